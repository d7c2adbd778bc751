"""Line dedup, Merkle manifests and vector codes against brute force and their SQL, with awkward tables."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import lines, merkle, vector_codes
from test_operators import CLASH, awkward, awkward_rows, empty, prose  # noqa: F401


# ------------------------------------------------------------------------------------------ lines


def brute_lines(rows: list[tuple]) -> list[tuple]:
    strip = " \t\n\x0b\x0c\r"
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(strip))
    holders = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if len(holders[key(x)]) < 5 or i == max((d for d in holders[key(x)] if d is not None), default=None)]
        out.append(((i is None, i or 0), len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_lines_against_brute_force(spark):
    r = random.Random(3)
    pool = [prose(i, 8) for i in range(12)] + ["short line", "", "É" * 39, "É" * 40, "K" + "é" * 45, "K" + "é" * 45, "x" * 40]
    rows = []
    for i in range(120):
        made = [r.choice(pool) for _ in range(r.randrange(0, 9))] + [prose(1000 + i, 9)]
        r.shuffle(made)
        rows.append((i * 7 % 120, "\n".join(r.choice(["", " ", "\t\r", "\x0b\x0c"]) + (x.upper() if x.isascii() and r.random() < 0.3 else x) + r.choice(["", "\r", " "]) for x in made)))
    rows += [(3, rows[5][1]), (3, rows[5][1]), (None, rows[7][1]), (None, pool[0]), (500, "\n".join(pool)), (501, None), (502, ""), (503, "\n"), (504, "\n\n" + pool[1] + "\n" + pool[1] + "\n")]
    rows += [(600 + i, pool[2]) for i in range(40)]  # all of a text is lost
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(7) for c in [*CLASH, "line", "place", "places", "version", "hash", "keeper", "n_lines"]}).repartition(5)
    got = sorted(((x.doc_id is None, x.doc_id or 0), x[1], x.n_dropped, x.kept) for x in lines.drop_lines(docs).collect())
    assert got == brute_lines(rows)
    assert lines.drop_lines(docs, carry=["place", "hash"]).columns == ["doc_id", "place", "hash", "n_lines", "n_dropped", "kept"]


def test_lines_awkward(awkward, empty):  # noqa: F811
    got = sorted(((x.doc_id is None, x.doc_id or 0), x.n_lines, x.n_dropped, x.kept) for x in lines.drop_lines(awkward).collect())
    assert got == brute_lines([x[:2] for x in awkward_rows()])
    assert lines.drop_lines(empty).count() == 0


def test_lines_shared_by_five(spark):
    shared = prose(77, 9)
    for n, lost in ((4, 0), (5, 4)):
        docs = spark.createDataFrame([(i, f"head {i}\n{shared}\n{shared}") for i in range(n)], "doc_id bigint, text string")
        out = {x.doc_id: x for x in lines.drop_lines(docs).collect()}
        assert sum(x.n_dropped == 2 for x in out.values()) == lost and out[n - 1].n_dropped == 0


# ----------------------------------------------------------------------------------------- Merkle


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(row: tuple) -> str:
    """row: doc_id, text, lang, source, n_chars."""
    doc_id, text, lang, source, n_chars = row
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def brute_tree(level: list[str], arity: int) -> tuple[str, list[list[tuple[list, list]]]]:
    proofs, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for k, a in enumerate(at):
            begin = a // arity * arity
            run = range(begin, min(begin + arity, len(level)))
            proofs[k].append(([level[j] for j in run if j < a], [level[j] for j in run if j > a]))
        level, at = [sha(*level[j : j + arity]) for j in range(0, len(level), arity)], [a // arity for a in at]
    return level[0], proofs


def brute_manifest(rows: list[tuple], arity: int = 3) -> list[tuple]:
    by = collections.defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(r)))
    trees = [brute_tree([brute_leaf(r) for r in by[s]], arity) for s in order]
    root, tops = brute_tree([t[0] for t in trees], arity)
    return sorted((brute_leaf(r), (r[0] is None, r[0] or 0), sub, root, sha(*[x for a, b in own + top for x in a + b])) for s, (sub, proofs), top in zip(order, trees, tops, strict=True) for r, own in zip(by[s], proofs, strict=True))


def made_rows(sizes: dict) -> list[tuple]:
    return [(i, prose(i, 5), "en", s, i) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]


@pytest.mark.parametrize("arity,sizes", [(3, {"a": 1}), (3, {None: 3}), (3, {"a": 4, "b": 1, None: 2}), (3, {"é": 81, "e": 82, "Z": 243, "z": 244, "a": 9}), (2, {"a": 17, "b": 33, "c": 1}), (3, {f"s{i}": 1 + i % 5 for i in range(130)}), (3, {"hot": 2200, "b": 5})])
def test_manifest_against_brute_force(spark, arity, sizes):
    rows = made_rows(sizes)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(5)
    out = merkle.manifest(docs, arity=arity, carry={"t": F.col("text")})
    out = out.select("id", "leaf", "subroot", "root", "t", merkle.proof_hash(F.col("segments")).alias("proof"), merkle.fold(F.col("leaf"), F.col("segments")).alias("folded"), merkle.fold(F.sha2(F.lit("other"), 256), F.col("segments")).alias("forged"))
    found = out.collect()
    assert sorted((x.leaf, (x.id is None, x.id or 0), x.subroot, x.root, x.proof) for x in found) == brute_manifest(rows, arity)
    assert all(x.folded == x.root != x.forged for x in found)
    texts = {r[0]: r[1] for r in rows}
    assert all(x.t == texts[x.id] for x in found)


def test_manifest_awkward(awkward, empty):  # noqa: F811
    found = merkle.manifest(awkward).withColumn("proof", merkle.proof_hash(F.col("segments"))).collect()
    assert sorted((x.leaf, (x.id is None, x.id or 0), x.subroot, x.root, x.proof) for x in found) == brute_manifest(awkward_rows())
    none = merkle.manifest(empty, carry={"key": F.col("key")})
    assert none.count() == 0 and none.columns == ["id", "leaf", "subroot", "root", "segments", "key"]


# ------------------------------------------------------------------------------------ vector codes


def brute_codes(rows: list[tuple], parts: int = 4, entries: int = 256, rounds: int = 4):
    """{row number: (code, error)} and the final entries; rows: vec_id, vector."""
    kept = [(k, r) for k, r in enumerate(rows) if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda x: (x[1][0] is None, x[1][0] or 0, list(x[1][1])))
    width = -(-max((len(r[1]) for _, r in kept), default=0) // parts) * parts
    data = [[math.floor(1024 * x) for x in r[1]] + [0] * (width - len(r[1])) for _, r in kept]
    step = width // parts
    out, books = {k: ["", 0] for k, _ in kept}, []
    for p in range(parts):
        own = [d[p * step : (p + 1) * step] for d in data]
        book = [list(v) for v in own[:entries]]
        near = lambda v, b: min((sum((x - y) ** 2 for x, y in zip(v, e, strict=True)), i) for i, e in enumerate(b))
        for _ in range(rounds):
            held = collections.defaultdict(list)
            for v in own:
                held[near(v, book)[1]].append(v)
            for i, vs in held.items():
                book[i] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
        for (k, _), v in zip(kept, own, strict=True):
            error, i = near(v, book)
            out[k][0] += f"{i:02x}"
            out[k][1] += error
        books.append(book)
    return {k: tuple(v) for k, v in out.items()}, books


@pytest.mark.parametrize("seed,width,entries", [(1, 8, 16), (2, 12, 5), (3, 4, 40)])
def test_codes_against_brute_force(spark, monkeypatch, seed, width, entries):
    monkeypatch.setattr(vector_codes, "LEAF", 4)
    monkeypatch.setattr(vector_codes, "SLICE_ROWS", 150)
    r = random.Random(seed)
    centres = [[r.uniform(-1, 1) for _ in range(width)] for _ in range(9)]
    rows = [(i * 3 % 700, [c + r.gauss(0, 0.05) for c in r.choice(centres)]) for i in range(500)]
    rows += [(5, [0.25] * width)] * 120 + [(None, [0.5] * width), (7, None), (8, [None] * width), (9, [float("nan")] * width), (10, [float("inf")] + [0.0] * (width - 1)), (11, [0.0] * (width - 3)), (-4, [])]
    table = spark.createDataFrame([(*x, k) for k, x in enumerate(rows)], "vec_id bigint, embedding array<double>, k int").withColumns({c: F.lit(1) for c in ("own", "vector", "carried", "code_", "trees")}).repartition(4)
    made = vector_codes.compress(table, carry=["k", "own", "vector", "trees"], entries=entries)
    want, books = brute_codes(rows, entries=entries)
    assert {x.k: (x.code, x.error) for x in made.rows.collect()} == want
    assert [b.tolist() for b in made.books] == books and made.rows.columns == ["vec_id", "k", "own", "vector", "trees", "code", "error"]
    assert made.sha256() == sha(",".join(str(x) for b in books for e in b for x in e))


def test_smallest_ids_are_cut_by_a_quantile(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "ACCURACY", 50)
    rows = spark.range(20_000).select(((F.col("id") * 7919) % 20_000 - 500).alias("own"), F.array(F.lit(1.0)).alias("vector")).repartition(6)
    cut = vector_codes.smallest(rows, 20_000, 16)
    assert sorted(r.own for r in cut.collect())[:16] == list(range(-500, -484)) and cut.count() < 2000
    assert vector_codes.smallest(rows, 20, 16).count() == 20_000 and vector_codes.smallest(rows.withColumn("own", F.col("own").cast("string")), 20_000, 16).count() == 20_000


def test_tree_balls_hold_their_points():
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.integers(-900, 900, (700, 5)), np.repeat(rng.integers(-900, 900, (1, 5)), 300, 0)])
    tree = vector_codes.Tree.unpack(vector_codes.build(points).pack())
    assert sorted(tree.places.tolist()) == list(range(1000)) and (tree.points == points[tree.places]).all()
    for a, b, total, centre, radius in zip(tree.start, tree.end, tree.total, tree.centre, tree.radius, strict=True):
        own = tree.points[a:b]
        assert (own.sum(0) == total).all() and np.sqrt(((own - centre) ** 2).sum(1)).max() <= radius * (1 + 1e-12)
    below = collections.defaultdict(list)
    for k, up in enumerate(tree.parent[1:], 1):
        below[up].append(k)
    for up, kids in below.items():
        assert not tree.leaf[up] and (tree.start[kids[0]], tree.end[kids[-1]]) == (tree.start[up], tree.end[up]) and all(tree.end[a] == tree.start[b] for a, b in zip(kids, kids[1:], strict=False))
    assert sum(b - a for a, b, leaf in zip(tree.start, tree.end, tree.leaf, strict=True) if leaf) == 1000


def test_balls_are_owned_whole(monkeypatch):
    """Well parted clusters are settled by cached sums: hardly a point is looked at."""
    rng = np.random.default_rng(3)
    centres = rng.integers(-900, 900, (20, 8))
    points = (centres[rng.integers(0, 20, 3000)] + rng.integers(-9, 9, (3000, 8))).astype(np.int64)
    looked = []
    exact = vector_codes.nearest
    monkeypatch.setattr(vector_codes, "nearest", lambda p, e: looked.append(len(p)) or exact(p, e))
    codes, sums, counts = vector_codes.assign(vector_codes.build(points), centres)
    assert sum(looked) < 100 and counts.sum() == 3000 and (sums.sum(0) == points.sum(0)).all()
    order = vector_codes.build(points).places
    assert (codes == exact(points[order], centres)).all()


def test_large_components_are_exact():
    rng = np.random.default_rng(4)
    points = rng.integers(-(1 << 26), 1 << 26, (200, 3))
    entries = points[:7].copy()
    codes, _, _ = vector_codes.assign(vector_codes.build(points), entries)
    places = vector_codes.build(points).places
    assert codes.tolist() == [min((sum((int(x) - int(y)) ** 2 for x, y in zip(p, e, strict=True)), i) for i, e in enumerate(entries))[1] for p in points[places]]
    with pytest.raises(ValueError, match="too large"):
        vector_codes.scaled(np.array([70000.0]))


def test_codes_of_odd_tables(spark):
    schema = "vec_id bigint, embedding array<float>, label string"
    assert vector_codes.compress(spark.createDataFrame([], schema)).rows.count() == 0
    only_bad = spark.createDataFrame([(1, None, "a"), (2, [None], None)], schema)
    none = vector_codes.compress(only_bad, carry=["label"])
    assert none.rows.count() == 0 and none.sha256() == sha("")
    few = spark.createDataFrame([(1, [0.5, 0.25, -0.125, 1.0], "a"), (2, [], None), (2, [], None)], schema)
    made = vector_codes.with_label_error(vector_codes.compress(few, carry=["label"]).rows, "label")
    assert sorted(map(tuple, made.select("vec_id", "code", "error", "label_error").collect())) == [(1, "00000000", 0, 0), (2, "01010101", 0, 0), (2, "01010101", 0, 0)]
