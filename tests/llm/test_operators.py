"""The training-data operators against brute force, round trips and awkward tables."""

import collections
import hashlib
import random
import re
import time
import types
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from logloom.llm import chat, components, exact_dedup, html_text, jaccard, labelled, media, mixing, pieces, quality, registry, substring_dedup, toxicity
from logloom.llm.common import WHITE

SF = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
#: Columns whose names an operator might use inside.
CLASH = ["key", "hit", "row", "size", "kept", "id", "n", "own", "ref", "full", "copies", "tokens_", "_bit", "component", "turn", "lost", "whole"]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def awkward_rows() -> list[tuple]:
    base = prose(1, 120)
    near = base.replace(base.split()[60], "changed", 1)
    long = prose(2, 30_000)
    texts = [base, near, base, None, "", " \t\n", "one", "One", "two words", prose(3, 60), long, long + " end", base.upper(), "x" * 100_000, "aé€𝔘 " * 50, base + " " + prose(4, 80)]
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[3], (None, base, None, None, None), (None, None, None, None, None), (2, "other text of a repeated id", "en", "s1", 5)]


@pytest.fixture(scope="module")
def awkward(spark):
    frame = spark.createDataFrame(awkward_rows(), "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return frame.withColumns({c: F.lit(7) for c in CLASH}).repartition(3)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.where("false")


def words(text: str) -> list[bytes]:
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return [w for w in re.split(b"[" + re.escape(WHITE) + b"]+", data) if w]


def shingles(text: str) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(sets: list[frozenset]) -> list[int]:
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                ra, rb = root(i), root(j)
                parent[max(ra, rb)] = min(ra, rb)
    return [root(i) for i in range(len(sets))]


# ------------------------------------------------------------------------------------- mixing


def test_mix_targets(spark, documents):
    rows = mixing.mix(documents).collect()
    by = collections.defaultdict(lambda: [0, 0, 0.0, 0])
    sources = {r.doc_id: r.source for r in documents.select("doc_id", "source").collect()}
    for r in rows:
        b = by[sources[r.doc_id]]
        b[0] += r.size
        b[1] += r.taken
        b[2], b[3] = r.target, max(b[3], r.size)
        assert r.taken in (0, r.size, 2 * r.size)
    assert abs(sum(b[2] for b in by.values()) - 1.5 * sum(b[0] for b in by.values())) < 1e-6
    assert all(abs(b[1] - b[2]) <= 1.5 * b[3] and b[2] <= 2 * b[0] + 1e-9 for b in by.values())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(documents.repartition(5)).collect()))


def test_mix_level(spark):
    s = spark.createDataFrame([("a", 10, 5.0, 1), ("b", 100, 2.0, 2), ("c", 1000, 1.0, 3), ("d", 0, 5.0, 4)], "s string, source_size bigint, weight double, rank_ int")
    got = {r.s: r.target for r in mixing.levelled(s, 1.5, 2.0).collect()}
    assert got == {"a": 20.0, "b": 200.0, "c": 1665.0 - 220.0, "d": 0.0}


def test_mix_awkward(awkward, empty):
    out = mixing.mix(awkward).collect()
    assert sorted(r.size for r in out) == sorted(len(words(t)) for _, t, *_ in awkward_rows())
    assert mixing.mix(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0
    clashing = awkward.withColumns({c: F.lit(3) for c in ("rate", "before", "copies_", "place_", "id_", "size_", "tie_", "carried_", "row__", "target")})
    carried = mixing.mix(clashing.drop("copies", "size"), carry=["rate", "before", "id_", "place_", "tie_", "carried_"])
    assert carried.columns[:7] == ["doc_id", "rate", "before", "id_", "place_", "tie_", "carried_"] and sorted(r.taken for r in carried.collect()) == sorted(r.taken for r in out)
    texts = lambda f: sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in mixing.mixed_rows(f).collect())
    assert texts(clashing) == texts(clashing.repartition(7, "text"))
    whole = mixing.mixed_rows(awkward)
    assert whole.columns == awkward.columns
    assert sum(r.copies for r in out) == whole.count()


# ------------------------------------------------------------------------------------ exact dedup


def test_exact_awkward(awkward, empty):
    rows = awkward_rows()
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    out = exact_dedup.exact_groups(awkward, digest="sha", full="full_").collect()
    assert all((r.full_ is not None) == (r.group_size > 1) for r in out if r.full_ is None or r.group_size > 1)
    lengths = collections.Counter(len((t or "").encode()) for _, t, *_ in rows)
    assert {r.n for r in exact_dedup.repeated_lengths(awkward, "doc_id", "text").collect()} == {n for n, c in lengths.items() if c > 1}
    assert len(out) == len(rows)
    kept = collections.Counter()
    largest = {hashlib.sha256(t.encode()).hexdigest(): (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}
    for r in out:
        assert (r.keep_id, r.group_size) == largest[r.sha]
        kept[r.sha] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}
    left = exact_dedup.drop_exact(awkward)
    assert left.columns == awkward.columns
    assert sorted((r.text or "") for r in left.select("text").collect()) == sorted(groups)
    assert exact_dedup.drop_exact(empty).count() == 0 and exact_dedup.exact_groups(empty).count() == 0


# ------------------------------------------------------------------------------------ near copies


def test_components_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100)], "u bigint, v bigint")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


@pytest.mark.parametrize("frequent,combine,tile,rounds", [(48, 64, 512, 2), (1, 3, 4, 0), (1, 500, 3, 1)])
def test_jaccard_against_brute_force(spark, monkeypatch, frequent, combine, tile, rounds):
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "COMBINE", combine)
    monkeypatch.setattr(jaccard, "TILE", tile)
    r = random.Random(9)
    texts = []
    passage = prose(50, 40).split()
    for g in range(12):
        original = prose(100 + g, r.randrange(8, 150)).split()
        for _ in range(r.randrange(1, 9)):
            copy = list(original)
            for _ in range(r.randrange(0, 7)):
                copy[r.randrange(len(copy))] = f"edit{r.randrange(10**6)}"
            texts.append(" ".join(copy + (passage if r.random() < 0.4 else [])))
    texts += ["", None, "a b", "A  b", "a b c d e", "a b c d e"]
    docs = spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(4)
    want = brute_components([shingles(t) for t in texts])
    got = {x.id: (x.n_shingles, x.component_id) for x in jaccard.link_documents(docs).collect()}
    assert got == {i * 3: (len(shingles(t)), want[i] * 3) for i, t in enumerate(texts)}


def test_jaccard_words_that_break_polynomial_hashes():
    morse = ["a" if bin(i).count("1") % 2 else "b" for i in range(2048)]
    for n in (8, 9, 1024, 2048):
        a, b = "".join(morse[:n]), "".join("ab"[c == "a"] for c in morse[:n])
        offsets, tokens, _ = jaccard.shingle_sets(pa.array([a, b, a.upper(), f"x {a}", f"x {b}", a[:-1]], pa.large_string()), 5)
        assert tokens[0] == tokens[2] and len(set(tokens.tolist())) == 5


def test_reach_loses_no_pair():
    r = np.random.default_rng(3)
    for percent in (50, 75, 90):
        for _ in range(3000):
            n, m = r.integers(1, 300, 2)
            common = int(r.integers(0, min(n, m) + 1))
            s, z = (int(r.integers(common, x + 1)) for x in (n, m))
            low, high = jaccard.reach(np.array([n, m]), np.array([s, z]), percent)
            if 100 * common >= percent * (n + m - common) and common:
                assert high[0] >= low[1] and high[1] >= low[0]
                assert jaccard.can_link(np.array([7, 7], np.uint64), low.astype(np.int64), high.astype(np.int64)).all()
    group, low, high = np.array([1, 1, 2, 2, 2, 3]), np.array([10, 12, 10, 50, 30, 0]), np.array([12, 10, 9, 60, 8, 0])
    assert jaccard.can_link(group, low, high).tolist() == [True, True, False, True, False, True]
    assert len(jaccard.can_link(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


def letters(count: int) -> list[str]:
    """Letters that share 92 of 120 words: no two are similar, all share their keys."""
    body = prose(4321, 92)
    return [f"{prose(50_000 + i, 28)} {body}" for i in range(count)]


def test_letters_are_told_apart_without_pairs(spark, monkeypatch):
    """Classes that share keys without linking cost nothing in verification; the near copies among them are found."""
    made = letters(600)
    copies = {5: made[5].replace(made[5].split()[3], "edited", 1), 77: made[77] + " more words behind"}
    rows = [(i, t) for i, t in enumerate(made)] + [(1000 + i, t) for i, t in copies.items()]
    assert max(len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) for a, b in zip(made[:20], made[20:40], strict=True)) < 0.7
    seen = []
    real = jaccard.block_links
    monkeypatch.setattr(jaccard, "block_links", lambda profiles, blocks, percent: seen.append(blocks.count()) or real(profiles, blocks, percent))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {x.id: x.component_id for x in jaccard.link_documents(docs).collect()}
    assert got == {i: i for i in range(600)} | {1005: 5, 1077: 77} and seen[0] < 20


def test_jaccard_tokens_are_not_shuffled_for_filters(spark, monkeypatch):
    """Where no table is small enough to broadcast, tokens of classes that go no further are not sorted and joined to find that out."""
    plans = {}
    real = jaccard.staged

    def seen(df, label, *codec):
        plans.setdefault(label, df._jdf.queryExecution().executedPlan().toString())
        return real(df, label, *codec)

    monkeypatch.setattr(jaccard, "staged", seen)
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    texts = [prose(i // 2, 60) + f" end{i}" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for name in names:
        spark.conf.set(name, "-1")
    try:
        got = {x.id: x.component_id for x in jaccard.link_documents(docs).collect()}
    finally:
        for name in names:
            spark.conf.unset(name)
    assert got == {i: i - i % 2 for i in range(40)}
    assert not {p for p in plans if "SortMergeJoin" in plans[p]} & {"jaccard-sets", "jaccard-profiles", "jaccard-open"}


def test_jaccard_still_open_keeps_all_classes_of_a_key(spark):
    pairs = spark.createDataFrame([(2, 1, 3), (3, 1, 1), (4, 1, 2), (6, 5, 1), (8, 7, 1)], "ref bigint, head bigint, c bigint")
    linked = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)], "node bigint, component bigint")
    assert {r.ref for r in jaccard.still_open(pairs, linked).collect()} == {1, 2, 3, 4, 7, 8}


def test_jaccard_profiles_know_a_size_only_of_given_classes(spark, monkeypatch):
    """Chance hits of full bitmaps get no row; copies and repeats of a row count once."""
    monkeypatch.setattr(jaccard, "in_bitmap", lambda bitmap, bits: np.ones(len(bits), bool))
    a, b = prose(1, 40), prose(1, 40) + " more"
    docs = spark.createDataFrame([(1, a), (1, a), (2, b), (1, b + " words"), (3, a)], "doc_id bigint, text string").repartition(3)
    sets = jaccard.sketch(docs, "doc_id", "text", 5).where(F.col("id") < 3).dropDuplicates(["f1"]).toPandas()
    sets = sets[sets["n"] < sets["n"].max()]
    classes = spark.createDataFrame([tuple(int(x) for x in r) for r in sets[["id", "f1", "f2", "n"]].to_numpy()], "id bigint, f1 bigint, f2 bigint, n bigint")
    rows = jaccard.token_profiles(docs, classes, "doc_id", "text", 5, 4).collect()
    assert {r.ref: (r.n, len(r.tokens) // 8) for r in rows} == {int(f): (int(n), int(n)) for f, n in zip(sets["f1"], sets["n"], strict=True)}


def test_jaccard_awkward(awkward, empty):
    rows = awkward_rows()
    want = brute_components([shingles(t) for _, t, *_ in rows])
    least = collections.defaultdict(list)
    for c, (i, *_) in zip(want, rows, strict=True):
        least[c].append(i)
    expected = sorted(((i is None, i or 0), len(shingles(t)), min((x for x in least[c] if x is not None), default=None)) for c, (i, t, *_) in zip(want, rows, strict=True))
    got = sorted(((r.id is None, r.id or 0), r.n_shingles, r.component_id) for r in jaccard.link_documents(awkward).collect())
    assert got == expected
    assert jaccard.link_documents(empty).count() == 0


# -------------------------------------------------------------------------------------- passages


def brute_passages(rows: list[tuple], width: int = 50) -> list[tuple]:
    data = [((1 << 62) if i is None else i, (t or "").encode()) for i, t, *_ in rows]
    first: dict[bytes, int] = {}
    for i, b in data:
        for k in range(len(b) - width + 1):
            w = b[k : k + width]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if first[b[k : k + width]] < i:
                gone[k : k + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("width", [23, 31, 50, 64])
def test_suffixes_are_sorted_by_cover_ranks(width):
    r = random.Random(width)
    unit = bytes(r.choices(b"ab", k=90))
    data = b"".join(r.choice([unit, unit[:40], b"a" * 70, bytes(r.choices(b"abc", k=60))]) for _ in range(60))
    at = np.array(r.sample(range(len(data) - width), 1500))
    order, classes = substring_dedup.sorted_suffixes(np.frombuffer(data, np.uint8), at, width)
    texts = [data[i : i + width] for i in at[order].tolist()]
    assert [t[:16] for t in texts] == sorted(t[:16] for t in texts)
    groups = collections.defaultdict(set)
    for c, t in zip(classes.tolist(), texts, strict=True):
        groups[t].add(c)
    assert all(len(c) == 1 for c in groups.values()) and len({c for g in groups.values() for c in g}) == len(groups) < len(at)


def test_cover_ranks_sort_by_depth():
    data = bytes(random.Random(1).choices(b"ab", k=3000))
    n = len(data) - 60
    for depth in (8, 11, 43, 57):
        ranks = substring_dedup.cover_ranks(substring_dedup.eights(np.frombuffer(data, np.uint8), n), n - 60, depth)
        place = [p for p in range(n - 130) if p % substring_dedup.PERIOD in substring_dedup.COVER]
        texts = sorted({data[p : p + depth] for p in place})
        byrank = sorted(place, key=lambda p: ranks[p])
        assert [data[p : p + depth] for p in byrank] == sorted(data[p : p + depth] for p in place) and len({int(ranks[p]) for p in place}) == len(texts)


@pytest.mark.parametrize("hot", [256, 0])
def test_passages_against_brute_force(spark, empty, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    passage = prose(7, 30)
    rows = [r[:2] for r in awkward_rows() if len(r[1] or "") < 2000]
    rows += [(200 + i, f"{prose(300 + i, 15)} {passage[: 60 + 9 * i]} {prose(400 + i, 9)}{'ab' * 40}") for i in range(8)]
    rows += [(300, "ab" * 200), (301, "b" + "ab" * 60), (302, passage[:49]), (303, passage[:50])]
    # A third of the documents share a passage; two very long texts share parts; copies in other order.
    rows += [(400 + i, f"{prose(600 + i, 12)} {passage} {prose(700 + i, 12)}" if i % 3 == 0 else prose(600 + i, 40)) for i in range(60)]
    long = prose(800, 25_000)
    rows += [(500, long), (499, prose(801, 9_000) + long[70_000:150_000] + "é€𝔘" * 40), (501, long[100:90_000]), (502, long)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(7) for c in [*CLASH, "start", "windows", "places", "sha"]}).repartition(3)
    got = sorted(((r.id is None, r.id or 0), (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in substring_dedup.strip_repeats(docs).collect())
    assert got == sorted(((r[0] is None, r[0] or 0), b) for r, b in zip(rows, brute_passages(rows), strict=True))
    assert substring_dedup.strip_repeats(empty).count() == 0


def test_passages_spans_on_documents(documents):
    rows = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    for r in substring_dedup.strip_repeats(documents).collect():
        data, at, kept = rows[r.id].encode(), 0, b""
        for s in r.spans:
            kept, at = kept + data[at : s.start], s.end
        assert hashlib.sha256(kept + data[at:]).hexdigest() == r.kept_sha256


class Steps:
    """Stands for a table: keeps the functions that are to run over it."""

    def __init__(self):
        self.found = []

    def mapInArrow(self, f, schema):  # noqa: N802
        self.found.append(f)
        return self

    def groupBy(self, *names):  # noqa: N802
        return self

    applyInArrow = mapInArrow  # noqa: N815


def noise(r: random.Random, n: int) -> str:
    return "".join(r.choices("bcdfghjklmnpqrstvwxz", k=n))


def sampled_gram(r: random.Random) -> str:
    """20 letters that are sampled wherever they stand."""
    while True:
        gram = noise(r, 20)
        data = [np.frombuffer(f"{noise(r, 60)}{gram}{noise(r, 60)}".encode(), np.uint8) for _ in range(40)]
        if all(60 in substring_dedup.samples(d, np.array([0, 140]), 50, 20)[0] for d in data):
            return gram


def passage_places(texts: list[str], at_once: int) -> tuple[dict, list]:
    """Of shared_samples(): the places by text, with the texts' numbers as ref, and the hot names."""
    steps = Steps()
    substring_dedup.shared_samples(steps, 50, 20, 1)
    entries, shared = steps.found
    batches = [pa.RecordBatch.from_pydict({"ref": pa.array(range(len(texts))[i : i + at_once], pa.int64()), "text": texts[i : i + at_once]}) for i in range(0, len(texts), at_once)]
    found = shared(pa.Table.from_batches(entries(iter(batches))))
    rows = substring_dedup.places_of(found.filter(pa.compute.is_valid(found["part"]))).to_pylist()
    return {r["ref"]: r["places"] for r in rows}, found.filter(pa.compute.is_null(found["part"]))["places"].to_pylist()


def passage_stretches(texts: list[str], places: dict, hot: list, at_once: int):
    """Of marked_suffixes(): the stretches that are shipped, and the function that sorts a bucket."""
    steps, bits = Steps(), np.zeros(1 << 26, bool)
    bits[substring_dedup._hot_bits(np.frombuffer(b"".join(hot), np.uint64))] = True
    substring_dedup.marked_suffixes(steps, types.SimpleNamespace(value=np.packbits(bits, bitorder="little").tobytes()), 50, 20, 1)
    stretches, sort_buckets = steps.found
    own = sorted(places)
    parts = [own[i : i + at_once] for i in range(0, len(own), at_once)]
    batches = [pa.RecordBatch.from_pydict({"id": pa.array(p, pa.int64()), "ref": pa.array(p, pa.int64()), "text": [texts[i] for i in p], "places": [places[i] for i in p]}) for p in parts]
    return pa.Table.from_batches(stretches(iter(batches))), sort_buckets


@pytest.mark.parametrize("at_once", [1, 7, 100])
def test_passages_that_share_a_gram_only_stay_at_home(at_once):
    r = random.Random(5)
    gram = sampled_gram(r)
    texts = [f"{noise(r, 60)}{gram}{noise(r, 60)}" for _ in range(100)]
    assert passage_places(texts, at_once) == ({}, [])  # all 100 have it sampled
    # Two of them share what stands before it too: their left sides may travel, the right ones and the others not.
    texts[3] = texts[3][:30] + texts[70][30:60] + texts[3][60:]
    places = {ref: set(np.frombuffer(p, np.uint32).tolist()) for ref, p in passage_places(texts, at_once)[0].items()}
    assert set(places) == {3, 70} and all(120 in p and 121 not in p for p in places.values())


@pytest.mark.parametrize("hot", [1000, 30, 2])
def test_passages_of_a_hot_gram_travel_by_sides(monkeypatch, hot):
    r = random.Random(6)
    gram, ends = sampled_gram(r), [noise(r, 16) for _ in range(20)]
    texts = [f"{noise(r, 60)}{gram}{end}{noise(r, 60)}" for end in ends for _ in range(4)]  # 80 have the gram, 4 each what follows
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    places, names = passage_places(texts, 10)
    assert bool(names) == (hot < 80)
    shipped, sort_buckets = passage_stretches(texts, places, names, 10)
    windows = np.frombuffer(b"".join(shipped["windows"].to_pylist()), np.uint16)
    assert (windows > 1).all() if hot > 4 else (windows == 1).any()  # a side of 4 is not hot, so it doesn't travel suffix by suffix
    marks = sort_buckets(shipped)
    assert len(marks) == 0  # no 50 bytes are repeated


def test_passages_equal_stretches_are_sorted_once(monkeypatch):
    passage = noise(random.Random(7), 2_000)
    texts = [passage, *(chr(32 + i) + passage + chr(32 + i) for i in range(1, 41))]
    shipped, sort_buckets = passage_stretches(texts, *passage_places(texts, 1), 1)
    sizes, plain = [], substring_dedup.sorted_suffixes
    monkeypatch.setattr(substring_dedup, "sorted_suffixes", lambda data, at, width: sizes.append(len(at)) or plain(data, at, width))
    marks = sort_buckets(shipped)
    assert sum(sizes) < 3 * 2_000  # of 41 times 1,951
    found = collections.defaultdict(list)
    for ref, m in zip(marks["ref"].to_pylist(), marks["mark"].to_pylist(), strict=True):
        found[ref].append(m)
    assert sorted(found) == list(range(1, 41)) and all(substring_dedup.removed_runs(np.array(m), 50) == [(1, 2_001)] for m in found.values())


@pytest.mark.parametrize("hot", [12, 3])
def test_passages_with_hot_grams_and_sides_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    r = random.Random(8)
    gram, ends = sampled_gram(r), [noise(r, 33) for _ in range(6)]
    rows = [(i, f"{noise(r, 40)}{gram}{r.choice(ends)[: r.randrange(10, 34)]}{noise(r, 40)}") for i in range(60)]
    rows += [(100 + i, rows[i][1][r.randrange(30) :] + noise(r, 20)) for i in range(20)] + [(90, rows[5][1]), (4, rows[7][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = sorted((x.id, (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256)) for x in substring_dedup.strip_repeats(docs).collect())
    assert got == sorted(zip([i for i, _ in rows], brute_passages(rows), strict=True))


# ----------------------------------------------------------------------------------- classifiers


def test_quality(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = lambda c: labelled.fold(c, 5) == 0
    texts = labelled.sample(documents, labels, "quality", 10_000, held)
    free = {r.text for r in documents.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    assert texts[0] and texts[1] and all(t in free for y in texts for t in texts[y])
    good, bad = [prose(i, 80) for i in range(60)], [" ".join([f"{w} {w} {w} | ***" for w in prose(i, 20).split()]) for i in range(500, 560)]
    model = quality.fit_texts(good, bad)
    s = quality.score_texts([prose(900, 70), " ".join(["mu3 mu3 mu3 | ***"] * 20), ""], model)
    assert s[0] > 0.5 > s[1] and 0 <= s[2] <= 1
    out = documents.select(quality.score(F.col("text"), model).alias("s")).agg(F.min("s"), F.max("s"), F.count("s")).first()
    assert 0 <= out[0] <= out[1] <= 1 and out[2] == documents.count()
    assert list(quality.score_texts(["x"], quality.fit_texts(["a"], []))) == [1.0]


def test_quality_against_brute_force():
    """The features and the score, computed text by text from zstandard's own results."""
    import zstandard

    r = random.Random(4)
    good, bad = [prose(i, r.randint(5, 90)) for i in range(80)], [" ".join(r.choices(["xx", "buy", "!!!", "now"], k=r.randint(5, 90))) for _ in range(80)]
    model = quality.fit_texts(good, bad)
    texts = ["", " ", "\t\n", "word", prose(7, 70), prose(7, 70), "x" * 100_000, prose(8, 20_000), "buy now !!! " * 30, "aé€𝔘 " * 50]
    rows = []
    for t in texts:
        data = t.encode()
        own = {"level": quality.LEVEL, "write_content_size": False, "write_dict_id": False, "write_checksum": False}
        g, b, p = (len(zstandard.ZstdCompressor(**own, **({"dict_data": zstandard.ZstdCompressionDict(d)} if d else {})).compress(data)) for d in (model.good, model.bad, None))
        n = len(data)
        x = [(b - g) / (n + 16), (b - g) / (p + 16), g / (n + 16), p / (n + 16), np.log1p(n) / 10] if n else [0.0] * 5
        x += [v * v for v in x] + [x[0] * v for v in x[2:]]
        z = sum(w * (v - c) / s for w, v, c, s in zip(model.weights, x, model.centre, model.scale, strict=False)) + model.weights[-1]
        rows.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
    got = quality.score_texts(texts, model)
    assert np.allclose(got, rows) and got[4] == got[5] and got[4] > 0.5 > got[8]


def test_quality_awkward(awkward, empty):
    model = quality.fit_texts([prose(i, 80) for i in range(60)], ["xx buy !!! now " * (i % 9 + 3) for i in range(60)])
    rows = awkward.withColumn("s", quality.score(F.col("text"), model)).select("text", "s").collect()
    assert len(rows) == len(awkward_rows()) and all(0 <= r.s <= 1 for r in rows)
    same = collections.defaultdict(set)
    for r in rows:
        same[r.text or ""].add(r.s)
    assert all(len(s) == 1 for s in same.values()) and len({s for v in same.values() for s in v}) > 5
    assert empty.withColumn("s", quality.score(F.col("text"), model)).count() == 0


def test_label_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "x" * 1000) for i in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    texts = labelled.sample(docs, labels, "quality", 15, class_bytes=7500)
    assert {y: len(v) for y, v in texts.items()} == {0: 7, 1: 7}


def test_toxicity():
    r = random.Random(4)
    clean = [prose(i, 60) for i in range(120)]
    toxic = []
    for i in range(120):
        w = prose(1000 + i, r.choice([10, 60, 400])).split()
        for bad in r.sample(["blighter", "nincompoop", "muckhead"], 2):
            w.insert(r.randrange(len(w)), bad)
        toxic.append(" ".join(w))
    model = toxicity.fit_texts(toxic[:90], clean[:90])
    s = toxicity.score_texts(pa.array([*toxic[90:], *clean[90:], "", prose(5, 20_000)], pa.large_string()), model)
    assert (s[:30] >= 0.3).mean() > 0.9 and (s[30:60] < 0.3).all() and s[60] < 0.3 and s[61] < 0.3
    assert list(toxicity.score_texts(pa.array(["x"], pa.large_string()), toxicity.fit_texts([], []))) == [0.0]


def test_toxicity_against_brute_force():
    """Scores from the n-grams of code points counted text by text."""
    r = random.Random(5)
    texts = ["".join(r.choices("abÄäßéñ 𝔘z", k=r.randint(0, 80))) for _ in range(120)]
    toxic = [t + " schwachköpfig ÑOÑO" for t in texts[:40]]
    model = toxicity.fit_texts(toxic, texts[40:100])
    weight = dict(zip(model.slots.tolist(), model.weights.tolist(), strict=True))

    def slot(gram):
        data = np.frombuffer(gram.encode("utf-32-le"), np.uint32)
        return int(toxicity.spans_hash(toxicity.running(data), np.array([0]), np.array([len(data)]))[0] >> np.uint64(64 - toxicity.TABLE_BITS))

    tried = ["", "SCHWACHKÖPFIG", "x schwachköpfig", *texts[100:], toxic[0], "é" * 5000]
    for t, s in zip(tried, toxicity.score_texts(pa.array(tried, pa.large_string()), model), strict=True):
        low = t.lower()
        slots = {slot(low[i : i + n]) for n in toxicity.LENGTHS for i in range(len(low) - n + 1)}
        assert abs(s - 1 / (1 + np.exp(-model.intercept - sum(weight.get(k, 0.0) for k in slots)))) < 1e-9
    assert toxicity.score_texts(pa.array(["SCHWACHKÖPFIG"], pa.large_string()), model)[0] == toxicity.score_texts(pa.array(["schwachköpfig"], pa.large_string()), model)[0]


def test_toxicity_keeps_every_significant_feature():
    r = random.Random(8)
    passage = "".join(r.choices("bcdfghjklmnpqrstvwxz", k=1700))
    clean = [prose(i, 60) for i in range(200)]
    toxic = [f"{prose(1000 + i, 40)} {passage}" for i in range(130)] + [f"{prose(2000 + i, 40)} blighter {prose(3000 + i, 20)}" for i in range(70)]
    model = toxicity.fit_texts(toxic, clean)
    rare = next(toxicity.grams(pa.array(["blighter"], pa.large_string())))[3]
    assert len(model.slots) > 5000 and set(rare.tolist()) <= set(model.slots.tolist())
    s = toxicity.score_texts(pa.array([f"{prose(5, 40)} {w} {prose(6, 20)}" for w in ("blighter", "neighbour")], pa.large_string()), model)
    assert s[0] > 0.5 > s[1]


def test_toxicity_awkward(awkward, empty):
    model = toxicity.fit_texts(["bad word here"] * 5, ["fine words here"] * 5)
    assert awkward.withColumn("s", toxicity.score(F.col("text"), model)).where("s between 0 and 1").count() == len(awkward_rows())
    assert empty.withColumn("s", toxicity.score(F.col("text"), model)).count() == 0


# ------------------------------------------------------------------------------------------- HTML

LONG = "This is the story of a man who was in the house and of what he had to say to us about it all. "
PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h2>Site</h2><a href=/>Home</a></header><nav><ul><li><a href=x>Menu</a></ul></nav>
<div class="cookie-notice">We use cookies &amp; more</div><main><article><h1>A &lt;title&gt;</h1><p>{0}<b>bold</b> end.<p>Short one.<br>same<br><br>new block</p><script>var x="<p>no</p>";</script>
<div class="ad-box">{0}</div><form><p>{0}</p></form><table><tr><td>a<td>b</table></article><section id="comments"><p>{0}</p></section></main><aside>{0}</aside><footer>{0}</footer></body></html>""".replace("{0}", LONG)


def test_html():
    want = ["A <title>", LONG + "bold end.", "Short one. same", "new block", "a b"]
    assert html_text.extract(PAGE).split("\n") == [" ".join(w.split()) for w in want]
    plain = f"<div class=menu><a>Home</a></div><h1>Head</h1><p>{LONG * 4}</p><p>Short.</p><p>{LONG * 4}</p><div id=sidebar>{LONG * 5}</div>"
    assert [b[:6] for b in html_text.extract(plain).split("\n")] == ["Head", "This i", "Short.", "This i"]
    for odd in (None, "", "<", "<<<>>>", "text only", "<!-- never closed <p>x", "<script>never closed", "<p", "a < b", "&#x41;&nbsp;&bogus;", "<article><p>Tiny.</article>", "<nav><article><p>" + LONG):
        assert isinstance(html_text.extract(odd), str)
    assert html_text.extract("<article><p>Tiny.</article>") == "Tiny." and html_text.extract("<nav>x<article><p>" + LONG) == LONG.strip()


def by_hand(page: str) -> list[tuple[str, bool]]:
    """Blocks of a page whose block elements are p, h1, li and div, none nested, and whether each is decided True by its own words."""
    out = []
    for body in re.findall(r"<(?:p|h1|li|div)>(.*?)</(?:p|h1|li|div)>", page, re.S):
        text = " ".join(re.sub("<[^>]*>", "", body).split())
        linked = sum(len(x) for x in re.findall(r"<a href=x>(.*?)</a>", body))
        tokens = text.lower().split()
        stops = sum(w in html_text.STOP_WORDS for w in tokens) / len(tokens)
        out.append((text, False if linked > 0.33 * len(text) else True if len(text) >= 200 and stops >= 0.3 else None))
    return out


def test_html_rules_against_brute_force():
    """Pages without any markup of their parts: each pass decides blocks, and without either the outcome is another."""
    r = random.Random(12)
    changed = [0, 0]
    for _ in range(200):
        parts = []
        for _ in range(r.randint(1, 12)):
            kind = r.choice(["long", "short", "links", "words"])
            parts.append({"long": f"<p>{LONG * 3}{r.randrange(99)}</p>", "short": f"<p>Short {r.randrange(999)}.</p>", "links": f"<li><a href=x>{'Menu entry ' * r.randint(1, 4)}</a></li>", "words": f"<div>{prose(r.randrange(999), 12)}</div>"}[kind])
        page = "".join(parts)
        rows = by_hand(page)
        labels = []
        for i, (_, label) in enumerate(rows):
            if label is None:
                before = [j for j in range(i) if rows[j][1] is not None][-1:]
                after = [j for j in range(i + 1, len(rows)) if rows[j][1] is not None][:1]
                near = sorted((abs(i - j), rows[j][1]) for j in before + after)
                label = near[0][1] if near else True  # at equal distance False comes first
            labels.append(label)
        assert html_text.extract(page) == "\n".join(t for (t, _), k in zip(rows, labels, strict=True) if k)
        changed[0] += False in [x for _, x in rows] and True in [x for _, x in rows]
        changed[1] += any(x is None and k is False for (_, x), k in zip(rows, labels, strict=True)) and any(x is None and k for (_, x), k in zip(rows, labels, strict=True))
    assert min(changed) > 20


def test_html_plain_short_paragraphs():
    page = "<div class=menu><a href=x>Home</a></div><div>Two short words.</div><div>And some more.</div><div id=footer>Imprint</div>"
    assert html_text.extract(page) == "Two short words.\nAnd some more."
    links = "<article><p>" + LONG * 2 + "</p><ul><li><a href=x>" + "Read this too " * 4 + "</a></li></ul><p>Short.</p><p>" + LONG + "</p></article>"
    assert html_text.extract(links).split("\n") == [" ".join((LONG * 2).split()), "Short.", LONG.strip()]


@pytest.mark.parametrize("name", "content-with-sidebar|no-sidebar|page has-comments|l-side|social-science|cookie-recipes|share-price|notice-board|main-head|sidebar|comments|ad-box|promo content".split("|"))
@pytest.mark.parametrize("page", ["<body><nav><a href=/>Home</a></nav><article>{}</article><footer>Imprint</footer>", "<body><div class=menu><a href=/>Home</a></div>{}<div>Imprint</div>"])
def test_html_wrappers_keep_their_text(name, page):
    """A class or id around all there is of an article takes nothing away, whatever its words."""
    inner = f"<p>{LONG * 4}</p><p>{LONG * 3}</p>"
    for attribute in ("class", "id"):
        got = html_text.extract(page.format(f'<div {attribute}="{name}">{inner}</div>'))
        assert " ".join((LONG * 4).split()) in got and " ".join((LONG * 3).split()) in got and "Home" not in got


def test_html_marks_beside_an_article():
    """The same names beside article text, inside or outside of the element, mark what is left out."""
    for name in ("ad-box", "cookie-notice", "comment-list", "share buttons", "related-items", "newsletter_form"):
        for page in ("<article><p>{0}</p>{1}</article>", "<p>{0}</p>{1}", "{1}<article><p>{0}</p></article>"):
            got = html_text.extract(page.format(LONG * 4, f'<div class="{name}"><p>{LONG * 3}</p><p>Short.</p></div>'))
            assert got == " ".join((LONG * 4).split()), (name, page)
    assert html_text.extract(f'<div class="comments"><p>{LONG * 5}</p><article><p>{LONG * 3}</p></article></div>') == " ".join((LONG * 3).split())
    assert html_text.extract(f"<form><h1>Head</h1><p>{LONG * 5}</p></form>").startswith("Head")  # a page that is one form
    assert html_text.extract(f"<article><p>{LONG * 5}</p><form><label>Name</label><p>{LONG * 3}</p></form></article>") == " ".join((LONG * 5).split())


def test_html_anchors():
    text = " ".join((LONG * 4).split())
    assert html_text.extract(f'<article><p><a name="top">{LONG * 4}</p><p>{LONG * 4}</p></article>') == f"{text}\n{text}"
    assert html_text.extract(f'<article><p><a href="x">{LONG * 4}</p><p>{LONG * 4}</p></article>') == text  # the open link ends with its paragraph
    assert html_text.extract(f'<article><p><a href=x>More<a href=y>Again</a> {LONG * 4}</p></article>') == f"MoreAgain {text}"
    assert html_text.extract(f"<article><div><a href=x><div>{LONG}</a></div>{LONG * 4}</div></article>").endswith(text)


def test_html_long_and_nested_pages():
    page = "<div>" * 300 + "".join(f"<section><h2>Part {i}</h2><p>{LONG * 3}</p></section>" for i in range(2000)) + "</div>" * 300
    lines_ = html_text.extract(page).split("\n")
    assert len(lines_) == 4000 and lines_[:2] == ["Part 0", " ".join((LONG * 3).split())] and lines_[-2] == "Part 1999"


def test_html_rules_without_markup(spark):
    """Pages stripped of semantic elements, classes and ids: the rules alone find the article's text again."""
    hit = extra = missed = 0
    for page in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        bare = re.sub(r"<(/?)(nav|article|footer|main|header|aside)\b[^>]*>", r"<\1div>", page.html or "")
        bare = re.sub(r' (class|id|role)="[^"]*"', "", bare)
        want, got = (collections.Counter(html_text.extract(x).split("\n")) for x in (page.html, bare))
        hit, extra, missed = (n + sum(len(k) * v for k, v in c.items()) for n, c in ((hit, want & got), (extra, got - want), (missed, want - got)))
    assert hit / (hit + extra) >= 0.95 and hit / (hit + missed) >= 0.95


def test_html_is_linear_in_tags():
    began = time.time()
    for odd in ("<b>" * 100_000 + "x" + "</i>" * 100_000, "<p>" * 100_000, "<div>" * 100_000 + "y" + "</span>" * 100_000, "<nav>" * 50_000 + "<article>z", "<li><b>" * 50_000, "</b>" * 100_000, "<" * 100_000):
        assert isinstance(html_text.extract(odd), str)
    assert time.time() - began < 30


def test_html_on_pages(spark):
    """Real pages: the text holds the article's own blocks as a plain parser finds them, and nothing of the parts around it."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.path, self.inside, self.outside = [], [], []

        def handle_starttag(self, tag, attrs):
            if tag not in html_text.VOID_TAGS:
                self.path.append((tag, dict(attrs)))

        def handle_endtag(self, tag):
            if tag in [t for t, _ in self.path]:
                while self.path.pop()[0] != tag:
                    pass

        def handle_data(self, data):
            tags = [t for t, _ in self.path]
            if data.strip() and not {"script", "style", "title", "head"} & set(tags):
                marked = any(any(html_text.hints(t, " ".join(f'{k}="{v}"' for k, v in a.items()))) for t, a in self.path)
                (self.inside if {"article", "main"} & set(tags) and not marked else self.outside).append("".join(data.split()))

    for page in spark.read.parquet(f"{SF}/pages.parquet").collect():
        plain, got = Article(), "".join(html_text.extract(page.html).split())
        plain.feed(page.html or "")
        assert got == "".join(plain.inside)


def test_html_awkward(spark):
    frame = spark.createDataFrame([(1, None), (2, ""), (3, PAGE), (3, PAGE)], "page_id bigint, html string").withColumns({c: F.lit(1) for c in CLASH})
    assert [r.t[:1] for r in frame.select(html_text.main_text(F.col("html")).alias("t")).collect()] == ["", "", "A", "A"]
    assert frame.where("false").select(html_text.main_text(F.col("html")).alias("t")).count() == 0


# ------------------------------------------------------------------------------------------ pieces


def test_scan_equals_library():
    model = pieces.PieceModel.of(pieces.read_model())
    r = random.Random(6)
    for k in range(300):
        x = "".join(r.choice("aabeinorst  \n\té€𝔘xX12_-.") for _ in range(r.randint(0, 150)))
        assert pieces.encode_by_scan(model, x, 32) == model.library.encode(x), x
    for x in ("a" * 90, " " * 90, "the " * 60, "-=" * 70, prose(3, 200)):
        assert pieces.encode_by_scan(model, x, 33) == model.library.encode(x)


def test_matrices_combine_associatively():
    model = pieces.PieceModel.of(pieces.read_model())
    parts = pieces.cut_chunks(model, pieces.normalized(prose(3, 60)), 40)
    m = [set(pieces.Chunk(model, t, lo, hi, i == 0, i == len(parts) - 1).matrix()) for i, (t, lo, hi) in enumerate(parts)][:3]
    assert pieces.combined(pieces.combined(m[0], m[1]), m[2]) == pieces.combined(m[0], pieces.combined(m[1], m[2]))


def test_scan_is_associative_at_any_fan(monkeypatch):
    model, calls = pieces.PieceModel.of(pieces.read_model()), []
    product = pieces.combined
    monkeypatch.setattr(pieces, "combined", lambda a, b: calls.append(1) or product(a, b))
    text = prose(4, 300)
    assert all(pieces.encode_by_scan(model, text, 40, fan) == model.library.encode(text) for fan in (2, 3, 32)) and len(calls) > 50


def test_giants_go_through_products(spark, monkeypatch):
    """Where the product is wrong, giants cannot be encoded: the main path combines matrices."""
    model, text = pieces.PieceModel.of(pieces.read_model()), prose(5, 4000)
    frame = spark.createDataFrame([("a", text), ("b", text[5:30_000])], "key string, text string")
    got = {r.key: r.tokens for r in pieces.scan_giants(frame, pieces.read_model(), 256, 4).collect()}
    assert got == {"a": model.library.encode(text), "b": model.library.encode(text[5:30_000])}
    monkeypatch.setattr(pieces, "combined", lambda left, right: set())
    with pytest.raises(Exception, match="states"):
        pieces.scan_giants(frame, pieces.read_model(), 256, 4).collect()


def test_words_and_tables_equal_the_library(documents):
    model = pieces.PieceModel.of(pieces.read_model())
    r = random.Random(2)
    texts = ["".join(r.choice("aabeinorst  \n\té€𝔘▁xX12_-.\0\u3000") for _ in range(r.randint(0, 60))) for _ in range(400)]
    texts += [x.text or "" for x in documents.select("text").collect()] + ["", " ", "a ", " a", "a  b", "▁", "<s> </s> <unk> <0x41>", "x" * 5000]
    ids, ends = pieces.encoded(model, pa.array(texts, pa.large_string()))
    cuts = np.concatenate([[0], ends])
    want = model.library.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == want
    assert pieces.decoded(model, ids, cuts).to_pylist() == model.library.decode(want)
    odd = [[1, 2], [0, 5], [200, 130, 3], [], [131, 200], [259], [29871, 29871, 259]]  # control ids, broken bytes, spaces
    cuts = np.cumsum([0, *map(len, odd)])
    assert pieces.decoded(model, np.array(sum(odd, []), np.int64), cuts).to_pylist() == [model.library.decode(o) for o in odd]
    one = [[29871, 29871, 259], [259], [], [5000, 29871]]
    cuts = np.cumsum([0, *map(len, one)])
    assert pieces.decoded(model, np.array(sum(one, []), np.int64), cuts).to_pylist() == [model.library.decode(o) for o in one]


def test_pieces_awkward(awkward, empty):
    model = pieces.PieceModel.of(pieces.read_model())
    out = pieces.encode(awkward, giant=600, chunk=250).withColumn("back", pieces.decode(F.col("tokens"))).select("text", "tokens", "back").collect()
    assert len(out) == len(awkward_rows())
    for r in out:
        assert r.tokens == model.library.encode(r.text or "") and r.back == (r.text or "")
    assert pieces.encode(empty).count() == 0


# ------------------------------------------------------------------------------------------- media


def test_chunks_follow_content():
    r = random.Random(8)
    body = bytes(r.randrange(97, 123) for _ in range(60_000))
    a, b = media.chunked(media.padded(body)), media.chunked(media.padded(b"inserted " + body))
    assert b"".join(a) == media.padded(body) and len(set(a) & set(b)) > 0.8 * len(a)
    assert media.read_samples(media.header(3) + b"abc") == b"abc"
    with pytest.raises(ValueError):
        media.read_samples(media.header(4) + b"abc")


def test_media_awkward(awkward, empty):
    out = media.media_features(awkward).collect()
    want = collections.Counter()
    for i, t, *_ in awkward_rows():
        d = (t or "").encode()
        p = d + b" " * (-len(d) % 192 if d else 192)
        want[(i, len(d), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), 44 + len(p), hashlib.sha256(media.header(len(p)) + p).hexdigest(), media.features(p))] += 1
    assert collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) for r in out) == want
    assert media.media_features(empty).count() == 0


# -------------------------------------------------------------------------------------------- chat


def test_chat_round_trip(spark):
    turns = [(1, None, "user", None), (1, 2, "assistant", "<|end|>\n<|user|>\n\\l \\\\ <"), (1, 1, "sys<|tem\\", "a\nb"), (1, 3, "assistant", "x"), (1, 3, "assistant", "x"), (None, 0, None, "\\"), (2, 0, "assistant", "")]
    frame = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    made = chat.format_conversations(frame)
    rows = {r.conv_id: r for r in made.select("conv_id", "n_turns", chat.parse_formatted(F.col("formatted")).alias("back"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    ordered = [("user", ""), ("sys<|tem\\", "a\nb"), ("assistant", turns[1][3]), ("assistant", "x"), ("assistant", "x")]
    assert [(t.role, t.body) for t in rows[1].back] == ordered and rows[1].n_turns == 5
    assert rows[1].loss == turns[1][3] + "xx" and [(t.role, t.body) for t in rows[None].back] == [("", "\\")] and rows[2].loss == ""
    assert chat.format_conversations(frame.where("false")).count() == 0


PART = "array<struct<type:string,text:string,ref:string,tokens:bigint>>"


def plain_format(rows: list[tuple]) -> tuple:
    """The template in plain Python, for rows (turn, role, parts) in order."""
    esc = lambda x: (x or "").replace("\\", "\\\\").replace("<", "\\l")
    name = lambda x: esc(x).replace("|", "\\p")
    out, spans, records = "", [], []
    for turn, role, parts in rows:
        out += f"<|turn:{name(role)}|>\n"
        start = len(out)
        for kind, text, ref, tokens in parts:
            if kind in (None, "text"):
                out += esc(text)
            else:
                records.append((len(records), turn, kind, ref, tokens or 0, len(out)))
                out += f"<|part:{name(kind)}:{len(records) - 1}|>"
        if role == "assistant":
            spans.append((start, len(out) - start))
        out += "<|end|>\n"
    return out, spans, records


def test_chat_parts(spark):
    kinds = ["image", "audio", "document", "im|age:0|>\n", "end", None, "text"]
    roles = ["user", "assistant", "end", "image:0", "a|>\nb", "part:image:0", "", "turn:x|>", "\\p|\\l<", "x<|end|>\n"]
    r = random.Random(3)
    rows = [(c, t, r.choice(roles), [(r.choice(kinds), r.choice(["", "hé<|end|>\n", "\\l|p", "<|part:image:0|>", "𝔘 text"]), f"ref{t}", r.choice([None, 7, 256])) for _ in range(r.randint(0, 6))]) for c in range(6) for t in range(25)]
    frame = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts {PART}").withColumns({c: F.lit(1) for c in ["seq", "pos", "part", "number", "start", "piece", "head", "turns", "text", "last"]}).repartition(3)
    made = chat.format_conversations(frame, parts=F.col("parts")).select("*", chat.parse_formatted(F.col("formatted")).alias("back"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss_text"))
    for m in made.collect():
        own = [x[1:] for x in rows if x[0] == m.conv_id]
        text, spans, records = plain_format(own)
        assert m.formatted == text and [tuple(s) for s in m.loss_spans] == spans
        assert [(a.number, a.turn, a.type, a.ref, a.tokens, a.start) for a in m.attachments] == records and m.expanded_tokens == sum(x[4] for x in records)
        assert [b.role for b in m.back] == [x[1] for x in own] and m.n_turns == len(own)
        bodies, k = [], 0
        for _, role, parts in own:
            body = ""
            for kind, t, _, _ in parts:
                if kind in (None, "text"):
                    body += t
                else:
                    name = kind.replace("|", "\\p")
                    body, k = body + f"<|part:{name}:{k}|>".replace("\\p", "|"), k + 1
            bodies.append((role, body))
        assert [b.body for b in m.back] == [b for _, b in bodies] and m.loss_text == "".join(b for x, b in bodies if x == "assistant")


def test_chat_many_turns_and_long_texts(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i} <é𝔘> " * (1 + i % 7)) for i in range(20_000)] + [(2, 0, "assistant", "é<" * 300_000)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(4)
    began = time.time()
    made = chat.format_conversations(frame).select("*", chat.parse_formatted(F.col("formatted")).alias("back"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    got = {m.conv_id: m for m in made.select("conv_id", "n_turns", "back", "loss").collect()}
    assert time.time() - began < 60
    assert [b.body for b in got[1].back] == [x[3] for x in rows[:-1]] and got[1].loss == "".join(x[3] for x in rows[1:-1:2]) and got[2].loss == rows[-1][3]


# --------------------------------------------------------------------------------------- registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(name, spark):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "conversations", "labels", "pages", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, SF).toPandas(), c.sql(registry.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    text = lambda f: sorted(tuple(repr(round(v, 9)) if isinstance(v, float) else str(v) for v in r) for r in f[columns].astype(object).itertuples(index=False))
    assert text(got) == text(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_covers_its_table(name, spark):
    out = registry.QUERIES[name](spark, SF)
    assert out.count() == spark.read.parquet(f"{SF}/{'pages' if 'html' in name else 'documents'}.parquet").count()
