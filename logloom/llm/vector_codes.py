"""Operator 13: vector code compression (product quantisation) over anchors-hierarchy metric trees.

Each vector is scaled to integers and cut into equal parts; each part position has a codebook of at most 256
entries, refined by rounds of assignment and averaging. All arithmetic that decides anything is exact in integers.

Vectors are taken in slices of a bounded number of rows, where they lie: they are never shuffled. For each slice and part position a metric
tree is built once, middle-out: about sqrt(n) anchors claim the points nearest to them (a new anchor is the point furthest from its own, and only points more than
half as far from their anchor as the two anchors are apart can move), the anchors' points are divided in the same way, and the
anchors are merged pairwise, smallest ball first, up to one root. Every ball caches its sum, count, centre and
radius, and the trees are written once to the shared folder.

A round walks each tree from the root. A ball inherits the candidate entries of the ball above it and drops those that are
further than its nearest candidate from every point of the ball: |c-e|^2 - |c-b|^2 > 2 r |e-b|, with a margin above
rounding errors, so ties are never dropped. A ball with one candidate left is wholly owned: its cached sum and
count go to that entry and its points aren't looked at. Points of leaves that are not owned are compared with the candidates that are left.
What leaves a task is a sum and a count for each used entry, at most 4 * 256 rows.

Defined cases: rows whose vector is null or holds null, NaN or infinite components are dropped; shorter vectors count as
filled up with zeros to the longest one, and that to a multiple of the number of parts; the entries start from the rows of the
smallest ids, null ids last and equal ids by their vectors, and with fewer rows there are fewer entries; repeated rows are kept; equal entries never win
over the first of them; an empty table gives an empty result. Components whose scaled value is 2**26 or more in size are an error: beyond it the
sums would not stay exact in 64 bits.
"""

from __future__ import annotations

import hashlib
import io
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import lean, ship, staged

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Ranks of an id's quantile are off by the rows divided by this, at most.
ACCURACY = 100_000
#: Rows and components of a slice at most, points of a leaf, and the size from which components are refused.
SLICE_ROWS, SLICE_CELLS, LEAF, LARGEST = 4096, 1 << 22, 32, 1 << 26


# ------------------------------------------------------------------------------ metric trees


def anchors(points: np.ndarray, k: int) -> np.ndarray:
    """The owner (0, 1, ...) of each point among at most k anchors."""
    pivots = [0]
    owner = np.zeros(len(points), np.int64)
    gone = np.sqrt(((points - points[0]) ** 2).sum(1))
    while len(pivots) < k:
        new = int(gone.argmax())
        if gone[new] == 0:
            break  # all others are copies of the anchors
        apart = np.sqrt(((points[pivots] - points[new]) ** 2).sum(1))
        open_ = np.flatnonzero(gone > apart[owner] / 2 * (1 - 1e-12))
        far = np.sqrt(((points[open_] - points[new]) ** 2).sum(1))
        moved = far < gone[open_]
        owner[open_[moved]] = len(pivots)
        gone[open_[moved]] = far[moved]
        pivots.append(new)
    return owner


def merged(children: list, points: np.ndarray) -> list:
    """One node over all: the pair with the smallest common ball is joined, again and again. A node is [indices] or [left, right]."""
    balls = [(points[members(c)].mean(0), len(members(c))) for c in children]
    centre = np.array([b[0] for b in balls])
    count = np.array([b[1] for b in balls], float)
    radius = np.array([np.sqrt(((points[members(c)] - m) ** 2).sum(1).max()) for c, m in zip(children, centre, strict=True)])
    cost = np.sqrt(np.maximum(((centre[:, None] - centre[None]) ** 2).sum(2), 0)) + radius[:, None] + radius[None]
    np.fill_diagonal(cost, np.inf)
    nodes, i = list(children), 0
    for _ in range(len(nodes) - 1):
        i, j = divmod(int(cost.argmin()), len(nodes))
        mid = (centre[i] * count[i] + centre[j] * count[j]) / (count[i] + count[j])
        reach = max(np.sqrt(((mid - centre[x]) ** 2).sum()) + radius[x] for x in (i, j))
        nodes[i], centre[i], count[i], radius[i] = (nodes[i], nodes[j]), mid, count[i] + count[j], reach
        cost[j] = cost[:, j] = np.inf
        open_ = np.isfinite(cost[i])
        cost[i, open_] = cost[open_, i] = np.sqrt(((centre[open_] - mid) ** 2).sum(1)) + radius[open_] + reach
    return nodes[i]


def members(node) -> np.ndarray:
    return node if isinstance(node, np.ndarray) else np.concatenate([members(c) for c in node])


def divided(points: np.ndarray, own: np.ndarray):
    """A node over the points `own`: an array of indices (a leaf) or a pair of nodes."""
    if len(own) <= LEAF:
        return own
    owner = anchors(points[own], math.isqrt(len(own) - 1) + 1)
    if not owner.any():
        return own  # copies of one point
    return merged([divided(points, own[owner == a]) for a in range(owner.max() + 1) if (owner == a).any()], points)


@dataclass
class Tree:
    """Balls in breadth-first order over points in tree order; places: the points' places in the slice."""

    places: np.ndarray
    points: np.ndarray
    start: np.ndarray
    end: np.ndarray
    parent: np.ndarray
    leaf: np.ndarray
    level: np.ndarray  # where each depth begins
    total: np.ndarray
    centre: np.ndarray
    radius: np.ndarray

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.__dict__)
        return out.getvalue()

    @staticmethod
    def unpack(data: bytes) -> Tree:
        with np.load(io.BytesIO(data)) as held:
            return Tree(**{k: held[k] for k in held.files})


def build(points: np.ndarray) -> Tree:
    """The tree over integer points (at least one)."""
    root = divided(points.astype(float), np.arange(len(points)))
    start, parent, leaf, size, level, places = [], [], [], [], [], np.zeros(len(points), np.int64)
    row, begin = [(root, 0, -1)], 0
    while row:
        level.append(len(start))
        below = []
        for node, begin, up in row:
            own = members(node)
            start.append(begin)
            size.append(len(own))
            parent.append(up)
            leaf.append(isinstance(node, np.ndarray))
            if leaf[-1]:
                places[begin : begin + len(own)] = own
            else:
                here, at = len(start) - 1, begin
                for child in node:
                    below.append((child, at, here))
                    at += len(members(child))
        row = below
    start, size = np.array(start), np.array(size)
    end, points = start + size, points[places]
    sums = np.zeros((len(points) + 1, points.shape[1]), np.int64)
    np.cumsum(points, axis=0, out=sums[1:])
    total = sums[end] - sums[start]
    centre = total / size[:, None]
    radius = np.array([math.sqrt(((points[a:b] - c) ** 2).sum(1).max()) for a, b, c in zip(start, end, centre, strict=True)])
    return Tree(places, points, start, end, np.array(parent), np.array(leaf), np.array(level), total, centre, radius)


def nearest(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The first nearest entry of each integer point, exactly."""
    largest = max(np.abs(points).max(initial=0), np.abs(entries).max(initial=0))
    if 4 * points.shape[1] * float(largest) ** 2 < 1 << 53:  # every sum is a whole number that a double holds
        p, e = points.astype(float), entries.astype(float)
        return ((e**2).sum(1) - 2 * (p @ e.T)).argmin(1)
    return np.array([((entries - p) ** 2).sum(1).argmin() for p in points], np.int64)


def assign(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes in tree order, sums and counts by entry) under the codebook."""
    e = entries.astype(float)
    squares = (e**2).sum(1)
    gaps = np.sqrt(((e[:, None] - e[None]) ** 2).sum(2)) if len(e) * e.size <= 1 << 22 else np.sqrt(np.array([((e - x) ** 2).sum(1) for x in e]))
    first = np.unique(entries, axis=0, return_index=True)[1] if entries.shape[1] else np.zeros(1, np.int64)
    candidates = np.zeros((len(tree.start), len(e)), bool)
    candidates[0, first] = True  # an entry that equals one before it never wins
    codes = np.full(len(tree.points), -1, np.int64)
    sums, counts = np.zeros(entries.shape, np.int64), np.zeros(len(e), np.int64)
    closed = np.zeros(len(tree.start), bool)
    for begin, end in zip(tree.level, [*tree.level[1:], len(tree.start)], strict=True):
        balls = np.arange(begin, end)
        if begin:
            closed[balls] = closed[tree.parent[balls]]
            balls = balls[~closed[balls]]
            candidates[balls] = candidates[tree.parent[balls]]
        if not len(balls):
            continue
        c, mine = tree.centre[balls], candidates[balls]
        square = (c**2).sum(1)
        away = square[:, None] - 2 * (c @ e.T) + squares[None]
        best = np.where(mine, away, np.inf).argmin(1)
        margin = 1e-9 + 1e-11 * (square + squares.max())
        beyond = away - away[np.arange(len(balls)), best][:, None] > 2 * tree.radius[balls, None] * gaps[best] * (1 + 1e-11) + margin[:, None]
        mine &= ~beyond
        candidates[balls] = mine
        owned = mine.sum(1) == 1
        closed[balls[owned]] = True
        np.add.at(sums, best[owned], tree.total[balls[owned]])
        np.add.at(counts, best[owned], (tree.end - tree.start)[balls[owned]])
        for ball, entry in zip(balls[owned], best[owned], strict=True):
            codes[tree.start[ball] : tree.end[ball]] = entry
        for ball in balls[~owned & tree.leaf[balls]]:
            left = np.flatnonzero(candidates[ball])
            own = slice(tree.start[ball], tree.end[ball])
            codes[own] = left[nearest(tree.points[own], entries[left])]
            np.add.at(sums, codes[own], tree.points[own])
            np.add.at(counts, codes[own], 1)
    return codes, sums, counts


# ------------------------------------------------------------------------------------- Spark


def usable(vector: Column) -> Column:
    """The vector is there and all its components are finite."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return vector.isNotNull() & ~F.exists(vector, odd)


def scaled(values: np.ndarray) -> np.ndarray:
    out = np.floor(values * SCALE)
    if np.abs(out).max(initial=0) >= LARGEST:
        raise ValueError(f"a component is too large: its size times {SCALE} must stay below {LARGEST}")
    return out.astype(np.int64)


def padded(lists: pa.ListArray, width: int) -> np.ndarray:
    """Rows of integers, filled up with zeros."""
    offsets = np.asarray(lists.offsets, np.int64)
    sizes = np.diff(offsets)
    out = np.zeros((len(lists), width), np.int64)
    values = scaled(np.asarray(lists.values, float)[offsets[0] : offsets[-1]])
    place = np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], sizes)
    out[np.repeat(np.arange(len(lists)), sizes), place] = values
    return out


def planted(rows: DataFrame, parts: int, width: int) -> DataFrame:
    """A row for each slice: its carried rows and a tree for each part position. rows: carried, vector."""
    carried = rows.schema["carried"].dataType.simpleString()
    step = max(1, min(SLICE_ROWS, SLICE_CELLS // max(1, width)))

    def plant(batches):
        def slice_of(held: list) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            vectors = table.column("vector").combine_chunks()
            vectors = pa.ListArray.from_arrays(vectors.offsets, vectors.values) if len(vectors) else vectors
            points = padded(vectors, width)
            trees = [build(p).pack() for p in np.split(points, parts, axis=1)]
            own = table.column("carried").combine_chunks()
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), pa.array([trees], pa.list_(pa.binary()))], ["carried", "trees"])

        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, step - n)
                batch = batch.slice(part.num_rows)
                held.append(part)
                n += part.num_rows
                if n == step:
                    yield slice_of(held)
                    held, n = [], 0
        if n:
            yield slice_of(held)

    return staged(rows.mapInArrow(lean(plant), f"carried array<{carried}>, trees array<binary>"), "code-trees")


def totals(slices: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """Rows (part, entry, n, sums) of what each entry owns; one row for each used entry after map-side sums in the worker."""
    width = books[0].shape[1]

    def walk(batches):
        sums, counts = [np.zeros(b.shape, np.int64) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for trees in batch.column(0).to_pylist():
                for k, data in enumerate(trees):
                    _, s, c = assign(Tree.unpack(data), books[k])
                    sums[k] += s
                    counts[k] += c
        for k, (s, c) in enumerate(zip(sums, counts, strict=True)):
            used = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), k), pa.int32()), pa.array(used, pa.int32()), pa.array(c[used], pa.int64()), pa.array(list(s[used]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    found = slices.select("trees").mapInArrow(lean(walk), "part int, entry int, n bigint, sums array<bigint>")
    return found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)]).cast("array<bigint>").alias("sums"))


def refined(slices: DataFrame, books: list[np.ndarray], rounds: int) -> list[np.ndarray]:
    """The codebooks after the rounds; at most parts * entries rows come to the driver."""
    books = [b.copy() for b in books]
    for _ in range(rounds):
        for r in totals(slices, books).collect():
            books[r["part"]][r["entry"]] = np.array(r["sums"], np.int64) // r["n"]
    return books


def coded(slices: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """Rows of carried, code, error."""
    inner = slices.schema["carried"].dataType.elementType.simpleString()

    def walk(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.column(0).slice(i, 1).flatten()
                codes, error = np.zeros((len(own), len(books)), np.uint8), np.zeros(len(own), np.int64)
                for k, data in enumerate(batch.column(1)[i].as_py()):
                    tree = Tree.unpack(data)
                    found = assign(tree, books[k])[0]
                    codes[tree.places, k] = found
                    error[tree.places] += ((tree.points - books[k][found]) ** 2).sum(1)
                text, n = codes.tobytes().hex(), 2 * len(books)
                yield pa.RecordBatch.from_arrays([own, pa.array([text[j : j + n] for j in range(0, len(text), n)], pa.string()), pa.array(error)], ["carried", "code", "error"])

    return slices.mapInArrow(lean(walk), f"carried {inner}, code string, error bigint")


@dataclass
class Codes:
    rows: DataFrame  # the carried columns, code, error
    books: list[np.ndarray]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for b in self.books for x in b.ravel().tolist()).encode()).hexdigest()


def smallest(rows: DataFrame, count: int, entries: int) -> DataFrame:
    """Rows (own, vector) that hold those of the smallest ids, and few others where ids are numbers.

    Every task would send its own smallest rows to the driver; so ids beyond a quantile's upper bound (its error is count / ACCURACY
    ranks at most) are left out first, and tasks without small ids send nothing.
    """
    out = rows.select("own", "vector")
    if count <= 4 * entries or dict(rows.dtypes)["own"] not in ("tinyint", "smallint", "int", "bigint"):
        return out
    share = (entries + 1) / count + 2 / ACCURACY
    bound = out.agg(F.percentile_approx("own", min(1.0, share), ACCURACY)).first()[0]
    return out.where(F.col("own") <= bound)


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", carry: list[str] | None = None, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codes:
    """Codes of all usable vectors and the codebooks: rows of the carried columns (default: the id), code (hex digits), error."""
    carry = [id_col] if carry is None else list(dict.fromkeys([id_col, *carry]))
    rows = vectors.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried"), F.col(f"`{id_col}`").alias("own"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    rows = rows.where(usable(F.col("vector")))
    longest, count = rows.agg(F.max(F.size("vector")), F.count("own")).first()
    width = -(-(longest or 0) // parts) * parts
    seeds = smallest(rows, count, entries).orderBy(F.asc_nulls_last("own"), "vector").limit(entries).collect()
    if not seeds:
        return Codes(rows.select("carried.*", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error")), [])
    start = np.zeros((len(seeds), width), np.int64)
    for i, r in enumerate(seeds):
        start[i, : len(r["vector"])] = scaled(np.array(r["vector"], float))
    slices = planted(rows.select("carried", "vector"), parts, width)
    books = refined(slices, np.split(start, parts, axis=1), rounds)
    return Codes(coded(slices, books).select("carried.*", "code", "error"), books)


def with_label_error(rows: DataFrame, label_col: str) -> DataFrame:
    """Adds label_error: the errors summed over equal labels, nulls together."""
    by = rows.groupBy(F.col(f"`{label_col}`").alias("_label")).agg(F.sum("error").alias("label_error"))
    return rows.join(by, F.col(f"`{label_col}`").eqNullSafe(F.col("_label"))).drop("_label")


ship(__name__)
