"""Operator 12: Merkle manifest of a dataset, with proofs found by pointer jumping.

Every row is a leaf: the SHA-256 (lower-case hex) of its fields, each written as its byte count, a colon and its
value, or as "-". The leaves of a source, in order of id, form a tree whose nodes hash runs of `arity`
neighbours; the roots of the sources, in order of source, are the leaves of the top tree.

- Leaves are numbered within their source by ranges (operators.numbering), so no task holds a source.
- The tree grows LEVELS levels at a time: a group holds arity**LEVELS neighbours at most.
- A node's segment is what its run holds before and after it. Proofs come from pointer jumping: every node starts with a pointer to
  its parent and its own segment; a self-join replaces the pointer by the pointer's pointer and appends the pointer's
  segments, so the distance doubles until all point to the root. Only nodes that something can still point to (at least
  `distance` levels up) are joined with. Leaves take their first step last, onto parents that already
  reach the root: they are most of the nodes, and their proofs are never shuffled.
- A node that many point to is one of few: nodes `distance` levels up are fewer by arity**distance, so either
  keys are many or that side is small enough for Spark to broadcast by its measured size.

Defined cases: null fields are "-"; a null source is a source of its own, first; null ids come first; rows that tie in
source and id are ordered by their hash, and equal rows are leaves of their own; a source of one row has its leaf as root, and a
table of one source that root as its root (the proof of a single row is empty); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.numbering import numbered
from .common import staged

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 3
#: Levels built in one grouping: 81 neighbours, 5 KB of digests.
LEVELS = 4
#: The number of the tree over sources; the sources' own trees are 0, 1, ...
TOP = -1


def encoded(field: Column) -> Column:
    """Byte count, colon and value; "-" for null."""
    text = field.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_hash(fields: list[Column]) -> Column:
    return digest(*[encoded(f) for f in fields])


def _hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def proof_hash(segments: Column) -> Column:
    """The hash of all siblings in order, level by level."""
    return F.sha2(F.array_join(F.transform(segments, lambda s: F.concat(_hex(s["left"]), _hex(s["right"]))), ""), 256)


def fold(leaf: Column, segments: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(segments, leaf, lambda below, s: digest(_hex(s["left"]), below, _hex(s["right"])))


def _runs(below: Column, arity: int) -> Column:
    """The next level: a hash of each run of neighbours."""
    starts = F.sequence(F.lit(0), F.size(below) - 1, F.lit(arity))
    return F.transform(starts, lambda s: F.sha2(F.array_join(F.slice(below, s + 1, F.lit(arity)), ""), 256))


def _with_segments(level: Column, arity: int) -> Column:
    """Each digest with what its run holds before and after it."""

    def one(own: Column, i: Column) -> Column:
        place = i % arity
        joined = lambda start, n: F.unhex(F.array_join(F.slice(level, start, n), ""))
        return F.struct(i.alias("i"), own.alias("digest"), joined(i - place + 1, place).alias("left"), joined(i + 2, F.lit(arity - 1) - place).alias("right"))

    return F.transform(level, one)


def _levels(level: Column, arity: int, depth: int) -> Column:
    """Arrays of this level and the next ones, depth + 1 in all; each is bound once."""
    rest = (lambda own: F.array(own)) if not depth else (lambda own: F.concat(F.array(own), _levels(_runs(own, arity), arity, depth - 1)))
    return F.get(F.transform(F.array(level), rest), F.lit(0))


def tree_nodes(leaves: DataFrame, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """All nodes of the trees over (tree, i from 0, digest, n leaves of the tree): tree, level, i, digest, height, left, right.

    The root of a tree is the node whose level is the tree's height; it has no siblings.
    """
    work = leaves.withColumn("height", _height(F.col("n"), arity)).withColumn("level", F.lit(0))
    parts, base = [], 0
    while True:
        block = F.floor(F.col("i") / arity**levels).cast("bigint")
        sorted_ = F.transform(F.array_sort(F.collect_list(F.struct("i", "digest"))), lambda x: x["digest"])
        grouped = work.groupBy("tree", block.alias("block")).agg(sorted_.alias("row"), F.first("height").alias("height"))
        made = F.transform(_levels(F.col("row"), arity, levels), lambda level: _with_segments(level, arity))
        nodes = grouped.select("tree", "block", "height", F.posexplode(made).alias("up", "nodes")).where(F.col("up") + base <= F.col("height"))
        nodes = nodes.select("tree", "block", "height", (F.col("up") + base).alias("level"), F.explode("nodes").alias("x"))
        first = F.col("block") * F.pow(F.lit(float(arity)), levels - F.col("level") + base).cast("bigint")
        nodes = staged(nodes.select("tree", "height", "level", (first + F.col("x.i")).alias("i"), "x.digest", "x.left", "x.right"), "merkle-nodes")
        # The last level of a block begins the next round, where its siblings are known; a tree's root has none.
        parts.append(nodes.where((F.col("level") < base + levels) | (F.col("level") == F.col("height"))))
        base += levels
        work = nodes.where((F.col("level") == base) & (F.col("height") > base)).select("tree", "i", "digest", "height")
        if work.isEmpty():
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _height(n: Column, arity: int) -> Column:
    """Levels above n leaves: the least h with arity**h >= n."""
    steps = F.sequence(F.lit(0), F.lit(63 // (arity.bit_length() - 1)))
    return F.get(F.filter(steps, lambda h: F.pow(F.lit(float(arity)), h) >= n), F.lit(0)).cast("int")


def jump(nodes: DataFrame) -> DataFrame:
    """Pointer jumping: (tree, i) of each node with (to_tree, to_level, to_i, segments) until every pointer is at the root (to_level null)."""
    own = ["tree", "level", "i"]
    distance, state = 1, nodes
    while True:
        target = state.where((F.col("tree") == TOP) | (F.col("level") >= distance))
        target = target.select(*[F.col(c).alias(f"t_{c}") for c in own], *[F.col(f"to_{c}").alias(f"next_{c}") for c in own], F.col("segments").alias("more"))
        on = (F.col("to_tree") == F.col("t_tree")) & (F.col("to_level") == F.col("t_level")) & (F.col("to_i") == F.col("t_i"))
        grown = state.where("to_level is not null").join(target, on, "left")
        grown = grown.select(*own, *[F.col(f"next_{c}").alias(f"to_{c}") for c in own], F.concat("segments", F.coalesce("more", F.array())).alias("segments"))
        state = staged(state.where("to_level is null").unionByName(grown), "merkle-jump")
        distance *= 2
        if state.where("to_level is not null").isEmpty():
            return state


def manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", fields: tuple[str, ...] = FIELDS, carry: dict[str, Column] | None = None, arity: int = ARITY) -> DataFrame:
    """One row per row of docs: id, leaf, subroot, root, segments (left and right siblings as bytes, level by level) and the carried expressions of docs' columns."""
    carry = carry or {}
    leaf = leaf_hash([F.col(f"`{c}`") for c in fields])
    rows = staged(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), leaf.alias("leaf"), F.struct(F.lit(0).alias("_"), *[c.alias(n) for n, c in carry.items()]).alias("carried")), "merkle-leaves")

    sources = rows.groupBy("source").agg(F.count("*").alias("n"))
    sources = numbered(sources, [(F.col("source"), "asc_nulls_first")], name="rank").select(F.col("source").alias("s"), "n", (F.col("rank") - 1).alias("tree"))
    placed = numbered(rows, [(F.col("id"), "asc_nulls_first"), (F.col("leaf"), "asc")], ["source"], "number")
    placed = staged(placed.join(sources, F.col("source").eqNullSafe(F.col("s"))).select("id", "leaf", "carried", "tree", "n", (F.col("number") - 1).alias("i")), "merkle-placed")

    own = tree_nodes(placed.select("tree", "i", F.col("leaf").alias("digest"), "n"), arity)
    subroots = own.where("level = height").select("tree", F.col("digest").alias("subroot"))
    count = subroots.count()
    top = tree_nodes(subroots.select(F.lit(TOP).cast("bigint").alias("tree"), F.col("tree").alias("i"), F.col("subroot").alias("digest"), F.lit(count).cast("bigint").alias("n")), arity)
    root = [r["digest"] for r in top.where("level = height").select("digest").limit(1).collect()]

    # A source's root is the top tree's leaf: it has one node, there.
    segment = F.array(F.struct("left", "right")).alias("segments")
    lifted = (F.col("tree") != TOP) & (F.col("level") + 1 == F.col("height"))
    parent = [F.when(lifted, F.lit(TOP).cast("bigint")).otherwise(F.col("tree")).alias("to_tree"), F.when(lifted, F.lit(0)).otherwise(F.col("level") + 1).alias("to_level"), F.when(lifted, F.col("tree")).otherwise(F.floor(F.col("i") / arity)).alias("to_i")]
    at_root = top.where("level = height").select("tree", "level", "i", F.lit(None).cast("bigint").alias("to_tree"), F.lit(None).cast("int").alias("to_level"), F.lit(None).cast("bigint").alias("to_i"), F.array().cast("array<struct<left:binary,right:binary>>").alias("segments"))
    inner = own.where("level < height and level > 0").unionByName(top.where("level < height")).select("tree", "level", "i", *parent, segment)
    paths = jump(inner.unionByName(at_root)).select(F.col("tree").alias("p_tree"), F.col("level").alias("p_level"), F.col("i").alias("p_i"), F.col("segments").alias("above"))

    steps = own.where("level = 0 and height > 0").select("tree", "i", *parent, segment)
    steps = steps.unionByName(own.where("height = 0").select("tree", "i", F.lit(TOP).cast("bigint").alias("to_tree"), F.lit(0).alias("to_level"), F.col("tree").alias("to_i"), F.array().cast("array<struct<left:binary,right:binary>>").alias("segments")))
    on = (F.col("to_tree") == F.col("p_tree")) & (F.col("to_level") == F.col("p_level")) & (F.col("to_i") == F.col("p_i"))
    proofs = placed.join(steps, ["tree", "i"]).join(paths, on)
    out = proofs.join(subroots, "tree").withColumn("root", F.lit(root[0] if root else None).cast("string"))
    return out.select("id", "leaf", "subroot", "root", F.concat("segments", "above").alias("segments"), *[F.col(f"carried.`{n}`").alias(n) for n in carry])
