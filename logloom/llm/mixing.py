"""Operator 1: mixing sources to target weights by systematic sampling, in DataFrame operations only.

Each document of a source has the same expected number of copies, target / source size. Within
a source these are prefix-summed in an order that runs through the sizes (a band of sizes, then
a hash of the id), one random offset is added, and a document is emitted once for each integer
that its interval crosses. Ordering by size makes the words taken, not just the documents, come
near the target.

The prefix sum has two levels, so that no task gets a whole source: rows are numbered within
(source, band, cell) where a cell is one of `cells` hash ranges, and the counts of cells and
bands, at most 256 * cells and 256 rows a source, are summed before them.

The table of sources (one row each) is ranked and levelled in one task: it is the mix's own
specification, far smaller than the documents. At 1e6 sources (hosts, say) that is some 1e8 bytes in one task;
mixes with more sources than that should be levelled by groups of sources first.

Defined cases: null text has size 0; a null source is a source of its own, last in order; a source
of size 0 has target 0 and takes nothing; repeated rows are sampled one by one; an empty table
gives an empty result. Reruns agree: order and offset depend only on ids, sources, sizes and the seed, and between rows that repeat
an id on what is carried. Carried columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import staged

#: Hash ranges in each band of sizes. At 3e10 documents, a third of them in one source, a cell has about 1e6 rows.
CELLS = 256
#: Weights of sources by their rank, repeating.
WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: Column) -> Column:
    r"""Number of ``[^\x20\x09-\x0D]+`` in a text; null: 0. One pass, no array of words."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x")
    return F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")).cast("bigint")


def size_band(size: Column) -> Column:
    """Quarters of powers of two: 0 for 0, then 4 bands for each bit length."""
    bits = F.length(F.bin(size))
    return F.when(size <= 0, F.lit(0)).otherwise(bits * 4 + (size * 4).cast("double") / F.pow(F.lit(2.0), bits - 1) - 4).cast("int")


def unit_hash(*parts: Column) -> Column:
    """The first 8 hex digits of an MD5 as a number below 2**32."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint")


def levelled(sources: DataFrame, share: float, cap: float) -> DataFrame:
    """Adds target to (source_size, weight): share * all sizes split by weight, at most cap * size.

    What exceeds a cap is split again by weight among the rest until nothing does. The fixed point
    has one level: target = min(cap * size, level * weight). Sources sorted by cap * size / weight
    are capped up to some place; the level follows from what those before it leave.
    """
    every = Window.partitionBy()
    order = Window.orderBy(F.col("ratio"), F.col("rank_"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = sources.withColumn("most", F.col("source_size") * F.lit(cap)).withColumn("ratio", F.col("most") / F.col("weight"))
    s = s.withColumn("budget", F.least(F.lit(share), F.lit(cap)) * F.sum("source_size").over(every)).withColumn("weights", F.sum("weight").over(every))
    s = s.withColumn("level", (F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    s = s.withColumn("open", F.col("ratio") >= F.col("level"))
    level = F.min(F.when(F.col("open"), F.struct(F.col("ratio"), F.col("rank_"), F.col("level")))).over(every)["level"]
    s = s.withColumn("lvl", level)
    return s.withColumn("target", F.when(F.col("lvl").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("lvl") * F.col("weight"))).cast("double"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, carry: list[str] | None = None, seed: str = "mix", cells: int = CELLS) -> DataFrame:
    """Per row of docs: the carried columns (default: the id), size, source_size, target, copies, taken."""
    carry = [id_col] if carry is None else list(dict.fromkeys([id_col, *carry]))
    size, source, band, cell, mark, tie = "size_", "source_", "band_", "cell_", "mark_", "tie_"
    own = F.struct(*[F.col(f"`{c}`") for c in carry])  # carried columns may have any name
    rows = docs.select(own.alias("carried_"), F.xxhash64(own).alias(tie), word_count(F.col(f"`{text_col}`")).alias(size), F.col(f"`{source_col}`").alias(source), unit_hash(F.lit(seed), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))).alias(mark), F.col(f"`{id_col}`").alias("id_"))
    rows = rows.withColumns({band: size_band(F.col(size)), cell: F.floor(F.col(mark) * F.lit(cells) / F.lit(1 << 32)).cast("int")})
    rows = staged(rows, "mix-rows") if len(carry) == 1 else rows

    counts = staged(rows.groupBy(source, band, cell).agg(F.count("*").alias("n"), F.sum(size).alias("words")), "mix-cells")
    by_band = counts.groupBy(source, band).agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    sources = by_band.groupBy(source).agg(F.sum("words").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last()))
    ring = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank_") - 1) % len(weights) + 1)
    sources = levelled(sources.withColumn("rank_", rank).withColumn("weight", ring), share, cap)
    sources = sources.select(F.col(source).alias("s_"), "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"))
    in_source, in_band = Window.partitionBy(source).orderBy(band), Window.partitionBy(source, band).orderBy(cell)
    bands = by_band.withColumn("bands_before", F.sum("n").over(in_source) - F.col("n")).select(F.col(source).alias("s_b"), F.col(band).alias("b_b"), "bands_before")
    offsets = counts.withColumn("cells_before", F.sum("n").over(in_band) - F.col("n"))
    offsets = offsets.join(bands, F.col(source).eqNullSafe(F.col("s_b")) & (F.col(band) == F.col("b_b")))
    offsets = offsets.join(sources, F.col(source).eqNullSafe(F.col("s_")))
    offsets = offsets.select(F.col(source).alias("s_k"), F.col(band).alias("b_k"), F.col(cell).alias("c_k"), (F.col("bands_before") + F.col("cells_before")).alias("before"), "source_size", "target", "rate")

    place = F.row_number().over(Window.partitionBy(source, band, cell).orderBy(mark, F.col("id_"), tie))
    rows = rows.withColumn("place_", place).join(offsets, F.col(source).eqNullSafe(F.col("s_k")) & (F.col(band) == F.col("b_k")) & (F.col(cell) == F.col("c_k")))
    start = (unit_hash(F.lit(seed), F.lit("offset"), F.coalesce(F.col(source), F.lit("null"))) % (1 << 20) + 0.5) / (1 << 20)
    upto = lambda k: F.floor(k * F.col("rate") + start)
    rank_of = F.col("before") + F.col("place_")
    copies = F.least((upto(rank_of) - upto(rank_of - 1)).cast("bigint"), F.ceil(F.lit(cap)).cast("bigint"))
    rows = rows.withColumn("copies", copies)
    return rows.select("carried_.*", F.col(size).alias("size"), F.col("source_size").cast("bigint").alias("source_size"), "target", "copies", (F.col("copies") * F.col(size)).alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: every column of docs, each row as often as it is taken."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    packed = docs.select(F.col(f"`{id_col}`").alias("id__"), F.col(f"`{text_col}`").alias("text__"), F.col(f"`{source_col}`").alias("source__"), F.struct(*names).alias("row__"))
    out = mix(packed, "id__", "text__", "source__", carry=["row__"], **options)
    out = out.where("copies > 0").select("row__", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy__"))
    return out.select("row__.*")
