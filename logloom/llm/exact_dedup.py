"""Operator 4: exact dedup by progressive refinement, in DataFrame operations only.

Three passes narrow the candidates. Lengths first: only rows whose length another row has go on. Their prefixes are
hashed, and only rows whose (length, prefix hash) another row has go on. Of these the full hash (SHA-256)
is taken, and equal ones are equal texts. A column store hands over a value whole, so each pass sees the text, but it
shuffles a few numbers a row. What survives a pass reaches the next one as a bitmap of
fixed size (common.bitmap_of): no text is ever shuffled. False hits of a bitmap only cost a hash.

Hot groups: counts are summed per (key, salt of the id) before they meet, and the joins back
to the rows use the same salted keys, so no task gets a whole group.

Defined cases: null text counts as empty; a null id loses against any other; ids that repeat
with the same text count as rows of one group, of which exactly one stays; ids that repeat with
different texts are independent; columns of any name pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import bitmap_of, staged, with_hit

SALTS = 64
PREFIX_CHARS = 64


def _text(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`"), F.lit(""))


def _id(column: str) -> Column:
    return F.col(f"`{column}`")


def repeated_lengths(docs: DataFrame, id_col: str, text_col: str, salts: int = SALTS) -> DataFrame:
    """Column n: each length that more than one row has."""
    slim = docs.select(F.octet_length(_text(text_col)).cast("bigint").alias("n"), F.pmod(F.xxhash64(_id(id_col)), F.lit(salts)).alias("s"))
    return slim.groupBy("n", "s").agg(F.count("*").alias("c")).groupBy("n").agg(F.sum("c").alias("c")).where("c > 1").select("n")


def surviving_groups(docs: DataFrame, id_col: str, text_col: str, salts: int = SALTS, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """Columns key: hash of each (length, prefix hash) that more than one row has; prefixes are hashed only of lengths that repeat."""
    lengths = bitmap_of(repeated_lengths(docs, id_col, text_col, salts), "n")
    text = F.col("text")
    rows = docs.select(_text(text_col).alias("text"), F.octet_length(_text(text_col)).cast("bigint").alias("n"), F.pmod(F.xxhash64(_id(id_col)), F.lit(salts)).alias("s"))
    slim = with_hit(rows, lengths, "n", "hit").where("hit").select("n", F.xxhash64(F.substring(text, 1, prefix_chars)).alias("p"), "s")
    by_prefix = slim.groupBy("n", "p", "s").agg(F.count("*").alias("c")).groupBy("n", "p").agg(F.sum("c").alias("c"))
    return by_prefix.where("c > 1").select(F.xxhash64("n", "p").alias("key"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, salts: int = SALTS, prefix_chars: int = PREFIX_CHARS, full: str | None = None, digest: str | None = None) -> DataFrame:
    """One row per row of docs: the carried columns (default: the id), keep_id, group_size, kept.

    keep_id is the largest id of the rows with equal text; kept marks that one row. full: name of a column for the full
    hash of rows that reached the last pass (null: its text is the only one); digest: for the full hash of every row,
    which the last scan then takes of the others too.
    """
    carry = [id_col] if carry is None else list(dict.fromkeys([id_col, *carry]))
    survivors = bitmap_of(surviving_groups(docs, id_col, text_col, salts, prefix_chars), "key")
    text = _text(text_col)
    size = F.octet_length(text).cast("bigint")
    packed = docs.select(F.struct(*[_id(c) for c in carry]).alias("row"), _id(id_col).alias("own"), text.alias("text"), size.alias("n"), F.xxhash64(size, F.xxhash64(F.substring(text, 1, prefix_chars))).alias("key"), F.pmod(F.xxhash64(_id(id_col)), F.lit(salts)).alias("salt"))
    hit = with_hit(packed, survivors, "key", "hit")
    hash_ = F.sha2("text", 256)
    rows = staged(hit.select("row", "own", "n", "salt", F.when(F.col("hit"), hash_).alias("full"), *([F.when(~F.col("hit"), hash_).alias("other")] if digest else [])), "exact-rows")

    cells = rows.where("full is not null").groupBy("n", "full", "salt").agg(F.max("own").alias("cell_max"), F.count("*").alias("cell_n"))
    groups = cells.groupBy("n", "full").agg(F.max("cell_max").alias("keep"), F.sum("cell_n").alias("size")).where("size > 1")
    back = cells.select("n", "full", "salt").join(groups, ["n", "full"])
    out = rows.join(back, ["n", "full", "salt"], "left")
    single = F.col("size").isNull()
    # Of rows that repeat the id and the text one stays; the partitions are those of the join.
    turn = F.row_number().over(Window.partitionBy("n", "full", "salt", "own").orderBy(F.lit(0)))
    out = out.withColumn("turn", turn)
    kept = single | (F.col("own").eqNullSafe(F.col("keep")) & (F.col("turn") == 1))
    hashes = ([F.col("full").alias(full)] if full else []) + ([F.coalesce("full", "other").alias(digest)] if digest else [])
    return out.select("row.*", *hashes, F.when(single, F.col("own")).otherwise(F.col("keep")).alias("keep_id"), F.coalesce("size", F.lit(1)).alias("group_size"), kept.alias("kept"))


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """docs without the rows whose text another row with a larger id has; all columns stay.

    Only the ids of dropped rows meet the texts again, through the bitmap and an exact join of
    the few rows that it marks.
    """
    others = [c for c in docs.columns if c != text_col]
    marked = docs.select(F.struct(*[_id(c) for c in docs.columns]).alias("whole"), _id(id_col).alias("own"), _text(text_col).alias("text"))
    groups = exact_groups(marked.select("own", "text"), "own", "text", salts=salts, full="digest")
    lost = staged(groups.where("not kept").groupBy(F.col("own").alias("lost_id"), F.col("digest").alias("lost_digest")).agg(F.count("*").alias("lost")), "exact-lost")
    bitmap = bitmap_of(lost.select(F.xxhash64("lost_id").alias("key")), "key")
    rows = with_hit(marked.withColumn("key", F.xxhash64("own")), bitmap, "key", "hit")
    clear = rows.where("not hit").select("whole.*")
    rows = rows.where("hit").withColumn("digest", F.sha2("text", 256))
    # Of repeats of one id and text all but the lost count stay.
    order = F.row_number().over(Window.partitionBy("own", "digest").orderBy(F.to_json(F.struct(*[F.col(f"whole.`{c}`") for c in others]))))
    doubtful = rows.withColumn("turn", order).join(lost, F.col("own").eqNullSafe(F.col("lost_id")) & (F.col("digest") == F.col("lost_digest")), "left")
    return clear.unionByName(doubtful.where("lost is null or turn > lost").select("whole.*"))
