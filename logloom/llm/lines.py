r"""Operator 11: line dedup across documents.

Every text is split at \n and its lines are exploded with their place. A line's key is the line
without white space (``[\x20\x09-\x0D]``) at both ends and with A-Z lower-cased; keys of enough code points
are hashed (MD5, 128 bits). Distinct documents are counted per hash in two steps, (hash, document) and
then hash, so a line that a third of all documents share is summed before it meets. Lines of hashes found in
enough documents are dropped, except in the largest document id that holds them, and what is left of a
text is put together again by position.

What travels is a row of 16 bytes and a place for each long line; whole texts travel once, to the places that they lose.

Defined cases: a null or empty text is one empty line; a null id is a document of its own and the least; rows that
repeat an id are one document, and each row loses its own lines; a text that loses all its lines becomes empty;
an empty table gives an empty result; carried columns may have any name.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from .common import WHITE, staged

LEAST_CHARS, LEAST_DOCS = 40, 5


def line_key(line: Column) -> Column:
    """The line in the form in which lines are compared."""
    bare = F.trim(line, F.lit(WHITE.decode()))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def long_lines(docs: DataFrame, id_col: str, text_col: str, least_chars: int) -> DataFrame:
    """A row (own, version, place, hash) for each line whose key is long enough; version tells rows that repeat an id apart."""
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("own"), version(text).alias("version"), F.posexplode(lines_of(text)).alias("place", "line"))
    keyed = rows.select("own", "version", "place", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= least_chars)
    return keyed.select("own", "version", "place", F.unhex(F.md5("key")).alias("hash"))


def version(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def repeated(lines: DataFrame, least_docs: int) -> DataFrame:
    """Hashes found in enough documents, with the largest id that holds them."""
    held = lines.groupBy("hash", "own").agg(F.lit(1).alias("one"))
    return held.groupBy("hash").agg(F.count("*").alias("docs"), F.max("own").alias("keeper")).where(F.col("docs") >= least_docs).select("hash", "keeper")


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, carry: list[str] | None = None) -> DataFrame:
    """One row per row of docs: the carried columns (default: the id), n_lines before dropping, n_dropped, kept (the text left)."""
    carry = [id_col] if carry is None else list(dict.fromkeys([id_col, *carry]))
    lines = staged(long_lines(docs, id_col, text_col, least_chars), "lines")
    # Written, so that both sides of the join are plain shuffles: Spark then splits the rows of a line that very many share.
    keepers = staged(repeated(lines, least_docs).withColumnRenamed("hash", "hash_r"), "lines-repeated")
    lost = lines.join(keepers, F.col("hash") == F.col("hash_r")).where(~F.col("own").eqNullSafe(F.col("keeper")))
    # Rows that repeat an id and a text name the same places.
    lost = lost.groupBy(F.col("own").alias("own_l"), F.col("version").alias("version_l")).agg(F.collect_set("place").alias("places"))

    text = F.col(f"`{text_col}`")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(f"`{id_col}`").alias("own"), version(text).alias("version"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.join(lost.hint("shuffle_hash"), F.col("own").eqNullSafe(F.col("own_l")) & (F.col("version") == F.col("version_l")), "left")
    count = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    split = F.array(lines_of(F.col("text")))  # an array of one binds the lines
    left = lambda s: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(s) - 1), F.col("places")), lambda i: F.get(s, i)), "\n")
    kept = F.when(F.col("places").isNull(), F.col("text")).otherwise(F.get(F.transform(split, left), F.lit(0)))
    return rows.select("row.*", count.cast("bigint").alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("bigint").alias("n_dropped"), kept.alias("kept"))
