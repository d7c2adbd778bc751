"""Bounded, reproducible samples of labelled texts, for operators that fit a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: A text longer than this many bytes is scored whole, but not used for training.
MAX_TRAIN_BYTES = 1 << 18
#: Bytes of the texts of one label that are collected, at most.
MAX_CLASS_BYTES = 48 << 20


def fold(doc_id, folds: int):
    """crc32 of the id as text, modulo the folds."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, held_out=None, id_col: str = "doc_id", text_col: str = "text", class_bytes: int = MAX_CLASS_BYTES) -> dict[int, list[str]]:
    """Up to per_class texts of each label 0 and 1, collected to the driver, in hash order of the ids.

    The bound (per_class rows and class_bytes bytes of each label) does not grow with the input. An id
    with several rows or labels counts once, with its smallest text and largest label.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).where("id is not null and y in (0, 1)")
    if held_out is not None:
        known = known.where(~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("id"))
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy("h", "id").limit(2 * per_class)  # some have no text
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where(f"text is not null and octet_length(text) <= {MAX_TRAIN_BYTES}")
    texts = texts.join(F.broadcast(chosen), "id").groupBy("id", "h", "y").agg(F.min("text").alias("text"))
    out: dict[int, list[str]] = {}
    for y in (0, 1):
        first = texts.where(F.col("y") == y).orderBy("h", "id").limit(per_class)  # few rows, so one task may sum their sizes
        upto = F.sum(F.octet_length("text").cast("bigint")).over(Window.orderBy("h", "id"))
        rows = first.withColumn("upto", upto).where(F.col("upto") <= class_bytes).orderBy("h", "id").select("text").collect()
        out[y] = [r["text"] for r in rows]
    return out
