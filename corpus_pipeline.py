"""A corpus from documents to tokens: five stages, each one of the training-data operators.

run() writes every stage's rows as Parquet in the shared folder and reads them back as the next
one's documents. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from logloom.llm import exact_dedup, jaccard, mixing, pieces, quality
from logloom.llm.common import bitmap_of, staged, with_hit

#: A document whose quality score is below this goes.
LEAST_QUALITY = 0.3


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that the compression classifier does not reject."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality.score(F.col("text"), model) >= LEAST_QUALITY)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of equal texts the row with the largest id stays."""
    return exact_dedup.drop_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of rows linked by 75 % of their 5-word shingles one with the least id stays; all unlinked ones stay.

    Rows are told apart by id and set of shingles, so an id that repeats with other texts, or is null, loses only its
    linked rows. A null id loses against any other; of several rows with the least id one stays.
    """
    rows = jaccard.linked_sets(docs).where("least is not null")
    cells = rows.groupBy(F.col("id").alias("lost_id"), "f1", "f2").agg(F.count("*").alias("c"), F.first(F.col("least") & F.col("id").eqNullSafe(F.col("component_id"))).alias("spare"))
    lost = staged(cells.where("c > 1 or not spare").drop("c"), "pipeline-near")
    bitmap = bitmap_of(lost.select(F.xxhash64("lost_id").alias("key")), "key")
    near = with_hit(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("doc_id").alias("key")), bitmap, "key", "hit")
    clear = near.where("not hit").select("row.*")
    doubtful = near.where("hit").select("row", F.col("row.doc_id").alias("own"), jaccard.set_fingerprint(F.col("row.text")).alias("set"))
    same = F.col("own").eqNullSafe(F.col("lost_id")) & (F.col("set.f1") == F.col("f1")) & (F.col("set.f2") == F.col("f2"))
    left = doubtful.join(lost, same, "left").where("spare is null or spare")
    # Of repeats of the least id and its set one stays.
    turn = F.row_number().over(Window.partitionBy("own", "f1", "f2").orderBy(F.to_json("row")))
    first = left.where("spare").withColumn("turn", turn).where("turn = 1")
    return clear.unionByName(left.where("spare is null").select("row.*")).unionByName(first.select("row.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: every source as often as its weight says; rows repeat where a document is taken twice."""
    return mixing.mixed_rows(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: the columns of documents and their token ids."""
    return pieces.encode(docs)


STAGES = [("quality", keep_good), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("pieces", tokenize)]

#: Compression, hashing of shingles and merges have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
