"""Tables written to the folder that all executors share: lineage ends there, and lost executors lose nothing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and there is one machine, as in tests, an own one."""
    jsc = spark.sparkContext._jsc
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and jsc.sc().getCheckpointDir().isDefined():
        found = jsc.sc().getCheckpointDir().get()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='staged')}"
        spark.sparkContext.setCheckpointDir(found)
        found = jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def staged(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here.

    The files survive lost executors; the file system drops them when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)
