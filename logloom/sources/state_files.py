"""Small JSON documents on any file system that Spark reaches, replaced in one step."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class StateFile:
    """One JSON document. A reader sees the old one or the new one, never a part: a new one is written beside it and renamed over it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path_of = jvm.org.apache.hadoop.fs.Path
        self._files = self._path_of(path).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), conf)

    def read(self, default=None):
        """The document; default where there is none."""
        target = self._path_of(self.path)
        if not self._files.exists(target):
            return default
        stream = self._files.open(target)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def write(self, document) -> None:
        part = self._path_of(f"{self.path}.{uuid.uuid4().hex}.part")
        stream = self._files.create(part, True)
        try:
            stream.write(bytearray(json.dumps(document, sort_keys=True).encode()))
        finally:
            stream.close()
        gateway, rename = self.spark.sparkContext._gateway, self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
        options = gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        self._context.rename(part, self._path_of(self.path), options)
