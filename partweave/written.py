"""Intermediate tables that iterations write and read again, in the folder all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only where it is unset, in a local session, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="partweave-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Written:
    """Written tables of one run; a written table cuts the lineage, so a lost executor costs one step at most.

    Tables go with ``drop``; what is left goes when Python exits.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{shared_dir(spark)}/partweave-{uuid.uuid4().hex}"
        _ALL.append(self)
        self._end = weakref.finalize(self, _delete, spark, self.base)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.base}/{name}")


_ALL: list[Written] = []


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is already down; the folder's own retention removes the files
        return
