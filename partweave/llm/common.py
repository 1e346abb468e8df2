"""Shared helpers: table access, written intermediate tables, worker set-up."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import weakref
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only where it is unset, in a local session, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="partweave-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def ready(spark: SparkSession) -> None:
    """Lets Python workers import this package when the session was started without it on the path.

    On a cluster the package is installed or sent with ``--py-files``; this covers local sessions.
    """
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


class Scratch:
    """Written intermediate tables under the shared checkpoint folder.

    A written table cuts the lineage: a lost executor costs at most the stage that was running.
    Tables are deleted by ``drop`` or, at the latest, when the owner is collected or Python exits.
    """

    def __init__(self, spark: SparkSession):
        ready(spark)
        self.spark, self.base = spark, f"{shared_dir(spark)}/pw-{uuid.uuid4().hex}"
        self.names: set[str] = set()
        self._end = weakref.finalize(self, _delete, spark, self.base)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.parquet(path)
        self.names.add(name)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._pw_scratch = self  # keeps the files while the frame is in use
        return out

    def drop(self, *names: str) -> None:
        """Deletes tables that have no further reader; those that were never written are skipped."""
        for name in names:
            _delete(self.spark, f"{self.base}/{name}")
            self.names.discard(name)

    def only(self, *names: str) -> None:
        self.drop(*(self.names - set(names)))


def keep(df: DataFrame, scratch: Scratch) -> DataFrame:
    """Ties the lifetime of ``scratch`` to the session, as ``df`` is evaluated later."""
    _KEPT.setdefault(id(scratch.spark), []).append(scratch)
    return df


_KEPT: dict[int, list] = {}


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is already down; the cluster's own retention removes the folder
        return
