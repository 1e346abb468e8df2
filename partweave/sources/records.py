"""JSON, JSON-lines and CSV records, and the stores kept in them.

Malformed files and lines are skipped, as the stores outlive changes of their format; empty folders give empty
tables of the schema asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partweave.functions import cells as C
from partweave.operators.tables import latest

CONVERSION = "id string, ts double, original_filename string, kind string, sha string, filename string, format string, total_rows long"
EVENT = "id string, timestamp string, kind string, file1 struct<name string, sha256 string>, file2 struct<name string, sha256 string>, summary map<string, string>"
SUMMARY = ("id", "ts", "original_filename", "kind", "filename", "format", "total_rows")


def json_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record a file; unreadable ones are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record a line; blank and malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def alias_csv(spark: SparkSession, path: str) -> DataFrame:
    """-> ``(mpn_a, mpn_b, note)``: quoted cells may hold commas, doubled quotes and line ends; a header names ``mpn``."""
    rows = spark.read.schema("mpn_a string, mpn_b string, note string").option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    return rows.where("NOT (lower(coalesce(mpn_a, '')) LIKE '%mpn%' AND lower(coalesce(mpn_b, '')) LIKE '%mpn%')")


def newest(rows: DataFrame, n: int, at: str = "ts", tie: str = "id") -> DataFrame:
    """The newest ``n`` rows; Spark keeps ``n`` a task before they meet."""
    return rows.orderBy(F.col(at).desc_nulls_last(), F.col(tie)).limit(n)


def upsert(store: DataFrame, new: DataFrame, keep: int = 300) -> DataFrame:
    """The store with new records: of one SHA the newest stays (records without one are their own), then the newest ``keep``."""
    both = store.unionByName(new, allowMissingColumns=True).withColumn("one__", F.coalesce("sha", F.concat(F.lit("id:"), "id")))
    return newest(latest(both, ["one__"], ["ts", "id"]).drop("one__"), keep)


def delete(store: DataFrame, ids: DataFrame) -> DataFrame:
    return store.join(ids.select("id"), "id", "left_anti")


def listing(store: DataFrame, n: int = 100) -> DataFrame:
    """The newest records without their payload, the format told by the file's name where it is missing."""
    return newest(store, n).select(*[F.coalesce("format", C.file_format("filename")).alias(c) if c == "format" else F.col(c) for c in SUMMARY])


def _pair(rows: DataFrame) -> tuple:
    return tuple(F.upper(C.strip(F.coalesce(c, F.lit("")))) for c in ("mpn_a", "mpn_b"))


def add_aliases(pairs: DataFrame, new: DataFrame) -> DataFrame:
    """Stored pairs with new ones in upper case; blank sides, pairs of a part with itself and known pairs are skipped."""
    a, b = _pair(new)
    ok = new.select(a.alias("mpn_a"), b.alias("mpn_b")).where("mpn_a <> '' AND mpn_b <> '' AND mpn_a <> mpn_b")
    return pairs.select("mpn_a", "mpn_b").union(ok).distinct()


def import_counts(new: DataFrame) -> DataFrame:
    """-> ``(added, skipped)`` of an import: rows with a blank side or two equal sides, in any case, are skipped."""
    a, b = _pair(new)
    ok = (a != "") & (b != "") & (a != b)
    return new.agg(F.count_if(ok).alias("added"), F.count_if(~ok).alias("skipped"))


def remove_aliases(pairs: DataFrame, gone: DataFrame) -> DataFrame:
    """Stored pairs without those removed, whichever side stands first; components follow from what is left."""

    def keyed(d: DataFrame) -> DataFrame:
        a, b = _pair(d)
        return d.select("mpn_a", "mpn_b", F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))

    return keyed(pairs).join(keyed(gone).select("lo", "hi"), ["lo", "hi"], "left_anti").select("mpn_a", "mpn_b")


def append_events(events: DataFrame, path: str) -> None:
    """Appends audit events as JSON lines; a missing id or time is filled in."""
    e = events.withColumn("id", F.coalesce("id", F.expr("uuid()"))).withColumn("timestamp", F.coalesce("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")))
    e.write.mode("append").json(path)


def audit_log(spark: SparkSession, path: str, keep: int = 500) -> DataFrame:
    """The newest events of the log."""
    return newest(json_lines(spark, path, EVENT), keep, "timestamp")


def preview(rows: DataFrame, order: list[str], n: int = 200) -> DataFrame:
    """-> one row ``(rows, total, truncated)``: the first rows as JSON, their number in all, and whether some are left out."""
    first = rows.orderBy(*order).limit(n).agg(F.array_sort(F.collect_list(F.struct(*order, F.to_json(F.struct(*rows.columns)).alias("j")))).alias("a"))
    total = rows.agg(F.count("*").alias("total"))
    return first.crossJoin(F.broadcast(total)).select(F.transform("a", lambda x: x["j"]).alias("rows"), "total", (F.col("total") > n).alias("truncated"))  # one row each


def recents(rows: DataFrame, keep: int = 8) -> DataFrame:
    """The newest entry of each kind and label, newest first, ``keep`` in all."""
    return newest(latest(rows, ["kind", "label"], ["ts"]), keep, "ts", "label")


def jobs(updates: DataFrame, now: float, ttl: float = 3600) -> DataFrame:
    """The last update of each job ``(job, ts, status, progress, stage)`` that is no older than ``ttl``; progress within 0 and 100."""
    last = latest(updates, ["job"], ["ts"])
    return last.where(F.lit(now) - F.col("ts") <= ttl).withColumn("progress", F.greatest(F.lit(0), F.least(F.lit(100), F.col("progress"))))


def sections(rows: DataFrame, by: str, order: list[str], n: int = 12) -> DataFrame:
    """The first ``n`` rows of each section with the number of rows left out (``more``)."""
    w = Window.partitionBy(by).orderBy(*order)
    total = rows.groupBy(by).agg(F.count("*").alias("total__"))
    first = rows.withColumn("place__", F.row_number().over(w)).where(F.col("place__") <= n)
    return first.join(total, by).withColumn("more", F.greatest(F.lit(0).cast("long"), F.col("total__") - n)).drop("place__", "total__")
