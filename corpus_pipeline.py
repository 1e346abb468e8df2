"""A corpus pipeline: quality rules, near duplicates, secrets, packing.

Each stage takes all rows its predecessor kept and is written as Parquet before the next one reads it.

Defined cases: null and empty texts go in the first stage; null and repeated ids, and rows that are equal in
all columns, are rows of their own; further columns of ``documents`` are left out; an empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partweave.llm.common import Scratch, keep, table
from partweave.llm.op02_secrets import redact_secrets
from partweave.llm.op04_jaccard_join import jaccard_components
from partweave.llm.op06_quality_rules import ledger, passes
from partweave.llm.op07_packing import pack

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None  # near duplicates, structural checks and packing are beyond SQL; tests/llm compare by brute force


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass policy v1; the others go.  A null or empty text has too few words and goes."""
    return ledger(docs, carry=COLUMNS).where(passes("v1")).select(*COLUMNS)


def _placed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows with what tells each apart from all others: its file and its place there."""
    place = [F.xxhash64("_metadata.file_path").alias("file_"), F.col("_metadata.row_index").alias("row_")]
    try:
        return docs.select(*COLUMNS, *place)
    except AnalysisException:  # rows that do not come straight from files are stored first
        return scratch.table(docs.select(*COLUMNS), "docs").select(*COLUMNS, *place)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exactly one document of each group linked by five-word shingles at a similarity of 0.8: that of the least id.

    A null id comes last; of rows with that id one stays.  Texts without words are in no group and all stay.
    """
    scratch = Scratch(spark)
    rows = _placed(docs, scratch)
    groups = jaccard_components(rows, carry=("file_", "row_")).where("component_key IS NOT NULL")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "file_", "row_").alias("at")
    # written first, so that the join has plain sides and the rows of a large group can be split over tasks
    least = scratch.table(groups.groupBy("component_key").agg(F.min(order).alias("least"), F.count("*").alias("n")).where("n > 1"), "least")
    go = groups.join(least, "component_key").where("least.file_ <> file_ OR least.row_ <> row_").select("file_", "row_")
    return keep(rows.join(scratch.table(go, "go"), ["file_", "row_"], "left_anti").select(*COLUMNS), scratch)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind."""
    out = redact_secrets(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), ranks=public_tokenizers.path("byte_bpe_50k.tiktoken")).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return keep(docs, scratch)
