"""Findings of round 3: words that are dealt by document are not dealt again, nor written."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from partweave.operators import words as W


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["anchored_words", "best_table_pages"])
def test_words_are_dealt_with_their_texts_only(spark, name):
    found = plan(entry.queries()[name](spark, "/root/testdata/sf0.001"))
    assert "REPARTITION_BY_NUM" in found and "ENSURE_REQUIREMENTS" not in found


@pytest.mark.parametrize("name", ["columnar_table"])
def test_words_are_not_dealt_by_page(spark, name):
    """Layouts, a few rows a document, may be dealt to meet the words; those stay."""
    found = plan(entry.queries()[name](spark, "/root/testdata/sf0.001"))
    assert "REPARTITION_BY_NUM" in found and not re.search(r"Exchange hashpartitioning\([^)]*page#", found)


def test_line_bins_go_to_the_even_number_without_decimals(spark):
    tops = [k / 4 for k in range(-50, 51)] + [1e15, 0.1 + 0.2, None]
    rows = spark.createDataFrame([(t,) for t in tops], "top double").select(W.line_bin("top", 4).alias("a"), F.bround(F.col("top") / 4).cast("long").alias("b"))
    assert all(r["a"] == r["b"] for r in rows.collect()) and "bround" not in plan(rows.select("a"))
