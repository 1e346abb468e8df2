"""Words of pages of any size: steps that must not grow with a page's square, and shuffles of texts only."""

import contextlib
import io

import pytest

import __spark_entry__ as entry
from partweave.operators import words as W

WORDS = "page int, text string, x0 double, x1 double, top double, bottom double"


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_column_starts_of_very_wide_words(spark):
    """Places are not counted one by one; words that overlap in a line cover a place once, lines of one word do not count."""
    rows = [(1, "a", 0.0, 9e8, 0.0, 8.0), (1, "b", 5.0, 1e9, 0.0, 8.0), (1, "c", 0.0, 3.0, 40.0, 48.0), (1, "d", 7.0, 8.0, 40.0, 48.0), (1, "e", 2e9, 2.1e9, 80.0, 88.0), (2, "x", 1.0, 2.0, 0.0, 8.0)]
    got = W.column_starts(spark.createDataFrame(rows, WORDS), ["page"]).collect()
    assert sorted((r["page"], r["start"]) for r in got) == [(1, 0), (1, 7)]


def test_nearest_anchor_runs_on_from_the_first_row(spark):
    words = spark.createDataFrame([(1, f"w{k}", 0.0, 1.0, float(k), 0.0) for k in range(12)], WORDS).selectExpr("*", "0 AS col")
    anchors = spark.createDataFrame([(1, 1, 2.0), (1, 2, 6.0), (1, 3, 6.0)], "page int, row int, y double")
    got = W.nearest(words, anchors, ["page"])
    assert {r["text"]: r["row"] for r in got.collect()} == {f"w{k}": 1 if k <= 4 else 2 for k in range(12)}
    assert "unboundedfollowing" not in plan(got).lower()


@pytest.mark.parametrize("name", ["words_to_columns", "words_to_lines", "nearest_anchor", "column_starts_histogram"])
def test_words_are_not_shuffled(spark, name):
    """Only the texts are dealt, by document; no step deals words, lines or places again."""
    found = plan(entry.queries()[name](spark, "/root/testdata/sf0.001"))
    assert "REPARTITION_BY_NUM" in found and "ENSURE_REQUIREMENTS" not in found


@pytest.mark.parametrize("name", ["parts_lines", "anchored_lines"])
def test_lines_are_dealt_once(spark, name):
    assert "REPARTITION_BY_NUM" in plan(entry.queries()[name](spark, "/root/testdata/sf0.001"))
