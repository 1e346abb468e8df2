"""Findings of round 3: steps whose work must not be done twice, nor grow with the square of a page."""

from pyspark.sql import functions as F

from partweave.operators import diff as D
from partweave.operators import quote as Q
from partweave.operators import rename as R
from partweave.operators import words as W
from partweave.plans.catalogue import QUERIES


def counted(spark, rows, column):
    """Rows whose column passes through Python, and the number of values that have passed."""
    seen = spark.sparkContext.accumulator(0)

    def passed(x):
        seen.add(1)
        return x

    return rows.withColumn(column, F.udf(passed, rows.schema[column].dataType).asNondeterministic()(column)), seen


def test_rows_are_cleaned_once(spark):
    rows = spark.createDataFrame([("t", k, f"I-{k}", "bolt steel", "ACME", f"XY{k}", "1") for k in range(20)], "doc string, row long, item string, description string, maker string, part string, qty string")
    rows, seen = counted(spark, rows, "description")
    assert sorted((r["line"], r["part"], r["qty"]) for r in Q.clean_rows(rows, ["doc"]).collect()) == [(k + 1, f"XY{k}", "1") for k in range(20)]
    assert seen.value == 20


def test_rows_are_read_once_to_fold_aliases(spark):
    revision = lambda p: spark.createDataFrame([(f"{p}{k}", k) for k in range(5)], "mpn string, line long")
    rows, seen = counted(spark, D.diff(revision("a"), revision("b")), "status")
    aliases = spark.createDataFrame([("A1", "x"), ("B3", "x"), ("A4", "y")], "mpn string, canon string")
    assert {r["status"]: r["n"] for r in D.summary(D.fold_aliases(rows, aliases)).collect()} == {"modified": 1, "removed": 4, "new": 4}
    assert seen.value == 10


def test_lines_of_a_page_without_its_words_in_one_array(spark):
    rows = [("p", f"w{k}", k % 7, 5 * k, 6, 12) for k in range(40)] + [("p", "none", 0, None, 6, 12), ("p", "none too", 0, None, 6, 12), (None, "x", 0, 3, 6, 50), (None, "y", 0, 33, 6, 50), (None, "z", 0, 34, 6, 50)]
    got = W.group_lines(spark.createDataFrame(rows, "doc string, text string, left int, top int, width int, height int"), ["doc"])
    # tolerance 8: two tops of a run share a line, after the two words without a top
    want = {("p", f"w{k}"): 2 + k // 2 for k in range(40)} | {("p", "none"): 0, ("p", "none too"): 1, (None, "x"): 0, (None, "y"): 0, (None, "z"): 1}
    assert {(r["doc"], r["text"]): r["line"] for r in got.collect()} == want
    assert "collect_list(struct" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_are_found_once(spark):
    """Those who apply pairs read them three times, so they come as one written table, not as all the steps that found them."""
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "k string")
    pairs = R.rename_pairs(keys("ABC-1234567", "ABC-1234568"), keys("ABC12345678", "ABC1234568R"))  # in two rounds
    assert pairs.count() == 2
    revision = lambda p: spark.createDataFrame([(f"{p}{k}", k) for k in range(5)], "mpn string, line long")
    folded = D.fold_aliases(D.diff(revision("a"), revision("b")), spark.createDataFrame([("A1", "x"), ("B3", "x")], "mpn string, canon string"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan(pairs) and "Window" not in plan(folded)


def test_figures_read_the_diff_once(spark):
    got = QUERIES["diff_figures"](spark, "/root/testdata/sf0.001")
    assert got.first()["mpn_renamed_count"] > 0 and got._jdf.queryExecution().optimizedPlan().toString().count("FullOuter") == 0
