"""Findings of round 4: the driver must not gather the tables of the rename join, nor settle its pairs in many rounds."""

import itertools

import pytest

from partweave.functions import similarity as S
from partweave.operators import components as G
from partweave.operators import diff as D
from partweave.operators import rename as R
from partweave.written import Written


def keys(spark, ks):
    return spark.createDataFrame([(x,) for x in ks], "k string")


@pytest.mark.parametrize("threshold", [0.5, 0.88])
def test_candidates_are_not_broadcast(spark, threshold):
    """Texts of many lengths, so that every kind of join has rows; few bytes, so that Spark would broadcast."""
    texts = [("AB12CD34" * 9)[k : k + n] for k, n in itertools.product((0, 1), (3, 9, 14, 20, 30, 45, 64))]
    texts = spark.createDataFrame([(t,) for t in dict.fromkeys(texts)], "canon string")
    got = R.candidates(texts, texts, threshold)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    got.collect()
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()  # as it was run


def test_pairs_and_aliases_are_not_broadcast(spark):
    revision = lambda p: spark.createDataFrame([(f"{p}{k}", k) for k in range(5)], "mpn string, line long")
    rows, pairs = D.diff(revision("a"), revision("b")), spark.createDataFrame([("A1", "B2")], "old_k string, new_k string")
    got = D.apply_renames(rows, Written(spark).table(pairs, "p"))
    got.collect()
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r["node"]: r["component"] for r in G.components(pairs.toDF("a", "b")).collect()} == {"A1": "A1", "B2": "A1"}


def test_chains_settle_in_few_rounds(spark, monkeypatch):
    """Each part but the first has its second best in common with the part before, which no one else wants."""
    names = []
    table = Written.table
    monkeypatch.setattr(Written, "table", lambda self, df, name: names.append(name) or table(self, df, name))
    draw = [f"{k:02d}" for k in range(40)]
    old, new = [f"PART{a}{a}{a}{a}X" for a in draw], [f"PART{a}{a}{a}{b}X" for a, b in zip(draw, draw[1:] + draw[:1], strict=True)] + [f"PART{a}{a}{a}{a}Y" for a in draw]
    used, want = set(), set()
    for x in sorted(old):
        best = min(((-S.weighted(x, y), y) for y in new if y not in used and S.weighted(x, y) >= 0.7), default=None)
        if best:
            used.add(best[1])
            want.add((x, best[1]))
    got = {(r.old_k, r.new_k) for r in R.rename_pairs(keys(spark, old), keys(spark, new), 0.7).collect()}
    assert got == want and len(names) < 14


def test_a_refused_best_keeps_its_part_for_others(spark):
    """The first part's best is refused: it gets none, and the second, which likes the same best, gets that."""
    old, new = ["ABC1234567", "ABC1234568"], ["ABC12345678", "ABC123456799"]
    no = spark.createDataFrame([(old[0], new[0])], "a string, b string")
    assert [(r.old_k, r.new_k) for r in R.rename_pairs(keys(spark, old), keys(spark, new), rejected=no).collect()] == [(old[1], new[0])]


def test_texts_are_compared_after_the_joins(spark):
    """Else every part of a longer text would go through Python."""
    seen = spark.sparkContext.accumulator(0)
    weighted = S.weighted

    def counted(a, b):
        seen.add(1)
        return weighted(a, b)

    old, new = [f"{c}{k}BRANDPARTNUMBER{k}" for k, c in enumerate("ABCDEFGH")], ["QQQQQQQ", "ZZZZZZZZ", "A0BRANDPARTNUMBER0Z"]
    S.weighted, before = counted, S.weighted
    try:
        got = R.rename_pairs(keys(spark, old), keys(spark, new)).collect()
    finally:
        S.weighted = before
    assert [(r.old_k, r.new_k) for r in got] == [(old[0], new[2])]
    assert 1 <= seen.value <= 8
