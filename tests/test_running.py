"""Running values of keys of any size against plain Python, with a key that holds a third of the rows."""

import random

from pyspark.sql import functions as F

from partweave.operators import diff as D
from partweave.operators.running import numbered, running


def test_running_against_plain(spark):
    r = random.Random(3)
    keys = [("hot", 1)] * 300 + [(None, 1)] * 120 + [(r.choice("abcdef"), r.choice((1, 2, None))) for _ in range(480)]
    rows = [(a, b, k, r.choice((None, "", " ", f"v{k}", "w")), r.choice((None, 1, 5)), "extra", k) for k, (a, b) in enumerate(keys)]
    r.shuffle(rows)
    d = spark.createDataFrame(rows, "a string, b int, at long, v string, q long, range string, key int").repartition(5)
    value = F.when(F.trim("v") != "", F.col("v"))
    got = {x["at"]: x for x in running(d, ["a", "b"], ["at"], last={"seen": value}, total={"sum": F.col("q")}).collect()}
    assert len(got) == len(rows)
    state: dict = {}
    for a, b, at, v, q, *_ in sorted(rows, key=lambda x: x[2]):
        seen, total = state.get((a, b), (None, None))
        seen = v if v and v.strip() else seen
        total = total if q is None else (total or 0) + q
        state[a, b] = seen, total
        assert (got[at]["seen"], got[at]["sum"], got[at]["range"], got[at]["key"]) == (seen, total, "extra", at), at
    places = {x["at"]: x["n"] for x in numbered(d, ["a"], [-F.col("at")], "n").collect()}
    count: dict = {}
    for a, _, at, *_ in sorted(rows, key=lambda x: -x[2]):
        count[a] = count.get(a, 0) + 1
        assert places[at] == count[a]


def test_hot_key_is_cut(spark):
    """One key of all rows is dealt to all ranges alike, and values pass over ranges that have none."""
    d = spark.range(4000).selectExpr("'k' AS k", "id", "if(id = 0, 'top', '') AS v")
    out = running(d, ["k"], ["id"], last={"v": F.when(F.col("v") != "", F.col("v"))}, total={"n": F.lit(1)})
    assert out.where("v = 'top' AND n = id + 1").count() == 4000
    sizes = [r["c"] for r in d.repartitionByRange(4, "k", "id").groupBy(F.spark_partition_id()).agg(F.count("*").alias("c")).collect()]
    assert max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]


def test_ties_and_empty(spark):
    d = spark.createDataFrame([("x", 1, "a"), ("x", 1, "a"), ("x", None, None), ("x", 2, None)], "k string, at int, v string")
    got = sorted((r["at"] or 0, r["v"]) for r in D.fill_merged(d, ["v"], ["k"], ["at"]).collect())
    assert got == [(0, ""), (1, "a"), (1, "a"), (2, "a")]
    assert sorted(r["n"] for r in numbered(d, ["k"], ["at"], "n").collect()) == [1, 2, 3, 4]
    assert D.forward_fill(d.limit(0), "v", ["k"], ["at"]).columns == ["k", "at", "v", "filled"] and numbered(d.limit(0), ["k"], ["at"]).count() == 0


def test_rows_before(spark):
    """The row before counts also where it stands in the range before; nulls there start no cluster."""
    from partweave.operators import tables as T

    rows = [("k", i, None if i % 7 == 3 else float(i * i)) for i in range(200)]
    got = {r["i"]: r["cluster"] for r in T.gap_clusters(spark.createDataFrame(rows, "k string, i int, at double"), ["k"], ["i"], "at", 50.0).collect()}
    cluster, prior = 0, None
    for _, i, at in rows:
        cluster += at is not None and prior is not None and at - prior > 50
        assert got[i] == cluster
        prior = at
