"""Stores with versions: failed writes, writers at one time, upserts, aliases and a log that is cut."""

import threading

import pytest
from pyspark.sql import functions as F

from partweave.sources import records as R
from partweave.sources.stores import Store

PAIRS = "mpn_a string, mpn_b string"


def test_failed_write_leaves_the_old_version(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", PAIRS)
    assert store.read().count() == 0 and store.commits() == []
    store.update(lambda d: R.add_aliases(d, spark.createDataFrame([("a", "b")], PAIRS)))
    with pytest.raises(Exception, match="broken"):
        store.update(lambda d: d.withColumn("mpn_a", F.expr("raise_error('broken')").cast("string")))
    assert [tuple(r) for r in store.read().collect()] == [("A", "B")] and store.commits() == [1]
    store.update(lambda d: R.remove_aliases(d, spark.createDataFrame([("B", "a")], PAIRS)))
    assert store.read().count() == 0 and store.read(1).count() == 1
    store.vacuum(1)
    assert store.commits() == [2] and store.read().count() == 0


def test_writers_at_one_time(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    together = threading.Barrier(3)

    def write(k):
        store, first = Store(spark, path, PAIRS), [True]

        def change(d):
            if first.pop() if first else False:
                together.wait(60)  # all have read the same version
            return R.add_aliases(d, spark.createDataFrame([(f"a{k}", f"b{k}")], PAIRS))

        store.update(change)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    store = Store(spark, path, PAIRS)
    assert sorted(r[0] for r in store.read().collect()) == ["A0", "A1", "A2"] and store.commits() == [1, 2, 3]


def test_conversions_and_log(spark, tmp_path):
    schema = "id string, ts double, sha string"
    store = Store(spark, f"file://{tmp_path}/c", schema)
    for k in range(3):
        store.update(lambda d, k=k: R.upsert(d, spark.createDataFrame([(f"i{k}", float(k), "same"), (f"j{k}", float(k), f"s{k}")], schema), keep=3))
    assert sorted(r["id"] for r in store.read().collect()) == ["i2", "j1", "j2"]
    log = Store(spark, f"file://{tmp_path}/l", "id string, ts double")
    for k in range(4):
        log.update(lambda d, k=k: R.newest(d.unionByName(spark.createDataFrame([(f"e{k}{n}", k + n / 10) for n in range(3)], "id string, ts double")), 5))
    assert sorted(r["id"] for r in log.read().collect()) == ["e21", "e22", "e30", "e31", "e32"]
