"""The bounded cache over a table and over a stream, with a key that holds a third of the accesses."""

import os
import random
import time

import pytest

from partweave.streaming import cache as S


def plain(rows, ttl, most):
    """By the definition, with a search for the oldest entry."""
    caches, out = {}, {}
    for c, k, t, i in sorted(rows, key=lambda r: (r[2], r[3])):
        held = caches.setdefault(c, {})
        if k in held and t - held[k][0] > ttl:
            del held[k]
        out[i] = k in held
        if not out[i]:
            if most is not None and len(held) >= most:
                del held[min(held, key=lambda x: held[x])]
            held[k] = (t, i)
    return out


def events(n, seed=1):
    rng = random.Random(seed)
    keys = [f"k{x}" for x in range(300)]
    return [(f"c{rng.choice([0, 0, 1, 2])}", "hot" if rng.random() < 1 / 3 else rng.choice(keys), float(i // 2), i) for i in range(n)]


def done(spark, out, n):
    return os.path.exists(f"{out}/_spark_metadata") and spark.read.schema(S.OUT).parquet(out).count() >= n


@pytest.fixture(scope="module")
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


@pytest.mark.parametrize(("ttl", "most"), [(500, 64), (50, 8), (300, None), (0, 1)])
def test_batch(spark, ttl, most):
    rows = events(20_000)
    got = S.accesses(spark.createDataFrame(rows, "cache string, key string, ts double, id long").repartition(5), ttl, most)
    assert {r["id"]: r["hit"] for r in got.collect()} == plain(rows, ttl, most)


def test_stream_agrees_with_batch(rocks, tmp_path):
    rows, schema = events(100_000, 2), "cache string, key string, ts double, id long"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    os.makedirs(src)
    q = S.stream_accesses(rocks.readStream.schema(schema).parquet(src), 400, 64)
    for k in range(2):  # two runs from one checkpoint: the second finds the first one's state
        rocks.createDataFrame(rows[k * 50_000 : (k + 1) * 50_000], schema).coalesce(1).write.mode("append").parquet(src)
        run = q.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", out).start()
        until = time.time() + 60
        while time.time() < until and run.isActive and not done(rocks, out, 50_000 * (k + 1)):  # timers by the clock keep the query alive
            time.sleep(0.5)
        run.stop()
    got = {r["id"]: r["hit"] for r in rocks.read.schema(S.OUT).parquet(out).collect()}
    batch = {r["id"]: r["hit"] for r in S.accesses(rocks.createDataFrame(rows, schema), 400, 64).collect()}
    assert got == batch == plain(rows, 400, 64) and sum(r[1] == "hot" for r in rows) > 33_000
