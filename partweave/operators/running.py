"""Running values over the order of each key, for keys of any size.

Rows are dealt to ranges of the order of key and place, so a key with many rows is cut into several tasks.  Within a
range a window runs; what a range's last key holds at its end, one row a range, goes on to the ranges that follow with
that key.  So no task holds all rows of a key, and nothing grows with the number of keys but the ranges' own rows.

Defined cases: null keys are one key, nulls of the order come first; rows of one place stand in any order among
themselves; extra columns of any name stay; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partweave.written import Written


def unused(rows: DataFrame, name: str) -> str:
    """A column name that ``rows`` does not have."""
    while name in rows.columns:
        name += "_"
    return name


def running(rows: DataFrame, by: list[str], order: list[str | Column], last: dict[str, Column] | None = None, total: dict[str, Column] | None = None, above: dict[str, Column] | None = None) -> DataFrame:
    """Adds to each row, up to and with itself: of ``last`` the last value that is not null, of ``total`` the sum;
    and of ``above`` the last value that is not null in the rows before.

    Columns of these names in ``rows`` are replaced.
    """
    last, total, above = {**(last or {}), **(above or {})}, total or {}, above or {}
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    written = Written(rows.sparkSession)
    part, key, side, told = (unused(rows, x) for x in ("range", "key", "side", "carried"))
    places = [unused(rows, f"place{k}") for k in range(len(order))]
    own = {name: unused(rows, f"own{k}") for k, name in enumerate([*last, *total])}
    keyed = rows.select("*", F.struct(*by, F.lit(0).alias("z")).alias(key), *[(F.col(o) if isinstance(o, str) else o).alias(p) for o, p in zip(order, places, strict=True)], *[c.alias(own[x]) for x, c in {**last, **total}.items()])
    dealt = written.table(keyed.repartitionByRange(n, key, *places).withColumn(part, F.spark_partition_id()), "ranges")
    upto = Window.partitionBy(part, key).orderBy(*places).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(part, key).orderBy(*places).rowsBetween(Window.unboundedPreceding, -1)
    within = dealt.withColumns({own[x]: F.last(own[x], ignorenulls=True).over(before if x in above else upto) if x in last else F.sum(own[x]).over(upto) for x in own})

    ends = dealt.groupBy(part).agg(F.min(key).alias("first"), F.max(key).alias("end"))  # one row a range
    end_rows = dealt.join(F.broadcast(ends.select(part, F.col("end").alias(key))), [part, key])
    latest = [F.max_by(own[x], F.when(F.col(own[x]).isNotNull(), F.struct(*places))).alias(own[x]) if x in last else F.sum(own[x]).alias(own[x]) for x in own]
    tails = end_rows.groupBy(part, key).agg(*latest).withColumn(side, F.lit(1))
    heads = ends.select(part, F.col("first").alias(key), F.lit(0).alias(side))
    so_far = Window.partitionBy(key).orderBy(part, side).rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.unionByName(heads, allowMissingColumns=True)
    carry = carry.select(part, key, side, *[(F.last(own[x], ignorenulls=True) if x in last else F.sum(own[x])).over(so_far).alias(told + own[x]) for x in own]).where(F.col(side) == 0).drop(side)
    both = within.join(F.broadcast(carry), [part, key], "left")
    out = {x: F.coalesce(own[x], told + own[x]) if x in last else F.when(F.col(own[x]).isNull() & F.col(told + own[x]).isNull(), None).otherwise(F.coalesce(own[x], F.lit(0)) + F.coalesce(told + own[x], F.lit(0))) for x in own}
    return both.select(*[c for c in rows.columns if c not in out], *[c.alias(x) for x, c in out.items()]).select(*rows.columns, *[x for x in out if x not in rows.columns])


def numbered(rows: DataFrame, by: list[str], order: list[str | Column], name: str = "line") -> DataFrame:
    """Adds the place of each row within its key, from 1."""
    return running(rows, by, order, total={name: F.lit(1).cast("long")})
