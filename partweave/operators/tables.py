"""Row operators over parts lists and positioned text: grouping, as-of and interval joins, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partweave.operators.running import numbered, running, unused
from partweave.written import Written


def latest(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The row of each key that comes last by ``order``; aggregated before the shuffle."""
    best = rows.groupBy(*keys).agg(F.max(F.struct(*[F.col(o) if isinstance(o, str) else o for o in order], F.struct(*rows.columns).alias("row_"))).alias("b_"))
    return best.select("b_.row_.*")


def ranked(rows: DataFrame, order: list[tuple[Column, bool]], name: str = "rank") -> DataFrame:
    """Adds the place of each row in the whole order (from 1): ``order`` has columns with whether they ascend, nulls last.

    Rows are dealt to ranges of the order and numbered within them; the sums of the ranges before, one number a
    range, are added.  So no task holds all rows.  An empty table stays empty.
    """
    written = Written(rows.sparkSession)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part, own, size = unused(rows, "range"), unused(rows, "own"), unused(rows, "size")
    keys = [f"{unused(rows, 'key')}{k}" for k in range(len(order))]
    dealt = rows.select("*", *[o.alias(k) for o, k in zip((c for c, _ in order), keys, strict=True)])
    by = [F.col(k).asc_nulls_last() if up else F.col(k).desc_nulls_last() for k, (_, up) in zip(keys, order, strict=True)]
    dealt = written.table(dealt.repartitionByRange(n, *by).withColumn(part, F.spark_partition_id()), "ranges")
    own_place = F.row_number().over(Window.partitionBy(part).orderBy(*by))
    sizes = dealt.groupBy(part).agg(F.count("*").alias(size))
    before = sizes.withColumn(size, F.coalesce(F.sum(size).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a range
    return dealt.withColumn(own, own_place).join(F.broadcast(before), part).select(*rows.columns, (F.col(own) + F.col(size)).cast("long").alias(name))


def retain(rows: DataFrame, n: int, by: list[str], order: list[Column]) -> DataFrame:
    """The first ``n`` rows of each key by ``order``; Spark cuts each task's rows to ``n`` before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    place = unused(rows, "place")
    return rows.withColumn(place, F.row_number().over(w)).where(F.col(place) <= n).drop(place)


def continuation(rows: DataFrame, by: list[str], order: str | list[str], anchor: Column, text: str, sep: str = "\n") -> DataFrame:
    """-> ``(*by, grp, first, n, text)``: rows that follow an anchor join it; rows before any are group 0.

    Further columns of ``order`` settle ties.  Keys may be of any size; the rows that follow one anchor become one text.
    """
    order, ties = (order, []) if isinstance(order, str) else (order[0], order[1:])
    g = running(rows, by, [order, *ties], total={"grp": F.when(anchor, 1).otherwise(0)})
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), *ties, F.coalesce(text, F.lit("")).alias("t"))))
    out = g.groupBy(*by, "grp").agg(F.min(order).alias("first"), F.count("*").alias("n"), parts.alias("p"))
    return out.select(*by, "grp", "first", "n", F.array_join(F.transform("p", lambda x: x["t"]), sep).alias("text"))


def placements(rows: DataFrame, part: str, order: list[str], first: list[str]) -> DataFrame:
    """One row per part with the first row's cells and the number of rows; blank parts stay single rows.

    The result is partial sums and minima of structs, so a part with very many placements costs one row per task.
    """
    o = F.struct(*order)
    blank = F.coalesce(F.trim(F.col(part).cast("string")), F.lit("")) == ""
    own = F.when(blank, F.to_json(o)).otherwise("")
    best = F.min(F.struct(o.alias("o"), F.struct(*first).alias("f"))).alias("b")
    return rows.groupBy(F.col(part), own.alias("own_")).agg(best, F.count("*").alias("qty")).select(part, "b.f.*", "qty")


def upper_median(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """-> ``(*by, median)``: the element at place n // 2 of the sorted values, found without collecting a group.

    Values are counted first, so a group's window holds its distinct values with running counts.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    total = counts.groupBy(*by).agg(F.sum("c").alias("n"))
    run = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    return run.join(total, by).where("upto > n div 2").groupBy(*by).agg(F.min(value).alias("median"))


def islands(rows: DataFrame, by: list[str], at: str) -> DataFrame:
    """-> ``(*by, lo, hi, n)``: the runs of consecutive whole numbers."""
    d = rows.select(*by, at).distinct()
    d = numbered(d, by, [at], "place__")
    return d.select(*by, at, (F.col(at) - F.col("place__")).alias("run__")).groupBy(*by, "run__").agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.count("*").alias("n")).drop("run__")


def gap_clusters(rows: DataFrame, by: list[str], order: list[str], at: str, gap: float) -> DataFrame:
    """Adds ``cluster``: it grows by one wherever ``at`` lies more than ``gap`` after the row before."""
    prior = unused(rows, "prior")
    seen = running(rows, by, order, above={prior: F.struct(F.col(at).alias("at"))})  # a struct, as the row before may hold a null
    return running(seen, by, order, total={"cluster": F.when(F.col(at) - F.col(f"{prior}.at") > gap, 1).otherwise(0)}).drop(prior)


def alias_fold(removed: DataFrame, added: DataFrame, order: str) -> DataFrame:
    """-> ``(canon, old, new)``: removed and added parts of one canonical name, paired one to one in order.

    Both sides have ``(canon, mpn, <order>)``.
    """
    w = Window.partitionBy("canon").orderBy(order, "mpn")
    a = removed.select("canon", F.col("mpn").alias("old"), F.row_number().over(w).alias("rn"))
    b = added.select("canon", F.col("mpn").alias("new"), F.row_number().over(w).alias("rn"))
    return a.join(b, ["canon", "rn"]).drop("rn")


def previous_label(rows: DataFrame, by: list[str], order: list[str], label: Column, value: str, back: int = 5) -> DataFrame:
    """Adds ``label``: the nearest labelled value among the ``back`` rows before."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-back, -1)
    return rows.withColumn("label", F.last(F.when(label, F.col(value)), ignorenulls=True).over(w))


def header_row(cells: DataFrame, by: str | list[str], row: str, value: str, most: int = 30) -> DataFrame:
    """-> ``(*by, header_row)``: the first of the first rows that scores 4 with two hits, else the best, else 0."""
    by = [by] if isinstance(by, str) else by
    v = F.lower(F.trim(value))
    any_of = lambda *k: v.rlike("|".join(k))
    # Header keywords and their weights.
    hit = any_of("mpn", "part", "qty", "desc", "ref", "loc", "item", "mfr", "package", "manufacturer", "designator", "quantity")
    score = F.when(any_of("manufacturer", "mpn", "part number", "pn"), 3).when(any_of("qty", "quantity", "desc", "ref", "designator"), 2).otherwise(1)
    s = cells.groupBy(*by, row).agg(F.sum(F.when((F.col(row) < most) & hit, score).otherwise(0)).alias("score"), F.sum(F.when(hit, 1).otherwise(0)).alias("hits"))
    s = s.where(F.col(row) < most)
    sure = F.min(F.when((F.col("hits") >= 2) & (F.col("score") >= 4), F.col(row)))
    best = F.max(F.struct("score", (-F.col(row)).alias("r")))
    return s.groupBy(*by).agg(sure.alias("a"), best.alias("b")).select(*by, F.coalesce("a", F.when(F.col("b.score") >= 2, -F.col("b.r")), F.lit(0)).cast("long").alias("header_row"))
