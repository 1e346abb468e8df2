"""Connected components of an edge table by alternating large-star and small-star rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond" (SoCC 2014): each round points nodes
at smaller nodes of their neighbourhood until every component is a star around its smallest node.
Rounds grow with the logarithm of the size, no node's neighbours are ever gathered in one place
(minima are pre-aggregated, then joined back) and each round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "cc", rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` -> ``(node, component)`` for every node of an edge; component is its smallest node.

    Self links, repeated links and null ends are ignored; without links the result is empty.
    """
    now = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = scratch.table(now, f"{name}0")
    last = _sign(now)
    if not last[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for k in range(1, rounds + 1):
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).distinct()
        now, before = scratch.table(small, f"{name}{k}"), f"{name}{k - 1}"
        scratch.drop(before)
        sign = _sign(now)
        if sign == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        last = sign
    raise RuntimeError("components did not settle")


def _sign(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)
