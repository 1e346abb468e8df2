"""Connected components of a table of links, and canonical names of aliases.

Rounds of large and small stars (Kiveris et al., "Connected Components in MapReduce and Beyond", SoCC 2014):
each points nodes at smaller nodes nearby until every component is a star around its least node.  Minima are
aggregated before the shuffle and joined back, so no node's neighbours are gathered; each round is written.
Joins are merge joins, as links are few bytes as files, but many times that if the driver broadcasts them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partweave.functions import cells as C
from partweave.written import Written


def components(links: DataFrame, written: Written | None = None, rounds: int = 60) -> DataFrame:
    """``links(a, b)`` -> ``(node, component)``: each node of a link with the least node of its component.

    Self links, repeated links and null ends are ignored; without links the result is empty.
    """
    written = written or Written(links.sparkSession)
    now = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, last = written.table(now, "links0"), None
    for k in range(1, rounds + 1):
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == last or not sign[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        last = sign
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).distinct()
        now = written.table(small, f"links{k}")
        written.drop(f"links{k - 1}")
    raise RuntimeError("components did not settle")


def canonical_names(pairs: DataFrame) -> DataFrame:
    """``pairs(mpn_a, mpn_b)`` -> ``(mpn, canon)``: every aliased part, upper case, with the first name of its group.

    Pairs with an empty side, or of a part with itself, make no alias.
    """
    a, b = (F.nullif(F.upper(C.strip(F.coalesce(c, F.lit("")))), F.lit("")) for c in ("mpn_a", "mpn_b"))
    return components(pairs.select(a.alias("a"), b.alias("b"))).select(F.col("node").alias("mpn"), F.col("component").alias("canon"))


def with_canonical(rows: DataFrame, aliases: DataFrame, mpn: str = "mpn", name: str = "canon") -> DataFrame:
    """Adds the canonical name of ``mpn``, which is itself (upper case) where it has no alias."""
    known = aliases.select(F.col("mpn").alias("alias_mpn__"), F.col("canon").alias("alias_canon__"))
    own = F.upper(C.strip(F.coalesce(F.col(mpn), F.lit(""))))
    out = rows.join(known, own == F.col("alias_mpn__"), "left")
    return out.select(*rows.columns, F.coalesce("alias_canon__", own).alias(name))
