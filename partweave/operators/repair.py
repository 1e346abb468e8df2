"""Repair of a quote's suspect cells by a second reading of the same table.

Rows and readings are ``(*by, line, item, description, maker, part, qty)``.  Only weak tables are repaired: those read
with little confidence or with several suspect rows.  A suspect row is matched by its item, letters and digits only,
else by the most similar description; each suspect cell takes the other reading where that is clearly better.

Descriptions are compared by matching blocks, at least 0.6.  Blocks of that much hold three tenths of both texts'
characters, so both share that many counted characters (``e``, the second ``e``, ...); each text's rarest counted
characters, as many as could be missed and one more, find all such pairs by an equi-join, and the shared ones are
counted before any text is compared in Python.

Defined cases: null cells count as empty; a row without item and description has no match; of readings with one item
the first line counts, of equally similar ones too; tables without a second reading only get their flags; empty tables
give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partweave.functions import cells as C
from partweave.functions import similarity as S
from partweave.operators import quote as Q
from partweave.written import Written

FIELDS = ("description", "part", "maker", "qty")
SURE, MANY, ALIKE = 0.85, 2, 0.6


def _text(c: str) -> Column:
    return F.when(C.blank(c), "").otherwise(C.strip(c))


def _form(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def weak(rows: DataFrame, confidence: DataFrame, by: list[str]) -> DataFrame:
    """-> ``(*by)``: tables with a ``confidence`` under 0.85 (none counts as 1) or two suspect rows at least, of those with any."""
    n = Q.suspects(rows).where("size(suspect) > 0").groupBy(*by).agg(F.count("*").alias("n"))
    return n.join(confidence.select(*by, "confidence"), by, "left").where((F.coalesce("confidence", F.lit(1.0)) < SURE) | (F.col("n") >= MANY)).select(*by)


def alike(left: DataFrame, right: DataFrame, by: list[str], least: float = ALIKE) -> DataFrame:
    """``left(*by, x)``, ``right(*by, y)``, distinct texts of letters and digits -> ``(*by, x, y, score)``: all pairs of ``least`` or more."""
    need = least / 2  # of both texts' characters together
    ratio = need / (1 - need)  # the shorter text's length is at least this part of the longer one's
    some = lambda d, c: d.where(F.length(c) > 0).select(*by, F.col(c), S.marks(c).alias("marks"))
    written = Written(left.sparkSession)
    a, b = written.table(some(left, "x"), "x"), written.table(some(right, "y"), "y")
    marks = a.select(*by, F.explode("marks").alias("mark")).union(b.select(*by, F.explode("marks").alias("mark"))).groupBy(*by, "mark").agg(F.count("*").alias("n"))

    def rarest(d: DataFrame, c: str) -> DataFrame:
        """A text's rarest marks: it may miss all but ``ratio`` of its length."""
        ranked = d.select(*by, c, F.explode("marks").alias("mark")).join(marks, [*by, "mark"]).groupBy(*by, c).agg(F.array_sort(F.collect_list(F.struct("n", "mark"))).alias("m"))
        return ranked.select(*by, c, F.explode(F.slice("m", 1, (F.length(c) - F.ceil(F.length(c) * ratio - 1e-9) + 1).cast("int"))).alias("m")).select(*by, c, "m.mark")

    m, n = F.length("x"), F.length("y")
    pairs = rarest(a, "x").join(rarest(b, "y"), [*by, "mark"]).where(F.least(m, n) >= need * (m + n) - 1e-9).select(*by, "x", "y").distinct()
    both = pairs.join(a.withColumnRenamed("marks", "p"), [*by, "x"]).join(b.withColumnRenamed("marks", "q"), [*by, "y"])
    close = both.where(F.size(F.array_intersect("p", "q")) >= need * (m + n) - 1e-9).select(*by, "x", "y")
    scored = close.withColumn("score", S.column(S.loose, "x", "y")).where(F.col("score") >= least)
    none = left.where("x = ''").join(right.where("y = ''"), by).select(*by, "x", "y", F.lit(1.0).alias("score"))  # two texts without letters and digits are equal
    return scored.unionByName(none)


def matches(suspects: DataFrame, reading: DataFrame, by: list[str]) -> DataFrame:
    """-> ``(*by, line, other)``: the reading's line for each suspect row that has one."""
    written = Written(suspects.sparkSession)
    s = written.table(suspects.select(*by, "line", _form(_text("item")).alias("i"), _text("description").alias("d")), "suspects")
    r = written.table(reading.select(*by, "line", _form(F.coalesce("item", F.lit(""))).alias("i"), _form(_text("description")).alias("y")), "reading")
    first = r.where("i <> ''").groupBy(*by, "i").agg(F.min("line").alias("other"))
    by_item = written.table(s.join(first, [*by, "i"]).select(*by, "line", "other"), "items")
    rest = s.join(by_item, [*by, "line"], "left_anti").where("d <> ''").select(*by, "line", _form("d").alias("x"))
    places = r.groupBy(*by, "y").agg(F.min("line").alias("other"))
    # nothing is more alike than an equal text, so only texts without one are compared with others
    same = written.table(rest.join(places.withColumnRenamed("y", "x"), [*by, "x"]).select(*by, "line", "x", "other"), "same")
    rest = written.table(rest.join(same.select(*by, "x").distinct(), [*by, "x"], "left_anti"), "rest")
    by_item = by_item.unionByName(same.drop("x"))
    pairs = alike(rest.select(*by, "x").distinct(), r.join(rest.select(*by).distinct(), by, "left_semi").select(*by, "y").distinct(), by)
    best = pairs.join(places, [*by, "y"]).groupBy(*by, "x").agg(F.min(F.struct((-F.col("score")).alias("s"), "other")).alias("b"))
    return by_item.unionByName(rest.join(best, [*by, "x"]).select(*by, "line", "b.other"))


def report(rows: DataFrame, reading: DataFrame, confidence: DataFrame, by: list[str]) -> DataFrame:
    """-> ``(*by, line, field, own, other, action)``: what happens to each suspect cell of weak tables.

    ``changed``: it takes the other reading; ``differs``: both readings are plausible; ``unmatched``: the other reading has
    no such row.  Cells on which both agree, or that the other reading leaves empty, are not reported.
    """
    tables = weak(rows, confidence, by).join(reading.select(*by).distinct(), by, "left_semi")
    written = Written(rows.sparkSession)
    suspects = written.table(Q.suspects(rows).where("size(suspect) > 0").join(tables, by, "left_semi"), "suspects")
    found = matches(suspects, reading, by)
    other = reading.select(*by, F.col("line").alias("other"), F.struct(*[_text(f).alias(f) for f in FIELDS]).alias("o"), F.lit(True).alias("found"))
    both = suspects.join(found, [*by, "line"], "left").join(other, [*by, "other"], "left")
    cells = both.select(*by, "line", "suspect", "found", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), _text(f).alias("own"), F.coalesce(F.col(f"o.{f}"), F.lit("")).alias("text")) for f in FIELDS])))
    cells = cells.where(F.array_contains("suspect", F.col("field")))
    better = F.lit(False)
    for f in FIELDS:
        better = F.when(F.col("field") == f, Q.better(f, "text", "own")).otherwise(better)
    action = F.when(F.col("found").isNull(), "unmatched").when(F.coalesce(better, F.lit(False)), "changed").when((F.col("text") != "") & (F.col("text") != F.col("own")), "differs")
    return cells.select(*by, "line", "field", "own", F.when(F.col("found"), F.col("text")).alias("other"), action.alias("action")).where("action IS NOT NULL")


def repaired(rows: DataFrame, changes: DataFrame, by: list[str]) -> DataFrame:
    """The rows with their changed cells, ``changed`` and, where rows have it, ``mounting`` told anew for those."""
    wide = changes.where("action = 'changed'").groupBy(*by, "line").agg(*[F.max(F.when(F.col("field") == f, F.col("other"))).alias(f"new_{f}") for f in FIELDS])
    both = rows.join(wide.withColumn("changed", F.lit(True)), [*by, "line"], "left")
    out = both.withColumns({f: F.coalesce(f"new_{f}", f) for f in FIELDS}).withColumn("changed", F.coalesce("changed", F.lit(False)))
    if "mounting" in rows.columns:
        out = out.withColumn("mounting", F.when(F.col("changed"), C.mounting(F.concat_ws(" ", "description", "part"))).otherwise(F.col("mounting")))
    return out.select(*rows.columns, "changed")
