"""The lines or pages of a document that tell most of its parts, as much as a budget of characters holds.

The order and the budget are running sums over a document's lines or pages, so no document's text is put together: the
result is the pieces in their order, the last one cut where the budget ends.  Defined cases: null texts count as empty;
pages of one score keep their order; a budget of nothing gives nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partweave.functions import cells as C

# Words and shapes of pages and lines of parts, characters a model reads, characters that make a list.
SECTIONS = ("LIST OF MATERIALS", "PARTS LIST", "REQD", "CODE IDENT", "IDENTIFYING NO", "NOMENCLATURE", "MANUFACTURER")
DESIGNATOR = r"\b[A-Z]{1,3}\d+(?:[-,]\d+)*\b"
PART_LINE = r"\s\d{1,3}\s+\d{1,4}\s+[0-9A-Z]{4,5}\s+\S{3,}"
DESIGNATOR_LINE = r"^[A-Z]{1,4}\d+[A-Z]?(?:[-,]\d+)*(?:[,\s]+[A-Z]{0,4}\d+[A-Z]?(?:[-,]\d+)*)*[,]?$"
HEAD_LINE = "IDENTIFYING NO"
BUDGET, LIST = 26_000, 200


def within(rows: DataFrame, by: list[str], order: list, budget: int, between: int, text: str = "text") -> DataFrame:
    """The rows whose texts, joined in order by ``between`` characters, begin within the budget; the last is cut."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.length(text) + between).over(w), F.lit(0))
    out = rows.withColumn("begin__", begin).where(F.col("begin__") < budget)
    return out.withColumn(text, F.substring(F.col(text), F.lit(1), (F.lit(budget) - F.col("begin__")).cast("int"))).drop("begin__")


def page_score(text: str = "text"):
    """Five for each section word and one for each designator."""
    upper = F.upper(text)
    words = F.size(F.filter(F.array(*map(F.lit, SECTIONS)), lambda s: F.contains(upper, s)))
    return 5 * words + F.size(F.regexp_extract_all(text, F.lit(DESIGNATOR), 0))


def relevant_pages(pages: DataFrame, by: list[str], budget: int = BUDGET) -> DataFrame:
    """``pages(*by, page, text)`` -> ``(*by, place, page, score, text)``: pages of parts first, two line ends between them."""
    p = pages.select(*by, "page", F.coalesce("text", F.lit("")).alias("text")).withColumn("score", page_score())
    order = [F.desc("score"), "page"]
    p = p.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return within(p, by, ["place"], budget, 2).select(*by, "place", "page", "score", "text")


def parts_lines(lines: DataFrame, by: list[str], budget: int = BUDGET, least: int = LIST) -> DataFrame:
    """``lines(*by, line, text)`` -> ``(*by, line, text, list)``: lines of parts and designators; all lines of documents that have few.

    Few: the lines, joined by line ends, have ``least`` characters or fewer.  Lines of parts lose the blanks at their ends.
    """
    raw = lines.select(*by, "line", F.coalesce("text", F.lit("")).alias("text"))
    d = raw.withColumn("s", C.strip("text"))
    kept = (F.col("s") != "") & (F.col("text").rlike(PART_LINE) | F.col("s").rlike(DESIGNATOR_LINE) | F.contains(F.upper("text"), F.lit(HEAD_LINE)))
    d = d.withColumn("kept", kept)
    long = d.groupBy(*by).agg((F.sum(F.when(F.col("kept"), F.length("s") + 1)) - 1).alias("n")).select(*by, F.coalesce(F.col("n") > least, F.lit(False)).alias("list"))
    d = d.join(long, by).where("kept OR NOT list").select(*by, "line", F.when(F.col("list"), F.col("s")).otherwise(F.col("text")).alias("text"), "list")
    return within(d, by, ["line"], budget, 1).select(*by, "line", "text", "list")
