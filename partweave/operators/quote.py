"""Cleaning of extracted rows into the quote layout: item, description, maker, part number, quantity.

One row comes in per source row with ``item, description, maker, part, qty`` (null where the table has no such
column), ``row`` for the order, and the columns ``by`` (one at least) that tell tables apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partweave.functions import cells as C
from partweave.operators.running import numbered
from partweave.written import Written

CELLS = ("item", "description", "maker", "part", "qty")


def tail_quantities(rows: DataFrame, by: list[str], field: str = "description") -> DataFrame:
    """Quantities that a parser left at the end of a column whose header names them, after a word of the part's life.

    Only in tables where half of the rows or more end so, and that have no quantity yet.  The count is one row per table.
    """
    hit = rows.select(*by, (C.lifecycle_quantity(field)["qty"] != "").alias("hit"))
    most = hit.groupBy(*by).agg((F.count_if("hit") >= F.greatest(F.lit(1), F.floor((F.count("*") + 1) / 2))).alias("most__"))
    x = rows.withColumn("tail__", C.lifecycle_quantity(field)).join(most, by)
    return x.withColumn("qty", F.when(F.col("most__"), F.col("tail__.qty")).otherwise(F.col("qty"))).withColumn(field, F.when(F.col("most__"), F.col("tail__.text")).otherwise(F.col(field))).drop("tail__", "most__")


def clean_rows(rows: DataFrame, by: list[str], item_is_part: bool = False, glued: bool = False) -> DataFrame:
    """-> ``(*by, line, item, description, maker, part, qty)``, lines numbered from 1 in the order of ``row``.

    Rows of drawing noise go; quantities at the end of descriptions fill blank ones; words in part cells join the
    description; cells are scrubbed; makers glued to part numbers are split; wire colours are no makers; rows without
    item, part and description go.  ``item_is_part``: items were the only part numbers, so text after one is
    description.  ``glued``: part cells hold the description, too.
    Where all quantities are blank and a part repeats, rows of a part become one with their number as quantity.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a table of few bytes is few tasks, but each row costs much
    d = rows.repartition(n, *by, "row").select(*by, "row", *[empty(c).alias(c) for c in CELLS], F.col("qty").isNotNull().alias("has_qty"))
    d = d.where(~C.junk_row("description", "part") | C.has_real_part("item"))
    # one struct a step, each bound once, so that no cell's expression is repeated in the next
    split = C.split_glued_description if item_is_part else C.split_bled_words
    glue = C.split_glued_description if glued else lambda p, t: F.struct(F.coalesce(p, F.lit("")).alias("part"), t.alias("description"))
    tail = F.when(C.blank_text("qty"), C.tail_quantity("description", short=F.col("has_qty"))).otherwise(F.struct(F.col("qty").alias("qty"), F.col("description").alias("text")))
    texts = C.let(tail, lambda a: C.let(split(C.collapse("item"), a["text"]), lambda b: C.let(glue(F.col("part"), b["description"]), lambda c: F.struct(
        b["part"].alias("item"), C.clean_description(C.once(c["description"])).alias("description"), C.clean_part(c["part"]).alias("part"), C.clean_qty(a["qty"]).alias("qty")))))
    makers = C.let(F.col("x"), lambda x: C.let(C.split_glued_maker(C.clean_maker("maker"), x["part"]), lambda m: F.struct(
        x["item"].alias("item"), x["description"].alias("description"), C.drop_wire_colour(m["maker"], x["description"]).alias("maker"), m["part"].alias("part"), x["qty"].alias("qty"))))
    d = d.select(*by, "row", "maker", texts.alias("x")).select(*by, "row", F.inline(F.array(makers)))
    d = d.where(~(C.blank("part") & C.blank("description") & C.blank("item"))).select(*by, "row", *CELLS)
    return number_lines(merge_placements(Written(rows.sparkSession).table(d, "cleaned"), by), by)  # cleaned once, read twice


def merge_placements(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row per part with its number of rows as quantity, in tables where no row has one and a part repeats.

    The tables are found by an aggregate; blank parts stay rows of their own; the first row's cells stand.
    """
    part, qty = C.strip("part"), C.strip("qty")
    per = rows.groupBy(*by, part.alias("p")).agg(F.count("*").alias("c"), F.count_if(qty != "").alias("q"))
    bare = per.groupBy(*by).agg(F.sum("q").alias("q"), F.max(F.when(F.col("p") != "", F.col("c"))).alias("c")).where("q = 0 AND c > 1").select(*by, F.lit(True).alias("bare__"))
    x = rows.join(bare, by, "left")
    own = F.when(F.col("bare__") & (part != ""), "").otherwise(F.col("row").cast("string"))
    out = x.groupBy(*by, part.alias("p"), own.alias("own__"), F.coalesce("bare__", F.lit(False)).alias("b")).agg(F.min(F.struct("row", *CELLS)).alias("f"), F.count("*").alias("c"))
    return out.select(*by, "f.row", *[f"f.{c}" for c in CELLS[:-1]], F.when(F.col("b"), F.col("c").cast("string")).otherwise(F.col("f.qty")).alias("qty"))


def number_lines(rows: DataFrame, by: list[str]) -> DataFrame:
    return numbered(rows, by, ["row"]).select(*by, "line", *CELLS)


def suspects(rows: DataFrame) -> DataFrame:
    """Adds ``suspect``: the names of the cells of a row that look wrong for what they hold."""
    d, m, p, q = (F.when(C.blank(c), "").otherwise(C.strip(c)) for c in ("description", "maker", "part", "qty"))
    tokens = F.split(m, r"\s+")
    stuff = r"(?i)\b(WIRE|CABLE|TIE|SLEEV|SHRINK|TUBING|TAPE|LABEL|SOLDER|GROMMET|BRAID|LACING|HEAT\s*SHRINK|MARKER)\b"  # fixed value: lines that need no part number
    bad_d = (d != "") & (d.rlike(r"\b(?:([A-Za-z])\1){2,}\b") | ~d.rlike("[A-Za-z]"))
    bad_p = ((p != "") & ~C.part_like(F.get(F.split(p, r"\s+"), F.lit(0)))) | ((p == "") & m.rlike("[A-Za-z]") & ~d.rlike(stuff))
    bad_m = (m != "") & (F.exists(F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1))), lambda t: C.part_like(t) & t.rlike(r"\d")) | ~m.rlike("[A-Za-z]"))
    bad_q = (q != "") & ~C.qty_like(q)
    names = [F.when(b, n) for b, n in ((bad_d, "description"), (bad_p, "part"), (bad_m, "maker"), (bad_q, "qty"))]
    return rows.withColumn("suspect", F.array_compact(F.array(*names)))


def better(field: str, other: str, own: str):
    """Whether another reading of a cell is clearly better than our own."""
    a, b = C.strip(F.col(other)), C.strip(F.col(own))
    first = lambda x: F.get(F.split(x, r"\s+"), F.lit(0))
    n = lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda t: t != ""))
    rule = {
        "part": C.part_like(first(a)) & ~C.part_like(first(b)),
        "qty": C.qty_like(a) & ~C.qty_like(b),
        "maker": a.rlike("[A-Za-z]") & (n(a) <= 3) & (~b.rlike("[A-Za-z]") | (n(b) > n(a))),
        "description": a.rlike("[A-Za-z]") & ~b.rlike("[A-Za-z]"),
    }[field]
    return (a != "") & (a != b) & rule


def totals(rows: DataFrame, by: list[str]) -> DataFrame:
    """-> ``(*by, lines, total, smt, th, fine)``: quantities in all, by mounting, and of fine-pitch packages; no quantity counts 1."""
    q = F.coalesce(C.quantity("qty"), F.lit(1.0))
    text = F.concat_ws(" ", "description", "part")
    fine = F.upper(text).rlike("QFN|QFP|BGA|DFN|WLCSP|0201")
    s = lambda c: F.coalesce(F.sum(F.when(c, q)), F.lit(0.0))
    return rows.groupBy(*by).agg(F.count("*").alias("lines"), F.coalesce(F.sum(q), F.lit(0.0)).alias("total"), s(C.mounting(text) == "SMT").alias("smt"), s(C.mounting(text) == "TH").alias("th"), s(fine).alias("fine"))
