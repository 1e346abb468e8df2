"""A revision's rows in the shape of a template sheet, with what changed marked by a tint.

Templates and data are raw cells ``(*by, row, col, value)`` of many sheets; ``by`` tells which template takes which
data.  The result is raw cells with tints for a writer of workbooks: the template down to its header row, then the
rows of the data in their order, then rows that the new revision dropped.  Rows are numbered by ranges of the order,
so a sheet of any length is spread over tasks.

Defined cases: null and empty cells are missing; roles that a template does not have are left out; of several
differences of one part any set flag counts; rows without a part number have no tint; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partweave.functions import cells as C
from partweave.operators import tables as T
from partweave.written import Written

ROLES = ("mpn", "qty", "refdes", "description")
# Words of header cells, and those that weigh 3 and 2; a data sheet has fewer that weigh 2.
WORDS = ("mpn", "part", "qty", "quantity", "desc", "ref", "loc", "designator", "manufacturer", "mfg", "item")
HEAVY = ("mpn", "part number", "p/n")
MIDDLE = {"template": ("qty", "quantity", "desc", "ref", "designator"), "data": ("qty", "quantity")}
# Colours (alpha, red, green, blue) of changed cells and of added, renamed and removed rows.
TINTS = {"qty": "FFFEF3C7", "refdes": "FFE0E7FF", "description": "FFEDE9FE", "added": "FFDCFCE7", "mpn_changed": "FFCFFAFE", "removed": "FFFEE2E2"}
TOP, LONGEST, ENOUGH = 30, 60, 4  # rows that may hold the header, characters of a header cell, score that settles it


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def header_row(cells: DataFrame, by: list[str], side: str) -> DataFrame:
    """-> ``(*by, header_row)``: the first of the top rows that scores 4, else the best, else row 0."""
    text = C.strip(F.lower("value"))
    weight = F.when(_any(text, HEAVY), 3).when(_any(text, MIDDLE[side]), 2).otherwise(1)
    score = F.sum(F.when((F.length(text) <= LONGEST) & _any(text, WORDS), weight).otherwise(0))
    rows = cells.where(f"row < {TOP}").groupBy(*by, F.col("row").cast("long").alias("row")).agg(score.alias("score"))
    best = F.max(F.struct("score", (-F.col("row")).alias("up")))
    found = rows.groupBy(*by).agg(F.min(F.when(F.col("score") >= ENOUGH, F.col("row"))).alias("sure"), best.alias("best"))
    return found.select(*by, F.coalesce("sure", F.when(F.col("best.score") > 0, -F.col("best.up")), F.lit(0)).cast("long").alias("header_row"))


def _filled(cells: DataFrame) -> DataFrame:
    return cells.where("value IS NOT NULL AND value <> ''")


def template_columns(cells: DataFrame, mapping: DataFrame, by: list[str]) -> DataFrame:
    """-> ``(*by, header_row, role, col)``: a role's name as it stands in the header, else without regard to case.

    Of columns with one name the last counts; of names that differ in case only, the one that stands first.
    """
    header = _filled(cells).join(header_row(cells, by, "template"), by).where("row = header_row")
    names = header.groupBy(*by, "header_row", C.strip("value").alias("name")).agg(F.max("col").alias("col"), F.min("col").alias("first"))
    wanted = mapping.where("name <> ''").select(*by, "role", F.col("name").alias("wanted"))
    like = names.withColumn("folded", F.lower("name")).join(wanted.withColumn("folded", C.strip(F.lower("wanted"))), [*by, "folded"])
    best = F.min(F.struct((F.col("name") != F.col("wanted")).alias("other"), "first", "col"))
    return like.groupBy(*by, "header_row", "role").agg(best.alias("b")).select(*by, "header_row", "role", F.col("b.col").alias("col"))


def data_rows(cells: DataFrame, mapping: DataFrame, by: list[str]) -> DataFrame:
    """-> ``(*by, row, mpn, qty, refdes, description)``: rows below the header with a cell of any chosen column.

    Names count as they stand in the header, the leftmost of equal ones; columns a sheet lacks are null.
    """
    full = _filled(cells)
    at = header_row(cells, by, "data")
    names = full.join(at, by).where("row = header_row").groupBy(*by, "header_row", F.col("value").alias("name")).agg(F.min("col").alias("col"))
    columns = names.join(mapping.select(*by, "role", "name"), [*by, "name"]).select(*by, "header_row", "role", "col")
    placed = full.join(columns, [*by, "col"]).where("row > header_row")
    return placed.groupBy(*by, "row").agg(*[F.max(F.when(F.col("role") == r, F.col("value"))).alias(r) for r in ROLES])


def _tint(role: str) -> Column:
    told = lambda flag: F.coalesce(F.col(flag), F.lit(False))
    row = F.when(F.col("dropped"), TINTS["removed"]).when(told("added"), TINTS["added"]).when(told("mpn_changed"), TINTS["mpn_changed"])
    return row if role == "mpn" else row.when(told(role + "_flag"), TINTS[role])


def fill_template(template: DataFrame, names: DataFrame, data: DataFrame, data_names: DataFrame, by: list[str], changes: DataFrame | None = None) -> DataFrame:
    """-> ``(*by, row, col, value, tint)``: the cells of the filled template.

    ``names`` and ``data_names`` are ``(*by, role, name)``.  ``changes`` are differences by part in capitals, ``(*by,
    part, qty, refdes, description, mpn_changed, added, removed, source)``; ``source`` is a struct of the four fields
    of the old revision's row.  Rows that were dropped follow in the order of their parts, those without ``source`` not.
    """
    written = Written(template.sparkSession)
    columns = written.table(template_columns(template, names, by), "columns")  # a few rows a sheet
    rows = data_rows(data, data_names, by).withColumn("part", C.strip(F.upper("mpn")))
    if changes is None:
        flags = [F.lit(False).alias(x) for x in ("qty_flag", "refdes_flag", "description_flag", "mpn_changed", "added")]
        rows = rows.select(*by, F.lit(False).alias("dropped"), "row", "part", *ROLES, *flags)
    else:
        any_of = [F.max(F.coalesce(x, F.lit(False))).alias(f"{x}_flag" if x in ROLES else x) for x in ("qty", "refdes", "description", "mpn_changed", "added", "removed")]
        told = written.table(changes.withColumn("part", C.strip(F.upper("part"))).groupBy(*by, "part").agg(*any_of, F.max("source").alias("source")), "changes")
        flags = ["qty_flag", "refdes_flag", "description_flag", "mpn_changed", "added"]
        rows = rows.join(told, [*by, "part"], "left").select(*by, F.lit(False).alias("dropped"), F.col("row").cast("long").alias("row"), "part", *ROLES, *flags)
        gone = told.where("removed AND source IS NOT NULL").select(*by, F.lit(True).alias("dropped"), F.lit(0).cast("long").alias("row"), "part", *[F.nullif(F.col(f"source.{r}"), F.lit("")).alias(r) for r in ROLES], *flags)
        rows = rows.unionByName(gone)
    rows = rows.join(columns.select(*by).distinct(), by, "left_semi")
    order = [(F.col(b), True) for b in by] + [(F.col(x), True) for x in ("dropped", "row", "part")]
    rows = written.table(T.ranked(rows, order, "place"), "rows")
    first = rows.groupBy(*by).agg(F.min("place").alias("first"))  # one row a sheet
    cells = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("value"), _tint(r).alias("tint")) for r in ROLES]))
    filled = rows.join(first, by).select(*by, (F.col("place") - F.col("first") + 1).alias("n"), cells.alias("c")).select(*by, "n", "c.*").where("value IS NOT NULL OR tint IS NOT NULL")
    filled = filled.join(columns, [*by, "role"]).select(*by, (F.col("header_row") + F.col("n")).alias("row"), F.col("col").cast("int").alias("col"), "value", "tint")
    top = _filled(template).join(header_row(template, by, "template"), by).where("row <= header_row")
    return top.select(*by, F.col("row").cast("long").alias("row"), F.col("col").cast("int").alias("col"), "value", F.lit(None).cast("string").alias("tint")).unionByName(filled)


def change_table(rows: DataFrame) -> DataFrame:
    """The ``changes`` of a comparison, without ``by``: flags of ``diff.export_flags`` with the old revision's row of dropped parts."""
    from partweave.operators import diff as D

    flags = D.export_flags(rows)
    old = rows.where("status = 'removed'").select(F.upper(C.strip(D.shown_part("old"))).alias("part"), F.struct(*[F.col(f"old_{r}").alias(r) for r in ROLES]).alias("source"))
    return flags.join(old.groupBy("part").agg(F.max("source").alias("source")), "part", "left")
