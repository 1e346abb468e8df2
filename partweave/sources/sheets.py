"""Parts lists out of raw cells of many sheets: header, roles and rows found in two passes.

Raw cells are ``(*by, row, col, value)``, text as it stands in the sheet, so part numbers keep their writing; ``by``
tells sheets apart.  The first pass (``profile``) reads the first rows and a few samples and gives the header row and
roles of each sheet as rows; the second (``logical_rows``) joins cells with roles and turns each sheet row into one
logical row.  Sheets are never looped over, and a sheet of any length is spread over tasks by its rows.

Defined cases: null and empty cells count as missing; a sheet without a part-number column has a profile but no
logical rows; rows without any cell of a role are dropped; cells of one place twice give the greater text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partweave.functions import cells as C
from partweave.operators import schema as H
from partweave.operators import tables as T
from partweave.written import Written

ROLES = ("mpn", "qty", "refdes", "description", "comment", "manufacturer", "vendor")
# Words without meaning in a description, and parts of names of columns that may hold one.
NO_MEANING = ("", "nan", "n/a", "none")
DESCRIPTION_PARTS = ("desc", "note", "comment", "remark", "component", "part", "item", "material")
TOP = 30  # rows that may hold the header
FEW, SAMPLE = 3, 3  # values under which a description column must show a meaning; values looked at in others


def _filled(cells: DataFrame) -> DataFrame:
    return cells.where("value IS NOT NULL AND value <> ''")


def header_names(cells: DataFrame, by: list[str]) -> DataFrame:
    """-> ``(*by, header_row, col, name)``: the header row of each sheet and its names; empty names are missing.

    Written, as all that follows asks for it again: a few rows a sheet.
    """
    first = _filled(cells).where(f"row < {TOP}")
    at = T.header_row(first, by, "row", "value", TOP)
    names = first.join(at, by).where("row = header_row").groupBy(*by, "header_row", "col").agg(F.max("value").alias("name"))
    return Written(cells.sparkSession).table(names, "headers")


def _more_roles(headers: DataFrame, by: list[str]) -> DataFrame:
    """Makers, vendors and comments by name, the leftmost column of each."""
    n = F.lower("name")
    role = F.when(n.rlike("manufacturer|mfg|mfr") & ~n.contains("part"), "manufacturer").when(n.isin("vendor", "supplier", "source"), "vendor").when(F.col("name") == "Comment", "comment")
    named = headers.select(*by, role.alias("role"), "col").where("role IS NOT NULL")
    return named.groupBy(*by, "role").agg(F.min("col").alias("col"))


def profile(cells: DataFrame, by: list[str]) -> DataFrame:
    """-> ``(*by, header_row, role, col, name)``: each sheet's columns by role.

    A description column without values, or with fewer than three of which none means anything, is dropped.  A sheet
    whose header names none takes the leftmost column with a fitting name whose first three values mean something.
    """
    headers = header_names(cells, by)
    roles = H.roles(headers, by).unionByName(_more_roles(headers, by))
    told = roles.where("role = 'description'").select(*by, "col", F.lit(True).alias("told"))
    likely = F.lit(False)
    for part in DESCRIPTION_PARTS:
        likely = likely | F.lower("name").contains(part)
    others = headers.where(likely).select(*by, "col", F.lit(False).alias("told")).join(told, by, "left_anti")
    candidates = told.unionByName(others).join(headers.select(*by, "header_row").distinct(), by)

    values = _filled(cells).join(candidates, [*by, "col"]).where("row > header_row")
    place = F.row_number().over(Window.partitionBy(*by, "col").orderBy("row"))
    means = ~F.lower(C.strip("value")).isin(*NO_MEANING)
    first = values.withColumn("place", place).where(f"place <= {max(FEW, SAMPLE)}")  # cut in each task before the shuffle
    seen = first.groupBy(*by, "col", "told").agg(F.count("*").alias("n"), F.count_if(means).alias("meaning"))
    fit = seen.where(f"(told AND n >= {FEW}) OR meaning > 0").groupBy(*by).agg(F.min("col").alias("col"))
    out = roles.where("role <> 'description'").unionByName(fit.select(*by, F.lit("description").alias("role"), "col"))
    return Written(cells.sparkSession).table(out.join(headers, [*by, "col"]).select(*by, "header_row", "role", "col", "name"), "profile")


def chosen_profile(cells: DataFrame, mapping: DataFrame, by: list[str]) -> DataFrame:
    """The profile of roles a user chose: ``mapping(*by, role, name)`` against the names of the header found.

    Of columns with one name the leftmost counts.  ``mapping_problems`` tells what does not fit.
    """
    headers = header_names(cells, by).groupBy(*by, "header_row", "name").agg(F.min("col").alias("col"))
    return headers.join(mapping.select(*by, "role", "name"), [*by, "name"]).select(*by, "header_row", "role", "col", "name")


def mapping_problems(cells: DataFrame, mapping: DataFrame, by: list[str]) -> DataFrame:
    """-> ``(*by, role, name, problem, available)``: chosen names a sheet does not have, and sheets without a part number.

    ``available`` lists the sheet's names from left to right.
    """
    headers = header_names(cells, by)
    names = headers.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("col", "name"))).alias("n")).select(*by, F.transform("n", lambda x: x["name"]).alias("available"))
    chosen = names.join(mapping.select(*by, "role", "name"), by)
    absent = chosen.where(~F.array_contains("available", F.col("name"))).select(*by, "role", "name", F.lit("column not found").alias("problem"), "available")
    without = names.join(mapping.where("role = 'mpn'").select(*by), by, "left_anti")
    return absent.unionByName(without.select(*by, F.lit("mpn").alias("role"), F.lit(None).cast("string").alias("name"), F.lit("part-number column must be chosen").alias("problem"), "available"))


def logical_rows(cells: DataFrame, roles: DataFrame, by: list[str], sheet_lines: bool = False, unmapped: str | None = None) -> DataFrame:
    """-> ``(*by, line, <role>...)``: the rows below each header with the cells of its roles, missing ones null.

    Lines count from 2 at the first row below the header; ``sheet_lines`` counts from the top of the sheet instead.
    ``unmapped`` stands in cells of roles that a sheet does not have.
    """
    wide = [F.max(F.when(F.col("role") == r, F.col("value"))).alias(r) for r in ROLES]
    part = roles.where("role = 'mpn'").select(*by)
    placed = _filled(cells).join(roles.join(part, by, "left_semi").select(*by, "col", "role", "header_row"), [*by, "col"]).where("row > header_row")
    out = placed.groupBy(*by, "header_row", "row").agg(*wide)
    line = (F.col("row") + 1 if sheet_lines else F.col("row") - F.col("header_row") + 1).cast("long")
    out = out.withColumn("line", line)
    if unmapped is None:
        return out.select(*by, "line", *ROLES)
    known = roles.groupBy(*by).agg(F.collect_set("role").alias("known"))  # at most one of each role
    filled = [F.when(F.array_contains("known", r), F.col(r)).otherwise(unmapped).alias(r) for r in ROLES]
    return out.join(known, by).select(*by, "line", *filled)
