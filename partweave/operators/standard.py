"""Extracted tables in one standard list of columns.

Defined cases: null cells count as empty; rows of empty cells go before rows are numbered; a table without a
part-number column gives no rows and is told by ``without_parts``; rows with an empty part number go last, so they
keep their number; cells of one place twice give the greater text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partweave.functions import cells as C
from partweave.operators import schema as H
from partweave.operators import tables as T
from partweave.written import Written

#: kinds of columns in the order of the result, with what stands where a table has none (item numbers are counted)
DEFAULTS = {"item_number": None, "manufacturer": "", "mpn": None, "customer_pn": "", "vendor": "", "vendor_pn": "", "qty": "1", "uom": None, "refdes": "", "description": ""}


def _columns(headers: DataFrame, cells: DataFrame, by: list[str]) -> DataFrame:
    """-> ``(*by, kind, col)``; a table whose names and values tell no part numbers takes the column of that role."""
    picked = H.pick_columns(headers, cells, by).where(F.col("kind").isin(*DEFAULTS))
    role = H.roles(headers, by).where("role = 'mpn'").select(*by, F.lit("mpn").alias("kind"), "col")
    return picked.unionByName(role.join(picked.where("kind = 'mpn'").select(*by), by, "left_anti"))


def without_parts(headers: DataFrame, cells: DataFrame, by: list[str]) -> DataFrame:
    """-> ``(*by)``: tables in which no column holds part numbers."""
    return headers.select(*by).distinct().join(_columns(headers, cells, by).where("kind = 'mpn'").select(*by), by, "left_anti")


def standard_rows(headers: DataFrame, cells: DataFrame, by: list[str]) -> DataFrame:
    """-> ``(*by, row, item_number, ..., description, alternates)``: the rows of each table that have a part number.

    ``headers`` is ``(*by, col, name)``, ``cells`` ``(*by, row, col, value)`` below the header.  Cells are stripped.
    Missing quantities columns give ``1``, missing item numbers the number of the row; ``alternates`` are the further
    part numbers of the cell, parted by ``|``.
    """
    written = Written(cells.sparkSession)
    chosen = written.table(_columns(headers, cells, by), "chosen")  # a few rows a table
    full = cells.select(*by, F.col("row").cast("long").alias("row"), "col", C.strip("value").alias("value")).where("value <> ''")
    has = chosen.where("kind = 'mpn'").select(*by)
    wide = [F.max(F.when(F.col("kind") == k, F.col("value"))).alias(k) for k in DEFAULTS]
    rows = full.join(has, by, "left_semi").join(chosen, [*by, "col"], "left").groupBy(*by, "row").agg(*wide)
    rows = written.table(T.ranked(rows, [(F.col(b), True) for b in by] + [(F.col("row"), True)], "place"), "rows")
    first = rows.groupBy(*by).agg(F.min("place").alias("first"))
    known = chosen.groupBy(*by).agg(F.collect_set("kind").alias("known"))  # at most one of each kind
    number = (F.col("place") - F.col("first") + 1).cast("string")
    out = []
    for kind, default in DEFAULTS.items():
        else_ = number if kind == "item_number" else F.lit(default).cast("string")
        out.append(F.when(F.array_contains("known", kind), F.coalesce(kind, F.lit(""))).otherwise(else_).alias(kind))
    parts = C.alternates("mpn")
    more = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), "|")).otherwise("")
    return rows.where("mpn IS NOT NULL").join(first, by).join(known, by).select(*by, "row", *out, more.alias("alternates"))
