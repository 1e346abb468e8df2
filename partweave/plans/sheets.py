"""Queries of whole sheets: header, roles and rows found in raw cells, and both comparisons, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from partweave.operators import diff as D
from partweave.operators import export as E
from partweave.operators import standard
from partweave.plans.catalogue import _t, query
from partweave.sources import sheets as S

#: four layouts of a sheet: header row, names, cells of a part
_LAYOUTS = (
    (3, ("Item #", "Manufacturer", "Mfg P/N", "Qty.", "Ref Des", "Description"), "array(cast(id AS string), 'Acme', mpn, qty, ref, p_name)"),
    (0, ("Component", "Part Number", "Quantity", "Location"), "array(p_name, mpn, qty, ref)"),
    (5, ("Qty", "MPN", "Description", "Ref"), "array(qty, mpn, NULL, ref)"),
    (1, ("Remarks", "Vendor", "Vendor Part No", "QTY:", "Designator", "Comment"), "array('n/a', 'Depot', mpn, qty, ref, if(mpn IS NULL, concat('note ', id), ''))"),
)


def raw_cells(spark, sf_dir):
    """``part`` as raw cells of two sheets a brand, an old and a new one, with title rows and headers of four layouts."""
    part = _t(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_name", "p_brand", "p_size", "cast(substr(p_brand, 7) AS int) % 4 AS layout")
    code = "CASE WHEN layout = 3 AND id % 10 = 1 THEN NULL WHEN side = 'new' AND id % 5 = 0 THEN concat(' ', lower(p_brand), '-', id) ELSE concat(p_brand, '-', id) END AS mpn"
    qty = "CASE WHEN side = 'new' AND id % 4 = 0 THEN concat(p_size, ' pcs') WHEN side = 'new' AND id % 4 = 1 THEN cast(p_size + 1 AS string) ELSE cast(p_size AS string) END AS qty"
    rows = part.withColumn("side", F.explode(F.array(F.lit("old"), F.lit("new")))).where("NOT (side = 'new' AND id % 10 = 3) AND NOT (side = 'old' AND id % 10 = 7)")
    rows = rows.selectExpr("*", "concat(side, ':', p_brand) AS sheet", code, qty, "if(side = 'new' AND id % 6 = 0, concat('r', id), concat('R', id)) AS ref")
    sheets = part.select("p_brand", "layout").distinct().selectExpr("inline(array(struct(concat('old:', p_brand) AS sheet, layout), struct(concat('new:', p_brand) AS sheet, layout)))")
    out = None
    for k, (header, names, cells) in enumerate(_LAYOUTS):
        data = rows.where(f"layout = {k}").selectExpr("sheet", f"{header} + 1 + id AS row", f"posexplode({cells}) AS (col, value)")
        top = sheets.where(f"layout = {k}").select("sheet", F.posexplode(F.array(*map(F.lit, names))).alias("col", "value")).selectExpr("sheet", f"cast({header} AS bigint) AS row", "col", "value")
        title = sheets.where(f"layout = {k} AND {header} > 0").selectExpr("sheet", "cast(0 AS bigint) AS row", "0 AS col", "concat('Bill of materials ', sheet) AS value")
        out = data.union(top).union(title) if out is None else out.union(data).union(top).union(title)
    return out


def _sides(rows):
    return [rows.where(f"startswith(sheet, '{s}:')") for s in ("old", "new")]


_P = "p AS (SELECT p_partkey AS id, p_name, p_brand, p_size, CAST(substr(p_brand, 7) AS INT) % 4 AS l FROM part)"
_SHEETS = "s AS (SELECT DISTINCT unnest(['old:' || p_brand, 'new:' || p_brand]) AS sheet, l FROM p)"


@query(f"""WITH {_P}, {_SHEETS}, r AS (SELECT * FROM (VALUES (0, 3, 'mpn', 2, 'Mfg P/N'), (0, 3, 'qty', 3, 'Qty.'), (0, 3, 'refdes', 4, 'Ref Des'), (0, 3, 'description', 5, 'Description'), (0, 3, 'manufacturer', 1, 'Manufacturer'),
  (1, 0, 'mpn', 1, 'Part Number'), (1, 0, 'qty', 2, 'Quantity'), (1, 0, 'refdes', 3, 'Location'), (1, 0, 'description', 0, 'Component'), (2, 5, 'mpn', 1, 'MPN'), (2, 5, 'qty', 0, 'Qty'), (2, 5, 'refdes', 3, 'Ref'),
  (3, 1, 'mpn', 2, 'Vendor Part No'), (3, 1, 'qty', 3, 'QTY:'), (3, 1, 'refdes', 4, 'Designator'), (3, 1, 'description', 0, 'Remarks'), (3, 1, 'vendor', 1, 'Vendor'), (3, 1, 'comment', 5, 'Comment')) AS v(l, header_row, role, col, name))
SELECT sheet, CAST(header_row AS BIGINT) AS header_row, role, col, name FROM s JOIN r USING (l)""")
def sheet_profile(spark, sf_dir):
    return S.profile(raw_cells(spark, sf_dir), ["sheet"])


_KEY = "upper(p_brand) || '-' || id"


@query(f"""WITH {_P} SELECT CASE WHEN l = 3 AND id % 10 = 1 THEN 'COMMENT_NOTE ' || id ELSE {_KEY} END AS k, CASE WHEN id % 10 = 3 THEN 'removed' WHEN id % 10 = 7 THEN 'new' WHEN id % 4 = 1 THEN 'modified' ELSE 'unchanged' END AS status,
  CASE WHEN id % 10 <> 7 THEN id + 2 END AS old_line, CASE WHEN id % 10 <> 3 THEN id + 2 END AS new_line, CASE WHEN id % 10 <> 7 THEN CAST(p_size AS VARCHAR) END AS old_qty,
  CASE WHEN id % 10 <> 7 AND l <> 2 THEN CASE l WHEN 3 THEN 'n/a' ELSE p_name END END AS old_description, CASE WHEN id % 10 <> 3 THEN CASE l WHEN 0 THEN 'Acme' END END AS new_manufacturer, CASE WHEN id % 10 <> 3 AND l = 3 THEN 'Depot' END AS new_vendor FROM p""")
def sheet_scan_diff(spark, sf_dir):
    """Raw cells of fifty sheets through header, roles and rows to the comparison of both revisions."""
    cells = raw_cells(spark, sf_dir)
    rows = D.diff(*_sides(S.logical_rows(cells, S.profile(cells, ["sheet"]), ["sheet"])))
    return rows.select("k", "status", "old_line", "new_line", "old_qty", "old_description", "new_manufacturer", "new_vendor")


def _names(spark):
    """The names of the columns of each layout by role."""
    names = [("mpn", "qty", "refdes", "description"), ("Mfg P/N", "Qty.", "Ref Des", "Description"), ("Part Number", "Quantity", "Location", "Component"), ("MPN", "Qty", "Ref", "Description"), ("Vendor Part No", "QTY:", "Designator", "Remarks")]
    rows = [(k, role, name) for k in range(4) for role, name in zip(names[0], names[k + 1], strict=True)]
    return spark.createDataFrame(rows, "layout int, role string, name string")


def _chosen(spark, sf_dir):
    """What a user chose for each sheet; designators of the second layout are chosen on the old side only."""
    sheets = _t(spark, sf_dir, "part").select("p_brand").distinct().selectExpr("explode(array(concat('old:', p_brand), concat('new:', p_brand))) AS sheet", "cast(substr(p_brand, 7) AS int) % 4 AS layout")
    return sheets.join(_names(spark), "layout").where("NOT (layout = 1 AND role = 'refdes' AND startswith(sheet, 'new:'))").select("sheet", "layout", "role", "name")


def _manual(spark, sf_dir):
    cells = raw_cells(spark, sf_dir)
    return D.manual_diff(*_sides(S.logical_rows(cells, S.chosen_profile(cells, _chosen(spark, sf_dir), ["sheet"]), ["sheet"], sheet_lines=True, unmapped="N/A")))


_MANUAL = f"""{_P}, m AS (SELECT {_KEY} AS k, id, l, [3, 0, 5, 1][l + 1] AS h, p_size, CASE WHEN id % 10 = 3 THEN 'removed' WHEN id % 10 = 7 THEN 'new' WHEN id % 4 IN (0, 1) OR l = 1 THEN 'modified' ELSE 'unchanged' END AS status,
  CASE WHEN l = 1 THEN 'N/A' WHEN id % 6 = 0 THEN 'r' || id ELSE 'R' || id END AS ref FROM p WHERE NOT (l = 3 AND id % 10 = 1))"""


@query(f"""WITH {_MANUAL} SELECT k, status, CASE WHEN id % 10 <> 7 THEN h + 2 + id END AS old_line, CASE WHEN id % 10 <> 3 THEN h + 2 + id END AS new_line, CASE WHEN id % 10 <> 3 THEN ref END AS new_refdes,
  id % 10 NOT IN (3, 7) AND id % 4 IN (0, 1) AS qty_changed, id % 10 NOT IN (3, 7) AND l = 1 AS refdes_changed FROM m""")
def manual_diff_rows(spark, sf_dir):
    """The comparison by columns that a user chose for each sheet: plain quantities, lines of the sheet."""
    return _manual(spark, sf_dir).select("k", "status", "old_line", "new_line", "new_refdes", "qty_changed", "refdes_changed")


@query(f"""WITH {_MANUAL} SELECT count(*) FILTER (status <> 'new') AS total_parts_file1, count(*) FILTER (status <> 'removed') AS total_parts_file2, count(*) FILTER (status = 'new') AS new_parts_count,
  count(*) FILTER (status = 'removed') AS removed_parts_count, count(*) FILTER (status = 'modified') AS modified_parts_count, count(*) FILTER (status = 'unchanged') AS unchanged_parts_count,
  0::BIGINT AS unrecognized_parts_count, 0::BIGINT AS mpn_renamed_count, 0.88::DOUBLE AS fuzzy_threshold FROM m""")
def manual_summary(spark, sf_dir):
    return D.manual_figures(_manual(spark, sf_dir))


@query(f"""WITH {_P}, {_SHEETS} SELECT sheet, CASE WHEN l = 2 THEN 'mpn' ELSE 'qty' END AS role, CASE WHEN l = 1 THEN 'Pieces' END AS name, CASE WHEN l = 2 THEN 'part-number column must be chosen' ELSE 'column not found' END AS problem,
  CASE WHEN l = 1 THEN 'Component|Part Number|Quantity|Location' ELSE 'Qty|MPN|Description|Ref' END AS available FROM s WHERE l IN (1, 2)""")
def mapping_problems(spark, sf_dir):
    """Chosen columns that a sheet does not have, and sheets without a part-number column."""
    wrong = _chosen(spark, sf_dir).withColumn("name", F.expr("if(layout = 1 AND role = 'qty', 'Pieces', name)")).where("NOT (layout = 2 AND role = 'mpn')")
    return S.mapping_problems(raw_cells(spark, sf_dir), wrong, ["sheet"]).withColumn("available", F.array_join("available", "|"))


_SIDES = f"""{_P}, sides AS (SELECT unnest(['old', 'new']) AS side), x AS (SELECT side, p_brand, id, l, [3, 0, 5, 1][l + 1] AS h, p_name, CASE WHEN l = 3 AND id % 10 = 1 THEN NULL WHEN side = 'new' AND id % 5 = 0 THEN ' ' || lower(p_brand) || '-' || id ELSE p_brand || '-' || id END AS mpn,
  CASE WHEN side = 'new' AND id % 4 = 0 THEN p_size || ' pcs' WHEN side = 'new' AND id % 4 = 1 THEN CAST(p_size + 1 AS VARCHAR) ELSE CAST(p_size AS VARCHAR) END AS qty, CASE WHEN side = 'new' AND id % 6 = 0 THEN 'r' ELSE 'R' END || id AS refdes,
  CASE WHEN l < 2 THEN p_name WHEN l = 3 THEN 'n/a' END AS description FROM p, sides WHERE NOT (side = 'new' AND id % 10 = 3) AND NOT (side = 'old' AND id % 10 = 7))"""


@query(f"""WITH {_SIDES}, y AS (SELECT *, row_number() OVER (PARTITION BY side, p_brand ORDER BY id) AS n, bool_or(l = 3 AND id % 10 = 1) OVER (PARTITION BY side, p_brand) AS noted FROM x)
SELECT side || ':' || p_brand AS sheet, h + 1 + id AS row, CAST(CASE WHEN l = 0 THEN id ELSE n END AS VARCHAR) AS item_number, CASE WHEN l = 0 THEN 'Acme' ELSE '' END AS manufacturer, trim(mpn) AS mpn, '' AS customer_pn,
  CASE WHEN l = 3 THEN 'Depot' ELSE '' END AS vendor, CASE WHEN l = 3 THEN trim(mpn) ELSE '' END AS vendor_pn, qty, CAST(NULL AS VARCHAR) AS uom, refdes, CASE WHEN l = 3 AND noted THEN '' ELSE coalesce(description, '') END AS description, '' AS alternates FROM y WHERE mpn IS NOT NULL""")
def standard_lists(spark, sf_dir):
    """Fifty sheets of four layouts in the standard columns; notes stand for descriptions where a sheet has some."""
    cells = raw_cells(spark, sf_dir)
    headers = S.header_names(cells, ["sheet"])
    below = cells.join(headers.select("sheet", "header_row").distinct(), "sheet").where("row > header_row").drop("header_row")
    return standard.standard_rows(headers, below, ["sheet"])


_TEMPLATE_NAMES = ", ".join(f"({k}, {header}, {col}, '{name}')" for k, (header, names, _) in enumerate(_LAYOUTS) for col, name in enumerate(names))


@query(f"""WITH {_SIDES}, names AS (SELECT * FROM (VALUES {_TEMPLATE_NAMES}) AS v(l, h, col, name)), brands AS (SELECT DISTINCT p_brand, l FROM p),
places AS (SELECT * FROM (VALUES (0, 'mpn', 2), (0, 'qty', 3), (0, 'refdes', 4), (0, 'description', 5), (1, 'mpn', 1), (1, 'qty', 2), (1, 'refdes', 3), (1, 'description', 0),
  (2, 'mpn', 1), (2, 'qty', 0), (2, 'refdes', 3), (2, 'description', 2), (3, 'mpn', 2), (3, 'qty', 3), (3, 'refdes', 4), (3, 'description', 0)) AS v(l, role, col)),
w AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY side = 'old', CASE WHEN side = 'new' THEN id END, upper(p_brand) || '-' || id) AS n FROM x WHERE side = 'new' OR id % 10 = 3),
c AS (SELECT p_brand, h + n AS row, places.col, CASE role WHEN 'mpn' THEN mpn WHEN 'qty' THEN qty WHEN 'refdes' THEN refdes ELSE description END AS value,
  CASE WHEN side = 'old' THEN 'FFFEE2E2' WHEN id % 10 = 7 THEN 'FFDCFCE7' WHEN role = 'qty' AND id % 4 = 1 AND mpn IS NOT NULL THEN 'FFFEF3C7' END AS tint FROM w JOIN places USING (l))
SELECT p_brand AS brand, CAST(h AS BIGINT) AS row, col, name AS value, CAST(NULL AS VARCHAR) AS tint FROM brands JOIN names USING (l)
UNION ALL SELECT p_brand, 0, 0, 'Bill of materials old:' || p_brand, NULL FROM brands WHERE l <> 1
UNION ALL SELECT * FROM c WHERE value IS NOT NULL OR tint IS NOT NULL""")
def template_export(spark, sf_dir):
    """Each brand's new sheet in the template of its old one, names chosen in capitals, differences as tints, dropped parts at the end."""
    cells = raw_cells(spark, sf_dir)
    changes = E.change_table(D.diff(*_sides(S.logical_rows(cells, S.profile(cells, ["sheet"]), ["sheet"]))))
    changes = changes.where("part LIKE 'BRAND#%'").withColumn("brand", F.expr("initcap(substring_index(part, '-', 1))"))
    names = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("brand")).distinct().withColumn("layout", F.expr("cast(substr(brand, 7) AS int) % 4"))
    names = names.join(_names(spark), "layout").select("brand", "role", "name")
    old, new = (side.withColumn("brand", F.expr("substr(sheet, 5)")).select("brand", "row", "col", "value") for side in _sides(cells))
    return E.fill_template(old, names.withColumn("name", F.upper("name")), new, names, ["brand"], changes)
