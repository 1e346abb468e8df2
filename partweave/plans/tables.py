"""Queries of the cell cleaners, column schemas, positioned words, stores and state over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from partweave.functions import cells as C
from partweave.operators import quote as Q
from partweave.operators import schema as H
from partweave.operators import words as W
from partweave.plans.catalogue import _t, query
from partweave.sources import records as R
from partweave.streaming import cache as S

_TRIM = "regexp_replace(regexp_replace(printf('%.10f', {}), '0+$', ''), '\\.$', '')"


@query(f"""SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN CAST(p_size * 1000 AS VARCHAR) WHEN 1 THEN {_TRIM.format('p_size * 1e-6')} WHEN 2 THEN p_size || '%' WHEN 3 THEN CAST(p_size AS VARCHAR)
  WHEN 4 THEN CAST(p_size AS VARCHAR) WHEN 5 THEN CAST(p_size AS VARCHAR) WHEN 6 THEN p_size || 'MA' WHEN 7 THEN '' ELSE p_size || 'K' END AS value FROM part""")
def norm_engineering_value(spark, sf_dir):
    raw = F.expr("concat(CASE WHEN p_partkey % 9 = 7 THEN '' ELSE cast(p_size AS string) END, element_at(array('k', 'µF', ' %', ' ohm', ' ea', 'R', 'mA', ' n/a', 'K'), cast(p_partkey % 9 AS int) + 1))")
    return _t(spark, sf_dir, "part").select("p_partkey", C.engineering_value(raw).alias("value"))


_ALT = "upper(p_brand) || '-' || p_partkey"


@query(f"""SELECT p_partkey, i AS place, CASE WHEN p_partkey % 6 = 5 THEN {_ALT} || '/X' || p_size WHEN i = 1 THEN {_ALT} ELSE 'X' || p_size || 'Y' END AS mpn
  FROM (SELECT *, unnest(CASE WHEN p_partkey % 6 = 5 THEN [1] ELSE [1, 2] END) AS i FROM part)""")
def alternate_mpns_explode(spark, sf_dir):
    raw = F.expr("concat(upper(p_brand), '-', p_partkey, element_at(array(' or ', ' ALT ', ' ; ', ' | ', ' / ', '/'), cast(p_partkey % 6 AS int) + 1), 'X', p_size, CASE WHEN p_partkey % 6 = 5 THEN '' ELSE 'Y' END)")
    return _t(spark, sf_dir, "part").select("p_partkey", F.posexplode(C.alternates(raw)).alias("place", "mpn")).withColumn("place", F.col("place") + 1)


def _tokens(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", r"[ \t\n\r\f\x0b]+")).alias("t")).where("t <> ''")


_TOK = "t AS (SELECT doc_id, t FROM (SELECT doc_id, unnest(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+')) AS t FROM documents) WHERE t <> '')"


@query(f"""WITH {_TOK}, p AS (SELECT *, regexp_matches(t, '^[A-Za-z0-9][A-Za-z0-9\\-_/.+ ]{{2,49}}$') AS part, length(regexp_replace(t, '[^0-9]', '', 'g')) AS digits, string_split(replace(replace(t, ' ', ''), ',', ' '), ' ') AS s FROM t)
SELECT doc_id, count(*) FILTER (part) AS parts, count(*) FILTER (length(t) <= 10 AND regexp_matches(t, '^[0-9]+([.,][0-9]+)?[KkMmuUnNpP]?$')) AS quantities,
  count(*) FILTER (part AND (regexp_matches(t, '[A-Za-z]') OR digits >= 5 OR regexp_matches(t, '[0-9][-/][0-9]'))) AS real_parts,
  count(*) FILTER (length(t) BETWEEN 2 AND 200 AND regexp_matches(list_filter(s, lambda x: x <> '')[1], '^[A-Za-z]{{1,4}}[0-9]+([\\-,/ ]+[A-Za-z]{{1,4}}?[0-9]+)*$')) AS designators,
  count(*) FILTER (regexp_matches(rtrim(t, ',.;'), '^[A-Za-z0-9][A-Za-z0-9\\-/.]{{3,}}$') AND digits > 0) AS callouts FROM p GROUP BY 1""")
def token_shapes(spark, sf_dir):
    n = lambda f: F.count_if(f("t"))
    return _tokens(spark, sf_dir).groupBy("doc_id").agg(n(C.part_like).alias("parts"), n(C.qty_like).alias("quantities"), n(C.real_part).alias("real_parts"), n(C.refdes_like).alias("designators"), n(C.callout_part).alias("callouts"))


_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents)"


def _lines(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("x"))


_WORDS = {"n": C.NOT_PLACED, "th": C.THROUGH_HOLE, "smt": C.SURFACE}


@query(f"WITH {_LINES}, u AS (SELECT doc_id, upper(x) AS x FROM l) SELECT doc_id, {', '.join('count(*) FILTER (' + ('NOT ' if k == 'none' else '') + c + f') AS {k}' for k, c in {'th': 'NOT n AND th', 'smt': 'NOT n AND NOT th AND smt'}.items())} FROM (SELECT doc_id, {', '.join(chr(40) + ' OR '.join(f'contains(x, {chr(39)}{w}{chr(39)})' for w in ws) + f') AS {k}' for k, ws in _WORDS.items())} FROM u) GROUP BY 1")
def smt_th_infer(spark, sf_dir):
    return _lines(spark, sf_dir).groupBy("doc_id").agg(*[F.count_if(C.mounting("x") == k.upper()).alias(k) for k in ("th", "smt")])


_CALLOUT = "x || CASE doc_id % 4 WHEN 0 THEN ' [ 7.00\"] (18 AWG) RRJJ' WHEN 1 THEN ' 4 12 7' WHEN 2 THEN ' ;-' ELSE '' END"
_CELL = """trim(array_to_string(list_filter(string_split_regex(regexp_replace(y, '(?i)\\[[^\\]]*\\]|\\(\\s*\\d+\\s*AWG\\s*\\)|[\\[\\]]', ' ', 'g'), '[\\s]+'),
  lambda t: t <> '' AND NOT (length(t) >= 4 AND length(t) % 2 = 0 AND regexp_matches(t, '^[A-Za-z]+$') AND len(list_filter(range(1, length(t), 2), lambda i: substr(t, i, 1) <> substr(t, i + 1, 1))) = 0)), ' '), ' ,;-')"""


@query(f"""WITH {_LINES}, y AS (SELECT doc_id, {_CALLOUT} AS y FROM l), c AS (SELECT doc_id, CASE WHEN lower(trim(y)) IN ('', 'nan', 'none') THEN '' ELSE {_CELL} END AS c FROM y)
SELECT doc_id, count(*) AS n, count(*) FILTER (c = '') AS blank, CAST(sum(length(c)) AS BIGINT) AS chars, CAST(sum(length(regexp_replace(c, '((?:^|\\s)\\d{{1,3}})(?:\\s+\\d{{1,3}})+$', '\\1'))) AS BIGINT) AS description_chars FROM c GROUP BY 1""")
def clean_cells(spark, sf_dir):
    y = F.expr("concat(x, CASE doc_id % 4 WHEN 0 THEN ' [ 7.00\"] (18 AWG) RRJJ' WHEN 1 THEN ' 4 12 7' WHEN 2 THEN ' ;-' ELSE '' END)")
    c = _lines(spark, sf_dir).select("doc_id", C.clean_cell(y).alias("c"), C.clean_description(y).alias("d"))
    return c.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("c") == "").alias("blank"), F.sum(F.length("c")).alias("chars"), F.sum(F.length("d")).alias("description_chars"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN p_size || '.5' WHEN 2 THEN p_size || '.00"' WHEN 3 THEN CAST(p_size AS VARCHAR) ELSE '' END AS qty, upper(p_brand) AS maker,
  'BOLT, ' || p_name AS description, CASE p_partkey % 5 WHEN 4 THEN 'XY' || p_partkey ELSE 'P-' || p_partkey END AS part FROM part""")
def clean_fields(spark, sf_dir):
    qty = F.expr("CASE p_partkey % 5 WHEN 0 THEN concat(p_size, '.00') WHEN 1 THEN concat(p_size, '.50 9 14') WHEN 2 THEN concat(p_size, '.00\"') WHEN 3 THEN concat('0', p_size, '.0') ELSE 'a b' END")
    maker = F.expr("concat('1 4 7.00\" ', upper(p_brand), ' 7')")
    words = C.split_bled_words(F.expr("concat('P-', p_partkey, ' BOLT,')"), F.col("p_name"))
    glued = C.split_glued_maker(F.expr("concat('MAKER XY', p_partkey)"), F.lit(""))
    part = F.when(F.col("p_partkey") % 5 == 4, glued["part"]).otherwise(C.clean_part(F.concat(words["part"], F.lit(" 2 3 R 16.0 ["))))
    return _t(spark, sf_dir, "part").select("p_partkey", C.clean_qty(qty).alias("qty"), C.clean_maker(maker).alias("maker"), words["description"].alias("description"), part.alias("part"))


@query("""SELECT p_brand AS doc, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS line, 'I-' || p_partkey AS item, CASE WHEN p_partkey % 3 = 0 THEN 'part ' || p_name ELSE p_name END AS description, 'ACME' AS maker,
  'XY' || p_partkey AS part, CASE WHEN p_partkey % 3 = 0 THEN '12' ELSE CAST(p_size AS VARCHAR) END AS qty FROM part WHERE p_partkey % 11 <> 0""")
def quote_rows(spark, sf_dir):
    """Rows of a source table cleaned: noise rows go, quantities come back from descriptions, glued makers are split."""
    rows = _t(spark, sf_dir, "part").selectExpr(
        "p_brand AS doc", "p_partkey AS row", "CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 3 = 0 THEN concat('I-', p_partkey, ' part') ELSE concat(' I-', p_partkey) END AS item",
        "CASE WHEN p_partkey % 11 = 0 THEN 'RRJJ 44' WHEN p_partkey % 3 = 0 THEN concat(p_name, ' 12 4 5') ELSE concat(p_name, ' [ 9]') END AS description", "CASE WHEN p_partkey % 2 = 0 THEN concat('ACME XY', p_partkey) ELSE 'ACME' END AS maker",
        "CASE WHEN p_partkey % 2 = 0 THEN '' ELSE concat('XY', p_partkey, ' 2') END AS part", "CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat(p_size, '.0') END AS qty",
    )
    return Q.clean_rows(rows, ["doc"])


@query("SELECT 'T' || (l_suppkey % 7) AS doc, row_number() OVER (PARTITION BY l_suppkey % 7 ORDER BY min(r), l_partkey) AS line, 'I1' AS item, 'd' AS description, 'M' AS maker, 'P' || l_partkey AS part, CAST(count(*) AS VARCHAR) AS qty FROM (SELECT *, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS r FROM lineitem) GROUP BY l_suppkey % 7, l_partkey")
def merge_placement_tables(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").selectExpr("concat('T', l_suppkey % 7) AS doc", "(l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS row", "'I1' AS item", "'d' AS description", "'M' AS maker", "concat('P', l_partkey) AS part", "'' AS qty")
    return Q.number_lines(Q.merge_placements(rows, ["doc"]), ["doc"])


_HEADS = (
    "MPN", "Part Number", "Mfg P/N", "Manufacturer", "Qty.", "Quantity per", "Ref Des", "Designator", "Description:", "Item #", "Line No", "UOM", "Vendor Part #", "Supplier P/N", "Customer PN", "KJR P/N",
    "Distributor", "A header that is much longer than any header of a column would ever be, so it has no kind", "",
)


@query("WITH h AS (SELECT unnest(" + str(list(_HEADS)) + ") AS name), p AS (SELECT unnest(range(1, " + str(len(H.FIRST_PARTS) + 1) + ")) AS k, unnest(" + str([a for a, _ in H.FIRST_PARTS]) + ") AS part, unnest(" + str([b for _, b in H.FIRST_PARTS]) + """) AS kind)
SELECT name, min_by(kind, k) AS kind FROM h LEFT JOIN p ON length(name) <= 60 AND contains(lower(name), part) GROUP BY 1""")
def classify_columns(spark, sf_dir):
    h = _t(spark, sf_dir, "region").limit(1).select(F.explode(F.array(*map(F.lit, _HEADS))).alias("name"))
    return h.select("name", H.kind("name").alias("kind"))


def _part_cells(spark, sf_dir):
    """``part`` as cells, a table per brand."""
    names = ("p_partkey", "p_name", "p_type", "p_size")
    part = _t(spark, sf_dir, "part")
    cells = part.select(F.col("p_brand").alias("doc"), F.col("p_partkey").alias("row"), F.posexplode(F.array(*[F.col(c).cast("string") for c in names])).alias("col", "value"))
    heads = part.select(F.col("p_brand").alias("doc")).distinct().select("doc", F.posexplode(F.array(*map(F.lit, ("Item No", "Component", "P/N", "Pcs")))).alias("col", "name"))
    return heads, cells


_CELLSQL = "c AS (SELECT p_brand AS doc, p_partkey AS row, unnest([0, 1, 2, 3]) AS col, unnest([CAST(p_partkey AS VARCHAR), p_name, p_type, CAST(p_size AS VARCHAR)]) AS value FROM part)"


@query(f"""WITH {_CELLSQL} SELECT doc, col, count(*) AS n, round(avg(CAST(regexp_matches(value, '^[A-Za-z0-9][A-Za-z0-9\\-_/.+ ]{{2,49}}$') AS INT)), 6) AS mpn, round(avg(CAST(length(value) <= 10 AND regexp_matches(value, '^[0-9]+$') AS INT)), 6) AS qty,
  round(avg(CAST(length(value) >= 6 AND contains(value, ' ') AS INT)), 6) AS description, round(avg(CAST(regexp_matches(value, '^[0-9]+$') AS INT)), 6) AS item_number
  FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc, col ORDER BY row) <= 50) GROUP BY 1, 2""")
def column_content_scores(spark, sf_dir):
    s = H.content_scores(_part_cells(spark, sf_dir)[1], ["doc"])
    return s.select("doc", "col", "n", *[F.round(k, 6).alias(k) for k in ("mpn", "qty", "description", "item_number")])


@query("SELECT DISTINCT p_brand AS doc, unnest(['item_number', 'mpn']) AS kind, unnest([0, 2]) AS col FROM part")
def pick_columns(spark, sf_dir):
    return H.pick_columns(*_part_cells(spark, sf_dir), ["doc"]).where("kind IN ('mpn', 'item_number')")


@query(f"""WITH {_CELLSQL}, s AS (SELECT doc, count(*) AS n, count(*) FILTER (CAST(value AS INT) BETWEEN 1 AND 99) AS small FROM c WHERE col = 3 GROUP BY 1) SELECT doc, 3 AS col FROM s WHERE n >= 2 AND small >= 0.8 * n""")
def recover_qty_column(spark, sf_dir):
    heads, cells = _part_cells(spark, sf_dir)
    dense = cells.withColumn("row", F.dense_rank().over(__import__("pyspark").sql.Window.partitionBy("doc").orderBy("row")))
    return H.recover_qty(heads, dense, ["doc"], heads.where("col < 3").select("doc", "col"))


@query("SELECT p_brand AS doc, i - 1 AS col, CASE i WHEN 1 THEN 'Column 1' WHEN 2 THEN 'Qty' WHEN 3 THEN 'Qty (2)' ELSE p_brand END AS unique_name FROM (SELECT DISTINCT p_brand, unnest([1, 2, 3, 4]) AS i FROM part)")
def unique_column_names(spark, sf_dir):
    heads = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("doc")).distinct().select("doc", F.posexplode(F.array(F.lit(" "), F.lit("Qty"), F.lit("Qty "), F.col("doc"))).alias("col", "name"))
    return H.unique_names(heads, ["doc"]).select("doc", "col", "unique_name")


@query("""SELECT p_brand AS doc, row_number() OVER (PARTITION BY p_brand ORDER BY c, p_partkey) AS item, CASE c WHEN 1 THEN 'LED' ELSE 'R' END || '-' || p_partkey AS part, CASE c WHEN 1 THEN 'Led, ' || p_type ELSE 'Resistor' END AS description, '1' AS qty, CASE c WHEN 1 THEN 'Acme' ELSE 'Digi' END AS maker
  FROM (SELECT *, unnest([1, 2]) AS c FROM part) QUALIFY count(*) OVER (PARTITION BY p_brand) >= 2""")
def matrix_explode(spark, sf_dir):
    part = _t(spark, sf_dir, "part").withColumnRenamed("p_brand", "doc")
    heads = part.select("doc").distinct().select("doc", F.posexplode(F.array(*map(F.lit, ("Assembly", "Acme Part # for LED", "LED colour", "Digi # for Resistor")))).alias("col", "name"))
    cells = part.select("doc", F.col("p_partkey").alias("row"), F.posexplode(F.expr("array('a', concat('LED-', p_partkey), p_type, concat('R-', p_partkey))")).alias("col", "value"))
    return H.explode_matrix(heads, cells, ["doc"]).withColumn("item", F.col("item").cast("long"))


DEALT = 8 << 20  # bytes of documents a task, which become some twenty times as much in words


def by_document(spark, sf_dir):
    """The documents dealt by their ids: what is drawn from one stays in its task, so words and lines are not shuffled again.

    The tasks grow with the documents' files, whose lengths are read without their contents, so a task's share does not.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{sf_dir}/documents.parquet")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(files.agg(F.sum("length")).first()[0] or 0) // DEALT))
    return _t(spark, sf_dir, "documents").select("doc_id", "text").repartition(n, "doc_id")


def _page_words(spark, sf_dir):
    """The words of documents on pages: ten a line, each 60 wide, lines 12 apart."""
    w = by_document(spark, sf_dir).select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", r"[ \t\n\r\f\x0b]+")).alias("i", "text")).where("text <> ''")
    return w.selectExpr("page", "text", "double((i % 10) * 60 + i % 3) AS x0", "double((i % 10) * 60 + i % 3 + least(length(text), 9) * 6) AS x1", "double(floor(i / 10) * 12 + i % 2) AS top", "double(floor(i / 10) * 12 + 8) AS bottom")


_PW = """w AS (SELECT page, i, text, CAST((i % 10) * 60 + i % 3 AS DOUBLE) AS x0, CAST((i % 10) * 60 + i % 3 + least(length(text), 9) * 6 AS DOUBLE) AS x1, CAST((i // 10) * 12 + i % 2 AS DOUBLE) AS top
  FROM (SELECT doc_id AS page, unnest(range(len(s))) AS i, unnest(s) AS text FROM (SELECT doc_id, string_split_regex(text, '[ \\t\\n\\r\\f\\v]+') AS s FROM documents)) WHERE text <> '')"""


@query(f"WITH {_PW} SELECT page, CAST(round_even(top / 8, 0) AS BIGINT) AS line, string_agg(text, ' ' ORDER BY x0, text) AS text FROM w GROUP BY 1, 2")
def words_to_lines(spark, sf_dir):
    return W.lines(_page_words(spark, sf_dir), ["page"], 8)


@query(f"WITH {_PW}, c AS (SELECT unnest(range(4)) AS col) SELECT page, col, count(*) AS n, round(sum(x0), 3) AS x FROM w JOIN c ON (x0 + x1) / 2 >= col * 150 AND (x0 + x1) / 2 < col * 150 + 150 GROUP BY 1, 2")
def words_to_columns(spark, sf_dir):
    words = _page_words(spark, sf_dir)
    cols = words.select("page").distinct().select("page", F.explode(F.expr("sequence(0, 3)")).alias("col")).selectExpr("page", "col", "col * 150 AS lo", "col * 150 + 150 AS hi")
    return W.to_columns(words, cols, ["page"]).groupBy("page", "col").agg(F.count("*").alias("n"), F.round(F.sum("x0"), 3).alias("x"))


@query(f"""WITH {_PW}, a AS (SELECT page, k AS row, k * 30.0 AS y FROM (SELECT DISTINCT page FROM w), (SELECT unnest(range(1, 6)) AS k)), 
  b AS (SELECT w.*, row FROM w JOIN a USING (page) QUALIFY row_number() OVER (PARTITION BY w.page, i ORDER BY abs(top - y), row) = 1) SELECT page, row, count(*) AS n FROM b GROUP BY 1, 2""")
def nearest_anchor(spark, sf_dir):
    words = _page_words(spark, sf_dir).withColumn("col", F.lit(0))
    anchors = words.select("page").distinct().select("page", F.explode(F.expr("sequence(1, 5)")).alias("row")).withColumn("y", F.col("row") * 30.0)
    return W.nearest(words, anchors, ["page"]).groupBy("page", "row").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE c AS (SELECT user_id AS page, CAST(trunc(value) AS INT) % 6 AS number, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
  r AS (SELECT page, 0::BIGINT AS k, 0 AS row FROM (SELECT DISTINCT page FROM c) UNION ALL SELECT r.page, n.k, n.number FROM r, LATERAL (SELECT k, number FROM c WHERE c.page = r.page AND c.k > r.k AND c.number = r.row + 1 ORDER BY k LIMIT 1) n)
SELECT page, row, CAST(k AS DOUBLE) AS y FROM r WHERE row > 0""")
def row_anchor_sequence(spark, sf_dir):
    from pyspark.sql import Window

    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("page"), (F.col("value").cast("int") % 6).alias("number"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("y"))
    return W.running_items(e, ["page"])


_FIXED = "rpad(p_brand, 12, ' ') || rpad(left(p_type, 16), 18, ' ') || rpad(left(p_name, 14), 16, ' ') || p_size"


@query(f"""WITH l AS (SELECT p_size % 7 AS page, {_FIXED} AS x FROM part), n AS (SELECT page, count(*) AS n FROM l GROUP BY 1), b AS (SELECT page, i, count(*) AS k FROM (SELECT page, x, unnest(range(length(x))) AS i FROM l) WHERE substr(x, CAST(i AS INT) + 1, 1) <> ' ' GROUP BY 1, 2),
  u AS (SELECT page, i FROM b JOIN n USING (page) WHERE k > 1 OR n <= 1) SELECT page, i AS start FROM (SELECT *, lag(i) OVER (PARTITION BY page ORDER BY i) AS p FROM u) WHERE p IS NULL OR i - p > 2""")
def text_rivers(spark, sf_dir):
    rows = _t(spark, sf_dir, "part").selectExpr("p_size % 7 AS page", "concat(rpad(p_brand, 12, ' '), rpad(left(p_type, 16), 18, ' '), rpad(left(p_name, 14), 16, ' '), p_size) AS text")
    return W.text_rivers(rows, ["page"])


@query(f"""WITH {_PW}, l AS (SELECT *, CAST(round_even(top / 4, 0) AS BIGINT) AS line FROM w), f AS (SELECT page, line FROM l GROUP BY 1, 2 HAVING count(*) >= 2), n AS (SELECT page, count(*) AS n FROM f GROUP BY 1),
  b AS (SELECT page, i, count(*) AS c FROM (SELECT DISTINCT page, line, unnest(range(CAST(floor(x0) AS INT), CAST(floor(x1) AS INT) + 1)) AS i FROM l SEMI JOIN f USING (page, line)) GROUP BY 1, 2), u AS (SELECT page, i FROM b JOIN n USING (page) WHERE c > ceil(n * 0.12))
SELECT page, i AS start FROM (SELECT *, lag(i) OVER (PARTITION BY page ORDER BY i) AS p FROM u) WHERE p IS NULL OR i - p > 2""")
def column_starts_histogram(spark, sf_dir):
    return W.column_starts(_page_words(spark, sf_dir), ["page"])


@query("SELECT event_type AS grp, CASE WHEN count(*) = 0 THEN 0 ELSE round(least(1, 0.5 + 0.5 * avg(CAST(event_id % 3 <> 0 AS INT))), 3) END AS confidence FROM events GROUP BY 1")
def grid_confidence(spark, sf_dir):
    e = _t(spark, sf_dir, "events").selectExpr("event_type AS grp", "if(event_id % 3 = 0, ' ', 'x') AS value")
    return W.fill_confidence(e, ["grp"])


@query("""WITH RECURSIVE e AS (SELECT concat(user_id, '|', event_type) AS key, CAST(epoch(ts) AS DOUBLE) AS t, event_id AS id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY epoch(ts), event_id) AS k FROM events),
  r AS (SELECT key, t AS put, t, id, k, false AS hit FROM e WHERE k = 1 UNION ALL SELECT e.key, CASE WHEN e.t - r.put <= 86400 THEN r.put ELSE e.t END, e.t, e.id, e.k, e.t - r.put <= 86400 FROM r JOIN e ON e.key = r.key AND e.k = r.k + 1)
SELECT key, id, hit FROM r""")
def cache_hits_ttl(spark, sf_dir):
    e = _t(spark, sf_dir, "events").selectExpr("concat(user_id, '|', event_type) AS key", "cast(cast(ts AS timestamp) AS double) AS ts", "event_id AS id")
    return S.hits(e, ttl=86400).select("key", "id", "hit")


@query("SELECT c_custkey AS id FROM (SELECT c_custkey, c_nationkey * 1000 + c_custkey % 9 AS sha, c_acctbal AS ts FROM customer QUALIFY row_number() OVER (PARTITION BY sha ORDER BY ts DESC, c_custkey DESC) = 1) ORDER BY ts DESC, id LIMIT 300")
def conversion_upsert(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "cast(c_nationkey * 1000 + c_custkey % 9 AS string) AS sha", "c_acctbal AS ts")
    return R.upsert(rows.where("id % 2 = 0"), rows.where("id % 2 = 1")).select("id")


@query("SELECT count(*) FILTER (n % 5 <> 0 AND n % 7 <> 0) AS added, count(*) FILTER (n % 5 = 0 OR n % 7 = 0) AS skipped FROM (SELECT s_suppkey AS n FROM supplier)")
def alias_import_counts(spark, sf_dir):
    rows = _t(spark, sf_dir, "supplier").selectExpr("if(s_suppkey % 5 = 0, ' ', s_name) AS mpn_a", "CASE WHEN s_suppkey % 7 = 0 THEN lower(s_name) ELSE concat(s_name, 'b') END AS mpn_b")
    return R.import_counts(rows.withColumn("mpn_b", F.when(C.blank_text("mpn_a"), F.lit("x")).otherwise(F.col("mpn_b"))))


@query("SELECT user_id AS job, event_type AS status, CAST(least(100, greatest(0, value)) AS DOUBLE) AS progress FROM events WHERE epoch(ts) >= (SELECT max(epoch(ts)) - 604800 FROM events) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts) DESC, event_id DESC) = 1")
def job_states(spark, sf_dir):
    e = _t(spark, sf_dir, "events").selectExpr("user_id AS job", "cast(cast(ts AS timestamp) AS double) AS ts", "event_id", "event_type AS status", "value AS progress", "'' AS stage")
    now = e.agg(F.max("ts")).first()[0]
    newest_ = e.groupBy("job").agg(F.max(F.struct("ts", "event_id")).alias("m")).select("job", "m.*")
    return R.jobs(e.join(newest_, ["job", "ts", "event_id"]).drop("event_id"), now or 0.0, 604800).select("job", "status", "progress")


@query("SELECT o_orderpriority AS section, o_orderkey, greatest(0, n - 12) AS more FROM (SELECT *, count(*) OVER (PARTITION BY o_orderpriority) AS n, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 12")
def section_heads(spark, sf_dir):
    return R.sections(_t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("section"), "o_orderkey"), "section", ["o_orderkey"])


@query("SELECT page_id, substr(upper(regexp_extract(regexp_replace(url, '^https?://', ''), '^[^\\s_#\\-]*')), 1, 24) AS prefix FROM pages")
def url_prefix_mapping(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", C.customer_prefix(F.regexp_replace("url", "^https?://", "")).alias("prefix"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.page') AS VARCHAR) AS page FROM events")
def json_props_parse(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.page").alias("page"))


@query()
def bounded_cache_hits(spark, sf_dir):
    """A cache of 64 entries for each type of event; evictions depend on all entries before, so a brute-force test stands for SQL."""
    return S.accesses(_t(spark, sf_dir, "events").selectExpr("event_type AS cache", "cast(user_id AS string) AS key", "cast(cast(ts AS timestamp) AS double) AS ts", "event_id AS id"), ttl=86400)
