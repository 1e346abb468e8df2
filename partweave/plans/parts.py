"""Queries of the cell functions and table operators over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from partweave.functions import cells as C
from partweave.operators import tables as T
from partweave.plans.catalogue import _t, query

_MPN = "p_brand || '-' || p_partkey"


@query(f"SELECT p_partkey, regexp_replace(upper(trim({_MPN} || ' _x/9.')), '[\\s\\-_./]+', '', 'g') AS norm FROM part")
def norm_mpn(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", C.match_form(F.concat("p_brand", F.lit("-"), "p_partkey", F.lit(" _x/9."))).alias("norm"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN '' WHEN 2 THEN upper(p_brand) || 'R' ELSE p_size || '.5' END AS norm FROM part""")
def norm_resistance(spark, sf_dir):
    raw = F.expr("CASE p_partkey % 4 WHEN 0 THEN concat(' ', p_size, 'r') WHEN 1 THEN 'None ' WHEN 2 THEN concat(p_brand, 'r') ELSE concat(p_size, '.5R') END")
    return _t(spark, sf_dir, "part").select("p_partkey", C.cell_key(raw).alias("norm"))


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 7 WHEN 0 THEN l_quantity WHEN 1 THEN l_quantity * 1000 WHEN 2 THEN l_quantity + 0.5 WHEN 3 THEN 0.75
  WHEN 4 THEN 2000 WHEN 5 THEN l_quantity + 0.5 ELSE NULL END AS qty FROM lineitem""")
def norm_quantity(spark, sf_dir):
    q = "cast(cast(l_quantity AS int) AS string)"
    raw = F.expr(f"CASE l_linenumber % 7 WHEN 0 THEN concat({q}, ' Pcs.') WHEN 1 THEN concat({q}, ',000') WHEN 2 THEN concat({q}, ',5') WHEN 3 THEN '¾' WHEN 4 THEN '2K' WHEN 5 THEN concat({q}, ' 1/2 ea') ELSE 'n/a' END")
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.quantity(raw).alias("qty"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'N/A' WHEN p_partkey % 3 = 1 THEN CAST(p_size AS VARCHAR) ELSE p_name END AS shown FROM part")
def display_cells(spark, sf_dir):
    raw = F.expr("CASE WHEN p_partkey % 3 = 0 THEN 'nan' WHEN p_partkey % 3 = 1 THEN concat(p_size, '.0') ELSE p_name END")
    return _t(spark, sf_dir, "part").select("p_partkey", C.display(raw).alias("shown"))


_SET = "list_sort(list_distinct(list_filter(regexp_split_to_array(upper({}), '[,;\\s]+'), lambda t: t <> '')))"


@query(f"SELECT p_partkey, {_SET.format('x')} = {_SET.format('y')} AS same, array_to_string({_SET.format('x')}, ',') AS tokens FROM (SELECT p_partkey, p_type || ', R' || p_size || ';R1' AS x, 'r1 r' || p_size || ' ' || p_type AS y FROM part)")
def refdes_set_equal(spark, sf_dir):
    x, y = C.refdes_set(F.expr("concat(p_type, ', R', p_size, ';R1')")), C.refdes_set(F.expr("concat('r1 r', p_size, ' ', p_type)"))
    return _t(spark, sf_dir, "part").select("p_partkey", (x == y).alias("same"), F.array_join(x, ",").alias("tokens"))


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B0' || s_suppkey END AS revision FROM supplier")
def revision_token(spark, sf_dir):
    raw = F.expr("concat(s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '_Rev A' WHEN 1 THEN concat('-rev.b0', s_suppkey) ELSE '_list' END)")
    return _t(spark, sf_dir, "supplier").select("s_suppkey", C.revision(raw).alias("revision"))


@query("SELECT p_partkey, p_partkey % 2 = 0 AS doubled, CASE WHEN p_partkey % 2 = 0 THEN '10555' || p_size ELSE '8' || p_size || '.' END AS digits, p_name || ' 12' AS description FROM part")
def ocr_repair(spark, sf_dir):
    tok = F.expr("CASE WHEN p_partkey % 2 = 0 THEN 'RRJJ' ELSE 'RRJ' END")
    num = F.expr("CASE WHEN p_partkey % 2 = 0 THEN concat('IOS5s', p_size) ELSE concat('B', p_size, '.#x') END")
    return _t(spark, sf_dir, "part").select("p_partkey", C.doubled_glyphs(tok).alias("doubled"), C.ocr_digits(num).alias("digits"), C.trim_leaders(F.concat("p_name", F.lit(" 12 3 4"))).alias("description"))


@query("SELECT p_partkey, p_size || ' a' AS tokens, CASE WHEN p_size < 20 THEN 'low' WHEN p_size * 3 < 80 THEN 'medium' ELSE 'high' END AS band FROM part")
def distinct_tokens(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", C.distinct_tokens(F.expr("concat(p_size, ' a  ', p_size, ' a')")).alias("tokens"), C.band(F.col("p_size") * 3).alias("band"))


@query("SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark, sf_dir):
    return T.latest(_t(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"])


@query("SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 300")
def retention_top_n(spark, sf_dir):
    return T.retain(_t(spark, sf_dir, "events"), 300, ["event_type"], [F.desc("ts"), F.desc("event_id")])


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def newest_first_limit(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", "ts", "event_type").orderBy(F.desc("ts"), F.desc("event_id")).limit(50)


@query("""SELECT conv_id, grp, min(turn) AS first, count(*) AS n, string_agg(coalesce(text, ''), chr(10) ORDER BY turn, role, coalesce(text, '')) AS text
FROM (SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS BIGINT) AS grp FROM conversations) GROUP BY conv_id, grp""")
def continuation_merge(spark, sf_dir):
    return T.continuation(_t(spark, sf_dir, "conversations"), ["conv_id"], ["turn", "role", "text"], F.col("role") == "user", "text")


_LI = "l_orderkey, l_linenumber, l_suppkey, l_quantity"


@query(f"SELECT l_partkey, arg_min(l_suppkey, row({_LI})) AS l_suppkey, arg_min(l_quantity, row({_LI})) AS l_quantity, count(*) AS qty FROM lineitem GROUP BY 1")
def placement_consolidation(spark, sf_dir):
    return T.placements(_t(spark, sf_dir, "lineitem"), "l_partkey", _LI.split(", "), ["l_suppkey", "l_quantity"])


@query("SELECT l_suppkey, list_sort(list(l_extendedprice))[count(*) // 2 + 1] AS median FROM lineitem GROUP BY 1")
def upper_median(spark, sf_dir):
    return T.upper_median(_t(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice")


@query("SELECT c_nationkey, lo, hi, n FROM (SELECT c_nationkey, min(b) AS lo, max(b) AS hi, count(*) AS n FROM (SELECT c_nationkey, b, b - row_number() OVER (PARTITION BY c_nationkey ORDER BY b) AS g FROM (SELECT DISTINCT c_nationkey, c_custkey // 20 AS b FROM customer)) GROUP BY c_nationkey, g)")
def bin_islands(spark, sf_dir):
    return T.islands(_t(spark, sf_dir, "customer").selectExpr("c_nationkey", "c_custkey div 20 AS b"), ["c_nationkey"], "b")


@query("""SELECT o_custkey, o_orderkey, CAST(sum(nw) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster
FROM (SELECT *, CASE WHEN o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 500 THEN 1 ELSE 0 END AS nw FROM orders)""")
def header_cluster_gaps(spark, sf_dir):
    return T.gap_clusters(_t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], "o_orderkey", 500)


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_id % 4 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS label FROM events""")
def previous_label(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return T.previous_label(e, ["user_id"], ["event_id"], F.col("event_id") % 4 == 0, "event_type").drop("event_type")


@query("""WITH a AS (SELECT p_brand AS canon, p_partkey AS mpn, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part WHERE p_partkey % 10 = 7),
b AS (SELECT p_brand AS canon, p_partkey AS mpn, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part WHERE p_partkey % 10 = 3)
SELECT a.canon, a.mpn AS old, b.mpn AS new FROM a JOIN b ON a.canon = b.canon AND a.rn = b.rn""")
def alias_fold(spark, sf_dir):
    p = _t(spark, sf_dir, "part").selectExpr("p_brand AS canon", "p_partkey AS mpn", "p_partkey AS line")
    return T.alias_fold(p.where("mpn % 10 = 7"), p.where("mpn % 10 = 3"), "line")


@query("""WITH c AS (SELECT doc_id, i - 1 AS row, lower(trim(l[i])) AS v FROM (SELECT doc_id, l, unnest(range(1, least(len(l), 30) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
  UNION ALL SELECT doc_id, doc_id % 11, unnest(['mpn', 'qty']) FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, doc_id % 13, 'part desc' FROM documents WHERE doc_id % 3 = 1),
s AS (SELECT doc_id, row, sum(CASE WHEN h THEN w ELSE 0 END) AS score, sum(CASE WHEN h THEN 1 ELSE 0 END) AS hits FROM (SELECT doc_id, row, regexp_matches(v, 'mpn|part|qty|desc|ref|loc|item|mfr|package|manufacturer|designator|quantity') AS h,
  CASE WHEN regexp_matches(v, 'manufacturer|mpn|part number|pn') THEN 3 WHEN regexp_matches(v, 'qty|quantity|desc|ref|designator') THEN 2 ELSE 1 END AS w FROM c) GROUP BY ALL)
SELECT doc_id, CAST(coalesce(min(CASE WHEN hits >= 2 AND score >= 4 THEN row END), CASE WHEN max(score) >= 2 THEN arg_max(row, row(score, -row)) END, 0) AS BIGINT) AS header_row FROM s GROUP BY 1""")
def header_row_detect(spark, sf_dir):
    lines = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.slice(F.split(F.coalesce("text", F.lit("")), "\n"), 1, 30)).alias("row", "value"))
    d = _t(spark, sf_dir, "documents")
    heads = d.where("doc_id % 3 = 0").selectExpr("doc_id", "cast(doc_id % 11 AS int) AS row", "explode(array('MPN', ' Qty')) AS value").union(d.where("doc_id % 3 = 1").selectExpr("doc_id", "cast(doc_id % 13 AS int) AS row", "'Part desc' AS value"))
    return T.header_row(lines.union(heads), "doc_id", "row", "value")


@query("SELECT 'supplier' AS source, s_suppkey AS key, s_name AS name, '' AS segment FROM supplier UNION ALL SELECT 'customer', c_custkey, c_name, c_mktsegment FROM customer")
def union_by_name(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier").selectExpr("'supplier' AS source", "s_suppkey AS key", "s_name AS name")
    c = _t(spark, sf_dir, "customer").selectExpr("'customer' AS source", "c_custkey AS key", "c_name AS name", "c_mktsegment AS segment")
    return s.unionByName(c, allowMissingColumns=True).na.fill("", ["segment"])


@query("SELECT p_type, sum(l_quantity) AS total, sum(CASE WHEN p_size < 25 THEN l_quantity ELSE 0 END) AS small, count(*) AS n_lines FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def quote_summary(spark, sf_dir):
    j = _t(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity").join(_t(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size"), F.expr("p_partkey = l_partkey"))
    return j.groupBy("p_type").agg(F.sum("l_quantity").alias("total"), F.sum(F.expr("CASE WHEN p_size < 25 THEN l_quantity ELSE 0 END")).alias("small"), F.count("*").alias("n_lines"))


@query("SELECT l_orderkey, l_linenumber, round_even(l_quantity / 4, 0) AS bin FROM lineitem")
def bucket_round_half_even(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.bround(F.col("l_quantity") / 4, 0).alias("bin"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY try_cast(v AS INT) NULLS LAST, v, p_partkey) AS rnk FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE CAST(p_size AS VARCHAR) END AS v FROM part)")
def numeric_aware_sort_rank(spark, sf_dir):
    v = _t(spark, sf_dir, "part").selectExpr("p_partkey", "CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE cast(p_size AS string) END AS v")
    return T.ranked(v, [(F.col("v").try_cast("int"), True), (F.col("v"), True), (F.col("p_partkey"), True)], "rnk").drop("v")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS rnk FROM part")
def descending_sort_rank(spark, sf_dir):
    return T.ranked(_t(spark, sf_dir, "part").select("p_partkey", "p_size"), [(F.col("p_size"), False), (F.col("p_partkey"), True)], "rnk").drop("p_size")
