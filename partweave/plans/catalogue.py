"""Queries of the parts-list engine over the driver tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partweave.functions.text import digest
from partweave.operators import components as G
from partweave.operators import diff as D
from partweave.operators import rename as R
from partweave.written import Written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: two derived revisions of ``part``: keys in other writing, comment keys, words for missing cells, repeated keys,
#: quantities with units, designators in another order, other makers, renamed parts
_OLD = """CASE p_partkey % 17 WHEN 0 THEN NULL WHEN 1 THEN 'NULL' WHEN 2 THEN concat(p_partkey, 'R') ELSE concat(p_brand, '-', p_partkey) END AS mpn,
 concat('R', p_partkey, ',R', p_partkey + 1) AS refdes, concat(p_size, CASE p_partkey % 4 WHEN 0 THEN ' pcs' WHEN 1 THEN '.0' WHEN 2 THEN ' ea' ELSE '' END) AS qty, p_name AS description,
 CASE WHEN p_partkey % 17 = 0 AND p_partkey % 2 = 0 THEN concat('note ', p_partkey) END AS comment, p_brand AS manufacturer, 'v1' AS vendor, p_partkey + 2 AS line"""
_NEW = """CASE p_partkey % 17 WHEN 0 THEN '' WHEN 1 THEN 'nan' WHEN 2 THEN concat('', p_partkey) ELSE concat(CASE WHEN p_partkey % 5 = 0 THEN concat(' ', lower(p_brand)) ELSE p_brand END, '-', p_partkey, CASE WHEN p_partkey % 13 = 5 THEN 'TR' ELSE '' END) END AS mpn,
 CASE WHEN p_partkey % 7 = 0 THEN concat('r', p_partkey + 1, ' r', p_partkey) WHEN p_partkey % 11 = 0 THEN concat('R', p_partkey) ELSE concat('R', p_partkey, ',R', p_partkey + 1) END AS refdes,
 concat('', CASE WHEN p_partkey % 6 = 0 THEN p_size + 1 ELSE p_size END) AS qty, CASE p_partkey % 8 WHEN 0 THEN concat(p_name, ' x') WHEN 1 THEN upper(p_name) ELSE p_name END AS description,
 CASE WHEN p_partkey % 17 = 0 AND p_partkey % 2 = 0 THEN concat('NOTE ', p_partkey) END AS comment, CASE WHEN p_partkey % 19 = 0 THEN 'Other' ELSE lower(p_brand) END AS manufacturer,
 CASE WHEN p_partkey % 29 = 0 THEN 'v2' ELSE 'V1' END AS vendor, p_partkey + 2 AS line"""
_AGAIN = "SELECT {0} FROM part WHERE {1} UNION ALL SELECT mpn, refdes, qty, description, comment, manufacturer, vendor, line + 1000000 FROM (SELECT {0} FROM part WHERE p_partkey % 23 = 0 AND {1}) x"
OLD, NEW = _AGAIN.format(_OLD, "p_partkey % 10 <> 3"), _AGAIN.format(_NEW, "p_partkey % 10 <> 7")


def revisions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = _t(spark, sf_dir, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")  # few bytes, but many cells a row
    return tuple(spark.sql(sql.replace("FROM part", "FROM {part}"), part=part) for sql in (OLD, NEW))


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.diff(*revisions(spark, sf_dir))


def _bare(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^\\s+|\\s+$', '', 'g')"


def _key(x: str) -> str:
    u = f"upper({_bare(x)})"
    return f"CASE WHEN {u} IN ('NAN', 'NONE', 'NULL') THEN '' WHEN regexp_matches({u}, '^[0-9]+\\.?[0-9]*R$') THEN left({u}, -1) ELSE {u} END"


def _number(x: str) -> str:
    n = f"try_cast(regexp_extract({x}, '^([0-9.]+) ?(pcs|ea)?$', 1) AS DOUBLE)"
    return f"coalesce(CAST(CAST({n} AS BIGINT) AS VARCHAR), '')"


_CELLS = ("mpn", "refdes", "qty", "description", "manufacturer", "vendor", "comment", "line")
_FORMS = {"refdes": "upper({0}.refdes)", "qty": _number("{0}.qty"), "description": "upper({0}.description)", "manufacturer": "upper({0}.manufacturer)", "vendor": "upper({0}.vendor)"}
_CTE = (
    f"WITH a AS ({OLD}), b AS ({NEW}), "
    + ", ".join(
        f"k{x} AS (SELECT * FROM (SELECT *, CASE WHEN m <> '' THEN m WHEN c <> '' THEN 'COMMENT_' || c ELSE '' END AS k FROM (SELECT *, {_key('mpn')} AS m, {_key('comment')} AS c FROM {x}) t) t WHERE k <> ''), "
        f"f{x} AS (SELECT * FROM k{x} QUALIFY row_number() OVER (PARTITION BY k ORDER BY line) = 1)"
        for x in "ab"
    )
    + ", e AS (SELECT coalesce(fa.k, fb.k) AS k, fa.k IS NULL AS no_a, fb.k IS NULL AS no_b, "
    + ", ".join(f"f{x}.{c} AS {n}_{c}" for x, n in (("a", "old"), ("b", "new")) for c in _CELLS)
    + ", "
    + ", ".join(f"fa.k IS NOT NULL AND fb.k IS NOT NULL AND {f.format('fa')} <> {f.format('fb')} AS {n}_changed" for n, f in _FORMS.items())
    + ", false AS mpn_changed, false AS alias_match FROM fa FULL OUTER JOIN fb ON fa.k = fb.k), "
    + "d AS (SELECT k, CASE WHEN no_b THEN 'removed' WHEN no_a THEN 'new' WHEN "
    + " OR ".join(f"{n}_changed" for n in _FORMS)
    + " THEN 'modified' ELSE 'unchanged' END AS status, * EXCLUDE (k, no_a, no_b) FROM e) "
)
#: modified rows that differ in writing only: the derived cells do so by the order of designators
_SETS = "list_sort(list_distinct(list_filter(regexp_split_to_array(upper({}), '[,;\\s]+'), lambda t: t <> '')))"
_ONLY = f"status = 'modified' AND regexp_replace(old_qty, ' (pcs|ea)$', '') = new_qty AND upper(old_description) = upper(new_description) AND {_SETS.format('old_refdes')} = {_SETS.format('new_refdes')} AND NOT manufacturer_changed AND NOT vendor_changed"
_RE = f"r AS (SELECT * REPLACE (CASE WHEN {_ONLY} THEN 'unchanged' ELSE status END AS status), {_ONLY} AS reclassified FROM d) "


@query(_CTE + "SELECT status, count(*) AS n FROM d GROUP BY 1")
def diff_summary(spark, sf_dir):
    return D.summary(_diff(spark, sf_dir))


@query(_CTE + "SELECT * FROM d")
def diff_rows(spark, sf_dir):
    return _diff(spark, sf_dir)


def _bucket(status: str) -> None:
    def run(spark, sf_dir):
        return _diff(spark, sf_dir).where(F.col("status") == status)

    run.__name__ = f"diff_{status}"
    query(_CTE + f"SELECT * FROM d WHERE status = '{status}'")(run)


for _status in ("new", "removed", "modified", "unchanged"):
    _bucket(_status)


@query(_CTE + "SELECT CAST(round(count(*) FILTER (status = 'unchanged') * 200 / (count(*) FILTER (status <> 'new') + count(*) FILTER (status <> 'removed'))) AS BIGINT) AS match_rate FROM d")
def match_rate(spark, sf_dir):
    return D.match_rate(_diff(spark, sf_dir))


@query(_CTE + "SELECT k, count(*) AS occurrences, min(line) AS first_line, max(line) AS last_line FROM ka WHERE k NOT LIKE 'COMMENT\\_%' ESCAPE '\\' GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return D.duplicates(revisions(spark, sf_dir)[0])


@query(_CTE + "SELECT k, line FROM ka WHERE k NOT LIKE 'COMMENT\\_%' ESCAPE '\\' QUALIFY count(*) OVER (PARTITION BY k) > 1")
def duplicate_key_lines(spark, sf_dir):
    return D.duplicate_lines(revisions(spark, sf_dir)[0])


@query(_CTE + ", " + _RE + "SELECT k, status, reclassified FROM r")
def reclassify_formatting_only(spark, sf_dir):
    return D.reclassify(_diff(spark, sf_dir)).select("k", "status", "reclassified")


_SHOWN = "CASE WHEN upper({0}) IN ('', 'NULL', 'NAN') OR {0} IS NULL THEN {1} ELSE {0} END"
_PART = {s: _SHOWN.format(f"trim({s}_mpn)", f"trim({s}_comment)") for s in ("old", "new")}


@query(_CTE + f"""SELECT CASE WHEN status = 'new' THEN {_PART['new']} ELSE {_PART['old']} END AS part, CASE status WHEN 'new' THEN 'Added' WHEN 'removed' THEN 'Removed' ELSE 'Modified' END AS status,
  {', '.join(f"coalesce({s}_{f}, '') AS {s}_{f}" for s in ("old", "new") for f in ("refdes", "qty", "description"))} FROM d WHERE status <> 'unchanged'""")
def diff_side_by_side(spark, sf_dir):
    return D.side_by_side(_diff(spark, sf_dir))


@query(_CTE + f"""SELECT upper(CASE WHEN status = 'removed' THEN {_PART['old']} ELSE {_PART['new']} END) AS part, {', '.join(f"status = 'modified' AND old_{f} <> new_{f} AS {f}" for f in ("qty", "refdes", "description"))},
  false AS mpn_changed, status = 'new' AS added, status = 'removed' AS removed FROM d WHERE status <> 'unchanged'""")
def export_diff_flags(spark, sf_dir):
    return D.export_flags(_diff(spark, sf_dir))


@query(_CTE + "SELECT k FROM d WHERE status = 'modified' AND qty_changed AND description_changed")
def modified_flag_filter(spark, sf_dir):
    return D.with_flags(_diff(spark, sf_dir), "qty", "description").select("k")


@query(_CTE + """SELECT k, CASE WHEN NOT description_changed OR status <> 'modified' THEN NULL ELSE 1.0 END AS description_similarity, false AS description_drift FROM d
  WHERE status = 'modified' AND (NOT description_changed OR lower(new_description) = lower(old_description) || ' x')""")
def diff_description_drift(spark, sf_dir):
    """A description with one word more holds all words of the other: similarity 1, no drift."""
    return D.with_drift(_diff(spark, sf_dir)).where("status = 'modified'").select("k", "description_similarity", "description_drift")


@query()
def diff_figures(spark, sf_dir):
    """The whole flow: keys, renames, aliases, reclassification, drift, figures."""
    old, new = revisions(spark, sf_dir)
    rows = Written(spark).table(D.diff(old, new), "diff")  # the keys of both sides and the renames read it
    keys = {s: rows.where(f"status = '{s}'").select("k") for s in ("removed", "new")}
    rows = D.apply_renames(rows, R.rename_pairs(keys["removed"], keys["new"]))
    rows = D.fold_aliases(rows, G.canonical_names(_aliases(spark, sf_dir)))
    return D.figures(D.with_drift(D.reclassify(rows)), old, new)


@query()
def fuzzy_pairs_blocked(spark, sf_dir):
    """Removed and new keys paired by similar part numbers; tests compare it with all pairs of a small table."""
    rows = Written(spark).table(_diff(spark, sf_dir).where("status IN ('removed', 'new')").select("k", "status"), "keys")
    out = R.rename_pairs(rows.where("status = 'removed'").select("k"), rows.where("status = 'new'").select("k"))
    return out.withColumn("score", F.round("score", 6))


def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs along chains of parts of one brand number: ``brand-k`` with ``brand-(k + 7)`` in new writing."""
    part = _t(spark, sf_dir, "part").where("p_partkey % 4 < 2")
    return part.selectExpr("concat(' ', lower(p_brand), '-', p_partkey) AS mpn_a", "concat(p_brand, '-', p_partkey + 7) AS mpn_b")


_EDGES = "e AS (SELECT upper(p_brand) || '-' || p_partkey AS a, upper(p_brand) || '-' || (p_partkey + 7) AS b FROM part WHERE p_partkey % 4 < 2), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e)"


@query(f"WITH RECURSIVE {_EDGES}, w AS (SELECT a AS n, a AS m FROM u UNION SELECT u.b, w.m FROM w JOIN u ON u.a = w.n) SELECT n AS mpn, min(m) AS canon FROM w GROUP BY 1")
def alias_components(spark, sf_dir):
    return G.canonical_names(_aliases(spark, sf_dir))


@query(f"WITH RECURSIVE {_EDGES}, w AS (SELECT a AS n, a AS m FROM u UNION SELECT u.b, w.m FROM w JOIN u ON u.a = w.n), c AS (SELECT n, min(m) AS canon FROM w GROUP BY 1) SELECT p_partkey, coalesce(canon, upper(p_brand) || '-' || p_partkey) AS canon FROM part LEFT JOIN c ON n = upper(p_brand) || '-' || p_partkey")
def alias_lookup(spark, sf_dir):
    part = _t(spark, sf_dir, "part").selectExpr("p_partkey", "concat(p_brand, '-', p_partkey) AS mpn")
    return G.with_canonical(part, G.canonical_names(_aliases(spark, sf_dir))).select("p_partkey", "canon")


@query(_CTE.replace("WITH a", f"WITH RECURSIVE {_EDGES.replace('e AS', 'ed AS').replace('FROM e ', 'FROM ed ').replace('FROM e)', 'FROM ed)')}, w AS (SELECT a AS n, a AS m FROM u UNION SELECT u.b, w.m FROM w JOIN u ON u.a = w.n), c AS (SELECT n, min(m) AS canon FROM w GROUP BY 1), a", 1)
 + """, o AS (SELECT k, canon, row_number() OVER (PARTITION BY canon ORDER BY old_line, k) AS p FROM d JOIN c ON n = upper(trim(old_mpn)) WHERE status = 'removed'),
  v AS (SELECT k, canon, row_number() OVER (PARTITION BY canon ORDER BY new_line, k) AS p FROM d JOIN c ON n = upper(trim(new_mpn)) WHERE status = 'new'),
  j AS (SELECT o.k AS ok, v.k AS vk FROM o JOIN v USING (canon, p))
  SELECT status, count(*) AS n FROM (SELECT CASE WHEN j.ok IS NOT NULL THEN 'modified' ELSE status END AS status FROM d LEFT JOIN j ON status = 'removed' AND ok = k WHERE NOT (status = 'new' AND k IN (SELECT vk FROM j))) GROUP BY 1""")
def alias_fold_diff(spark, sf_dir):
    return D.summary(D.fold_aliases(_diff(spark, sf_dir), G.canonical_names(_aliases(spark, sf_dir))))


@query("SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) = 1")
def first_row_per_key(spark, sf_dir):
    return D.first_per_key(_t(spark, sf_dir, "part"), ["p_brand"], ["p_size", "p_partkey"])


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_custkey % 3 <> 0")
def key_except(spark, sf_dir):
    return _t(spark, sf_dir, "customer").selectExpr("c_custkey AS k").subtract(_t(spark, sf_dir, "orders").where("o_custkey % 3 <> 0").select("o_custkey"))


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def key_intersect(spark, sf_dir):
    return _t(spark, sf_dir, "customer").selectExpr("c_custkey AS k").intersect(_t(spark, sf_dir, "orders").select("o_custkey"))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)")
def key_semi(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    return _t(spark, sf_dir, "part").select("p_partkey", "p_name").join(li, "p_partkey", "left_semi")


@query("SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey AND o_custkey % 7 <> 0)")
def key_anti(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").where("o_custkey % 7 <> 0").select(F.col("o_custkey").alias("c_custkey"))
    return _t(spark, sf_dir, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left_anti")


@query("SELECT sha256(coalesce(text, '')) AS sha, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1")
def content_dedupe_sha(spark, sf_dir):
    return _t(spark, sf_dir, "documents").groupBy(digest("text").alias("sha")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query("SELECT event_id, user_id, last_value(CASE WHEN event_id % 3 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS filled FROM events")
def forward_fill(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", F.expr("CASE WHEN event_id % 3 = 0 THEN event_type ELSE '' END").alias("v"))
    return D.forward_fill(e, "v", ["user_id"], ["event_id"]).select("event_id", "user_id", "filled")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), '12') OR contains(lower(p_type), '12') OR contains(lower(p_brand), '12') OR contains(CAST(p_partkey AS VARCHAR), '12')")
def search_filter(spark, sf_dir):
    return D.search(_t(spark, sf_dir, "part"), "12", ["p_name", "p_type", "p_brand", "p_partkey"]).select("p_partkey", "p_name")


@query("SELECT l_suppkey, count(*) AS n_lines, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY 1")
def supplier_parts(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n_lines"), F.countDistinct("l_partkey").alias("n_parts"))
