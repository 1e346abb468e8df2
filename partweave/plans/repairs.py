"""Queries of the repair by a second reading, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from partweave.operators import repair as R
from partweave.plans.catalogue import _t, query


def readings(spark, sf_dir):
    """``part`` as quote lines of a table a brand, with bad cells, and a second reading in other writing that lacks some rows."""
    p = _t(spark, sf_dir, "part")
    own = p.selectExpr(
        "p_brand AS doc", "p_partkey AS line", "if(p_partkey % 3 = 0, '', concat('I-', p_partkey)) AS item", "if(p_partkey % 11 = 0, '§§', concat(p_name, ' ', p_partkey)) AS description",
        "CASE p_partkey % 5 WHEN 1 THEN concat('ACME XY', p_partkey) WHEN 2 THEN '77' ELSE 'ACME' END AS maker", "CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '??' ELSE concat('XY-', p_partkey) END AS part",
        "if(p_partkey % 7 = 0, 'see drawing no 9', cast(p_size AS string)) AS qty",
    )
    other = p.where("p_partkey % 11 <> 0").selectExpr(
        "p_brand AS doc", "p_partkey + 5 AS line", "if(p_partkey % 3 = 0, NULL, concat('i', p_partkey, '.')) AS item", "concat(upper(p_name), ', ', p_partkey, '.') AS description", "if(p_partkey % 2 = 0, 'Acme', NULL) AS maker",
        "if(p_partkey % 8 = 0, '--', concat('XY', p_partkey)) AS part", "if(p_partkey % 14 = 0, 'some', cast(p_size AS string)) AS qty",
    )
    return own, other, p.selectExpr("p_brand AS doc", "0.5 AS confidence").distinct()


_OWN = """p AS (SELECT p_partkey AS id, p_brand AS doc, CAST(p_size AS VARCHAR) AS size FROM part),
f AS (SELECT doc, id AS line, id % 11 <> 0 AS found, 'maker' AS field, CASE id % 5 WHEN 1 THEN 'ACME XY' || id ELSE '77' END AS own, CASE WHEN id % 2 = 0 THEN 'Acme' ELSE '' END AS other FROM p WHERE id % 5 IN (1, 2)
UNION ALL SELECT doc, id, id % 11 <> 0, 'part', CASE id % 4 WHEN 0 THEN '' ELSE '??' END, CASE WHEN id % 8 = 0 THEN '--' ELSE 'XY' || id END FROM p WHERE id % 4 = 1 OR (id % 4 = 0 AND id % 5 <> 2)
UNION ALL SELECT doc, id, id % 11 <> 0, 'qty', 'see drawing no 9', CASE WHEN id % 14 = 0 THEN 'some' ELSE size END FROM p WHERE id % 7 = 0
UNION ALL SELECT doc, id, false, 'description', '§§', NULL FROM p WHERE id % 11 = 0)"""


@query(f"""WITH {_OWN} SELECT doc, line, field, own, CASE WHEN found THEN other END AS other, CASE WHEN NOT found THEN 'unmatched' WHEN field = 'maker' THEN 'changed' WHEN field = 'part' AND other = '--' THEN 'differs'
WHEN field = 'qty' AND other = 'some' THEN 'differs' ELSE 'changed' END AS action FROM f WHERE NOT found OR other <> ''""")
def repair_report(spark, sf_dir):
    """What a second reading changes: rows matched by item or by similar description, and rows it lacks."""
    own, other, confidence = readings(spark, sf_dir)
    return R.report(own, other, confidence, ["doc"])
