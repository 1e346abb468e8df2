"""Findings of round 4: lines are split once."""

import __spark_entry__ as entry
from partweave.operators import anchored as A

LINES = "doc string, line int, text string"


def test_lines_are_read_once(spark):
    found = entry.queries()["anchored_lines"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert found.count("Generate") == 2 and "Union" not in found  # rows of a document, lines of a row


def test_blocks_of_lines_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(A, "LINES", 7)
    rows = [(d, 3 * k + h, f"{k % 40}  1  ABCD  PN-{k}0" if h else f"R{k},") for d in ("x", None) for k in range(200) for h in (0, 1) if (k + h) % 5]
    lines = spark.createDataFrame([*rows, ("one", 1, "1  1  ABCD  P1")], LINES)
    once, apart = (sorted(map(tuple, A.anchored_lines(lines, ["doc"], blocks=b).collect()), key=str) for b in (False, True))
    assert once == apart and len(once) > 100 and len({r[3] for r in once}) > 20
