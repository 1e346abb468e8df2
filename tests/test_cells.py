import pytest
from pyspark.sql import functions as F

from partweave.functions import cells as C
from partweave.operators import tables as T

QTY = {"10": 10.0, "10.0": 10.0, "10,5": 10.5, "1,000": 1000.0, "1,000.5": 1000.5, "10K": 10000.0, "3/4": 0.75, "1 1/2": 1.5, "1 ½": 1.5, "1½": None, "5/16": 0.3125, "2 5/16": None, "1/0": None, "10 pcs": 10.0, "10x": 10.0, "2m": 2e6, "": None, "n/a": None, None: None}


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", fn("v").alias("x")).orderBy("i").collect()]


def test_quantity(spark):
    assert dict(zip(QTY, apply(spark, C.quantity, QTY), strict=True)) == QTY


@pytest.mark.parametrize(
    ("fn", "cases"),
    [
        (C.match_form, {" lm-317_t/nopb.x ": "LM317TNOPBX", "nan": "", None: "", "": ""}),
        (C.cell_key, {"750R": "750", " 4.7r ": "4.7", "R": "R", "BR": "BR", "Null": "", None: "", "N/A": "N/A"}),
        (C.display, {"3.0": "3", "3.10": "3.10", "none": "N/A", None: "N/A", "ab": "ab"}),
        (C.revision, {"list_Rev-B00_0001": "B00", "x-rev A": "A", "plain": None, None: None}),
        (C.ocr_digits, {"1O": "10", "S.l2-g": "5.12-9", "xx": "", None: None}),
        (C.doubled_glyphs, {"RRJJ": True, "RRJ": False, "RR": False, None: False}),
        (C.distinct_tokens, {"a b  a": "a b", "": "", None: None}),
        (C.trim_leaders, {"bolt 3 4 5": "bolt 3", "bolt 3": "bolt 3", None: None}),
        (lambda c: F.array_join(C.refdes_set(c), " "), {"R2, r1;R2": "R1 R2", "": "", None: ""}),
    ],
)
def test_cells(spark, fn, cases):
    assert dict(zip(cases, apply(spark, fn, cases), strict=True)) == cases


def test_placements_keep_blank_parts(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, None, "z"), (4, " ", "z"), (5, None, "z")], "line int, part string, maker string")
    got = sorted((r.part or "", r.maker, r.qty) for r in T.placements(rows, "part", ["line"], ["maker"]).collect())
    assert got == [("", "z", 1), ("", "z", 1), (" ", "z", 1), ("a", "x", 2)]


def test_continuation_and_islands(spark):
    rows = spark.createDataFrame([(1, 1, "p"), (1, 2, "A"), (1, 3, None), (1, 4, "q")], "d int, line int, t string")
    got = T.continuation(rows, ["d"], "line", F.col("t") == "A", "t", "|").orderBy("grp").collect()
    assert [(r.grp, r.text) for r in got] == [(0, "p"), (1, "A||q")]
    runs = T.islands(rows.where("line <> 3"), ["d"], "line").orderBy("lo").collect()
    assert [(r.lo, r.hi, r.n) for r in runs] == [(1, 2, 2), (4, 4, 1)]
    assert T.upper_median(rows, ["d"], "line").collect()[0].median == 3
    assert T.islands(rows.limit(0), ["d"], "line").count() == 0


def test_header_row(spark):
    cells = spark.createDataFrame([("f", 0, "Acme"), ("f", 2, "MPN"), ("f", 2, "Qty"), ("f", 3, "part desc"), ("g", 0, "x"), ("g", 1, "y"), ("h", 1, "Qty")], "f string, row int, v string")
    assert {r.f: r.header_row for r in T.header_row(cells, "f", "row", "v").collect()} == {"f": 2, "g": 0, "h": 1}
