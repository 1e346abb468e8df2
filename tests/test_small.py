"""Small operators by their values: shapes, confidences, repeated headers, filled cells, totals, recents, remembered columns."""

from pyspark.sql import functions as F

from partweave.functions import cells as C
from partweave.operators import diff as D
from partweave.operators import quote as Q
from partweave.operators import schema as H
from partweave.operators import words as W
from partweave.sources import records as R
from partweave.streaming import cache as S


def table(spark, rows):
    """-> headers, cells of tables {name: [header, row, ...]}; rows from 1"""
    head = [(t, c, n) for t, lines in rows.items() for c, n in enumerate(lines[0])]
    data = [(t, r, c, v) for t, lines in rows.items() for r, line in enumerate(lines[1:], 1) for c, v in enumerate(line)]
    return spark.createDataFrame(head, "t string, col int, name string"), spark.createDataFrame(data, "t string, row long, col int, value string")


def test_shapes(spark):
    wide, long = ["a", "b", "c", "d", "e", "f"], "x" * 60
    heads, cells = table(spark, {"good": [["Item", "Qty"], ["1", "2"]], "crammed": [wide, ["1", "2", "", None, " ", ""], ["3", "", "", "", "", ""]], "one": [wide[:4], [long, "", "", ""]], "short": [wide[:4], ["x", "", "", ""]]})
    assert {r["t"]: r["valid"] for r in H.shape_valid(cells, heads, ["t"]).collect()} == {"good": True, "crammed": False, "one": False, "short": True}


def test_repeated_headers(spark):
    heads, cells = table(spark, {"t": [["Item", "Part Number", "Qty", ""], ["1", "A", "2", ""], ["item", "PART NUMBER ", "qty", "x"], ["Item", "Part", "3", ""]]})
    assert {r["row"] for r in H.without_repeated_headers(cells, heads, ["t"]).collect()} == {1, 3}


def test_column_confidence(spark):
    heads, cells = table(spark, {"t": [["MPN", "Qty", "Manufacturer", "zzz"], ["AB-12", "1", "Bosch", "q"], ["CD-34", "many of them", "Hilti", "q"], ["EF-5", "3", "Wago", "q"]]})
    assert {r["col"]: (r["kind"], r["confidence"]) for r in H.column_confidence(heads, cells, ["t"]).collect()} == {0: ("mpn", 1.0), 1: ("qty", 0.67), 2: ("manufacturer", 0.0)}


def test_ocr_confidence(spark):
    w = spark.createDataFrame([("a", 90.0, 0.5), ("a", 70.0, 0.5), ("a", 69.0, 0.5), ("a", 10.0, 0.5), ("b", 99.0, 2.0)], "page string, conf double, h double")
    assert {r["page"]: r["confidence"] for r in W.confidence(w, ["page"], F.col("h")).collect()} == {"a": 0.7, "b": 1.0}


def test_tail_quantities(spark):
    rows = [("t", 1, "bolt Production 4", None), ("t", 2, "nut 12", None), ("t", 3, "pin", None), ("u", 1, "cap 5", None), ("u", 2, "a", None), ("u", 3, "b", None)]
    got = Q.tail_quantities(spark.createDataFrame(rows, "t string, row int, description string, qty string"), ["t"])
    assert {(r["t"], r["row"]): (r["description"], r["qty"]) for r in got.collect()} == {("t", 1): ("bolt", "4"), ("t", 2): ("nut", "12"), ("t", 3): ("pin", ""), ("u", 1): ("cap 5", None), ("u", 2): ("a", None), ("u", 3): ("b", None)}


def test_filled_cells_and_totals(spark):
    d = spark.createDataFrame([("t", 1, "A", "1"), ("t", 2, " ", None), ("t", 3, None, "2"), ("u", 1, "", "")], "t string, row int, item string, qty string")
    assert [tuple(r) for r in D.fill_merged(d, ["item", "qty"], ["t"], ["row"]).orderBy("t", "row").collect()] == [("t", 1, "A", "1"), ("t", 2, "A", "1"), ("t", 3, "A", "2"), ("u", 1, "", "")]
    q = spark.createDataFrame([("t", "0402 SMD resistor", "R1", "10"), ("t", "axial lead cap", "C2", ""), ("t", "QFN chip SMD", "U1", "2.5"), ("t", "label", "", "x")], "t string, description string, part string, qty string")
    r = Q.totals(q, ["t"]).first()
    assert (r["lines"], r["total"], r["smt"], r["fine"]) == (4, 14.5, 12.5, 2.5)


def test_recents_and_eviction(spark):
    rows = spark.createDataFrame([("diff", f"f{k % 9}", float(k)) for k in range(20)], "kind string, label string, ts double")
    assert [r["label"] for r in R.recents(rows).collect()] == ["f1", "f0", "f8", "f7", "f6", "f5", "f4", "f3"]
    assert [r["key"] for r in S.evict(spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 2.0)], "key string, ts double"), 2).collect()] == ["b", "c"]


def test_remembered_columns(spark):
    files = spark.createDataFrame([("acme_list-3.xlsx", ["MPN", "Qty"]), ("other.xlsx", ["MPN"])], "name string, columns array<string>")
    known = spark.createDataFrame([("ACME", "mpn", "MPN"), ("ACME", "qty", "Quantity")], "prefix string, role string, column string")
    assert [tuple(r) for r in H.remembered_mapping(files, known).collect()] == [("acme_list-3.xlsx", "mpn", "MPN")]


def test_repair_by_kind(spark):
    d = spark.createDataFrame([("qty", "1O.S"), ("item_number", "l2"), ("mpn", "4O7-AB"), ("description", "1O")], "k string, v string")
    assert [r[0] for r in d.select(C.ocr_repair("v", "k")).collect()] == ["10.5", "12", "407-AB", "1O"]
    t = spark.createDataFrame([("A12",), ("ab",), ("a b c",), ("1,2",), (None,)], "v string")
    assert [r[0] for r in t.select(C.layout_part("v")).collect()] == [True, False, False, False, False]
