"""Filled templates with tints, and standard columns: literal tables and awkward rows."""

from partweave.operators import export as E
from partweave.operators import standard as St


def cells(spark, sheets):
    rows = [(name, r, c, v) for name, grid in sheets.items() for r, line in enumerate(grid) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, "sheet string, row long, col int, value string")


TEMPLATE = {
    "a": [["ACME"], ["part number " * 6, "item"], [" Part Number ", "Qty", "QTY", "Ref Des", None], ["old", "1", "", "R9", "x"]],
    "b": [["x", "y"], ["1", "2"]],  # no header word: row 0
}
DATA = {"a": [["Desc", "MPN", "Qty", "Ref"], ["d1", "p1", "1", "R1"], [None, "", None, None], ["d2", " P2 ", "2", None], ["d3", None, "3", "R3"], ["d4", "p4", "4", "R4"], ["d5", "p4", "5", ""]], "b": [["MPN", "Qty"], ["q1", "1"]]}
NAMES = [("a", "mpn", "part number"), ("a", "qty", "QTY"), ("a", "refdes", "ref des "), ("a", "description", "Nothing"), ("b", "mpn", "X")]
DATA_NAMES = [("a", "mpn", "MPN"), ("a", "qty", "Qty"), ("a", "refdes", "Ref"), ("a", "description", "Desc"), ("b", "mpn", "MPN"), ("b", "qty", "qty")]
MAP = "sheet string, role string, name string"
CHANGES = "sheet string, part string, qty boolean, refdes boolean, description boolean, mpn_changed boolean, added boolean, removed boolean, source struct<mpn:string, qty:string, refdes:string, description:string>"


def test_header_rows(spark):
    t = cells(spark, {**TEMPLATE, "c": [["Desc", "Ref"], ["Part Number", "Qty"]], "d": [["item"], ["item", "loc"], ["loc", "part"]]})
    got = {s: {r["sheet"]: r["header_row"] for r in E.header_row(t, ["sheet"], s).collect()} for s in ("template", "data")}
    assert got["template"] == {"a": 2, "b": 0, "c": 0, "d": 1}
    assert got["data"] == {"a": 2, "b": 0, "c": 1, "d": 1}  # descriptions and designators weigh less in data


def test_fill_template(spark):
    none = (None,) * 4
    changes = [
        ("a", "P1", None, None, None, None, True, None, None), ("a", "p2 ", True, True, True, False, False, False, None), ("a", "P4", False, False, True, False, False, False, None), ("a", "P4", False, True, False, True, False, False, None),
        ("a", "Z2", False, False, False, False, False, True, ("z2", "", "R7", "d")), ("a", "Z1", False, False, False, False, False, True, ("z1", "9", None, None)), ("a", "Z0", False, False, False, False, False, True, None), ("zz", "P1", True, True, True, True, True, True, none),
    ]
    t, d = cells(spark, TEMPLATE), cells(spark, DATA)
    names, data_names = spark.createDataFrame(NAMES, MAP), spark.createDataFrame(DATA_NAMES, MAP)
    got = sorted(((r["sheet"], r["row"], r["col"]), (r["value"], r["tint"])) for r in E.fill_template(t, names, d, data_names, ["sheet"], spark.createDataFrame(changes, CHANGES)).collect())
    T = E.TINTS
    assert [v for k, v in got if k[:2] == ("a", 2)] == [(" Part Number ", None), ("Qty", None), ("QTY", None), ("Ref Des", None)]
    assert [(k[1], k[2], *v) for k, v in got if k[0] == "a" and k[1] > 2] == [
        (3, 0, "p1", T["added"]), (3, 2, "1", T["added"]), (3, 3, "R1", T["added"]),
        (4, 0, " P2 ", None), (4, 2, "2", T["qty"]), (4, 3, None, T["refdes"]),
        (5, 2, "3", None), (5, 3, "R3", None),
        (6, 0, "p4", T["mpn_changed"]), (6, 2, "4", T["mpn_changed"]), (6, 3, "R4", T["mpn_changed"]),
        (7, 0, "p4", T["mpn_changed"]), (7, 2, "5", T["mpn_changed"]), (7, 3, None, T["mpn_changed"]),
        (8, 0, "z1", T["removed"]), (8, 2, "9", T["removed"]), (8, 3, None, T["removed"]),
        (9, 0, "z2", T["removed"]), (9, 2, None, T["removed"]), (9, 3, "R7", T["removed"]),
    ]
    assert [(k[1], k[2], *v) for k, v in got if k[0] == "b"] == [(0, 0, "x", None), (0, 1, "y", None), (1, 0, "q1", None)]
    plain = E.fill_template(t, names, d, data_names, ["sheet"])
    assert plain.where("tint IS NOT NULL").count() == 0 and plain.where("sheet = 'a' AND row > 2").count() == 12
    assert E.fill_template(t.limit(0), names, d, data_names, ["sheet"]).count() == 0


def test_standard_rows(spark):
    heads = {"a": ["Mfg P/N", "Ref Des", "UOM"], "b": ["Item No", "Vendor Part No", "Qty"], "c": ["x", "y"]}
    body = {"a": [["A1 or B2", " R1 ", "EA"], ["  ", None, ""], ["", "R2", "EA"], ["C3", "", None]], "b": [["7", "V-1", "2"], ["8", None, "3"]], "c": [["1", "2"]]}
    headers = spark.createDataFrame([(s, c, n) for s, names in heads.items() for c, n in enumerate(names)], "sheet string, col int, name string").selectExpr("*", "0 AS header_row")
    below = cells(spark, body).selectExpr("sheet", "row + 1 AS row", "col", "value")
    got = {(r["sheet"], r["row"]): r.asDict() for r in St.standard_rows(headers, below, ["sheet"]).collect()}
    assert set(got) == {("a", 1), ("a", 4), ("b", 1)}
    assert got["a", 1] | {"sheet": 0, "row": 0} == dict(sheet=0, row=0, item_number="1", manufacturer="", mpn="A1 or B2", customer_pn="", vendor="", vendor_pn="", qty="1", uom="EA", refdes="R1", description="", alternates="B2")
    assert (got["a", 4]["item_number"], got["a", 4]["uom"], got["a", 4]["alternates"]) == ("3", "", "")  # the empty row goes before rows are numbered, the row without a part after
    assert (got["b", 1]["item_number"], got["b", 1]["mpn"], got["b", 1]["vendor_pn"], got["b", 1]["qty"], got["b", 1]["uom"]) == ("7", "V-1", "V-1", "2", None)
    assert [r[0] for r in St.without_parts(headers, below, ["sheet"]).collect()] == ["c"]
    assert St.standard_rows(headers.limit(0), below.limit(0), ["sheet"]).count() == 0
