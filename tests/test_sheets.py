"""Raw cells of several sheets to logical rows: header, roles, samples, chosen columns, lines."""

import pytest

from partweave.operators import diff as D
from partweave.sources import sheets as S


def cells(spark, sheets):
    rows = [(name, r, c, v) for name, grid in sheets.items() for r, line in enumerate(grid) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, "sheet string, row long, col int, value string")


TITLED = [["ACME", None], ["Drawing 12"], [""], ["   "], ["Item #", "Manufacturer", "Mfg P/N", "Qty.", "Ref Des", "Comments"], ["1", "Bosch", "0123.0", "2", "R1", "n/a"], ["", "", "", "", "", ""], ["2", None, "B-7", "", None, "x"]]
BARE = [["x", "y"], ["1", "2"], ["3", "4"], ["5", "6"]]
SPARSE = [["Part Number", "Qty", "Description", "Item"], ["A1", "1", "none", "bolt"], ["A2", "2", "n/a", "nut"], ["A3", "3", "", "pin"]]
ADOPTED = [["MPN", "Qty", "Material kind"], ["A1", "1", "none"], ["A2", "2", ""], ["A3", "3", "n/a"], ["A4", "4", "steel"]]
SECOND = [["MPN", "Qty", "Item kind", "Material"], ["A1", "1", "nan", None], ["A2", "2", "n/a", None], ["A3", "3", "None", "steel"]]


@pytest.fixture(scope="module")
def sheets(spark):
    return cells(spark, {"titled": TITLED, "bare": BARE, "sparse": SPARSE, "adopted": ADOPTED, "second": SECOND, "none": [[None, ""]]})


def test_profile(sheets):
    got = {}
    for r in S.profile(sheets, ["sheet"]).collect():
        got.setdefault(r["sheet"], {"header": r["header_row"]})[r["role"]] = r["col"]
    assert got["titled"] == {"header": 4, "mpn": 2, "qty": 3, "refdes": 4, "description": 5, "manufacturer": 1}
    assert "bare" not in got and "none" not in got
    assert got["sparse"] == {"header": 0, "mpn": 0, "qty": 1}  # two values without meaning: dropped, and no other is taken
    assert got["adopted"] == {"header": 0, "mpn": 0, "qty": 1, "description": 2}  # the third of its values means something
    assert got["second"] == {"header": 0, "mpn": 0, "qty": 1, "description": 3}  # the first fitting name has no meaning


def test_logical_rows(sheets):
    rows = S.logical_rows(sheets, S.profile(sheets, ["sheet"]), ["sheet"])
    got = sorted(tuple(r) for r in rows.where("sheet = 'titled'").collect())
    assert got == [("titled", 2, "0123.0", "2", "R1", "n/a", None, "Bosch", None), ("titled", 4, "B-7", None, None, "x", None, None, None)]
    assert rows.where("sheet = 'bare'").count() == 0


def test_chosen_columns(spark, sheets):
    chosen = spark.createDataFrame([("titled", "mpn", "Mfg P/N"), ("titled", "qty", "Qty."), ("titled", "description", "Nothing"), ("sparse", "qty", "Qty")], "sheet string, role string, name string")
    rows = S.logical_rows(sheets, S.chosen_profile(sheets, chosen, ["sheet"]), ["sheet"], sheet_lines=True, unmapped="N/A")
    assert sorted(tuple(r)[:6] for r in rows.collect()) == [("titled", 6, "0123.0", "2", "N/A", "N/A"), ("titled", 8, "B-7", None, "N/A", "N/A")]
    got = {(r["sheet"], r["role"], r["name"]): r["available"] for r in S.mapping_problems(sheets, chosen, ["sheet"]).collect()}
    assert got[("titled", "description", "Nothing")] == ["Item #", "Manufacturer", "Mfg P/N", "Qty.", "Ref Des", "Comments"]
    assert got[("sparse", "mpn", None)] == ["Part Number", "Qty", "Description", "Item"] and ("titled", "mpn", None) not in got


def test_empty(spark, sheets):
    none = sheets.limit(0)
    assert S.profile(none, ["sheet"]).count() == 0 and S.logical_rows(none, S.profile(none, ["sheet"]), ["sheet"]).count() == 0


def test_manual_comparison(spark):
    schema = "mpn string, qty string, refdes string, description string, comment string, manufacturer string, line long"
    old = spark.createDataFrame([("A1", "10", "R1", "d", "", "M", 5), ("A2", "1", "r2", "d", "", "M", 6), ("A3", "1.0", "", "x", "", "M", 7), ("", "1", "", "", "note", "", 8), ("A1", "99", "", "", "", "", 9)], schema)
    new = spark.createDataFrame([("a1", "10 pcs", "R1", "d", "", "M", 4), ("A2", "1.00", "R2", "D", "", "other", 6), ("A4", "1", "", "", "", "", 7)], schema)
    rows = D.manual_diff(old, new)
    assert {r["k"]: (r["status"], r["old_line"], r["new_line"]) for r in rows.collect()} == {"A1": ("modified", 5, 4), "A2": ("unchanged", 6, 6), "A3": ("removed", 7, None), "A4": ("new", None, 7)}
    assert D.manual_figures(rows).first().asDict() == {
        "total_parts_file1": 3, "total_parts_file2": 3, "new_parts_count": 1, "removed_parts_count": 1, "modified_parts_count": 1, "unchanged_parts_count": 1,
        "unrecognized_parts_count": 0, "mpn_renamed_count": 0, "fuzzy_threshold": 0.88,
    }
