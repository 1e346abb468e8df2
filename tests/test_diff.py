import random

import pytest

import __spark_entry__ as entry
from partweave.functions import similarity as S
from partweave.operators import components as G
from partweave.operators import diff as D
from partweave.operators import rename as R

CELLS = "mpn string, refdes string, qty string, description string, line int, comment string, manufacturer string, vendor string"


def revision(spark, *rows):
    return spark.createDataFrame([(*r, *[None] * (8 - len(r))) for r in rows], CELLS)


def test_statuses(spark):
    old = revision(spark, ("a1", "R1", "1 pcs", "x", 1), ("B2", "R2", "2", "y", 2), ("B2", "R9", "9", "z", 3), ("750R", None, None, None, 4), ("", "R", "1", "e", 5), (None, "R", "1", "e", 6, "Note 1"), ("NULL", "R", "1,000", "", 7, "n 2", "Acme"), ("m", "", "", "", 8, None, "Acme", "v"))
    new = revision(spark, ("\tA1 ", "r1", "1.0", "X", 1), ("B2", "R2", "3", "y", 2), ("D4", "R4", "1", "n", 4), ("750", "", None, "", 5), ("nan", "R", "1 ea", "e", 6, "note 1 "), (None, "r", "1000", "nan", 7, "N 2", "ACME"), ("M", "", "", "", 8, None, "Other", "V"))
    got = {r["k"]: (r["status"], r["qty_changed"], r["manufacturer_changed"]) for r in D.diff(old, new).collect()}
    assert got == {"A1": ("unchanged", False, False), "B2": ("modified", True, False), "750": ("unchanged", False, False), "D4": ("new", False, False), "COMMENT_NOTE 1": ("unchanged", False, False), "COMMENT_N 2": ("unchanged", False, False), "M": ("modified", False, True)}


def test_reclassify_and_figures(spark):
    old = revision(spark, ("a", "R1,R2", "1", "4.7uF", 1), ("b", "R1", "1", "big red bolt", 2), ("c", "R1", "1", "x", 3), ("d", "", "2", "", 4), ("c", "R1", "1", "x", 9), ("e", "", "1", "", 5, None, "M"))
    new = revision(spark, ("a", "R2 r1", "1 ea", "4.7µF", 1), ("b", "R1", "1", "washer of steel", 2), ("c", "R1", "1", "x", 3), ("z", "", "2", "", 4), ("e", "", "1", "", 5, None, "N"))
    rows = D.with_drift(D.reclassify(D.diff(old, new)))
    got = {r["k"]: (r["status"], r["reclassified"], r["description_drift"]) for r in rows.collect()}
    assert got == {"A": ("unchanged", True, False), "B": ("modified", False, True), "C": ("unchanged", False, False), "D": ("removed", False, False), "Z": ("new", False, False), "E": ("modified", False, False)}
    f = D.figures(rows, old, new).first().asDict()
    assert f == {"total_parts_file1": 5, "total_parts_file2": 5, "new_parts_count": 1, "removed_parts_count": 1, "modified_parts_count": 2, "unchanged_parts_count": 2, "unrecognized_parts_count": 0, "mpn_renamed_count": 0, "description_drift_count": 1, "duplicate_mpn_count": 1, "fuzzy_threshold": 0.88}
    assert D.match_rate(rows).first()[0] == 40


def test_aliases(spark):
    pairs = spark.createDataFrame([("a", "b"), ("B", "c "), ("x", "y"), ("s", "S"), ("", "q"), (None, "q"), ("p", "x")], "mpn_a string, mpn_b string")
    names = {r.mpn: r.canon for r in G.canonical_names(pairs).collect()}
    assert names == {"A": "A", "B": "A", "C": "A", "X": "P", "Y": "P", "P": "P"}
    old = revision(spark, ("c", "", "1", "", 1), ("b", "", "1", "", 2), ("w", "", "1", "", 3))
    new = revision(spark, ("a", "", "2", "", 7), ("v", "", "1", "", 8))
    rows = D.fold_aliases(D.diff(old, new), G.canonical_names(pairs)).collect()
    assert {(r["k"], r["status"], r["new_mpn"], r["alias_match"]) for r in rows} == {("C", "modified", "a", True), ("B", "removed", None, False), ("W", "removed", None, False), ("V", "new", "v", False)}
    assert G.components(pairs.limit(0).toDF("a", "b")).count() == 0


def test_similarity():
    cases = [("BC547", "BC548", 0.8), ("BC547", "BC547BTA", 0.9), ("", "a", 0.0), ("AB", "AB", 1.0), ("A" * 2, "A" * 40, 0.6)]
    assert [round(S.weighted(a, b), 6) for a, b, _ in cases] == [w for *_, w in cases]
    assert S.token_set("bolt red", "red bolt x") == 1 and S.token_set("", "x") == 0 and S.loose("A-1", "a1") == 1 and S.partial("bcd", "abcde") == 1


@pytest.mark.parametrize("threshold", [0.88, 0.8, 0.95, 0.5, 0.65])
def test_renames_equal_all_pairs(spark, threshold):
    rng = random.Random(5)
    a = {"".join(rng.choice("AB12") for _ in range(rng.choice((1, 2, 3, 5, 7, 9, 12, 14, 18, 25, 40)))) for _ in range(70)}
    b = set()
    for x in sorted(a):
        y = list(x)
        for _ in range(rng.choice((0, 1, 1, 2, 3))):
            y.insert(rng.randrange(len(y) + 1), rng.choice("AB1XY")) if rng.random() < 0.6 else y.pop() if len(y) > 1 else None
        b.add("".join(y) + "XYZ" * rng.choice((0, 0, 0, 1, 3)))
    keys = lambda s: spark.createDataFrame([(x,) for x in sorted(s)], "k string")
    used, want = set(), set()
    for x in sorted(a):
        best = min(((-S.weighted(x, y), y) for y in b if y not in used and S.weighted(x, y) >= threshold), default=None)
        if best:
            used.add(best[1])
            want.add((x, best[1]))
    assert {(r.old_k, r.new_k) for r in R.rename_pairs(keys(a), keys(b), threshold).collect()} == want


def test_rejected_renames(spark):
    keys = lambda *s: spark.createDataFrame([(x,) for x in s], "k string")
    no = spark.createDataFrame([("AB-1234567", "ab1234567 ")], "a string, b string")
    got = R.rename_pairs(keys("AB-1234567", "COMMENT_X", "ZZ99"), keys("AB1234567", "AB12345678", "COMMENT_X"), rejected=no).collect()
    assert got == []  # the best match is refused, so there is none
    assert R.rename_pairs(keys(), keys("A"), 0.9).count() == 0


def test_empty_and_duplicates(spark):
    none = revision(spark)
    assert D.diff(none, none).count() == 0 and D.match_rate(D.diff(none, none)).first()[0] == 0
    rows = revision(spark, ("a", "", "1", "", 7), ("A ", "", "1", "", 3), ("b", "", "1", "", 1), (None, "", "1", "", 8, "x"), (None, "", "1", "", 9, "x"))
    assert [tuple(r) for r in D.duplicates(rows).collect()] == [("A", 2, 3, 7)]
    assert sorted(tuple(r) for r in D.duplicate_lines(rows).collect()) == [("A", 3), ("A", 7)]


def test_entry(spark):
    assert {r["status"] for r in entry.entry(spark).collect()} <= {"new", "removed", "modified", "unchanged"}


def test_rename_pairs_of_like_numbers_meet_only_where_they_reach_the_threshold(spark):
    """Long part numbers that share most of their runs are no candidates unless enough characters are common; none is missing."""
    import math
    import random

    from partweave.functions import similarity as S
    from partweave.operators import rename as R

    draw = random.Random(5)
    old = sorted({f"BRAND1{draw.randrange(10)}{draw.randrange(10**6):06d}" + draw.choice(["", "TR"]) for _ in range(60)})
    new = sorted({x[: k % len(x)] + draw.choice("0159A") + x[k % len(x) + draw.randrange(2) :] for k, x in enumerate(old)} | {f"BRAND1{draw.randrange(10)}{draw.randrange(10**6):06d}TR" for _ in range(60)})
    got = R.candidates(*(spark.createDataFrame([(x,) for x in side], "canon string") for side in (old, new)), 0.88).collect()
    pairs = {(r["x"], r["y"]) for r in got}
    assert len(pairs) == len(got)
    assert pairs == {(a, b) for a in old for b in new if S.common(a, b) >= math.ceil(0.88 * (len(a) + len(b)) / 2 - 1e-9)}
    assert {p for p in pairs if S.weighted(*p) >= 0.88} == {(a, b) for a in old for b in new if S.weighted(a, b) >= 0.88}
