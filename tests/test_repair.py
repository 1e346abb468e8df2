"""Repair by a second reading: candidates against all pairs, matches, actions, repaired rows."""

import difflib
import random
import re

from partweave.operators import repair as R

SCHEMA = "doc string, line long, item string, description string, maker string, part string, qty string"


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


def test_alike_equals_all_pairs(spark):
    rng = random.Random(6)
    words = ["bolt", "nut", "resistor", "cap", "m3", "m5", "10k", "steel", "long", "wire", "xx", "q"]
    texts = {"".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(90)} | {"", "a", "ab", "ba", "aaaa", "aaab", "abcdefghij", "axbxcxdxex", "z" * 40, "z" * 16}
    left, right = sorted(texts)[::2], sorted(texts)[1::2] + ["", "abcdefghij"]
    a = spark.createDataFrame([("d", t) for t in left] + [("e", "bolt")], "doc string, x string")
    b = spark.createDataFrame([("d", t) for t in set(right)] + [("f", "bolt")], "doc string, y string")
    got = {(r["x"], r["y"]) for r in R.alike(a, b, ["doc"]).collect()}
    assert got == {(x, y) for x in left for y in set(right) if ratio(x, y) >= 0.6}


def rows(spark, values):
    return spark.createDataFrame(values, SCHEMA)


def test_report_and_repair(spark):
    own = [
        ("t", 1, "1", "bolt M3", "ACME", "??", "2"), ("t", 2, "I 2", "nut", "ACME XY12", "N-2", "2"), ("t", 3, "", "resistor 0402 10k", "Vishay", "", "many of them"), ("t", 4, None, "### 77", None, "P-4", "1"),
        ("t", 5, "9", "pin", "77", "P-5", "1"), ("t", 6, "6", "cable", "ACME", "", "1"), ("t", 7, "", None, "12", "P-7", "1"), ("sure", 1, "1", "x", "M", "??", "1"), ("alone", 1, "1", "x", "M", "??", "1"), ("alone", 2, "1", "x", "M", "??", "1"),
    ]
    other = [("t", 11, "1.", "BOLT", "ACME", "B-1", "2"), ("t", 12, "i2", "nut", "Acme", "N-2", "2"), ("t", 13, "x1", "Resistor 10k, 0402", "Vishay", "RC0402", "4"), ("t", 14, "1", "late", "L", "L-9", "9"), ("t", 15, "x2", "???", "Bosch", "P-4", "1"), ("sure", 1, "1", "x", "M", "A-1", "1")]
    confidence = spark.createDataFrame([("t", 0.9), ("sure", 0.85)], "doc string, confidence double")
    rep = R.report(rows(spark, own), rows(spark, other), confidence, ["doc"])
    got = {(r["doc"], r["line"], r["field"]): (r["own"], r["other"], r["action"]) for r in rep.collect()}
    norm = lambda s: re.sub("[^a-z0-9]", "", s.lower())
    assert ratio(norm("resistor 0402 10k"), norm("Resistor 10k, 0402")) >= 0.6
    assert got == {
        ("t", 1, "part"): ("??", "B-1", "changed"), ("t", 2, "maker"): ("ACME XY12", "Acme", "changed"), ("t", 3, "part"): ("", "RC0402", "changed"), ("t", 3, "qty"): ("many of them", "4", "changed"),
        ("t", 4, "description"): ("### 77", None, "unmatched"), ("t", 5, "maker"): ("77", None, "unmatched"), ("t", 7, "maker"): ("12", None, "unmatched"),
    }
    fixed = {(r["doc"], r["line"]): r for r in R.repaired(rows(spark, own), rep, ["doc"]).collect()}
    assert fixed["t", 3]["part"] == "RC0402" and fixed["t", 3]["qty"] == "4" and fixed["t", 3]["changed"] and not fixed["t", 5]["changed"] and fixed["sure", 1]["part"] == "??" and len(fixed) == len(own)
    none = rows(spark, [])
    assert R.report(none, none, confidence, ["doc"]).count() == 0


def test_rows_with_an_equal_text_are_not_compared_with_others(spark, monkeypatch):
    from partweave.operators import repair as R

    seen = []
    real = R.alike
    monkeypatch.setattr(R, "alike", lambda left, right, by: seen.extend((r["x"] for r in left.collect())) or real(left, right, by))
    rows = "doc string, line int, item string, description string"
    own = spark.createDataFrame([("t", k, "", f"cold bolt {k}") for k in range(20)] + [("t", 20, "", "hot plate 7x"), ("u", 1, "", "cold bolt 3")], rows)
    other = spark.createDataFrame([("t", 100 - k, "", f"COLD bolt, {k}.") for k in range(20)] + [("t", 101, "", "cold-bolt 4"), ("t", 102, "", "hot plate 7"), ("u", 5, "", "cold bolt 33")], rows)
    got = {(r["doc"], r["line"]): r["other"] for r in R.matches(own, other, ["doc"]).collect()}
    assert got == {**{("t", k): 100 - k for k in range(20)}, ("t", 20): 102, ("u", 1): 5}
    assert sorted(seen) == ["coldbolt3", "hotplate7x"]
