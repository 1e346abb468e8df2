"""Tables without lines in pictures: header words that grow, header lines, cells."""

from partweave.operators import ocr as O

SCHEMA = "doc string, text string, left int, top int, width int, height int, conf double"


def words(spark, rows):
    return spark.createDataFrame([(d, t, x, y, 6 * len(t), h, 90.0) for d, t, x, y, h in rows], SCHEMA)


def test_header_words_grow(spark):
    w = words(spark, [("a", "Part", 0, 0, 10), ("a", "No", 34, 0, 10), ("a", "of", 56, 0, 30), ("a", "Maker", 89, 0, 10), ("a", "Qty", 200, 0, 10), ("b", "One", 5, 0, 10)])
    got = [tuple(r) for r in O.merge_header(w.select("doc", "text", "left", "width", "height"), ["doc"]).orderBy("doc", "left").collect()]
    # 10 < 11 joins; then the joined height is 30, so a gap of 21 joins where two of 10 would stay apart
    assert got == [("a", "Part No of Maker", 0, 119), ("a", "Qty", 200, 18), ("b", "One", 5, 18)]


def test_borderless(spark):
    page = [("p", "List", 0, 0, 12), ("p", "Part", 0, 30, 12), ("p", "Number", 30, 32, 12), ("p", "Qty", 200, 30, 12), ("p", "AB-1O2", 0, 60, 12), ("p", "l2", 200, 61, 12), ("p", "CD-7", 0, 90, 12), ("p", "CD-7", 0, 90, 12), ("p", "S", 204, 92, 12)]
    plain = [("q", "just", 0, 0, 12), ("q", "two", 100, 1, 12), ("q", "x1", 0, 40, 12), ("r", "alone", 0, 0, 12)]
    got = {}
    for r in O.borderless_table(words(spark, page + plain), ["doc"]).collect():
        got[r["doc"], r["row"], r["name"]] = (r["text"], r["confidence"])
    assert got == {
        ("p", 1, "Part Number"): ("AB-102", 0.88), ("p", 1, "Qty"): ("12", 0.88), ("p", 2, "Part Number"): ("CD-7 CD-7", 0.88), ("p", 2, "Qty"): ("5", 0.88),
        ("q", 1, "just"): ("x1", 0.79),
    }
    assert O.borderless_table(words(spark, page).limit(0), ["doc"]).count() == 0
