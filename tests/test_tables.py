"""Hand-made tables of expected values for cells, schemas, words, stores and state."""

import time

import pytest
from pyspark.sql import functions as F

from partweave.functions import cells as C
from partweave.operators import quote as Q
from partweave.operators import schema as H
from partweave.operators import words as W
from partweave.sources import records as R
from partweave.streaming import cache as S


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", fn("v").alias("x")).orderBy("i").collect()]


join = lambda f: lambda c: F.array_join(f(c), "+")
pair = lambda f, *names: lambda c: F.concat_ws("+", *[f(c)[n] for n in names])


@pytest.mark.parametrize(
    ("fn", "cases"),
    [
        (C.engineering_value, {"750R": "750", "750 ohm": "750", "4.7uF": "0.0000047", "4.7µF": "0.0000047", "10k": "10000", "10K": "10K", "5%": "5%", "5 %": "5%", "1 ea": "1", "100mA": "100MA", "0402": "0402", "10pF": "0", "4u7": "4U7", "2meg": "2000000", "n/a": "", "--": "", None: "", "abc": "ABC"}),
        (join(C.alternates), {"BC547 / 2N3904": "BC547+2N3904", "A1B or C2D": "A1B+C2D", "BC547, 2N3904": "BC547+2N3904", "R1, x": "R1, x", "a\nb;c|d//e": "a+b+c+d+e", "LM7805/T": "LM7805/T", "": "", None: ""}),
        (C.part_like, {"MOLEX": True, "100": True, "ab": False, "a b": True, "-x1": False, None: False}),
        (C.real_part, {"3.00": False, "12345": True, "2-52": True, "AB1": True, None: False}),
        (C.refdes_like, {"R1, R2": True, "C1-C5": True, "x": False, ",": False, None: False}),
        (C.qty_like, {"10": True, "1,5k": True, "12345678901": False, "x": False, None: False}),
        (C.mounting, {"Cap 0402": "SMT", "DIP-8": "TH", "PCB SMT": "", "wire": "", None: ""}),
        (C.clean_part, {"305247H03 2 3 R 4 [": "305247H03", 'X1 7.00" Y2': "X1 Y2", None: ""}),
        (C.clean_qty, {"2.00": "2", "2.50": "2.5", "1 9 10": "1", '50.00"': '50.00"', "x": "x", "a b": "", "0.25": "0.25", "007": "7", None: ""}),
        (C.clean_maker, {'1 4 7.00" BK 7': "BK", "T & B": "T & B", "3M": "3M", "12": "", None: ""}),
        (C.once, {"Big Bolt big bolt": "Big Bolt", "a b": "a b", "x": "x", None: ""}),
        (pair(C.tail_quantity, "qty", "text"), {"CLEAR 1.5 6 7 4": "1.5+CLEAR", "bolt 12": "+bolt 12", None: "+"}),
        (pair(lambda c: C.tail_quantity(c, short=True), "qty", "text"), {"bolt 12": "12+bolt", "a b c d 12": "+a b c d 12", "bolt 0805": "+bolt 0805", "10": "10+"}),
        (pair(C.lifecycle_quantity, "qty", "text"), {"res 1% Production 4": "4+res 1%", "res 4": "4+res", "res": "+res"}),
        (pair(lambda c: C.split_glued_maker(c, F.lit("")), "maker", "part"), {"HIROSE MDF6-14": "HIROSE+MDF6-14", "T & B": "T & B+", "AMP": "AMP+", "Rohm CAL-CHIP": "Rohm CAL-CHIP+", "3M X1": "3M X1+", "A B1C C2D": "A+B1C C2D"}),
        (pair(lambda c: C.split_bled_words(c, F.lit("box")), "part", "description"), {"173-01 CARTON,": "173-01+CARTON, box", "30H C06": "30H C06+box", "USER X": "USER X+box"}),
        (pair(C.split_maker, "maker", "description"), {"MOLEX HOUSING": "MOLEX+HOUSING", "Housing": "+Housing", "TE": "TE+TE"}),
        (C.category, {"Acme Part # for LEDs": "LED", "LED resistor": None, "Qty": None, None: None}),
        (C.header_maker, {"All Electronics Part # for LED": "All Electronics", "LED part": "", "Part": ""}),
        (C.ocr_part, {"BC54O7": "BC5407", "1OO2": "1OO2", "O1": "O1", "1O2S3": "10253", "": "", None: ""}),
        (C.row_key, {"a": "A", "nan": "", "4.7r": "4.7"}),
        (C.quantity_text, {"1,000": "1000", "10 pcs": "10", "2.50": "2.5", "x": "x", None: "", "nan": ""}),
        (C.plain_quantity, {"10.0": "10", "10 pcs": "10 pcs", "1,000": "1,000", None: ""}),
        (C.age, {"0.2": "1s ago", "59": "59s ago", "61": "1m ago", "7300": "2h ago", "172800": "2d ago"}),
        (C.salvaged_json, {'x {"a": {}} y': '{"a": {}}', "none": None}),
        (C.customer_prefix, {"acme-1_x": "ACME", "a" * 30: "A" * 24}),
        (C.file_format, {"a.DOCX": "word", "b.pdf": "excel", None: "excel"}),
        (C.csv_cell, {'a"b': '"a""b"', None: '""'}),
        (C.shown_quantity, {"2.50": "2.5", "N/A": "", " x ": "x", "3.0": "3"}),
        (C.label, {"SHRINK TUBING": True, "PN 123 abcd": False, "a1b": False}),
        (join(lambda c: C.wide_split(c, 3)), {"a  b c  d": "a+b c+d", "a": "a++", "a  b  c  d": "a+b+c d"}),
        (join(lambda c: C.slices(c, [0, 3])), {"ab cd": "ab+cd", "": "+"}),
        (H.kind, {"Mfg P/N": "mpn", "Item #": "item_number", "Quantiy": "qty", "zzz": None, "": None, "Vendor Part": "vendor_pn"}),
    ],
)
def test_cells(spark, fn, cases):
    assert dict(zip(cases, apply(spark, fn, cases), strict=True)) == cases


def headers(spark, *names):
    return spark.createDataFrame([("t", i, n) for i, n in enumerate(names)], "doc string, col int, name string")


def test_roles_and_picks(spark):
    got = {r.role: r.col for r in H.roles(headers(spark, "Ref Des", "Qty", "Vendor P/N", "MPN", "Notes"), ["doc"]).collect()}
    assert got == {"refdes": 0, "qty": 1, "mpn": 3, "description": 4}
    assert {r.role: r.col for r in H.roles(headers(spark, "x", "Manufacturer"), ["doc"]).collect()} == {"mpn": 1}
    h = headers(spark, "P/N", "MFG P/N", "Component")
    cells = spark.createDataFrame([("t", r, c, v) for r in range(3) for c, v in enumerate((f"03-{r}1", f"AB{r}", str(r + 1)))], "doc string, row int, col int, value string")
    picked = {r.kind: r.col for r in H.pick_columns(h, cells, ["doc"]).collect()}
    assert picked["mpn"] == 1 and picked["customer_pn"] == 0
    assert H.recover_qty(h, cells, ["doc"], H.pick_columns(h, cells, ["doc"]).where("kind IN ('mpn', 'customer_pn')")).first().col == 2
    assert H.item_source(h, cells, ["doc"], H.pick_columns(h, cells, ["doc"])).first().col == 0
    assert H.best_column(h, cells, ["doc"], "mpn").first().col in (0, 1)
    assert H.headers_match(h, headers(spark, "p/n", "MFG P/N ", "component"), ["doc"]).first().same
    assert not H.headers_match(h, headers(spark, "p/n", "MFG P/N"), ["doc"]).first().same


def test_quote_rows(spark):
    rows = spark.createDataFrame([("t", 1, "", "RESISTOR 10k", "HIROSE MDF6-14", "", ""), ("t", 2, None, "RRJJ 44", "", "", ""), ("t", 3, "7-1 CARTON", "box", "BK", "", "1 9"), ("t", 4, "", "1.5", "", "3.00", "")], "doc string, row int, item string, description string, maker string, part string, qty string")
    got = [tuple(r) for r in Q.clean_rows(rows, ["doc"]).orderBy("line").collect()]
    assert got == [("t", 1, "", "RESISTOR 10k", "HIROSE", "MDF6-14", ""), ("t", 2, "7-1", "CARTON box", "BK", "", "1")]
    bare = spark.createDataFrame([("t", 1, "i", "a", "m", "P1", ""), ("t", 2, "j", "b", "m", "P1", ""), ("t", 3, "k", "c", "m", "", ""), ("t", 4, "l", "d", "m", "", "")], "doc string, row int, item string, description string, maker string, part string, qty string")
    assert [(r.item, r.qty) for r in Q.merge_placements(bare, ["doc"]).orderBy("row").collect()] == [("i", "2"), ("k", "1"), ("l", "1")]
    s = spark.createDataFrame([("44", "12 3", "", "x y"), ("bolt", "Acme", "", "1"), ("CABLE", "T X-12", "AB1", "2")], "description string, maker string, part string, qty string")
    assert sorted(",".join(r.suspect) for r in Q.suspects(s).collect()) == ["description,maker,qty", "maker", "part"]


def test_generic_table(spark):
    head = [("ITEM", 10, 0), ("PART", 60, 0), ("NUMBER", 90, 0), ("DESCRIPTION", 200, 0), ("QTY", 300, 0)]
    rows = [(str(k), 10, 20 * k) for k in (1, 2, 3)] + [(f"P-{k}", 62, 20 * k) for k in (1, 2, 3)] + [("bolt", 200, 20), ("m4", 225, 20), ("nut", 200, 41), ("long", 200, 60), ("text", 200, 67), ("4 ea".split()[0], 300, 20), ("7", 12, 30), ("UNLESS", 200, 75)]
    words = spark.createDataFrame([(1, t, float(x), float(x + 5 * len(t)), float(y), float(y + 8)) for t, x, y in head + rows] + [(2, "x", 1.0, 2.0, 3.0, 4.0)], "page int, text string, x0 double, x1 double, top double, bottom double")
    got = {(r.row, r.name): r.text for r in W.generic_table(words, ["page"]).collect()}
    assert got[1, "ITEM"] == "1" and got[1, "DESCRIPTION"] == "bolt m4" and got[3, "DESCRIPTION"] == "long text" and got[1, "QTY"] == "4" and got[2, "PART NUMBER"] == "P-2"


def test_folds(spark):
    w = spark.createDataFrame([("p", t, x, y, 10, 10) for t, x, y in (("a", 0, 0), ("b", 20, 7), ("c", 0, 9), ("d", 0, 30))], "page string, text string, left int, top int, width int, height int")
    assert {r.text: r.line for r in W.group_lines(w, ["page"]).collect()} == {"a": 0, "b": 0, "c": 1, "d": 2}
    v = spark.createDataFrame([("p", x) for x in (0, 6, 12, 40)], "page string, y int")
    assert sorted(r.at for r in W.merge_near(v, ["page"], "y").collect()) == [3, 12, 40]
    e = spark.createDataFrame([("k", float(t), i) for i, t in enumerate((0, 100, 3600, 3601, 7201, 7202))], "key string, ts double, id long")
    assert [r.hit for r in S.hits(e).orderBy("id").collect()] == [False, True, True, False, True, False]


def test_stores(spark, tmp_path):
    d = tmp_path / "r"
    d.mkdir()
    (d / "a.json").write_text('{"id": "1", "ts": 5, "sha": "x",\n"filename": "a.docx"}')
    (d / "b.json").write_text("{broken")
    (d / "c.json").write_text('{"id": "2", "ts": 7, "sha": "x"}')
    store = R.json_files(spark, str(d), R.CONVERSION)
    assert sorted(r.id for r in store.where("id IS NOT NULL").collect()) == ["1", "2"]
    assert [r.id for r in R.upsert(store.where("id = '1'"), store.where("id = '2'")).collect()] == ["2"]
    assert R.listing(store.where("id = '1'")).first().format == "word"
    (tmp_path / "a.csv").write_text('mpn_a,mpn_b,note\n"a,1","b""2",n\nc,C,\n')
    pairs = R.alias_csv(spark, str(tmp_path / "a.csv"))
    assert sorted((r.mpn_a, r.mpn_b) for r in R.add_aliases(pairs.limit(0), pairs).collect()) == [("A,1", 'B"2')]
    assert tuple(R.import_counts(pairs).first()) == (1, 1)
    assert R.remove_aliases(spark.createDataFrame([("A", "B"), ("B", "C")], "mpn_a string, mpn_b string"), spark.createDataFrame([("b", "a")], "mpn_a string, mpn_b string")).collect()[0].mpn_b == "C"
    log = str(tmp_path / "log")
    R.append_events(spark.createDataFrame([(None, None, "diff", None, None, None), ("e", "2020-01-01T00:00:00", "x", None, None, None)], R.EVENT), log)
    assert [r.kind for r in R.audit_log(spark, log).collect()] == ["diff", "x"]
    p = R.preview(spark.range(5), ["id"], 2).first()
    assert (list(p.rows), p.total, p.truncated) == (['{"id":0}', '{"id":1}'], 5, True)


def test_stream_cache(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.createDataFrame([("k", 0.0, 0), ("k", 100.0, 1), ("k", 3601.0, 2), ("j", 5.0, 3)], "key string, ts double, id long").coalesce(1).write.parquet(src)
    q = S.stream_hits(spark.readStream.schema("key string, ts double, id long").parquet(src)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).start(out)
    until = time.time() + 120
    while time.time() < until and not (tmp_path / "out" / "_spark_metadata" / "0").exists():  # timeouts by the clock keep the query alive
        time.sleep(0.5)
    q.stop()
    assert {r.id: r.hit for r in spark.read.parquet(out).collect()} == {0: False, 1: True, 2: False, 3: False}


def test_callouts(spark):
    from partweave.operators.callouts import callouts

    lines = [
        "MOLEX HOUSING PN# 0009508040 X2", "4 POSITION HOUSING", "MOLEX PN 39-01-2040", "Molex#0009520071 X8", "TERMINAL BLOCK PN:", "", "1776244-2 x3", "SHRINK TUBING, 3/4 DIA", "230-0018-001 X4",
        "CABLE TIE BLACK x5 MOLEX PN# 0009508040", "1  YELLOW  24 AWG  REQUEST", "W2 HARNESS ASSY", "500-0153-000",
    ]
    d = spark.createDataFrame([("d", i, t) for i, t in enumerate(lines)] + [("e", 0, None)], "doc string, line int, text string")
    got = {r.part or r.description: (r.description, r.qty, r.maker) for r in callouts(d, ["doc"]).collect()}
    assert got["0009508040"] == ("MOLEX HOUSING", "2", "MOLEX") and got["39-01-2040"] == ("4 POSITION HOUSING", "1", "MOLEX")
    assert got["0009520071"][1:] == ("8", "Molex") and got["1776244-2"] == ("TERMINAL BLOCK", "3", "")
    assert got["230-0018-001"] == ("SHRINK TUBING, 3/4 DIA", "4", "") and got["Wire, YELLOW, 24 AWG, REQUEST"][1] == "1"
    assert "CABLE TIE BLACK x5" in got or "CABLE TIE BLACK" in str(got)


def test_grid(spark):
    w = spark.createDataFrame([("p", "a", 0, 0, 10, 8), ("p", "b", 20, 1, 10, 8), ("p", "|", 45, 0, 2, 8), ("p", "c", 60, 30, 10, 8), ("p", "out", 500, 0, 5, 5)], "page string, text string, left int, top int, width int, height int")
    rows = spark.createDataFrame([("p", 0, 0, 20), ("p", 1, 20, 40)], "page string, row int, lo int, hi int")
    cols = spark.createDataFrame([("p", 0, 0, 50), ("p", 1, 50, 100)], "page string, col int, lo int, hi int")
    got = {(r.row, r.col): r.text for r in W.grid_cells(W.to_grid(w, rows, cols, ["page"]), ["page"]).collect()}
    assert got == {(0, 0): "a b", (1, 1): "c"}
    h = W.header_bounds(spark.createDataFrame([("p", "Item", 10, 20), ("p", "Qty", 60, 20)], "page string, text string, left int, width int"), ["page"])
    assert [tuple(r) for r in h.orderBy("col").collect()] == [("p", 0, "Item", 0, 45), ("p", 1, "Qty", 45, 10**9)]
    assert W.tiles(spark.createDataFrame([("p", 2000, 900)], "page string, width int, height int"), ["page"]).count() == 2
