"""Findings of round 3: texts dealt by their size, lines cut once, names that come with the cells."""

from partweave.operators import textlines as X
from partweave.plans import tables as T


def lines(spark):
    rows = ["Item    Mfg Part Number   Description   Qty", *(f"{k}       PN{k}-77            bolt a{k}       {k}" for k in range(1, 8))]
    return spark.createDataFrame([(d, k, t) for d in (1, 2) for k, t in enumerate(rows)], "doc int, line int, text string")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_dealt_by_their_size(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(k, f"{k} " * 5000) for k in range(50)], "doc_id long, text string").repartition(2).write.option("compression", "none").parquet(f"{tmp_path}/documents.parquet")
    assert T.by_document(spark, str(tmp_path)).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(T, "DEALT", 500)
    few = T.by_document(spark, str(tmp_path))
    assert few.rdd.getNumPartitions() > 8 and few.count() == 50


def test_wide_cells_meet_their_names_without_a_join(spark):
    got = X.wide_table(lines(spark), ["doc"])
    assert {r["name"] for r in got.collect()} == {"Item", "Mfg", "Description", "Qty"} and got.count() == 56
    assert plan(got).count("Join ") == 1


def test_text_cells_are_cut_once_a_row(spark):
    got = X.text_table(lines(spark), ["doc"])
    assert {(r["row"], r["name"], r["text"]) for r in got.where("doc = 1 AND row = 3").collect()} == {(3, "Item", "3"), (3, "Mfg Part Number", "PN3-77"), (3, "Description", "bolt a3"), (3, "Qty", "3")}
    assert plan(got).count("arrays_zip(") == 1
