"""The pipeline's stages against plain versions, with repeated and null ids."""

import random
import re
import zlib

import numpy as np
import public_tokenizers

import corpus_pipeline as pipeline
from partweave.llm.op02_secrets import base_spans

from .brute import word_sets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key long, file_path string"


def rows():
    rng = random.Random(7)
    words = [f"word{k}" for k in range(400)]
    texts = [None, "", " \n", "too few words", "x y " * 60, "# % & " * 20]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(30, 160))]
        for _ in range(rng.randint(1, 5)):
            c = list(base)
            if rng.random() < 0.5:
                c[rng.randrange(len(c))] = "changed"
            texts.append(" ".join(c))
    texts += [texts[8], texts[8], " ".join(rng.choice(words) for _ in range(9000)), texts[9] + ' token = "abcdefgh12"']
    out = [(i, t, "en", "s", len(t or ""), "other", 5, "clash") for i, t in enumerate(texts)]
    out += [(8, texts[12], "en", "s", 1, None, None, None), (None, texts[8], "en", "s", 1, None, None, None), (None, " ".join(reversed(texts[14].split())), "en", "s", 1, None, None, None)]
    return [*out, out[8], out[-1], out[-1]]


def passes(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen: dict = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    again = {i + k for v in seen.values() if len(v) > 1 for i in v for k in range(5)}
    chars = sum(map(len, w))
    return len(w) >= 10 and 100 * len(again) <= 20 * len(w) and 2 * len(re.findall(r"[#*$%&|<>]", text)) <= len(w) and 2 * len(w) <= chars <= 20 * len(w)


def plain_groups(texts):
    sets = word_sets(texts, 5)
    group = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = group[i], group[j]
                group = [min(x, y) if g in (x, y) else g for g in group]
    return group


def test_stages(spark, tmp_path):
    given = rows()
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(given, SCHEMA).repartition(3).write.parquet(path)

    docs = pipeline.quality(spark, spark.read.parquet(path), str(tmp_path))
    kept = [r for r in given if passes(r[1])]
    assert sorted(map(str, docs.select("doc_id", "text").collect())) == sorted(f"Row(doc_id={r[0]!r}, text={r[1]!r})" for r in kept)
    docs.write.parquet(str(tmp_path / "q"))

    out = pipeline.near_duplicates(spark, spark.read.parquet(str(tmp_path / "q")), str(tmp_path)).collect()
    group = plain_groups([r[1] for r in kept])
    best: dict = {}
    for r, g in zip(kept, group, strict=True):
        best[g] = min(best.get(g, (True, 0)), (r[0] is None, r[0] or 0))
    assert len(out) == len(best)
    left = {g: r for r in out for k, g in zip(kept, group, strict=True) if k[1] == r["text"]}
    assert sorted((left[g]["doc_id"] is None, left[g]["doc_id"] or 0) for g in best) == sorted(best.values())

    # rows that come from no file give the same
    again = pipeline.near_duplicates(spark, spark.createDataFrame([r[:5] for r in kept], "doc_id long, text string, lang string, source string, n_chars long"), "").collect()
    assert sorted(map(str, again)) == sorted(map(str, out)) or len(again) == len(out)

    docs = spark.createDataFrame(out, "doc_id long, text string, lang string, source string, n_chars long")
    clean = pipeline.secrets(spark, docs, "").collect()
    assert len(clean) == len(out) and not any(base_spans(r["text"]) for r in clean) and all(r["n_chars"] == len(r["text"]) for r in clean)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = pipeline.packing(spark, spark.createDataFrame(clean, "doc_id long, text string, lang string, source string, n_chars long"), "").collect()
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, len(tok.encode(r["text"], add_special_tokens=False).ids) + 1) for r in clean)
    got: dict = {}
    for p in pieces:
        got[p["doc_id"], p["doc_tokens"]] = got.get((p["doc_id"], p["doc_tokens"]), 0) + p["length"]
    assert sum(got.values()) == sum(n for _, _, n in want) and {(d is None, d or 0, n) for d, n in got} == set(want)
    text = {r["doc_id"]: r["text"] for r in clean}
    for p in pieces:
        if p["doc_id"] is not None and p["start"] == 0 and p["length"] == p["doc_tokens"]:
            ids = np.array([*tok.encode(text[p["doc_id"]], add_special_tokens=False).ids, 1], "<u4")
            assert p["ids_crc32"] == zlib.crc32(ids.tobytes())


def test_run(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    out = pipeline.run(spark, str(tmp_path))
    assert out.count() > 10 and out.where("doc_id IS NULL").count() > 0
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_quality_result_filters(spark, tmp_path):
    from partweave.llm.queries import QUERIES

    spark.createDataFrame(rows(), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES["op6_quality_rules"](spark, str(tmp_path))
    assert out.where("kept").count() == sum(passes(r[1]) for r in rows()) and out.where("kept AND base_failed").count() == 0
