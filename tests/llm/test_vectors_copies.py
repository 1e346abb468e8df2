"""Vector codes, hard negatives and exact copies against plain versions, with awkward rows."""

import hashlib
import math
import random

import numpy as np
import pytest

from partweave.llm.op11_vector_codes import Codebook, compress
from partweave.llm.op12_hard_negatives import hard_negatives
from partweave.llm.op13_exact_dedup import LARGE, PIECE, exact_dedup, moved, piece_hash, text_hash

INF, NAN = float("inf"), float("nan")


def vectors(n, dim, seed, size=1.0):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.standard_normal(dim) * size], int(rng.integers(0, 4)), "x") for i in range(n)]
    rows += [(n + i, rows[0][1], 1, None) for i in range(n // 3)]  # a third of all rows is one vector
    rows += [(5, rows[9][1], 2, "again"), (5, rows[9][1], 2, "again"), (None, rows[3][1], 3, "x"), (None, rows[4][1], None, "x"), (2 * n, rows[5][1], None, "x")]
    rows += [(3 * n, None, 1, "x"), (3 * n + 1, [], 1, "x"), (3 * n + 2, [None] * dim, 1, "x"), (3 * n + 3, [NAN] * dim, 1, "x"), (3 * n + 4, [INF] * dim, 1, "x"), (3 * n + 5, [1.0] * (dim - 1), 1, "x")]
    rows += [(3 * n + 6, [0.0] * dim, 0, "x"), (4 * n, rows[7][1], 0, "x")]
    return rows


SCHEMA = "vec_id long, embedding array<double>, label int, error string"


def sound(v):
    return v and all(x is not None and math.isfinite(x) for x in v)


def plain_codes(rows, parts, entries, rounds, scale):
    key = [((r[0] is None, r[0] or 0), [math.floor(scale * x) for x in r[1]], r) for r in rows if sound(r[1])]
    key.sort(key=lambda k: k[:2])
    dim = len(key[0][1])
    key = [k for k in key if len(k[1]) == dim]
    cut = [k * dim // parts for k in range(parts + 1)]
    books = [[k[1][a:b] for k in key[:entries]] for a, b in zip(cut, cut[1:])]

    def assign(q):
        out = []
        for book, a, b in zip(books, cut, cut[1:]):
            d = [sum((x - y) ** 2 for x, y in zip(q[a:b], c)) for c in book]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        got = [assign(k[1]) for k in key]
        for p, (a, b) in enumerate(zip(cut, cut[1:])):
            for e in range(len(books[p])):
                some = [k[1][a:b] for k, g in zip(key, got) if g[p][0] == e]
                if some:
                    books[p][e] = [sum(c) // len(some) for c in zip(*some)]
    out = [(k[2][0], k[2][2], [e for e, _ in assign(k[1])], sum(d for _, d in assign(k[1]))) for k in key]
    total = {}
    for _, label, _, d in out:
        total[label] = total.get(label, 0) + d
    return sorted((str(i), str(label), codes, d, total[label]) for i, label, codes, d in out), books


@pytest.mark.parametrize(("dim", "entries", "size"), [(8, 16, 1.0), (6, 300, 1.0), (8, 7, 5e4)])
def test_codes(spark, dim, entries, size):
    rows = vectors(90, dim, dim, size)
    out, books = compress(spark.createDataFrame(rows, SCHEMA).repartition(3), entries=entries)
    want, plain = plain_codes(rows, 4, entries, 4, 1024)
    assert [b.tolist() for b in books] == plain
    assert sorted((str(r["id"]), str(r["label"]), r["codes"], r["error"], r["label_error"]) for r in out.collect()) == want


def test_codes_range_and_empty(spark):
    out, books = compress(spark.createDataFrame([(3, None, 1, "x")], SCHEMA))
    assert out.count() == 0 and [len(b) for b in books] == [0] * 4
    with pytest.raises(Exception, match="too large"):
        compress(spark.createDataFrame([(1, [1e300] * 8, 1, "x")], SCHEMA))


def test_ring_holds_the_nearest_with_ties():
    rng = np.random.default_rng(2)
    for width, top in ((1, 4), (2, 3), (4, 50), (16, 2**26)):
        x, entries = rng.integers(-top, top, (400, width)), rng.integers(-top, top, (60, width))
        d = ((x[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(2)
        code, distance = Codebook(entries).nearest(x)
        assert code.tolist() == [row.tolist().index(min(row)) for row in d] and distance.tolist() == d.min(1).tolist()


def plain_negatives(rows, every, k, m):
    some = [(r[0], r[2], [math.floor(256 * x) for x in r[1]], n) for n, r in enumerate(rows) if r[2] is not None and sound(r[1])]
    out = []
    for a in some:
        if a[0] is None or a[0] % every:
            continue
        score = [(-sum(x * y for x, y in zip(a[2], b[2])), (b[0] is None, b[0] or 0), b) for b in some if b[3] != a[3] and len(b[2]) == len(a[2])]
        score.sort(key=lambda s: s[:2])
        for p in [s for s in score if s[2][1] == a[1]][:k]:
            fits = [s for s in score if s[2][1] != a[1] and 30 * -p[0] <= 100 * -s[0] <= 90 * -p[0]][:m]
            out += [(a[0], str(p[2][0]), n, str(s[2][0]), -p[0], -s[0]) for n, s in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize(("every", "k", "m", "size"), [(5, 5, 10, 1.0), (3, 2, 4, 500.0)])
def test_hard_negatives(spark, every, k, m, size):
    rows = vectors(120, 6, every, size)
    out = hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3), every=every, positives=k, negatives=m)
    got = sorted((r["anchor_id"], str(r["positive_id"]), r["rank"], str(r["negative_id"]), r["positive_score"], r["negative_score"]) for r in out.collect())
    want = plain_negatives(rows, every, k, m)
    assert len(want) > 100 and got == want


def test_hard_negatives_in_blocks(spark, monkeypatch):
    from partweave.llm import op12_hard_negatives as op12

    monkeypatch.setattr(op12, "ANCHORS", 7)
    rows = vectors(60, 4, 1)
    got = hard_negatives(spark.createDataFrame(rows, SCHEMA), every=4).collect()
    assert sorted((r[0], str(r[1]), r[2], str(r[3]), r[4], r[5]) for r in got) == plain_negatives(rows, 4, 5, 10)


def test_hard_negatives_without_anchors(spark):
    assert hard_negatives(spark.createDataFrame([(7, [1.0], 1, "x")], SCHEMA)).count() == 0
    assert hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    assert hard_negatives(spark.createDataFrame([(100, [1.0], 1, "x")], SCHEMA)).count() == 0


def test_hash_composes():
    rng = random.Random(3)
    text = rng.randbytes(3 * PIECE + 77)
    whole = 0
    for byte in text:
        whole = (whole * 1_204_573_987 + byte + 1) % (2**31 - 1)
    assert text_hash(text)[0] == whole and text_hash(b"") == [0, 0] and text_hash(b"\0") != text_hash(b"\0\0")
    assert moved(piece_hash(b"ab"), 1)[0] == (text_hash(b"abc")[0] - text_hash(b"c")[0]) % (2**31 - 1)


def copies():
    rng = random.Random(5)
    long = "Ä" + "Lorem ipsum " * (PIECE * LARGE // 12 * 2)
    texts = [None, "", " ", "a", "A", "b", "É", "é", "ab" * PIECE, "ab" * (PIECE - 1) + "AB", "ab" * (PIECE - 1) + "aa", long, long.upper().replace("Ä", "Ä"), long[:-1] + "x", long]
    texts += [rng.choice(["hot text", "Hot Text", "hot texts"]) for _ in range(400)]
    texts += ["".join(rng.choices("abAB", k=2)) for _ in range(40)]
    rows = [(i, t, "c", "d") for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, "b", "c", "d"), (None, "only", "c", "d"), (None, "only", "c", "d")]


def plain_copies(rows):
    norm = ["".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "") for r in rows]
    size, top = {}, {}
    for n, t in enumerate(norm):
        size[t] = size.get(t, 0) + 1
        best = top.get(t)
        if best is None or (rows[n][0] is not None, rows[n][0] or 0) > (rows[best][0] is not None, rows[best][0] or 0):
            top[t] = n
    return sorted((str(r[0]), str(rows[top[t]][0]), size[t], hashlib.sha256(t.encode()).hexdigest()) for r, t in zip(rows, norm)), len(size)


def digest(c):
    from pyspark.sql import functions as F

    from partweave.llm.op13_exact_dedup import normal

    return F.sha2(normal(F.col(c)), 256)


@pytest.mark.parametrize("prime", [2**31 - 1, 3])
def test_exact_dedup(spark, prime):
    """Also with hashes of which many are equal by chance."""
    rows = [r for r in copies() if prime > 3 or len(r[1] or "") < 9]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, keep_ string").repartition(4).withColumn("sha", digest("text"))
    got = exact_dedup(docs, carry=("sha",), prime=prime).collect()
    want, classes = plain_copies(rows)
    assert sorted((str(r["id"]), str(r["keep_id"]), r["group_size"], r["sha"]) for r in got) == want
    assert sum(r["kept"] for r in got) == classes and all(str(r["id"]) == str(r["keep_id"]) for r in got if r["kept"])


def test_exact_dedup_reads_files_in_place(spark, tmp_path):
    rows = copies()
    spark.createDataFrame(rows, "doc_id long, text string, key string, keep_ string").repartition(3).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d").withColumn("sha", digest("text"))
    got = exact_dedup(docs, carry=("sha",)).collect()
    assert sorted((str(r["id"]), str(r["keep_id"]), r["group_size"], r["sha"]) for r in got) == plain_copies(rows)[0]
    assert exact_dedup(docs.limit(0)).count() == 0
