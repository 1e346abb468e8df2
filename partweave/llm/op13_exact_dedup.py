"""Exact dedup by composable polynomial fingerprints.

1. A text, lower-cased in A-Z only, is a sequence of UTF-8 bytes, cut into pieces of ``PIECE`` bytes.  A piece's hash
   is the value of a polynomial with its bytes as coefficients, modulo ``PRIME``, at each of two points.  The hash of
   a text is the sum of its pieces' hashes, each moved by the point's power of the bytes that follow; texts of more
   than ``LARGE`` pieces are hashed by as many tasks as they have pieces, and sums modulo the prime put them together.
2. Texts of equal length and hash are candidates of the one with the greatest id.  Their pieces are dealt by
   candidate, place in the text and a salt, so a group with a third of all rows is many tasks, and are read in
   order: the first text's piece is held while all others of that place stream past it.
3. Texts that differ from the one they were held against go round again among themselves, so equal hashes of
   different texts cost a round and never a wrong answer.

Defined cases: null counts as empty; empty texts are equal to one another; a null id is less than all others; of rows
with one id, the one later in the files stays; rows that are equal in all columns are rows of their own; an empty
table gives an empty result.  ``carry`` names further columns to return; they may not be named like the result's own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, keep

PRIME = 2**31 - 1
POINTS = (1_204_573_987, 731_096_251)
PIECE = 1 << 14
LARGE = 64  # pieces of a text that one task hashes alone
MEMBERS = 128  # texts held against one copy of the kept text
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HASH = ["n_bytes", "f0", "f1"]
PLACE = ["file_", "row_"]


def normal(text: Column) -> Column:
    """The text that is compared: null as empty, A-Z in lower case."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, UPPER.lower())


@lru_cache(4)
def _powers(points: tuple[int, ...], prime: int) -> np.ndarray:
    """Descending powers: row k ends in point k to the power of 1, 0."""
    out = np.ones((len(points), PIECE), np.int64)
    for k, x in enumerate(points):
        value = 1
        for i in range(PIECE - 2, -1, -1):
            value = value * x % prime
            out[k, i] = value
    return out


def piece_hash(piece: bytes, points: tuple[int, ...] = POINTS, prime: int = PRIME) -> np.ndarray:
    """The hashes of at most ``PIECE`` bytes, one for each point; a byte counts one more, so zeros count too."""
    coefficients = np.frombuffer(piece, np.uint8).astype(np.int64) + 1
    return _powers(points, prime)[:, PIECE - len(piece) :] @ coefficients % prime


def moved(hashes: np.ndarray, after: int, points: tuple[int, ...] = POINTS, prime: int = PRIME) -> list[int]:
    """The part of a text's hash that a piece gives when ``after`` bytes follow it."""
    return [int(h) * pow(x, after, prime) % prime for h, x in zip(hashes, points, strict=True)]


def text_hash(text: bytes, points: tuple[int, ...] = POINTS, prime: int = PRIME) -> list[int]:
    total = [0] * len(points)
    for at in range(0, len(text), PIECE):
        piece = text[at : at + PIECE]
        part = moved(piece_hash(piece, points, prime), len(text) - at - len(piece), points, prime)
        total = [(a + b) % prime for a, b in zip(total, part, strict=True)]
    return total


def _hashes(points: tuple[int, ...], prime: int, whole: bool):
    """Replaces the first column, the bytes, by hashes; of pieces, the second tells the bytes that follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 1 if whole else 2
            if whole:
                got = [text_hash(x.as_py(), points, prime) for x in batch.column(0)]
            else:
                got = [moved(piece_hash(x.as_py(), points, prime), n.as_py(), points, prime) for x, n in zip(batch.column(0), batch.column(1), strict=True)]
            hashes = [pa.array([g[k] for g in got], pa.int64()) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[at:], *hashes], [*batch.schema.names[at:], "f0", "f1"])

    return run


def _pieces(binary: str) -> Column:
    """Numbered pieces of at most PIECE bytes; an empty text is one empty piece."""
    cut = f"transform(sequence(0L, greatest(n_bytes - 1, 0L) div {PIECE}), i -> struct(i AS i, substring({binary}, cast(i * {PIECE} + 1 AS int), {PIECE}) AS piece))"
    return F.inline(F.expr(cut))


def _differing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of group, place and rank, the kept text first; gives the rows of texts that differ from it."""
    held, piece = None, None
    for batch in batches:
        group, first, pieces = batch.column("key"), batch.column("follows"), batch.column("piece")
        out = []
        for n in range(batch.num_rows):
            if first[n].as_py() == 0:
                held, piece = group[n].as_py(), pieces[n].as_buffer().to_pybytes() if pieces[n].is_valid else b""
            elif held != group[n].as_py() or pieces[n].as_buffer() != pa.py_buffer(piece):
                out.append(n)
        yield batch.select(PLACE).take(pa.array(out, pa.int64()))


def _straight(docs: DataFrame) -> bool:
    """Whether the rows come straight from files, so that file and row tell them apart."""
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    return node.nodeName().startswith(("LogicalRelation", "Relation")) and "_metadata" not in docs.columns


def _read(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` with ``file_`` and ``row_``, which stay the same each time they are read."""
    if not _straight(docs):
        docs = scratch.table(docs, "docs")
    return docs.withColumns({"file_": F.xxhash64("_metadata.file_path"), "row_": F.col("_metadata.row_index")})


def _fingerprints(docs: DataFrame, carry: Sequence[str], points: tuple[int, ...], prime: int) -> DataFrame:
    d = docs.withColumn("bytes_", F.col("text_").cast("binary")).withColumn("n_bytes", F.octet_length("text_").cast("long"))
    more = ["file_", "row_", "id_", "n_bytes", *carry]
    types = {f.name: f.dataType.simpleString() for f in d.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in more)
    short = d.where(f"n_bytes <= {PIECE * LARGE}").select("bytes_", *more).mapInArrow(_hashes(points, prime, True), schema + ", f0 long, f1 long")
    pieces = d.where(f"n_bytes > {PIECE * LARGE}").select(*more, "bytes_").select(*more, _pieces("bytes_"))
    pieces = pieces.repartition(*PLACE, "i").select("piece", F.expr(f"n_bytes - i * {PIECE} - length(piece)").alias("after"), *more)
    parts = pieces.mapInArrow(_hashes(points, prime, False), schema + ", f0 long, f1 long")
    once = [F.first(c).alias(c) for c in ("id_", "n_bytes", *carry)]
    long = parts.groupBy(*PLACE).agg(*once, *(F.expr(f"sum({f}) % {prime}").alias(f) for f in ("f0", "f1")))
    return short.unionByName(long.select(short.columns))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), points: tuple[int, int] = POINTS, prime: int = PRIME
) -> DataFrame:
    """-> ``(id, keep_id, group_size, kept, *carry)``, one row for each row of ``docs``."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("id_"), normal(F.col(text_col)).alias("text_"), *carry)
    docs = _read(docs, scratch)
    thin = scratch.table(_fingerprints(docs, carry, points, prime), "thin")

    left, found, n = thin.select(*PLACE, "id_", *HASH), [], 0
    while True:
        groups = left.groupBy(*HASH).agg(F.count("*").alias("n"), F.max(F.struct("id_", *PLACE)).alias("k")).where("n > 1")
        groups = scratch.table(groups.select(*HASH, "n", F.col("k.id_").alias("keep_"), F.expr("struct(k.file_, k.row_)").alias("key")), f"groups{n}")
        if groups.isEmpty():
            break
        members = scratch.table(left.join(groups, HASH), f"members{n}")
        salts = F.expr(f"cast(ceil(n / {MEMBERS}) AS int)")
        # a merge join at every size: texts cross the network once, and memory does not depend on the number of members
        dealt = docs.select(*PLACE, F.col("text_").cast("binary").alias("bytes_")).join(members.select(*PLACE, "n_bytes", "n", "key").hint("merge"), PLACE)
        dealt = dealt.withColumn("follows", F.expr("cast(key.file_ <> file_ OR key.row_ <> row_ AS int)"))
        mine = F.when(F.col("follows") == 1, F.array(F.pmod(F.xxhash64("row_", "file_"), salts).cast("int"))).otherwise(F.sequence(F.lit(0), salts - 1))
        dealt = dealt.withColumn("salt", F.explode(mine)).select(*PLACE, "key", "follows", "salt", "n_bytes", "bytes_").select(*PLACE, "key", "follows", "salt", _pieces("bytes_"))
        dealt = dealt.repartition("key", "salt", "i").sortWithinPartitions("key", "salt", "i", "follows")
        differ = dealt.mapInArrow(_differing, "file_ long, row_ long").distinct()
        differ = scratch.table(differ, f"differ{n}")
        if differ.isEmpty():
            found.append(members.select(*PLACE, "key", "keep_", F.col("n").alias("size_")))
            break
        equal = members.join(differ, PLACE, "left_anti").select(*PLACE, "key", "keep_")
        equal = scratch.table(equal, f"equal{n}")
        sizes = scratch.table(equal.groupBy("key").agg(F.count("*").alias("size_")), f"sizes{n}")
        found.append(equal.join(sizes, "key").select(*PLACE, "key", "keep_", "size_"))
        left = scratch.table(members.join(differ, PLACE, "left_semi").select(*PLACE, "id_", *HASH), f"left{n}")
        n += 1

    out = thin.select(*PLACE, F.col("id_").alias("id"), *carry)
    if found:
        every = found[0]
        for f in found[1:]:
            every = every.union(f)
        out = out.join(every, PLACE, "left")
    else:
        out = out.selectExpr("*", "cast(null AS struct<file_: bigint, row_: bigint>) AS key", "cast(null AS bigint) AS keep_", "cast(null AS bigint) AS size_")
    kept = F.expr("key IS NULL OR (key.file_ = file_ AND key.row_ = row_)")
    result = ["id", F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("keep_")).alias("keep_id"), F.coalesce("size_", F.lit(1).cast("long")).alias("group_size"), kept.alias("kept")]
    return keep(out.select(*result, *carry), scratch)
