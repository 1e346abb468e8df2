"""Hard negatives by a vector-approximation file.

1. Components become whole numbers; each dimension's range over all rows is cut into at most ``CELLS`` cells of equal
   width, and a row's approximation is its cells, one byte a dimension, written beside the vector.
2. Anchors are read in blocks of at most ``ANCHORS``; each block is sent to all tasks, and every task reads its rows
   against it.  For an anchor and a dimension a table holds the least product of the anchor's component with each
   cell; the table entries at a row's cells add up to a lower bound of the score, and the anchor's slack, what whole
   cells can add, gives the upper bound.
3. First pass, rows of the anchor's label: only rows whose upper bound reaches the task's k-th best score so far are
   scored exactly.  Second pass, rows of other labels: each positive gives a window of scores; only rows whose bounds
   meet a window, and whose upper bound reaches the window's k-th best so far, are scored exactly.  Tasks give their
   best of each list, and the best of all follow by shuffle.

A block needs two passes over the approximations, whatever the labels' sizes; nothing is dealt by label.
Defined cases: rows without a label or vector, or with null or non-finite components, take no part; vectors of other
lengths than the anchor's are no partners of it; a null id is no anchor and comes last among ties; rows with one id are
rows of their own; components so large that a score could exceed a long raise an error; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, keep
from .op11_vector_codes import sound, whole_vectors

CELLS = 256
ANCHORS = 2048  # anchors that all tasks hold at a time
TOGETHER = 64  # anchors whose tables are looked up at a time
SLAB = 1024  # rows after which the best so far are brought up to date
AT_ONCE = 4_000_000  # components of pairs scored at a time
NO_ID = np.iinfo(np.int64).max
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


class Best:
    """The first ``k`` of each of ``n`` lists: greatest score, then least id, then least row."""

    def __init__(self, n: int, k: int):
        self.k, self.entries = k, np.zeros((4, 0), np.int64)  # list, score, id, row
        self.least = np.full(n, np.iinfo(np.int64).min)  # the k-th score of each full list

    def add(self, lists: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if not len(lists):
            return
        every = np.concatenate([self.entries, np.stack([lists, score, ids, rows])], 1)
        every = every[:, np.lexsort((every[3], every[2], -every[1], every[0]))]
        start = np.searchsorted(every[0], every[0])
        rank = np.arange(every.shape[1]) - start
        self.entries = every[:, rank < self.k]
        last = every[:, rank == self.k - 1]
        self.least[last[0]] = last[1]


class Batch:
    """Rows of one length as arrays."""

    def __init__(self, batch: pa.RecordBatch, rows: np.ndarray, dim: int):
        part = batch.take(pa.array(rows))
        self.row = part.column(0).to_numpy(zero_copy_only=False)
        self.id = part.column(1).fill_null(NO_ID).to_numpy(zero_copy_only=False)
        self.label = part.column(2).to_numpy(zero_copy_only=False)
        self.q = part.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(rows), dim)
        self.cells = np.stack([np.frombuffer(c.as_buffer(), np.uint8) for c in part.column(4)])


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Batch]]:
    for batch in batches:
        lengths = np.array(batch.column(3).value_lengths().to_numpy(zero_copy_only=False), np.int64)
        for dim in np.unique(lengths):
            yield int(dim), Batch(batch, np.flatnonzero(lengths == dim), int(dim))


class Group:
    """Up to TOGETHER anchors of one length with their tables of least products."""

    def __init__(self, anchors: list[tuple], low: np.ndarray, width: np.ndarray):
        self.number = np.array([a[0] for a in anchors], np.int64)
        self.row = np.array([a[1] for a in anchors], np.int64)
        self.label = np.array([a[2] for a in anchors], np.int64)
        self.q = np.array([a[3] for a in anchors], np.int64)
        first = low[:, None] + width[:, None] * np.arange(CELLS)  # of each cell, its least component
        last = first + width[:, None] - 1
        self.table = np.minimum(first[:, :, None] * self.q.T[:, None, :], last[:, :, None] * self.q.T[:, None, :])
        self.slack = np.abs(self.q) @ (width - 1)
        if np.abs(self.table).max(initial=0) * len(low) < 2**30:
            self.table = self.table.astype(np.int32)

    def bounds(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = np.zeros((len(cells), len(self.q)), self.table.dtype)
        for d, table in enumerate(self.table):
            low += table[cells[:, d]]
        low = low.astype(np.int64)
        return low, low + self.slack

    def score(self, q: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        step = max(1, AT_ONCE // q.shape[1])
        parts = [np.einsum("ij,ij->i", q[i[a : a + step]], self.q[j[a : a + step]]) for a in range(0, len(i), step)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _grouped(anchors: list[tuple], ranges: dict[int, tuple[np.ndarray, np.ndarray]], by_label: bool) -> dict[int, list[Group]]:
    """Groups of anchors by length, and by label where only that label's rows are read."""
    lists: dict[tuple, list[tuple]] = {}
    for a in anchors:
        lists.setdefault((len(a[3]), a[2] if by_label else None), []).append(a)
    out: dict[int, list[Group]] = {}
    for (dim, _), some in lists.items():
        out.setdefault(dim, []).extend(Group(list(part), *ranges[dim]) for part in batched(some, TOGETHER))
    return out


def _positives(anchors: list[tuple], ranges: dict, k: int):
    """Each task's best k other rows of the anchors' own labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        groups = _grouped(anchors, ranges, True)
        best = {dim: [Best(len(g.q), k) for g in gs] for dim, gs in groups.items()}
        for dim, b in _batches(batches):
            for g, top in zip(groups.get(dim, []), best.get(dim, []), strict=True):
                same = np.flatnonzero(b.label == g.label[0])
                for at in range(0, len(same), SLAB):
                    rows = same[at : at + SLAB]
                    _, high = g.bounds(b.cells[rows])
                    i, j = np.nonzero((high >= top.least) & (b.row[rows][:, None] != g.row))
                    i = rows[i]
                    top.add(j, g.score(b.q, i, j), b.id[i], b.row[i])
        for dim, gs in groups.items():
            for g, top in zip(gs, best[dim], strict=True):
                j, score, ids, rows = top.entries
                yield _frame({"anchor": g.number[j], "score": score, "row": rows}, ids)

    return run


def _negatives(anchors: list[tuple], ranges: dict, windows: dict[int, list[tuple[int, int, int]]], k: int):
    """Each task's best k rows of other labels for each window of the anchors' scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        groups = _grouped([a for a in anchors if a[0] in windows], ranges, False)
        most = max((len(w) for w in windows.values()), default=0)
        tops, edges = {}, {}
        for dim, gs in groups.items():
            tops[dim] = [Best(len(g.q) * most, k) for g in gs]
            edges[dim] = []
            for g in gs:
                low, high = np.full((len(g.q), most), NO_ID), np.full((len(g.q), most), -NO_ID)  # no score is in there
                for j, number in enumerate(g.number):
                    for place, lo, hi in windows[int(number)]:
                        low[j, place], high[j, place] = lo, hi
                edges[dim].append((low, high))
        for dim, b in _batches(batches):
            for g, top, (first, last) in zip(groups.get(dim, []), tops.get(dim, []), edges.get(dim, []), strict=True):
                for at in range(0, len(b.row), SLAB):
                    low, high = g.bounds(b.cells[at : at + SLAB])
                    need = np.maximum(first, top.least.reshape(first.shape))
                    may = np.zeros(low.shape, bool)
                    for w in range(most):
                        may |= (high >= need[:, w]) & (low <= last[:, w])
                    i, j = np.nonzero(may & (b.label[at : at + SLAB, None] != g.label))
                    score = g.score(b.q[at : at + SLAB], i, j)
                    for w in range(most):
                        fits = (score >= need[j, w]) & (score <= last[j, w])
                        r = at + i[fits]
                        top.add(j[fits] * most + w, score[fits], b.id[r], b.row[r])
        for dim, gs in groups.items():
            for g, top in zip(gs, tops[dim], strict=True):
                j, score, ids, rows = top.entries
                yield _frame({"anchor": g.number[j // most], "place": j % most, "score": score, "row": rows}, ids)

    return run


def _frame(columns: dict[str, np.ndarray], ids: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({**columns, "id": pd.array(ids, "Int64")}).assign(id=lambda f: f["id"].mask(f["id"] == NO_ID))


def _arrow(run):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pdf in run(batches):
            columns = [pa.array(pdf[c], pa.int64()) for c in pdf.columns]
            yield pa.RecordBatch.from_arrays(columns, list(pdf.columns))

    return go


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least and greatest component of each dimension, for each length of vectors."""
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        q = batch.column(0)
        lengths = q.value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(lengths):
            m = q.take(pa.array(np.flatnonzero(lengths == dim))).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            both = np.stack([m.min(0), m.max(0)])
            if dim in found:
                both = np.stack([np.minimum(both[0], found[dim][0]), np.maximum(both[1], found[dim][1])])
            found[dim] = both
    for dim, both in found.items():
        n = len(both[0])
        yield pa.RecordBatch.from_arrays([pa.array([int(dim)] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(both[0], pa.int64()), pa.array(both[1], pa.int64())], ["dim", "d", "low", "high"])


def _approximate(ranges: dict[int, tuple[np.ndarray, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = batch.column(3)
            lengths = q.value_lengths().to_numpy(zero_copy_only=False)
            cells: list = [b""] * len(q)
            for dim in np.unique(lengths):
                rows = np.flatnonzero(lengths == dim)
                low, width = ranges[int(dim)]
                m = q.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                for r, c in zip(rows, ((m - low) // width).astype(np.uint8), strict=True):
                    cells[r] = c.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.binary())], [*batch.schema.names, "cells"])

    return run


def hard_negatives(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = 100, positives: int = 5, negatives: int = 10,
    low: int = 30, high: int = 90, scale: int = 256,
) -> DataFrame:
    """-> ``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Anchors are rows whose id ``every`` divides.  ``low`` and ``high`` are percents of the positive's score.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    d = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("e"))
    d = d.where(f"label IS NOT NULL AND {sound('e')}").select(F.monotonically_increasing_id().alias("row"), "id", "label", whole_vectors("e", scale).alias("q"))
    found = d.select("q").mapInArrow(_ranges, "dim int, d int, low long, high long").groupBy("dim", "d").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    by_dim: dict[int, list] = {}
    for r in found.orderBy("dim", "d").collect():  # as many rows as vectors have dimensions
        by_dim.setdefault(r["dim"], []).append((r["low"], r["high"]))
    ranges = {}
    for dim, some in by_dim.items():
        least, most = np.array(some, np.int64).T
        ranges[dim] = (least, (most - least) // CELLS + 1)
    file = scratch.table(d.mapInArrow(_approximate(ranges), "row long, id long, label long, q array<long>, cells binary"), "file")

    n = 0
    for block in batched(file.where(f"id % {every} = 0").select("row", "id", "label", "q").toLocalIterator(), ANCHORS):
        anchors = [(k, a["row"], a["label"], a["q"]) for k, a in enumerate(block)]
        near = file.mapInArrow(_arrow(_positives(anchors, ranges, positives)), "anchor long, score long, row long, id long")
        order = Window.partitionBy("anchor").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
        near = near.withColumn("place", F.row_number().over(order)).where(f"place <= {positives}").collect()  # a few for each anchor of the block
        windows: dict[int, list[tuple[int, int, int]]] = {}
        pairs = []
        for p in near:
            pairs.append((p["anchor"], p["place"] - 1, block[p["anchor"]]["id"], p["id"], p["score"]))
            windows.setdefault(p["anchor"], []).append((p["place"] - 1, -(-low * p["score"] // 100), high * p["score"] // 100))
        if not pairs:
            continue
        found = file.mapInArrow(_arrow(_negatives(anchors, ranges, windows, negatives)), "anchor long, place long, score long, row long, id long")
        order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
        found = found.withColumn("rank", F.row_number().over(order)).where(f"rank <= {negatives}")
        named = spark.createDataFrame(pairs, "anchor long, place long, anchor_id long, positive_id long, positive_score long")
        scratch.table(found.join(named, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), f"found/{n}")
        n += 1
    out = spark.read.schema(RESULT).parquet(f"{scratch.base}/found/*") if n else spark.createDataFrame([], RESULT)
    return keep(out, scratch)
