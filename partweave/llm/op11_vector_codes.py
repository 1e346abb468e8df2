"""Vector code compression: codes of vector parts against small codebooks, the nearest entry by annular norm pruning.

Components become whole numbers, ``floor(scale * x)``; a vector is cut into ``parts`` consecutive parts, and each part
becomes the number of the nearest entry of its codebook.  A codebook starts as the part of the vectors with the least
ids and moves to its members' floored means in each round.

The nearest entry: entries are sorted by norm.  The entries next to a part's own norm give a first best distance r;
an entry outside the ring of norms within r of the part's can't be nearer, so a binary search gives the ring and its
entries, bounds included, are compared exactly.  Parts are taken in order of norm, so a block's rings lie together.

A round is one pass over the written whole-number vectors: each task adds up its members of each entry, the sums are
added by shuffle, and only the codebooks, at most ``entries`` times a vector, pass through the driver.

Defined cases: rows whose vector is null, empty, or holds null or non-finite components are dropped, and so are rows
of another length than the vector of the least id; null ids come last, equal ids by their vectors; components so large
that a squared distance could exceed a long raise an error; lengths that ``parts`` does not divide are cut at
``k * length div parts``; fewer rows than entries give smaller codebooks; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, keep

BLOCK = 128  # parts whose rings are read together
FIRST = 8  # entries on each side that give the first best distance


def whole_vectors(vector: str, scale: int) -> Column:
    """``floor(scale * x)`` of each component, in double precision; an error where it would be out of range."""
    top = f"array_max(transform({vector}, x -> abs({scale}D * x))) > sqrt(1e18D / size({vector}))"
    return F.expr(f"CASE WHEN {top} THEN raise_error('a component is too large for whole-number distances') ELSE transform({vector}, x -> cast(floor({scale}D * x) AS long)) END")


def sound(vector: str) -> str:
    """A condition: the vector has components, all finite."""
    return f"coalesce(size({vector}) > 0 AND NOT exists({vector}, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity')), false)"


def matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), dim)


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances, as whole numbers."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if x.shape[1] * 4 * top * top < 2**53:  # all sums are whole numbers that doubles hold
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return ((x[:, None, :] - entries[None, :, :]) ** 2).sum(2)


class Codebook:
    def __init__(self, entries: np.ndarray):
        self.entries = entries
        norm = np.sqrt((entries.astype(np.float64) ** 2).sum(1))
        self.by_norm = np.argsort(norm, kind="stable")
        self.norms = norm[self.by_norm]
        self.place = np.argsort(self.by_norm)  # of each entry in the order of norms

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row its nearest entry, ties to the lower number, and the squared distance."""
        code, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        order = np.argsort(norm, kind="stable")
        for at in range(0, len(x), BLOCK):
            rows = order[at : at + BLOCK]
            part, own = x[rows], norm[rows]
            near = np.searchsorted(self.norms, own[[0, -1]])
            some = self.by_norm[max(0, near[0] - FIRST) : near[1] + FIRST]
            best = np.sqrt(squared(part, self.entries[some]).min(1).astype(np.float64))
            reach = best + 1e-9 * (1 + best + own)  # bounds included, whatever the roots' rounding
            low, high = np.searchsorted(self.norms, own - reach, "left"), np.searchsorted(self.norms, own + reach, "right")
            ring = np.sort(self.by_norm[low.min() : high.max()])
            d = squared(part, self.entries[ring])
            place = self.place[ring]
            d[(place < low[:, None]) | (place >= high[:, None])] = np.iinfo(np.int64).max
            j = d.argmin(1)
            code[rows], distance[rows] = ring[j], d[np.arange(len(rows)), j]
        return code, distance


def cuts(dim: int, parts: int) -> list[slice]:
    at = [k * dim // parts for k in range(parts + 1)]
    return [slice(a, b) for a, b in zip(at, at[1:], strict=False)]


def _sums(books: list[np.ndarray], dim: int):
    """Adds up a task's members of each entry: rows of slot and value, a slot an entry's component or count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [Codebook(b) for b in books]
        total = [np.zeros((b.shape[0], b.shape[1] + 1), np.int64) for b in books]
        for batch in batches:
            q = matrix(batch.column(0), dim)
            for book, where, t in zip(ready, cuts(dim, len(books)), total, strict=True):
                code, _ = book.nearest(q[:, where])
                order = np.argsort(code, kind="stable")
                used, start = np.unique(code[order], return_index=True)
                if len(used):
                    t[used, :-1] += np.add.reduceat(q[order][:, where], start, axis=0)
                    t[used, -1] += np.diff([*start, len(order)])
        flat = np.concatenate([t.ravel() for t in total])
        slot = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(flat[slot])], ["slot", "value"])

    return run


def _moved(books: list[np.ndarray], sums: dict[int, int]) -> list[np.ndarray]:
    """Each entry with members becomes their floored mean."""
    out, at = [], 0
    for book in books:
        n, width = book.shape
        t = np.array([sums.get(at + i, 0) for i in range(n * (width + 1))], np.int64).reshape(n, width + 1)
        count = t[:, -1:]
        out.append(np.where(count > 0, t[:, :-1] // np.maximum(count, 1), book))
        at += t.size
    return out


def _codes(books: list[np.ndarray], dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [Codebook(b) for b in books]
        for batch in batches:
            q = matrix(batch.column(2), dim)
            got = [book.nearest(q[:, where]) for book, where in zip(ready, cuts(dim, len(books)), strict=True)]
            code = np.stack([c for c, _ in got], 1)
            error = np.sum([d for _, d in got], axis=0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code.tolist(), pa.list_(pa.int32())), pa.array(error)], ["id", "label", "codes", "error"])

    return run


def compress(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024
) -> tuple[DataFrame, list[np.ndarray]]:
    """-> ``(id, label, codes, error, label_error)`` for every sound row, and the codebooks, one array for each part."""
    scratch = Scratch(rows.sparkSession)
    d = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("e"))
    q = scratch.table(d.where(sound("e")).select("id", "label", whole_vectors("e", scale).alias("q")), "vectors")
    order = [F.col("id").asc_nulls_last(), "q"]
    least = q.orderBy(*order).select(F.size("q")).first()
    dim = least[0] if least else 1
    q = q.where(F.size("q") == dim)
    first = q.orderBy(*order).select("q").limit(entries).collect()  # one codebook
    start = np.array([r["q"] for r in first], np.int64).reshape(-1, dim)
    books = [start[:, where] for where in cuts(dim, parts)]
    if first:
        for _ in range(rounds):
            sums = q.select("q").mapInArrow(_sums(books, dim), "slot int, value long").groupBy("slot").agg(F.sum("value").alias("value"))
            books = _moved(books, {r["slot"]: r["value"] for r in sums.collect()})  # as many rows as the codebooks have numbers
    label = rows.schema[label_col].dataType.simpleString()
    coded = q.select("id", "label", "q").mapInArrow(_codes(books, dim), f"id long, label {label}, codes array<int>, error long")
    coded = scratch.table(coded, "coded")
    by_label = scratch.table(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "by_label")
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select("id", "label", "codes", "error", "label_error")
    return keep(out, scratch), books
