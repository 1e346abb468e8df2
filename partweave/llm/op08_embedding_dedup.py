"""Embedding near-duplicates by lattice hashing.

1. Equal vectors of one label are a class; only one vector of each class goes on.
2. Each of ``TABLES`` tables projects a vector on ``PARTS`` times eight random directions and decodes each
   eight coordinates to the nearest point of the E8 lattice; label and points are the cell.  Vectors also
   probe the neighbouring cells whose lattice points are the next nearest.
3. Cells with an owner and another member are kept; members are compared in square blocks, so a large
   cell is many tasks and no pairs are written out.  A pair met in several cells is counted in the first
   one only, which both vectors' cells tell, so link counts are exact for the pairs found.
4. Blocks report counts per vector and links that join something new; components follow from those.

Cosine is computed in double precision.  ``>= percent`` pairs only; recall is measured against brute
force in the tests.  Defined cases: null, zero, or partly null or non-finite vectors and null labels link
with nothing (0 links, component = own id); vectors of different lengths never link; an empty table
gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, keep
from .components import components

TABLES, PARTS, PROBES = 5, 2, 2
SCALE = 0.28  # lattice step against unit vectors; a pair of cosine 0.98 is about 0.07 apart in eight of 64 directions
BLOCK = 512
AT_ONCE = 4_000_000  # components of pairs compared at a time
GROUP = ["label", "dim", "t", "cell", "i", "j"]


def e8(x: np.ndarray) -> np.ndarray:
    """The nearest E8 points, doubled so that they are whole numbers: E8 is D8 and D8 moved by halves."""

    def d8(y: np.ndarray) -> np.ndarray:
        r = np.rint(y)
        off = y - r
        odd = np.flatnonzero(r.sum(1) % 2)
        k = np.abs(off[odd]).argmax(1)
        r[odd, k] += np.where(off[odd, k] >= 0, 1, -1)
        return r

    a, b = d8(x), d8(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return (2 * np.where(nearer[:, None], a, b)).astype(np.int64)


@lru_cache(1)
def roots() -> np.ndarray:
    """The 240 shortest lattice vectors, doubled."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((2, -2), repeat=2):
            v = [0] * 8
            v[i], v[j] = s, t
            out.append(v)
    out += [v for v in itertools.product((1, -1), repeat=8) if v.count(-1) % 2 == 0]
    return np.array(out, np.int64)


@lru_cache(8)
def directions(dim: int, table: int) -> np.ndarray:
    rng = np.random.default_rng(1_000_003 * dim + table)
    m = rng.standard_normal((dim, 8 * PARTS))
    return np.linalg.qr(m)[0] if dim >= 8 * PARTS else m / np.sqrt(dim)


@lru_cache(1)
def _mixers() -> np.ndarray:
    return np.random.default_rng(8).integers(1, 2**63 - 1, 8 * PARTS, dtype=np.int64) | 1


def cells(unit: np.ndarray, table: int) -> np.ndarray:
    """For each vector its own cell and the cells it probes: an array (n, 1 + PROBES) of 64-bit keys."""
    dim = unit.shape[1]
    y = unit @ directions(dim, table) * (np.sqrt(dim / 64) / SCALE)
    points, steps, gains = [], [], []
    for p in range(PARTS):
        x = y[:, 8 * p : 8 * p + 8]
        c = e8(x)
        # distance to c + v is |d|^2 - 2 d.v + |v|^2: the next nearest have the greatest d.v
        score = (x - c / 2) @ (roots().T / 2)
        best = np.argpartition(-score, PROBES, axis=1)[:, :PROBES]
        points.append(c)
        steps.append(best)
        gains.append(np.take_along_axis(score, best, 1))
    mult = _mixers()
    with np.errstate(over="ignore"):
        own = np.concatenate(points, 1) @ mult + np.int64(table)
        moved = np.concatenate([own[:, None] + roots()[steps[p]] @ mult[8 * p : 8 * p + 8] for p in range(PARTS)], 1)
    pick = np.argsort(-np.concatenate(gains, 1), axis=1, kind="stable")[:, :PROBES]
    return np.concatenate([own[:, None], np.take_along_axis(moved, pick, 1)], 1)


def _units(raw: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(b, "<f8") for b in raw]


def _groups(vectors: list[np.ndarray]):
    """Rows of equal length together, as unit vectors."""
    by: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        by.setdefault(len(v), []).append(i)
    for rows in by.values():
        m = np.stack([vectors[i] for i in rows])
        m = m / np.abs(m).max(1, keepdims=True)  # no overflow of squares
        yield np.array(rows), m / np.linalg.norm(m, axis=1, keepdims=True)


def _keys(batches):
    for pdf in batches:
        dim = (pdf["v"].str.len() // 8).to_numpy(np.int32)
        every = np.stack([np.frombuffer(b, np.int64) for b in pdf["cells"]]).reshape(len(pdf), TABLES, -1) if len(pdf) else np.zeros((0, TABLES, 1), np.int64)
        n = every.shape[2]
        for table in range(TABLES):
            rows = np.repeat(np.arange(len(pdf)), n)
            yield pd.DataFrame({"label": pdf["label"].to_numpy()[rows], "dim": dim[rows], "t": np.int32(table), "cell": every[:, table].ravel(), "own": np.tile(np.arange(n) == 0, len(pdf)), "rep": pdf["rep"].to_numpy()[rows]})


def _pairs(group_left: np.ndarray, group_right: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places left, places right) of all pairs within groups, ``most`` or so at a time; both sides sorted by group."""
    begin, end = np.searchsorted(group_right, group_left), np.searchsorted(group_right, group_left, "right")
    each = end - begin
    total = np.cumsum(each)
    at = 0
    while at < len(each):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        n = each[at:to]
        i = np.repeat(np.arange(at, to), n)
        yield i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + begin[i]
        at = to


def _linked(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links between the owners of cells and the other members of whole groups: counts per vector, and joining links.

    All groups of the batch are compared in flat arrays, whatever their sizes.
    """
    pdf = pdf.drop_duplicates([*GROUP, "side", "rep"])
    group = pdf.groupby(GROUP, sort=False, dropna=False).ngroup().to_numpy()
    pdf = pdf.iloc[np.argsort(group, kind="stable")]
    group = np.sort(group)
    unit = np.stack(_units(pdf["v"]))
    unit = unit / np.abs(unit).max(1, keepdims=True)
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    keys = np.stack([np.frombuffer(b, np.int64) for b in pdf["cells"]]).reshape(len(pdf), TABLES, -1)
    side, own, table = pdf["side"].to_numpy(), pdf["own"].to_numpy(bool), pdf["t"].to_numpy()
    rep, size = pdf["rep"].to_numpy(), pdf["size"].to_numpy()
    left, right = np.flatnonzero((side == 0) & own), np.flatnonzero(side == 1)
    found = []
    for i, j in _pairs(group[left], group[right], max(1, AT_ONCE // unit.shape[1])):
        i, j = left[i], right[j]
        open_ = (rep[i] != rep[j]) & ~(own[j] & (rep[i] > rep[j]))
        i, j = i[open_], j[open_]
        near = np.einsum("ij,ij->i", unit[i], unit[j]) >= least
        i, j = i[near], j[near]
        first = np.ones(len(i), bool)
        for t in range(TABLES):  # a pair counts in the first table where it meets
            x, y = keys[i, t], keys[j, t]
            first &= ~((t < table[i]) & ((x == y[:, :1]).any(1) | (y == x[:, :1]).any(1)))
        # a probing neighbour whose own cell the other probes too is met twice in this table
        twice = ~own[j] & (keys[i, table[i]] == keys[j, table[i]][:, :1]).any(1) & (rep[i] > rep[j])
        found.append((i[first & ~twice], j[first & ~twice]))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (left[:0], right[:0])
    n = pd.concat([pd.Series(size[j]).groupby(rep[i]).sum(), pd.Series(size[i]).groupby(rep[j]).sum()]).groupby(level=0).sum()
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    links = []
    for x, y in zip(rep[i].tolist(), rep[j].tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            links.append((x, y))
    a = np.concatenate([n.index.to_numpy(np.int64), np.array([x for x, _ in links], np.int64)])
    b = pd.array([None] * len(n) + [y for _, y in links], "Int64")
    return pd.DataFrame({"a": a, "b": b, "n": np.concatenate([n.to_numpy(np.int64), np.zeros(len(links), np.int64)])})


def _compare(least: float):
    """Sorted rows of whole groups, which may go on from one batch to the next."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            last = (pdf[GROUP] == pdf[GROUP].iloc[-1]).all(axis=1) if len(pdf) else pd.Series([], dtype=bool)
            held = pdf[last]
            for _, part in pdf[~last].groupby("dim"):
                yield _linked(part, least)
        if held is not None and len(held):
            yield _linked(held, least)

    return run


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98) -> DataFrame:
    """-> ``(id, n_links, component_id)`` for every row; ``label`` is any type that casts to string."""
    scratch = Scratch(rows.sparkSession)
    d = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("e"))
    fit = "label IS NOT NULL AND size(e) > 0 AND NOT exists(e, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity')) AND exists(e, x -> x <> 0)"
    d = d.withColumn("fit", F.coalesce(F.expr(fit), F.lit(False))).withColumn("key", F.when(F.col("fit"), F.xxhash64("label", F.expr("transform(e, x -> x + 0D)"))))
    thin = scratch.table(d.select("id", "key"), "rows")
    sizes = thin.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("size"))
    sizes = scratch.table(sizes, "classes")

    def raw(batches):
        for pdf in batches:
            vectors = [np.asarray(x, "<f8") for x in pdf["e"]]
            own: list = [b""] * len(vectors)
            for rows, unit in _groups(vectors):
                every = np.concatenate([cells(unit, t) for t in range(TABLES)], 1)
                for r, k in zip(rows, every, strict=True):
                    own[r] = k.tobytes()
            yield pd.DataFrame({"rep": pdf["key"].to_numpy(), "label": pdf["label"].to_numpy(), "size": pdf["size"].to_numpy(), "v": [x.tobytes() for x in vectors], "cells": own})

    one = d.where("fit").alias("d").join(sizes.alias("s"), F.expr("d.key = s.key AND d.id <=> s.first")).select("d.key", "label", "size", "e").dropDuplicates(["key"])
    vectors = scratch.table(one.mapInPandas(raw, "rep long, label string, size long, v binary, cells binary"), "vectors")
    met = vectors.mapInPandas(_keys, "label string, dim int, t int, cell long, own boolean, rep long")
    met = scratch.table(met, "cells")
    at = ["label", "dim", "t", "cell"]
    count = met.groupBy(*at).agg(F.count("*").alias("m"), F.expr("bool_or(own)").alias("some")).where("some AND m > 1").select(*at, F.expr(f"cast(ceil(m / {BLOCK}) AS int)").alias("nb"))
    live = met.join(count, at).withColumn("i", F.expr("cast(pmod(xxhash64(rep, 3), nb) AS int)"))
    k = F.explode(F.expr("sequence(0, nb - 1)"))
    left = live.where("own").select(*at, "rep", "own", "i", k.alias("j"), F.lit(0).alias("side"))
    right = live.select(*at, "rep", "own", F.col("i").alias("j"), k.alias("i"), F.lit(1).alias("side")).select(*at, "rep", "own", "i", "j", "side")
    placed = left.union(right).join(vectors.select("rep", "size", "v", "cells"), "rep")
    found = scratch.table(placed.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInPandas(_compare(least), "a long, b long, n long"), "found")
    joined = components(found.where("b IS NOT NULL").select("a", "b"), scratch, "cc")
    links = found.where("b IS NULL").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n"))
    classes = sizes.join(links, "key", "left").join(joined.select(F.col("node").alias("key"), "component"), "key", "left")
    classes = classes.select("key", "first", F.expr("coalesce(n, 0) + size - 1").alias("n_links"), F.coalesce("component", "key").alias("grp"))
    low = classes.groupBy("grp").agg(F.min("first").alias("component_id"))
    known = classes.join(low, "grp").select("key", "n_links", "component_id")
    out = thin.join(known, "key", "left").select("id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return keep(out, scratch)
