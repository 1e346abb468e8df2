"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents are compared by their sets of distinct word shingles; two link when
``100 * |A & B| >= percent * |A | B|``.

1. Documents with equal sets form a class (128-bit set digest); only classes are compared.  Sets are
   computed anew from the texts by each step that needs them, which takes less than storing them.
2. Blocks of documents ask, per range of token values, how many documents hold their tokens.  A token counts once
   per block in that exchange, so one held by a third of all documents is a number per block; a byte
   comes back for each.  Tokens of one document alone come first in the rare-first order and match nothing.
3. Each class indexes the repeated tokens in a prefix of its ordered tokens.  With ``t = ceil(percent/100 * n)``
   two linked classes share at least ``l`` of their first ``n - t + l`` tokens, for any ``l``.  Each class picks
   the ``l`` with the least estimated cost (index rows plus expected false candidates), and a pair is
   a candidate only when it shares ``min(l1, l2)`` prefix tokens.
4. Tokens of few classes emit pairs; the shared tokens of a pair are counted and pairs below their
   required number are dropped.  What remains is grouped (components of candidate pairs).  A token of
   many classes emits no pairs: its classes are a group.  Tokens whose classes share the least hash, so mostly
   tokens of about the same classes, make one group of all their classes.
5. Groups are verified on whole sets.  The first pass deals a group's classes to blocks, each
   with two pivots of the group, and compares all of a block, so a group of one block is done; rows grow with
   the group, not its square, and most of a group of near copies joins up through the pivots.  In the second
   pass, candidate pairs of larger groups that are still in two components are compared one by one; of the groups of
   frequent tokens, the classes outside the largest component are compared with all classes of the group, in
   rectangular blocks.  Two classes are left uncompared only when they are in one component already.
6. Blocks report only the links that join something new within the block, and the connected
   components of those links are the result.  No link is lost: a verified pair of classes is always
   inside the component its block reports.

Intermediate tables go as soon as their last reader has ended; only the result stays.

Defined cases: null text, empty text and text of white space have no shingles, size 0 and link with
nothing (component = own id).  Rows with equal ids are separate rows of the result.  A row with a null
id keeps its size and takes part in its class; its component is that of the class, null if no id is in reach.
Tokens and classes are told apart by 64 bits of their hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, keep
from .components import components
from .words import chunks, digest, shingle_sets

FEW = 32  # a token in at most so many classes emits its pairs
BLOCK = 128  # classes of a block, or on each side of a rectangular one
MOST_MATCHES = 8
SALTS = 16  # parts into which the classes of a group are dealt when looking up what holds for the group
REMEMBERED = 200_000  # digests a task remembers to skip its own copies; more copies only cost time
BLOCK_TOKENS, BLOCK_DOCS = 500_000, 16_384  # of a block
RANGE_TOKENS = 1_000_000  # tokens of a range, about
EXACT = 64  # numbers of documents up to here are kept exact, greater ones in steps
BITS = 25  # of the fixed-size filter that keeps most sets without candidates out of the exchange

PACKED = "src long, part int, tokens binary, nums binary, keys binary"


def _first(b: bytes) -> int:
    return int.from_bytes(b[:8], "little", signed=True)


def lowest(n, percent: int):
    """The least overlap with any linked set: ceil(percent/100 * n)."""
    return -(-percent * n // 100)


def _new_sets(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(class key, set) of the texts in the last column that another set can link to, a task's own copies once."""
    seen: set[int] = set()
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        for a, b in chunks(texts, 1_000_000):
            for tokens in shingle_sets(texts[a:b], width):
                n = len(tokens)
                if not n or (lowest(n, percent) == n and 100 * n // percent == n):
                    continue
                key = _first(digest(tokens))
                if key not in seen:
                    if len(seen) < REMEMBERED:
                        seen.add(key)
                    yield key, tokens


def _facts(width: int):
    """Per document (first columns as given): size, set digest and its first 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.num_columns - 1
            texts = batch.column(given).to_pylist()
            for a, b in chunks(texts, 1_000_000):
                sets = shingle_sets(texts[a:b], width)
                marks = [digest(t) if len(t) else None for t in sets]
                own = [pa.array([len(t) for t in sets], pa.int64()), pa.array(marks, pa.binary()), pa.array([None if d is None else _first(d) for d in marks], pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(a, b - a) for k in range(given)] + own, [*batch.schema.names[:given], "n", "digest", "key"])

    return run


def _pack(ascending: np.ndarray) -> bytes:
    """The differences of ascending numbers, all lowest bytes first, so that the many zero bytes stand together."""
    d = np.diff(ascending, prepend=ascending.dtype.type(0))
    return d.view(np.uint8).reshape(len(d), d.itemsize).T.tobytes()


def _unpack(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.cumsum(np.frombuffer(raw, np.uint8).reshape(size, -1).T.copy().view(kind).ravel(), dtype=kind)


def _blocks(width: int, percent: int, ranges: int, asks: bool):
    """Texts -> blocks of sets: what each asks of the ranges (``asks``), or the block itself.

    Tokens are short here: the range of the token's upper half above its lower half.  Two tokens seldom share one;
    where they do, their numbers of documents are summed, which changes the order for all sets alike, and
    they count as a shared token of candidates, which are verified on whole sets.
    """
    schema = pa.schema([("src", pa.int64()), ("part", pa.int32()), ("tokens", pa.binary()), ("nums", pa.binary()), ("keys", pa.binary())])

    def block(src: int, held: list[np.ndarray], keys: list[int]) -> pa.RecordBatch:
        lens = np.array([len(t) for t in held], np.uint32)
        tokens = np.concatenate(held)
        part = ((tokens >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        tokens = part << np.uint64(32) | tokens & np.uint64(2**32 - 1)
        order = np.argsort(tokens, kind="stable")
        tokens = tokens[order]
        first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
        count, short = np.diff(np.append(first, len(tokens))), tokens[first]
        if not asks:
            doc = np.repeat(np.arange(len(held), dtype=np.uint16), lens)[order]
            nums = np.uint64([len(short), len(held)]).tobytes() + count.astype(np.uint16).tobytes() + lens.tobytes() + doc.tobytes()
            rows = [[src], [-1], [_pack(short)], [nums], [np.array(keys, np.int64).tobytes()]]
        else:
            part, low = short >> np.uint64(32), short.astype(np.uint32)
            at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            cuts = list(zip(at, np.append(at[1:], len(short)), strict=True))
            count = np.minimum(count, 255).astype(np.uint8)
            rows = [np.full(len(at), src), part[at].astype(np.int32), [_pack(low[i:j]) for i, j in cuts], [count[i:j].tobytes() for i, j in cuts], [None] * len(at)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        keys: list[int] = []
        size, src = 0, TaskContext.get().partitionId() << 32
        for key, tokens in _new_sets(batches, width, percent):
            held.append(tokens)
            keys.append(key)
            size += len(tokens)
            if size >= BLOCK_TOKENS or len(held) >= BLOCK_DOCS:
                yield block(src, held, keys)
                held, keys, size, src = [], [], 0, src + 1
        if held:
            yield block(src, held, keys)

    return run


def grade(df: np.ndarray) -> np.ndarray:
    """Numbers of documents in a byte: exact to ``EXACT``, then eight steps to each doubling."""
    return np.minimum(np.where(df <= EXACT, df, EXACT + np.floor(8 * np.log2(np.maximum(df, 1) / EXACT))), 255).astype(np.uint8)


#: the least number of documents of each grade
GRADES = np.array([k if k <= EXACT else EXACT * 2 ** ((k - EXACT) / 8) for k in range(256)]).astype(np.int64)


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """The requests of a range -> for each block the grades of its tokens, in the order it sent them."""
    parts = [_unpack(b, np.uint32) for b in pdf["tokens"]]
    tokens = np.concatenate(parts)
    count = np.concatenate([np.frombuffer(b, np.uint8) for b in pdf["nums"]]).astype(np.int64)
    order = np.argsort(tokens, kind="stable")
    ranked = tokens[order]
    start = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    graded = np.empty(len(tokens), np.uint8)
    graded[order] = np.repeat(grade(np.add.reduceat(count[order], start)), np.diff(np.append(start, len(ranked))))
    at = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    own = [graded[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
    return pd.DataFrame({"src": pdf["src"], "part": pdf["part"], "tokens": None, "nums": own, "keys": None})


def needs(n: np.ndarray, repeated: np.ndarray, before, percent: int, classes: int) -> np.ndarray:
    """How many prefix matches to require of each set: least index rows plus expected wasted verifications.

    ``repeated`` is the number of a set's tokens that others hold; ``before(k)`` gives, per set, the sum over its
    first ``k`` repeated tokens of the other documents that hold them.  Chance candidates of one match are that
    sum ``x``; each further match by chance is rarer by ``x / classes``.
    """
    t = lowest(n, percent)
    best, at = np.full(len(n), np.inf), np.ones(len(n), np.int64)
    for need in range(1, MOST_MATCHES + 1):
        rows = np.clip(n - t + need - (n - repeated), 0, repeated)
        x = before(rows).astype(float)
        cost = rows + (4 + n / 8) * x * np.minimum(0.5, x / max(1, classes)) ** (need - 1)
        better = (cost < best) & (need <= t)
        best, at = np.where(better, cost, best), np.where(better, need, at)
    return at


def _prefixes(percent: int, classes: int):
    """A block and its answers -> index rows ``(token, key, need, n, df)`` of repeated prefix tokens."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["part"] < 0].iloc[0]
        told = pdf[pdf["part"] >= 0].sort_values("part")
        keys, nums = np.frombuffer(own["keys"], np.int64), own["nums"]
        u, m = (int(x) for x in np.frombuffer(nums, np.uint64, 2))
        count, lens, doc = np.frombuffer(nums, np.uint16, u, 16), np.frombuffer(nums, np.uint32, m, 16 + 2 * u).astype(np.int64), np.frombuffer(nums, np.uint16, -1, 16 + 2 * u + 4 * m)
        graded = np.repeat(np.concatenate([np.frombuffer(b, np.uint8) for b in told["nums"]]), count)
        token = np.repeat(_unpack(own["tokens"], np.uint64), count)
        hit = graded > 1
        doc, token, graded = doc[hit].astype(np.int64), token[hit], graded[hit]
        order = np.lexsort((token, graded, doc))
        doc, token, df = doc[order], token[order], GRADES[graded[order]]
        repeated = np.bincount(doc, minlength=len(lens))
        first = np.concatenate(([0], np.cumsum(repeated)[:-1]))
        sums = np.concatenate(([0], np.cumsum(df - 1)))
        need = needs(lens, repeated, lambda k: sums[first + k] - sums[first], percent, classes)
        rows = np.clip(lens - lowest(lens, percent) + need - (lens - repeated), 0, repeated)
        take = np.arange(len(doc)) - first[doc] < rows[doc]
        doc, token = doc[take], token[take]
        return pd.DataFrame({"token": token.view(np.int64), "key": keys[doc], "need": need[doc], "n": lens[doc], "df": df[take]})

    return run


def _bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keys -> the bytes of a bit array that are not zero, as (place, value)."""
    bits = np.zeros(1 << (BITS - 3), np.uint8)
    for pdf in batches:
        slot = pdf["key"].to_numpy().astype(np.uint64) >> np.uint64(64 - BITS)
        np.bitwise_or.at(bits, (slot >> np.uint64(3)).astype(np.int64), (1 << (slot & np.uint64(7))).astype(np.uint8))
    step = 1 << 12
    for k in range(0, len(bits), step):
        if bits[k : k + step].any():
            yield pd.DataFrame({"k": [k], "b": [bits[k : k + step].tobytes()]})


def _either(pdf: pd.DataFrame) -> pd.DataFrame:
    out = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in pdf["b"]])
    return pd.DataFrame({"k": pdf["k"].iloc[:1].to_numpy(), "b": [out.tobytes()]})


def _sets(width: int, percent: int, shared):
    """Texts -> (class key, its token set) of the classes that may be among those of the bit array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        keys: list[int] = []
        sets: list[bytes] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], ["key", "tokens"])

        for key, tokens in _new_sets(batches, width, percent):
            slot = (key & (2**64 - 1)) >> (64 - BITS)
            if bits[slot >> 3] >> (slot & 7) & 1:
                keys.append(key)
                sets.append(tokens.tobytes())
                if len(keys) >= 1024:
                    yield out()
                    keys, sets = [], []
        if keys:
            yield out()

    return run


def linked(sets: list[np.ndarray], split: int, percent: int) -> list[tuple[int, int]]:
    """Spanning links of a block: pairs (i < split <= j), or all pairs i < j where split is 0.

    Intersections are counted by products of 0/1 matrices over slices of the tokens that at least two
    sets hold.  Only links that join two parts not joined before are returned.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, bool)
    col = np.cumsum(new) - 1
    often = np.bincount(col, minlength=1)[col] > 1 if len(flat) else new
    row, col = row[often], col[often]
    left, right = (np.arange(split), np.arange(split, n)) if split else (np.arange(n), np.arange(n))
    common = np.zeros((len(left), len(right)), np.float32)
    step, at = 2048, 0
    if len(col):
        col = np.unique(col, return_inverse=True)[1]
        cuts = np.searchsorted(col, np.arange(0, int(col[-1]) + 1, step))
        for k, lo in enumerate(cuts):
            hi = cuts[k + 1] if k + 1 < len(cuts) else len(col)
            m = np.zeros((n, step), np.float32)
            m[row[lo:hi], col[lo:hi] - k * step] = 1
            common += m[left] @ m[right].T
    inter = common.astype(np.int64)
    ok = 100 * inter >= percent * (sizes[left][:, None] + sizes[right][None, :] - inter)
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(ok), strict=True):
        i, j = int(left[i]), int(right[j])
        if i == j:
            continue
        at, to = find(i), find(j)
        if at != to:
            parent[max(at, to)] = min(at, to)
            out.append((i, j))
    return out


def _verify(percent: int, all_pairs: bool):
    """Spanning links of a block: among all its classes, or of side 0 with side 1 (a class may be on both)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("key" if all_pairs else ["side", "key"]).sort_values(["side", "key"], kind="stable")
        keys = pdf["key"].to_numpy()
        sets = [np.frombuffer(b, np.uint64) for b in pdf["tokens"]]
        split = int((pdf["side"] == 0).sum())
        if len(sets) < 2 or (not all_pairs and split in (0, len(sets))):
            pairs = []
        else:
            pairs = linked(sets, 0 if all_pairs else split, percent)
        return pd.DataFrame({"a": np.array([keys[i] for i, _ in pairs], np.int64), "b": np.array([keys[j] for _, j in pairs], np.int64)})

    return run


def _pairs(percent: int):
    """Pairs with both sets -> those that link."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = []
            for x, y in zip(pdf["x"], pdf["y"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pdf.loc[ok, ["a", "b"]]

    return run


def _of_group(member: DataFrame, facts: DataFrame, how: str) -> DataFrame:
    """Members with what ``facts`` says of their group; a group's members are dealt by salt, not to one task."""
    spread = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return member.withColumn("salt", F.expr(f"cast(pmod(xxhash64(key, 11), {SALTS}) AS int)")).join(spread, ["kind", "grp", "salt"], how).drop("salt")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, carry: tuple[str, ...] = ()) -> DataFrame:
    """-> ``(id, n_shingles, component_id, component_key, *carry)``, a row for each row of ``docs``; see the module's text.

    ``component_id`` is the smallest id that links reach.  ``component_key`` tells components apart even where ids
    repeat or are null; rows without shingles have none.  ``carry`` names further columns of ``docs`` (longs) to keep.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    extra = [f"carry_{k}" for k in range(len(carry))]
    docs = docs.select(F.col(id_col).cast("long").alias("id"), *[F.col(c).cast("long").alias(n) for c, n in zip(carry, extra, strict=True)], F.col(text_col).cast("string").alias("text"))
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:  # rows that do not come straight from files could come in another order each time
        docs = scratch.table(docs, "docs")
    facts = ", ".join(f"{c} long" for c in ["id", *extra, "n"]) + ", digest binary, key long"
    facts = scratch.table(docs.mapInArrow(_facts(width), facts), "rows")
    classes, total = facts.where("digest IS NOT NULL").agg(F.count("*"), F.sum("n")).first()

    texts, ranges = docs.select("text"), max(1, -(-(total or 0) // RANGE_TOKENS))
    told = texts.mapInArrow(_blocks(width, percent, ranges, True), PACKED).groupBy("part").applyInPandas(_answer, PACKED)
    both = texts.mapInArrow(_blocks(width, percent, ranges, False), PACKED).union(told)
    index = both.groupBy("src").applyInPandas(_prefixes(percent, classes), "token long, key long, need int, n int, df long")
    live = scratch.table(index.distinct(), "live")

    often = live.where(F.col("df") > FEW).withColumn("salt", F.expr(f"cast(pmod(xxhash64(key, 11), {SALTS}) AS int)"))
    size = often.groupBy("token").agg(F.count("*").alias("size"), F.min(F.xxhash64("key")).alias("least"))
    sized = often.join(size.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["token", "salt"])
    sized = scratch.table(sized.select("token", "key", "need", "n", "size", "least"), "sized")
    few = live.where(F.col("df") <= FEW).select("token", "key", "need", "n").union(sized.where(F.col("size") <= FEW).select("token", "key", "need", "n"))
    pairs = (
        few.alias("x")
        .join(few.alias("y"), F.expr(f"x.token = y.token AND x.key < y.key AND 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"))
        .groupBy(F.col("x.key").alias("a"), F.col("y.key").alias("b"))
        .agg(F.count("*").alias("hits"), F.first(F.least("x.need", "y.need")).alias("need"))
        .where("hits >= need")
        .select("a", "b")
    )
    pairs = scratch.table(pairs, "pairs")
    scratch.drop("live")
    groups = components(pairs, scratch, "candidates")
    cold = groups.select(F.col("component").alias("grp"), "node").union(groups.select("component", "component")).distinct().select(F.lit(0).alias("kind"), "grp", F.col("node").alias("key"))
    hot = sized.where(F.col("size") > FEW).select(F.lit(1).alias("kind"), F.col("least").alias("grp"), "key").distinct()
    member = scratch.table(cold.union(hot), "members")
    scratch.drop("sized", "candidates")

    bits = np.zeros(1 << (BITS - 3), np.uint8)
    for k, b in member.select("key").mapInPandas(_bits, "k int, b binary").groupBy("k").applyInPandas(_either, "k int, b binary").collect():  # 4 MB in all, whatever the input
        bits[k : k + len(b)] = np.frombuffer(b, np.uint8)
    found = texts.mapInArrow(_sets(width, percent, spark.sparkContext.broadcast(bits)), "key long, tokens binary")
    sets = scratch.table(found.join(member.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]), "sets")

    group = member.groupBy("kind", "grp").agg(F.count("*").alias("m"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    large = scratch.table(group.where(F.col("m") > BLOCK).withColumn("nb", F.expr(f"cast(ceil(m / {BLOCK}) AS int)")), "large")
    at = ["kind", "grp", "i", "j"]
    own = _of_group(member, large.select("kind", "grp", "nb"), "left").select("kind", "grp", "key", F.expr("cast(coalesce(pmod(xxhash64(key, 7), nb), 0) AS int)").alias("i"))
    pivots = large.select("kind", "grp", F.explode(F.array("lo", "hi")).alias("key"), "nb").select("kind", "grp", "key", F.explode(F.expr("sequence(0, nb - 1)")).alias("i"))
    first = own.union(pivots).select("*", F.col("i").alias("j"), F.lit(0).alias("side"))
    links = scratch.table(first.join(sets, "key").groupBy(*at).applyInPandas(_verify(percent, True), "a long, b long"), "links")

    if not large.isEmpty():
        joined = components(links, scratch, "links_cc")
        part = joined.select(F.col("node").alias("key"), "component")
        of = _of_group(member, large.select("kind", "grp", "nb"), "inner").join(part, "key", "left")
        of = scratch.table(of.select("kind", "grp", "key", "nb", F.coalesce("component", "key").alias("part")), "parts")
        open_pairs = pairs.join(of.where("kind = 0").select(F.col("key").alias("a"), F.col("part").alias("pa")), "a").join(of.where("kind = 0").select(F.col("key").alias("b"), F.col("part").alias("pb")), "b")
        open_pairs = open_pairs.where("pa <> pb").select("a", "b").join(sets.select(F.col("key").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("tokens").alias("y")), "b")
        links = links.union(scratch.table(open_pairs.mapInPandas(_pairs(percent), "a long, b long"), "pair_links"))
        hot = of.where("kind = 1")
        parts = hot.groupBy("kind", "grp", "part").agg(F.count("*").alias("m"))
        rest = parts.groupBy("kind", "grp").agg(F.max_by("part", F.struct("m", "part")).alias("main"), (F.sum("m") - F.max("m")).alias("left"))
        rest = scratch.table(rest.where("left > 0").select("kind", "grp", "main", F.expr(f"cast(ceil(left / {BLOCK}) AS int)").alias("nr")), "rest")
        if not rest.isEmpty():
            open_ = _of_group(hot, rest, "inner")
            i, j = F.expr("cast(pmod(xxhash64(key, 5), nr) AS int)").alias("i"), F.expr("cast(pmod(xxhash64(key, 7), nb) AS int)").alias("j")
            rows_ = open_.where("part <> main").select("kind", "grp", "key", i, F.explode(F.expr("sequence(0, nb - 1)")).alias("j"), F.lit(0).alias("side"))
            columns = open_.select("kind", "grp", "key", F.explode(F.expr("sequence(0, nr - 1)")).alias("i"), j, F.lit(1).alias("side"))
            more = rows_.union(columns).join(sets, "key").groupBy(*at).applyInPandas(_verify(percent, False), "a long, b long")
            links = links.union(scratch.table(more, "block_links"))
    joined = components(links, scratch, "all_cc")
    scratch.drop("sets", "members", "parts", "pairs")

    # rows -> class -> component; only classes with a link to another are joined, texts without shingles are not
    low = facts.where("digest IS NOT NULL").groupBy("digest", "key").agg(F.min("id").alias("rep"))
    named = low.join(joined.select(F.col("node").alias("key"), "component"), "key", "left").select("digest", F.coalesce("component", "key").alias("grp"), "rep")
    named = scratch.table(named, "named")
    of = named.join(named.groupBy("grp").agg(F.min("rep").alias("component_id")), "grp").select("digest", "component_id", F.col("grp").alias("component_key"))
    shown = ["id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), "component_key", *[F.col(n).alias(c) for n, c in zip(extra, carry, strict=True)]]
    out = facts.where("digest IS NOT NULL").join(of, "digest", "left").select(*shown)
    none = facts.where("digest IS NULL").withColumns({c: F.lit(None).cast("long") for c in ("component_id", "component_key")}).select(*shown)
    out = scratch.table(out.union(none), "result")
    scratch.only("result")
    return keep(out, scratch)
