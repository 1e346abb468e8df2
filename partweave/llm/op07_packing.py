"""Hierarchical packing of token sequences into windows of several lengths.

Each task packs the documents of its own partition; nothing is shuffled and a task holds about ``HOLD``
tokens at a time, so the work grows with the input alone.

1. A document's whole windows of the longest tier are cut off; its rest goes to the tier of the least
   window (a power of two) that holds it.
2. Each tier is packed, longest first: a window takes a rest of its own tier, then the longest pieces
   of shorter tiers that fit its gap; the gap that no piece fits is filled by cutting one.
3. Windows that cannot be filled wait for the next documents.  At the end of a task the waiting pieces
   are joined and cut into windows of falling powers of two, so no window needs padding.
4. Windows of a tier form step groups of ``step`` tokens each, whatever the tier: 64 windows of 2048
   or 512 of 256, so that steps are balanced by tokens.  Only a task's last group of each tier is smaller, and
   windows below the shortest tier, of which a task's end makes one of each power of two at most, are groups of their own.

Defined cases: null and empty texts are one end id; rows with equal or null ids are packed apart; an
empty table has no pieces.  Equal inputs in equal partitions give equal windows, also after a retry.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready
from .words import chunks

HOLD = 4_000_000
SCHEMA = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window int, step_group long"


@lru_cache(2)
def encoder(path: str, ranks: str | None = None):
    """texts -> ids as the tokenizers library gives them for ``path``.

    ``ranks`` names the same vocabulary as merge ranks.  Their faster encoder takes the texts of ASCII and
    Latin letters, where both libraries' character classes agree; all others go through tokenizers itself.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    if ranks is None:
        return lambda texts: [x.ids for x in tok.encode_batch_fast(texts, add_special_tokens=False)]
    import public_tokenizers
    import tiktoken

    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(ranks).read_bytes().splitlines())}
    special = {t.content: i for i, t in tok.get_added_tokens_decoder().items()}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens=special)
    other = re.compile("[^\x00-\u024f]|\\s{4096}")  # long white space exhausts the faster encoder's stack

    def ids(t: str) -> list[int]:
        if not other.search(t):
            try:
                return fast.encode(t, allowed_special="all")
            except ValueError:  # its pattern gave up on this text
                pass
        return tok.encode(t, add_special_tokens=False).ids

    return lambda texts: [ids(t) for t in texts]


class Packer:
    """Packs pieces (document number, start, length) of one task; ``windows`` yields finished ones."""

    def __init__(self, longest: int = 2048, shortest: int = 256):
        self.longest, self.shortest = longest, shortest
        self.rests: list[tuple[int, int, int]] = []  # (length, document, start), ascending

    def add(self, doc: int, tokens: int) -> Iterator[list[tuple[int, int, int]]]:
        full = tokens // self.longest * self.longest
        for at in range(0, full, self.longest):
            yield [(doc, at, self.longest)]
        if tokens > full:
            insort(self.rests, (tokens - full, doc, full))

    def _tier(self, length: int) -> int:
        return max(self.shortest, 1 << (length - 1).bit_length())

    def fill(self) -> Iterator[list[tuple[int, int, int]]]:
        """Full windows, longest tiers first, as far as the pieces reach."""
        rests = self.rests
        while rests:
            size = self._tier(rests[-1][0])
            if sum_at_least(rests, size):
                n, doc, at = rests.pop()
                out, gap = [(doc, at, n)], size - n
                while gap:
                    k = bisect_right(rests, (gap, float("inf"), 0)) - 1
                    if k >= 0:
                        n, doc, at = rests.pop(k)
                        out.append((doc, at, n))
                        gap -= n
                    else:  # every piece is longer than the gap: cut the shortest
                        n, doc, at = rests.pop(0)
                        out.append((doc, at, gap))
                        insort(rests, (n - gap, doc, at + gap))
                        gap = 0
                yield out
            else:
                return

    def end(self) -> Iterator[list[tuple[int, int, int]]]:
        left = sum(n for n, _, _ in self.rests)
        while left:
            size = min(self.longest, 1 << (left.bit_length() - 1))
            out, gap = [], size
            while gap:
                n, doc, at = self.rests.pop()
                take = min(n, gap)
                out.append((doc, at, take))
                if n > take:
                    self.rests.append((n - take, doc, at + take))
                gap -= take
            left -= size
            yield out


def sum_at_least(rests: list[tuple[int, int, int]], size: int) -> bool:
    total = 0
    for n, _, _ in reversed(rests):
        total += n
        if total >= size:
            return True
    return False


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, longest: int = 2048, shortest: int = 256, step: int = 131_072, ranks: str | None = None) -> DataFrame:
    """-> one row per piece, see ``SCHEMA``; ``step`` is the number of tokens in a step group."""
    ready(docs.sparkSession)
    if longest & (longest - 1) or shortest & (shortest - 1) or step < longest:
        raise ValueError("window sizes are powers of two and a step holds at least one window")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        encode, base = encoder(path, ranks), TaskContext.get().partitionId() << 36
        packer, held, made = Packer(longest, shortest), {}, 0
        per_tier: dict[int, int] = {}
        rows: list[tuple] = []
        number = size = 0

        def put(windows) -> None:
            nonlocal made
            for window in windows:
                total = sum(n for _, _, n in window)
                group = per_tier.get(total, 0)
                per_tier[total] = group + 1
                group = base | (total.bit_length() << 30) | (group * total // step)
                offset = 0
                for doc, at, n in window:
                    ids, name = held[doc]
                    rows.append((name, at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids), base | made, offset, total, group))
                    offset += n
                made += 1

        def flush() -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            out["id"] = pd.array([r[0] for r in rows], "Int64")
            rows.clear()
            live = {d for _, d, _ in packer.rests}
            for d in [d for d in held if d not in live]:
                del held[d]
            return out

        for pdf in batches:
            names, texts = pdf.column(0).to_pylist(), pdf.column(1).to_pylist()
            for a, b in chunks(texts, 500_000):
                for name, ids in zip(names[a:b], encode(texts[a:b]), strict=True):
                    ids = np.append(np.array(ids, "<u4"), np.uint32(end_id)).astype("<u4")
                    held[number] = ids, name
                    put(packer.add(number, len(ids)))
                    number, size = number + 1, size + len(ids)
                if size > HOLD:
                    put(packer.fill())
                    yield flush()
                    size = 0
        put(packer.fill())
        put(packer.end())
        if rows:
            yield flush()

    def arrow(batches):
        schema = pa.schema([(c.split()[0], pa.int32() if c.endswith("int") else pa.int64()) for c in SCHEMA.split(", ")])
        for pdf in run(batches):
            yield pa.RecordBatch.from_pandas(pdf, schema, preserve_index=False)

    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return docs.mapInArrow(arrow, SCHEMA)
