"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Words of a batch (a run of spaces with the characters after it) are encoded together: their symbols
lie in one flat array; each round looks up the rank of every adjacent pair, takes the least rank per
word (a segmented minimum), merges all leftmost non-overlapping pairs of that rank at once and compacts
the array; words without a mergeable pair leave.  A worker remembers the words it has met.  Words are cut
first between characters that stand together in no piece, so one long run without spaces is many short parts.

The model must be BPE with the identity normaliser, byte fallback and no user-defined symbols; others
are refused.  Null text counts as empty: its ids are the end id alone and its decoded text is empty.
Text of any length is one row; rows with equal ids stay apart; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready
from .words import chunks

SPACE = "▁"
NEVER = np.int32(2**31 - 1)
REMEMBERED = 300_000  # words a worker keeps; beyond that it starts afresh
AT_ONCE = 100_000  # words of one merge run


class Model:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) for i in range(n)]
        names = sp.id_to_piece(list(range(n)))
        self.n, self.end, self.unknown = n, sp.eos_id(), sp.unk_id()
        self.bytes_at = np.array(sp.piece_to_id([f"<0x{b:02X}>" for b in range(256)]), np.int32)
        if any(sp.is_unused(i) for i in range(n)) or not all(sp.is_byte(int(i)) for i in self.bytes_at) or sp.normalize("   aﬁ  ") != f"{SPACE}{SPACE} {SPACE}aﬁ{SPACE}{SPACE}":
            raise ValueError("only BPE models with byte fallback and the identity normaliser are supported")
        at = {p: i for i, p in enumerate(names) if plain[i]}
        scores = np.array([sp.get_score(i) for i in range(n)])
        _, rank = np.unique(-scores, return_inverse=True)
        used = {c for p in at for c in p}
        self.char = np.full(0x110000, -1, np.int64)
        for c in used:
            self.char[ord(c)] = at.get(c, n + ord(c))
        free = self.char < 0
        self.char[free] = n + np.flatnonzero(free)  # symbols outside the vocabulary
        symbol = {c: int(self.char[ord(c)]) for c in used} | at
        pairs = {}
        for p, i in at.items():
            for k in range(1, len(p)):
                if p[:k] in symbol and p[k:] in symbol:
                    pairs[symbol[p[:k]], symbol[p[k:]]] = i
        self._hash(pairs, rank)
        order = {p: int(rank[i]) for p, i in at.items()}
        times = np.bincount(rank[[i for i in at.values()]], minlength=n)
        #: Pieces after which an equal or better pair may appear beside them: one such merge per word and round.
        self.alone = np.zeros(n, bool)
        for (a, b), i in pairs.items():
            for part in (a, b):
                if part < n and plain[part] and rank[i] <= rank[part]:
                    self.alone[part] = True
            if times[rank[i]] > 1:
                self.alone[i] = True
        self.one_word = any(SPACE in p.lstrip(SPACE) for p in order)
        near = np.array(sorted({ord(a) << 21 | ord(b) for p in order for a, b in zip(p, p[1:])}), np.int64)
        self.near = near if len(near) else np.array([-1])
        inside = "" if "\n" in used else "\n"  # a character of no piece parts words
        self.words = re.compile(f"{inside}| *[^ {inside}]+| +" if inside else " *[^ ]+| +")
        self.text = [p.replace(SPACE, " ").encode() if plain[i] else bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" for i, p in enumerate(names)]
        self.text[self.unknown] = " ⁇ ".encode()
        self.spaced = np.array([plain[i] and p.startswith(SPACE) for i, p in enumerate(names)])
        self.known: dict[str, bytes] = {}

    def _hash(self, pairs: dict, rank: np.ndarray) -> None:
        """An open-addressing table of pairs, so that a lookup is a few gathers."""
        size = 1 << max(4, int(np.ceil(np.log2(4 * max(1, len(pairs))))))
        self.shift = np.uint64(64 - int(np.log2(size)))
        self.keys = np.full(size, np.uint64(2**64 - 1))
        self.made, self.rank = np.full(size, -1, np.int64), np.full(size, NEVER, np.int32)
        self.most = 1
        for (a, b), i in pairs.items():
            k = (a << 32) | b
            s, probe = ((k * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> int(self.shift), 1
            while self.keys[s] != np.uint64(2**64 - 1):
                s, probe = (s + 1) % size, probe + 1
            self.keys[s], self.made[s], self.rank[s] = k, i, rank[i]
            self.most = max(self.most, probe)

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The merged piece and its rank for each pair; rank NEVER where there is none."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = ((key * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        made, rank = np.full(len(key), -1, np.int64), np.full(len(key), NEVER, np.int32)
        todo = np.arange(len(key))
        for _ in range(self.most):
            found = self.keys[slot[todo]]
            hit = found == key[todo]
            at = todo[hit]
            made[at], rank[at] = self.made[slot[at]], self.rank[slot[at]]
            todo = todo[~hit & (found != np.uint64(2**64 - 1))]
            if not len(todo):
                break
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
        return made, rank

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All words' final symbols in one array, and where each word begins (one more entry)."""
        joined = "".join(words).replace(" ", SPACE)
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        symbol = self.char[code]
        # no piece spans two characters that are neighbours in none, so a word is cut there into parts
        pair = code[:-1].astype(np.int64) << 21 | code[1:]
        apart = self.near[np.minimum(np.searchsorted(self.near, pair), len(self.near) - 1)] != pair
        length = np.array([len(w) for w in words], np.int64)
        begin = np.concatenate(([0], np.cumsum(length)))
        new = np.zeros(len(code) + 1, bool)
        new[1:-1] = apart
        new[begin[:-1][length > 0]] = True
        word = np.cumsum(new[:-1])
        parts = np.append(word, (word[-1] if len(word) else 0) + 1)[np.minimum(begin, len(word))]  # the first part of each word
        done_symbol, done_word = [], []
        while len(symbol):
            made, rank = self.look(symbol[:-1], symbol[1:])
            rank[word[:-1] != word[1:]] = NEVER
            rank = np.append(rank, NEVER)
            start = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            length = np.diff(np.append(start, len(word)))
            least = np.minimum.reduceat(rank, start)
            going = np.repeat(least != NEVER, length)
            if not going.all():
                done_symbol.append(symbol[~going])
                done_word.append(word[~going])
                if not going.any():
                    break
            least = np.repeat(least, length)[going]
            symbol, word, rank, made = symbol[going], word[going], rank[going], np.append(made, -1)[going]
            take = rank == least
            # alternate places of a run, from its left: pairs of a run overlap
            place = np.arange(len(take))
            before = np.maximum.accumulate(np.where(take, -1, place))
            take &= ((place - before) & 1) == 1
            at = np.flatnonzero(take)
            single = self.alone[made[at]]
            if single.any():  # only the leftmost of its word
                first = np.concatenate(([True], word[at][1:] != word[at][:-1]))
                at = at[first | ~_any_of(word[at], single)]
            symbol[at] = made[at]
            left = np.ones(len(symbol), bool)
            left[at + 1] = False
            symbol, word = symbol[left], word[left]
        symbol, word = np.concatenate([*done_symbol, symbol[:0]]), np.concatenate([*done_word, word[:0]])
        order = np.argsort(word, kind="stable")
        return symbol[order], np.searchsorted(word[order], parts)

    def ids(self, symbol: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols outside the vocabulary become the ids of their UTF-8 bytes."""
        out = symbol >= self.n
        if not out.any():
            return symbol.astype(np.int32), at
        raw = ["".join(map(chr, symbol[out] - self.n))][0]
        parts = [self.bytes_at[list(c.encode("utf-8", "surrogatepass"))] for c in raw]
        size = np.ones(len(symbol), np.int64)
        size[out] = [len(p) for p in parts]
        stop = np.cumsum(size)
        ids = np.repeat(symbol, size).astype(np.int32)
        ids[np.repeat(out, size)] = np.concatenate(parts)
        return ids, np.concatenate(([0], stop))[at]

    def learn(self, words: set[str]) -> None:
        new = list(words)
        for k in range(0, len(new), AT_ONCE):
            part = new[k : k + AT_ONCE]
            ids, at = self.ids(*self.merge(part))
            raw = ids.astype("<i4").tobytes()
            self.known.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(part, at[:-1].tolist(), at[1:].tolist(), strict=True))

    def encode(self, texts: list) -> list[np.ndarray]:
        """Ids of each text with the end id."""
        out = []
        end = np.int32(self.end).tobytes()
        for a, b in chunks(texts, 2_000_000):
            cut = [([" " + t.replace(SPACE, " ")] if self.one_word else self.words.findall(" " + t.replace(SPACE, " "))) if t else [] for t in texts[a:b]]
            new = set().union(*cut) - self.known.keys()
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
                new = set().union(*cut)
            self.learn(new)
            out += [np.frombuffer(b"".join(map(self.known.__getitem__, ws)) + end, "<i4") for ws in cut]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: control ids vanish, a byte that is no UTF-8 becomes U+FFFD, the space put before the text goes."""
        parts = list(map(self.text.__getitem__, ids.tolist()))
        raw = b"".join(parts)
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = "".join("�" if "\udc80" <= c <= "\udcff" else c for c in raw.decode("utf-8", "surrogateescape"))
        first = next((int(i) for i in ids if self.text[i]), self.unknown)
        return text[1:] if self.spaced[first] else text


def _any_of(groups: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """For each entry of a sorted array of groups, whether a flag of its group is set."""
    start = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
    some = np.logical_or.reduceat(flags, start)
    return np.repeat(some, np.diff(np.append(start, len(groups))))


@lru_cache(2)
def model(path: str) -> Model:
    return Model(path)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> ``(id, ids array<int>, decoded string)``: the ids with the end id, and the text they decode to."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts, 1_000_000):
                ids = own.encode(texts[a:b])
                at = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(ids), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), flat, pa.array([own.decode(x) for x in ids], pa.string())], ["id", "ids", "decoded"])

    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, "id long, ids array<int>, decoded string")
