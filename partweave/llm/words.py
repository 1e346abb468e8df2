"""Words and word shingles of many texts at once, as flat numpy arrays.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return; ``A-Z`` are lower-cased.  Words are hashed to 64 bits, eight bytes of all words per step, so
no Python object is made for a word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_ODD1, _ODD2, _ODD3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_TAIL = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
LONG_WORD = 512


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * _ODD2
    x = (x ^ (x >> np.uint64(27))) * _ODD3
    return x ^ (x >> np.uint64(31))


def chunks(texts: list, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``most`` characters each; one text alone may be longer."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > most:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


def word_hashes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words begin (one more entry than texts)."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(b) + 1 for b in raw], dtype=np.int64)
    joined = b"\n".join([*raw, b""]).lower() + b" " * 8
    data = np.frombuffer(joined, np.uint8)
    gap = _SPACE[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(data) and not gap[0]:
        edge = np.concatenate(([0], edge))
    starts, stops = edge[0::2], edge[1::2]
    size = stops - starts
    eight = np.ndarray((len(data) - 7,), "<u8", joined, 0, (1,))
    h = mix(size.astype(np.uint64) * _ODD1 + np.uint64(1))
    live, k = np.arange(len(starts)), 0
    while len(live) and k < LONG_WORD:
        left = size[live] - k
        v = eight[starts[live] + k] & _TAIL[np.minimum(left, 8)]
        h[live] = mix(h[live] * _ODD1 ^ v)
        k += 8
        live = live[left > 8]
    for i in live:  # the rest of very long words at once
        tail = joined[starts[i] + k : stops[i]]
        h[i] = mix(h[i : i + 1] ^ np.frombuffer(hashlib.blake2b(tail, digest_size=8).digest(), "<u8"))[0]
    return h, np.concatenate(([0], np.searchsorted(starts, ends))).astype(np.int64)


def shingle_sets(texts: list, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    A text of one word to ``width - 1`` words has one shingle, its whole word sequence; a text
    without words (or null) has none.
    """
    out: list[np.ndarray] = []
    for a, b in chunks(texts):
        h, at = word_hashes(texts[a:b])
        n = max(0, len(h) - width + 1)
        s = mix(h[:n] + _ODD1)
        for j in range(1, width):
            s = mix(s * _ODD1 ^ h[j : n + j])
        for i in range(b - a):
            lo, hi = at[i], at[i + 1]
            if hi - lo >= width:
                out.append(np.unique(s[lo : hi - width + 1]))
            elif hi > lo:
                one = mix(np.uint64([hi - lo]))
                for x in h[lo:hi]:
                    one = mix(one * _ODD1 ^ x)
                out.append(one)
            else:
                out.append(h[:0])
    return out


def digest(tokens: np.ndarray) -> bytes:
    """128 bits that stand for the whole set."""
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
