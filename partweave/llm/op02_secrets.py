"""Secret scans with structural confirmation.

Base kinds are patterns (assign, access, hex).  Further spans are reported only when what they encode
parses: signed tokens whose header and claims are JSON objects and whose header names an algorithm;
armoured blocks, base64 and hexadecimal runs that decode to a private key, that is nested tag-length-value
structures whose lengths fit exactly, or the binary key format of ssh; armoured blocks may stand in a string with
escaped line ends, and an encrypted one counts if it names its cipher and decodes to whole cipher blocks.  Structures
nested more than ``DEEPEST`` deep are not keys (keys nest 4 deep).  Every pattern is linear in the text.

Defined cases: null text counts as empty and has no spans; equal ids stay apart; spans of one text are
ordered by start, then by kind as in ``KINDS``; spans of different kinds may overlap; an empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready

KINDS = ("assign", "access", "hex", "jwt", "pem", "key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
DOTTED = re.compile(r"(?<![A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:[^-]|-(?!----))+)-----END \1-----")
RUN64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
RUN16 = re.compile(r"[0-9a-fA-F]{48,}")
SSH = b"openssh-key-v1\0"
DEEPEST = 12


def unbase64(s: str) -> bytes | None:
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def values(data: bytes) -> list[tuple[int, bytes]] | None:
    """The tag-length-value items that fill ``data`` exactly, or None."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > len(data):
                return None
            n, at = int.from_bytes(data[at : at + k], "big"), at + k
        if at + n > len(data):
            return None
        out.append((tag, data[at : at + n]))
        at += n
    return out


def nests(data: bytes, depth: int = 0) -> bool:
    """Whether all constructed items hold items whose lengths fit."""
    items = values(data)
    if items is None or depth > DEEPEST:
        return False
    return all(nests(v, depth + 1) for tag, v in items if tag & 0x20)


def private_key(data: bytes | None) -> bool:
    if not data:
        return False
    if data.startswith(SSH):
        at, fields = len(SSH), 0
        while fields < 3 and at + 4 <= len(data):  # cipher, kdf, options
            at, fields = at + 4 + int.from_bytes(data[at : at + 4], "big"), fields + 1
        return fields == 3 and at + 4 <= len(data)
    if data[0] != 0x30 or not nests(data):
        return False
    outer = values(data)
    inside = values(outer[0][1]) if outer and len(outer) == 1 else None
    if not inside:
        return False
    tags = [t for t, _ in inside]
    version = inside[0][1] if tags[0] == 2 else None
    if version in (b"\0", b"\1") and tags[1:3] == [0x30, 0x04]:  # key with its algorithm
        named = values(inside[1][1])
        return bool(named) and named[0][0] == 6
    if version == b"\0" and len(tags) >= 6 and set(tags) == {2}:  # numbers of an RSA or DSA key
        return True
    if version == b"\1" and tags[1:2] == [0x04]:  # key on a curve
        return True
    return tags[:2] == [0x30, 0x04] and len(tags) == 2 and (values(inside[0][1]) or [(0, b"")])[0][0] == 6  # encrypted


def signed_token(s: str) -> bool:
    parts = s.split(".")
    try:
        head, body = (json.loads(unbase64(p) or b"") for p in parts[:2])
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict) and unbase64(parts[2]) is not None


def base_spans(text: str) -> list[tuple[int, int, int]]:
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    out = [(m.start(), 3, m.end()) for m in DOTTED.finditer(text) if signed_token(m[0])] if "eyJ" in text else []
    if "-----BEGIN " in text:
        for m in ARMOUR.finditer(text):
            lines = re.sub(r"""\\[nr]|["'+,]*$""", "\n", m[2], flags=re.M).splitlines()  # also as a string of source code
            data = unbase64(re.sub(r"""[\s"']""", "", "".join(x for x in lines if ":" not in x)))
            sealed = any(x.strip().startswith("DEK-Info:") for x in lines) and data and len(data) >= 48 and len(data) % 8 == 0
            if sealed or private_key(data):
                out.append((m.start(), 4, m.end()))
    inside = [(a, b) for a, k, b in out if k == 4]
    runs = [(m, unbase64(m[0])) for m in RUN64.finditer(text)]
    runs += [(m, binascii.unhexlify(m[0])) for m in RUN16.finditer(text) if len(m[0]) % 2 == 0]
    for m, data in runs:
        if private_key(data) and not any(a <= m.start() and m.end() <= b for a, b in inside):
            out.append((m.start(), 5, m.end()))
    return sorted(set(out))


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by the name of its first kind."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> ``(id, base, spans)``: the base spans and all spans, written ``kind:start:end``, comma-joined."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, every = [], []
            for t in batch.column(1).to_pylist():
                found = base_spans(t)
                base.append(written(found))
                every.append(written(sorted(found + confirmed_spans(t))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.string()), pa.array(every, pa.string())], ["id", "base", "spans"])

    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return docs.mapInArrow(run, "id long, base string, spans string")


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with secrets in ``text_col`` replaced by their kind; null stays null."""
    ready(docs.sparkSession)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None else redacted(t, sorted(base_spans(t) + confirmed_spans(t))) for t in batch.column(place).to_pylist()]
            yield batch.set_column(place, batch.schema.field(place).name, pa.array(texts, pa.string()))

    return docs.mapInArrow(run, docs.schema)
