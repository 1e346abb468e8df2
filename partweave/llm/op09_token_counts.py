"""Token counts through a digest cache.

Every text has a content digest (SHA-256 of its UTF-8 bytes; nothing may be folded, as each byte can
change the ids) and every tokenizer a version digest (SHA-256 of its file and the library's version).
Stored counts are joined by both; only one row of each missing content is encoded; the new counts are
appended to the cache (a folder per tokenizer version), from which all rows then take theirs.  Texts travel once, to the row that stands
for its content, spread by id, so a text with many copies makes no large group.

Defined cases: null text counts as empty (0 bytes, 0 tokens); rows with equal ids, null ids and texts
of any length stay as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, keep
from .words import chunks

CACHE = "content binary, tokenizer string, n_tokens long"


@lru_cache(4)
def load(path: str):
    """The library's counter for a tokenizer file: texts -> numbers of ids."""
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return lambda texts: [len(x.ids) for x in tok.encode_batch_fast(texts, add_special_tokens=False)]


def version(path: str) -> str:
    import sentencepiece
    import tokenizers

    lib = sentencepiece if path.endswith(".model") else tokenizers
    return hashlib.sha256(Path(path).read_bytes() + f"{lib.__name__} {lib.__version__}".encode()).hexdigest()


def token_counts(docs: DataFrame, path: str, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> ``(id, n_bytes, n_tokens)``.  ``cache`` is a Parquet folder kept between runs; None: a new one."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    cache, own = cache or f"{scratch.base}/cache", version(path)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("content", F.unhex(F.sha2("text", 256)))
    rows = scratch.table(docs.select("id", "content", F.octet_length("text").cast("long").alias("n_bytes")), "rows")
    spark.createDataFrame([], CACHE).write.mode("append").partitionBy("tokenizer").parquet(cache)

    def known() -> DataFrame:
        return spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == own).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))

    one = rows.groupBy("content").agg(F.min("id").alias("id"))
    missing = scratch.table(one.join(known(), "content", "left_anti"), "missing")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = load(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            got = [n for a, b in chunks(texts, 1_000_000) for n in count(texts[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(got, np.int64))], ["content", "n_tokens"])

    x, m = docs.alias("x"), missing.hint("shuffle_hash").alias("m")
    todo = x.join(m, F.expr("x.id <=> m.id AND x.content = m.content"), "left_semi").select("content", "text")
    new = todo.mapInArrow(encode, "content binary, n_tokens long").groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    new.select("content", F.lit(own).alias("tokenizer"), "n_tokens").write.mode("append").partitionBy("tokenizer").parquet(cache)
    # both sides are tables as written, so the rows of a content with many copies can be split over tasks
    counts = scratch.table(known().join(one.select("content"), "content", "left_semi"), "counts")
    scratch.drop("missing")
    return keep(rows.join(counts.hint("merge"), "content").select("id", "n_bytes", "n_tokens"), scratch)
