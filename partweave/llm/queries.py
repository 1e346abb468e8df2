"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .op01_tool_calls import link_tool_calls
from .op02_secrets import find_secrets
from .op03_sentencepiece import encode_decode
from .op04_jaccard_join import jaccard_components
from .op05_licenses import duck_sql, find_licenses
from .op06_quality_rules import ablation, ledger, passes
from .op07_packing import pack
from .op08_embedding_dedup import near_duplicates
from .op09_token_counts import token_counts
from .op10_html import main_text
from .op11_vector_codes import compress
from .op12_hard_negatives import hard_negatives
from .op13_exact_dedup import exact_dedup, normal

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


@query()
def op1_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_tool_calls(table(spark, sf_dir, "conversations"))


@query()
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_secrets(table(spark, sf_dir, "documents"))
    n = {k: F.expr(f"cast(size(filter(split(base, ','), x -> startswith(x, '{k}:'))) AS long)").alias(f"n_{k}") for k in ("assign", "access", "hex")}
    return out.select(F.col("id").alias("doc_id"), n["assign"], n["access"], n["hex"], F.sha2("base", 256).alias("base_sha256"), "spans")


@query()
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return out.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query()
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_components(table(spark, sf_dir, "documents"), width=3, percent=90)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


@query(duck_sql())
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_licenses(table(spark, sf_dir, "documents"))
    ids = F.array_join(F.col("sentence_ids").cast("array<string>"), ",")
    return out.select(F.col("id").alias("doc_id"), F.size("sentence_ids").cast("long").alias("n_sentences"), ids.alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


@query(r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM documents),
v AS (SELECT doc_id, i, w[i:i + 4] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM v) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest(range(5)) AS k) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM d LEFT JOIN c USING (doc_id)),
f AS (SELECT *, CAST(n_words < 10 AS BIGINT) + 2 * CAST(100 * n_repeat_words > 20 * n_words AS BIGINT) + 4 * CAST(2 * n_symbols > n_words AS BIGINT)
    + 8 * CAST(100 * n_dup_lines > 30 * n_lines AS BIGINT) + 16 * CAST(word_chars < 2 * n_words AS BIGINT) + 32 * CAST(word_chars > 20 * n_words AS BIGINT) AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) <> 0 AS base_failed, failures = 0 AS kept, failures FROM f
""")
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ledger(table(spark, sf_dir, "documents"))
    measured = out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failures")
    return measured.select("*", (~passes("base")).alias("base_failed"), passes("v1").alias("kept"))


@query(
    "WITH p AS ("
    + ORACLES["op6_quality_rules"]
    + """), r AS (SELECT * FROM (VALUES ('few_words', 1), ('repeated_words', 2), ('symbols', 4), ('duplicate_lines', 8), ('short_words', 16), ('long_words', 32)) AS v(rule, bit))
SELECT 'v1' AS policy, rule, count(*) AS n_rows, count(*) FILTER (failures & bit <> 0) AS n_failed, count(*) FILTER (failures = bit) AS n_only, count(*) FILTER (failures = 0) AS n_kept,
    count(*) FILTER (failures = 0 OR failures = bit) AS n_kept_without FROM p, r GROUP BY rule"""
)
def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of a policy rejects, alone and with others, by sums over the ledger's bits."""
    return ablation(ledger(table(spark, sf_dir, "documents")), "v1")


@query()
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ranks=public_tokenizers.path("byte_bpe_50k.tiktoken")).withColumnRenamed("id", "doc_id")


@query()
def op8_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


@query()
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


@query()
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = main_text(table(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def _codes_sql(rounds: int = 4) -> str:
    """The rounds one after another, each distance from dot products of whole numbers, which doubles hold exactly."""
    steps = ["""v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, p, q[16 * p + 1:16 * p + 16] AS x FROM v, (SELECT unnest(range(4)) AS p)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM p QUALIFY e < 256)"""]
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT vec_id, p.p, min_by(e, (d, e)) AS e, min(d) AS d, any_value(x) AS x FROM
    (SELECT vec_id, p.p, e, x, list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c) AS d FROM p JOIN b{k} USING (p)) AS p GROUP BY vec_id, p.p)""")
        if k < rounds:
            steps.append(f"""m{k} AS (SELECT p, e, list(floor(s / n) ORDER BY i) AS c FROM (SELECT p, e, i, sum(x[i]) AS s, count(*) AS n FROM a{k}, (SELECT unnest(range(1, 17)) AS i) GROUP BY p, e, i) GROUP BY p, e),
b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN m{k} USING (p, e))""")
    return "WITH " + ",\n".join(steps) + f""",
r AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} JOIN v USING (vec_id) GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256 FROM r"""


@query(_codes_sql())
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = compress(table(spark, sf_dir, "embeddings"))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    digest = hashlib.sha256(",".join(str(x) for book in books for x in book.ravel()).encode()).hexdigest()
    return out.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


@query("""
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
""")
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")))


@query("""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
""")
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text_sha256", F.sha2(normal(F.col("text")), 256))
    return exact_dedup(docs, carry=("text_sha256",)).withColumnRenamed("id", "doc_id")
