"""Quality rules as a bitmask ledger, with built-in functions only.

``ledger`` measures every text once and stores one failure bit per rule.  Policies are named masks over
those bits: applying or changing one reads no text.  ``ablation`` tells, per rule of a policy, how many
rows fail it, fail nothing else, and would be kept without it, by sums over bits in one pass.

Words are runs other than space and control characters 9 to 13.  Repeated five-word windows are found by
comparing hashes of the windows within a text (96 bits), sorted only where two are equal.

Defined cases: null and empty texts have no words, all measurements 0, and fail ``few_words``; equal and
null ids are rows of their own; an empty table gives an empty ledger.  Thresholds are whole-number
comparisons, so a ratio of exactly the limit passes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: name -> condition over the measurements; the place in this list is the bit, new rules go to its end
RULES = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "2 * n_symbols > n_words",
    "duplicate_lines": "100 * n_dup_lines > 30 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
}
#: version -> rules that reject
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": tuple(RULES),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
GAP = r"[\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"


def mask(policy: str) -> int:
    return sum(1 << list(RULES).index(r) for r in POLICIES[policy])


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """-> ``(id, *MEASURES, failures, *carry)``; ``carry`` names further columns of ``docs`` to keep."""
    kept = [F.col(c).alias(f"carry_{k}") for k, c in enumerate(carry)]
    names = [f"carry_{k}" for k in range(len(carry))]
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"), *kept)
    bare = F.btrim("t", F.lit(SPACE))
    d = d.select(
        "id",
        *names,
        F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP)).alias("w"),
        F.expr(r"filter(split(t, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')").alias("lines"),
        F.expr("cast(regexp_count(t, '[#*$%&|<>]') AS long)").alias("n_symbols"),
    )
    d = d.select(
        "id", *names, "w", "n_symbols",
        F.expr("cast(length(array_join(w, '')) AS long)").alias("word_chars"),
        F.expr("cast(size(w) AS long)").alias("n_words"),
        F.expr("cast(size(lines) AS long)").alias("n_lines"),
        F.expr("cast(size(lines) - size(array_distinct(lines)) AS long)").alias("n_dup_lines"),
        F.expr("transform(w, x -> xxhash64(x))").alias("h"),
    )
    at = ", ".join(f"h[i + {k}]" for k in range(5))
    other = ", ".join(f"w[i + {k}]" for k in range(5))
    d = d.withColumn("v", F.expr(f"CASE WHEN n_words >= 5 THEN transform(sequence(0, cast(n_words AS int) - 5), i -> xxhash64({at})) END"))
    again = f"array_sort(transform(v, (x, i) -> struct(x AS x, hash({other}) AS y, i AS i)))"
    d = d.withColumn("s", F.expr(f"CASE WHEN size(array_distinct(v)) < size(v) THEN {again} END"))
    same = "(s[k].x = s[k + {0}].x AND s[k].y = s[k + {0}].y)"
    d = d.withColumn(
        "p",
        F.expr(f"array_sort(transform(filter(sequence(0, size(s) - 1), k -> (k > 0 AND {same.format(-1)}) OR (k < size(s) - 1 AND {same.format(1)})), k -> s[k].i))"),
    )
    d = d.withColumn("n_repeat_words", F.expr("CASE WHEN size(p) > 0 THEN aggregate(sequence(0, size(p) - 2 + cast(size(p) = 1 AS int)), 5L, (a, k) -> a + CASE WHEN k < size(p) - 1 THEN least(5, p[k + 1] - p[k]) ELSE 0 END) ELSE 0L END"))
    bits = " | ".join(f"shiftleft(cast(({rule}) AS long), {k})" for k, rule in enumerate(RULES.values()))
    # one generated row per text: filters on the results stay above it, so no rule is evaluated twice
    made = F.inline(F.array(F.struct(*MEASURES, F.expr(bits).alias("failures"))))
    return d.select("id", *names, *MEASURES).select("id", made, *[F.col(n).alias(c) for n, c in zip(names, carry, strict=True)])


def passes(policy: str, failures: str = "failures"):
    return F.col(failures).bitwiseAND(F.lit(mask(policy))) == 0


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """-> ``(policy, rule, n_rows, n_failed, n_only, n_kept, n_kept_without)`` for each rule of the policy."""
    full = mask(policy)
    patterns = rows.groupBy(F.col("failures").bitwiseAND(F.lit(full)).alias("f")).agg(F.count("*").alias("n"))  # at most 2^rules rows
    rules = rows.sparkSession.createDataFrame([(r, 1 << list(RULES).index(r)) for r in POLICIES[policy]], "rule string, bit long")
    sums = patterns.withColumn("one", F.explode(F.array(*[F.lit(1 << list(RULES).index(r)) for r in POLICIES[policy]]))).groupBy(F.col("one").cast("long").alias("bit")).agg(
        F.sum("n").alias("n_rows"),
        F.expr("sum(if(f & one <> 0, n, 0))").alias("n_failed"),
        F.expr("sum(if(f = one, n, 0))").alias("n_only"),
        F.expr("sum(if(f = 0, n, 0))").alias("n_kept"),
        F.expr("sum(if(f & ~one = 0, n, 0))").alias("n_kept_without"),
    )
    return sums.join(F.broadcast(rules), "bit").select(F.lit(policy).alias("policy"), "rule", "n_rows", "n_failed", "n_only", "n_kept", "n_kept_without")
