"""The rename join: removed and new parts paired one to one by similar part numbers.

Part numbers are compared without punctuation.  Pairs that can reach the threshold are found by equi-joins, none is
missing and no two sides are compared in full:

* Short part numbers of like length leave few characters out to become their common subsequence.  What two lengths
  must share is a number, so each is joined on its texts of just that length; only pairs that reach the threshold meet.
* A part number that must stand in a longer one as a whole is joined with the longer one's substrings.
* Below a threshold of 0.8 those are too few: there the rarest counted characters of the shorter text, as many as it
  may miss and one more, are joined with all of the longer one's, and the shared ones are counted.
* Long ones share a run of characters by the pigeonhole principle; they are joined on their rarest runs, as many as
  the characters left out can destroy and one more.

All joins are merge joins: these tables are few bytes as files or shuffled, but many times that in the driver, which
would build a table to broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partweave.functions import cells as C
from partweave.functions import similarity as S
from partweave.written import Written

LEAST = 0.5  # the least threshold
RUNS = 0.8  # from here candidates come from texts with characters left out and from runs
MOST_LEFT = 1500  # texts with characters left out that one part number may give
MOST_LENGTH = 200  # lengths up to here decide the widths of runs; runs only grow beyond


def _kept(m: int, n: int, t: float) -> int:
    """The length of the common subsequence that texts of these lengths need for a ratio of ``t``; more than the shorter has: none reach it."""
    return math.ceil(t * (m + n) / 2 - 1e-9)


def _left_out(t: float, m: int, longest: int) -> dict[int, list[int]]:
    """How many characters a text of length ``m`` leaves out for the common subsequence -> the lengths of texts it does so for."""
    out: dict[int, list[int]] = {}
    for n in range(1, longest + 1):
        if _kept(m, n, t) <= min(m, n):
            out.setdefault(m - _kept(m, n, t), []).append(n)
    return out


def _dealt(texts: DataFrame, by: str) -> DataFrame:
    """A small table is few files, but each text gives many rows; dealt by a hash, as Spark leaves out what deals by the same column again."""
    return texts.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(by))


def _shortened(texts: DataFrame, t: float, short: int, own: set[int], others: set[int]) -> DataFrame | None:
    """``texts(canon)`` up to ``short`` -> ``(canon, size, other, v)``: what is left of a text for each length of the other one.

    ``own`` and ``others`` hold the lengths found on this side and on the other one; none if no two go together.
    """
    every = {m: {k: there for k, ns in _left_out(t, m, short).items() if (there := [n for n in ns if n in others])} for m in range(1, short + 1) if m in own}
    every = {m: per for m, per in every.items() if per}
    if not every:
        return None
    cut = "transform(sequence(r.at, length(r.v)), i -> struct(i AS at, concat(left(r.v, i - 1), substr(r.v, i + 1)) AS v))"
    x, out = _dealt(texts.where(F.length("canon").isin(*every)), "canon").select("canon", F.length("canon").alias("size"), F.expr("array(struct(1 AS at, canon AS v))").alias("l")), None
    for k in range(max(k for per in every.values() for k in per) + 1):
        if k:  # characters go from left to right, so no set of places comes twice
            x = x.withColumn("l", F.expr(f"flatten(transform(filter(l, r -> r.at <= length(r.v)), r -> {cut}))"))
        sizes = {m: per[k] for m, per in every.items() if k in per}
        if sizes:
            lengths = F.create_map(*[c for m, ns in sizes.items() for c in (F.lit(m), F.array(*map(F.lit, ns)))])
            step = x.where(F.col("size").isin(*sizes)).select("canon", "size", F.explode(F.array_distinct(F.col("l.v"))).alias("v"))
            step = step.select("canon", "size", F.explode(F.try_element_at(lengths, F.col("size"))).alias("other"), "v")
            out = step if out is None else out.union(step)
        x = x.where(F.col("size").isin(*[m for m, per in every.items() if max(per) > k])) if any(max(per) > k for per in every.values()) else x
    return out


def _runs(parts: DataFrame, width: int, most: Column) -> DataFrame:
    """-> ``(run, canon)``: the ``most`` rarest runs of each part (all parts of both sides count)."""
    at = F.explode(F.sequence(F.lit(1), F.length("canon") - width + 1))
    runs = _dealt(parts.where(F.length("canon") >= width), "canon").select("side", "canon", at.alias("at")).select("side", "canon", F.substring(F.col("canon"), F.col("at"), F.lit(width)).alias("run")).distinct()
    held = runs.groupBy("run").agg(F.count("*").alias("n"))
    ranked = runs.join(held.hint("merge"), "run").groupBy("side", "canon").agg(F.array_sort(F.collect_list(F.struct("n", "run"))).alias("r"))  # as many as a part has characters
    return ranked.select("side", "canon", F.explode(F.slice("r", 1, most)).alias("r")).select("side", "canon", "r.run")


def _band(x: str, y: str, threshold: float) -> Column:
    m, n = F.length(x), F.length(y)
    return 2 * F.least(m, n) >= threshold * (m + n)


def _by_marks(old: DataFrame, new: DataFrame, t: float) -> DataFrame:
    """All pairs that share enough counted characters for a ratio of ``t``, of the whole texts or of the shorter with a part."""
    written = Written(old.sparkSession)
    a, b = (written.table(d.select(F.col("canon").alias(c), S.marks("canon").alias(f"m{c}")), c) for d, c in ((old, "x"), (new, "y")))
    part = t / S.PART_WEIGHT
    inner = part / (2 - part)  # of the shorter text, if a part of the longer one is alike
    least = min(t, inner)
    ones = {c: d.select(c, F.explode(f"m{c}").alias("mark")) for d, c in ((a, "x"), (b, "y"))}
    held = ones["x"].select("mark").union(ones["y"].select("mark")).groupBy("mark").agg(F.count("*").alias("n"))

    def rarest(c: str) -> DataFrame:
        ranked = ones[c].join(held.hint("merge"), "mark").groupBy(c).agg(F.array_sort(F.collect_list(F.struct("n", "mark"))).alias("m"))  # as many as a part has characters
        return ranked.select(c, F.explode(F.slice("m", 1, (F.length(c) - F.ceil(F.length(c) * least - 1e-9) + 1).cast("int"))).alias("m")).select(c, "m.mark")

    m, n = F.length("x"), F.length("y")
    pairs = rarest("x").join(ones["y"].hint("merge"), "mark").where(m <= n).select("x", "y").union(ones["x"].join(rarest("y").hint("merge"), "mark").where(m > n).select("x", "y")).distinct()
    shared = F.size(F.array_intersect("mx", "my"))
    whole = shared >= t * (m + n) / 2 - 1e-9
    within = (F.greatest(m, n) >= S.EVEN * F.least(m, n)) & (shared >= inner * F.least(m, n) - 1e-9)
    return pairs.join(a.hint("merge"), "x").join(b.hint("merge"), "y").where(whole | within).select("x", "y")


def candidates(old: DataFrame, new: DataFrame, threshold: float) -> DataFrame:
    """``old(canon)``, ``new(canon)``, distinct -> ``(x, y)``: all pairs that may reach the threshold, and some more."""
    t = threshold
    if t < RUNS:
        return _by_marks(old, new, t)
    short = 1
    while short < MOST_LENGTH - 1 and sum(math.comb(short + 1, k) * len(ns) for k, ns in _left_out(t, short + 1, 2 * short + 2).items()) <= MOST_LEFT:
        short += 1
    both = old.select(F.lit("x").alias("side"), "canon").union(new.select(F.lit("y"), "canon"))
    found: dict[str, set[int]] = {"x": set(), "y": set()}  # lengths up to MOST_LENGTH, all longer ones as that
    for r in both.select("side", F.least(F.length("canon"), F.lit(MOST_LENGTH)).alias("n")).distinct().collect():
        found[r["side"]].add(r["n"])
    longest = {s: max(ns, default=0) for s, ns in found.items()}
    # a subsequence of the length that a pair needs is all that the pair shares, so only pairs that reach the threshold meet
    x, y = _shortened(old, t, short, found["x"], found["y"]), _shortened(new, t, short, found["y"], found["x"])
    out = old.select(F.col("canon").alias("x"), F.col("canon").alias("y")).where("false")
    if x is not None and y is not None:
        x = x.select(F.col("canon").alias("x"), F.col("size").alias("m"), F.col("other").alias("n"), "v")
        y = y.select(F.col("canon").alias("y"), F.col("other").alias("m"), F.col("size").alias("n"), "v")
        out = x.join(y.hint("merge"), ["m", "n", "v"]).select("x", "y").distinct()

    def by_runs(width: int, lost: Column, fits: Column, least: int) -> DataFrame:
        runs = _runs(both.where(F.length("canon") >= least), width, lost * width + 1)
        a, b = (runs.where(F.col("side") == s).select("run", F.col("canon").alias(s)) for s in ("x", "y"))
        return a.join(b.hint("merge"), "run").where(fits).select("x", "y")

    # like lengths: L >= t (m + n) / 2, d = m + n - 2 L characters are left out, d + 1 runs at most
    like = [(m, n) for m in range(1, 2 * MOST_LENGTH) for n in range(m, int(m * (2 - t) / t) + 1) if n > short]
    if max(longest.values()) > short:
        width = min(math.ceil(math.ceil(t * (m + n) / 2) / (m + n - 2 * math.ceil(t * (m + n) / 2) + 1)) for m, n in like)
        n = F.length("canon")
        out = out.union(by_runs(width, F.floor(n * 2 / t * (1 - t)).cast("int"), _band("x", "y", t) & (F.greatest(F.length("x"), F.length("y")) > short), min(m for m, _ in like)))

    if t <= S.PART_WEIGHT:  # a part of the longer text with a ratio of t / PART_WEIGHT
        best = t / S.PART_WEIGHT
        whole = max(m for m in range(1, MOST_LENGTH) if int(2 * m * (1 - best) + 1e-9) == 0)
        for long, inner in (("x", "y"), ("y", "x")):
            a = both.where(F.col("side") == long).select(F.col("canon").alias(long))
            b = both.where(F.col("side") == inner).where(F.length("canon") <= whole).select(F.col("canon").alias(inner))
            there = sorted(n for n in found[inner] if 0 < n <= whole)  # no other parts of the longer text can be a whole text
            if not there or longest[long] < min(MOST_LENGTH, S.EVEN * there[0]):
                continue
            sizes = F.expr(f"filter(array({', '.join(map(str, there))}), s -> s >= length({long}) / {S.LONG} AND s <= floor(length({long}) / {S.EVEN}))")
            cut = F.expr(f"flatten(transform(sizes, s -> transform(sequence(1, length({long}) - s + 1), i -> substr({long}, i, s))))")
            a = _dealt(a.where(F.length(long) >= 2), long).withColumn("sizes", sizes).where("size(sizes) > 0")
            out = out.union(a.select(long, F.explode(F.array_distinct(cut)).alias(inner)).join(b.hint("merge"), inner).select("x", "y"))
        need = {m: math.ceil(best * m / (2 - best)) for m in range(whole + 1, MOST_LENGTH)}
        if not need or min(longest.values()) <= whole:  # only whole parts can reach it
            return out.distinct()
        width = min(math.ceil(k / (int(2 * m * (1 - best)) + 1)) for m, k in need.items())
        m = F.least(F.length("x"), F.length("y"))
        apart = (F.greatest(F.length("x"), F.length("y")) >= S.EVEN * m) & (F.greatest(F.length("x"), F.length("y")) <= S.LONG * m) & (m > whole)
        out = out.union(by_runs(width, F.length("canon"), apart, whole + 1))  # all runs: the longer text has more of its own
    return out.distinct()


def rename_pairs(old: DataFrame, new: DataFrame, threshold: float = 0.88, rejected: DataFrame | None = None) -> DataFrame:
    """``old(k)``, ``new(k)`` -> ``(old_k, new_k, score)``: in key order each old part takes the best new part still free.

    The score is ``similarity.weighted`` of the part numbers without punctuation; equal scores go to the lesser key.
    ``threshold`` is held within 0.5 and 1.  Comment keys and keys without letters or digits stay out; of
    keys with one canonical form the last stands for all.  ``rejected(a, b)`` names pairs a user refused: a part whose best match
    is refused gets none.  The order is kept by rounds: every part asks for its best, and greater parts give up what a
    lesser one asks for, until none has to: who once holds a new part gives it to lesser parts only.
    """
    threshold = min(1.0, max(LEAST, threshold))
    written = Written(old.sparkSession)

    def canon(rows: DataFrame, name: str) -> DataFrame:
        c = rows.where("NOT startswith(k, 'COMMENT_')").select("k", C.match_form("k").alias("canon")).where("canon <> ''")
        return written.table(c.groupBy("canon").agg(F.max("k").alias("k")) if name == "new" else c, name)

    a, b = canon(old, "old"), canon(new, "new")
    pairs = candidates(a.select("canon").distinct(), b.select("canon"), threshold)
    scored = pairs.withColumn("score", S.column(S.weighted, "x", "y", late=True)).where(F.col("score") >= threshold)
    edges = scored.join(a.select(F.col("canon").alias("x"), F.col("k").alias("old_k")).hint("merge"), "x").join(b.select(F.col("canon").alias("y"), F.col("k").alias("new_k")).hint("merge"), "y")
    edges = edges.select("old_k", "new_k", "score", "x", "y")
    if rejected is not None:
        refused = rejected.select(C.match_form("a").alias("x"), C.match_form("b").alias("y")).distinct().withColumn("refused", F.lit(True))
        edges = edges.join(refused.hint("merge"), ["x", "y"], "left").select("old_k", "new_k", "score", F.coalesce("refused", F.lit(False)).alias("refused"))
    else:
        edges = edges.select("old_k", "new_k", "score", F.lit(False).alias("refused"))

    def best(edges: DataFrame) -> DataFrame:
        first = edges.groupBy("old_k").agg(F.min(F.struct((-F.col("score")).alias("s"), "new_k", "refused")).alias("b"))
        return first.select("old_k", "b.new_k", (-F.col("b.s")).alias("score"), "b.refused").where("NOT refused")

    edges, round_ = written.table(edges, "live0"), 0
    n, before = edges.count(), 0
    while n != before:
        holder = best(edges).groupBy("new_k").agg(F.min("old_k").alias("holder"))
        left = edges.join(holder.hint("merge"), "new_k", "left").where("holder IS NULL OR old_k <= holder").select(*edges.columns)
        round_ += 1
        edges = written.table(left, f"live{round_}")
        written.drop(f"live{round_ - 1}")
        n, before = edges.count(), n
    # a table, as those who apply the pairs read them several times
    return written.table(best(edges).select("old_k", "new_k", "score"), "pairs")
