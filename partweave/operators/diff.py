"""The comparison of two revisions of a parts list: keyed diff, renames, aliases, reclassification, figures.

A revision has ``mpn`` and ``line``, and may have ``refdes, qty, description, comment, manufacturer, vendor``;
columns it lacks count as null, further columns are left out.  Of rows with one key the first line wins, among equal
lines the least row.  Rows without key (no part number and no comment) are dropped.  Empty revisions are allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partweave.functions import cells as C
from partweave.functions import similarity as S
from partweave.operators.running import numbered, running
from partweave.written import Written

FIELDS = ("refdes", "qty", "description", "manufacturer", "vendor")
CELLS = ("mpn", *FIELDS, "comment")
DRIFT = 0.75


def first_per_key(rows: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    """The first row of each key by ``order``, among equals the least row, so partitions do not matter.

    Written as a minimum of structs, which is aggregated before the shuffle, so a key with very many
    rows costs one row per task.  Rows with a null key are a group; an empty table gives an empty result.
    """
    best = rows.groupBy(*keys).agg(F.min(F.struct(*order, F.struct(*rows.columns).alias("row_"))).alias("best_"))
    return best.select("best_.row_.*")


def revision(rows: DataFrame) -> DataFrame:
    """``(k, *CELLS, line)``: the cells as text, those that are absent null, with the row's key."""
    have = [F.col(c).cast("string").alias(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in CELLS]
    out = rows.select(*have, F.col("line").cast("long").alias("line"))
    return out.select(C.row_key("mpn", "comment").alias("k"), "*").where("k <> ''")


def keyed(rows: DataFrame, plain: bool = False) -> DataFrame:
    """One row per key, with the cells and their forms (``form_*``) for comparing."""
    out = first_per_key(revision(rows), ["k"], ["line"])
    return out.select("*", *[_form(f, F.col(f), plain).alias(f"form_{f}") for f in FIELDS])


def _form(field: str, c: Column, plain: bool = False) -> Column:
    """A cell in the form it is compared in; ``plain`` quantities are numbers without unit, fraction or comma."""
    if field == "qty":
        return C.plain_quantity(c) if plain else C.quantity_text(c)
    if field == "description":
        return C.cell_key(c)
    return F.upper(C.strip(F.coalesce(c, F.lit(""))))


def diff(old: DataFrame, new: DataFrame, plain: bool = False) -> DataFrame:
    """-> ``(k, status, old_*, new_*, *_changed, mpn_changed, alias_match)``: one row per key of either side.

    Status is new, removed, modified or unchanged.  Quantities are compared as numbers, descriptions as keys,
    designators, makers and vendors as upper-case text; the order of designators counts (see ``reclassify``).
    """
    a, b = keyed(old, plain).alias("a"), keyed(new, plain).alias("b")
    changed = {f: F.col(f"a.form_{f}") != F.col(f"b.form_{f}") for f in FIELDS}
    both = F.col("a.k").isNotNull() & F.col("b.k").isNotNull()
    any_changed = changed[FIELDS[0]]
    for f in FIELDS[1:]:
        any_changed = any_changed | changed[f]
    status = F.when(F.col("b.k").isNull(), "removed").when(F.col("a.k").isNull(), "new").when(any_changed, "modified").otherwise("unchanged")
    sides = [F.col(f"{s}.{f}").alias(f"{n}_{f}") for s, n in (("a", "old"), ("b", "new")) for f in (*CELLS, "line")]
    flags = [F.when(both, c).otherwise(False).alias(f"{f}_changed") for f, c in changed.items()]
    joined = a.join(b, F.col("a.k") == F.col("b.k"), "full")
    no = [F.lit(False).alias(c) for c in ("mpn_changed", "alias_match")]
    return joined.select(F.coalesce("a.k", "b.k").alias("k"), status.alias("status"), *sides, *flags, *no)


def manual_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``diff`` for columns a user chose: quantities are plain numbers, and only part numbers are keys.

    Makers and vendors are not compared.  ``manual_figures`` gives its figures.
    """
    cells = ("mpn", "qty", "refdes", "description", "line")
    keep = lambda rows: rows.select(*[c for c in cells if c in rows.columns])
    return diff(keep(old), keep(new), plain=True)


def manual_figures(rows: DataFrame, threshold: float = 0.88) -> DataFrame:
    """One row of the nine figures of a manual comparison."""
    n = lambda condition: F.count_if(F.expr(condition))
    return rows.agg(
        n("status <> 'new'").alias("total_parts_file1"), n("status <> 'removed'").alias("total_parts_file2"), n("status = 'new'").alias("new_parts_count"),
        n("status = 'removed'").alias("removed_parts_count"), n("status = 'modified'").alias("modified_parts_count"), n("status = 'unchanged'").alias("unchanged_parts_count"),
        F.lit(0).cast("long").alias("unrecognized_parts_count"), n("status = 'modified' AND mpn_changed").alias("mpn_renamed_count"),
    ).withColumn("fuzzy_threshold", F.lit(threshold))


def shown_part(side: str) -> Column:
    """The part number to show: whole numbers without ``.0``, the comment where there is no part number."""
    mpn, comment = C.display(f"{side}_mpn"), C.display(f"{side}_comment")
    return F.when(mpn != "N/A", mpn).otherwise(comment)


def _promote(rows: DataFrame, pairs: DataFrame, alias: bool) -> DataFrame:
    """Turns pairs ``(old_k, new_k)`` of removed and new keys into modified rows."""
    old_cells, new_cells = ([F.col(f"{x}.{s}_{f}") for f in (*CELLS, "line")] for s, x in (("old", "o"), ("new", "n")))
    o, n = rows.where("status = 'removed'").alias("o"), rows.where("status = 'new'").alias("n")
    flags = [(_form(f, F.col(f"o.old_{f}")) != _form(f, F.col(f"n.new_{f}"))).alias(f"{f}_changed") for f in FIELDS]
    # pairs are few bytes as files, but may be too many for the driver to broadcast
    made = pairs.alias("p").join(o.hint("merge"), F.expr("p.old_k = o.k")).join(n.hint("merge"), F.expr("p.new_k = n.k"))
    made = made.select(F.col("o.k").alias("k"), F.lit("modified").alias("status"), *old_cells, *new_cells, *flags, F.lit(True).alias("mpn_changed"), F.lit(alias).alias("alias_match"))
    gone = pairs.select(F.lit("removed").alias("status"), F.col("old_k").alias("k")).union(pairs.select(F.lit("new"), "new_k"))
    return rows.join(gone.hint("merge"), ["status", "k"], "left_anti").select(*rows.columns).unionByName(made)


def apply_renames(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Diff rows with the pairs ``(old_k, new_k)`` of the rename join as modified rows."""
    return _promote(rows, pairs.select("old_k", "new_k"), False)


def fold_aliases(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Removed and new parts of one alias group ``aliases(mpn, canon)`` become modified rows, one to one in line order.

    Only parts that have an alias fold.  A group with more parts on one side leaves the rest as they are.  The rows are
    written once, as both sides, the pairs' rows and the rest read them, and so are the pairs.
    """
    written = Written(rows.sparkSession)
    rows = written.table(rows, "rows")

    def side(status: str, name: str) -> DataFrame:
        part = F.upper(C.strip(F.coalesce(F.col(f"{name}_mpn"), F.lit(""))))
        x = rows.where(F.col("status") == status).select("k", F.col(f"{name}_line").alias("line"), part.alias("mpn")).join(aliases.select("mpn", "canon").hint("merge"), "mpn")
        return numbered(x, ["canon"], ["line", "k"], "place").select("canon", F.col("k").alias(f"{name}_k"), "place")

    pairs = side("removed", "old").join(side("new", "new").hint("merge"), ["canon", "place"]).select("old_k", "new_k")
    return _promote(rows, written.table(pairs, "pairs"), True)


def reclassify(rows: DataFrame) -> DataFrame:
    """Modified rows whose cells differ in writing only become unchanged (``reclassified`` tells which).

    Quantities, descriptions and part numbers are compared as engineering values, designators as sets; maker and
    vendor must be unchanged, and alias matches stay modified.
    """
    same = [C.engineering_value(f"old_{f}") == C.engineering_value(f"new_{f}") for f in ("qty", "description", "mpn")]
    sets = C.refdes_set(C.designators("old_refdes")) == C.refdes_set(C.designators("new_refdes"))
    # a row that was matched by key has one part; only renames compare part numbers
    only = (F.col("status") == "modified") & same[0] & same[1] & (~F.col("mpn_changed") | same[2]) & sets & ~F.col("alias_match") & ~F.col("manufacturer_changed") & ~F.col("vendor_changed")
    return rows.withColumn("reclassified", only).withColumn("status", F.when(only, "unchanged").otherwise(F.col("status")))


def with_drift(rows: DataFrame, least: float = DRIFT) -> DataFrame:
    """Adds ``description_similarity`` (two decimals, null unless modified) and ``description_drift``: under ``least``.

    Only modified rows whose descriptions are both present and changed are compared in Python.
    """
    both = (F.col("status") == "modified") & F.col("description_changed") & (C.strip("old_description") != "") & (C.strip("new_description") != "")
    score = S.column(S.token_set, F.when(both, F.col("old_description")), F.when(both, F.col("new_description")))
    out = rows.withColumn("description_similarity", score)
    drift = F.coalesce(F.col("description_similarity") < least, F.lit(False))
    return out.withColumn("description_drift", drift).withColumn("description_similarity", F.round("description_similarity", 2))


def summary(rows: DataFrame) -> DataFrame:
    """Rows per status."""
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def figures(rows: DataFrame, old: DataFrame, new: DataFrame, threshold: float = 0.88) -> DataFrame:
    """One row of the eleven figures of a comparison; counts of an empty comparison are 0.

    ``rows`` come from ``with_drift``; parts of a revision are its distinct keys, duplicates are counted per revision.
    """
    n = lambda condition: F.count_if(F.expr(condition))
    counts = rows.agg(
        n("status <> 'new'").alias("total_parts_file1"), n("status <> 'removed'").alias("total_parts_file2"), n("status = 'new'").alias("new_parts_count"),
        n("status = 'removed'").alias("removed_parts_count"), n("status = 'modified'").alias("modified_parts_count"), n("status = 'unchanged'").alias("unchanged_parts_count"),
        F.lit(0).cast("long").alias("unrecognized_parts_count"), n("status = 'modified' AND mpn_changed").alias("mpn_renamed_count"),
        n("status = 'modified' AND description_drift").alias("description_drift_count"),
    )
    twice = duplicates(old).select("k").union(duplicates(new).select("k")).agg(F.count("*").alias("duplicate_mpn_count"))
    return counts.crossJoin(F.broadcast(twice)).withColumn("fuzzy_threshold", F.lit(threshold))  # one row each


def match_rate(rows: DataFrame) -> DataFrame:
    """-> ``(match_rate)``: twice the unchanged parts over the parts of both revisions, in whole percent; 0 without parts."""
    n = lambda condition: F.count_if(F.expr(condition))
    total = n("status <> 'new'") + n("status <> 'removed'")
    return rows.agg(F.when(total > 0, F.floor(n("status = 'unchanged'") * 200 / total + 0.5)).otherwise(F.lit(0)).cast("long").alias("match_rate"))


def duplicates(rows: DataFrame) -> DataFrame:
    """-> ``(k, occurrences, first_line, last_line)``: part keys found on more than one row; comment keys do not count.

    All figures are aggregated before the shuffle.  ``duplicate_lines`` gives every line.
    """
    k = revision(rows).where("NOT startswith(k, 'COMMENT_')")
    return k.groupBy("k").agg(F.count("*").alias("occurrences"), F.min("line").alias("first_line"), F.max("line").alias("last_line")).where("occurrences > 1")


def duplicate_lines(rows: DataFrame) -> DataFrame:
    """-> ``(k, line)``: every row of a key found on more than one; a key's rows are never gathered."""
    return revision(rows).select("k", "line").join(duplicates(rows).select("k"), "k", "left_semi")


def side_by_side(rows: DataFrame) -> DataFrame:
    """Removed, added, modified and renamed parts with both sides' cells; missing cells are empty."""
    cell = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    part = F.when(F.col("mpn_changed"), F.concat_ws(" → ", shown_part("old"), shown_part("new"))).when(F.col("status") == "new", shown_part("new")).otherwise(shown_part("old"))
    status = F.when(F.col("mpn_changed"), "Renamed").when(F.col("status") == "new", "Added").otherwise(F.initcap("status"))
    return rows.where("status <> 'unchanged'").select(part.alias("part"), status.alias("status"), *[cell(f"{s}_{f}") for s in ("old", "new") for f in ("refdes", "qty", "description")])


def export_flags(rows: DataFrame) -> DataFrame:
    """-> per part (upper case) of the new revision, by raw text: which cells differ, whether it was added or removed."""
    part = F.upper(C.strip(F.when(F.col("status") == "removed", shown_part("old")).otherwise(shown_part("new"))))
    raw = lambda f: (F.col("status") == "modified") & ~F.col(f"old_{f}").eqNullSafe(F.col(f"new_{f}"))
    return rows.where("status <> 'unchanged'").select(part.alias("part"), *[raw(f).alias(f) for f in ("qty", "refdes", "description")], "mpn_changed", (F.col("status") == "new").alias("added"), (F.col("status") == "removed").alias("removed"))


def search(rows: DataFrame, text: str, columns: list[str] | None = None) -> DataFrame:
    """Rows with the text in any of the columns (all by default), in any case of letters; blank text finds all."""
    wanted = text.lower()
    if not wanted.strip():
        return rows
    hit = F.lit(False)
    for c in columns or rows.columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(wanted)), F.lit(False))
    return rows.where(hit)


def with_flags(rows: DataFrame, *flags: str) -> DataFrame:
    """Modified rows with all of the named changes (``qty``, ``refdes``, ``description``, ``manufacturer``)."""
    out = rows.where("status = 'modified'")
    for f in flags:
        out = out.where(F.col(f"{f}_changed"))
    return out


def forward_fill(rows: DataFrame, value: str, by: list[str], order: list[str], name: str = "filled") -> DataFrame:
    """Blank cells take the last value above them within ``by``; cells before any value stay null.  Keys may be of any size."""
    return running(rows, by, order, last={name: F.when(C.strip(F.col(value)) != "", F.col(value))})


def fill_merged(rows: DataFrame, columns: list[str], by: list[str], order: list[str]) -> DataFrame:
    """``forward_fill`` of several columns in place, as merged cells leave all but their first row blank."""
    filled = running(rows, by, order, last={c: F.when(C.strip(F.col(c)) != "", F.col(c)) for c in columns})
    return filled.withColumns({c: F.coalesce(c, F.lit("")) for c in columns})
