"""Parts named by callouts in the text of drawings, as rules over numbered lines.

``lines(<by>, line, text)`` -> ``(*by, item, part, description, qty, maker)``.  Rules are columns of regular
expressions; labels above and part numbers below a line come from windows of a few lines; what a rule may not repeat
is settled by aggregates per document.  Nothing is folded, and a document's lines are the largest group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partweave.functions import cells as C
from partweave.operators.diff import first_per_key

# Materials that carry no part number, longer phrases before shorter ones.
MATERIALS = (
    "HEAT SHRINK", "SHRINK TUBING", "SHRINK SLEEVE", "SHRINK", "SLEEVING", "SLEEVE", "CABLE TIE", "TIE WRAP", "ZIP TIE", "WIRE MARKER", "CABLE MARKER", "WIRE LABEL", "MARKER", "LABEL",
    "LACING", "HARNESS TAPE", "TAPE", "GROMMET", "BRAID", "CONVOLUTE", "LOOM", "SOLDER", "FLUX", "POTTING", "EPOXY", "ADHESIVE", "TUBING",
)
# Shapes of callouts.
CODE = r"[A-Za-z0-9][A-Za-z0-9\-/.]{3,}"
TIMES = r"[xX]\s*(\d+)"
INLINE = rf"^(.*?)\b(?:PN|P/?N)\b\s*[#:]?\s*({CODE})(?:\s*{TIMES})?"
NUMBERED = rf"^([A-Za-z]{{2,}})#\s*({CODE})(?:\s*{TIMES})?"
ENDING = r"(?i)\b(?:PN|P/?N)#?:?$"
WIRE = r"^\d+\s+([A-Z]{3,12})\s+(\d+\s*AWG)\s*(.*)$"
BREAK = rf"(?i)\b(?:{'|'.join(C.MAKERS)}|PN#?|P/N)\b"


def _clean(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, r"\s+", " "), F.lit(" :-"))


def _part(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), "[,.;]+$", "")


def callouts(lines: DataFrame, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("line")
    text = C.strip(F.coalesce("text", F.lit("")))
    t = F.col("t")
    usable = ~t.rlike(C.VIEW) & C.label(t) & ~F.regexp_replace(F.upper(t), "[.,]+$", "").isin(*C.MAKERS) & ~t.rlike(C.ASSEMBLY)
    d = lines.select(*by, "line", text.alias("t"))
    d = d.withColumn("above", F.coalesce(F.last(F.when(usable, t), ignorenulls=True).over(w.rowsBetween(-5, -1)), F.lit("")))
    d = d.withColumn("below", F.first(F.when(t != "", t), ignorenulls=True).over(w.rowsBetween(1, 2)))
    first = F.get(F.split(t, r"\s+"), F.lit(0))
    code, numbered = (F.regexp_extract(t, p, 2) for p in (INLINE, NUMBERED))
    below = F.get(F.split(F.coalesce("below", F.lit("")), r"\s+"), F.lit(0))
    dashed = _part(first)
    rule = (
        F.when(t == "", 0).when(t.rlike(INLINE) & C.callout_part(code), 1).when(t.rlike(NUMBERED) & C.callout_part(numbered), 2).when(t.rlike(ENDING), 3)
        .when(dashed.contains("-") & (F.length(dashed) >= 7) & dashed.rlike(r"^[A-Za-z0-9]+(?:[-/.][A-Za-z0-9]+)+$") & C.callout_part(dashed) & (F.col("above") != "") & ~F.col("above").rlike(C.ASSEMBLY), 4).otherwise(0)
    )
    d = d.withColumn("rule", rule)
    lead = F.trim(F.regexp_extract(t, INLINE, 1))
    alone = (lead == "") | F.upper(lead).isin(*C.MAKERS)
    from_above = alone & (F.col("above") != "")
    named = F.regexp_extract(t, NUMBERED, 1)
    known = F.when(F.upper(named).isin(*C.MAKERS), named).otherwise("")
    above = F.col("above")
    made = (
        F.when(F.col("rule") == 1, F.struct(_part(code).alias("part"), F.when(from_above, above).otherwise(lead).alias("label"), F.regexp_extract(t, INLINE, 3).alias("qty"), F.when(from_above, C.split_maker(lead)["maker"]).otherwise("").alias("maker")))
        .when(F.col("rule") == 2, F.struct(_part(numbered).alias("part"), F.when(above != "", above).otherwise(known).alias("label"), F.regexp_extract(t, NUMBERED, 3).alias("qty"), known.alias("maker")))
        .when((F.col("rule") == 3) & C.callout_part(below), F.struct(_part(below).alias("part"), C.strip(F.regexp_replace(t, ENDING, "")).alias("label"), F.regexp_extract(F.coalesce("below", F.lit("")), TIMES + r"\b", 1).alias("qty"), F.lit("").alias("maker")))
        .when(F.col("rule") == 4, F.struct(dashed.alias("part"), above.alias("label"), F.regexp_extract(t, TIMES + r"\b", 1).alias("qty"), F.lit("").alias("maker")))
    )
    rows = d.withColumn("m", made).where("m IS NOT NULL").select(*by, "line", "rule", "m.part", _clean(F.col("m.label")).alias("description"), "m.qty", F.when(F.col("m.maker") != "", F.col("m.maker")).otherwise(C.split_maker("m.label")["maker"]).alias("maker"))
    # a part is listed once; a dashed number goes if an earlier callout has its label
    rows = first_per_key(rows.withColumn("p", F.upper("part")), [*by, "p"], ["line"]).drop("p")
    used = F.min("line").over(Window.partitionBy(*by, F.upper("description")))
    rows = rows.withColumn("used", used).where("rule <> 4 OR line = used").drop("used")
    told = rows.groupBy(*by).agg(F.concat_ws(" || ", F.collect_set(F.upper("description"))).alias("told"))  # distinct labels of a document

    u = F.upper(t)
    words = F.array(*map(F.lit, MATERIALS))
    word = F.get(F.filter(words, lambda x: u.contains(x)), F.lit(0))
    m = d.select(*by, "line", "t", word.alias("word")).where("word IS NOT NULL").join(told, by, "left").where("told IS NULL OR NOT contains(told, word)")
    tail = F.expr("substr(t, instr(upper(t), word))")
    rest = F.expr("substr(t, instr(upper(t), word) + length(word))")
    stop = F.regexp_instr(rest, F.lit(BREAK))
    phrase = F.when(stop > 0, F.concat(F.substr(tail, F.lit(1), F.length("word")), F.substr(rest, F.lit(1), stop - 1))).otherwise(tail)
    m = m.select(*by, "line", F.lit(5).alias("rule"), F.lit("").alias("part"), _clean(F.btrim(phrase, F.lit(" -:,."))).alias("description"), F.regexp_extract(tail, TIMES + r"\b", 1).alias("qty"), F.lit("").alias("maker")).where("length(description) >= 4")
    m = m.where(~F.col("description").rlike(C.ASSEMBLY))
    signal = F.trim(F.regexp_extract(t, WIRE, 3))
    wire = d.where(t.rlike(WIRE)).select(*by, "line", F.lit(6).alias("rule"), F.lit("").alias("part"), F.concat(F.lit("Wire, "), F.regexp_extract(t, WIRE, 1), F.lit(", "), F.regexp_extract(t, WIRE, 2), F.when(signal != "", F.concat(F.lit(", "), signal)).otherwise("")).alias("description"), F.lit("1").alias("qty"), F.lit("").alias("maker"))

    every = rows.union(m).union(wire).where("part <> '' OR description <> ''")
    stage = F.when(F.col("rule") <= 4, 0).otherwise(F.col("rule"))
    key = F.when(F.col("part") != "", F.concat(F.lit("p:"), F.upper("part"))).otherwise(F.concat(F.lit("d:"), F.upper("description")))
    best = every.groupBy(*by, key.alias("key")).agg(F.min(F.struct(stage.alias("stage"), "line", "part", "description", "qty", "maker")).alias("b"))
    item = F.row_number().over(Window.partitionBy(*by).orderBy("b.stage", "b.line", "key"))
    shown = F.when(F.col("b.description") == "", "Part").otherwise(F.col("b.description"))
    return best.select(*by, item.cast("long").alias("item"), "b.part", shown.alias("description"), F.when(F.col("b.qty") == "", "1").otherwise(F.col("b.qty")).alias("qty"), "b.maker")
