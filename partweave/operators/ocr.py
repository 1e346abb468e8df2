"""Tables without lines in pictures: words as OCR reads them, to lines, a header, columns and cells.

Words are ``(*by, text, left, top, width, height, conf)``; ``by`` tells pictures apart and a picture's words are few.
Defined cases: pictures without a line of two words have no table; of equally good header lines the first counts;
words equal in all values all stay; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partweave.functions import cells as C
from partweave.operators import candidates as B
from partweave.operators import schema as H
from partweave.operators import words as W
from partweave.written import Written

TOP, SURE, FULL, UNSURE = 25, 8, 30, 0.3
CLOSE = 1.1  # of the mean height: a smaller gap joins header words


def header_lines(lined: DataFrame, by: list[str]) -> DataFrame:
    """-> ``(*by, line, share)``: the line of most header words by weight, 8 at least, else the first with two words.

    ``share`` is how sure the header is: its score of 30, or three tenths where it is only the first line.
    """
    texts = F.array_sort(F.collect_list(F.struct("left", "text")))  # a line's words
    per = lined.groupBy(*by, "line").agg(F.lower(F.array_join(F.transform(texts, lambda x: x["text"]), " ")).alias("t"), F.count("*").alias("n"))
    weights = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(n).alias("n")) for w, n in B.WEIGHTS.items()])
    score = F.when(F.length("t") < 4, 0).otherwise(C.let(F.col("t"), lambda t: F.aggregate(F.filter(weights, lambda x: F.contains(t, x["w"])), F.lit(0), lambda a, x: a + x["n"])))
    per = per.withColumn("score", F.when(F.col("line") < TOP, score).otherwise(0))
    best = per.groupBy(*by).agg(F.min(F.struct((-F.col("score")).alias("s"), "line")).alias("b"), F.min(F.when(F.col("n") >= 2, F.col("line"))).alias("first"))
    sure = -F.col("b.s") >= SURE
    out = best.select(*by, F.when(sure, F.col("b.line")).otherwise(F.col("first")).alias("line"), F.when(sure, F.least(F.lit(1.0), -F.col("b.s") / FULL)).otherwise(UNSURE).alias("share"))
    return out.where("line IS NOT NULL")


def merge_header(words: DataFrame, by: list[str]) -> DataFrame:
    """Words of one header line ``(*by, text, left, width, height)`` -> ``(*by, text, left, width)``: near ones joined.

    A fold from left to right: what has been joined so far grows, and the next word joins it if the gap to its right end
    is less than 1.1 of the mean of both heights; the joined height is the greater one.
    """
    seq = F.array_sort(F.collect_list(F.struct(F.col("left").cast("long").alias("left"), "text", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"))))
    kind = "struct<left: bigint, text: string, width: bigint, height: bigint>"
    zero = F.expr(f"named_struct('done', cast(array() AS array<{kind}>), 'open', cast(null AS {kind}))")

    def fold(a, x):
        o = a["open"]
        near = x["left"] - (o["left"] + o["width"]) < (o["height"] + x["height"]) / 2 * CLOSE
        joined = F.struct(o["left"].alias("left"), F.concat_ws(" ", o["text"], x["text"]).alias("text"), (x["left"] + x["width"] - o["left"]).alias("width"), F.greatest(o["height"], x["height"]).alias("height"))
        return F.when(o.isNull(), F.struct(a["done"].alias("done"), x.alias("open"))).when(near, F.struct(a["done"].alias("done"), joined.alias("open"))).otherwise(F.struct(F.array_append(a["done"], o).alias("done"), x.alias("open")))

    done = F.aggregate(seq, zero, fold, lambda a: F.array_append(a["done"], a["open"]))
    return words.groupBy(*by).agg(done.alias("m")).select(*by, F.inline("m")).select(*by, "text", "left", "width")


def borderless_table(words: DataFrame, by: list[str]) -> DataFrame:
    """-> ``(*by, row, col, name, text, confidence)``: the filled cells below the header, repaired by their column's kind."""
    written = Written(words.sparkSession)
    lined = written.table(W.group_lines(words, by), "lined")
    heads = written.table(header_lines(lined, by), "heads")
    merged = merge_header(lined.join(heads, [*by, "line"]).select(*by, "text", "left", "width", "height"), by)
    bounds = H.unique_names(W.header_bounds(merged, by), by)
    bounds = written.table(bounds.select(*by, "col", F.col("unique_name").alias("name"), "lo", "hi"), "bounds")
    kinds = written.table(bounds.select("name").distinct().withColumn("kind", H.kind("name")), "kinds")
    below = lined.join(heads.select(*by, F.col("line").alias("head")), by).where("line > head")
    placed = W.to_columns(below, bounds, by, F.floor(F.col("left") + F.floor(F.col("width") / 2)))
    cells = W.in_order(placed, [*by, "line", "col"], ["left"]).where(~C.blank_text("text"))
    rows = cells.select(*by, "line").distinct().select(*by, "line", F.row_number().over(Window.partitionBy(*by).orderBy("line")).cast("long").alias("row"))
    sure = W.confidence(words.join(heads.select(*by, "share"), by), by, F.col("share"))
    out = cells.join(rows, [*by, "line"]).join(bounds.select(*by, "col", "name"), [*by, "col"]).join(kinds, "name").join(sure, by)
    return out.select(*by, "row", "col", "name", F.coalesce(C.ocr_repair("text", "kind"), "text").alias("text"), "confidence")
