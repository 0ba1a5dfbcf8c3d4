"""Text of recognised pages from their rows of words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions.text import Normalization, normalize


def page_text(rows: DataFrame) -> DataFrame:
    """(pdf, page, text, mean_confidence, words) from typed OCR rows (pdf, page, line_no, block_num, par_num, line_num, conf, text).

    Words (rows with more than blanks for text) stand in file order, joined by a blank within one
    (block, paragraph, line) and by a line break where that changes or is unknown.  The mean is that of
    confidences of 0 or more of these words, null if there are none.  Pages without words have no row.
    """
    words = rows.where(F.length(F.trim(F.regexp_replace("text", r"(?U)\s+", " "))) > 0)
    w = Window.partitionBy("pdf", "page").orderBy("line_no")
    key = F.struct("block_num", "par_num", "line_num")
    known = F.col("block_num").isNotNull() & F.col("par_num").isNotNull() & F.col("line_num").isNotNull()
    glue = F.when(F.lag("line_no").over(w).isNull(), "").when(known & (F.lag(key).over(w) == key), " ").otherwise("\n")
    parts = words.withColumn("glue", glue)
    return parts.groupBy("pdf", "page").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.concat("glue", "text").alias("t")))), lambda x: x["t"]), "").alias("text"),
        F.avg(F.when(F.col("conf") >= 0, F.col("conf"))).alias("mean_confidence"),
        F.count("*").alias("words"),
    )


def word_spans(rows: DataFrame, options: Normalization = Normalization()) -> DataFrame:
    """(pdf, page, spans): the words of each page with their boxes, in file order."""
    words = rows.where(F.length(F.trim("text")) > 0)
    box = F.struct(F.col("left").cast("double").alias("x"), F.col("top").cast("double").alias("y"), F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"))
    whole = F.col("left").isNotNull() & F.col("top").isNotNull() & F.col("width").isNotNull() & F.col("height").isNotNull()
    span = F.struct("line_no", F.struct(normalize("text", options).alias("text"), F.when(whole, box).alias("bbox")).alias("s"))
    return words.groupBy("pdf", "page").agg(F.transform(F.array_sort(F.collect_list(span)), lambda x: x["s"]).alias("spans"))
