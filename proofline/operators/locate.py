"""Locate literals: the one Markdown unit and the one page that hold each exactly once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.functions import text as T
from proofline.functions.grams import chosen
from proofline.functions.text import Normalization

#: Grams by the length of a literal: (least length, characters of a gram, window of which one gram is taken).
GRAMS = ((23, 12, 12), (8, 8, 1), *((n, n, 1) for n in range(7, 0, -1)))
_CHUNK = 1 << 22  # characters hashed at once


def _grams(k: int, window: int):
    """Distinct chosen grams of every text that has at least one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = k + window - 1
        for batch in batches:
            key = batch.column("key")
            rows, parts, size = [], [], 0
            for i, text in enumerate([*batch.column("text").to_pylist(), None]):
                pieces = [] if text is None else [text[at : at + _CHUNK + least - 1] for at in range(0, len(text) - least + 1, _CHUNK)]
                if parts and (text is None and i == batch.num_rows or size + sum(map(len, pieces[:1])) > _CHUNK):
                    which, _, digest = chosen(parts, k, window)
                    pairs = np.unique(np.stack([np.array(rows, np.int64)[which], digest]), axis=1)
                    yield pa.record_batch([key.take(pa.array(pairs[0])), pa.array(pairs[1])], names=["key", "gram"])
                    rows, parts, size = [], [], 0
                for piece in pieces:
                    rows.append(i)
                    parts.append(piece)
                    size += len(piece)

    return run


def _candidates(need: DataFrame, hay: DataFrame, k: int, window: int) -> DataFrame:
    """(literal, needle, key): texts that share the rarest chosen gram of the literal."""
    kind = lambda df: f"key {df.schema['key'].dataType.simpleString()}, gram long"
    own = need.select(F.col("literal").alias("key"), F.col("needle").alias("text"))
    grams = own.mapInArrow(_grams(k, window), kind(own)).withColumnRenamed("key", "literal")
    at = hay.mapInArrow(_grams(k, window), kind(hay)).join(grams.select("gram").distinct(), "gram", "left_semi")
    counts = at.groupBy("gram").agg(F.count("*").alias("n"))
    # A gram that no text has leaves its literal without candidates.
    rarest = grams.join(counts, "gram", "left").groupBy("literal").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0").select("literal", "r.gram")
    return need.join(rarest, "literal").join(at, "gram").select("literal", "needle", "key").distinct()


def within(literals: DataFrame, texts: DataFrame, by: list[str], options: Normalization = Normalization()) -> DataFrame:
    """(literal, text key, hits): where each literal occurs, as an equi join on ``by`` with the occurrence test behind it.

    ``literals``: by..., literal, exact; ``texts``: by..., key, text.  Both are normalised once.
    """
    need = literals.select(*by, "literal", T.normalize("exact", options).alias("needle")).where("needle <> ''")
    hay = texts.select(*by, "key", T.normalize("text", options).alias("hay"))
    return need.join(hay, by).where(F.contains("hay", "needle")).select("literal", "key", T.exact_count("hay", "needle").alias("hits"))


def anywhere(literals: DataFrame, texts: DataFrame, options: Normalization = Normalization()) -> DataFrame:
    """(literal, key, hits) over all texts, without a common key and without a nested loop.

    ``literals``: literal, exact; ``texts``: key, text.  Of every ``window`` consecutive character grams of
    a text one is chosen by its hash, so a text that holds a literal has all of the literal's chosen grams.
    A literal is joined by the rarest of them; the test of the whole literal follows.  Shorter literals
    take shorter grams, each of which is chosen.
    """
    need = literals.select("literal", T.normalize("exact", options).alias("needle")).where("needle <> ''")
    hay = texts.select("key", T.normalize("text", options).alias("text")).where("text <> ''")
    lengths = {r["n"] for r in need.select(F.least(F.length("needle"), F.lit(GRAMS[0][0])).alias("n")).distinct().collect()}  # at most 23 numbers
    pairs, below = None, 1 << 31
    for least, k, window in GRAMS:
        if any(least <= n < below for n in lengths):
            some = _candidates(need.where((F.length("needle") >= least) & (F.length("needle") < below)), hay, k, window)
            pairs = some if pairs is None else pairs.unionAll(some)
        below = least
    if pairs is None:
        pairs = need.join(hay.limit(0), F.lit(True)).select("literal", "needle", "key")
    return pairs.join(hay, "key").where(F.contains("text", "needle")).select("literal", "key", T.exact_count("text", "needle").alias("hits"))


def classify(literals: DataFrame, hits: DataFrame) -> DataFrame:
    """(literal, places, unique_key, outcome): unique if exactly one text has it exactly once; texts with several
    occurrences do not count for 'unique' but make 'ambiguous' of what else would be missing."""
    per = hits.groupBy("literal").agg(F.count("*").alias("places"), F.count_if(F.col("hits") == 1).alias("singles"), F.min(F.when(F.col("hits") == 1, F.col("key"))).alias("one"))
    outcome = F.when(F.col("singles") == 1, "unique").when(F.col("places") > 0, "ambiguous").otherwise("missing")
    rows = literals.select("literal").distinct().join(per, "literal", "left")
    return rows.select("literal", F.coalesce("places", F.lit(0)).alias("places"), F.when(F.col("singles") == 1, F.col("one")).alias("unique_key"), outcome.alias("outcome"))


def classify_pages(literals: DataFrame, hits: DataFrame) -> DataFrame:
    """(literal, pages, page, outcome): ok (one page, once), repeated (one page, several times), many (several pages), missing."""
    per = hits.groupBy("literal").agg(F.count_distinct("key").alias("pages"), F.min("key").alias("page"), F.max("hits").alias("most"))
    outcome = F.when(F.col("pages").isNull(), "missing").when(F.col("pages") > 1, "many").when(F.col("most") > 1, "repeated").otherwise("ok")
    rows = literals.select("literal").distinct().join(per, "literal", "left")
    return rows.select("literal", F.coalesce("pages", F.lit(0)).alias("pages"), F.when(F.col("pages") == 1, F.col("page")).alias("page"), outcome.alias("outcome"))


def matching_bbox(spans: Column | str, exact: Column, options: Normalization = Normalization()) -> Column:
    """The box around the spans that the one occurrence of ``exact`` touches, or null.

    ``spans``: array<struct<text, bbox struct<x,y,width,height>>>.  Spans are joined by line breaks and
    normalised cumulatively, so each has a range in the normalised text; ranges that meet the match give
    their boxes, whose union is returned.  Null unless the match is unique and a touched span has a box.
    """
    s = T.col(spans)
    joined = lambda n: T.normalize(F.array_join(F.transform(F.slice(s, 1, n), lambda x: F.coalesce(x["text"], F.lit(""))), "\n"), options)
    n = F.coalesce(F.size(s), F.lit(0))
    whole = joined(F.greatest(n, F.lit(0)))
    needle = T.normalize(exact, options)
    start = F.position(needle, whole) - 1
    end = start + F.length(needle)
    ends = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.length(joined(i)))
    ranges = F.transform(ends, lambda e, i: F.struct(F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1)).alias("a"), e.alias("b"), F.get(s, i)["bbox"].alias("box")))
    touched = F.filter(ranges, lambda r: (r["a"] < end) & (r["b"] > start) & r["box"].isNotNull())
    left, top = F.array_min(F.transform(touched, lambda r: r["box"]["x"])), F.array_min(F.transform(touched, lambda r: r["box"]["y"]))
    right, bottom = F.array_max(F.transform(touched, lambda r: r["box"]["x"] + r["box"]["width"])), F.array_max(F.transform(touched, lambda r: r["box"]["y"] + r["box"]["height"]))
    box = F.struct(left.alias("x"), top.alias("y"), (right - left).alias("width"), (bottom - top).alias("height"))
    return F.when((n > 0) & (T.exact_count(whole, needle) == 1) & (F.size(touched) > 0), box)
