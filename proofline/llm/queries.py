"""Queries of this subpackage, each over its whole tables, and the SQL of those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm import canonical, consensus, encode, language, mix, scans, sentences, spans
from proofline.session import cut_lineage, table


def _records(spark: SparkSession, d: str) -> DataFrame:
    return spans.paper_records(table(spark, d, "md_units"), table(spark, d, "pdf_pages"), table(spark, d, "locators"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_pairs(_records(spark, d))


def p1_spans(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(_records(spark, d))


def p1_without_repeats(spark: SparkSession, d: str) -> DataFrame:
    return spans.remove_repeats(_records(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.hidden_matches(table(spark, d, "locators"), table(spark, d, "md_units"), table(spark, d, "pdf_pages"))


def p3_canonical(spark: SparkSession, d: str) -> DataFrame:
    parts = [("md_units", "unit_id", "text"), ("pdf_pages", "page_id", "text"), ("locators", "locator_id", "exact")]
    out = None
    for name, key, text in parts:
        part = canonical.canonical_columns(table(spark, d, name), key, text)
        out = part if out is None else out.unionAll(part)
    return out


def _repaired(spark: SparkSession, d: str) -> DataFrame:
    pages, supplements = table(spark, d, "pdf_pages"), table(spark, d, "parsed_tsv")
    texts = pages.select("text", (F.col("backend") != "tesseract-ocr").alias("native")).unionAll(supplements.select("text", F.lit(False).alias("native")))
    return scans.repair(scans.scanned_pages(pages, supplements), texts=texts)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    lines = _repaired(spark, d).select(F.col("record").alias("record_id"), F.explode("lines").alias("l"))
    return lines.select("record_id", "l.line_no", "l.kind").distinct()


def p4_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    rows = _repaired(spark, d).select(F.col("record").alias("record_id"), F.posexplode("paragraphs").alias("pos", "paragraph"))
    return rows


def _consensus(spark: SparkSession, d: str) -> consensus.Consensus:
    return consensus.consensus(consensus.valid_verdicts(table(spark, d, "reviews")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _consensus(spark, d).items().where("reviewers >= 3").select("id", "claim", "verdict")


def p5_agreement(spark: SparkSession, d: str) -> DataFrame:
    return _consensus(spark, d).items().select("id", "claim", F.round("confidence", 6).alias("confidence"), F.round("agreement", 6).alias("agreement"), "reviewers")


def p5_reviewers(spark: SparkSession, d: str) -> DataFrame:
    return _consensus(spark, d).annotators().select("annotator", F.round("competence", 6).alias("competence"), F.round("accuracy", 6).alias("accuracy"), "votes")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    texts = sentences.running_text(table(spark, d, "md_units"), table(spark, d, "candidates"))
    return sentences.sentences(texts).select(F.col("record").alias("record_id"), "start_char").distinct()


def p6_sentences(spark: SparkSession, d: str) -> DataFrame:
    texts = sentences.running_text(table(spark, d, "md_units"), table(spark, d, "candidates"))
    return sentences.sentences(texts).distinct()


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(table(spark, d, "documents"))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    return p7_ids(spark, d).select("doc_id", encode.decode("ids").alias("text"))


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    encoded = encode.encode(table(spark, d, "documents"), keep=("source",))
    sized = cut_lineage(encoded.select("doc_id", "source", F.size("ids").alias("size")))
    return mix.mix(sized, table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix.shares(*_mixture(spark, d))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[0]


def _languages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs, codes = table(spark, d, "documents"), table(spark, d, "lang_codes")
    return language.identify(docs, language.train(docs, codes)), codes


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return language.mislabelled(*_languages(spark, d)).select("doc_id", "start_char", "lang").distinct()


def p9_languages(spark: SparkSession, d: str) -> DataFrame:
    return _languages(spark, d)[0]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [p1_found, p1_spans, p1_without_repeats, p3_found, p3_canonical, p4_found, p4_paragraphs, p5_found, p5_agreement, p5_reviewers, p6_found, p6_sentences, p7_ids, p7_decoded, p8_shares, p8_mixture, p9_found, p9_languages]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        # what the ids stand for: the text itself, empty where there is none
        "p7_decoded": "select doc_id, coalesce(text, '') as text from documents",
    }
