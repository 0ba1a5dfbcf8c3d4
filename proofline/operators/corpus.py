"""The relational form of a corpus that all operators work on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofline.session import one_per_key, table

LOCATOR_TYPE = "struct<source:string,exact:string,markdown:struct<line:int,col:int,unit:string,section:array<string>>,pdf:struct<page:int,backend:string>>"


@dataclass
class Corpus:
    """Tables of a corpus; every one has one row per key.

    summaries: id, claims array<string>, sources array<struct<name, markdown, pdf>> (null: no evidence
    section), has_review boolean, exempt_words array<string>
    locators: id, entry_ord, claim, claim_sha256, locator, source, exact, markdown, pdf
    entries: id, entry_ord, claim, claim_sha256, locators array<struct>
    units: id, source, ord, kind, text, line, col, section
    pages: id, source, backend, page, text
    reviews: id, review_ord, claim, claim_sha256, evidence_sha256, verdict, reviewer, note, at
    files: path, sha256, state ('ok', 'outside', 'missing', 'unreadable', 'undecodable'), or None if unknown
    """

    summaries: DataFrame
    entries: DataFrame
    locators: DataFrame
    units: DataFrame
    pages: DataFrame
    reviews: DataFrame
    files: DataFrame | None = None

    def claims(self) -> DataFrame:
        """(id, claim, claim_text, claim_hash), one row per claim of a summary."""
        rows = self.summaries.select("id", F.posexplode("claims").alias("claim", "claim_text"))
        return rows.withColumn("claim_hash", F.sha2("claim_text", 256))

    def counted(self) -> DataFrame:
        return self.summaries.select("id", F.size("claims").alias("n_claims"))


def locator_struct() -> Column:
    return F.struct("source", "exact", "markdown", "pdf")


def from_tables(spark: SparkSession, d: str) -> Corpus:
    """The corpus of a folder of Parquet tables.  Rows repeated under one key count once; locators of a claim are in order of their ids."""
    summaries = one_per_key(table(spark, d, "summaries").select("id", "claims", "sources"), "id").select(
        "id", "claims", "sources", F.lit(True).alias("has_review"), F.array().cast("array<string>").alias("exempt_words"))
    loc = one_per_key(table(spark, d, "locators"), "locator_id")
    w = Window.partitionBy("id", "claim").orderBy("locator_id")
    locators = loc.select(
        "id", F.col("claim").alias("entry_ord"), "claim", "claim_sha256", (F.row_number().over(w) - 1).alias("locator"),
        F.coalesce("source", F.lit("default")).alias("source"), "exact", "markdown", "pdf", "locator_id",
    )
    entries = locators.groupBy("id", "entry_ord", "claim").agg(
        F.min_by("claim_sha256", "locator").alias("claim_sha256"),
        F.transform(F.array_sort(F.collect_list(F.struct("locator", locator_struct().alias("l")))), lambda x: x["l"]).alias("locators"),
    )
    units = one_per_key(table(spark, d, "md_units").drop("ingested_at"), "unit_id")
    pages = one_per_key(table(spark, d, "pdf_pages").drop("extracted_at"), "page_id")
    rev = one_per_key(table(spark, d, "reviews"), "review_id")
    reviews = rev.select("id", F.col("review_id").alias("review_ord"), "claim", "claim_sha256", "evidence_sha256", "verdict", "reviewer", "note", F.col("reviewed_at").alias("at"))
    return Corpus(summaries, entries, locators, units, pages, reviews)
