"""Corroboration: the independent texts that confirm all literals of a claim."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.functions import text as T
from proofline.operators.corpus import Corpus
from proofline.operators.rules import ENTRY, SEVERITIES, issues, pdf_problem
from proofline.sources.config import Config


def confirmed_by_markdown(c: Corpus, cfg: Config) -> DataFrame:
    """(id, entry_ord, locator, text): corroborating Markdown texts some unit of which has the literal exactly once.

    An equi join on the paper, the occurrence test behind it; only a summary's own units meet its literals.
    """
    names = [n for n, s in cfg.corpus.sources.items() if s.corroborates and s.markdown is not None]
    units = c.units.where(F.col("source").isin(names)).select("id", F.col("source").alias("name"), T.normalize("text", cfg.normalization).alias("hay"))
    literals = c.locators.select("id", "entry_ord", "locator", T.normalize("exact", cfg.normalization).alias("needle"))
    hits = literals.join(units, "id").where(F.contains("hay", "needle")).where(T.exact_count("hay", "needle") == 1)
    return hits.select("id", "entry_ord", "locator", "name").distinct()


def claim_legs(c: Corpus, cfg: Config, found: DataFrame) -> DataFrame:
    """(id, entry_ord, claim, legs, corroborated): the texts that confirm every literal of an entry, in order.

    First ``pdf`` (no locator has a page problem; an unresolved source counts as none), then the
    corroborating sources by name (an entry without locators has all of them), then ``ocr``.
    """
    ocr_on = cfg.corroborate.ocr and cfg.pdf.ocr.enabled
    per = found.groupBy("id", "entry_ord").agg(F.count("*").alias("n"), F.bool_and(~pdf_problem(cfg)).alias("pdf_ok"), F.bool_and(F.coalesce(F.col("backend") != "tesseract-ocr", F.lit(True))).alias("native"))
    entries = c.entries.select("id", "entry_ord", "claim").join(per, ["id", "entry_ord"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    md = confirmed_by_markdown(c, cfg).groupBy("id", "entry_ord", "name").agg(F.count("*").alias("hits"))
    full = entries.select("id", "entry_ord", "n").join(md, ["id", "entry_ord"]).where("hits = n").groupBy("id", "entry_ord").agg(F.array_sort(F.collect_list("name")).alias("md_legs"))
    names = [n for n, s in cfg.corpus.sources.items() if s.corroborates and s.markdown is not None]
    present = c.units.where(F.col("source").isin(names)).groupBy("id").agg(F.array_sort(F.collect_set("source")).alias("all_md"))
    rows = entries.join(full, ["id", "entry_ord"], "left").join(present, "id", "left")
    empty = F.array().cast("array<string>")
    md_legs = F.when(F.col("n") == 0, F.coalesce("all_md", empty)).otherwise(F.coalesce("md_legs", empty))
    pdf = F.coalesce(F.col("pdf_ok"), F.lit(False)) & (F.col("n") > 0)
    legs = F.concat(F.when(pdf, F.array(F.lit("pdf"))).otherwise(empty), md_legs)
    if ocr_on:
        seen = c.pages.where("backend = 'tesseract-ocr'").select("id", "source", "page", T.normalize("text", cfg.normalization).alias("hay"))
        want = c.locators.select("id", "entry_ord", "locator", "source", F.col("pdf.page").cast("int").alias("page"), T.normalize("exact", cfg.normalization).alias("needle"))
        hits = want.join(seen, ["id", "source", "page"]).where(T.exact_count("hay", "needle") == 1).groupBy("id", "entry_ord").agg(F.count_distinct("locator").alias("ocr_hits"))
        rows = rows.join(hits, ["id", "entry_ord"], "left")
        legs = F.concat(legs, F.when(pdf & F.col("native") & (F.col("ocr_hits") == F.col("n")), F.array(F.lit("ocr"))).otherwise(empty))
    return rows.select("id", "entry_ord", "claim", legs.alias("legs")).withColumn("corroborated", F.size("legs") >= 2)


def single_leg_issues(legs: DataFrame, cfg: Config) -> list[DataFrame]:
    severity = SEVERITIES.get(cfg.corroborate.single_leg)
    if severity is None:
        return []
    said = F.concat(F.format_string(f"{cfg.terms.claim} %d, confirmed by: ", F.col("claim")), F.when(F.size("legs") == 0, F.lit("none")).otherwise(F.array_join("legs", ", ")))
    return [issues(legs.where("not corroborated"), "single_leg", ENTRY, 7, said, severity, entry=F.col("entry_ord"), locator=F.lit((1 << 31) - 1), claim=F.col("claim"))]
