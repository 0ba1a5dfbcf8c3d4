"""Propose evidence for claims: spans of a summary's Markdown, scored, ranked, and verified on its pages."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions import text as T
from proofline.functions import tokens as K
from proofline.operators.corpus import Corpus
from proofline.sources.config import Config

ATTEMPTS_PER_CANDIDATE = 8  # page verifications that a claim may spend per candidate wanted


def open_claims(c: Corpus, everything: bool = False) -> DataFrame:
    """Claims without locators, or all of them."""
    claims = c.claims()
    return claims if everything else claims.join(c.locators.select("id", "claim").distinct(), ["id", "claim"], "left_anti")


def prepare_spans(c: Corpus, cfg: Config) -> DataFrame:
    """(id, source, unit_ord, span_ord, exact, line, col, unit, section): sentences and whole units that occur once in their unit."""
    norm = cfg.normalization
    units = c.units.select("id", "source", F.col("ord").alias("unit_ord"), T.normalize("text", norm).alias("text"), "line", "col", F.col("kind").alias("unit"), "section")
    rows = units.select("*", F.posexplode(T.candidate_spans("text", norm)).alias("span_ord", "exact"))
    return rows.where(T.exact_count("text", "exact") == 1).drop("text")


def score_spans(spans: DataFrame, claims: DataFrame, cfg: Config) -> DataFrame:
    """Every span of a summary with the number of a claim's required tokens it covers, if any.

    Claims and spans meet by their summary; tokens are tested within the row.
    """
    wanted = claims.select("id", "claim", K.required_tokens("claim_text", cfg.normalization).alias("required")).where("size(required) > 0")
    matched = F.size(F.filter("required", lambda t: K.covers(F.col("exact"), t)))
    return wanted.join(spans, "id").withColumn("matched", matched).where("matched > 0").withColumn("n_required", F.size("required")).drop("required")


def rank(scored: DataFrame) -> DataFrame:
    """Total order per claim: most tokens, fewest bytes, source, line, column, then order of preparation."""
    w = Window.partitionBy("id", "claim").orderBy(F.desc("matched"), F.octet_length("exact"), "source", "line", "col", "unit_ord", "span_ord")
    return scored.withColumn("rank", F.row_number().over(w))


def verified_pages(spans: DataFrame, c: Corpus, cfg: Config) -> DataFrame:
    """(id, source, exact, found_page): the one native page of the source that contains the span at all."""
    pages = c.pages.where("backend = 'mutool-native'").select("id", "source", "page", T.normalize("text", cfg.normalization).alias("hay"))
    hits = spans.select("id", "source", "exact").distinct().join(pages, ["id", "source"]).where(F.contains("hay", "exact"))
    return hits.groupBy("id", "source", "exact").agg(F.count_distinct("page").alias("n"), F.min("page").alias("found_page")).where("n = 1").drop("n")


_KEPT = "id string, claim int, source string, exact string, matched int, n_required int, line int, col int, unit string, section array<string>, found_page int, rank int"


def _spend(candidates: int):
    """Walk a summary's claims in order with one memory of verified spans; a span not yet in it costs an attempt."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["claim", "rank"], kind="stable")
        memory: set[tuple[str, str]] = set()
        keep: list[int] = []
        for _, rows in batch.groupby("claim", sort=True):
            accepted = spent = 0
            for i, source, exact, page in zip(rows.index, rows["source"], rows["exact"], rows["found_page"]):
                if accepted >= candidates:
                    break
                if (source, exact) not in memory:
                    if spent >= candidates * ATTEMPTS_PER_CANDIDATE:
                        break
                    spent += 1
                    memory.add((source, exact))
                if not pd.isna(page):
                    accepted += 1
                    keep.append(i)
        return batch.loc[keep, [f.split(" ")[0] for f in _KEPT.split(", ")]]

    return run


def propose(c: Corpus, cfg: Config, candidates: int = 3, everything: bool = False) -> DataFrame:
    """The accepted candidates of every open claim, best first.

    Verification is set-wise; the order-dependent budget only does the accounting.  A claim reaches at
    most the spans before its budget ends, and the memory may prolong that by spans that earlier claims
    tried, so ranks are not cut beforehand; a group is one summary's own spans.
    """
    scored = rank(score_spans(prepare_spans(c, cfg), open_claims(c, everything), cfg))
    checked = scored.join(verified_pages(scored, c, cfg), ["id", "source", "exact"], "left")
    return checked.select("id", "claim", "source", "exact", "matched", "n_required", F.col("line").cast("int"), F.col("col").cast("int"), "unit", "section", F.col("found_page").cast("int").alias("found_page"), "rank").groupBy("id").applyInPandas(_spend(candidates), _KEPT)


def uncovered(c: Corpus, cfg: Config, accepted: DataFrame, everything: bool = False) -> DataFrame:
    """(id, claim, required_tokens, advisory_tokens, uncovered_tokens) of every open claim."""
    rows = open_claims(c, everything).select("id", "claim", K.required_tokens("claim_text", cfg.normalization).alias("required_tokens"), K.advisory_terms("claim_text").alias("advisory_tokens"))
    got = accepted.groupBy("id", "claim").agg(F.collect_list("exact").alias("exacts"))
    open_ = F.filter("required_tokens", lambda t: ~F.exists(F.coalesce("exacts", F.array().cast("array<string>")), lambda e: K.covers(e, t)))
    return rows.join(got, ["id", "claim"], "left").select("id", "claim", "required_tokens", "advisory_tokens", open_.alias("uncovered_tokens"))
