"""Registered queries of the core, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.functions import text as T
from proofline.functions import tokens as K
from proofline.operators import legs as L
from proofline.operators import locate, pages, propose
from proofline.operators import rules as R
from proofline.operators.corpus import Corpus, from_tables
from proofline.plans import check as C
from proofline.plans import extract
from proofline.session import one_per_key, table
from proofline.sources import config as cfg_module
from proofline.sources import ocr_rows

WEAK = ["gal", "vor"]  # parts of headings that the test corpus treats as weak


def test_config() -> cfg_module.Config:
    """The configuration of the test tables: papers with supplements and a compendium, all rules on."""
    supplement = cfg_module.SourceTemplates(markdown=None, pdf="pdfs/{id}-supp.pdf")
    compendium = cfg_module.SourceTemplates(markdown=None, pdf="pdfs/compendium/{id}.pdf")
    cfg = cfg_module.Config()
    cfg.corpus.sources |= {"supplement": supplement, "compendium": compendium}
    cfg.sections.weak = WEAK
    cfg.coverage.words = "warn"
    cfg.corroborate.single_leg = "warn"
    return cfg


def _checked(spark: SparkSession, d: str) -> C.Checked:
    return C.check(from_tables(spark, d), test_config(), require_review=True)


def _coded(spark: SparkSession, d: str, codes: list[str]) -> DataFrame:
    c, cfg = from_tables(spark, d), test_config()
    rows = R.structure_issues(c, cfg)
    return rows.where(F.col("code").isin(codes)).select("id", "code", "claim", "source")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return ocr_rows.load_ocr_rows(table(spark, d, "ocr_raw"))[1]


def p2_loaded(spark: SparkSession, d: str) -> DataFrame:
    valid = ocr_rows.load_ocr_rows(table(spark, d, "ocr_raw"))[0]
    return valid.selectExpr("raw_id", "pdf", "page", "line_no", "level", "page_num", "block_num", "par_num", "line_num", "word_num", "left as left_px", "top as top_px", "width", "height", "conf", "coalesce(text, '') as text")


def norm_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.normalize("text").alias("norm")).withColumn("digest", T.sha256("norm"))


def norm_whitespace_only(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "md_units").select("unit_id", T.normalize("text", T.WHITESPACE_ONLY).alias("norm")).distinct()


def fold_quotes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.fold_quotes("text").alias("folded"))


def units_by_line(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("doc_id", (F.col("pos") + 1).alias("line_no"), T.collapse_blanks("line").alias("unit")).where("unit <> ''")


def unit_index(spark: SparkSession, d: str) -> DataFrame:
    return R.unit_index(from_tables(spark, d).units).select("id", "source", "kind", "line", "col", "units")


def sentences(spark: SparkSession, d: str) -> DataFrame:
    units = from_tables(spark, d).units
    return units.select("unit_id", F.posexplode(T.split_sentences("text")).alias("pos", "sentence"))


def candidate_spans(spark: SparkSession, d: str) -> DataFrame:
    return propose.prepare_spans(from_tables(spark, d), cfg_module.Config()).select("id", "source", "unit_ord", "span_ord", "exact", "line", "col", "unit")


def claim_hash(spark: SparkSession, d: str) -> DataFrame:
    return from_tables(spark, d).claims()


def numeric_tokens(spark: SparkSession, d: str) -> DataFrame:
    claims = from_tables(spark, d).claims()
    return claims.select("id", "claim", F.posexplode(K.numeric_literals("claim_text")).alias("pos", "token"))


def number_words(spark: SparkSession, d: str) -> DataFrame:
    claims = from_tables(spark, d).claims()
    return claims.select("id", "claim", F.explode(K.number_words("claim_text")).alias("token"))


def quoted_phrases(spark: SparkSession, d: str) -> DataFrame:
    claims = from_tables(spark, d).claims()
    return claims.select("id", "claim", F.posexplode(K.quoted_phrases("claim_text")).alias("pos", "phrase"))


def required_tokens(spark: SparkSession, d: str) -> DataFrame:
    claims = from_tables(spark, d).claims()
    return claims.select("id", "claim", K.required_tokens("claim_text").alias("tokens"))


def advisory_terms(spark: SparkSession, d: str) -> DataFrame:
    claims = from_tables(spark, d).claims()
    return claims.select("id", "claim", F.posexplode(K.advisory_terms("claim_text")).alias("pos", "term"))


def document_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(K.advisory_terms("text")).alias("pos", "term"))


def content_words(spark: SparkSession, d: str) -> DataFrame:
    claims = from_tables(spark, d).claims()
    return claims.select("id", "claim", F.explode(K.content_words("claim_text")).alias("word"))


def token_coverage(spark: SparkSession, d: str) -> DataFrame:
    return R.uncovered_tokens(from_tables(spark, d), cfg_module.Config()).select("id", "claim", "token")


def word_coverage(spark: SparkSession, d: str) -> DataFrame:
    return R.uncovered_words(from_tables(spark, d), cfg_module.Config()).select("id", "claim", F.explode("words").alias("word"))


def _resolved(c: Corpus, cfg: cfg_module.Config) -> DataFrame:
    return R.resolve_locators(c, cfg, R.resolved_sources(c, cfg)[0])


def locator_outcomes(spark: SparkSession, d: str) -> DataFrame:
    found = _resolved(from_tables(spark, d), test_config())
    return found.select("locator_id", F.coalesce("units", F.lit(0)).alias("units"), T.occurrence_class(F.col("md_count")).alias("markdown_outcome"), F.when(F.col("pages").isNotNull(), T.occurrence_class(F.col("pdf_count"))).alias("pdf_outcome"))


def weak_sections(spark: SparkSession, d: str) -> DataFrame:
    c, cfg = from_tables(spark, d), test_config()
    return R.union(R.weak_issues(_resolved(c, cfg), cfg)).select("id", "claim")


def stale_sections(spark: SparkSession, d: str) -> DataFrame:
    c, cfg = from_tables(spark, d), test_config()
    return R.locator_issues(_resolved(c, cfg), cfg).where("code = 'stale_section'").select("id", "claim", "locator")


def altered_sections(spark: SparkSession, d: str) -> DataFrame:
    """Stale sections where every locator records one heading more than it should; the tables themselves have no such case."""
    c, cfg = from_tables(spark, d), test_config()
    longer = F.concat(F.coalesce("markdown.section", F.array().cast("array<string>")), F.array(F.lit("altered")))
    c.locators = c.locators.withColumn("markdown", F.when(F.col("markdown").isNotNull(), F.col("markdown").withField("section", longer)))
    return R.locator_issues(_resolved(c, cfg), cfg).where("code = 'stale_section'").select("id", "claim", "locator")


def doubled_entries(spark: SparkSession, d: str) -> DataFrame:
    """Duplicate entries where every entry is there twice; the tables themselves have no such case."""
    c = from_tables(spark, d)
    c.entries = c.entries.unionAll(c.entries)
    return R.structure_issues(c, test_config()).where("code = 'duplicate_entry'").select("id", "code", "claim")


def stale_hash(spark: SparkSession, d: str) -> DataFrame:
    return _coded(spark, d, ["stale_hash", "entry_out_of_range"]).select("id", "code", "claim")


def missing_entries(spark: SparkSession, d: str) -> DataFrame:
    return _coded(spark, d, ["missing_evidence_entry", "duplicate_entry"]).select("id", "code", "claim")


def unused_sources(spark: SparkSession, d: str) -> DataFrame:
    return _coded(spark, d, ["unused_source"]).select("id", "source")


def unknown_sources(spark: SparkSession, d: str) -> DataFrame:
    return _coded(spark, d, ["unknown_source", "markdown_locator_mismatch"]).select("id", "code", "claim", "source")


def unnormalized_exact(spark: SparkSession, d: str) -> DataFrame:
    return _coded(spark, d, ["unnormalized_exact", "empty_exact"]).select("id", "code", "claim")


def canonical_json_hash(spark: SparkSession, d: str) -> DataFrame:
    return from_tables(spark, d).entries.select("id", "claim", T.canonical_locators("locators").alias("canonical"), T.evidence_sha256("locators").alias("digest"))


def _reviews(spark: SparkSession, d: str, codes: list[str]) -> DataFrame:
    rows = R.review_issues(from_tables(spark, d), test_config(), require_review=True)
    return rows.where(F.col("code").isin(codes)).groupBy("id", "code", "claim").agg(F.count("*").alias("n"))


def review_missing(spark: SparkSession, d: str) -> DataFrame:
    return _reviews(spark, d, ["missing_review", "unknown_review_claim"])


def review_unsupported(spark: SparkSession, d: str) -> DataFrame:
    return _reviews(spark, d, ["unsupported_verdict", "duplicate_review_claim"])


def review_stale(spark: SparkSession, d: str) -> DataFrame:
    return _reviews(spark, d, ["stale_review_claim", "stale_review_evidence"])


def legs(spark: SparkSession, d: str) -> DataFrame:
    c, cfg = from_tables(spark, d), test_config()
    return L.claim_legs(c, cfg, _resolved(c, cfg)).select("id", "claim", F.array_join("legs", ",").alias("legs"), "corroborated")


def issues(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d).issues.select(*R.ISSUE_COLUMNS)


def check_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d).per_summary()


def check_report(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d).report()


def audit_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d).audit()


def locate_literals(spark: SparkSession, d: str) -> DataFrame:
    c = from_tables(spark, d)
    literals = one_per_key(table(spark, d, "candidates"), "candidate_id").select(F.col("candidate_id").alias("literal"), "exact")
    hits = locate.anywhere(literals, c.units.select(F.col("unit_id").alias("key"), "text"))
    return locate.classify(literals, hits).select("literal", "places", "unique_key", "outcome")


def locate_pages(spark: SparkSession, d: str) -> DataFrame:
    c = from_tables(spark, d)
    literals = c.locators.select("id", F.col("locator_id").alias("literal"), "exact")
    native = c.pages.where("backend = 'mutool-native'").select("id", F.col("page").alias("key"), "text")
    return locate.classify_pages(literals, locate.within(literals, native, ["id"])).select("literal", "pages", "page", "outcome")


def matching_boxes(spark: SparkSession, d: str) -> DataFrame:
    c = from_tables(spark, d)
    w = c.locators.select("locator_id", "id", "source", F.col("pdf.backend").alias("backend"), F.col("pdf.page").cast("int").alias("page"), "exact")
    found = w.join(c.pages.select("id", "source", "backend", "page", "spans"), ["id", "source", "backend", "page"])
    return found.select("locator_id", locate.matching_bbox("spans", F.col("exact")).alias("b")).where("b is not null").select("locator_id", "b.*")


def propose_scored(spark: SparkSession, d: str) -> DataFrame:
    c, cfg = from_tables(spark, d), cfg_module.Config()
    scored = propose.rank(propose.score_spans(propose.prepare_spans(c, cfg), propose.open_claims(c, True), cfg))
    return scored.where("rank <= 3").select("id", "claim", "rank", "matched", "exact", "line", "col")


def propose_budgeted(spark: SparkSession, d: str) -> DataFrame:
    return propose.propose(from_tables(spark, d), cfg_module.Config(), everything=True)


def propose_uncovered(spark: SparkSession, d: str) -> DataFrame:
    c, cfg = from_tables(spark, d), cfg_module.Config()
    return propose.uncovered(c, cfg, propose.propose(c, cfg, everything=True), True)


def extract_markdown(spark: SparkSession, d: str) -> DataFrame:
    return extract.page_markdown(from_tables(spark, d).pages.where("backend = 'mutool-native'"))


def ocr_page_text(spark: SparkSession, d: str) -> DataFrame:
    valid = ocr_rows.load_ocr_rows(table(spark, d, "ocr_raw"))[0]
    return pages.page_text(valid)


def source_pages(spark: SparkSession, d: str) -> DataFrame:
    c = from_tables(spark, d)
    return c.locators.groupBy("id", "source", F.col("pdf.backend").alias("backend")).agg(F.count_distinct("pdf.page").alias("cited_pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        p2_found, p2_loaded, norm_documents, norm_whitespace_only, fold_quotes, units_by_line, unit_index, sentences, candidate_spans, claim_hash, numeric_tokens,
        number_words, quoted_phrases, required_tokens, advisory_terms, document_terms, content_words, token_coverage, word_coverage, locator_outcomes, weak_sections, stale_sections, altered_sections, doubled_entries,
        stale_hash, missing_entries, unused_sources, unknown_sources, unnormalized_exact, canonical_json_hash, review_missing, review_unsupported, review_stale, legs,
        issues, check_rollup, check_report, audit_rollup, locate_literals, locate_pages, matching_boxes, propose_scored, propose_budgeted, propose_uncovered,
        extract_markdown, ocr_page_text, source_pages,
    ]
    return {f.__name__: f for f in own}
