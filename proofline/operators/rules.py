"""Validation rules: each turns the corpus into rows of issues.

Issue rows have (id, phase, entry_ord, locator, rule, code, severity, message, source, claim); sorted by
the four ordinals they come in the order in which a summary's issues are reported: structure, sources,
then entry by entry its locators, tokens, words, weak sections and legs, then the review.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions import text as T
from proofline.functions import tokens as K
from proofline.operators.corpus import Corpus
from proofline.sources.config import Config

# Every issue code, whether it makes a command fail (1 or null), and what it means.
ISSUE_CODES = {
    "missing_evidence": (1, "the summary has no evidence section"), "stale_hash": (1, "the claim's hash is not that of its text"),
    "markdown_missing": (1, "the literal is not in the cited unit"), "markdown_ambiguous": (1, "the literal is in the cited unit more than once"),
    "pdf_missing": (1, "the literal is not on the cited page"), "pdf_ambiguous": (1, "the literal is on the cited page more than once"),
    "unknown_source": (1, "a locator names a source that is not declared"), "unused_source": (1, "no locator names a declared source"),
    "unknown_source_template": (1, "no templates are configured for a declared source"), "uncovered_token": (1, "no locator has a required token"),
    "uncovered_word": (1, "no locator has a content word"), "stale_section": (1, "the recorded headings are not those of the unit"),
    "ocr_disabled": (1, "a locator relies on recognised text, which is switched off"), "stale_review_claim": (1, "a review is of another text of its claim"),
    "stale_review_evidence": (1, "a review is of other evidence"), "unknown_review_claim": (1, "a review is of no claim"),
    "duplicate_review_claim": (1, "a claim has several reviews"), "missing_review": (1, "a claim has no review"),
    "unsupported_verdict": (1, "a review does not support its claim"), "duplicate_entry": (1, "a claim has several evidence entries"),
    "missing_evidence_entry": (1, "a claim has no evidence entry"), "entry_out_of_range": (1, "an evidence entry is of no claim"),
    "empty_sources": (1, "no sources are declared"), "empty_source": (1, "a source record has no path"), "empty_locators": (1, "an evidence entry has no locators"),
    "empty_exact": (1, "a literal is empty"), "unnormalized_exact": (1, "a literal is not in normalised form"), "invalid_source_name": (1, "a source name is not valid"),
    "invalid_sha256": (1, "a hash is not 64 small hexadecimal digits"), "invalid_id": (1, "an id is not valid"),
    "markdown_unit_missing": (1, "no single unit is at the coordinates"), "markdown_read_failed": (1, "a Markdown file cannot be read"),
    "pdf_extraction_failed": (1, "a page's text cannot be had"), "empty_markdown_candidates": (1, "a source has no Markdown templates"),
    "weak_section_only": (None, "all locators are under weak headings"), "markdown_locator_mismatch": (1, "a locator and its source differ in having Markdown"),
    "single_leg": (None, "a claim is confirmed by less than two texts"), "source_hash_mismatch": (1, "a file's hash is not the recorded one"),
    "source_mismatch": (1, "a recorded path is not the expected one"), "source_read_failed": (1, "a file cannot be hashed"),
    "source_outside_repo": (1, "a path leaves the corpus"), "source_unresolvable": (1, "a path leads to no file"),
    "summary_parse_failed": (1, "a summary cannot be read"), "id_mismatch": (1, "a summary's id is not that of its file"),
}

ISSUE_COLUMNS = ["id", "phase", "entry_ord", "locator", "rule", "code", "severity", "message", "source", "claim"]
SEVERITIES = {"error": "error", "warn": "warning"}
MOST = 1 << 30
STRUCTURE, SOURCES, ENTRY, REVIEW = 0, 1, 2, 3


def quoted(x: Column | str) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(T.col(x), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def issues(rows: DataFrame, code: str, phase: int, rule: int, detail: Column | None, severity: str = "error", entry: Column | None = None, locator: Column | None = None, source: Column | None = None, claim: Column | None = None) -> DataFrame:
    """Issue rows of one code; the message is what the code means and, behind a colon, the ``detail``."""
    said = F.lit(ISSUE_CODES[code][1])
    message = said if detail is None else F.concat(said, F.lit(": "), detail)
    none_int, none_text = F.lit(None).cast("int"), F.lit(None).cast("string")
    return rows.select(
        "id", F.lit(phase).alias("phase"), (F.lit(-1) if entry is None else entry.cast("int")).alias("entry_ord"), (none_int if locator is None else locator.cast("int")).alias("locator"),
        F.lit(rule).alias("rule"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), message.alias("message"),
        (none_text if source is None else source).alias("source"), (none_int if claim is None else claim.cast("int")).alias("claim"),
    )


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def declared(c: Corpus) -> DataFrame:
    """(id, pos, name, markdown, pdf): the sources that summaries declare."""
    return c.summaries.select("id", F.posexplode("sources").alias("pos", "s")).select("id", "pos", "s.name", "s.markdown", "s.pdf")


def structure_issues(c: Corpus, cfg: Config) -> DataFrame:
    """Shape of the evidence, and every entry bound to its claim."""
    term, terms = cfg.terms.claim, cfg.terms.claims
    out = [issues(c.summaries.where("sources is null"), "missing_evidence", STRUCTURE, 0, None)]
    out.append(issues(c.summaries.where("size(sources) = 0"), "empty_sources", STRUCTURE, 1, None))
    src = declared(c)
    out.append(issues(src.where(~T.is_source_name("name")), "invalid_source_name", STRUCTURE, 2, quoted("name"), entry=F.col("pos"), source=F.col("name")))
    halves = src.select("id", "pos", "name", F.explode(F.array(F.struct(F.lit("markdown").alias("half"), F.col("markdown").alias("r")), F.struct(F.lit("pdf").alias("half"), F.col("pdf").alias("r")))).alias("h"))
    halves = halves.select("id", "pos", "name", "h.half", "h.r").where("r is not null")
    label = F.concat_ws("/", "name", "half")
    out.append(issues(halves.where("r.source = ''"), "empty_source", STRUCTURE, 2, label, entry=F.col("pos"), source=F.col("name")))
    out.append(issues(halves.where(~T.is_sha256("r.sha256")), "invalid_sha256", STRUCTURE, 2, label, entry=F.col("pos"), source=F.col("name")))

    known = c.summaries.where("sources is not null").select("id", F.size("claims").alias("n_claims"))
    entries = c.entries.join(known, "id").join(c.claims(), ["id", "claim"], "left")
    at, claim = F.col("entry_ord"), F.col("claim")
    out.append(issues(entries.where("claim >= n_claims"), "entry_out_of_range", STRUCTURE, 3, F.format_string(f"{term} %d, {terms}: %d", claim, F.col("n_claims")), entry=at, claim=claim))
    out.append(issues(entries.where("claim < n_claims and not claim_sha256 <=> claim_hash"), "stale_hash", STRUCTURE, 3, F.format_string(f"{term} %d has %s, recorded is %s", claim, F.col("claim_hash"), F.coalesce("claim_sha256", F.lit("nothing"))), entry=at, claim=claim))
    out.append(issues(entries.where("coalesce(size(locators), 0) <= 0"), "empty_locators", STRUCTURE, 4, F.format_string(f"{term} %d", claim), entry=at, claim=claim))
    out.append(issues(entries.where(~F.coalesce(T.is_sha256("claim_sha256"), F.lit(False))), "invalid_sha256", STRUCTURE, 5, F.format_string(f"{term} %d", claim), entry=at, claim=claim))

    pairs = src.select("id", F.col("name").alias("source"), F.lit(True).alias("declared"), F.col("markdown").isNotNull().alias("has_md"))
    loc = c.locators.join(known.select("id"), "id").join(pairs, ["id", "source"], "left")
    place = {"entry": at, "locator": F.col("locator"), "claim": claim, "source": F.col("source")}
    differ = loc.where(F.col("declared") & (F.col("has_md") != F.col("markdown").isNotNull()))
    text = F.concat(quoted("source"), F.when(F.col("has_md"), F.lit(" has Markdown, the locator cites none")).otherwise(F.lit(" has none, the locator cites Markdown")))
    out.append(issues(differ, "markdown_locator_mismatch", STRUCTURE, 6, text, **place))
    out.append(issues(loc.where("declared is null"), "unknown_source", STRUCTURE, 6, quoted("source"), **place))
    norm = T.normalize("exact", cfg.normalization)
    judged = loc.withColumn("norm", norm)
    out.append(issues(judged.where("norm = ''"), "empty_exact", STRUCTURE, 7, None, **place))
    out.append(issues(judged.where("norm <> exact"), "unnormalized_exact", STRUCTURE, 7, F.concat(F.lit("normalised it reads "), quoted("norm")), **place))

    counts = c.claims().select("id", "claim").join(known.select("id"), "id").join(c.entries.groupBy("id", "claim").agg(F.count("*").alias("n")), ["id", "claim"], "left")
    last = F.lit(MOST) - 1
    out.append(issues(counts.where("n is null"), "missing_evidence_entry", STRUCTURE, 8, F.format_string(f"{term} %d", claim), entry=last, locator=claim, claim=claim))
    out.append(issues(counts.where("n > 1"), "duplicate_entry", STRUCTURE, 8, F.format_string(f"{term} %d, entries: %d", claim, F.col("n")), entry=last, locator=claim, claim=claim))
    used = c.locators.select("id", F.col("source").alias("name")).distinct()
    out.append(issues(src.join(used, ["id", "name"], "left_anti"), "unused_source", STRUCTURE, 9, quoted("name"), entry=F.lit(MOST), source=F.col("name"), locator=F.col("pos")))
    return union(out)


def resolved_sources(c: Corpus, cfg: Config) -> tuple[DataFrame, DataFrame]:
    """(sources that resolved: id, source, md_ok), and the issues of all others.

    Recorded paths must be the expected ones; with a file inventory the files must exist within the
    corpus and have the recorded hashes.  Without one, the parsed tables stand for the files.
    """
    spark = c.summaries.sparkSession
    table = [(name, s.markdown is not None, list(s.markdown or []), s.pdf) for name, s in cfg.corpus.sources.items()]
    configured = spark.createDataFrame(table, "name string, takes_md boolean, md_templates array<string>, pdf_template string")
    src = declared(c).join(F.broadcast(configured), "name", "left")  # as many rows as the configuration has sources
    place = {"entry": F.col("pos"), "source": F.col("name")}
    out = [issues(src.where("takes_md is null"), "unknown_source_template", SOURCES, 0, quoted("name"), **place)]
    src = src.where("takes_md is not null")
    out.append(issues(src.where(~T.is_valid_id("id")), "invalid_id", SOURCES, 1, quoted("id"), **place))
    src = src.where(T.is_valid_id("id"))
    out.append(issues(src.where("takes_md and size(md_templates) = 0"), "empty_markdown_candidates", SOURCES, 2, quoted("name"), **place))
    only = F.lit(len(cfg.corpus.sources) > 0) & (F.col("markdown").isNotNull()) & ~F.col("takes_md")
    out.append(issues(src.where(only), "source_mismatch", SOURCES, 3, F.concat(quoted("name"), F.lit(" should have no Markdown")), **place))
    src = src.where(~only)
    expected_md = F.transform("md_templates", lambda t: F.replace(t, F.lit("{id}"), F.col("id")))
    expected_pdf = F.replace(F.col("pdf_template"), F.lit("{id}"), F.col("id"))
    halves = src.select(
        "id", "pos", "name",
        F.explode(F.array(
            F.struct(F.lit("markdown").alias("half"), F.col("markdown").alias("r"), expected_md.alias("expected")),
            F.struct(F.lit("pdf").alias("half"), F.col("pdf").alias("r"), F.array(expected_pdf).alias("expected")))).alias("h"),
    ).select("id", "pos", "name", "h.*").where("r is not null")
    wrong = ~F.array_contains("expected", F.col("r.source"))
    out.append(issues(halves.where(wrong), "source_mismatch", SOURCES, 4, F.concat_ws("", F.col("name"), F.lit("/"), F.col("half"), F.lit(" records "), F.col("r.source"), F.lit(" in place of "), F.array_join("expected", " or ")), **place))
    if c.files is not None:
        seen = halves.join(c.files.select(F.col("path"), F.col("sha256").alias("actual"), "state"), F.col("r.source") == F.col("path"), "left").withColumn("state", F.coalesce("state", F.lit("missing")))
        for state, code in (("outside", "source_outside_repo"), ("missing", "source_unresolvable"), ("unreadable", "source_read_failed")):
            out.append(issues(seen.where(F.col("state") == state), code, SOURCES, 5, F.concat_ws("", F.col("name"), F.lit("/"), F.col("half"), F.lit(": "), F.col("r.source")), **place))
        out.append(issues(seen.where("state = 'undecodable' and half = 'markdown'"), "markdown_read_failed", SOURCES, 7, F.col("r.source"), **place))
        out.append(issues(seen.where("actual is not null and actual <> r.sha256"), "source_hash_mismatch", SOURCES, 6, F.format_string("%s/%s has %s, recorded is %s", "name", "half", "actual", F.col("r.sha256")), **place))
        ok = seen.groupBy("id", F.col("name").alias("source")).agg(F.max(F.when((F.col("half") == "markdown") & (F.col("state") == "ok"), 1).otherwise(0)).alias("md"), F.max(F.when(F.col("state").isin("outside", "missing"), 1).otherwise(0)).alias("lost"))
        good = ok.where("lost = 0").select("id", "source", (F.col("md") == 1).alias("md_ok"))
    else:
        good = src.select("id", F.col("name").alias("source"), F.col("markdown").isNotNull().alias("md_ok"))
    return good, union(out)


def unit_index(units: DataFrame) -> DataFrame:
    """(id, source, kind, line, col) -> how many units are there, and the text and headings of the one whose text sorts first."""
    return units.groupBy("id", "source", "kind", "line", "col").agg(F.count("*").alias("units"), F.min("text").alias("unit_text"), F.min_by("section", "text").alias("unit_section"))


def resolve_locators(c: Corpus, cfg: Config, resolved: DataFrame) -> DataFrame:
    """Every locator with what was found at its coordinates.

    Adds source_ok, md_ok, units (count at the coordinates), md_count, unit_section, pages, page_text_found,
    pdf_count.  Literals are compared in normalised form.
    """
    norm = cfg.normalization
    loc = c.locators.join(resolved.withColumn("source_ok", F.lit(True)), ["id", "source"], "left")
    loc = loc.withColumn("needle", T.normalize("exact", norm)).withColumn("kind", F.col("markdown.unit")).withColumn("line", F.col("markdown.line").cast("int")).withColumn("col", F.col("markdown.col").cast("int")).withColumn("backend", F.col("pdf.backend")).withColumn("page", F.col("pdf.page").cast("int"))
    loc = loc.join(unit_index(c.units), ["id", "source", "kind", "line", "col"], "left")
    pages = c.pages.groupBy("id", "source", "backend", "page").agg(F.min("text").alias("page_text"), F.count("*").alias("pages"))
    loc = loc.join(pages, ["id", "source", "backend", "page"], "left")
    return loc.withColumn("md_count", T.exact_count(T.normalize("unit_text", norm), F.col("needle"))).withColumn("pdf_count", T.exact_count(T.normalize(F.coalesce("page_text", F.lit("")), norm), F.col("needle"))).drop("unit_text", "page_text")


def _ocr_off(cfg: Config) -> Column:
    return F.lit(not cfg.pdf.ocr.enabled) & (F.col("backend") == "tesseract-ocr")


def pdf_problem(cfg: Config) -> Column:
    """A locator whose page does not confirm it; one whose source did not resolve has no such problem."""
    return F.coalesce(F.col("source_ok"), F.lit(False)) & (_ocr_off(cfg) | F.col("pages").isNull() | F.coalesce(F.col("pdf_count") != 1, F.lit(True)))


def locator_issues(found: DataFrame, cfg: Config) -> DataFrame:
    place = {"entry": F.col("entry_ord"), "locator": F.col("locator"), "claim": F.col("claim"), "source": F.col("source")}
    base = found.where("source_ok")
    md = base.where("md_ok and markdown is not null")
    where = F.format_string("%s at %d:%d", F.col("kind"), F.col("line"), F.col("col"))
    one = md.where("units = 1")
    out = [
        issues(md.where("units is null"), "markdown_unit_missing", ENTRY, 0, F.concat(where, F.lit(" has none")), **place),
        issues(md.where("units > 1"), "markdown_unit_missing", ENTRY, 0, F.concat(where, F.lit(" has several")), **place),
        issues(one.where("md_count = 0"), "markdown_missing", ENTRY, 1, where, **place),
        issues(one.where("md_count > 1"), "markdown_ambiguous", ENTRY, 1, F.format_string("%s, times: %d", where, F.col("md_count")), **place),
        issues(one.where("md_count = 1 and size(markdown.section) > 0").where(~T.paths_match("markdown.section", "unit_section")), "stale_section", ENTRY, 1,
               F.concat(F.array_join("markdown.section", " > "), F.lit(" is now "), F.array_join(F.coalesce("unit_section", F.array().cast("array<string>")), " > ")), **place),
        issues(base.where(_ocr_off(cfg)), "ocr_disabled", ENTRY, 2, None, **place),
    ]
    page = F.format_string("page %d by %s", F.col("page"), F.col("backend"))
    on = base.where(~F.coalesce(_ocr_off(cfg), F.lit(False)))
    out += [
        issues(on.where("pages is not null and pdf_count = 0"), "pdf_missing", ENTRY, 3, page, **place),
        issues(on.where("pages is not null and pdf_count > 1"), "pdf_ambiguous", ENTRY, 3, F.format_string("%s, times: %d", page, F.col("pdf_count")), **place),
        issues(on.where("pages is null or pdf_count is null"), "pdf_extraction_failed", ENTRY, 3, F.coalesce(page, F.lit("no page given")), **place),
    ]
    return union(out)


def uncovered_tokens(c: Corpus, cfg: Config) -> DataFrame:
    """(id, entry_ord, claim, pos, token): required tokens of a claim that no locator of its entry contains."""
    entries = c.entries.join(c.claims(), ["id", "claim"]).select("id", "entry_ord", "claim", "locators", F.posexplode(K.required_tokens("claim_text", cfg.normalization)).alias("pos", "token"))
    covered = F.exists(F.coalesce(F.transform("locators", lambda x: x["exact"]), F.array().cast("array<string>")), lambda e: K.covers(F.coalesce(e, F.lit("")), F.col("token")))
    return entries.where(~covered).select("id", "entry_ord", "claim", "pos", "token")


def uncovered_words(c: Corpus, cfg: Config) -> DataFrame:
    """(id, entry_ord, claim, words): content words of a claim that no locator of its entry contains, if any."""
    words = K.content_words("claim_text", cfg.coverage.word_min_len, cfg.coverage.allowed_words, F.col("exempt_words"))
    entries = c.entries.join(c.claims(), ["id", "claim"]).join(c.summaries.select("id", "exempt_words"), "id").withColumn("words", words)
    exacts = F.coalesce(F.transform("locators", lambda x: x["exact"]), F.array().cast("array<string>"))
    open_ = F.filter("words", lambda w: ~F.exists(exacts, lambda e: K.is_covered_any_case(F.coalesce(e, F.lit("")), w)))
    return entries.select("id", "entry_ord", "claim", open_.alias("words")).where("size(words) > 0")


def coverage_issues(c: Corpus, cfg: Config) -> list[DataFrame]:
    out = []
    if (s := SEVERITIES.get(cfg.coverage.tokens)) is not None:
        rows = uncovered_tokens(c, cfg)
        out.append(issues(rows, "uncovered_token", ENTRY, 4, F.concat(quoted("token"), F.format_string(f" of {cfg.terms.claim} %d", F.col("claim"))), s, entry=F.col("entry_ord"), locator=F.lit(MOST) + F.col("pos"), claim=F.col("claim")))
    if (s := SEVERITIES.get(cfg.coverage.words)) is not None:
        rows = uncovered_words(c, cfg)
        said = F.array_join(F.transform("words", lambda w: F.concat(F.lit('"'), w, F.lit('"'))), ", ")
        out.append(issues(rows, "uncovered_word", ENTRY, 5, F.concat(F.format_string(f"{cfg.terms.claim} %d, ", F.col("claim")), said), s, entry=F.col("entry_ord"), locator=F.lit(MOST), claim=F.col("claim")))
    return out


def weak_issues(found: DataFrame, cfg: Config) -> list[DataFrame]:
    """Entries all of whose locators resolve to units under weak headings."""
    if not cfg.sections.weak:
        return []
    weak = F.coalesce(F.col("source_ok"), F.lit(False)) & F.coalesce(F.col("md_ok"), F.lit(False)) & F.coalesce(F.col("units") == 1, F.lit(False)) & T.is_weak_section("unit_section", cfg.sections.weak)
    rows = found.groupBy("id", "entry_ord", "claim").agg(F.bool_and(weak).alias("weak")).where("weak")
    return [issues(rows, "weak_section_only", ENTRY, 6, F.format_string(f"{cfg.terms.claim} %d", F.col("claim")), "warning", entry=F.col("entry_ord"), locator=F.lit(MOST), claim=F.col("claim"))]


def review_issues(c: Corpus, cfg: Config, require_review: bool) -> DataFrame:
    term, terms = cfg.terms.claim, cfg.terms.claims
    claim, at = F.col("claim"), F.row_number().over(Window.partitionBy("id").orderBy("review_ord"))
    base = c.summaries.where("sources is not null").select("id", "has_review", F.size("claims").alias("n_claims"))
    rev = c.reviews.join(base.where("has_review"), "id").withColumn("at_ord", at)
    inside = rev.where("claim < n_claims").withColumn("nth", F.row_number().over(Window.partitionBy("id", "claim").orderBy("review_ord")))
    place = {"entry": F.col("at_ord"), "claim": claim}
    out = [
        issues(rev.where("claim >= n_claims"), "unknown_review_claim", REVIEW, 0, F.format_string(f"{term} %d, {terms}: %d", claim, F.col("n_claims")), **place),
        issues(inside.where("nth > 1"), "duplicate_review_claim", REVIEW, 0, F.format_string(f"{term} %d", claim), **place),
    ]
    first = inside.where("nth = 1").join(c.claims(), ["id", "claim"])
    out.append(issues(first.where("not claim_sha256 <=> claim_hash"), "stale_review_claim", REVIEW, 0, F.format_string(f"{term} %d has %s, reviewed was %s", claim, F.col("claim_hash"), F.coalesce("claim_sha256", F.lit("nothing"))), **place))
    last = c.entries.groupBy("id", "claim").agg(F.max_by("locators", "entry_ord").alias("locators")).select("id", "claim", T.evidence_sha256("locators", cfg.normalization).alias("expected"))
    stale = first.drop("locators").join(last, ["id", "claim"]).where("not evidence_sha256 <=> expected")
    out.append(issues(stale, "stale_review_evidence", REVIEW, 1, F.format_string(f"{term} %d has %s, reviewed was %s", claim, F.col("expected"), F.coalesce("evidence_sha256", F.lit("nothing"))), **place))
    if require_review:
        out.append(missing_reviews(c, cfg))
        wrong = inside.where("coalesce(verdict, '') <> 'supported'")
        out.append(issues(wrong, "unsupported_verdict", REVIEW, 3, F.format_string(f"{term} %d was given %s", claim, F.coalesce("verdict", F.lit("nothing"))), entry=F.lit(MOST) + F.col("at_ord"), claim=claim))
    return union(out)


def missing_reviews(c: Corpus, cfg: Config) -> DataFrame:
    base = c.summaries.where("sources is not null").select("id")
    rows = c.claims().join(base, "id").join(c.reviews.select("id", "claim").distinct(), ["id", "claim"], "left_anti")
    return issues(rows, "missing_review", REVIEW, 2, F.format_string(f"{cfg.terms.claim} %d", F.col("claim")), entry=F.lit(MOST), locator=F.col("claim"), claim=F.col("claim"))
