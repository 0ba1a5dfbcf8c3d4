import hashlib
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.operators import legs as L
from proofline.operators import locate, propose
from proofline.operators import rules as R
from proofline.operators.corpus import LOCATOR_TYPE, Corpus
from proofline.plans.check import check, ordered
from proofline.sources.config import Config
from proofline.streaming.incremental import check_stream

CLAIM = "The rate was 13 in Two Trials."
SHA = hashlib.sha256(CLAIM.encode()).hexdigest()
RECORD = "struct<source:string,sha256:string>"


def locator(exact="rate was 13 in two", line=3, unit="paragraph", section=("A",), page=1, backend="mutool-native", source="default", md=True):
    return (source, exact, (line, 1, unit, list(section)) if md else None, (page, backend))


def corpus(spark, locators=None, claims=(CLAIM,), sources="default", ident="abc", units=None, pages=None, reviews=(), sha=SHA, claim=0, entries=None):
    if isinstance(sources, list):
        sources = [(n, m and (m[0].replace("abc", ident), m[1]), (q[0].replace("abc", ident), q[1])) for n, m, q in sources]
    pair = [("default", (f"md/{ident}.md", "a" * 64), (f"pdfs/{ident}.pdf", "b" * 64))] if sources == "default" else sources
    summaries = spark.createDataFrame([(ident, list(claims), pair, bool(reviews), [])], f"id string, claims array<string>, sources array<struct<name:string,markdown:{RECORD},pdf:{RECORD}>>, has_review boolean, exempt_words array<string>")
    rows = entries if entries is not None else [(claim, sha, locators if locators is not None else [locator()])]
    entry = spark.createDataFrame([(ident, i, c, s, ls) for i, (c, s, ls) in enumerate(rows)], f"id string, entry_ord int, claim int, claim_sha256 string, locators array<{LOCATOR_TYPE}>")
    loc = entry.select("id", "entry_ord", "claim", "claim_sha256", F.posexplode("locators").alias("locator", "l")).select("id", "entry_ord", "claim", "claim_sha256", "locator", "l.*")
    u = spark.createDataFrame([(ident, *u[1:]) for u in units] if units is not None else [(ident, "default", 0, "paragraph", "The rate was 13 in two trials.", 3, 1, ["A"])], "id string, source string, ord int, kind string, text string, line int, col int, section array<string>")
    p = spark.createDataFrame([(ident, *q[1:]) for q in pages] if pages is not None else [(ident, "default", "mutool-native", 1, "The rate was 13 in two trials.")], "id string, source string, backend string, page int, text string")
    rev = spark.createDataFrame(list(reviews), "id string, review_ord long, claim int, claim_sha256 string, evidence_sha256 string, verdict string, reviewer string, note string, at string")
    return Corpus(summaries, entry, loc, u, p, rev)


def codes(c, cfg=None, **kw):
    return [r["code"] for r in ordered(check(c, cfg, **kw).issues).collect()]


CASES = {
    "missing_evidence": dict(sources=None), "stale_hash": dict(sha="c" * 64), "invalid_sha256": dict(sha="short"), "entry_out_of_range": dict(claim=5), "empty_locators": dict(locators=[]),
    "markdown_locator_mismatch": dict(locators=[locator(md=False)]), "unknown_source": dict(locators=[locator(source="other")]), "unnormalized_exact": dict(locators=[locator("rate  was 13 in two")]),
    "empty_exact": dict(locators=[locator(" ")]), "markdown_unit_missing": dict(locators=[locator(line=9)]), "markdown_missing": dict(locators=[locator("rate was 13 in two days")]),
    "stale_section": dict(locators=[locator(section=("B",))]), "pdf_extraction_failed": dict(locators=[locator(page=7)]), "uncovered_token": dict(locators=[locator("in two trials")]),
    "markdown_ambiguous": dict(units=[("abc", "default", 0, "paragraph", "rate was 13 in two rate was 13 in two", 3, 1, ["A"])]),
    "pdf_missing": dict(pages=[("abc", "default", "mutool-native", 1, "nothing")]), "pdf_ambiguous": dict(pages=[("abc", "default", "mutool-native", 1, "rate was 13 in two rate was 13 in two")]),
    "missing_evidence_entry": dict(claims=(CLAIM, "Other.")), "duplicate_entry": dict(entries=[(0, SHA, [locator()]), (0, SHA, [locator()])]),
    "invalid_source_name": dict(sources=[("default", ("md/abc.md", "a" * 64), ("pdfs/abc.pdf", "b" * 64)), ("No", None, ("x", "b" * 64))]),
    "unused_source": dict(sources=[("default", ("md/abc.md", "a" * 64), ("pdfs/abc.pdf", "b" * 64)), ("more", None, ("x", "b" * 64))]),
    "unknown_source_template": dict(sources=[("default", ("md/abc.md", "a" * 64), ("pdfs/abc.pdf", "b" * 64)), ("more", None, ("x", "b" * 64))]),
    "source_mismatch": dict(sources=[("default", ("md/else.md", "a" * 64), ("pdfs/abc.pdf", "b" * 64))]), "empty_source": dict(sources=[("default", ("", "a" * 64), ("pdfs/abc.pdf", "b" * 64))]),
    "empty_sources": dict(sources=[]),
}


def test_every_issue(spark):
    """One corpus with a summary for each case, checked at once."""
    parts = [corpus(spark, ident=code.replace("_", "-"), **case) for code, case in CASES.items()] + [corpus(spark, ident="all-good")]
    whole = Corpus(*[reduce(DataFrame.unionByName, [getattr(p, f) for p in parts]).toArrow() for f in ("summaries", "entries", "locators", "units", "pages", "reviews")])
    whole = Corpus(*[spark.createDataFrame(getattr(whole, f), getattr(parts[0], f).schema) for f in ("summaries", "entries", "locators", "units", "pages", "reviews")])
    found = {(r["id"], r["code"]) for r in check(whole).issues.select("id", "code").collect()}
    assert not [code for code in CASES if (code.replace("_", "-"), code) not in found]
    assert not [x for x in found if x[0] == "all-good"]


def test_missing_evidence_is_alone(spark):
    assert codes(corpus(spark, sources=None, entries=[]), require_review=True) == ["missing_evidence"]


def test_review_rules(spark):
    rev = lambda n, claim=0, sha=SHA, verdict="supported": ("abc", n, claim, sha, "x", verdict, "r", None, None)
    got = codes(corpus(spark, reviews=[rev(1, sha="d" * 64), rev(2), rev(3, claim=4), rev(4, verdict="partial")]), require_review=True)
    assert got.count("duplicate_review_claim") == 2 and "unknown_review_claim" in got and "stale_review_claim" in got and "stale_review_evidence" in got and got.count("unsupported_verdict") == 1
    assert codes(corpus(spark), require_review=True) == ["missing_review"]


def test_configured_rules(spark):
    cfg = Config()
    cfg.sections.weak, cfg.coverage.words, cfg.corroborate.single_leg, cfg.pdf.ocr.enabled = ["a"], "warn", "warn", False
    got = codes(corpus(spark, locators=[locator(backend="tesseract-ocr")]), cfg)
    assert {"weak_section_only", "uncovered_word", "single_leg", "ocr_disabled"} >= set(got) and "ocr_disabled" in got and "weak_section_only" in got


def test_legs_quirks(spark):
    c = corpus(spark, locators=[locator(source="other")])
    got = check(c).legs.first()
    assert got["legs"] == ["pdf", "default"]  # an unresolved source has no page problem
    assert check(corpus(spark, locators=[])).legs.first()["legs"] == ["default"]  # no literals: every text agrees


def test_rollups(spark):
    done = check(corpus(spark, sha="c" * 64))
    assert done.report().first().asDict() == {"checked": 1, "valid": 0, "invalid": 1, "skipped": 0, "corroborated": 1, "single_leg": 0}
    assert done.audit().first()["invalid"] == 1 and done.failed()
    missing = check(corpus(spark, sources=None))
    assert missing.report().first()["skipped"] == 1 and missing.report(True).first()["invalid"] == 1 and not missing.failed() and missing.failed(strict=True)


def test_propose_budget_and_order(spark):
    units = [("abc", "default", i, "paragraph", f"Rate 13 in two nr {i}{'x' * i}.", i + 1, 1, []) for i in range(12)]
    pages = [("abc", "default", "mutool-native", 1, " ".join(u[4] for u in units[9:]))]
    c = corpus(spark, entries=[], units=units, pages=pages)
    got = propose.propose(c, Config(), candidates=1).collect()
    assert [r["line"] for r in got] == []  # eight attempts end before the first span that is on a page
    got = propose.propose(c, Config(), candidates=2).orderBy("rank").collect()
    assert [r["line"] for r in got] == [10, 11]
    assert propose.uncovered(c, Config(), propose.propose(c, Config(), 2)).first()["uncovered_tokens"] == []


def test_locate(spark):
    lit = spark.createDataFrame([(1, "alpha beta gamma"), (2, "beta"), (3, "absent words here"), (4, "")], "literal int, exact string")
    texts = spark.createDataFrame([(10, "x alpha beta gamma y"), (11, "beta beta"), (12, None)], "key int, text string")
    got = {r["literal"]: r["outcome"] for r in locate.classify(lit, locate.anywhere(lit, texts)).collect()}
    assert got == {1: "unique", 2: "unique", 3: "missing", 4: "missing"}


def test_boxes(spark):
    df = spark.sql("select array(named_struct('text','a b','bbox',named_struct('x',0d,'y',0d,'width',2d,'height',1d)), named_struct('text','c','bbox',named_struct('x',5d,'y',3d,'width',1d,'height',1d)), named_struct('text','z','bbox',null)) as s")
    box = lambda e: df.select(locate.matching_bbox("s", F.lit(e)).alias("b")).first()["b"]
    assert box("b c").asDict() == {"x": 0, "y": 0, "width": 6, "height": 4} and box("nope") is None and box("z") is None


def test_stream(spark, tmp_path):
    c = corpus(spark, sha="c" * 64)
    c.summaries.write.parquet(str(tmp_path / "in"))
    arrivals = spark.readStream.schema(c.summaries.schema).parquet(str(tmp_path / "in"))
    check_stream(arrivals, c, Config(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).select("code").distinct().collect()[0][0] == "stale_hash"


def test_registry():
    assert len(R.ISSUE_CODES) == 44 and [c for c, (e, _) in R.ISSUE_CODES.items() if e is None] == ["weak_section_only", "single_leg"]
    assert L.claim_legs is not None
