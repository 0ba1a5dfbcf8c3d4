"""Command line: check, audit, propose, locate, extract, schema, doctor."""

from __future__ import annotations

import argparse
import json
import shutil
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from proofline.functions import text as T
from proofline.operators import locate, propose
from proofline.plans import check as C
from proofline.plans import extract, render
from proofline.sources import config, inventory


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="proofline", description=__doc__)
    p.add_argument("--config")
    p.add_argument("--root", default=".")
    p.add_argument("--format", choices=["human", "json"], default="human")
    s = p.add_subparsers(dest="command", required=True)
    for name in ("check", "audit", "propose"):
        c = s.add_parser(name)
        c.add_argument("ids", nargs="*")
        if name != "propose":
            c.add_argument("--require-review", action="store_true")
        if name == "audit":
            c.add_argument("--strict", action="store_true")
        if name == "propose":
            c.add_argument("--all", action="store_true")
            c.add_argument("--candidates", type=int, default=3)
    c = s.add_parser("locate")
    c.add_argument("id")
    c.add_argument("--claim", type=int, required=True)
    c.add_argument("--exact", required=True)
    c.add_argument("--source", default="default")
    for name in ("page", "line", "column"):
        c.add_argument(f"--{name}", type=int)
    c = s.add_parser("extract")
    c.add_argument("id")
    c.add_argument("--source", default="default")
    c.add_argument("--write", action="store_true")
    c.add_argument("--force", action="store_true")
    s.add_parser("schema")
    s.add_parser("doctor")
    return p


def _show(rows, form: str, line: str | None = None) -> None:
    for r in rows.toLocalIterator():
        print(json.dumps(r.asDict(True), ensure_ascii=False, default=str) if form == "json" or line is None else r[line])


def main(args: list[str] | None = None) -> int:
    a = _parser().parse_args(args)
    if a.command == "locate" and a.column is not None and a.line is None:
        _parser().error("--column needs --line")
    spark = SparkSession.builder.appName("proofline").getOrCreate()
    if a.command == "schema":
        _show(render.code_table(spark), "json")
        return 0
    cfg, root = config.load(a.root, a.config)
    if a.command == "doctor":
        rows = [("root", root.is_dir(), str(root)), *[(t, shutil.which(t) is not None, shutil.which(t) or "not found") for t in ("mutool", "tesseract")]]
        _show(render.doctor(spark, rows), "json")
        return 0 if rows[0][1] else 1
    corpus, parse_issues = inventory.from_folder(spark, root, cfg)
    ids = list(getattr(a, "ids", [])) or ([a.id] if hasattr(a, "id") else [])
    if ids:
        only = lambda df: df.where(F.col("id").isin(ids))
        corpus.summaries, corpus.entries, corpus.locators, corpus.reviews, parse_issues = map(only, (corpus.summaries, corpus.entries, corpus.locators, corpus.reviews, parse_issues))
    if a.command in ("check", "audit"):
        done = C.check(corpus, cfg, a.require_review, parse_issues)
        shown = C.ordered(done.issues) if a.command == "check" else done.audit_issues()
        _show(render.issue_lines(shown), a.format, "line")
        _show(done.report(bool(ids)) if a.command == "check" else done.audit(), "json")
        broken = not parse_issues.isEmpty()
        return int(broken or done.failed(strict=getattr(a, "strict", False) or bool(ids and a.command == "check")))
    if a.command == "propose":
        found = propose.propose(corpus, cfg, a.candidates, a.all)
        _show(found if a.format == "json" else render.proposal_lines(found).orderBy("id", "claim", "rank"), a.format, "line")
        return int(not parse_issues.isEmpty())
    if a.command == "extract":
        return _extract(a, cfg, root, corpus)
    literal = spark.createDataFrame([(0, a.id, a.exact)], "literal int, id string, exact string")
    units = corpus.units.where(F.col("source") == a.source)
    if a.line is not None:
        units = units.where(F.col("line") == a.line)
    if a.column is not None:
        units = units.where(F.col("col") == a.column)
    at_units = locate.within(literal, units.select("id", F.struct("line", "col", F.col("kind").alias("unit"), "section").alias("key"), "text"), ["id"], cfg.normalization)
    pages = corpus.pages.where((F.col("source") == a.source) & (F.col("backend") == "mutool-native"))
    if a.page is not None:
        pages = pages.where(F.col("page") == a.page)
    at_pages = locate.classify_pages(literal, locate.within(literal, pages.select("id", F.col("page").alias("key"), "text"), ["id"], cfg.normalization))
    units_one = at_units.where("hits = 1").select("literal", "key.*")
    page = at_pages.where("outcome = 'ok'").select("literal", "page")
    # A source whose summary or configuration has no Markdown is located on its page alone.
    source = corpus.summaries.select(F.explode("sources").alias("s")).where(F.col("s.name") == a.source).select(F.col("s.markdown").isNotNull().alias("md")).first()
    templates = cfg.corpus.sources.get(a.source)
    markdown = source["md"] if source is not None else bool(templates and templates.markdown)
    if (markdown and units_one.count() != 1) or page.isEmpty():
        print(f"the literal is not {'in exactly one unit and ' if markdown else ''}on exactly one page", file=sys.stderr)
        return 1
    claims = corpus.claims().where(F.col("claim") == a.claim).select("id", "claim", F.col("claim_hash").alias("claim_sha256"))
    if claims.isEmpty():
        print(f"{a.id} has no {cfg.terms.claim} {a.claim}", file=sys.stderr)
        return 1
    units_of = units_one if markdown else units_one.limit(0)
    boxes = pages.select(F.col("page"), "spans").groupBy("page").agg(F.first("spans").alias("spans")) if "spans" in pages.columns else None
    rows = page.join(units_of, "literal", "left").withColumn("id", F.lit(a.id)).join(claims, "id")
    rows = rows.withColumns({"source": F.lit(a.source), "exact": T.normalize(F.lit(a.exact), cfg.normalization), "backend": F.lit("mutool-native")})
    if boxes is not None:
        rows = rows.join(boxes, "page", "left").withColumn("bbox", locate.matching_bbox("spans", F.col("exact"), cfg.normalization))
    _show(render.located_record(rows, cfg.terms.claim), a.format, "record")
    return 0


def _extract(a: argparse.Namespace, cfg: config.Config, root: Path, corpus) -> int:
    """Prints the Markdown of a paper's pages, or writes it to the first Markdown path of its source."""
    found = extract.page_markdown(corpus.pages.where((F.col("id") == a.id) & (F.col("source") == a.source)), cfg.normalization)
    templates = cfg.corpus.sources.get(a.source)
    if templates is None:
        print(f"no source {a.source} is configured", file=sys.stderr)
        return 1
    pdf = templates.pdf.replace("{id}", a.id)
    if corpus.files is not None:
        digests = corpus.files.where(F.col("path") == pdf).select(F.lit(a.id).alias("id"), F.lit(a.source).alias("source"), F.col("path").alias("pdf"), "sha256")
        found = extract.with_front_matter(found, digests)
    row = found.first()  # one paper
    if row is None or not row["paragraphs"]:
        print(f"{pdf} has no text", file=sys.stderr)
        return 1
    if not a.write:
        print(row["markdown"], end="")
        return 0
    if not templates.markdown:
        print(f"{a.source} has no Markdown path", file=sys.stderr)
        return 1
    target = root / templates.markdown[0].replace("{id}", a.id)
    try:
        extract.write_text(target, row["markdown"], a.force)
    except FileExistsError as e:
        print(e, file=sys.stderr)
        return 1
    print(target)
    return 0


if __name__ == "__main__":
    try:
        sys.exit(main())
    except BrokenPipeError:
        sys.exit(0)
