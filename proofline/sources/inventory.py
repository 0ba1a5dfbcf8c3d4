"""Files of a corpus: discovery by templates, contents, hashes, and the relational corpus read from them."""

from __future__ import annotations

import os
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.operators import rules as R
from proofline.operators.corpus import Corpus
from proofline.sources import markdown, stext, summaries
from proofline.sources.config import Config


class InventoryError(ValueError):
    """A folder that does not fit its template."""


def summary_ids(root: Path, template: str) -> list[str]:
    """Sorted ids of the files under a template.  Links and hidden names are skipped, a missing folder has none, a folder below the template's depth is an error."""
    head, tail = template.split("{id}", 1)
    folder, prefix = os.path.split(head)
    base = root / folder
    if not base.is_dir():
        return []
    deep = tail.count("/")
    pattern = re.compile(re.escape(prefix) + r"([^/]+)" + re.escape(tail).replace(re.escape("{id}"), r"\1") + r"\Z")
    found: set[str] = set()
    for at, folders, names in os.walk(base):
        relative = Path(at).relative_to(base)
        depth = len(relative.parts)
        folders[:] = sorted(f for f in folders if not f.startswith(".") and not (Path(at) / f).is_symlink())
        if depth >= deep and folders:
            raise InventoryError(f"{relative / folders[0]} is deeper than {template}")
        for name in names:
            path = Path(at) / name
            if name.startswith(".") or path.is_symlink():
                continue
            if m := pattern.match((relative / name).as_posix()):
                found.add(m.group(1))
    return sorted(found)


def read_files(spark: SparkSession, root: Path, folder: str) -> DataFrame:
    """(path relative to root, content) of all files under a folder, read by the executors."""
    base = root / folder
    if not base.is_dir():
        return spark.createDataFrame([], "path string, content binary")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(base))
    prefix = root.resolve().as_posix().rstrip("/") + "/"
    plain = F.regexp_replace(F.expr("url_decode(replace(path, '+', '%2B'))"), "^file:/+", "/")
    return rows.select(plain.alias("full"), "content").select(F.when(F.startswith("full", F.lit(prefix)), F.substring("full", len(prefix) + 1, 1 << 20)).otherwise(F.col("full")).alias("path"), "content")


def file_states(files: DataFrame) -> DataFrame:
    """(path, sha256, state): what rules need to know of a file."""
    utf8 = F.is_valid_utf8(F.col("content").cast("string"))
    state = F.when(F.length("content") > summaries.MOST_BYTES, "undecodable").when(~utf8, "undecodable").otherwise("ok")
    return files.select("path", F.sha2("content", 256).alias("sha256"), state.alias("state"))


def path_state(root: Path, path: str) -> str | None:
    """What keeps a recorded path from being read: 'outside' (it leads out of ``root``, also by a link), 'missing', 'unreadable', or null."""
    full = root / path
    try:
        real = full.resolve(strict=True)
    except (OSError, RuntimeError):
        parts = os.path.normpath(full)
        return "missing" if Path(parts).is_relative_to(root) else "outside"
    if not real.is_relative_to(root):
        return "outside"
    return None if real.is_file() and os.access(real, os.R_OK) else "unreadable"


def recorded_states(spark: SparkSession, root: Path, rows: DataFrame) -> DataFrame:
    """(path, sha256, state) of the paths that summaries record and that cannot be read; the files lie on the driver's file system."""
    halves = rows.select(F.explode("sources").alias("s")).select(F.explode(F.array("s.markdown.source", "s.pdf.source")).alias("path")).where("path <> ''").distinct()
    bad = [(p, None, state) for (p,) in halves.toLocalIterator() if (state := path_state(root, p)) is not None]
    return spark.createDataFrame(bad, "path string, sha256 string, state string")


def _named(files: DataFrame, templates: dict[str, list[str]]) -> DataFrame:
    """Files with the (id, source) whose template they answer to; the first existing template of a source counts."""
    parts = None
    for source, options in templates.items():
        for rank, t in enumerate(options):
            head, tail = t.split("{id}", 1)
            pattern = "^" + re.escape(head) + "([^/]+)" + re.escape(tail).replace(re.escape("{id}"), r"\1") + "$"
            rows = files.where(F.col("path").rlike(pattern)).select(F.regexp_extract("path", pattern, 1).alias("id"), F.lit(source).alias("source"), F.lit(rank).alias("rank"), "path", "content")
            parts = rows if parts is None else parts.unionAll(rows)
    best = parts.groupBy("id", "source").agg(F.min_by(F.struct("path", "content"), "rank").alias("f"))
    return best.select("id", "source", "f.*")


def from_folder(spark: SparkSession, root: str | os.PathLike, cfg: Config, pages: DataFrame | None = None) -> tuple[Corpus, DataFrame]:
    """(corpus, issues of files that are no summaries) of a folder.

    Page texts come from ``pages`` (id, source, backend, page, text) or, if none are given, from
    structured-text files beside the PDFs (the PDF's path with .xml for .pdf); recognition is never run.
    """
    root = Path(root).resolve()
    template = cfg.corpus.summaries
    ids = summary_ids(root, template)
    head, tail = template.split("{id}", 1)
    files = read_files(spark, root, os.path.dirname(head))
    wanted = spark.createDataFrame([(i, template.replace("{id}", i)) for i in ids], "file_id string, path string")
    parsed = summaries.parse_files(wanted.join(files, "path", "left"), cfg.terms, tuple(cfg.coverage.allowed_from)).persist()
    failed = parsed.where("parse_error is not null").select(F.col("file_id").alias("id"), "parse_error")
    other = parsed.where("parse_error is null and id <> file_id").select("file_id", F.col("id").alias("found"))
    issues = R.issues(failed, "summary_parse_failed", -1, 0, F.col("parse_error")).unionByName(
        R.issues(other.select(F.col("file_id").alias("id"), "found"), "id_mismatch", -1, 0, F.concat(F.lit("it says "), F.col("found")))
    )
    good = parsed.where("parse_error is null and id = file_id")
    entries = good.select("id", F.posexplode("entries").alias("entry_ord", "e")).select("id", "entry_ord", "e.claim", "e.claim_sha256", "e.locators")
    locators = entries.select("id", "entry_ord", "claim", "claim_sha256", F.posexplode("locators").alias("locator", "l")).select("id", "entry_ord", "claim", "claim_sha256", "locator", "l.*")
    reviews = good.select("id", F.posexplode("reviews").alias("review_ord", "r")).select("id", "review_ord", "r.*")
    rows = good.select("id", "claims", "sources", F.col("reviews").isNotNull().alias("has_review"), "exempt_words")

    md_templates = {n: s.markdown for n, s in cfg.corpus.sources.items() if s.markdown}
    folders = sorted({os.path.dirname(t.split("{id}", 1)[0]) or "." for ts in md_templates.values() for t in ts} | {os.path.dirname(s.pdf.split("{id}", 1)[0]) or "." for s in cfg.corpus.sources.values()})
    sources = None
    for folder in folders:
        part = read_files(spark, root, folder)
        sources = part if sources is None else sources.unionAll(part)
    sources = sources.dropDuplicates(["path"])
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    units = markdown.units_of(_named(sources, md_templates).select("id", "source", text.alias("text")), cfg.normalization) if md_templates else spark.createDataFrame([], "id string, source string, ord int, kind string, text string, line int, col int, section array<string>")
    if pages is None:
        xml = {n: [s.pdf.removesuffix(".pdf") + ".xml"] for n, s in cfg.corpus.sources.items()}
        pages = stext.pages_of(_named(sources, xml).select("id", "source", text.alias("text")), cfg.normalization).where("error is null").select("id", "source", F.lit("mutool-native").alias("backend"), "page", "text", "spans")
    bad = recorded_states(spark, root, rows)
    read = file_states(sources.where(~F.col("path").endswith(".xml"))).join(bad, "path", "left_anti")
    corpus = Corpus(rows, entries, locators, units, pages, reviews, read.unionAll(bad))
    return corpus, issues
