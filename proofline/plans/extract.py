"""Markdown of a paper from the text of its pages."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.functions.text import Normalization, normalize


def page_markdown(pages: DataFrame, options: Normalization = Normalization()) -> DataFrame:
    """(id, source, markdown, pages, paragraphs): per paper, a heading for each page and a paragraph for each of its blocks.

    ``pages``: id, source, page, text and optionally blocks (array<string>); without blocks the text is
    one.  Empty blocks are left out, a page without any keeps its heading.  Papers are never split: the
    pages of one meet in one row.
    """
    blocks = F.col("blocks") if "blocks" in pages.columns else F.array("text")
    kept = F.filter(F.transform(blocks, lambda b: normalize(F.coalesce(b, F.lit("")), options)), lambda b: b != "")
    rows = pages.select("id", "source", "page", kept.alias("b"))
    section = F.concat(F.format_string("## Page %d\n\n", "page"), F.array_join(F.transform("b", lambda b: F.concat(b, F.lit("\n\n"))), ""))
    return (
        rows.select("id", "source", "page", section.alias("s"), F.size("b").alias("n"))
        .groupBy("id", "source")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "s"))), lambda x: x["s"]), "").alias("markdown"), F.count("*").alias("pages"), F.sum("n").alias("paragraphs"))
    )


def with_front_matter(extracted: DataFrame, digests: DataFrame) -> DataFrame:
    """Adds the head that names the PDF and its hash; ``digests``: id, source, pdf, sha256."""
    head = F.format_string("---\nsource: %s\nsha256: %s\n---\n\n", "pdf", "sha256")
    return extracted.join(digests, ["id", "source"], "left").withColumn("markdown", F.concat(F.coalesce(head, F.lit("")), "markdown"))


def write_text(path: Path, text: str, force: bool = False) -> None:
    """Writes beside ``path`` and renames, so that a file is whole or not there; an existing one is kept unless ``force``."""
    if path.exists() and not force:
        raise FileExistsError(f"{path} exists")
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise
