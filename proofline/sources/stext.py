"""Structured page text (XML) and recognition side files."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.functions.text import Normalization, col
from proofline.sources.markdown import normalize_text


class StextError(ValueError):
    """XML that is no structured page text, with the reason."""


def _box(text: str | None) -> dict | None:
    parts = (text or "").split()
    if len(parts) != 4:
        return None
    try:
        x0, y0, x1, y1 = map(float, parts)
    except ValueError:
        return None
    return {"x": x0, "y": y0, "width": x1 - x0, "height": y1 - y0}


def parse_document(xml: str, options: Normalization = Normalization()) -> list[dict]:
    """Pages in order: page, text, blocks, spans.  Nesting must be document, page, block, line; a line needs its text."""
    pages: list[dict] = []
    path: list[str] = []
    parents = {"page": "document", "block": "page", "line": "block"}
    block: list[str] = []
    try:
        for event, e in ElementTree.iterparse(io.StringIO(xml), ("start", "end")):
            if event == "start":
                if e.tag in parents and parents[e.tag] not in path:
                    raise StextError(f"{e.tag} outside {parents[e.tag]}")
                path.append(e.tag)
                if e.tag == "page":
                    pages.append({"lines": [], "blocks": [], "spans": []})
                elif e.tag == "block":
                    block = []
                elif e.tag == "line":
                    if "text" not in e.attrib:
                        raise StextError("line without text")
                    block.append(e.attrib["text"])
                    pages[-1]["lines"].append(e.attrib["text"])
                    pages[-1]["spans"].append({"text": e.attrib["text"], "bbox": _box(e.attrib.get("bbox"))})
            else:
                path.pop()
                if e.tag == "block" and (text := normalize_text("\n".join(block), options)):
                    pages[-1]["blocks"].append(text)
                e.clear()
    except ElementTree.ParseError as error:
        raise StextError(str(error)) from error
    if not pages:
        raise StextError("no pages")
    return [{"page": i, "text": normalize_text("\n".join(p["lines"]), options), "blocks": p["blocks"], "spans": p["spans"]} for i, p in enumerate(pages, 1)]


_BBOX = pa.struct([(c, pa.float64()) for c in ("x", "y", "width", "height")])
_SCHEMA = pa.schema([("id", pa.string()), ("source", pa.string()), ("page", pa.int32()), ("text", pa.string()), ("blocks", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("text", pa.string()), ("bbox", _BBOX)]))), ("error", pa.string())])


def pages_of(files: DataFrame, options: Normalization = Normalization()) -> DataFrame:
    """Page rows of XML files (id, source, text); a file that is none gives one row with the error instead of failing the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for i, s, text in zip(*(batch.column(c).to_pylist() for c in ("id", "source", "text"))):
                try:
                    rows += [{"id": i, "source": s, "error": None} | p for p in parse_document(text or "", options)]
                except StextError as error:
                    rows.append({"id": i, "source": s, "page": None, "text": None, "blocks": None, "spans": None, "error": str(error)})
            yield pa.record_batch([pa.array([r[f.name] for r in rows], f.type) for f in _SCHEMA], schema=_SCHEMA)

    kind = "id string, source string, page int, text string, blocks array<string>, spans array<struct<text:string,bbox:struct<x:double,y:double,width:double,height:double>>>, error string"
    return files.select("id", "source", "text").mapInArrow(run, kind)


def orientation(x: Column | str) -> Column:
    """Degrees of the first line "Rotate: n" with n of 0, 90, 180, 270, else 0."""
    found = F.regexp_extract(col(x), r"(?m)^Rotate:[ \t]*(\d+)[ \t]*$", 1)
    return F.when(found.isin("0", "90", "180", "270"), F.try_to_number(found, F.lit("999")).cast("int")).otherwise(0)


def parse_version(text: str) -> tuple[int, int, int] | None:
    """The first token that starts with a digit and has three parts; each counts by its leading digits."""
    for token in text.split():
        if token[:1].isdigit():
            parts = token.split(".")
            numbers = [re.match(r"\d+", p) for p in parts]
            return tuple(int(m.group()) for m in numbers) if len(parts) == 3 and all(numbers) else None
    return None


def version_in(text: str, least: tuple[int, int], below: tuple[int, int]) -> bool:
    version = parse_version(text)
    return version is not None and least <= version[:2] < below
