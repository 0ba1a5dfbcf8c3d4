"""Summary documents: YAML to the relational corpus, with vocabulary, shorthand and strictness."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.sources.config import Terms

MOST_BYTES = 64 * 1024 * 1024


class SummaryError(ValueError):
    """A document that is no summary, with the reason."""


class _Loader(yaml.SafeLoader):
    """Dates stay text."""


_Loader.yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t != "tag:yaml.org,2002:timestamp"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}

_EVIDENCE, _REVIEW = {"sources", "claims", "markdown", "pdf"}, {"claims"}
_ENTRY, _LOCATOR = {"claim", "claim_sha256", "locators"}, {"source", "exact", "markdown", "pdf"}
_MARKDOWN, _PDF, _RECORD = {"line", "column", "unit", "section"}, {"page", "backend"}, {"source", "sha256"}
_VERDICT = {"claim", "claim_sha256", "evidence_sha256", "verdict", "reviewer", "note", "at"}
_UNITS = {"heading", "paragraph", "list_item", "blockquote", "table_cell", "code_block"}


def _rename(tree: dict, pairs: dict[str, str]) -> dict:
    """Keys of the configured vocabulary under their canonical names; both at once is an error."""
    out = {}
    for k, v in tree.items():
        name = pairs.get(k, k)
        if name in out:
            raise SummaryError(f"both {name!r} and its configured name are given")
        out[name] = v
    return out


def canonicalize(tree: dict, terms: Terms) -> dict:
    pairs = {terms.claims: "claims", terms.claim: "claim", f"{terms.claim}_sha256": "claim_sha256"}
    tree = _rename(tree, {terms.claims: "claims"})
    for part in ("evidence", "review"):
        if isinstance(body := tree.get(part), dict):
            body = _rename(body, {terms.claims: "claims"})
            if isinstance(body.get("claims"), list):
                body["claims"] = [_rename(e, pairs) if isinstance(e, dict) else e for e in body["claims"]]
            tree[part] = body
    return tree


def _only(tree: Any, known: set[str], at: str) -> dict:
    if not isinstance(tree, dict):
        raise SummaryError(f"{at} must be a mapping")
    if unknown := sorted(set(map(str, tree)) - known):
        raise SummaryError(f"unknown key {at}.{unknown[0]}")
    return tree


def _number(x: Any, least: int, at: str) -> int:
    if isinstance(x, bool) or not isinstance(x, int) or x < least:
        raise SummaryError(f"{at} must be one-based" if least else f"{at} must be an index")
    return x


def _text(x: Any, at: str) -> str:
    if not isinstance(x, str):
        raise SummaryError(f"{at} must be text")
    return x


def _record(tree: Any, at: str) -> dict:
    tree = _only(tree, _RECORD, at)
    return {k: _text(tree.get(k), f"{at}.{k}") for k in ("source", "sha256")}


def _locator(tree: Any) -> dict:
    tree = _only(tree, _LOCATOR, "locator")
    md = tree.get("markdown")
    if md is not None:
        md = _only(md, _MARKDOWN, "locator.markdown")
        if md.get("unit") not in _UNITS:
            raise SummaryError("locator.markdown.unit is no kind of unit")
        md = {"line": _number(md.get("line"), 1, "line"), "col": _number(md.get("column"), 1, "column"), "unit": md["unit"], "section": list(md.get("section") or [])}
    pdf = _only(tree.get("pdf"), _PDF, "locator.pdf")
    if pdf.get("backend") not in ("mutool-native", "tesseract-ocr"):
        raise SummaryError("locator.pdf.backend is unknown")
    return {"source": tree.get("source", "default"), "exact": _text(tree.get("exact"), "locator.exact"), "markdown": md, "pdf": {"page": _number(pdf.get("page"), 1, "page"), "backend": pdf["backend"]}}


def exempt_words(tree: dict, paths: list[str]) -> list[str]:
    """Words of ASCII letters at dotted paths (text or lists of text), lower case, sorted, once each."""
    words: set[str] = set()
    for path in paths:
        node: Any = tree
        for key in path.split("."):
            node = node.get(key) if isinstance(node, dict) else None
        for text in [node] if isinstance(node, str) else node if isinstance(node, list) else []:
            if isinstance(text, str):
                words |= {w.lower() for w in re.findall("[A-Za-z]+", text)}
    return sorted(words)


def parse_summary(content: str, terms: Terms = Terms(), allowed_from: tuple[str, ...] = ()) -> dict:
    """The typed document: id, claims, sources (null without evidence), entries, reviews (null without review), exempt_words."""
    try:
        raw = yaml.load(content, _Loader)
    except yaml.YAMLError as error:
        raise SummaryError(str(error).split("\n")[0]) from error
    if not isinstance(raw, dict):
        raise SummaryError("summary must be a mapping")
    tree = canonicalize(raw, terms)
    claims = tree.get("claims")
    if not isinstance(claims, list) or not all(isinstance(c, str) for c in claims):
        raise SummaryError("claims must be a list of text")
    out = {"id": _text(tree.get("id"), "id"), "claims": claims, "sources": None, "entries": [], "reviews": None, "exempt_words": exempt_words(raw, list(allowed_from))}
    if (evidence := tree.get("evidence")) is not None:
        evidence = _only(evidence, _EVIDENCE, "evidence")
        short = {k: evidence[k] for k in ("markdown", "pdf") if k in evidence}
        if short and "sources" in evidence:
            raise SummaryError("evidence.sources and evidence.markdown/pdf exclude each other")
        sources = {"default": short} if short else evidence.get("sources") or {}
        if not isinstance(sources, dict):
            raise SummaryError("evidence.sources must be a mapping")
        out["sources"] = []
        for name in sorted(sources):
            pair = _only(sources[name], {"markdown", "pdf"}, f"evidence.sources.{name}")
            out["sources"].append({"name": name, "markdown": _record(pair["markdown"], "markdown") if pair.get("markdown") is not None else None, "pdf": _record(pair.get("pdf"), "pdf")})
        for e in evidence.get("claims") or []:
            e = _only(e, _ENTRY, "evidence.claims")
            out["entries"].append({"claim": _number(e.get("claim"), 0, "claim"), "claim_sha256": _text(e.get("claim_sha256"), "claim_sha256"), "locators": [_locator(x) for x in e.get("locators") or []]})
    if (review := tree.get("review")) is not None:
        out["reviews"] = []
        for e in _only(review, _REVIEW, "review").get("claims") or []:
            e = _only(e, _VERDICT, "review.claims")
            if e.get("verdict") not in ("supported", "partial", "unsupported", "unclear"):
                raise SummaryError("review verdict is unknown")
            out["reviews"].append({"claim": _number(e.get("claim"), 0, "claim")} | {k: None if e.get(k) is None else str(e[k]) for k in ("claim_sha256", "evidence_sha256", "verdict", "reviewer", "note", "at")})
    return out


PARSED = (
    "file_id string, id string, claims array<string>, sources array<struct<name:string,markdown:struct<source:string,sha256:string>,pdf:struct<source:string,sha256:string>>>, "
    "entries array<struct<claim:int,claim_sha256:string,locators:array<struct<source:string,exact:string,markdown:struct<line:int,col:int,unit:string,section:array<string>>,pdf:struct<page:int,backend:string>>>>>, "
    "reviews array<struct<claim:int,claim_sha256:string,evidence_sha256:string,verdict:string,reviewer:string,note:string,at:string>>, exempt_words array<string>, parse_error string"
)


def parse_files(files: DataFrame, terms: Terms = Terms(), allowed_from: tuple[str, ...] = ()) -> DataFrame:
    """Parsed summaries of ``files`` (file_id, content binary): typed columns, or parse_error with the rest null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file_id, content in zip(batch.column("file_id").to_pylist(), batch.column("content").to_pylist()):
                try:
                    if content is None or len(content) > MOST_BYTES:
                        raise SummaryError("file is missing or too large")
                    body, error = json.dumps(parse_summary(content.decode("utf-8"), terms, allowed_from)), None
                except (SummaryError, UnicodeDecodeError) as problem:
                    body, error = None, str(problem)
                rows.append((file_id, body, error))
            yield pa.record_batch([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["file_id", "body", "parse_error"])

    inner = PARSED.removeprefix("file_id string, ").removesuffix(", parse_error string")
    parsed = files.select("file_id", "content").mapInArrow(run, "file_id string, body string, parse_error string")
    return parsed.select("file_id", F.from_json("body", inner).alias("b"), "parse_error").select("file_id", "b.*", "parse_error")
