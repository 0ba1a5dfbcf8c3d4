"""Project configuration: discovery, strict decoding, validation."""

from __future__ import annotations

import json
import os
import re
import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any

import yaml

from proofline.functions.text import Normalization

PROJECT_NAME = "proofline"  # the project file's name; it may be hidden or lie in .config
_SUFFIXES = (".yaml", ".yml", ".toml", ".json")


class ConfigError(ValueError):
    """A configuration that cannot be used, with the reason."""


@dataclass
class SourceTemplates:
    markdown: list[str] | None = field(default_factory=lambda: ["md/{id}.md", "md/{id}/{id}.md"])
    pdf: str = "pdfs/{id}.pdf"
    corroborates: bool = True


@dataclass
class CorpusConfig:
    summaries: str = "summaries/{id}.yaml"
    sources: dict[str, SourceTemplates] = field(default_factory=lambda: {"default": SourceTemplates()})


@dataclass
class CoverageConfig:
    tokens: str = "error"
    words: str = "off"
    word_min_len: int = 4
    allowed_words: list[str] = field(default_factory=list)
    allowed_from: list[str] = field(default_factory=list)


@dataclass
class OcrConfig:
    enabled: bool = True
    dpi: int = 300
    lang: str = "eng"
    page_segmentation_mode: int = 3


@dataclass
class PdfConfig:
    ocr: OcrConfig = field(default_factory=OcrConfig)
    tools: dict[str, str | None] = field(default_factory=dict)


@dataclass
class CorroborateConfig:
    ocr: bool = False
    single_leg: str = "off"


@dataclass
class SectionsConfig:
    weak: list[str] = field(default_factory=list)


@dataclass
class NormalizeConfig:
    dehyphenate: bool = True
    quotes: bool = True


@dataclass
class CacheConfig:
    root: str | None = None


@dataclass
class Terms:
    claim: str = "claim"
    claims: str = "claims"


@dataclass
class Config:
    corpus: CorpusConfig = field(default_factory=CorpusConfig)
    normalize: NormalizeConfig = field(default_factory=NormalizeConfig)
    coverage: CoverageConfig = field(default_factory=CoverageConfig)
    sections: SectionsConfig = field(default_factory=SectionsConfig)
    corroborate: CorroborateConfig = field(default_factory=CorroborateConfig)
    pdf: PdfConfig = field(default_factory=PdfConfig)
    terms: Terms = field(default_factory=Terms)
    cache: CacheConfig = field(default_factory=CacheConfig)

    @property
    def normalization(self) -> Normalization:
        return Normalization(self.normalize.dehyphenate, self.normalize.quotes)


def _severity(value: Any) -> str:
    """``off`` reaches YAML readers as false."""
    value = "off" if value is False else value
    if value not in ("error", "warn", "off"):
        raise ConfigError(f"severity must be error, warn or off, not {value!r}")
    return value


_SPECIAL: dict[tuple[type, str], Callable[[Any], Any]] = {
    (CoverageConfig, "tokens"): _severity, (CoverageConfig, "words"): _severity, (CorroborateConfig, "single_leg"): _severity,
    (CorpusConfig, "sources"): lambda v: {k: _decode(SourceTemplates, x, f"corpus.sources.{k}") for k, x in v.items()},
}


def _decode(kind: type, value: Any, at: str) -> Any:
    if value is None:
        return kind()
    if not isinstance(value, dict):
        raise ConfigError(f"{at or 'configuration'} must be a mapping")
    known = {f.name: f for f in fields(kind)}
    if unknown := sorted(set(value) - set(known)):
        raise ConfigError(f"unknown key {'.'.join(filter(None, [at, unknown[0]]))}")
    made = kind()
    for name, x in value.items():
        now = getattr(made, name)
        if (kind, name) in _SPECIAL:
            x = _SPECIAL[kind, name](x)
        elif is_dataclass(now):
            x = _decode(type(now), x, f"{at}.{name}".strip("."))
        elif now is not None and not isinstance(x, type(now)) and not (kind is SourceTemplates and x is None):
            raise ConfigError(f"{at}.{name} must be {type(now).__name__}")
        elif isinstance(now, int) and not isinstance(now, bool) and isinstance(x, bool):
            raise ConfigError(f"{at}.{name} must be int")
        setattr(made, name, x)
    return made


def _desugar(tree: dict) -> dict:
    """Bare corpus.markdown and corpus.pdf stand for the source ``default``; the half not given has its default."""
    corpus = tree.get("corpus")
    if isinstance(corpus, dict) and ("markdown" in corpus or "pdf" in corpus):
        if "sources" in corpus:
            raise ConfigError("corpus.sources and corpus.markdown/pdf exclude each other")
        short = {k: corpus[k] for k in ("markdown", "pdf") if k in corpus}
        tree = tree | {"corpus": {k: v for k, v in corpus.items() if k not in short} | {"sources": {"default": short}}}
    return tree


def _check_template(template: str, at: str) -> None:
    if "{id}" not in template:
        raise ConfigError(f"{at} must contain {{id}}")
    if os.path.isabs(template) or ".." in Path(template).parts:
        raise ConfigError(f"{at} must be relative and stay within the corpus")


def validate(config: Config) -> Config:
    _check_template(config.corpus.summaries, "corpus.summaries")
    if not config.corpus.sources:
        raise ConfigError("corpus.sources needs a source")
    for name, s in config.corpus.sources.items():
        if not re.fullmatch("[a-z0-9_-]+", name):
            raise ConfigError(f"source name {name!r} is not valid")
        for t in s.markdown or []:
            _check_template(t, f"corpus.sources.{name}.markdown")
        _check_template(s.pdf, f"corpus.sources.{name}.pdf")
    ocr = config.pdf.ocr
    if not 1 <= ocr.dpi <= 1200:
        raise ConfigError("pdf.ocr.dpi must be 1 to 1200")
    if not ocr.lang.strip():
        raise ConfigError("pdf.ocr.lang must not be empty")
    if not 0 <= ocr.page_segmentation_mode <= 13:
        raise ConfigError("pdf.ocr.page_segmentation_mode must be 0 to 13")
    if (root := config.cache.root) is not None and (os.path.isabs(root) or ".." in Path(root).parts):
        raise ConfigError("cache.root must be relative and stay within the corpus")
    t = config.terms
    if not t.claim or not t.claims or t.claim == t.claims or any(not re.fullmatch("[a-z][a-z0-9_]*", x) for x in (t.claim, t.claims)):
        raise ConfigError("terms must be two different lower-case names")
    return config


def decode(tree: Any) -> Config:
    if tree is None:
        tree = {}
    if not isinstance(tree, dict):
        raise ConfigError("configuration must be a mapping")
    return validate(_decode(Config, _desugar(tree), ""))


def read_tree(path: Path) -> Any:
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".toml":
        return tomllib.loads(text)
    return json.loads(text) if path.suffix == ".json" else yaml.safe_load(text)


def discover(start: Path, name: str = PROJECT_NAME) -> Path | None:
    """The nearest project file of ``start`` or its ancestors, not beyond a folder with .git."""
    for folder in [start, *start.parents]:
        for stem in (f".config/{name}", f".{name}", name):
            for suffix in _SUFFIXES:
                if (found := folder / (stem + suffix)).is_file():
                    return found
        if (folder / ".git").exists():
            return None
    return None


def resolve_root(config_path: Path | None, start: Path) -> Path:
    """The folder of the project file (its parent, if that is .config), else the nearest one with .git, else ``start``."""
    if config_path is not None:
        folder = config_path.resolve().parent
        return folder.parent if folder.name == ".config" else folder
    start = start.resolve()
    return next((f for f in [start, *start.parents] if (f / ".git").exists()), start)


def load(start: str | os.PathLike, explicit: str | os.PathLike | None = None, name: str = PROJECT_NAME) -> tuple[Config, Path]:
    """(configuration, corpus root); ``name`` is that of the project files to look for."""
    path = Path(explicit) if explicit else discover(Path(start).resolve(), name)
    return (decode(read_tree(path)) if path else Config()), resolve_root(path, Path(start))
