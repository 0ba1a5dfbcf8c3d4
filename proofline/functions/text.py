"""Text as Spark column expressions: normalisation, occurrence counts, sentences, hashes, names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Typographic quotes and the plain ones they fold to.
CURVED_QUOTES = "‘’‚‛“”„‟"
PLAIN_QUOTES = "''''\"\"\"\""

_DIVIDED = r"(?U)[-\x{AD}\x{2010}]\s*[\n\r\x{2028}\x{2029}]\s*(?=\p{IsLowercase})"


@dataclass(frozen=True)
class Normalization:
    """Which foldings apply besides the collapse of blanks; fixed when an expression is built."""

    dehyphenate: bool = True
    quotes: bool = True


WHITESPACE_ONLY = Normalization(False, False)


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold_quotes(x: Column | str) -> Column:
    return F.translate(col(x), CURVED_QUOTES, PLAIN_QUOTES)


def collapse_blanks(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(x), r"(?U)\s+", " "))


def normalize(x: Column | str, options: Normalization = Normalization()) -> Column:
    """Plain quotes, words divided at a line break joined, blanks collapsed and trimmed; null stays null.

    A hyphen, soft or typographic hyphen goes with the break behind it only if a small letter follows.
    """
    out = col(x)
    if options.quotes:
        out = fold_quotes(out)
    if options.dehyphenate:
        out = F.regexp_replace(out, _DIVIDED, "")
    return collapse_blanks(out)


def exact_count(haystack: Column | str, needle: Column | str) -> Column:
    """Non-overlapping occurrences; 0 for an empty needle, null if either is null."""
    h, n = col(haystack), col(needle)
    removed = F.length(h) - F.length(F.replace(h, n, F.lit("")))
    return F.when(F.length(n) == 0, F.lit(0)).otherwise(F.floor(removed / F.greatest(F.length(n), F.lit(1))).cast("int"))


def occurrence_class(count: Column) -> Column:
    """missing, unique or ambiguous."""
    return F.when(count == 0, "missing").when(count == 1, "unique").when(count > 1, "ambiguous")


def split_sentences(x: Column | str, options: Normalization = Normalization()) -> Column:
    """Normalised sentences: cut behind . ! ? where an ASCII blank follows; empty ones are dropped."""
    parts = F.split(col(x), r"(?<=[.!?])[ \t\n\f\r]+")
    return F.filter(F.transform(parts, lambda s: normalize(s, options)), lambda s: s != "")


def candidate_spans(x: Column | str, options: Normalization = Normalization()) -> Column:
    """The sentences of a unit, and the whole unit if it has several."""
    sentences = split_sentences(x, options)
    return F.when(F.size(sentences) > 1, F.concat(sentences, F.array(normalize(x, options)))).otherwise(sentences)


def sha256(x: Column | str) -> Column:
    """Lower-case hexadecimal digest of the stored bytes."""
    return F.sha2(col(x), 256)


def is_sha256(x: Column | str) -> Column:
    return col(x).rlike("^[0-9a-f]{64}\\z")


def is_source_name(x: Column | str) -> Column:
    return col(x).rlike(r"^[a-z0-9_-]+\z")


def is_valid_id(x: Column | str) -> Column:
    """Three or more small letters, digits and hyphens, no hyphen at either end."""
    return col(x).rlike(r"^[a-z0-9][a-z0-9-]+[a-z0-9]\z")


def paths_match(recorded: Column | str, computed: Column | str) -> Column:
    """Equal lists of headings in order; a null list is an empty one."""
    empty = F.array().cast("array<string>")
    return F.coalesce(col(recorded), empty) == F.coalesce(col(computed), empty)


def is_weak_section(section: Column | str, weak: list[str]) -> Column:
    """Some heading contains, in any case, one of ``weak``; false for an empty list or no section."""
    if not weak:
        return F.lit(False)
    hit = F.exists(col(section), lambda h: F.exists(F.array(*[F.lit(w.lower()) for w in weak]), lambda w: F.contains(F.lower(h), w)))
    return F.coalesce(hit, F.lit(False))


def render_template(template: str, id_column: Column | str) -> Column:
    """A path template with its id filled in."""
    return F.replace(F.lit(template), F.lit("{id}"), col(id_column))


def relative_path(path: Column | str, root: str) -> Column:
    """A path without its root and with forward slashes."""
    plain = F.replace(col(path), F.lit("\\"), F.lit("/"))
    prefix = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(plain.startswith(prefix), F.substring(plain, len(prefix) + 1, 1 << 30)).otherwise(plain)


def canonical_locators(locators: Column | str, options: Normalization = Normalization()) -> Column:
    """Compact JSON of an evidence entry's locators, keys in order at every level, absent parts left out, literals normalised.

    ``locators`` is array<struct<source, exact, markdown: struct<line, col, unit, section>, pdf: struct<page, backend>>>.
    """

    def one(x: Column) -> Column:
        md, pdf = x["markdown"], x["pdf"]
        section = F.when(F.size(md["section"]) > 0, md["section"])
        markdown = F.when(md.isNotNull(), F.struct(md["col"].alias("column"), md["line"].alias("line"), section.alias("section"), md["unit"].alias("unit")))
        page = F.when(pdf.isNotNull(), F.struct(pdf["backend"].alias("backend"), pdf["page"].alias("page")))
        return F.struct(normalize(x["exact"], options).alias("exact"), markdown.alias("markdown"), page.alias("pdf"), F.coalesce(x["source"], F.lit("default")).alias("source"))

    return F.to_json(F.transform(col(locators), one))


def evidence_sha256(locators: Column | str, options: Normalization = Normalization()) -> Column:
    return sha256(canonical_locators(locators, options))
