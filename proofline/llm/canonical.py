"""One consistent form for text that looks the same but is spelt with different characters.

Most text is already in that form.  Each text is scanned once for unstable characters (those that fail
the quick check of the form: they fold, compose with what stands before them, do not show, or are an
unusual blank).  Only those segments, with the base character before them as context, are normalised;
the results are spliced into the unchanged rest.

There are two forms.  The readable one keeps words of another alphabet as they are and only mends words
that mix alphabets; the key, made for comparing, folds every look-alike letter.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Letters of other alphabets whose shape is that of a Latin letter.
CYRILLIC = ("асеорхуіјѕһԁԛԝӏАВЕКМНОРСТХІЈЅУԌԜӀ", "aceopxyijshdqwlABEKMHOPCTXIJSYGWI")
GREEK = ("οΑΒΕΖΗΙΚΜΝΟΡΤΥΧνϲϳϹͿ", "oABEZHIKMNOPTYXvcjCJ")
# Forms of one sign.
HYPHENS = "‐‑﹣－"
DOUBLE_QUOTES = "“”„‟"
SINGLE_QUOTES = "‘’‚‛"

_LETTERS = str.maketrans(CYRILLIC[0] + GREEK[0], CYRILLIC[1] + GREEK[1])
#: The look-alikes the other way round, for words of the other alphabet that hold Latin letters.
_BACK = {alphabet: str.maketrans(*reversed(pair)) for alphabet, pair in (("CYRILLIC", CYRILLIC), ("GREEK", GREEK))}
_SIGNS = str.maketrans(HYPHENS + DOUBLE_QUOTES + SINGLE_QUOTES, "-" * len(HYPHENS) + '"' * len(DOUBLE_QUOTES) + "'" * len(SINGLE_QUOTES))
#: Blocks in which every character is stable on its own; left out of the scan below for speed.
_UNIFORM = ((0x3400, 0x9FFF), (0xAC00, 0xD7A3), (0x20000, 0x2F7FF), (0x30000, 0xE0000), (0xE0200, 0x110000))


def _raised(char: str) -> bool:
    """Raised and lowered signs differ to the eye from plain ones and keep their form."""
    return unicodedata.decomposition(char).startswith(("<super>", "<sub>"))


def _shows(char: str) -> bool:
    return unicodedata.category(char) != "Cf" and not (char == "͏" or 0xFE00 <= ord(char) <= 0xFE0F or 0xE0100 <= ord(char) <= 0xE01EF)


@functools.lru_cache(maxsize=1 << 16)
def _normalise(segment: str, letters: bool = True) -> str:
    """The whole form, for a segment that starts at a stable character; ``letters``: look-alike letters become Latin."""
    text = "".join(c if _raised(c) else unicodedata.normalize("NFKD", c) for c in segment if _shows(c))
    text = "".join(c for c in (text.translate(_LETTERS) if letters else text).translate(_SIGNS) if _shows(c))
    text = unicodedata.normalize("NFC", text)
    return "".join(" " if c.isspace() or c == "\u0085" else c for c in text)


@functools.cache
def _unstable() -> re.Pattern:
    """Matches a run of unstable characters with the stable character before it."""
    backward = set()
    bad: list[int] = []
    for code in range(0x30000):
        if any(a <= code <= b for a, b in _UNIFORM) or 0xD800 <= code <= 0xDFFF:
            continue
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            backward.add(int(parts[1], 16))
    backward |= set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))
    for code in [*range(0x30000), *range(0xE0000, 0xE0200)]:
        if 0xD800 <= code <= 0xDFFF or any(a <= code <= b for a, b in _UNIFORM):
            continue
        c = chr(code)
        if code != 0x20 and (c.isspace() or code in backward or unicodedata.combining(c) or _normalise(c) != c):
            bad.append(code)
    ranges, i = [], 0
    while i < len(bad):
        j = i
        while j + 1 < len(bad) and bad[j + 1] == bad[j] + 1:
            j += 1
        ranges.append(f"\\U{bad[i]:08x}-\\U{bad[j]:08x}" if j > i else f"\\U{bad[i]:08x}")
        i = j + 1
    cls = "".join(ranges)
    return re.compile(f"[^{cls}]?[{cls}]+")


_BLANKS = re.compile(" {2,}")


def canonical_text(text: str | None) -> str | None:
    """The one form of ``text``; null stays null, text without anything to see becomes empty."""
    if text is None:
        return None
    if not text.isascii() or not text.isprintable():
        text = _unstable().sub(lambda m: _normalise(m.group()), text)
    return _BLANKS.sub(" ", text).strip(" ")


_OTHER_LETTERS = "\u0370-\u03ff\u0400-\u052f"
_MIXED = re.compile(f"[^\\W\\d_]*(?:[A-Za-z][^\\W\\d_]*[{_OTHER_LETTERS}]|[{_OTHER_LETTERS}][^\\W\\d_]*[A-Za-z])[^\\W\\d_]*")


def _one_alphabet(word: str) -> str:
    """A word of mixed alphabets in one: that of its letters without a Latin look-alike, otherwise Latin."""
    rest = [unicodedata.name(c, "").split(" ")[0] for c in word if not c.isascii() and ord(c) not in _LETTERS]
    for alphabet, back in _BACK.items():
        if alphabet in rest:
            return word.translate(back)
    return word.translate(_LETTERS)


def readable_text(text: str | None) -> str | None:
    """The form of ``text`` for reading: as the key, but words of one alphabet keep their letters."""
    if text is None:
        return None
    if not text.isascii() or not text.isprintable():
        text = _unstable().sub(lambda m: _normalise(m.group(), False), text)
        text = _MIXED.sub(lambda m: _one_alphabet(m.group()), text)
    return _BLANKS.sub(" ", text).strip(" ")


def _batches_of(form: Callable[[str | None], str | None]):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([form(t) for t in texts], dtype=object)

    return run


def canonical(text: Column | str) -> Column:
    """Column of canonical texts, the keys for comparing.

    Alike: all blanks (one space for a run, none at the ends), widths, ligatures, presentation forms,
    composed and decomposed accents, hyphens, straight and curved quotes, letters of Cyrillic and Greek
    shaped as Latin ones.  Characters that do not show are dropped.  Different: case, accents, raised
    and plain digits, digits and letters, dashes and hyphens.  The form is idempotent.  It is taken
    where it stands: the optimizer may not move it below a join or a filter.
    """
    form = pandas_udf(_batches_of(canonical_text), T.StringType()).asNondeterministic()
    return form(F.col(text) if isinstance(text, str) else text)


def readable(text: Column | str) -> Column:
    """Column of texts in the form for reading: as ``canonical``, but look-alike letters change only in words of mixed alphabets."""
    return pandas_udf(_batches_of(readable_text), T.StringType())(F.col(text) if isinstance(text, str) else text)


def canonical_columns(df: DataFrame, key: str, text: str) -> DataFrame:
    """(record, text, key, changed): both forms of every text of a table, repeated rows once.

    ``text`` is the form for reading, ``key`` the one to compare by.  A record with several contents keeps
    each of them; ``changed`` (text is not as stored) is null for a null text.
    """
    one = df.select(F.col(key).alias("record"), F.col(text).alias("stored")).distinct()
    forms = one.withColumns({"text": readable("stored"), "key": canonical("stored")})
    return forms.select("record", "text", "key", (F.col("text") != F.col("stored")).alias("changed"))


def hidden_matches(locators: DataFrame, units: DataFrame, pages: DataFrame) -> DataFrame:
    """Locators whose literal is missing from the cited text as stored but there to the eye.

    Result: locator_id, side ('unit' or 'page').  Side 'unit' looks in the unit at (id, kind, line,
    col), side 'page' in the native page at (id, page).  Where several texts answer to one citation, a
    literal that one of them holds as stored is no case.  Locators without the citation, without the
    cited text, or with a null or empty literal give no row.  Only the cited texts that lack the literal
    as stored are put in canonical form.
    """
    want = locators.where("exact is not null and exact <> ''")
    unit_side = want.where("markdown is not null").select("locator_id", "exact", "id", F.col("markdown.unit").alias("kind"), F.col("markdown.line").cast("int").alias("line"), F.col("markdown.col").cast("int").alias("col"))
    in_units = unit_side.join(units.select("id", "kind", "line", "col", "text"), ["id", "kind", "line", "col"]).select("locator_id", F.lit("unit").alias("side"), "exact", "text")
    page_side = want.where("pdf.backend = 'mutool-native'").select("locator_id", "exact", "id", F.col("pdf.page").cast("int").alias("page"))
    native = pages.where("backend = 'mutool-native'").select("id", "page", "text")
    in_pages = page_side.join(native, ["id", "page"]).select("locator_id", F.lit("page").alias("side"), "exact", "text")
    cited = in_units.unionAll(in_pages).where("text is not null").withColumn("stored", F.contains("text", "exact"))
    lacking = lambda c: F.when(~F.col("stored"), F.col(c))
    forms = cited.select("locator_id", "side", "stored", canonical(lacking("exact")).alias("c_exact"), canonical(lacking("text")).alias("c_text"))
    seen = F.coalesce((F.col("c_exact") != "") & F.contains("c_text", "c_exact"), F.lit(False))
    sides = forms.groupBy("locator_id", "side").agg(F.max("stored").alias("stored"), F.max(seen).alias("seen"))
    return sides.where("seen and not stored").select("locator_id", "side")
