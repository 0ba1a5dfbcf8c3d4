"""Sentences of texts in many languages and scripts.

What marks a sentence's end is learned from the corpus itself, per language, without labels:
abbreviations by a log-likelihood ratio of a word with and without its period and by what follows it,
sentence starters from the words that open a text, abbreviations that may end a sentence from the
starters behind them, and collocations across a period (a whole number and the word behind it)
by a log-likelihood ratio against what stands behind other periods.  Every mark is then classified with these statistics, with decimals, brackets and
quotations taken into account.  Where a script marks no ends (Thai), the blanks are the candidates: a
mixture over what stands before and behind a blank, anchored at the known starts and ends of texts, is
fitted by expectation-maximisation on the corpus' table of such pairs.

Statistics are pre-aggregated per batch, summed over all texts and reduced to types with at least a
``SHARE`` of their language's occurrences before they reach the driver, so there are at most 1/SHARE of
each kind and language at any size of the corpus.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.llm.canonical import canonical_text

SHARE = 1e-5
SHORT = 4  # letters up to which the ratio alone makes an abbreviation; longer types need evidence behind their period
_SIGNIFICANT = 7.88  # log-likelihood ratio beyond which chance is ruled out at 0.5 %
_LIFT = 10  # with enough text any difference is significant: how many times as often a collocation's word is there at least

# Function words that tell languages of Latin script apart.
FUNCTION_WORDS = {
    "en": "the of and that with while under over was at yet since throughout", "de": "der die das und bei mit nur nach während obwohl unter des den im auf",
    "nl": "de het een van bij met onder door na hoewel tijdens bereikte en vroeg", "fr": "le la les des du pendant après sous dans malgré que et sur au",
    "es": "el la los las del durante después bajo aunque con que y en por", "pt": "o a os as do da no na durante depois sob embora com que em ao",
    "it": "il lo la gli del della durante dopo sotto benché con che e di al", "sv": "den det och vid under efter trots att på i med av som för",
    "da": "den det og ved under efter selv om på i med af som for mellem", "pl": "w na i przy podczas po pod mimo że z się nie do od",
}
_WORDS = {w: {k for k, v in FUNCTION_WORDS.items() if w in v.split()} for v in FUNCTION_WORDS.values() for w in v.split()}

_SCRIPTS = (
    ("th", re.compile("[฀-๿]")), ("hi", re.compile("[ऀ-ॿ]")), ("ja", re.compile("[぀-ヿ]")), ("zh", re.compile("[㐀-鿿]")),
    ("ar", re.compile("[؀-ۿ]")), ("el", re.compile("[Ͱ-ΨΪ-λν-Ͽ]")), ("cyr", re.compile("[Ѐ-ӿ]")),
)
_UNCASED = {"th", "hi", "ja", "zh", "ar"}
_NO_PERIOD = {"th", "hi", "ja", "zh"}  # a period there closes an abbreviation

_MARK = re.compile(r"[.!?]+|[。！？｡।॥؟]+|…+|[;;]")
_TOKEN = re.compile(r"\S+")
_PAIRS = {"«": "»", "“": "”", "„": "”“\"", "「": "」", "『": "』", "‘": "’", "(": ")", "（": "）", "[": "]"}
_CLOSING = ")]）」』»”’"
_OPENING = "([（「『«“„‘¿¡\"'"
_UNSEEN = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"


def language_hint(text: str) -> tuple[str, str]:
    """(language, script group) that ``text`` is counted under."""
    best, most = "", 0
    for name, pattern in () if text.isascii() else _SCRIPTS:
        n = len(pattern.findall(text))
        if name == "ja" and n:
            n += len(_SCRIPTS[3][1].findall(text))
        if n > most:
            best, most = name, n
    if best and most * 3 > sum(map(str.isalpha, text)):
        if best == "cyr":
            return ("uk" if re.search("[іїєґІЇЄҐ]", text) else "ru"), "cyr"
        return best, best
    votes: Counter = Counter()
    for w in text.lower().split():
        votes.update(_WORDS.get(w, ()))
    return (max(sorted(votes), key=votes.get) if votes else "latin"), "latin"


@functools.lru_cache(maxsize=1 << 14)
def _hidden(c: str) -> bool:
    return unicodedata.category(c) == "Cf"


@functools.lru_cache(maxsize=1 << 17)
def _type(token: str) -> str:
    """A token as it is counted: without brackets and quotes, in one form, in lower case."""
    token = token.strip(_OPENING + _CLOSING + ",;:")
    return (token if token.isascii() else canonical_text(token)).lower()


@functools.lru_cache(maxsize=1 << 16)
def _kind(token: str) -> str:
    """How a following token begins: lower, upper, digit, mixed (small first letter, capitals after) or other."""
    bare = token.lstrip(_OPENING)
    if bare != token and token[0] in "\"«“„「『¿¡":
        return "quote"
    for c in bare:
        if _hidden(c):
            continue
        if c.isdigit():
            return "digit"
        if c.isupper():
            return "upper"
        if c.islower():
            return "mixed" if any(x.isupper() for x in bare) else "lower"
        return "other"
    return "other"


@dataclass
class Statistics:
    """What was learned: per language (and script group) the abbreviations, which of them may end a sentence, the starters, and the words that belong to a number before a period."""

    abbreviations: dict[str, dict[str, bool]] = field(default_factory=dict)
    starters: dict[str, set[str]] = field(default_factory=dict)
    collocations: dict[str, set[str]] = field(default_factory=dict)
    gaps: dict[tuple[str, str, str], bool] = field(default_factory=dict)
    before: dict[str, set[str]] = field(default_factory=dict)
    behind: dict[str, set[str]] = field(default_factory=dict)

    def abbreviation(self, word: str, groups: tuple[str, str]) -> bool | None:
        """None: no abbreviation; else whether it may end a sentence."""
        for g in groups:
            if word in self.abbreviations.get(g, ()):
                return self.abbreviations[g][word]
        return None

    def starter(self, word: str, groups: tuple[str, str]) -> bool:
        return any(word in self.starters.get(g, ()) for g in groups)

    def collocation(self, word: str, behind: str, groups: tuple[str, str]) -> bool:
        return bool(re.fullmatch("[0-9]+", word)) and any(behind in self.collocations.get(g, ()) for g in groups)


# --- scripts without marks: what stands before and behind a blank -------------------------------


def _shape(chunk: str) -> str:
    if any(c.isdigit() for c in chunk):
        return "N"
    if chunk[:1] in "(（" or chunk[-1:] in ")）":
        return "P"
    return "U" if chunk[:1].isascii() or not re.search("[฀-๿]", chunk) else "T"


def _gaps(text: str) -> Iterator[tuple[int, str, str, str]]:
    """(place of the chunk behind, last word before, shapes since it, chunk behind) at every blank, the start and the end."""
    last, since, depth = "^", "", 0
    place = 0
    for m in _TOKEN.finditer(text):
        chunk = m.group()
        if depth <= 0:
            yield m.start(), last, since, chunk
        depth = max(0, depth + sum(c in "(（" for c in chunk) - sum(c in ")）" for c in chunk))
        shape = _shape(chunk)
        if shape == "T":
            last, since = chunk[-10:], ""
        else:
            since = (since + shape)[-3:]
        place = m.end()
    yield place, last, since, "$"


# --- counting ------------------------------------------------------------------------------------

_COUNTS = pa.schema([("lang", pa.string()), ("kind", pa.string()), ("a", pa.string()), ("b", pa.string()), ("n", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for text, whole in zip(batch.column("text").to_pylist(), batch.column("whole").to_pylist()):
            if not text or not text.strip():
                continue
            groups = language_hint(text)
            if groups[0] == "th":
                for place, last, since, chunk in _gaps(text):
                    if last == "^" or chunk == "$":
                        if whole:
                            counts["th", "edge", f"{last}|{since}", chunk[:12]] += 1
                    else:
                        counts["th", "gap", f"{last}|{since}", chunk[:12]] += 1
                continue
            tokens = _TOKEN.findall(text)
            for i, token in enumerate(tokens):
                word = _type(token)
                if not word:
                    continue
                for g in set(groups):
                    if word.endswith(".") and not word.endswith("..") and token.rstrip(_UNSEEN)[-1:] in ".":
                        follow = _kind(tokens[i + 1]) if i + 1 < len(tokens) else "end"
                        counts[g, "period", word[:-1], follow] += 1
                        if follow == "upper":
                            counts[g, "pair", word[:-1], _type(tokens[i + 1]).rstrip(".")] += 1
                    else:
                        counts[g, "plain", word, ""] += 1
                    if i == 0 and whole:
                        counts[g, "start", word, ""] += 1
        if counts:
            rows = list(counts.items())
            yield pa.record_batch([pa.array([k[j] for k, _ in rows], pa.string()) for j in range(4)] + [pa.array([n for _, n in rows], pa.int64())], schema=_COUNTS)


def _log_likelihood(n: int, k: int, p0: float, p1: float) -> float:
    """Log of the ratio that k of n periods come from rate p1 and not from p0, doubled; negative if p0 fits better."""
    like = lambda p: k * math.log(p) + (n - k) * math.log(1 - p)
    return 2 * (like(p1) - like(p0))


def learn(texts: DataFrame) -> Statistics:
    """Statistics of ``texts``: columns text, whole (it starts and ends with a sentence).  All texts are counted."""
    counts = texts.select("text", "whole").mapInArrow(_count, "lang string, kind string, a string, b string, n long").groupBy("lang", "kind", "a", "b").agg(F.sum("n").alias("n"))
    counts = counts.persist()
    try:
        return _learned(counts)
    finally:
        counts.unpersist()


def _learned(counts: DataFrame) -> Statistics:
    out = Statistics()
    totals = {(r["lang"], r["kind"]): r["n"] for r in counts.groupBy("lang", "kind").agg(F.sum("n").alias("n")).collect()}  # one row per language and kind
    words = (
        counts.where("kind in ('period', 'plain', 'start')").groupBy("lang", "a")
        .agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k) for k in ("period", "plain", "start")],
             *[F.sum(F.when((F.col("kind") == "period") & (F.col("b") == b), F.col("n")).otherwise(0)).alias(b) for b in ("lower", "digit", "upper", "end", "quote")])
    )
    share = F.create_map(*[x for (g, k), n in totals.items() if k == "period" for x in (F.lit(g), F.lit(n * SHARE))] or [F.lit(""), F.lit(0.0)])
    starts = F.create_map(*[x for (g, k), n in totals.items() if k == "start" for x in (F.lit(g), F.lit(n * SHARE))] or [F.lit(""), F.lit(0.0)])
    kept = words.where((F.col("period") > F.coalesce(F.element_at(share, "lang"), F.lit(0.0))) | (F.col("start") > F.coalesce(F.element_at(starts, "lang"), F.lit(0.0)))).where("period > 1 or start > 1")
    rows = kept.collect()  # at most 2 / SHARE rows per language
    for r in rows:
        g, w = r["lang"], r["a"]
        periods = totals.get((g, "period"), 0)
        n_all = periods + totals.get((g, "plain"), 0)
        if r["start"] > 1:
            expected = (r["period"] + r["plain"]) / max(1, n_all)
            n_start = totals[g, "start"]
            if r["start"] / n_start > 2 * expected and _log_likelihood(n_start, min(r["start"], n_start - 1) or 1, min(max(expected, 1e-9), 0.99), min(r["start"] / n_start, 0.99)) > _SIGNIFICANT:
                out.starters.setdefault(g, set()).add(w.rstrip("."))
        k, n = r["period"], r["period"] + r["plain"]
        if k > 1 and not w[-1:].isdigit() and not re.search(r"\d", w):
            p0 = min(max(periods / max(1, n_all), 1e-6), 0.5)
            letters = len(w.replace(".", ""))
            score = _log_likelihood(n, k, p0, 0.99) * math.exp(-letters) * (1 + w.count(".")) / (max(letters, 1) ** min(r["plain"], 50))
            inside = r["lower"] + r["digit"]
            followed = inside + r["upper"] + r["quote"]
            if (score > 0.3 and letters <= SHORT) or (inside >= 2 and inside > 0.4 * followed):
                out.abbreviations.setdefault(g, {})[w] = False
    known = [(g, w) for g, ws in out.abbreviations.items() for w in ws]
    opening = [(g, w) for g, ws in out.starters.items() for w in ws]
    if known:
        spark = counts.sparkSession
        a = spark.createDataFrame(known, "lang string, a string")
        b = spark.createDataFrame(opening or [("", "")], "lang string, b string").withColumn("opens", F.lit(1))
        pairs = counts.where("kind = 'pair'").join(a, ["lang", "a"]).join(b, ["lang", "b"], "left")
        for r in pairs.groupBy("lang", "a").agg(F.sum(F.coalesce("opens", F.lit(0)) * F.col("n")).alias("open"), F.sum("n").alias("n")).collect():
            out.abbreviations[r["lang"]][r["a"]] = r["open"] >= 0.5 * r["n"]
    _learn_collocations(out, counts, words, totals, share)
    _fit_gaps(out, counts)
    return out


def _learn_collocations(out: Statistics, counts: DataFrame, words: DataFrame, totals: dict[tuple[str, str], int], share: Column) -> None:
    """Words that belong to the whole number before a period; all whole numbers are one type.

    Such a word follows numbers far more often than it follows other periods and than it occurs at all.  Copies of
    one text are no evidence: a word must be seen behind two different numbers.
    """
    pairs = counts.where("kind = 'pair' and b <> ''").withColumn("number", F.col("a").rlike("^[0-9]+$"))
    sides = {(r["lang"], r["number"]): r["n"] for r in pairs.groupBy("lang", "number").agg(F.sum("n").alias("n")).collect()}  # two rows per language
    behind = pairs.where("not number").groupBy("lang", "b").agg(F.sum("n").alias("elsewhere"))
    seen = words.select("lang", F.col("a").alias("b"), (F.col("period") + F.col("plain")).alias("seen"))
    rows = (
        pairs.where("number").groupBy("lang", "b").agg(F.sum("n").alias("n"), F.count("*").alias("numbers"))
        .where("numbers > 1").where(F.col("n") > F.coalesce(F.element_at(share, "lang"), F.lit(0.0)))
        .join(behind, ["lang", "b"], "left").join(seen, ["lang", "b"], "left").collect()
    )  # at most 1 / SHARE rows per language
    for r in rows:
        g, k, n = r["lang"], r["n"], sides[r["lang"], True]
        n_all = totals.get((g, "period"), 0) + totals.get((g, "plain"), 0)
        p0 = max((r["elsewhere"] or 0) / max(1, sides.get((g, False), 0)), max(0, (r["seen"] or 0) - k) / max(1, n_all - n), 1e-6)
        if k / n > _LIFT * p0 and _log_likelihood(n, k, min(p0, 0.98), min(k / n, 0.99)) > _SIGNIFICANT:
            out.collocations.setdefault(g, set()).add(r["b"])


def _fit_gaps(out: Statistics, counts: DataFrame) -> None:
    """Which blanks of unmarked scripts are boundaries, by EM over the table of what stands before and behind."""
    table = counts.where("kind in ('edge', 'gap')")
    total = table.agg(F.sum("n")).first()[0] or 0
    if not total:
        return
    side = lambda c: table.groupBy("lang", F.col(c).alias("x")).agg(F.sum("n").alias("n")).where(F.col("n") > max(1.0, total * SHARE)).select("lang", "x")
    left, right = side("a").withColumn("l", F.lit(1)), side("b").withColumn("r", F.lit(1))
    rows = (
        table.join(left.withColumnRenamed("x", "a"), ["lang", "a"], "left").join(right.withColumnRenamed("x", "b"), ["lang", "b"], "left")
        .withColumn("a", F.when(F.col("l").isNull(), F.concat(F.lit("?|"), F.element_at(F.split("a", r"\|"), -1))).otherwise(F.col("a")))
        .withColumn("b", F.when(F.col("r").isNull(), F.lit("?")).otherwise(F.col("b")))
        .groupBy("lang", "kind", "a", "b").agg(F.sum("n").alias("n")).collect()
    )  # at most 1 / SHARE types on either side
    ends, starts, gaps = Counter(), Counter(), Counter()
    for r in rows:
        if r["kind"] == "edge" and r["a"].startswith("^"):
            starts[r["b"]] += r["n"]
        elif r["kind"] == "edge":
            ends[r["a"]] += r["n"]
        elif r["kind"] == "gap":
            gaps[r["a"], r["b"]] += r["n"]
    seen = Counter()
    for (a, _), n in gaps.items():
        seen[a] += n
    post = {k: 0.2 for k in gaps}
    for _ in range(30):
        e, s, c, c_all = Counter(ends), Counter(starts), Counter(), Counter()
        for (a, b), n in gaps.items():
            p = post[a, b]
            e[a] += n * p
            s[b] += n * p
            c[a, b] += n * (1 - p)
            c_all[a] += n * (1 - p)
        s_all, kinds = sum(s.values()), len({b for _, b in gaps}) + 1
        back = Counter()
        for (a, b), n in c.items():
            back[b] += n
        back_all = sum(back.values())
        for a, b in gaps:
            stop = (e[a] + 0.05) / (e[a] + c_all[a] + 1.0)
            opens = (s[b] + 0.01) / (s_all + 0.01 * kinds)
            goes = (c[a, b] + 2.0 * (back[b] + 0.01) / (back_all + 0.01 * kinds)) / (c_all[a] + 2.0)
            x, y = stop * opens, (1 - stop) * goes
            post[a, b] = x / (x + y)
    for (a, b), p in post.items():
        out.gaps["th", a, b] = p > 0.5
    out.before["th"], out.behind["th"] = {a for a, _ in gaps}, {b for _, b in gaps}


# --- splitting -----------------------------------------------------------------------------------


def _enclosed(text: str) -> list[tuple[int, int]]:
    """Quotations and brackets: (place of the opening, place of the closing sign), not nested."""
    out: list[tuple[int, int]] = []
    i, n = 0, len(text)
    gone: set[str] = set()  # closing signs that do not come any more
    for m in re.finditer(r"[«“„「『(（\[\"]", text):
        at, sign = m.start(), m.group()
        if at < i:
            continue
        if sign == '"':
            before = text[at - 1] if at else " "
            if not (before.isspace() or before in "([（-–—.!?…;:" or _hidden(before)) or at + 1 >= n or text[at + 1].isspace():
                continue
            closers = '"'
        else:
            closers = _PAIRS[sign]
        found = []
        for c in closers:
            place = -1 if c in gone else text.find(c, at + 1)
            if place < 0:
                gone.add(c)
            else:
                found.append(place)
        if not found:
            continue
        end = min(found)
        out.append((at, end))
        i = end + 1
    return out


def boundaries(text: str, stats: Statistics) -> list[int]:
    """Places of the first non-blank character of every sentence of ``text`` but the first."""
    groups = language_hint(text)
    if groups[0] == "th":
        return _blank_boundaries(text, stats, "th")
    n = len(text)
    inside = _enclosed(text)
    out: list[int] = []
    q = 0
    for m in _MARK.finditer(text):
        start, mark = m.start(), m.group()
        while q < len(inside) and inside[q][1] < start:
            q += 1
        end = m.end()
        quoted = q < len(inside) and inside[q][0] < start < inside[q][1]
        j = end
        while j < n and (text[j] in _CLOSING or _hidden(text[j]) or (quoted and j == inside[q][1])):
            j += 1
        if quoted and j <= inside[q][1]:
            continue  # a quotation or bracket inside a sentence does not end it
        k = j
        while k < n and text[k].isspace():
            k += 1
        if k >= n:
            continue
        gap = k > j
        follow = _TOKEN.match(text, k).group()
        first = next((c for c in follow if not _hidden(c)), "")
        kind = _kind(follow)
        word = _type(re.split(r"[.!?;؟。]", follow)[0])
        opens = stats.starter(word, groups)
        if quoted:
            if groups[0] in _UNCASED or not (kind == "quote" or (kind in ("upper", "mixed") and opens)):
                continue
        elif mark[0] in "。！？｡।॥؟":
            if first in "，、,」』”»）)":
                continue
        elif mark[0] in ";;":
            if groups[0] != "el" or kind in ("lower", "digit", "other"):
                continue
        elif mark[0] in "!?":
            if kind == "lower" or (not gap and kind not in ("upper", "quote", "other") and not (kind == "mixed" and opens)):
                continue
        elif len(mark) > 1 or mark == "…":
            if not (kind in ("upper", "mixed", "quote") and (opens or kind == "quote")):
                continue
        else:
            if groups[0] in _NO_PERIOD:
                continue
            b = start
            while b > 0 and not text[b - 1].isspace():
                b -= 1
            token = text[b:start]
            previous = _type(token) if token[-1:] not in _CLOSING else ""
            ends = stats.abbreviation(previous, groups) if previous else None
            if not gap:
                if kind == "digit" or (kind in ("lower", "other") and groups[0] not in _UNCASED) or (kind == "mixed" and not opens):
                    continue
                if kind == "upper" and (re.search(r"(?:^|\.)[^\W\d_]$", previous) or first == follow):
                    continue
                if kind == "other" and not first.isalpha():
                    continue
                if ends is False and not opens:
                    continue
                if ends is not None and kind == "other":
                    continue
            elif kind == "lower" or (kind == "mixed" and not opens):
                continue
            elif ends is not None:
                if kind in ("digit", "other") or not (ends or (opens and kind != "quote")):
                    continue
            elif kind == "upper" and not opens and stats.collocation(previous, word, groups):
                continue
            elif kind == "other" and not first.isalpha() and first not in "\"«“„「¿¡([（+-−":
                continue
        if not out or k > out[-1]:
            out.append(k)
    return out


def _blank_boundaries(text: str, stats: Statistics, lang: str) -> list[int]:
    out = []
    before, behind = stats.before.get(lang, set()), stats.behind.get(lang, set())
    for place, last, since, chunk in _gaps(text):
        if last == "^" or chunk == "$":
            continue
        a, b = f"{last}|{since}", chunk[:12]
        a = a if a in before else f"?|{since}"
        b = b if b in behind else "?"
        if stats.gaps.get((lang, a, b), False):
            out.append(place)
    return out


def split_text(text: str | None, stats: Statistics) -> list[tuple[int, int]]:
    """(start, end) of every sentence, from its first non-blank character to behind its last one."""
    if text is None or not text.strip():
        return []
    first = len(text) - len(text.lstrip())
    starts = [first, *[b for b in boundaries(text, stats) if b > first]]
    ends = [*starts[1:], len(text)]
    return [(s, s + len(text[s:e].rstrip())) for s, e in zip(starts, ends)]


def sentences(texts: DataFrame, stats: Statistics | None = None) -> DataFrame:
    """(record, sentence, start_char, end_char, text): the sentences of every text.

    ``texts`` has record (long), text and whole (see learn); other columns are ignored.  Null, empty
    and blank texts have none.  Repeated rows give repeated sentences.
    """
    shared = texts.sparkSession.sparkContext.broadcast(stats or learn(texts))  # bounded, see SHARE
    schema = pa.schema([("record", pa.int64()), ("sentence", pa.int32()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            rows: dict[str, list] = defaultdict(list)
            for record, text in zip(batch.column("record").to_pylist(), batch.column("text").to_pylist()):
                for i, (a, b) in enumerate(split_text(text, known)):
                    for name, value in zip(schema.names, (record, i, a, b, text[a:b])):
                        rows[name].append(value)
            if rows:
                yield pa.record_batch([pa.array(rows[f.name], f.type) for f in schema], schema=schema)

    return texts.select("record", "text").mapInArrow(run, "record long, sentence int, start_char int, end_char int, text string")


def running_text(units: DataFrame, candidates: DataFrame) -> DataFrame:
    """Running text of papers (paragraphs, list items, quotations) and candidate literals as records."""
    running = units.where(F.col("kind").isin("paragraph", "list_item", "blockquote"))
    return running.select(F.col("unit_id").alias("record"), "text", F.lit(True).alias("whole")).unionAll(
        candidates.select(F.col("candidate_id").alias("record"), F.col("exact").alias("text"), F.lit(False).alias("whole"))
    )
