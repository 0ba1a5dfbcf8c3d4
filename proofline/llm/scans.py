"""Repair of text from scanned pages: page furniture, divided words, misread characters.

Lines are rows.  Furniture is told by position and recurrence: page numbers, lines that recur at the
edge of several pages of a document, and line shapes that the corpus has at page edges only.  Words are
judged by a lexicon of the corpus' frequent words, without the forms that are frequent only as misread
from far more frequent words: those that recognised text has and native text lacks.  A symmetric-delete index over the lexicon (every
word under all forms with up to two characters left out) finds candidates for an unknown word; a
weighted edit distance in which pairs of confusable shapes are cheap decides, as are letters that this
corpus' recognition is found to write for any other, and the counts of the word before it choose among
equals.  All counts are over all pages; lexicon, word pairs and shapes are
those above a share of all occurrences, so at most 1/share of each reach the driver and the tasks.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.session import cut_lineage

WORD_SHARE = 1e-5  # of all words: how often an ordinary word occurs at least
LEAST_COUNT = 4
PAIR_SHARE = 1e-5
SHAPE_SHARE = 1e-4  # of all lines
MISREAD_TIMES = 20  # how many times more frequent a word is than the form it is misread to
_BLIND_TIMES = 50  # the same where native text is too little to tell whether the form is written at all

# Shapes that recognition takes for each other, written form and what was meant.
CONFUSIONS = [
    ("rn", "m"), ("m", "rn"), ("ri", "n"), ("ni", "m"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("u", "ii"), ("li", "h"), ("vv", "w"), ("w", "vv"), ("in", "m"), ("n", "ri"), ("h", "li"), ("iii", "m"),
    ("0", "o"), ("o", "0"), ("1", "l"), ("l", "1"), ("1", "i"), ("5", "s"), ("s", "5"), ("9", "g"), ("g", "9"), ("6", "b"), ("8", "b"), ("2", "z"), ("3", "e"), ("4", "a"), ("7", "t"),
    ("o", "a"), ("a", "o"), ("e", "c"), ("c", "e"), ("h", "b"), ("b", "h"), ("f", "t"), ("t", "f"), ("l", "i"), ("i", "l"), ("u", "n"), ("n", "u"), ("v", "y"), ("y", "v"), ("j", "i"), ("i", "j"), ("q", "g"), ("g", "q"), ("r", "n"), ("o", "e"), ("e", "o"), ("s", "a"), ("l", "t"), ("t", "l"), ("f", "l"), ("l", "f"), ("r", "i"), ("ø", "r"), ("r", "ø"),
]
HYPHENS = "-‐‑­¬"
_SURE_HYPHENS = "­¬"
_PAIRED = defaultdict(list)
for _written, _meant in CONFUSIONS:
    _PAIRED[_written].append(_meant)
_ACCENT = 0.45
UNCLEAR_SHARE, UNCLEAR_LEAST = 0.2, 5  # of unexplained substitutions; letters of the words they are seen and mended in
_CHEAP, _DEAR = 0.35, 1.0
MOST_COST = 0.75

_TOKEN = re.compile(r"[^\s]+")
_CORE = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_NUMBER_LETTERS = "lIOoSsBgqZz|D"
_NUMBER = re.compile(rf"^[(\[\"“„«]*([-+−]?[\d{_NUMBER_LETTERS}][\d.,{_NUMBER_LETTERS}]*)%?[)\]\"”“».,;:!?]*$")


# --- furniture -----------------------------------------------------------------------------------

_NUM = r"(?:(?=[^\s]{0,4}[0-9])[0-9OoIlSBg]{1,5}|[ivxlc]{1,8})"
_PAGE = rf"(?:-\s*{_NUM}\s*-|\[\s*{_NUM}\s*\]|(?:p|pp|s)\.\s*{_NUM}|page\s+{_NUM}(?:\s+of\s+{_NUM})?|{_NUM})"


def page_lines(pages: DataFrame) -> DataFrame:
    """(doc, record, line_no, line, top, bottom, words...): the lines of every page; top and bottom count its lines with text from 0."""
    rows = pages.select("doc", "record", "page", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc", "record", "page", (F.col("pos") + 1).alias("line_no"), "line")
    rows = rows.withColumn("bare", F.trim(F.regexp_replace("line", r"(?U)\s+", " "))).where("bare <> ''")
    up, down = Window.partitionBy("record").orderBy("line_no"), Window.partitionBy("record").orderBy(F.desc("line_no"))
    return rows.withColumn("top", F.row_number().over(up) - 1).withColumn("bottom", F.row_number().over(down) - 1)


def _folded(x: Column) -> Column:
    return F.translate(F.lower(x), "0159|", "olsgl")


def furniture(pages: DataFrame) -> DataFrame:
    """(record, line_no) of running headers, footers and page numbers.

    ``pages``: doc, record, page, text.  Only the two outermost lines with text at either end of a page come
    into question, the inner one only beside an outer one that is furniture.
    """
    lines = page_lines(pages)
    only = F.lower("bare").rlike(rf"^{_PAGE}$") | F.translate("bare", "OoIlS", "00115").rlike(r"^(?:- [0-9]{1,5} -|\[[0-9]{1,5}\]|p\. [0-9]{1,5}|[0-9]{1,5})$")
    core = F.regexp_replace("line", rf"(?i)^\s*{_PAGE}(?:\s*\|\s*|\s{{2,}})|(?:\s*\|\s*|\s{{2,}}){_PAGE}\s*$", "")
    numbered = F.trim(core) != F.trim("line")
    core = F.trim(F.regexp_replace(core, r"(?U)\s+", " "))
    lines = lines.withColumn("only", only).withColumn("core", core).withColumn("numbered", numbered)
    edge = (F.col("top") < 2) | (F.col("bottom") < 2)
    key = F.regexp_replace(_folded(F.col("core")), r"[^\p{L}]+", "")
    lines = cut_lineage(lines.withColumn("edge", edge).withColumn("key", key))  # read by all that follows

    # Words that are frequent in the corpus stay in a line's shape; all others are masked.
    words = lines.select("doc", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("core"), F.lit(r"\p{L}{2,}"), F.lit(0)))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    total = lines.count()
    kept = [r["w"] for r in words.where(F.col("n") > max(3.0, total * 4e-4)).select("w").collect()]  # at most words-per-line / 4e-4
    known = set(kept)
    shared = pages.sparkSession.sparkContext.broadcast(known)
    shape_schema = pa.schema([("record", pa.int64()), ("line_no", pa.int32()), ("shape", pa.string())])

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = shared.value
        mask = lambda m: m.group() if m.group().lower() in keep else ("X" if m.group()[0].isupper() else "x")
        for b in batches:
            out = [re.sub(r"\d+", "#", re.sub(r"[^\W\d_]{2,}", mask, c)).lower() if len(c) < 120 else "" for c in b.column("core").to_pylist()]
            yield pa.record_batch([b.column("record"), b.column("line_no"), pa.array(out, pa.string())], schema=shape_schema)

    shaped = lines.select("record", "line_no", "core").mapInArrow(shapes, "record long, line_no int, shape string")
    lines = cut_lineage(lines.join(shaped, ["record", "line_no"]))
    outer = (F.col("top") < 1) | (F.col("bottom") < 2)
    by_shape = lines.where("shape <> ''").groupBy("shape").agg(F.count("*").alias("n"), F.count_if(outer).alias("edges"), F.count_if(F.col("edge") & ~(outer)).alias("second")).where((F.col("n") >= F.greatest(F.lit(3.0), F.lit(total * SHAPE_SHARE))) & ((F.col("edges") + F.col("second")) >= 0.85 * F.col("n"))).select(F.col("shape"), F.lit(True).alias("typical"))
    by_shape = by_shape.where(F.length(F.regexp_replace("shape", r"[^\p{L}]|(?<!\p{L})x(?!\p{L})", "")) >= 2)
    recurring = lines.where(F.col("edge") & (F.length("key") >= 4)).groupBy("doc", "key").agg(F.count_distinct("record").alias("pages")).where("pages > 1").select("doc", "key", F.lit(True).alias("recurs"))
    body = lines.where(~F.col("edge") & (F.length("key") >= 4)).select("doc", "key").distinct().withColumn("inside", F.lit(True))
    judged = lines.where("edge").join(by_shape, "shape", "left").join(recurring, ["doc", "key"], "left").join(body, ["doc", "key"], "left")
    short = F.length("bare") < 110
    hit = F.coalesce(F.col("only"), F.lit(False)) | (short & (F.coalesce("typical", F.lit(False)) | (F.coalesce("recurs", F.lit(False)) & F.col("inside").isNull())) )
    outermost = (F.col("top") == 0) | (F.col("bottom") == 0)
    hit = hit | (short & F.col("numbered") & outermost)
    # Odd and even pages may have different headers: beside a page whose header is known, a short opening
    # line without frequent words, number or stop is one as well, but for a document's first page.
    plain = (F.length("bare") < 60) & F.col("core").rlike(r"^\p{Lu}[^.!?;:,।。]*$") & ~F.col("shape").rlike(r"[\p{L}]{2,}") & ~F.col("core").rlike(r"[0-9] ?(?:\p{L}{1,3}[²³]?|%|°C|g/L)$")
    marks = judged.select("doc", "page", "record", "only", "numbered", F.regexp_replace(F.lower("bare"), "[0-9]+|\\b[ivxlc]+\\b", "#").alias("style"), "line_no", "top", "bottom", hit.alias("hit"), F.coalesce(plain, F.lit(False)).alias("plain"))
    heads = marks.where("hit and top = 0").groupBy("doc").agg(F.count_distinct("record").alias("headed")).select("doc", "headed")
    firsts = pages.groupBy("doc").agg(F.min("page").alias("first_page"))
    marks = marks.join(heads, "doc", "left").join(firsts, "doc").withColumn("hit", F.col("hit") | (F.col("plain") & (F.col("top") == 0) & (F.col("page") > F.col("first_page")) & F.col("headed").isNotNull()))
    # A page has one number.  Of several lines that could be it, the style most pages of the document use
    # counts, then one with more than the bare digits, then the outermost.
    marks = cut_lineage(marks)
    number = F.col("only") | F.col("numbered")
    style = F.when(F.col("only"), F.col("style")).otherwise(F.lit("beside"))
    numbers = marks.where(F.col("hit") & number).withColumn("style", style)
    used = numbers.groupBy("doc", "style").agg(F.count_distinct("record").alias("used"))
    order = Window.partitionBy("record").orderBy(F.desc("used"), (F.col("style") == "#").cast("int"), F.least("top", "bottom"), F.desc("line_no"))
    chosen = numbers.join(used, ["doc", "style"]).withColumn("nth", F.row_number().over(order)).where("nth = 1").select("record", "line_no", F.lit(True).alias("chosen"))
    marks = marks.join(chosen, ["record", "line_no"], "left").where(~(F.col("only") & F.col("chosen").isNull()))
    outer_hits = marks.where("hit and (top = 0 or bottom = 0)").select("record", F.col("top").alias("o_top"), F.col("bottom").alias("o_bottom"))
    ends = outer_hits.groupBy("record").agg(F.max((F.col("o_top") == 0).cast("int")).alias("head"), F.max((F.col("o_bottom") == 0).cast("int")).alias("foot"))
    return marks.where("hit").join(ends, "record").where("(top = 0 or bottom = 0) or (top = 1 and head = 1) or (bottom = 1 and foot = 1)").select("record", "line_no")


# --- words ---------------------------------------------------------------------------------------


def _bare(c: str) -> str:
    return unicodedata.normalize("NFD", c)[0]


def _deletes(word: str, most: int) -> set[str]:
    out = {word}
    layer = {word}
    for _ in range(most):
        layer = {w[:i] + w[i + 1 :] for w in layer for i in range(len(w)) if len(w) > 1}
        out |= layer
    return out


def _reach(word: str) -> int:
    return 2 if len(word) >= 5 else 1


def distance(written: str, meant: str, most: float = MOST_COST, unclear: frozenset[str] = frozenset()) -> float:
    """Weighted edit distance: confusable shapes are cheap, and in words of five letters the ``unclear`` ones; other edits are dear; more than ``most`` counts as infinite."""
    n, m = len(written), len(meant)
    inf = float("inf")
    table = [[inf] * (m + 1) for _ in range(n + 1)]
    table[0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            now = table[i][j]
            if now > most:
                continue
            if i < n and j < m:
                a, b = written[i], meant[j]
                cost = 0.0 if a == b else _CHEAP if a in unclear and n >= UNCLEAR_LEAST else _ACCENT if _bare(a) == _bare(b) else _DEAR
                if now + cost < table[i + 1][j + 1]:
                    table[i + 1][j + 1] = now + cost
            for k in (1, 2, 3):
                for x in _PAIRED.get(written[i : i + k], ()) if i + k <= n else ():
                    if meant.startswith(x, j) and now + _CHEAP < table[i + k][j + len(x)]:
                        table[i + k][j + len(x)] = now + _CHEAP
    return table[n][m] if table[n][m] <= most else inf


_MOST_KEPT = 1 << 18  # words whose candidates a task keeps at hand; the oldest go first


def _delete_index(words: Iterable[str]) -> dict[str, list[str]]:
    index = defaultdict(list)
    for w in words:
        for d in _deletes(w, _reach(w)):
            index[d].append(w)
    return dict(index)


def _near(word: str, index: dict[str, list[str]], unclear: frozenset[str] = frozenset()) -> list[tuple[float, str]]:
    """(distance, word) of the words of a delete index that ``word`` may be misread from."""
    seen = {w for d in _deletes(word, _reach(word)) for w in index.get(d, ()) if abs(len(w) - len(word)) <= 2}
    return [(cost, w) for w in seen if (cost := distance(word, w, unclear=unclear)) <= MOST_COST]


@dataclass
class Lexicon:
    """Frequent words, written compounds and word pairs of the corpus, with the symmetric-delete indexes."""

    words: dict[str, int] = field(default_factory=dict)
    compounds: dict[str, int] = field(default_factory=dict)
    pairs: dict[tuple[str, str], int] = field(default_factory=dict)
    index: dict[str, list[str]] = field(default_factory=dict)
    parts: dict[str, list[str]] = field(default_factory=dict)  # index of the halves of compounds
    unclear: frozenset[str] = frozenset()  # letters that recognition writes for any other
    kept: dict[str, list[tuple[float, str]]] = field(default_factory=dict)

    def built(self) -> Lexicon:
        if not self.index:
            self.index = _delete_index(w for w in self.words if len(w) >= 3)
            self.parts = _delete_index({p for c in self.compounds if c.count("-") == 1 for p in c.split("-")})
        return self

    def correct(self, word: str, before: str = "") -> str | None:
        """The ordinary word that ``word``, which is none, was misread from, or null.

        Candidates do not depend on the place of a word and are found once; the counts of the word before it
        choose among those of equal cost.
        """
        near = self.kept.get(word)
        if near is None:
            near = _near(word, self.index, self.unclear)
            least = min((c for c, _ in near), default=0)
            near = [x for x in near if x[0] == least]
            if len(self.kept) >= _MOST_KEPT:
                self.kept.pop(next(iter(self.kept)))
            self.kept[word] = near
        return min((-self.pairs.get((before, w), 0), -self.words[w], w) for _, w in near)[2] if near else None

    def misread_compound(self, left: str, right: str) -> bool:
        """Whether ``left``-``right`` is a written compound or misread from one; each half costs on its own."""
        right_near = _near(right, self.parts, self.unclear)
        return any(x + y <= MOST_COST and f"{a}-{b}" in self.compounds for x, a in _near(left, self.parts, self.unclear) for y, b in right_near)


_COUNTS = pa.schema([("kind", pa.string()), ("a", pa.string()), ("b", pa.string()), ("n", pa.int64())])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for text, native in zip(batch.column("text").to_pylist(), batch.column("native").to_pylist()):
            for line in (text or "").split("\n"):
                before = ""
                for token in _TOKEN.findall(line):
                    bare = token.strip("()[]\"“”„«»'.,;:!?…।。").lower()
                    if bare.isalpha():
                        counts["word", bare, ""] += 1
                        if native:
                            counts["native", bare, ""] += 1
                        if before:
                            counts["pair", before, bare] += 1
                        before = bare
                    else:
                        before = ""
                        if "-" in bare and all(p.isalpha() for p in bare.split("-")):
                            counts["compound", bare, ""] += 1
                            for p in bare.split("-"):
                                counts["word", p, ""] += 1
                                if native:
                                    counts["native", p, ""] += 1
        rows = list(counts.items())
        yield pa.record_batch([pa.array([k[i] for k, _ in rows], pa.string()) for i in range(3)] + [pa.array([n for _, n in rows], pa.int64())], schema=_COUNTS)


def misread_forms(words: dict[str, int], native: dict[str, int], native_total: int, total: int) -> set[str]:
    """The forms among ``words`` that are misread from far more frequent ones.

    ``native`` has the words' counts in text that was not recognised, the totals are of all words.  A form
    that native text has at a tenth of its rate in recognised text or more is an ordinary word.
    """
    per_scanned = native_total / max(1, total - native_total)
    times: dict[str, int] = {}  # of the forms in question
    for w, n in words.items():
        expected = (n - native.get(w, 0)) * per_scanned
        if len(w) >= 3 and native.get(w, 0) < max(1.0, 0.1 * expected):
            times[w] = MISREAD_TIMES if expected >= 3 else _BLIND_TIMES
    index: dict[str, list[str]] = defaultdict(list)  # over these few only; all words are held against it
    for w in times:
        for d in _deletes(w, _reach(w)):
            index[d].append(w)
    meant: dict[str, list[str]] = defaultdict(list)
    for v, n in words.items():
        if len(v) < 3 or not index:
            continue
        near = {w for d in _deletes(v, _reach(v)) for w in index.get(d, ()) if abs(len(w) - len(v)) <= 2 and n >= times[w] * words[w]}
        for w in near:
            if distance(w, v) <= MOST_COST:
                meant[w].append(v)
    out: set[str] = set()
    for w in sorted(meant, key=lambda w: -words[w]):
        if any(v not in out for v in meant[w]):
            out.add(w)
    return out


def unclear_letters(counts: DataFrame, words: dict[str, int]) -> frozenset[str]:
    """Letters that recognition writes for many others, not for look-alikes only.

    Every form that native text lacks and that is one letter away from exactly one far more frequent word
    tells of a substitution.  Of those that no confusable shape explains, an unclear letter makes up
    ``UNCLEAR_SHARE`` or more, and no single letter is meant by half of them.
    """
    shared = counts.sparkSession.sparkContext.broadcast(words)  # bounded by the share
    explained = {(w, m) for w, m in CONFUSIONS if len(w) == len(m) == 1}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gaps = defaultdict(list)
        for w in shared.value:
            if len(w) >= UNCLEAR_LEAST:
                for i in range(len(w)):
                    gaps[w[:i], w[i + 1 :]].append(w)
        for batch in batches:
            found: Counter = Counter()
            for form, n in zip(batch.column("a").to_pylist(), batch.column("n").to_pylist()):
                if form in shared.value:
                    continue
                near = {(w, i) for i in range(len(form)) for w in gaps.get((form[:i], form[i + 1 :]), ())}
                if len(near) == 1:
                    ((w, i),) = near
                    if shared.value[w] >= MISREAD_TIMES * n and (form[i], w[i]) not in explained and _bare(form[i]) != _bare(w[i]):
                        found[form[i], w[i]] += n
            yield pa.record_batch([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["written", "meant", "n"])

    sides = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k) for k in ("word", "native")]
    forms = counts.where("kind in ('word', 'native')").where(F.length("a") >= UNCLEAR_LEAST).groupBy("a").agg(*sides).where("native = 0").select("a", F.col("word").alias("n"))
    pairs = forms.mapInArrow(run, "written string, meant string, n long").groupBy("written", "meant").agg(F.sum("n").alias("n"))
    letters = pairs.groupBy("written").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    whole = Window.partitionBy()  # one row per letter
    rows = letters.withColumn("total", F.sum("n").over(whole)).where((F.col("n") >= UNCLEAR_SHARE * F.col("total")) & (F.col("n") > 2 * F.col("most")) & (F.col("n") > LEAST_COUNT)).select("written").collect()
    return frozenset(r["written"] for r in rows)


def learn_lexicon(texts: DataFrame) -> Lexicon:
    """Lexicon of the ``text`` column of all pages; ``native``, if there is such a column, tells texts that were not recognised."""
    native = F.coalesce("native", F.lit(False)) if "native" in texts.columns else F.lit(False)
    counts = texts.select("text", native.alias("native")).mapInArrow(_count_words, "kind string, a string, b string, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
    counts = counts.persist()
    try:
        totals = {r["kind"]: r["n"] for r in counts.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
        out = Lexicon()
        need = max(LEAST_COUNT, totals.get("word", 0) * WORD_SHARE)
        sides = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k) for k in ("word", "native")]
        rows = counts.where("kind in ('word', 'native')").groupBy("a").agg(*sides).where(F.col("word") >= need).collect()
        wrong = misread_forms({r["a"]: r["word"] for r in rows}, {r["a"]: r["native"] for r in rows}, totals.get("native", 0), totals.get("word", 0))
        out.words = {r["a"]: r["word"] for r in rows if r["a"] not in wrong}
        out.unclear = unclear_letters(counts, out.words)
        for r in counts.where((F.col("kind") == "compound") & (F.col("n") >= max(2.0, totals.get("word", 0) * WORD_SHARE / 10))).collect():
            out.compounds[r["a"]] = r["n"]
        for r in counts.where((F.col("kind") == "pair") & (F.col("n") >= max(LEAST_COUNT, totals.get("pair", 0) * PAIR_SHARE))).collect():
            out.pairs[r["a"], r["b"]] = r["n"]
        return out
    finally:
        counts.unpersist()


def _misread_number(token: str) -> str | None:
    """The number that ``token`` was misread from, or null if it is a number, or none at all."""
    m = _NUMBER.match(token)
    if not m:
        return None
    body = m.group(1).lstrip("+-−")
    digits = sum(c.isdigit() for c in body)
    letters = [c for c in body if c in _NUMBER_LETTERS]
    if not letters or not digits or len(letters) > digits + 1 or not re.search(r"\d", body):
        return None
    return body.translate(str.maketrans("lIOoSsBgqZz|D", "1100558992210"))


def _halves(line: str, following: str) -> tuple[str, str, str] | None:
    """(part before the mark, the mark, part behind the break) if the line ends with a dividing mark before a letter."""
    stripped = line.rstrip()
    if len(stripped) < 2 or stripped[-1] not in HYPHENS or not (stripped[-2].isalnum() or _is_mark(stripped[-2])):
        return None
    left = re.search(r"[^\W_](?:[^\W_]|[̀-ͯऀ-ःऺ-ॏั-๎])*$", stripped[:-1])
    right = re.match(r"[^\W_](?:[^\W_]|[̀-ͯऀ-ःऺ-ॏั-๎])*", following.lstrip())
    if not left or not right:
        return None
    return left.group(), stripped[-1], right.group()


def _is_mark(c: str) -> bool:
    return "̀" <= c <= "ͯ" or "ऀ" <= c <= "ॏ" or "ั" <= c <= "๎"


def divides(line: str, following: str, lexicon: Lexicon) -> bool:
    """The mark at the end of ``line`` divides one word; words that are written with a hyphen anyway do not count."""
    halves = _halves(line, following)
    if halves is None:
        return False
    left, mark, right = halves
    if right[0].isdigit() or left[-1].isdigit() and not left[:1].isalpha():
        return False
    if mark in _SURE_HYPHENS:
        return True
    if right[0].isupper() and not left.isupper():
        return False
    if left.isupper() and len(left) > 1 and right.isupper():
        return False
    joined, hyphened = (left + right).lower(), f"{left}-{right}".lower()
    tail = re.search(r"[^\s]*$", line.rstrip()[:-1]).group().strip("()[]\"“”„«»'.,;:!?").lower()
    follow = re.match(r"[^\s]*", following.lstrip()).group().strip("()[]\"“”„«»'.,;:!?").lower()
    written = lexicon.compounds.get(hyphened, 0) + lexicon.compounds.get(f"{tail}-{follow}", 0)
    whole = lexicon.words.get(joined, 0)
    if written > whole:
        return False
    if whole:
        return True
    # A misread half of a written compound is a compound still.
    if left.lower() in lexicon.words and right.lower() in lexicon.words and len(right) > 3 and len(left) > 2:
        return not lexicon.misread_compound(left.lower(), right.lower())
    return True


def judge_page(text: str, skip: set[int], lexicon: Lexicon) -> tuple[list[tuple[int, str]], list[str]]:
    """([(line, 'hyphen' or 'misread')], repaired paragraphs) of one page; ``skip`` has its furniture."""
    lines = text.split("\n")
    body = [(i, l) for i, l in enumerate(lines, 1) if i not in skip and l.strip()]
    found: list[tuple[int, str]] = []
    paragraphs: list[list[str]] = [[]]
    carried = ""  # the first part of a divided word
    last = 0
    for n, (i, line) in enumerate(body):
        if last and any(not lines[k - 1].strip() for k in range(last + 1, i)):
            paragraphs.append([])
        last = i
        following = body[n + 1][1] if n + 1 < len(body) and body[n + 1][0] == i + 1 else ""
        divided = bool(following) and divides(line, following, lexicon)
        if divided:
            found.append((i, "hyphen"))
        tokens = _TOKEN.findall(line)
        before, misread = "", False
        repaired: list[str] = []
        for k, token in enumerate(tokens):
            core = token
            if k == 0 and carried:
                core = carried + token
            if k == len(tokens) - 1 and divided:
                nxt = _TOKEN.search(following)
                # judged with its other half; the half that holds the error is told by what the word should be
                whole = core.rstrip(HYPHENS) + nxt.group()
                fixed = _repair(whole, before, lexicon)
                if fixed is not None and _half_differs(core.rstrip(HYPHENS), fixed, True):
                    misread = True
                carried_next = core.rstrip(HYPHENS)
                repaired.append("")
                carried = carried_next
                break
            if k == len(tokens) - 1 and token[-1:] in HYPHENS:
                repaired.append(core)
                continue
            fixed = _repair(core, before, lexicon)
            if fixed is not None:
                if k == 0 and carried:
                    misread |= _half_differs(token, fixed, False)
                else:
                    misread = True
            repaired.append(fixed if fixed is not None else core)
            before = core.strip("()[]\"“”„«»'.,;:!?").lower()
        if not divided:
            carried = ""
        if misread:
            found.append((i, "misread"))
        paragraphs[-1].append(" ".join(r for r in repaired if r))
    return found, [" ".join(p) for p in paragraphs if any(p)]


def _half_differs(half: str, fixed: str, first: bool) -> bool:
    return not (fixed.lower().startswith(half.lower()) if first else fixed.lower().endswith(half.lower()))


def _repair(token: str, before: str, lexicon: Lexicon) -> str | None:
    """The token with its word or number put right, or null if nothing is wrong with it."""
    if token.isascii() and any(c.isdigit() for c in token):
        number = _misread_number(token)
        if number is not None:
            m = _NUMBER.match(token)
            return token.replace(m.group(1).lstrip("+-−"), number)
    for m in _CORE.finditer(token):
        word = m.group()
        low = word.lower()
        if len(low) < 3 or low in lexicon.words or word.isdigit():
            continue
        if word[1:].upper() == word[1:] and any(c.isalpha() for c in word[1:]) and len(word) > 1 and not word[1:].isdigit() and word[1:].lower() != word[1:]:
            continue  # codes and headlines in capitals
        if word[0].isdigit() and not any(c.isalpha() for c in word):
            continue
        if sum(c.isdigit() for c in word) > max(1, sum(c.isalpha() for c in word)):
            continue
        if m.start() > 0 and token[m.start() - 1] in "-." and word.isdigit():
            continue
        meant = lexicon.correct(low, before)
        if meant is not None:
            if word[0].isupper():
                meant = meant[0].upper() + meant[1:]
            return token[: m.start()] + meant + token[m.end() :]
    return None


def repair(pages: DataFrame, lexicon: Lexicon | None = None, texts: DataFrame | None = None) -> DataFrame:
    """(record, lines, paragraphs): what is wrong with the lines of every page, and its text put right.

    ``pages``: doc (string), record (long, one content), page (int), text.  ``lines`` has (line_no, kind), kind
    furniture, hyphen or misread, line_no from 1 over all lines; ``paragraphs`` are the repaired ones.
    Null and blank texts have none of either.  ``texts`` (text and, if known, native) is what the lexicon is
    learned from, if not the pages themselves.
    """
    lexicon = lexicon or learn_lexicon(texts if texts is not None else pages)
    shared = pages.sparkSession.sparkContext.broadcast(lexicon)  # bounded by the shares
    marks = furniture(pages).groupBy("record").agg(F.array_sort(F.collect_set("line_no")).alias("skip"))
    rows = pages.select("record", "text").join(marks, "record", "left")
    kind = pa.list_(pa.struct([("line_no", pa.int32()), ("kind", pa.string())]))
    schema = pa.schema([("record", pa.int64()), ("lines", kind), ("paragraphs", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.built()
        for batch in batches:
            lines, paragraphs = [], []
            for text, skip in zip(batch.column("text").to_pylist(), batch.column("skip").to_pylist()):
                skip = set(skip or [])
                found, parts = judge_page(text, skip, known) if text and text.strip() else ([], [])
                lines.append([{"line_no": i, "kind": "furniture"} for i in sorted(skip)] + [{"line_no": i, "kind": k} for i, k in found])
                paragraphs.append(parts)
            yield pa.record_batch([batch.column("record"), pa.array(lines, kind), pa.array(paragraphs, pa.list_(pa.string()))], schema=schema)

    return rows.mapInArrow(run, "record long, lines array<struct<line_no:int,kind:string>>, paragraphs array<string>")


def scanned_pages(pages: DataFrame, supplements: DataFrame) -> DataFrame:
    """Recognised pages of papers and of supplements as (doc, record, page, text), each once."""
    a = pages.where("backend = 'tesseract-ocr'").select(F.concat_ws("/", F.lit("paper"), "id", "source").alias("doc"), F.col("page_id").alias("record"), "page", "text")
    b = supplements.select(F.concat_ws("/", F.lit("pdf"), "pdf").alias("doc"), F.col("tsv_id").alias("record"), "page", "text")
    return a.unionAll(b).where("text is not null").dropDuplicates(["record"])
