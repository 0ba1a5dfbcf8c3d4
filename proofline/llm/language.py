"""Language of every document and of every segment of mixed ones, with a confidence.

A linear-chain conditional random field: affix, character n-gram, script and lexicon features of the
words, and transitions between languages, with weights learned together by forward-backward from a
bounded sample of labelled documents.  Languages change only between sentences, so transitions have
potential only there; within a sentence the chain stays in one state and the word potentials add up, and
forward-backward runs over sentences.  Sentences are cut generously (a cut too many costs nothing but a
possible switch).  The sample's labels may be wrong or hold for a part only: a field is fitted on the
labels of each half, the other half's sentences are labelled by it, and the whole field is fitted on
these chains.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_PER_LANGUAGE = 120  # labelled documents that the field is fitted on, per language
SAMPLE_CHARS = 20_000  # longer documents are not put in the sample (they are labelled like all others)
SAMPLE_LEAST = 21  # nor are shorter ones

# Three-letter codes (terminological and bibliographic) of two-letter ones.
THREE_LETTERS = {
    "eng": "en", "deu": "de", "ger": "de", "nld": "nl", "dut": "nl", "fra": "fr", "fre": "fr", "spa": "es", "por": "pt", "ita": "it", "swe": "sv",
    "dan": "da", "pol": "pl", "rus": "ru", "ukr": "uk", "ell": "el", "gre": "el", "ara": "ar", "hin": "hi", "zho": "zh", "chi": "zh", "jpn": "ja", "tha": "th",
}

_WORD = re.compile(r"[^\W\d_]+(?:[̀-ͯऀ-ःऺ-ॏัิ-๎][^\W\d_]*)*")
_SMALL = "a-zß-öø-ÿą-žа-џґα-ώ"
_CUT = re.compile(
    r"\s*\n\s*"
    r"|[!?؟।]+[\"»”’」』)\]]*(?:\s+|(?=[^\W\d_]))"
    rf"|[.;;…]+[\"»”’」』)\]]*(?:\s+(?![{_SMALL}][^A-Z]|[\d(,])|(?=[A-ZÀ-ÖØ-ÞΑ-ΩА-Я]))"
    r"|[。！？]+[」』”’）]*\s*"
)
#: Thai marks no ends: a sentence in another script may follow, or precede, at any blank.
_THAI = re.compile("[฀-๿]")
_THAI_CUT = re.compile(r"(?<=[฀-๿%)0-9²³])\s+(?=[\"„«“¿「]?[^\W\d_฀-๿]{2})|(?<=[^\W\d_฀-๿.%)²³0-9])\s+(?=[฀-๿])")
#: A quotation in brackets is no run; its letters don't count.
_GLOSS = re.compile(r"[(（][“\"„«「『][^()（）]*[”\"“»」』][)）]")
EVIDENCE = 2.5  # by how much (log odds) the first language of a sentence must lead for a run of its own
LEANING = 0.75  # and by how much for going with the run behind it
UNKNOWN = 0.3  # weight of the affixes of a word of a cased script that the lexicon lacks
_SCRIPTS = ((0x250, "l"), (0x370, "o"), (0x400, "g"), (0x530, "c"), (0x600, "o"), (0x700, "a"), (0x900, "o"), (0x980, "d"), (0xE00, "o"), (0xE80, "t"), (0x3040, "o"), (0x3100, "k"), (0x3400, "o"), (0xA000, "h"))


def label_code(label: Column, codes: DataFrame) -> Column:
    """The code that a label names, or null: codes in any case, with blanks or a region, three-letter codes, English names.

    ``codes`` (code, lang_name) is the fixed list of languages; it is read on the driver.
    """
    known = {r["code"].lower(): r["code"] for r in codes.where("code is not null").select("code", "lang_name").collect()}
    names = {r["lang_name"].strip().lower(): r["code"] for r in codes.where("code is not null and lang_name is not null").collect()}
    table = names | {k: v for k, v in THREE_LETTERS.items() if v in known} | known
    entries = F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv]) if table else F.create_map(F.lit(""), F.lit(None).cast("string"))
    clean = F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", ""))
    return F.coalesce(F.element_at(entries, clean), F.element_at(entries, F.regexp_replace(clean, r"[-_].*$", "")))


def segments(text: str) -> list[int]:
    """Starts of the sentences of ``text``, generously cut, the first at its first non-blank character."""
    first = len(text) - len(text.lstrip())
    ends = [m.end() for m in _CUT.finditer(text)]
    if _THAI.search(text):
        ends = sorted({*ends, *(m.end() for m in _THAI_CUT.finditer(text))})
    return [first, *(e for e in ends if first < e < len(text))]




@functools.lru_cache(maxsize=1 << 14)
def _script(char: str) -> str:
    code = ord(char)
    return next((s for top, s in _SCRIPTS if code < top), "h" if 0x20000 <= code < 0x30000 else "o")


def _features(word: str) -> list[str]:
    """Script (first), the word, its affixes and an inner trigram; of a run of an unspaced script all scripts and pairs of letters."""
    script = _script(word[0])
    out = ["#" + script, "=" + word, "<" + word[:1], "<" + word[:2], ">" + word[-1:], ">" + word[-2:]]
    n = len(word)
    if n > 2:
        out += ["<" + word[:3], ">" + word[-3:]]
    if n > 4:
        mid = n // 2
        out.append("~" + word[mid - 1 : mid + 2])
    if not word.isascii() and word[-1] > "\u0dff":
        out += ["#" + c for c in {*map(_script, word)} if c != script]
        out += [f"+{a}{b}" for a, b in zip(word, word[1:]) if b > "\u0dff"]
    return out


@dataclass
class Field:
    """The fitted field: weights (feature, language), the languages, and the log potential of every transition between sentences."""

    languages: list[str]
    index: dict[str, int]
    weights: np.ndarray
    transitions: np.ndarray

    def words(self, words: Sequence[str]) -> np.ndarray:
        """Scores (word, language)."""
        get, empty = self.index.get, len(self.weights)
        weights = np.concatenate([self.weights, np.zeros((1, len(self.languages)), np.float32)])
        at: list[int] = []
        sizes: list[int] = []
        unknown = np.ones(len(words), np.float32)
        for i, w in enumerate(words):
            fs = _features(w)
            at += [get(f, empty) for f in fs]
            sizes.append(len(fs))
            if fs[0] in ("#l", "#c", "#g") and fs[1] not in self.index:
                unknown[i] = UNKNOWN
        out = np.zeros((len(words), len(self.languages)), np.float32)
        if len(at):
            ends = np.cumsum(sizes)
            begins = np.concatenate([[0], ends[:-1]])
            for a in range(0, len(words), 20_000):
                z = min(len(words), a + 20_000)
                part = np.array(at[begins[a] : ends[z - 1]], np.int64)
                out[a:z] = np.add.reduceat(weights[part], begins[a:z] - begins[a])
        return out * unknown[:, None]


CHAINS = 0.25  # weight of the likelihood of chains beside that of single labels
NATIVE = 0.25  # share of a language's letters from which on a script is its own
SWITCH = 0.005  # chance of another language in the next sentence, before it is learned


def _transitions(n: int, switch: float = SWITCH) -> np.ndarray:
    """Log potentials of a chain that changes with this chance, to any other language alike."""
    return np.where(np.eye(n, dtype=bool), np.log(1 - switch), np.log(switch / max(n - 1, 1)))


class _Sample:
    """The sample as numbers: sentences as words, words as features; both are counted once and used by all fits."""

    def __init__(self, docs: Sequence[list[list[str]]]):
        self.sizes = np.array([len(d) for d in docs], np.int64)
        self.doc = np.repeat(np.arange(len(docs)), self.sizes)
        sentences = [ws for d in docs for ws in d]
        place: dict[str, int] = {}
        flat = [place.setdefault(w, len(place)) for ws in sentences for w in ws]
        self.sentence = np.repeat(np.arange(len(sentences)), [len(ws) for ws in sentences])
        self.word = np.array(flat, np.int64)
        self.n = len(sentences)
        self.vocabulary = list(place)
        names: dict[str, int] = {}
        rows = [[names.setdefault(f, len(names)) for f in _features(w)] for w in self.vocabulary]
        self.of_word = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.feature = np.fromiter((f for r in rows for f in r), np.int64, len(self.of_word))
        self.names = list(names)
        self.own = np.ones((len(names), 1), np.float32)

    def native(self, y: np.ndarray, n: int) -> None:
        """Words of a script that is not a language's own (units, names) speak for it by their script only."""
        scripts = sorted({s for _, s in _SCRIPTS} | {"h", "o"})
        at = {s: i for i, s in enumerate(scripts)}
        of = np.array([at[_script(w[0])] for w in self.vocabulary], np.int64)
        letters = np.zeros((n, len(scripts)))
        np.add.at(letters, (y[self.sentence], of[self.word]), np.array([len(w) for w in self.vocabulary])[self.word])
        own = letters >= NATIVE * letters.sum(1, keepdims=True)
        self.own = np.stack([np.ones(n) if f[0] == "#" else own[:, at[_script(f[1])]] for f in self.names]).astype(np.float32)

    def fit(self, y: np.ndarray, use: np.ndarray, languages: list[str], rounds: int, chains: bool) -> Field:
        """The field that fits the labels ``y`` of the sentences in ``use``, by Adam on the penalised likelihood.

        It is the likelihood of each label alone and, with ``chains``, also that of the label chains of whole
        documents, whose gradient comes from forward-backward and goes to weights and transitions together.
        (By chains alone a sentence that its neighbours explain would teach its words nothing.)
        """
        n = len(languages)
        has = np.zeros(self.n, bool)
        has[self.sentence] = True
        use = use & has
        inside = use[self.sentence]
        sentence, word = self.sentence[inside], self.word[inside]
        counts = np.bincount(word, minlength=len(self.vocabulary))
        seen = np.bincount(self.feature[counts[self.of_word] > 0], weights=counts[self.of_word][counts[self.of_word] > 0], minlength=len(self.names)) > 1
        ids = np.flatnonzero(seen)
        column = np.full(len(self.names), -1)
        column[ids] = np.arange(len(ids))
        pairs = (counts[self.of_word] > 0) & seen[self.feature]
        words, features = self.of_word[pairs], column[self.feature[pairs]]
        # Sums by sorted segments: features of a word, words of a feature, words of a sentence, sentences of a word.
        to_word, to_feature = _Sum(words, features, len(self.vocabulary), len(ids))
        to_sentence, back = _Sum(sentence, word, self.n, len(self.vocabulary))
        share = np.bincount(y[use], minlength=n).clip(1)
        weight = np.where(use, use.sum() / n / share[y], 0).astype(np.float32)  # every language weighs the same
        w, t = np.zeros((len(ids), n), np.float32), _transitions(n)
        prior, own = t.copy(), self.own[ids]
        moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (w, t)]
        chain = _Chains(self.doc, use) if chains else None
        total = max(1, int(use.sum()))
        for step in range(1, rounds + 1):
            z = to_sentence(to_word(w))
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(self.n), y] -= 1
            grads = []
            if chain is not None:
                whole, moved = chain.expected(z, t)
                whole[np.arange(self.n), y] -= 1
                p = ((1 - CHAINS) * p + CHAINS * whole).astype(np.float32)
                grads = [(moved - chain.counted(y, n)) / total + 1e-4 * (t - prior)]
            grads.insert(0, own * to_feature(back(p * weight[:, None])) / total + 3e-5 * w)
            for x, g, (m, v), rate in zip((w, t), grads, moments, (0.12, 0.05)):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        return Field(languages, {self.names[i]: k for k, i in enumerate(ids)}, w, t)

    def scores(self, field: Field) -> np.ndarray:
        to_sentence, _ = _Sum(self.sentence, self.word, self.n, len(self.vocabulary))
        return to_sentence(field.words(self.vocabulary))


def _Sum(rows: np.ndarray, columns: np.ndarray, n_rows: int, n_columns: int):
    """The two products with a sparse matrix of ones: of its columns' values by row, and of its rows' values by column."""

    def product(to: np.ndarray, of: np.ndarray, n: int):
        order = np.argsort(to, kind="stable")
        targets, first = np.unique(to[order], return_index=True)
        source = of[order]
        edges = [*range(0, len(targets), 20_000), len(targets)]
        bounds = np.append(first, len(source))

        def run(x: np.ndarray) -> np.ndarray:
            out = np.zeros((n, x.shape[1]), x.dtype)
            for a, z in zip(edges, edges[1:]):
                out[targets[a:z]] = np.add.reduceat(x[source[bounds[a] : bounds[z]]], first[a:z] - first[a])
            return out

        return run

    return product(rows, columns, n_rows), product(columns, rows, n_columns)


class _Chains:
    """Forward-backward over many documents at once: step i of all documents that have it."""

    def __init__(self, doc: np.ndarray, use: np.ndarray):
        places = np.flatnonzero(use)
        begins = np.flatnonzero(np.diff(doc[places], prepend=-1))
        lengths = np.diff(np.append(begins, len(places)))
        order = np.argsort(-lengths, kind="stable")
        self.n = len(use)
        self.steps = [places[begins[order[: int((lengths > i).sum())]] + i] for i in range(int(lengths.max()) if len(lengths) else 0)]

    def counted(self, y: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, n))
        for a, b in zip(self.steps, self.steps[1:]):
            np.add.at(out, (y[a[: len(b)]], y[b]), 1)
        return out

    def expected(self, z: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(posterior of every sentence, expected number of every transition) under scores and transitions."""
        e = np.exp(z.astype(np.float64) - z.max(1, keepdims=True))
        move = np.exp(t - t.max())
        ahead, p = np.ones_like(e), np.zeros_like(e)
        forward: list[np.ndarray] = []
        for i, at in enumerate(self.steps):
            x = e[at] if i == 0 else (forward[-1][: len(at)] @ move) * e[at]
            forward.append(x / x.sum(1, keepdims=True))
        moved = np.zeros_like(move)
        for i in range(len(self.steps) - 1, -1, -1):
            at = self.steps[i]
            both = forward[i] * ahead[at]
            p[at] = both / both.sum(1, keepdims=True)
            if i:
                x = e[at] * ahead[at]
                before = self.steps[i - 1][: len(at)]
                back = x @ move.T
                norm = (forward[i - 1][: len(at)] * back).sum(1, keepdims=True)
                moved += (forward[i - 1][: len(at)] / norm).T @ x
                ahead[before] = back / back.sum(1, keepdims=True)
        return p, moved * move


def _posteriors(sizes: Sequence[int], scores: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Posterior of the language of every sentence; ``sizes``: the number of sentences of each document."""
    if not len(scores):
        return scores.astype(np.float64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    return _Chains(doc, np.ones(len(scores), bool)).expected(scores, transitions)[0]


def _sentences(text: str) -> tuple[list[int], list[list[str]]]:
    text = _GLOSS.sub(lambda m: "_" * len(m.group()), text)
    starts = segments(text)
    ends = [*starts[1:], len(text)]
    return starts, [_WORD.findall(text[a:b].lower()) for a, b in zip(starts, ends)]


def fit(sample: Sequence[tuple[str, str]], languages: Sequence[str], rounds: int = 35) -> Field:
    """Fit the field on (text, language) pairs, some of which may be wrong."""
    languages = sorted(languages)
    code = {c: i for i, c in enumerate(languages)}
    pairs = [(ws, code[c]) for t, c in sample if t and t.strip() and c in code and (ws := _sentences(t)[1])]
    n = len(languages)
    if not pairs:
        return Field(list(languages), {}, np.zeros((0, n), np.float32), _transitions(n))
    data = _Sample([ws for ws, _ in pairs])
    given = np.array([c for _, c in pairs], np.int64)[data.doc]
    data.native(given, n)
    half = data.doc % 2
    sure = np.zeros(data.n, bool)
    for mine in (0, 1):  # each half is judged by the field of the other
        own = half == mine
        field = data.fit(given, ~own if (~own).any() else own, languages, rounds, chains=False)
        if own.any():
            scores, doc = data.scores(field)[own], data.doc[own]
            sizes = np.bincount(doc)[np.unique(doc)]
            sure[own] = _posteriors(sizes, scores, field.transitions).argmax(1) == given[own]
    return data.fit(given, sure, languages, rounds, chains=True)


def train(docs: DataFrame, codes: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Field:
    """Fit the field on at most ``per_language`` different labelled texts of each language, those of the least hashes."""
    labelled = docs.select("text", label_code(F.col("lang"), codes).alias("code")).where(f"code is not null and length(trim(text)) >= {SAMPLE_LEAST} and length(text) <= {SAMPLE_CHARS}")
    # Copies of a text count once; its hash stands for it until the sample is known.
    hashes = labelled.select("code", F.xxhash64("text").alias("h")).distinct()
    counts = {r["code"]: r["n"] for r in hashes.groupBy("code").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Field([r["code"] for r in codes.select("code").where("code is not null").collect()], {}, np.zeros((0, (n := codes.where("code is not null").count())), np.float32), _transitions(n))
    nth = F.row_number().over(Window.partitionBy("code").orderBy("h"))
    drawn = hashes.withColumn("nth", nth).where(F.col("nth") <= per_language).select("code", "h")
    rows = labelled.withColumn("h", F.xxhash64("text")).join(F.broadcast(drawn), ["code", "h"]).select("code", "text").distinct().collect()  # per_language a language
    sample: dict[str, list[str]] = {}
    for r in rows:
        sample.setdefault(r["code"], []).append(r["text"])
    return fit([(t, c) for c, ts in sorted(sample.items()) for t in sorted(ts)], sorted(counts))


class _Scorer:
    """Scores of sentences, with the words' scores kept while there are not too many."""

    MOST = 300_000

    def __init__(self, field: Field):
        self.field = field
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.table = np.zeros((1 << 12, len(self.field.languages)), np.float32)

    def __call__(self, sentences: list[list[str]]) -> np.ndarray:
        if len(self.at) > self.MOST:
            self._clear()
        at = self.at
        new = {w for ws in sentences for w in ws if w not in at}
        if len(at) + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((len(self.table) + len(new), self.table.shape[1]), np.float32)])
        fresh = sorted(new)
        self.table[len(at) : len(at) + len(fresh)] = self.field.words(fresh)
        for w in fresh:
            at[w] = len(at)
        flat = np.fromiter((at[w] for ws in sentences for w in ws), np.int64)
        sizes = np.array([len(ws) for ws in sentences])
        out = np.zeros((len(sentences), self.table.shape[1]), np.float32)
        if len(flat):
            some = sizes > 0
            begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])[some]
            out[some] = np.add.reduceat(self.table[flat], begins)
        return out


_RUNS = pa.list_(pa.struct([("start_char", pa.int32()), ("end_char", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())]))


def _runs(text: str, starts: list[int], posterior: np.ndarray, worded: np.ndarray, leaning: np.ndarray, languages: list[str]) -> list[dict]:
    """Maximal runs of one language.

    A sentence without evidence of its own goes with the run before it, or begins the one behind it if the
    chain gives it that language and the sentence leans to one.
    """
    best = posterior.argmax(1)
    runs: list[list] = []
    ahead = -1
    behind = np.empty(len(starts), np.int64)  # language of the next sentence with evidence
    for i in range(len(starts) - 1, -1, -1):
        behind[i] = ahead
        if worded[i]:
            ahead = best[i]
    for i, s in enumerate(starts):
        if not worded[i] and not (leaning[i] and runs and best[i] == behind[i]):
            continue
        if runs and runs[-1][1] == best[i]:
            runs[-1][2].append(posterior[i, best[i]])
        else:
            runs.append([s, best[i], [posterior[i, best[i]]]])
    if runs:
        runs[0][0] = starts[0]
    out = []
    for i, (s, b, ps) in enumerate(runs):
        e = runs[i + 1][0] if i + 1 < len(runs) else len(text)
        out.append({"start_char": s, "end_char": s + len(text[s:e].rstrip()), "lang": languages[b], "confidence": float(np.mean(ps))})
    return out


def identify(docs: DataFrame, field: Field, key: str = "doc_id") -> DataFrame:
    """(``key``, label, lang, confidence, runs) of every row of ``docs`` (``key``, text, lang).

    ``runs`` are the maximal stretches in one language (start_char, end_char, lang, confidence); lang is
    that of the most text, confidence its share weighed with the runs' confidence.  Texts that are null
    or without words have no runs and no language.  ``label`` is docs.lang as given.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)  # bounded by the sample
    schema = pa.schema([(key, pa.int64()), ("label", pa.string()), ("lang", pa.string()), ("confidence", pa.float64()), ("runs", _RUNS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        score = _Scorer(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                texts = batch.column("text").to_pylist()
                starts: list[list[int]] = []
                words: list[list[str]] = []
                for t in texts:
                    s, ws = _sentences(t) if t and t.strip() else ([], [])
                    starts.append(s)
                    words.extend(ws)
                scores = score(words)
                posteriors = _posteriors([len(s) for s in starts if s], scores, model.transitions) if model.languages else scores
                two = np.sort(scores, axis=1)[:, -2:] if scores.shape[1] > 1 else np.concatenate([scores - 9, scores], axis=1)
                has = np.array([bool(ws) for ws in words], bool)
                lead = two[:, 1] - two[:, 0]
                worded = has & (lead >= EVIDENCE)
                langs, trust, runs = [], [], []
                begin = 0
                for t, s in zip(texts, starts):
                    end = begin + len(s)
                    found: list[dict] = []
                    if len(s) and has[begin:end].any() and model.languages:
                        use = worded[begin:end] if worded[begin:end].any() else has[begin:end]
                        found = _runs(t, s, posteriors[begin:end], use, lead[begin:end] >= LEANING, model.languages)
                    begin = end
                    runs.append(found)
                    size: Counter = Counter()
                    for r in found:
                        size[r["lang"]] += (r["end_char"] - r["start_char"]) * r["confidence"]
                    total = sum(r["end_char"] - r["start_char"] for r in found)
                    top = min(size, key=lambda c: (-size[c], c)) if size else None
                    langs.append(top)
                    trust.append(size[top] / total if top and total else None)
                columns = [batch.column(key), batch.column("label"), pa.array(langs, pa.string()), pa.array(trust, pa.float64()), pa.array(runs, _RUNS)]
                yield pa.record_batch(columns, schema=schema)

    kind = f"{key} long, label string, lang string, confidence double, runs array<struct<start_char:int,end_char:int,lang:string,confidence:double>>"
    return docs.select(key, F.col("lang").alias("label"), "text").mapInArrow(run, kind)


def mislabelled(identified: DataFrame, codes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Runs of the documents whose label is missing, names no language or a wrong one, or whose text mixes languages."""
    named = label_code(F.col("label"), codes)
    cases = identified.where(F.size("runs") > 0).withColumn("named", named).where(F.col("named").isNull() | (F.col("named") != F.col("lang")) | (F.size("runs") > 1))
    return cases.select(key, F.explode("runs").alias("r")).select(key, "r.*")
