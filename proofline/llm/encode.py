"""Encoding of whole texts with a public byte-level BPE: ranked merges folded by Spark's higher-order functions.

Texts are split by the tokenizer's pattern, and further at every byte boundary that no token of the
vocabulary spans: no merge can cross it, so the pieces can be encoded apart.  The rules of the split
look at neighbouring characters only, so a block of texts is split at once with array operations.
Most pieces recur.  The distinct ones that are no token themselves are merged once each, over all
texts: a fold over the merge steps of an array that holds every token with the rank of the merge with
the token behind it.  The ranked merges are a literal: one array in which the merges of a left token
lie at its offset plus the right token, so that a look-up is two reads.  The ids go back to the
documents block by block: documents are hashed to blocks of bounded size, each in a task of its own,
and a block meets the dictionary of its own pieces.
"""

from __future__ import annotations

import functools
import heapq
import importlib.util
import json
import os
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_CHARS = 8_000_000  # characters of text in a block, on average
CHUNK_BYTES = 1 << 24  # bytes of whole texts split at once
# What may follow an apostrophe as a piece of its own.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
# The blanks of the pattern (the property White_Space).
BLANKS = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

_BLANK, _LETTER, _NUMBER, _SIGN = range(4)
_LOW = (1 << 17) - 1  # an id in a packed entry: rank << 17 | id
_NO_MERGE = 1 << 34  # packed entries from here on stand for no merge
_END = 256  # stands behind the last byte


def default_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of an installed public vocabulary; PROOFLINE_TOKENIZERS names another folder."""
    folder = os.environ.get("PROOFLINE_TOKENIZERS")
    if not folder:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, name)


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files: printable bytes for themselves, the rest counted on from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable}
    rest = [b for b in range(256) if b not in set(printable)]
    return letters | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass(frozen=True)
class Vocabulary:
    tokens: tuple[bytes, ...]  # by id; special tokens are empty
    single: tuple[int, ...]  # id of each byte
    pairs: tuple[tuple[int, int], ...]  # merges by rank, as ids
    first: int  # id of the first merge; that of rank r is first + r

    def spanned(self) -> np.ndarray:
        """Table of (byte, byte that starts a character of two bytes or more): whether some token has the two in a row."""
        out = np.zeros((256, 256), bool)
        for token in self.tokens:
            for a, b in zip(token, token[1:]):
                out[a, b] = True
        return out


@functools.lru_cache(maxsize=4)
def load_vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters = _byte_letters()
    plain = lambda t: bytes(letters[c] for c in t)
    ids = {t: i for t, i in model["vocab"].items() if all(c in letters for c in t)}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    tokens = [b""] * (max(ids.values()) + 1)
    made = {ids[a + b] for a, b in merges} | {i for t, i in ids.items() if len(t) == 1}
    for t, i in ids.items():
        if i in made:  # special tokens are ordinary text here
            tokens[i] = plain(t)
    first = ids["".join(merges[0])]
    if any(ids[a + b] != first + r for r, (a, b) in enumerate(merges)):
        raise ValueError("ids must follow the ranks of the merges")
    if len(tokens) > _LOW:
        raise ValueError("the vocabulary is too large")
    single = [0] * 256
    for t, i in ids.items():
        if len(t) == 1:
            single[letters[t]] = i
    return Vocabulary(tuple(tokens), tuple(single), tuple((ids[a], ids[b]) for a, b in merges), first)


@functools.lru_cache(maxsize=4)
def _displaced(vocabulary: Vocabulary) -> tuple[list[int], list[int]]:
    """(table, offsets): the merge of (left, right) lies at offsets[left] + right as (left + 1) << 17 | rank, other places are 0.

    The rows of the left tokens are laid over each other, the longest first, so that no two entries meet.
    """
    rows = defaultdict(list)
    for rank, (left, right) in enumerate(vocabulary.pairs):
        rows[left].append((right, rank))
    n = len(vocabulary.tokens)
    size = 8 * n
    free = np.ones(size, bool)
    table = np.zeros(size, np.int64)
    offsets = np.zeros(n + 1, np.int64)
    at, was = 0, 0
    for left, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        right, rank = np.array(row, np.int64).T
        if len(right) < was or len(right) == 1:  # shorter rows may fit into gaps again
            at = int(np.argmax(free[at if len(right) == 1 else 0 :])) + (at if len(right) == 1 else 0)
        was = len(right)
        while True:
            places = at + np.flatnonzero(free[at : at + 4096]) - right[0]
            places = places[places >= 0]
            for r in right[1:]:
                if not len(places):
                    break
                places = places[free[places + r]]
            if len(places):
                break
            at += 4096
        offsets[left] = places[0]
        free[places[0] + right] = False
        table[places[0] + right] = (left + 1) << 17 | rank
    return table[: int(offsets.max()) + n + 1].tolist(), offsets.tolist()


def _literal(values: list[int], kind: str) -> str:
    """A literal array, as text that Spark folds into a constant."""
    return f"cast(split('{','.join(map(str, values))}', ',') as array<{kind}>)"


def _fold(vocabulary: Vocabulary, piece: str) -> Column:
    """Ids of the binary column ``piece`` by merging the pair of least rank, again and again.

    The state is one array: for every token its id, and in front of it the rank of the merge with the token
    behind it.  So the least entry is the next merge, and its first place the leftmost one.
    """
    table, offsets = _displaced(vocabulary)
    size = _END + 1
    # Of two bytes the rank of their merge, less what stands for none; of a byte its id with none.
    of_pairs, of_bytes = [0] * (256 * size), [_NO_MERGE | i for i in vocabulary.single]
    byte_of = {i: b for b, i in enumerate(vocabulary.single)}
    for rank, (left, right) in enumerate(vocabulary.pairs):
        if left in byte_of and right in byte_of:
            of_pairs[byte_of[left] * size + byte_of[right]] = (rank << 17) - _NO_MERGE
    bytes_of = f"transform(split(concat(decode({piece}, 'ISO-8859-1'), '\\u0100'), ''), c -> ascii(c))"
    start = f"transform(array({bytes_of}), x -> transform(sequence(0, size(x) - 2), j -> t.p[x[j] * {size} + x[j + 1]] + t.b[x[j]]))[0]"
    # An entry of the table, less its own left token's bits, is the rank; an entry of another token stays above all ranks.
    entry = lambda left, right: f"shiftleft(t.c[t.o[{left}] + {right}] ^ shiftleft({left} + 1, 17), 17) + {left}"
    merged = f"coalesce({entry('w.m', f'(get(s, w.p + 1) & {_LOW}L)')}, {_NO_MERGE}L + w.m)"
    before = entry(f"(y & {_LOW}L)", "w.m")
    places = f"transform(s, (y, j) -> case when j > w.p then y when j = w.p then -1L when j = w.p - 1 then {merged} when j = w.p - 2 then {before} else y end)"
    least = f"named_struct('p', cast(array_position(s, array_min(s)) as int), 'm', shiftright(array_min(s), 17) + {vocabulary.first}L)"
    step = f"case when array_min(s) >= {_NO_MERGE}L then s else array_remove(transform(array({least}), w -> {places})[0], -1L) end"
    constants = f"named_struct('c', {_literal(table, 'bigint')}, 'o', {_literal(offsets, 'bigint')}, 'p', {_literal(of_pairs, 'bigint')}, 'b', {_literal(of_bytes, 'bigint')})"
    merges = f"aggregate(sequence(1, octet_length({piece}) - 1), {start}, (s, i) -> {step})"
    return F.expr(f"transform(array({constants}), t -> transform({merges}, y -> cast(y & {_LOW}L as int)))[0]")


def _merge_long(vocabulary: Vocabulary):
    """The same merges with a heap, for pieces too long to fold."""
    ranks = {p: r for r, p in enumerate(vocabulary.pairs)}

    def encode(piece: bytes) -> list[int]:
        ids = [vocabulary.single[c] for c in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := ranks.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = vocabulary.first + r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if 0 <= x and y < n and (q := ranks.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    return encode


def _classes() -> np.ndarray:
    """Of every code point, whether it is a blank, letter, number or another sign."""
    out = np.full(0x110000, _SIGN, np.uint8)
    for first in (*range(0, 0x32000, 0x1000), 0xE0000):  # other planes have no letters and numbers
        out[first : first + 0x1000] = [{"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], _SIGN) for c in range(first, first + 0x1000)]
    out[list(BLANKS)] = _BLANK
    return out


class _Splitter:
    """Splits the texts of a chunk into pieces, all at once."""

    def __init__(self, vocabulary: Vocabulary):
        self.classes = _classes()
        self.spanned = vocabulary.spanned()

    def __call__(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(pieces, number of pieces of each text) of an array of strings without nulls."""
        offsets, data = self._buffers(texts)
        if not len(data):
            return pa.array([], pa.binary()), np.zeros(len(texts), np.int64)
        codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        places = np.flatnonzero((data & 0xC0) != 0x80)  # of the first byte of each character
        heads = np.zeros(len(codes), bool)  # characters that begin a text
        firsts = np.searchsorted(places, offsets[:-1][offsets[:-1] < offsets[1:]])
        heads[firsts] = True
        cls = self.classes[codes]
        begins = self._begins(codes, cls, heads)
        many = np.flatnonzero(codes >= 0x80)
        many = many[places[many] > 0]
        begins[many] |= ~self.spanned[data[places[many] - 1], data[places[many]]]
        cuts = places[begins]
        made = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(np.append(cuts, len(data)).astype(np.int32)), pa.py_buffer(data)])
        return made, np.diff(np.searchsorted(cuts, offsets))

    @staticmethod
    def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        wide = pa.types.is_large_string(texts.type)
        offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] else np.zeros(0, np.uint8)
        return offsets - offsets[0], data

    @staticmethod
    def _begins(codes: np.ndarray, cls: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Where the pieces of the tokenizer's pattern begin.

        A run of one class is a piece.  One plain space before it belongs to it; of several blanks all but
        the last are a piece, if something follows in the text.  An apostrophe that begins a run takes
        the letters of a contraction with it and nothing else.
        """
        blank = cls == _BLANK
        begins = np.empty(len(codes), bool)
        begins[0] = True
        begins[1:] = cls[1:] != cls[:-1]
        begins[1:] &= ~((codes[:-1] == 0x20) & ~blank[1:])
        inner = np.flatnonzero(blank[:-1] & ~blank[1:] & ~heads[1:])  # the last blank of a run that something follows
        begins[inner] = True
        begins |= heads
        marks = np.flatnonzero(begins & (codes == 0x27))
        if len(marks):
            ahead = np.full((3, len(marks)), 0x110000, np.uint32)  # characters behind the mark, in the same text
            inside = np.ones(len(marks), bool)
            for i in range(3):
                at = marks + i + 1
                inside &= at < len(codes)
                inside[inside] = ~heads[at[inside]]
                ahead[i, inside] = codes[at[inside]]
            for word in CONTRACTIONS:
                fits = np.logical_and.reduce([ahead[i] == ord(c) for i, c in enumerate(word)])
                begins[marks[fits] + 1] = False
                ends = marks[fits] + 1 + len(word)
                begins[ends[ends < len(codes)]] = True
        return begins


def _chunks(texts: pa.ChunkedArray) -> Iterator[tuple[int, pa.Array]]:
    """(row of the first, texts) of stretches of about ``CHUNK_BYTES``, nulls as empty texts."""
    row = 0
    for part in texts.chunks:
        part = pc.fill_null(part, "")
        sizes = np.cumsum(pc.binary_length(part).to_numpy(zero_copy_only=False).astype(np.int64))
        edges = np.flatnonzero(np.diff(sizes // CHUNK_BYTES)) + 1
        for a, b in zip([0, *edges], [*edges, len(part)]):
            if b > a:
                yield row + int(a), part.slice(a, b - a)
        row += len(part)


def _distinct(shared):
    schema = pa.schema([("block", pa.int32()), ("piece", pa.binary())])

    def run(key: tuple, block: pa.Table) -> pa.Table:
        tokens, vocabulary = shared.value
        split, found = _Splitter(vocabulary), []
        for _, texts in _chunks(block.column("text")):
            pieces = pc.unique(split(texts)[0])
            found.append(pieces.filter(pc.invert(pc.is_in(pieces, tokens))))
        own = pc.unique(pa.chunked_array(found, pa.binary()))
        return pa.table([pa.repeat(pa.scalar(key[0].as_py(), pa.int32()), len(own)), own], schema=schema)

    return run


def _assemble(shared, key: str, keep: tuple[str, ...]):
    schema = pa.schema([(key, pa.int64()), ("ids", pa.list_(pa.int32())), *[(c, pa.string()) for c in keep]])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        tokens, vocabulary = shared.value
        own = right.column("piece").combine_chunks() if len(right) else pa.array([], pa.binary())
        ids = right.column("ids").combine_chunks() if len(right) else pa.array([], pa.list_(pa.int32()))
        if ids.null_count:
            merge = _merge_long(vocabulary)
            long = {i: merge(own[i].as_py()) for i in np.flatnonzero(pc.is_null(ids).to_numpy(zero_copy_only=False))}
            ids = pa.array([long.get(i, x) for i, x in enumerate(ids.to_pylist())], pa.list_(pa.int32()))
        known = pa.concat_arrays([tokens, pc.cast(own, pa.binary())])
        lengths = np.concatenate([np.ones(len(tokens), np.int64), pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)])
        values = np.concatenate([np.arange(len(tokens), dtype=np.int32), ids.flatten().to_numpy(zero_copy_only=False)])
        begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        split, lists = _Splitter(vocabulary), []
        for _, texts in _chunks(left.column("text")):
            pieces, sizes = split(texts)
            at = pc.index_in(pieces, value_set=known)
            if at.null_count:
                raise ValueError(f"{at.null_count} pieces are missing from the dictionary of {len(own)} of their block")
            at = at.to_numpy(zero_copy_only=False)
            long = lengths[at]
            ends = np.cumsum(long)
            flat = values[np.repeat(begins[at] - (ends - long), long) + np.arange(int(ends[-1]) if len(ends) else 0)]
            edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
            lists.append(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(flat, pa.int32())))
        made = pa.chunked_array(lists, pa.list_(pa.int32()))
        return pa.table([left.column(key), made, *[left.column(c) for c in keep]], schema=schema)

    return run


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, fold_bytes: int = 96, keep: tuple[str, ...] = ()) -> DataFrame:
    """(``key``, ids): the token ids of every text, one row per row of ``docs``, without special tokens.

    A null and an empty text have no ids (an empty array).  Strings of special tokens are ordinary
    text.  ``key`` is a long column; null and repeated keys are allowed (rows with the same key and the same
    text lie in one block).  String columns named in ``keep`` come along, other columns are ignored.
    Pieces of more than ``fold_bytes`` bytes, which runs without blanks or letters may form, are merged
    with a heap instead of the fold, for the fold's cost grows with the square of the length; the ids are
    the same.
    """
    spark = docs.sparkSession
    vocabulary = load_vocabulary(path or default_vocabulary())
    source = docs.select(F.col(key).alias(key), F.col(text).alias("text"), *keep)
    chars = source.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, round(chars / BLOCK_CHARS))
    block = F.pmod(F.xxhash64(key, F.xxhash64("text")), F.lit(blocks)).cast("int")
    # As many tasks as blocks: a task's share stays the same as the data grow.
    texts = source.select(block.alias("block"), key, "text", *keep).repartition(max(blocks, int(spark.conf.get("spark.sql.shuffle.partitions"))), "block")
    tokens = pa.array([t or None for t in vocabulary.tokens], pa.binary())
    shared = spark.sparkContext.broadcast((tokens, vocabulary))  # a fixed size
    own = texts.groupBy("block").applyInArrow(_distinct(shared), "block int, piece binary")
    # One exchange brings the uses of a piece together; its ids are made at the first and handed to the others.
    alike = Window.partitionBy("piece").orderBy("block")
    merged = own.withColumn("nth", F.row_number().over(alike)).withColumn("made", F.when((F.col("nth") == 1) & (F.octet_length("piece") > 1) & (F.octet_length("piece") <= fold_bytes), _fold(vocabulary, "piece")))
    dictionary = merged.select(F.col("block").alias("of"), "piece", F.first("made").over(alike).alias("ids"))
    assemble = _assemble(shared, key, keep)
    return texts.groupBy("block").cogroup(dictionary.groupBy("of")).applyInArrow(assemble, ", ".join([f"{key} long, ids array<int>", *[f"{c} string" for c in keep]]))


def decode(ids: Column | str, path: str | None = None) -> Column:
    """The text of an array of ids: their bytes joined.  An id outside the vocabulary raises; null stays null."""
    vocabulary = load_vocabulary(path or default_vocabulary())
    table = ",".join(t.hex() for t in vocabulary.tokens)
    column = F.col(ids) if isinstance(ids, str) else ids
    bytes_of = F.split(F.lit(table), ",")
    return F.decode(F.unhex(F.array_join(F.transform(column, lambda i: F.element_at(bytes_of, i + 1)), "")), "UTF-8")
