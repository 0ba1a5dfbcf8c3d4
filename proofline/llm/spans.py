"""Long verbatim spans shared between records.

The named method hashes lines or paragraphs, groups the digests globally and keeps the earliest
occurrence.  Stored page texts have no line structure (a native page is one line) and shared passages
start and end anywhere, so a fixed unit would miss most of them.  The unit here is therefore a gram of
``UNIT`` characters at places the content itself chooses: of every ``WINDOW`` consecutive grams the
one with the least hash.  Any verbatim run of ``UNIT + WINDOW - 1`` characters contains a whole window
and so at least one chosen unit, in both records at the same place of the run.  Digests of the units
are grouped globally; of units whose digest occurs in more than one group of records, the different
spellings of their surroundings are laid beside each other, and the true extent of the run is compared
character by character.  Records are members of such spellings; pairs of records are formed only where
they are asked for.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions.grams import chosen
from proofline.session import cut_lineage

HOT = 512  # spellings of one unit's surroundings that a single task pairs; beyond it they are split by salt
_CHUNK = 1 << 23  # characters fingerprinted at once


def _fingerprints(k: int, window: int):
    schema = pa.schema([("record", pa.int64()), ("owner", pa.int64()), ("pos", pa.int32()), ("digest", pa.int64())])

    def chunks(batch: pa.RecordBatch) -> Iterator[tuple[list, list, list]]:
        ids, owners, texts, size = [], [], [], 0
        for i, o, t in zip(*(batch.column(c).to_pylist() for c in ("record", "owner", "text"))):
            for at in range(0, max(1, len(t) - (k + window - 2)), _CHUNK):  # longer texts in pieces that overlap
                piece = t[at : at + _CHUNK + k + window - 2]
                if texts and size + len(piece) > _CHUNK:
                    yield ids, owners, texts
                    ids, owners, texts, size = [], [], [], 0
                ids.append((i, at))
                owners.append(o)
                texts.append(piece)
                size += len(piece)
        if texts:
            yield ids, owners, texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, owners, texts in chunks(batch):
                which, pos, digest = chosen(texts, k, window)
                base = np.array([i for i, _ in ids], np.int64)
                shift = np.array([a for _, a in ids], np.int64)
                own = np.array(owners, np.int64)
                yield pa.record_batch([base[which], own[which], (pos + shift[which]).astype(np.int32), digest], schema=schema)

    return run


def _extent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How far two equal units extend to both sides within their surroundings."""
    for batch in batches:
        left, size = [], []
        for a, ga, b, gb, k in zip(*(batch.column(c).to_pylist() for c in ("a_text", "a_gram", "b_text", "b_gram", "k"))):
            if a[ga : ga + k] != b[gb : gb + k]:
                left.append(0)
                size.append(0)  # two texts of one digest
                continue
            back = 0
            while back < min(ga, gb) and a[ga - back - 1] == b[gb - back - 1]:
                back += 1
            ahead, most = k, min(len(a) - ga, len(b) - gb)
            while ahead < most and a[ga + ahead] == b[gb + ahead]:
                ahead += 1
            left.append(back)
            size.append(back + ahead)
        yield pa.record_batch([batch.column("a_place"), batch.column("b_place"), pa.array(left, pa.int32()), pa.array(size, pa.int32())], names=["a_place", "b_place", "back", "size"])


@dataclass(frozen=True)
class Links:
    """What recurs, without the pairs: ``members`` (place, record, owner, pos) and ``links`` (a, b, back, size).

    A place is one spelling of a unit with its surroundings; its members are all copies of it.  A link says
    that members of place a and b share ``size`` characters, which begin ``back`` characters before the
    unit; a place of several owners is linked with itself.  ``places`` (place, first, second, owner, members):
    the lowest record of a place and its owner, the lowest of another owner, and a digest of all records.
    """

    members: DataFrame
    places: DataFrame
    links: DataFrame


def shared_places(records: DataFrame, least: int = 150) -> Links:
    """Where verbatim runs of ``least`` characters or more recur between records of different owners.

    ``records`` has record (long, one content each; repeated rows are harmless), owner (string) and
    text; other columns are ignored.  Texts are compared as stored.  Null and shorter texts share
    nothing; records without an owner are of one unnamed owner.  Copies of a unit with the same
    surroundings are one place, and only places are laid beside each other, so the work follows the number
    of different texts, not that of pairs of copies.  No bound is put on partners; units of more than
    ``HOT`` places are split by salt.
    """
    if least < 4:
        raise ValueError("least must be 4 or more")
    k = max(1, 2 * least // 3)
    window = least - k + 1
    around = least - k
    texts = records.select("record", F.xxhash64(F.coalesce("owner", F.lit(""))).alias("owner"), "text").where(F.length("text") >= least)
    marks = texts.mapInArrow(_fingerprints(k, window), "record long, owner long, pos int, digest long").repartition("digest")
    recurring = marks.groupBy("digest").agg(F.min("owner").alias("lo"), F.max("owner").alias("hi")).where("lo <> hi").select("digest")
    units = marks.join(recurring, "digest")
    beside = units.join(texts.select("record", "text").dropDuplicates(["record"]), "record").select(
        "digest", "record", "owner", "pos", F.least("pos", F.lit(around)).alias("gram"),
        F.expr(f"substring(text, greatest(pos - {around}, 0) + 1, least(pos, {around}) + {k + around})").alias("text"),
    ).dropDuplicates(["record", "pos"])
    beside = cut_lineage(beside.withColumn("place", F.xxhash64("digest", "gram", "text")))
    places = beside.groupBy("place", "digest").agg(
        F.min("text").alias("text"), F.min("gram").alias("gram"), F.min(F.struct("record", "owner")).alias("low"),
        F.sum(F.xxhash64("record").cast("decimal(38,0)")).cast("string").alias("members"), F.min("owner").alias("lo"), F.max("owner").alias("hi"),
    )
    low = F.min(F.struct("record", "owner")).over(Window.partitionBy("place"))
    second = beside.select("place", "record", "owner", low.alias("low")).where("owner <> low.owner").groupBy("place").agg(F.min("record").alias("second"))
    per_digest = places.groupBy("digest").agg(F.ceil(F.count("*") / HOT).cast("int").alias("salts"), F.count("*").alias("n")).where("n > 1").select("digest", "salts")
    several = places.join(per_digest, "digest")
    one = several.withColumn("salt", F.pmod(F.xxhash64("place"), F.col("salts")).cast("int"))
    other = several.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    a, b = one.alias("a"), other.alias("b")
    # Two places that one and the same owner holds alone share nothing between owners.
    alone = (F.col("a.lo") == F.col("a.hi")) & (F.col("b.lo") == F.col("b.hi")) & (F.col("a.lo") == F.col("b.lo"))
    pairs = a.join(b, (F.col("a.digest") == F.col("b.digest")) & (F.col("a.salt") == F.col("b.salt")) & (F.col("a.place") < F.col("b.place")) & ~alone).select(
        F.col("a.place").alias("a_place"), F.col("b.place").alias("b_place"), F.col("a.text").alias("a_text"), F.col("a.gram").alias("a_gram"),
        F.col("b.text").alias("b_text"), F.col("b.gram").alias("b_gram"), F.lit(k).alias("k"),
    )
    between = pairs.mapInArrow(_extent, "a_place long, b_place long, back int, size int").toDF("a", "b", "back", "size")
    within = places.where("lo <> hi").select(F.col("place").alias("a"), F.col("place").alias("b"), F.col("gram").alias("back"), F.length("text").alias("size"))
    found = places.join(second, "place", "left").select("place", F.col("low.record").alias("first"), F.col("low.owner").alias("owner"), "second", "members")
    return Links(beside.select("place", "record", "owner", "pos"), found, between.unionAll(within).where(F.col("size") >= least))


def shared_pairs(records: DataFrame, least: int = 150) -> DataFrame:
    """(record_a, record_b), record_a < record_b: records of different owners that share a verbatim run, each pair once.

    For ``records`` and ``least`` see ``shared_places``.  Places with the same records are expanded once.
    """
    found = shared_places(records, least)
    digests = found.places.select("place", "members")
    links = found.links.select("a", "b").join(digests.toDF("a", "a_members"), "a").join(digests.toDF("b", "b_members"), "b").dropDuplicates(["a_members", "b_members"]).select("a", "b")
    left, right = (found.members.select(F.col("place").alias(x), F.col("record").alias(f"{x}_record"), F.col("owner").alias(f"{x}_owner")) for x in "ab")
    rows = links.join(left, "a").join(right, "b").where("a_record <> b_record and a_owner <> b_owner")
    return rows.select(F.least("a_record", "b_record").alias("record_a"), F.greatest("a_record", "b_record").alias("record_b")).distinct()


def _stretches(records: DataFrame, least: int) -> DataFrame:
    """(record, start, stop, first): stretches of what a record shares with others, each with the lowest record that holds it."""
    found = shared_places(records, least)
    both = found.links.select(F.col("a").alias("place"), F.col("b").alias("other"), "back", "size").unionAll(
        found.links.where("a <> b").select(F.col("b").alias("place"), F.col("a").alias("other"), "back", "size"))
    holders = both.join(found.places.select(F.col("place").alias("other"), "first", "second", "owner"), "other")
    # Of all places that share the same stretch with a place: the lowest record, and the lowest of another owner.
    same = Window.partitionBy("place", "back", "size")
    low = F.min(F.struct("first", "owner")).over(same)
    others = F.when(F.col("owner") != F.col("low.owner"), F.col("first")).otherwise(F.col("second"))
    per = holders.withColumn("low", low).groupBy("place", "back", "size").agg(F.min("low").alias("low"), F.min(others).alias("second"))
    rows = found.members.join(per, "place").withColumn("partner", F.when(F.col("owner") != F.col("low.owner"), F.col("low.first")).otherwise(F.col("second")))
    start = F.col("pos") - F.col("back")
    return rows.where("partner is not null").groupBy("record", start.alias("start"), (start + F.col("size")).alias("stop")).agg(F.min(F.least("partner", "record")).alias("first"))


def _covered(stretches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Disjoint (start, stop, rank) in order: the least rank of the stretches over every place, equal neighbours as one."""
    out: list[tuple[int, int, int]] = []
    active: list[tuple[int, int]] = []  # heap of (rank, stop)
    i, at, n = 0, 0, len(stretches)
    stretches = sorted(stretches)
    while i < n or active:
        if not active:
            at = max(at, stretches[i][0])
        while i < n and stretches[i][0] <= at:
            heapq.heappush(active, (stretches[i][2], stretches[i][1]))
            i += 1
        while active and active[0][1] <= at:
            heapq.heappop(active)
        if not active:
            continue
        rank, stop = active[0]
        if i < n:
            stop = min(stop, stretches[i][0])
        if out and out[-1][1] == at and out[-1][2] == rank:
            out[-1] = (out[-1][0], stop, rank)
        else:
            out.append((at, stop, rank))
        at = stop
    return out


def _spans_of(record: int, stretches: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """(start, stop, first) of one record: the places of its stretches (start, stop, first), each with its earliest holder.

    What recurs is a passage of ``least`` characters, so holders are told by passage: a place belongs to the record
    itself if any passage over it occurs here first, also where its other passages occur earlier elsewhere.
    """
    passages = _covered([(a, b - least + 1, first) for a, b, first in stretches])
    own = -1  # ranks before all others
    spans = _covered([(a, b + least - 1, own if first == record else first) for a, b, first in passages])
    return [(a, b, record if first == own else first) for a, b, first in spans]


def _held(least: int):
    schema = pa.schema([("record", pa.int64()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("first_record", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, int, int]] = []
        current, stretches = None, []
        for batch in batches:
            for record, start, stop, first in zip(*(batch.column(c).to_pylist() for c in ("record", "start", "stop", "first"))):
                if record != current and stretches:
                    rows += [(current, *s) for s in _spans_of(current, stretches, least)]
                    stretches = []
                current = record
                stretches.append((start, stop, first))
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows = []
        if stretches:
            rows = [(current, *s) for s in _spans_of(current, stretches, least)]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def shared_spans(records: DataFrame, least: int = 150) -> DataFrame:
    """For every record the spans it shares and how much of it they are.

    One row per record and span: record, start_char, end_char (0-based, end excluded, in the stored
    text), first_record (the lowest record number among those that hold the passages of the span, itself
    included), kept (this record is that first one), shared_chars and shared_share of the whole
    record.  Spans of different holders touch and do not overlap.  Records that share nothing have one row
    with a null span and shared_chars 0; the share of a null or empty text is 0.
    """
    stretches = _stretches(records, least)
    ordered = stretches.repartition("record").sortWithinPartitions("record", "start", "stop")
    spans = ordered.mapInArrow(_held(least), "record long, start_char int, end_char int, first_record long").withColumn("kept", F.col("first_record") == F.col("record"))
    total = spans.groupBy("record").agg(F.sum(F.col("end_char") - F.col("start_char")).alias("shared_chars"))
    sizes = records.select("record", F.coalesce(F.length("text"), F.lit(0)).alias("chars")).dropDuplicates(["record"])
    return (
        sizes.join(total, "record", "left").join(spans, "record", "left")
        .select("record", "start_char", "end_char", "first_record", "kept", F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"),
                F.when(F.col("chars") > 0, F.coalesce("shared_chars", F.lit(0)) / F.col("chars")).otherwise(F.lit(0.0)).alias("shared_share"))
    )


def remove_repeats(records: DataFrame, least: int = 150) -> DataFrame:
    """Texts with every shared span taken out but in the record where it occurs first.

    Every passage of ``least`` characters that recurs is left whole in the first record that holds it.

    Result: record, text (what is left), cuts: array of (start_char, end_char) in the original text.
    Null texts stay null.
    """
    cuts = (
        shared_spans(records, least).where("not kept").groupBy("record")
        .agg(F.array_sort(F.collect_list(F.struct("start_char", "end_char"))).alias("cuts"))
    )
    left = records.select("record", "text").dropDuplicates(["record"]).join(cuts, "record", "left")
    bounds = F.expr("concat(array(0), transform(cuts, c -> c.end_char))")
    ends = F.expr("concat(transform(cuts, c -> c.start_char), array(length(text)))")
    kept = F.expr("array_join(zip_with(_from, _to, (a, b) -> substring(text, a + 1, b - a)), '')")
    return (
        left.withColumn("_from", bounds).withColumn("_to", ends)
        .select("record", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(kept).alias("text"), F.coalesce("cuts", F.expr("cast(array() as array<struct<start_char:int,end_char:int>>)")).alias("cuts"))
    )


def paper_records(units: DataFrame, pages: DataFrame, locators: DataFrame) -> DataFrame:
    """Units, pages and locator literals as records of their papers."""
    parts = [(units, "unit_id", "text"), (pages, "page_id", "text"), (locators, "locator_id", "exact")]
    out = None
    for df, key, text in parts:
        part = df.select(F.col(key).alias("record"), F.col("id").alias("owner"), F.col(text).alias("text"))
        out = part if out is None else out.unionAll(part)
    return out
