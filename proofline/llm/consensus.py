"""Consensus of several reviewers' verdicts by a competence-and-spamming mixture.

A verdict is either truthful (with the reviewer's competence) or drawn from the reviewer's own guess
distribution.  Expectation-maximisation yields the posterior of every claim's true verdict and both
properties of every reviewer.

Every claim is one row with the arrays of its reviewers and verdicts, written once.  One iteration is one
pass over these rows: with all reviewers' properties at hand a claim needs no other row, and what moves are
the expected counts, one row per reviewer and task.  The properties are sent to the tasks while the
number of reviewers, which is counted, keeps within ``MOST_SENT``; beyond it they stay a table that is
joined with the verdicts (``Consensus``), with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.session import cut_lineage

# The verdicts a review may give.
VERDICTS = ("supported", "partial", "unsupported", "unclear")

MOST_SENT = 200_000  # reviewers whose properties (n + 1 numbers each) are sent to all tasks

_TINY = 1e-12


def valid_verdicts(reviews: DataFrame, labels: Sequence[str] = VERDICTS) -> DataFrame:
    """(id, claim, annotator, label): the last valid verdict of each reviewer on each claim.

    Verdicts and reviewers are trimmed of blanks and put in lower case; other verdicts, and null or
    blank reviewers, do not count.  The latest reviewed_at holds, a null one being the earliest; of
    equal times the label that sorts last.
    """
    clean = lambda c: F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    rows = reviews.select("id", "claim", clean("reviewer").alias("annotator"), clean("verdict").alias("label"), "reviewed_at")
    rows = rows.where(F.col("label").isin(*labels) & (F.col("annotator") != "") & F.col("id").isNotNull() & F.col("claim").isNotNull())
    when = F.try_to_timestamp("reviewed_at")
    last = F.max(F.struct(F.coalesce(when, F.lit("0001-01-01").cast("timestamp")).alias("at"), F.coalesce("reviewed_at", F.lit("")).alias("raw"), F.col("label")))
    return rows.groupBy("id", "claim", "annotator").agg(last.alias("last")).select("id", "claim", "annotator", F.col("last.label").alias("label"))


def _total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


class Consensus:
    """The fitted mixture: ``items`` and ``annotators`` are its results."""

    def __init__(self, votes: DataFrame, labels: Sequence[str], iterations: int, tolerance: float):
        """``votes``: (item columns..., annotator, label), one row per item and annotator."""
        self.labels = list(labels)
        self.items_by = [c for c in votes.columns if c not in ("annotator", "label")]
        code = reduce(lambda e, i: e.when(F.col("label") == self.labels[i], i), range(1, len(labels)), F.when(F.col("label") == labels[0], 0))
        self.votes = cut_lineage(votes.select(*self.items_by, "annotator", code.alias("y")).repartition(*self.items_by))
        self.iterations, self.tolerance = iterations, tolerance
        self.rounds = 0

    def _posterior(self, parameters: DataFrame, prior: Sequence[float]) -> DataFrame:
        """Every vote with the posterior of its item (q0...) and the chance that it was truthful (honest)."""
        n = len(self.labels)
        w = Window.partitionBy(*self.items_by)
        rows = self.votes.join(parameters, "annotator")
        guess = lambda y: F.element_at("guesses", y + 1)
        spam = (1 - F.col("competence")) * guess(F.col("y"))
        rows = rows.withColumn("spam", spam)
        for t in range(n):
            like = F.when(F.col("y") == t, F.col("competence")).otherwise(0.0) + F.col("spam")
            rows = rows.withColumn(f"l{t}", F.sum(F.log(like + F.lit(_TINY))).over(w) + F.log(F.lit(prior[t] + _TINY)))
        top = F.greatest(*[F.col(f"l{t}") for t in range(n)])
        rows = rows.withColumn("top", top)
        for t in range(n):
            rows = rows.withColumn(f"e{t}", F.exp(F.col(f"l{t}") - F.col("top")))
        rows = rows.withColumn("sum", _total([F.col(f"e{t}") for t in range(n)]))
        for t in range(n):
            rows = rows.withColumn(f"q{t}", F.col(f"e{t}") / F.col("sum"))
        right = reduce(lambda e, t: e.when(F.col("y") == t, F.col(f"q{t}")), range(1, n), F.when(F.col("y") == 0, F.col("q0")))
        rows = rows.withColumn("right", right).withColumn("size", F.count("*").over(w))
        honest = F.col("right") * F.col("competence") / (F.col("competence") + F.col("spam") + F.lit(_TINY))
        return rows.select(*self.items_by, "annotator", "y", "size", "right", honest.alias("honest"), *[f"q{t}" for t in range(n)])

    def _maximise(self, rows: DataFrame) -> DataFrame:
        n = len(self.labels)
        sums = rows.groupBy("annotator").agg(
            F.sum("honest").alias("true"), F.count("*").alias("votes"), F.sum("right").alias("hits"),
            *[F.sum(F.when(F.col("y") == t, 1 - F.col("honest")).otherwise(0.0)).alias(f"s{t}") for t in range(n)],
            *[F.sum(F.col(f"q{t}") / F.col("size")).alias(f"p{t}") for t in range(n)],
        )
        spam = _total([F.col(f"s{t}") + 0.5 for t in range(n)])
        return sums.select(
            "annotator", "votes", ((F.col("true") + 1.0) / (F.col("votes") + 2.0)).alias("competence"),
            F.array(*[(F.col(f"s{t}") + 0.5) / spam for t in range(n)]).alias("guesses"),
            (F.col("hits") / F.col("votes")).alias("accuracy"), *[f"p{t}" for t in range(n)],
        )

    def fit(self) -> Consensus:
        n = len(self.labels)
        prior = [1.0 / n] * n
        parameters = self.votes.groupBy("annotator").agg(F.count("*").alias("votes")).select(
            "annotator", F.lit(0.7).alias("competence"), F.array(*[F.lit(1.0 / n)] * n).alias("guesses"))
        for self.rounds in range(1, self.iterations + 1):
            new = cut_lineage(self._maximise(self._posterior(parameters, prior)))
            moved = new.join(parameters.select("annotator", F.col("competence").alias("was")), "annotator").agg(F.max(F.abs(F.col("competence") - F.col("was"))).alias("d"), *[F.sum(f"p{t}").alias(f"p{t}") for t in range(n)]).first()
            parameters = new
            if moved["d"] is None:
                break
            mass = sum(moved[f"p{t}"] for t in range(n))
            prior = [moved[f"p{t}"] / mass for t in range(n)]
            if moved["d"] < self.tolerance:
                break
        self.parameters, self.prior = parameters, prior
        return self

    def items(self) -> DataFrame:
        """Per item: verdict, confidence, agreement, reviewers.

        ``agreement`` is the share of pairs of its reviewers with equal verdicts (null for one
        reviewer); ties of confidence go to the label that comes first.
        """
        n = len(self.labels)
        rows = self._posterior(self.parameters.select("annotator", "competence", "guesses"), self.prior)
        one = rows.groupBy(*self.items_by).agg(*[F.first(f"q{t}").alias(f"q{t}") for t in range(n)], *[F.sum((F.col("y") == t).cast("int")).alias(f"c{t}") for t in range(n)], F.count("*").alias("reviewers"))
        best = F.greatest(*[F.col(f"q{t}") for t in range(n)])
        verdict = F.coalesce(*[F.when(F.col(f"q{t}") >= F.col("confidence"), F.lit(self.labels[t])) for t in range(n)])
        same = _total([F.col(f"c{t}") * (F.col(f"c{t}") - 1) for t in range(n)])
        pairs = F.col("reviewers") * (F.col("reviewers") - 1)
        return one.withColumn("confidence", best).select(*self.items_by, verdict.alias("verdict"), "confidence", F.when(pairs > 0, same / pairs).alias("agreement"), "reviewers")

    def annotators(self) -> DataFrame:
        """Per reviewer: competence (chance of a truthful verdict), accuracy (expected share of right ones), votes, guesses."""
        return self.parameters.select("annotator", "competence", "accuracy", "votes", "guesses")


def _expected(who: np.ndarray, y: np.ndarray, sizes: np.ndarray, competence: np.ndarray, guesses: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of every item, and of every vote the chances that it is right and that it was truthful)."""
    c = competence[who]
    spam = (1 - c)[:, None] * guesses[who]
    at = np.arange(len(who))
    like = np.log(spam[at, y] + _TINY)[:, None] * np.eye(guesses.shape[1])[y]  # of a wrong truth a vote tells by guess only
    own = np.log(c + spam[at, y] + _TINY)
    item = np.repeat(np.arange(len(sizes)), sizes)
    total = np.bincount(item, weights=like.sum(1), minlength=len(sizes))[:, None] + np.zeros(guesses.shape[1])
    np.add.at(total, (item, y), own - like.sum(1))
    total += np.log(prior + _TINY)
    q = np.exp(total - total.max(1, keepdims=True))
    q /= q.sum(1, keepdims=True)
    right = q[item, y]
    return q, right, right * c / (c + spam[at, y] + _TINY)


def _votes_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    who, y = (batch.column(c) for c in ("who", "what"))
    sizes = np.diff(who.offsets.to_numpy(zero_copy_only=False))
    return who.flatten().to_numpy(zero_copy_only=False), y.flatten().to_numpy(zero_copy_only=False), sizes


class Compact(Consensus):
    """The same mixture with one row per item and the annotators' properties on the driver; for up to ``MOST_SENT`` annotators."""

    def __init__(self, votes: DataFrame, labels: Sequence[str], iterations: int, tolerance: float, names: Sequence[str]):
        self.labels, self.names = list(labels), list(names)
        self.items_by = [c for c in votes.columns if c not in ("annotator", "label")]
        self.spark = votes.sparkSession
        index = self.spark.createDataFrame(pa.table({"annotator": pa.array(self.names, pa.string()), "at": pa.array(range(len(self.names)), pa.int32())}))
        label = reduce(lambda e, i: e.when(F.col("label") == self.labels[i], i), range(1, len(labels)), F.when(F.col("label") == labels[0], 0))
        coded = votes.join(F.broadcast(index), "annotator").select(*self.items_by, "at", label.alias("y"))  # at most MOST_SENT names
        pairs = F.array_sort(F.collect_list(F.struct("at", "y")))
        rows = coded.groupBy(*self.items_by).agg(pairs.alias("v"))
        self.rows = cut_lineage(rows.select(*self.items_by, F.col("v.at").alias("who"), F.col("v.y").alias("what")))
        self.iterations, self.tolerance = iterations, tolerance
        self.rounds, self.moved = 0, float("nan")

    def _sums(self, competence: np.ndarray, guesses: np.ndarray, prior: np.ndarray) -> np.ndarray:
        """Per annotator: votes, truthful ones, right ones, guessed ones by label, and the items' posteriors by label."""
        n, m = len(self.labels), len(self.names)
        given = self.spark.sparkContext.broadcast((competence, guesses, prior))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((3 + 2 * n, m))
            for batch in batches:
                who, y, sizes = _votes_of(batch)
                if not len(who):
                    continue
                q, right, honest = _expected(who, y, sizes, *given.value)
                out[0] += np.bincount(who, minlength=m)
                out[1] += np.bincount(who, weights=honest, minlength=m)
                out[2] += np.bincount(who, weights=right, minlength=m)
                np.add.at(out[3 : 3 + n], (y, who), 1 - honest)
                share = np.repeat(q / sizes[:, None], sizes, axis=0)
                for t in range(n):
                    out[3 + n + t] += np.bincount(who, weights=share[:, t], minlength=m)
            some = np.flatnonzero(out[0])
            yield pa.record_batch([pa.array(some, pa.int32()), *[pa.array(x[some]) for x in out]], names=["at", *[f"x{i}" for i in range(len(out))]])

        names = [f"x{i}" for i in range(3 + 2 * n)]
        parts = self.rows.select("who", "what").mapInArrow(run, "at int, " + ", ".join(f"{x} double" for x in names))
        got = parts.groupBy("at").agg(*[F.sum(x).alias(x) for x in names]).toArrow()  # one row per annotator
        given.destroy()
        out = np.zeros((len(names), m))
        out[:, got.column("at").to_numpy()] = [got.column(x).to_numpy() for x in names]
        return out

    def fit(self) -> Compact:
        n, m = len(self.labels), len(self.names)
        self.prior = np.full(n, 1 / n)
        self.competence, self.guesses = np.full(m, 0.7), np.full((m, n), 1 / n)
        self.votes_of, self.accuracy = np.zeros(m), np.zeros(m)
        for self.rounds in range(1, self.iterations + 1):
            if not m:
                break
            votes, true, hits, *rest = self._sums(self.competence, self.guesses, self.prior)
            was, self.competence = self.competence, (true + 1) / (votes + 2)
            spam = np.array(rest[:n]).T + 0.5
            self.guesses = spam / spam.sum(1, keepdims=True)
            mass = np.array(rest[n:]).sum(1)
            self.prior = mass / mass.sum()
            self.votes_of, self.accuracy = votes, hits / votes
            self.moved = float(np.abs(self.competence - was).max())
            if self.moved < self.tolerance:
                break
        return self

    def items(self) -> DataFrame:
        n = len(self.labels)
        given = self.spark.sparkContext.broadcast((self.competence, self.guesses, self.prior))
        labels, by = self.labels, self.items_by

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                who, y, sizes = _votes_of(batch)
                q = _expected(who, y, sizes, *given.value)[0] if len(who) else np.zeros((0, n))
                counts = np.zeros((len(sizes), n))
                np.add.at(counts, (np.repeat(np.arange(len(sizes)), sizes), y), 1)
                pairs = sizes * (sizes - 1.0)
                agreement = np.divide((counts * (counts - 1)).sum(1), pairs, out=np.zeros(len(sizes)), where=pairs > 0)
                verdict = pa.array([labels[i] for i in q.argmax(1)], pa.string())
                columns = [verdict, pa.array(q.max(1) if len(q) else []), pa.array(agreement, mask=pairs == 0), pa.array(sizes, pa.int64())]
                yield pa.record_batch([*[batch.column(c) for c in by], *columns], names=[*by, "verdict", "confidence", "agreement", "reviewers"])

        kinds = dict(self.rows.dtypes)
        schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "verdict string, confidence double, agreement double, reviewers long"])
        return self.rows.mapInArrow(run, schema)

    def annotators(self) -> DataFrame:
        columns = {"annotator": pa.array(self.names, pa.string()), "competence": pa.array(self.competence), "accuracy": pa.array(self.accuracy), "votes": pa.array(self.votes_of.astype(np.int64)), "guesses": pa.array(self.guesses.tolist(), pa.list_(pa.float64()))}
        return self.spark.createDataFrame(pa.table(columns))


def consensus(votes: DataFrame, labels: Sequence[str] = VERDICTS, iterations: int = 50, tolerance: float = 1e-3, most_sent: int = MOST_SENT) -> Consensus:
    """Fit the mixture on (item columns..., annotator, label), one row per item and annotator.

    An empty table gives empty results.  With more than ``most_sent`` annotators the parameters stay a
    table.  ``rounds`` of the result tells how many iterations it took; fewer than ``iterations`` means
    that no competence moved by ``tolerance`` in the last.
    """
    names = [r[0] for r in votes.select("annotator").distinct().limit(most_sent + 1).collect()]
    if len(names) > most_sent:
        return Consensus(votes, labels, iterations, tolerance).fit()
    return Compact(votes, labels, iterations, tolerance, sorted(names)).fit()
