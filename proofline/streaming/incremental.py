"""Incremental checks: summaries that arrive are checked batch by batch."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from proofline.operators.corpus import Corpus
from proofline.plans.check import check
from proofline.sources.config import Config


def check_stream(arrivals: DataFrame, corpus: Corpus, cfg: Config, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Check the summaries of every micro-batch against the corpus and append their issues to ``out``.

    ``arrivals`` is a streaming table like corpus.summaries.  Rows of one id within a batch count once.
    A batch that is run again overwrites its own part, so issues are written exactly once.
    """

    def run(batch: DataFrame, number: int) -> None:
        new = batch.dropDuplicates(["id"]).persist()
        ids = new.select("id")
        part = replace(corpus, summaries=new, entries=corpus.entries.join(ids, "id", "left_semi"), locators=corpus.locators.join(ids, "id", "left_semi"), reviews=corpus.reviews.join(ids, "id", "left_semi"))
        check(part, cfg).issues.write.mode("overwrite").parquet(f"{out}/batch={number}")
        new.unpersist()

    writer = arrivals.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
