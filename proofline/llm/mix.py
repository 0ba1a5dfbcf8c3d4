"""Mixing sources to target shares of the total size.

Every record gets a random key from a hash of its id, so the order within a source is random and the
same in every run.  The keys' range is cut into slices that grow in number with the data; sums per
(source, slice) are pre-aggregated, their running totals are formed over that small table, and only
within a slice are single records summed.  No source, however large, is ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofline.session import cut_lineage

SLICE_ROWS = 20_000  # records of a slice, on average, if all were of one source


def plan_shares(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """The budget of every source.

    ``sizes`` has source, records, size; ``targets`` source, target_share, max_repeats.  A source of
    only one of them takes part with size or share 0.  Shares of sources with nothing to give are
    spread over the others in proportion.  Without ``total`` the mixture is the largest in which every
    source can give its share within its repeats; with a larger ``total`` a source that cannot gives
    all it has and stays short of its share.  The table has one row per source.
    """
    named = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    plan = sizes.join(named, sizes["source"].eqNullSafe(named["source"]), "full").select(
        F.coalesce(sizes["source"], named["source"]).alias("source"),
        F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("size", F.lit(0)).alias("size"),
        F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("max_repeats"),
    )
    able = (F.col("size") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    every = Window.partitionBy()  # one row per source: as many rows as there are sources
    plan = plan.withColumn("usable_share", F.when(able, F.col("target_share")).otherwise(0.0))
    plan = plan.withColumn("share", F.when(able, F.col("usable_share") / F.sum("usable_share").over(every)).otherwise(0.0))
    most = F.when(F.col("share") > 0, F.col("size") * F.col("max_repeats") / F.col("share"))
    whole = F.lit(float(total)) if total is not None else F.coalesce(F.min(most).over(every), F.lit(0.0))
    budget = F.floor(F.least(F.col("share") * F.col("whole"), F.col("size").cast("double") * F.col("max_repeats")) + 1e-6).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("budget", budget)
    epochs = F.when(F.col("size") > 0, F.floor(F.col("budget") / F.col("size"))).otherwise(0).cast("int")
    return plan.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("size")).select(
        "source", "records", "size", "target_share", "max_repeats", "share", "budget", "epochs", "rest"
    )


def mix(sized: DataFrame, targets: DataFrame, key: str = "doc_id", total: float | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(mixture, plan): every record with the number of its copies, and the budgets they were cut at.

    ``sized`` has ``key`` (long), source and size (0 or more; null counts as 0), one row per record.
    The mixture has ``key``, source, size, copies: one row per used record, 1 or more copies, at most
    max_repeats of its source.  All records of a source are used ``epochs`` times; one more copy goes to
    the first ones in random order whose running size stays within the rest of the budget (if its repeats
    allow it), and to the one record after them whose size comes nearest to what is still missing.
    Records of size 0 and sources without a target are not used.
    """
    rows = sized.select(F.col(key).alias(key), "source", F.coalesce("size", F.lit(0)).cast("long").alias("size")).where("size > 0")
    sizes = rows.groupBy("source").agg(F.count("*").alias("records"), F.sum("size").alias("size"))
    plan = plan_shares(sizes, targets, total)
    n = rows.count()
    slices = max(1, -(-n // SLICE_ROWS))
    random = F.xxhash64(F.lit(seed), key)
    rows = rows.withColumn("order", random).withColumn("slice", F.floor((F.col("order").cast("double") / 2.0**64 + 0.5) * slices).cast("int"))
    heads = rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("source", "slice", F.coalesce(F.sum("slice_size").over(before), F.lit(0)).alias("ahead"))
    budgets = plan.where("budget > 0").select(F.col("source").alias("of"), "epochs", "rest", "max_repeats")
    heads = heads.join(budgets, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumnsRenamed({"source": "h_source", "slice": "h_slice"})
    within = Window.partitionBy("source", "slice").orderBy("order", key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(heads, F.col("source").eqNullSafe(F.col("h_source")) & (F.col("slice") == F.col("h_slice")))
    end = F.col("ahead") + F.sum("size").over(within)
    rows = cut_lineage(rows.select(key, "source", "size", "order", "epochs", "rest", "max_repeats", end.alias("end")))
    inside = F.col("end") <= F.col("rest")
    gaps = rows.where("epochs < max_repeats").groupBy(F.col("source").alias("g_source")).agg((F.max("rest") - F.max(F.when(inside, F.col("end")).otherwise(0))).alias("gap"))
    fill = (
        rows.where(~inside & (F.col("epochs") < F.col("max_repeats")))
        .join(gaps, F.col("source").eqNullSafe(F.col("g_source")))
        .withColumn("miss", F.abs(F.col("size") - F.col("gap"))).where("miss < gap")
        .groupBy("source").agg(F.min(F.struct("miss", "order", key)).alias("best"))
        .select(F.col("source").alias("f_source"), F.col(f"best.{key}").alias("f_key"))
    )
    rows = rows.join(fill, F.col("source").eqNullSafe(F.col("f_source")) & F.col(key).eqNullSafe(F.col("f_key")), "left")
    more = (F.col("epochs") < F.col("max_repeats")) & (inside | F.col("f_source").isNotNull() | F.col("f_key").isNotNull())
    copies = F.col("epochs") + F.when(more, 1).otherwise(0)
    return rows.select(key, "source", "size", copies.alias("copies")).where("copies > 0"), plan


def shares(mixture: DataFrame, plan: DataFrame) -> DataFrame:
    """What was reached: per source its target, the share and size used, the records, and how often one is used at most."""
    used = mixture.groupBy("source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("used"), F.count("*").alias("records_used"), F.max("copies").alias("most_copies")
    ).withColumnRenamed("source", "u_source")
    total = F.sum(F.coalesce("used", F.lit(0))).over(Window.partitionBy())
    return plan.join(used, F.col("source").eqNullSafe(F.col("u_source")), "left").select(
        "source", "records", F.col("size").alias("size_available"), "target_share", "max_repeats", F.col("share").alias("feasible_share"), "budget",
        F.coalesce("used", F.lit(0)).alias("size_used"), F.coalesce("records_used", F.lit(0)).alias("records_used"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.when(total > 0, F.coalesce("used", F.lit(0)) / total).otherwise(0.0).alias("actual_share"),
    )
