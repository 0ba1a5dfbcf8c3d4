"""Human and machine-readable forms of results, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.operators.rules import ISSUE_CODES

PREVIEW = 72


def issue_lines(issues: DataFrame) -> DataFrame:
    """One printed line per issue."""
    mark = F.when(F.col("severity") == "warning", "warning: ").otherwise("")
    return issues.withColumn("line", F.concat("id", F.lit(": "), mark, "code", F.lit(": "), "message"))


def candidate_label(position: Column) -> Column:
    """a to z for the first 26, then the ordinal number."""
    return F.when(position < 26, F.char(position + 97)).otherwise((position + 1).cast("string"))


def preview(x: Column) -> Column:
    """The first ``PREVIEW`` characters, with an ellipsis if there are more."""
    return F.when(F.length(x) > PREVIEW, F.concat(F.substring(x, 1, PREVIEW), F.lit("…"))).otherwise(x)


def proposal_lines(accepted: DataFrame) -> DataFrame:
    """(id, claim, rank, line): commented lines of the proposals."""
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("id", "claim").orderBy("rank")) - 1
    line = F.concat(F.lit("# "), candidate_label(F.col("at")), F.format_string(" (%d/%d) page %d: ", "matched", "n_required", "found_page"), preview(F.col("exact")))
    return accepted.withColumn("at", at).select("id", "claim", "rank", line.alias("line"))


def located_record(rows: DataFrame, claim_term: str = "claim") -> DataFrame:
    """(id, record): the evidence record of located literals as JSON, in the configured vocabulary."""
    md = F.struct("line", F.col("col").alias("column"), "unit", F.when(F.size("section") > 0, F.col("section")).alias("section"))
    locator = F.struct("source", "exact", F.when(F.col("line").isNotNull(), md).alias("markdown"), F.struct("page", "backend").alias("pdf"), *(["bbox"] if "bbox" in rows.columns else []))
    return rows.select("id", F.to_json(F.struct(F.col("claim").alias(claim_term), F.col("claim_sha256").alias(f"{claim_term}_sha256"), F.array(locator).alias("locators"))).alias("record"))


def code_table(spark: SparkSession) -> DataFrame:
    """(code, exit_code, description) of every issue."""
    return spark.createDataFrame([(c, e, d) for c, (e, d) in sorted(ISSUE_CODES.items())], "code string, exit_code int, description string")


def doctor(spark: SparkSession, rows: list[tuple[str, bool, str]]) -> DataFrame:
    """(check, ok, detail): the state of the environment."""
    return spark.createDataFrame(rows, "check string, ok boolean, detail string")
