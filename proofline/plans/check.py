"""Check and audit: all rules composed, rolled up per summary and in total."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.operators import legs as L
from proofline.operators import rules as R
from proofline.operators.corpus import Corpus
from proofline.session import cut_lineage
from proofline.sources.config import Config


@dataclass
class Checked:
    """issues (in R.ISSUE_COLUMNS) and legs of a corpus."""

    issues: DataFrame
    legs: DataFrame
    summaries: DataFrame

    def per_summary(self) -> DataFrame:
        """One row per summary: outcome ('missing' evidence, 'valid', 'invalid'), counts of errors, warnings, claims by legs."""
        counts = self.issues.groupBy("id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
        legs = self.legs.groupBy("id").agg(F.count("*").alias("entries"), F.count_if("corroborated").alias("corroborated"))
        rows = self.summaries.select("id", F.col("sources").isNull().alias("missing")).join(counts, "id", "left").join(legs, "id", "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
        outcome = F.when(F.col("missing"), "missing").when(F.coalesce("errors", F.lit(0)) > 0, "invalid").otherwise("valid")
        return rows.select("id", outcome.alias("outcome"), zero("errors"), zero("warnings"), zero("entries"), zero("corroborated"), (F.coalesce("entries", F.lit(0)) - F.coalesce("corroborated", F.lit(0))).alias("single_leg"))

    def report(self, targeted: bool = False) -> DataFrame:
        """One row of counters.  Bare checks skip summaries without evidence, targeted ones count them as invalid."""
        s = self.per_summary()
        bad = F.col("outcome").isin("invalid", "missing") if targeted else F.col("outcome") == "invalid"
        return s.agg(
            F.count_if(F.lit(targeted) | (F.col("outcome") != "missing")).alias("checked"), F.count_if(F.col("outcome") == "valid").alias("valid"), F.count_if(bad).alias("invalid"),
            F.count_if((F.col("outcome") == "missing") & ~F.lit(targeted)).alias("skipped"),
            F.coalesce(F.sum("corroborated"), F.lit(0)).alias("corroborated"), F.coalesce(F.sum("single_leg"), F.lit(0)).alias("single_leg"),
        )

    def audit(self) -> DataFrame:
        """One row: summaries valid, missing, invalid, and the issues shown (those of invalid summaries only)."""
        s = self.per_summary()
        return s.agg(
            F.count("*").alias("total"), F.count_if(F.col("outcome") == "valid").alias("valid"), F.count_if(F.col("outcome") == "missing").alias("missing"),
            F.count_if(F.col("outcome") == "invalid").alias("invalid"), F.coalesce(F.sum(F.when(F.col("outcome") == "invalid", F.col("errors") + F.col("warnings"))), F.lit(0)).alias("issues_shown"),
        )

    def audit_issues(self) -> DataFrame:
        """Issues of an audit: those of summaries that are not valid."""
        keep = self.per_summary().where("outcome <> 'valid'").select("id")
        return ordered(self.issues.join(keep, "id", "left_semi"))

    def failed(self, strict: bool = False) -> bool:
        s = self.per_summary()
        return not s.where(F.col("outcome").isin(*(["invalid", "missing"] if strict else ["invalid"]))).isEmpty()


def ordered(issues: DataFrame) -> DataFrame:
    """Issues in the order they are reported."""
    return issues.orderBy("id", "phase", "entry_ord", F.coalesce("locator", F.lit(-1)), "rule", "message")


def check(c: Corpus, cfg: Config | None = None, require_review: bool = False, parse_issues: DataFrame | None = None) -> Checked:
    """All rules over all summaries.  A summary without evidence has that one issue only."""
    cfg = cfg or Config()
    resolved, source_issues = R.resolved_sources(c, cfg)
    found = cut_lineage(R.resolve_locators(c, cfg, resolved))  # texts are normalised once, all rules read the counts
    legs = L.claim_legs(c, cfg, found)
    parts = [R.structure_issues(c, cfg), source_issues, R.locator_issues(found, cfg), *R.coverage_issues(c, cfg), *R.weak_issues(found, cfg), *L.single_leg_issues(legs, cfg), R.review_issues(c, cfg, require_review)]
    if parse_issues is not None:
        parts.append(parse_issues)
    return Checked(R.union(parts), legs, c.summaries)
