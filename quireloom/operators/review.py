"""Findings of two reviewers merged by key, and the choice among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireloom.functions import predicates as P
from quireloom.functions.extract import finding_key

LOW_CONFIDENCE = 0.6
#: What two findings of one key must share to be the same finding.
SAME = ("chapter_id", "block_id", "finding_type", "severity", "identity", "auto_fixable")


def with_key(findings: DataFrame) -> DataFrame:
    """Findings with ``finding_key`` and the ``identity`` that ends it."""
    key = finding_key("chapter_id", "block_id", "finding_type", "source_signature", "source_excerpt")
    return findings.withColumn("finding_key", key).withColumn("identity", F.substring_index("finding_key", "|", -1))


def one_of_each(findings: DataFrame, order: str) -> DataFrame:
    """One finding for each key: the last by ``order``."""
    columns = [c for c in findings.columns if c != "finding_key"]
    return findings.groupBy("finding_key").agg(F.max_by(F.struct(*columns), order).alias("f")).select("finding_key", "f.*")


def fail_on_duplicates(findings: DataFrame, role: str) -> DataFrame:
    """The findings; running the plan fails where a key occurs twice."""
    n = F.count("*").over(Window.partitionBy("finding_key"))
    said = F.concat(F.lit(f"Duplicate {role} finding for consensus key: "), F.col("finding_key"))
    return findings.withColumn("__n", n).where(F.when(F.col("__n") > 1, F.raise_error(said).cast("boolean")).otherwise(F.lit(True))).drop("__n")


def merge_findings(audit: DataFrame, review: DataFrame, low: float = LOW_CONFIDENCE) -> DataFrame:
    """A row for each key of either side: ``finding_key``, structs ``audit`` and ``review``, and ``bucket``.

    low_confidence: either side below ``low``, or only one side there; agreed: both sides the same; else disputed.
    A null confidence is not low. Inputs hold one row for each key (see fail_on_duplicates, one_of_each).
    """
    fields = [c for c in audit.columns if c != "finding_key"]
    left = audit.select("finding_key", F.struct(*fields).alias("audit"))
    right = review.select("finding_key", F.struct(*fields).alias("review"))
    unsure = F.coalesce(F.col("audit.confidence") < low, F.lit(False)) | F.coalesce(F.col("review.confidence") < low, F.lit(False))
    both = F.col("audit").isNotNull() & F.col("review").isNotNull()
    bucket = (
        F.when(unsure | ~both, "low_confidence").when(P.same_finding("audit", "review", SAME), "agreed").otherwise("disputed")
    )
    return left.join(right, "finding_key", "full_outer").withColumn("bucket", bucket)


def preferred(audit: Column, review: Column) -> Column:
    """The finding of higher confidence, the review's at a tie."""
    takes_audit = audit.isNotNull() & (
        review.isNull() | (F.coalesce(audit["confidence"], F.lit(-1.0)) > F.coalesce(review["confidence"], F.lit(-1.0)))
    )
    return F.when(takes_audit, audit).otherwise(review)


def arbitration_queue(merged: DataFrame) -> DataFrame:
    return merged.where("bucket = 'disputed'").orderBy("finding_key")


def fix_candidates(merged: DataFrame, arbiter: DataFrame) -> DataFrame:
    """Fixable findings: the arbiter's, and the preferred ones of agreed keys that the arbiter has none for."""
    agreed = merged.where("bucket = 'agreed'").select(
        "finding_key", preferred(F.col("audit"), F.col("review")).alias("finding"), F.lit(0).alias("rank")
    )
    fields = [f.name for f in agreed.schema["finding"].dataType]
    decided = arbiter.select("finding_key", F.struct(*fields).alias("finding"), F.lit(1).alias("rank"))
    fixable = agreed.unionByName(decided).where("finding.auto_fixable")
    return fixable.groupBy("finding_key").agg(F.max_by("finding", "rank").alias("finding")).select("finding_key", "finding.*")


def arbiter_choice(audit: Column, review: Column) -> Column:
    """The one side there is; of two the review's if it is fixable and as sure as the audit's, else the audit's."""
    sure = review["auto_fixable"] & (review["confidence"] >= audit["confidence"])
    return F.when(audit.isNull(), review).when(review.isNull(), audit).when(sure, review).otherwise(audit)


def fallback_choice(audit: Column, review: Column) -> Column:
    """The fixable review, else the fixable audit, else null."""
    return F.when(review["auto_fixable"], review).when(audit["auto_fixable"], audit)
