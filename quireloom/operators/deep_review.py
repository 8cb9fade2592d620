"""The review of whole chapters as one plan: audit, structure, second audit, merge, repair, third audit, annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quireloom.functions import predicates as P
from quireloom.functions.text import strip
from quireloom.operators.assembly import blocks_to_text
from quireloom.operators.audit import audit_pairs
from quireloom.operators.editorial import repair_blocks, text_to_blocks
from quireloom.operators.layout import layout_annotations
from quireloom.operators.review import arbiter_choice, fail_on_duplicates, fallback_choice, fix_candidates, merge_findings, with_key
from quireloom.plans.staging import stage


def match_sources(artifacts: DataFrame, sources: DataFrame) -> DataFrame:
    """Artifacts (book_id, chapter_id, chapter_index, text) with the source of their id, else of their index in the book.

    source_id, source_text and source_title are null where there is neither.
    """
    kept = sources.select("book_id", "chapter_id", "chapter_index", "title", "text").distinct()
    fields = F.struct(F.col("chapter_id").alias("id"), "title", "text").alias("s")
    by_id = kept.groupBy("book_id", "chapter_id").agg(F.max_by(F.struct(F.col("chapter_id").alias("id"), "title", "text"), "chapter_index").alias("by_id"))
    last = F.row_number().over(Window.partitionBy("book_id", "chapter_index").orderBy(F.desc("chapter_id")))
    by_index = kept.withColumn("__n", last).where("__n = 1").select("book_id", "chapter_index", fields).withColumnRenamed("s", "by_index")
    joined = artifacts.join(by_id, ["book_id", "chapter_id"], "left").join(by_index, ["book_id", "chapter_index"], "left")
    source = F.coalesce("by_id", "by_index")
    return joined.select(
        *artifacts.columns, source["id"].alias("source_id"), source["title"].alias("source_title"), source["text"].alias("source_text")
    )


def _keyed(findings: DataFrame) -> DataFrame:
    return with_key(findings.withColumn("block_id", F.lit(None).cast("string")))


def arbitrate(merged: DataFrame, candidates: DataFrame) -> DataFrame:
    """The arbiter's fixable finding of each disputed key, in the form of ``candidates``.

    candidates: the findings of a third look. A disputed key that it meets again gets the arbiter's choice of the two
    sides, any other, or one whose choice cannot be fixed, the fallback.
    """
    fields = [c for c in candidates.columns if c != "finding_key"]
    seen = candidates.select("finding_key").distinct().withColumn("seen", F.lit(True))
    audit, review = F.col("audit"), F.col("review")
    chosen = F.when(F.col("seen"), arbiter_choice(audit, review))
    found = merged.where("bucket = 'disputed'").join(seen, "finding_key", "left").select(
        "finding_key", F.when(chosen["auto_fixable"], chosen).otherwise(fallback_choice(audit, review)).alias("f")
    )
    return found.where("f.auto_fixable").select("finding_key", *[F.col(f"f.{c}").alias(c) for c in fields]).withColumn("agent_role", F.lit("arbiter"))


def deep_review(artifacts: DataFrame, sources: DataFrame, cross_review: bool = True, depth: str = "consensus") -> dict[str, DataFrame]:
    """Tables of a review: ``findings``, ``review``, ``merged``, ``arbiter``, ``fixes``, ``confirmation``, ``chapters``,
    ``annotations``, ``report``.

    artifacts: one row for each chapter_id. A chapter without a source gets one finding of its own and keeps its text.
    Without ``cross_review``, or at another ``depth`` than 'consensus', nobody looks a second time: ``review``, ``merged``
    and ``arbiter`` are empty and all fixable findings of the audit are repaired.
    """
    crossed = cross_review and depth == "consensus"
    paired = stage(match_sources(artifacts, sources), "pairs")
    matched, lost = paired.where("source_id IS NOT NULL"), paired.where("source_id IS NULL")

    def audit(texts: DataFrame) -> DataFrame:
        return audit_pairs(texts.select("chapter_id", "source_title", "source_text", F.col("text").alias("target_text")), ["chapter_id"])

    first = stage(_keyed(audit(matched)), "audit")
    blocks = stage(text_to_blocks(matched.select("chapter_id", "text", "source_text")), "blocks")
    sides = matched.select("chapter_id", "source_title", "source_text")
    if crossed:
        # The arbiter looks at the same texts as the second audit, whose findings are therefore its candidates.
        second = stage(_keyed(audit(blocks_to_text(blocks).join(sides, "chapter_id"))), "second")
        merged = stage(merge_findings(fail_on_duplicates(first, "audit"), fail_on_duplicates(second, "review")), "merged")
        arbiter = stage(arbitrate(merged, second), "arbiter")
        fixes = stage(fix_candidates(merged, arbiter), "fixes")
    else:
        second = arbiter = first.where("false")
        merged = merge_findings(second, second)
        fixes = first.where("auto_fixable")
    final = stage(blocks_to_text(repair_blocks(blocks)), "final")
    third = stage(_keyed(audit(final.join(sides, "chapter_id"))), "third")
    missing = lost.select(
        "chapter_id", F.lit("missing_source_chapter").alias("finding_type"), F.lit("high").alias("severity"),
        F.lit("").alias("source_excerpt"), F.substring(F.coalesce("text", F.lit("")), 1, 180).alias("target_excerpt"),
        F.lit("Source chapter could not be matched during deep review.").alias("reason"), F.lit(False).alias("auto_fixable"),
        F.lit(0.5).alias("confidence"), F.lit(None).cast("string").alias("source_signature"), F.lit("audit").alias("agent_role"),
    )
    findings = first.unionByName(_keyed(missing))
    blocking = third.unionByName(_keyed(missing))
    texts = matched.select("book_id", "chapter_id", "chapter_index", "text").join(
        final.withColumnRenamed("text", "final_text"), "chapter_id", "left"
    )
    chapters = texts.select(
        "book_id", "chapter_id", "chapter_index", F.coalesce("final_text", F.lit("")).alias("text"),
        (~F.coalesce("final_text", F.lit("")).eqNullSafe(F.coalesce("text", F.lit("")))).alias("revised"),
    ).unionByName(lost.select("book_id", "chapter_id", "chapter_index", strip("text").alias("text"), F.lit(False).alias("revised")))
    counted = blocking.groupBy("chapter_id").agg(F.count("*").alias("n_unresolved"))
    chapters = chapters.join(counted, "chapter_id", "left").withColumn("n_unresolved", F.coalesce("n_unresolved", F.lit(0)))
    # Annotations follow the fixes of a chapter, or its first findings where nothing is to be fixed.
    chosen = fixes.select("chapter_id", "finding_key", "finding_type", "target_excerpt", "source_excerpt", "reason")
    rest = first.join(chosen.select("chapter_id").distinct(), "chapter_id", "left_anti").select(*chosen.columns)
    annotations = layout_annotations(
        chosen.unionByName(rest).withColumnRenamed("finding_key", "ord"),
        final.join(sides.select("chapter_id", "source_text"), "chapter_id"),
    )
    report = blocking.agg(
        F.count("*").alias("unresolved_count"),
        F.count_if(F.col("severity") == "high").alias("high_severity_count"),
        F.count_if(F.col("finding_type") == "missing_source_chapter").alias("missing_source_count"),
        F.count_if(P.is_structural("finding_type")).alias("structural_issue_count"),
        F.count_if(P.is_citation("finding_type")).alias("citation_issue_count"),
        F.count_if(P.is_about_images("finding_type")).alias("image_or_caption_issue_count"),
    )
    buckets = merged.agg(*[F.count_if(F.col("bucket") == b).alias(f"{b}_count") for b in ("agreed", "disputed", "low_confidence")])
    for name, table in (("source_finding", findings), ("review_finding", second), ("arbiter_finding", arbiter), ("confirmation_finding", third),
                        ("annotation", annotations), ("revised_chapter", chapters.where("revised"))):
        report = report.join(table.agg(F.count("*").alias(f"{name}_count")))
    report = report.join(buckets).withColumn("audit_depth", F.lit(depth)).withColumn("cross_review_enabled", F.lit(crossed))
    return {
        "findings": findings, "review": second, "merged": merged, "arbiter": arbiter, "fixes": fixes, "confirmation": third,
        "chapters": chapters, "annotations": annotations, "report": report,
    }
