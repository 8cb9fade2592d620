"""Roll-ups of runs: counts, sums and means for each book and over all books."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireloom.functions import predicates as P
from quireloom.operators.assembly import latest_translations


def run_summary(chunks: DataFrame, translations: DataFrame, failed: DataFrame) -> DataFrame:
    """A row for each book: chunks, successes, failures, tokens, cost (6 places) and mean latency (3 places).

    Sums and successes are over the latest translation of each chunk id, including ids that no chunk has any more.
    """
    latest = latest_translations(translations)
    done = latest.groupBy("book_id").agg(
        F.count("*").alias("success_chunks"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        # Exact sums: a sum of doubles depends on the order of rows and may round either way.
        F.round(F.sum(F.col("estimated_cost_usd").cast("decimal(20,8)")), 6).cast("double").alias("cost_usd"),
        F.round(F.avg("latency_ms"), 3).alias("mean_latency_ms"),
    )
    total = chunks.groupBy("book_id").agg(F.countDistinct("chunk_id").alias("total_chunks"))
    lost = failed.groupBy("book_id").agg(F.countDistinct("chunk_id").alias("failed_chunks"))
    zero = F.lit(0)
    return (
        total.join(done, "book_id", "full_outer")
        .join(lost, "book_id", "full_outer")
        .select(
            "book_id",
            F.coalesce("total_chunks", zero).alias("total_chunks"),
            F.coalesce("success_chunks", zero).alias("success_chunks"),
            F.coalesce("failed_chunks", zero).alias("failed_chunks"),
            F.coalesce("input_tokens", zero).alias("input_tokens"),
            F.coalesce("output_tokens", zero).alias("output_tokens"),
            F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"),
            F.coalesce("mean_latency_ms", F.lit(0.0)).alias("mean_latency_ms"),
        )
    )


def run_details(chunks: DataFrame, translations: DataFrame) -> DataFrame:
    """A row for each book: chapters, provider and model of its last translation, seconds from its first to its last (3 places)."""
    total = chunks.groupBy("book_id").agg(F.countDistinct("chapter_id").alias("total_chapters"))
    at = F.col("written_at").cast("timestamp")
    seconds = (F.unix_micros(F.max(at)) - F.unix_micros(F.min(at))) / 1e6
    last = translations.groupBy("book_id").agg(
        F.max_by(F.struct("provider", "model"), "seq").alias("last"), F.round(seconds, 3).alias("duration_seconds")
    )
    return total.join(last, "book_id", "full_outer").select(
        "book_id", F.coalesce("total_chapters", F.lit(0)).alias("total_chapters"), F.col("last.provider").alias("provider"),
        F.col("last.model").alias("model"), F.coalesce("duration_seconds", F.lit(0.0)).alias("duration_seconds"),
    )


def overall(summaries: DataFrame) -> DataFrame:
    """One row over all books."""
    return summaries.agg(
        F.count("*").alias("books"), F.sum("success_chunks").alias("success_chunks"), F.sum("failed_chunks").alias("failed_chunks"),
        F.round(F.sum(F.col("cost_usd").cast("decimal(20,8)")), 6).cast("double").alias("cost_usd"),
    )


def finding_rollup(findings: DataFrame, by: str = "book_id") -> DataFrame:
    """Counts of findings by what they are about."""
    return findings.groupBy(by).agg(
        F.count("*").alias("n_findings"),
        F.count_if(F.col("finding_type") == "missing_source_chapter").alias("n_missing_source"),
        F.count_if(F.col("severity") == "high").alias("n_high"),
        F.count_if(P.is_structural("finding_type")).alias("n_structural"),
        F.count_if(P.is_citation("finding_type")).alias("n_citation"),
        F.count_if(P.is_about_images("finding_type")).alias("n_image_or_caption"),
        F.count_if(F.coalesce(F.col("confidence") < 0.6, F.lit(False))).alias("n_low_confidence"),
    )
