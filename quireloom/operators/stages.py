"""Which stages of a resumed run have to run again: fingerprints of what went in, compared with what was recorded."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quireloom.functions.text import payload_fingerprint


def input_fingerprints(parts: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """``keys`` and the fingerprint of their values in order; nulls count, the order of rows does not.

    The digests of the values are gathered, not the values.
    """
    digest = F.sha2(F.coalesce(F.col(value).cast("string"), F.lit("\x00")), 256)
    held = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), digest.alias("d"))))
    return parts.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(held, lambda x: x["d"]), "|"), 256).alias("fingerprint"))


def stale_stages(wanted: DataFrame, recorded: DataFrame) -> DataFrame:
    """Stages of books (book_id, stage, stage_no, fingerprint) with ``stale`` and ``runs``.

    recorded: book_id, stage, status, fingerprint. A stage is stale when it was never recorded, is not complete, or had
    another fingerprint; it and all behind it run again, as what they read is cleared.
    """
    held = recorded.select("book_id", "stage", F.col("status").alias("__status"), F.col("fingerprint").alias("__was"))
    fresh = (F.col("__status") == "complete") & F.col("__was").eqNullSafe(F.col("fingerprint"))
    marked = wanted.join(held, ["book_id", "stage"], "left").withColumn("stale", ~F.coalesce(fresh, F.lit(False)))
    before = Window.partitionBy("book_id").orderBy("stage_no").rowsBetween(Window.unboundedPreceding, 0)
    return marked.select("book_id", "stage", "stage_no", "fingerprint", "stale", F.max("stale").over(before).alias("runs"))


#: What a run must share with the recorded one to be resumed.
RESUMED = ("source_fingerprint", "provider", "model", "config_fingerprint")


def resume_compatible(run: DataFrame, manifest: DataFrame) -> DataFrame:
    """``book_id`` of each run, ``compatible``, and the names of what differs; without a manifest nothing is to resume."""
    held = manifest.select("book_id", *[F.col(c).alias(f"__{c}") for c in RESUMED], F.lit(True).alias("__there"))
    differs = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), F.lit(c)) for c in RESUMED]))
    there = F.coalesce("__there", F.lit(False))
    return run.join(held, "book_id", "left").select(
        "book_id", (there & (F.size(differs) == 0)).alias("compatible"), F.when(there, differs).alias("differs")
    )


__all__ = ["input_fingerprints", "payload_fingerprint", "resume_compatible", "stale_stages"]
