"""Progress of runs from their events, as a table or as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENT_TYPES = ("run_started", "book_started", "book_completed", "book_failed", "run_completed", "run_failed")


def progress_fraction(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(done / total, F.lit(1.0))).otherwise(F.lit(0.0))


# The status that an event of a type sets; others keep it.
STATUS = {"run_started": "running", "run_completed": "completed", "book_failed": "failed", "run_failed": "failed"}


def fold_events(events: DataFrame) -> DataFrame:
    """State of each run (run_id) after its events (seq, type, book_name, total_books, error), by seq.

    A later run_started of the same run begins anew; a run_completed completes all books, and the progress is 1.0 until
    another event of a book or a start. A failed book or run sets the status to failed, a failed book adds nothing to the
    progress. Before any such event a run is idle. total_books is the last one named before a run failed. On tables the
    events are counted in a second aggregate after the run's last start and end are known, so a run may hold much of the
    table; on streams, in update or complete mode, ``marks`` holds one small struct an event as state.
    """
    known = events.where(F.col("type").isin(*EVENT_TYPES))
    is_type = F.col("type")
    status = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])[is_type]
    moves = is_type != "run_failed"
    named = F.col("total_books").isNotNull() & moves
    marks = [F.collect_list(F.struct("seq", "type", "total_books")).alias("marks")] if events.isStreaming else []
    heads = known.groupBy("run_id").agg(
        F.max(F.when(is_type == "run_started", F.col("seq"))).alias("started_at"),
        F.max(F.when(is_type == "run_completed", F.col("seq"))).alias("finished_at"),
        F.max_by("total_books", F.when(named, F.col("seq"))).alias("total_books"),
        F.max_by("type", F.when(moves, F.col("seq"))).alias("moved"),
        F.max_by(F.struct("type", "book_name", "error"), "seq").alias("last"),
        F.max_by(status, F.when(status.isNotNull(), F.col("seq"))).alias("status"),
        F.max("seq").alias("last_seq"),
        *marks,
    )
    start = F.coalesce("started_at", F.lit(-(1 << 63)))
    ended = F.coalesce(F.col("finished_at") > start, F.lit(False))
    heads = heads.withColumns({"start": start, "ended": ended, "since": F.when(ended, F.col("finished_at")).otherwise(start)})
    if events.isStreaming:

        def after(kind: str, seq: str) -> Column:
            return F.size(F.filter("marks", lambda e: (e["type"] == kind) & (e["seq"] > F.col(seq)))).cast("bigint")

        whole = F.array_max(
            F.filter("marks", lambda e: e["total_books"].isNotNull() & (e["type"] != "run_failed") & (e["seq"] <= F.col("finished_at")))
        )["total_books"]
        counted = heads.withColumns({"done": after("book_completed", "since"), "failed_books": after("book_failed", "start"), "whole": whole})
    else:
        bounds = heads.select("run_id", "start", "since", "finished_at")
        sums = known.select("run_id", "seq", "type", "total_books").join(bounds, "run_id").groupBy("run_id").agg(
            F.count_if((is_type == "book_completed") & (F.col("seq") > F.col("since"))).alias("done"),
            F.count_if((is_type == "book_failed") & (F.col("seq") > F.col("start"))).alias("failed_books"),
            F.max_by("total_books", F.when(named & (F.col("seq") <= F.col("finished_at")), F.col("seq"))).alias("whole"),
        )
        counted = heads.join(sums, "run_id")
    zero = F.lit(0)
    counted = counted.withColumn("completed_books", F.when(F.col("ended"), F.coalesce("whole", zero)).otherwise(zero) + F.col("done"))
    total = F.coalesce("total_books", zero)
    progress = (
        F.when(F.col("moved") == "run_completed", F.lit(1.0))
        .when(F.coalesce(F.col("moved") == "run_started", F.lit(False)), F.lit(0.0))
        .otherwise(progress_fraction(F.col("completed_books"), total))
    )
    return counted.select(
        "run_id", F.coalesce("status", F.lit("idle")).alias("status"), total.alias("total_books"), "completed_books", "failed_books",
        F.col("last.type").alias("last_type"), F.col("last.book_name").alias("current_book"), F.col("last.error").alias("last_error"), "last_seq",
        progress.alias("progress"),
    )


def event_windows(events: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events counted by type in tumbling windows; later than ``late`` behind the newest they no longer count in a stream."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    return marked.groupBy(F.window(time, width).alias("w"), F.col(kind).alias("event_type")).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("window_start"), "event_type", "n"
    )
