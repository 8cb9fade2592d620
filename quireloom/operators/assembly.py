"""Texts put together again: chunks with translations, blocks of chapters, chapters of books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireloom.functions.extract import ordered_marker
from quireloom.functions.text import strip

LIST_KINDS = ("ordered_item", "unordered_item")


def joined(order: str, text: Column, gap: str) -> Column:
    """Aggregate: texts in the order of a column, null texts left out."""
    pairs = F.sort_array(F.collect_list(F.when(text.isNotNull(), F.struct(F.col(order).alias("o"), text.alias("t")))))
    return F.array_join(F.transform(pairs, lambda x: x["t"]), gap)


def latest_translations(translations: DataFrame) -> DataFrame:
    """One row for each chunk id: the one of the highest seq."""
    others = [c for c in translations.columns if c not in ("chunk_id", "seq")]
    best = F.max_by(F.struct("seq", *others), "seq")
    return (
        translations.where("chunk_id IS NOT NULL")
        .groupBy("chunk_id")
        .agg(best.alias("r"))
        .select("chunk_id", *[F.col(f"r.{c}").alias(c) for c in ("seq", *others)])
    )


def completed_chunks(translations: DataFrame) -> DataFrame:
    return translations.where("chunk_id IS NOT NULL").select("chunk_id").distinct()


def pending_chunks(chunks: DataFrame, translations: DataFrame) -> DataFrame:
    """Chunks that no translation names."""
    return chunks.join(completed_chunks(translations), "chunk_id", "left_anti")


def failure_text(title: Column, index: Column) -> Column:
    return F.concat(F.lit("[[翻译失败: "), title, F.lit(" / chunk "), index.cast("string"), F.lit("]]"))


def chapter_texts(chapters: DataFrame, chunks: DataFrame, translations: DataFrame, failed: DataFrame, keep_blank: bool = False) -> DataFrame:
    """Chapters with the texts of their chunks joined by blank lines.

    A chunk without a translation gives a placeholder if it failed and nothing otherwise; chapters without any part are
    left out. Blank translations count as missing unless ``keep_blank``. Chapter and chunk rows delivered twice count once.
    """
    texts = latest_translations(translations).select("chunk_id", "translated_text")
    if not keep_blank:
        texts = texts.where(F.length(strip("translated_text")) > 0)
    marked = failed.select("chunk_id").distinct().withColumn("failed", F.lit(True))
    heads = chapters.select("book_id", "chapter_id", "chapter_index", "title").distinct()
    rows = (
        chunks.select("chapter_id", "chunk_id", "chunk_index").distinct()
        .join(heads, "chapter_id")
        .join(texts, "chunk_id", "left")
        .join(marked, "chunk_id", "left")
    )
    part = F.coalesce(
        strip("translated_text"),
        F.when(F.col("failed"), failure_text(F.coalesce("title", F.lit("")), F.col("chunk_index"))),
    )
    return (
        rows.withColumn("part", part)
        .groupBy("book_id", "chapter_id", "chapter_index", "title")
        .agg(joined("chunk_index", F.col("part"), "\n\n").alias("text"), F.count("part").alias("n_parts"))
        .where("n_parts > 0")
    )


def book_texts(chapters: DataFrame) -> DataFrame:
    """Books of chapters (book_id, chapter_index, title, text): titles and texts joined by blank lines, a line end behind."""
    part = F.concat_ws("\n\n", F.nullif(strip("title"), F.lit("")), F.nullif(strip("text"), F.lit("")))
    return (
        chapters.withColumn("part", F.nullif(part, F.lit("")))
        .groupBy("book_id")
        .agg(F.concat(strip(joined("chapter_index", F.col("part"), "\n\n")), F.lit("\n")).alias("text"))
    )


def render_block(kind: Column, text: Column, anchor: Column, order: Column) -> Column:
    """A block's text; ordered items with the marker of their anchor, else with their place."""
    bare = strip(text)
    marker = F.coalesce(ordered_marker(anchor), F.lit(""))
    number = F.when(marker != "", marker).otherwise(F.concat(order.cast("string"), F.lit(".")))
    return F.when((kind == "ordered_item") & (bare != ""), F.concat(number, F.lit(" "), bare)).otherwise(bare)


def blocks_to_text(blocks: DataFrame) -> DataFrame:
    """Texts of chapters (chapter_id) from blocks in order: list items and answers close up, the rest by blank lines."""
    rendered = blocks.withColumn(
        "rendered", render_block(F.col("kind"), F.col("text"), F.col("source_anchor"), F.col("order_index"))
    ).where("rendered <> ''")
    order = Window.partitionBy("chapter_id").orderBy("order_index", "block_id")
    before = F.lag("kind").over(order)
    close = (before.isin(*LIST_KINDS) & F.col("kind").isin(*LIST_KINDS)) | ((before == "qa_question") & (F.col("kind") == "qa_answer"))
    gap = F.when(before.isNull(), F.lit("")).when(close, F.lit("\n")).otherwise(F.lit("\n\n"))
    placed = rendered.withColumn("piece", F.concat(gap, F.col("rendered"))).withColumn("place", F.row_number().over(order))
    return placed.groupBy("chapter_id").agg(strip(joined("place", F.col("piece"), "")).alias("text"))


def adjacency_runs(blocks: DataFrame) -> DataFrame:
    """Runs of adjacent blocks of one kind: chapter_id, run_no, kind, first, last, n."""
    order = Window.partitionBy("chapter_id").orderBy("order_index", "block_id")
    starts = F.when(F.lag("kind").over(order).eqNullSafe(F.col("kind")), 0).otherwise(1)
    numbered = blocks.withColumn("starts", starts).withColumn("run_no", F.sum("starts").over(order))
    return numbered.groupBy("chapter_id", "run_no").agg(
        F.max("kind").alias("kind"), F.min("order_index").alias("first_index"), F.max("order_index").alias("last_index"),
        F.count("*").alias("n_blocks"),
    )
