"""Editorial passes over texts: lexicons, revision, proofreading, blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireloom.functions import extract as E
from quireloom.functions import predicates as P
from quireloom.functions.text import (
    canonical_caption,
    caption_key,
    let,
    paragraphs,
    proofread,
    restore_numbered_lines,
    strip,
    tidy_spacing,
)
from quireloom.operators.assembly import blocks_to_text

#: A lexicon is a glossary of a book, not data; a longer one is refused before it becomes part of a plan.
MAX_ENTRIES = 20_000


def clean_lexicon(entries: DataFrame) -> DataFrame:
    """Stripped entries (kind, ord, source, translation) without blanks, the first of equal pairs of a kind."""
    bare = entries.select("kind", "ord", strip("source").alias("source"), strip("translation").alias("translation")).where(
        "source <> '' AND translation <> ''"
    )
    return bare.groupBy("kind", "source", "translation").agg(F.min("ord").alias("ord")).select("kind", "ord", "source", "translation")


def merge_lexicons(generated: DataFrame, overrides: DataFrame) -> DataFrame:
    """Entries (ord, source, translation) of both; overrides win, blanks never count, new sources go behind."""
    old = generated.select("source", F.col("ord").alias("o1"), F.nullif(strip("translation"), F.lit("")).alias("t1")).where("t1 IS NOT NULL")
    new = overrides.select("source", F.col("ord").alias("o2"), F.nullif(strip("translation"), F.lit("")).alias("t2")).where("t2 IS NOT NULL")
    joined = old.join(new, "source", "full_outer")
    place = F.struct(F.when(F.col("o1").isNull(), 1).otherwise(0).alias("late"), F.coalesce("o1", "o2").alias("at"))
    order = Window.partitionBy(F.lit(0)).orderBy("place", "source")
    return joined.withColumn("place", place).select(
        (F.row_number().over(order) - 1).alias("ord"), "source", F.coalesce("t2", "t1").alias("translation")
    )


def entry_array(lexicon: DataFrame, order: Column, name: str = "entries") -> DataFrame:
    """One row with all entries (source, translation) in order as an array; more than MAX_ENTRIES fail."""
    rows = F.sort_array(F.collect_list(F.struct(order.alias("at"), F.struct("source", "translation").alias("e"))))
    entries = F.transform(rows, lambda x: x["e"])
    bounded = F.when(F.size(rows) > MAX_ENTRIES, F.raise_error(F.lit(f"more than {MAX_ENTRIES} lexicon entries"))).otherwise(entries)
    return lexicon.limit(MAX_ENTRIES + 1).agg(bounded.alias(name))  # the one entry too many is what fails


def replace_in_order(text: Column | str, entries: Column) -> Column:
    """Literal replacement of every entry of an array, one after the other; later entries see what earlier ones made."""
    return F.aggregate(entries, F.col(text) if isinstance(text, str) else text, lambda done, e: F.replace(done, e["source"], e["translation"]))


def revise(artifacts: DataFrame, lexicon: DataFrame, order: Column) -> DataFrame:
    """Texts with the lexicon's translations put in by ``order``; the lexicon goes to the workers as one row."""
    entries = F.broadcast(entry_array(lexicon, order, "__entries"))
    return artifacts.join(entries, F.lit(True)).withColumn("text", replace_in_order("text", F.col("__entries"))).drop("__entries")


def proofread_texts(artifacts: DataFrame) -> DataFrame:
    """Texts in publishing form with the note that the pass leaves."""
    fresh = artifacts.withColumn("__new", proofread("text"))
    changed = ~F.col("__new").eqNullSafe(F.col("text"))
    return fresh.select(
        *[c for c in artifacts.columns if c != "text"],
        F.col("__new").alias("text"),
        F.when(changed, "spacing_normalization").otherwise("proofread_review").alias("note_type"),
        F.when(changed, "medium").otherwise("info").alias("severity"),
    )


def final_log(artifacts: DataFrame) -> DataFrame:
    """Chapters that the last pass changes, or one row for the whole book where there is none."""
    fresh = artifacts.where(~proofread("text").eqNullSafe(F.col("text"))).select("book_id", "chapter_id")
    changed = fresh.select("book_id", "chapter_id", F.lit("whole_book_normalization").alias("log_type"), F.lit("medium").alias("severity"))
    books = artifacts.select("book_id").distinct().join(fresh.select("book_id").distinct(), "book_id", "left_anti")
    clean = books.select("book_id", F.lit("*").alias("chapter_id"), F.lit("whole_book_review").alias("log_type"), F.lit("info").alias("severity"))
    return changed.unionByName(clean)


def repair_text(text: Column | str, restore: Column) -> Column:
    """Editorial spacing, after rebuilding an inline list where asked and where no list stands in lines."""
    column = F.col(text) if isinstance(text, str) else text
    rebuild = restore & ~P.counts_up(E.block_numbers(column), 3, from_one=True)
    return tidy_spacing(F.when(rebuild, rebuild_inline_list(column)).otherwise(column))


def rebuild_inline_list(text: Column) -> Column:
    """Items of an inline list 1, 2, 3 on lines of their own; other texts as they are."""
    parts = F.split(text, E.INLINE, -1)
    items = E.inline_items(text)
    body = F.array_join(F.transform(items, lambda x: F.concat(x["number"], F.lit(". "), x["body"])), "\n")
    intro = strip(F.get(parts, F.lit(0)))
    return F.when(F.size(items) >= 3, F.when(intro != "", F.concat(intro, F.lit("\n\n"), body)).otherwise(body)).otherwise(text)


def repair_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks with editorial spacing; blank ones are left out but for images."""
    return blocks.withColumn("text", tidy_spacing("text")).where("text <> '' OR kind = 'image'")


def text_to_blocks(texts: DataFrame) -> DataFrame:
    """Blocks of texts (chapter_id, text, source_text): list items, what runs on behind them, and paragraphs.

    The numbered lines of the source become the anchors of the items one by one over the whole chapter.
    """

    def of_paragraph(p: Column) -> Column:
        plain = F.array(F.struct(F.lit("paragraph").alias("kind"), p.alias("text")))

        def of_items(items: Column) -> Column:
            split = F.flatten(F.transform(items, lambda x: E.split_overflow(x["body"])))
            return F.when(F.size(items) > 0, split).otherwise(plain)

        # Most paragraphs hold no marker at all.
        return F.when(F.regexp_like(p, F.lit("[0-9][.)]")), let(E.numbered_items(p), of_items)).otherwise(plain)

    pieces = F.flatten(F.transform(paragraphs("text"), of_paragraph))
    placed = texts.select(
        "chapter_id", E.numbered_lines(F.coalesce("source_text", F.lit(""))).alias("__anchors"),
        F.posexplode(pieces).alias("__at", "__piece"),
    )
    order = Window.partitionBy("chapter_id").orderBy("__at")
    item = (F.col("__piece.kind") == "ordered_item").cast("int")
    nth = F.sum(item).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("__nth", nth).select(
        "chapter_id",
        F.concat("chapter_id", F.lit("-block-"), (F.col("__at") + 1).cast("string")).alias("block_id"),
        F.col("__piece.kind").alias("kind"),
        F.col("__piece.text").alias("text"),
        (F.col("__at") + 1).alias("order_index"),
        F.when(F.col("__piece.kind") == "ordered_item", F.get("__anchors", F.col("__nth") - 1)).alias("source_anchor"),
    )


def attach_captions(blocks: DataFrame, assets: DataFrame) -> DataFrame:
    """Blocks in which the first block with an asset's caption becomes its caption; unmatched captions go behind.

    assets: chapter_id, source_asset_id, caption, source_location_hint.
    """
    wanted = assets.where("caption IS NOT NULL AND caption <> ''").withColumn("__key", caption_key("caption"))
    keyed = blocks.withColumn("__key", caption_key("text"))
    first = keyed.groupBy("chapter_id", "__key").agg(F.min_by("block_id", "order_index").alias("block_id"))
    by_key = wanted.groupBy("chapter_id", "__key").agg(
        F.min_by("caption", "source_asset_id").alias("caption"), F.min_by("source_location_hint", "source_asset_id").alias("hint")
    )
    hits = first.join(by_key, ["chapter_id", "__key"]).select("chapter_id", "block_id", "caption", "hint")
    anchor = F.coalesce(F.nullif("hint", F.lit("")), strip("caption"))
    marked = blocks.join(hits, ["chapter_id", "block_id"], "left").select(
        *[c for c in ("chapter_id", "block_id")],
        F.when(F.col("caption").isNotNull(), "caption").otherwise(F.col("kind")).alias("kind"),
        F.when(F.col("caption").isNotNull(), canonical_caption("text", "caption")).otherwise(F.col("text")).alias("text"),
        "order_index",
        F.coalesce("source_anchor", F.when(F.col("caption").isNotNull(), anchor)).alias("source_anchor"),
    )
    last = blocks.groupBy("chapter_id").agg(F.max("order_index").alias("last"))
    rest = by_key.join(first.select("chapter_id", "__key"), ["chapter_id", "__key"], "left_anti").join(last, "chapter_id", "left")
    place = F.coalesce("last", F.lit(0)) + F.row_number().over(Window.partitionBy("chapter_id").orderBy("__key"))
    added = rest.withColumn("order_index", place).select(
        "chapter_id", F.concat("chapter_id", F.lit("-block-"), F.col("order_index").cast("string")).alias("block_id"),
        F.lit("caption").alias("kind"), strip("caption").alias("text"), "order_index", anchor.alias("source_anchor"),
    )
    return marked.unionByName(added)


def asset_manifest(assets: DataFrame) -> DataFrame:
    """Assets of a chapter counted by status."""
    return assets.groupBy("chapter_id").agg(
        *[F.count_if(F.col("status") == s).alias(f"n_{s.replace('-', '_')}") for s in ("extracted", "caption-only", "missing")]
    )


def asset_list(assets: DataFrame) -> DataFrame:
    """The manifest of each chapter: asset_count, counts by status, and its assets (chapter_id, ord, ...) in order."""
    fields = [c for c in assets.columns if c not in ("chapter_id", "ord")]
    held = F.sort_array(F.collect_list(F.struct("ord", F.struct(*fields).alias("asset"))))
    listed = assets.groupBy("chapter_id").agg(F.count("*").alias("asset_count"), F.transform(held, lambda x: x["asset"]).alias("assets"))
    return asset_manifest(assets).join(listed, "chapter_id").select(
        "chapter_id", "asset_count", F.col("n_extracted").alias("extracted_count"), F.col("n_caption_only").alias("caption_only_count"),
        F.col("n_missing").alias("missing_count"), "assets",
    )


__all__ = [
    "asset_list", "asset_manifest", "attach_captions", "blocks_to_text", "clean_lexicon", "entry_array", "final_log", "merge_lexicons",
    "proofread_texts", "rebuild_inline_list", "repair_blocks", "repair_text", "replace_in_order", "restore_numbered_lines",
    "revise", "text_to_blocks",
]
