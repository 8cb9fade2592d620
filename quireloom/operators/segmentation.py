"""From books to chapters and from chapters to word-budgeted chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireloom.functions.patterns import LINE_END, S
from quireloom.functions.text import estimate_tokens, let, slug, strip, word_count

HEADING = rf"(?i)^(?:chapter|part|section){S}+[^\n]+$"


def _hard_split(sentence: Column, most: int) -> Column:
    """Fixed-size word slices."""
    words = F.split(strip(sentence), f"{S}+", -1)
    return F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(most)),
        lambda i: F.array_join(F.slice(words, i + 1, F.lit(most)), " "),
    )


def _counted(texts: Column) -> Column:
    """Texts with their words counted, so that a fold does not count again at every step."""
    return F.transform(texts, lambda t: F.struct(t.alias("text"), word_count(t).alias("n")))


def _nothing() -> Column:
    return F.array().cast("array<string>")


def pack_sentences(paragraph: Column, most: int) -> Column:
    """Sentences of a paragraph packed greedily into units of up to ``most`` words; longer ones cut by words."""
    found = F.filter(F.transform(F.split(paragraph, rf"(?<=[.!?]){S}+", -1), strip), lambda s: s != "")
    start = F.struct(F.lit("").alias("held"), F.lit(0).alias("n"), _nothing().alias("done"))

    def flush(acc: Column) -> Column:
        return F.when(acc["held"] != "", F.concat(acc["done"], F.array(acc["held"]))).otherwise(acc["done"])

    def step(acc: Column, x: Column) -> Column:
        s, n = x["text"], x["n"]
        return (
            F.when(
                n > most,
                F.struct(F.lit("").alias("held"), F.lit(0).alias("n"), F.concat(flush(acc), _hard_split(s, most)).alias("done")),
            )
            .when((acc["held"] != "") & (acc["n"] + n > most), F.struct(s.alias("held"), n.alias("n"), flush(acc).alias("done")))
            .otherwise(
                F.struct(
                    F.when(acc["held"] == "", s).otherwise(F.concat(acc["held"], F.lit(" "), s)).alias("held"),
                    (acc["n"] + n).alias("n"),
                    acc["done"].alias("done"),
                )
            )
        )

    return F.aggregate(_counted(found), start, step, flush)


def paragraph_units(text: Column, most: int) -> Column:
    """Paragraphs of up to ``most`` words, longer ones packed from sentences; the stripped text if there is none."""
    parts = F.filter(F.transform(F.split(text, rf"\n{S}*\n", -1), strip), lambda p: p != "")
    units = F.flatten(F.transform(parts, lambda p: F.when(word_count(p) <= most, F.array(p)).otherwise(pack_sentences(p, most))))
    return let(units, lambda found: F.when(F.size(found) == 0, F.array(strip(text))).otherwise(found))


def pack_units(units: Column, most: int) -> Column:
    """Units joined by blank lines into chunks of up to ``most`` words; one unit above it is a chunk of its own."""
    start = F.struct(F.lit("").alias("held"), F.lit(0).alias("n"), _nothing().alias("done"))

    def step(acc: Column, x: Column) -> Column:
        unit, n = x["text"], x["n"]
        return F.when(
            (acc["held"] != "") & (acc["n"] + n > most),
            F.struct(unit.alias("held"), n.alias("n"), F.concat(acc["done"], F.array(acc["held"])).alias("done")),
        ).otherwise(
            F.struct(
                F.when(acc["held"] == "", unit).otherwise(F.concat(acc["held"], F.lit("\n\n"), unit)).alias("held"),
                (acc["n"] + n).alias("n"),
                acc["done"].alias("done"),
            )
        )

    def close(acc: Column) -> Column:
        return F.when(acc["held"] != "", F.concat(acc["done"], F.array(acc["held"]))).otherwise(acc["done"])

    return F.aggregate(_counted(units), start, step, close)


def chunk_chapters(chapters: DataFrame, most: int = 3000) -> DataFrame:
    """Chunks of chapters (book_id, chapter_id, chapter_index, title, text), a narrow plan.

    Blank and null texts give no chunk. The fold stands inside the generator, so that it is planned once.
    """
    filled = chapters.where(F.length(strip("text")) > 0)
    return filled.select(
        "book_id", "chapter_id", "chapter_index", F.col("title").alias("chapter_title"),
        F.posexplode(pack_units(paragraph_units(F.col("text"), most), most)).alias("chunk_index", "source_text"),
    ).select(
        "book_id",
        F.concat_ws("-", "chapter_id", slug(F.coalesce("chapter_title", F.lit(""))), F.col("chunk_index").cast("string")).alias("chunk_id"),
        "chapter_id",
        "chapter_index",
        "chunk_index",
        "chapter_title",
        strip("source_text").alias("source_text"),
        estimate_tokens("source_text").alias("source_token_estimate"),
    )


def _lines(books: DataFrame) -> DataFrame:
    """book_id, line_no, line of every raw text."""
    return books.select("book_id", F.posexplode(F.split("raw_text", LINE_END, -1)).alias("line_no", "line"))


def _bodies(marked: DataFrame) -> DataFrame:
    """Chapters of lines with a running chapter number; heads are left out of the bodies."""
    rows = marked.where("chapter_index >= 0").groupBy("book_id", "chapter_index").agg(
        F.max(F.when(F.col("is_head"), F.col("title"))).alias("title"),
        F.sort_array(F.collect_list(F.when(~F.col("is_head"), F.struct("line_no", "line")))).alias("body"),
    )
    return rows.select(
        "book_id",
        F.concat(slug("title"), F.lit("-"), F.col("chapter_index").cast("string")).alias("chapter_id"),
        F.col("chapter_index").cast("int").alias("chapter_index"),
        "title",
        strip(F.array_join(F.col("body.line"), "\n")).alias("text"),
    )


def split_by_headings(books: DataFrame) -> DataFrame:
    """Chapters of books (book_id, raw_text) at lines that start with chapter, part or section; what precedes is left out."""
    order = Window.partitionBy("book_id").orderBy("line_no")
    marked = (
        _lines(books)
        .withColumn("is_head", F.regexp_like("line", F.lit(HEADING)))
        .withColumn("chapter_index", F.sum(F.col("is_head").cast("int")).over(order) - 1)
        .withColumn("title", strip("line"))
    )
    return _bodies(marked)


def title_lines(books: DataFrame, titles: DataFrame) -> DataFrame:
    """Line of each title (book_id, ord, title): the last one before the line chosen for the next title.

    Copies in a table of contents are passed over. Books in which a title has no such line give no row.
    """
    order = Window.partitionBy("book_id").orderBy("ord")
    wanted = titles.select("book_id", "title", (F.row_number().over(order) - 1).alias("at"))
    places = (
        _lines(books)
        .withColumn("match", F.lower(strip("line")))
        .join(wanted.withColumn("match", F.lower(strip("title"))), ["book_id", "match"])
        .groupBy("book_id", "at")
        .agg(F.collect_set("line_no").alias("lines"), F.first("title").alias("title"))
    )
    sizes = wanted.groupBy("book_id").agg(F.count("*").alias("n"))
    listed = places.groupBy("book_id").agg(
        F.reverse(F.sort_array(F.collect_list(F.struct("at", "lines", "title")))).alias("found")
    )
    chosen = F.aggregate(
        "found",
        F.struct(F.lit(2**31 - 1).alias("bound"), F.array().cast("array<int>").alias("lines")),
        lambda acc, x: F.struct(
            F.coalesce(F.array_max(F.filter(x["lines"], lambda i: i < acc["bound"])), F.lit(-1)).alias("bound"),
            F.concat(
                acc["lines"], F.array(F.coalesce(F.array_max(F.filter(x["lines"], lambda i: i < acc["bound"])), F.lit(-1)))
            ).alias("lines"),
        ),
        lambda acc: acc["lines"],
    )
    complete = listed.join(sizes, "book_id").where(F.size("found") == F.col("n")).withColumn("chosen", chosen)
    complete = complete.where(F.array_min("chosen") >= 0)
    pairs = F.arrays_zip(F.col("found.at").alias("at"), F.col("found.title").alias("title"), F.col("chosen").alias("line_no"))
    return complete.select("book_id", F.inline(pairs)).select("book_id", F.col("at").alias("chapter_index"), "title", "line_no")


def split_by_titles(books: DataFrame, titles: DataFrame) -> DataFrame:
    """Chapters of books at the lines of their titles; all titles of a book or none."""
    heads = title_lines(books, titles)
    order = Window.partitionBy("book_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = (
        _lines(books)
        .join(heads, ["book_id", "line_no"], "left")
        .withColumn("is_head", F.col("title").isNotNull())
        .withColumn("chapter_index", F.coalesce(F.last("chapter_index", ignorenulls=True).over(order), F.lit(-1)))
        .join(heads.select("book_id").distinct(), "book_id", "left_semi")
    )
    return _bodies(marked)


def drop_leading_title(body: Column, title: Column) -> Column:
    """A body without a first line that is its title, in any case."""
    first = F.lower(strip(F.substring_index(body, "\n", 1)))
    rest = F.when(F.contains(body, F.lit("\n")), F.regexp_replace(body, F.lit(r"\A[^\n]*\n"), F.lit(""))).otherwise(F.lit(""))
    return F.when(first == F.lower(strip(title)), strip(rest)).otherwise(body)


#: Pages of a stretch.
STRETCH = 64


def split_by_pages(pages: DataFrame, toc: DataFrame) -> DataFrame:
    """Chapters by page: from an entry's page up to the next entry's, at least one page.

    pages: book_id, page_index, text; toc: book_id, ord, title, page_index. Entries without a page of the book do not
    count. Blank pages are left out, the others joined by blank lines, and a leading title line is dropped.
    """
    sizes = pages.groupBy("book_id").agg((F.max("page_index") + 1).alias("n_pages"))
    order = Window.partitionBy("book_id").orderBy("ord")
    spans = (
        toc.join(sizes, "book_id")
        .where("page_index >= 0 AND page_index < n_pages")
        .select(
            "book_id",
            "title",
            (F.row_number().over(order) - 1).alias("chapter_index"),
            F.col("page_index").alias("low"),
            F.coalesce(F.lead("page_index").over(order), F.col("n_pages")).alias("next"),
        )
        .withColumn("high", F.greatest(F.col("next"), F.col("low") + 1))
    )
    filled = pages.select("book_id", "page_index", strip("text").alias("text")).where("text <> ''")
    # Pages meet spans by stretches of pages, so that a large book is neither one key nor joined with all its spans.
    stretch = F.floor(F.col("page_index") / STRETCH)
    stretches = F.explode(F.sequence(F.floor(F.col("low") / STRETCH), F.floor((F.col("high") - 1) / STRETCH))).alias("__stretch")
    wide = spans.select("book_id", "chapter_index", "low", "high", stretches)
    inside = wide.join(filled.withColumn("__stretch", stretch), ["book_id", "__stretch"]).where("page_index >= low AND page_index < high")
    return (
        spans.join(
            inside.groupBy("book_id", "chapter_index").agg(
                F.sort_array(F.collect_list(F.struct("page_index", "text"))).alias("body")
            ),
            ["book_id", "chapter_index"],
            "left",
        )
        .select(
            "book_id",
            F.concat(slug("title"), F.lit("-"), F.col("chapter_index").cast("string")).alias("chapter_id"),
            "chapter_index",
            "title",
            drop_leading_title(
                strip(F.array_join(F.coalesce(F.col("body.text"), F.array().cast("array<string>")), "\n\n")), F.col("title")
            ).alias("text"),
        )
    )


STRATEGIES = ("toc-first", "auto", "rule-only", "manual")


def detect_chapters(
    books: DataFrame,
    toc: DataFrame | None = None,
    pages: DataFrame | None = None,
    manual_titles: DataFrame | None = None,
    strategy: str = "toc-first",
) -> DataFrame:
    """Chapters by the first way that works for a book.

    toc-first and auto: pages of the contents, titles of the contents, heading lines, manual titles, the whole book.
    rule-only leaves out the contents, manual takes nothing but the manual titles.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    if strategy == "manual":
        if manual_titles is None:
            raise ValueError("the manual strategy needs titles")
        return split_by_titles(books, manual_titles)
    ways = []
    if strategy != "rule-only" and toc is not None:
        if pages is not None:
            ways.append(split_by_pages(pages, toc.where("page_index IS NOT NULL")))
        ways.append(split_by_titles(books, toc))
    ways.append(split_by_headings(books))
    if manual_titles is not None:
        ways.append(split_by_titles(books, manual_titles))
    whole = books.select(
        "book_id", F.concat(slug("title"), F.lit("-chapter-0")).alias("chapter_id"), F.lit(0).alias("chapter_index"),
        "title", strip("raw_text").alias("text"),
    )
    ranked = [way.withColumn("__way", F.lit(i)) for i, way in enumerate([*ways, whole])]
    everything = ranked[0]
    for way in ranked[1:]:
        everything = everything.unionByName(way)
    first = everything.groupBy("book_id").agg(F.min("__way").alias("__way"))
    return everything.join(first, ["book_id", "__way"], "left_semi").drop("__way")
