"""Rows that a renderer prints: annotations, printable blocks, XHTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireloom.functions import extract as E
from quireloom.functions import predicates as P
from quireloom.functions.patterns import CJK, S
from quireloom.functions.text import (
    drop_markup,
    escape_html,
    excerpt,
    filled_lines,
    flow_lines,
    has_markup,
    header_cut,
    inline_html,
    key,
    let,
    match_tokens,
    paragraph_html,
    short_title,
    strip,
    tighten_mixed,
)
from quireloom.operators.assembly import joined
from quireloom.plans.staging import stage


def quote_score(quote: Column, target: Column, context: Column) -> Column:
    """8 if the quotation is in the target, 4 if the target is in it, 3 for each token shared with the context."""
    q, t = F.lower(quote), F.lower(target)
    inside = F.when((t != "") & F.contains(t, q), 8).otherwise(0)
    around = F.when((t != "") & F.contains(q, t), 4).otherwise(0)
    return inside + around + F.size(F.array_intersect(match_tokens(quote), match_tokens(context))) * 3


def best_quote(quotes: Column, target: Column, source: Column, reason: Column) -> Column:
    """The quotation of the highest score, the first at a tie; without any score only a single one; else empty."""
    context = strip(F.concat_ws(" ", target, strip(source), strip(reason)))
    scored = F.transform(quotes, lambda q, i: F.struct(quote_score(q, target, context).alias("score"), (-i).alias("at"), q.alias("q")))
    best = F.array_max(scored)
    return F.when(best["score"] > 0, best["q"]).when(F.size(quotes) == 1, F.get(quotes, F.lit(0))).otherwise(F.lit(""))


def callout_text(text: Column, target: Column, source: Column, reason: Column) -> Column:
    """Best quotation, else the first emphasised line, else the target excerpt, else an excerpt of the chapter."""
    bare = strip(target)
    return F.coalesce(
        F.nullif(best_quote(E.quoted_spans(text), bare, source, reason), F.lit("")),
        F.nullif(E.emphasised_line(text), F.lit("")),
        F.nullif(bare, F.lit("")),
        excerpt(text),
    )


def question_anchor(text: Column, source_text: Column, target: Column) -> Column:
    return F.coalesce(F.nullif(E.pair_anchor(text, source_text), F.lit("")), F.nullif(strip(target), F.lit("")), excerpt(text))


def layout_annotations(findings: DataFrame, chapters: DataFrame) -> DataFrame:
    """Callout and question annotations of findings with their chapters (chapter_id, text, source_text), without repeats.

    The first of equal annotations by the order of finding keys (``ord``) stays; empty callouts are left out.
    """
    rows = findings.where(F.col("finding_type").isin("callout_candidate", "question_answer_structure")).join(chapters, "chapter_id")
    text, source = F.coalesce("text", F.lit("")), F.coalesce("source_text", F.lit(""))
    target = F.coalesce("target_excerpt", F.lit(""))
    is_callout = F.col("finding_type") == "callout_candidate"
    value = F.when(is_callout, callout_text(text, target, F.coalesce("source_excerpt", F.lit("")), F.coalesce("reason", F.lit("")))).otherwise(
        question_anchor(text, source, target)
    )
    marked = rows.select(
        "chapter_id", "ord", F.when(is_callout, "callout").otherwise("qa_block").alias("kind"), value.alias("value"),
        F.when(~is_callout, P.has_question_mark(text)).alias("has_question_marker"),
        F.when(~is_callout, P.has_answer_mark(text)).alias("has_answer_marker"),
    ).where("kind = 'qa_block' OR value <> ''")
    return marked.groupBy("chapter_id", "kind", "value").agg(
        F.min("ord").alias("ord"), F.max("has_question_marker").alias("has_question_marker"),
        F.max("has_answer_marker").alias("has_answer_marker"),
    )


# Markup of a raised citation number.
RAISED, LOWERED = "<font color='#2F5BD2' size='6.8'><super>", "</super></font>"


def citation_markup(numbers: Column) -> Column:
    return F.array_join(
        F.transform(numbers, lambda n: F.concat(F.lit(RAISED), n, F.lit(LOWERED))), ""
    )


def mark_citations(text: Column | str) -> Column:
    """Escaped text in which numbers of 2 to 4 digits behind closing signs stand raised.

    Not where text other than ideographs follows at once, nor a sign of a date or an address.
    """
    follows = rf"(?=$|{S}|(?![年月日号]){CJK})"
    # Private-use characters mark the places until the rest of the text is escaped.
    marked = F.regexp_replace(text, F.lit(rf"([。！？!?；;:：”’」】）)]){S}*([0-9]{{2,4}}){follows}"), F.lit("$1\ue000$2\ue001"))
    raised = F.lit(f"{RAISED}$1{LOWERED}")
    return F.regexp_replace(escape_xml(marked), F.lit("\ue000([0-9]{2,4})\ue001"), raised)


def escape_xml(text: Column) -> Column:
    """Only the signs that text between tags may not hold."""
    t = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(t, F.lit(">"), F.lit("&gt;")), F.lit("<"), F.lit("&lt;"))


def block_text(parts: Column, citations: Column) -> Column:
    return F.concat(mark_citations(tighten_mixed(flow_lines(parts))), citation_markup(citations))


def printable_blocks(texts: DataFrame) -> DataFrame:
    """Blocks of texts (book_id, chapter_id, chapter_index, text) with their kind: reference, callout, section_heading,
    numbered_item or paragraph; title lines of book and chapter are rows of kind book_title and chapter_title.

    A book's first line that is a book title and the first content of each chapter that is a chapter title are taken out.
    """
    blocks = texts.select(
        "book_id", "chapter_id", "chapter_index", F.posexplode(F.flatten(F.transform(E.raw_blocks("text"), E.semantic_blocks))).alias("at", "lines")
    )
    cut = blocks.withColumn("references", E.reference_entries(F.col("lines"))).withColumn("parts", E.trailing_citations(F.col("lines")))
    cut = cut.withColumn(
        "content",
        F.when(
            F.regexp_like(F.get("parts.content", F.lit(0)), F.lit(r"\A[0-9]+\z")), E.clean_lines(F.col("parts.content"), True)
        ).otherwise(E.clean_lines(F.col("parts.content"))),
    ).where("size(references) > 0 OR size(content) > 0")
    titled = (F.size("references") == 0) & P.is_book_title(F.get("content", F.lit(0)))
    # The first title of a book by an aggregate and a join: a window would sort all blocks of a large book in one task.
    cut = stage(cut.withColumn("titled", F.coalesce(titled, F.lit(False))), "blocks")
    place = F.struct("chapter_index", "chapter_id", "at")
    firsts = cut.where("titled").groupBy("book_id").agg(F.min(place).alias("first"))
    cut = cut.join(firsts, "book_id", "left")
    cut = cut.withColumn("book_title", F.when(F.col("titled") & (place == F.col("first")), F.get("content", F.lit(0))))
    cut = cut.withColumn(
        "content", F.when(F.col("book_title").isNotNull(), F.slice("content", 2, F.size("content"))).otherwise(F.col("content"))
    )
    in_chapter = Window.partitionBy("book_id", "chapter_id").orderBy("at")
    filled = ((F.size("references") > 0) | (F.size("content") > 0)).cast("int")
    first = (F.sum(filled).over(in_chapter) == 1) & (filled == 1) & (F.size("references") == 0)
    cut = cut.withColumn("split", F.when(first, E.chapter_title(F.col("content"))))
    lines = F.when(F.col("split").isNotNull(), F.col("split.lines")).otherwise(F.col("content"))
    cut = cut.withColumn("kept", lines).withColumn("chapter_title", F.col("split.title"))
    single = F.size("kept") == 1
    only, numbers = F.get("kept", F.lit(0)), F.col("parts.citations")
    kind = (
        F.when(P.is_callout(F.col("kept"), numbers), "callout")
        .when(single & P.is_section_heading(only), "section_heading")
        .when(single & P.is_numbered_item(only), "numbered_item")
        .otherwise("paragraph")
    )
    plain_heading = (kind == "section_heading") & (F.size(numbers) == 0)
    body = F.when(plain_heading, tighten_mixed(only)).otherwise(block_text(F.col("kept"), numbers))

    def rows(kind: Column, texts: Column) -> Column:
        return F.transform(texts, lambda x: F.struct(kind.alias("kind"), x.alias("text")))

    def some(value: Column) -> Column:
        return F.when(value.isNotNull(), F.array(value)).otherwise(F.array().cast("array<string>"))

    pieces = F.concat(
        rows(F.lit("reference"), F.col("references")),
        rows(F.lit("book_title"), some(F.col("book_title"))),
        rows(F.lit("chapter_title"), some(F.col("chapter_title"))),
        rows(kind, F.when((F.size("references") == 0) & (F.size("kept") > 0), F.array(body)).otherwise(F.array().cast("array<string>"))),
    )
    return cut.select("book_id", "chapter_id", "chapter_index", "at", F.posexplode(pieces).alias("part", "piece")).select(
        "book_id", "chapter_id", "chapter_index",
        (F.row_number().over(Window.partitionBy("book_id", "chapter_id").orderBy("at", "part")) - 1).alias("block_no"),
        F.col("piece.kind").alias("kind"), F.col("piece.text").alias("text"),
    )


# Printable kind of each block kind that changes its name.
PRINT_KINDS = {"ordered_item": "numbered_item", "unordered_item": "paragraph", "heading": "section_heading", "reference_entry": "reference"}
SAME_KINDS = ("paragraph", "qa_question", "qa_answer", "callout", "quote", "caption")


def print_kind(kind: Column | str) -> Column:
    """Printable kind of a structured block, 'paragraph' for any other."""
    column = F.col(kind) if isinstance(kind, str) else kind
    out = F.when(column.isin(*SAME_KINDS), column)
    for old, new in PRINT_KINDS.items():
        out = out.when(column == old, F.lit(new))
    return out.otherwise(F.lit("paragraph"))


def structured_to_printable(blocks: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """Printable rows of structured blocks; blank blocks of other kinds are left out.

    assets: chapter_id, source_asset_id, ord, block_anchor_id, status, caption; the last of a block counts. An image that
    is known by its caption only becomes a caption, unless a caption block says the same; such captions without a block
    of theirs go behind the chapter, with the columns that blocks have beside theirs as null. Blocks then need chapter_id,
    block_id and order_index.
    """
    known = F.col("kind").isin(*SAME_KINDS, *PRINT_KINDS)
    if assets is None:
        return blocks.select(
            *[c for c in blocks.columns if c not in ("kind", "text")], print_kind("kind").alias("kind"),
            strip("text").alias("text"), known.alias("__known"),
        ).where("__known OR text <> ''").drop("__known")
    told = caption_keys(blocks).withColumn("__told", F.lit(True))
    alone = assets.where("status = 'caption-only' AND caption IS NOT NULL AND caption <> ''").withColumn("caption_key", key("caption"))
    alone = alone.join(told, ["chapter_id", "caption_key"], "left")
    last = assets.where("block_anchor_id IS NOT NULL AND block_anchor_id <> ''").groupBy("chapter_id", "block_anchor_id").agg(F.max("ord").alias("ord"))
    by_block = alone.join(last, ["chapter_id", "block_anchor_id", "ord"]).select(
        "chapter_id", F.col("block_anchor_id").alias("block_id"), F.col("caption").alias("__caption"), F.coalesce("__told", F.lit(False)).alias("__said")
    )
    rows = blocks.join(by_block, ["chapter_id", "block_id"], "left")
    pictured = (F.col("kind") == "image") & F.col("__caption").isNotNull()
    shown = rows.where(~F.coalesce(pictured & F.col("__said"), F.lit(False))).select(
        *[c for c in blocks.columns if c not in ("kind", "text")],
        F.when(pictured, "caption").otherwise(print_kind("kind")).alias("kind"),
        F.when(pictured, strip("__caption")).otherwise(strip("text")).alias("text"),
        (known | F.coalesce(pictured, F.lit(False))).alias("__known"),
    ).where("__known OR text <> ''").drop("__known")
    placed = blocks.where("kind IN ('image', 'caption')").select("chapter_id", F.col("block_id").alias("block_anchor_id")).distinct()
    rest = alone.where("__told IS NULL").join(placed, ["chapter_id", "block_anchor_id"], "left_anti")
    ends = blocks.groupBy("chapter_id").agg(F.max("order_index").alias("__end"))
    place = F.coalesce("__end", F.lit(0)) + F.row_number().over(Window.partitionBy("chapter_id").orderBy("ord"))
    made = rest.join(ends, "chapter_id", "left").withColumn("order_index", place.cast(blocks.schema["order_index"].dataType))
    values = {"chapter_id": F.col("chapter_id"), "order_index": F.col("order_index"), "kind": F.lit("caption"), "text": strip("caption")}
    return shown.unionByName(
        made.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in shown.schema])
    )


def apply_callout(blocks: DataFrame, callouts: DataFrame) -> DataFrame:
    """Blocks (chapter_id, block_no, kind, text) in which the first one that holds a callout's text becomes a callout.

    callouts: chapter_id, value. A block with markup keeps its text, others take the callout's.
    """
    wanted = callouts.select("chapter_id", F.col("value").alias("__value"), E.match_text("value").alias("__wanted")).where("__value <> ''")
    plain = E.match_text(drop_markup("text"))
    hits = (
        blocks.where("kind <> 'reference'").withColumn("__plain", plain).where("__plain <> ''").join(wanted, "chapter_id")
        .where(F.contains("__plain", F.col("__wanted")) | F.contains("__wanted", F.col("__plain")))
        .groupBy("chapter_id", "__value").agg(F.min("block_no").alias("block_no"))
        .groupBy("chapter_id", "block_no").agg(F.min("__value").alias("__value"))
    )
    joined_rows = blocks.join(hits, ["chapter_id", "block_no"], "left")
    hit = F.col("__value").isNotNull()
    return joined_rows.select(
        *[c for c in blocks.columns if c not in ("kind", "text")],
        F.when(hit, "callout").otherwise(F.col("kind")).alias("kind"),
        F.when(hit & ~has_markup("text"), F.col("__value")).otherwise(F.col("text")).alias("text"),
    )


def repeats_answer(answer: Column, paragraph: Column) -> Column:
    """Whether a paragraph only repeats the end of the answer before it."""
    a, p = E.match_text(drop_markup(answer)), E.match_text(drop_markup(paragraph))
    return (a != "") & (p != "") & F.endswith(a, p)


def question_pair(anchor: Column, marked: Column) -> Column:
    """Struct of question and answer of an annotation's anchor, or null: its marked lines, else, where the annotation
    speaks of marks, its first two lines; a single line is split (see extract.split_compact_pair)."""

    def of(parts: Column) -> Column:
        question = F.get(F.filter(parts, P.is_question), F.lit(0))
        answer = F.get(F.filter(parts, P.is_answer), F.lit(0))
        both = question.isNotNull() & answer.isNotNull()
        one, two = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
        lined = F.when(both, F.struct(question.alias("question"), answer.alias("answer"))).when(
            marked, F.struct(one.alias("question"), two.alias("answer"))
        )
        return F.when(F.size(parts) < 2, E.split_compact_pair(anchor, marked)).otherwise(lined)

    return let(filled_lines(anchor), of)


def apply_questions(blocks: DataFrame, questions: DataFrame) -> DataFrame:
    """Blocks (chapter_id, block_no, kind, text) in which the first one that matches an annotation becomes two.

    questions: chapter_id, ord, anchor, and the marks has_question_marker and has_answer_marker (null: the annotation says
    nothing of them). A block takes the annotation of the lowest ord. A paragraph behind it that repeats the end of the
    answer is left out. Blocks are numbered anew from 0 in each chapter. Annotations without a pair change nothing.
    """
    marked = F.col("has_question_marker").isNotNull() | F.col("has_answer_marker").isNotNull()
    anchor = strip(F.coalesce("anchor", F.lit("")))
    wanted = questions.select(
        "chapter_id", F.col("ord").alias("__ord"), question_pair(anchor, marked).alias("__pair"), E.match_text(anchor).alias("__target")
    ).where("__pair IS NOT NULL")
    plain = E.match_text(drop_markup(F.coalesce("text", F.lit(""))))
    hits = (
        blocks.select("chapter_id", "block_no", plain.alias("__plain")).where("__plain <> ''").join(wanted, "chapter_id")
        .where((F.col("__target") == "") | F.contains("__plain", F.col("__target")) | F.contains("__target", F.col("__plain")))
        .groupBy("chapter_id", "__ord").agg(F.min("block_no").alias("block_no"), F.min_by("__pair", "block_no").alias("__pair"))
        .groupBy("chapter_id", "block_no").agg(F.min_by("__pair", "__ord").alias("__pair"))
    )
    order = Window.partitionBy("chapter_id").orderBy("block_no")
    joined_rows = blocks.join(hits, ["chapter_id", "block_no"], "left").withColumn("__before", F.lag("__pair").over(order))
    repeated = (F.col("kind") == "paragraph") & F.col("__pair").isNull() & repeats_answer(F.col("__before.answer"), F.col("text"))
    kept = joined_rows.where(~F.coalesce(repeated, F.lit(False)))
    own = F.array(F.struct("kind", "text"))
    pair = F.array(
        F.struct(F.lit("qa_question").alias("kind"), F.col("__pair.question").alias("text")),
        F.struct(F.lit("qa_answer").alias("kind"), F.col("__pair.answer").alias("text")),
    )
    rest = [c for c in blocks.columns if c not in ("chapter_id", "block_no", "kind", "text")]
    pieces = kept.select(
        "chapter_id", "block_no", *rest, F.posexplode(F.when(F.col("__pair").isNotNull(), pair).otherwise(own)).alias("__part", "__piece")
    )
    number = F.row_number().over(Window.partitionBy("chapter_id").orderBy("block_no", "__part")) - 1
    return pieces.select("chapter_id", number.alias("block_no"), F.col("__piece.kind").alias("kind"), F.col("__piece.text").alias("text"), *rest)


def retitle(chapters: DataFrame, overrides: DataFrame) -> DataFrame:
    """Chapters (chapter_id, title, title_zh) with the overrides' titles (chapter_id, title_zh) and all that is made of
    them: title_kind, header_title and toc_label_html. A blank override leaves a title as it is."""
    new = overrides.where("title_zh IS NOT NULL AND title_zh <> ''").groupBy("chapter_id").agg(F.max("title_zh").alias("__new"))
    zh = preferred_title(F.coalesce("__new", "title_zh"))
    joined_rows = chapters.join(new, "chapter_id", "left").withColumn("title_zh", zh).drop("__new")
    title, translated = F.coalesce("title", F.lit("")), F.coalesce("title_zh", F.lit(""))
    return joined_rows.withColumns(
        {
            "title_kind": title_kind(title, translated), "header_title": header_title(title, F.col("title_zh")),
            "toc_label_html": contents_label(title, F.col("title_zh")),
        }
    )


def title_kind(title: Column, translated: Column) -> Column:
    part = F.startswith(F.lower(title), F.lit("part ")) | (
        F.startswith(translated, F.lit("第")) & F.contains(translated, F.lit("部分"))
    )
    empty = (F.coalesce(title, F.lit("")) == "") & (F.coalesce(translated, F.lit("")) == "")
    return F.when(empty, "fallback").when(F.coalesce(part, F.lit(False)), "part").otherwise("chapter")


def header_title(title: Column, translated: Column) -> Column:
    return F.coalesce(F.nullif(translated, F.lit("")), F.nullif(title, F.lit("")), F.lit("未命名章节"))


def contents_label(title: Column, translated: Column) -> Column:
    """Escaped label of a table of contents: the translated title over the title, where there is one."""
    small = F.concat(escape_xml(translated), F.lit("<br/><font size='8.5' color='#6B6259'>"), escape_xml(title), F.lit("</font>"))
    return F.when(F.coalesce(translated, F.lit("")) == "", escape_xml(title)).otherwise(small)


def preferred_title(translated: Column) -> Column:
    return F.regexp_replace(F.nullif(translated, F.lit("")), F.lit("^([^\n]+?)核心法则([0-9]+)条$"), F.lit("$1的 $2 条核心法则"))


def running_header(page: Column, book: Column, chapter: Column) -> Column:
    """Struct of left and right header: the short book title on even pages, the chapter title on odd ones."""
    even = page % 2 == 0
    return F.struct(
        F.when(even, header_cut(short_title(book), 18)).otherwise(F.lit("")).alias("left"),
        F.when(even, F.lit("")).otherwise(header_cut(chapter, 22)).alias("right"),
    )


def opening_template(kind: Column) -> Column:
    return F.when(kind == "part", "part-opening").otherwise("chapter-opening")


def chapter_labels(title: Column, translated: Column) -> Column:
    """Struct of primary and secondary title; the secondary is blank where both are the same."""
    first = F.coalesce(F.nullif(translated, F.lit("")), title, F.lit(""))
    second = F.when(F.coalesce(title, F.lit("")) == first, F.lit("")).otherwise(F.coalesce(title, F.lit("")))
    return F.struct(strip(first).alias("first"), strip(second).alias("second"))


def contents_line(title: Column, translated: Column) -> Column:
    labels = chapter_labels(title, translated)
    both = (labels["first"] != "") & (labels["second"] != "")
    return F.when(both, F.concat(labels["first"], F.lit(" / "), labels["second"])).otherwise(F.concat(labels["first"], labels["second"]))


def block_html(kind: Column, text: Column) -> Column:
    """Element of a block outside lists; captions without an image are placeholders, blank other blocks nothing."""

    def tag(open_: str, inner: Column, close: str) -> Column:
        return F.concat(F.lit(open_), inner, F.lit(close))

    line = inline_html(text)
    out = (
        F.when(kind == "heading", tag("<h2>", line, "</h2>"))
        .when(kind == "callout", tag('<aside class="callout">', paragraph_html(text), "</aside>"))
        .when(kind == "qa_question", tag('<p class="qa-question">', line, "</p>"))
        .when(kind == "qa_answer", tag('<p class="qa-answer">', line, "</p>"))
        .when(kind == "quote", tag("<blockquote>", paragraph_html(text), "</blockquote>"))
        .when(kind == "reference_entry", tag('<p class="reference">', line, "</p>"))
        .when(
            kind.isin("caption", "image"),
            F.when(strip(text) == "", F.lit("")).otherwise(
                tag('<figure class="image-placeholder"><figcaption>', line, "</figcaption></figure>")
            ),
        )
    )
    paragraph = F.when((kind != "paragraph") & (strip(text) == ""), F.lit("")).otherwise(tag("<p>", line, "</p>"))
    return out.otherwise(paragraph)


def figure_html(kind: Column, text: Column, asset: Column) -> Column:
    """Figure of an image or caption block with its asset (file_name, caption, status), or null where it has none to show."""
    said, caption = strip(text), F.coalesce(asset["caption"], F.lit(""))
    alone = F.when(said != "", said).otherwise(caption)

    def picture(alt: Column, below: Column) -> Column:
        return F.concat(
            F.lit('<figure class="image"><img src="'), escape_html(asset["file_name"]), F.lit('" alt="'), escape_html(alt), F.lit('" />'), below,
            F.lit("</figure>"),
        )

    def below(words: Column) -> Column:
        return F.when(words != "", F.concat(F.lit("<figcaption>"), inline_html(words), F.lit("</figcaption>"))).otherwise(F.lit(""))

    placeholder = F.concat(F.lit('<figure class="image-placeholder"><figcaption>'), inline_html(alone), F.lit("</figcaption></figure>"))
    return (
        F.when((kind == "image") & asset.isNotNull(), picture(alone, below(caption)))
        .when((kind == "caption") & (asset["status"] == "extracted"), picture(alone, F.concat(F.lit("<figcaption>"), inline_html(alone), F.lit("</figcaption>"))))
        .when((kind == "caption") & asset.isNotNull() & (alone != ""), placeholder)
    )


def _with_assets(blocks: DataFrame, assets: DataFrame) -> DataFrame:
    fields = F.struct("file_name", "caption", "status", "block_anchor_id").alias("__a")
    named = assets.select("chapter_id", F.explode(F.array_compact(F.array("source_asset_id", "block_anchor_id"))).alias("__name"), fields)
    named = named.groupBy("chapter_id", "__name").agg(F.min("__a").alias("__a"))
    worded = assets.where("caption <> ''").groupBy("chapter_id", key("caption").alias("__words")).agg(F.min(fields).alias("__by_words"))
    extracted = assets.where("status = 'extracted'").groupBy("chapter_id").agg(F.countDistinct("source_asset_id").alias("__n"), F.min(fields).alias("__only"))
    joined_rows = (
        blocks.withColumn("__words", key(F.coalesce("text", F.lit(""))))
        .join(named.select("chapter_id", F.col("__name").alias("block_id"), F.col("__a").alias("__own")), ["chapter_id", "block_id"], "left")
        .join(named.select("chapter_id", F.col("__name").alias("source_anchor"), F.col("__a").alias("__anchored")), ["chapter_id", "source_anchor"], "left")
        .join(worded, ["chapter_id", "__words"], "left")
        .join(extracted, "chapter_id", "left")
    )
    other = F.when(F.col("kind") == "caption", F.col("__by_words")).when((F.col("kind") == "image") & (F.col("__n") == 1), F.col("__only"))
    return joined_rows.withColumn("__asset", F.coalesce("__own", "__anchored", other)).select(*blocks.columns, "__asset")


def chapters_html(blocks: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """Body of each chapter (chapter_id, html): list items of adjacent blocks in one list, the rest an element each.

    assets: chapter_id, source_asset_id, block_anchor_id, file_name, caption, status of those that have a file (see
    unique_file_names). A block's asset is the one that names it or that its anchor names, for a caption else one with the
    same words, for an image else the only extracted one. A caption block that an image before it has shown is left out.
    """
    order = Window.partitionBy("chapter_id").orderBy("order_index", "block_id")
    figure = F.lit(None).cast("string")
    if assets is not None:
        blocks = _with_assets(blocks, assets)
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        pictured = F.when((F.col("kind") == "image") & (F.coalesce(F.col("__asset.caption"), F.lit("")) != ""), F.col("__asset.block_anchor_id"))
        blocks = blocks.withColumn("__shown", F.collect_set(pictured).over(before))
        blocks = blocks.where(~((F.col("kind") == "caption") & F.array_contains("__shown", F.col("block_id")))).drop("__shown")
        figure = figure_html(F.col("kind"), F.coalesce("text", F.lit("")), F.col("__asset"))
    blocks = blocks.withColumn("__figure", figure)
    starts = F.when(F.lag("kind").over(order).eqNullSafe(F.col("kind")) & F.col("kind").isin("ordered_item", "unordered_item"), 0).otherwise(1)
    runs = blocks.withColumn("starts", starts).withColumn("run_no", F.sum("starts").over(order)).withColumn("place", F.row_number().over(order))
    item = F.when(strip("text") != "", F.concat(F.lit("<li>"), inline_html("text"), F.lit("</li>")))
    grouped = runs.groupBy("chapter_id", "run_no").agg(
        F.max("kind").alias("kind"),
        F.min_by("source_anchor", "place").alias("anchor"),
        joined("place", item, "").alias("items"),
        F.min_by("text", "place").alias("text"),
        F.min_by("__figure", "place").alias("figure"),
    )
    start = E.ordered_start(F.col("anchor"))
    attribute = F.coalesce(F.concat(F.lit(' start="'), start.cast("string"), F.lit('"')), F.lit(""))
    element = (
        F.when(F.col("kind").isin("ordered_item", "unordered_item") & (F.col("items") == ""), F.lit(""))
        .when(F.col("kind") == "ordered_item", F.concat(F.lit('<ol class="ordered-list"'), attribute, F.lit(">"), F.col("items"), F.lit("</ol>")))
        .when(F.col("kind") == "unordered_item", F.concat(F.lit('<ul class="unordered-list">'), F.col("items"), F.lit("</ul>")))
        .otherwise(F.coalesce("figure", block_html(F.col("kind"), F.coalesce("text", F.lit("")))))
    )
    return grouped.withColumn("element", F.nullif(element, F.lit(""))).groupBy("chapter_id").agg(
        joined("run_no", F.col("element"), "\n").alias("html")
    )


def html_page(title: Column, body: Column, body_class: str = "chapter") -> Column:
    """An XHTML document around a body."""
    head = (
        '<?xml version="1.0" encoding="utf-8"?><!DOCTYPE html><html xmlns="http://www.w3.org/1999/xhtml" lang="zh-CN">'
        '<head><meta charset="utf-8" /><title>'
    )
    middle = f'</title><link rel="stylesheet" type="text/css" href="styles/style.css" /></head><body class="{body_class}">'
    return F.concat(F.lit(head), escape_html(title), F.lit(middle), body, F.lit("</body></html>"))


def unique_file_names(assets: DataFrame) -> DataFrame:
    """``file_name`` of assets (chapter_id, source_asset_id, ord, suffix): repeats get -2, -3 and so on."""
    nth = F.row_number().over(Window.partitionBy("chapter_id", "source_asset_id", "suffix").orderBy("ord"))
    base = F.concat(F.lit("images/"), "chapter_id", F.lit("-"), "source_asset_id")
    return assets.withColumn(
        "file_name", F.concat(base, F.when(nth > 1, F.concat(F.lit("-"), nth.cast("string"))).otherwise(F.lit("")), "suffix")
    )


def caption_keys(blocks: DataFrame) -> DataFrame:
    return blocks.where("kind = 'caption'").select("chapter_id", key("text").alias("caption_key")).distinct()
