"""Queries of chaptering and chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quireloom.operators import segmentation as G
from quireloom.operators.assembly import joined
from quireloom.plans import sqltext as Q
from quireloom.sources import read_table

#: Words of a chunk in the query: small enough that long paragraphs are cut by sentences and by words.
MOST = 45


def _chapters(spark: SparkSession, data_dir: str) -> DataFrame:
    return read_table(spark, data_dir, "chapters").where("chapter_id IS NOT NULL").distinct()


def _books(chapters: DataFrame, head) -> DataFrame:
    """Raw texts of books: a contents list, then each chapter's head line and text."""
    rows = chapters.withColumn("head", head).withColumn("part", F.concat("head", F.lit("\n"), F.coalesce("text", F.lit(""))))
    return rows.groupBy("book_id").agg(
        F.concat(
            F.lit("Contents\n"), joined("chapter_index", F.col("head"), "\n"), F.lit("\n\n"), joined("chapter_index", F.col("part"), "\n\n")
        ).alias("raw_text")
    )


def chunk_pack(spark: SparkSession, data_dir: str) -> DataFrame:
    """Chunks of every chapter."""
    return G.chunk_chapters(_chapters(spark, data_dir), MOST).drop("book_id", "chapter_title")


def heading_chapters(spark: SparkSession, data_dir: str) -> DataFrame:
    """Chapters of books by heading lines; the lines of the contents list give empty chapters."""
    chapters = _chapters(spark, data_dir)
    head = F.concat(F.lit("Chapter "), F.col("chapter_index").cast("string"), F.lit(" "), F.coalesce(F.col("title"), F.lit("untitled")))
    return G.split_by_headings(_books(chapters, head))


def title_chapters(spark: SparkSession, data_dir: str) -> DataFrame:
    """Chapters of books by their titles; copies in the contents list are passed over."""
    chapters = _chapters(spark, data_dir)
    head = F.concat(F.lit("§ "), F.col("chapter_index").cast("string"), F.lit(" "), F.coalesce(F.col("title"), F.lit("untitled")))
    titles = chapters.select("book_id", F.col("chapter_index").alias("ord"), head.alias("title")).distinct()
    return G.split_by_titles(_books(chapters, head), titles)


def page_chapters(spark: SparkSession, data_dir: str) -> DataFrame:
    """Chapters by page: chunks as pages, the contents naming the first chunk of each chapter."""
    chunks = read_table(spark, data_dir, "chunks").where("chunk_id IS NOT NULL").distinct()
    # Pages are numbered within chapters and moved by the pages of the chapters before: a book's pages are never one window.
    sizes = chunks.groupBy("book_id", "chapter_index").agg(F.count("*").alias("n"))
    before = Window.partitionBy("book_id").orderBy("chapter_index").rowsBetween(Window.unboundedPreceding, -1)
    moved = sizes.select("book_id", F.col("chapter_index").alias("at"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("moved"))
    in_chapter = Window.partitionBy("book_id", "chapter_index").orderBy("chunk_index", "chunk_id")
    same = chunks["book_id"].eqNullSafe(moved["book_id"]) & chunks["chapter_index"].eqNullSafe(moved["at"])
    chunks = chunks.join(moved, same).drop(moved["book_id"])
    order = (F.col("moved") + F.row_number().over(in_chapter) - 1).cast("int")
    pages = chunks.select(
        "book_id", order.alias("page_index"), F.coalesce("source_text", F.lit("")).alias("text"), "chapter_id", "chapter_index", "chapter_title"
    )
    toc = pages.groupBy("book_id", "chapter_id").agg(
        F.min("chapter_index").alias("ord"), F.min("page_index").alias("page_index"), F.coalesce(F.min("chapter_title"), F.lit("")).alias("title")
    ).select("book_id", "ord", "title", "page_index")
    return G.split_by_pages(pages.select("book_id", "page_index", "text"), toc)


QUERIES = {
    "chunk_pack": chunk_pack, "heading_chapters": heading_chapters, "title_chapters": title_chapters, "page_chapters": page_chapters,
}


def _books_sql(head: str) -> str:
    return f"""
        c AS (SELECT *, {head} AS head FROM (SELECT DISTINCT * FROM chapters WHERE chapter_id IS NOT NULL)),
        b AS (SELECT book_id, 'Contents' || chr(10) || string_agg(head, chr(10) ORDER BY chapter_index, head) || chr(10) || chr(10)
            || string_agg(head || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY chapter_index, head || chr(10) || coalesce(text, '')) AS raw
            FROM c GROUP BY book_id),
        l AS (SELECT book_id, i AS line_no, ls[i] AS line FROM
            (SELECT book_id, {Q.lines('raw')} AS ls FROM b), unnest(range(1, len(ls) + 1)) u(i))"""


_BODY = f"""
        SELECT book_id, {Q.slug('title')} || '-' || CAST(chapter_index AS VARCHAR) AS chapter_id, CAST(chapter_index AS INT) AS chapter_index, title,
            {Q.strip("coalesce(body, '')")} AS text
        FROM (SELECT book_id, chapter_index, max(title) FILTER (is_head) AS title,
                string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT is_head) AS body
            FROM m WHERE chapter_index >= 0 GROUP BY book_id, chapter_index)"""

SQL = {
    "chunk_pack": rf"""
        WITH RECURSIVE c AS (SELECT DISTINCT * FROM chapters WHERE chapter_id IS NOT NULL AND length({Q.strip("coalesce(text, '')")}) > 0),
        p AS (SELECT chapter_id, i, ps[i] AS para, {Q.words('ps[i]')} AS n FROM
            (SELECT chapter_id, {Q.filled(f"list_transform(string_split_regex(text, '{chr(92)}n{Q.WS}*{chr(92)}n'), lambda x: {Q.strip('x')})")} AS ps FROM c),
            unnest(range(1, len(ps) + 1)) u(i)),
        s AS (SELECT chapter_id, i, j, ss[j] AS sent FROM
            (SELECT chapter_id, i, {Q.filled(f"list_transform(string_split(regexp_replace(para, '([.!?]){Q.WS}+', '{chr(92)}1' || chr(2), 'g'), chr(2)), lambda x: {Q.strip('x')})")} AS ss
                FROM p WHERE n > {MOST}), unnest(range(1, len(ss) + 1)) u(j)),
        w AS (SELECT *, string_split_regex(sent, '{Q.WS}+') AS ws FROM s),
        a0 AS (SELECT chapter_id, i, j, 0 AS k, sent AS atom, len(ws) AS n, FALSE AS hard FROM w WHERE len(ws) <= {MOST}
            UNION ALL SELECT chapter_id, i, j, k, array_to_string(ws[k * {MOST} + 1:(k + 1) * {MOST}], ' '), {MOST} + 1, TRUE
            FROM w, unnest(range(0, (len(ws) + {MOST} - 1) // {MOST})) u(k) WHERE len(ws) > {MOST}),
        a AS (SELECT *, row_number() OVER (PARTITION BY chapter_id, i ORDER BY j, k) AS r FROM a0),
        g AS (SELECT chapter_id, i, r, n AS held, 1 AS grp, hard FROM a WHERE r = 1
            UNION ALL SELECT a.chapter_id, a.i, a.r, CASE WHEN a.hard OR g.hard OR g.held + a.n > {MOST} THEN a.n ELSE g.held + a.n END,
                CASE WHEN a.hard OR g.hard OR g.held + a.n > {MOST} THEN g.grp + 1 ELSE g.grp END, a.hard
            FROM g JOIN a ON a.chapter_id = g.chapter_id AND a.i = g.i AND a.r = g.r + 1),
        u0 AS (SELECT chapter_id, i, 0 AS grp, para AS unit FROM p WHERE n <= {MOST}
            UNION ALL SELECT a.chapter_id, a.i, g.grp, string_agg(atom, ' ' ORDER BY a.r) FROM a JOIN g USING (chapter_id, i, r) GROUP BY ALL),
        u AS (SELECT chapter_id, unit, {Q.words('unit')} AS n, row_number() OVER (PARTITION BY chapter_id ORDER BY i, grp) AS r FROM u0),
        h AS (SELECT chapter_id, r, n AS held, 0 AS grp FROM u WHERE r = 1
            UNION ALL SELECT u.chapter_id, u.r, CASE WHEN h.held + u.n > {MOST} THEN u.n ELSE h.held + u.n END,
                CASE WHEN h.held + u.n > {MOST} THEN h.grp + 1 ELSE h.grp END
            FROM h JOIN u ON u.chapter_id = h.chapter_id AND u.r = h.r + 1),
        k AS (SELECT chapter_id, grp AS chunk_index, string_agg(unit, chr(10) || chr(10) ORDER BY u.r) AS source_text FROM u JOIN h USING (chapter_id, r) GROUP BY ALL)
        SELECT k.chapter_id || '-' || {Q.slug("coalesce(title, '')")} || '-' || CAST(chunk_index AS VARCHAR) AS chunk_id, k.chapter_id, chapter_index, chunk_index,
            {Q.strip('source_text')} AS source_text, {Q.estimate('source_text')} AS source_token_estimate
        FROM k JOIN c USING (chapter_id)
    """,
    "heading_chapters": rf"""
        WITH {_books_sql("'Chapter ' || CAST(chapter_index AS VARCHAR) || ' ' || coalesce(title, 'untitled')")},
        t AS (SELECT *, regexp_matches(line, '(?i)^(?:chapter|part|section){Q.WS}+[^\n]+$') AS is_head, {Q.strip('line')} AS title FROM l),
        m AS (SELECT *, sum(CAST(is_head AS INT)) OVER (PARTITION BY book_id ORDER BY line_no) - 1 AS chapter_index FROM t)
        {_BODY}
    """,
    "title_chapters": f"""
        WITH {_books_sql("'§ ' || CAST(chapter_index AS VARCHAR) || ' ' || coalesce(title, 'untitled')")},
        -- Heads are unique in a book, so the last line that equals one is its place and their order is that of the index.
        h AS (SELECT c.book_id, c.head AS title, row_number() OVER (PARTITION BY c.book_id ORDER BY c.chapter_index) - 1 AS nth, max(line_no) AS line_no
            FROM c JOIN l ON l.book_id = c.book_id AND lower({Q.strip('l.line')}) = lower({Q.strip('c.head')}) GROUP BY c.book_id, c.head, c.chapter_index),
        t AS (SELECT l.book_id, l.line_no, line, h.title, h.nth, h.title IS NOT NULL AS is_head FROM l LEFT JOIN h USING (book_id, line_no)),
        m AS (SELECT *, coalesce(last_value(nth IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), -1) AS chapter_index FROM t)
        {_BODY}
    """,
    "page_chapters": f"""
        WITH d AS (SELECT DISTINCT * FROM chunks WHERE chunk_id IS NOT NULL),
        p AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY chapter_index, chunk_index, chunk_id) - 1 AS page_index FROM d),
        t AS (SELECT book_id, min(chapter_index) AS ord, min(page_index) AS low, coalesce(min(chapter_title), '') AS title FROM p GROUP BY book_id, chapter_id),
        s AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY ord) - 1 AS chapter_index,
            coalesce(lead(low) OVER (PARTITION BY book_id ORDER BY ord), 1000000000) AS high FROM t),
        j AS (SELECT s.book_id, s.chapter_index, s.title, coalesce(string_agg({Q.strip('p.source_text')}, chr(10) || chr(10) ORDER BY p.page_index)
                FILTER ({Q.strip("coalesce(p.source_text, '')")} <> ''), '') AS body
            FROM s LEFT JOIN p ON p.book_id = s.book_id AND p.page_index >= s.low AND p.page_index < greatest(s.high, s.low + 1) GROUP BY ALL)
        SELECT book_id, {Q.slug('title')} || '-' || CAST(chapter_index AS VARCHAR) AS chapter_id, chapter_index, title,
            CASE WHEN lower({Q.strip("split_part(body, chr(10), 1)")}) = lower({Q.strip('title')})
                THEN {Q.strip("substr(body, strpos(body || chr(10), chr(10)) + 1)")} ELSE body END AS text
        FROM j
    """,
}
