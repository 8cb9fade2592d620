"""Queries of assembly, roll-ups, layout rows, translation and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quireloom.operators import assembly as A
from quireloom.operators import layout as L
from quireloom.operators import summary as U
from quireloom.operators.editorial import clean_lexicon, entry_array, text_to_blocks
from quireloom.operators.translate import StubProvider, translate_chunks, user_prompt
from quireloom.plans import reviews
from quireloom.plans import sqlblocks as B
from quireloom.plans import sqltext as Q
from quireloom.sources import read_table
from quireloom.streaming.progress import event_windows, fold_events


def _tables(spark: SparkSession, data_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Chapters, chunks, translations, and as failed chunks those that no translation names."""
    chapters = read_table(spark, data_dir, "chapters").where("chapter_id IS NOT NULL")
    chunks = read_table(spark, data_dir, "chunks").where("chunk_id IS NOT NULL")
    translations = read_table(spark, data_dir, "translations")
    return chapters, chunks, translations, A.pending_chunks(chunks, translations)


def resume_pending(spark: SparkSession, data_dir: str) -> DataFrame:
    """Chunks still to be translated."""
    return _tables(spark, data_dir)[3].select("book_id", "chunk_id").distinct()


def last_write_wins(spark: SparkSession, data_dir: str) -> DataFrame:
    """The translation that counts for each chunk id."""
    return A.latest_translations(read_table(spark, data_dir, "translations")).select("chunk_id", "seq", "provider", "attempt_count")


def agg1_run_summary(spark: SparkSession, data_dir: str) -> DataFrame:
    """Run summary of every book."""
    _, chunks, translations, failed = _tables(spark, data_dir)
    return U.run_summary(chunks, translations, failed)


def run_totals(spark: SparkSession, data_dir: str) -> DataFrame:
    return U.overall(agg1_run_summary(spark, data_dir))


def _heads(chapters: DataFrame) -> DataFrame:
    return chapters.groupBy("book_id", "chapter_id", "chapter_index").agg(F.min("title").alias("title"))


def assemble_chapters(spark: SparkSession, data_dir: str) -> DataFrame:
    """Chapters put together from the latest translations, with placeholders for failed chunks."""
    chapters, chunks, translations, failed = _tables(spark, data_dir)
    return A.chapter_texts(_heads(chapters), chunks, translations, failed)


def assemble_books(spark: SparkSession, data_dir: str) -> DataFrame:
    """Books of the assembled chapters."""
    return A.book_texts(assemble_chapters(spark, data_dir))


def _blocks(spark: SparkSession, data_dir: str) -> DataFrame:
    """One block for each place: the last of those delivered again."""
    blocks = read_table(spark, data_dir, "blocks").where("chapter_id IS NOT NULL AND block_id IS NOT NULL AND order_index IS NOT NULL")
    fields = ["kind", "text", "source_anchor", "block_no"]
    best = blocks.groupBy("chapter_id", "block_id", "order_index").agg(F.max_by(F.struct(*fields), "block_no").alias("b"))
    return best.select("chapter_id", "block_id", "order_index", *[F.col(f"b.{f}").alias(f) for f in fields])


def structured_text(spark: SparkSession, data_dir: str) -> DataFrame:
    """Texts of chapters from their blocks."""
    return A.blocks_to_text(_blocks(spark, data_dir))


def adjacency_runs(spark: SparkSession, data_dir: str) -> DataFrame:
    return A.adjacency_runs(_blocks(spark, data_dir))


def chapters_html(spark: SparkSession, data_dir: str) -> DataFrame:
    """XHTML body of every chapter."""
    return L.chapters_html(_blocks(spark, data_dir))


def structured_printable(spark: SparkSession, data_dir: str) -> DataFrame:
    """Printable rows of blocks."""
    return L.structured_to_printable(_blocks(spark, data_dir).select("block_no", "kind", "text"))


def text_blocks(spark: SparkSession, data_dir: str) -> DataFrame:
    """Blocks of every chunk's latest translation; the numbered lines of the source anchor its items."""
    sources = read_table(spark, data_dir, "chunks").where("chunk_id IS NOT NULL").select("chunk_id", "source_text").distinct()
    latest = A.latest_translations(read_table(spark, data_dir, "translations").select("chunk_id", "seq", "translated_text"))
    rows = sources.join(latest, "chunk_id")
    return text_to_blocks(rows.select(F.col("chunk_id").alias("chapter_id"), F.col("translated_text").alias("text"), "source_text"))


def printable_rows(spark: SparkSession, data_dir: str) -> DataFrame:
    """Printable blocks of every assembled chapter."""
    return L.printable_blocks(assemble_chapters(spark, data_dir))


def title_labels(spark: SparkSession, data_dir: str) -> DataFrame:
    """Header, contents and template labels of chapters; translated titles are the first heading block."""
    heads = _heads(read_table(spark, data_dir, "chapters").where("chapter_id IS NOT NULL"))
    headings = _blocks(spark, data_dir).where("kind = 'heading'").groupBy("chapter_id").agg(F.min_by("text", "order_index").alias("zh"))
    rows = heads.join(headings, "chapter_id", "left")
    en, zh = F.coalesce("title", F.lit("")), F.col("zh")
    return rows.select(
        "chapter_id", L.title_kind(en, zh).alias("kind"), L.header_title(en, zh).alias("header"), L.contents_label(en, zh).alias("label"),
        L.contents_line(en, zh).alias("line"), L.opening_template(L.title_kind(en, zh)).alias("template"),
        L.running_header(F.col("chapter_index"), en, L.header_title(en, zh))["left"].alias("left_header"),
        L.running_header(F.col("chapter_index"), en, L.header_title(en, zh))["right"].alias("right_header"),
    )


def stub_translations(spark: SparkSession, data_dir: str) -> DataFrame:
    """Pending chunks through the deterministic provider."""
    _, chunks, translations, failed = _tables(spark, data_dir)
    none = F.array().cast("array<struct<source:string,translation:string>>")
    prompts = failed.select("book_id", "chunk_id", "chapter_title", "chunk_index", "source_text").distinct().select(
        "chunk_id",
        user_prompt(
            F.coalesce("book_id", F.lit("")), F.coalesce("chapter_title", F.lit("")), F.col("chunk_index"),
            F.coalesce("source_text", F.lit("")), none, none,
        ).alias("prompt"),
        F.coalesce("source_text", F.lit("")).alias("source_text"),
    )
    return translate_chunks(prompts, StubProvider()).select("chunk_id", "ok", "translated_text", "input_tokens", "output_tokens", "attempt_count")


def prompts(spark: SparkSession, data_dir: str) -> DataFrame:
    """Prompts of every chunk with the glossary and the names of the lexicon; missing parts are empty."""
    clean = clean_lexicon(read_table(spark, data_dir, "lexicon"))
    order = F.struct("ord", "source", "translation")
    rows = read_table(spark, data_dir, "chunks").where("chunk_id IS NOT NULL").distinct()
    for kind in ("glossary", "name"):
        rows = rows.join(F.broadcast(entry_array(clean.where(F.col("kind") == kind), order, kind)), F.lit(True))
    none = F.lit("")
    return rows.select(
        "chunk_id",
        user_prompt(
            F.coalesce("book_id", none), F.coalesce("chapter_title", none), F.coalesce(F.col("chunk_index").cast("string"), none),
            F.coalesce("source_text", none), F.col("glossary"), F.col("name"),
        ).alias("prompt"),
    )


def run_details(spark: SparkSession, data_dir: str) -> DataFrame:
    """Chapters, provider, model and duration of every book's run."""
    chunks = read_table(spark, data_dir, "chunks").where("chunk_id IS NOT NULL")
    return U.run_details(chunks, read_table(spark, data_dir, "translations"))


def question_blocks(spark: SparkSession, data_dir: str) -> DataFrame:
    """Blocks with the question annotations of the findings put in."""
    place = F.row_number().over(Window.partitionBy("chapter_id").orderBy("order_index", "block_id")).alias("block_no")
    blocks = _blocks(spark, data_dir).select("chapter_id", place, "kind", "text")
    questions = reviews.annotations(spark, data_dir).where("kind = 'qa_block'").withColumnRenamed("value", "anchor").drop("kind")
    return L.apply_questions(blocks, questions)


def progress_fold(spark: SparkSession, data_dir: str) -> DataFrame:
    """Runs of users: their first event starts a run, purchases complete books, errors fail them."""
    events = read_table(spark, data_dir, "events")
    kinds = {"click": "book_started", "purchase": "book_completed", "error": "book_failed", "signup": "run_started", "view": "run_completed"}
    kind = None
    for name, value in kinds.items():
        kind = F.when(F.col("event_type") == name, value) if kind is None else kind.when(F.col("event_type") == name, value)
    rows = events.select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), kind.alias("type"), F.lit(None).cast("string").alias("book_name"),
        F.lit(10).alias("total_books"), F.lit(None).cast("string").alias("error"),
    ).where("type IS NOT NULL")
    return fold_events(rows).select("run_id", "status", "completed_books", "failed_books", "last_type", "last_seq", "progress")


def event_hours(spark: SparkSession, data_dir: str) -> DataFrame:
    """Events by type in tumbling hours."""
    return event_windows(read_table(spark, data_dir, "events"), "ts", "event_type").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


QUERIES = {
    "resume_pending": resume_pending, "last_write_wins": last_write_wins, "agg1_run_summary": agg1_run_summary, "run_totals": run_totals,
    "assemble_chapters": assemble_chapters, "assemble_books": assemble_books, "structured_text": structured_text,
    "adjacency_runs": adjacency_runs, "chapters_html": chapters_html, "structured_printable": structured_printable,
    "text_blocks": text_blocks, "printable_rows": printable_rows, "title_labels": title_labels, "stub_translations": stub_translations,
    "run_details": run_details, "question_blocks": question_blocks, "prompts": prompts, "progress_fold": progress_fold, "event_hours": event_hours,
}

_LATEST = "lt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY seq DESC) AS nth FROM translations WHERE chunk_id IS NOT NULL) WHERE nth = 1)"
_FAILED = "fa AS (SELECT DISTINCT * FROM chunks c WHERE chunk_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM translations t WHERE t.chunk_id = c.chunk_id))"
_SUMMARY = f"""
        WITH {_LATEST}, {_FAILED},
        d AS (SELECT book_id, count(*) AS success_chunks, sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens,
            CAST(round(sum(CAST(estimated_cost_usd AS DECIMAL(20, 8))), 6) AS DOUBLE) AS cost_usd, round(avg(latency_ms), 3) AS mean_latency_ms FROM lt GROUP BY book_id),
        n AS (SELECT book_id, count(DISTINCT chunk_id) AS total_chunks FROM chunks WHERE chunk_id IS NOT NULL GROUP BY book_id),
        f AS (SELECT book_id, count(DISTINCT chunk_id) AS failed_chunks FROM fa GROUP BY book_id)
        SELECT book_id, coalesce(total_chunks, 0) AS total_chunks, coalesce(success_chunks, 0) AS success_chunks, coalesce(failed_chunks, 0) AS failed_chunks,
            CAST(coalesce(input_tokens, 0) AS BIGINT) AS input_tokens, CAST(coalesce(output_tokens, 0) AS BIGINT) AS output_tokens,
            coalesce(cost_usd, 0.0) AS cost_usd, coalesce(mean_latency_ms, 0.0) AS mean_latency_ms
        FROM n FULL OUTER JOIN d USING (book_id) FULL OUTER JOIN f USING (book_id)"""
_CHAPTERS = f"""
        WITH {_LATEST}, {_FAILED},
        h AS (SELECT book_id, chapter_id, chapter_index, min(title) AS title FROM chapters WHERE chapter_id IS NOT NULL GROUP BY ALL),
        r AS (SELECT h.*, c.chunk_index,
            CASE WHEN {Q.strip("coalesce(lt.translated_text, '')")} <> '' THEN {Q.strip('lt.translated_text')}
                WHEN c.chunk_id IN (SELECT chunk_id FROM fa) THEN '[[翻译失败: ' || coalesce(h.title, '') || ' / chunk ' || CAST(c.chunk_index AS VARCHAR) || ']]' END AS part
            FROM (SELECT DISTINCT chapter_id, chunk_id, chunk_index FROM chunks WHERE chunk_id IS NOT NULL) c JOIN h USING (chapter_id) LEFT JOIN lt USING (chunk_id)),
        ch AS (SELECT book_id, chapter_id, chapter_index, title, string_agg(part, chr(10) || chr(10) ORDER BY chunk_index, part) AS text, count(part) AS n_parts
            FROM r GROUP BY ALL HAVING count(part) > 0)"""
_BLOCKS = """
        bl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chapter_id, block_id, order_index ORDER BY block_no DESC) AS nth
            FROM blocks WHERE chapter_id IS NOT NULL AND block_id IS NOT NULL AND order_index IS NOT NULL) WHERE nth = 1)"""
_MARK = f"regexp_extract(coalesce(source_anchor, ''), '^{Q.WS}*([0-9]{{1,3}}[.)]){Q.WS}+{Q.NS}', 1)"
_EN, _ZH = "coalesce(title, '')", "coalesce(zh, '')"


def _xml(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '>', '&gt;'), '<', '&lt;')"


_SHORT = _EN
for _separator in (" | ", " — ", " - ", ": ", " A Guide to "):
    _SHORT = f"CASE WHEN contains({_EN}, '{_separator}') THEN {Q.strip(f'split_part({_EN}, {chr(39)}{_separator}{chr(39)}, 1)')} ELSE {_SHORT} END"
_HEADER = "coalesce(nullif(zh, ''), nullif(title, ''), '未命名章节')"
_KIND = f"CASE WHEN {_EN} = '' AND {_ZH} = '' THEN 'fallback' WHEN starts_with(lower({_EN}), 'part ') OR (starts_with({_ZH}, '第') AND contains({_ZH}, '部分')) THEN 'part' ELSE 'chapter' END"
_FIRST = "coalesce(nullif(zh, ''), title, '')"

_TEXT_BLOCKS, _BLOCK_ROWS = B.text_blocks("base")
_PRINTABLE, _PRINT_ROWS = B.printable("ch")


def _match(x: str) -> str:
    """Comparison form of an annotation's text."""
    bare = f"translate({Q.squeeze(x)}, '“”\"', '')"
    return f"replace({Q.tighten(bare)}, ' ', '')"


_QUESTION, _ANSWER = (f"'(?i)^{Q.WS}*{m}{Q.WS}*[:：]{Q.WS}*{Q.NS}'" for m in (B.ASKS, B.ANSWERS))


def _cut_at(signs: str) -> tuple[str, str]:
    return Q.strip(f"regexp_extract(flat, '^([^{signs}]*[{signs}])', 1)"), Q.strip(f"regexp_replace(flat, '^[^{signs}]*[{signs}]', '')")


(_Q1, _A1), (_Q2, _A2) = _cut_at("?？"), _cut_at(".!?。！？")
_BOTH = f"'(?i)^({B.ASKS}{Q.WS}*[:：].+?){Q.WS}+({B.ANSWERS}{Q.WS}*[:：].+)$'"

SQL = {
    "run_details": """
        WITH c AS (SELECT book_id, count(DISTINCT chapter_id) AS n FROM chunks WHERE chunk_id IS NOT NULL GROUP BY book_id),
        t AS (SELECT book_id, arg_max(struct_pack(p := provider, m := model), seq) AS l,
            round((epoch_us(max(written_at)) - epoch_us(min(written_at))) / 1e6, 3) AS s FROM translations GROUP BY book_id)
        SELECT coalesce(c.book_id, t.book_id) AS book_id, coalesce(n, 0) AS total_chapters, l.p AS provider, l.m AS model, coalesce(s, 0.0) AS duration_seconds
        FROM c FULL OUTER JOIN t ON c.book_id = t.book_id
    """,
    "text_blocks": f"""
        WITH {_LATEST}, base AS (SELECT chunk_id AS chapter_id, translated_text AS text, source_text
            FROM (SELECT DISTINCT chunk_id, source_text FROM chunks WHERE chunk_id IS NOT NULL) JOIN lt USING (chunk_id)),{_TEXT_BLOCKS}
        SELECT * FROM {_BLOCK_ROWS}
    """,
    "printable_rows": f"{_CHAPTERS},{_PRINTABLE} SELECT * FROM {_PRINT_ROWS}",
    "resume_pending": f"WITH {_FAILED} SELECT DISTINCT book_id, chunk_id FROM fa",
    "last_write_wins": f"WITH {_LATEST} SELECT chunk_id, seq, provider, attempt_count FROM lt",
    "agg1_run_summary": _SUMMARY,
    "run_totals": f"SELECT count(*) AS books, CAST(sum(success_chunks) AS BIGINT) AS success_chunks, CAST(sum(failed_chunks) AS BIGINT) AS failed_chunks, CAST(round(sum(CAST(cost_usd AS DECIMAL(20, 8))), 6) AS DOUBLE) AS cost_usd FROM ({_SUMMARY})",
    "assemble_chapters": f"{_CHAPTERS} SELECT * FROM ch",
    "assemble_books": f"""{_CHAPTERS},
        p AS (SELECT book_id, chapter_index, nullif(concat_ws(chr(10) || chr(10), nullif({Q.strip('title')}, ''), nullif({Q.strip('text')}, '')), '') AS part FROM ch)
        SELECT book_id, {Q.strip("coalesce(string_agg(part, chr(10) || chr(10) ORDER BY chapter_index, part), '')")} || chr(10) AS text FROM p GROUP BY book_id
    """,
    "structured_text": f"""
        WITH {_BLOCKS},
        r AS (SELECT chapter_id, block_id, order_index, kind, CASE WHEN kind = 'ordered_item' AND {Q.strip("coalesce(text, '')")} <> ''
            THEN CASE WHEN {_MARK} <> '' THEN {_MARK} ELSE CAST(order_index AS VARCHAR) || '.' END || ' ' || {Q.strip('text')} ELSE {Q.strip('text')} END AS t FROM bl),
        g AS (SELECT *, lag(kind) OVER w AS prev, row_number() OVER w AS k FROM r WHERE t <> '' WINDOW w AS (PARTITION BY chapter_id ORDER BY order_index, block_id)),
        h AS (SELECT *, CASE WHEN k = 1 THEN '' WHEN (prev IN ('ordered_item', 'unordered_item') AND kind IN ('ordered_item', 'unordered_item'))
            OR (prev = 'qa_question' AND kind = 'qa_answer') THEN chr(10) WHEN prev IS NULL THEN '' ELSE chr(10) || chr(10) END || t AS piece FROM g)
        SELECT chapter_id, {Q.strip("string_agg(piece, '' ORDER BY k)")} AS text FROM h GROUP BY chapter_id
    """,
    "adjacency_runs": f"""
        WITH {_BLOCKS},
        s AS (SELECT *, CASE WHEN lag(kind) OVER w IS NOT DISTINCT FROM kind AND (row_number() OVER w > 1 OR kind IS NULL) THEN 0 ELSE 1 END AS starts
            FROM bl WINDOW w AS (PARTITION BY chapter_id ORDER BY order_index, block_id)),
        n AS (SELECT *, sum(starts) OVER (PARTITION BY chapter_id ORDER BY order_index, block_id) AS run_no FROM s)
        SELECT chapter_id, CAST(run_no AS BIGINT) AS run_no, max(kind) AS kind, min(order_index) AS first_index, max(order_index) AS last_index, count(*) AS n_blocks FROM n GROUP BY chapter_id, run_no
    """,
    "chapters_html": f"""
        WITH {_BLOCKS},
        s AS (SELECT *, CASE WHEN kind IN ('ordered_item', 'unordered_item') AND lag(kind) OVER w = kind THEN 0 ELSE 1 END AS starts, row_number() OVER w AS place
            FROM bl WINDOW w AS (PARTITION BY chapter_id ORDER BY order_index, block_id)),
        n AS (SELECT *, sum(starts) OVER (PARTITION BY chapter_id ORDER BY place) AS run_no, coalesce(text, '') AS t FROM s),
        g AS (SELECT chapter_id, run_no, max(kind) AS kind, max(CASE WHEN starts = 1 THEN source_anchor END) AS anchor,
            coalesce(string_agg(CASE WHEN {Q.strip('t')} <> '' THEN '<li>' || {Q.inline('t')} || '</li>' END, '' ORDER BY place), '') AS items, max(CASE WHEN starts = 1 THEN t END) AS t FROM n GROUP BY chapter_id, run_no),
        e AS (SELECT chapter_id, run_no, CASE
            WHEN kind IN ('ordered_item', 'unordered_item') AND items = '' THEN ''
            WHEN kind = 'ordered_item' THEN '<ol class="ordered-list"' || CASE WHEN try_cast(regexp_extract(coalesce(anchor, ''), '^{Q.WS}*([0-9]{{1,3}})[.)]{Q.WS}+', 1) AS INT) > 1
                THEN ' start="' || CAST(try_cast(regexp_extract(anchor, '^{Q.WS}*([0-9]{{1,3}})[.)]{Q.WS}+', 1) AS INT) AS VARCHAR) || '"' ELSE '' END || '>' || items || '</ol>'
            WHEN kind = 'unordered_item' THEN '<ul class="unordered-list">' || items || '</ul>'
            WHEN kind = 'heading' THEN '<h2>' || {Q.inline('t')} || '</h2>' WHEN kind = 'callout' THEN '<aside class="callout">' || {Q.paragraph_html('t')} || '</aside>'
            WHEN kind = 'qa_question' THEN '<p class="qa-question">' || {Q.inline('t')} || '</p>' WHEN kind = 'qa_answer' THEN '<p class="qa-answer">' || {Q.inline('t')} || '</p>'
            WHEN kind = 'quote' THEN '<blockquote>' || {Q.paragraph_html('t')} || '</blockquote>' WHEN kind = 'reference_entry' THEN '<p class="reference">' || {Q.inline('t')} || '</p>'
            WHEN kind IN ('caption', 'image') THEN CASE WHEN {Q.strip('t')} = '' THEN '' ELSE '<figure class="image-placeholder"><figcaption>' || {Q.inline('t')} || '</figcaption></figure>' END
            WHEN kind IS DISTINCT FROM 'paragraph' AND {Q.strip('t')} = '' THEN '' ELSE '<p>' || {Q.inline('t')} || '</p>' END AS element FROM g)
        SELECT chapter_id, coalesce(string_agg(nullif(element, ''), chr(10) ORDER BY run_no), '') AS html FROM e GROUP BY chapter_id
    """,
    "question_blocks": f"""
        WITH {_BLOCKS}, an AS (SELECT * FROM ({reviews.SQL["annotations"]})),
        p AS (SELECT chapter_id, row_number() OVER (PARTITION BY chapter_id ORDER BY order_index, block_id) AS no, kind, text,
            {_match("regexp_replace(coalesce(text, ''), '<[^>]+>', '', 'g')")} AS plain FROM bl),
        q0 AS (SELECT chapter_id, ord, {Q.strip("value")} AS anchor FROM an WHERE kind = 'qa_block'),
        q1 AS (SELECT *, {Q.filled_lines("anchor")} AS ls, {Q.squeeze("anchor")} AS flat, {_match("anchor")} AS target FROM q0),
        q2 AS (SELECT *, list_filter(ls, lambda x: regexp_matches(x, {_QUESTION}))[1] AS ql, list_filter(ls, lambda x: regexp_matches(x, {_ANSWER}))[1] AS al FROM q1),
        q3 AS (SELECT *, CASE
            WHEN len(ls) >= 2 AND ql IS NOT NULL AND al IS NOT NULL THEN {{'q': ql, 'a': al}} WHEN len(ls) >= 2 THEN {{'q': ls[1], 'a': ls[2]}}
            WHEN regexp_matches(flat, {_BOTH}) THEN {{'q': {Q.strip(f"regexp_extract(flat, {_BOTH}, 1)")}, 'a': {Q.strip(f"regexp_extract(flat, {_BOTH}, 2)")}}}
            WHEN {_Q1} <> '' AND {_A1} <> '' THEN {{'q': {_Q1}, 'a': {_A1}}} WHEN {_Q2} <> '' AND {_A2} <> '' THEN {{'q': {_Q2}, 'a': {_A2}}} END AS pair FROM q2),
        h1 AS (SELECT q3.chapter_id, ord, min(no) AS no, any_value(pair) AS pair FROM q3 JOIN p ON p.chapter_id = q3.chapter_id
            WHERE pair IS NOT NULL AND plain <> '' AND (target = '' OR contains(plain, target) OR contains(target, plain)) GROUP BY q3.chapter_id, ord),
        h2 AS (SELECT chapter_id, no, arg_min(pair, ord) AS pair FROM h1 GROUP BY chapter_id, no),
        j AS (SELECT p.*, h2.pair, lag(h2.pair) OVER (PARTITION BY p.chapter_id ORDER BY p.no) AS above FROM p LEFT JOIN h2 ON p.chapter_id = h2.chapter_id AND p.no = h2.no),
        k AS (SELECT *, {_match("regexp_replace(above.a, '<[^>]+>', '', 'g')")} AS said FROM j),
        x AS (SELECT chapter_id, no, kind, text, pair FROM k WHERE NOT coalesce(kind = 'paragraph' AND pair IS NULL AND above IS NOT NULL AND plain <> '' AND said <> '' AND ends_with(said, plain), FALSE)),
        y AS (SELECT chapter_id, no, 0 AS part, CASE WHEN pair IS NULL THEN kind ELSE 'qa_question' END AS kind, CASE WHEN pair IS NULL THEN text ELSE pair.q END AS text FROM x
            UNION ALL SELECT chapter_id, no, 1, 'qa_answer', pair.a FROM x WHERE pair IS NOT NULL)
        SELECT chapter_id, row_number() OVER (PARTITION BY chapter_id ORDER BY no, part) - 1 AS block_no, kind, text FROM y
    """,
    "structured_printable": f"""
        WITH {_BLOCKS}
        SELECT block_no, CASE kind WHEN 'ordered_item' THEN 'numbered_item' WHEN 'unordered_item' THEN 'paragraph' WHEN 'heading' THEN 'section_heading'
            WHEN 'reference_entry' THEN 'reference' WHEN 'image' THEN 'paragraph' ELSE coalesce(kind, 'paragraph') END AS kind, {Q.strip('text')} AS text
        FROM bl WHERE kind IN ('paragraph', 'qa_question', 'qa_answer', 'callout', 'quote', 'caption', 'ordered_item', 'unordered_item', 'heading', 'reference_entry') OR {Q.strip('text')} <> ''
    """,
    "title_labels": f"""
        WITH {_BLOCKS},
        h AS (SELECT chapter_id, chapter_index, min(title) AS title FROM chapters WHERE chapter_id IS NOT NULL GROUP BY book_id, chapter_id, chapter_index),
        z AS (SELECT chapter_id, min_by(text, order_index) AS zh FROM bl WHERE kind = 'heading' GROUP BY chapter_id),
        r AS (SELECT * FROM h LEFT JOIN z USING (chapter_id))
        SELECT chapter_id, {_KIND} AS kind, {_HEADER} AS header,
            CASE WHEN {_ZH} = '' THEN {_xml(_EN)} ELSE {_xml('zh')} || '<br/><font size=''8.5'' color=''#6B6259''>' || {_xml(_EN)} || '</font>' END AS label,
            CASE WHEN {Q.strip(_FIRST)} <> '' AND {_EN} <> {_FIRST} AND {Q.strip(_EN)} <> '' THEN {Q.strip(_FIRST)} || ' / ' || {Q.strip(_EN)}
                ELSE {Q.strip(_FIRST)} || CASE WHEN {_EN} <> {_FIRST} THEN {Q.strip(_EN)} ELSE '' END END AS line,
            CASE WHEN {_KIND} = 'part' THEN 'part-opening' ELSE 'chapter-opening' END AS template,
            CASE WHEN chapter_index % 2 = 0 THEN CASE WHEN length({_SHORT}) <= 18 THEN {_SHORT} ELSE left({_SHORT}, 17) || '…' END ELSE '' END AS left_header,
            CASE WHEN chapter_index % 2 = 0 THEN '' ELSE CASE WHEN length({_HEADER}) <= 22 THEN {_HEADER} ELSE left({_HEADER}, 21) || '…' END END AS right_header
        FROM r
    """,
    "stub_translations": f"""
        WITH {_FAILED} SELECT chunk_id, TRUE AS ok, '译文::' || coalesce(source_text, '') AS translated_text, 10 AS input_tokens, 12 AS output_tokens, 1 AS attempt_count
        FROM (SELECT DISTINCT book_id, chunk_id, chapter_title, chunk_index, source_text FROM fa)
    """,
    "prompts": f"""
        WITH e AS (SELECT kind, ord, {Q.strip('source')} AS source, {Q.strip('translation')} AS translation FROM lexicon),
        x AS (SELECT kind, source, translation, min(ord) AS ord FROM e WHERE source <> '' AND translation <> '' GROUP BY ALL),
        g AS (SELECT kind, string_agg('- ' || source || ': ' || translation, chr(10) ORDER BY ord, source, translation) AS lines FROM x GROUP BY kind)
        SELECT chunk_id, 'Book: ' || coalesce(book_id, '') || chr(10) || 'Chapter: ' || coalesce(chapter_title, '') || chr(10) || 'Chunk index: ' || coalesce(CAST(chunk_index AS VARCHAR), '') || chr(10) || chr(10)
            || 'Translate the following text into Simplified Chinese only:' || chr(10) || chr(10) || coalesce(source_text, '')
            || coalesce(chr(10) || chr(10) || 'Glossary:' || chr(10) || (SELECT lines FROM g WHERE kind = 'glossary'), '')
            || coalesce(chr(10) || chr(10) || 'Name map:' || chr(10) || (SELECT lines FROM g WHERE kind = 'name'), '') AS prompt
        FROM (SELECT DISTINCT * FROM chunks WHERE chunk_id IS NOT NULL)
    """,
    "progress_fold": """
        WITH e AS (SELECT user_id AS run_id, event_id AS seq, CASE event_type WHEN 'click' THEN 'book_started' WHEN 'purchase' THEN 'book_completed'
            WHEN 'error' THEN 'book_failed' WHEN 'signup' THEN 'run_started' WHEN 'view' THEN 'run_completed' END AS type FROM events),
        s AS (SELECT run_id, coalesce(max(seq) FILTER (type = 'run_started'), -1) AS s FROM e WHERE type IS NOT NULL GROUP BY run_id),
        f AS (SELECT run_id, s, max(seq) FILTER (type = 'run_completed' AND seq > s) AS f FROM e JOIN s USING (run_id) WHERE type IS NOT NULL GROUP BY run_id, s),
        g AS (SELECT run_id, CASE WHEN f IS NULL THEN 0 ELSE 10 END + count(*) FILTER (type = 'book_completed' AND seq > coalesce(f, s)) AS completed_books,
            count(*) FILTER (type = 'book_failed' AND seq > s) AS failed_books, max_by(type, seq) AS last_type, max(seq) AS last_seq,
            max_by(type, seq) FILTER (type IN ('run_completed', 'run_failed', 'run_started', 'book_failed')) AS ended, max_by(type, seq) FILTER (type <> 'run_failed') AS moved
            FROM e JOIN f USING (run_id) WHERE type IS NOT NULL GROUP BY run_id, s, f)
        SELECT run_id, CASE ended WHEN 'run_completed' THEN 'completed' WHEN 'run_started' THEN 'running' WHEN 'run_failed' THEN 'failed' WHEN 'book_failed' THEN 'failed' ELSE 'idle' END AS status,
            completed_books, failed_books, last_type, last_seq,
            CASE moved WHEN 'run_completed' THEN 1.0 WHEN 'run_started' THEN 0.0 ELSE least(completed_books / 10, 1.0) END::DOUBLE AS progress FROM g
    """,
    "event_hours": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
