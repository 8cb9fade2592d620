"""Queries of the scalar functions, predicates and extractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireloom.functions import extract as E
from quireloom.functions import predicates as P
from quireloom.functions import text as T
from quireloom.plans import sqltext as Q
from quireloom.sources import read_table, with_text


def text_scalars(spark: SparkSession, data_dir: str) -> DataFrame:
    """Scalar functions of every chunk's source and title."""
    rows = with_text(read_table(spark, data_dir, "chunks").where("chunk_id IS NOT NULL").distinct(), "source_text")
    s, title = F.col("source_text"), F.coalesce("chapter_title", F.lit(""))
    return rows.select(
        "chunk_id", T.slug(title).alias("slug"), T.word_count(s).alias("words"), T.estimate_tokens(s).alias("tokens"),
        T.latin_letters(s).alias("latin"), T.cjk_characters(s).alias("cjk"), T.plain_unit(s).alias("unit"),
        T.sentence_count(s).alias("sentences"), T.is_meaningful(title).alias("meaningful"), T.excerpt(s).alias("excerpt"),
        T.signature_token(s).alias("signature"), F.size(T.numeric_anchors(s)).alias("anchors"), T.key(title).alias("title_key"),
        F.size(T.match_tokens(s)).alias("match_tokens"), T.excerpt_fingerprint(s).alias("fingerprint"),
        T.inline_html(s).alias("html"), T.header_cut(title).alias("header"), T.epub_identifier(title).alias("epub_id"),
        F.size(T.paragraphs(s)).alias("paragraphs"), T.drop_markup(s).alias("plain"), T.to_float(title).alias("number"),
    )


def text_spacing(spark: SparkSession, data_dir: str) -> DataFrame:
    """Editorial, publishing and print spacing of every translation."""
    t = F.col("translated_text")
    return with_text(read_table(spark, data_dir, "translations"), "translated_text").select(
        "seq", T.tidy_spacing(t).alias("tidy"), T.proofread(t).alias("proofread"), T.tighten_mixed(t).alias("tight"),
        T.contains_cjk(t).alias("has_cjk"), T.mixes_scripts(t).alias("mixed"), T.has_markup(t).alias("markup"),
    )


def text_predicates(spark: SparkSession, data_dir: str) -> DataFrame:
    """Predicates over the text of every block."""
    t = F.coalesce("text", F.lit(""))
    return read_table(spark, data_dir, "blocks").select(
        "block_no", P.is_reference(t).alias("reference"), P.is_boundary_heading(t).alias("boundary"), P.is_line_block(t).alias("line_block"),
        P.is_question(t).alias("question"), P.is_answer(t).alias("answer"), P.is_question_line(t).alias("question_line"),
        P.is_emphasised(t).alias("emphasised"), P.is_chapter_heading(t).alias("chapter_heading"), P.is_book_title(t).alias("book_title"),
        P.is_section_heading(t).alias("section_heading"), P.is_numbered_item(t).alias("numbered"), P.is_title_candidate(t).alias("title_like"),
        P.is_preface(t).alias("preface"), P.is_prompt_echo(t).alias("prompt_echo"), P.is_rule(t).alias("rule"),
        T.caption_key(t).alias("caption_key"), E.ordered_marker(t).alias("marker"), E.ordered_start(t).alias("list_start"),
    )


def page_samples(spark: SparkSession, data_dir: str) -> DataFrame:
    """Sample pages of books with as many pages as they have chapters."""
    books = read_table(spark, data_dir, "chapters").groupBy("book_id").agg(F.countDistinct("chapter_id").cast("int").alias("n"))
    return books.select("book_id", "n", F.array_join(T.sample_pages(F.col("n")).cast("array<string>"), ",").alias("pages"))


def inline_lists(spark: SparkSession, data_dir: str) -> DataFrame:
    """Items of lists of every chunk: by lines, and of the same text run together."""
    rows = with_text(read_table(spark, data_dir, "chunks").where("chunk_id IS NOT NULL").distinct(), "source_text")
    s = F.col("source_text")
    return rows.select(
        "chunk_id", E.block_numbers(s).alias("numbers"), F.size(E.numbered_lines(s)).alias("numbered_lines"),
        P.counts_up(E.block_numbers(s), 3).alias("counts_up"), F.size(E.inline_items(T.squeeze(s))).alias("inline_items"),
        E.has_inline_run(T.squeeze(s), 3).alias("inline_run"),
    )


QUERIES = {
    "text_scalars": text_scalars, "text_spacing": text_spacing, "text_predicates": text_predicates,
    "page_samples": page_samples, "inline_lists": inline_lists,
}

_TITLE = "coalesce(chapter_title, '')"
_X = "source_text"
_REFERENCE = r"(?i)https?://|www\.|[\"“”]|\b(?:podcast|summit|conference|speech|interview|blog|transcript|episode|plan)\b"


def _is(pattern: str, x: str = "t") -> str:
    return f"regexp_matches({x}, '{pattern}')"


_FLAT = Q.squeeze("t")
_REF = f"({_is(f'^[0-9]{{2,4}}{Q.WS}+{Q.NS}', _FLAT)} AND {_is(_REFERENCE, _FLAT)})"
_LINE = rf"(?i)^{Q.WS}*(?:[0-9]{{1,3}}[.)]|[-*]|•|(?:q|question|问|a|answer|答){Q.WS}*[:：]){Q.WS}+{Q.NS}"
_X_REF = f"(regexp_matches({Q.squeeze('x')}, '^[0-9]{{2,4}}{Q.WS}+{Q.NS}') AND regexp_matches({Q.squeeze('x')}, '{_REFERENCE}'))"
_PARTS = Q.filled_lines("t")
_HEADING = r"(regexp_matches(t, '^(?:第|PART|Part)') AND regexp_matches(t, '章|部分|Chapter|PART'))"
_BOOK = "(starts_with(t, '《') AND ends_with(t, '》'))"
_S = Q.strip("t")
_PROMPT = " OR ".join(f"starts_with(t, '{p}')" for p in P.PROMPT_STARTS)

SQL = {
    "text_scalars": f"""
        WITH d AS (SELECT DISTINCT * FROM (SELECT * REPLACE (coalesce(source_text, '') AS source_text) FROM chunks)
            WHERE chunk_id IS NOT NULL)
        SELECT chunk_id, {Q.slug(_TITLE)} AS slug, {Q.words(_X)} AS words, {Q.estimate(_X)} AS tokens,
            {Q.count(_X, '[A-Za-z]')} AS latin, {Q.count(_X, Q.CJK)} AS cjk, {Q.unit(_X)} AS unit,
            {Q.sentence_count(_X)} AS sentences, {Q.meaningful(_TITLE)} AS meaningful, {Q.excerpt(_X)} AS excerpt,
            {Q.signature(_X)} AS signature, len({Q.anchors(_X)}) AS anchors, {Q.key(_TITLE)} AS title_key,
            len({Q.match_tokens(_X)}) AS match_tokens, {Q.fingerprint(_X)} AS fingerprint, {Q.inline(_X)} AS html,
            CASE WHEN length({_TITLE}) <= 22 THEN {_TITLE} ELSE left({_TITLE}, 21) || '…' END AS header,
            CASE WHEN {Q.key(_TITLE)} = '' THEN 'epub-book' ELSE 'epub-' || left({Q.key(_TITLE)}, 32) END AS epub_id,
            len({Q.paragraphs(_X)}) AS paragraphs, {Q.sub(_X, '<[^>]+>', '')} AS plain, try_cast({_TITLE} AS DOUBLE) AS number
        FROM d
    """,
    "text_spacing": rf"""
        WITH a AS (
            SELECT seq, translated_text AS t,
                regexp_replace(regexp_replace(replace(translated_text, chr(13) || chr(10), chr(10)), '[ \t]{{2,}}', ' ', 'g'),
                    '^以下是《[^》]+》[^\n]*?简体中文翻译[:：]{Q.WS}*', '') AS p
            FROM (SELECT * REPLACE (coalesce(translated_text, '') AS translated_text) FROM translations)),
        b AS (SELECT *, {Q.marked_items('p')} AS m FROM a),
        c AS (SELECT *, regexp_extract_all(m, chr(2) || '([0-9]{{1,3}})' || chr(3), 1) AS nums,
                string_split_regex(m, chr(2) || '[0-9]{{1,3}}' || chr(3)) AS parts FROM b),
        d AS (SELECT *, list_filter(list_transform(range(1, len(nums) + 1), lambda i: {{'n': nums[i], 'b': {Q.squeeze('parts[i + 1]')}}}),
                lambda x: x.b <> '') AS items FROM c),
        e AS (SELECT *, array_to_string(list_transform(items, lambda x: x.n || '. ' || x.b), chr(10)) AS body, {Q.strip('parts[1]')} AS intro FROM d),
        f AS (SELECT seq, t, CASE WHEN NOT (contains(p, chr(10) || '1. ') AND contains(p, chr(10) || '2. '))
                AND len(nums) >= 3 AND CAST(nums[1] AS INT) = 1 AND CAST(nums[2] AS INT) = 2 AND CAST(nums[3] AS INT) = 3 AND len(items) >= 3
                THEN CASE WHEN intro <> '' THEN intro || chr(10) || chr(10) || body ELSE body END ELSE p END AS r FROM e),
        g AS (SELECT seq, t, {Q.sub(Q.sub('r', rf'({Q.CJK})[ \t]+({Q.CJK})', r'\1\2'), rf'({Q.CJK})[ \t]+({Q.CJK})', r'\1\2')} AS r FROM f),
        h AS (SELECT seq, t, {Q.sub(Q.sub('r', rf'({Q.CJK})[ \t]*([A-Za-z0-9])', r'\1 \2'), rf'([A-Za-z0-9])[ \t]*({Q.CJK})', r'\1 \2')} AS r FROM g),
        i AS (SELECT seq, t, {Q.sub(Q.sub('r', r'[ \t]+([，。！？；：,.!?;:])', r'\1'), r'([，。！？；：])[ \t]+', r'\1')} AS r FROM h)
        SELECT seq, {Q.tidy('t')} AS tidy, {Q.strip(Q.few_breaks('r'))} AS proofread, {Q.tighten('t')} AS tight,
            {_is(Q.CJK)} AS has_cjk, {_is(Q.CJK)} AND {_is('[A-Za-z0-9]')} AS mixed, contains(t, '<') AND contains(t, '>') AS markup
        FROM i
    """,
    "text_predicates": rf"""
        WITH b AS (SELECT block_no, coalesce(text, '') AS t FROM blocks)
        SELECT block_no, {_REF} AS reference, {_is(f'(?i)^(?:part|chapter){Q.WS}+[ivxlcdm0-9]+$', _FLAT)} AS boundary,
            len({_PARTS}) >= 3 AND (len(list_filter({_PARTS}, lambda x: NOT regexp_matches(x, '{_LINE}'))) = 0
                OR len(list_filter({_PARTS}, lambda x: NOT {_X_REF})) = 0) AS line_block,
            {_is(f'(?i)^{Q.WS}*(?:q|question|问){Q.WS}*[:：]{Q.WS}*{Q.NS}')} AS question,
            {_is(f'(?i)^{Q.WS}*(?:a|answer|答){Q.WS}*[:：]{Q.WS}*{Q.NS}')} AS answer,
            ({_is(f'(?i)^(?:q|question|问){Q.WS}*[:：]{Q.WS}*{Q.NS}', _FLAT)} OR {_is('[?？]$', _FLAT)}) AS question_line,
            (length({_FLAT}) <= 120 AND {_is('[.!?。！？]$', _FLAT)} AND
                {_is(r'(?i)\b(remember|note|important|key point|takeaway)\b|记住|注意|重点|要点', _FLAT)}) AS emphasised,
            {_HEADING} AS chapter_heading, {_BOOK} AS book_title,
            ({_BOOK} OR {_HEADING} OR (length(t) <= 24 AND NOT {_is('[。！？；.!?;:]$')})
                OR (upper(t) = t AND lower(t) <> t AND length(t) <= 80)) AS section_heading,
            {_is(rf'^[0-9]{{1,3}}\.{Q.WS}+{Q.NS}')} AS numbered,
            ({_is(Q.CJK)} AND length({_S}) <= 34 AND NOT {_is('[。！？；!?]$', _S)} AND {Q.count('t', Q.CJK)} >= 3
                AND {Q.count('t', Q.CJK)} / greatest(length({Q.sub('t', Q.WS + '+', '')}), 1) >= 0.45) AS title_like,
            (starts_with(t, '以下是') AND contains(t, '简体中文') AND {_is('翻译|内容')}) AS preface,
            ({_PROMPT} OR (contains(t, '本书：') AND contains(t, '章节：') AND contains(t, '分块索引：'))
                OR ({_is('^(?:本书|这本书|书名)')} AND contains(t, '原文片段索引：'))) AS prompt_echo,
            {_is('^[-*_]{3,}$')} AS rule, {Q.caption_key('t')} AS caption_key,
            regexp_extract(t, '^{Q.WS}*([0-9]{{1,3}}[.)]){Q.WS}+{Q.NS}', 1) AS marker,
            CASE WHEN try_cast(regexp_extract(t, '^{Q.WS}*([0-9]{{1,3}})[.)]{Q.WS}+', 1) AS INT) > 1
                THEN try_cast(regexp_extract(t, '^{Q.WS}*([0-9]{{1,3}})[.)]{Q.WS}+', 1) AS INT) END AS list_start
        FROM b
    """,
    "page_samples": """
        WITH b AS (SELECT book_id, CAST(count(DISTINCT chapter_id) AS INT) AS n FROM chapters GROUP BY book_id)
        SELECT book_id, n, array_to_string(CASE WHEN n < 1 THEN [] WHEN n <= 12 THEN range(1, n + 1)
            ELSE list_sort(list_distinct([1, 2, 3, 4, 5, n // 2, n // 2 + 1, n - 2, n - 1, n])) END, ',') AS pages
        FROM b
    """,
    "inline_lists": rf"""
        WITH d AS (SELECT DISTINCT chunk_id, source_text AS t, {Q.squeeze('source_text')} AS f FROM (SELECT * REPLACE (coalesce(source_text, '') AS source_text) FROM chunks)
            WHERE chunk_id IS NOT NULL),
        n AS (SELECT *, {Q.block_numbers('t')} AS numbers, {Q.marked_items('f', '[.)]')} AS m FROM d),
        i AS (SELECT *, list_transform(regexp_extract_all(m, chr(2) || '([0-9]{{1,3}})' || chr(3), 1), lambda x: CAST(x AS INT)) AS nums,
            {Q.filled(f"list_transform(string_split_regex(m, chr(2) || '[0-9]{{1,3}}' || chr(3))[2:], lambda x: {Q.strip('x')})")} AS parts,
            list_transform(regexp_extract_all(regexp_replace(f, '(^|[^0-9])([0-9]{{1,3}}[.)]{Q.WS}+{Q.NS})', '\1' || chr(2) || '\2', 'g'),
                chr(2) || '([0-9]{{1,3}})', 1), lambda x: CAST(x AS INT)) AS gaps FROM n)
        SELECT chunk_id, numbers, len(list_filter({Q.filled_lines('t')}, lambda x: regexp_matches(x, '^[0-9]{{1,3}}[.)]{Q.WS}*{Q.NS}'))) AS numbered_lines,
            {Q.counts_up('numbers')} AS counts_up,
            CASE WHEN len(nums) >= 3 AND nums[1] = 1 AND nums[2] = 2 AND nums[3] = 3 AND len(parts) >= 3 THEN len(parts) ELSE 0 END AS inline_items,
            {Q.counts_up('gaps')} AS inline_run
        FROM i
    """,
}
