"""Queries of audits, finding merges, lexicons and editorial passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireloom.operators import audit as A
from quireloom.operators import editorial as D
from quireloom.operators import review as R
from quireloom.operators.assembly import latest_translations
from quireloom.operators.deep_review import deep_review
from quireloom.operators.layout import layout_annotations
from quireloom.operators.summary import finding_rollup
from quireloom.plans import sqlblocks as B
from quireloom.plans import sqltext as Q
from quireloom.plans import texts
from quireloom.sources import read_table, with_text


def _pairs(spark: SparkSession, data_dir: str) -> DataFrame:
    chunks = read_table(spark, data_dir, "chunks").where("chunk_id IS NOT NULL").distinct()
    latest = latest_translations(read_table(spark, data_dir, "translations").select("chunk_id", "seq", "translated_text"))
    return chunks.join(latest, "chunk_id").select(
        "chunk_id", F.col("chapter_title").alias("source_title"), "source_text", F.col("translated_text").alias("target_text")
    )


def audit_findings(spark: SparkSession, data_dir: str) -> DataFrame:
    """Findings of every chunk against its latest translation."""
    return A.audit_pairs(_pairs(spark, data_dir), ["chunk_id"]).drop("reason", "agent_role")


def collapsed_lists(spark: SparkSession, data_dir: str) -> DataFrame:
    """Findings of chunks with lists against the same text run together, which collapses every list."""
    rows = read_table(spark, data_dir, "chunks").where("chunk_id IS NOT NULL").distinct()
    pairs = rows.select("chunk_id", F.col("chapter_title").alias("source_title"), "source_text", F.regexp_replace("source_text", r"\s*\n\s*", " ").alias("target_text"))
    return A.audit_pairs(pairs, ["chunk_id"]).where("finding_type IN ('collapsed_numbered_list', 'list_structure_loss')").select(
        "chunk_id", "finding_type", "source_signature", "severity", "confidence"
    )


def _side(spark: SparkSession, data_dir: str, role: str) -> DataFrame:
    rows = read_table(spark, data_dir, "findings").where(F.col("agent_role") == role)
    kept = rows.select(
        "finding_id", "chapter_id", "block_id", "source_signature", "finding_type", "severity", "source_excerpt", "target_excerpt",
        "auto_fixable", "confidence",
    )
    return R.one_of_each(R.with_key(kept), "finding_id")


def consensus_merge(spark: SparkSession, data_dir: str) -> DataFrame:
    """Audit and review findings merged by key, with the bucket and the preferred finding."""
    merged = R.merge_findings(_side(spark, data_dir, "audit"), _side(spark, data_dir, "review"))
    return merged.select("finding_key", "bucket", R.preferred(F.col("audit"), F.col("review"))["finding_id"].alias("preferred_id"))


def fix_candidates(spark: SparkSession, data_dir: str) -> DataFrame:
    """Fixable findings after the arbiters."""
    merged = R.merge_findings(_side(spark, data_dir, "audit"), _side(spark, data_dir, "review"))
    return R.fix_candidates(merged, _side(spark, data_dir, "arbiter")).select("finding_key", "finding_id", "confidence")


def arbitration(spark: SparkSession, data_dir: str) -> DataFrame:
    """Disputed findings with the arbiter's choice and the fallback."""
    merged = R.merge_findings(_side(spark, data_dir, "audit"), _side(spark, data_dir, "review"))
    a, r = F.col("audit"), F.col("review")
    return R.arbitration_queue(merged).select(
        "finding_key", R.arbiter_choice(a, r)["finding_id"].alias("chosen_id"), R.fallback_choice(a, r)["finding_id"].alias("fallback_id")
    )


def finding_counts(spark: SparkSession, data_dir: str) -> DataFrame:
    """Findings of every book counted by what they are about."""
    return finding_rollup(read_table(spark, data_dir, "findings"))


def lexicon_clean(spark: SparkSession, data_dir: str) -> DataFrame:
    return D.clean_lexicon(read_table(spark, data_dir, "lexicon"))


def lexicon_merge(spark: SparkSession, data_dir: str) -> DataFrame:
    """Names as generated, glossary entries as overrides."""
    clean = D.clean_lexicon(read_table(spark, data_dir, "lexicon"))
    first = clean.groupBy("kind", "source").agg(F.min("ord").alias("ord"), F.min_by("translation", "ord").alias("translation"))
    return D.merge_lexicons(first.where("kind = 'name'"), first.where("kind = 'glossary'"))


def ordered_replace(spark: SparkSession, data_dir: str) -> DataFrame:
    """Every chunk's source with glossary and names put in, one entry after the other."""
    clean = D.clean_lexicon(read_table(spark, data_dir, "lexicon"))
    order = F.struct((F.col("kind") == "name").alias("late"), "ord", "source", "translation")
    rows = with_text(read_table(spark, data_dir, "chunks").where("chunk_id IS NOT NULL").select("chunk_id", F.col("source_text").alias("text")).distinct(), "text")
    return D.revise(rows, clean.where(F.col("kind").isin("glossary", "name")), order)


def proofread_notes(spark: SparkSession, data_dir: str) -> DataFrame:
    """What the publishing pass says of every translation."""
    rows = with_text(read_table(spark, data_dir, "translations").select("seq", F.col("translated_text").alias("text")), "text")
    return D.proofread_texts(rows).select("seq", "note_type", "severity")


def block_repairs(spark: SparkSession, data_dir: str) -> DataFrame:
    return D.repair_blocks(with_text(read_table(spark, data_dir, "blocks"), "text")).select("block_no", "text")


def annotations(spark: SparkSession, data_dir: str) -> DataFrame:
    """Callouts and question blocks of findings over the text of their chapters' translations."""
    pairs = read_table(spark, data_dir, "chapters").where("chapter_id IS NOT NULL").select("chapter_id", F.col("text").alias("source_text")).distinct()
    blocks = read_table(spark, data_dir, "blocks").where("chapter_id IS NOT NULL AND text IS NOT NULL")
    texts = blocks.groupBy("chapter_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("order_index", "block_no", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    findings = read_table(spark, data_dir, "findings").select("chapter_id", F.col("finding_id").alias("ord"), "finding_type", "target_excerpt", "source_excerpt", "reason")
    return layout_annotations(findings, texts.join(pairs, "chapter_id"))


def _review(spark: SparkSession, data_dir: str) -> dict[str, DataFrame]:
    sources = read_table(spark, data_dir, "chapters").where("chapter_id IS NOT NULL").groupBy("book_id", "chapter_id", "chapter_index").agg(
        F.min("title").alias("title"), F.min("text").alias("text")
    )
    chunks = read_table(spark, data_dir, "chunks").where("chunk_id IS NOT NULL").select("book_id", "chapter_id", "chapter_index", "chunk_id", "chunk_index").distinct()
    latest = latest_translations(read_table(spark, data_dir, "translations").select("chunk_id", "seq", "translated_text"))
    texts = chunks.join(latest, "chunk_id").groupBy("book_id", "chapter_id", "chapter_index").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "translated_text"))), lambda x: x["translated_text"]), "\n\n").alias("text")
    )
    return deep_review(texts, sources)


def review_chapters(spark: SparkSession, data_dir: str) -> DataFrame:
    """Chapters after the deep review of all books."""
    return _review(spark, data_dir)["chapters"]


def review_findings(spark: SparkSession, data_dir: str) -> DataFrame:
    """Findings that stay after the repairs of the deep review."""
    return _review(spark, data_dir)["confirmation"].select("chapter_id", "finding_type", "severity", "source_signature")


def review_fixes(spark: SparkSession, data_dir: str) -> DataFrame:
    """Findings that the deep review repairs."""
    return _review(spark, data_dir)["fixes"].select("finding_key", "chapter_id", "finding_type", "severity", "confidence")


QUERIES = {
    "audit_findings": audit_findings, "collapsed_lists": collapsed_lists, "consensus_merge": consensus_merge,
    "fix_candidates": fix_candidates, "arbitration": arbitration, "finding_counts": finding_counts, "lexicon_clean": lexicon_clean,
    "lexicon_merge": lexicon_merge, "ordered_replace": ordered_replace, "proofread_notes": proofread_notes,
    "block_repairs": block_repairs, "annotations": annotations, "review_chapters": review_chapters, "review_findings": review_findings,
    "review_fixes": review_fixes,
}

_S = Q.strip


def _units(x: str, title: str | None) -> tuple[str, str]:
    """Units of a text as SQL, without the title unit, and the test for units that do not count at the end."""
    reference = r"(?i)https?://|www\.|[\"“”]|\b(?:podcast|summit|conference|speech|interview|blog|transcript|episode|plan)\b"
    line = rf"(?i)^{Q.WS}*(?:[0-9]{{1,3}}[.)]|[-*]|•|(?:q|question|问|a|answer|答){Q.WS}*[:：]){Q.WS}+{Q.NS}"

    def is_ref(v: str) -> str:
        return f"(regexp_matches({Q.squeeze(v)}, '^[0-9]{{2,4}}{Q.WS}+{Q.NS}') AND regexp_matches({Q.squeeze(v)}, '{reference}'))"

    parts, meant = Q.filled_lines("p"), f"list_filter({Q.sentences(Q.squeeze('p'))}, lambda x: {Q.meaningful('x')})"
    block = (
        f"(len({parts}) >= 3 AND (len(list_filter({parts}, lambda x: NOT regexp_matches(x, '{line}'))) = 0 "
        f"OR len(list_filter({parts}, lambda x: NOT {is_ref('x')})) = 0))"
    )
    units = (
        f"flatten(list_transform({Q.paragraphs(x)}, lambda p: CASE WHEN {block} THEN list_filter({parts}, lambda x: {Q.meaningful('x')}) "
        f"WHEN len({meant}) >= 3 THEN {meant} ELSE [{Q.squeeze('p')}] END))"
    )
    tail = f"({is_ref('x')} OR regexp_matches({Q.squeeze('x')}, '(?i)^(?:part|chapter){Q.WS}+[ivxlcdm0-9]+$'))"
    if title:
        units = (
            f"(SELECT CASE WHEN {Q.unit(title)} <> '' AND {Q.unit('us[1]')} = {Q.unit(title)} THEN us[2:] ELSE us END FROM (SELECT {units} AS us))"
        )
    return units, tail


_LIST = r"(?i)\b(remember|note|important|key point|takeaway)\b"
_QM, _AM = f"(?mi)^{Q.WS}*(?:q|question|问){Q.WS}*[:：]", f"(?mi)^{Q.WS}*(?:a|answer|答){Q.WS}*[:：]"
_SU, _TAIL = _units("s", "ti")
_TU, _ = _units("t", None)


def _body(us: str) -> str:
    """Units up to the last one that is no reference and no part heading."""
    flags = f"list_transform({us}, lambda x: {_TAIL})"
    return f"{us}[1:coalesce(list_max(list_filter(range(1, len({us}) + 1), lambda i: NOT {flags}[i])), 0)]"


def _audit(base: str, key: str, name: str) -> str:
    """Findings of ``base`` (key, ti, s, t) as steps of which the last is ``name``."""
    steps = f"""
        {name}_n AS MATERIALIZED (SELECT *, {Q.block_numbers('s')} AS sn, {Q.block_numbers('t')} AS tn, {_SU} AS su0, {_TU} AS tu0,
            {Q.sentence_count('s')} AS ss, {Q.sentence_count('t')} AS ts,
            list_transform({Q.lines('t')}, lambda x: list_transform(regexp_extract_all(regexp_replace(x, '(^|[^0-9])([0-9]{{1,3}}[.)]{Q.WS}+{Q.NS})', '\\1' || chr(2) || '\\2', 'g'),
                chr(2) || '([0-9]{{1,3}})', 1), lambda y: CAST(y AS INT))) AS runs,
            regexp_extract_all(s, '[\"“”]([^\\n]{{12,140}}?)[\"“”]', 1) AS quotes FROM {base}),
        {name}_u AS MATERIALIZED (SELECT *, {_body('su0')} AS su, {_body('tu0')} AS tu, {Q.counts_up('sn')} AS listed, {Q.counts_up('tn')} AS kept,
            len(list_filter(runs, lambda r: {Q.counts_up('r')})) > 0 AS inline FROM {name}_n),
        {name}_m AS (SELECT *, listed AND NOT kept AND inline AS collapsed, su[len(tu) + 1:] AS missing, len(su) AS nsu, len(tu) AS ntu,
            len(list_intersect({Q.anchors('s')}, {Q.anchors('t')})) AS anchors,
            ({Q.count('s', '[A-Za-z]')} >= greatest(12, {Q.count('s', Q.CJK)} * 2) AND {Q.count('t', Q.CJK)} >= greatest(8, {Q.count('t', '[A-Za-z]')} * 2)) AS crossed,
            {Q.unit('t')} AS plain FROM {name}_u),
        {name}_o AS MATERIALIZED (SELECT *, list_filter(list_transform(missing, lambda x: {Q.unit('x')}), lambda x: length(x) >= 6) AS checked FROM {name}_m),
        {name}_f AS (
            SELECT {key}, 'collapsed_numbered_list' AS finding_type, s AS se, t AS te, sn, missing, quotes FROM {name}_o WHERE collapsed
            UNION ALL SELECT {key}, 'list_structure_loss', s, t, sn, missing, quotes FROM {name}_o WHERE listed AND sn <> tn
            UNION ALL SELECT {key}, 'possible_omission', array_to_string(missing, chr(10)), t, sn, missing, quotes FROM {name}_o
            WHERE NOT collapsed AND NOT (ss >= 3 AND ts >= ss) AND nsu >= 3 AND ntu < nsu
                AND NOT (nsu >= 3 AND ntu >= 2 AND ((crossed AND (ntu * 2 >= nsu OR (ss >= 3 AND ts >= 2 AND nsu <= 6)
                    OR (anchors >= 3 AND ts >= greatest(4, floor(ss * 0.08))) OR (ss >= 8 AND ntu >= 8 AND ts >= greatest(12, floor(ss * 0.2)))))
                    OR (anchors >= 6 AND ts >= greatest(12, floor(ss * 0.6)) AND ntu >= greatest(8, floor(nsu * 0.75)))))
                AND NOT (len(checked) > 0 AND len(list_filter(checked, lambda x: contains(plain, x))) * 10 >= len(checked) * 8)
            UNION ALL SELECT {key}, 'callout_candidate', {_S('quotes[1]')}, t, sn, missing, quotes FROM {name}_o
            WHERE len(quotes) > 0 AND regexp_matches(s, '{_LIST}') AND NOT regexp_matches(t, '[\"“”「」『』]')
            UNION ALL SELECT {key}, 'question_answer_structure', s, t, [{Q.count('s', _QM)}, {Q.count('s', _AM)}], missing, quotes FROM {name}_o
            WHERE {Q.count('s', _QM)} > 0 AND {Q.count('s', _AM)} > 0
                AND NOT ({Q.count('t', _QM)} >= {Q.count('s', _QM)} AND {Q.count('t', _AM)} >= {Q.count('s', _AM)})),
        {name} AS (SELECT {key}, finding_type, CASE WHEN finding_type IN ('collapsed_numbered_list', 'list_structure_loss') THEN 'high' ELSE 'medium' END AS severity,
            {Q.excerpt('se')} AS source_excerpt, {Q.excerpt('te')} AS target_excerpt,
            finding_type NOT IN ('possible_omission', 'question_answer_structure') AS auto_fixable,
            CASE finding_type WHEN 'collapsed_numbered_list' THEN 0.95 WHEN 'list_structure_loss' THEN 0.9 WHEN 'possible_omission' THEN 0.65
                WHEN 'callout_candidate' THEN 0.75 ELSE 0.7 END::DOUBLE AS confidence,
            CASE finding_type WHEN 'possible_omission' THEN 'possible_omission:' || len(missing) || ':' || array_to_string(list_transform(missing, lambda x: {Q.signature('x')})[1:3], '-')
                WHEN 'callout_candidate' THEN 'callout_candidate:' || {Q.signature('se')}
                WHEN 'question_answer_structure' THEN 'question_answer_structure:q' || sn[1] || ':a' || sn[2]
                ELSE finding_type || ':' || array_to_string(sn[1:5], '-') END AS source_signature
        FROM {name}_f)"""
    return steps


_PAIRED = """
        l AS (SELECT chunk_id, max_by(translated_text, seq) AS tt FROM
                (SELECT chunk_id, seq, coalesce(translated_text, '') AS translated_text FROM translations WHERE chunk_id IS NOT NULL) GROUP BY chunk_id),
        d AS (SELECT DISTINCT chunk_id, coalesce(chapter_title, '') AS ti, coalesce(source_text, '') AS s FROM chunks WHERE chunk_id IS NOT NULL),
        b AS (SELECT chunk_id, ti, s, tt AS t FROM d JOIN l USING (chunk_id))"""
_AUDIT = f"WITH {_PAIRED},{_audit('b', 'chunk_id', 'audited')} SELECT * FROM audited"

_SIDE = f"""
        k AS (SELECT *, {Q.finding_key()} AS finding_key FROM findings),
        z AS (SELECT *, row_number() OVER (PARTITION BY agent_role, finding_key ORDER BY finding_id DESC) AS nth FROM k),
        a AS (SELECT * FROM z WHERE agent_role = 'audit' AND nth = 1), r AS (SELECT * FROM z WHERE agent_role = 'review' AND nth = 1),
        j AS (SELECT coalesce(a.finding_key, r.finding_key) AS finding_key, a.finding_id AS ai, r.finding_id AS ri, a.confidence AS ac, r.confidence AS rc,
            a.auto_fixable AS af, r.auto_fixable AS rf,
            CASE WHEN coalesce(a.confidence < 0.6, FALSE) OR coalesce(r.confidence < 0.6, FALSE) OR a.finding_id IS NULL OR r.finding_id IS NULL THEN 'low_confidence'
                WHEN a.chapter_id IS NOT DISTINCT FROM r.chapter_id AND a.block_id IS NOT DISTINCT FROM r.block_id
                    AND a.finding_type IS NOT DISTINCT FROM r.finding_type AND a.severity IS NOT DISTINCT FROM r.severity
                    AND a.auto_fixable IS NOT DISTINCT FROM r.auto_fixable THEN 'agreed' ELSE 'disputed' END AS bucket
            FROM a FULL OUTER JOIN r ON a.finding_key = r.finding_key)"""
_TAKES_AUDIT = "ai IS NOT NULL AND (ri IS NULL OR coalesce(ac, -1) > coalesce(rc, -1))"

_CLEAN = f"""
        e AS (SELECT kind, ord, {_S('source')} AS source, {_S('translation')} AS translation FROM lexicon),
        x AS (SELECT kind, source, translation, min(ord) AS ord FROM e WHERE source <> '' AND translation <> '' GROUP BY ALL)"""

_BLOCK_STEPS, _BLOCK_ROWS = B.text_blocks("base")
_SAME_SIDES = "a.severity = r.severity AND a.auto_fixable = r.auto_fixable"
# The steps of the deep review: audit, blocks, second audit, merge, arbiter, repair, third audit.
_REVIEW = f"""
        WITH src AS (SELECT book_id, chapter_id, chapter_index, min(title) AS title, min(text) AS text FROM chapters WHERE chapter_id IS NOT NULL GROUP BY ALL),
        lt AS (SELECT chunk_id, arg_max(struct_pack(t := translated_text), seq).t AS translated_text FROM translations WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
        art AS (SELECT book_id, chapter_id, chapter_index, coalesce(string_agg(translated_text, chr(10) || chr(10) ORDER BY chunk_index, translated_text), '') AS text
            FROM (SELECT DISTINCT book_id, chapter_id, chapter_index, chunk_id, chunk_index FROM chunks WHERE chunk_id IS NOT NULL) JOIN lt USING (chunk_id) GROUP BY ALL),
        ids AS (SELECT book_id, chapter_id, arg_max(struct_pack(id := chapter_id, title := title, text := text), chapter_index) AS s FROM src GROUP BY ALL),
        ixs AS (SELECT book_id, chapter_index, arg_max(struct_pack(id := chapter_id, title := title, text := text), chapter_id) AS s FROM src GROUP BY ALL),
        mt AS (SELECT art.*, coalesce(ids.s, ixs.s) AS s FROM art LEFT JOIN ids ON art.book_id = ids.book_id AND art.chapter_id = ids.chapter_id
            LEFT JOIN ixs ON art.book_id = ixs.book_id AND art.chapter_index = ixs.chapter_index),
        base AS (SELECT chapter_id, text, s.text AS source_text FROM mt WHERE s IS NOT NULL),
        sides AS (SELECT book_id, chapter_id, chapter_index, text, coalesce(s.title, '') AS ti, coalesce(s.text, '') AS s FROM mt WHERE s IS NOT NULL),
        lost AS (SELECT book_id, chapter_id, chapter_index, text FROM mt WHERE s IS NULL),
        one AS (SELECT chapter_id, ti, s, text AS t FROM sides),{_audit("one", "chapter_id", "first")},{_BLOCK_STEPS},{B.blocks_text(_BLOCK_ROWS, "body")},
        two AS (SELECT chapter_id, ti, s, body.text AS t FROM sides JOIN body USING (chapter_id)),{_audit("two", "chapter_id", "second")},
        ka AS (SELECT *, {Q.finding_key()} AS finding_key FROM (SELECT *, NULL::VARCHAR AS block_id FROM first)),
        kr AS (SELECT *, {Q.finding_key()} AS finding_key FROM (SELECT *, NULL::VARCHAR AS block_id FROM second)),
        fixes AS (
            SELECT r.finding_key, r.chapter_id, r.finding_type, r.severity, r.confidence FROM ka a JOIN kr r USING (finding_key)
                WHERE a.confidence >= 0.6 AND r.confidence >= 0.6 AND {_SAME_SIDES} AND r.auto_fixable
            UNION ALL SELECT finding_key, w.chapter_id, w.finding_type, w.severity, w.confidence FROM (SELECT a.finding_key,
                    CASE WHEN CASE WHEN r.auto_fixable AND r.confidence >= a.confidence THEN r.auto_fixable ELSE a.auto_fixable END
                        THEN CASE WHEN r.auto_fixable AND r.confidence >= a.confidence THEN r ELSE a END WHEN r.auto_fixable THEN r ELSE a END AS w
                FROM ka a JOIN kr r USING (finding_key) WHERE a.confidence >= 0.6 AND r.confidence >= 0.6 AND NOT ({_SAME_SIDES})) WHERE w.auto_fixable),
        fixed AS (SELECT * FROM (SELECT * EXCLUDE (text), {Q.tidy("text")} AS text FROM {_BLOCK_ROWS}) WHERE text <> '' OR kind = 'image'),{B.blocks_text("fixed", "final")},
        three AS (SELECT chapter_id, ti, s, final.text AS t FROM sides JOIN final USING (chapter_id)),{_audit("three", "chapter_id", "third")}"""
_NOTES, _NOTE_ROWS = B.annotations("nd0", "nc")

SQL = {
    "review_findings": f"{_REVIEW} SELECT chapter_id, finding_type, severity, source_signature FROM third",
    "review_fixes": f"{_REVIEW} SELECT * FROM fixes",
    "review_chapters": f"""
        {_REVIEW}, open AS (SELECT chapter_id, count(*) AS n FROM third GROUP BY chapter_id)
        SELECT book_id, sides.chapter_id, chapter_index, coalesce(final.text, '') AS text, coalesce(final.text, '') <> sides.text AS revised, coalesce(n, 0) AS n_unresolved
        FROM sides LEFT JOIN final USING (chapter_id) LEFT JOIN open USING (chapter_id)
        UNION ALL SELECT book_id, chapter_id, chapter_index, {_S("text")}, FALSE, 1 FROM lost
    """,
    "annotations": f"""
        WITH nd0 AS (SELECT chapter_id, finding_id AS ord, finding_type, target_excerpt, source_excerpt, reason FROM findings),
        nc AS (SELECT chapter_id, t.text, s.source_text FROM (SELECT chapter_id, string_agg(text, chr(10) || chr(10) ORDER BY order_index, block_no, text) AS text
                FROM blocks WHERE chapter_id IS NOT NULL AND text IS NOT NULL GROUP BY chapter_id) t
            JOIN (SELECT DISTINCT chapter_id, text AS source_text FROM chapters WHERE chapter_id IS NOT NULL) s USING (chapter_id)),{_NOTES}
        SELECT * FROM {_NOTE_ROWS}
    """,
    "audit_findings": _AUDIT,
    "collapsed_lists": rf"""
        WITH d AS (SELECT DISTINCT chunk_id, source_text AS s, regexp_replace(source_text, '\s*\n\s*', ' ', 'g') AS t FROM chunks WHERE chunk_id IS NOT NULL),
        n AS (SELECT chunk_id, {Q.block_numbers('s')} AS sn, {Q.block_numbers('t')} AS tn,
            list_transform(regexp_extract_all(regexp_replace(t, '(^|[^0-9])([0-9]{{1,3}}[.)]{Q.WS}+{Q.NS})', '\1' || chr(2) || '\2', 'g'), chr(2) || '([0-9]{{1,3}})', 1), lambda y: CAST(y AS INT)) AS run FROM d)
        SELECT chunk_id, 'collapsed_numbered_list' AS finding_type, 'collapsed_numbered_list:' || array_to_string(sn[1:5], '-') AS source_signature, 'high' AS severity, 0.95::DOUBLE AS confidence
        FROM n WHERE {Q.counts_up('sn')} AND NOT {Q.counts_up('tn')} AND {Q.counts_up('run')}
        UNION ALL SELECT chunk_id, 'list_structure_loss', 'list_structure_loss:' || array_to_string(sn[1:5], '-'), 'high', 0.9::DOUBLE FROM n WHERE {Q.counts_up('sn')} AND sn <> tn
    """,
    "consensus_merge": f"WITH {_SIDE} SELECT finding_key, bucket, CASE WHEN {_TAKES_AUDIT} THEN ai ELSE ri END AS preferred_id FROM j",
    "fix_candidates": f"""
        WITH {_SIDE},
        g AS (SELECT finding_key, CASE WHEN {_TAKES_AUDIT} THEN ai ELSE ri END AS id, 0 AS rank FROM j WHERE bucket = 'agreed'
            UNION ALL SELECT finding_key, finding_id, 1 FROM z WHERE agent_role = 'arbiter' AND nth = 1),
        h AS (SELECT g.finding_key, g.rank, f.finding_id, f.confidence FROM g JOIN findings f ON f.finding_id = g.id WHERE f.auto_fixable)
        SELECT finding_key, finding_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY finding_key ORDER BY rank DESC) AS q FROM h) WHERE q = 1
    """,
    "arbitration": f"""
        WITH {_SIDE} SELECT finding_key, CASE WHEN rf AND rc >= ac THEN ri ELSE ai END AS chosen_id,
            CASE WHEN rf THEN ri WHEN af THEN ai END AS fallback_id FROM j WHERE bucket = 'disputed'
    """,
    "finding_counts": """
        SELECT book_id, count(*) AS n_findings, count(*) FILTER (finding_type = 'missing_source_chapter') AS n_missing_source,
            count(*) FILTER (severity = 'high') AS n_high,
            count(*) FILTER (finding_type = 'missing_source_chapter' OR contains(finding_type, 'structure')) AS n_structural,
            count(*) FILTER (contains(finding_type, 'citation')) AS n_citation,
            count(*) FILTER (finding_type IN ('missing_image', 'missing_caption', 'image_anchor_loss')) AS n_image_or_caption,
            count(*) FILTER (confidence < 0.6) AS n_low_confidence
        FROM findings GROUP BY book_id
    """,
    "lexicon_clean": f"WITH {_CLEAN} SELECT kind, ord, source, translation FROM x",
    "lexicon_merge": f"""
        WITH {_CLEAN},
        y AS (SELECT kind, source, min(ord) AS ord, min_by(translation, ord) AS translation FROM x GROUP BY ALL),
        g AS (SELECT * FROM y WHERE kind = 'name'), o AS (SELECT * FROM y WHERE kind = 'glossary'),
        m AS (SELECT coalesce(g.source, o.source) AS source, coalesce(o.translation, g.translation) AS translation,
            g.source IS NULL AS late, coalesce(g.ord, o.ord) AS place FROM g FULL OUTER JOIN o ON g.source = o.source)
        SELECT row_number() OVER (ORDER BY late, place, source) - 1 AS ord, source, translation FROM m
    """,
    "ordered_replace": f"""
        WITH RECURSIVE {_CLEAN},
        y AS (SELECT source, translation, row_number() OVER (ORDER BY kind = 'name', ord, source, translation) AS k FROM x WHERE kind IN ('glossary', 'name')),
        w AS (SELECT DISTINCT chunk_id, coalesce(source_text, '') AS text, 0 AS k FROM chunks WHERE chunk_id IS NOT NULL
            UNION ALL SELECT chunk_id, replace(text, y.source, y.translation), y.k FROM w JOIN y ON y.k = w.k + 1)
        SELECT chunk_id, text FROM w WHERE k = (SELECT max(k) FROM y)
    """,
    "proofread_notes": f"""
        SELECT s.seq, CASE WHEN s.proofread <> coalesce(t.translated_text, '') THEN 'spacing_normalization' ELSE 'proofread_review' END AS note_type,
            CASE WHEN s.proofread <> coalesce(t.translated_text, '') THEN 'medium' ELSE 'info' END AS severity
        FROM ({texts.SQL["text_spacing"]}) s JOIN translations t USING (seq)
    """,
    "block_repairs": f"SELECT block_no, {Q.tidy('text')} AS text FROM (SELECT * REPLACE (coalesce(text, '') AS text) FROM blocks) WHERE {Q.tidy('text')} <> '' OR kind = 'image'",
}
