"""SQL of blocks, printable rows and annotations, written as steps of common table expressions.

Each function gives the steps behind a ``WITH`` and the name of the last one. RE2 looks neither back nor ahead, so places
are marked with control characters at first and the text is cut there.
"""

from __future__ import annotations

from quireloom.plans import sqltext as Q

WS, NS, CJK = Q.WS, Q.NS, Q.CJK

# What makes a numbered line a reference, and marks of questions and answers.
SOURCES = r"(?i)https?://|www\.|[\"“”]|\b(?:podcast|summit|conference|speech|interview|blog|transcript|episode|plan)\b"
ASKS, ANSWERS = "(?:q|question|问)", "(?:a|answer|答)"


def is_reference(x: str) -> str:
    return f"(regexp_matches({x}, '^[0-9]{{2,4}}{WS}+{NS}') AND regexp_matches({x}, '{SOURCES}'))"


def text_blocks(base: str) -> tuple[str, str]:
    """Blocks of ``base`` (chapter_id, text, source_text)."""
    item = f"'^[0-9]{{1,3}}[.)]{WS}*{NS}'"
    tail = f"regexp_replace(flat, '(^|[^0-9])([0-9]{{2,4}}) ', '\\1' || chr(2) || '\\2' || chr(3), 'g')"
    tail = f"regexp_replace({tail}, '(^|[^0-9])([0-9]{{2,4}}) ', '\\1' || chr(2) || '\\2' || chr(3), 'g')"
    number = "CAST(split_part(seg[{}], chr(3), 1) AS INT)"
    steps = f"""
        tp AS (SELECT chapter_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS pno FROM (SELECT chapter_id, {Q.paragraphs('text')} AS ps FROM {base})),
        tl AS (SELECT *, {Q.filled_lines('p')} AS ls, {Q.squeeze('p')} AS flat FROM tp),
        ts AS (SELECT *, string_split({Q.marked_items('flat', '[.)]')}, chr(2)) AS seg,
            len(list_filter(ls, lambda x: NOT regexp_matches(x, {item}) OR len(string_split({Q.marked_items('x', '[.)]')}, chr(2))) > 2)) = 0 AS single FROM tl),
        ti AS (SELECT chapter_id, p, pno, CASE
            WHEN single THEN list_transform(ls, lambda x: {Q.strip(f"regexp_replace(x, '^[0-9]{{1,3}}[.)]{WS}*', '')")})
            WHEN len(seg) >= 4 THEN CASE WHEN {number.format(2)} = 1 AND {number.format(3)} = 2 AND {number.format(4)} = 3
                THEN {Q.filled(f"list_transform(seg[2:], lambda x: {Q.strip('split_part(x, chr(3), 2)')})")} ELSE [] END
            ELSE [] END AS items, single FROM ts),
        tu AS (SELECT chapter_id, p, pno, CASE WHEN single OR len(items) >= 3 THEN items ELSE [] END AS items FROM ti),
        tx AS (SELECT chapter_id, pno, unnest(items) AS body, generate_subscripts(items, 1) AS ino FROM tu WHERE len(items) > 0),
        tt AS (SELECT *, string_split({tail}, chr(2)) AS seg FROM (SELECT *, {Q.squeeze('body')} AS flat FROM tx)),
        tv AS (SELECT *, list_transform(seg[2:], lambda x: CAST(split_part(x, chr(3), 1) AS INT)) AS vals FROM tt),
        tw AS (SELECT *, list_filter(range(1, len(vals)), lambda i: vals[i + 1] = vals[i] + 1 AND regexp_matches(seg[i], '[.!?)\\]}}\"''。！？）] *$'))[1] AS spot FROM tv),
        ty AS (SELECT *, CASE WHEN spot IS NOT NULL THEN rtrim(replace(array_to_string(seg[1:spot], ''), chr(3), ' ')) END AS head FROM tw),
        tz AS (SELECT chapter_id, pno, ino, CASE WHEN coalesce(head, '') = '' THEN [{{'kind': 'ordered_item', 'text': flat}}]
            ELSE [{{'kind': 'ordered_item', 'text': head}}] || list_transform(
                {Q.filled(f"list_transform(seg[spot + 1:], lambda x: {Q.strip('replace(x, chr(3), chr(32))')})")},
                lambda x: {{'kind': CASE WHEN {is_reference('x')} THEN 'reference_entry' ELSE 'paragraph' END, 'text': x}}) END AS pieces FROM ty),
        te AS (SELECT chapter_id, pno, ino, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS k FROM tz
            UNION ALL SELECT chapter_id, pno, 1, {{'kind': 'paragraph', 'text': p}}, 1 FROM tu WHERE len(items) = 0),
        tn AS (SELECT chapter_id, piece.kind AS kind, piece.text AS text, row_number() OVER w AS order_index,
            count(*) FILTER (piece.kind = 'ordered_item') OVER w AS nth FROM te WINDOW w AS (PARTITION BY chapter_id ORDER BY pno, ino, k)),
        ta AS (SELECT chapter_id, list_filter({Q.filled_lines("coalesce(source_text, '')")}, lambda x: regexp_matches(x, {item})) AS anchors FROM {base}),
        tb AS MATERIALIZED (SELECT tn.chapter_id, tn.chapter_id || '-block-' || order_index AS block_id, kind, text, CAST(order_index AS INT) AS order_index,
            CASE WHEN kind = 'ordered_item' THEN anchors[nth] END AS source_anchor FROM tn JOIN ta USING (chapter_id))"""
    return steps, "tb"


def blocks_text(blocks: str, name: str) -> str:
    """Texts of chapters from ``blocks`` as the step ``name`` (chapter_id, text)."""
    mark = f"regexp_extract(coalesce(source_anchor, ''), '^{WS}*([0-9]{{1,3}}[.)]){WS}+{NS}', 1)"
    return f"""
        {name}_r AS (SELECT chapter_id, block_id, order_index, kind, CASE WHEN kind = 'ordered_item' AND {Q.strip("coalesce(text, '')")} <> ''
            THEN CASE WHEN {mark} <> '' THEN {mark} ELSE CAST(order_index AS VARCHAR) || '.' END || ' ' || {Q.strip('text')} ELSE {Q.strip('text')} END AS t FROM {blocks}),
        {name}_g AS (SELECT *, lag(kind) OVER w AS prev, row_number() OVER w AS k FROM {name}_r WHERE t <> '' WINDOW w AS (PARTITION BY chapter_id ORDER BY order_index, block_id)),
        {name}_h AS (SELECT *, CASE WHEN prev IS NULL THEN '' WHEN (prev IN ('ordered_item', 'unordered_item') AND kind IN ('ordered_item', 'unordered_item'))
            OR (prev = 'qa_question' AND kind = 'qa_answer') THEN chr(10) ELSE chr(10) || chr(10) END || t AS piece FROM {name}_g),
        {name} AS MATERIALIZED (SELECT chapter_id, {Q.strip("string_agg(piece, '' ORDER BY k)")} AS text FROM {name}_h GROUP BY chapter_id)"""


def annotations(findings: str, chapters: str) -> tuple[str, str]:
    """Annotations of ``findings`` (chapter_id, ord, finding_type, excerpts, reason) over ``chapters`` (chapter_id, text, source_text)."""
    text, target = "text", "te"
    quote = "regexp_extract_all(text, '[\"“”「」『』]([^\\n]{8,220}?)[\"“”「」『』]', 1)"
    context = Q.strip(f"concat_ws(' ', te, {Q.strip('se')}, {Q.strip('re')})")
    score = (
        "(CASE WHEN te <> '' AND contains(lower(te), lower(q)) THEN 8 ELSE 0 END + CASE WHEN te <> '' AND contains(lower(q), lower(te)) THEN 4 ELSE 0 END"
        f" + 3 * len(list_intersect({Q.match_tokens('q')}, tokens)))"
    )
    cue = r"(?i)\b(remember|note|important|key point|takeaway)\b|记住|注意|重点|要点"
    flat = Q.squeeze("x")
    stressed = f"list_filter({Q.filled_lines(text)}, lambda x: length({flat}) <= 120 AND regexp_matches({flat}, '[.!?。！？]$') AND regexp_matches({flat}, '{cue}'))[1]"

    def asks(x: str) -> str:
        return f"regexp_matches({x}, '(?i)^{WS}*{ASKS}{WS}*[:：]{WS}*{NS}')"

    def answers(x: str) -> str:
        return f"regexp_matches({x}, '(?i)^{WS}*{ANSWERS}{WS}*[:：]{WS}*{NS}')"

    def marked(x: str, mark: str) -> str:
        return f"regexp_matches({x}, '(?mi)^{WS}*{mark}{WS}*[:：]')"

    one, two = "ls[1]", "ls[2]"
    bare_pair = (
        f"(NOT {answers(one)} AND NOT {asks(two)} AND NOT regexp_matches({one}, '[.!?。！？:;：；]{WS}*$') "
        f"AND regexp_matches({one}, '[A-Za-z0-9\\x{{4E00}}-\\x{{9FFF}}]') AND regexp_matches({two}, '[.!?。！？]{WS}*$'))"
    )
    lined = f"len(ls) >= 2 AND ({asks(one)} OR regexp_matches({one}, '[?？]{WS}*$') OR (source_marked AND {bare_pair}))"
    explicit = f"'(?i)^({ASKS}{WS}*[:：].+?){WS}+({ANSWERS}{WS}*[:：].+?)$'"
    first = Q.strip("regexp_extract(flat, '^([^?？]*[?？])', 1)")
    rest = Q.strip("regexp_replace(flat, '^[^?？]*[?？]', '')")
    compact = (
        f"CASE WHEN regexp_matches(flat, {explicit}) THEN {Q.strip(f'regexp_extract(flat, {explicit}, 1)')} || chr(10) || {Q.strip(f'regexp_extract(flat, {explicit}, 2)')} "
        f"WHEN {first} <> '' AND {rest} <> '' THEN {first} || chr(10) || {rest} ELSE '' END"
    )
    steps = f"""
        nf AS (SELECT chapter_id, ord, finding_type, {Q.strip("coalesce(target_excerpt, '')")} AS te, coalesce(source_excerpt, '') AS se, coalesce(reason, '') AS re FROM {findings}
            WHERE finding_type IN ('callout_candidate', 'question_answer_structure')),
        nt AS (SELECT chapter_id, coalesce(text, '') AS text, coalesce(source_text, '') AS source_text FROM {chapters}),
        nd AS (SELECT *, list_transform({quote}, lambda q: {Q.strip('q')}) AS quotes, {Q.excerpt(text)} AS short, coalesce({stressed}, '') AS stressed,
            ({marked('source_text', ASKS)} AND {marked('source_text', ANSWERS)}) AS source_marked,
            string_split_regex(text, '\\n{WS}*\\n+') AS ps, {marked(text, ASKS)} AS q, {marked(text, ANSWERS)} AS a FROM nt),
        np AS (SELECT chapter_id, source_text, text, source_marked, unnest(ps) AS p, generate_subscripts(ps, 1) AS pno FROM nd),
        nl AS (SELECT *, {Q.filled_lines('p')} AS ls, {Q.squeeze('p')} AS flat FROM np),
        nx AS (SELECT chapter_id, source_text, text, min_by(pair, pno) AS pair FROM (SELECT *, CASE WHEN {lined} THEN {one} || chr(10) || {two} ELSE {compact} END AS pair FROM nl)
            WHERE pair <> '' GROUP BY chapter_id, source_text, text),
        nj AS (SELECT nf.*, nd.*, coalesce(nx.pair, '') AS pair, {Q.match_tokens(context)} AS tokens FROM nf JOIN nd ON nf.chapter_id = nd.chapter_id
            LEFT JOIN nx ON nx.chapter_id = nd.chapter_id AND nx.text = nd.text AND nx.source_text = nd.source_text),
        nb AS (SELECT *, list_aggregate(list_transform(quotes, lambda q, i: {{'score': {score}, 'at': -i}}), 'max') AS best FROM nj),
        nv AS (SELECT chapter_id, ord, CASE WHEN finding_type = 'callout_candidate' THEN 'callout' ELSE 'qa_block' END AS kind, CASE
            WHEN finding_type = 'callout_candidate' THEN coalesce(nullif(CASE WHEN best.score > 0 THEN quotes[-best.at] WHEN len(quotes) = 1 THEN quotes[1] ELSE '' END, ''), nullif(stressed, ''), nullif(te, ''), short)
            ELSE coalesce(nullif(pair, ''), nullif(te, ''), short) END AS value, q, a FROM nb),
        na AS (SELECT chapter_id, kind, value, min(ord) AS ord, bool_or(CASE WHEN kind = 'qa_block' THEN q END) AS has_question_marker,
            bool_or(CASE WHEN kind = 'qa_block' THEN a END) AS has_answer_marker FROM nv WHERE kind = 'qa_block' OR value <> '' GROUP BY chapter_id, kind, value)"""
    return steps, "na"


# Starts of lines that repeat the instructions given to a translator.
ECHOES = ("本书：", "这本书：", "书名：", "章节：", "分块索引：", "原文片段索引：", "翻译如下")


def _line(x: str, keep: str = "TRUE") -> str:
    """A line as it is printed; empty where it is not. keep: whether a lone number stays."""
    v = "v"
    starts = " OR ".join(f"starts_with({v}, '{e}')" for e in ECHOES)
    plain = f"regexp_replace(replace(replace({v}, '**', ''), '__', ''), '^\\*([^\\n]+)\\*$', '\\1')"
    gone = (
        f"(starts_with({v}, '以下是') AND contains({v}, '简体中文') AND (contains({v}, '翻译') OR contains({v}, '内容'))) OR {starts} "
        f"OR (contains({v}, '本书：') AND contains({v}, '章节：') AND contains({v}, '分块索引：')) "
        f"OR ((starts_with({v}, '本书') OR starts_with({v}, '这本书') OR starts_with({v}, '书名')) AND contains({v}, '原文片段索引：')) "
        f"OR regexp_full_match({v}, '[-*_]{{3,}}')"
    )
    value = Q.strip(f"regexp_replace({x}, '^#{{1,6}}{WS}*', '')")
    body = f"CASE WHEN {gone} THEN '' WHEN NOT ({keep}) AND regexp_full_match({plain}, '[0-9]+') THEN '' ELSE {plain} END"
    return f"list_transform([{value}], lambda v: {body})[1]"


def _number(x: str) -> str:
    return f"regexp_full_match({x}, '[0-9]+')"


def _xml(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '>', '&gt;'), '<', '&lt;')"


def printable(chapters: str) -> tuple[str, str]:
    """Printable rows of ``chapters`` (book_id, chapter_id, chapter_index, text)."""
    kept = Q.filled(f"list_transform(ls, lambda x: {_line('x')})")
    cut = (
        f"list_reduce([''] || kept, lambda acc, x: CASE WHEN string_split(acc, chr(4))[-1] = '' THEN acc || x "
        f"WHEN NOT {_number('x')} THEN acc || chr(5) || x "
        f"WHEN {_number('split_part(string_split(acc, chr(4))[-1], chr(5), 1)')} THEN acc || chr(4) || x ELSE acc || chr(5) || x || chr(4) END)"
    )
    senses = (
        f"CASE WHEN len(kept) = 0 THEN [] WHEN {_number('kept[1]')} THEN [kept] "
        f"WHEN len(list_filter(kept, lambda x: NOT regexp_matches(x, '^[0-9]{{1,3}}\\.{WS}+{NS}'))) = 0 THEN list_transform(kept, lambda x: [x]) "
        f"ELSE list_transform({Q.filled(f'string_split({cut}, chr(4))')}, lambda b: string_split(b, chr(5))) END"
    )
    entries = (
        f"CASE WHEN len(kept) > 0 AND {_number('kept[1]')} THEN list_transform(list_filter(list_transform("
        f"string_split(array_to_string(list_transform(kept, lambda x: CASE WHEN {_number('x')} THEN chr(4) || x ELSE chr(5) || x END), ''), chr(4))[2:], "
        f"lambda e: string_split(e, chr(5))), lambda e: len(e) > 1), lambda e: e[1] || ' ' || array_to_string(e[2:], ' ')) ELSE [] END"
    )
    last = f"coalesce(list_max(list_filter(range(1, len(kept) + 1), lambda i: NOT {_number('kept[i]')})), 0)"
    clean = Q.filled(f"list_transform(content, lambda x, i: {_line('x', 'i = 1 AND ' + _number('content[1]'))})")

    def book_title(x: str) -> str:
        return f"(starts_with({x}, '《') AND ends_with({x}, '》'))"

    def heading(x: str) -> str:
        return f"(regexp_matches({x}, '^(?:第|PART|Part)') AND regexp_matches({x}, '章|部分|Chapter|PART'))"

    def candidate(x: str) -> str:
        bare = Q.strip(x)
        return (
            f"(regexp_matches({bare}, '{CJK}') AND length({bare}) <= 34 AND NOT regexp_matches({bare}, '[。！？；!?]$') AND {Q.count(bare, CJK)} >= 3 "
            f"AND {Q.count(bare, CJK)} / greatest({Q.count(bare, NS)}, 1) >= 0.45)"
        )

    double = f"({heading('c[1]')} AND regexp_matches(c[1], '{CJK}') AND regexp_matches(c[1], '[：:]{WS}*$') AND coalesce({candidate('c[2]')}, FALSE))"
    single = f"(({heading('c[1]')} AND regexp_matches(c[1], '{CJK}')) OR {candidate('c[1]')})"
    flow = "list_reduce(lines, lambda a, x: CASE WHEN regexp_matches(a, '[A-Za-z0-9]$') AND regexp_matches(x, '^[A-Za-z0-9]') THEN a || ' ' || x ELSE a || x END)"
    raised = "<font color=''#2F5BD2'' size=''6.8''><super>{}</super></font>"
    marks = f"regexp_replace(flow, '([。！？!?；;:：”’」】）)])({WS}*)([0-9]{{2,4}})', '\\1' || chr(1) || '\\2' || chr(2) || '\\3' || chr(6), 'g')"
    other = f"[^{Q.WS[1:-1]}{CJK[1:-1]}]|[年月日号]"
    undone = f"regexp_replace({marks}, chr(1) || '({WS}*)' || chr(2) || '([0-9]{{2,4}})' || chr(6) || '({other})', '\\1\\2\\3', 'g')"
    styled = f"regexp_replace({_xml(undone)}, chr(1) || '{WS}*' || chr(2) || '([0-9]{{2,4}})' || chr(6), '{raised.format(chr(92) + '1')}', 'g')"
    cited = f"array_to_string(list_transform(cites, lambda n: replace('{raised.format('@')}', '@', n)), '')"
    called = f"(len(cites) > 0 AND length({Q.strip('flow')}) BETWEEN 1 AND 54 AND NOT regexp_matches({Q.strip('flow')}, '^(?:Q:|A:|问：|答：)') AND NOT {heading(Q.strip('flow'))} AND NOT {book_title(Q.strip('flow'))})"
    section = (
        f"({book_title('lines[1]')} OR {heading('lines[1]')} OR (length(lines[1]) <= 24 AND NOT regexp_matches(lines[1], '[。！？；.!?;:]$')) "
        f"OR (upper(lines[1]) = lines[1] AND lower(lines[1]) <> lines[1] AND length(lines[1]) <= 80))"
    )
    steps = f"""
        pr AS (SELECT book_id, chapter_id, chapter_index, unnest(rs) AS r, generate_subscripts(rs, 1) AS rno FROM
            (SELECT *, string_split_regex(replace(text, chr(13) || chr(10), chr(10)), '\\n{WS}*\\n+') AS rs FROM {chapters})),
        pk AS (SELECT * EXCLUDE (ls), {kept} AS kept FROM (SELECT *, {Q.filled_lines('r')} AS ls FROM pr)),
        ps AS (SELECT * EXCLUDE (kept), {senses} AS bs FROM pk),
        pb AS (SELECT book_id, chapter_id, chapter_index, rno, unnest(bs) AS ls, generate_subscripts(bs, 1) AS bno FROM ps),
        pn AS (SELECT * EXCLUDE (ls), {kept} AS kept FROM pb),
        pe AS (SELECT *, {entries} AS found, {last} AS last FROM pn),
        pc AS (SELECT * EXCLUDE (kept, found), CASE WHEN len(found) >= 2 THEN found ELSE [] END AS refs, kept[1:last] AS content, kept[last + 1:] AS cites FROM pe),
        pl AS (SELECT * EXCLUDE (content), {clean} AS c0 FROM pc),
        pf AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY chapter_index, chapter_id, rno, bno) AS spot FROM pl WHERE len(refs) > 0 OR len(c0) > 0),
        pt AS (SELECT book_id, min(spot) AS title_at FROM pf WHERE len(refs) = 0 AND {book_title('c0[1]')} GROUP BY book_id),
        pu AS (SELECT pf.*, CASE WHEN spot = title_at THEN c0[1] END AS book_title, CASE WHEN spot = title_at THEN c0[2:] ELSE c0 END AS c FROM pf LEFT JOIN pt ON pf.book_id = pt.book_id),
        pv AS (SELECT *, count(*) FILTER (len(refs) > 0 OR len(c) > 0) OVER (PARTITION BY book_id, chapter_id ORDER BY spot) = 1 AND len(refs) = 0 AND len(c) > 0 AS first FROM pu),
        pw AS (SELECT *, CASE WHEN first AND {double} THEN c[1] || c[2] WHEN first AND {single} THEN c[1] END AS chapter_title,
            CASE WHEN first AND {double} THEN c[3:] WHEN first AND {single} THEN c[2:] ELSE c END AS lines FROM pv),
        px AS (SELECT *, CASE WHEN len(refs) = 0 AND len(lines) > 0 THEN {Q.tighten(flow)} END AS flow FROM pw),
        py AS (SELECT *, CASE WHEN {called} THEN 'callout' WHEN len(lines) = 1 AND {section} THEN 'section_heading'
            WHEN len(lines) = 1 AND regexp_matches(lines[1], '^[0-9]{{1,3}}\\.{WS}+{NS}') THEN 'numbered_item' ELSE 'paragraph' END AS kind FROM px),
        pz AS (SELECT book_id, chapter_id, chapter_index, spot, list_transform(refs, lambda x: {{'kind': 'reference', 'text': x}})
            || CASE WHEN book_title IS NULL THEN [] ELSE [{{'kind': 'book_title', 'text': book_title}}] END
            || CASE WHEN chapter_title IS NULL THEN [] ELSE [{{'kind': 'chapter_title', 'text': chapter_title}}] END
            || CASE WHEN flow IS NULL THEN [] ELSE [{{'kind': kind, 'text': CASE WHEN kind = 'section_heading' AND len(cites) = 0 THEN {Q.tighten('lines[1]')} ELSE {styled} || {cited} END}}] END AS pieces FROM py),
        pq AS (SELECT book_id, chapter_id, chapter_index, spot, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS part FROM pz),
        pp AS (SELECT book_id, chapter_id, chapter_index, row_number() OVER (PARTITION BY book_id, chapter_id ORDER BY spot, part) - 1 AS block_no,
            piece.kind AS kind, piece.text AS text FROM pq)"""
    return steps, "pp"
