"""The text functions as SQL, for comparing results with another engine. Arguments and results are SQL expressions."""

from __future__ import annotations

from quireloom.functions.patterns import SQL_CJK, SQL_LINE_END, SQL_WS

WS = f"[{SQL_WS}]"
NS = f"[^{SQL_WS}]"
CJK = SQL_CJK
NL = "chr(10)"


def sub(x: str, pattern: str, new: str) -> str:
    return f"regexp_replace({x}, '{pattern}', '{new}', 'g')"


def strip(x: str) -> str:
    return sub(x, f"^{WS}+|{WS}+$", "")


def squeeze(x: str) -> str:
    return strip(sub(x, f"{WS}+", " "))


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def lines(x: str) -> str:
    return f"string_split_regex({x}, '{SQL_LINE_END}')"


def filled(items: str) -> str:
    return f"list_filter({items}, lambda x: x <> '')"


def filled_lines(x: str) -> str:
    return filled(f"list_transform({lines(x)}, lambda x: {strip('x')})")


def paragraphs(x: str) -> str:
    unified = strip(f"replace({x}, chr(13) || chr(10), chr(10))")
    return filled(rf"list_transform(string_split_regex({unified}, '\n{WS}*\n+'), lambda x: {strip('x')})")


def slug(x: str) -> str:
    joined = sub(f"lower({strip(x)})", r"[^\p{L}\p{N}_\-]+", "-")
    return f"coalesce(nullif({sub(sub(joined, '-{2,}', '-'), '^-+|-+$', '')}, ''), 'book')"


def words(x: str) -> str:
    return count(x, f"{NS}+")


def estimate(x: str) -> str:
    return f"CASE WHEN {words(x)} = 0 THEN 0 ELSE greatest(1, CAST(ceil({words(x)} / 0.75) AS INTEGER)) END"


def unit(x: str) -> str:
    return sub(f"lower({squeeze(x)})", r"[.!?,;:。！？，；：\"''()\[\]{}<>《》]", "")


def sentences(x: str) -> str:
    return filled(f"list_transform(regexp_extract_all({x}, '[^.!?。！？]+[.!?。！？]?'), lambda x: {strip('x')})")


def sentence_count(x: str) -> str:
    return f"len({sentences(squeeze(x))})"


def meaningful(x: str) -> str:
    bare = sub(sub(x, f"{WS}+", ""), r"[.!?,;:。！？，；：\"''()\[\]{}]", "")
    return (
        f"CASE WHEN regexp_matches({bare}, '{CJK}') THEN length({bare}) >= 4 ELSE {count(bare, '[A-Za-z0-9]')} >= 4 END"
    )


def excerpt(x: str) -> str:
    return f"CASE WHEN length({squeeze(x)}) <= 180 THEN {squeeze(x)} ELSE left({squeeze(x)}, 179) || '...' END"


def signature(x: str) -> str:
    ascii_words = f"regexp_extract_all(lower({x}), '[a-z0-9]+')"
    ideographs = f"regexp_extract_all({x}, '{CJK}')"
    rest = f"left({sub(sub(f'lower({strip(x)})', f'{WS}+', '-'), '[^a-z0-9' + chr(92) + '-' + CJK[1:-1] + ']', '')}, 32)"
    return (
        f"CASE WHEN len({ascii_words}) > 0 THEN array_to_string({ascii_words}[1:6], '-') "
        f"WHEN len({ideographs}) > 0 THEN array_to_string({ideographs}[1:8], '') "
        f"WHEN {rest} <> '' THEN {rest} ELSE 'none' END"
    )


def anchors(x: str) -> str:
    """Numbers of 2 to 4 digits: runs of digits of that length."""
    return f"list_distinct(list_filter(regexp_extract_all({x}, '[0-9]+'), lambda x: length(x) BETWEEN 2 AND 4))"


def key(x: str) -> str:
    return sub(f"lower({x})", r"[^\p{L}\p{N}]+", "")


def escape(x: str) -> str:
    t = f"replace({x}, '&', '&amp;')"
    for sign, name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        t = f"replace({t}, '{sign}', '{name}')"
    return t


def inline(x: str) -> str:
    return f"replace({escape(strip(x))}, {NL}, '<br />')"


def paragraph_html(x: str) -> str:
    parts = filled(f"list_transform(string_split({x}, chr(10) || chr(10)), lambda x: {strip('x')})")
    wrapped = f"list_transform({parts}, lambda x: '<p>' || {inline('x')} || '</p>')"
    return f"CASE WHEN len({parts}) = 0 THEN '<p>' || {inline(x)} || '</p>' ELSE array_to_string({wrapped}, '') END"


def few_breaks(x: str) -> str:
    return f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"


def tidy(x: str) -> str:
    t = sub(f"replace({x}, chr(13) || chr(10), chr(10))", r"[ \t]{2,}", " ")
    for _ in range(2):
        t = sub(t, rf"({CJK})[ \t]+({CJK})", r"\1\2")
    t = sub(t, r"[ \t]+([,.;:!?，。；：！？、）\]}>])", r"\1")
    t = sub(t, r"([（\[{<])[ \t]+", r"\1")
    t = f"regexp_replace({t}, '[ \\t]+\\n', chr(10), 'g')"
    return strip(few_breaks(t))


def tighten(x: str) -> str:
    signs = "[A-Za-z0-9@#&]"
    t = sub(x, rf"({CJK}){WS}+({signs})", r"\1\2")
    t = sub(t, rf"({signs}){WS}+({CJK})", r"\1\2")
    t = sub(t, rf"({CJK}){WS}+([（(])", r"\1\2")
    t = sub(t, rf"([）)]){WS}+({CJK})", r"\1\2")
    t = sub(t, rf"([A-Za-z]){WS}+([0-9])", r"\1 \2")
    return sub(t, rf"([0-9]){WS}+([A-Za-z])", r"\1 \2")


def marked_items(x: str, closing: str = r"\.") -> str:
    """Text with chr(2) before and chr(3) behind the number of every inline marker; looks back without lookbehind."""
    once = f"regexp_replace({x}, '(^|[^0-9])([0-9]{{1,3}}){closing}{WS}*', '\\1' || chr(2) || '\\2' || chr(3), 'g')"
    return f"regexp_replace({once}, '(^|[^0-9])([0-9]{{1,3}}){closing}{WS}*', '\\1' || chr(2) || '\\2' || chr(3), 'g')"


def fingerprint(x: str) -> str:
    return f"left(sha1({squeeze(x)}), 12)"


def match_tokens(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]{{3,}}|{CJK}{{2,}}'))"


def counts_up(values: str) -> str:
    """Whether three numbers in a row follow each other."""
    return (
        f"(len({values}) >= 3 AND len(list_filter(range(1, greatest(len({values}) - 1, 1)), lambda i: "
        f"{values}[i + 1] = {values}[i] + 1 AND {values}[i + 2] = {values}[i] + 2)) > 0)"
    )


def block_numbers(x: str) -> str:
    found = f"list_transform({lines(x)}, lambda x: regexp_extract(x, '^{WS}*([0-9]{{1,3}})[.)]{WS}+{NS}', 1))"
    return f"list_transform({filled(found)}, lambda x: CAST(x AS INTEGER))"


def caption_bare(x: str) -> str:
    t = f"regexp_replace({strip(x)}, '^\\[[^\\]]+\\]{WS}*', '')"
    t = f"regexp_replace({t}, '(?i)^(?:figure|fig\\.?|image){WS}*[0-9]+[:.\\-]?{WS}*', '')"
    return strip(f"regexp_replace({t}, '^图{WS}*[0-9]*[:：.\\-]?{WS}*', '')")


def caption_key(x: str) -> str:
    return sub(f"lower({sub(caption_bare(x), f'{WS}+', '')})", r"[^\p{L}\p{N}_]", "")


SOURCE = "coalesce(source_excerpt, '')"


def finding_key() -> str:
    identity = f"coalesce(nullif(source_signature, ''), {fingerprint(SOURCE)})"
    return f"coalesce(chapter_id, '') || '|' || coalesce(nullif(block_id, ''), '-') || '|' || coalesce(finding_type, '') || '|' || {identity}"
