"""Predicates over texts, lines and number lists: column in, boolean column out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quireloom.functions.patterns import NS, S
from quireloom.functions.text import (
    cjk_characters,
    contains_cjk,
    filled_lines,
    flow_lines,
    latin_letters,
    let,
    squeeze,
    strip,
    tighten_mixed,
)

# What makes a numbered line a reference.
REFERENCE_SIGNS = r"(?i)https?://|www\.|[\"“”]|\b(?:podcast|summit|conference|speech|interview|blog|transcript|episode|plan)\b"
# Marks of questions and answers, and words that announce an emphasis.
QUESTION_WORDS, ANSWER_WORDS = "q|question|问", "a|answer|答"
QUESTION_MARK, ANSWER_MARK = f"(?:{QUESTION_WORDS})", f"(?:{ANSWER_WORDS})"
EMPHASIS = r"(?i)\b(remember|note|important|key point|takeaway)\b|记住|注意|重点|要点"
# Starts of lines that repeat the instructions given to a translator.
PROMPT_MARKS = ("本书：", "章节：", "分块索引：")
PROMPT_BOOK, PROMPT_INDEX = r"\A(?:本书|这本书|书名)", "原文片段索引："
# A heading at which a part or chapter begins.
BOUNDARY_HEADING = f"(?i)^(?:part|chapter){S}+[ivxlcdm0-9]+$"
PROMPT_STARTS = ("本书：", "这本书：", "书名：", "章节：", "分块索引：", "原文片段索引：", "翻译如下")


def _like(text: Column | str, pattern: str) -> Column:
    return F.regexp_like(text, F.lit(pattern))


def counts_up(values: Column, shortest: int, from_one: bool = False) -> Column:
    """Whether a list of numbers has ``shortest`` or more in a row that each follow the one before.

    With ``from_one`` the row must begin with 1.
    """

    def begins_here(i: Column) -> Column:
        steps = [F.get(values, i + k + 1) == F.get(values, i + k) + 1 for k in range(shortest - 1)]
        row = reduce(lambda a, b: a & b, steps)
        if from_one:
            row = row & (F.get(values, i) == 1) & ((i == 0) | (F.get(values, i - 1) != 0))
        return row

    long_enough = F.size(values) >= shortest
    starts = F.sequence(F.lit(0), F.greatest(F.size(values) - shortest, F.lit(0)))
    return long_enough & F.exists(starts, begins_here)


def is_reference(text: Column | str) -> Column:
    """A number of 2 to 4 digits, then text with an address, a quotation mark or a word for a source."""
    return _like(text, f"^{S}*[0-9]{{2,4}}{S}+{NS}") & _like(text, REFERENCE_SIGNS)


def is_boundary_heading(text: Column | str) -> Column:
    return _like(squeeze(text), BOUNDARY_HEADING)


def is_structured_line(line: Column | str) -> Column:
    mark = f"(?:[0-9]{{1,3}}[.)]|[-*]|•|(?:{QUESTION_WORDS}|{ANSWER_WORDS}){S}*[:：])"
    return _like(line, f"(?i)^{S}*{mark}{S}+{NS}")


def is_line_block(text: Column | str) -> Column:
    """Three or more lines that are all list or marker lines, or all references."""
    return let(
        filled_lines(text),
        lambda parts: (F.size(parts) >= 3) & (F.forall(parts, is_structured_line) | F.forall(parts, is_reference)),
    )


def crosses_languages(source: Column | str, target: Column | str) -> Column:
    """Whether a mostly Latin source has a mostly Chinese target."""

    return (latin_letters(source) >= F.greatest(F.lit(12), cjk_characters(source) * 2)) & (
        cjk_characters(target) >= F.greatest(F.lit(8), latin_letters(target) * 2)
    )


def is_question(text: Column | str) -> Column:
    return _like(text, f"(?i)^{S}*{QUESTION_MARK}{S}*[:：]{S}*{NS}")


def is_answer(text: Column | str) -> Column:
    return _like(text, f"(?i)^{S}*{ANSWER_MARK}{S}*[:：]{S}*{NS}")


def is_question_line(text: Column | str) -> Column:
    return is_question(text) | _like(text, rf"[?？]{S}*\z")


def has_question_mark(text: Column | str) -> Column:
    return _like(text, f"(?mi)^{S}*{QUESTION_MARK}{S}*[:：]")


def has_answer_mark(text: Column | str) -> Column:
    return _like(text, f"(?mi)^{S}*{ANSWER_MARK}{S}*[:：]")


def is_unmarked_pair(question: Column | str, answer: Column | str) -> Column:
    """Two lines that can be a question and its answer without marks."""
    return (
        ~is_answer(question) & ~is_question(answer) & ~_like(question, rf"[.!?。！？:;：；]{S}*\z")
        & _like(question, "[A-Za-z0-9一-鿿]") & _like(answer, rf"[.!?。！？]{S}*\z")
    )


def is_emphasised(line: Column | str) -> Column:
    return let(
        squeeze(line), lambda flat: (F.length(flat) <= 120) & _like(flat, "[.!?。！？]$") & _like(flat, EMPHASIS)
    )


def is_chapter_heading(text: Column | str) -> Column:
    return _like(text, r"\A(?:第|PART|Part)") & _like(text, "章|部分|Chapter|PART")


def is_book_title(text: Column | str) -> Column:
    return F.startswith(text, F.lit("《")) & F.endswith(text, F.lit("》"))


def is_section_heading(text: Column | str) -> Column:
    column = F.col(text) if isinstance(text, str) else text
    short = (F.length(column) <= 24) & ~_like(column, "[。！？；.!?;:]$")
    shouted = (F.upper(column) == column) & (F.lower(column) != column) & (F.length(column) <= 80)
    return is_book_title(column) | is_chapter_heading(column) | short | shouted


def is_numbered_item(text: Column | str) -> Column:
    return _like(text, rf"^[0-9]{{1,3}}\.{S}+{NS}")


def is_callout(parts: Column, citations: Column) -> Column:
    """Whether lines with citation numbers behind them are a short emphasis."""
    flat = strip(tighten_mixed(flow_lines(parts)))
    plain = ~_like(flat, r"\A(?:Q:|A:|问：|答：)") & ~is_chapter_heading(flat) & ~is_book_title(flat)
    return (F.size(citations) > 0) & F.length(flat).between(1, 54) & plain


def is_title_candidate(text: Column | str) -> Column:
    """Whether a line can be a translated title: short, open-ended and mostly ideographs."""
    flat = strip(text)
    seen = F.length(F.regexp_replace(flat, F.lit(f"{S}+"), F.lit("")))
    ideographs = cjk_characters(flat)
    return (
        contains_cjk(flat) & (F.length(flat) <= 34) & ~_like(flat, "[。！？；!?]$")
        & (ideographs >= 3) & (ideographs / F.greatest(seen, F.lit(1)) >= 0.45)
    )


def is_preface(text: Column | str) -> Column:
    return F.startswith(text, F.lit("以下是")) & F.contains(text, F.lit("简体中文")) & _like(text, "翻译|内容")


def is_prompt_echo(text: Column | str) -> Column:
    starts = reduce(lambda a, b: a | b, (F.startswith(text, F.lit(p)) for p in PROMPT_STARTS))
    marks = reduce(lambda a, b: a & b, (F.contains(text, F.lit(m)) for m in PROMPT_MARKS))
    return starts | marks | (_like(text, PROMPT_BOOK) & F.contains(text, F.lit(PROMPT_INDEX)))


def is_rule(text: Column | str) -> Column:
    return _like(text, r"\A[-*_]{3,}\z")


def is_structural(finding_type: Column | str) -> Column:
    """Finding types about structure: a missing source chapter, a lost list, or any with 'structure' in its name."""
    column = F.col(finding_type) if isinstance(finding_type, str) else finding_type
    return (column == "missing_source_chapter") | F.contains(column, F.lit("structure"))


def is_about_images(finding_type: Column | str) -> Column:
    column = F.col(finding_type) if isinstance(finding_type, str) else finding_type
    return column.isin("missing_image", "missing_caption", "image_anchor_loss")


def is_citation(finding_type: Column | str) -> Column:
    return F.contains(finding_type, F.lit("citation"))


def same_finding(left: str, right: str, fields: tuple[str, ...]) -> Column:
    """Whether two struct columns agree in all named fields, nulls included."""
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{f}").eqNullSafe(F.col(f"{right}.{f}")) for f in fields))
