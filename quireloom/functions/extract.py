"""Functions that take lists out of texts: markers, items, units, anchors, question and answer pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quireloom.functions import predicates as P
from quireloom.functions.patterns import BLANK_LINES, NS, S
from quireloom.functions.text import (
    excerpt_fingerprint,
    filled_lines,
    is_meaningful,
    let,
    lines,
    paragraphs,
    plain_unit,
    sentences,
    squeeze,
    strip,
    tighten_mixed,
)

#: A marker of an inline item, and one with text behind it.
INLINE = rf"(?<![0-9])[0-9]{{1,3}}[.)]{S}*"
INLINE_NUMBER = r"(?<![0-9])([0-9]{1,3})[.)]"
FILLED_MARKER = rf"(?<![0-9])([0-9]{{1,3}})[.)]{S}+{NS}"
#: A number that may start a reference behind an item.
TAIL = rf"(?<![0-9])([0-9]{{2,4}}){S}+(?={NS})"


def _all(text: Column | str, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _ints(texts: Column) -> Column:
    return F.transform(texts, lambda n: n.cast("int"))


def block_numbers(text: Column | str) -> Column:
    """Numbers of the lines that are list items."""
    found = F.transform(lines(text), lambda x: F.regexp_extract(x, rf"^{S}*([0-9]{{1,3}})[.)]{S}+{NS}", 1))
    return _ints(F.filter(found, lambda n: n != ""))


def has_inline_run(text: Column | str, shortest: int = 3) -> Column:
    """Whether one line holds list items that count up."""
    return F.exists(lines(text), lambda x: P.counts_up(_ints(_all(x, FILLED_MARKER)), shortest))


def is_collapsed_list(source: Column | str, target: Column | str) -> Column:
    """Whether items on lines of their own in the source stand in one line of the target."""
    return (
        P.counts_up(block_numbers(source), 3) & ~P.counts_up(block_numbers(target), 3) & has_inline_run(target, 3)
    )


def structural_units(text: Column | str, title: Column | None = None) -> Column:
    """Units of a text: lines of list blocks, sentences of paragraphs with three or more, else whole paragraphs.

    A first unit that equals the title is left out.
    """

    def of_prose(flat: Column) -> Column:
        return let(
            F.filter(sentences(flat), is_meaningful), lambda meant: F.when(F.size(meant) >= 3, meant).otherwise(F.array(flat))
        )

    def of_paragraph(p: Column) -> Column:
        return F.when(P.is_line_block(p), F.filter(filled_lines(p), is_meaningful)).otherwise(let(squeeze(p), of_prose))

    def without_title(units: Column) -> Column:
        first = F.coalesce(plain_unit(F.get(units, F.lit(0))) == plain_unit(title), F.lit(False))
        named = F.coalesce(plain_unit(title), F.lit("")) != ""
        return F.when(named & first, F.slice(units, 2, F.greatest(F.size(units), F.lit(1)))).otherwise(units)

    units = F.flatten(F.transform(paragraphs(text), of_paragraph))
    return units if title is None else let(units, without_title)


def body_units(units: Column) -> Column:
    """Units without references and part headings at the end."""

    def kept(units: Column) -> Column:
        last = F.array_max(
            F.transform(
                units, lambda u, i: F.when(P.is_reference(u) | P.is_boundary_heading(u), F.lit(0)).otherwise(i + 1)
            )
        )
        return F.slice(units, 1, F.coalesce(last, F.lit(0)))

    return let(units, kept)


def question_marks(text: Column | str) -> Column:
    return F.regexp_count(text, F.lit(f"(?mi)^{S}*{P.QUESTION_MARK}{S}*[:：]"))


def answer_marks(text: Column | str) -> Column:
    return F.regexp_count(text, F.lit(f"(?mi)^{S}*{P.ANSWER_MARK}{S}*[:：]"))


def inline_items(paragraph: Column | str) -> Column:
    """Items (number, body) of a list in running text that counts 1, 2, 3; fewer than three give none."""

    def of(flat: Column) -> Column:
        parts = F.split(flat, INLINE, -1)
        zipped = F.arrays_zip(_all(flat, INLINE_NUMBER).alias("number"), F.slice(parts, 2, F.size(parts)).alias("part"))
        return F.filter(
            F.transform(zipped, lambda x: F.struct(x["number"].alias("number"), strip(x["part"]).alias("body"))),
            lambda x: x["body"] != "",
        )

    def checked(flat: Column) -> Column:
        counts = F.slice(_ints(_all(flat, INLINE_NUMBER)), 1, 3) == F.array(F.lit(1), F.lit(2), F.lit(3))
        return let(of(flat), lambda items: F.when(counts & (F.size(items) >= 3), items).otherwise(F.slice(items, 1, 0)))

    return let(squeeze(paragraph), checked)


def numbered_items(paragraph: Column | str) -> Column:
    """Items (number, body) of a paragraph all of whose lines are single items; else of its running text."""
    pattern = rf"^{S}*([0-9]{{1,3}})[.)]{S}*([^\n]+?){S}*$"

    def of(parts: Column) -> Column:
        single = F.forall(parts, lambda x: F.regexp_like(x, F.lit(pattern)) & (F.size(_all(x, INLINE_NUMBER)) <= 1))
        items = F.transform(
            parts,
            lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("number"), strip(F.regexp_extract(x, pattern, 2)).alias("body")),
        )
        return F.when((F.size(parts) > 0) & single, items).otherwise(inline_items(paragraph))

    return let(filled_lines(paragraph), of)


def split_overflow(item: Column | str) -> Column:
    """Array of (kind, text): the item's own text, then the references and paragraphs that run on behind it.

    The tail begins at the first of two numbers that count up, where a closing sign stands before it.
    """

    def whole(flat: Column) -> Column:
        return F.array(F.struct(F.lit("ordered_item").alias("kind"), flat.alias("text")))

    def split(flat: Column) -> Column:
        numbers = _ints(_all(flat, TAIL))
        parts, marks = F.split(flat, TAIL, -1), _all(flat, rf"((?<![0-9])[0-9]{{2,4}}{S}+)(?={NS})")
        packed = F.struct(numbers.alias("numbers"), parts.alias("parts"), marks.alias("marks"), flat.alias("flat"))
        return let(packed, cut)

    def cut(x: Column) -> Column:
        numbers, parts = x["numbers"], x["parts"]
        starts = F.filter(
            F.sequence(F.lit(0), F.greatest(F.size(numbers) - 2, F.lit(0))),
            lambda i: (F.get(numbers, i + 1) == F.get(numbers, i) + 1)
            & F.regexp_like(F.get(parts, i), F.lit(rf"[.!?)\]}}\"'。！？）]{S}*\z")),
        )
        return let(F.struct(F.get(starts, F.lit(0)).alias("start"), x.alias("x")), pieces)

    def pieces(y: Column) -> Column:
        start, x = y["start"], y["x"]
        every = F.transform(
            F.sequence(F.lit(0), F.size(x["numbers"]) - 1), lambda i: F.concat(F.get(x["marks"], i), F.get(x["parts"], i + 1))
        )
        head = F.rtrim(F.concat(F.get(x["parts"], F.lit(0)), F.array_join(F.slice(every, 1, F.coalesce(start, F.lit(0))), "")))
        tail = F.transform(
            F.filter(F.transform(F.slice(every, F.coalesce(start, F.lit(0)) + 1, F.size(every)), strip), lambda t: t != ""),
            lambda t: F.struct(
                F.when(P.is_reference(t), F.lit("reference_entry")).otherwise(F.lit("paragraph")).alias("kind"), t.alias("text")
            ),
        )
        return F.when(start.isNotNull() & (head != ""), F.concat(whole(head), tail)).otherwise(whole(x["flat"]))

    return let(
        squeeze(item), lambda flat: F.when(F.size(_all(flat, TAIL)) >= 2, split(flat)).otherwise(whole(flat))
    )


def numbered_lines(text: Column | str) -> Column:
    """Stripped lines that start with a list number."""
    return F.filter(filled_lines(text), lambda x: F.regexp_like(x, F.lit(rf"^[0-9]{{1,3}}[.)]{S}*{NS}")))


def raw_blocks(text: Column | str) -> Column:
    """Array of blocks between blank lines, each an array of stripped lines."""
    unified = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    return F.filter(F.transform(F.split(unified, BLANK_LINES, -1), filled_lines), lambda b: F.size(b) > 0)


def print_line(line: Column | str, keep_number: bool = False) -> Column:
    """A line without marks; empty for prefaces, repeated instructions, rules and, unless kept, lone numbers."""

    def of(bare: Column) -> Column:
        plain = F.regexp_replace(F.replace(F.replace(bare, F.lit("**")), F.lit("__")), F.lit(r"^\*([^\n]+)\*$"), F.lit("$1"))
        gone = P.is_preface(bare) | P.is_prompt_echo(bare) | P.is_rule(bare)
        if not keep_number:
            gone = gone | F.regexp_like(bare, F.lit(r"\A(?:\*\*|__)*[0-9]+(?:\*\*|__)*\z"))
        return F.when(gone, F.lit("")).otherwise(plain)

    return let(strip(F.regexp_replace(line, F.lit(rf"^#{{1,6}}{S}*"), F.lit(""))), of)


def _is_number(x: Column) -> Column:
    return F.regexp_like(x, F.lit(r"\A[0-9]+\z"))


def clean_lines(parts: Column, keep_first_number: bool = False) -> Column:
    return F.filter(
        F.transform(parts, lambda x, i: F.when(i == 0, print_line(x, keep_first_number)).otherwise(print_line(x))),
        lambda x: x != "",
    )


def _kept_lines(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda x: print_line(x, True)), lambda x: x != "")


def trailing_citations(parts: Column) -> Column:
    """Struct of content lines and the numbers that stand alone behind them."""

    def of(kept: Column) -> Column:
        last = F.coalesce(F.array_max(F.transform(kept, lambda x, i: F.when(_is_number(x), F.lit(0)).otherwise(i + 1))), F.lit(0))
        return F.struct(F.slice(kept, 1, last).alias("content"), F.slice(kept, last + 1, F.size(kept)).alias("citations"))

    return let(_kept_lines(parts), of)


def semantic_blocks(parts: Column) -> Column:
    """Lines of a block cut where their sense ends: each list item alone, else behind a lone number, and before one where
    the lines began with one.

    A block that begins with a number stays whole.
    """
    return let(_kept_lines(parts), _cut_senses)


def _cut_senses(kept: Column) -> Column:
    whole = F.array(kept)
    each = F.transform(kept, lambda x: F.array(x))
    empty = F.slice(kept, 1, 0)

    def step(acc: Column, x: Column) -> Column:
        current, done = acc["current"], acc["done"]
        closes = _is_number(x) & (F.size(current) > 0)
        numbered = F.coalesce(_is_number(F.get(current, F.lit(0))), F.lit(False))
        return (
            F.when(closes & numbered, F.struct(F.array(x).alias("current"), F.concat(done, F.array(current)).alias("done")))
            .when(closes, F.struct(empty.alias("current"), F.concat(done, F.array(F.concat(current, F.array(x)))).alias("done")))
            .otherwise(F.struct(F.concat(current, F.array(x)).alias("current"), done.alias("done")))
        )

    folded = F.aggregate(
        kept,
        F.struct(empty.alias("current"), F.slice(whole, 1, 0).alias("done")),
        step,
        lambda acc: F.when(F.size(acc["current"]) > 0, F.concat(acc["done"], F.array(acc["current"]))).otherwise(acc["done"]),
    )
    return (
        F.when(F.size(kept) == 0, F.slice(whole, 1, 0))
        .when(_is_number(F.get(kept, F.lit(0))), whole)
        .when(F.forall(kept, P.is_numbered_item), each)
        .otherwise(folded)
    )


def reference_entries(parts: Column) -> Column:
    """'number text' for each number line and the lines behind it; none unless the first is a number and two come out."""
    return let(_kept_lines(parts), _entries_of)


def _entries_of(kept: Column) -> Column:
    start = F.struct(F.lit("").alias("number"), F.lit("").alias("body"), F.slice(kept, 1, 0).alias("done"))

    def close(acc: Column) -> Column:
        entry = F.concat(acc["number"], F.lit(" "), acc["body"])
        return F.when((acc["number"] != "") & (acc["body"] != ""), F.concat(acc["done"], F.array(entry))).otherwise(acc["done"])

    def step(acc: Column, x: Column) -> Column:
        body = F.when(acc["body"] == "", x).otherwise(F.concat(acc["body"], F.lit(" "), x))
        return F.when(
            _is_number(x), F.struct(x.alias("number"), F.lit("").alias("body"), close(acc).alias("done"))
        ).otherwise(F.struct(acc["number"].alias("number"), body.alias("body"), acc["done"].alias("done")))

    none = F.slice(kept, 1, 0)
    entries = let(F.aggregate(kept, start, step, close), lambda found: F.when(F.size(found) >= 2, found).otherwise(none))
    numbered = (F.size(kept) > 0) & F.coalesce(_is_number(F.get(kept, F.lit(0))), F.lit(False))
    return F.when(numbered, entries).otherwise(none)


def chapter_title(parts: Column) -> Column:
    """Struct of the translated title that lines begin with, or null, and the lines behind it."""
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    rest = F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))
    after = F.slice(parts, 3, F.greatest(F.size(parts), F.lit(1)))
    heading = P.is_chapter_heading(first) & F.regexp_like(first, F.lit("[一-鿿]"))
    double = heading & F.regexp_like(first, F.lit(f"[：:]{S}*$")) & F.coalesce(P.is_title_candidate(second), F.lit(False))
    title = F.when(double, F.concat(first, second)).when(heading | P.is_title_candidate(first), first)
    return F.struct(
        title.alias("title"),
        F.when(double, after).when(heading | P.is_title_candidate(first), rest).otherwise(parts).alias("lines"),
    )


def compact_pair(text: Column | str) -> Column:
    """'question\\nanswer' of a single-line pair, by marks or at the first question mark; else empty."""
    flat = squeeze(text)
    pattern = rf"(?i)^({P.QUESTION_MARK}{S}*[:：].+?){S}+({P.ANSWER_MARK}{S}*[:：].+?)$"
    question = strip(F.regexp_extract(flat, "^([^?？]*[?？])", 1))
    answer = strip(F.regexp_replace(flat, F.lit("^[^?？]*[?？]"), F.lit("")))
    marked = F.concat(strip(F.regexp_extract(flat, pattern, 1)), F.lit("\n"), strip(F.regexp_extract(flat, pattern, 2)))
    cut = (question != "") & (answer != "") & P.is_question_line(question)
    return F.when(F.regexp_like(flat, F.lit(pattern)), marked).when(cut, F.concat(question, F.lit("\n"), answer)).otherwise(F.lit(""))


def pair_anchor(text: Column | str, source: Column | str) -> Column:
    """First question and answer of a text's paragraphs, or empty."""
    marked_source = P.has_question_mark(source) & P.has_answer_mark(source)

    def of_lines(parts: Column, p: Column) -> Column:
        one, two = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
        lined = P.is_question_line(one) | (marked_source & P.is_unmarked_pair(one, two))
        return F.when((F.size(parts) >= 2) & lined, F.concat(one, F.lit("\n"), two)).otherwise(compact_pair(p))

    found = F.filter(
        F.transform(F.split(text, BLANK_LINES, -1), lambda p: let(filled_lines(p), lambda parts: of_lines(parts, p))), lambda x: x != ""
    )
    return F.coalesce(F.get(found, F.lit(0)), F.lit(""))


def split_compact_pair(anchor: Column | str, marked: Column) -> Column:
    """Struct of question and answer in one line: at marks, else behind '?', else behind the first end; null if none.

    ``marked``: whether the annotation speaks of marks at all.
    """
    flat = squeeze(anchor)
    pattern = rf"(?i)^({P.QUESTION_MARK}{S}*[:：].+?){S}+({P.ANSWER_MARK}{S}*[:：].+)$"

    def at(signs: str) -> tuple[Column, Column]:
        return (
            strip(F.regexp_extract(flat, f"^([^{signs}]*[{signs}])", 1)),
            strip(F.regexp_replace(flat, F.lit(f"^[^{signs}]*[{signs}]"), F.lit(""))),
        )

    def pair(q: Column, a: Column) -> Column:
        return F.struct(q.alias("question"), a.alias("answer"))

    (q1, a1), (q2, a2) = at("?？"), at(".!?。！？")
    return F.when(
        marked,
        F.when(
            F.regexp_like(flat, F.lit(pattern)),
            pair(strip(F.regexp_extract(flat, pattern, 1)), strip(F.regexp_extract(flat, pattern, 2))),
        )
        .when((q1 != "") & (a1 != ""), pair(q1, a1))
        .when((q2 != "") & (a2 != ""), pair(q2, a2)),
    )


def emphasised_line(text: Column | str) -> Column:
    """First emphasised line, or empty."""
    return F.coalesce(F.get(F.filter(filled_lines(text), P.is_emphasised), F.lit(0)), F.lit(""))


def ordered_marker(anchor: Column | str) -> Column:
    """'n.' or 'n)' that an anchor begins with, or empty."""
    return F.regexp_extract(anchor, rf"^{S}*([0-9]{{1,3}}[.)]){S}+{NS}", 1)


def ordered_start(anchor: Column | str) -> Column:
    """Number an anchor begins with where it is above 1."""
    number = F.regexp_extract(anchor, rf"^{S}*([0-9]{{1,3}})[.)]{S}+", 1).try_cast("int")
    return F.when(number > 1, number)


def quoted_spans(text: Column | str, shortest: int = 8, longest: int = 220) -> Column:
    """Stripped quotations of bounded length, in order."""
    marks = "[\"“”「」『』]"
    return F.transform(_all(text, f"{marks}([^\\n]{{{shortest},{longest}}}?){marks}"), strip)


def match_text(text: Column | str) -> Column:
    """Comparison form of an annotation's text: squeezed, without quotation marks and blanks."""
    return F.replace(tighten_mixed(F.translate(squeeze(text), "“”\"", "")), F.lit(" "), F.lit(""))


def finding_key(chapter: Column | str, block: Column | str, kind: Column | str, signature: Column | str, source: Column | str) -> Column:
    """'chapter|block|type|identity'; the identity is the signature, else the fingerprint of the excerpt."""
    return F.concat_ws(
        "|",
        F.coalesce(chapter, F.lit("")),
        F.coalesce(F.nullif(F.col(block) if isinstance(block, str) else block, F.lit("")), F.lit("-")),
        F.coalesce(kind, F.lit("")),
        F.coalesce(
            F.nullif(F.col(signature) if isinstance(signature, str) else signature, F.lit("")),
            excerpt_fingerprint(F.coalesce(source, F.lit(""))),
        ),
    )


