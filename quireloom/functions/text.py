"""Scalar text functions: column in, column out, all inside the JVM.

Every function gives null for a null text unless it says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quireloom.functions.patterns import BLANK_LINES, CJK, LINE_END, WORD, S

LISTED_PUNCTUATION = ".!?,;:。！？，；：\"'()[]{}<>《》"
TERMINATOR = "[.!?。！？]"


def _re(text: Column | str, pattern: str, new: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(new))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, also inside a lambda, where Spark shares no subexpressions."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def strip(text: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return _re(text, rf"\A{S}+|{S}+\z", "")


def squeeze(text: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(_re(text, f"{S}+", " "))


def lines(text: Column | str) -> Column:
    """Lines; a line end at the end opens no further line."""
    return let(
        F.split(text, LINE_END, -1),
        lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts),
    )


def filled_lines(text: Column | str) -> Column:
    """Stripped lines that are not blank."""
    return F.filter(F.transform(F.split(text, LINE_END, -1), strip), lambda x: x != "")


def paragraphs(text: Column | str) -> Column:
    """Stripped parts between blank lines that are not blank."""
    unified = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    return F.filter(F.transform(F.split(strip(unified), BLANK_LINES, -1), strip), lambda x: x != "")


def slug(value: Column | str) -> Column:
    """Lower case, everything but word characters and hyphens as single hyphens; 'book' if nothing is left."""
    joined = _re(F.lower(strip(value)), rf"[^{WORD}\-]+", "-")
    bare = _re(_re(joined, "-{2,}", "-"), r"\A-+|-+\z", "")
    return F.when(bare == "", F.lit("book")).otherwise(bare)


def word_count(text: Column | str) -> Column:
    """Runs of non-white space.

    Counted from the gaps: splitting at white space costs a tenth of matching what is none against the long class.
    """

    def of(parts: Column) -> Column:
        ends = (F.get(parts, F.lit(0)) == "").cast("int") + (F.element_at(parts, -1) == "").cast("int")
        return F.greatest(F.size(parts) - ends, F.lit(0))

    return let(F.split(text, f"{S}+", -1), of)


def characters(text: Column | str, kind: str) -> Column:
    """Number of characters of a class, without listing them."""
    return F.length(text) - F.length(_re(text, f"{kind}+", ""))


def estimate_tokens(text: Column | str) -> Column:
    """0 for blank text, else words / 0.75 rounded up, at least 1."""
    words = word_count(text)
    return F.when(words == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil(words / F.lit(0.75)))).cast("int")


def latin_letters(text: Column | str) -> Column:
    return characters(text, "[A-Za-z]")


def cjk_characters(text: Column | str) -> Column:
    return characters(text, CJK)


def contains_cjk(text: Column | str) -> Column:
    return F.regexp_like(text, F.lit(CJK))


def mixes_scripts(text: Column | str) -> Column:
    """Whether ideographs stand beside ASCII letters or digits."""
    return contains_cjk(text) & F.regexp_like(text, F.lit("[A-Za-z0-9]"))


def plain_unit(text: Column | str) -> Column:
    """Comparison form of a unit: squeezed, lower case, without listed punctuation."""
    return F.translate(F.lower(squeeze(text)), LISTED_PUNCTUATION, "")


def sentences(text: Column | str) -> Column:
    """Runs up to and with one terminator, stripped, none blank."""
    # Splitting behind terminators is several times faster than matching the runs between them.
    parts = F.filter(F.split(text, f"(?<={TERMINATOR})", -1), lambda x: ~F.regexp_like(x, F.lit(rf"\A{TERMINATOR}?\z")))
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def sentence_count(text: Column | str) -> Column:
    """Number of sentences of the squeezed text."""
    return F.size(F.filter(F.split(squeeze(text), TERMINATOR, -1), lambda x: x != ""))


def is_meaningful(text: Column | str) -> Column:
    """Whether a unit has 4 characters with ideographs among them, or 4 ASCII letters and digits."""
    bare = F.translate(_re(text, f"{S}+", ""), ".!?,;:。！？，；：\"'()[]{}", "")
    return F.when(contains_cjk(bare), F.length(bare) >= 4).otherwise(characters(bare, "[A-Za-z0-9]") >= 4)


def excerpt(text: Column | str, longest: int = 180) -> Column:
    """Squeezed text, cut one below ``longest`` with three dots added where it is longer."""
    return let(
        squeeze(text),
        lambda flat: F.when(F.length(flat) <= longest, flat).otherwise(F.concat(F.substring(flat, 1, longest - 1), F.lit("..."))),
    )


def signature_token(text: Column | str, most: int = 6) -> Column:
    """First ASCII words joined by hyphens; else the first 8 ideographs; else what is plain of the text, or 'none'."""
    words = F.regexp_extract(F.lower(text), f"[a-z0-9]+(?:[^a-z0-9]+[a-z0-9]+){{0,{most - 1}}}", 0)
    ideographs = F.regexp_extract(text, f"{CJK}(?:[^一-鿿]*{CJK}){{0,7}}", 0)
    rest = F.substring(_re(_re(F.lower(strip(text)), f"{S}+", "-"), "[^a-z0-9\\-一-鿿]", ""), 1, 32)
    return (
        F.when(words != "", _re(words, "[^a-z0-9]+", "-"))
        .when(ideographs != "", _re(ideographs, "[^一-鿿]+", ""))
        .when(rest != "", rest)
        .otherwise(F.lit("none"))
    )


def numeric_anchors(text: Column | str) -> Column:
    """Different numbers of 2 to 4 digits."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![0-9])([0-9]{2,4})(?![0-9])"), F.lit(1)))


def shared_numeric_anchors(left: Column | str, right: Column | str) -> Column:
    return F.size(F.array_intersect(numeric_anchors(left), numeric_anchors(right)))


# Steps of editorial, publishing and print spacing, each a pattern and what takes its place, in their order.
EDITORIAL_STEPS = (
    (r"[ \t]{2,}", " "),
    (rf"(?<={CJK})[ \t]+(?={CJK})", ""),
    (r"[ \t]+([,.;:!?，。；：！？、）\]}>])", "$1"),
    (r"([（\[{<])[ \t]+", "$1"),
    (r"[ \t]+\n", "\n"),
    (r"\n{3,}", "\n\n"),
)
PUBLISHING_STEPS = (
    (rf"(?<={CJK})[ \t]+(?={CJK})", ""),
    (rf"(?<={CJK})[ \t]*(?=[A-Za-z0-9])", " "),
    (rf"(?<=[A-Za-z0-9])[ \t]*(?={CJK})", " "),
    ("[ \\t]+([，。！？；：,.!?;:])", "$1"),
    ("([，。！？；：])[ \\t]+", "$1"),
    (r"\n{3,}", "\n\n"),
)
PRINT_STEPS = (
    (rf"(?<={CJK}){S}+(?=[A-Za-z0-9@#&])", ""),
    (rf"(?<=[A-Za-z0-9@#&]){S}+(?={CJK})", ""),
    (rf"(?<={CJK}){S}+(?=[（(])", ""),
    (rf"(?<=[）)]){S}+(?={CJK})", ""),
    (rf"(?<=[A-Za-z]){S}+(?=[0-9])", " "),
    (rf"(?<=[0-9]){S}+(?=[A-Za-z])", " "),
)


def _in_steps(text: Column | str, steps: tuple[tuple[str, str], ...]) -> Column:
    for pattern, new in steps:
        text = _re(text, pattern, new)
    return text


def _unix_lines(text: Column | str) -> Column:
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def tidy_spacing(text: Column | str) -> Column:
    """Editorial spacing: no gaps between ideographs, before closing or behind opening signs, at line ends."""
    return strip(_in_steps(_unix_lines(text), EDITORIAL_STEPS))


def drop_preface(text: Column | str) -> Column:
    """Without a translator's announcement at the start."""
    return _re(text, rf"\A以下是《[^》]+》[^\n]*?简体中文翻译[:：]{S}*", "")


def restore_numbered_lines(text: Column | str) -> Column:
    """An inline list that counts 1, 2, 3 with an item on each line; other texts as they are."""
    marker = r"(?<![0-9])([0-9]{1,3})\."
    numbers = F.regexp_extract_all(text, F.lit(marker), F.lit(1))
    parts = F.split(text, rf"(?<![0-9])[0-9]{{1,3}}\.{S}*", -1)
    items = F.filter(
        F.transform(
            F.arrays_zip(numbers.alias("number"), F.slice(parts, 2, F.size(parts)).alias("part")),
            lambda x: F.struct(x["number"].alias("number"), squeeze(x["part"]).alias("body")),
        ),
        lambda x: x["body"] != "",
    )
    body = F.array_join(F.transform(items, lambda x: F.concat(x["number"], F.lit(". "), x["body"])), "\n")
    intro = strip(F.element_at(parts, 1))
    counts = F.slice(F.transform(numbers, lambda n: n.cast("int")), 1, 3) == F.array(F.lit(1), F.lit(2), F.lit(3))
    listed = F.contains(text, F.lit("\n1. ")) & F.contains(text, F.lit("\n2. "))
    return F.when(~listed & counts & (F.size(items) >= 3), F.when(intro != "", F.concat(intro, F.lit("\n\n"), body)).otherwise(body)).otherwise(text)


def proofread(text: Column | str) -> Column:
    """Publishing form: preface dropped, inline lists restored, one space between ideographs and ASCII letters."""
    single = _re(_unix_lines(text), r"[ \t]{2,}", " ")
    return strip(_in_steps(restore_numbered_lines(drop_preface(single)), PUBLISHING_STEPS))


def tighten_mixed(text: Column | str) -> Column:
    """Print form: no gap between ideographs and ASCII letters, digits or brackets, one space between letters and digits."""
    return _in_steps(text, PRINT_STEPS)


def drop_markup(text: Column | str) -> Column:
    return _re(text, "<[^>]+>", "")


def has_markup(text: Column | str) -> Column:
    return F.contains(text, F.lit("<")) & F.contains(text, F.lit(">"))


def flow_lines(parts: Column) -> Column:
    """Wrapped lines as one: a space only where ASCII letters or digits would touch."""
    ascii_end, ascii_start = "[A-Za-z0-9]$", "^[A-Za-z0-9]"

    def join(done: Column, line: Column) -> Column:
        gap = F.when(F.regexp_like(done, F.lit(ascii_end)) & F.regexp_like(line, F.lit(ascii_start)), F.lit(" ")).otherwise(F.lit(""))
        return F.when(done == "", line).otherwise(F.concat(done, gap, line))

    return F.aggregate(parts, F.lit(""), join)


def key(text: Column | str) -> Column:
    """Comparison key: lower case letters, numerals and ideographs only."""
    return _re(F.lower(text), r"[^\p{L}\p{N}]+", "")


def header_cut(text: Column | str, longest: int = 22) -> Column:
    """The text, cut one below ``longest`` with an ellipsis where it is longer."""
    column = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(column) <= longest, column).otherwise(F.concat(F.substring(column, 1, longest - 1), F.lit("…")))


# What separates a short title from the rest, by precedence.
TITLE_SEPARATORS = (" A Guide to ", ": ", " - ", " — ", " | ")


def short_title(text: Column | str) -> Column:
    """What stands before the first of TITLE_SEPARATORS, by their order, that the text has; else the text."""
    column = F.col(text) if isinstance(text, str) else text
    out = column
    for separator in reversed(TITLE_SEPARATORS):
        out = F.when(F.contains(column, F.lit(separator)), strip(F.substring_index(column, separator, 1))).otherwise(out)
    return out


def path_stem(path: Column | str) -> Column:
    """File name without folders of either separator and without its last suffix."""
    name = _re(path, r"^.*[/\\]", "")
    return _re(name, r"(?<=.)\.[^.]*$", "")


def title_and_author(stem: Column | str) -> Column:
    """Struct of title and author of 'Title (Author)'; the author is null where there is none."""
    column = F.col(stem) if isinstance(stem, str) else stem
    pattern = rf"^(.+?){S}*\(([^()]+)\)$"
    title = F.regexp_extract(column, pattern, 1)
    return F.when(title != "", F.struct(strip(title).alias("title"), strip(F.regexp_extract(column, pattern, 2)).alias("author"))).otherwise(
        F.struct(column.alias("title"), F.lit(None).cast("string").alias("author"))
    )


def match_tokens(text: Column | str) -> Column:
    """Different lower-case tokens: 3 or more ASCII letters and digits, or 2 or more ideographs."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"([a-z0-9]{{3,}}|{CJK}{{2,}})"), F.lit(1)))


def drop_caption_prefix(text: Column | str) -> Column:
    t = _re(strip(text), rf"\A\[[^\]]+\]{S}*", "")
    t = _re(t, rf"(?i)\A(?:figure|fig\.?|image){S}*[0-9]+[:.\-]?{S}*", "")
    return strip(_re(t, rf"\A图{S}*[0-9]*[:：.\-]?{S}*", ""))


def caption_key(text: Column | str) -> Column:
    return _re(F.lower(_re(drop_caption_prefix(text), f"{S}+", "")), f"[^{WORD}]", "")


def canonical_caption(block: Column | str, caption: Column | str) -> Column:
    """The asset's caption where both have one key, else the block's text without prefix, else the caption."""
    bare = drop_caption_prefix(block)
    return F.when(caption_key(bare) == caption_key(caption), strip(caption)).when(bare != "", bare).otherwise(strip(caption))


def excerpt_fingerprint(text: Column | str) -> Column:
    """First 12 hexadecimal digits of the SHA-1 of the squeezed text."""
    return F.substring(F.sha1(squeeze(text)), 1, 12)


def epub_identifier(title: Column | str) -> Column:
    part = F.substring(key(title), 1, 32)
    return F.when(part == "", F.lit("epub-book")).otherwise(F.concat(F.lit("epub-"), part))


def escape_html(text: Column | str) -> Column:
    t = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for sign, name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        t = F.replace(t, F.lit(sign), F.lit(name))
    return t


def inline_html(text: Column | str) -> Column:
    return F.replace(escape_html(strip(text)), F.lit("\n"), F.lit("<br />"))


def paragraph_html(text: Column | str) -> Column:
    """A paragraph element for each part between empty lines, at least one."""
    parts = F.filter(F.transform(F.split(text, "\n\n", -1), strip), lambda x: x != "")
    wrapped = F.transform(parts, lambda p: F.concat(F.lit("<p>"), inline_html(p), F.lit("</p>")))
    return F.when(F.size(parts) == 0, F.concat(F.lit("<p>"), inline_html(text), F.lit("</p>"))).otherwise(F.array_join(wrapped, ""))


# Labels before a translated title.
TITLE_LABELS = "标题：|翻译：|译文："


def first_cjk_line(text: Column | str) -> Column:
    """First line with ideographs, without marks and labels around it; null if there is none."""

    def bare(line: Column) -> Column:
        t = _re(_re(strip(line), r"\*\*|__", ""), "\\A[`\"'“”]+|[`\"'“”]+\\z", "")
        return tighten_mixed(strip(_re(t, rf"\A(?:{TITLE_LABELS})", "")))

    return F.try_element_at(F.filter(F.transform(lines(text), bare), contains_cjk), F.lit(1))


def payload_fingerprint(*columns: str) -> Column:
    """SHA-256 of the named columns as JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def page_numbers(spec: Column | str, total: Column | int) -> Column:
    """Sorted different pages of '1,3-5'; blank parts do not count.

    An error for no page, for inverted ranges, for pages outside 1 to ``total`` and for anything else.
    """
    total = F.lit(total) if isinstance(total, int) else total
    parts = F.filter(F.transform(F.split(spec, ",", -1), strip), lambda p: p != "")
    good = (F.size(parts) > 0) & F.forall(parts, lambda p: F.regexp_like(p, F.lit(rf"^[0-9]+{S}*(-{S}*[0-9]+)?$")))

    def fail(said: str, what: Column) -> Column:
        return F.raise_error(F.concat(F.lit(said), what)).cast("array<int>")

    def span(p: Column) -> Column:
        low = F.regexp_extract(p, r"^([0-9]+)", 1).cast("int")
        high = F.regexp_extract(p, r"([0-9]+)$", 1).cast("int")
        fits = (low >= 1) & (low <= high) & (high <= total)
        return F.when(fits, F.sequence(F.least(low, high), F.greatest(low, high))).otherwise(fail("pages out of range: ", p))

    pages = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, span))))
    return F.when(good, pages).otherwise(fail("not a page list: ", spec if isinstance(spec, Column) else F.col(spec)))


def sample_pages(total: Column) -> Column:
    """All pages up to 12, else the first 5, the middle 2 and the last 3."""
    middle = F.floor(total / 2).cast("int")
    few = F.sequence(F.lit(1), F.greatest(total, F.lit(1)))
    some = F.array(*[F.lit(i) for i in range(1, 6)], middle, middle + 1, total - 2, total - 1, total)
    return F.when(total < 1, F.array().cast("array<int>")).when(total <= 12, few).otherwise(F.array_distinct(some))


def to_float(value: Column | str) -> Column:
    """The number a text spells, else null."""
    return (F.col(value) if isinstance(value, str) else value).try_cast("double")
