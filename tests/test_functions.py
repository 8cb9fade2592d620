"""Scalar functions, predicates and extractions on literals; each case runs as one projection."""

import pytest
from pyspark.sql import functions as F

from quireloom.functions import extract as E
from quireloom.functions import predicates as P
from quireloom.functions import text as T


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(0).alias("x")])
    return row.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("value", "slug"),
    [("Hello, World!", "hello-world"), ("  ", "book"), ("Élodie — the café", "élodie-the-café"), ("a--b_c", "a-b_c"), ("--", "book")],
)
def test_slug(spark, value, slug):
    assert one(spark, T.slug("x"), x=value) == slug


def test_words_count_every_kind_of_white_space(spark):
    text = "a\u00a0b\u3000c d"
    assert one(spark, T.word_count("x"), x=text) == 4
    assert one(spark, T.estimate_tokens("x"), x=text) == 6
    assert one(spark, T.estimate_tokens("x"), x=" \u2003 ") == 0


def test_spacing_policies_stay_apart(spark):
    assert one(spark, T.tidy_spacing("x"), x="你好  世界 。This  is   a test 。") == "你好世界。This is a test。"
    assert one(spark, T.proofread("x"), x="我在  PayPal  工作。  2002 年，我们 达成了协议 。") == "我在 PayPal 工作。2002 年，我们达成了协议。"
    assert one(spark, T.tighten_mixed("x"), x="我在 PayPal 工作") == "我在PayPal工作"


def test_proofread_restores_inline_lists(spark):
    assert one(spark, T.proofread("x"), x="前言 1. 甲 2. 乙 3. 丙") == "前言\n\n1. 甲\n2. 乙\n3. 丙"
    assert one(spark, T.proofread("x"), x="2. 甲 3. 乙 4. 丙") == "2. 甲 3. 乙 4. 丙"
    assert one(spark, T.drop_preface("x"), x="以下是《书》第1章的简体中文翻译：\n正文") == "正文"


def test_excerpts_can_be_two_longer_than_the_bound(spark):
    assert len(one(spark, T.excerpt("x"), x="a" * 300)) == 182
    assert one(spark, T.excerpt("x"), x=" a \n b ") == "a b"


def test_signature_tokens(spark):
    assert one(spark, T.signature_token("x"), x="Focus compounds over decades, and more words here.") == "focus-compounds-over-decades-and-more"
    assert one(spark, T.signature_token("x"), x="专注会在几十年里复利") == "专注会在几十年里"
    assert one(spark, T.signature_token("x"), x="!!") == "none"


def test_titles_and_paths(spark):
    assert one(spark, T.path_stem("x"), x="C:\\books\\The Book (An Author).epub") == "The Book (An Author)"
    assert one(spark, T.title_and_author("x"), x="The Book (An Author)").asDict() == {"title": "The Book", "author": "An Author"}
    assert one(spark, T.short_title("x"), x="Big: small - more") == "Big"
    assert one(spark, T.header_cut("x"), x="a" * 23) == "a" * 21 + "…"
    assert one(spark, T.first_cjk_line("x"), x="Title\n**标题：第 1 章**\n") == "第1章"


def test_pages(spark):
    assert one(spark, T.page_numbers("x", 8), x="1, 3-4,, 6") == [1, 3, 4, 6]
    assert one(spark, T.sample_pages(F.col("x")), x=20) == [1, 2, 3, 4, 5, 10, 11, 18, 19, 20]
    assert one(spark, T.sample_pages(F.col("x")), x=3) == [1, 2, 3]
    for bad in ("", "4-3", "9", "x"):
        with pytest.raises(Exception, match="page"):
            one(spark, T.page_numbers("x", 8), x=bad)


def test_html(spark):
    assert one(spark, T.inline_html("x"), x=" a<b\n'c' ") == "a&lt;b<br />&#x27;c&#x27;"
    assert one(spark, T.paragraph_html("x"), x="a\n\nb") == "<p>a</p><p>b</p>"
    assert one(spark, T.paragraph_html("x"), x="") == "<p></p>"


def test_captions(spark):
    assert one(spark, T.caption_key("x"), x="[图] Falcon launch") == one(spark, T.caption_key("x"), x="Figure 3: falcon  Launch")
    assert one(spark, T.canonical_caption("a", "b"), a="[图] Falcon launch", b=" Falcon launch ") == "Falcon launch"


@pytest.mark.parametrize(
    ("numbers", "any_start", "from_one"),
    [([1, 2, 3], True, True), ([4, 5, 6], True, False), ([1, 2, 4], False, False), ([0, 1, 2, 3], True, False), ([7, 1, 2, 3], True, True), ([], False, False)],
)
def test_counting_runs(spark, numbers, any_start, from_one):
    rows = spark.createDataFrame([(numbers,)], "v array<int>")
    got = rows.select(P.counts_up(F.col("v"), 3), P.counts_up(F.col("v"), 3, from_one=True)).first()
    assert tuple(got) == (any_start, from_one)


def test_predicates(spark):
    assert one(spark, P.is_reference("x"), x="508 “A talk”, 2019")
    assert not one(spark, P.is_reference("x"), x="508 plain words")
    assert one(spark, P.is_boundary_heading("x"), x="Part  IV")
    assert one(spark, P.is_line_block("x"), x="1. a\n2. b\n- c")
    assert not one(spark, P.is_line_block("x"), x="1. a\n2. b")
    assert one(spark, P.is_question("x"), x="问：为什么") and one(spark, P.is_answer("x"), x="Answer: so")
    assert one(spark, P.is_question_line("x"), x="Why? ")
    assert one(spark, P.is_unmarked_pair("a", "b"), a="What matters most", b="Useful things.")
    assert one(spark, P.is_title_candidate("x"), x="第一章 开始")
    assert not one(spark, P.is_title_candidate("x"), x="这是一句话。")
    assert one(spark, P.is_rule("x"), x="***") and one(spark, P.is_prompt_echo("x"), x="书名：甲")
    assert one(spark, P.is_section_heading("x"), x="短句") and not one(spark, P.is_section_heading("x"), x="短句。")


def test_items_of_lists(spark):
    items = one(spark, E.numbered_items("x"), x="1. one\n2) two")
    assert [(i["number"], i["body"]) for i in items] == [("1", "one"), ("2", "two")]
    items = one(spark, E.numbered_items("x"), x="1. one 2. two 3. three")
    assert [i["body"] for i in items] == ["one", "two", "three"]
    assert one(spark, E.numbered_items("x"), x="1. one 2. two") == []


def test_overflow_of_the_last_item(spark):
    text = 'Third item. 508 "A talk", site 509 www.example.org more'
    pieces = one(spark, E.split_overflow("x"), x=text)
    assert [p["kind"] for p in pieces] == ["ordered_item", "reference_entry", "reference_entry"]
    assert pieces[0]["text"] == "Third item." and pieces[1]["text"].startswith("508")
    assert len(one(spark, E.split_overflow("x"), x="In 1999 and 2000 nothing")) == 1


def test_units(spark):
    units = one(spark, E.body_units(E.structural_units("x", F.lit("Title"))), x="Title\n\nAlpha one. Beta two. Gamma three.\n\n508 “A source”")
    assert units == ["Alpha one.", "Beta two.", "Gamma three."]


def test_print_lines(spark):
    assert one(spark, E.print_line("x"), x="### **标题**") == "标题"
    assert one(spark, E.print_line("x"), x="35") == "" and one(spark, E.print_line("x", True), x="35") == "35"
    blocks = one(spark, E.semantic_blocks(F.split("x", "\n")), x="a\nb\n35\nc")
    assert blocks == [["a", "b", "35"], ["c"]]
    assert one(spark, E.semantic_blocks(F.split("x", "\n")), x="1. a\n2. b") == [["1. a"], ["2. b"]]
    assert one(spark, E.reference_entries(F.split("x", "\n")), x="35\ntext\n36\nmore\ntext") == ["35 text", "36 more text"]
    assert one(spark, E.reference_entries(F.split("x", "\n")), x="35\ntext") == []
    parts = one(spark, E.trailing_citations(F.split("x", "\n")), x="a\n12\n13")
    assert parts["content"] == ["a"] and parts["citations"] == ["12", "13"]


def test_pairs(spark):
    assert one(spark, E.pair_anchor("x", F.lit("")), x="Intro.\n\nQ: Why? \nA: So.") == "Q: Why?\nA: So."
    assert one(spark, E.compact_pair("x"), x="Q: Why A: Because") == "Q: Why\nA: Because"
    assert one(spark, E.compact_pair("x"), x="no pair here") == ""
    pair = one(spark, E.split_compact_pair("x", F.lit(True)), x="First sentence. Second one")
    assert (pair["question"], pair["answer"]) == ("First sentence.", "Second one")
    assert one(spark, E.split_compact_pair("x", F.lit(False)), x="First. Second") is None


def test_lone_numbers_cut_lines_by_sense(spark):
    cases = {
        "text|1|2|3": [["text", "1"], ["2"], ["3"]], "text|1|more|2|3 x": [["text", "1"], ["more", "2"], ["3 x"]],
        "text|1|2|tail|3": [["text", "1"], ["2", "tail"], ["3"]], "1|a|2|b": [["1", "a", "2", "b"]], "1. a|2. b": [["1. a"], ["2. b"]], "": [],
    }
    table = spark.createDataFrame([(k,) for k in cases], "t string").select("t", E.semantic_blocks(F.filter(F.split("t", "[|]"), lambda x: x != "")).alias("b"))
    assert {r["t"]: r["b"] for r in table.collect()} == cases
