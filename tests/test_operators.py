"""Operators on small tables with the results written out."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from quireloom.operators import assembly, audit, deep_review, editorial, layout, review, segmentation, stages, summary, translate
from quireloom.sources import books, jsonl
from quireloom.streaming import progress


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).orderBy(*columns).collect()]


def audit_of(spark, source, target, title=None):
    pairs = spark.createDataFrame([("c", title, source, target)], "chapter_id string, source_title string, source_text string, target_text string")
    return {r["finding_type"]: r["source_signature"] for r in audit.audit_pairs(pairs, ["chapter_id"]).collect()}


def chapters(spark, *texts):
    return spark.createDataFrame([("b", f"c-{i}", i, "T", t) for i, t in enumerate(texts)], "book_id string, chapter_id string, chapter_index int, title string, text string")


def test_packing(spark):
    five = "one two three four five"
    got = segmentation.chunk_chapters(chapters(spark, f"{five}\n\n{five}\n\n{five}"), 10).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in got] == [0, 1] and got[1]["source_text"] == five and got[0]["chunk_id"] == "c-0-t-0"
    got = segmentation.chunk_chapters(chapters(spark, "One two three four five. Six seven eight nine ten. Eleven twelve."), 5).orderBy("chunk_index").collect()
    assert len(got) == 3 and got[0]["source_text"].endswith("five.")
    got = segmentation.chunk_chapters(chapters(spark, "a b c d e f g"), 3).orderBy("chunk_index").collect()
    assert [r["source_text"] for r in got] == ["a b c", "d e f", "g"]
    assert segmentation.chunk_chapters(chapters(spark, "   \n\n   ", None), 3).count() == 0


def test_titles_skip_the_contents(spark):
    raw = "Contents\nChapter 1\nChapter 2\n\nChapter 1\nActual first body.\n\nChapter 2\nActual second body.\n"
    one = spark.createDataFrame([("b", raw, "Book")], "book_id string, raw_text string, title string")
    titles = spark.createDataFrame([("b", 0, "Chapter 1"), ("b", 1, "chapter 2")], "book_id string, ord int, title string")
    got = segmentation.split_by_titles(one, titles).orderBy("chapter_index").collect()
    assert [r["text"] for r in got] == ["Actual first body.", "Actual second body."]
    missing = titles.unionByName(spark.createDataFrame([("b", 2, "Chapter 3")], titles.schema))
    assert segmentation.split_by_titles(one, missing).count() == 0


def test_pages_and_strategies(spark):
    pages = spark.createDataFrame(
        [("b", 0, "cover"), ("b", 1, "Notes\nNotes body."), ("b", 2, "Foreword\nForeword body."), ("b", 3, "Actual second body.")], "book_id string, page_index int, text string"
    )
    toc = spark.createDataFrame([("b", 0, "Notes", 1), ("b", 1, "Foreword", 2), ("b", 2, "Two", 3), ("b", 3, "Gone", 9)], "book_id string, ord int, title string, page_index int")
    got = segmentation.split_by_pages(pages, toc).orderBy("chapter_index").collect()
    assert [r["text"] for r in got] == ["Notes body.", "Foreword body.", "Actual second body."]
    two = spark.createDataFrame(
        [("b", "CHAPTER 1\nFirst body.\n\nCHAPTER 2\nSecond body.\n", "B"), ("w", "no heads", "Whole Book")], "book_id string, raw_text string, title string"
    )
    got = segmentation.detect_chapters(two, strategy="auto").orderBy("book_id", "chapter_index").collect()
    assert [(r["title"], r["text"]) for r in got] == [("CHAPTER 1", "First body."), ("CHAPTER 2", "Second body."), ("Whole Book", "no heads")]
    assert got[2]["chapter_id"] == "whole-book-chapter-0"
    with pytest.raises(ValueError, match="manual"):
        segmentation.detect_chapters(two, strategy="manual")


def test_audits(spark):
    listed = "1. First idea.\n2. Second idea.\n3. Third idea."
    assert audit_of(spark, listed, listed.replace("\n", " ")) == {
        "collapsed_numbered_list": "collapsed_numbered_list:1-2-3", "list_structure_loss": "list_structure_loss:1-2-3",
    }
    assert audit_of(spark, "Alpha.\nBeta.\nGamma.", "Alpha.\nBeta.") == {"possible_omission": "possible_omission:2:beta-gamma"}
    assert audit_of(spark, 'Remember this:\n"Focus compounds over decades."', "记住专注") == {"callout_candidate": "callout_candidate:focus-compounds-over-decades"}
    assert audit_of(spark, "Q: What matters most?\nA: Build useful things.", "什么最重要") == {"question_answer_structure": "question_answer_structure:q1:a1"}
    five = "\n".join(f"{i}. {w}" for i, w in enumerate(("one 1", "two 2", "three", "four", "five"), 1))
    got = audit_of(spark, five, "\n".join(five.split("\n")[:3]))
    assert got == {"list_structure_loss": "list_structure_loss:1-2-3-4-5", "possible_omission": "possible_omission:2:4-four-5-five"}
    assert set(audit_of(spark, "4. aa bb\n5. cc dd\n6. ee ff", "4. aa bb 5. cc dd 6. ee ff").values()) == {"collapsed_numbered_list:4-5-6", "list_structure_loss:4-5-6"}
    ten = " ".join(f"Sentence number {w} stands here." for w in "one two three four five six seven eight nine ten".split())
    assert "possible_omission" in audit_of(spark, ten, "这里只有一个很短的句子。")
    assert audit_of(spark, None, None) == {}


FINDING = "finding_id long, chapter_id string, block_id string, source_signature string, finding_type string, severity string, source_excerpt string, auto_fixable boolean, confidence double"


def test_consensus_buckets(spark):
    a = [(1, "c", None, "s1", "list", "high", "x", True, 0.95), (2, "c", None, "s2", "omission", "medium", "x", False, 0.86), (3, "c", None, "s3", "quote", "low", "x", True, 0.55)]
    r = [(4, "c", "", "s1", "list", "high", "y", True, 0.91), (5, "c", None, "s2", "omission", "low", "x", False, 0.87), (6, "c", None, None, "other", "low", " a  b ", True, 0.9)]
    left, right = (review.with_key(spark.createDataFrame(x, FINDING)) for x in (a, r))
    left = left.withColumn("block_id", F.nullif("block_id", F.lit("")))
    right = right.withColumn("block_id", F.nullif("block_id", F.lit("")))
    merged = review.merge_findings(review.fail_on_duplicates(left, "audit"), review.fail_on_duplicates(right, "review"))
    got = {r["finding_key"].split("|")[2]: r["bucket"] for r in merged.collect()}
    assert got == {"list": "agreed", "omission": "disputed", "quote": "low_confidence", "other": "low_confidence"}
    fixes = review.fix_candidates(merged, left.where("false")).collect()
    assert [(f["finding_id"], f["confidence"]) for f in fixes] == [(1, 0.95)]
    double = left.unionByName(left)
    with pytest.raises(Exception, match="Duplicate audit finding"):
        review.fail_on_duplicates(double, "audit").collect()


def test_blocks_and_texts(spark):
    source = "1. a\n2. b\n\ntext\n\n1. c\n2. d"
    texts = spark.createDataFrame([("c", "1. 甲\n2. 乙\n\n中间\n\n1. 丙\n2. 丁", source)], "chapter_id string, text string, source_text string")
    got = editorial.text_to_blocks(texts).orderBy("order_index").collect()
    assert [b["source_anchor"] for b in got] == ["1. a", "2. b", None, "1. c", "2. d"]
    assert [b["block_id"] for b in got][0] == "c-block-1" and [b["kind"] for b in got][2] == "paragraph"
    text = assembly.blocks_to_text(editorial.text_to_blocks(texts)).first()["text"]
    assert text == "1. 甲\n2. 乙\n\n中间\n\n1. 丙\n2. 丁"
    runs = assembly.adjacency_runs(editorial.text_to_blocks(texts)).orderBy("run_no").collect()
    assert [r["n_blocks"] for r in runs] == [2, 1, 2]
    html = layout.chapters_html(editorial.text_to_blocks(texts)).first()["html"]
    assert html == '<ol class="ordered-list"><li>甲</li><li>乙</li></ol>\n<p>中间</p>\n<ol class="ordered-list"><li>丙</li><li>丁</li></ol>'


def test_captions_attach(spark):
    blocks = spark.createDataFrame([("c", "c-block-1", "paragraph", "[图] Falcon launch", 1, None)], "chapter_id string, block_id string, kind string, text string, order_index int, source_anchor string")
    assets = spark.createDataFrame([("c", "a1", "Falcon launch", "page:3"), ("c", "a2", "Other", None), ("c", "a3", None, None)], "chapter_id string, source_asset_id string, caption string, source_location_hint string")
    got = editorial.attach_captions(blocks, assets).orderBy("order_index").collect()
    assert [(b["kind"], b["text"], b["source_anchor"]) for b in got] == [("caption", "Falcon launch", "page:3"), ("caption", "Other", "Other")]


def test_lexicons(spark):
    entries = spark.createDataFrame([("name", 0, "Mars", "火星"), ("name", 1, " Mars ", "火星 "), ("name", 2, "Tesla", "特斯拉"), ("name", 3, "X", " ")], "kind string, ord int, source string, translation string")
    assert rows(editorial.clean_lexicon(entries), "ord", "source", "translation") == [(0, "Mars", "火星"), (2, "Tesla", "特斯拉")]
    old = spark.createDataFrame([(0, "Tesla", "甲"), (1, "Mars", "乙")], "ord int, source string, translation string")
    new = spark.createDataFrame([(0, "Tesla", "丙"), (1, "New", "丁"), (2, "Mars", " ")], "ord int, source string, translation string")
    assert rows(editorial.merge_lexicons(old, new), "ord", "source", "translation") == [(0, "Tesla", "丙"), (1, "Mars", "乙"), (2, "New", "丁")]
    text = spark.createDataFrame([("a b",)], "text string").select(editorial.replace_in_order("text", F.array(*[F.struct(F.lit(s).alias("source"), F.lit(t).alias("translation")) for s, t in (("a", "b"), ("b", "c"))])).alias("t")).first()["t"]
    assert text == "c c"


def test_final_review(spark):
    artifacts = spark.createDataFrame([("b", "c1", "Two  words 。"), ("d", "c2", "干净")], "book_id string, chapter_id string, text string")
    assert rows(editorial.final_log(artifacts), "book_id", "chapter_id", "log_type") == [("b", "c1", "whole_book_normalization"), ("d", "*", "whole_book_review")]
    assert rows(editorial.proofread_texts(artifacts), "text", "note_type")[0] == ("Two words。", "spacing_normalization")
    fixed = artifacts.limit(1).select(editorial.repair_text(F.lit("前言 1. 甲 2. 乙 3. 丙"), F.lit(True)).alias("t")).first()["t"]
    assert fixed == "前言\n\n1. 甲\n2. 乙\n3. 丙"


def test_assembly_leaves_out_empty_chapters(spark):
    heads = chapters(spark, "", "").drop("text")
    chunks = spark.createDataFrame([("c-1", "k1", 0), ("c-1", "k2", 1), ("c-1", "k2", 1)], "chapter_id string, chunk_id string, chunk_index int")
    done = spark.createDataFrame([("k1", 1, "old"), ("k1", 2, " new ")], "chunk_id string, seq long, translated_text string")
    failed = spark.createDataFrame([("k2",)], "chunk_id string")
    got = assembly.chapter_texts(heads, chunks, done, failed).collect()
    assert [r["text"] for r in got] == ["new\n\n[[翻译失败: T / chunk 1]]"]
    assert assembly.book_texts(assembly.chapter_texts(heads, chunks, done, failed)).first()["text"].startswith("T\n\nnew\n\n")
    assert rows(assembly.pending_chunks(chunks, done), "chunk_id") == [("k2",), ("k2",)]


def test_summary(spark):
    chunks = spark.createDataFrame([("b", "k1"), ("b", "k1"), ("b", "k2")], "book_id string, chunk_id string")
    done = spark.createDataFrame([("b", "k1", 1, 5, 7, 0.1, 10), ("b", "k1", 2, 6, 8, 0.2, 20), ("b", "stale", 3, 1, 1, 0.1, None)], "book_id string, chunk_id string, seq long, input_tokens int, output_tokens int, estimated_cost_usd double, latency_ms int")
    got = summary.run_summary(chunks, done, chunks.where("chunk_id = 'k2'")).first()
    assert (got["total_chunks"], got["success_chunks"], got["failed_chunks"], got["input_tokens"], got["cost_usd"], got["mean_latency_ms"]) == (2, 2, 1, 7, 0.3, 20.0)


def test_printable_blocks(spark):
    text = "《书名》\n\n第一章 开始\n\n### 小标题\n\n这一行没有结束\n下一行结束了。\n12\n\n35\n来源甲\n36\n来源乙\n\n---\n\n1. 项目"
    table = spark.createDataFrame([("b", "c", 0, text)], "book_id string, chapter_id string, chapter_index int, text string")
    got = [(r["kind"], r["text"]) for r in layout.printable_blocks(table).orderBy("block_no").collect()]
    assert [k for k, _ in got] == ["book_title", "chapter_title", "section_heading", "callout", "reference", "reference", "section_heading"]
    assert got[3][1].startswith("这一行没有结束下一行结束了。") and "<super>12</super>" in got[3][1]


def test_citations(spark):
    def mark(t):
        return spark.range(1).select(layout.mark_citations(F.lit(t)).alias("r")).first()["r"]

    assert mark("结束。12 后").count("<super>12</super>") == 1
    assert "<super>" not in mark("结束。1999年") and "<super>" not in mark("结束。12abc")
    assert mark("a < b") == "a &lt; b"


def test_annotations(spark):
    findings = spark.createDataFrame(
        [("c", 1, "callout_candidate", "", "Focus matters", "r"), ("c", 2, "callout_candidate", "", "Focus matters", "r"), ("c", 3, "question_answer_structure", "t", "s", "r")],
        "chapter_id string, ord int, finding_type string, target_excerpt string, source_excerpt string, reason string",
    )
    texts = spark.createDataFrame([("c", "他说“专注 focus 很重要啊啊”。\n\nQ: 为什么？\nA: 因为。", "Q: x\nA: y")], "chapter_id string, text string, source_text string")
    got = rows(layout.layout_annotations(findings, texts), "kind", "value", "ord")
    assert got == [("callout", "专注 focus 很重要啊啊", 1), ("qa_block", "Q: 为什么？\nA: 因为。", 3)]
    blocks = spark.createDataFrame([("c", 0, "paragraph", "他说专注focus很重要啊啊。"), ("c", 1, "reference", "x")], "chapter_id string, block_no int, kind string, text string")
    marks = spark.createDataFrame([("c", "专注 focus 很重要啊啊")], "chapter_id string, value string")
    assert rows(layout.apply_callout(blocks, marks), "block_no", "kind")[0] == (0, "callout")


def test_deep_review_without_a_source(spark):
    artifacts = spark.createDataFrame([("b", "x-1", 7, "some text")], "book_id string, chapter_id string, chapter_index int, text string")
    tables = deep_review.deep_review(artifacts, chapters(spark, "source"))
    assert rows(tables["findings"], "finding_type", "severity") == [("missing_source_chapter", "high")]
    assert tables["report"].first()["missing_source_count"] == 1
    matched = artifacts.withColumn("chapter_index", F.lit(0))
    assert deep_review.deep_review(matched, chapters(spark, "source"))["findings"].count() == 0


def test_translation_rows(spark):
    requests = spark.createDataFrame([("k1", "p", "good"), ("k2", "p", "bad one")], "chunk_id string, prompt string, source_text string")
    got = {r["chunk_id"]: r for r in translate.translate_chunks(requests, translate.StubProvider(fail_on="bad")).collect()}
    assert got["k1"]["translated_text"] == "译文::good" and got["k1"]["ok"] and got["k1"]["attempt_count"] == 1
    assert not got["k2"]["ok"] and got["k2"]["error_type"] == "ValueError"


def test_retries():
    calls, waits = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise translate.RetryableError("later")
        return translate.Reply("x", 1, 1)

    assert translate.with_retries(call, sleep=waits.append)[1] == 3
    assert 1.0 <= waits[0] <= 1.25 and 2.0 <= waits[1] <= 2.25
    with pytest.raises(ValueError):
        translate.with_retries(lambda: (_ for _ in ()).throw(ValueError("no")), sleep=waits.append)


def test_titles_come_from_the_cache_first(spark):
    titles = spark.createDataFrame([("c1", "One"), ("c2", "Two")], "chapter_id string, title string")
    cache = spark.createDataFrame([("c1", "一")], "chapter_id string, title_zh string")
    assert rows(translate.translate_titles(titles, cache, translate.StubProvider()), "chapter_id", "title_zh") == [("c1", "一"), ("c2", "译文::Two")]


def epub(path):
    pages = {"a": "<html><body><h1>One</h1><p>First &amp; <b>bold</b></p><script>x()</script><img src='pic.png' alt='A picture'/></body></html>", "b": "<html><body><h1>Two</h1><figure><img src='gone.png'/><figcaption>Lost one</figcaption></figure></body></html>"}
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", "<container xmlns='urn:oasis:names:tc:opendocument:xmlns:container'><rootfiles><rootfile full-path='OEBPS/c.opf'/></rootfiles></container>")
        items = "".join(f"<item id='{k}' href='{k}.xhtml' media-type='application/xhtml+xml'/>" for k in pages)
        z.writestr(
            "OEBPS/c.opf",
            "<package xmlns='http://www.idpf.org/2007/opf' xmlns:dc='http://purl.org/dc/elements/1.1/'><metadata><dc:title>A Book</dc:title></metadata><manifest>"
            f"{items}<item id='nav' href='nav.xhtml' properties='nav' media-type='application/xhtml+xml'/><item id='i' href='pic.png' media-type='image/png'/></manifest>"
            "<spine><itemref idref='nav'/><itemref idref='b'/><itemref idref='a'/></spine></package>",
        )
        z.writestr("OEBPS/nav.xhtml", "<html><nav epub:type='toc'><ol><li><a href='a.xhtml'>One</a></li><li><a href='b.xhtml'>Two</a></li></ol></nav></html>")
        for k, html in pages.items():
            z.writestr(f"OEBPS/{k}.xhtml", html)
        z.writestr("OEBPS/pic.png", b"png")


def test_epubs(spark, tmp_path):
    os.makedirs(tmp_path / "deep")
    epub(tmp_path / "deep" / "x.EPUB")
    (tmp_path / "broken.epub").write_bytes(b"no archive")
    (tmp_path / "notes.txt").write_text("x")
    assert books.discover_books(spark, str(tmp_path)).count() == 2
    got = {r["path"].rsplit("/", 1)[1]: r for r in books.read_books(spark, str(tmp_path)).collect()}
    assert got["broken.epub"]["error"].startswith("BadZipFile")
    book = got["x.EPUB"]
    assert book["title"] == "A Book" and book["pages"] == ["Two\nLost one", "One\nFirst &\nbold"] and book["toc"] == ["One", "Two"] and book["missing"] == []
    assets = rows(books.book_assets(books.read_books(spark, str(tmp_path)).where("error IS NULL")), "status", "source_asset_id", "caption")
    assert assets == [("caption-only", "caption-only:gone.png", "Lost one"), ("extracted", "i", "A picture")]
    empty = io.BytesIO()
    with zipfile.ZipFile(empty, "w") as z:
        z.writestr("mimetype", "x")
    with zipfile.ZipFile(empty) as z:
        assert books.missing_entries(z) == ["META-INF/container.xml"]


def test_json(spark, tmp_path):
    path = str(tmp_path / "rows")
    assert jsonl.read_jsonl(spark, path, "translations").count() == 0
    table = spark.createDataFrame([("k", 1, None)], "chunk_id string, seq long, translated_text string")
    jsonl.write_jsonl(table, path)
    jsonl.write_jsonl(table, path, "append")
    assert jsonl.read_jsonl(spark, path, "translations").count() == 2
    text = spark.createDataFrame([('["a", {"title": " b "}, " "]',)], "j string")
    assert text.select(jsonl.title_list("j").alias("t")).first()["t"] == ["a", "b"]
    with pytest.raises(Exception, match="neither"):
        spark.createDataFrame([('[{"x": 1}]',)], "j string").select(jsonl.title_list("j")).collect()


def test_progress(spark, tmp_path):
    schema = "run_id string, seq long, type string, book_name string, total_books int, error string"
    events = [("r", 1, "run_started", None, 2, None), ("r", 2, "book_started", "a", None, None), ("r", 3, "book_completed", "a", None, None),
              ("r", 4, "book_started", "b", None, None), ("r", 5, "book_failed", "b", None, "no"), ("r", 6, "run_failed", "b", None, "no")]
    table = spark.createDataFrame(events, schema)
    got = progress.fold_events(table).first()
    assert (got["status"], got["completed_books"], got["failed_books"], got["progress"], got["last_error"]) == ("failed", 1, 1, 0.5, "no")  # a failed book is no progress
    table.write.json(str(tmp_path / "in"))
    stream = progress.fold_events(spark.readStream.schema(schema).json(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("states").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("states").first().asDict() == got.asDict()


def test_progress_of_runs_started_twice(spark, tmp_path):
    schema = "run_id string, seq long, type string, book_name string, total_books int, error string"
    runs = {
        "again": ["run_started 5", "book_completed", "book_failed", "book_completed", "run_failed", "run_started 3", "book_completed"],
        "whole": ["run_started 4", "book_completed", "run_completed"], "started": ["run_started 2", "book_completed", "run_completed", "run_started"],
        "more": ["book_completed", "run_started 4", "book_failed", "run_completed", "book_completed"], "none": ["run_completed"],
        "later": ["run_started 4", "run_completed", "run_failed"], "idle": ["book_started 2", "book_completed"], "lost": ["run_started 2", "book_failed", "book_completed"], "grown": ["run_started 2", "run_completed", "book_started 8"],
    }
    events = [(run, n, *(t.split() + [None])[:2]) for run, types in runs.items() for n, t in enumerate(types)]
    table = spark.createDataFrame([(run, n, t, None, int(total) if total else None, None) for run, n, t, total in events], schema)
    got = {r["run_id"]: tuple(r)[1:] for r in progress.fold_events(table).select("run_id", "status", "total_books", "completed_books", "failed_books", "progress").collect()}
    assert got == {
        "again": ("running", 3, 1, 0, 1 / 3), "whole": ("completed", 4, 4, 0, 1.0), "started": ("running", 2, 0, 0, 0.0), "more": ("completed", 4, 5, 1, 1.0),
        "none": ("completed", 0, 0, 0, 1.0), "later": ("failed", 4, 4, 0, 1.0), "idle": ("idle", 2, 1, 0, 0.5), "lost": ("failed", 2, 1, 1, 0.5), "grown": ("completed", 8, 2, 0, 0.25),
    }
    table.repartition(3).write.json(str(tmp_path / "in"))
    stream = progress.fold_events(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("restarts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(spark.table("restarts").collect()) == sorted(progress.fold_events(table).collect())


def test_modes_of_the_deep_review(spark):
    artifacts = chapters(spark, "1. First. 2. Second. 3. Third.")
    sources = chapters(spark, "1. First.\n2. Second.\n3. Third.")
    for more, crossed in (({"depth": "standard"}, False), ({"cross_review": False}, False), ({}, True)):
        tables = deep_review.deep_review(artifacts, sources, **more)
        report = tables["report"].first().asDict()
        assert (report["cross_review_enabled"], report["audit_depth"]) == (crossed, more.get("depth", "consensus"))
        assert report["review_finding_count"] == tables["review"].count() and (crossed or report["review_finding_count"] == 0)
        assert tables["chapters"].first()["revised"] and report["revised_chapter_count"] == 1 and report["unresolved_count"] == 0
        kinds = {r["finding_type"] for r in tables["fixes"].collect()}
        assert crossed or kinds == {"collapsed_numbered_list", "list_structure_loss"}


def test_the_arbiter_settles_disputes(spark):
    schema = "chapter_id string, block_id string, finding_type string, severity string, source_excerpt string, source_signature string, auto_fixable boolean, confidence double, agent_role string"
    audit_rows = [("c", None, "a", "high", "", "one", True, 0.9, "audit"), ("c", None, "b", "high", "", "two", True, 0.9, "audit"),
                  ("c", None, "d", "high", "", "three", False, 0.7, "audit"), ("c", None, "e", "low", "", "four", False, 0.9, "audit")]
    review_rows = [("c", None, "a", "low", "", "one", True, 0.9, "review"), ("c", None, "b", "low", "", "two", True, 0.8, "review"),
                   ("c", None, "d", "low", "", "three", True, 0.6, "review"), ("c", None, "e", "high", "", "four", False, 0.9, "review")]
    left, right = (review.with_key(spark.createDataFrame(x, schema)) for x in (audit_rows, review_rows))
    merged = review.merge_findings(left, right)
    got = {r["finding_type"]: (r["severity"], r["agent_role"]) for r in deep_review.arbitrate(merged, right).collect()}
    # As sure: the review; surer: the audit; the surer cannot be fixed: the fixable review; neither can: nothing.
    assert got == {"a": ("low", "arbiter"), "b": ("high", "arbiter"), "d": ("low", "arbiter")}
    unseen = {r["finding_type"]: r["severity"] for r in deep_review.arbitrate(merged, right.where("false")).collect()}
    assert unseen == {"a": "low", "b": "low", "d": "low"}
    fixed = {r["finding_type"] for r in review.fix_candidates(merged, deep_review.arbitrate(merged, right)).collect()}
    assert fixed == {"a", "b", "d"}


def test_stages_are_kept_in_the_shared_folder_and_cleared(spark):
    from quireloom.plans import staging

    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    kept = staging.stage(spark.range(3), "numbers")
    assert kept.count() == 3 and all(f.startswith(f"file://{folder}") for f in kept.inputFiles())
    staging.clear_stages(spark)
    assert not os.path.exists(f"{folder}/quireloom/{spark.sparkContext.applicationId}")


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from quireloom.plans import staging

    def session(master, named=None):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: named))

    for master in ("spark://somewhere:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            staging._shared_folder(session(master))
        assert staging._shared_folder(session(master, "hdfs://shared/")) == "hdfs://shared"
    assert staging._shared_folder(session("local[4]")).startswith("file://")


def test_questions_become_blocks(spark):
    schema = "chapter_id string, block_no int, kind string, text string"
    blocks = [("c", 0, "paragraph", "Intro."), ("c", 1, "paragraph", "问：为什么 study？ 答：因为 it helps a lot."), ("c", 2, "paragraph", "it helps a lot."),
              ("c", 3, "paragraph", "Rest."), ("d", 5, "paragraph", "Is it so? Yes, it is."), ("d", 7, "paragraph", "Other."), ("e", 0, "paragraph", "no pair here")]
    notes = [("c", 1, "问：为什么 study？\n答：因为 it helps a lot.", True, True), ("d", 1, "Is it so? Yes, it is.", False, False), ("e", 1, "no pair here", None, None), ("x", 1, "Q: a\nA: b", True, True)]
    table = spark.createDataFrame(blocks, schema).withColumn("extra", F.lit(1))
    questions = spark.createDataFrame(notes, "chapter_id string, ord int, anchor string, has_question_marker boolean, has_answer_marker boolean")
    got = rows(layout.apply_questions(table, questions), "chapter_id", "block_no", "kind", "text", "extra")
    assert got == [
        ("c", 0, "paragraph", "Intro.", 1), ("c", 1, "qa_question", "问：为什么 study？", 1), ("c", 2, "qa_answer", "答：因为 it helps a lot.", 1), ("c", 3, "paragraph", "Rest.", 1),
        ("d", 0, "qa_question", "Is it so?", 1), ("d", 1, "qa_answer", "Yes, it is.", 1), ("d", 2, "paragraph", "Other.", 1), ("e", 0, "paragraph", "no pair here", 1),
    ]
    assert layout.apply_questions(table.where("false"), questions).count() == 0
    assert layout.apply_questions(table, questions.where("false")).count() == len(blocks)


def test_titles_are_put_anew(spark):
    chapters_ = spark.createDataFrame([("a", "Part One", "第一部分"), ("b", "Two", None), ("c", None, None)], "chapter_id string, title string, title_zh string")
    new = spark.createDataFrame([("b", "第二章"), ("a", ""), ("z", "x")], "chapter_id string, title_zh string")
    got = {r["chapter_id"]: r for r in layout.retitle(chapters_, new).collect()}
    assert (got["a"]["title_zh"], got["a"]["title_kind"]) == ("第一部分", "part")
    assert (got["b"]["title_zh"], got["b"]["header_title"]) == ("第二章", "第二章") and "Two" in got["b"]["toc_label_html"]
    assert got["c"]["title_kind"] == "fallback" and got["c"]["header_title"] == "未命名章节"


def test_images_in_blocks_and_pages(spark):
    schema = "chapter_id string, block_id string, order_index int, kind string, text string, source_anchor string"
    blocks = spark.createDataFrame(
        [("c", "b1", 1, "image", "", None), ("c", "b2", 2, "caption", "Figure <1>", None), ("c", "b3", 3, "image", "", None), ("c", "b4", 4, "paragraph", "Text", None), ("c", "b5", 5, "image", "lost", None)], schema)
    assets = spark.createDataFrame(
        [("c", "a1", 1, "b1", "extracted", None, "images/c-a1.png"), ("c", "a2", 2, "b2", "extracted", "Figure <1>", "images/c-a2.png"), ("c", "a3", 3, "b3", "caption-only", "Map of the bay", None),
         ("c", "a4", 4, None, "caption-only", "Loose caption", None), ("c", "a5", 5, None, "caption-only", "figure 1", None)],
        "chapter_id string, source_asset_id string, ord int, block_anchor_id string, status string, caption string, file_name string")
    printed = rows(layout.structured_to_printable(blocks, assets), "order_index", "kind", "text")
    assert printed == [(2, "caption", "Figure <1>"), (3, "caption", "Map of the bay"), (4, "paragraph", "Text"), (5, "paragraph", "lost"), (6, "caption", "Loose caption")]
    html = layout.chapters_html(blocks, assets.where("file_name IS NOT NULL")).first()["html"]
    assert html.split("\n") == [
        '<figure class="image"><img src="images/c-a1.png" alt="" /></figure>',
        '<figure class="image"><img src="images/c-a2.png" alt="Figure &lt;1&gt;" /><figcaption>Figure &lt;1&gt;</figcaption></figure>',
        "<p>Text</p>", '<figure class="image-placeholder"><figcaption>lost</figcaption></figure>',
    ]
    # By the asset's name in the anchor, by a caption's words, and the only extracted asset for any image.
    blocks = spark.createDataFrame([("d", "b1", 1, "image", "", "a9"), ("d", "b2", 2, "caption", "The BAY", None), ("d", "b3", 3, "caption", "Other", None), ("e", "b1", 1, "image", "x", None)], schema)
    assets = spark.createDataFrame(
        [("d", "a9", 1, None, "extracted", None, "images/9.png"), ("d", "a8", 2, None, "extracted", "the bay", "images/8.png"), ("e", "a7", 1, None, "extracted", "One", "images/7.png")], assets.schema)
    html = {r["chapter_id"]: r["html"].split("\n") for r in layout.chapters_html(blocks, assets).collect()}
    assert html["d"][0] == '<figure class="image"><img src="images/9.png" alt="" /></figure>' and 'src="images/8.png" alt="The BAY"' in html["d"][1] and "placeholder" in html["d"][2]
    assert html["e"] == ['<figure class="image"><img src="images/7.png" alt="x" /><figcaption>One</figcaption></figure>']


def test_stages_that_run_again(spark):
    names = ["draft", "lexicon", "revision", "proofread"]
    wanted = spark.createDataFrame([(b, s, n, f"{b}{s}") for b in "ab" for n, s in enumerate(names)], "book_id string, stage string, stage_no int, fingerprint string")
    recorded = spark.createDataFrame([("a", "draft", "complete", "adraft"), ("a", "lexicon", "complete", "old"), ("a", "revision", "complete", "arevision")], "book_id string, stage string, status string, fingerprint string")
    got = {(r["book_id"], r["stage"]): (r["stale"], r["runs"]) for r in stages.stale_stages(wanted, recorded).collect()}
    assert [got["a", s] for s in names] == [(False, False), (True, True), (False, True), (True, True)] and all(got["b", s] == (True, True) for s in names)
    parts = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 1, "x"), ("b", 2, None)], "book_id string, n int, text string")
    prints = dict(rows(stages.input_fingerprints(parts, ["book_id"], "n", "text"), "book_id", "fingerprint"))
    assert prints["a"] != prints["b"] and prints == dict(rows(stages.input_fingerprints(parts.repartition(3), ["book_id"], "n", "text"), "book_id", "fingerprint"))
    run = spark.createDataFrame([("a", "s", "p", "m", "c"), ("b", "s", "p", "m", "c"), ("z", "s", "p", "m", "c")], "book_id string, source_fingerprint string, provider string, model string, config_fingerprint string")
    manifest = run.where("book_id <> 'z'").withColumn("model", F.when(F.col("book_id") == "b", "other").otherwise(F.col("model")))
    assert rows(stages.resume_compatible(run, manifest), "book_id", "compatible", "differs") == [("a", True, []), ("b", False, ["model"]), ("z", False, None)]


def test_json_documents(spark, tmp_path):
    path = str(tmp_path / "errors")
    table = spark.createDataFrame([("k", 1), ("l", None)], "chunk_id string, attempts int")
    jsonl.write_json_array(table, path)
    assert rows(jsonl.read_json_array(spark, path, "chunk_id string, attempts int"), "chunk_id", "attempts") == [("k", 1), ("l", None)]
    jsonl.write_json_object(table.limit(1), path)
    assert rows(jsonl.read_json_object(spark, path, "chunk_id string, attempts int"), "chunk_id") == [("k",)]
    assert rows(jsonl.read_json_map(spark, path), "key", "value") == [("attempts", "1"), ("chunk_id", "k")]
    with pytest.raises(Exception, match="no JSON array"):
        jsonl.read_json_array(spark, path, "chunk_id string").collect()
    with pytest.raises(Exception, match="one row"):
        jsonl.write_json_object(table, path + "2")
    (tmp_path / "list.json").write_text("[1]")
    with pytest.raises(Exception, match="JSON object"):
        jsonl.read_json_map(spark, str(tmp_path / "list.json")).collect()
    assert jsonl.read_json_map(spark, str(tmp_path / "none")).count() == 0 and jsonl.read_json_array(spark, str(tmp_path / "none"), "chunks").count() == 0


def test_outputs_are_validated(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    (tmp_path / "b.pdf").write_bytes(b"")
    with zipfile.ZipFile(tmp_path / "c.epub", "w") as archive:
        archive.writestr("mimetype", "application/epub+zip")
    (tmp_path / "d.epub").write_bytes(b"no archive")
    names = [("a.pdf", "pdf"), ("b.pdf", "pdf"), ("c.epub", "epub"), ("d.epub", "epub"), ("e.epub", "epub"), ("f.pdf", "pdf")]
    table = spark.createDataFrame([(str(tmp_path / n), k) for n, k in names], "path string, kind string")
    got = [(os.path.basename(p), *rest) for p, *rest in rows(books.validate_outputs(spark, table), "path", "passed", "reason")]
    assert got == [("a.pdf", True, None), ("b.pdf", False, "missing_or_empty_file"), ("c.epub", False, "missing_entries"), ("d.epub", False, "missing_entries"),
                   ("e.epub", False, "missing_file"), ("f.pdf", False, "missing_or_empty_file")]
    with pytest.raises(Exception, match="Unsupported output kind"):
        books.validate_outputs(spark, table.withColumn("kind", F.lit("txt"))).collect()


def test_structured_chapters_and_manifests(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"chapter_id": "c", "chapter_index": 1, "translated_title": "t", "blocks": [{"block_id": "b1", "kind": "image", "text": "", "order_index": 1}],'
                                      ' "assets": [{"source_asset_id": "a", "status": "extracted", "block_anchor_id": "b1"}, {"source_asset_id": "z", "status": "missing"}]}\n')
    chapters_ = jsonl.read_jsonl(spark, str(tmp_path / "s.jsonl"), "structured_chapters")
    blocks, assets = jsonl.chapter_parts(chapters_)
    assert rows(blocks, "chapter_id", "block_id", "kind") == [("c", "b1", "image")]
    manifest = editorial.asset_list(assets).first().asDict(recursive=True)
    assert (manifest["asset_count"], manifest["extracted_count"], manifest["caption_only_count"], manifest["missing_count"]) == (2, 1, 0, 1)
    assert [a["source_asset_id"] for a in manifest["assets"]] == ["a", "z"]


def test_providers_by_name():
    assert translate.build_provider("stub", mark="x").translate("p", "s").text == "xs"
    with pytest.raises(ValueError, match="Unsupported provider"):
        translate.build_provider("other")


def test_unknown_suffixes_fail(spark):
    files = spark.createDataFrame([("/a/x.PDF",), ("/a/y.epub",)], "path string")
    assert rows(books.check_suffixes(files), "kind") == [("epub",), ("pdf",)]
    with pytest.raises(Exception, match="Unsupported input file type"):
        books.check_suffixes(spark.createDataFrame([("/a/x.txt",)], "path string")).collect()


def test_asset_counts(spark):
    assets = spark.createDataFrame([("c", "extracted"), ("c", "caption-only"), ("c", "extracted")], "chapter_id string, status string")
    assert tuple(editorial.asset_manifest(assets).first()) == ("c", 2, 1, 0)
    named = spark.createDataFrame([("c", "a", 1, ".png"), ("c", "a", 2, ".png")], "chapter_id string, source_asset_id string, ord int, suffix string")
    assert rows(layout.unique_file_names(named), "file_name") == [("images/c-a-2.png",), ("images/c-a.png",)]
