import io
import zipfile

from pyspark.sql import functions as F

from quireloom.operators.layout import html_page
from quireloom.sources.books import missing_entries, read_epub
from quireloom.sources.epub_writer import epub_archives


def test_archives_can_be_read_again(spark):
    rows = [("b", "A & B", 1, "Two", "<p>second</p>"), ("b", "A & B", 0, "One <1>", "<h1>One</h1><p>first</p>"), ("c", None, 0, None, None)]
    table = spark.createDataFrame(rows, "book_id string, book_title string, chapter_index int, title string, body string")
    pages = table.withColumn("page", html_page(F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))))
    got = {r["book_id"]: bytes(r["content"]) for r in epub_archives(pages).collect()}
    again = {r["book_id"]: bytes(r["content"]) for r in epub_archives(pages.repartition(3)).collect()}
    assert got == again and set(got) == {"b", "c"}
    book = read_epub(got["b"], "stem")
    assert book["title"] == "A & B" and book["toc"] == ["One <1>", "Two"] and book["pages"][0].endswith("One\nfirst")
    with zipfile.ZipFile(io.BytesIO(got["c"])) as archive:
        assert missing_entries(archive) == [] and archive.namelist()[0] == "mimetype"


def test_images_go_into_the_archive(spark):
    pages = spark.createDataFrame([("b", "Book", 0, "One", "<html/>")], "book_id string, book_title string, chapter_index int, title string, page string")
    images = spark.createDataFrame([("b", "images/c-a.png", bytearray(b"png")), ("z", "x.png", bytearray(b"x"))], "book_id string, file_name string, content binary")
    content = bytes(epub_archives(pages, images=images).first()["content"])
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        assert archive.read("EPUB/images/c-a.png") == b"png" and 'href="images/c-a.png" media-type="image/png"' in archive.read("EPUB/content.opf").decode()
        assert "One" in archive.read("EPUB/toc.ncx").decode()
