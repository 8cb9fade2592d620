"""EPUB archives from the XHTML of chapters: a row for each book, its archive as bytes."""

from __future__ import annotations

import html
import io
import mimetypes
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STYLE = "body { line-height: 1.6; } h1 { text-align: center; } aside.callout { background: #ece9e4; padding: 0.8em; } figcaption { font-size: 0.9em; }"
_CONTAINER = (
    '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles>'
    '<rootfile full-path="EPUB/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
)


def build_epub(
    identifier: str, title: str, language: str, chapters: list[tuple[str, str]], images: list[tuple[str, bytes]] = []
) -> bytes:
    """An archive of chapters (title, page) and images (file name, content); equal input gives equal bytes."""
    out = io.BytesIO()
    names = [f"chapter-{i + 1}.xhtml" for i in range(len(chapters))]
    links = "".join(f'<li><a href="{n}">{html.escape(t)}</a></li>' for n, (t, _) in zip(names, chapters, strict=True))
    items = "".join(f'<item id="c{i + 1}" href="{n}" media-type="application/xhtml+xml"/>' for i, n in enumerate(names))
    items += "".join(
        f'<item id="i{i + 1}" href="{html.escape(n)}" media-type="{mimetypes.guess_type(n)[0] or "application/octet-stream"}"/>'
        for i, (n, _) in enumerate(images)
    )
    points = "".join(
        f'<navPoint id="p{i + 1}"><navLabel><text>{html.escape(t)}</text></navLabel><content src="{n}"/></navPoint>'
        for i, (n, (t, _)) in enumerate(zip(names, chapters, strict=True))
    )
    ncx = (
        '<?xml version="1.0" encoding="utf-8"?><ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1">'
        f'<head><meta name="dtb:uid" content="{html.escape(identifier)}"/></head><docTitle><text>{html.escape(title)}</text></docTitle>'
        f"<navMap>{points}</navMap></ncx>"
    )
    spine = "".join(f'<itemref idref="c{i + 1}"/>' for i in range(len(names)))
    package = (
        '<?xml version="1.0" encoding="utf-8"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id">'
        f'<metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{html.escape(identifier)}</dc:identifier>'
        f"<dc:title>{html.escape(title)}</dc:title><dc:language>{html.escape(language)}</dc:language></metadata><manifest>"
        '<item id="nav" href="nav.xhtml" properties="nav" media-type="application/xhtml+xml"/>'
        f'<item id="css" href="styles/style.css" media-type="text/css"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>{items}'
        f'</manifest><spine toc="ncx">{spine}</spine></package>'
    )
    nav = (
        '<?xml version="1.0" encoding="utf-8"?><html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops">'
        f'<head><title>{html.escape(title)}</title></head><body><nav epub:type="toc"><ol>{links}</ol></nav></body></html>'
    )
    files = [("mimetype", "application/epub+zip"), ("META-INF/container.xml", _CONTAINER), ("EPUB/content.opf", package), ("EPUB/nav.xhtml", nav), ("EPUB/styles/style.css", STYLE)]
    files += [("EPUB/toc.ncx", ncx), *((f"EPUB/{n}", page) for n, (_, page) in zip(names, chapters, strict=True))]
    files += [(f"EPUB/{n}", content) for n, content in images]
    with zipfile.ZipFile(out, "w") as archive:
        for name, content in files:
            entry = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            entry.compress_type = zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED
            archive.writestr(entry, content)
    return out.getvalue()


def epub_archives(pages: DataFrame, language: str = "zh-CN", images: DataFrame | None = None) -> DataFrame:
    """``book_id`` and ``content`` of each book of pages (book_id, book_title, chapter_index, title, page).

    images: book_id, file_name, content. A book is gathered into one row, as its archive is one value; books are
    independent of each other.
    """
    books = pages.groupBy("book_id").agg(
        F.min("book_title").alias("book_title"), F.sort_array(F.collect_list(F.struct("chapter_index", "title", "page"))).alias("chapters")
    )
    none = F.array().cast("array<struct<file_name:string,content:binary>>")
    if images is not None:
        held = images.groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("file_name", "content"))).alias("images"))
        books = books.join(held, "book_id", "left").withColumn("images", F.coalesce("images", none))
    else:
        books = books.withColumn("images", none)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            content = [
                build_epub(f"epub-{b}", t or b, language, [(c["title"] or "", c["page"] or "") for c in cs], [(i["file_name"], bytes(i["content"] or b"")) for i in ims])
                for b, t, cs, ims in zip(batch["book_id"], batch["book_title"], batch["chapters"], batch["images"], strict=True)
            ]
            yield pd.DataFrame({"book_id": batch["book_id"], "content": content})

    return books.where("book_id IS NOT NULL").mapInPandas(run, "book_id string, content binary")
