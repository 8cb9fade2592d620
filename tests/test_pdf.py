"""PDF files put together by hand."""

import zlib

from quireloom.operators.segmentation import detect_chapters
from quireloom.sources import pdf


def pdf_file(pages, outline=(), deflate=False):
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R /Outlines 90 0 R >>"}
    numbers = [10 + 2 * i for i in range(len(pages))]
    objects[2] = b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % n for n in numbers) + b"] /Resources << /Font << /F1 3 0 R /F2 5 0 R >> /XObject << /I 4 0 R >> >> >>"
    objects[3] = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"
    objects[4] = b"<< /Subtype /Image /Length 3 >>\nstream\nabc\nendstream"
    objects[5] = b"<< /Type /Font /ToUnicode 6 0 R >>"
    objects[6] = b"<< /Length 9 >>\nstream\n2 beginbfchar <0001> <4E66> <0002> <672C> endbfchar 1 beginbfrange <0010> <0012> <0041> endbfrange\nendstream"
    for n, text in zip(numbers, pages, strict=True):
        body = b"BT /F1 12 Tf 72 700 Td " + text + b" ET"
        head = b"<< /Length %d >>" % len(body)
        if deflate:
            body, head = zlib.compress(body), b"<< /Filter /FlateDecode >>"
        objects[n] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (n + 1)
        objects[n + 1] = head + b"\nstream\n" + body + b"\nendstream"
    entries = list(outline)
    objects[90] = b"<< /First 91 0 R >>" if entries else b"<< >>"
    for i, (title, page) in enumerate(entries):
        following = b"/Next %d 0 R" % (92 + i) if i + 1 < len(entries) else b""
        target = b"/Dest [%d 0 R /Fit]" % numbers[page] if page is not None else b""
        objects[91 + i] = b"<< /Title (" + title + b") " + target + following + b" >>"
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objects.items()) + b"trailer << /Root 1 0 R >>\n%%EOF"


def test_text_outline_and_images():
    pages = [b"(Cover) Tj", b"(One) Tj 0 -14 Td [(Fir) 20 (st) -300 (line\\051)] TJ T* (caf\\351) Tj", b"", b"/F2 9 Tf <0001000200100011> Tj"]
    for deflate in (False, True):
        got = pdf.read_pdf(pdf_file(pages, [(b"One", 1), (b"Nowhere", None)], deflate), "x")
        assert got["pages"] == ["Cover", "One\nFirst line)\ncafé", "", "书本AB"]
        assert got["raw_text"] == "Cover\n\nOne\nFirst line)\ncafé\n\n书本AB"
        assert got["toc"] == [{"title": "One", "page_index": 1}, {"title": "Nowhere", "page_index": None}]
        assert got["images"] == [{"id": "pdf-xref-4", "page_index": 0, "size": 4}]


def test_files_become_chapters(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(pdf_file([b"(Cover) Tj", b"(Notes) Tj T* (Notes body.) Tj", b"(Last body.) Tj"], [(b"Notes", 1), (b"Last", 2)]))
    (tmp_path / "bad.PDF").write_bytes(b"nothing")
    (tmp_path / "locked.pdf").write_bytes(b"%PDF-1.4 /Encrypt")
    rows = pdf.read_pdfs(spark, str(tmp_path))
    assert {r["path"].rsplit("/", 1)[1]: r["error"] for r in rows.collect()} == {"a.pdf": None, "bad.PDF": "ValueError: no PDF", "locked.pdf": "ValueError: encrypted"}
    books, pages, toc = pdf.book_tables(rows.where("error IS NULL"))
    got = detect_chapters(books, toc, pages).orderBy("chapter_index").collect()
    assert [(r["chapter_id"], r["text"]) for r in got] == [("notes-0", "Notes body."), ("last-1", "Last body.")]
