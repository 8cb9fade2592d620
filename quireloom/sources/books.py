"""Books from EPUB archives: text, contents, images and captions, with the standard library inside Arrow batches."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireloom.functions.text import path_stem

BOOK = (
    "path string, title string, raw_text string, pages array<string>, toc array<string>, "
    "images array<struct<id:string,href:string,caption:string,size:int>>, "
    "captions array<struct<href:string,caption:string>>, missing array<string>, error string"
)
#: Folders whose outputs are validated in one go.
MAX_FOLDERS = 1_000
_CONTAINER = "META-INF/container.xml"


def discover_books(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder and its folders that end in .pdf or .epub in any case, by path, with their size and time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.lower("path").rlike(r"\.(pdf|epub)$")).select("path", "length", "modificationTime").orderBy("path")


def check_suffixes(files: DataFrame) -> DataFrame:
    """Files (path) with ``kind``, 'pdf' or 'epub'; running the plan fails where a path has another suffix."""
    kind = F.regexp_extract(F.lower("path"), r"\.(pdf|epub)$", 1)
    other = F.raise_error(F.concat(F.lit("Unsupported input file type: "), "path")).cast("string")
    return files.withColumn("kind", F.when(kind != "", kind).otherwise(other))


def file_fingerprint():
    """SHA-256 over path, time and size of a file."""
    return F.sha2(F.concat("path", F.col("modificationTime").cast("string"), F.col("length").cast("string")), 256)


class _Page(HTMLParser):
    """Text nodes, and images with what may be their captions."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.images: list[dict] = []
        self.stack: list[str] = []
        self.figures: list[dict] = []
        self.captions: list[list[str]] = []

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        if tag == "img":
            image = {"href": (values.get("src") or "").strip(), "alt": values.get("alt"), "title": values.get("title"), "figure": self.figures[-1] if self.figures else None}
            self.images.append(image)
        if tag == "figure":
            self.figures.append({"caption": None})
        if tag == "figcaption":
            self.captions.append([])
        if tag not in self.VOID:
            self.stack.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in self.VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "figcaption" and self.captions:
            words = " ".join(self.captions.pop())
            if self.figures and self.figures[-1]["caption"] is None:
                self.figures[-1]["caption"] = words
        if tag == "figure" and self.figures:
            self.figures.pop()
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass

    def handle_data(self, data):
        if data.strip() and not {"script", "style"} & set(self.stack):
            self.parts.append(data.strip())
            for held in self.captions:
                held.append(data.strip())


def html_text(html: str) -> str:
    """Stripped text nodes of a page, one to a line; scripts, styles and comments are no text."""
    page = _Page()
    page.feed(html)
    page.close()
    return "\n".join(page.parts)


def image_captions(html: str) -> list[tuple[str, str]]:
    """(href, caption) of the images of a page that have a caption: of their figure, else alt, else title."""
    page = _Page()
    page.feed(html)
    page.close()
    found = []
    for image in page.images:
        figure = (image["figure"] or {}).get("caption")
        caption = next((c.strip() for c in (figure, image["alt"], image["title"]) if c and c.strip()), None)
        if image["href"] and caption:
            found.append((image["href"], caption))
    return found


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _package(archive: zipfile.ZipFile) -> tuple[str, ElementTree.Element]:
    root = ElementTree.fromstring(archive.read(_CONTAINER))
    path = next((e.get("full-path") for e in root.iter() if _name(e.tag) == "rootfile"), None)
    if not path:
        raise ValueError("no rootfile")
    return path, ElementTree.fromstring(archive.read(path))


def missing_entries(archive: zipfile.ZipFile) -> list[str]:
    """Entries that a reader of the archive needs and that are not there; the first kind of gap found."""
    names = set(archive.namelist())
    if gone := sorted({"mimetype", _CONTAINER} - names):
        return gone
    try:
        root = ElementTree.fromstring(archive.read(_CONTAINER))
    except ElementTree.ParseError:
        return [_CONTAINER]
    path = next((e.get("full-path", "").strip() for e in root.iter() if _name(e.tag) == "rootfile"), "")
    if not path:
        return [_CONTAINER]
    if path not in names:
        return [path]
    folder = posixpath.dirname(path)
    try:
        package = ElementTree.fromstring(archive.read(path))
    except ElementTree.ParseError:
        package = ElementTree.Element("package")
    nav = next((e.get("href", "").strip() for e in package.iter() if _name(e.tag) == "item" and "nav" in (e.get("properties") or "").split()), "")
    if not nav:
        return [f"{folder}/nav.xhtml"]
    nav = posixpath.normpath(posixpath.join(folder, nav))
    return [] if nav in names else [nav]


def validate_outputs(spark: SparkSession, outputs: DataFrame) -> DataFrame:
    """``path``, ``kind``, ``passed``, ``reason``, ``missing`` and ``size_bytes`` of written outputs (path, kind).

    A PDF passes when it is there and not empty, an EPUB when no entry that a reader needs is missing. Files are looked at
    where they are, by the workers; another kind fails.
    """
    known = F.when(F.col("kind").isin("pdf", "epub"), F.col("kind")).otherwise(
        F.raise_error(F.concat(F.lit("Unsupported output kind: "), "kind")).cast("string")
    )
    folders = [r[0] for r in outputs.select(F.regexp_replace("path", "/[^/]*$", "")).distinct().limit(MAX_FOLDERS + 1).collect()]
    if len(folders) > MAX_FOLDERS:
        raise ValueError(f"outputs in more than {MAX_FOLDERS} folders")
    found = spark.read.format("binaryFile").load(folders) if folders else spark.createDataFrame([], "path string, length bigint, content binary")

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            gaps = []
            for kind, content in zip(batch["kind"], batch["content"], strict=True):
                try:
                    gaps.append(missing_entries(zipfile.ZipFile(io.BytesIO(content))) if kind == "epub" and content is not None else [])
                except zipfile.BadZipFile:
                    gaps.append(["mimetype"])
            yield pd.DataFrame({"path": batch["path"], "kind": batch["kind"], "size_bytes": batch["length"], "missing": gaps})

    bare = F.regexp_replace("path", "^file:/*", "/")
    held = outputs.select(bare.alias("path"), known.alias("kind")).join(found.select(bare.alias("path"), "length", "content"), "path", "left")
    looked = held.mapInPandas(look, "path string, kind string, size_bytes bigint, missing array<string>")
    there = F.col("size_bytes").isNotNull()
    reason = (
        F.when((F.col("kind") == "pdf") & (F.coalesce("size_bytes", F.lit(0)) == 0), "missing_or_empty_file")
        .when(~there, "missing_file")
        .when(F.size("missing") > 0, "missing_entries")
    )
    return looked.select("path", "kind", reason.isNull().alias("passed"), reason.alias("reason"), "missing", F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"))


def _contents(archive: zipfile.ZipFile, package: ElementTree.Element, folder: str, items: dict) -> list[str]:
    """Titles of the contents, depth first, of the navigation page or else of the older table."""
    names = set(archive.namelist())
    nav = next((h for h, p, _ in items.values() if "nav" in p), None)
    if nav and (path := posixpath.normpath(posixpath.join(folder, nav))) in names:
        html = archive.read(path).decode("utf-8", "replace")
        part = re.search(r"<nav[^>]*toc[^>]*>(.*?)</nav>", html, re.S | re.I)
        titles = [html_text(a).replace("\n", " ") for a in re.findall(r"<(?:a|span)\b[^>]*>(.*?)</(?:a|span)>", part.group(1) if part else "", re.S)]
        if titles := [t for t in titles if t]:
            return titles
    ncx = next((h for h, _, kind in items.values() if kind == "application/x-dtbncx+xml"), None)
    if ncx and (path := posixpath.normpath(posixpath.join(folder, ncx))) in names:
        root = ElementTree.fromstring(archive.read(path))
        return [
            (t.text or "").strip()
            for point in root.iter() if _name(point.tag) == "navPoint"
            for label in point if _name(label.tag) == "navLabel"
            for t in label if _name(t.tag) == "text" and (t.text or "").strip()
        ]
    return []


def read_epub(content: bytes, stem: str) -> dict:
    """Title, sections in reading order, contents, images and captions of an archive."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = set(archive.namelist())
        path, package = _package(archive)
        folder = posixpath.dirname(path)
        items = {
            e.get("id"): (e.get("href", ""), (e.get("properties") or "").split(), e.get("media-type", ""))
            for e in package.iter() if _name(e.tag) == "item"
        }

        def full(href: str) -> str:
            return posixpath.normpath(posixpath.join(folder, href))

        def page(item: str) -> str | None:
            href, properties, kind = items[item]
            return href if kind == "application/xhtml+xml" and full(href) in names else None

        spine = [e.get("idref") for e in package.iter() if _name(e.tag) == "itemref"]
        read = [i for i in spine if i != "nav" and i in items and page(i)] or [i for i in items if page(i)]
        sections, captions = [], {}
        for item in read:
            if text := html_text(archive.read(full(items[item][0])).decode("utf-8", "replace")):
                sections.append(text)
        for item in items:
            if href := page(item):
                for src, caption in image_captions(archive.read(full(href)).decode("utf-8", "replace")):
                    captions[src] = caption
                    captions.setdefault(posixpath.basename(src), caption)
        images = [
            {"id": i, "href": h, "caption": captions.get(h) or captions.get(posixpath.basename(h)), "size": archive.getinfo(full(h)).file_size}
            for i, (h, _, kind) in items.items() if kind.startswith("image/") and full(h) in names
        ]
        title = next(((e.text or "").strip() for e in package.iter() if _name(e.tag) == "title"), "") or stem
        seen = {x["href"] for x in images} | {posixpath.basename(x["href"]) for x in images}
        alone, emitted = [], set()
        for href, caption in sorted(captions.items()):
            base = posixpath.basename(href) or href
            if href not in seen and base not in seen and base not in emitted:
                emitted.add(base)
                alone.append({"href": href, "caption": caption})
        return {
            "title": title, "raw_text": "\n\n".join(sections).strip(), "pages": sections,
            "toc": _contents(archive, package, folder, items), "images": images, "captions": alone,
            "missing": missing_entries(archive),
        }


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """A row for each EPUB of a folder. One that cannot be read has its error and nulls; it does not fail the others."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").endswith(".epub"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in BOOK.split(", ")]
        for batch in batches:
            rows = []
            for where, stem, content in zip(batch["path"], batch["stem"], batch["content"], strict=True):
                try:
                    rows.append({"path": where, "error": None} | read_epub(content, stem))
                except Exception as error:
                    rows.append(dict.fromkeys(names) | {"path": where, "error": f"{type(error).__name__}: {error}"})
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", path_stem("path").alias("stem"), "content").mapInPandas(run, BOOK)


def book_assets(books: DataFrame) -> DataFrame:
    """Images of books, then captions whose image is not there."""
    images = books.select("path", F.inline("images")).select(
        "path", F.col("id").alias("source_asset_id"), F.col("href").alias("source_location_hint"), "caption", F.lit("extracted").alias("status")
    )
    alone = books.select("path", F.inline("captions")).select(
        "path", F.concat(F.lit("caption-only:"), "href").alias("source_asset_id"), F.col("href").alias("source_location_hint"), "caption",
        F.lit("caption-only").alias("status"),
    )
    return images.unionByName(alone)
