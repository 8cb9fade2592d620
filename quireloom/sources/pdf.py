"""Books from PDF files: text of pages, outline and images, with the standard library inside Arrow batches.

Covers uncompressed and deflated streams, object streams, simple fonts and fonts with a map to Unicode. Text in other
encodings or encrypted files comes out as an error or as empty pages; a full renderer is a matter of a plug-in.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireloom.functions.text import path_stem

PDF = (
    "path string, title string, raw_text string, pages array<string>, toc array<struct<title:string,page_index:int>>, "
    "images array<struct<id:string,page_index:int,size:int>>, error string"
)
_TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|[\[\]{}]|/[^\s<>\[\]()/%{}]*|[+-]?\d*\.?\d+|[A-Za-z'\"*][A-Za-z0-9'\"*]*|<[0-9A-Fa-f\s]*>|\(")
_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b")
_ESCAPES = {ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("b"): 8, ord("f"): 12}


class Ref(int):
    """Number of another object."""


class Name(str):
    """A name such as /Type."""


class Operator(bytes):
    """A bare word of a content stream."""


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    """A string in parentheses that begins behind ``at``."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at]
        if c == 0x5C:
            at += 1
            if octal := re.compile(rb"[0-7]{1,3}").match(data, at):
                out.append(int(octal.group(), 8) & 255)
                at = octal.end()
                continue
            if at < len(data) and data[at] not in b"\r\n":
                out.append(_ESCAPES.get(data[at], data[at]))
            at += 1
            continue
        depth += (c == 0x28) - (c == 0x29)
        at += 1
        if not depth:
            break
        out.append(c)
    return bytes(out), at


def _values(data: bytes, at: int = 0) -> Iterator[tuple[object, int]]:
    """Values and operators in order, each with the place behind it."""
    stack: list[list] = []
    while found := _TOKEN.search(data, at):
        token, at = found.group(), found.end()
        if token.startswith(b"%"):
            continue
        if token in (b"<<", b"["):
            stack.append([token])
            continue
        if token in (b">>", b"]"):
            if not stack:
                continue
            kind, *items = stack.pop()
            value = dict(zip(items[::2], items[1::2], strict=False)) if kind == b"<<" else items
        elif token == b"(":
            value, at = _literal(data, at)
        elif token.startswith(b"<"):
            digits = re.sub(rb"\s", b"", token[1:-1])
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif token.startswith(b"/"):
            value = Name(token[1:].decode("latin-1"))
        elif token == b"R" and stack and len(stack[-1]) > 2:
            stack[-1].pop()
            value = Ref(stack[-1].pop())
        elif token[:1] in b"+-.0123456789":
            value = float(token) if b"." in token else int(token)
        else:
            value = {b"true": True, b"false": False, b"null": None}.get(token, Operator(token))
        if stack:
            stack[-1].append(value)
        else:
            yield value, at


class Document:
    """Objects of a file by number; streams are deflated when read."""

    def __init__(self, data: bytes):
        if not data.lstrip().startswith(b"%PDF"):
            raise ValueError("no PDF")
        if b"/Encrypt" in data:
            raise ValueError("encrypted")
        self.objects: dict[int, object] = {}
        self.streams: dict[int, bytes] = {}
        for m in _OBJECT.finditer(data):
            end = data.find(b"endobj", m.end())
            self._add(int(m.group(1)), data[m.end() : end if end > 0 else len(data)])
        for number in [n for n, o in self.objects.items() if isinstance(o, dict) and o.get("Type") == "ObjStm"]:
            self._unpack(self.objects[number], self.stream(number))

    def _add(self, number: int, body: bytes) -> None:
        head, mark, rest = body.partition(b"stream")
        self.objects[number] = next((v for v, _ in _values(head)), None)
        if mark:
            rest = rest[2:] if rest.startswith(b"\r\n") else rest[1:]
            self.streams[number] = rest[: rest.rfind(b"endstream")]

    def _unpack(self, head: dict, data: bytes) -> None:
        first = self.get(head.get("First"))
        numbers = [int(x) for x in data[:first].split()]
        for number, offset in zip(numbers[::2], numbers[1::2], strict=False):
            self.objects.setdefault(number, next((v for v, _ in _values(data, first + offset)), None))

    def get(self, value: object) -> object:
        for _ in range(32):
            if not isinstance(value, Ref):
                return value
            value = self.objects.get(int(value))
        return None

    def stream(self, number: int) -> bytes:
        data, head = self.streams.get(number, b""), self.objects.get(number) or {}
        filters = self.get(head.get("Filter"))
        for name in filters if isinstance(filters, list) else [filters] if filters else []:
            if self.get(name) != "FlateDecode":
                raise ValueError(f"unread filter {name}")
            data = zlib.decompressobj().decompress(data)
        return data

    def root(self) -> dict:
        for o in self.objects.values():
            if isinstance(o, dict) and o.get("Type") == "Catalog":
                return o
        raise ValueError("no catalog")

    def pages(self) -> list[tuple[int, dict]]:
        """Pages in order with their object numbers; resources are inherited."""
        found: list[tuple[int, dict]] = []
        seen: set[int] = set()

        def walk(ref: object, inherited: object) -> None:
            node = self.get(ref)
            if not isinstance(node, dict) or int(ref) in seen:
                return
            seen.add(int(ref))
            resources = node.get("Resources", inherited)
            if "Kids" in node:
                for kid in self.get(node["Kids"]) or []:
                    walk(kid, resources)
            else:
                found.append((int(ref), node | {"Resources": resources}))

        walk(self.root().get("Pages"), {})
        return found

    def unicode_map(self, font: object) -> dict[bytes, str] | None:
        """Codes to text of a font that has such a map."""
        ref = (self.get(font) or {}).get("ToUnicode")
        if not isinstance(ref, Ref):
            return None
        table: dict[bytes, str] = {}
        held: list = []
        for value, _ in _values(self.stream(int(ref))):
            if not isinstance(value, Operator):
                held.append(value)
                continue
            if value == b"endbfchar":
                for code, text in zip(held[::2], held[1::2], strict=False):
                    table[code] = text.decode("utf-16-be", "replace")
            elif value == b"endbfrange":
                for low, high, start in zip(held[::3], held[1::3], held[2::3], strict=False):
                    for i in range(int.from_bytes(high) - int.from_bytes(low) + 1):
                        text = start[i] if isinstance(start, list) else (int.from_bytes(start) + i).to_bytes(len(start))
                        table[(int.from_bytes(low) + i).to_bytes(len(low))] = text.decode("utf-16-be", "replace")
            held = []
        return table

    def page_text(self, page: dict) -> str:
        """Strings a page shows; moves to another line are line ends."""
        contents = page.get("Contents")
        whole = self.get(contents)
        parts = whole if isinstance(whole, list) else [contents]
        data = b"\n".join(self.stream(int(p)) for p in parts if isinstance(p, Ref))
        fonts = self.get((self.get(page.get("Resources")) or {}).get("Font")) or {}
        out: list[str] = []
        held: list = []
        table: dict[bytes, str] | None = None

        def show(text: object) -> None:
            if not isinstance(text, bytes):
                return
            if table:
                width = max(map(len, table))
                out.extend(table.get(text[i : i + width], "") for i in range(0, len(text), width))
            else:
                out.append(text.decode("utf-16") if text[:2] in (b"\xfe\xff", b"\xff\xfe") else text.decode("cp1252", "replace"))

        for value, _ in _values(data):
            if not isinstance(value, Operator):
                held.append(value)
                continue
            if value == b"Tf" and held:
                table = self.unicode_map(fonts.get(held[0]))
            elif value in (b"T*", b"ET") or (value in (b"Td", b"TD") and len(held) > 1 and held[-1]):
                out.append("\n")
            elif value in (b"'", b'"') and held:
                out.append("\n")
                show(held[-1])
            elif value == b"Tj" and held:
                show(held[-1])
            elif value == b"TJ" and held and isinstance(held[-1], list):
                for piece in held[-1]:
                    if isinstance(piece, (int, float)) and piece < -200:
                        out.append(" ")
                    show(piece)
            held = []
        return re.sub(r"\n{2,}", "\n", "".join(out)).strip()

    def outline(self, places: dict[int, int]) -> list[dict]:
        """Titles of the outline, depth first, with the index of their page where it is known."""
        found: list[dict] = []
        seen: set[int] = set()

        def walk(ref: object) -> None:
            while isinstance(ref, Ref) and int(ref) not in seen:
                seen.add(int(ref))
                node = self.get(ref) or {}
                title = self.get(node.get("Title"))
                target = self.get(node.get("Dest"))
                if target is None:
                    target = self.get((self.get(node.get("A")) or {}).get("D"))
                page = target[0] if isinstance(target, list) and target else None
                if isinstance(title, bytes):
                    text = title.decode("utf-16") if title[:2] in (b"\xfe\xff", b"\xff\xfe") else title.decode("cp1252", "replace")
                    found.append({"title": text.strip(), "page_index": places.get(int(page)) if isinstance(page, Ref) else None})
                walk(node.get("First"))
                ref = node.get("Next")

        walk((self.get(self.root().get("Outlines")) or {}).get("First"))
        return found

    def images(self, pages: list[tuple[int, dict]]) -> list[dict]:
        """Images of pages, each at its first page."""
        found: dict[int, dict] = {}
        for index, (_, page) in enumerate(pages):
            drawn = self.get((self.get(page.get("Resources")) or {}).get("XObject")) or {}
            for ref in drawn.values():
                if isinstance(ref, Ref) and (self.get(ref) or {}).get("Subtype") == "Image" and int(ref) not in found:
                    found[int(ref)] = {"id": f"pdf-xref-{int(ref)}", "page_index": index, "size": len(self.streams.get(int(ref), b""))}
        return list(found.values())


def read_pdf(content: bytes, stem: str) -> dict:
    """Title (the file's stem), stripped page texts with empty ones kept, outline and images."""
    document = Document(content)
    pages = document.pages()
    texts = [document.page_text(p) for _, p in pages]
    return {
        "title": stem, "raw_text": "\n\n".join(t for t in texts if t), "pages": texts,
        "toc": document.outline({number: i for i, (number, _) in enumerate(pages)}), "images": document.images(pages),
    }


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """A row for each PDF of a folder. One that cannot be read has its error and nulls; it does not fail the others."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").endswith(".pdf"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "title", "raw_text", "pages", "toc", "images", "error"]
        for batch in batches:
            rows = []
            for where, stem, content in zip(batch["path"], batch["stem"], batch["content"], strict=True):
                try:
                    rows.append({"path": where, "error": None} | read_pdf(content, stem))
                except Exception as error:
                    rows.append(dict.fromkeys(names) | {"path": where, "error": f"{type(error).__name__}: {error}"})
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", path_stem("path").alias("stem"), "content").mapInPandas(run, PDF)


def book_tables(pdfs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """books, pages and toc as the chapter operators take them, by file stem."""
    book = path_stem("path").alias("book_id")
    return (
        pdfs.select(book, "title", "raw_text"),
        pdfs.select(book, F.posexplode("pages").alias("page_index", "text")),
        pdfs.select(book, F.posexplode("toc").alias("ord", "t")).select("book_id", "ord", "t.title", "t.page_index"),
    )
