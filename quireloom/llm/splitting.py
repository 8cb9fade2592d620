"""Problem 1: items above a size limit cut into overlapping pieces at natural boundaries.

Every word gap of an item is a node. A node's successor is the farthest end of a paragraph, line or sentence that a
piece starting there, overlap included, can reach; the hard limit only where no such end is in reach. The cuts are the
nodes visited from 0. They are not walked one after another: the successor table is squared again and again, and each
squaring doubles the part of the path that is marked. One table holds the nodes of all items of an Arrow batch, so the
number of rounds is the logarithm of the longest path and every round is a few array operations.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireloom.sources import read_table

#: Signs that end a sentence, and signs that may follow them.
SENTENCE_ENDS = ".!?。！？…"
SENTENCE_CLOSERS = "\"'”’»)]）」』】》"

WORD_END, SENTENCE_END, LINE_END, PARAGRAPH_END = range(4)
KINDS = np.array(["word", "sentence", "line", "paragraph"])


@functools.cache
def _classes() -> np.ndarray:
    """1 for white space, 2 for line breaks, 4 for sentence ends, 8 for closers, by code point."""
    table = np.zeros(0x110000, np.uint8)
    for cp in range(0x3001):
        if chr(cp).isspace():
            table[cp] = 1
    table[[ord(c) for c in "\n  \x0b\x0c\x85"]] |= 2
    table[[ord(c) for c in SENTENCE_ENDS]] |= 4
    table[[ord(c) for c in SENTENCE_CLOSERS]] |= 8
    return table


def max_words(max_tokens: int) -> int:
    """Most words of a piece whose size, words / 0.75 rounded up, is within the limit."""
    return max_tokens * 3 // 4


def words_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (run of non-white space), and the kind of boundary behind it."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    cls = _classes()[points]
    solid = np.zeros(len(points) + 2, bool)
    solid[1:-1] = (cls & 1) == 0
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint8)
    breaks = np.concatenate(([0], np.cumsum((cls & 2) > 0)))
    pairs = np.concatenate(([0], np.cumsum(points == 13)))
    returns_alone = np.zeros(len(points), bool)
    if pairs[-1]:
        returns_alone = points == 13
        returns_alone[:-1] &= points[1:] != 10
        breaks = breaks + np.concatenate(([0], np.cumsum(returns_alone)))
    behind = np.append(starts[1:], len(points))
    lines = breaks[behind] - breaks[ends]
    kind = np.where(lines >= 2, PARAGRAPH_END, np.where(lines == 1, LINE_END, WORD_END)).astype(np.uint8)
    last = ends - 1
    for _ in range(3):
        last = np.where(((cls[last] & 8) > 0) & (last > starts), last - 1, last)
    sentence = (cls[last] & 4) > 0
    kind[sentence & (kind == WORD_END)] = SENTENCE_END
    kind[-1] = PARAGRAPH_END
    return starts, ends, kind


def greedy_cuts(kinds: list[np.ndarray], limits: list[int], overlaps: list[int]) -> list[np.ndarray]:
    """For each item the word counts at which its pieces end, by pointer doubling over all items at once.

    kinds: kind of boundary behind each word; limits and overlaps: in words, the overlap below the limit.
    """
    sizes = np.array([len(k) + 1 for k in kinds], np.int64)
    offsets = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    begin = np.repeat(offsets, sizes)
    end = begin + np.repeat(sizes, sizes) - 1
    node = np.arange(total)
    reach = np.minimum(
        np.maximum(node - np.repeat(np.array(overlaps, np.int64), sizes), begin)
        + np.repeat(np.array(limits, np.int64), sizes),
        end,
    )
    natural = np.zeros(total, bool)
    for offset, kind in zip(offsets, kinds, strict=True):
        natural[offset + 1 : offset + 1 + len(kind)] = kind > WORD_END
    nearest = np.maximum.accumulate(np.where(natural, node, -1))[reach]
    successor = np.where(nearest > node, nearest, reach)
    reached = np.zeros(total, bool)
    reached[offsets] = True
    while True:
        reached[successor[reached]] = True
        if (successor[offsets] == end[offsets]).all():
            break
        successor = successor[successor]
    return [np.flatnonzero(reached[o + 1 : o + n]) + 1 for o, n in zip(offsets, sizes, strict=True)]


PIECE_FIELDS = (
    "piece_no int, n_pieces int, item_size bigint, start_char int, end_char int, n_words int, size int, "
    "overlap_words int, cut_at string"
)


def split_oversized(
    items: DataFrame,
    kind: str = "item_kind",
    key: str = "item_id",
    text: str = "text",
    max_tokens: str = "max_tokens",
    overlap_tokens: str = "overlap_tokens",
    with_text: bool = True,
) -> DataFrame:
    """Pieces of the items whose size is above their limit; the others give no row.

    size = words / 0.75 rounded up, a word being a run of non-white space. Pieces count from 0; piece n > 0 begins
    ``overlap_words`` before the end of piece n - 1. ``cut_at`` says where a piece ends: paragraph, line, sentence, or
    word where no other boundary was in reach. start_char and end_char locate the piece in the text; with ``with_text``
    the piece is given too. A null or empty text or a null limit gives no row. A null overlap counts as none; an overlap
    that leaves no room for new words is cut to one word less than the limit. A text without white space is one word,
    however long, and is never cut. Repeated rows give repeated pieces. Other columns are not read.
    A narrow plan: no shuffle, no broadcast.
    """
    chosen = items.select(
        F.col(kind).cast("string"),
        F.col(key).cast("string"),
        F.col(text),
        F.col(max_tokens).cast("int"),
        F.coalesce(F.col(overlap_tokens), F.lit(0)).cast("int"),
    ).where(F.col(text).isNotNull() & F.col(max_tokens).isNotNull())
    names = [kind, key, *(f.split()[0] for f in PIECE_FIELDS.split(", ")), *(["text"] if with_text else [])]
    schema = f"`{kind}` string, `{key}` string, {PIECE_FIELDS}" + (", text string" if with_text else "")
    types = [pa.string(), pa.string(), *[pa.int32()] * 2, pa.int64(), *[pa.int32()] * 5, pa.string(), pa.string()]

    def cut(rows: list[tuple]) -> pa.RecordBatch:
        found = [words_of(t) for _, _, t, _, _ in rows]
        limits = [max(1, max_words(m)) for _, _, _, m, _ in rows]
        overlaps = [min(max(0, max_words(o)), w - 1) for w, (_, _, _, _, o) in zip(limits, rows, strict=True)]
        cuts = greedy_cuts([k for _, _, k in found], limits, overlaps)
        out: list[list] = [[] for _ in names]
        for (item_kind, item, body, _, _), (starts, ends, kinds), overlap, at in zip(rows, found, overlaps, cuts, strict=True):
            first = np.maximum(np.concatenate(([0], at[:-1])) - overlap, 0)
            size = (4 * len(kinds) + 2) // 3
            for n, (a, b) in enumerate(zip(first.tolist(), at.tolist(), strict=True)):
                low, high = int(starts[a]), int(ends[b - 1])
                row = [item_kind, item, n, len(at), size, low, high, b - a, (4 * (b - a) + 2) // 3]
                row += [int(at[n - 1]) - a if n else 0, KINDS[kinds[b - 1]]] + ([body[low:high]] if with_text else [])
                for column, value in zip(out, row, strict=True):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=False)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            waiting, chars = [], 0
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(row[2]) > 2 * max_words(row[3]) and len(row[2].split()) > max_words(row[3]):
                    waiting.append(row)
                    chars += len(row[2])
                    if chars > 1_000_000:
                        yield cut(waiting)
                        waiting, chars = [], 0
            if waiting:
                yield cut(waiting)

    return chosen.mapInArrow(run, schema)


def _items(spark: SparkSession, data_dir: str) -> DataFrame:
    """Chapters and chunks with the limits of their kind; the limits are a table of settings with a row for each kind."""
    chapters = read_table(spark, data_dir, "chapters").select(
        F.lit("chapter").alias("item_kind"), F.col("chapter_id").alias("item_id"), "text"
    )
    chunks = read_table(spark, data_dir, "chunks").select(
        F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_id"), F.col("source_text").alias("text")
    )
    limits = (
        read_table(spark, data_dir, "split_limits")
        .groupBy("item_kind")
        .agg(F.min("max_tokens").alias("max_tokens"), F.min("overlap_tokens").alias("overlap_tokens"))
    )
    return chapters.unionByName(chunks).join(limits, "item_kind")


def p1_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """Items that had to be cut."""
    pieces = split_oversized(_items(spark, data_dir), with_text=False)
    return pieces.where("piece_no = 0 AND item_id IS NOT NULL").select("item_kind", "item_id").distinct()


def p1_pieces(spark: SparkSession, data_dir: str) -> DataFrame:
    """All pieces with their texts; rows delivered twice count once."""
    pieces = split_oversized(_items(spark, data_dir))
    return pieces.dropDuplicates(["item_kind", "item_id", "piece_no", "start_char", "end_char", "item_size", "text"])


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces}

_BLANK = r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

SQL = {
    "p1_found": f"""
        WITH items AS (
            SELECT 'chapter' AS item_kind, chapter_id AS item_id, text FROM chapters
            UNION ALL SELECT 'chunk', chunk_id, source_text FROM chunks)
        SELECT DISTINCT item_kind, item_id
        FROM items JOIN split_limits USING (item_kind)
        WHERE item_id IS NOT NULL
          AND ceil(len(regexp_extract_all(text, '[^{_BLANK}]+')) / 0.75) > max_tokens
    """
}
