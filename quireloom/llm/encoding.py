"""Problem 7: every text as ids of a public byte-level BPE tokenizer.

Pre-tokenisation has no regular expression. The texts of an Arrow batch become one array of code points, a table turns
code points into symbols, and a ten-state automaton runs over them as an associative scan: the transition functions of
fixed-width blocks are composed side by side, the block functions are scanned by doubling, and every block is then
replayed from its entry state. Token starts follow from neighbouring states and symbols. The byte slices between starts
go through pair merging with a cache. Offsets are kept, so that ids decode to the text and each id knows its bytes.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import os
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireloom.sources import read_table

TOKENIZER_FOLDER = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k"

#: A rank file above this size is not a vocabulary and is refused before it is broadcast.
MAX_RANK_BYTES = 64 << 20
#: Characters handled at a time within a batch, so that memory does not follow the batch's size.
SLICE_CHARS = 2_000_000
CACHE_ENTRIES = 300_000

# Symbols of the automaton.
LETTER, SINGLE, LETTER_R, LETTER_V, LETTER_L, LETTER_E, NUMBER, OTHER, QUOTE, SPACE, BLANK, SAME = range(12)
SYMBOLS = 12
# States: after a blank or the start, after a space, in letters, in numbers, in other signs, after an apostrophe that
# starts a token, after 'r 'v 'l, and after a finished contraction.
BEGIN, SPACED, LETTERS, NUMBERS, SIGNS, APOSTROPHE, AFTER_R, AFTER_V, AFTER_L, CONTRACTED = range(10)
STATES = 10


@functools.cache
def symbol_table() -> np.ndarray:
    """Symbol of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
        elif kind == "Z":
            table[cp] = BLANK
    table[[9, 10, 11, 12, 13, 0x85]] = BLANK
    table[ord(" ")] = SPACE
    table[ord("'")] = QUOTE
    for letters, symbol in (("stmd", SINGLE), ("r", LETTER_R), ("v", LETTER_V), ("l", LETTER_L), ("e", LETTER_E)):
        table[[ord(c) for c in letters]] = symbol
    return table


@functools.cache
def transitions() -> np.ndarray:
    """Next state by symbol and state; symbols shifted by SYMBOLS begin a text."""
    table = np.empty((2 * SYMBOLS, STATES), np.uint8)
    for state in range(STATES):
        for symbol in (LETTER, SINGLE, LETTER_R, LETTER_V, LETTER_L, LETTER_E):
            table[symbol, state] = LETTERS
        table[NUMBER, state] = NUMBERS
        table[OTHER, state] = SIGNS
        table[QUOTE, state] = SIGNS if state in (SPACED, SIGNS, APOSTROPHE) else APOSTROPHE
        table[SPACE, state] = SPACED
        table[BLANK, state] = BEGIN
        table[SAME, state] = state
    table[SINGLE, APOSTROPHE] = CONTRACTED
    table[LETTER_R, APOSTROPHE] = AFTER_R
    table[LETTER_V, APOSTROPHE] = AFTER_V
    table[LETTER_L, APOSTROPHE] = AFTER_L
    table[LETTER_E, AFTER_R] = table[LETTER_E, AFTER_V] = table[LETTER_L, AFTER_L] = CONTRACTED
    table[SYMBOLS:] = table[:SYMBOLS, BEGIN][:, None]
    return table


def scan_states(symbols: np.ndarray, width: int = 64) -> np.ndarray:
    """State after every symbol, by composing transition functions instead of stepping."""
    n, flat = len(symbols), transitions().ravel()
    rows = -(-n // width)
    grid = np.full(rows * width, SAME, np.int16)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(rows, width).T) * np.int16(STATES)
    function = np.tile(np.arange(STATES, dtype=np.uint8), (rows, 1))
    for column in grid:
        function = flat[column[:, None] + function]
    step = 1
    while step < rows:
        function[step:] = np.take_along_axis(function[step:], function[:-step].astype(np.intp), 1)
        step *= 2
    state = np.empty(rows, np.uint8)
    if rows:
        state[0], state[1:] = BEGIN, function[:-1, BEGIN]
    out = np.empty((width, rows), np.uint8)
    for j, column in enumerate(grid):
        out[j] = state = flat[column + state]
    return np.ascontiguousarray(out.T).ravel()[:n]


def token_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Whether a token begins at each code point. text_starts: where non-empty texts begin."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    plain = symbol_table()[points]
    first = np.zeros(n, bool)
    first[text_starts] = True
    after = scan_states(plain + first * np.uint8(SYMBOLS))
    before = np.empty(n, np.uint8)
    before[0], before[1:] = BEGIN, after[:-1]
    before[first] = BEGIN
    last = np.ones(n, bool)
    last[:-1] = first[1:]
    following = np.full(n, BLANK, np.uint8)
    following[:-1] = plain[1:]
    blank = (plain == SPACE) | (plain == BLANK)
    blank_before = np.zeros(n, bool)
    blank_before[1:] = blank[:-1]
    blank_before[first] = False
    solid_after = ~last & (following != SPACE) & (following != BLANK)
    completes = np.zeros(n, bool)
    completes[:-1] = after[1:] == CONTRACTED
    completes &= ~last
    contraction = (after == CONTRACTED) | (np.isin(after, (AFTER_R, AFTER_V, AFTER_L)) & completes)
    letter = plain <= LETTER_E
    in_letters = np.isin(before, (LETTERS, SPACED, AFTER_R, AFTER_V, AFTER_L))
    starts = np.where(
        blank,
        ~blank_before | solid_after,
        np.where(
            letter,
            ~in_letters & ~((before == APOSTROPHE) & contraction),
            np.where(
                plain == NUMBER,
                ~np.isin(before, (NUMBERS, SPACED)),
                ~np.isin(before, (SIGNS, APOSTROPHE, SPACED)),
            ),
        ),
    )
    return starts | first


def merge_pairs(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: the adjacent pair of lowest rank is joined until none is left."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(itertools.pairwise(parts)))
        if rank == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class PieceCache(dict):
    """Ids by slice; forgets all when full, which costs time and changes nothing."""

    def __init__(self, merge):
        super().__init__()
        self.merge = merge

    def __missing__(self, piece: bytes) -> list[int]:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        ids = self[piece] = self.merge(piece)
        return ids


def parse_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}


class ByteBpe:
    """Encoder and decoder over a rank file's content."""

    def __init__(self, content: bytes, native: bool = True):
        self.ranks = parse_ranks(content)
        merge = functools.partial(merge_pairs, ranks=self.ranks)
        if native:
            try:
                import tiktoken

                name = hashlib.sha1(content).hexdigest()
                core = tiktoken.Encoding(name, pat_str=r"\S+", mergeable_ranks=self.ranks, special_tokens={})
                merge = core._core_bpe.encode_single_piece
            except (ImportError, AttributeError):
                pass
        self.cache = PieceCache(merge)
        self.pieces = {i: piece for piece, i in self.ranks.items()}
        self.widths = np.zeros(1 + max(self.pieces, default=0), np.int32)
        for i, piece in self.pieces.items():
            self.widths[i] = len(piece)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the texts in a row, the number of ids of each text, and the byte length behind each id."""
        known = [t or "" for t in texts]
        lengths = np.fromiter(map(len, known), np.int64, len(known))
        ends = np.cumsum(lengths)
        counts, ids, widths = np.zeros(len(known), np.int64), [], []
        begin = 0
        while begin < len(known):
            floor = ends[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, floor + SLICE_CHARS, "right")))
            part, sizes = known[begin:stop], lengths[begin:stop]
            one = "".join(part)
            data = one.encode("utf-8", "surrogatepass")
            points = np.frombuffer(one.encode("utf-32-le", "surrogatepass"), np.uint32)
            text_starts = np.cumsum(sizes) - sizes
            at = np.flatnonzero(token_starts(points, text_starts[sizes > 0]))
            bytes_of = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
            offset = np.concatenate(([0], np.cumsum(bytes_of)))
            cuts = np.append(offset[at], len(data)).tolist()
            found = list(map(self.cache.__getitem__, [data[a:b] for a, b in itertools.pairwise(cuts)]))
            sizes_of = np.fromiter(map(len, found), np.int64, len(found))
            owner = np.searchsorted(text_starts + sizes, at, "right")
            counts[begin:stop] = np.bincount(owner, sizes_of, len(part)).astype(np.int64) if len(at) else 0
            ids.append(np.fromiter(itertools.chain.from_iterable(found), np.int32, int(sizes_of.sum())))
            begin = stop
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        return flat, counts, self.widths[flat]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(self.pieces[i] for i in ids)


def read_ranks(folder: str = TOKENIZER_FOLDER, name: str = TOKENIZER) -> bytes:
    path = os.path.join(folder, f"{name}.tiktoken")
    if os.path.getsize(path) > MAX_RANK_BYTES:
        raise ValueError(f"{path} is larger than a vocabulary can be ({MAX_RANK_BYTES} bytes)")
    with open(path, "rb") as f:
        return f.read()


@functools.lru_cache(maxsize=4)
def _bpe(content: bytes) -> ByteBpe:
    return ByteBpe(content)


def _rank_broadcast(spark: SparkSession, folder: str, name: str):
    """The rank file, at most MAX_RANK_BYTES, sent to the executors, which then need no tokenizer folder."""
    return spark.sparkContext.broadcast(read_ranks(folder, name))


def encode_texts(
    df: DataFrame,
    key: str,
    text: str,
    folder: str = TOKENIZER_FOLDER,
    tokenizer: str = TOKENIZER,
    offsets: bool = False,
) -> DataFrame:
    """``key`` and ``ids`` of every row; with ``offsets`` also ``byte_starts``, the UTF-8 offset at which each id begins.

    Null and empty texts give an empty list, also when a key repeats or is null: one row out for each row in. Texts that
    name special tokens are ordinary text. Other columns, whatever their names, are not read. An empty table gives an
    empty table. A narrow plan without a shuffle; the only broadcast is the rank file.
    """
    shared = _rank_broadcast(df.sparkSession, folder, tokenizer)
    kind = df.select(F.col(key)).schema[0].dataType.simpleString()
    schema = f"`{key}` {kind}, ids array<int>" + (", byte_starts array<int>" if offsets else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(shared.value)
        for batch in batches:
            flat, counts, widths = bpe.encode(batch.column(1).to_pylist())
            bounds = np.concatenate(([0], np.cumsum(counts)))
            lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))]
            if offsets:
                total = np.cumsum(widths) - widths
                base = np.repeat(np.append(total, 0)[bounds[:-1]] if len(total) else bounds[:-1] * 0, counts)
                lists.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(total - base, pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=[key, "ids", "byte_starts"][: 1 + len(lists)])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def count_tokens(
    df: DataFrame, keep: list[str], text: str, folder: str = TOKENIZER_FOLDER, tokenizer: str = TOKENIZER
) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` of every row; null and empty texts have 0."""
    shared = _rank_broadcast(df.sparkSession, folder, tokenizer)
    chosen = df.select(*[F.col(c) for c in keep], F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema[:-1]) + ", n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(shared.value)
        for batch in batches:
            counts = bpe.encode(batch.column(len(keep)).to_pylist())[1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*keep, "n_tokens"]
            )

    return chosen.mapInArrow(run, schema)


def p7_ids(spark: SparkSession, data_dir: str) -> DataFrame:
    """Ids of every document."""
    return encode_texts(read_table(spark, data_dir, "documents"), "doc_id", "text")


QUERIES = {"p7_ids": p7_ids}
