"""Problem 3: texts cut off by limits.

A text that does not end in a sentence's closing sign is suspect. Two kinds of evidence decide. First, near-copies are
sought by min-hash banding: a cut text is like the beginning of its copy, so texts are signed at growing lengths and a
suspect at the largest of them it fills, and a candidate must also hold one of the suspect's last phrases at that place
and go on behind it. A suspect whose alignment with a verified copy ends early was cut. Second, a suspect without such a
copy is scored by the terminality of its closing words: how often the corpus ends a sentence or line after the same
characters, over closings of several lengths, and after the same last characters in a line of the same shape (a
signature or a date ends differently from a sentence). The corpus is read once for both: a filter over the suspects'
hashes, sized by their number, lets only what they need leave the scan.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireloom.llm.lookalikes import _tables as lookalike_tables
from quireloom.llm.responses import is_empty, unwrap
from quireloom.plans.staging import stage
from quireloom.sources import read_table

#: Lengths of the closings whose terminality is counted, and the most tokens of a line shape.
ORDERS = (1, 2, 3, 4, 5, 8)
SHAPE_TOKENS = 8
#: Preference among the closings of ORDERS and the line's shape: the more specific, the higher; the higher score at a tie.
RANKS, SHAPE_RANK = (1, 2, 3, 4, 5, 6), 4
#: Occurrences of a closing, besides the suspect's own, that make it evidence; share of endings that makes it terminal.
SUPPORT, TERMINAL = 3, 0.5
#: The filter over the suspects' hashes has FILTER_SHARE bits for each, at most 2 ** FILTER_MOST (64 MB). Beyond, it lets
#: more rows through that the joins behind it drop; the result never depends on it.
FILTER_SHARE, FILTER_LEAST, FILTER_MOST = 32, 16, 29
#: Where the places of a hash in the filter begin.
PLACE_BITS = (0, 17, 35)
#: Characters of a shingle, bands and their rows, and the share of a suspect's shingles that a copy holds.
SHINGLE, BANDS, ROWS, SIMILARITY = 5, 6, 3, 0.8
#: Lengths at which beginnings are signed: the least, and the ratio of each to the one before.
LEAST_LENGTH, LENGTH_RATIO = 8, 1.25
#: Characters of a phrase near a suspect's end, how far from the end such phrases stand, and how much earlier or later
#: a changed copy may have them.
PHRASE, PHRASE_PLACES, SHIFT = 8, (0, 8), 10
#: Copies of a key that are compared at first, one from each of so many parts of them.
FIRST_PARTS, MORE_PARTS = 8, 8
#: Pairs of a suspect's key and a copy up to which all that are left are compared in one go.
PAIRS_AT_ONCE = 200_000
TAIL = 64
SLICE_CHARS = 500_000
#: Closings a task sums up before it sends them on.
HELD_CLOSINGS = 2_000_000

ENDS = "。！？!?.;；｡"
CLOSERS = "\"'”’」』)）]］】》〉"
ELLIPSES = "…⋯"
JOINERS = "·"  # between the parts of a foreign name
BROKEN = "�"
_END = 3  # stands between texts
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt * 0x632BE59BD9B4E019 % (1 << 64))).astype(np.uint64)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0x94D049BB133111EB)


@functools.cache
def _lengths() -> np.ndarray:
    grid = LEAST_LENGTH * LENGTH_RATIO ** np.arange(100)
    return np.unique(grid[grid < 2**31].astype(np.int64))


def _level(n: np.ndarray) -> np.ndarray:
    """Number of the largest length that ``n`` characters fill; -1 for none."""
    return np.searchsorted(_lengths(), n, "right") - 1


class _Filter:
    """A bit array in which every hash has three places."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(len(words) * 32 - 1)

    def _set(self, place: np.ndarray) -> np.ndarray:
        place = place & self.mask
        return (self.words[(place >> np.uint64(5)).astype(np.int64)] >> (place & np.uint64(31)).astype(np.uint32)) & 1 > 0

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each hash may be among those put in."""
        found = self._set(hashes)
        for bits in PLACE_BITS[1:]:
            at = np.flatnonzero(found)
            found[at] = self._set(hashes[at] >> np.uint64(bits))
        return found


@functools.cache
def _char_tables() -> tuple[np.ndarray, np.ndarray]:
    """Normal form of each character (0: left out), and its kind: 1 ideograph or kana, 2 letter, 3 digit, 4 blank,
    8 sentence end, 16 closer, 32 line break, 64 ellipsis."""
    plain = lookalike_tables()[0].copy()
    kind = np.zeros(0x110000, np.uint8)
    for cp in range(0x33FF):
        c = chr(cp)
        if c.isalpha():
            low = chr(plain[cp]).lower() if plain[cp] else ""
            plain[cp] = ord(low) if len(low) == 1 else plain[cp]
            kind[cp] = 2 if cp < 0x2E80 else 1
    kind[0x3400:0xA000] = 1
    kind[0xAC00:0xD7A4] = 1
    kind[0x20000:0x32000] = 1
    plain[[ord(c) for c in "0123456789"]] = ord("0")
    for cp in [*range(0x2010), *range(0xFF10, 0xFF1A)]:
        if chr(cp).isdigit():
            plain[cp], kind[cp] = ord("0"), 3
    kind[ord(" ")], kind[ord("\n")], kind[_END] = 4, 32, 32
    for c in ENDS:
        kind[plain[ord(c)]] = 8
    for c in CLOSERS:
        kind[plain[ord(c)]] = 16
    for c in ELLIPSES:
        kind[ord(c)] = 64
    for c in JOINERS:
        kind[plain[ord(c)]] = 1
    plain[_END] = _END
    return plain, kind


class _Corpus:
    """Normalised texts in one array, with an end mark behind each."""

    def __init__(self, texts: list[str]):
        plain, kinds = _char_tables()
        joined = chr(_END).join([t.replace(chr(_END), "") for t in texts]) + chr(_END)
        points = plain[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
        points = points[points > 0]
        kind = kinds[points]
        before = np.zeros(len(points), np.uint8)
        before[1:] = kind[:-1]
        repeated = ((kind == 3) & (before == 3)) | ((kind == 4) & ((before & 36) > 0))
        points, kind = points[~repeated], kind[~repeated]
        after = np.zeros(len(points), np.uint8)
        after[:-1] = kind[1:]
        drop = (kind == 4) & (after == 32)
        points, kind = points[~drop], kind[~drop]
        blank_lines = np.zeros(len(points), bool)
        blank_lines[1:] = (points[1:] == 10) & (points[:-1] == 10)
        self.points, self.kind = points[~blank_lines], kind[~blank_lines]
        self.ends = np.flatnonzero(self.points == _END)
        self.begins = np.concatenate(([0], self.ends[:-1] + 1))

    def grams(self) -> dict[int, np.ndarray]:
        """Hash of the characters up to and with each position, by number of characters."""
        c = self.points.astype(np.uint64) + np.uint64(17)
        rolled, power, out = c.copy(), np.uint64(1), {}
        for n in range(1, max(*ORDERS, SHINGLE) + 1):
            if n > 1:
                with np.errstate(over="ignore"):
                    power = power * _P
                    rolled[n - 1 :] += c[: max(0, len(c) - n + 1)] * power
            if n in ORDERS or n == SHINGLE:
                out[n] = _mix(rolled, n)
        return out

    def shapes(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the line's shape so far and the last two characters; whether the shape is short enough."""
        kind, points = self.kind, self.points
        solid = np.maximum.accumulate(np.where(kind == 4, 0, np.arange(len(points))))
        before = np.zeros(len(points), np.uint8)
        before[1:] = kind[solid[:-1]]
        word = (kind == 1) | (kind == 2) | (kind == 3)
        start = ((before != kind) | ~word) & (kind != 4)
        line = np.zeros(len(points), bool)
        line[0] = True
        line[1:] = kind[:-1] == 32
        number = np.cumsum(start)
        line_of = np.maximum.accumulate(np.where(line, np.arange(len(points)), 0))
        index = number - (number - start)[line_of]
        short = index <= SHAPE_TOKENS
        value = np.where(word, kind, points).astype(np.uint64) + np.uint64(1)
        powers = np.cumprod(np.full(SHAPE_TOKENS + 2, _P, np.uint64))
        share = np.where(start & short, value * powers[np.clip(index, 0, SHAPE_TOKENS + 1)], np.uint64(0))
        running = np.cumsum(share)
        shape = running - (running - share)[line_of]
        return _mix(shape * _P + pairs, 99), short

    def strings(self) -> list[str]:
        """The normalised texts."""
        one = self.points.tobytes().decode("utf-32-le", "surrogatepass")
        return [one[a:b] for a, b in zip(self.begins.tolist(), self.ends.tolist(), strict=True)]

    def signatures(self, shingles: np.ndarray, text: np.ndarray, level: np.ndarray) -> np.ndarray:
        """Band hashes of the beginning of each given text up to the length of each given level.

        One-permutation min-hashing: the least hashes of the stretches between two lengths, the least of all before them,
        and empty bins filled from the next that is not.
        """
        bins, lengths, nothing = BANDS * ROWS, _lengths(), np.iinfo(np.uint64).max
        used = np.unique(text)
        local = np.full(len(self.ends), -1, np.int64)
        local[used] = np.arange(len(used))
        top = np.zeros(len(used), np.int64)
        np.maximum.at(top, local[text], level)
        first = np.cumsum(top + 1) - (top + 1)
        owner = np.repeat(local, self.ends - self.begins + 1)
        place = np.arange(len(self.points)) - np.repeat(self.begins, self.ends - self.begins + 1)
        inside = np.flatnonzero((owner >= 0) & (place >= SHINGLE - 1) & (self.points != _END))
        stretch = np.searchsorted(lengths, place[inside] + 1)
        kept = stretch <= top[owner[inside]]
        inside, stretch = inside[kept], stretch[kept]
        values = shingles[inside]
        row = first[owner[inside]] + stretch
        least = np.full(int((top + 1).sum()) * bins, nothing, np.uint64)
        np.minimum.at(least, row * bins + (((values >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64), values)
        grid = least.reshape(-1, bins)
        for step in range(1, int(top.max(initial=0)) + 1):
            at = first[top >= step] + step
            grid[at] = np.minimum(grid[at], grid[at - 1])
        grid = grid[first[local[text]] + level]
        twice = np.concatenate((grid, grid), 1)
        following = np.where(twice != nothing, np.arange(2 * bins), 4 * bins)
        following = np.minimum.accumulate(following[:, ::-1], 1)[:, ::-1][:, :bins]
        gap = following - np.arange(bins)
        with np.errstate(over="ignore"):
            filled = np.take_along_axis(twice, np.minimum(following, 2 * bins - 1), 1) + gap.astype(np.uint64) * _P
            bands = np.zeros((len(grid), BANDS), np.uint64)
            for r in range(ROWS):
                bands = bands * _P + filled.reshape(-1, BANDS, ROWS)[:, :, r]
        return _mix(bands + np.arange(BANDS, dtype=np.uint64) + level.astype(np.uint64)[:, None] * np.uint64(64), 7)


def _keys(bands: np.ndarray, phrases: np.ndarray, back: int) -> np.ndarray:
    """Hashes of each band with the phrase that stands ``back`` characters before the end."""
    with np.errstate(over="ignore"):
        return _mix(bands * _P + phrases[:, None], 20 + back)


def _phrase_hashes(phrases: np.ndarray) -> np.ndarray:
    return _mix(phrases, 13)


def _placed_hashes(phrases: np.ndarray, level: np.ndarray, back: int) -> np.ndarray:
    """Hashes of phrases with the length their text fills and how far before its end they stand."""
    with np.errstate(over="ignore"):
        return _mix(phrases * _P + level.astype(np.uint64), 40 + back)


def _parts(rows: list[tuple]) -> Iterator[list[tuple]]:
    part, chars = [], 0
    for row in rows:
        part.append(row)
        chars += len(row[-1])
        if chars > SLICE_CHARS:
            yield part
            part, chars = [], 0
    if part:
        yield part


def stripped_ending(body: str) -> tuple[str, bool]:
    """A text without blanks and dots of omission behind it, and whether it had such dots."""
    body = body.rstrip().rstrip("​‌‍⁠﻿­‎‏").rstrip()
    bare = body.rstrip(ELLIPSES)
    if bare != body:
        return bare.rstrip(), True
    if body.endswith("..."):
        return body.rstrip(".").rstrip(), True
    return body, False


def ends_openly(body: str) -> bool:
    """Whether a text ends without a sentence's closing sign, quotes and brackets behind it aside."""
    bare, dots = stripped_ending(body)
    if dots:
        return True
    last = bare.rstrip(CLOSERS)
    return bool(bare) and not (last and last[-1] in ENDS)


#: For Spark's regular expressions: surely closed texts, which no worker needs to see as suspects.
_CLOSED = r"(?s)^.*[。！？!?][”’」』)）\]］】》\"']*\s*$|^.*[^.\s]\.[”’\"']*\s*$"


def find_suspects(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Suspects with their hashes: ``key``, ``body``, ``dots``, ``broken``, ``closings``, ``shape``, ``tail``, a hash of the
    last characters, ``phrases`` and, of these with the bands of the beginning, ``keys``."""
    chosen = texts.select(F.col(key).cast("bigint"), F.col(text)).where(
        F.col(text).isNotNull() & ~F.right(F.col(text), F.lit(TAIL)).rlike(_CLOSED)
    )
    schema = (
        f"`{key}` bigint, body string, dots boolean, broken boolean, closings array<bigint>, shape bigint, "
        "tail bigint, phrases array<bigint>, keys array<bigint>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                body = unwrap(t)
                if not is_empty(body) and ends_openly(body):
                    bare, dots = stripped_ending(body)
                    if bare:
                        rows.append((k, body, dots, bare))
            for part in _parts(rows):
                held = _Corpus([r[3] for r in part])
                grams = held.grams()
                shape, short = held.shapes(grams[2])
                last = np.maximum(held.ends - 1, held.begins)
                size = held.ends - held.begins
                closings = [
                    [int(grams[n][e].astype(np.int64)) if s >= n else None for n in ORDERS]
                    for e, s in zip(last, size, strict=True)
                ]
                level = _level(size)
                signed = np.flatnonzero(level >= 0)
                bands = held.signatures(grams[SHINGLE], signed, level[signed])
                phrases: list[list[int]] = [[] for _ in part]
                keys: list[list[int]] = [[] for _ in part]
                for back in PHRASE_PLACES:
                    fits = size[signed] >= PHRASE + back
                    found = grams[PHRASE][last[signed[fits]] - back]
                    joint = _keys(bands[fits], found, back).astype(np.int64).tolist()
                    both = np.stack([_phrase_hashes(found), _placed_hashes(found, level[signed[fits]], back)], 1)
                    for i, hs, ks in zip(signed[fits].tolist(), both.astype(np.int64).tolist(), joint, strict=True):
                        phrases[i] += hs
                        keys[i] += ks
                tail = [_hash_of(held, max(b, e - 24), e) for b, e in zip(held.begins, held.ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in part], pa.int64()),
                        pa.array([r[1] for r in part], pa.string()),
                        pa.array([r[2] for r in part], pa.bool_()),
                        pa.array([r[3].endswith(BROKEN) for r in part], pa.bool_()),
                        pa.array(closings, pa.list_(pa.int64())),
                        pa.array([int(v) if o else None for v, o in zip(shape[last].astype(np.int64), short[last], strict=True)], pa.int64()),
                        pa.array(tail, pa.int64()),
                        pa.array(phrases, pa.list_(pa.int64())),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    names=[key, "body", "dots", "broken", "closings", "shape", "tail", "phrases", "keys"],
                )

    return chosen.mapInArrow(run, schema)


def _hash_of(held: _Corpus, begin: int, end: int) -> int:
    return int.from_bytes(hashlib.blake2b(held.points[begin:end].tobytes(), digest_size=8).digest(), signed=True)


def _filter_of(suspects: DataFrame, copies: bool) -> np.ndarray:
    """Bit array over the hashes of all suspects, sized by their number; it comes back in words of 32 as one row each."""
    more = [F.col("phrases"), F.col("keys")] if copies else []
    hashes = suspects.select(F.explode(F.concat("closings", F.array("shape"), *more)).alias("h")).where("h IS NOT NULL")
    n = suspects.count() * (len(ORDERS) + 1 + (len(PHRASE_PLACES) * (2 + BANDS) if copies else 0))
    bits = min(max(FILTER_LEAST, (n * FILTER_SHARE).bit_length()), FILTER_MOST)
    places = hashes.select(F.explode(F.array(*[F.shiftrightunsigned("h", b) for b in PLACE_BITS])).alias("h")).select(
        F.col("h").bitwiseAND(F.lit((1 << bits) - 1)).alias("place")
    )
    words = places.groupBy(F.shiftright("place", 5).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(place & 31 AS INT))")).alias("bits")
    )
    table = np.zeros(1 << (bits - 5), np.uint32)
    found = words.toArrow()
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return table


def _tally(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different hashes in order and how often each occurs."""
    held = np.sort(hashes)
    first = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1]))) if len(held) else np.zeros(0, np.int64)
    return held[first], np.diff(np.concatenate((first, [len(held)])))


class _Sums:
    """Closings of a task with their counts, each hash once."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.held = 0

    def add(self, rows: np.ndarray) -> None:
        """rows: hash, total, closed, dotted."""
        self.parts.append(rows)
        self.held += rows.shape[1]

    def whole(self) -> np.ndarray:
        if not self.parts:
            return np.zeros((4, 0), np.int64)
        joined = np.concatenate(self.parts, 1)
        unique, place = np.unique(joined[0], return_inverse=True)
        sums = [np.bincount(place, joined[i], len(unique)).astype(np.int64) for i in (1, 2, 3)]
        self.parts = [np.stack([unique, *sums])]
        self.held = len(unique)
        return self.parts[0]


_GATHERED = "h bigint, total bigint, closed bigint, dotted bigint, id bigint, after int, whole bigint, body string"


def _gather(texts: DataFrame, key: str, text: str, table: np.ndarray, copies: bool) -> DataFrame:
    """What the suspects need of the corpus, in rows of three kinds.

    A closing: ``h``, ``total``, ``closed``, ``dotted``, summed up over the task. A text that holds a suspect's phrase
    behind a beginning with its band: ``h``, ``id``, ``after`` (characters behind the phrase) and ``whole``, a hash of the
    normalised text. Each such text once: ``id`` and ``body``. Bands and hashes of copies are those of the texts without
    wrappers and dots behind them, as suspects have them.
    """
    shared = texts.sparkSession.sparkContext.broadcast(table)
    chosen = texts.select(F.col(key).cast("bigint"), F.col(text)).where(F.col(text).isNotNull())

    def count(held: _Corpus, grams: dict[int, np.ndarray], wanted: _Filter) -> np.ndarray:
        kind, points = held.kind, held.points
        after, later = np.zeros((2, len(points)), np.uint8)
        after[:-1], later[:-2] = kind[1:], kind[2:]
        final = np.zeros(len(points), bool)
        final[:-1] = points[1:] == _END
        closed = ((after & 40) > 0) | ((after == 16) & ((later & 40) > 0))
        dotted = after == 64
        use = (points != _END) & ~final
        shape, short = held.shapes(grams[2])
        found = []
        for hashes, ok in [*((grams[n], use) for n in ORDERS), (shape, use & short)]:
            at = np.flatnonzero(ok)
            at = at[wanted.holds(hashes[at])]
            unique, total = _tally(hashes[at].astype(np.int64))
            rows = np.stack([unique, total, np.zeros_like(unique), np.zeros_like(unique)])
            for row, mask in ((2, closed), (3, dotted)):
                some, times = _tally(hashes[at[mask[at]]].astype(np.int64))
                rows[row, np.searchsorted(unique, some)] = times
            found.append(rows)
        return np.concatenate(found, 1)

    def candidates(held: _Corpus, grams: dict[int, np.ndarray], wanted: _Filter, chosen: np.ndarray) -> tuple[np.ndarray, ...]:
        """Keys the suspects have, the texts that have them, and the characters behind their phrases.

        Only where the text would go on in the same line behind the suspect's end.
        """
        size = held.ends - held.begins
        owner = np.repeat(np.arange(len(held.ends)), size + 1)
        through = np.arange(len(held.points)) - held.begins[owner] + 1
        behind = held.ends[owner] - 1 - np.arange(len(held.points))
        at = np.flatnonzero((through >= PHRASE) & (behind >= 2) & chosen[owner])
        at = at[wanted.holds(_phrase_hashes(grams[PHRASE][at]))]
        top = _level(size)
        places, levels, backs = [], [], []
        for back in PHRASE_PLACES:
            here = at[behind[at] >= back + 2]
            here = here[held.kind[here + back + 1] != 32]
            last = np.full(len(here), -1)
            for shift in (-SHIFT, 0, SHIFT):
                level = _level(through[here] + back + shift)
                new = np.flatnonzero((level > last) & (level <= top[owner[here]]))
                new = new[wanted.holds(_placed_hashes(grams[PHRASE][here[new]], level[new], back))]
                places.append(here[new])
                levels.append(level[new])
                backs.append(np.full(len(new), back))
                last = np.maximum(last, level)
        place, level, back = map(np.concatenate, (places, levels, backs))
        if not len(place):
            return np.zeros(0, np.uint64), place, place
        pair, whose = np.unique(owner[place] * 128 + level, return_inverse=True)
        bands = held.signatures(grams[SHINGLE], pair // 128, pair % 128)
        found = []
        for before_end in PHRASE_PLACES:
            mine = np.flatnonzero(back == before_end)
            keys = _keys(bands[whose[mine]], grams[PHRASE][place[mine]], before_end)
            row, band = np.nonzero(wanted.holds(keys.ravel()).reshape(keys.shape))
            at = place[mine[row]]
            found.append((keys[row, band], owner[at], behind[at]))
        return tuple(map(np.concatenate, zip(*found, strict=True)))

    def closings(sums: np.ndarray) -> pa.RecordBatch:
        n = sums.shape[1]
        empty = [pa.nulls(n, t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.string())]
        return pa.RecordBatch.from_arrays([*map(pa.array, sums), *empty], names=names)

    def copies_of(
        held: _Corpus, grams: dict[int, np.ndarray], wanted: _Filter, chosen: np.ndarray, ids: np.ndarray, bodies: list[str]
    ) -> Iterator[pa.RecordBatch]:
        keys, owner, after = candidates(held, grams, wanted, chosen)
        used = np.unique(owner)
        whole = np.zeros(len(ids), np.int64)
        for i in used.tolist():
            whole[i] = _hash_of(held, held.begins[i], held.ends[i])
        for n, columns in (
            (len(keys), {0: pa.array(keys.astype(np.int64)), 4: pa.array(ids[owner]), 5: pa.array(after.astype(np.int32)), 6: pa.array(whole[owner])}),
            (len(used), {4: pa.array(ids[used]), 7: pa.array([bodies[i] for i in used.tolist()], pa.string())}),
        ):
            yield pa.RecordBatch.from_arrays([columns.get(i, pa.nulls(n, t)) for i, t in enumerate(types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, sums = _Filter(shared.value), _Sums()
        for batch in batches:
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for part in _parts(rows):
                held = _Corpus([t for _, t in part])
                grams = held.grams()
                sums.add(count(held, grams, wanted))
                if sums.held > HELD_CLOSINGS and sums.whole().shape[1] > HELD_CLOSINGS // 2:
                    yield closings(sums.whole())
                    sums = _Sums()
                if copies:
                    bodies = [stripped_ending(unwrap(t))[0] for _, t in part]
                    ids = np.array([k if k is not None else 0 for k, _ in part], np.int64)
                    bare = np.array([b == t for b, (_, t) in zip(bodies, part, strict=True)])
                    yield from copies_of(held, grams, wanted, bare, ids, bodies)
                    if not bare.all():
                        others = [b for b, whole in zip(bodies, bare, strict=True) if not whole]
                        unwrapped = _Corpus(others)
                        every = np.ones(len(others), bool)
                        yield from copies_of(unwrapped, unwrapped.grams(), wanted, every, ids[~bare], others)
        yield closings(sums.whole())

    names = ["h", "total", "closed", "dotted", "id", "after", "whole", "body"]
    types = [*[pa.int64()] * 5, pa.int32(), pa.int64(), pa.string()]
    return chosen.mapInArrow(run, _GATHERED)


def _terminality(suspects: DataFrame, key: str, gathered: DataFrame) -> DataFrame:
    """``key``, ``score`` and ``support``: of the most specific closing with enough support."""
    ranks = F.array(*[F.lit(r) for r in RANKS])
    ranked = F.concat(
        F.transform("closings", lambda h, i: F.struct(ranks[i].alias("rank"), h.alias("h"))),
        F.array(F.struct(F.lit(SHAPE_RANK).alias("rank"), F.col("shape").alias("h"))),
    )
    asked = suspects.select(key, "dots", "tail", F.inline(ranked)).where("h IS NOT NULL")
    counts = gathered.where("id IS NULL").groupBy("h").agg(
        F.sum("total").alias("total"), F.sum("closed").alias("closed"), F.sum("dotted").alias("dotted")
    )
    # Ends of texts count once for each different ending, so that a cut text delivered again is no evidence for itself.
    ends = asked.select("h", "dots", "tail").distinct().groupBy("h", "dots").agg(F.count("*").alias("ends"))
    scored = (
        asked.join(ends, ["h", "dots"])
        .join(counts, "h", "left")
        .select(
            key,
            "rank",
            (F.coalesce("total", F.lit(0)) + F.col("ends") - 1).alias("support"),
            (F.coalesce(F.when(F.col("dots"), F.col("dotted")).otherwise(F.col("closed")), F.lit(0)) + F.col("ends") - 1).alias("closed"),
        )
        .where(F.col("support") >= SUPPORT)
    )
    score = F.col("closed") / F.col("support")
    best = F.max(F.struct("rank", score.alias("score"), "support"))
    return scored.groupBy(key).agg(best.alias("best")).select(key, "best.score", "best.support")


def shingles_of(text: str) -> set[str]:
    return {text[i : i + SHINGLE] for i in range(len(text) - SHINGLE + 1)}


def ends_early(plain_cut: str, plain_whole: str) -> tuple[float, bool]:
    """Share of the first normalised text's shingles that the second has, and whether it ends within a line of it.

    The last TAIL characters of the first are aligned anywhere in the second at the least edit cost.
    """
    a, b = shingles_of(plain_cut), shingles_of(plain_whole)
    similarity = len(a & b) / max(1, len(a))
    if similarity < SIMILARITY:
        return similarity, False
    tail = plain_cut[-TAIL:]
    text = np.array([ord(c) for c in plain_whole], np.int64)
    cost = np.zeros(len(text) + 1, np.int64)
    steps = np.arange(len(text) + 1)
    for i, c in enumerate(tail, 1):
        new = np.empty_like(cost)
        new[0] = i
        new[1:] = np.minimum(cost[:-1] + (text != ord(c)), cost[1:] + 1)
        cost = np.minimum.accumulate(new - steps) + steps
    best = len(cost) - 1 - int(np.argmin(cost[::-1]))
    if cost[best] > len(tail) // 4:
        return similarity, False
    rest = plain_whole[best:]
    return similarity, not rest.lstrip(" ").startswith("\n") and sum(ch.isalnum() for ch in rest) >= 2


def _judged(pairs: DataFrame, suspects: DataFrame, copies: DataFrame, key: str) -> DataFrame:
    """Pairs of suspect and copy with ``early``: the copy is one and goes on where the suspect ends."""
    held = pairs.join(suspects.select(F.col(key).alias("suspect"), F.col("body").alias("cut")), "suspect").join(copies, "id")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            cuts = _Corpus([stripped_ending(r["cut"])[0] for r in rows]).strings()
            wholes = _Corpus([r["body"] for r in rows]).strings()
            early = [ends_early(*both)[1] for both in zip(cuts, wholes, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("suspect"), pa.array(early, pa.bool_())], names=["suspect", "early"])

    return held.select("suspect", "cut", "body").mapInArrow(judge, "suspect bigint, early boolean")


def _cut_copies(suspects: DataFrame, key: str, gathered: DataFrame) -> DataFrame:
    """Suspects that end before a verified near-copy does.

    Texts that are the same in normal form stand for each other. The copies of a key, ranked by what follows the phrase,
    are divided into 8, 64, 512 ... parts; each suspect still open is compared with the first of each part, until it ends
    early in one or so few are left that all can be. So a key that much of the corpus shares costs a few comparisons for each cut suspect,
    no suspect is joined with more copies of a key at a time than there are parts, and no copy is passed over.
    """
    copies = stage(gathered.where("body IS NOT NULL").select("id", "body"), "copies")
    pool = gathered.where("whole IS NOT NULL").groupBy("h", "whole").agg(
        F.min_by("id", F.struct(-F.col("after"), F.col("id"))).alias("id"), F.max("after").alias("after")
    )
    pool = stage(pool, "pool")
    asked = stage(suspects.select(F.col(key).alias("suspect"), F.explode("keys").alias("h")).distinct(), "asked")
    parts, done, met = FIRST_PARTS, None, None
    while True:
        firsts = pool
        if parts:
            part = F.pmod(F.xxhash64("whole"), F.lit(parts))
            firsts = pool.groupBy("h", part.alias("part")).agg(F.max_by("id", F.struct("after", "id")).alias("id"))
            firsts = stage(firsts.select("h", "id"), "firsts")
        new = firsts if met is None else firsts.join(met, ["h", "id"], "left_anti")
        pairs = asked.join(new, "h").where("id <> suspect").select("suspect", "id").distinct()
        found = stage(_judged(pairs, suspects, copies, key).where("early").select("suspect").distinct(), "early")
        done = found if done is None else done.unionByName(found)
        if not parts:
            return done.distinct().withColumn("early", F.lit(True))
        # Only keys with copies that were not met yet and with open suspects go on; few pairs go on all at once.
        rest = pool.groupBy("h").agg(F.count("*").alias("n")).join(firsts.groupBy("h").agg(F.count("*").alias("met")), "h").where("n > met")
        asked = stage(asked.join(found, "suspect", "left_anti").join(rest.select("h", "n"), "h"), "asked")
        left = asked.agg(F.sum("n")).first()[0]
        if not left:
            return done.distinct().withColumn("early", F.lit(True))
        asked = asked.drop("n")
        pool = stage(pool.join(asked.select("h").distinct(), "h", "left_semi"), "pool")
        met, parts = firsts, parts * MORE_PARTS if left > PAIRS_AT_ONCE else 0


def detect_cut(texts: DataFrame, key: str, text: str, copies: bool = True) -> DataFrame:
    """Suspect texts with a verdict: ``key``, ``cut``, ``evidence``, ``score`` (terminality), ``support``.

    key: a unique number. Texts that are null, blank, content-free or end in a closing sign are no suspects and give no
    row. evidence: 'character' (the last character is broken), 'copy' (the alignment with a near-copy ends early),
    'ending' (terminality below TERMINAL), 'none' (not cut; also where nothing in the corpus bears on the ending, as in
    a table of few rows). Repeated texts are judged alike. Empty tables give no row; other columns are not read.
    """
    suspects = stage(find_suspects(texts, key, text), "suspects")
    gathered = stage(_gather(texts, key, text, _filter_of(suspects, copies), copies), "gathered")
    scores = _terminality(suspects, key, gathered)
    out = suspects.select(key, "broken").join(scores, key, "left")
    if copies:
        early = _cut_copies(suspects, key, gathered)
        out = out.join(early.withColumnRenamed("suspect", key), key, "left")
    else:
        out = out.withColumn("early", F.lit(None).cast("boolean"))
    evidence = (
        F.when(F.col("broken"), "character")
        .when(F.coalesce("early", F.lit(False)), "copy")
        .when(F.col("score") < TERMINAL, "ending")
        .otherwise("none")
    )
    return out.select(key, (evidence != "none").alias("cut"), evidence.alias("evidence"), "score", "support")


def p3_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """Translations that were cut."""
    return detect_cut(read_table(spark, data_dir, "translations"), "seq", "translated_text").where("cut").select("seq")


def p3_rates(spark: SparkSession, data_dir: str) -> DataFrame:
    """Rows, cut rows and their share for each provider and model; missing names are a group of their own."""
    texts = read_table(spark, data_dir, "translations")
    cut = detect_cut(texts, "seq", "translated_text").where("cut").select("seq", "cut")
    joined = texts.select("seq", "provider", "model").join(cut, "seq", "left")
    return joined.groupBy("provider", "model").agg(
        F.count("*").alias("n_rows"),
        F.count("cut").alias("n_cut"),
        (F.count("cut") / F.count("*")).alias("cut_share"),
    )


QUERIES = {"p3_found": p3_found, "p3_rates": p3_rates}
