"""Problem 6: sentences of bilingual documents paired where one renders the other.

The documents are first aligned by sentence length alone. One-to-one pairs whose lengths fit train word-translation
counts by expectation-maximisation: the expected counts of a round are summed on the map side, added up by one shuffle,
and sent back as a hashed table of fixed size. Then every document is aligned again by dynamic programming over lexical
scores in both directions, with merged, divided, added and omitted sentences, and what the monotone path leaves over is
matched out of order where the scores are clear.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireloom.llm.lookalikes import _tables as lookalike_tables
from quireloom.plans.staging import stage
from quireloom.sources import read_table

#: Slots of the hashed tables of pair counts and word counts: 16 MB and 1 MB are sent to the workers, whatever the corpus.
PAIR_BITS, WORD_BITS = 22, 17
ROUNDS = 4
#: Standard deviations by which the lengths of a training pair may differ from what is expected.
FITTING = 0.8
#: Share of a word's probability that is left to chance, and the bounds of what one word can say.
CHANCE = 0.1
NUMBER_MATCHES, NUMBER_DIFFERS = 3.0, -2.0
#: Least score of a pair, and its least share of the score that is usual for the document's sentences; what a pair out of
#: order needs more; the share that a left-over part of a pair needs; what a pair may score below its sentences' best.
LEAST, SHARE, MOVED, PART, NEARLY = 0.35, 0.4, 0.2, 0.25, 0.1
#: Sentences that may be joined or divided.
MOST_JOINED = 3
#: A document is aligned by words in windows of so many source sentences, each giving the pairs of its middle half; the
#: target side of a window follows the length alignment, with a margin. Most documents are one window.
WINDOW, MARGIN = 200, 60
#: Steps of the length alignment, in sentences of both sides, and their prices; the variance of a character's rendering.
MOVES, SPREAD = ((1, 1, 0.0), (1, 0, 2.2), (0, 1, 2.2), (2, 1, 1.6), (1, 2, 1.6)), 0.12
#: Sentences of both sides up to which a document is aligned by length together with others, and of all of them together.
SHORT, TOGETHER = 200, 20_000
#: Places from the straight line between the ends within which the length alignment of a document moves.
BAND = 400

_SOURCE_END = re.compile(r"(?<=[.!?])\s+")
_TARGET_SENTENCE = re.compile(r"[^。！？]*[。！？]+[）」』”’》〉】］)\]\"']*|[^。！？]+")
_NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_SALT = np.uint64(0x9E3779B97F4A7C15)


def source_sentences(text: str) -> list[str]:
    """Sentences that end in . ! or ? before white space or the end of the text; a rest without an end is one too."""
    return [s for s in _SOURCE_END.split(text.strip()) if s.strip()]


def target_sentences(text: str) -> list[str]:
    """Sentences that end in 。！ or ？ and closing signs behind; a rest without an end is one too."""
    return [s for s in _TARGET_SENTENCE.findall(text) if s.strip()]


def _plain(text: str) -> str:
    points = lookalike_tables()[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    return points[points > 0].tobytes().decode("utf-32-le", "surrogatepass")


def _is_ideograph(c: str) -> bool:
    return "㐀" <= c <= "鿿" or "𠀀" <= c


class _Words:
    """Numbers for words, by a stable hash."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def number(self, word: str) -> int:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 200_000:
                self.known.clear()
            found = self.known[word] = zlib.crc32(word.encode()) | 1 << 33
        return found

    def of(self, sentence: str) -> tuple[list[int], set[str]]:
        """Words of a sentence, ideographs one by one, and its numerals."""
        found: set[int] = set()
        for word in _WORD.findall(sentence.lower()):
            if _is_ideograph(word[0]) or _is_ideograph(word[-1]):
                found.update(ord(c) for c in word if _is_ideograph(c))
                word = "".join(c for c in word if not _is_ideograph(c))
            if word:
                found.add(self.number(word))
        return sorted(found), set(_NUMBER.findall(sentence))


def _pair_slot(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = source.astype(np.uint64) * _SALT + target.astype(np.uint64)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def _word_slot(words: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (words.astype(np.uint64) + np.uint64(1)) * _SALT
    return (x >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def align_batch(pairs: list[tuple[np.ndarray, np.ndarray]], ratio: float) -> list[list[tuple[int, int, float]]]:
    """align_lengths of many short documents, the cells of one anti-diagonal of all of them at once."""
    found: list[list[tuple[int, int, float]]] = [[] for _ in pairs]
    order = sorted(range(len(pairs)), key=lambda i: len(pairs[i][0]) + len(pairs[i][1]))
    while order:
        mine = order[: max(1, TOGETHER // (1 + len(pairs[order[-1]][0]) + len(pairs[order[-1]][1])))]
        order = order[len(mine) :]
        for i, beads in zip(mine, _align_group([pairs[i] for i in mine], ratio), strict=True):
            found[i] = beads
    return found


def _align_group(pairs: list[tuple[np.ndarray, np.ndarray]], ratio: float) -> list[list[tuple[int, int, float]]]:
    n, m = (np.array([len(p[side]) for p in pairs]) for side in (0, 1))
    src, tgt = np.zeros((len(pairs), n.max() + 1)), np.zeros((len(pairs), m.max() + 1))
    for row, (a, b) in enumerate(pairs):
        src[row, 1 : len(a) + 1], tgt[row, 1 : len(b) + 1] = np.cumsum(a), np.cumsum(b)
    i = np.arange(n.max() + 1)
    best: list[np.ndarray] = []
    back: list[np.ndarray] = []
    for d in range(int((n + m).max()) + 1):
        j = d - i
        at = np.clip(j, 0, m.max())
        inside = (i <= n[:, None]) & (j >= 0) & (j <= m[:, None])
        cost, move = np.full(inside.shape, np.inf), np.full(inside.shape, -1, np.int8)
        if d == 0:
            cost[:, 0] = 0.0
        for number, (di, dj, price) in enumerate(MOVES):
            if di + dj > d:
                continue
            value = np.full(inside.shape, np.inf)
            value[:, di:] = best[d - di - dj][:, : len(i) - di] + price
            if di and dj:
                expected = (src[:, di:] - src[:, : len(i) - di]) * ratio
                real = tgt[:, at[di:]] - tgt[:, np.clip(j[di:] - dj, 0, m.max())]
                with np.errstate(invalid="ignore", divide="ignore"):
                    value[:, di:] += np.abs(real - expected) / np.sqrt(SPREAD * (expected + real + 2) * 2)
            better = inside & (value < cost) & (j >= dj)
            cost, move = np.where(better, value, cost), np.where(better, np.int8(number), move)
        best.append(cost)
        back.append(move)
        if d >= 3:
            best[d - 3] = best[d - 3][:0]
    found = []
    for row, (x, y) in enumerate(zip(n.tolist(), m.tolist(), strict=True)):
        beads = []
        while x or y:
            di, dj, _ = MOVES[back[x + y][row, x]]
            x, y = x - di, y - dj
            if di == dj == 1:
                expected, real = (src[row, x + 1] - src[row, x]) * ratio, tgt[row, y + 1] - tgt[row, y]
                beads.append((x, y, float(abs(real - expected) / np.sqrt(SPREAD * (expected + real + 2) * 2))))
        found.append(beads)
    return found


def align_lengths(source: np.ndarray, target: np.ndarray, ratio: float) -> list[tuple[int, int, float]]:
    """One-to-one beads of the cheapest alignment by length, with the deviation of their lengths.

    A sentence left out costs a fixed amount; two sentences may stand against one.
    """
    n, m = len(source), len(target)
    src, tgt = np.concatenate(([0.0], np.cumsum(source))), np.concatenate(([0.0], np.cumsum(target)))

    # Cells on one anti-diagonal depend on the three before it only, so each is worked out at once.
    best: list[tuple[int, np.ndarray]] = []
    back: list[tuple[int, np.ndarray, np.ndarray]] = []
    for d in range(n + m + 1):
        on_line = d * n / max(1, n + m)
        low = max(0, d - m, int(on_line) - BAND)
        i = np.arange(low, min(n, d, int(on_line) + BAND) + 1)
        j = d - i
        cost, move, bend = np.full(len(i), np.inf), np.full(len(i), -1, np.int8), np.zeros(len(i))
        if d == 0:
            cost[0] = 0.0
        for number, (di, dj, price) in enumerate(MOVES):
            if di + dj > d:
                continue
            first, before = best[d - di - dj]
            ok = (i >= di) & (j >= dj) & (i - di >= first) & (i - di < first + len(before))
            if not ok.any():
                continue
            x, y = i[ok], j[ok]
            z = np.zeros(len(x))
            if di and dj:
                expected, real = (src[x] - src[x - di]) * ratio, tgt[y] - tgt[y - dj]
                z = np.abs(real - expected) / np.sqrt(SPREAD * (expected + real + 2) * 2)
            value = np.full(len(i), np.inf)
            value[ok] = before[x - di - first] + price + z
            better = value < cost
            deviation = np.zeros(len(i))
            deviation[ok] = z
            cost, move, bend = np.where(better, value, cost), np.where(better, number, move), np.where(better, deviation, bend)
        best.append((low, cost))
        back.append((low, move, bend))
        if d >= 3:
            best[d - 3] = (0, np.zeros(0))
    found, i, j = [], n, m
    while i or j:
        first, move, bend = back[i + j]
        di, dj, _ = MOVES[move[i - first]]
        z = float(bend[i - first])
        i, j = i - di, j - dj
        if di == dj == 1:
            found.append((i, j, z))
    return found


#: Steps of a path through scores, in the order in which the first of equal ones is taken.
STEPS = ((1, 0), (0, 1), (1, 1), *((x, y) for k in range(2, MOST_JOINED + 1) for x, y in ((1, k), (k, 1))))
#: Cells for each sentence of both sides from which on anti-diagonals are faster than cells; the paths are the same.
AT_ONCE = 30


def _path_by_cells(score: np.ndarray) -> list[tuple[int, int]]:
    """Pairs on the best monotone path, cell by cell."""
    n, m = score.shape
    rows = np.concatenate((np.zeros((n, 1)), np.cumsum(score, 1)), 1).tolist()
    cols = np.concatenate((np.zeros((1, m)), np.cumsum(score, 0)), 0).tolist()
    cell = score.tolist()
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    back = [[(0, 0)] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if not i and not j:
                continue
            top, move = (best[i - 1][j], (1, 0)) if i else (-1.0, (0, 1))
            if j and best[i][j - 1] > top:
                top, move = best[i][j - 1], (0, 1)
            if i and j:
                value = best[i - 1][j - 1] + cell[i - 1][j - 1]
                if value > top:
                    top, move = value, (1, 1)
                for k in range(2, MOST_JOINED + 1):
                    if k <= j and min(cell[i - 1][j - k : j]) > 0:
                        value = best[i - 1][j - k] + rows[i - 1][j] - rows[i - 1][j - k]
                        if value > top:
                            top, move = value, (1, k)
                    if k <= i and min(cell[x][j - 1] for x in range(i - k, i)) > 0:
                        value = best[i - k][j - 1] + cols[i][j - 1] - cols[i - k][j - 1]
                        if value > top:
                            top, move = value, (k, 1)
            best[i][j], back[i][j] = top, move
    found, i, j = [], n, m
    while i or j:
        di, dj = back[i][j]
        if di and dj:
            found += [(x, y) for x in range(i - di, i) for y in range(j - dj, j)]
        i, j = i - di, j - dj
    return found


def _path_at_once(score: np.ndarray) -> list[tuple[int, int]]:
    """The same path, all cells of an anti-diagonal at once."""
    n, m = score.shape
    rows = np.concatenate((np.zeros((n, 1)), np.cumsum(score, 1)), 1)
    cols = np.concatenate((np.zeros((1, m)), np.cumsum(score, 0)), 0)
    # Runs of positive scores that end in a cell, along its row and its column.
    across, down = np.zeros((2, n + 1, m + 1), np.int32)
    for j in range(1, m + 1):
        across[1:, j] = np.where(score[:, j - 1] > 0, across[1:, j - 1] + 1, 0)
    for i in range(1, n + 1):
        down[i, 1:] = np.where(score[i - 1] > 0, down[i - 1, 1:] + 1, 0)
    best, back = np.zeros((n + 1, m + 1)), np.zeros((n + 1, m + 1), np.int8)
    for d in range(1, n + m + 1):
        i = np.arange(max(0, d - m), min(n, d) + 1)
        j = d - i
        top, move = np.where(i > 0, best[i - 1, j], -1.0), np.where(i > 0, 0, 1)
        for number, (di, dj) in enumerate(STEPS[1:], 1):
            ok = (i >= di) & (j >= dj)
            if di > 1:
                ok &= down[i, j] >= di
            elif dj > 1:
                ok &= across[i, j] >= dj
            if not ok.any():
                continue
            x, y = i[ok], j[ok]
            value = best[x - di, y - dj]
            if dj > 1:
                value = value + rows[x - 1, y] - rows[x - 1, y - dj]
            elif di > 1:
                value = value + cols[x, y - 1] - cols[x - di, y - 1]
            elif di:
                value = value + score[x - 1, y - 1]
            better = np.flatnonzero(ok)[value > top[ok]]
            top[better] = value[value > top[ok]]
            move[better] = number
        best[i, j], back[i, j] = top, move
    found, i, j = [], n, m
    while i or j:
        di, dj = STEPS[back[i, j]]
        if di and dj:
            found += [(x, y) for x in range(i - di, i) for y in range(j - dj, j)]
        i, j = i - di, j - dj
    return found


def align_scores(score: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of the best monotone path through a matrix of scores, and clear pairs out of order.

    The score at which two sentences belong together follows what is usual in the document, the median of the best scores
    of its source sentences; it depends on how well the words are known. A path takes a sentence of either side with up to
    MOST_JOINED of the other, or leaves it out at no cost.
    """
    n, m = score.shape
    given = score.tolist()
    usual = float(np.median(score.max(1)))
    score = score - max(LEAST, SHARE * usual)
    # A pair must be the best or nearly so for one of its sides; else a moved sentence joins whatever its place holds.
    best_of = np.minimum(score.max(1, keepdims=True), score.max(0, keepdims=True))
    score = np.where(score >= best_of - NEARLY, score, -1.0)
    found = _path_at_once(score) if n * m > AT_ONCE * (n + m) else _path_by_cells(score)
    cell = score.tolist()
    taken_i, taken_j = {i for i, _ in found}, {j for _, j in found}
    rest = sorted(
        ((cell[i][j], i, j) for i in range(n) for j in range(m) if i not in taken_i and j not in taken_j and cell[i][j] > MOVED),
        key=lambda x: (-x[0], x[1], x[2]),
    )
    for _, i, j in rest:
        if i not in taken_i and j not in taken_j:
            found.append((i, j))
            taken_i.add(i)
            taken_j.add(j)
    # What is left over beside a paired sentence and says a little of the same is a part of that pair.
    pairs, part = set(found), max(LEAST, PART * usual)
    for j in set(range(m)) - taken_j:
        i = max(range(n), key=lambda x: given[x][j])
        if given[i][j] > part and ((i, j - 1) in pairs or (i, j + 1) in pairs):
            found.append((i, j))
    for i in set(range(n)) - taken_i:
        j = max(range(m), key=lambda x: given[i][x])
        if given[i][j] > part and ((i - 1, j) in pairs or (i + 1, j) in pairs):
            found.append((i, j))
    return sorted(found)


def _training_pairs(documents: DataFrame, ratio: float) -> DataFrame:
    """Words of the one-to-one pairs that fit by length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            left, right = [], []
            sides = [
                (source_sentences(source), target_sentences(_plain(target)))
                for source, target in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            ]
            lengths = [tuple(np.fromiter(map(len, side), float, len(side)) for side in pair) for pair in sides]
            short = [i for i, (a, b) in enumerate(lengths) if len(a) + len(b) <= SHORT]
            aligned = dict(zip(short, align_batch([lengths[i] for i in short], ratio), strict=True))
            for at, (ours, theirs) in enumerate(sides):
                beads = aligned[at] if at in aligned else align_lengths(*lengths[at], ratio)
                for i, j, z in beads:
                    if z <= FITTING:
                        e, f = words.of(ours[i])[0], words.of(theirs[j])[0]
                        if e and f:
                            left.append(e)
                            right.append(f)
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(left, kind), pa.array(right, kind)], names=["source", "target"])

    return documents.mapInArrow(run, "source array<bigint>, target array<bigint>")


def _crossed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every source word with every target word of each pair, and the running number of (pair, target word)."""
    e, f = batch.column(0), batch.column(1)
    ne, nf = np.diff(e.offsets.to_numpy()), np.diff(f.offsets.to_numpy())
    source = e.flatten().to_numpy(zero_copy_only=False)
    target = f.flatten().to_numpy(zero_copy_only=False)
    size = ne * nf
    start = np.cumsum(size) - size
    inside = np.arange(size.sum()) - np.repeat(start, size)
    wide = np.repeat(ne, size)
    at_e = np.repeat(np.cumsum(ne) - ne, size) + inside % wide
    at_f = np.repeat(np.cumsum(nf) - nf, size) + inside // wide
    return source[at_e], target[at_f], at_f


def _expected_counts(pairs: DataFrame, shared) -> DataFrame:
    """Expected counts by slot: word pairs (kind 0), source words (1), target words (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value if shared else None
        sums = [np.zeros(1 << PAIR_BITS), np.zeros(1 << WORD_BITS), np.zeros(1 << WORD_BITS)]
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                source, target, owner = _crossed(whole.slice(at, 2000))
                if not len(source):
                    continue
                slot, e_slot = _pair_slot(source, target), _word_slot(source)
                weight = table[0][slot] / np.maximum(table[1][e_slot], 1e-9) if table else np.ones(len(slot))
                weight = weight / np.maximum(np.bincount(owner, weight), 1e-12)[owner]
                sums[0] += np.bincount(slot, weight, 1 << PAIR_BITS)
                sums[1] += np.bincount(e_slot, weight, 1 << WORD_BITS)
                sums[2] += np.bincount(_word_slot(target), weight, 1 << WORD_BITS)
        for kind, held in enumerate(sums):
            slot = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(slot), kind, np.int32)), pa.array(slot.astype(np.int32)), pa.array(held[slot])],
                names=["kind", "slot", "mass"],
            )

    return pairs.mapInArrow(run, "kind int, slot int, mass double").groupBy("kind", "slot").agg(F.sum("mass").alias("mass"))


def train_words(pairs: DataFrame, rounds: int = ROUNDS):
    """Hashed counts of word pairs, source words and target words after some rounds, as arrays of fixed size."""
    context = pairs.sparkSession.sparkContext
    shared, tables = None, None
    for _ in range(rounds):
        found = _expected_counts(pairs, shared).toArrow()
        kind, slot, mass = (found.column(c).to_numpy() for c in ("kind", "slot", "mass"))
        tables = []
        for k, bits in enumerate((PAIR_BITS, WORD_BITS, WORD_BITS)):
            table = np.zeros(1 << bits, np.float32)
            table[slot[kind == k]] = mass[kind == k]
            tables.append(table)
        if shared:
            shared.unpersist()
        shared = context.broadcast(tables)
    return shared, tables


def score_matrix(ours: list[tuple[list[int], set[str]]], theirs: list[tuple[list[int], set[str]]], tables) -> np.ndarray:
    """How well each pair of sentences explains each other, the better of the two directions."""
    pair, e_count, f_count = tables
    total = max(float(e_count.sum()), 1.0)
    n, m = len(ours), len(theirs)
    e = np.array([w for words, _ in ours for w in (words or [0])], np.int64)
    f = np.array([w for words, _ in theirs for w in (words or [0])], np.int64)
    ne = np.array([max(1, len(w)) for w, _ in ours])
    nf = np.array([max(1, len(w)) for w, _ in theirs])
    at_e, at_f = np.cumsum(ne) - ne, np.cumsum(nf) - nf
    mass = pair[_pair_slot(e[:, None], f[None, :])]
    ce, cf = np.maximum(e_count[_word_slot(e)], 0.5), np.maximum(f_count[_word_slot(f)], 0.5)
    forth = np.add.reduceat(np.minimum(mass / ce[:, None], 1.0), at_e, 0) / ne[:, None]
    forth = np.log((1 - CHANCE) * forth * total / cf + CHANCE)
    back = np.add.reduceat(np.minimum(mass / cf, 1.0), at_f, 1) / nf
    back = np.log((1 - CHANCE) * back * total / ce[:, None] + CHANCE)
    forward = np.add.reduceat(np.clip(forth, -2.5, 4.0), at_f, 1)
    backward = np.add.reduceat(np.clip(back, -2.5, 4.0), at_e, 0)
    place = {x: i for i, x in enumerate(sorted(set().union(*(a for _, a in ours), *(b for _, b in theirs))))}
    left, right = np.zeros((n, len(place))), np.zeros((m, len(place)))
    for held, side in ((left, ours), (right, theirs)):
        for i, (_, numerals) in enumerate(side):
            held[i, [place[x] for x in numerals]] = 1
    same, na, nb = left @ right.T, left.sum(1)[:, None], right.sum(1)
    x = (forward + same * NUMBER_MATCHES + (nb - same) * NUMBER_DIFFERS) / (nf + nb)
    y = (backward + same * NUMBER_MATCHES + (na - same) * NUMBER_DIFFERS) / (ne[:, None] + na)
    return np.maximum(x, y)


def align_document(ours: list, theirs: list, tables, lengths: tuple[np.ndarray, np.ndarray, float]) -> list[tuple[int, int, float]]:
    """Pairs of a document's sentences with their scores, window by window. lengths: as align_lengths takes them."""
    n, m = len(ours), len(theirs)
    if n <= WINDOW and m <= WINDOW + 2 * MARGIN:
        scores = score_matrix(ours, theirs, tables)
        return [(i, j, float(scores[i, j])) for i, j in align_scores(scores)]
    beads = np.array([(0, 0), *((i, j) for i, j, _ in reversed(align_lengths(*lengths))), (n, m)])
    found, half = [], WINDOW // 2
    for core in range(0, n, half):
        low, high = max(0, core - half // 2), min(n, core + half + half // 2)
        start, stop = np.interp([low, high], beads[:, 0], beads[:, 1])
        first, last = max(0, int(start) - MARGIN), min(m, int(stop) + MARGIN + 1)
        if first >= last:
            continue
        scores = score_matrix(ours[low:high], theirs[first:last], tables)
        found += [
            (i + low, j + first, float(scores[i, j])) for i, j in align_scores(scores) if core <= i + low < core + half
        ]
    return found


def align_sentences(documents: DataFrame, key: str, source: str, target: str) -> DataFrame:
    """``key``, ``source_pos``, ``target_pos`` and ``score`` of each pair of sentences of which one renders the other.

    Sentences of a long document that moved farther than the margin of a window, or than BAND, are not paired.

    key: a unique number. Positions count from 0. A document with a null or blank side has no pairs. Sentences left out
    or added have none; joined or divided ones have several. Repeated documents are aligned alike. Other columns are not
    read; empty tables give no row.
    """
    chosen = stage(
        documents.select(F.col(key).cast("bigint").alias("key"), F.col(source).alias("source"), F.col(target).alias("target"))
        .where("length(trim(source)) > 0 AND length(trim(target)) > 0"),
        "documents",
    )
    sums = chosen.agg(F.sum(F.length("source")).alias("s"), F.sum(F.length("target")).alias("t")).first()
    ratio = (sums["t"] or 0) / (sums["s"] or 1)
    pairs = stage(_training_pairs(chosen, ratio), "training")
    shared, _ = train_words(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            rows = []
            for k, s, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                left, right = source_sentences(s), [_plain(x) for x in target_sentences(t)]
                if left and right:
                    lengths = tuple(np.fromiter(map(len, side), float, len(side)) for side in (left, right))
                    pairs = align_document([words.of(x) for x in left], [words.of(x) for x in right], shared.value, (*lengths, ratio))
                    rows += [(k, *pair) for pair in pairs]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            types = [pa.int64(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, x) for c, x in zip(columns, types, strict=True)], names=["key", "source_pos", "target_pos", "score"]
            )

    return chosen.mapInArrow(run, "key bigint, source_pos int, target_pos int, score double").withColumnRenamed("key", key)


def bilingual(spark: SparkSession, data_dir: str, model: str = "tandem-parallel-1") -> DataFrame:
    """Translations of the bilingual editions with the source of their chunk; chunks delivered twice count once."""
    wanted = read_table(spark, data_dir, "translations").where(F.col("model") == model).select("seq", "chunk_id", "translated_text")
    sources = read_table(spark, data_dir, "chunks").where("source_text IS NOT NULL").select("chunk_id", "source_text")
    joined = wanted.join(sources, "chunk_id")
    return joined.groupBy("seq").agg(F.min("source_text").alias("source_text"), F.min("translated_text").alias("translated_text"))


def p6_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """Pairs of sentences in the bilingual editions."""
    pairs = align_sentences(bilingual(spark, data_dir), "seq", "source_text", "translated_text")
    return pairs.select("seq", "source_pos", "target_pos")


def p6_scores(spark: SparkSession, data_dir: str) -> DataFrame:
    """Pairs with their scores."""
    return align_sentences(bilingual(spark, data_dir), "seq", "source_text", "translated_text")


QUERIES = {"p6_found": p6_found, "p6_scores": p6_scores}
