"""Problem 5: texts that look the same brought to one form.

Words of alphabetic scripts are looked up in a trie of the corpus's own spellings by a weighted edit automaton: moving
along an edge costs nothing when the edge and the character read look alike, skipping an ignorable character costs
nothing, and everything else costs 1. At the bound 0 a word finds the spelling that looks like it, and the most frequent
such spelling is its canonical one. Words that the trie lacks are normalised by table. Ideographs, kana and signs are
words of one character, for which the trie has one level and becomes an array over code points. Equality of canonical
texts does not depend on which spellings the trie holds: all spellings of a class match the same entry or none.
"""

from __future__ import annotations

import functools
import hashlib
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireloom.plans.staging import stage
from quireloom.sources import read_table

# Characters of other scripts, signs and strokes that look like the character before the colon.
LOOKALIKES = """
a: а ɑ
b: Ꮟ ᑲ
c: с ϲ ᴄ ⲥ
d: ԁ ᑯ
e: е
g: ɡ
h: һ Ꮒ
i: і ι Ꭵ
j: ј ϳ
k: κ
o: о ο օ ᴏ ⲟ
p: р ρ ⲣ
q: ԛ
s: ѕ ꜱ
u: υ ս ᴜ
v: ν ѵ ᴠ
w: ԝ ᴡ
x: х
y: у
z: ᴢ
A: А Α Ꭺ ꓮ
B: В Β Ᏼ ꓐ ᗷ
C: С Ϲ Ꮯ ꓚ Ⲥ
D: Ꭰ ꓓ ᗞ
E: Е Ε Ꭼ ꓰ
F: Ϝ ꓝ
G: Ꮐ Ԍ ꓖ
H: Н Η Ꮋ ꓧ ᕼ Ⲏ
I: І Ι Ӏ ꓲ Ⲓ
J: Ј Ꭻ ꓙ ᒍ
K: К Κ Ꮶ ꓗ Ⲕ
L: Ꮮ ꓡ ᒪ
M: М Μ Ꮇ ꓟ ᗰ Ⲙ
N: Ν ꓠ Ⲛ
O: О Ο Օ ꓳ Ⲟ
P: Р Ρ Ꮲ ꓑ ᑭ Ⲣ
Q: Ԛ
R: Ꮢ ꓣ ᖇ
S: Ѕ Տ Ꮪ ꓢ
T: Т Τ Ꭲ ꓔ Ⲧ
U: Ս ꓴ ᑌ
V: Ѵ Ꮩ ꓦ ᐯ
W: Ԝ Ꮃ ꓪ
X: Х Χ ꓫ Ⲭ
Y: Ү Υ ꓬ Ⲩ
Z: Ζ Ꮓ ꓜ
ä: ӓ
ë: ё
ï: ї
ö: ӧ
一: ㇐ ⼀ ー
丨: 〡 ㇑ ⼁
丶: ㇔ ⼂
丿: ㇒ ⼃ ノ
乙: ㇠ ⼄
二: ニ
八: ハ
力: カ
卜: ト
口: ロ
夕: タ
工: エ
ヘ: へ
ベ: べ
ペ: ぺ
リ: り
·: · ‧ ・ • ∙ ⋅ ･
-: ‐ ‑ ‒ − ﹣ －
': ʼ ʹ ′
:: ː ∶ ꞉
;: ;
!: ǃ
~: ∼ ～
—: ― ⸺
"""

BLANK, INVISIBLE = " ", ""
#: Spellings the trie holds, and the longest of them: what is sent to the workers stays below VOCABULARY x LONGEST
#: characters. Rarer spellings are normalised by table.
VOCABULARY, LONGEST = 50_000, 48
CACHE_ENTRIES = 200_000
SLICE_CHARS = 2_000_000
#: Keys over which the rows of one string are spread when they are put in their pairs.
SALTS = 8
KEEP_WIDTHS = ("<wide>", "<narrow>", "<noBreak>", "<font>")
#: Compatibility forms of several characters that look the same written out: ligatures of f and Roman numerals.
SPELT_OUT = [*range(0xFB00, 0xFB07), *range(0x2160, 0x2180)]


def _one_step(c: str) -> str:
    """The plain form of a character by its decomposition, where the two look the same."""
    parts = unicodedata.decomposition(c).split()
    if not parts:
        return c
    if parts[0] in KEEP_WIDTHS or ord(c) in SPELT_OUT:
        return "".join(chr(int(p, 16)) for p in parts[1:])
    if parts[0] == "<compat>" and len(parts) == 2 and 0x2E80 <= ord(c) <= 0x2FDF:
        return chr(int(parts[1], 16))
    if not parts[0].startswith("<") and len(parts) == 1:
        return chr(int(parts[0], 16))
    return c


@functools.cache
def _alike() -> dict[str, str]:
    """Representative of each character of LOOKALIKES."""
    found = {}
    for line in LOOKALIKES.strip().splitlines():
        plain, _, others = line.rpartition(": ") if not line.startswith("::") else (":", ": ", line[3:])
        found |= dict.fromkeys(others.split(), plain)
    return found


@functools.cache
def plain_form(c: str) -> str:
    """Representative of the characters that look like ``c``: nothing for invisible ones, a space for any blank."""
    while (d := _one_step(c)) != c:
        if len(d) > 1:
            return "".join(map(plain_form, d))
        c = d
    kind, cp = unicodedata.category(c), ord(c)
    if kind == "Zs" or c == "\t":
        return BLANK
    if kind == "Cf" or (kind == "Cc" and c != "\n") or 0xFE00 <= cp <= 0xFE0F or cp in (0x34F, 0x115F, 0x1160, 0x3164):
        return INVISIBLE
    return _alike().get(c, c)


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: plain form (0 if invisible), whether it belongs to words, whether it needs spelling out first."""
    plain = np.arange(0x110000, dtype=np.uint32)
    word, special = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    for cp in [*range(0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x10000), 0xD7B0, *range(0x2F800, 0x2FA20), *range(0x1D400, 0x1D800), *range(0xE0000, 0xE0200)]:
        c = chr(cp)
        p = plain_form(c)
        special[cp] = len(p) > 1 or unicodedata.category(c) in ("Mn", "Mc") or cp in (0xFF9E, 0xFF9F)
        plain[cp] = ord(p) if len(p) == 1 else 0 if not p else cp
        word[cp] = not p or (unicodedata.category(p[0])[0] in "LM" and ord(p[0]) < 0x2E80)
    plain[0], word[0], special[0] = 0, False, False
    return plain, word, special


def spell_out(text: str) -> str:
    """Composed form, with widths, ligatures and numerals written plainly; for texts with marks or such forms."""
    wide = "".join(p if len(p := plain_form(c)) > 1 or ord(c) in (0xFF9E, 0xFF9F) else c for c in text)
    return unicodedata.normalize("NFC", wide)


def skeleton(word: str) -> str:
    """Table normal form of a word: equal for words that look the same."""
    parts = unicodedata.normalize("NFD", word)
    return unicodedata.normalize("NFC", "".join(map(plain_form, parts)))


class LookalikeTrie:
    """Spellings by their characters, searched with an edit automaton."""

    def __init__(self, spellings: list[str]):
        self.edges: list[dict[str, list[tuple[str, int]]]] = [{}]
        self.ends: list[str | None] = [None]
        for spelling in spellings:
            self._add(spelling)

    def _add(self, spelling: str) -> None:
        node = 0
        for c in unicodedata.normalize("NFD", spelling):
            kin = self.edges[node].setdefault(plain_form(c), [])
            child = next((n for e, n in kin if e == c), None)
            if child is None:
                child = len(self.edges)
                self.edges.append({})
                self.ends.append(None)
                kin.append((c, child))
            node = child
        if self.ends[node] is None:
            self.ends[node] = spelling

    def _skip(self, states: dict[int, int], limit: int) -> dict[int, int]:
        """Also the states reached by edges for which nothing is read, at cost 1 each."""
        todo = [(n, c) for n, c in states.items() if c < limit]
        while todo:
            node, cost = todo.pop()
            for kin in self.edges[node].values():
                for _, child in kin:
                    if states.get(child, limit + 1) > cost + 1:
                        states[child] = cost + 1
                        if cost + 1 < limit:
                            todo.append((child, cost + 1))
        return states

    def find(self, word: str, limit: int = 0) -> str | None:
        """The spelling of least cost within ``limit``; the first added among equals."""
        states = self._skip({0: 0}, limit)
        for c in unicodedata.normalize("NFD", word):
            if not (form := plain_form(c)):
                continue
            after: dict[int, int] = {}
            for node, cost in states.items():
                for _, child in self.edges[node].get(form, ()):
                    after[child] = min(cost, after.get(child, limit))
                if cost < limit:
                    after[node] = min(cost + 1, after.get(node, limit))
                    for kin in self.edges[node].values():
                        for _, child in kin:
                            after[child] = min(cost + 1, after.get(child, limit))
            states = self._skip(after, limit)
            if not states:
                return None
        found = [(cost, node) for node, cost in states.items() if self.ends[node] is not None]
        return self.ends[min(found)[1]] if found else None


class _Batch:
    """The texts of a batch as one array of code points, with the runs of word characters in it."""

    def __init__(self, texts: list[str]):
        _, word, special = _tables()
        one = "".join(texts)
        points = np.frombuffer(one.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        if (odd := special[points]).any():
            texts = list(texts)
            for i in np.unique(np.searchsorted(np.cumsum(lengths), np.flatnonzero(odd), "right")).tolist():
                texts[i] = spell_out(texts[i])
            one = "".join(texts)
            points = np.frombuffer(one.encode("utf-32-le", "surrogatepass"), np.uint32)
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.one, self.points, self.lengths = one, points, lengths
        inside = np.zeros(len(points) + 2, np.int8)
        inside[1:-1] = word[points]
        step = np.diff(inside)
        starts = np.cumsum(lengths) - lengths
        # A run does not pass from one text into the next.
        seams = starts[(starts > 0) & (starts < len(points))]
        seams = seams[(inside[seams] > 0) & (inside[seams + 1] > 0)]
        self.starts = np.unique(np.concatenate((np.flatnonzero(step > 0), seams)))
        self.ends = np.unique(np.concatenate((np.flatnonzero(step < 0), seams)))

    def words(self) -> list[str]:
        one = self.one
        return [one[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)]


def _slices(texts: list[str]) -> Iterator[list[str]]:
    part, chars = [], 0
    for text in texts:
        part.append(text)
        chars += len(text)
        if chars > SLICE_CHARS:
            yield part
            part, chars = [], 0
    if part:
        yield part


def _spellings(texts: DataFrame) -> DataFrame:
    """Counts of the spellings of words and of single characters that have look-alikes, by plain form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, word, _ = _tables()
        shared = np.zeros(0x110000, bool)
        moved = np.flatnonzero((plain != np.arange(0x110000)) & (plain > 0) & ~word)
        shared[moved] = shared[plain[moved]] = True
        words: Counter[str] = Counter()
        signs: Counter[int] = Counter()
        for batch in batches:
            for part in _slices([t for t in batch.column(0).to_pylist() if t]):
                held = _Batch(part)
                words.update(held.words())
                found, n = np.unique(held.points[shared[held.points]], return_counts=True)
                signs.update(dict(zip(found.tolist(), n.tolist(), strict=True)))
        rows: Counter[tuple[str, str]] = Counter()
        for raw, n in words.items():
            spelling = unicodedata.normalize("NFC", "".join(c for c in raw if plain_form(c)))
            if spelling and len(spelling) <= LONGEST:
                rows[skeleton(raw), spelling] += n
        for cp, n in signs.items():
            rows[chr(plain[cp]), chr(cp)] += n
        keys = list(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in keys], pa.string()), pa.array([s for _, s in keys], pa.string()),
             pa.array([rows[k] for k in keys], pa.int64())],
            names=["form", "spelling", "n"],
        )

    return texts.mapInArrow(run, "form string, spelling string, n bigint").groupBy("form", "spelling").agg(F.sum("n").alias("n"))


def learn_spellings(texts: DataFrame, size: int = VOCABULARY) -> tuple[list[str], dict[str, str]]:
    """Canonical spellings of words, at most ``size``, most frequent first, and of single characters.

    texts: one column. Of spellings that look the same the most frequent is canonical, ties go to the one that sorts
    first. All texts are counted; only the number of words kept is bounded.
    """
    best = (
        _spellings(texts)
        .groupBy("form")
        .agg(F.min_by("spelling", F.struct(-F.col("n"), F.col("spelling"))).alias("spelling"), F.sum("n").alias("n"))
    )
    is_word = (F.length("form") > 1) | F.col("form").rlike(r"^[\p{L}\p{M}]") & (F.col("form") < chr(0x2E80))
    words = best.where(is_word).orderBy(F.desc("n"), "form").limit(size).collect()
    signs = best.where(~is_word).collect()  # no more than there are characters
    return [r["spelling"] for r in words], {r["form"]: r["spelling"] for r in signs}


class Canonical:
    """Brings texts to their canonical form."""

    def __init__(self, spellings: list[str], signs: dict[str, str]):
        self.trie = LookalikeTrie(spellings)
        plain, word, _ = _tables()
        self.table = np.where(word, np.arange(0x110000, dtype=np.uint32), plain)
        chosen = np.arange(0x110000, dtype=np.uint32)
        for form, sign in signs.items():
            chosen[ord(form)] = ord(sign)
        self.table = np.where(word, self.table, chosen[self.table]).astype(np.uint32)
        self.cache: dict[str, str] = {}

    def word(self, raw: str) -> str:
        found = self.cache.get(raw)
        if found is None:
            found = self.trie.find(raw)
            if found is None:
                found = skeleton(raw)
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            self.cache[raw] = found
        return found

    def texts(self, texts: list[str]) -> list[str]:
        out: list[str] = []
        for part in _slices(texts):
            held = _Batch(part)
            mapped = self.table[held.points]
            for raw, a, b in zip(held.words(), held.starts.tolist(), held.ends.tolist(), strict=True):
                new = self.word(raw)
                if new != raw:
                    mapped[a : a + len(new)] = np.frombuffer(new.encode("utf-32-le"), np.uint32)
                    mapped[a + len(new) : b] = 0
            kept = np.concatenate(([0], np.cumsum(mapped > 0)))
            line = mapped[mapped > 0].tobytes().decode("utf-32-le", "surrogatepass")
            ends = np.cumsum(held.lengths)
            out += [line[a:b] for a, b in zip(kept[ends - held.lengths].tolist(), kept[ends].tolist(), strict=True)]
        return out


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def canonical_texts(
    df: DataFrame, keys: list[str], text: str, spellings: list[str], signs: dict[str, str], digests: bool = False
) -> DataFrame:
    """``keys`` and ``canonical`` of every row, or with ``digests`` the 128-bit digests ``form`` and ``raw`` instead.

    Texts that look the same have equal canonical texts: full, half or compatibility width, composed or decomposed,
    invisible characters, one blank for another, look-alikes of other scripts. Line breaks are kept, carriage returns
    are invisible. Null stays null, an empty text or one of invisible characters becomes empty. One row out for each row
    in; other columns are not read. Narrow plan; the broadcast holds at most VOCABULARY words of LONGEST characters.
    """
    shared = df.sparkSession.sparkContext.broadcast((spellings, signs))
    chosen = df.select(*keys, F.col(text).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema[:-1])
    schema = f"{fields}, form binary, raw binary" if digests else f"{fields}, canonical string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = None
        for batch in batches:
            tool = tool or Canonical(*shared.value)
            texts = batch.column(len(keys)).to_pylist()
            known = tool.texts([t for t in texts if t is not None])
            if digests:
                forms = iter(map(_digest, known))
                columns = [
                    pa.array([None if t is None else next(forms) for t in texts], pa.binary()),
                    pa.array([None if t is None else _digest(t) for t in texts], pa.binary()),
                ]
            else:
                forms = iter(known)
                columns = [pa.array([None if t is None else next(forms) for t in texts], pa.string())]
            names = [*keys, *(["form", "raw"] if digests else ["canonical"])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=names)

    return chosen.mapInArrow(run, schema)


def lookalike_pairs(df: DataFrame, table: str, key: str, text: str, size: int = VOCABULARY, least: int = 20) -> DataFrame:
    """Pairs of rows of one table whose texts look the same and are different strings: ``table``, key_a < key_b.

    Only texts of at least ``least`` characters count; nulls never do. Equal strings are no pair, whatever their number.
    Texts are compared by 128-bit digests. Classes with a single string, however many rows have it, are dropped by a
    map-side combined aggregate before any pair is formed. The different strings of a class are paired first and the rows
    of each then put in their places, so nothing larger than the result is formed; rows of one string are spread over
    SALTS keys.
    """
    long_enough = df.where(F.length(text) >= least)
    spellings, signs = learn_spellings(long_enough.select(text), size)
    rows = stage(canonical_texts(long_enough, [table, key], text, spellings, signs, digests=True), "forms")
    several = rows.groupBy(table, "form").agg(F.min("raw").alias("a"), F.max("raw").alias("b")).where("a <> b")
    several = stage(rows.join(several.select(table, "form"), [table, "form"], "left_semi"), "variants")
    strings = several.select(table, "form", "raw").distinct()
    other = strings.withColumnRenamed("raw", "raw_b")
    pairs = strings.withColumnRenamed("raw", "raw_a").join(other, [table, "form"]).where("raw_a < raw_b").drop("form")
    rows = several.select(table, "raw", F.col(key).alias("__key"), F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int").alias("__salt"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt")
    for side in ("a", "b"):
        mine = rows.select(F.col(table), F.col("raw").alias(f"raw_{side}"), F.col("__key").alias(f"__{side}"), "__salt")
        pairs = pairs.select("*", salts).join(mine, [table, f"raw_{side}", "__salt"]).drop("__salt")
    return pairs.select(table, F.least("__a", "__b").alias("key_a"), F.greatest("__a", "__b").alias("key_b"))


def _texts(spark: SparkSession, data_dir: str) -> DataFrame:
    translations = read_table(spark, data_dir, "translations").select(
        F.lit("translations").alias("table_name"), F.col("seq").alias("key"), F.col("translated_text").alias("text")
    )
    blocks = read_table(spark, data_dir, "blocks").select(
        F.lit("blocks").alias("table_name"), F.col("block_no").alias("key"), "text"
    )
    return translations.unionByName(blocks)


def p5_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """Pairs of rows that a reader cannot tell apart."""
    return lookalike_pairs(_texts(spark, data_dir), "table_name", "key", "text")


def p5_texts(spark: SparkSession, data_dir: str) -> DataFrame:
    """Every text in its canonical form."""
    texts = _texts(spark, data_dir)
    return canonical_texts(texts, ["table_name", "key"], "text", *learn_spellings(texts.select("text")))


def p5_classes(spark: SparkSession, data_dir: str) -> DataFrame:
    """Class of every text that looks the same, and the number of different strings in the class."""
    texts = _texts(spark, data_dir).where("text IS NOT NULL")
    rows = stage(
        canonical_texts(texts, ["table_name", "key"], "text", *learn_spellings(texts.select("text")), digests=True), "forms"
    )
    strings = rows.groupBy("form", "raw").agg(F.count("*").alias("n")).groupBy("form").agg(F.count("*").alias("n_strings"))
    return rows.join(strings, "form").select("table_name", "key", F.hex("form").alias("class_id"), "n_strings")


QUERIES = {"p5_found": p5_found, "p5_texts": p5_texts, "p5_classes": p5_classes}
