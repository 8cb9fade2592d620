"""Problem 4: broken pairs of prompt and response.

Ordered rules read each response once: emptiness, unclosed delimiters, abrupt endings, refusal phrases in several
languages, and script mismatch; only responses that trigger something leave the scan. All responses are joined with
their prompts and compared from the start for copies. Every triggered defect is listed; where one name is wanted, the
rules' precedence decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireloom.llm.responses import is_empty, unwrap
from quireloom.llm.truncation import detect_cut, ends_openly
from quireloom.plans.staging import stage
from quireloom.sources import read_table

#: A refusal is uttered within so many sentences from a response's start, or from its end, however long it is.
REFUSAL_OPENS, REFUSAL_CLOSES = 3, 2
#: Share of the response's word triples found in the prompt that makes it a copy.
COPIED = 0.6
#: Ideographs for each letter of another script, and kana for each ideograph, at which a text is Chinese or Japanese.
CHINESE, JAPANESE = 0.5, 0.15

PRECEDENCE = ("empty", "refusal", "copy", "other_language", "truncated")

# Ways to refuse, by language; each line is one pattern over a response without its quotations.
REFUSALS = r"""
(?:无法|不能|不会|没法|没有办法|难以|不便|不可|恕难|恕不|不予|不再|选择不|拒绝)[^。！？\n]{0,16}(?:翻译|译文|译出|协助|处理|提供|完成|给出|中文版本|请求)
(?:翻译|译|处理|完成)不了
超出了?[^。！？\n]{0,6}(?:能力|范围)
不在[^。！？\n]{0,6}能[^。！？\n]{0,6}范围
(?:留空|空白|空缺)[^。！？\n]{0,4}(?:不译|不翻)
只(?:能|好)[^。！？\n]{0,10}(?:留作?空|空着|跳过|略过)
\b(?:cannot|can't|can not|unable to|not able to|won't|will not|must decline to|decline to|refuse to)\b[^.!?\n]{0,40}(?:translat|render|comply|process|provid|assist|help|produce|complete|fulfil)
(?:translat\w*|render\w*|assist\w*|help\w*)[^.!?\n]{0,60}(?:outside what i can|beyond what i can|not something i can|not possible for me)
something i (?:cannot|can't|am unable to)
(?:have to|must) leave[^.!?\n]{0,40}untranslated
(?:translation|request|content|text)[^.!?\n]{0,20}(?:declined|refused|not supported|cannot be processed|can't be processed|could not be processed)
je (?:ne peux|ne puis|ne suis)[^.!?\n]{0,12}pas[^.!?\n]{0,40}(?:tradui|aider|fournir|traiter)
(?:impossible|pas en mesure) de[^.!?\n]{0,20}(?:traduire|fournir|traiter)
ich (?:kann|darf|werde)[^.!?\n]{0,60}nicht[^.!?\n]{0,20}(?:übersetz|helfen|bearbeit|bereitstell)
nicht in der lage[^.!?\n]{0,40}(?:übersetz|helfen|bearbeit)
no (?:puedo|podré|me es posible)[^.!?\n]{0,30}(?:traducir|ayudar|procesar|proporcionar)
(?:翻訳|お手伝い|対応|提供)[^。！？\n]{0,8}(?:できません|できかねます|いたしかねます)
"""

# Signs of somebody else's speech, in which a refusal is part of the story.
REPORTED = r"(?:回答|告诉|解释|承认|表示|宣布|[他她们人员])说|答道|说道|写道|\b(?:said|told|answered|replied|wrote|asked)\b|\b(?:antwortete|sagte)\b|\b(?:répondit|dit)\b"

_REFUSES = re.compile("|".join(f"(?:{x})" for x in REFUSALS.strip().splitlines()), re.I)
_REPORTED = re.compile(REPORTED, re.I)
_QUOTED = re.compile(r"“[^”]*”|「[^」]*」|『[^』]*』|«[^»]*»|„[^“]*“|\"[^\"\n]*\"")
_SENTENCES = re.compile(r"[^。！？.!?\n]*[^\s。！？.!?][^。！？.!?\n]*[。！？.!?\n]*")
_WORD = re.compile(r"[^\W_]+")

_HAN = re.compile("[\u3400-\u9fff]")

_PAIRED = {"（": "）", "(": ")", "［": "］", "[": "]", "【": "】", "《": "》", "“": "”", "「": "」", "『": "』", "‘": "’"}


# Parts of words, one of the first and one of the second line at least in whatever REFUSALS match.
REFUSAL_HINTS = tuple(
    tuple(line.split("|"))
    for line in (
        "无法|不能|不会|没法|没有办法|难以|不便|不可|恕难|恕不|不予|不再|选择不|拒绝|不了|超出|不在|留空|空白|空缺|只能|只好|cannot|can't|can not|"
        "able to|won't|will not|decline|refuse|outside|beyond|something|not possible|have to|must|not supported|could not|"
        "je ne|impossible|pas en mesure|ich |nicht in der|no pued|no podr|no me es|できません|できかね|いたしかね",
        "译|协助|处理|提供|完成|给出|中文版本|请求|能力|范围|不翻|留空|空着|留作|跳过|略过|translat|render|comply|process|provid|assist|help|"
        "produce|complete|fulfil|something i|tradui|aider|fournir|traiter|übersetz|helfen|bearbeit|bereitstell|traducir|ayudar|"
        "procesar|proporcionar|翻訳|手伝い|対応|request|content|text",
    )
)


def refuses(body: str) -> bool:
    """Whether an unwrapped response is a refusal: one of its first or last sentences refuses outside any quotation.

    What somebody is reported to have refused is part of a story.
    """
    low = body.lower().replace("’", "'")
    if not all(any(part in low for part in parts) for parts in REFUSAL_HINTS):
        return False
    plain = _QUOTED.sub("“”", body.replace("’", "'"))
    if not _REFUSES.search(plain):
        return False
    sentences = [m.group() for m in _SENTENCES.finditer(plain)]
    ends = sentences if len(sentences) <= REFUSAL_OPENS + REFUSAL_CLOSES else sentences[:REFUSAL_OPENS] + sentences[-REFUSAL_CLOSES:]
    return any(_REFUSES.search(x) and not _REPORTED.search(x) for x in ends)


def unclosed(body: str) -> bool:
    """Whether a bracket or quotation is still open at the end of the last paragraph."""
    last = body.rsplit("\n", 1)[-1]
    opened: list[str] = []
    for c in last:
        if c in _PAIRED:
            opened.append(_PAIRED[c])
        elif opened and c == opened[-1]:
            opened.pop()
    return bool(opened)


def copies(prompt: str, response: str) -> bool:
    """Whether a response repeats its prompt: the same start of letters and digits, or most of its word triples.

    Case, punctuation, line ends, numbering and marks before lines make no difference.
    """
    ours = _WORD.findall(response.lower())
    if not ours:
        return False
    # A prompt without ideographs holds no triple with a word of them: too few others, and it need not be cut into words.
    plain = sum(not _HAN.search(w) for w in ours)
    if plain < COPIED * (len(ours) - 2) and _HAN.search("".join(ours[:40])[:40]) and not _HAN.search(prompt):
        return False
    theirs = _WORD.findall(prompt.lower())
    if not theirs:
        return False
    start_a, start_b = "".join(ours)[:200], "".join(theirs)[:200]
    if min(len(start_a), len(start_b)) >= 40 and start_a[:40] == start_b[:40]:
        return True
    held = set(zip(theirs, theirs[1:], theirs[2:], strict=False))
    triples = list(zip(ours, ours[1:], ours[2:], strict=False))
    if not triples:
        return ours == theirs
    return sum(t in held for t in triples) >= COPIED * len(triples)


def _scripts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ideographs, kana and letters of other scripts in each text."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    starts = np.concatenate(([0], ends[:-1])) if len(texts) else ends

    def count(mask: np.ndarray) -> np.ndarray:
        running = np.concatenate(([0], np.cumsum(mask)))
        return running[ends] - running[starts]

    han = ((points >= 0x3400) & (points <= 0x9FFF)) | ((points >= 0xF900) & (points <= 0xFAFF)) | ((points >= 0x20000) & (points <= 0x323AF)) | ((points >= 0x2F00) & (points <= 0x2FDF))
    kana = (points >= 0x3041) & (points <= 0x30FA) & (points != 0x30A0)
    low = points | 0x20
    letter = ((low >= ord("a")) & (low <= ord("z"))) | ((points >= 0xC0) & (points <= 0x1FFF)) | ((points >= 0xAC00) & (points <= 0xD7A3))
    return count(han), count(kana), count(letter)


def _apply_rules(responses: DataFrame, key: str, prompt_id: str, response: str) -> DataFrame:
    """Responses that trigger a rule or might: key, prompt id and one flag for each rule."""
    chosen = responses.select(F.col(key).cast("bigint"), F.col(prompt_id).cast("string"), F.col(response))
    schema = (
        f"`{key}` bigint, `{prompt_id}` string, empty boolean, refusal boolean, foreign boolean, open boolean, "
        "unclosed boolean"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [unwrap(t or "") for t in batch.column(2).to_pylist()]
            han, kana, letters = (x.tolist() for x in _scripts(bodies))
            rows = []
            for k, p, body, h, j, a in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), bodies, han, kana, letters, strict=True
            ):
                if is_empty(body):
                    rows.append((k, p, True, False, False, False, False))
                    continue
                foreign = h < CHINESE * a or j > JAPANESE * (h + j)
                refusal = refuses(body)
                openly = ends_openly(body)
                if foreign or refusal or openly:
                    rows.append((k, p, False, refusal, foreign, openly, openly and unclosed(body)))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            types = [pa.int64(), pa.string(), *[pa.bool_()] * 5]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                names=[key, prompt_id, "empty", "refusal", "foreign", "open", "unclosed"],
            )

    return chosen.mapInArrow(run, schema)


def broken_pairs(
    prompts: DataFrame, responses: DataFrame, prompt_id: str, prompt: str, key: str, response: str, every: bool = False
) -> DataFrame:
    """``key`` and ``defects`` (an array in the order of PRECEDENCE) of every defective pair; sound pairs give no row.

    key: a unique number of the response. Responses whose prompt id is null or unknown form no pair. Prompts delivered
    twice count once; of different prompts with one id, the text that sorts first counts. A null prompt is copied by
    nothing. Null, blank and content-free responses are 'empty' and trigger nothing else. A copy in a foreign script is
    listed as 'other_language' too only with ``every``. Truncated are those that problem 3 finds among all responses, pairs
    or not. Other columns are not read; empty tables give no row.
    """
    flagged = stage(_apply_rules(responses, key, prompt_id, response), "flagged")
    cut = detect_cut(responses, key, response).where("cut").select(key, "cut")
    known = prompts.where(F.col(prompt_id).isNotNull()).select(F.col(prompt_id).cast("string").alias(prompt_id)).distinct()
    texts = (
        prompts.where(F.col(prompt_id).isNotNull())
        .groupBy(F.col(prompt_id).cast("string").alias(prompt_id))
        .agg(F.min(prompt).alias("prompt"))
        .where("prompt IS NOT NULL")
        .join(
            responses.where(F.col(response).isNotNull()).select(
                F.col(key).cast("bigint"), F.col(prompt_id).cast("string"), F.col(response).alias("response")
            ),
            prompt_id,
        )
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for k, p, r in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                body = unwrap(r)
                if not is_empty(body) and copies(p, body):
                    keys.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([True] * len(keys), pa.bool_())], names=[key, "copied"])

    copied = texts.select(key, "prompt", "response").mapInArrow(compare, f"`{key}` bigint, copied boolean")
    joined = flagged.join(known, prompt_id, "left_semi").join(copied, key, "full").join(cut, key, "left")
    no = F.lit(False)
    truncated = F.coalesce("cut", no) | F.coalesce("unclosed", no)
    copied_flag = F.coalesce("copied", no)
    tests = {
        "empty": F.col("empty"),
        "refusal": F.col("refusal"),
        "copy": copied_flag,
        "other_language": F.col("foreign") if every else F.col("foreign") & ~copied_flag,
        "truncated": truncated,
    }
    defects = F.array_compact(F.array(*[F.when(tests[d], F.lit(d)) for d in PRECEDENCE]))
    return joined.select(key, defects.alias("defects")).where(F.size("defects") > 0)


def _pairs(spark: SparkSession, data_dir: str, every: bool = False) -> DataFrame:
    return broken_pairs(
        read_table(spark, data_dir, "chunks"), read_table(spark, data_dir, "translations"),
        "chunk_id", "source_text", "seq", "translated_text", every,
    )


def p4_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """The defect of each broken pair."""
    return _pairs(spark, data_dir).select("seq", F.col("defects")[0].alias("defect"))


def p4_defects(spark: SparkSession, data_dir: str) -> DataFrame:
    """Every triggered defect of each broken pair."""
    return _pairs(spark, data_dir, every=True)


QUERIES = {"p4_found": p4_found, "p4_defects": p4_defects}
