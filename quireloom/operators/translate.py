"""The translation step: prompts as columns, calls of a pluggable provider inside Arrow batches, results and errors as rows."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYSTEM_PROMPT = (
    "You are a professional book translator. Translate the provided text into Simplified Chinese. "
    "Preserve chapter headings. Do not summarize or explain. Do not omit content. Keep proper nouns and terms consistent."
)
RESULT = (
    "chunk_id string, ok boolean, translated_text string, input_tokens int, output_tokens int, estimated_cost_usd double, "
    "latency_ms int, attempt_count int, error_type string, error_message string"
)


@dataclass
class Reply:
    """What a provider gives back for one prompt."""

    text: str
    input_tokens: int
    output_tokens: int
    cost_usd: float = 0.0


class Provider(Protocol):
    """A translator; instances are sent to the workers and must be picklable."""

    def translate(self, prompt: str, source_text: str) -> Reply: ...


class RetryableError(Exception):
    """An error after which the same call may succeed: time-outs, broken connections, HTTP 429 and 5xx."""


class StubProvider:
    """Deterministic provider for tests: the source behind a mark. Texts with ``fail_on`` raise an error."""

    def __init__(self, mark: str = "译文::", fail_on: str | None = None):
        self.mark, self.fail_on = mark, fail_on

    def translate(self, prompt: str, source_text: str) -> Reply:
        if self.fail_on and self.fail_on in source_text:
            raise ValueError(f"refused: {self.fail_on}")
        return Reply(self.mark + source_text, 10, 12, 0.001)


#: Makers of providers by name; plug-ins add theirs.
PROVIDERS: dict[str, Callable[..., Provider]] = {"stub": StubProvider}


def build_provider(name: str, **settings) -> Provider:
    """A new provider of a registered name."""
    if name not in PROVIDERS:
        raise ValueError(f"Unsupported provider: {name}")
    return PROVIDERS[name](**settings)


def is_retryable(error: Exception) -> bool:
    status = getattr(error, "status_code", None)
    return isinstance(error, (RetryableError, TimeoutError, ConnectionError)) or (
        isinstance(status, int) and (status == 429 or status >= 500)
    )


def with_retries(call: Callable[[], Reply], most: int = 4, base: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> tuple[Reply, int]:
    """The reply and the number of attempts; waits base x 2^(n-1) s and up to 0.25 s more between them."""
    attempt = 0
    while True:
        attempt += 1
        try:
            return call(), attempt
        except Exception as error:
            if attempt >= most or not is_retryable(error):
                raise
            sleep(base * 2 ** (attempt - 1) + random.uniform(0.0, 0.25))


def entry_lines(title: str, entries: Column) -> Column:
    """'- source: translation' lines of an array of structs under a title, in order; null for an empty array."""
    lines = F.array_join(F.transform(entries, lambda e: F.concat(F.lit("- "), e["source"], F.lit(": "), e["translation"])), "\n")
    return F.when(F.size(entries) > 0, F.concat(F.lit(f"{title}:\n"), lines))


def user_prompt(book: Column, chapter: Column, index: Column, source: Column, glossary: Column, names: Column) -> Column:
    head = F.concat(
        F.lit("Book: "), book, F.lit("\nChapter: "), chapter, F.lit("\nChunk index: "), index.cast("string"),
        F.lit("\n\nTranslate the following text into Simplified Chinese only:\n\n"), source,
    )
    extras = F.concat_ws("\n\n", entry_lines("Glossary", glossary), entry_lines("Name map", names))
    return F.when(extras != "", F.concat(head, F.lit("\n\n"), extras)).otherwise(head)


def translate_chunks(requests: DataFrame, provider: Provider, concurrency: int = 5, attempts: int = 4, base_delay: float = 1.0) -> DataFrame:
    """A row for each request (chunk_id, prompt, source_text): the result, or with ok = false the error.

    Errors become rows and never fail the job. A task has up to ``concurrency`` calls under way; cap the whole by the number
    of partitions. Calls cost money: write the result before reading it twice, or Spark may call again.
    """

    def one(chunk_id: str, prompt: str, source: str) -> dict:
        began = time.monotonic()
        row = dict.fromkeys((f.split()[0] for f in RESULT.split(", ")))
        row["chunk_id"] = chunk_id
        try:
            reply, n = with_retries(lambda: provider.translate(prompt, source), attempts, base_delay)
            row |= {
                "ok": True, "translated_text": reply.text, "input_tokens": reply.input_tokens, "output_tokens": reply.output_tokens,
                "estimated_cost_usd": reply.cost_usd, "attempt_count": n,
            }
        except Exception as error:
            row |= {"ok": False, "error_type": type(error).__name__, "error_message": str(error), "attempt_count": attempts}
        row["latency_ms"] = int((time.monotonic() - began) * 1000)
        return row

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in RESULT.split(", ")]
        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                rows = pool.map(one, batch["chunk_id"], batch["prompt"], batch["source_text"])
                yield pd.DataFrame(list(rows), columns=names)

    return requests.select("chunk_id", "prompt", "source_text").mapInPandas(run, RESULT)


def results(replies: DataFrame) -> DataFrame:
    return replies.where("ok").drop("ok", "error_type", "error_message")


def errors(replies: DataFrame) -> DataFrame:
    return replies.where("NOT ok").select("chunk_id", "error_type", "error_message", F.col("attempt_count").alias("attempts"))


def translate_titles(titles: DataFrame, cache: DataFrame, provider: Provider) -> DataFrame:
    """``chapter_id`` and ``title_zh``: cached titles as they are, others from the provider's first line with ideographs.

    Titles that fail or come back without ideographs are left out.
    """
    from quireloom.functions.text import first_cjk_line

    cached = cache.where("title_zh IS NOT NULL AND title_zh <> ''").select("chapter_id", "title_zh")
    pending = titles.join(cached, "chapter_id", "left_anti").select(
        F.col("chapter_id").alias("chunk_id"),
        F.concat(F.lit("Translate this chapter title into Simplified Chinese: "), "title").alias("prompt"),
        F.col("title").alias("source_text"),
    )
    fresh = results(translate_chunks(pending, provider)).select(
        F.col("chunk_id").alias("chapter_id"), first_cjk_line("translated_text").alias("title_zh")
    )
    return cached.unionByName(fresh.where("title_zh IS NOT NULL"))
