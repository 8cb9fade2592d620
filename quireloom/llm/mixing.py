"""Problem 8: a mix in which every source has its target share of all tokens.

The largest mix that keeps both the shares and the caps on repeats is fixed by the source that runs out first. Each
source gives whole copies of itself as often as its budget holds and, for the rest, the records whose hash lies below a
threshold. The threshold comes from nested histograms of tokens by source and hash bucket: the bucket in which the
budget ends is cut into finer buckets, to which only its own rows go. Nothing is sorted; the sizes are read once a level. A record that would overshoot
the budget by far is passed over for smaller ones behind it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quireloom.llm.encoding import TOKENIZER, TOKENIZER_FOLDER, count_tokens
from quireloom.plans.staging import stage
from quireloom.sources import read_table

#: Hash bits a level of the histogram resolves, and the levels: 3 x 12 bits tell 68 billion records of a source apart.
LEVEL_BITS, LEVELS = 12, 3
#: A source's budget counts as reached when less than this part of it is missing.
TOLERANCE = 0.002
#: Targets are a table of settings; more sources than this are refused before their totals reach the driver.
MAX_SOURCES = 10_000


def _bucket(level: int) -> Column:
    shift = LEVEL_BITS * (LEVELS - 1 - level)
    return F.shiftright("__slot", shift).bitwiseAND(F.lit((1 << LEVEL_BITS) - 1)).cast("int")


def plan_budgets(rows: list[tuple[str, float, int, int]], total_tokens: int | None = None) -> dict[str, dict]:
    """Budget, whole copies and remainder by source. rows: source, target share, repeats, tokens there are.

    Sources without tokens or without a share take no part; the shares of the others are scaled to sum to 1. A
    ``total_tokens`` above the largest possible mix is lowered to it.
    """
    live = [(s, w, r, n) for s, w, r, n in rows if w > 0 and r > 0 and n > 0]
    weight = math.fsum(w for _, w, _, _ in live)
    if not live:
        return {}
    most = min(r * n / (w / weight) for _, w, r, n in live)
    total = most if total_tokens is None else min(most, total_tokens)
    plan = {}
    for source, w, repeats, tokens in live:
        budget = min(math.floor(total * w / weight + 1e-6), repeats * tokens)
        plan[source] = {"budget": budget, "copies": budget // tokens, "rest": budget % tokens}
    return plan


def _sized(documents: DataFrame, key: str, source: str, text: str, folder: str, tokenizer: str, seed: int) -> DataFrame:
    sized = count_tokens(
        documents.select(F.col(key).alias("__key"), F.col(source).alias("__source"), F.col(text).alias("__body")),
        ["__key", "__source"],
        "__body",
        folder,
        tokenizer,
    )
    slot = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "__key"), 64 - LEVEL_BITS * LEVELS)
    return stage(sized.withColumn("__slot", slot), "sized")


def _find_ranges(spark: SparkSession, sized: DataFrame, plan: dict[str, dict]) -> dict[str, list[tuple]]:
    """Ranges of hash slots, each with the largest record it takes, whose records fill the remainders.

    The first range ends in the slot where the running sum passes the remainder. Where the record in that slot is far
    larger than what is left, the gap is filled from the slots behind it by records that fit, and so on until the gap is
    below TOLERANCE of the budget or no record fits.
    """
    slots = 1 << (LEVEL_BITS * LEVELS)
    ranges: dict[str, list[tuple]] = {s: [] for s in plan}
    gap = {s: p["rest"] for s, p in plan.items()}
    low = dict.fromkeys(plan, 0)
    open_sources = {s for s in plan if gap[s] > 0}
    while open_sources:
        cut = dict.fromkeys(open_sources, 0)
        rest = {s: gap[s] for s in open_sources}
        whole: set[str] = set()
        for level in range(LEVELS):
            known = spark.createDataFrame(
                [(s, low[s], gap[s], rest[s], cut[s]) for s in open_sources - whole],
                "__source string, __low bigint, __most bigint, __rest bigint, __cut bigint",
            )
            rows = sized.join(known, "__source").where("__slot >= __low AND n_tokens <= __most AND n_tokens > 0")
            if level:
                rows = rows.where(F.shiftright("__slot", LEVEL_BITS * (LEVELS - level)) == F.col("__cut"))
            histogram = rows.groupBy("__source", "__rest", _bucket(level).alias("__bucket")).agg(
                F.sum("n_tokens").alias("__tokens")
            )
            upto = F.sum("__tokens").over(Window.partitionBy("__source").orderBy("__bucket"))
            boundary = (
                histogram.withColumn("__upto", upto)
                .where("__upto > __rest AND __upto - __tokens <= __rest")
                .select("__source", "__bucket", (F.col("__upto") - F.col("__tokens")).alias("__below"))
            )
            found = {r["__source"]: r for r in boundary.collect()}
            if not level:
                whole = open_sources - set(found)
            for s, r in found.items():
                cut[s] = (cut[s] << LEVEL_BITS) | r["__bucket"]
                rest[s] -= r["__below"]
            if not open_sources - whole:
                break
        for s in sorted(open_sources):
            if s in whole:
                ranges[s].append((low[s], slots, gap[s]))
                open_sources.discard(s)
                continue
            ranges[s].append((low[s], cut[s], gap[s]))
            low[s] = cut[s] if rest[s] < gap[s] else cut[s] + 1
            gap[s] = rest[s]
            if gap[s] <= TOLERANCE * plan[s]["budget"]:
                open_sources.discard(s)
    return ranges


def _targets(targets: DataFrame) -> DataFrame:
    """One row a source; repeated rows count once by their largest settings, null settings as no share and one use."""
    return (
        targets.where(F.col("source").isNotNull())
        .groupBy(F.col("source").alias("__source"))
        .agg(
            F.max(F.coalesce("target_share", F.lit(0.0))).alias("target_share"),
            F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"),
        )
    )


def mix_sources(
    documents: DataFrame,
    targets: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    total_tokens: int | None = None,
    folder: str = TOKENIZER_FOLDER,
    tokenizer: str = TOKENIZER,
    seed: int = 17,
) -> tuple[DataFrame, DataFrame]:
    """The mix and its report.

    Mix: ``key``, ``source``, ``n_tokens`` and ``uses`` (how often the record is used, at least 1). Report: a row for
    each source of either table with the tokens there are, the budget, the tokens used, target and actual share.
    Records without a source, of sources without a target, and without tokens (null, empty texts) have no use. Records
    with equal texts are records of their own; rows that repeat a key get the same hash and enter or stay out together.
    Targets without documents are reported with share 0 and the other shares scaled up. Empty tables give an empty mix.
    """
    spark = documents.sparkSession
    sized = _sized(documents, key, source, text, folder, tokenizer, seed)
    wanted = _targets(targets)
    totals = sized.groupBy("__source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("records"))
    settings = wanted.join(totals, "__source").limit(MAX_SOURCES + 1).collect()
    if len(settings) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources have targets")
    plan = plan_budgets([(r["__source"], r["target_share"], r["max_repeats"], r["tokens"]) for r in settings], total_tokens)

    ranges = _find_ranges(spark, sized, plan) if plan else {}
    chosen = spark.createDataFrame(
        [(s, p["copies"], ranges[s]) for s, p in plan.items()],
        "__source string, __copies int, __ranges array<struct<low: bigint, high: bigint, most: bigint>>",
    )
    inside = F.exists(
        "__ranges",
        lambda r: (F.col("__slot") >= r["low"]) & (F.col("__slot") < r["high"]) & (F.col("n_tokens") <= r["most"]),
    )
    used = (
        sized.where("n_tokens > 0")
        .join(chosen, "__source")
        .withColumn("uses", F.col("__copies") + F.when(inside, 1).otherwise(0))
        .where("uses > 0")
    )
    mix = used.select(F.col("__key").alias(key), F.col("__source").alias(source), "n_tokens", "uses")

    sums = used.groupBy("__source").agg(
        F.sum(F.col("n_tokens") * F.col("uses")).alias("used_tokens"),
        F.count("*").alias("used_records"),
        F.max("uses").alias("most_uses"),
    )
    budgets = spark.createDataFrame([(s, p["budget"]) for s, p in plan.items()], "__source string, budget_tokens bigint")
    report = (
        wanted.join(totals, "__source", "full_outer")
        .join(budgets, "__source", "left")
        .join(sums, "__source", "left")
        .select(
            F.col("__source").alias(source),
            "target_share",
            "max_repeats",
            F.coalesce("records", F.lit(0)).alias("records"),
            F.coalesce("tokens", F.lit(0)).alias("available_tokens"),
            F.coalesce("budget_tokens", F.lit(0)).alias("budget_tokens"),
            F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"),
            F.coalesce("used_records", F.lit(0)).alias("used_records"),
            F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
        )
    )
    whole = F.sum("used_tokens").over(Window.partitionBy(F.lit(0)))
    report = report.withColumn("actual_share", F.when(whole > 0, F.col("used_tokens") / whole).otherwise(F.lit(0.0)))
    return mix, report


def _parts(spark: SparkSession, data_dir: str) -> tuple[DataFrame, DataFrame]:
    return mix_sources(read_table(spark, data_dir, "documents"), read_table(spark, data_dir, "mix_targets"))


def p8_mix(spark: SparkSession, data_dir: str) -> DataFrame:
    """Every record of the mix and how often it is used."""
    return _parts(spark, data_dir)[0]


def p8_shares(spark: SparkSession, data_dir: str) -> DataFrame:
    """Target and actual share of every source."""
    return _parts(spark, data_dir)[1]


QUERIES = {"p8_mix": p8_mix, "p8_shares": p8_shares}
