"""Problem 2: agreed labels of passages, agreement, and the reliability of the agents.

Labels of one agent on one passage are reduced to its latest judgement, and the judgements of a passage are packed into
one row, at most one entry for an agent. What an agent says is its label and how sure it is: beside its confusion matrix
each agent has a distribution of confidence for right and for wrong labels. Expectation-maximisation then alternates between the posterior of each passage
(narrow, over the packed rows) and the confusion matrix of each agent (sums that are combined on the map side before a
shuffle of agents x labels x labels rows). While the matrices are small they are sent to the workers whole; above a
documented bound they are joined instead. Agreement is corrected for chance and reported apart from the model.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quireloom.plans.staging import stage
from quireloom.sources import read_table

_log = logging.getLogger(__name__)

#: Pseudo-counts of the confusion matrices, on the diagonal and elsewhere, and of the levels of confidence.
RIGHT, WRONG, LEVEL = 2.0, 0.5, 1.0
#: Bounds between levels of confidence; a missing confidence is a level of its own.
BOUNDS = (0.45, 0.55, 0.6, 0.65, 0.7, 0.75, 0.85)
LEVELS = len(BOUNDS) + 2
MAX_ROUNDS, TOLERANCE = 30, 1e-4
#: Distinct labels a scale may have; a label set is a coding scheme, not data.
MAX_LABELS = 200
#: Cells of all confusion matrices that are sent to the workers; 4 million doubles are 32 MB.
MAX_CELLS = 4_000_000


def plain_label(label: Column) -> Column:
    """Lower case with single underscores; null for blank labels."""
    joined = F.regexp_replace(F.lower(F.trim(label)), r"[\s\-_]+", "_")
    return F.nullif(F.regexp_replace(joined, r"^_+|_+$", ""), F.lit(""))


def confidence_level(confidence: Column) -> Column:
    """Level of a confidence from 0 to 1 or, above 1, in percent; the last level if it is missing."""
    value = F.nanvl(confidence.cast("double"), F.lit(None).cast("double"))
    share = F.when(value > 1, value / 100).otherwise(value)
    level = sum(((share >= b).cast("int") for b in BOUNDS), F.lit(0))
    return F.coalesce(level, F.lit(LEVELS - 1))


def latest_judgements(
    rows: DataFrame, item: str, agent: str, label: str, at: str, order: str, confidence: str | None = None
) -> DataFrame:
    """``item``, ``agent``, ``label`` and ``level`` of the last judgement of each agent on each item that has a label.

    Last by ``at`` (nulls first), then ``order``, then label, so that ties and repeated rows give one defined row. Rows
    without item or agent are left out. Without a confidence column all have the level of a missing one.
    """
    sure = confidence_level(F.col(confidence)) if confidence else F.lit(LEVELS - 1)
    known = rows.select(
        F.col(item).alias("item"), F.col(agent).alias("agent"), plain_label(F.col(label)).alias("label"),
        F.col(at).alias("at"), F.col(order).alias("order"), sure.alias("level"),
    ).where("item IS NOT NULL AND agent IS NOT NULL AND label IS NOT NULL")
    best = F.max(F.struct("at", "order", "label", "level"))
    return known.groupBy("item", "agent").agg(best.alias("best")).select("item", "agent", "best.label", "best.level")


def _pack(judgements: DataFrame, labels: list[str]) -> DataFrame:
    """A row for each item with its votes as two parallel arrays, in the order of agents.

    A code is the label's number plus the number of labels times the level of confidence.
    """
    codes = F.create_map(*[F.lit(x) for i, name in enumerate(labels) for x in (name, i)])
    code = codes[F.col("label")] + F.lit(len(labels)) * F.col("level")
    return (
        judgements.groupBy("item")
        .agg(F.sort_array(F.collect_list(F.struct("agent", code.alias("code")))).alias("votes"))
        .select("item", F.col("votes.agent").alias("agents"), F.col("votes.code").alias("codes"))
    )


def _posteriors(batch: pa.RecordBatch, agents: dict[str, int] | None, model, k: int):
    """Flat votes of a batch and the posterior of each item. model: None at first, else log matrices and log priors."""
    names, codes = batch.column(1), batch.column(2)
    lengths = np.diff(names.offsets.to_numpy())
    item = np.repeat(np.arange(len(lengths)), lengths)
    encoded = names.flatten().dictionary_encode()
    words = encoded.dictionary.to_pylist()
    local = encoded.indices.to_numpy(zero_copy_only=False)
    who = np.array([agents[w] for w in words], np.int64)[local] if agents is not None else local
    code = codes.flatten().to_numpy(zero_copy_only=False)
    if model is None:
        score = np.zeros((len(lengths), k))
        np.add.at(score, (item, code % k), 1.0)
        post = (score + 0.1) / (score + 0.1).sum(1, keepdims=True)
    else:
        matrices, priors = model
        score = np.tile(priors, (len(lengths), 1))
        np.add.at(score, item, matrices[who, :, code])
        score -= score.max(1, keepdims=True)
        post = np.exp(score)
        post /= post.sum(1, keepdims=True)
    return item, who, words, local, code, post


def _normalise(counts: np.ndarray, priors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log rates of codes by agent and true label, and log priors.

    counts: agents x true labels x codes. A code's rate is that of its label times that of its level, given that the label
    is right or wrong; so an agent needs few judgements to be known.
    """
    n, k = counts.shape[:2]
    cells = counts.reshape(n, k, LEVELS, k)
    labels = cells.sum(2) + WRONG + (RIGHT - WRONG) * np.eye(k)
    labels /= labels.sum(2, keepdims=True)
    same = np.eye(k, dtype=bool)
    right = cells.transpose(0, 2, 1, 3)[:, :, same].sum(2) + LEVEL
    wrong = cells.transpose(0, 2, 1, 3)[:, :, ~same].sum(2) + LEVEL
    right, wrong = right / right.sum(1, keepdims=True), wrong / wrong.sum(1, keepdims=True)
    levels = np.where(same[None, None], right[:, :, None, None], wrong[:, :, None, None])
    rates = labels[:, None] * levels
    return np.log(rates.transpose(0, 2, 1, 3).reshape(n, k, LEVELS * k)), np.log((priors + 1.0) / (priors + 1.0).sum())


def _sums(packed: DataFrame, k: int, shared) -> DataFrame:
    """Expected counts by agent, true label and given label; a null agent holds the sums of the posteriors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        agents, model = shared.value if shared else (None, None)
        total: dict[str, np.ndarray] = {}
        prior = np.zeros(k)
        for batch in batches:
            item, _, words, local, code, post = _posteriors(batch, agents, model, k)
            prior += post.sum(0)
            wide = k * LEVELS
            cells = np.zeros((len(words), k, wide))
            for true in range(k):
                flat = np.bincount(local * wide + code, post[item, true], len(words) * wide)
                cells[:, true] = flat.reshape(len(words), wide)
            for word, cell in zip(words, cells, strict=True):
                total[word] = total[word] + cell if word in total else cell
        for word, cell in [(None, np.diag(prior)), *total.items()]:
            true, given = np.nonzero(cell)
            yield pa.RecordBatch.from_arrays(
                [pa.array([word] * len(true), pa.string()), pa.array(true.astype(np.int32)),
                 pa.array(given.astype(np.int32)), pa.array(cell[true, given])],
                names=["agent", "truth", "given", "mass"],
            )

    found = packed.mapInArrow(run, "agent string, truth int, given int, mass double")
    return found.groupBy("agent", "truth", "given").agg(F.sum("mass").alias("mass"))


def _posterior_rows(packed: DataFrame, k: int, shared) -> DataFrame:
    item_type = packed.schema["item"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        agents, model = shared.value
        for batch in batches:
            post = _posteriors(batch, agents, model, k)[-1]
            bounds = pa.array(np.arange(len(post) + 1, dtype=np.int32) * k)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(bounds, pa.array(post.ravel()))],
                names=["item", "agents", "codes", "posterior"],
            )

    return packed.mapInArrow(run, f"item {item_type}, agents array<string>, codes array<int>, posterior array<double>")


def _fit_small(packed: DataFrame, names: list[str], k: int) -> tuple[DataFrame, DataFrame]:
    """EM with the matrices on the driver: at most MAX_CELLS numbers come back a round."""
    context = packed.sparkSession.sparkContext
    place = {a: i for i, a in enumerate(names)}
    shared, old, sums = None, None, None
    for _ in range(MAX_ROUNDS):
        sums = _sums(packed, k, shared).toPandas()
        counts, priors = np.zeros((len(names), k, k * LEVELS)), np.zeros(k)
        own = sums[sums.agent.notna()]
        counts[own.agent.map(place), own.truth, own.given] = own.mass
        rest = sums[sums.agent.isna()]
        priors[rest.truth] = rest.mass
        model = _normalise(counts, priors)
        if shared:
            shared.destroy()  # the sums made with it are here
        shared = context.broadcast((place, model))
        new = np.exp(model[0])
        if old is not None and np.abs(new - old).max() < TOLERANCE:
            break
        old = new
    else:
        _log.warning("rates still change after %d rounds", MAX_ROUNDS)
    counts, new = (x.reshape(len(names), k, LEVELS, k).sum(2) for x in (counts, new))
    matrices = [
        (a, t, g, float(counts[i, t, g]), float(new[i, t, g]))
        for a, i in place.items() for t in range(k) for g in range(k)
    ]
    frame = pd.DataFrame(matrices, columns=["agent", "truth", "given", "mass", "rate"])
    table = packed.sparkSession.createDataFrame(frame, "agent string, truth int, given int, mass double, rate double")
    return _posterior_rows(packed, k, shared), table


def _fit_joined(packed: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """EM with the matrices as a table joined to the votes, for more agents than can be sent to every worker."""
    votes = stage(
        packed.select("item", F.explode(F.arrays_zip("agents", "codes")).alias("v")).select(
            "item", F.col("v.agents").alias("agent"), F.col("v.codes").alias("given")
        ),
        "votes",
    )
    def numbers(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    sums, old = stage(_sums(packed, k, None), "matrices"), None
    for step in range(MAX_ROUNDS):
        own = sums.where("agent IS NOT NULL")
        full = own.select("agent").distinct().select("agent", numbers(k).alias("truth"))
        full = full.select("*", numbers(k * LEVELS).alias("given")).join(own, ["agent", "truth", "given"], "left")
        full = full.withColumns(
            {
                "mass": F.coalesce("mass", F.lit(0.0)), "label": F.col("given") % k,
                "level": F.floor(F.col("given") / k), "same": F.col("truth") == F.col("given") % k,
            }
        )

        def total(*keys: str) -> Column:
            return F.sum("mass").over(Window.partitionBy("agent", *keys))

        of_label = (total("truth", "label") + F.when(F.col("same"), RIGHT).otherwise(WRONG)) / (
            total("truth") + (RIGHT + (k - 1) * WRONG)
        )
        of_level = (total("same", "level") + LEVEL) / (total("same") + LEVELS * LEVEL)
        table = stage(full.select("agent", "truth", "given", "mass", (of_label * of_level).alias("rate")), "rates")
        prior = sums.where("agent IS NULL").select("truth", F.log(F.col("mass") + 1.0).alias("prior"))
        score = (
            votes.join(table, ["agent", "given"])
            .groupBy("item", "truth").agg(F.sum(F.log("rate")).alias("score"))
            .join(F.broadcast(prior), "truth", "left")
            .withColumn("score", F.col("score") + F.coalesce("prior", F.lit(0.0)))
        )
        by_item = Window.partitionBy("item")
        weight = F.exp(F.col("score") - F.max("score").over(by_item))
        post = score.select("item", "truth", (weight / F.sum(weight).over(by_item)).alias("p"))
        post = stage(post, "posteriors")
        if old is not None:
            change = table.join(old.withColumnRenamed("rate", "was"), ["agent", "truth", "given"]).agg(F.max(F.abs(F.col("rate") - F.col("was"))))
            if change.first()[0] < TOLERANCE:
                break
        if step == MAX_ROUNDS - 1:
            _log.warning("rates still change after %d rounds", MAX_ROUNDS)
            break
        old = table.select("agent", "truth", "given", "rate")
        own_sums = votes.join(post, "item").groupBy("agent", "truth", "given").agg(F.sum("p").alias("mass"))
        all_sums = post.groupBy("truth").agg(F.sum("p").alias("mass")).select(
            F.lit(None).cast("string").alias("agent"), "truth", F.col("truth").alias("given"), "mass"
        )
        sums = stage(own_sums.unionByName(all_sums), "matrices")
    array = post.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("truth", "p")))["p"].alias("posterior"))
    by_label = table.groupBy("agent", "truth", (F.col("given") % k).cast("int").alias("given"))
    return packed.join(array, "item"), by_label.agg(F.sum("mass").alias("mass"), F.sum("rate").alias("rate"))


def fit_consensus(judgements: DataFrame, max_cells: int = MAX_CELLS) -> tuple[DataFrame, DataFrame, list[str]]:
    """Items with votes and posteriors, the agents' matrices, and the labels in the order of the posteriors.

    judgements: ``item``, ``agent``, ``label``, ``level``, one row for each item and agent, nothing null. An empty table gives two
    empty tables and no labels. Item posteriors tie towards the label that sorts first.
    """
    labels = [r[0] for r in judgements.select("label").distinct().orderBy("label").limit(MAX_LABELS + 1).collect()]
    if len(labels) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels: not a scale")
    spark = judgements.sparkSession
    k = len(labels)
    if not k:
        kind = judgements.schema["item"].dataType.simpleString()
        fields = f"item {kind}, agents array<string>, codes array<int>, posterior array<double>"
        return (
            spark.createDataFrame([], fields),
            spark.createDataFrame([], "agent string, truth int, given int, mass double, rate double"),
            labels,
        )
    packed = stage(_pack(judgements, labels), "votes")
    names = [r[0] for r in judgements.select("agent").distinct().limit(max(1, max_cells // (k * k * LEVELS)) + 1).collect()]
    if len(names) * k * k * LEVELS <= max_cells:
        return *_fit_small(packed, sorted(names), k), labels
    return *_fit_joined(packed, k), labels


def _pick(posterior: Column, labels: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in labels]), F.array_position(posterior, F.array_max(posterior)).cast("int"))


def consensus_of(rows: DataFrame, label: str, item: str, agent: str, at: str, order: str, confidence: str | None = None):
    """Consensus label, agreement and reliability: a table of items, one of agents and one row for the scale.

    Items: ``item``, ``label``, ``posterior`` of it, ``n_agents``, ``observed_agreement`` (share of agreeing pairs of
    agents, null for one agent) and ``agreement`` (corrected for chance by the labels' overall shares). Agents:
    ``agent``, ``n_items``, ``reliability`` (chance to give the right label, over the estimated labels) and
    ``chance_corrected`` (0 for guessing, 1 for always right). Scale: ``n_items``, ``n_judgements`` and
    ``alpha`` (Krippendorff's, nominal). Blank labels are no judgements. Empty tables give empty tables.
    """
    judgements = stage(latest_judgements(rows, item, agent, label, at, order, confidence), "judgements")
    fitted, matrices, labels = fit_consensus(judgements)
    k = max(1, len(labels))
    shares = {r["label"]: r["n"] for r in judgements.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n = sum(shares.values())
    expected = sum(v * (v - 1) for v in shares.values()) / (n * (n - 1)) if n > 1 else 1.0
    size = F.size("codes")
    counts = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda c: F.size(F.filter("codes", lambda x: x % k == c)))
    pairs = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, c: a + c * (c - 1))
    observed = F.when(size > 1, pairs / (size * (size - 1)))
    items = fitted.select(
        "item",
        (_pick(F.col("posterior"), labels) if labels else F.lit(None).cast("string")).alias("label"),
        F.array_max("posterior").alias("posterior"),
        size.alias("n_agents"),
        observed.alias("observed_agreement"),
        ((observed - expected) / (1 - expected) if expected < 1 else F.lit(None).cast("double")).alias("agreement"),
    )
    right = F.sum(F.when(F.col("truth") == F.col("given"), F.col("mass")).otherwise(0.0)) / F.sum("mass")
    by_truth = F.sum("mass").over(Window.partitionBy("agent", "truth"))
    by_given = F.sum("mass").over(Window.partitionBy("agent", "given"))
    whole = F.sum("mass").over(Window.partitionBy("agent"))
    chance = F.sum(
        F.when(F.col("truth") == F.col("given"), F.col("t") * F.col("g") / (F.col("w") * F.col("w"))).otherwise(0.0)
    )
    agents = (
        matrices.withColumns({"t": by_truth, "g": by_given, "w": whole})
        .groupBy("agent")
        .agg(F.sum("mass").alias("n_items"), right.alias("reliability"), chance.alias("chance"))
        .select(
            "agent",
            F.round("n_items").cast("bigint").alias("n_items"),
            "reliability",
            ((F.col("reliability") - F.col("chance")) / F.nullif(F.lit(1.0) - F.col("chance"), F.lit(0.0))).alias("chance_corrected"),
        )
    )
    paired = fitted.where(size > 1)
    scale = paired.agg(
        F.count("*").alias("n_items"),
        F.sum(size).alias("n_judgements"),
        F.sum(pairs / (size - 1)).alias("same"),
    ).select(
        "n_items",
        F.coalesce("n_judgements", F.lit(0)).alias("n_judgements"),
        (F.lit(1.0) - (F.lit(1.0) - F.col("same") / F.col("n_judgements")) / (1 - expected)).alias("alpha")
        if expected < 1
        else F.lit(None).cast("double").alias("alpha"),
    )
    return items, agents, scale


def _found(spark: SparkSession, data_dir: str, label: str):
    return consensus_of(read_table(spark, data_dir, "findings"), label, "passage_no", "agent_id", "recorded_at", "finding_id", "confidence")


def p2_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """The finding type of each passage that at least three agents judged."""
    items = _found(spark, data_dir, "finding_type")[0]
    return items.where("n_agents >= 3").select(F.col("item").alias("passage_no"), F.col("label").alias("finding_type"))


def p2_consensus(spark: SparkSession, data_dir: str) -> DataFrame:
    """Agreed finding type and severity of every judged passage and how far its agents agree."""
    kinds = _found(spark, data_dir, "finding_type")[0]
    levels = _found(spark, data_dir, "severity")[0].select(
        "item", F.col("label").alias("severity"), F.col("posterior").alias("severity_posterior"),
        F.col("agreement").alias("severity_agreement"),
    )
    return kinds.join(levels, "item", "full_outer").select(
        F.col("item").alias("passage_no"), F.col("label").alias("finding_type"), "posterior", "n_agents",
        "observed_agreement", "agreement", "severity", "severity_posterior", "severity_agreement",
    )


def p2_agents(spark: SparkSession, data_dir: str) -> DataFrame:
    """Reliability of every agent as to finding types."""
    return _found(spark, data_dir, "finding_type")[1].withColumnRenamed("agent", "agent_id")


def p2_agreement(spark: SparkSession, data_dir: str) -> DataFrame:
    """Chance-corrected agreement on finding types and on severity."""
    kinds = _found(spark, data_dir, "finding_type")[2].withColumn("scale", F.lit("finding_type"))
    return kinds.unionByName(_found(spark, data_dir, "severity")[2].withColumn("scale", F.lit("severity")))


QUERIES = {
    "p2_found": p2_found,
    "p2_consensus": p2_consensus,
    "p2_agents": p2_agents,
    "p2_agreement": p2_agreement,
}
