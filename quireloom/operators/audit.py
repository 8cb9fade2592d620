"""Source and target texts compared: five detectors as expressions, at most one finding of a type for a pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireloom.functions import extract as E
from quireloom.functions import predicates as P
from quireloom.functions.text import excerpt, let, plain_unit, sentence_count, shared_numeric_anchors, signature_token, strip

# Severity, whether fixable, confidence and reason by finding type.
FINDINGS = {
    "collapsed_numbered_list": ("high", True, 0.95, "Ordered list markers in source are not preserved as block items in target."),
    "list_structure_loss": ("high", True, 0.9, "Ordered list cardinality or block structure drifted between source and target."),
    "possible_omission": (
        "medium", False, 0.65,
        "Source contains additional structural units that are not represented in target; review for potential omissions.",
    ),
    "callout_candidate": (
        "medium", True, 0.75,
        "Source highlights a short quoted emphasis line with cue words; target may need explicit callout treatment.",
    ),
    "question_answer_structure": (
        "medium", False, 0.7,
        "Question/answer markers in source are not fully preserved in target; verify Q&A block structure.",
    ),
}
# Words that announce an emphasis.
CUES = r"(?i)\b(remember|note|important|key point|takeaway)\b"


def _finding(kind: str, source: Column, target: Column, signature: Column) -> Column:
    severity, fixable, confidence, reason = FINDINGS[kind]
    return F.struct(
        F.lit(kind).alias("finding_type"), F.lit(severity).alias("severity"), excerpt(source).alias("source_excerpt"),
        excerpt(target).alias("target_excerpt"), F.lit(reason).alias("reason"), F.lit(fixable).alias("auto_fixable"),
        F.lit(confidence).alias("confidence"), signature.alias("source_signature"),
    )


def list_signature(kind: str, numbers: Column) -> Column:
    run = F.array_join(F.slice(numbers, 1, 5).cast("array<string>"), "-")
    return F.concat(F.lit(f"{kind}:"), F.when(F.size(numbers) == 0, F.lit("none")).otherwise(run))


def omission_signature(units: Column) -> Column:
    tokens = F.slice(F.transform(units, lambda u: signature_token(u)), 1, 3)
    return F.concat(F.lit("possible_omission:"), F.size(units).cast("string"), F.lit(":"), F.array_join(tokens, "-"))


def mostly_present(units: Column, target: Column) -> Column:
    """Whether of the units of 6 or more plain characters at least four fifths are in the target."""

    def of(x: Column) -> Column:
        found = F.filter(x["checked"], lambda u: F.contains(x["plain"], u))
        return (F.size(x["checked"]) > 0) & (F.size(found) * 10 >= F.size(x["checked"]) * 8)

    checked = F.filter(F.transform(units, plain_unit), lambda u: F.length(u) >= 6)
    return let(F.struct(checked.alias("checked"), plain_unit(target).alias("plain")), of)


def relaxes_omission(crossed: Column, n_source: Column, n_target: Column, s_source: Column, s_target: Column, anchors: Column) -> Column:
    """Whether thresholds of units, sentences and shared numbers excuse fewer units in the target.

    The numbers are fixed values.
    """

    def part(n: Column, share: float, least: int) -> Column:
        return F.greatest(F.lit(least), F.floor(n * F.lit(share)))

    prose = (
        (n_target * 2 >= n_source)
        | ((s_source >= 3) & (s_target >= 2) & (n_source <= 6))
        | ((anchors >= 3) & (s_target >= part(s_source, 0.08, 4)))
        | ((s_source >= 8) & (n_target >= 8) & (s_target >= part(s_source, 0.2, 12)))
    )
    any_pair = (anchors >= 6) & (s_target >= part(s_source, 0.6, 12)) & (n_target >= part(n_source, 0.75, 8))
    return (n_source >= 3) & (n_target >= 2) & ((crossed & prose) | any_pair)


def audit_pairs(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Findings of pairs (keys, source_title, source_text, target_text), a narrow plan; null texts count as empty.

    Steps build on each other as columns, so that the units are worked out once.
    """
    none = F.lit("")
    base = pairs.select(
        *keys,
        F.coalesce("source_title", none).alias("__title"),
        F.coalesce("source_text", none).alias("__s"),
        F.coalesce("target_text", none).alias("__t"),
    )
    source, target = F.col("__s"), F.col("__t")
    steps = base.withColumns(
        {
            "__sn": E.block_numbers(source),
            "__tn": E.block_numbers(target),
            "__ss": sentence_count(source),
            "__ts": sentence_count(target),
            "__quotes": F.regexp_extract_all(source, F.lit("[\"“”]([^\\n]{12,140}?)[\"“”]"), F.lit(1)),
            "__q": E.question_marks(source),
            "__a": E.answer_marks(source),
        }
    )
    listed = P.counts_up(F.col("__sn"), 3)
    steps = steps.withColumns({"__listed": listed, "__kept": P.counts_up(F.col("__tn"), 3)})
    steps = steps.withColumn("__collapsed", F.col("__listed") & ~F.col("__kept") & E.has_inline_run(target, 3))
    # Units are only worked out where the sentence counts leave an omission possible.
    open_ = ~F.col("__collapsed") & ~((F.col("__ss") >= 3) & (F.col("__ts") >= F.col("__ss")))
    steps = steps.withColumn("__su", F.when(open_, E.structural_units(source, F.col("__title"))))
    steps = steps.withColumn("__su", E.body_units(F.col("__su")))
    steps = steps.withColumn("__tu", E.body_units(F.when(F.size("__su") >= 3, E.structural_units(target))))
    n_source, n_target = F.size("__su"), F.size("__tu")
    fewer = F.coalesce((n_source >= 3) & (n_target < n_source), F.lit(False))
    missing = F.when(fewer, F.slice("__su", n_target + 1, n_source - n_target))
    steps = steps.withColumn("__missing", missing)
    excused = relaxes_omission(
        P.crosses_languages(source, target), n_source, n_target, F.col("__ss"), F.col("__ts"), shared_numeric_anchors(source, target)
    ) | mostly_present(F.col("__missing"), target)
    steps = steps.withColumn("__omitted", F.when(F.col("__missing").isNotNull(), ~excused).otherwise(F.lit(False)))
    omitted, listed = F.col("__omitted"), F.col("__listed")
    quote = strip(F.get("__quotes", F.lit(0)))
    called = (F.size("__quotes") > 0) & F.regexp_like(source, F.lit(CUES)) & ~F.regexp_like(target, F.lit("[\"“”「」『』]"))
    asked = (F.col("__q") > 0) & (F.col("__a") > 0) & ~(
        (E.question_marks(target) >= F.col("__q")) & (E.answer_marks(target) >= F.col("__a"))
    )
    asked_signature = F.concat(
        F.lit("question_answer_structure:q"), F.col("__q").cast("string"), F.lit(":a"), F.col("__a").cast("string")
    )
    findings = F.array_compact(
        F.array(
            F.when(F.col("__collapsed"), _finding("collapsed_numbered_list", source, target, list_signature("collapsed_numbered_list", F.col("__sn")))),
            F.when(listed & (F.col("__sn") != F.col("__tn")), _finding("list_structure_loss", source, target, list_signature("list_structure_loss", F.col("__sn")))),
            F.when(omitted, _finding("possible_omission", F.array_join("__missing", "\n"), target, omission_signature(F.col("__missing")))),
            F.when(called, _finding("callout_candidate", quote, target, F.concat(F.lit("callout_candidate:"), signature_token(quote)))),
            F.when(asked, _finding("question_answer_structure", source, target, asked_signature)),
        )
    )
    return steps.select(*keys, F.inline(findings)).withColumn("agent_role", F.lit("audit"))
