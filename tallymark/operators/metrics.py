"""Agreement between predicted and human labels, confidence and gates.

The only pass over the label rows is ``label_pairs``: it counts (actual,
predicted) pairs per run and concept with map-side aggregation. Both modes,
both levels, matrices, precision and gates read that small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.dims import (
    EXACT,
    PASS_FAIL,
    PASS_FAIL_CLASSES,
    RUN_KEY,
    VALID_LABELS,
)
from tallymark.functions.labels import pass_fail_class

PAIR_KEY = RUN_KEY + ["key_concept"]


def match_labels(predicted: DataFrame, actual: DataFrame) -> DataFrame:
    """Predicted rows with the human label of the same student and concept."""
    on = RUN_KEY + ["student_id", "key_concept"]
    human = actual.select(*on, F.col("label").alias("actual"))
    return predicted.withColumnRenamed("label", "predicted").join(human, on, "inner")


def unmatched_labels(predicted: DataFrame, actual: DataFrame) -> DataFrame:
    """Predictions without a human label: a violation, reported as rows."""
    return predicted.join(actual, RUN_KEY + ["student_id", "key_concept"], "left_anti")


def label_pairs(matched: DataFrame) -> DataFrame:
    """Count of every (actual, predicted) pair per run and concept."""
    return matched.groupBy(*PAIR_KEY, "actual", "predicted").agg(F.count(F.lit(1)).alias("n"))


def in_both_modes(pairs: DataFrame) -> DataFrame:
    """The pairs once with their classes (pass_fail) and once as they are (exact)."""

    def as_mode(name: str, actual: Column, predicted: Column) -> Column:
        return F.struct(F.lit(name).alias("mode"), actual.alias("actual"), predicted.alias("predicted"))

    actual, predicted = F.col("actual"), F.col("predicted")
    both = F.array(
        as_mode(PASS_FAIL, pass_fail_class(actual), pass_fail_class(predicted)),
        as_mode(EXACT, actual, predicted),
    )
    return pairs.select(*PAIR_KEY, F.explode(both).alias("m"), "n").select(*PAIR_KEY, "m.*", "n")


def accuracy(mode_pairs: DataFrame) -> DataFrame:
    """Share of equal labels per concept, and pooled over all rows (key_concept NULL)."""
    equal = F.coalesce(F.col("actual") == F.col("predicted"), F.lit(False))
    return (
        mode_pairs.groupingSets(
            [
                [*[F.col(c) for c in RUN_KEY], F.col("mode"), F.col("key_concept")],
                [*[F.col(c) for c in RUN_KEY], F.col("mode")],
            ],
            *RUN_KEY,
            "mode",
            "key_concept",
        )
        .agg(
            (F.grouping("key_concept") == 1).alias("overall"),
            F.sum("n").alias("n"),
            F.sum(F.when(equal, F.col("n")).otherwise(0)).alias("n_equal"),
        )
        .withColumn("accuracy", F.col("n_equal") / F.col("n"))
    )


def _cell_counts(classes: list[str]) -> Column:
    """One counted struct per cell of the matrix; labels off the scale are in none."""
    return F.array(
        *[
            F.struct(
                F.lit(a).alias("actual"),
                F.lit(p).alias("predicted"),
                F.coalesce(
                    F.sum(F.when((F.col("actual") == a) & (F.col("predicted") == p), F.col("n"))),
                    F.lit(0),
                ).alias("n"),
            )
            for a in classes
            for p in classes
        ]
    )


def confusion(mode_pairs: DataFrame, overall: bool = False) -> DataFrame:
    """Dense confusion counts: every class pair has a row, also when it is 0."""
    keys = RUN_KEY if overall else PAIR_KEY
    parts = []
    for mode, classes in ((PASS_FAIL, PASS_FAIL_CLASSES), (EXACT, VALID_LABELS)):
        parts.append(
            mode_pairs.where(F.col("mode") == mode)
            .groupBy(*keys, "mode")
            .agg(_cell_counts(classes).alias("cells"))
            .select(*keys, "mode", F.inline("cells"))
        )
    return parts[0].unionByName(parts[1])


def predicted_class_stats(confused: DataFrame) -> DataFrame:
    """Per predicted class: how often it was predicted and how often rightly."""
    right = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    return (
        confused.groupBy(*PAIR_KEY, "mode", F.col("predicted").alias("label"))
        .agg(F.sum("n").alias("n"), right.alias("n_right"))
        .withColumn("precision", F.coalesce(F.try_divide("n_right", "n"), F.lit(0.0)))
    )


# The confidence cut-offs.
def pass_fail_confidence(acc: DataFrame) -> DataFrame:
    score = F.col("accuracy")
    level = F.when(score >= 0.85, "HIGH").when(score >= 0.8, "MEDIUM").otherwise("LOW")
    return (
        acc.where((F.col("mode") == PASS_FAIL) & ~F.col("overall"))
        .select(*PAIR_KEY, "accuracy", level.alias("level"))
    )


def exact_confidence(stats: DataFrame) -> DataFrame:
    sure = (F.col("precision") >= 0.88) & (F.col("n") >= 10)
    return stats.where(F.col("mode") == EXACT).select(
        *PAIR_KEY, "label", "n", "precision", F.when(sure, "HIGH").otherwise("LOW").alias("level")
    )


def against_thresholds(acc: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Exact accuracies with their threshold: met, below, or without a threshold.

    ``thresholds`` has lesson, key_concept (NULL for overall), min_accuracy.
    """
    exact = acc.where(F.col("mode") == EXACT).select(*RUN_KEY, "key_concept", "accuracy")
    limit = F.col("min_accuracy")
    return (
        exact.alias("a")
        .join(
            thresholds.alias("t"),
            (F.col("a.lesson") == F.col("t.lesson"))
            & F.col("a.key_concept").eqNullSafe(F.col("t.key_concept")),
            "left",
        )
        .select(
            *[f"a.{c}" for c in RUN_KEY],
            "a.key_concept",
            F.col("accuracy").alias("accuracy_score"),
            limit.alias("threshold"),
            F.when(limit.isNull(), "missing").when(F.col("accuracy") < limit, "below").otherwise("met").alias("status"),
        )
    )


def threshold_failures(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("status") == "below").drop("status")


def gate(failures: DataFrame) -> DataFrame:
    """One row: passed when nothing is below its threshold."""
    return failures.agg(F.count(F.lit(1)).alias("n_failures")).select(
        "n_failures", (F.col("n_failures") == 0).alias("passed")
    )


def evaluate(predicted: DataFrame, actual: DataFrame) -> dict[str, DataFrame]:
    """All agreement tables from one pass over the labels."""
    pairs = in_both_modes(label_pairs(match_labels(predicted, actual)))
    acc = accuracy(pairs)
    by_concept = confusion(pairs)
    stats = predicted_class_stats(by_concept)
    return {
        "accuracy": acc,
        "confusion": by_concept,
        "overall_confusion": confusion(pairs, overall=True),
        "class_stats": stats,
        "confidence_pass_fail": pass_fail_confidence(acc),
        "confidence_exact": exact_confidence(stats),
    }


def failed_students(assessed: DataFrame) -> DataFrame:
    """Per run: how many students have no labels, and how many were asked."""
    failed = F.col("outcome") != "ok"
    return assessed.groupBy(*RUN_KEY).agg(
        F.count(F.lit(1)).alias("n_students"), F.count_if(failed).alias("n_errors")
    )


def usage_totals(assessed: DataFrame) -> DataFrame:
    """Tokens and seconds of the results per run and model; unknown times count as none."""
    optional = [c for c in ("prompt_tokens", "completion_tokens", "seconds") if c in assessed.columns]
    return assessed.groupBy(*RUN_KEY, "model").agg(
        F.count(F.lit(1)).alias("n_responses"),
        F.sum("total_tokens").alias("total_tokens"),
        F.avg("total_tokens").alias("avg_tokens"),
        *[F.sum(c).alias(c) for c in optional],
    )


def run_totals() -> dict[str, Column]:
    """What ``DataFrame.observe`` can gather while results are written: no second pass."""
    return {
        "n_results": F.count(F.lit(1)),
        "n_failed": F.count_if(F.col("outcome") != "ok"),
        "n_static": F.count_if(F.col("agent") == "static"),
        **{name: F.coalesce(F.sum(name), F.lit(0)) for name in ("prompt_tokens", "completion_tokens", "total_tokens")},
        "seconds": F.coalesce(F.sum("seconds"), F.lit(0.0)),
    }
