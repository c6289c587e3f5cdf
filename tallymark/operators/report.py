"""Report tables: accuracy with colours, matrices, student rows, run headers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.dims import EXACT, PASS_FAIL, RUN_KEY, VALID_LABELS
from tallymark.functions.labels import accuracy_color, cell_color, percent_text


def accuracy_table(acc: DataFrame) -> DataFrame:
    """Truncated percent and background colour per concept and mode."""
    percent = F.col("accuracy") * 100
    return acc.where(~F.col("overall")).select(
        *RUN_KEY, "mode", "key_concept", percent_text(percent).alias("accuracy_text"), accuracy_color(percent).alias("color")
    )


def confusion_table(confused: DataFrame) -> DataFrame:
    """One row per actual label, one column per predicted label (exact mode)."""
    keys = [*RUN_KEY, "key_concept", "actual"]
    return (
        confused.where(F.col("mode") == EXACT)
        .groupBy(*keys)
        .pivot("predicted", VALID_LABELS)
        .agg(F.sum("n"))
    )


def student_rows(matched: DataFrame) -> DataFrame:
    """Per mode, every graded concept next to the human label, with its colour."""
    modes = matched.withColumn("mode", F.explode(F.array(F.lit(PASS_FAIL), F.lit(EXACT))))
    return modes.select(
        *RUN_KEY, "mode", "student_id", "key_concept", "observations",
        F.coalesce("evidence", F.lit("")).alias("evidence"),
        "actual", "predicted",
        cell_color(F.col("actual"), F.col("predicted"), F.col("mode")).alias("color"),
        "reason",
    )


def run_headers(acc: DataFrame, failed: DataFrame, params: DataFrame) -> DataFrame:
    """One row per run and mode: settings, overall accuracy, number of errors.

    A run in which every student failed has no accuracy and shows N/A.
    """
    overall = acc.where("overall").select(*RUN_KEY, "mode", "accuracy")
    modes = failed.withColumn("mode", F.explode(F.array(F.lit(PASS_FAIL), F.lit(EXACT))))
    settings = F.to_json(
        F.struct(
            F.col("dataset").alias("dataset_name"),
            F.col("experiment").alias("experiment_name"),
            F.col("lesson").alias("lesson_name"),
            F.struct("model", "num_responses", "temperature", "remove_comments", "response_type").alias("model_params"),
        )
    )
    return (
        modes.join(overall, [*RUN_KEY, "mode"], "left")
        .join(params, RUN_KEY, "left")
        .select(
            *RUN_KEY, "mode", settings.alias("input_params"),
            percent_text(F.col("accuracy") * 100).alias("overall_accuracy"),
            "n_students", "n_errors",
        )
    )
