"""The evaluation plan: label all runs, compare with human labels, report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.dims import RUN_KEY, STUDENT_KEY
from tallymark.functions.prompts import option_or_param
from tallymark.operators import metrics, report, validate
from tallymark.operators.responses import result_rows
from tallymark.session import materialize
from tallymark.sources.writers import label_sheets


def predicted_labels(assessed: DataFrame) -> DataFrame:
    """Rows of the students that have a result."""
    return result_rows(assessed.where(F.col("outcome") == "ok"), STUDENT_KEY)


def run_options(params: DataFrame, **options) -> DataFrame:
    """Parameters with the options of this evaluation over them.

    An option (model, num_responses, temperature, remove_comments) that is missing,
    zero or empty leaves the parameter as it is.
    """
    known = {f.name: f.dataType for f in params.schema}
    over = {
        name: option_or_param(F.lit(value).cast(known[name]), F.col(name))
        for name, value in options.items()
        if value is not None and name in known
    }
    return params.withColumns(over) if over else params


def input_checks(
    raw_params: DataFrame, rubric_levels: DataFrame, actual: DataFrame, submissions: DataFrame, examples: DataFrame | None = None
) -> dict[str, DataFrame]:
    """What is wrong with the inputs, before anything is labelled; empty tables when all is well.

    ``raw_params`` has the run key and ``params`` as read, ``actual`` the run key,
    student_id, key_concept and label.
    """
    rubric = rubric_levels.select(*RUN_KEY, "key_concept", "ord").distinct()
    checks = {
        "param_problems": validate.param_problems(raw_params),
        "concept_mismatches": validate.concept_mismatches(rubric, actual.select(*RUN_KEY, "key_concept").distinct()),
        "students_without_labels": validate.students_without_labels(submissions, actual.select(*STUDENT_KEY).distinct()),
        "unsupported_lessons": validate.unsupported_lessons(raw_params.select(*RUN_KEY)),
    }
    if examples is not None:
        checks["example_mismatches"] = validate.example_mismatches(examples, rubric)
    return checks


def evaluate_runs(
    assessed: DataFrame,
    actual: DataFrame,
    params: DataFrame,
    thresholds: DataFrame | None = None,
    checks: dict[str, DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """Every table of an evaluation, for all runs at once, with those of ``checks``.

    ``assessed`` is read by several tables; store it first (``write_cache`` or
    ``materialize``) when the labelling is costly. The counted label pairs are stored
    here, so the metrics' tables do not match the labels again.
    """
    predicted = predicted_labels(assessed)
    matched = metrics.match_labels(predicted, actual)
    pairs = metrics.in_both_modes(materialize(metrics.label_pairs(matched), "label-pairs"))
    acc = metrics.accuracy(pairs)
    by_concept = metrics.confusion(pairs)
    failed = metrics.failed_students(assessed)
    stats = metrics.predicted_class_stats(by_concept)
    tables = {
        "accuracy_counts": acc,
        "accuracy": report.accuracy_table(acc),
        "confusion": by_concept,
        "overall_confusion": metrics.confusion(pairs, overall=True),
        "students": report.student_rows(matched),
        "headers": report.run_headers(acc, failed, params),
        "errors": assessed.where(F.col("outcome") != "ok").select(*STUDENT_KEY, "outcome"),
        "unmatched": metrics.unmatched_labels(predicted, actual),
        "confidence_pass_fail": metrics.pass_fail_confidence(acc),
        "confidence_exact": metrics.exact_confidence(stats),
    }
    if thresholds is not None:
        checked = metrics.against_thresholds(acc, thresholds)
        tables["thresholds"] = checked
        tables["gate"] = metrics.gate(metrics.threshold_failures(checked))
    return tables | (checks or {})


def new_labels(assessed: DataFrame, rubric_levels: DataFrame) -> DataFrame:
    """The new-labels sheets of all runs, with the concepts of their own rubrics.

    No comparison is made. One scan of the results serves all runs
    (``write_label_sheets`` gives every run its file).
    """
    return label_sheets(predicted_labels(assessed), rubric_levels)
