"""Checks of inputs. Each gives rows that say what is wrong, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.dims import (
    ALLOWED_PARAMS,
    DEFAULT_MODEL,
    DEPRECATED_PARAMS,
    LESSONS,
    REQUIRED_PARAMS,
    RESPONSE_TYPES,
    RUN_KEY,
    STUDENT_KEY,
    SUPPORTED_MODELS,
    lit_array,
)
from tallymark.functions import answers


def param_problems(params: DataFrame) -> DataFrame:
    """Missing, unsupported or deprecated keys, models and response types.

    ``params`` has the run key and ``params`` MAP<STRING, STRING> as read.
    """
    keys, given = F.map_keys("params"), F.col("params")

    def flag(names: Column, problem: str) -> Column:
        return F.transform(names, lambda k: F.struct(k.alias("param"), F.lit(problem).alias("problem")))

    def bad_value(key: str, allowed: list[str], problem: str) -> Column:
        value = given[key]
        return F.when(value.isNotNull() & ~value.isin(allowed), F.array(F.lit(key))).otherwise(
            F.array().cast("array<string>")
        )

    found = F.concat(
        flag(F.array_except(lit_array(REQUIRED_PARAMS), keys), "missing"),
        flag(F.array_except(keys, lit_array(ALLOWED_PARAMS)), "unsupported"),
        flag(F.array_intersect(keys, lit_array(DEPRECATED_PARAMS)), "deprecated"),
        flag(bad_value("model", SUPPORTED_MODELS, ""), "unsupported value"),
        flag(bad_value("response-type", RESPONSE_TYPES, ""), "unsupported value"),
    )
    return params.select(*RUN_KEY, F.inline(found))


def concept_mismatches(rubric: DataFrame, actual: DataFrame) -> DataFrame:
    """Concepts of the rubric and of the label sheet that are not one to one."""
    key = [*RUN_KEY, "key_concept"]
    in_rubric = rubric.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rubric"))
    in_sheet = actual.groupBy(*key).agg(F.lit(1).alias("n_labels"))
    counts = [F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in ("n_rubric", "n_labels")]
    return in_rubric.join(in_sheet, key, "full_outer").select(*key, *counts).where("n_rubric <> n_labels")


def students_without_labels(submissions: DataFrame, actual: DataFrame) -> DataFrame:
    """Submitted students the label sheet does not know; the reverse is fine."""
    return submissions.select(*STUDENT_KEY).distinct().join(actual, STUDENT_KEY, "left_anti")


def unsupported_lessons(requested: DataFrame, supported: list[str] | None = None) -> DataFrame:
    names = LESSONS if supported is None else supported
    return requested.where(~F.coalesce(F.col("lesson").isin(names), F.lit(False)))


def example_mismatches(examples: DataFrame, rubric: DataFrame) -> DataFrame:
    """Examples whose concepts differ from the rubric's, as two-way difference.

    ``examples`` has the run key, example_id, answer and response_type.
    """
    concepts = rubric.groupBy(*RUN_KEY).agg(F.collect_set("key_concept").alias("concepts"))
    got = answers.example_concepts(F.col("answer"), F.col("response_type"))
    joined = examples.join(concepts, RUN_KEY).withColumn("got", got)
    known_type = F.coalesce(F.col("response_type").isin(RESPONSE_TYPES), F.lit(False))
    return joined.select(
        *RUN_KEY, "example_id",
        F.when(~known_type, "invalid response type").otherwise("mismatch").alias("problem"),
        F.array_sort(F.array_except("got", "concepts")).alias("unexpected"),
        F.array_sort(F.array_except("concepts", "got")).alias("missing"),
    ).where((F.size("unexpected") > 0) | (F.size("missing") > 0) | (F.col("problem") != "mismatch"))


# Defaults of a request's form fields (fixed values).
REQUEST_DEFAULTS = {
    "examples": "[]",
    "model": DEFAULT_MODEL,
    "remove-comments": "0",
    "num-responses": "1",
    "temperature": "0.2",
    "response-type": "tsv",
}


def read_requests(forms: DataFrame, passed: list[str] | None = None) -> DataFrame:
    """Request fields with defaults and a status: ok or what is wrong.

    ``forms`` has request_id and ``form`` MAP<STRING, STRING>; columns ``passed`` go along.
    """
    form = F.col("form")

    def field(name: str) -> Column:
        given = form[name]
        return F.coalesce(given, F.lit(REQUEST_DEFAULTS[name])) if name in REQUEST_DEFAULTS else given

    n, temperature = (
        field("num-responses").try_cast("int"),
        field("temperature").try_cast("double"),
    )
    examples = F.from_json(field("examples"), "array<array<string>>")
    status = F.lit("ok")
    status = F.when(n.isNull() | temperature.isNull(), "not a number").otherwise(status)
    for name in ("rubric", "prompt", "code"):
        status = F.when(field(name).isNull(), f"{name} is required").otherwise(status)
    return forms.select(
        "request_id",
        field("code").alias("code"),
        field("prompt").alias("prompt"),
        field("rubric").alias("rubric"),
        F.transform(
            examples, lambda e: F.struct(F.get(e, F.lit(0)).alias("code"), F.get(e, F.lit(1)).alias("answer"))
        ).alias("examples"),
        field("model").alias("model"),
        (field("remove-comments") != "0").alias("remove_comments"),
        n.alias("num_responses"),
        temperature.alias("temperature"),
        field("response-type").alias("response_type"),
        F.filter(
            F.transform(F.split(field("code-feature-extractor"), ","), lambda c: F.trim(c)), lambda c: c != ""
        ).alias("rule_concepts"),
        # As a request gives it; its concepts are found in the text (``requested_concepts``).
        field("code-feature-extractor").alias("rule_text"),
        field("lesson").alias("lesson"),
        status.alias("status"),
        *(passed or []),
    )


def requested_concepts(rule_text: Column, concepts: Column) -> Column:
    """Those of ``concepts`` whose name stands anywhere in the text, commas and all."""
    return F.filter(concepts, lambda c: F.coalesce(F.contains(rule_text, c), F.lit(False)))


def without_data(assessed: DataFrame) -> DataFrame:
    """Results without a list of rows."""
    return assessed.where(F.col("data").isNull())
