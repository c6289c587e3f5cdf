"""Requests: every row is a run of its own, with the settings its form gives.

A form carries the program, prompt, rubric (as CSV text), examples and parameters of
one request. Its rubric becomes levels and concepts, its rule text the concepts to
label by rule, and the labelling plan runs over all requests of a batch at once, with
the request as run key. What a request lacks is a status, not an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.dims import RUN_KEY, STUDENT_KEY, VALID_LABELS
from tallymark.functions import answers, prompts
from tallymark.operators import validate
from tallymark.plans import label

# What stands in the run key of a request, besides its id and lesson.
DATASET = "requests"
# Outcomes of requests that are refused before anything is labelled.
REFUSED = "bad_request"
NO_CONCEPTS = "rubric has no key concepts"


def _rubric_rows(rubric: Column) -> Column:
    """(ord, key_concept, descriptors) of every row of a rubric text."""

    def row(entries: Column, at: Column) -> Column:
        cells = [x for name in VALID_LABELS for x in (F.lit(name), answers.cell(entries, name))]
        return F.struct(at.alias("ord"), answers.cell(entries, "Key Concept").alias("key_concept"), F.create_map(*cells).alias("descriptors"))

    return F.filter(F.transform(answers.sheet_rows(rubric), row), lambda r: r["key_concept"].isNotNull())


def request_fields(requests: DataFrame, passed: list[str] | None = None) -> DataFrame:
    """The fields of ``validate.read_requests`` with run key, rubric rows and concepts.

    ``requests`` has request_id and ``form``. A rubric without a concept is refused.
    """
    fields = validate.read_requests(requests, passed).withColumn("rubric_rows", _rubric_rows(F.col("rubric")))
    names = F.transform("rubric_rows", lambda r: r["key_concept"])
    none = (F.col("status") == "ok") & (F.size(names) < 1)
    return (
        fields.withColumn("concepts", F.array_distinct(names))
        .withColumn("status", F.when(none, NO_CONCEPTS).otherwise(F.col("status")))
        .withColumn("rule_concepts", validate.requested_concepts(F.col("rule_text"), F.col("concepts")))
        .withColumn("by_rules", F.coalesce(F.col("rule_text") != "", F.lit(False)))
        .withColumn("dataset", F.lit(DATASET))
        .withColumn("experiment", F.col("request_id"))
        .withColumn("student_id", F.col("request_id"))
        .withColumn("tree_lesson", F.col("lesson"))
        .withColumn("lesson", F.coalesce("lesson", F.lit("")))
    )


def label_requests(requests: DataFrame, keep=None) -> DataFrame:
    """One result per request: request_id, message and the columns of a result.

    ``requests`` has request_id (distinct), ``form``, and of the answer http_status,
    body and, where known, seconds. Outcome is ``bad_request`` for a form that cannot
    be used, with ``message`` saying why; everything else is as in
    ``label.label_submissions``. ``keep`` may store what several branches read. Programs
    and answers carry the settings of their own row, so that no text is joined.
    """
    keep = keep or (lambda df: df)
    answer = [c for c in ("http_status", "body", "seconds") if c in requests.columns]
    fields = keep(request_fields(requests, answer))
    good = fields.where("status = 'ok'")
    # Only concepts that are labelled by rule are looked up.
    ruled = good.select(*RUN_KEY, "rule_concepts", F.inline("rubric_rows")).where(F.expr("array_contains(rule_concepts, key_concept)"))
    levels = ruled.select(*RUN_KEY, "key_concept", "ord", F.explode("descriptors").alias("label", "descriptor"))
    settings = good.select(
        *RUN_KEY, "model", "response_type", "remove_comments", "rule_concepts", "tree_lesson", "concepts"
    )
    programs = good.select(*STUDENT_KEY, "code", *[c for c in settings.columns if c not in RUN_KEY])
    responses = good.where(F.col("http_status").isNotNull()).select(*STUDENT_KEY, "model", "response_type", "concepts", *answer)
    labelled = label.label_submissions(programs, levels, settings, responses, keep=keep, settings=settings)
    # The rules are named even if the text names no concept of the rubric.
    silent = good.where(F.col("by_rules") & (F.size("rule_concepts") == 0)).select(*STUDENT_KEY, F.lit(True).alias("silent"))
    agent = F.when(
        F.col("silent") & (F.col("agent") != "static"), F.concat("agent", F.lit(f", {label.RULE_AGENT}"))
    ).otherwise(F.col("agent"))
    done = labelled.join(silent, STUDENT_KEY, "left").withColumn("agent", agent).drop("silent")
    bad = fields.where("status <> 'ok'").select(
        *STUDENT_KEY, "model", F.lit(REFUSED).alias("outcome"), F.col("status").alias("message")
    )
    out = done.withColumn("message", F.lit(None).cast("string")).unionByName(bad, allowMissingColumns=True)
    return out.select(F.col("student_id").alias("request_id"), "message", *label.RESULT_COLUMNS)


def request_bodies(requests: DataFrame) -> DataFrame:
    """What a provider is sent for each usable request: the student key and ``body``."""
    good = request_fields(requests).where("status = 'ok'")
    body = prompts.request_body(
        F.col("model"), F.col("prompt"), F.col("rubric"), F.col("code"), F.col("examples"), F.col("num_responses"), F.col("temperature")
    )
    return good.select(*STUDENT_KEY, body.alias("body"))


def published(requests: DataFrame, results: DataFrame) -> DataFrame:
    """request_id and the published document of every request that was labelled."""
    good = results.where("outcome = 'ok'")
    documents = label.result_envelope(good, request_bodies(requests))
    return documents.select(F.col("student_id").alias("request_id"), "result")
