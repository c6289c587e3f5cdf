"""The labelling plan: submissions and stored responses -> results per student."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.dims import RUN_KEY, STUDENT_KEY
from tallymark.functions import prompts
from tallymark.functions.text import is_blank, sanitize_code
from tallymark.operators import facts as fact_ops
from tallymark.operators import responses as response_ops
from tallymark.operators import rules
from tallymark.session import materialize

# Texts of results.
BLANK_TEXT = "The program is empty."
RULE_AGENT = "code feature extractor"
USAGE = ["prompt_tokens", "completion_tokens", "total_tokens"]
RESULT_COLUMNS = [*STUDENT_KEY, "model", "agent", "outcome", *USAGE, "seconds", "data"]


def rubric_concepts(rubric_levels: DataFrame) -> DataFrame:
    """Per run, the rubric's concepts in their order: one array per rubric."""
    first = rubric_levels.groupBy(*RUN_KEY, "key_concept").agg(F.min("ord").alias("ord"))
    ordered = F.array_sort(F.collect_list(F.struct("ord", "key_concept")))
    return first.groupBy(*RUN_KEY).agg(F.transform(ordered, lambda c: c["key_concept"]).alias("concepts"))


def run_settings(params: DataFrame, rubric_levels: DataFrame) -> DataFrame:
    """One stored row per run: its parameters and the rubric's concepts.

    Programs and responses are joined with it by the run key. Stored, its size is
    known, so that it is broadcast and the heavy side does not move for it.
    """
    names = ["model", "response_type", "remove_comments", "rule_concepts", "tree_lesson"]
    joined = params.select(*RUN_KEY, *names).join(rubric_concepts(rubric_levels), RUN_KEY, "left")
    return materialize(joined, "run-settings")


def prepare(submissions: DataFrame, params: DataFrame) -> DataFrame:
    """Submissions of known runs, comments removed where asked, blank ones flagged.

    Submissions that carry their run's settings are not joined with ``params``.
    """
    code = sanitize_code(F.col("code"), F.col("remove_comments"))
    if "rule_concepts" not in submissions.columns:
        settings = params.select(*RUN_KEY, "model", "remove_comments", "rule_concepts", "tree_lesson")
        submissions = submissions.join(settings, RUN_KEY)
    return (
        submissions.withColumn("code", code)
        .withColumn("blank", is_blank(F.col("code")))
    )


def blank_results(prepared: DataFrame, concepts: DataFrame) -> DataFrame:
    """No Evidence for every concept of an empty program."""
    rows = F.transform(
        "concepts",
        lambda c: F.struct(
            c.alias("key_concept"),
            F.lit(BLANK_TEXT).alias("observations"),
            F.lit("").alias("evidence"),
            F.lit("No Evidence").alias("label"),
            F.lit(BLANK_TEXT).alias("reason"),
        ),
    )
    blank = prepared.where("blank")
    blank = blank if "concepts" in prepared.columns else blank.join(concepts, RUN_KEY)
    return blank.select(
        *STUDENT_KEY, "model", F.lit("static").alias("agent"), F.lit("ok").alias("outcome"),
        *[F.lit(0).cast("bigint").alias(name) for name in USAGE],
        F.lit(0).cast("double").alias("seconds"), rows.alias("data"),
    )


def response_results(responses: DataFrame, settings: DataFrame) -> DataFrame:
    """Parse, check and vote every stored response of the runs in ``settings``.

    ``seconds``, how long the response took, is passed on where it is known. Responses
    that carry their run's settings are not joined with ``settings``.
    """
    if "seconds" not in responses.columns:
        responses = responses.withColumn("seconds", F.lit(None).cast("double"))
    if "concepts" not in responses.columns:
        settings = settings.where(F.col("concepts").isNotNull()).select(*RUN_KEY, "model", "response_type", "concepts")
        responses = responses.join(settings, RUN_KEY)
    provider = prompts.provider(F.col("model"))
    known = responses.withColumn(
        # Other providers always answer in JSON.
        "response_type", F.when(provider == "openai", F.col("response_type")).otherwise("json")
    )
    graded = response_ops.grade_responses(known)
    return graded.select(
        *STUDENT_KEY,
        F.when(provider.isNull(), "unknown_model").otherwise(F.col("outcome")).alias("outcome"),
        *[F.coalesce(F.col("usage")[name], F.lit(0).cast("bigint")).alias(name) for name in USAGE],
        "seconds",
        "data",
    )


def _override(data: Column, by_rule: Column) -> Column:
    """Rule rows replace the rows of the same concepts; other rule rows are unused."""

    def pick(row: Column) -> Column:
        ruled = F.get(F.filter(by_rule, lambda r: r["key_concept"] == row["key_concept"]), F.lit(0))
        return F.coalesce(ruled, row)

    return F.when(by_rule.isNull(), data).otherwise(F.transform(data, pick))


def rule_lists(rows: DataFrame) -> DataFrame:
    """Rule rows of one student as an array (at most one per rubric concept)."""
    row = F.struct(
        "key_concept", "observations", F.array_join("evidence", " ").alias("evidence"), "label", "reason"
    )
    return rows.groupBy(*STUDENT_KEY).agg(F.collect_list(row).alias("by_rule"))


def requested_rules(params: DataFrame, rubric_levels: DataFrame) -> DataFrame:
    """(run, tree_lesson, key_concept) to label by rule: listed and in the rubric."""
    listed = params.select(*RUN_KEY, "tree_lesson", F.explode("rule_concepts").alias("key_concept"))
    return listed.join(rubric_levels, [*RUN_KEY, "key_concept"], "left_semi")


def asked_results(cache: DataFrame, submissions: DataFrame) -> DataFrame:
    """The cached results of the students that were asked for."""
    return cache.join(submissions.select(*STUDENT_KEY), STUDENT_KEY, "left_semi")


def without_results(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows of students that have no cached result."""
    return rows.join(cache.select(*STUDENT_KEY), STUDENT_KEY, "left_anti")


def label_submissions(
    submissions: DataFrame,
    rubric_levels: DataFrame,
    params: DataFrame,
    responses: DataFrame,
    cache: DataFrame | None = None,
    facts: DataFrame | None = None,
    keep=None,
    settings: DataFrame | None = None,
    with_data: bool = True,
) -> DataFrame:
    """One result row per submission; failures are outcomes, not errors.

    Program text meets nothing but its own settings and statements, response
    text is parsed where it is read; only keys and result rows are joined.
    ``keep`` may store what several branches read: the submissions without their
    text (four times) and the scanned facts (three times). ``settings`` are the
    stored ``run_settings``, made here unless given; where every row is a run of its own,
    submissions and responses carry them instead (``plans.requests``). Without ``with_data`` the rows of
    results are NULL and no program is scanned: an outcome comes from the response.
    """
    keep = keep or (lambda df: df)
    if settings is None:
        settings = run_settings(params, rubric_levels)
    prepared = prepare(submissions, settings)
    if cache is not None:
        # Only results of students that were asked for; what is cached is not parsed again.
        cache = asked_results(cache, submissions)
        prepared = without_results(prepared, cache)
        responses = without_results(responses, cache)
    state = keep(prepared.drop("code"))
    live = state.where(~F.col("blank"))

    listed = (F.size("rule_concepts") > 0).alias("by_rules")
    results = live.select(*STUDENT_KEY, "model", listed).join(
        response_results(responses, settings), STUDENT_KEY, "left"
    )
    if with_data:
        requested = requested_rules(settings, rubric_levels)
        by_rules = F.size("rule_concepts") > 0
        if facts is None:
            facts = keep(fact_ops.facts(prepared.where(~F.col("blank") & by_rules), STUDENT_KEY))
        by_rule = rule_lists(rules.rule_rows(live.where(by_rules), facts, requested, rubric_levels))
        results = results.join(by_rule, STUDENT_KEY, "left")
        data = response_ops.sanitize_data(_override(F.col("data"), F.col("by_rule")))
    else:
        data = F.lit(None).cast(results.schema["data"].dataType)

    agent = F.concat(
        prompts.provider(F.col("model")),
        F.when(F.col("by_rules"), f", {RULE_AGENT}").otherwise(""),
    )
    answered = results.select(
        *STUDENT_KEY, "model", agent.alias("agent"),
        F.coalesce("outcome", F.lit("no_response")).alias("outcome"),
        *[F.coalesce(name, F.lit(0).cast("bigint")).alias(name) for name in USAGE],
        "seconds",
        data.alias("data"),
    )
    parts = [answered, blank_results(state, settings.where("concepts IS NOT NULL").select(*RUN_KEY, "concepts"))]
    if cache is not None:
        parts.append(cache)
    union = parts[0].select(*RESULT_COLUMNS)
    for part in parts[1:]:
        own = part.select(*[c for c in RESULT_COLUMNS if c in part.columns])
        union = union.unionByName(own, allowMissingColumns=True)
    return union


def result_envelope(assessed: DataFrame, bodies: DataFrame | None = None) -> DataFrame:
    """Results as published documents: {metadata, data}.

    metadata has agent, time (where known), student_id, and of what a provider
    answered its usage and, with ``bodies`` (student key and ``body``, as sent), the
    request. Rows of data go by their published names.
    """
    if bodies is not None:
        assessed = assessed.join(bodies.select(*STUDENT_KEY, F.col("body").alias("sent")), STUDENT_KEY, "left")
        request = F.from_json("sent", "model string, temperature double, messages array<struct<role string, content string>>, n int")
    else:
        request = F.lit(None).cast("struct<model:string>")
    asked = F.col("agent") != "static"
    metadata = F.struct(
        "agent",
        F.col("seconds").alias("time"),
        "student_id",
        F.when(asked, F.struct(*USAGE)).alias("usage"),
        F.when(asked, request).alias("request"),
    )
    data = F.transform(
        "data",
        lambda row: F.struct(
            row["key_concept"].alias("Key Concept"), row["observations"].alias("Observations"), row["evidence"].alias("Evidence"),
            row["label"].alias("Label"), row["reason"].alias("Reason"),
        ),
    )
    return assessed.select(*STUDENT_KEY, F.to_json(F.struct(metadata.alias("metadata"), data.alias("data"))).alias("result"))


def requests_table(submissions: DataFrame, params: DataFrame, prompts_table: DataFrame) -> DataFrame:
    """Bodies for an external caller: one per non-blank submission.

    ``prompts_table`` has the run key, prompt, rubric text and examples.
    """
    text = prompts_table.join(params.select(*RUN_KEY, "num_responses", "temperature"), RUN_KEY)
    live = prepare(submissions, params).where(~F.col("blank")).join(text, RUN_KEY)
    model = F.col("model")
    return live.select(
        *STUDENT_KEY,
        prompts.provider(model).alias("provider"),
        prompts.provider_model_id(model).alias("provider_model"),
        prompts.request_body(
            model, F.col("prompt"), F.col("rubric"), F.col("code"), F.col("examples"),
            F.col("num_responses"), F.col("temperature"),
        ).alias("body"),
    )
