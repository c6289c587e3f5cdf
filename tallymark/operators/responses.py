"""Stored responses -> checked choices -> outcome and voted rows, row by row.

One input row is one stored response with all its choices, so every step below
is a projection: nothing is shuffled however many responses there are, and the
same functions run on a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.dims import REQUIRED_COLUMNS, RESPONSE_TYPES, STUDENT_KEY, VALID_LABELS, lit_array
from tallymark.functions import answers, responses
from tallymark.functions.expressions import let, with_once
from tallymark.functions.text import sanitize_evidence

INVALID = ["invalid_json", "invalid_columns", "invalid_concepts", "invalid_label"]


def open_envelopes(raw: DataFrame) -> DataFrame:
    """Add http_outcome, choices and total_tokens; drops the body."""
    opened = with_once(raw, _env=responses.envelope(F.col("body")))
    env = F.col("_env")
    return opened.select(
        *[c for c in raw.columns if c != "body"],
        responses.http_outcome(F.col("http_status"), env).alias("http_outcome"),
        responses.choices(env).alias("choices"),
        env["usage"].alias("usage"),
        responses.total_tokens(env).alias("total_tokens"),
    )


# ---- one choice -------------------------------------------------------------


def _name_set(names: Column) -> Column:
    return F.array_join(F.array_sort(names), ", ")


def columns_error(rows: Column) -> Column:
    """NULL, or what the first row lacks when any row lacks a column."""
    required = lit_array(REQUIRED_COLUMNS)
    complete = F.forall(rows, lambda r: F.size(F.array_except(required, r["columns"])) == 0)
    first = F.get(rows, F.lit(0))["columns"]
    text = F.concat(
        F.lit("incorrect column names. unexpected: {"),
        _name_set(F.array_except(first, required)),
        F.lit("} missing: {"),
        _name_set(F.array_except(required, first)),
        F.lit("}"),
    )
    return F.when(~complete, text)


def concepts_error(rows: Column, concepts: Column) -> Column:
    """NULL, or the two-way difference between answered and rubric concepts."""
    got = F.array_distinct(F.transform(rows, lambda r: r["key_concept"]))
    unexpected, missing = F.array_except(got, concepts), F.array_except(concepts, got)

    def shown(names: Column) -> Column:
        return F.when(F.size(names) == 0, "None").otherwise(F.concat(F.lit("{"), _name_set(names), F.lit("}")))

    text = F.concat(
        F.lit("unexpected or missing key concept. unexpected: "), shown(unexpected),
        F.lit(" missing: "), shown(missing),
    )
    return F.when((F.size(unexpected) > 0) | (F.size(missing) > 0), text)


def label_error(rows: Column) -> Column:
    """NULL, or the first label outside the scale."""
    bad = F.filter(rows, lambda r: ~F.coalesce(r["label"].isin(VALID_LABELS), F.lit(False)))
    first = F.coalesce(F.get(bad, F.lit(0))["label"], F.lit("None"))
    return F.when(F.size(bad) > 0, F.concat(F.lit("invalid label value: '"), first, F.lit("'")))


def check_choices(df: DataFrame) -> DataFrame:
    """Parse and validate each choice.

    Needs ``choices``, ``response_type`` and ``concepts`` (the rubric's). Adds
    ``checked``: ARRAY<STRUCT<choice_index, status, error, rows>>. The first
    failing check names the status.
    """
    response_type = F.col("response_type")

    def parse(choice: Column, index: Column) -> Column:
        return F.struct(
            index.alias("choice_index"),
            choice["content"].alias("content"),
            choice["finish_reason"].isin("length", "max_tokens").alias("truncated"),
            answers.parse_rows(choice["content"], response_type).alias("rows"),
        )

    def drop_junk(choice: Column) -> Column:
        return F.struct(
            choice["choice_index"].alias("choice_index"),
            choice["content"].alias("content"),
            choice["truncated"].alias("truncated"),
            answers.has_null_concept(choice["rows"]).alias("broken"),
            answers.drop_junk_rows(choice["rows"]).alias("rows"),
        )

    def errors(choice: Column) -> Column:
        rows = choice["rows"]
        return F.struct(
            choice["choice_index"].alias("choice_index"),
            choice["content"].alias("content"),
            choice["truncated"].alias("truncated"),
            choice["broken"].alias("broken"),
            rows.alias("rows"),
            columns_error(rows).alias("columns_error"),
            concepts_error(rows, F.col("concepts")).alias("concepts_error"),
            label_error(rows).alias("label_error"),
        )

    def status(choice: Column) -> Column:
        unreadable = choice["rows"].isNull()
        not_objects = answers.is_json_array(answers.json_slice(choice["content"]))
        truncated = F.coalesce(choice["truncated"], F.lit(False))
        name = (
            F.when(F.coalesce(choice["content"], F.lit("")) == "", "empty")
            .when(~F.coalesce(response_type.isin(RESPONSE_TYPES), F.lit(False)), "exception")
            .when(unreadable & not_objects, "exception")
            .when(unreadable & truncated, "too_large")
            .when(unreadable, "invalid_json")
            .when(choice["broken"], "exception")
            .when(choice["columns_error"].isNotNull(), "invalid_columns")
            .when(choice["concepts_error"].isNotNull(), "invalid_concepts")
            .when(choice["label_error"].isNotNull(), "invalid_label")
            .otherwise("ok")
        )
        error = (
            F.when(unreadable, F.lit(None).cast("string"))
            .when(choice["broken"], "key concept without a value")
            .otherwise(
                F.coalesce(choice["columns_error"], choice["concepts_error"], choice["label_error"])
            )
        )
        return F.struct(
            choice["choice_index"].alias("choice_index"),
            name.alias("status"),
            error.alias("error"),
            choice["rows"].alias("rows"),
        )

    staged = F.transform("choices", parse)
    for step in (drop_junk, errors, status):
        staged = F.transform(staged, step)
    return with_once(df, checked=staged)


# ---- one response -----------------------------------------------------------


def _valid(checked: Column) -> Column:
    return F.filter(checked, lambda c: (c["status"] == "ok") & (F.size(c["rows"]) > 0))


def add_outcome(df: DataFrame) -> DataFrame:
    """Add ``outcome`` and ``valid`` (the valid choices' rows, one list per choice).

    Choices without text are passed over; one valid choice makes the response
    ok; without one, the last choice decides.
    """
    checked = F.col("checked")
    last = F.try_element_at(checked, F.lit(-1))["status"]
    outcome = (
        F.when(F.col("http_outcome") != "ok", F.col("http_outcome"))
        .when(F.col("choices").isNull(), "exception")
        .when(F.exists(checked, lambda c: c["status"] == "exception"), "exception")
        .when(F.size(_valid(checked)) > 0, "ok")
        .when(last == "too_large", "too_large")
        .otherwise("invalid")
    )
    return df.withColumn("outcome", outcome).withColumn(
        "valid", F.when(F.col("outcome") == "ok", F.transform(_valid(checked), lambda c: c["rows"]))
    )


def _result_row(key_concept, observations, evidence, label, reason) -> Column:
    return F.struct(
        key_concept.alias("key_concept"),
        observations.alias("observations"),
        evidence.alias("evidence"),
        label.alias("label"),
        reason.alias("reason"),
    )


def _evidence(row: Column) -> Column:
    # A cell that is there but empty of value is written as the word None.
    return F.coalesce(row["evidence"], F.lit("None"))


def _tally(votes: Column) -> Column:
    """Most frequent label; the one seen first wins a tie."""
    labels = F.transform(votes, lambda v: v["label"])
    counted = F.transform(
        F.array_distinct(labels),
        lambda label, i: F.struct(
            F.size(F.filter(labels, lambda x: x == label)).alias("n"),
            (-i).alias("rank"),
            label.alias("label"),
        ),
    )
    return F.struct(
        votes.alias("votes"),
        labels.alias("labels"),
        F.array_max(counted)["label"].alias("majority"),
    )


def _consensus_row(tally: Column) -> Column:
    agreed = F.filter(tally["votes"], lambda v: v["label"] == tally["majority"])
    first, last = F.get(agreed, F.lit(0)), F.try_element_at(agreed, F.lit(-1))
    shown = F.concat(F.lit("<b>Votes: ["), F.array_join(tally["labels"], ", "), F.lit("]</b><br>"))
    disputed = F.size(F.array_distinct(tally["labels"])) > 1
    return _result_row(
        first["key_concept"],
        first["observations"],
        F.when(first["has_evidence"], _evidence(first)).otherwise(""),
        tally["majority"],
        F.concat(F.when(disputed, shown).otherwise(""), F.coalesce(last["reason"], F.lit("None"))),
    )


def add_votes(df: DataFrame) -> DataFrame:
    """Add ``tallies``: per concept, in order of first appearance, its votes."""
    rows = F.flatten("valid")

    def grouped(all_rows: Column) -> Column:
        return F.transform(
            F.array_distinct(F.transform(all_rows, lambda r: r["key_concept"])),
            lambda name: F.filter(all_rows, lambda r: r["key_concept"] == name),
        )

    groups = let(rows, grouped)
    return df.withColumn("tallies", F.transform(groups, _tally))


def add_consensus(df: DataFrame) -> DataFrame:
    """Add ``data``: the voted rows, or the single valid choice as it is."""
    single = F.transform(
        F.get("valid", F.lit(0)),
        lambda r: _result_row(
            r["key_concept"],
            r["observations"],
            F.when(r["has_evidence"], _evidence(r)),
            r["label"],
            r["reason"],
        ),
    )
    voted = F.transform("tallies", _consensus_row)
    return with_once(df, data=F.when(F.size("valid") == 1, single).when(F.size("valid") > 1, voted))


def sanitize_data(data: Column) -> Column:
    """Clean the evidence of every result row."""
    return F.transform(data, lambda r: r.withField("evidence", sanitize_evidence(r["evidence"])))


def grade_responses(raw: DataFrame) -> DataFrame:
    """From body text to outcome and voted rows.

    ``raw`` needs http_status, body, response_type and concepts. Adds usage,
    total_tokens, outcome, checked, tallies, valid and data.
    """
    return add_consensus(add_votes(add_outcome(check_choices(open_envelopes(raw)))))


# ---- long views -------------------------------------------------------------


def choice_statuses(graded: DataFrame, keys: list[str] = STUDENT_KEY) -> DataFrame:
    """One row per choice: its status and error."""
    return graded.select(*keys, F.explode("checked").alias("c")).select(
        *keys,
        F.col("c.choice_index").alias("choice_index"),
        F.col("c.status").alias("status"),
        F.col("c.error").alias("error"),
    )


def answer_rows(graded: DataFrame, keys: list[str] = STUDENT_KEY) -> DataFrame:
    """One row per parsed row of every readable choice."""
    return (
        graded.select(*keys, F.explode("checked").alias("c"))
        .select(*keys, F.col("c.choice_index").alias("choice_index"), F.posexplode("c.rows").alias("row_index", "r"))
        .select(
            *keys, "choice_index", "row_index",
            "r.key_concept", "r.observations", "r.evidence", "r.has_evidence", "r.label", "r.reason", "r.columns",
        )
    )


def outvoted(graded: DataFrame, keys: list[str] = STUDENT_KEY) -> DataFrame:
    """Concepts of voted responses whose first label lost."""
    return (
        graded.where(F.size("valid") > 1)
        .select(*keys, F.explode("tallies").alias("t"))
        .select(
            *keys,
            F.get("t.votes", F.lit(0))["key_concept"].alias("key_concept"),
            F.get("t.labels", F.lit(0)).alias("first_label"),
            F.col("t.majority").alias("majority_label"),
        )
        .where("first_label <> majority_label")
    )


def result_rows(assessed: DataFrame, keys: list[str] = STUDENT_KEY) -> DataFrame:
    """One row per student and concept of ``data``, with its position."""
    return assessed.select(*keys, F.posexplode("data").alias("pos", "r")).select(*keys, "pos", "r.*")
