"""Queries over stored responses: parsing, checks, in-row votes (B17, C, E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.catalog.inputs import CTES, RUN, STUDENT, Inputs
from tallymark.catalog.registry import query
from tallymark.dims import LESSONS, RUN_KEY, STUDENT_KEY, SUPPORTED_MODELS
from tallymark.operators import responses, validate
from tallymark.plans.label import run_settings


def _known(i: Inputs):
    """Responses with the response type and rubric concepts of their run."""
    settings = run_settings(i.params(), i.rubric_levels()).where("concepts IS NOT NULL")
    return i.responses().join(settings.select(*RUN_KEY, "response_type", "concepts"), RUN_KEY)


def graded(i: Inputs):
    return responses.grade_responses(_known(i))


_SPOILT = "(variant = 0 AND choice = 0)"
CTES["parsed"] = f"""SELECT {STUDENT}, fmt, choice AS choice_index,
  k + CASE WHEN variant = 4 AND choice = 0 AND fmt <> 'md' THEN 1 ELSE 0 END AS row_index,
  CASE WHEN variant = 1 AND choice = 1 AND k = 2 THEN 'x' ELSE '' END || key_concept AS key_concept,
  observations, evidence, label, CASE WHEN NOT {_SPOILT} THEN reason END AS reason
  FROM answers a WHERE variant NOT IN (8, 9) AND NOT (variant = 7 AND choice = 1)
  AND NOT (variant = 2 AND choice = 2 AND fmt = 'json')
  AND NOT (variant = 6 AND choice = (SELECT max(c.choice) FROM answers c WHERE c.sid = a.sid))
  UNION ALL SELECT {STUDENT}, fmt, choice, 0, '-----', '-', '-', '-', '-' FROM answer_choice
  WHERE variant = 4 AND choice = 0 AND fmt <> 'md'"""
_PARSED = f"{STUDENT}, choice_index, row_index, key_concept, observations, evidence, label, reason"


def _answer_rows(i: Inputs, response_type: str):
    rows = responses.answer_rows(
        responses.check_choices(responses.open_envelopes(_known(i))).where(F.col("response_type") == response_type)
    )
    return rows.select(
        *STUDENT_KEY, F.col("choice_index").cast("bigint").alias("choice_index"),
        F.col("row_index").cast("bigint").alias("row_index"),
        "key_concept", "observations", "evidence", "label", "reason",
    )


@query("b17_tabular_rows", f"SELECT {_PARSED} FROM parsed WHERE fmt <> 'json'")
def _(i):
    return _answer_rows(i, "tsv")


@query("b17_json_rows", f"SELECT {_PARSED} FROM parsed WHERE fmt = 'json'")
def _(i):
    return _answer_rows(i, "json")


def _statuses(i: Inputs):
    return responses.choice_statuses(responses.check_choices(responses.open_envelopes(_known(i))))


def _with_status(i: Inputs, status: str):
    return _statuses(i).where(F.col("status") == status).select(
        *STUDENT_KEY, F.col("choice_index").cast("bigint").alias("choice_index"), "error"
    )


@query(
    "c1_column_errors",
    f"""SELECT {STUDENT}, choice AS choice_index, 'incorrect column names. unexpected: {{Evidence}} missing: {{Reason}}' AS error
    FROM choice_status WHERE status = 'invalid_columns'""",
)
def _(i):
    return _with_status(i, "invalid_columns")


CTES["rubric_list"] = f"SELECT {RUN}, string_agg(key_concept, ', ' ORDER BY key_concept) AS names FROM rubric GROUP BY {RUN}"


@query(
    "c2_concept_errors",
    f"""SELECT {STUDENT}, choice AS choice_index, 'unexpected or missing key concept. unexpected: ' ||
    CASE variant WHEN 1 THEN '{{x' || (SELECT any_value(a.key_concept) FROM answers a WHERE a.sid = c.sid AND a.k = 2) || '}} missing: {{' ||
    (SELECT any_value(a.key_concept) FROM answers a WHERE a.sid = c.sid AND a.k = 2) || '}}'
    WHEN 4 THEN '{{-----}} missing: None' ELSE 'None missing: {{' || names || '}}' END AS error
    FROM choice_status c JOIN rubric_list USING ({RUN}) WHERE status = 'invalid_concepts'""",
)
def _(i):
    return _with_status(i, "invalid_concepts")


@query(
    "c3_label_errors",
    f"SELECT {STUDENT}, choice AS choice_index, 'invalid label value: ''invalid label''' AS error FROM choice_status WHERE status = 'invalid_label'",
)
def _(i):
    return _with_status(i, "invalid_label")


@query("c4_choice_status", f"SELECT {STUDENT}, choice AS choice_index, status FROM choice_status")
def _(i):
    return _statuses(i).select(*STUDENT_KEY, F.col("choice_index").cast("bigint").alias("choice_index"), "status")


@query("c5_response_outcome", f"SELECT {STUDENT}, outcome, CAST(n_ok AS BIGINT) AS n_ok FROM outcomes")
def _(i):
    return graded(i).select(
        *STUDENT_KEY, "outcome", F.coalesce(F.size("valid"), F.lit(0)).cast("bigint").alias("n_ok")
    )


@query(
    "e6_row_votes",
    f"""SELECT {STUDENT}, key_concept, observations, evidence, label, reason FROM graded""",
)
def _(i):
    return graded(i).where(F.col("outcome") == "ok").select(*STUDENT_KEY, F.inline("data"))


@query(
    "e10_single_choice",
    f"SELECT {STUDENT}, key_concept, label, reason FROM ok_votes WHERE n_ok = 1",
)
def _(i):
    single = graded(i).where((F.col("outcome") == "ok") & (F.size("valid") == 1))
    return single.select(*STUDENT_KEY, F.inline("data")).select(*STUDENT_KEY, "key_concept", "label", "reason")


@query(
    "e11_row_outvoted",
    f"""SELECT {STUDENT}, key_concept, first_label, label AS majority_label FROM graded
    WHERE n_ok > 1 AND first_label <> label""",
)
def _(i):
    return responses.outvoted(graded(i))


# Parameters of a user: the keys present depend on the user's events.
_PARAM_SQL = {
    "model": f"CASE WHEN user_id % 3 = 0 THEN 'gpt-9' ELSE '{SUPPORTED_MODELS[0]}' END",
    "num-responses": "CASE WHEN event_type <> 'click' THEN '3' END",
    "temperature": "'0.2'",
    "num-passing-grades": "CASE WHEN event_type = 'view' THEN '2' END",
    "colour": "CASE WHEN event_type = 'error' THEN 'red' END",
    "response-type": "CASE WHEN event_type = 'signup' THEN 'xml' END",
}


@query(
    "c6_param_problems",
    """SELECT 'd' AS dataset, 'e' AS experiment, 'run' || event_id AS lesson, p.param, p.problem FROM events JOIN
    (VALUES ('num-responses', 'missing', 'click'), ('num-passing-grades', 'deprecated', 'view'),
    ('colour', 'unsupported', 'error'), ('response-type', 'unsupported value', 'signup'), ('model', 'unsupported value', '*'))
    AS p(param, problem, cause) ON p.cause = event_type OR (p.cause = '*' AND user_id % 3 = 0)""",
)
def _(i):
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.expr(v).alias("v")) for k, v in _PARAM_SQL.items()])
    present = F.map_from_entries(F.filter(pairs, lambda e: e["v"].isNotNull()))
    params = i.table("events").select(
        F.lit("d").alias("dataset"), F.lit("e").alias("experiment"),
        F.concat(F.lit("run"), "event_id").alias("lesson"), present.alias("params"),
    )
    return validate.param_problems(params)


@query(
    "c7_concept_mismatches",
    f"""SELECT {RUN}, key_concept, coalesce(r.n, 0) AS n_rubric, coalesce(s.n, 0) AS n_labels FROM
    (SELECT {RUN}, key_concept, count(*) AS n FROM (SELECT DISTINCT {RUN}, key_concept, choice_index % 2 AS part FROM votes) GROUP BY ALL) r
    FULL JOIN (SELECT DISTINCT {RUN}, 'KC' || (choice_index % 5) AS key_concept, 1 AS n FROM votes) s USING ({RUN}, key_concept)
    WHERE coalesce(r.n, 0) <> coalesce(s.n, 0)""",
)
def _(i):
    rubric = i.votes().selectExpr(*RUN_KEY, "key_concept", "choice_index % 2 AS part").distinct()
    sheet = i.votes().selectExpr(*RUN_KEY, "'KC' || (choice_index % 5) AS key_concept")
    return validate.concept_mismatches(rubric, sheet)


@query(
    "c8_students_without_labels",
    f"""SELECT DISTINCT {STUDENT} FROM votes EXCEPT SELECT {STUDENT} FROM votes WHERE value > 300""",
)
def _(i):
    return validate.students_without_labels(i.votes(), i.votes().where("value > 300"))


@query(
    "c9_example_mismatches",
    f"""SELECT {RUN}, student_id AS example_id, 'mismatch' AS problem, '' AS unexpected, key_concept AS missing
    FROM answers JOIN (SELECT sid, max(choice) AS choice FROM answers GROUP BY sid) l USING (sid, choice) WHERE k = 3 AND sid % 2 = 0""",
)
def _(i):
    # The last answer of every student as an example; some lack the fourth concept.
    row = F.struct("k", "key_concept", "label")
    last = i.answers().groupBy(*STUDENT_KEY, "sid", "choice").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    last = last.groupBy(*STUDENT_KEY, "sid").agg(F.max_by("rows", "choice").alias("rows"))
    kept = F.filter("rows", lambda r: (F.col("sid") % 2 == 1) | (r["k"] < 3))
    tsv = F.concat(
        F.lit("Key Concept\tGrade\n"),
        F.array_join(F.transform(kept, lambda r: F.concat(r["key_concept"], F.lit("\t"), r["label"])), "\n"),
    )
    listed = F.to_json(F.transform(kept, lambda r: F.struct(r["key_concept"].alias("Key Concept"))))
    is_json = F.col("sid") % 3 == 0
    examples = last.select(
        *RUN_KEY, F.col("student_id").alias("example_id"),
        F.when(is_json, listed).otherwise(tsv).alias("answer"),
        F.when(is_json, "json").otherwise("tsv").alias("response_type"),
    )
    found = validate.example_mismatches(examples, i.rubric_levels())
    return found.withColumn("unexpected", F.array_join("unexpected", ", ")).withColumn("missing", F.array_join("missing", ", "))


@query(
    "c10_unsupported_lessons",
    f"""SELECT doc_id, CASE WHEN lang = 'en' THEN '{LESSONS[1]}' ELSE lang END AS lesson FROM documents WHERE lang <> 'en'""",
)
def _(i):
    lesson = F.when(F.col("lang") == "en", LESSONS[1]).otherwise(F.col("lang"))
    return validate.unsupported_lessons(i.table("documents").select("doc_id", lesson.alias("lesson")))


@query(
    "c11_request_fields",
    """SELECT doc_id AS request_id, CASE doc_id % 5 WHEN 0 THEN 'code is required' WHEN 1 THEN 'prompt is required'
    WHEN 2 THEN 'rubric is required' WHEN 3 THEN 'not a number' ELSE 'ok' END AS status,
    CASE WHEN doc_id % 2 = 0 THEN 'gpt-4-0613' ELSE 'bedrock.us.anthropic.claude-sonnet-4-5-20250929-v1:0' END AS model,
    doc_id % 2 = 0 AS remove_comments, CASE WHEN doc_id % 5 = 3 THEN NULL ELSE doc_id END AS num_responses,
    0.2::DOUBLE AS temperature, 'tsv' AS response_type, CAST(1 AS BIGINT) AS n_examples, 'A|B c' AS rules, length(text) AS n_code
    FROM documents""",
)
def _(i):
    d, even = F.col("doc_id"), F.col("doc_id") % 2 == 0
    fields = {
        "code": F.when(d % 5 != 0, F.col("text")),
        "prompt": F.when(d % 5 != 1, F.lit("p")),
        "rubric": F.when(d % 5 != 2, F.lit("r")),
        "num-responses": F.when(d % 5 == 3, "many").otherwise(d.cast("string")),
        "examples": F.lit('[["var x", "Key Concept"]]'),
        "model": F.when(even, "gpt-4-0613"),
        "remove-comments": F.when(even, "1"),
        "code-feature-extractor": F.lit("A, B c"),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in fields.items()])
    forms = i.table("documents").select(
        d.alias("request_id"), "text",
        F.map_from_entries(F.filter(pairs, lambda e: e["v"].isNotNull())).alias("form"),
    )
    read = validate.read_requests(forms).join(forms.select("request_id", F.length("text").alias("n_code")), "request_id")
    return read.select(
        "request_id", "status", "model", "remove_comments", F.col("num_responses").cast("bigint").alias("num_responses"),
        "temperature", "response_type", F.size("examples").cast("bigint").alias("n_examples"),
        F.array_join("rule_concepts", "|").alias("rules"), F.col("n_code").cast("bigint").alias("n_code"),
    )


@query(
    "c12_results_without_data",
    f"SELECT {STUDENT}, outcome FROM outcomes WHERE outcome <> 'ok'",
)
def _(i):
    return validate.without_data(graded(i)).select(*STUDENT_KEY, "outcome")


@query(
    "e13_failed_students",
    f"""SELECT {RUN}, count(*) AS n_students, CAST(sum(CAST(outcome <> 'ok' AS INT)) AS BIGINT) AS n_errors FROM outcomes GROUP BY {RUN}""",
)
def _(i):
    from tallymark.operators.metrics import failed_students

    return failed_students(graded(i))


@query(
    "e19_usage_totals",
    f"""SELECT {RUN}, 'gpt-4-0613' AS model, count(*) AS n_responses, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
    round(avg(total_tokens), 6) AS avg_tokens, CAST(sum(length(student_id) + 0.25) AS DOUBLE) AS seconds FROM outcomes GROUP BY {RUN}""",
)
def _(i):
    from tallymark.operators.metrics import usage_totals
    from tallymark.plans.label import response_results

    timed = i.responses().withColumn("seconds", (F.length("student_id") + F.lit(0.25)).cast("double"))
    settings = run_settings(i.params(), i.rubric_levels())
    results = response_results(timed, settings).join(settings.select(*RUN_KEY, "model"), RUN_KEY)
    return usage_totals(results).drop("prompt_tokens", "completion_tokens").withColumn("avg_tokens", F.round("avg_tokens", 6))


@query(
    "j11_concepts_in_a_text",
    "SELECT doc_id, CAST(len(list_filter(['the', 'of, the', 'th', 'and, or', lang, 'xq'], lambda c: contains(text, c))) AS BIGINT) AS n FROM documents",
)
def _(i):
    """Which names stand in a request's text: a substring test, commas and all."""
    names = F.array(*[F.lit(x) for x in ("the", "of, the", "th", "and, or")], F.col("lang"), F.lit("xq"))
    return i.table("documents").select("doc_id", F.size(validate.requested_concepts(F.col("text"), names)).cast("bigint").alias("n"))


@query(
    "g1_concept_differences",
    f"""SELECT {STUDENT}, choice AS choice_index, CASE WHEN variant = 1 THEN 'x' || (SELECT any_value(a.key_concept) FROM answers a
    WHERE a.sid = c.sid AND a.k = 2) WHEN variant = 4 THEN '-----' ELSE '' END AS unexpected
    FROM choice_status c WHERE status = 'invalid_concepts'""",
)
def _(i):
    checked = responses.check_choices(responses.open_envelopes(_known(i)))
    rows = checked.select(*STUDENT_KEY, "concepts", F.inline("checked")).where(F.col("status") == "invalid_concepts")
    got = F.array_distinct(F.transform("rows", lambda r: r["key_concept"]))
    return rows.select(
        *STUDENT_KEY, F.col("choice_index").cast("bigint").alias("choice_index"),
        F.array_join(F.array_sort(F.array_except(got, F.col("concepts"))), ", ").alias("unexpected"),
    )


@query(
    "g2_required_columns",
    f"SELECT {STUDENT}, choice AS choice_index, CAST(3 AS BIGINT) AS n_shared FROM choice_status WHERE status = 'invalid_columns'",
)
def _(i):
    from tallymark.dims import REQUIRED_COLUMNS, lit_array

    checked = responses.check_choices(responses.open_envelopes(_known(i)))
    rows = checked.select(*STUDENT_KEY, F.inline("checked")).where(F.col("status") == "invalid_columns")
    shared = F.array_intersect(F.get("rows", F.lit(0))["columns"], lit_array(REQUIRED_COLUMNS))
    return rows.select(
        *STUDENT_KEY, F.col("choice_index").cast("bigint").alias("choice_index"), F.size(shared).cast("bigint").alias("n_shared")
    )
