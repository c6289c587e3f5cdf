"""Queries over text, prompts, labels and colours (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.catalog.inputs import CTES, RUN, STUDENT, STUDENT_KEY, Inputs
from tallymark.catalog.registry import query
from tallymark.dims import PASS_FAIL, SUPPORTED_MODELS
from tallymark.functions import answers, labels, prompts, responses, text
from tallymark.plans.label import blank_results, prepare, rubric_concepts

# Documents as programs: a string with slashes, a line and a block comment.
CODE = (
    "CASE WHEN doc_id % 50 = 0 THEN '  ' || chr(10) || chr(9) WHEN doc_id % 50 = 1 THEN '// only' ELSE "
    "text || chr(10) || 'var s = \"a // b\"; // note ' || doc_id || chr(10) || "
    "'/* two' || chr(10) || 'lines */ x = 1;' END"
)
CTES["programs_text"] = f"SELECT doc_id, lang, source, {CODE} AS code FROM documents"
_DUCK_COMMENT = r"""regexp_replace(code, '(?sm)(".*?[^\\]"|''.*?[^\\]'')|/\*.*?\*/|//.*?$', '\1', 'g')"""


def _programs(i: Inputs):
    return i.table("documents").selectExpr("doc_id", "lang", "source", f"{CODE} AS code")


@query("b1_remove_comments", f"SELECT doc_id, {_DUCK_COMMENT} AS code FROM programs_text")
def _(i):
    return _programs(i).select("doc_id", text.remove_comments(F.col("code")).alias("code"))


@query(
    "b2_sanitize_code",
    f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {_DUCK_COMMENT} ELSE code END AS code FROM programs_text",
)
def _(i):
    code = text.sanitize_code(F.col("code"), F.col("doc_id") % 2 == 0)
    return _programs(i).select("doc_id", code.alias("code"))


@query(
    "b3_blank_programs",
    f"SELECT doc_id, trim({_DUCK_COMMENT}, chr(32) || chr(9) || chr(10) || chr(13)) = '' AS blank FROM programs_text",
)
def _(i):
    return _programs(i).select("doc_id", text.is_blank(text.remove_comments(F.col("code"))).alias("blank"))


CTES["student"] = f"SELECT DISTINCT {STUDENT}, sid FROM answers"
CTES["blank_student"] = "SELECT * FROM student WHERE sid % 13 = 0 OR (sid % 13 = 1 AND sid % 2 = 1)"


@query(
    "b4_blank_results",
    f"""SELECT {STUDENT}, key_concept, 'The program is empty.' AS observations, '' AS evidence,
    'No Evidence' AS label, 'The program is empty.' AS reason
    FROM blank_student JOIN rubric USING ({RUN})""",
)
def _(i):
    prepared = prepare(i.submissions(), i.params())
    blank = blank_results(prepared, rubric_concepts(i.rubric_levels()))
    return blank.select(*STUDENT_KEY, F.inline("data"))


_PROMPT, _RUBRIC = "'Grade ' || lang", "'Key Concept,' || source"
CTES["prompted"] = f"SELECT *, {_PROMPT} AS prompt, {_RUBRIC} AS rubric FROM programs_text"


def _prompted(i: Inputs):
    example = lambda n: F.struct(
        F.concat("lang", F.lit(f" code {n}")).alias("code"), F.concat("source", F.lit(f" answer {n}")).alias("answer")
    )
    return _programs(i).selectExpr("*", f"{_PROMPT} AS prompt", f"{_RUBRIC} AS rubric").withColumn(
        "examples", F.array(example(1), example(2))
    )


@query(
    "b5_chat_messages",
    """SELECT doc_id, CAST(6 AS BIGINT) AS n, 'system,user,assistant,user,assistant,user' AS roles,
    concat_ws('|', prompt || chr(10) || chr(10) || 'Rubric:' || chr(10) || rubric, lang || ' code 1', source || ' answer 1',
    lang || ' code 2', source || ' answer 2', code) AS contents FROM prompted""",
)
def _(i):
    messages = prompts.chat_messages(F.col("prompt"), F.col("rubric"), F.col("code"), F.col("examples"))
    return _prompted(i).withColumn("m", messages).select(
        "doc_id", F.size("m").cast("bigint").alias("n"),
        F.array_join("m.role", ",").alias("roles"), F.array_join("m.content", "|").alias("contents"),
    )


_NL2 = "chr(10) || chr(10)"
_DUCK_ANTHROPIC = (
    f"'Human:' || chr(10) || prompt || {_NL2} || 'Rubric:' || chr(10) || rubric || {_NL2} || 'Student Code:' "
    f"|| chr(10) || code || {_NL2} || 'Assistant:' || chr(10)"
)
_DUCK_META = (
    f"'[INST]' || prompt || '[/INST]' || {_NL2} || 'Rubric:' || chr(10) || rubric || {_NL2} || 'Student Code:' "
    f"|| chr(10) || code || {_NL2} || 'Evaluation (JSON):' || chr(10)"
)


@query("b6_anthropic_prompt", f"SELECT doc_id, {_DUCK_ANTHROPIC} AS prompt FROM prompted")
def _(i):
    built = prompts.anthropic_prompt(F.col("prompt"), F.col("rubric"), F.col("code"))
    return _prompted(i).select("doc_id", built.alias("prompt"))


@query("b7_meta_prompt", f"SELECT doc_id, {_DUCK_META} AS prompt FROM prompted")
def _(i):
    built = prompts.meta_prompt(F.col("prompt"), F.col("rubric"), F.col("code"))
    return _prompted(i).select("doc_id", built.alias("prompt"))


_MODELS = [*SUPPORTED_MODELS, "bedrock.anthropic.other-v1", "palm-2"]
_MODEL = (
    f"CASE doc_id % {len(_MODELS)} "
    + " ".join(f"WHEN {n} THEN '{m}'" for n, m in enumerate(_MODELS))
    + " END"
)
CTES["modelled"] = f"SELECT *, {_MODEL} AS model FROM prompted"
_DUCK_PROVIDER = """CASE WHEN starts_with(model, 'gpt') THEN 'openai' WHEN starts_with(model, 'bedrock.meta') THEN 'meta'
  WHEN starts_with(model, 'bedrock.anthropic') OR starts_with(model, 'bedrock.us.anthropic') THEN 'anthropic' END"""


def _modelled(i: Inputs):
    return _prompted(i).withColumn("model", F.expr(_MODEL))


@query("b8_provider_route", f"SELECT doc_id, model, coalesce({_DUCK_PROVIDER}, 'unknown_model') AS provider FROM modelled")
def _(i):
    route = F.coalesce(prompts.provider(F.col("model")), F.lit("unknown_model"))
    return _modelled(i).select("doc_id", "model", route.alias("provider"))


@query(
    "b9_provider_model_id",
    f"""SELECT doc_id, CASE {_DUCK_PROVIDER} WHEN 'openai' THEN model WHEN 'meta' THEN substr(model, 9)
    WHEN 'anthropic' THEN CASE WHEN contains(model, 'claude-3') THEN substr(model, 9)
    ELSE 'arn:aws:bedrock:us-east-1:123:inference-profile/' || substr(model, 9) END END AS model_id FROM modelled""",
)
def _(i):
    model_id = prompts.provider_model_id(F.col("model"), account="123")
    return _modelled(i).select("doc_id", model_id.alias("model_id"))


@query(
    "b10_request_body",
    f"""SELECT doc_id, CASE {_DUCK_PROVIDER}
    WHEN 'openai' THEN CAST(to_json({{'model': model, 'temperature': 0.5::DOUBLE, 'messages': [
      {{'role': 'system', 'content': prompt || {_NL2} || 'Rubric:' || chr(10) || rubric}},
      {{'role': 'user', 'content': lang || ' code 1'}}, {{'role': 'assistant', 'content': source || ' answer 1'}},
      {{'role': 'user', 'content': lang || ' code 2'}}, {{'role': 'assistant', 'content': source || ' answer 2'}},
      {{'role': 'user', 'content': code}}], 'n': 3}}) AS VARCHAR)
    WHEN 'meta' THEN CAST(to_json({{'prompt': {_DUCK_META}, 'max_gen_len': 1536, 'temperature': 0.5::DOUBLE}}) AS VARCHAR)
    WHEN 'anthropic' THEN CASE WHEN contains(model, 'claude') THEN
      CAST(to_json({{'anthropic_version': 'bedrock-2023-05-31', 'max_tokens': 4096, 'messages': [
      {{'role': 'user', 'content': [{{'type': 'text', 'text': {_DUCK_ANTHROPIC}}}]}}]}}) AS VARCHAR)
      ELSE CAST(to_json({{'prompt': {_DUCK_ANTHROPIC}, 'max_tokens_to_sample': 4000, 'temperature': 0.5::DOUBLE}}) AS VARCHAR) END
    END AS body FROM modelled""",
)
def _(i):
    body = prompts.request_body(
        F.col("model"), F.col("prompt"), F.col("rubric"), F.col("code"), F.col("examples"), F.lit(3), F.lit(0.5)
    )
    return _modelled(i).select("doc_id", body.alias("body"))


@query(
    "b11_option_override",
    "SELECT event_id, CASE WHEN user_id % 3 = 0 THEN event_id % 5 ELSE user_id % 3 END AS num_responses FROM events",
)
def _(i):
    chosen = prompts.option_or_param(F.col("user_id") % 3, F.col("event_id") % 5)
    return i.table("events").select("event_id", chosen.alias("num_responses"))


@query(
    "b14_json_rows",
    "SELECT doc_id, lang AS key_concept, CAST(n_chars AS VARCHAR) AS label, source || ' ; b' AS evidence FROM documents",
)
def _(i):
    # An array inside other words, with a raw line break and a list in it.
    row = F.format_string(
        'Sure: [{"Key Concept": "%s", "Label": %d, "Evidence": ["%s", ";", "b"], "Reason": "x\ny"}] done',
        "lang", "n_chars", "source",
    )
    rows = answers.parse_rows(row, F.lit("json"))
    return i.table("documents").select("doc_id", F.inline(rows)).select("doc_id", "key_concept", "label", "evidence")


_MESSY = "text || chr(10) || 'Key Concept' || chr(92) || 't' || role || chr(9) || chr(9) || 'x' || chr(10) || '  '"


@query(
    "b15_tabular_text",
    f"""SELECT conv_id, turn, replace(replace(trim(substr(m, instr(m, chr(10) || 'Key Concept')), chr(32) || chr(10)),
    chr(92) || 't', chr(9)), chr(9) || chr(9), chr(9)) AS cleaned
    FROM (SELECT *, {_MESSY} AS m FROM conversations)""",
)
def _(i):
    return i.table("conversations").select("conv_id", "turn", answers.tabular_text(F.expr(_MESSY)).alias("cleaned"))


_TABLE = (
    "'A' || CASE conv_id % 3 WHEN 0 THEN chr(9) WHEN 1 THEN ' | ' ELSE ',' END || 'B' || chr(10) || '--- | ---' "
    "|| chr(10) || replace(replace(role, '-', ''), '|', '') || chr(10) || turn"
)


@query(
    "b16_delimiter",
    f"""SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'tab' ELSE 'pipe' END AS delimiter,
    CASE WHEN conv_id % 3 = 0 THEN t ELSE replace(t, '--- | ---' || chr(10), '') END AS ready
    FROM (SELECT *, {_TABLE} AS t FROM conversations)""",
)
def _(i):
    t = F.expr(_TABLE)
    name = F.when(answers.delimiter(t) == "\t", "tab").when(answers.delimiter(t) == "|", "pipe").otherwise("comma")
    return i.table("conversations").select("conv_id", "turn", name.alias("delimiter"), answers.drop_rulers(t).alias("ready"))


@query("b18_strip_cells", "SELECT event_id, trim(props, '\"') AS cell FROM events")
def _(i):
    padded = F.concat(F.lit(' \t "'), "props", F.lit('"" \n'))
    return i.table("events").select("event_id", text.strip_value(padded).alias("cell"))


CTES["junk_rows"] = """SELECT sid, pos, label = 'invalid label' AS junk,
  CASE WHEN label = 'invalid label' THEN '--- ' || event_id ELSE 'k' || event_id END AS key_concept FROM base"""


@query(
    "b19_junk_rows",
    """SELECT sid, key_concept FROM (SELECT *, row_number() OVER (PARTITION BY sid, junk, pos - rn ORDER BY pos) AS nth FROM
    (SELECT *, row_number() OVER (PARTITION BY sid, junk ORDER BY pos) AS rn FROM junk_rows)) WHERE NOT junk OR nth % 2 = 0""",
)
def _(i):
    concept = F.concat(F.when(F.col("label") == "invalid label", "--- ").otherwise("k"), "event_id")
    row = F.struct("pos", concept.alias("key_concept"), F.array(F.lit("Key Concept")).alias("columns"))
    per_answer = i.base().groupBy("sid").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return per_answer.select("sid", F.inline(answers.drop_junk_rows(F.col("rows")))).select("sid", "key_concept")


@query(
    "b20_grade_is_label",
    "SELECT event_id, event_type AS label, 'Key Concept,Label' AS columns FROM events",
)
def _(i):
    entry = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    entries = F.array(entry(" Key Concept ", F.lit("c")), entry("Label", F.lit("old")), entry("Grade", F.col("event_type")))
    row = answers.clean_row(entries)
    return i.table("events").select(
        "event_id", row["label"].alias("label"), F.array_join(F.array_sort(row["columns"]), ",").alias("columns")
    )


@query(
    "b21_sanitize_evidence",
    r"""SELECT choice_index, regexp_replace(replace(replace('```' || evidence || chr(10) || evidence, chr(10), ' '), '```', '`'),
    'Lines? (\d+), \d*, (\d+)', 'Lines \1-\2', 'g') AS evidence FROM votes""",
)
def _(i):
    raw = F.concat(F.lit("```"), "evidence", F.lit("\n"), "evidence")
    return i.votes().select("choice_index", text.sanitize_evidence(raw).alias("evidence"))


@query(
    "b22_pass_fail_class",
    """SELECT choice_index, CASE WHEN label IN ('Extensive Evidence', 'Convincing Evidence')
    THEN 'Extensive Evidence/Convincing Evidence' ELSE 'Limited Evidence/No Evidence' END AS class FROM votes""",
)
def _(i):
    return i.votes().select("choice_index", labels.pass_fail_class(F.col("label")).alias("class"))


_DUCK_ORD = """CASE {0} WHEN 'Extensive Evidence' THEN 0 WHEN 'Convincing Evidence' THEN 1
  WHEN 'Limited Evidence' THEN 2 WHEN 'No Evidence' THEN 3 END"""


@query(
    "b23_same_class",
    f"SELECT {STUDENT}, key_concept, ({_DUCK_ORD.format('actual')} < 2) = (coalesce({_DUCK_ORD.format('predicted')}, 3) < 2) AS same FROM matched",
)
def _(i):
    from tallymark.operators.metrics import match_labels

    same = labels.same_class(F.col("actual"), F.col("predicted"))
    return match_labels(i.voted(), i.actual()).select(*STUDENT_KEY, "key_concept", same.alias("same"))


CTES["colored"] = f"""SELECT {STUDENT}, key_concept, observations, evidence, reason, actual, predicted,
  CASE abs({_DUCK_ORD.format('actual')} - {_DUCK_ORD.format('predicted')}) WHEN 0 THEN 'green' WHEN 1 THEN 'yellow' ELSE 'red' END AS exact_color,
  CASE WHEN ({_DUCK_ORD.format('actual')} < 2) = (coalesce({_DUCK_ORD.format('predicted')}, 3) < 2) THEN 'green' ELSE 'red' END AS class_color
  FROM matched"""


@query("b24_cell_colors", f"SELECT {STUDENT}, key_concept, exact_color, class_color FROM colored")
def _(i):
    from tallymark.operators.metrics import match_labels

    color = lambda mode: labels.cell_color(F.col("actual"), F.col("predicted"), F.lit(mode))
    return match_labels(i.voted(), i.actual()).select(
        *STUDENT_KEY, "key_concept", color("exact").alias("exact_color"), color(PASS_FAIL).alias("class_color")
    )


_PERCENT = "least(value, 100.0)"
DUCK_COLOR = """CASE WHEN {p} >= 50 THEN 'rgb(' || (255 - trunc(({p} - 50) * 5.1)::INT) || ', 255, ' || (255 - trunc(({p} - 50) * 5.1)::INT) || ')'
  ELSE 'rgb(255, ' || (trunc(({p} - 50) * 5.1)::INT + 200) || ', ' || (trunc(({p} - 50) * 5.1)::INT + 200) || ')' END"""


@query("b25_accuracy_color", f"SELECT event_id, {DUCK_COLOR.format(p=_PERCENT)} AS color FROM events")
def _(i):
    percent = F.least(F.col("value"), F.lit(100.0))
    return i.table("events").select("event_id", labels.accuracy_color(percent).alias("color"))


@query(
    "b26_percent_text",
    "SELECT event_id, CASE WHEN value > 300 THEN 'N/A' ELSE trunc(value)::BIGINT || '%' END AS shown FROM events",
)
def _(i):
    percent = F.when(F.col("value") > 400, F.lit(float("nan"))).when(F.col("value") <= 300, F.col("value"))
    return i.table("events").select("event_id", labels.percent_text(percent).alias("shown"))


@query(
    "b27_http_outcome",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'server_error' WHEN 'view' THEN
    CASE WHEN event_id % 2 = 0 THEN 'too_large' ELSE 'failed' END WHEN 'error' THEN 'failed' ELSE 'ok' END AS outcome FROM events""",
)
def _(i):
    status = F.expr("CASE event_type WHEN 'click' THEN 500 WHEN 'view' THEN 400 WHEN 'error' THEN 429 ELSE 200 END")
    code = F.when(F.col("event_id") % 2 == 0, "context_length_exceeded").otherwise("other")
    body = F.to_json(F.struct(F.struct(code.alias("code"), F.lit("m").alias("message")).alias("error")))
    env = responses.envelope(body)
    return i.table("events").select("event_id", responses.http_outcome(status, env).alias("outcome"))


@query(
    "b29_token_usage",
    "SELECT event_id, CASE WHEN event_type = 'error' THEN 0 ELSE user_id END AS total_tokens FROM events",
)
def _(i):
    usage = F.when(F.col("event_type") != "error", F.struct(F.col("user_id").alias("total_tokens")))
    env = responses.envelope(F.to_json(F.struct(usage.alias("usage"))))
    return i.table("events").select("event_id", responses.total_tokens(env).alias("total_tokens"))


@query(
    "b12_choices",
    """SELECT event_id, 'text ' || event_id AS content,
    CASE event_type WHEN 'error' THEN NULL ELSE 'stop' END AS finish_reason FROM events""",
)
def _(i):
    content = F.concat(F.lit("text "), "event_id")
    kind = F.col("event_type")
    body = (
        F.when(
            kind == "click",
            F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"), F.lit("stop").alias("finish_reason"))).alias("choices"))),
        )
        .when(kind == "view", F.to_json(F.struct(content.alias("completion"), F.lit("stop").alias("stop_reason"))))
        .when(kind == "error", F.to_json(F.struct(content.alias("generation"))))
        .otherwise(
            F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), content.alias("text"))).alias("content"), F.lit("stop").alias("stop_reason")))
        )
    )
    return i.table("events").select("event_id", F.inline(responses.choices(responses.envelope(body))))
