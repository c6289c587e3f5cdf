"""Queries over the file readers and the rule registry.

The shared tables hold no such files, so paths and contents are made of their
rows; the readers get them as a table of files.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.catalog import plan_queries  # noqa: F401  (its views come first)
from tallymark.catalog.inputs import STUDENT
from tallymark.catalog.registry import query
from tallymark.dims import RUN_KEY, STUDENT_KEY
from tallymark.operators import features, rules
from tallymark.sources import readers

ROOT = "'file:/data/'"


def _files(df, path: str, value: str):
    return df.select(F.expr(path).alias("path"), F.expr(value).alias("value"))


def _quoted(text: str) -> str:
    return f"""'"' || replace({text}, '"', '""') || '"'"""


@query(
    "a1_submissions",
    """SELECT 'set ' || lang AS dataset, coalesce(source, 'none') AS lesson, 'student_' || doc_id AS student_id, coalesce(text, '') AS code FROM documents""",
)
def _(i):
    path = f"{ROOT} || 'set%20' || lang || '/' || coalesce(source, 'none') || '/student_' || doc_id || '.js'"
    files = _files(i.table("documents"), path, "coalesce(text, '')")
    return readers.submissions_of(files).select("dataset", "lesson", "student_id", "code")


@query(
    "a13_lessons_of_a_glob",
    """SELECT 'd' || (event_id % 3) AS dataset, 'L' || (user_id % 7) AS lesson, count(*) AS n FROM events WHERE user_id % 7 < 4 GROUP BY ALL""",
)
def _(i):
    path = f"{ROOT} || 'd' || (event_id % 3) || '/L' || (user_id % 7) || '/student_' || event_id || '.js'"
    found = readers.submissions_of(_files(i.table("events"), path, "event_type"))
    chosen = readers.choose_lessons(found, [f"L{n}" for n in range(4)])
    return chosen.groupBy("dataset", "lesson").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a2_label_sheets",
    """SELECT 'd' || (page_id % 2) AS dataset, 'L' || page_id AS lesson, 's' || k AS student_id, c.concept AS key_concept,
    CASE c.concept WHEN 'A, b' THEN url ELSE 'x' || k END AS label
    FROM pages, (VALUES (1), (2)) AS s(k), (VALUES ('A, b'), ('C')) AS c(concept)""",
)
def _(i):
    path = f"{ROOT} || 'd' || (page_id % 2) || '/L' || page_id || '/actual.csv'"
    line = lambda k, url: f"'s{k},' || {url} || ',x{k}'"
    lines = ["""'student,"A, b",C'""", line(1, "'old'"), line(2, _quoted("url")), line(1, _quoted("url"))]
    files = _files(i.table("pages"), path, " || chr(10) || ".join(lines))
    return readers.actual_labels_of(files)


@query(
    "a3_rubrics",
    """SELECT 'e' || (item_id % 2) AS experiment, 'L' || item_id AS lesson, k.name AS key_concept, label,
    CASE label WHEN 'No Evidence' THEN text ELSE label || k.name END AS descriptor FROM benchmark, (VALUES ('A'), ('B')) AS k(name),
    (VALUES ('Extensive Evidence'), ('Convincing Evidence'), ('Limited Evidence'), ('No Evidence')) AS l(label)""",
)
def _(i):
    path = f"{ROOT} || 'e' || (item_id % 2) || '/L' || item_id || '/rubric.csv'"
    head = "'No Evidence,Key Concept,Extensive Evidence,Convincing Evidence,Limited Evidence'"
    row = lambda n: f"{_quoted('text')} || ',{n},Extensive Evidence{n},Convincing Evidence{n},Limited Evidence{n}'"
    files = _files(i.table("benchmark"), path, " || chr(10) || ".join([head, row("A"), row("B")]))
    levels = readers.rubric_levels(readers.rubrics_of(files), ["experiment", "lesson"])
    return levels.select("experiment", "lesson", "key_concept", "label", "descriptor")


@query(
    "a4_params",
    """SELECT 'e' || (event_id % 5) AS experiment, 'L' || event_id AS lesson, CAST(event_id % 4 AS INT) AS num_responses,
    CASE WHEN event_id % 3 = 0 THEN NULL ELSE (event_id % 10) / 10.0 END::DOUBLE AS temperature, event_id % 2 = 1 AS remove_comments,
    CASE WHEN event_id % 2 = 0 THEN 'json' ELSE 'tsv' END AS response_type, event_type AS model FROM events""",
)
def _(i):
    path = f"{ROOT} || 'e' || (event_id % 5) || '/L' || event_id || '/params.json'"
    fields = """named_struct('model', event_type, 'num-responses', string(event_id % 4), 'remove-comments', string(event_id % 2),
      'temperature', if(event_id % 3 = 0, 'warm', string((event_id % 10) / 10)), 'response-type', if(event_id % 2 = 0, 'json', null))"""
    raw = readers.raw_params_of(_files(i.table("events"), path, f"to_json({fields})"))
    typed = readers.cast_params(raw, ["experiment", "lesson"])
    return typed.select("experiment", "lesson", "num_responses", "temperature", "remove_comments", "response_type", "model")


@query(
    "a5_examples",
    """SELECT 'e' AS experiment, 'L' || (doc_id // 3) AS lesson, count(*) AS n, max(doc_id || ':' || coalesce(text, '') || ':' || lang) FILTER (doc_id % 3 = 0) AS first
    FROM documents WHERE lang IS NOT NULL GROUP BY 2""",
)
def _(i):
    place = f"{ROOT} || 'e/L' || (doc_id div 3) || '/examples/' || doc_id"
    docs = i.table("documents").where("lang IS NOT NULL")
    code = _files(docs, f"{place} || '.js'", "doc_id || ':' || coalesce(text, '')")
    answer = _files(docs, f"{place} || if(doc_id % 2 = 0, '.tsv', '.json')", "lang")
    lists = readers.example_lists(readers.examples_of(code, answer), ["experiment", "lesson"])
    third = F.filter("examples", lambda e: F.split_part(e["code"], F.lit(":"), F.lit(1)).cast("bigint") % 3 == 0)
    shown = F.transform(third, lambda e: F.concat(e["code"], F.lit(":"), e["answer"]))
    return lists.select("experiment", "lesson", F.size("examples").cast("bigint").alias("n"), F.array_max(shown).alias("first"))


@query(
    "a6_thresholds",
    """SELECT 'L' || event_id AS lesson, k.name AS key_concept, CASE WHEN k.name IS NULL THEN 0.7 ELSE (event_id % 100) / 100.0 END::DOUBLE AS min_accuracy
    FROM events, (VALUES (NULL), ('A')) AS k(name)""",
)
def _(i):
    value = "to_json(map('L' || event_id, named_struct('overall', 0.7D, 'key_concepts', map('A', (event_id % 100) / 100D))))"
    return readers.explode_thresholds(_files(i.table("events"), "'x'", value))


@query(
    "m6_registered_rule",
    f"""SELECT {STUDENT}, 'Own' AS key_concept, CASE WHEN count(*) FILTER (kind = 'if' AND in_draw) > 1 THEN 'Yes' ELSE 'No' END AS label
    FROM facts GROUP BY {STUDENT}""",
)
def _(i):
    """A rule of one's own, for the time of this plan."""
    rules.register("Own", "own-lesson", lambda: F.when(F.col("cond_draw") > 1, "Yes").otherwise("No"))
    try:
        facts = i.facts()
        programs = facts.select(*STUDENT_KEY).distinct()
        requested = programs.select(*RUN_KEY).distinct().withColumns({"tree_lesson": F.lit("own-lesson"), "key_concept": F.lit("Own")})
        numbers = features.program_features(features.name_stats(facts))
        return rules.label_programs(programs, numbers, requested).select(*STUDENT_KEY, "key_concept", "label")
    finally:
        del rules.RULES[("Own", "own-lesson")]
