"""What is computed once, or not at all, when tables grow."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallymark.catalog import QUERIES, Inputs, plan_queries
from tallymark.dims import RUN_KEY
from tallymark.llm import pii
from tallymark.operators import facts as scan
from tallymark.operators import features, responses, rules
from tallymark.plans import label


@pytest.fixture
def inputs(spark, tmp_path):
    labels = "element_at(array('click', 'purchase', 'view', 'signup'), CAST(id % 4 + 1 AS INT))"
    rows = f"SELECT id AS event_id, id % 7 AS user_id, {labels} AS event_type, '{{}}' AS props FROM range(360)"
    spark.sql(rows).write.parquet(f"{tmp_path}/events.parquet")
    return Inputs(spark, str(tmp_path))


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rule_rows_scan_programs_once(inputs):
    assert "regexp_extract_all" not in plan_of(QUERIES["j11_rule_rows"](inputs))


def test_outcomes_need_no_scan(inputs):
    kept = []
    keep = lambda df: kept.append(df) or df
    given = inputs.submissions(), inputs.rubric_levels(), inputs.params(), inputs.responses()
    found = label.label_submissions(*given, keep=keep, with_data=False).select("student_id", "outcome", "agent")
    assert len(kept) == 1  # the submissions; no facts
    settings = label.run_settings(given[2], given[1]).select(*RUN_KEY, "response_type", "concepts")
    graded = {r.student_id: r.outcome for r in responses.grade_responses(given[3].join(settings, RUN_KEY)).collect()}
    rows = found.collect()
    assert len(rows) == 15
    assert all(r.outcome == ("ok" if r.agent == "static" else graded[r.student_id]) for r in rows)


def test_resumed_runs_share_their_inputs(inputs, monkeypatch):
    seen = []
    monkeypatch.setattr(plan_queries, "labelled", lambda i, cache=None, inputs=None: seen.append(inputs))
    monkeypatch.setattr(plan_queries.writers, "write_cache", lambda *a, **k: None)
    monkeypatch.setattr(plan_queries.writers, "read_cache", lambda *a, **k: None)
    monkeypatch.setattr(plan_queries, "materialize", lambda df, name: (name, len(df.columns)))
    monkeypatch.setattr(plan_queries.evaluate, "predicted_labels", lambda df: inputs.programs().selectExpr("*", "'' AS key_concept", "'' AS label"))
    QUERIES["a7_resume_from_cache"](inputs)
    assert len(seen) == 3 and len(seen[0]) == 4 and seen[0] is seen[1] is seen[2]


def test_addresses_are_found_from_run_to_run():
    plain = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    draw = random.Random(3)
    for _ in range(3000):
        text = "".join(draw.choice("12..a ") for _ in range(draw.randint(1, 30)))
        small = [m.span() for m in plain.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
        assert [(s, e) for kind, s, e in pii.base_spans(text) if kind == "ip"] == small, text
    # A search that begins with a look behind tries every character.
    assert not pii.IP.pattern.startswith("(?<")


def test_texts_of_a_concept_have_their_first_place(spark):
    at = "dataset string, experiment string, lesson string, student_id string, key_concept string, section_ord int, done long, seq long, text string"
    texts = [("A", 1, 5, 1, "x"), ("A", 0, 9, 2, "y"), ("A", 0, 7, 3, "x"), ("A", 0, 9, 4, "z"), ("B", 0, 1, 1, "x")]
    rows = spark.createDataFrame([("d", "e", "l", "s", *t) for t in texts], at)
    assert {r.key_concept: r.evidence for r in rules.concept_lists(rows).collect()} == {"A": ["x", "z", "y"], "B": ["x"]}


def test_rule_rows_group_evidence_once(inputs):
    found = rules.rule_rows(inputs.programs(), inputs.facts(), inputs.requested(), inputs.rubric_levels())
    assert "min(struct(section_ord" not in plan_of(found)  # a text's first place had a grouping of its own


def test_rule_rows_read_the_facts_once(inputs, spark, tmp_path):
    inputs.facts().write.parquet(f"{tmp_path}/facts")
    facts, asked = spark.read.parquet(f"{tmp_path}/facts"), inputs.requested().localCheckpoint()
    found = rules.rule_rows(inputs.programs(), facts, asked, inputs.rubric_levels())
    # Once each for labels, names and counts, and once more for the messages, before.
    assert len(re.findall(r"Relation \[[^]]*seen_draw", plan_of(found))) == 1
    stats = features.name_stats(facts).localCheckpoint()
    apart = rules.evidence_items(facts, stats, features.program_features(stats), requested=asked)
    lists = rules.evidence_lists(rules.rule_evidence(apart, asked)).collect()
    shown = {(r.student_id, r.key_concept): r.evidence for r in found.collect()}
    assert {(r.student_id, r.key_concept): r.evidence for r in lists} == {k: v for k, v in shown.items() if v}
    assert any(shown.values())


def test_scanned_programs_are_not_merged_by_size(inputs):
    scanned = scan.facts(inputs.programs()).select(F.spark_partition_id().alias("p"))
    assert scanned.distinct().count() == 4  # the session's; merged into one task before
