"""Requests as runs of their own, their stream, and the versioned result cache."""

import json

import pytest
from pyspark.sql import functions as F

from tallymark.plans import label
from tallymark.plans import requests as plan
from tallymark.sources import snapshots, writers
from tallymark.streaming import requests as stream

RUBRIC = 'Key Concept,Extensive Evidence,Convincing Evidence,Limited Evidence,No Evidence\n"Loops, nested",le,lc,ll,ln\nNames,ne,nc,nl,nn\n'
CODE = "var a = 1;\nfunction draw() {\n  a = a + 1;\n}\n"


def answer(labels, n=1):
    rows = [{"Key Concept": c, "Observations": "o", "Evidence": "Line 1", "Reason": "r", "Label": x} for c, x in labels.items()]
    choices = [{"message": {"content": json.dumps(rows)}, "finish_reason": "stop"}] * n
    return json.dumps({"choices": choices, "usage": {"prompt_tokens": 5, "completion_tokens": 7, "total_tokens": 12}})


def form(**fields):
    return {"code": CODE, "prompt": "p", "rubric": RUBRIC, "response-type": "json", "model": "gpt-4-0613"} | {k.replace("_", "-"): v for k, v in fields.items()}


BOTH = {"Loops, nested": "No Evidence", "Names": "Extensive Evidence"}
ROWS = [
    ("a", 0, form(), 200, answer(BOTH, 3), 1.5),
    ("b", 60, form(rubric="Key Concept,No Evidence\nOther,x\n"), 200, answer({"Other": "No Evidence"}), 2.0),
    ("c", 120, form(code="  "), 200, answer(BOTH), 9.0),
    ("d", 180, {"code": CODE, "prompt": "p"}, 200, answer(BOTH), 9.0),
    ("e", 240, form(num_responses="many"), 200, answer(BOTH), 9.0),
    ("f", 300, form(rubric="no header"), 200, answer(BOTH), 9.0),
    ("g", 360, form(), 500, "down", 0.5),
    ("h", 420, form(code_feature_extractor="x Loops, nested y", lesson="csd3-2023-L11"), 200, answer(BOTH), 3.0),
    ("i", 480, form(code_feature_extractor="nothing of it"), 200, answer(BOTH), 3.0),
    ("j", 540, form(), None, None, None),
]


def requests(spark, rows=ROWS):
    rows = [(i, f"2024-01-01 00:{s // 60:02}:00", f, *rest) for i, s, f, *rest in rows]
    schema = "request_id string, received string, form map<string,string>, http_status int, body string, seconds double"
    return spark.createDataFrame(rows, schema).withColumn("received", F.col("received").cast("timestamp"))


def test_each_request_has_its_own_settings(spark):
    found = requests(spark).cache()
    got = {r["request_id"]: r for r in plan.label_requests(found).collect()}
    assert len(got) == len(ROWS)
    assert {i: r["outcome"] for i, r in got.items()} == {
        "a": "ok", "b": "ok", "c": "ok", "d": "bad_request", "e": "bad_request", "f": "bad_request",
        "g": got["g"]["outcome"], "h": "ok", "i": "ok", "j": "no_response",
    }
    assert got["g"]["outcome"] not in ("ok", "bad_request")
    assert [got[i]["message"] for i in "def"] == ["rubric is required", "not a number", plan.NO_CONCEPTS]
    assert [(r["key_concept"], r["label"]) for r in got["a"]["data"]] == list(BOTH.items())
    assert [(r["key_concept"], r["label"]) for r in got["b"]["data"]] == [("Other", "No Evidence")]
    assert got["c"]["agent"] == "static" and got["c"]["total_tokens"] == 0 and len(got["c"]["data"]) == 2
    assert (got["a"]["prompt_tokens"], got["a"]["completion_tokens"], got["a"]["total_tokens"], got["a"]["seconds"]) == (5, 7, 12, 1.5)
    assert got["a"]["agent"] == "openai" and got["i"]["agent"] == got["h"]["agent"] == "openai, code feature extractor"
    assert plan.label_requests(found.limit(0)).count() == 0


def test_a_concept_with_a_comma_is_found(spark):
    fields = {r["request_id"]: r["rule_concepts"] for r in plan.request_fields(requests(spark)).collect()}
    assert fields["h"] == ["Loops, nested"] and fields["i"] == [] and fields["a"] == []


def test_published_documents(spark):
    found = requests(spark).cache()
    documents = {r["request_id"]: json.loads(r["result"]) for r in plan.published(found, plan.label_requests(found).withColumn("student_id", F.col("request_id"))).collect()}
    one = documents["a"]["metadata"]
    assert one["agent"] == "openai" and one["time"] == 1.5 and one["usage"] == {"prompt_tokens": 5, "completion_tokens": 7, "total_tokens": 12}
    assert one["request"]["model"] == "gpt-4-0613" and one["request"]["n"] == 1 and one["request"]["messages"][-1]["role"] == "user"
    assert list(documents["a"]["data"][0]) == ["Key Concept", "Observations", "Evidence", "Label", "Reason"]
    assert "usage" not in documents["c"]["metadata"] and "request" not in documents["c"]["metadata"]


def test_a_replayed_file_adds_nothing(spark, tmp_path):
    path = str(tmp_path)
    rows = requests(spark, ROWS[:4])
    rows.coalesce(1).write.json(f"{path}/in")

    def run():
        stream.label_request_stream(stream.read_request_stream(spark, f"{path}/in", 1), f"{path}/out", f"{path}/state").awaitTermination()

    run()
    before = stream.read_results(spark, f"{path}/out").count()
    later = rows.withColumn("received", F.col("received") + F.expr("INTERVAL 3 MINUTES"))
    later.union(requests(spark, ROWS[6:7])).coalesce(1).write.mode("append").json(f"{path}/in")
    run()
    got = stream.read_results(spark, f"{path}/out")
    assert before == 4 and sorted(r["request_id"] for r in got.collect()) == ["a", "b", "c", "d", "g"]
    totals = stream.read_totals(spark, f"{path}/out").agg(F.sum("n_results"), F.sum("n_failed"), F.sum("seconds")).first()
    assert tuple(totals) == (5, 2, 1.5 + 2.0 + 0.5)


def test_a_batch_is_committed_once(spark, tmp_path):
    out = str(tmp_path)
    rows = plan.label_requests(requests(spark, ROWS[:2])).cache()
    for part in (rows, rows.limit(1), rows.limit(0)):  # what a repeated batch brings is not taken
        stream.commit_batch(part, out, 7)
    assert stream.read_results(spark, out).count() == 2 and stream.read_totals(spark, out).first()["n_results"] == 2
    broken = rows.withColumn("agent", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        stream.commit_batch(broken, out, 8)
    assert stream.read_results(spark, out).count() == 2
    stream.commit_batch(rows.limit(0), out, 8)
    assert stream.read_totals(spark, out).agg(F.sum("n_results")).first()[0] == 2


# ---- versions of the cache -----------------------------------------------------------

SCHEMA = "dataset string, experiment string, lesson string, student_id string, agent string, outcome string, note string"


def results(spark, lessons, note, students=("s1", "s2")):
    return spark.createDataFrame([("d", "e", lesson, s, "openai", "ok", note) for lesson in lessons for s in students], SCHEMA)


def notes(rows):
    return sorted((r["lesson"], r["student_id"], r["note"]) for r in rows.collect())


def test_a_failed_write_leaves_the_old_results(spark, tmp_path):
    path = f"{tmp_path}/cache"
    assert writers.read_cache(spark, path) is None
    first = results(spark, ["01", "L2"], "a")
    assert writers.write_cache(first, path, first) == 1
    broken = results(spark, ["01"], "b").withColumn("note", F.when(F.col("student_id") == "s2", F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("note")))
    with pytest.raises(Exception, match="lost"):
        writers.write_cache(broken, path, broken)
    assert snapshots.versions(spark, path) == [1]
    assert notes(writers.read_cache(spark, path)) == notes(first)


def test_readers_keep_their_version(spark, tmp_path):
    path = f"{tmp_path}/cache"
    first = results(spark, ["01", "L2"], "a")
    writers.write_cache(first, path, first)
    pinned = writers.read_cache(spark, path)
    second = results(spark, ["01"], "b")
    assert writers.write_cache(second, path, second) == 2
    # A job may read the version it replaces.
    own = writers.read_cache(spark, path).where("lesson = 'L2'").withColumn("note", F.lit("c"))
    writers.write_cache(own, path, results(spark, ["L2"], ""))
    assert notes(pinned) == notes(first)
    assert {(a, c) for a, _, c in notes(writers.read_cache(spark, path))} == {("01", "b"), ("L2", "c")}
    assert {(a, c) for a, _, c in notes(writers.read_cache(spark, path, 2))} == {("01", "b"), ("L2", "a")}
    writers.prune_cache(spark, path)
    assert snapshots.versions(spark, path) == [3]
    assert {(a, c) for a, _, c in notes(writers.read_cache(spark, path))} == {("01", "b"), ("L2", "c")}


def test_the_second_of_two_writers_fails(spark, tmp_path):
    path = f"{tmp_path}/cache"
    one, two = results(spark, ["L1"], "one"), results(spark, ["L1"], "two")
    keys = ["dataset", "experiment", "lesson"]
    snapshots.commit(one, path, keys, one, expected=0)
    with pytest.raises(FileExistsError):
        snapshots.commit(two, path, keys, two, expected=0)
    assert notes(snapshots.read(spark, path)) == notes(one)
    none = one.limit(0)
    assert snapshots.commit(none, path, keys, one) == 2 and snapshots.read(spark, path).count() == 0
    snapshots.prune(spark, path)
    assert snapshots.read(spark, path).columns == one.columns


def test_a_batch_without_rows_is_not_labelled(spark, tmp_path):
    path = str(tmp_path)
    requests(spark, ROWS[:2]).coalesce(1).write.json(f"{path}/in")
    stream.label_request_stream(stream.read_request_stream(spark, f"{path}/in"), f"{path}/out", f"{path}/state").awaitTermination()
    # The watermark moves on in a batch of its own.
    assert stream.read_totals(spark, f"{path}/out").count() == 1
    assert stream.read_results(spark, f"{path}/out").count() == 2


def test_answers_meet_their_settings_in_their_own_row(spark):
    found = requests(spark)
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().split("Join ")[1:]
    good = plan.request_fields(found, ["http_status", "body"]).where("status = 'ok' AND http_status IS NOT NULL")
    graded = label.response_results(good, None)
    assert joins(graded) == [] and {r.student_id: r.outcome for r in graded.collect()}["a"] == "ok"
