"""File layouts, sheets and caches on small files."""

import json

import pytest
from pyspark.sql import functions as F

from tallymark.dims import RUN_KEY
from tallymark.sources import readers, writers


def write(root, name, text):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_submissions(spark, tmp_path):
    for n in range(7):
        write(tmp_path, f"set a/L1/student_{n}.js", f"code {n}\n// é")
    write(tmp_path, "set a/L2/student_0.js", "other")
    rows = readers.read_submissions(spark, f"{tmp_path}/*/*/*.js")
    found = sorted((r.dataset, r.lesson, r.student_id, r.code) for r in rows.collect())
    assert len(found) == 8 and found[0] == ("set a", "L1", "student_0", "code 0\n// é")
    chosen = readers.choose_submissions(rows, limit=3).collect()
    assert sorted(r.student_id for r in chosen if r.lesson == "L1") == ["student_0", "student_1", "student_2"]
    assert readers.choose_submissions(rows, student_ids=["student_6"]).count() == 1
    assert readers.choose_lessons(rows, ["L2"]).count() == 1


def test_labels_rubric_and_params(spark, tmp_path):
    write(tmp_path, "d/L1/actual.csv", 'student,"A, b",C.d\ns1,x,y\ns2,z,w\ns1,new,y2\n')
    write(tmp_path, "d/L2/actual.csv", "student,Z\r\ns9,q\r\n")
    labels = {(r.student_id, r.key_concept): r.label for r in readers.read_actual_labels(spark, f"{tmp_path}/d/*/*.csv").collect()}
    assert labels == {("s1", "A, b"): "new", ("s1", "C.d"): "y2", ("s2", "A, b"): "z", ("s2", "C.d"): "w", ("s9", "Z"): "q"}

    head = "Key Concept,Instructions,Extensive Evidence,Convincing Evidence,Limited Evidence,No Evidence"
    write(tmp_path, "e/L1/rubric.csv", f'{head}\nA,"do, it",e,c,l,n\nB,"two\nlines",e2,c2,l2,n2\n')
    write(tmp_path, "e/L2/rubric.csv", "No Evidence,Key Concept,Extensive Evidence\nn3,Z,e3\n")
    rubric = readers.read_rubrics(spark, f"{tmp_path}/e/*/rubric.csv").orderBy("lesson", "ord").collect()
    assert [(r.experiment, r.lesson, r.key_concept, r.instructions) for r in rubric] == [
        ("e", "L1", "A", "do, it"), ("e", "L1", "B", "two\nlines"), ("e", "L2", "Z", None)
    ]
    assert (rubric[2].descriptors["No Evidence"], rubric[2].descriptors["Extensive Evidence"]) == ("n3", "e3")
    assert rubric[1].descriptors["No Evidence"] == "n2"
    levels = readers.rubric_levels(readers.read_rubrics(spark, f"{tmp_path}/e/L1/rubric.csv"), ["experiment", "lesson"])
    assert levels.count() == 8

    params = {
        "model": "gpt-4-0613", "remove-comments": "1", "num-responses": "3", "temperature": "0.2",
        "code-feature-extractor": ["A"], "lesson": "csd3-2023-L11",
    }
    write(tmp_path, "e/L1/params.json", json.dumps(params))
    (row,) = readers.cast_params(readers.raw_params(spark, f"{tmp_path}/e/*/params.json"), ["experiment", "lesson"]).collect()
    assert (row.num_responses, row.temperature, row.remove_comments, row.response_type) == (3, 0.2, True, "tsv")
    assert row.rule_concepts == ["A"] and row.tree_lesson == "csd3-2023-L11"


def test_examples_and_thresholds(spark, tmp_path):
    for n in (2, 1):
        write(tmp_path, f"e/L1/examples/{n}.js", f"code {n}")
        write(tmp_path, f"e/L1/examples/{n}.tsv", f"answer {n}")
    pairs = readers.read_examples(spark, f"{tmp_path}/*/*/examples/*.js", f"{tmp_path}/*/*/examples/*.tsv")
    (row,) = readers.example_lists(pairs, ["experiment", "lesson"]).collect()
    assert [(e.code, e.answer) for e in row.examples] == [("code 1", "answer 1"), ("code 2", "answer 2")]

    write(tmp_path, "t.json", json.dumps({"L1": {"overall": 0.7, "key_concepts": {"A": 0.6}}, "L2": {"overall": 0.5}}))
    got = {(r.lesson, r.key_concept): r.min_accuracy for r in readers.read_thresholds(spark, f"{tmp_path}/t.json").collect()}
    assert got == {("L1", None): 0.7, ("L1", "A"): 0.6, ("L2", None): 0.5}


def test_label_sheets(spark, tmp_path):
    write(tmp_path, "sheet.tsv", "Link\tA\tB\nhttps://x/p/abc/view\tx\t\nhttps://x/p/def/view\t\ty\n")
    got = sorted(tuple(r) for r in readers.read_label_sheet(spark, f"{tmp_path}/sheet.tsv").collect())
    assert got == [("abc", "A", "x"), ("def", "B", "y")]

    rows = [("d", "e", "l", f"student_{n}", c, f"{c}{n}") for n in (10, 9) for c in ("B", "A")]
    predicted = spark.createDataFrame(rows, "dataset string, experiment string, lesson string, student_id string, key_concept string, label string")
    sheet = writers.label_sheet(predicted, ["B", "A"])
    assert sheet.columns[-3:] == ["student", "A", "B"]
    assert [tuple(r)[-3:] for r in sheet.collect()] == [("student_9", "A9", "B9"), ("student_10", "A10", "B10")]


def test_cache_keeps_valid_results_of_other_runs(spark, tmp_path):
    schema = "dataset string, experiment string, lesson string, student_id string, agent string, outcome string, note string"

    def rows(lesson, note):
        return [("d", "e", lesson, "s1", "openai", "ok", note), ("d", "e", lesson, "s2", "static", "ok", note),
                ("d", "e", lesson, "s3", "openai", "invalid", note)]

    def runs(*lessons):
        return spark.createDataFrame([("d", "e", lesson) for lesson in lessons], "dataset string, experiment string, lesson string")

    path = f"{tmp_path}/cache"
    writers.write_cache(spark.createDataFrame(rows("L1", "a") + rows("L2", "a"), schema), path, runs("L1", "L2"))
    writers.write_cache(spark.createDataFrame(rows("L1", "b"), schema), path, runs("L1"))
    kept = writers.read_cache(spark, path)
    assert sorted((r.lesson, r.student_id, r.note) for r in kept.collect()) == [("L1", "s1", "b"), ("L2", "s1", "a")]
    for _ in range(2):  # what is there already is not added again
        writers.write_cache(spark.createDataFrame(rows("L3", "c") + rows("L1", "c"), schema), path, runs("L1", "L3"), resume=True)
    kept = writers.read_cache(spark, path)
    assert sorted((r.lesson, r.student_id, r.note) for r in kept.collect()) == [("L1", "s1", "b"), ("L2", "s1", "a"), ("L3", "s1", "c")]
    assert kept.groupBy(*RUN_KEY).agg(F.count("*")).count() == 3
    # A fresh run in which everything failed leaves nothing of its own runs.
    failed = spark.createDataFrame([r for r in rows("L1", "d") if r[5] != "ok"], schema)
    writers.write_cache(failed, path, runs("L1"))
    assert sorted(r.lesson for r in writers.read_cache(spark, path).collect()) == ["L2", "L3"]


def test_no_default_limit_of_students(spark):
    rows = spark.createDataFrame([("d", "l", f"s{n:03}", f"p{n:03}") for n in range(150)], "dataset string, lesson string, student_id string, path string")
    assert readers.choose_submissions(rows).count() == 150


def test_run_options(spark):
    from tallymark.functions.prompts import option_or_param

    text = spark.createDataFrame([("", "p"), ("0", "p"), (None, "p"), ("gpt", "p")], "o string, p string")
    assert [r[0] for r in text.select(option_or_param(F.col("o"), F.col("p"))).collect()] == ["p", "p", "p", "gpt"]
    number = spark.createDataFrame([(0.0, 1.5), (None, 1.5), (0.2, 1.5)], "o double, p double")
    assert [r[0] for r in number.select(option_or_param(F.col("o"), F.col("p"))).collect()] == [1.5, 1.5, 0.2]


def test_sheets_of_all_runs_in_one_job(spark, tmp_path):
    run = ("d", "e", "l1")
    rows = [(*run, f"student_{n}", c, f"{c}{n}", 0) for n in range(30) for c in ("A", 'B, "b"')]
    rows += [(*run, "student_3", "A", "later", 1), (*run, "student_3", "Z", "no column", 0), ("d", "e", "l2", "student_1", "C", "c", 0)]
    predicted = spark.createDataFrame(rows, "dataset string, experiment string, lesson string, student_id string, key_concept string, label string, pos int")
    concepts = [(*run, "A"), (*run, 'B, "b"'), ("d", "e", "l2", "C"), ("d", "e", "l2", "D"), ("d", "e", "l3", "E")]
    rubric = spark.createDataFrame(concepts, "dataset string, experiment string, lesson string, key_concept string")
    sheets = writers.label_sheets(predicted, rubric)
    assert sheets._jdf.queryExecution().analyzed().collectLeaves().size() == 2  # whatever the number of runs
    writers.write_label_sheets(sheets, f"{tmp_path}/sheets", rows_per_file=10)

    def files(lesson):
        folder = tmp_path / "sheets" / "dataset=d" / "experiment=e" / f"lesson={lesson}"
        return [f.read_text().splitlines() for part in sorted(folder.iterdir()) for f in part.glob("part-*.txt")]

    long = files("l1")
    assert len(long) == 3 and {f[0] for f in long} == {'student,A,"B, ""b"""'}
    numbers = [[int(line.split(",")[0].split("_")[1]) for line in f[1:]] for f in long]
    assert all(n == sorted(n) for n in numbers) and sorted(sum(numbers, [])) == list(range(30))
    assert 'student_3,A3,"B, ""b""3"' in sum(long, [])
    assert files("l2") == [["student,C,D", "student_1,c,"]] and files("l3") == [["student,E"]]
    back = readers.read_whole(spark, f"{tmp_path}/sheets/dataset=d/experiment=e/lesson=l1/*")
    assert back.count() == 3


@pytest.mark.parametrize("in_plan", [10_000, 3])
def test_submissions_are_chosen_before_they_are_read(spark, tmp_path, monkeypatch, in_plan):
    monkeypatch.setattr(readers, "PATHS_IN_PLAN", in_plan)
    for lesson in ("L1", "L 2"):
        (tmp_path / "set [a]" / lesson).mkdir(parents=True)
        for n in range(12):
            (tmp_path / "set [a]" / lesson / f"student_{n}+.js").write_text(f"x({n});\n")
    where = f"{tmp_path}/set \\[a\\]/*/*.js"
    listed = readers.list_files(spark, where)
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    got = readers.read_submissions(spark, where, limit=2)
    rows = sorted((r.dataset, r.lesson, r.student_id, r.code) for r in got.collect())
    assert rows == [("set [a]", l, f"student_{n}+", f"x({n});\n") for l in ("L 2", "L1") for n in (0, 1)]
    if in_plan > 4:  # 24 files are listed, 4 are opened
        scans = got._jdf.queryExecution().executedPlan().collectLeaves()
        assert scans.apply(0).metrics().get("numFiles").get().value() == 4
    only = readers.read_submissions(spark, where, student_ids=["student_7+"], lessons=["L1"])
    assert [r.code for r in only.collect()] == ["x(7);\n"]
    assert readers.read_submissions(spark, where, lessons=["L1"]).count() == 12
    assert readers.read_submissions(spark, where).count() == 24
