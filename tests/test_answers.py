"""Tabular answers against Python's csv reader, JSON answers against json."""

import csv
import io
import itertools
import json

import pytest
from pyspark.sql import functions as F

from tallymark.functions import answers

TABLES = {
    "tsv": "Key Concept\tGrade\tReason\nA\tx\tr1\nB\ty\tr2",
    "csv": 'Key Concept,Grade\n"A, b",x\n\nB,"y ""q"" z"',
    "pipes": "Key Concept | Grade\n--- | ---\nA | x\nB | y",
    "edge pipes": "| Key Concept | Grade |\n| --- | --- |\n| A | x |",
    "quoted pipe": 'Key Concept |Grade | z\n"a|b"|x | 1',
    "lead": "Bogus\nlines\nKey Concept\tGrade\nA\tx",
    "escaped": "Key Concept\\tGrade\nA\\tx",
    "doubled": "Key Concept\t\tGrade\nA\t\tx",
    "short": "Key Concept\tGrade\tReason\nA\tx\nB",
    "extra": "Key Concept\tGrade\nA\tx\ty\tz",
    "inner quotes": 'Key Concept\tGrade\na"b"c\t"d" e',
    "spaces": 'Key Concept\t Grade \nA\t "b" ',
    "backslash": 'Key Concept\tGrade\np\\"q\\n\tx',
    "quoted break": 'Key Concept\tGrade\n"l1\nl2"\tx',
    "empty": "Key Concept\tGrade\tReason\n\tx\t\nA\t \tr",
    "empty csv": "Key Concept,Grade,Reason\n,x,\nA,,r",
    "quotes": 'Key Concept\tGrade\n"a"""\t""\nB\t"open',
    "long": "Key Concept\tGrade\n" + "x" * 120_000 + '\t"' + 'a""\n' * 20_000 + '"',
}


def python_rows(text):
    text = text.strip()
    if "\nKey Concept" in text:
        text = text[text.index("\nKey Concept"):].strip()
    text = text.replace("\\t", "\t").replace("\t\t", "\t")
    sep = "\t" if "\t" in text else "|" if " | " in text else ","
    if sep == "|":
        text = "\n".join(line for line in text.split("\n") if "---" not in line)
    rows = []
    for row in csv.DictReader(io.StringIO(text), delimiter=sep):
        row.pop(None, None)
        rows.append({k.strip(): v.strip().strip('"') if v is not None else None for k, v in row.items()})
    return rows


def spark_rows(spark, texts, response_type):
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    parsed = df.select("n", answers.parse_rows(F.col("t"), F.lit(response_type)).alias("rows"))
    return [r.rows for r in sorted(parsed.collect())]


def test_tables_read_as_python_does(spark):
    for text, got in zip(TABLES.values(), spark_rows(spark, list(TABLES.values()), "tsv")):
        want = python_rows(text)
        assert len(got) == len(want), text[:200]
        for g, w in zip(got, want):
            assert g.key_concept == w.get("Key Concept")
            assert g.label == w.get("Grade")
            assert g.reason == w.get("Reason")


def test_json_answers(spark):
    text = 'Sure [{"Key Concept": " A ", "Grade": "x", "Evidence": ["l1", "l2"], "Reason": "two\nlines"}] bye'
    ((row,),) = spark_rows(spark, [text], "json")
    assert (row.key_concept, row.label, row.evidence, row.reason) == ("A", "x", "l1 l2", "two\nlines")
    assert sorted(row.columns) == ["Evidence", "Key Concept", "Label", "Reason"]


UNREADABLE = ["bogus", "[{]", "] [", "[1, 2] and [3]", "[{'a': 'b'}]", '[{"a": 1},]']


def test_unreadable_json(spark):
    assert spark_rows(spark, UNREADABLE, "json") == [None] * len(UNREADABLE)
    for text in UNREADABLE:
        start, end = text.find("["), text.rfind("]")
        with pytest.raises(ValueError):
            if not 0 <= start < end:
                raise ValueError
            json.loads(text[start : end + 1], strict=False)


def test_junk_rows_are_removed_as_the_loop_does(spark):
    masks = ["".join(m) for size in range(1, 8) for m in itertools.product("Jg", repeat=size)]
    names = [[("-" if c == "J" else "k") + str(n) for n, c in enumerate(mask)] for mask in masks]
    rows = F.transform(
        F.split("t", ","), lambda n: F.struct(n.alias("key_concept"), F.array(F.lit("Key Concept")).alias("columns"))
    )
    df = spark.createDataFrame([(n, ",".join(row)) for n, row in enumerate(names)], "n int, t string")
    kept = df.select("n", answers.drop_junk_rows(rows).alias("r")).collect()
    for n, row in kept:
        expected = list(names[n])
        for name in expected:
            if not name[0:1].isalnum():
                expected.remove(name)
        assert [r.key_concept for r in row] == expected


def test_example_concepts(spark):
    tsv = "Key Concept\tObservations\nA\to\nB\to\nA\to"
    js = json.dumps([{"Key Concept": "A"}, {"Key Concept": "C"}])
    df = spark.createDataFrame([(tsv, "tsv"), (js, "json")], "a string, t string")
    got = [r.x for r in df.select(answers.example_concepts(F.col("a"), F.col("t")).alias("x")).collect()]
    assert [sorted(g) for g in got] == [["A", "B"], ["A", "C"]]
