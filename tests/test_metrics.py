import pytest

from tallymark.dims import VALID_LABELS
from tallymark.operators import metrics


def pairs_of(spark, matrix, concept="c"):
    rows = [
        ("d", "e", "l", concept, a, p, n)
        for a, line in zip(VALID_LABELS, matrix)
        for p, n in zip(VALID_LABELS, line)
        if n
    ]
    return spark.createDataFrame(
        rows, "dataset string, experiment string, lesson string, key_concept string, actual string, predicted string, n bigint"
    )


def exact_stats(spark, matrix):
    confused = metrics.confusion(metrics.in_both_modes(pairs_of(spark, matrix)))
    return metrics.predicted_class_stats(confused)


def by_label(rows, field):
    found = {r.label: r[field] for r in rows}
    return [found[label] for label in VALID_LABELS]


def test_class_stats(spark):
    rows = exact_stats(spark, [[4, 1, 0, 0], [5, 1, 0, 0], [0, 0, 8, 0], [0, 0, 0, 0]]).where("mode = 'exact'").collect()
    assert by_label(rows, "n") == [9, 2, 8, 0]
    assert by_label(rows, "precision") == [pytest.approx(4 / 9), 0.5, 1.0, 0.0]


def test_exact_confidence(spark):
    high = [[17, 1, 1, 0], [1, 9, 1, 1], [1, 0, 15, 1], [0, 0, 0, 14]]
    levels = metrics.exact_confidence(exact_stats(spark, high)).collect()
    assert by_label(levels, "level") == ["HIGH", "HIGH", "HIGH", "LOW"]
    low = [[5, 1, 0, 0], [5, 1, 0, 0], [0, 0, 8, 0], [0, 0, 0, 0]]
    assert by_label(metrics.exact_confidence(exact_stats(spark, low)).collect(), "level") == ["LOW"] * 4


@pytest.mark.parametrize("right, level", [(90, "HIGH"), (85, "HIGH"), (80, "MEDIUM"), (70, "LOW")])
def test_pass_fail_confidence(spark, right, level):
    matrix = [[right, 0, 0, 100 - right], [0] * 4, [0] * 4, [0] * 4]
    acc = metrics.accuracy(metrics.in_both_modes(pairs_of(spark, matrix)))
    assert metrics.pass_fail_confidence(acc).first().level == level


def test_gate_reports_missing_thresholds(spark):
    acc = metrics.accuracy(metrics.in_both_modes(pairs_of(spark, [[1, 1, 0, 0], [0] * 4, [0] * 4, [0] * 4])))
    limits = spark.createDataFrame([("l", "c", 0.7)], "lesson string, key_concept string, min_accuracy double")
    checked = {r.key_concept: r.status for r in metrics.against_thresholds(acc, limits).collect()}
    assert checked == {"c": "below", None: "missing"}
    failures = metrics.threshold_failures(metrics.against_thresholds(acc, limits))
    assert metrics.gate(failures).first().passed is False


def test_run_options_and_input_checks(spark):
    from tallymark.plans import evaluate

    params = spark.createDataFrame([("d", "e", "l", "gpt-4", 3, 0.2, True)], "dataset string, experiment string, lesson string, model string, num_responses int, temperature double, remove_comments boolean")
    row = evaluate.run_options(params, model="", num_responses=5, temperature=0.0, remove_comments=None).first()
    assert (row.model, row.num_responses, row.temperature, row.remove_comments) == ("gpt-4", 5, 0.2, True)

    run = "dataset string, experiment string, lesson string"
    raw = spark.createDataFrame([("d", "e", "nowhere", {"model": "odd"})], f"{run}, params map<string,string>")
    rubric = spark.createDataFrame([("d", "e", "nowhere", "A", 0)], f"{run}, key_concept string, ord int")
    actual = spark.createDataFrame([("d", "e", "nowhere", "s1", "B", "No Evidence")], f"{run}, student_id string, key_concept string, label string")
    submitted = spark.createDataFrame([("d", "e", "nowhere", s) for s in ("s1", "s2")], f"{run}, student_id string")
    found = {name: table.count() for name, table in evaluate.input_checks(raw, rubric, actual, submitted).items()}
    assert found["concept_mismatches"] == 2 and found["students_without_labels"] == 1 and found["unsupported_lessons"] == 1
    assert found["param_problems"] >= 2
