"""Choice checks, response outcomes and votes inside one response."""

import json
from collections import Counter

import pytest

from tallymark.dims import VALID_LABELS
from tallymark.operators import responses

CONCEPTS = ["Shapes", "Text", "Sprites"]
E, C, L, N = VALID_LABELS


def answer(labels=(E, E, E), fmt="json", concepts=CONCEPTS, header="Grade", note="", drop=None):
    rows = [
        {"Key Concept": c, "Observations": f"o{note}", "Evidence": f"e{note}", header: label, "Reason": f"r{note}"}
        for c, label in zip(concepts, labels)
    ]
    if drop:
        for row in rows:
            del row[drop]
    if fmt == "json":
        return json.dumps(rows)
    lines = ["\t".join(rows[0])] + ["\t".join(r.values()) for r in rows]
    return "\n".join(lines)


def grade(spark, choices, fmt="json", http=200, finish="stop", body=None):
    if body is None:
        body = json.dumps({"choices": [{"message": {"content": c}, "finish_reason": finish} for c in choices]})
    df = spark.createDataFrame(
        [("d", "e", "l", "s", http, body, fmt, CONCEPTS)],
        "dataset string, experiment string, lesson string, student_id string, http_status int, body string, "
        "response_type string, concepts array<string>",
    )
    return responses.grade_responses(df).first()


@pytest.mark.parametrize("fmt", ["json", "tsv"])
def test_a_good_answer(spark, fmt):
    row = grade(spark, [answer(fmt=fmt)], fmt)
    assert row.outcome == "ok" and [r.key_concept for r in row.data] == CONCEPTS
    assert row.data[0].reason == "r"


REJECTED = [
    (answer(drop="Reason"), "invalid_columns"),
    (answer(concepts=["Shapes", "Text", "xSprites"]), "invalid_concepts"),
    (answer(concepts=CONCEPTS[:2]), "invalid_concepts"),
    (answer(labels=(E, "x" + E, E)), "invalid_label"),
    ("bogus", "invalid_json"),
    ("[{]", "invalid_json"),
    ("[1, 2]", "exception"),
    ('[{"Key Concept": null, "Observations": "", "Label": "", "Reason": ""}]', "exception"),
    ("", "empty"),
]


def test_rejected_answers(spark):
    row = grade(spark, [text for text, _ in REJECTED])
    assert [c.status for c in row.checked] == [status for _, status in REJECTED]
    assert row.outcome == "exception" and row.data is None
    assert grade(spark, [REJECTED[0][0]]).outcome == "invalid"


@pytest.mark.parametrize("text", ["bogus", "[{]"])
def test_truncated_answers_are_too_large(spark, text):
    assert grade(spark, [text], finish="length").outcome == "too_large"


def test_one_valid_choice_is_enough(spark):
    assert grade(spark, ["bogus", answer(), "[{]"]).outcome == "ok"
    assert grade(spark, ["bogus", "", "[{]"]).outcome == "invalid"
    assert grade(spark, ["bogus", "bogus"], finish="max_tokens").outcome == "too_large"
    assert grade(spark, [answer(), "[1]"]).outcome == "exception"


def test_http_outcomes(spark):
    assert grade(spark, [], http=500).outcome == "server_error"
    assert grade(spark, [], http=429).outcome == "failed"
    too_long = json.dumps({"error": {"code": "context_length_exceeded"}})
    assert grade(spark, [], http=400, body=too_long).outcome == "too_large"
    assert grade(spark, [], body="not json").outcome == "exception"


def test_other_envelopes(spark):
    for body in (
        {"content": [{"type": "text", "text": answer()}], "stop_reason": "end_turn"},
        {"completion": answer(), "stop_reason": "stop"},
        {"generation": answer()},
    ):
        assert grade(spark, [], body=json.dumps(body)).outcome == "ok"
    spoilt = answer(concepts=["Shapes", "Text", "X Stretch"]).replace("Stretch", '\\"Stretch\\"')
    row = grade(spark, [], body=json.dumps({"content": [{"type": "text", "text": spoilt}], "stop_reason": "end_turn"}))
    assert "X “Stretch”" in row.checked[0].error


def test_votes(spark):
    row = grade(spark, [answer((L, E, E), note="1"), answer((E, E, E), note="2"), answer((E, E, E), note="3")])
    first = row.data[0]
    assert first.label == E and first.observations == "o2" and first.evidence == "e2"
    assert first.reason == f"<b>Votes: [{L}, {E}, {E}]</b><br>r3"
    assert row.data[1].reason == "r3" and row.data[1].observations == "o1"


def test_votes_against_a_counter(spark):
    import random

    rng = random.Random(7)
    for _ in range(6):
        picks = [[rng.choice(VALID_LABELS) for _ in CONCEPTS] for _ in range(5)]
        row = grade(spark, [answer(p, note=str(n)) for n, p in enumerate(picks)])
        for k, result in enumerate(row.data):
            labels = [p[k] for p in picks]
            majority = Counter(labels).most_common(1)[0][0]
            places = [n for n, label in enumerate(labels) if label == majority]
            assert result.label == majority
            assert result.observations == f"o{places[0]}"
            assert result.reason.endswith(f"r{places[-1]}")


def test_single_choice_passes_without_vote_text(spark):
    row = grade(spark, ["bogus", answer((L, N, C), drop="Evidence")])
    assert [r.label for r in row.data] == [L, N, C]
    assert row.data[0].evidence is None and row.data[0].reason == "r"


def test_adjacent_junk_rejects_the_answer(spark):
    lines = answer(fmt="tsv").split("\n")
    junk = "-----\t-\t-\t-\t-"
    between = "\n".join([lines[0]] + [x for line in lines[1:] for x in (junk, line)])
    assert grade(spark, [between], "tsv").outcome == "ok"
    adjacent = "\n".join([lines[0], junk, junk, *lines[1:]])
    assert grade(spark, [adjacent], "tsv").checked[0].status == "invalid_concepts"
