"""Long-table votes against a plain Counter, with one very large group."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tallymark.dims import VALID_LABELS
from tallymark.operators import consensus, metrics

SCHEMA = (
    "dataset string, experiment string, lesson string, student_id string, key_concept string, choice_index bigint, "
    "row_index bigint, label string, observations string, evidence string, reason string"
)


def votes(spark):
    rows = []
    for n in range(6000):
        # One concept of one student holds a third of all votes.
        student, concept = ("hot", "k0") if n % 3 == 0 else (f"s{n % 40}", f"k{n % 3}")
        label = VALID_LABELS[(n * n + n // 7) % 4]
        rows.append(("d", "e", "l", student, concept, n // 2, n % 2, label, f"o{n}", f"e{n}", f"r{n}"))
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(7)


def test_consensus_equals_counting(spark):
    rows, df = votes(spark)
    groups = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[5], r[6])):
        groups[r[3], r[4]].append(r)
    got = {(r.student_id, r.key_concept): r for r in consensus.consensus(df).collect()}
    assert got.keys() == groups.keys()
    for key, members in groups.items():
        labels = [m[7] for m in members]
        majority = Counter(labels).most_common(1)[0][0]
        chosen = [m for m in members if m[7] == majority]
        prefix = f"<b>Votes: [{', '.join(labels)}]</b><br>" if len(set(labels)) > 1 else ""
        row = got[key]
        assert (row.label, row.observations, row.evidence) == (majority, chosen[0][8], chosen[0][9])
        assert row.reason == prefix + chosen[-1][10]
        assert (row.first_label, row.n_votes) == (labels[0], len(labels))


def test_metrics_with_a_large_group(spark):
    rows, df = votes(spark)
    predicted = df.select(*df.columns[:5], "label")
    actual = predicted.select(*df.columns[:5]).distinct().withColumn("label", F.lit(VALID_LABELS[1]))
    pairs = metrics.in_both_modes(metrics.label_pairs(metrics.match_labels(predicted, actual)))
    exact = {r.key_concept: r for r in metrics.accuracy(pairs).where("mode = 'exact'").collect()}
    for concept in ("k0", "k1", "k2", None):
        mine = [r for r in rows if concept in (None, r[4])]
        right = sum(r[7] == VALID_LABELS[1] for r in mine)
        assert (exact[concept].n, exact[concept].n_equal) == (len(mine), right)
    dense = metrics.confusion(pairs)
    assert dense.where("mode = 'exact'").count() == 3 * 16
    assert dense.where("mode = 'exact'").agg(F.sum("n")).first()[0] == len(rows)
