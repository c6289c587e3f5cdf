"""Queries over votes and human labels: consensus, accuracy, gates (D-H, L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.catalog.inputs import CTES, GROUP, RUN, STUDENT, Inputs
from tallymark.catalog.registry import query
from tallymark.catalog.text_queries import DUCK_COLOR
from tallymark.dims import RUN_KEY, STUDENT_KEY, label_dim
from tallymark.operators import consensus, metrics, report, rules, validate
from tallymark.plans import label
from tallymark.sources import readers, writers


def _matched(i: Inputs):
    return metrics.match_labels(i.voted(), i.actual())


def _pairs(i: Inputs):
    return metrics.in_both_modes(metrics.label_pairs(_matched(i)))


# ---- label sheets -----------------------------------------------------------

CONCEPTS = ["KC0", "KC1", "KC2", "KC3"]


@query("a2_actual_labels", f"SELECT {GROUP}, label FROM actual")
def _(i):
    # One row per vote in sheet form; the last one of a student and concept counts.
    wide = i.actual().groupBy(*STUDENT_KEY).pivot("key_concept", CONCEPTS).agg(F.first("label"))
    first = wide.select(*RUN_KEY, "student_id", *[F.lit("old").alias(c) for c in CONCEPTS], F.lit(0).alias("n"))
    sheet = first.unionByName(wide.withColumn("n", F.lit(1)))
    return readers.unpivot_labels(sheet, RUN_KEY, student="student_id", order="n").where("label IS NOT NULL").select(
        *STUDENT_KEY, "key_concept", "label"
    )


@query(
    "a9_new_labels_sheet",
    f"""SELECT {RUN}, student_id AS student, {', '.join(f"max(label) FILTER (key_concept = '{c}') AS {c}" for c in CONCEPTS)}
    FROM voted GROUP BY {STUDENT}""",
)
def _(i):
    return writers.label_sheet(i.voted(), CONCEPTS)


@query(
    "a12_prepare_label_sheet",
    """SELECT page_id AS student_id, key_concept, label FROM (
    SELECT 'p' || page_id AS page_id, unnest(['Shapes', 'Text']) AS key_concept,
    unnest([CASE WHEN page_id % 3 = 0 THEN '' ELSE 'No Evidence' END, CASE WHEN page_id % 4 = 0 THEN NULL ELSE 'Limited Evidence' END]) AS label
    FROM pages) WHERE label <> ''""",
)
def _(i):
    sheet = i.table("pages").select(
        F.concat(F.lit("https://x.org/projects/p"), "page_id", F.lit("/view")).alias("Link"),
        F.when(F.col("page_id") % 3 == 0, "").otherwise("No Evidence").alias("Shapes"),
        F.when(F.col("page_id") % 4 != 0, "Limited Evidence").alias("Text"),
    )
    return readers.prepare_label_sheet(sheet)


# ---- votes ------------------------------------------------------------------

_VOTED = f"{GROUP}, label, observations, evidence, reason"


@query("e6_consensus", f"SELECT {_VOTED}, n_votes, n_labels FROM voted")
def _(i):
    return i.voted().drop("first_label", "first_choice", "first_row")


@query("e7_first_texts", f"SELECT {GROUP}, t.label, observations, evidence FROM tally t JOIN votes v USING ({GROUP}) WHERE v.choice_index = t.f")
def _(i):
    return consensus.vote_counts(i.votes()).select(
        *STUDENT_KEY, "key_concept", "label", "_first.observations", "_first.evidence"
    )


@query("e8_last_reason", f"SELECT {GROUP}, t.label, reason FROM tally t JOIN votes v USING ({GROUP}) WHERE v.choice_index = t.l")
def _(i):
    return consensus.vote_counts(i.votes()).select(*STUDENT_KEY, "key_concept", "label", "_last.reason")


@query("e9_vote_prefix", f"SELECT {GROUP}, '<b>Votes: [' || seq || ']</b><br>' AS prefix FROM winner JOIN vote_text USING ({GROUP}) WHERE n_labels > 1")
def _(i):
    prefix = F.regexp_extract("reason", r"^(<b>Votes: \[.*\]</b><br>)", 1)
    return i.voted().where("n_labels > 1").select(*STUDENT_KEY, "key_concept", prefix.alias("prefix"))


@query("e11_outvoted", f"SELECT {GROUP}, first_label, label FROM winner WHERE first_label <> label")
def _(i):
    return consensus.outvoted(i.voted()).select(*STUDENT_KEY, "key_concept", "first_label", "label")


@query("e12_concepts", f"SELECT DISTINCT {RUN}, key_concept FROM votes")
def _(i):
    concepts = label.rubric_concepts(i.votes().withColumn("ord", F.lit(0)))
    return concepts.select(*RUN_KEY, F.explode("concepts").alias("key_concept"))


@query("f1_concept_order", f"SELECT {STUDENT}, string_agg(key_concept, '|' ORDER BY first_choice) AS concepts FROM winner GROUP BY {STUDENT}")
def _(i):
    ordered = consensus.concept_order(i.voted())
    return ordered.select(*STUDENT_KEY, F.array_join("concepts", "|").alias("concepts"))


def _sheets(i: Inputs):
    return writers.label_sheets(i.voted(), i.votes().select(*RUN_KEY, "key_concept"))


@query(
    "f5_student_order",
    f"SELECT DISTINCT {STUDENT}, CAST(split_part(student_id, '_', 2) AS BIGINT) AS number FROM votes",
)
def _(i):
    sheets = _sheets(i).where("student IS NOT NULL")
    return sheets.select(*RUN_KEY, F.col("student").alias("student_id"), "number")


@query(
    "f6_first_submissions",
    """SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY lang || '/' || doc_id || '.js') AS n
    FROM documents) WHERE n <= 20""",
)
def _(i):
    files = i.table("documents").select("doc_id", "lang", F.concat("lang", F.lit("/"), "doc_id", F.lit(".js")).alias("path"))
    return readers.choose_submissions(files, limit=20, keys=("lang",)).select("doc_id", "lang")


@query("f7_concept_header", f"SELECT {RUN}, string_agg(key_concept, ',' ORDER BY key_concept) AS header FROM (SELECT DISTINCT {RUN}, key_concept FROM votes) GROUP BY {RUN}")
def _(i):
    return _sheets(i).select(*RUN_KEY, F.array_join("concepts", ",").alias("header")).distinct()


# ---- joins and sets ---------------------------------------------------------


@query("d1_match_labels", f"SELECT {GROUP}, predicted, actual FROM matched")
def _(i):
    return _matched(i).select(*STUDENT_KEY, "key_concept", "predicted", "actual")


CTES["some_actual"] = f"SELECT {GROUP}, max(value) AS top FROM votes GROUP BY {GROUP} HAVING max(value) > 250"


@query("d1_unmatched_labels", f"SELECT {GROUP}, label FROM voted ANTI JOIN some_actual USING ({GROUP})")
def _(i):
    some = i.votes().groupBy(*STUDENT_KEY, "key_concept").agg(F.max("value").alias("top")).where("top > 250")
    return metrics.unmatched_labels(i.voted(), some).select(*STUDENT_KEY, "key_concept", "label")


@query(
    "d3_resume",
    f"""SELECT {STUDENT}, 'cached' AS source FROM some_actual GROUP BY {STUDENT}
    UNION ALL SELECT {STUDENT}, 'new' FROM (SELECT DISTINCT {STUDENT} FROM votes) ANTI JOIN some_actual USING ({STUDENT})""",
)
def _(i):
    asked = i.votes().select(*STUDENT_KEY).distinct()
    cached = label.asked_results(i.votes().where("value > 250").select(*STUDENT_KEY).distinct(), asked)
    fresh = label.without_results(asked, cached)
    return cached.withColumn("source", F.lit("cached")).unionByName(fresh.withColumn("source", F.lit("new")))


@query("d4_unknown_students", f"SELECT DISTINCT {STUDENT} FROM votes ANTI JOIN some_actual USING ({STUDENT})")
def _(i):
    known = i.votes().where("value > 250").select(*STUDENT_KEY)
    return validate.students_without_labels(i.votes(), known)


@query("d5_reason_lookup", f"SELECT {GROUP}, CASE WHEN label = 'invalid label' THEN '' ELSE key_concept || ' / ' || label END AS reason FROM voted")
def _(i):
    labels = label_dim(i.spark).select("label")
    concepts = i.votes().select(*RUN_KEY, "key_concept").distinct()
    scale = F.array(*[F.lit(r) for r in ("Extensive Evidence", "Convincing Evidence", "Limited Evidence", "No Evidence")])
    levels = (
        concepts.withColumn("label", F.explode(scale))
        .join(F.broadcast(labels), "label")
        .withColumn("descriptor", F.concat("key_concept", F.lit(" / "), "label"))
    )
    found = rules.with_reasons(i.voted().drop("reason"), levels)
    return found.select(*STUDENT_KEY, "key_concept", "reason")


@query("g3_predicted_minus_actual", f"SELECT DISTINCT {STUDENT} FROM votes EXCEPT SELECT {STUDENT} FROM some_actual")
def _(i):
    known = i.votes().where("value > 250").select(*STUDENT_KEY)
    return validate.students_without_labels(i.voted(), known)


@query("g4_failing_labels", "SELECT DISTINCT label, label IN ('Limited Evidence', 'No Evidence') AS failing FROM votes")
def _(i):
    failing = label_dim(i.spark).where("NOT passing").select("label", F.lit(True).alias("failing"))
    seen = i.votes().select("label").distinct()
    return seen.join(F.broadcast(failing), "label", "left").select("label", F.coalesce("failing", F.lit(False)).alias("failing"))


@query(
    "g5_union_results",
    f"SELECT {GROUP}, label, CAST(NULL AS VARCHAR) AS reason FROM actual UNION ALL SELECT {GROUP}, label, reason FROM voted",
)
def _(i):
    voted = i.voted().select(*STUDENT_KEY, "key_concept", "label", "reason")
    return i.actual().unionByName(voted, allowMissingColumns=True)


# ---- accuracy ---------------------------------------------------------------

_ACC = f"SELECT {RUN}, mode, key_concept, n, round(accuracy, 6) AS accuracy FROM acc"


def _accuracy(i: Inputs, overall: bool):
    acc = metrics.accuracy(_pairs(i)).where(F.col("overall") == overall)
    return acc.select(*RUN_KEY, "mode", "key_concept", "n", F.round("accuracy", 6).alias("accuracy"))


@query("e1_accuracy_by_concept", f"{_ACC} WHERE NOT overall")
def _(i):
    return _accuracy(i, overall=False)


@query("e2_overall_accuracy", f"SELECT {RUN}, mode, n, round(accuracy, 6) AS accuracy FROM acc WHERE overall")
def _(i):
    return _accuracy(i, overall=True).drop("key_concept")


@query("e3_confusion_by_concept", f"SELECT {RUN}, mode, key_concept, actual, predicted, n FROM confused")
def _(i):
    return metrics.confusion(_pairs(i))


@query("e4_overall_confusion", f"SELECT {RUN}, mode, actual, predicted, CAST(sum(n) AS BIGINT) AS n FROM confused GROUP BY ALL")
def _(i):
    return metrics.confusion(_pairs(i), overall=True)


@query("d12_dense_grid", f"SELECT {RUN}, mode, key_concept, count(*) AS n_cells, CAST(sum(CAST(n = 0 AS INT)) AS BIGINT) AS n_empty FROM confused GROUP BY ALL")
def _(i):
    return metrics.confusion(_pairs(i)).groupBy(*RUN_KEY, "mode", "key_concept").agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col("n") == 0).alias("n_empty")
    )


@query("e5_class_stats", f"SELECT {RUN}, mode, key_concept, label, n, round(prec, 6) AS \"precision\" FROM class_stats")
def _(i):
    stats = metrics.predicted_class_stats(metrics.confusion(_pairs(i)))
    return stats.select(*RUN_KEY, "mode", "key_concept", "label", "n", F.round("precision", 6).alias("precision"))


@query(
    "h1_pass_fail_confidence",
    f"""SELECT {RUN}, key_concept, CASE WHEN accuracy >= 0.85 THEN 'HIGH' WHEN accuracy >= 0.8 THEN 'MEDIUM' ELSE 'LOW' END AS level
    FROM acc WHERE mode = 'pass_fail' AND NOT overall""",
)
def _(i):
    return metrics.pass_fail_confidence(metrics.accuracy(_pairs(i))).drop("accuracy")


@query(
    "h2_exact_confidence",
    f"""SELECT {RUN}, key_concept, label, n, CASE WHEN prec >= 0.88 AND n >= 10 THEN 'HIGH' ELSE 'LOW' END AS level
    FROM class_stats WHERE mode = 'exact'""",
)
def _(i):
    stats = metrics.predicted_class_stats(metrics.confusion(_pairs(i)))
    return metrics.exact_confidence(stats).drop("precision")


CTES["checked_thresholds"] = f"""SELECT a.dataset, a.experiment, a.lesson, a.key_concept, a.accuracy, t.min_accuracy,
  CASE WHEN t.min_accuracy IS NULL THEN 'missing' WHEN a.accuracy < t.min_accuracy THEN 'below' ELSE 'met' END AS status
  FROM acc a LEFT JOIN thresholds t ON t.lesson = a.lesson AND t.key_concept IS NOT DISTINCT FROM a.key_concept
  WHERE a.mode = 'exact'"""


def _checked(i: Inputs):
    return metrics.against_thresholds(metrics.accuracy(_pairs(i)), i.thresholds())


@query("d6_threshold_status", f"SELECT {RUN}, key_concept, status FROM checked_thresholds")
def _(i):
    return _checked(i).select(*RUN_KEY, "key_concept", "status")


@query(
    "h3_threshold_failures",
    f"""SELECT {RUN}, key_concept, round(accuracy, 6) AS accuracy_score, round(min_accuracy::DOUBLE, 6) AS threshold
    FROM checked_thresholds WHERE status = 'below'""",
)
def _(i):
    return metrics.threshold_failures(_checked(i)).withColumn("accuracy_score", F.round("accuracy_score", 6)).withColumn(
        "threshold", F.round("threshold", 6)
    )


@query("h4_gate", "SELECT count(*) AS n_failures, count(*) = 0 AS passed FROM checked_thresholds WHERE status = 'below'")
def _(i):
    return metrics.gate(metrics.threshold_failures(_checked(i)))


@query("h5_both_modes", f"SELECT {RUN}, mode, key_concept, actual, predicted, count(*) AS n FROM moded GROUP BY ALL")
def _(i):
    return _pairs(i).groupBy(*RUN_KEY, "mode", "key_concept", "actual", "predicted").agg(F.sum("n").alias("n"))


# ---- report -----------------------------------------------------------------


@query(
    "l1_accuracy_table",
    f"""SELECT {RUN}, mode, key_concept, trunc(accuracy * 100)::BIGINT || '%' AS accuracy_text,
    {DUCK_COLOR.format(p='(accuracy * 100)')} AS color FROM acc WHERE NOT overall""",
)
def _(i):
    return report.accuracy_table(metrics.accuracy(_pairs(i)))


_LABELS = ("Extensive Evidence", "Convincing Evidence", "Limited Evidence", "No Evidence")


@query(
    "l2_confusion_table",
    f"""SELECT {RUN}, key_concept, actual, {', '.join(f"CAST(sum(n) FILTER (predicted = '{x}') AS BIGINT) AS \"{x}\"" for x in _LABELS)}
    FROM confused WHERE mode = 'exact' GROUP BY {RUN}, key_concept, actual""",
)
def _(i):
    return report.confusion_table(metrics.confusion(_pairs(i)))


@query(
    "l3_student_rows",
    f"""SELECT {GROUP}, mode, observations, evidence, actual, predicted, reason,
    CASE mode WHEN 'exact' THEN exact_color ELSE class_color END AS color
    FROM colored CROSS JOIN (VALUES ('exact'), ('pass_fail')) AS m(mode)""",
)
def _(i):
    return report.student_rows(_matched(i))
