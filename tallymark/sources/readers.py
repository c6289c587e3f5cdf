"""Readers for the file layout of datasets and experiments.

A dataset is ``<root>/<dataset>/<lesson>/…`` and parameters are
``<root>/<experiment>/<lesson>/…``; one read with a glob covers all lessons of
any Hadoop file system, and names come from the path. ``read_…`` opens files,
``…_of`` takes a table of them (path, value), wherever it comes from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallymark.dims import LESSONS, VALID_LABELS
from tallymark.functions import answers

THRESHOLDS_TYPE = "map<string,struct<overall:double,key_concepts:map<string,double>>>"
RESPONSE_SCHEMA = (
    "dataset string, experiment string, lesson string, student_id string, http_status int, body string"
)

# Most paths that go into a filter (a few hundred bytes each); more are joined.
PATHS_IN_PLAN = 10_000


def _path():
    return F.col("path")


def _decoded(part):
    """A name from a path, which is URL-encoded in file metadata."""
    return F.url_decode(F.replace(part, F.lit("+"), F.lit("%2B")))


def _stem(extension: str):
    return _decoded(F.regexp_extract(_path(), rf"([^/]+)\.{extension}$", 1))


def _parent(level: int):
    """Name of the directory ``level`` steps above the file."""
    return _decoded(F.element_at(F.split(_path(), "/"), -1 - level))


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: its path and, in ``value``, the whole file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths of the files, from their metadata alone: no file is opened."""
    return spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"))


def read_chosen(spark: SparkSession, path: str, chosen: DataFrame) -> DataFrame:
    """``read_whole`` of the files whose paths are in ``chosen``.

    Up to ``PATHS_IN_PLAN`` paths become a filter on file metadata, by which Spark skips the
    other files unopened. Beyond it the paths are joined; files are then read where they are
    and only paths decide, so no text moves as long as the paths can be broadcast.
    """
    paths = [row[0] for row in chosen.select("path").limit(PATHS_IN_PLAN + 1).collect()]
    if len(paths) > PATHS_IN_PLAN:
        return read_whole(spark, path).join(chosen.select("path"), "path", "left_semi")
    text = spark.read.text(path, wholetext=True)
    return text.where(F.col("_metadata.file_path").isin(paths)).select(F.col("_metadata.file_path").alias("path"), "value")


def read_submissions(
    spark: SparkSession, path: str, limit: int | None = None, student_ids: list[str] | None = None, lessons: list[str] | None = None
) -> DataFrame:
    """``…/<dataset>/<lesson>/<student>.js`` -> dataset, lesson, student_id, code.

    With a limit, students or lessons (see ``choose_submissions`` and ``choose_lessons``) the
    choice is made among paths, before any program is read.
    """
    if limit is None and not student_ids and lessons is None:
        return submissions_of(read_whole(spark, path))
    named = _named(list_files(spark, path))
    named = named if lessons is None else choose_lessons(named, lessons)
    return submissions_of(read_chosen(spark, path, choose_submissions(named, limit, student_ids)))


def _named(files: DataFrame) -> DataFrame:
    return files.select(
        _parent(2).alias("dataset"), _parent(1).alias("lesson"), _stem("js").alias("student_id"), _path().alias("path"),
    )


def submissions_of(files: DataFrame) -> DataFrame:
    return files.select(
        _parent(2).alias("dataset"), _parent(1).alias("lesson"), _stem("js").alias("student_id"),
        _path().alias("path"), F.col("value").alias("code"),
    )


def choose_submissions(submissions: DataFrame, limit: int | None = None, student_ids: list[str] | None = None, keys: tuple[str, ...] = ("dataset", "lesson"), by: str = "path") -> DataFrame:
    """The given students, or the first ``limit`` of every lesson by path.

    The limit is the number of students to evaluate per lesson, an option of a
    run; without it all stay. Spark keeps only the first rows per task before the
    exchange.
    """
    if student_ids:
        return submissions.where(F.col("student_id").isin(student_ids))
    if limit is None:
        return submissions
    first = W.partitionBy(*keys).orderBy(by)
    return submissions.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= limit).drop("_n")


def choose_lessons(df: DataFrame, lessons: list[str] | None = None) -> DataFrame:
    return df.where(F.col("lesson").isin(LESSONS if lessons is None else lessons))


def _csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"', sep=sep)


def unpivot_labels(wide: DataFrame, keys: list[str], student: str = "student", order: str | None = None) -> DataFrame:
    """One column per concept -> one row per student and concept.

    With ``order``, a later row of the same student replaces an earlier one.
    """
    concepts = [c for c in wide.columns if c not in (*keys, student, order)]
    if order:
        latest = F.max_by(F.struct(*[f"`{c}`" for c in concepts]), F.col(order))
        wide = wide.groupBy(*keys, student).agg(latest.alias("_row")).select(*keys, student, "_row.*")
    return wide.unpivot([*keys, student], [f"`{c}`" for c in concepts], "key_concept", "label").withColumnRenamed(
        student, "student_id"
    )


def _sheet_rows(files: DataFrame, root: str) -> DataFrame:
    """Rows of many sheets, each under its own header.

    A sheet is one small file and its columns are its own, so files of one
    glob may differ in columns and in their order.
    """
    rows = F.posexplode(answers.sheet_rows(F.col("value")))
    return (
        files.select(_parent(2).alias(root), _parent(1).alias("lesson"), _path().alias("path"), "value")
        .select(root, "lesson", "path", rows.alias("ord", "entries"))
    )


def read_actual_labels(spark: SparkSession, path: str) -> DataFrame:
    """Human labels of any number of sheets ``…/<dataset>/<lesson>/<file>.csv``.

    A later row of the same student replaces an earlier one.
    """
    return actual_labels_of(read_whole(spark, path))


def actual_labels_of(files: DataFrame) -> DataFrame:
    labels = F.filter("entries", lambda e: e["k"] != "student")
    long = _sheet_rows(files, "dataset").select(
        "dataset", "lesson", answers.cell(F.col("entries"), "student").alias("student_id"),
        "path", "ord", F.inline(labels),
    )
    keys = ["dataset", "lesson", "student_id", F.col("k").alias("key_concept")]
    return long.groupBy(*keys).agg(F.max_by("v", F.struct("path", "ord")).alias("label"))


def read_rubrics(spark: SparkSession, path: str) -> DataFrame:
    """Rubric sheets ``…/<experiment>/<lesson>/<file>.csv``, one row per concept.

    ``Instructions`` is optional; descriptors is a map label -> text.
    """
    return rubrics_of(read_whole(spark, path))


def rubrics_of(files: DataFrame) -> DataFrame:
    entries = F.col("entries")
    pairs = [x for label in VALID_LABELS for x in (F.lit(label), answers.cell(entries, label))]
    return _sheet_rows(files, "experiment").select(
        "experiment", "lesson", answers.cell(entries, "Key Concept").alias("key_concept"), "ord",
        answers.cell(entries, "Instructions").alias("instructions"),
        F.create_map(*pairs).alias("descriptors"),
    )


def rubric_levels(rubrics: DataFrame, keys: list[str]) -> DataFrame:
    """Long form: one row per concept and label."""
    return rubrics.select(
        *keys, "key_concept", "ord", F.explode("descriptors").alias("label", "descriptor")
    )


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    return prompts_of(read_whole(spark, path))


def prompts_of(files: DataFrame) -> DataFrame:
    return files.select(
        _parent(2).alias("experiment"), _parent(1).alias("lesson"), F.col("value").alias("prompt")
    )


def raw_params(spark: SparkSession, path: str) -> DataFrame:
    """Parameter files as MAP<STRING, STRING>, for checking."""
    return raw_params_of(read_whole(spark, path))


def raw_params_of(files: DataFrame) -> DataFrame:
    return files.select(
        _parent(2).alias("experiment"), _parent(1).alias("lesson"),
        F.from_json("value", "map<string,string>").alias("params"),
    )


def cast_params(raw: DataFrame, keys: list[str]) -> DataFrame:
    """Typed parameters with the defaults of a run."""
    p = F.col("params")
    return raw.select(
        *keys,
        p["model"].alias("model"),
        p["num-responses"].try_cast("int").alias("num_responses"),
        p["temperature"].try_cast("double").alias("temperature"),
        (F.coalesce(p["remove-comments"].try_cast("int"), F.lit(0)) != 0).alias("remove_comments"),
        F.coalesce(p["response-type"], F.lit("tsv")).alias("response_type"),
        F.from_json(p["code-feature-extractor"], "array<string>").alias("rule_concepts"),
        p["lesson"].alias("tree_lesson"),
    )


def read_examples(spark: SparkSession, path: str, answer_path: str) -> DataFrame:
    """``…/<experiment>/<lesson>/examples/<id>.js`` with ``<id>.tsv`` or ``<id>.json``."""
    return examples_of(read_whole(spark, path), read_whole(spark, answer_path))


def examples_of(code_files: DataFrame, answer_files: DataFrame) -> DataFrame:
    place = [_parent(3).alias("experiment"), _parent(2).alias("lesson")]
    code = code_files.select(*place, _stem("js").alias("example_id"), F.col("value").alias("code"))
    answer = answer_files.select(
        *place, _stem("(?:tsv|json)").alias("example_id"), F.col("value").alias("answer")
    )
    return code.join(answer, ["experiment", "lesson", "example_id"])


def example_lists(examples: DataFrame, keys: list[str]) -> DataFrame:
    """The few examples of one prompt, in order of their ids."""
    listed = F.array_sort(F.collect_list(F.struct("example_id", "code", "answer")))
    return examples.groupBy(*keys).agg(
        F.transform(listed, lambda e: F.struct(e["code"].alias("code"), e["answer"].alias("answer"))).alias("examples")
    )


def explode_thresholds(texts: DataFrame) -> DataFrame:
    """Nested JSON -> lesson, key_concept (NULL = overall), min_accuracy."""
    lessons = texts.select(F.explode(F.from_json("value", THRESHOLDS_TYPE)).alias("lesson", "t"))
    overall = F.struct(F.lit(None).cast("string").alias("key_concept"), F.col("t.overall").alias("min_accuracy"))
    per_concept = F.transform(
        F.map_entries("t.key_concepts"),
        lambda e: F.struct(e["key"].alias("key_concept"), e["value"].alias("min_accuracy")),
    )
    rows = F.concat(F.array(overall), F.coalesce(per_concept, F.array().cast("array<struct<key_concept:string,min_accuracy:double>>")))
    return lessons.select("lesson", F.inline(rows))


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    return explode_thresholds(read_whole(spark, path))


def prepare_label_sheet(sheet: DataFrame) -> DataFrame:
    """Grading sheet (project link first) -> student_id, key_concept, label.

    The project id is the part before ``/view``; empty scores are dropped.
    """
    link, *scores = sheet.columns
    long = sheet.unpivot([f"`{link}`"], [f"`{c}`" for c in scores], "key_concept", "label")
    student = F.regexp_extract(F.col(f"`{link}`"), r"/([^/]+)/view", 1)
    return long.where("label IS NOT NULL AND label <> ''").select(student.alias("student_id"), "key_concept", "label")


def read_label_sheet(spark: SparkSession, path: str) -> DataFrame:
    return prepare_label_sheet(_csv(spark, path, sep="\t"))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Stored responses, one JSON record per response."""
    return spark.read.schema(RESPONSE_SCHEMA).json(path)
