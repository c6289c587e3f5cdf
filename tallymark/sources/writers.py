"""Result tables and sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.dims import RUN_KEY, STUDENT_KEY
from tallymark.session import materialize
from tallymark.sources import snapshots

CACHED_AGENTS_EXCLUDED = ["static"]


def cacheable(assessed: DataFrame) -> DataFrame:
    """Valid results of responses; blank programs are cheap and not kept."""
    return assessed.where((F.col("outcome") == "ok") & ~F.col("agent").isin(CACHED_AGENTS_EXCLUDED))


def write_cache(assessed: DataFrame, path: str, runs: DataFrame, resume: bool = False) -> int:
    """Keep the valid results of ``runs`` (the run keys of this job); returns the version.

    A fresh evaluation replaces whatever the cache has of its runs, also of those
    without a single valid result now; runs outside the job stay. ``resume`` adds the
    students that the cache does not have yet. The cache is a versioned table
    (``snapshots``): other runs' files stay as they are, and the new version is complete
    before it becomes the current one. A job that fails leaves the old results, and
    results may be read from the cache that is written. ``prune_cache`` removes what is no longer read.
    """
    spark = assessed.sparkSession
    version = max(snapshots.versions(spark, path), default=0)
    kept = cacheable(assessed)
    if resume and version:
        old = snapshots.read(spark, path, version)
        kept = kept.join(old.select(*STUDENT_KEY), STUDENT_KEY, "left_anti")
    return snapshots.commit(kept, path, RUN_KEY, None if resume else runs, version)


def read_cache(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The cached results of a version, the current one unless given; None before the first."""
    return snapshots.read(spark, path, version)


def prune_cache(spark: SparkSession, path: str, keep: int = 1) -> None:
    snapshots.prune(spark, path, keep)


def label_sheet(predicted: DataFrame, concepts: list[str], keys: list[str] = RUN_KEY) -> DataFrame:
    """One row per student, one column per concept (sorted), by student number.

    A concept that a result holds twice shows its first label.
    """
    order = F.col("pos") if "pos" in predicted.columns else F.col("label")
    return (
        predicted.groupBy(*keys, "student_id")
        .pivot("key_concept", sorted(concepts))
        .agg(F.min_by("label", order))
        .withColumn("_n", _number())
        .orderBy(*keys, "_n")
        .drop("_n")
        .withColumnRenamed("student_id", "student")
    )


def _number():
    return F.split_part("student_id", F.lit("_"), F.lit(2)).try_cast("bigint")


def label_sheets(predicted: DataFrame, rubric: DataFrame, keys: list[str] = RUN_KEY) -> DataFrame:
    """The sheets of all runs as one table: run key, student, concepts, labels.

    ``rubric`` (run key, key_concept) names the columns of a run's sheet, which are
    sorted in ``concepts``; ``labels`` is in their order, NULL where a student has none
    of a concept. A concept that a result holds twice shows its first label, as in
    ``label_sheet``. A run without any result has one row with a NULL student, so its sheet has
    a header; runs without a rubric and concepts outside of it have no column.
    """
    order = F.col("pos") if "pos" in predicted.columns else F.col("label")
    headers = rubric.groupBy(*keys).agg(F.array_sort(F.collect_set("key_concept")).alias("concepts"))
    own = (
        predicted.groupBy(*keys, "student_id", "key_concept")
        .agg(F.min_by("label", order).alias("label"))
        .where(F.col("key_concept").isNotNull())
        .groupBy(*keys, "student_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("key_concept", "label"))).alias("_own"))
        .withColumn("number", _number())
    )
    labels = F.transform("concepts", lambda c: F.try_element_at("_own", c))
    return headers.join(own, keys, "left").select(
        *keys, F.col("student_id").alias("student"), "number", "concepts", labels.alias("labels")
    )


def _csv_line(first, cells):
    """A line of comma-separated cells, quoted where needed."""

    def cell(text):
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(text.rlike('[",\\r\\n]|^\\s|\\s$'), quoted).otherwise(F.coalesce(text, F.lit("")))

    return F.array_join(F.transform(F.concat(F.array(first), cells), cell), ",")


def write_label_sheets(sheets: DataFrame, path: str, keys: list[str] = RUN_KEY, rows_per_file: int = 1_000_000) -> None:
    """Write the table of ``label_sheets`` in one job, every file under its run's own header.

    ``<path>/<run key>/part=<n>/`` holds one file; a run has as many as its students
    need, so no run is the work of a single task. Rows are by student number in a file.
    """
    sheets = materialize(sheets, "label-sheets")  # read for the sizes and the rows
    sizes = sheets.groupBy(*keys).agg(F.ceil(F.count("student") / rows_per_file).alias("files"), F.first("concepts").alias("concepts"))
    heads = sizes.select(
        *keys, F.explode(F.sequence(F.lit(0), F.greatest(F.col("files") - 1, F.lit(0)).cast("int"))).alias("part"),
        F.lit(0).alias("_body"), F.lit(None).cast("bigint").alias("number"), F.lit("").alias("student"),
        _csv_line(F.lit("student"), F.col("concepts")).alias("value"),
    )
    part = F.pmod(F.xxhash64("student"), F.greatest("files", F.lit(1))).cast("int")
    body = sheets.where(F.col("student").isNotNull()).join(sizes.select(*keys, "files"), keys).select(
        *keys, part.alias("part"), F.lit(1).alias("_body"), "number", "student",
        _csv_line(F.col("student"), F.col("labels")).alias("value"),
    )
    lines = heads.unionByName(body).repartition(*keys, "part").sortWithinPartitions(*keys, "part", "_body", "number", "student")
    lines.select(*keys, "part", "value").write.mode("overwrite").partitionBy(*keys, "part").text(path)


def write_label_sheet(sheet: DataFrame, path: str) -> None:
    sheet.write.mode("overwrite").option("header", True).csv(path)


def write_tables(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """Every table of a report under its name."""
    for name, table in tables.items():
        table.write.mode("overwrite").format(fmt).save(f"{path}/{name}")
