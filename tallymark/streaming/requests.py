"""The request path as a stream of files.

Two streams: programs with stored responses of known runs (``label_stream``), and
requests that bring their own prompt, rubric, examples and parameters
(``label_request_stream``). A micro-batch runs the batch plan and is committed by
renaming its finished folder, so that a batch repeated after a failure adds nothing
and readers never meet half of one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallymark.dims import STUDENT_KEY
from tallymark.operators.metrics import run_totals
from tallymark.plans.label import label_submissions, run_settings
from tallymark.plans.requests import label_requests
from tallymark.sources.snapshots import exists, rename

RESPONSE_SCHEMA = (
    "dataset string, experiment string, lesson string, student_id string, "
    "code string, http_status int, body string"
)
REQUEST_SCHEMA = (
    "request_id string, received timestamp, form map<string, string>, http_status int, body string, seconds double"
)


def read_response_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Programs and stored responses of known runs, from JSON files."""
    return _read(spark, path, RESPONSE_SCHEMA, files_per_batch)


def read_request_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Requests with their forms and answers, from JSON files."""
    return _read(spark, path, REQUEST_SCHEMA, files_per_batch)


def _read(spark: SparkSession, path: str, schema: str, files_per_batch: int) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def commit_batch(results: DataFrame, out: str, batch_id: int) -> None:
    """Write a batch as ``batch=<id>``, once: a repeated batch finds it there.

    The totals of the batch are gathered while it is written and go beside it, as
    ``totals/batch=<id>``. Written under a name that readers pass over, and renamed
    when complete; the totals come first, so a batch that is there has its own.
    """
    spark = results.sparkSession
    done, totals = f"{out}/results/batch={batch_id}", f"{out}/totals/batch={batch_id}"
    if exists(spark, done):
        return
    staged = f"{out}/_staged/{batch_id}-{uuid.uuid4().hex}"
    seen = Observation()
    results.observe(seen, *[value.alias(name) for name, value in run_totals().items()]).write.parquet(f"{staged}/results")
    spark.createDataFrame([tuple(seen.get.values())], TOTALS_SCHEMA).write.parquet(f"{staged}/totals")
    rename(spark, f"{staged}/totals", totals, replace=True)
    rename(spark, f"{staged}/results", done)


TOTALS_SCHEMA = (
    "n_results long, n_failed long, n_static long, prompt_tokens long, completion_tokens long, total_tokens long, seconds double"
)


def read_results(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/results")


def read_totals(spark: SparkSession, out: str) -> DataFrame:
    """Results, failures, tokens and seconds of every batch."""
    return spark.read.parquet(f"{out}/totals")


def _run(stream: DataFrame, labelled, out: str, checkpoint: str):
    """Label every batch and commit it; stops by itself once all present files are done."""

    def label_batch(batch: DataFrame, batch_id: int) -> None:
        kept = []

        def keep(df: DataFrame) -> DataFrame:
            kept.append(df.persist())
            return kept[-1]

        try:
            rows = keep(batch)
            # After the last rows a batch without any moves the watermark on: nothing to label.
            if batch_id > 0 and rows.isEmpty():
                return
            commit_batch(labelled(rows, keep), out, batch_id)
        finally:
            for df in kept:
                df.unpersist()

    return (
        stream.writeStream.foreachBatch(label_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def label_stream(responses: DataFrame, rubric_levels: DataFrame, params: DataFrame, out: str, checkpoint: str):
    """Label programs and responses of known runs."""
    settings = run_settings(params, rubric_levels)  # once, not in every batch

    def labelled(batch: DataFrame, keep) -> DataFrame:
        return label_submissions(
            batch.select(*STUDENT_KEY, "code"),
            rubric_levels,
            params,
            batch.select(*STUDENT_KEY, "http_status", "body"),
            keep=keep,
            settings=settings,
        )

    return _run(responses, labelled, out, checkpoint)


def label_request_stream(requests: DataFrame, out: str, checkpoint: str, replays: str = "1 hour"):
    """Label requests by their own settings.

    A request id that comes again within ``replays`` of the time it was received is a
    replay and dropped; the ids are remembered no longer than that. Requests without
    an id or a time are refused by the reader of a form, so they are left out here.
    """
    known = requests.where(F.col("request_id").isNotNull() & F.col("received").isNotNull())
    once = known.withWatermark("received", replays).dropDuplicatesWithinWatermark(["request_id"])
    return _run(once, lambda batch, keep: label_requests(batch, keep), out, checkpoint)
