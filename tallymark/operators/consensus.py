"""Majority vote over a long table of votes.

A vote is (run key, student_id, key_concept, choice_index, row_index, label,
observations, evidence, reason). One concept of one student may hold a large
share of all votes, so votes become runs of equal labels within a block of choices
first; only those runs meet on the concept, and the vote text is written from them
where labels differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallymark.dims import STUDENT_KEY

CHOICES_PER_BLOCK = 256


def _order():
    return F.struct(F.col("choice_index").cast("bigint").alias("c"), F.col("row_index").cast("bigint").alias("r"))


def _earlier(order):
    """Sort key under which an earlier vote is the larger one."""
    return F.struct((-order["c"]).alias("c"), (-order["r"]).alias("r"))


def vote_runs(votes: DataFrame, keys: list[str] = STUDENT_KEY) -> DataFrame:
    """Votes of one block of choices that follow each other with one label, as one row.

    ``n`` votes, the place of the first, and the texts kept. Blocks hold disjoint,
    ascending choices, so runs of different blocks never interleave.
    """
    block = [*keys, "key_concept", "_block"]
    votes = votes.withColumn("_ord", _order()).withColumn("_block", F.floor(F.col("choice_index") / CHOICES_PER_BLOCK))
    in_order = W.partitionBy(*block).orderBy("_ord", "label")
    before = F.lag(F.struct("label")).over(in_order)
    return (
        votes.withColumn("_new", (~before.eqNullSafe(F.struct("label"))).cast("int"))
        .withColumn("_run", F.sum("_new").over(in_order))
        .groupBy(*block, "_run", "label")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.struct("_ord", "observations", "evidence")).alias("_first"),
            F.max(F.struct("_ord", "reason")).alias("_last"),
        )
    )


def vote_counts(votes: DataFrame, keys: list[str] = STUDENT_KEY) -> DataFrame:
    """Per label: number of votes, its first and last place, and the texts kept.

    Observations and evidence come from the first vote for the label, the
    reason from the last one. ``_runs`` has the label's runs: place and length.
    """
    return (
        vote_runs(votes, keys)
        .repartition(*keys, "key_concept")
        .groupBy(*keys, "key_concept", "label")
        .agg(
            F.sum("n").alias("n"),
            F.min("_first").alias("_first"),
            F.max("_last").alias("_last"),
            F.collect_list(F.struct(F.col("_first._ord").alias("o"), F.col("n"))).alias("_runs"),
        )
    )


def _repeated(run):
    """A run's label once per vote; NULL, which the text passes over, stays NULL."""
    again = F.repeat(F.concat(F.lit(", "), run["l"]), (run["n"] - 1).cast("int"))
    return F.concat(run["l"], again)


def consensus(votes: DataFrame, keys: list[str] = STUDENT_KEY) -> DataFrame:
    """One row per student and concept.

    A tie goes to the label seen first. Where labels differ the reason starts
    with all votes in order; ``first_label`` is the label of the first vote and
    ``first_choice``/``first_row`` order the concepts by first appearance.
    """
    counts = vote_counts(votes, keys)
    first = F.col("_first")
    won = F.struct(
        F.col("label"),
        first["observations"].alias("observations"),
        F.coalesce(first["evidence"], F.lit("")).alias("evidence"),
        F.col("_last")["reason"].alias("reason"),
    )
    marks = F.transform("_runs", lambda r: F.struct(r["o"].alias("o"), F.col("label").alias("l"), r["n"].alias("n")))
    groups = (
        counts.withColumn("_marks", marks)
        .groupBy(*keys, "key_concept")
        .agg(
            F.max_by(won, F.struct(F.col("n"), _earlier(first["_ord"]))).alias("_won"),
            F.min(F.struct(first["_ord"].alias("o"), F.col("label").alias("l"))).alias("_seen"),
            F.count(F.lit(1)).alias("n_labels"),
            F.sum("n").alias("n_votes"),
            F.flatten(F.collect_list("_marks")).alias("_marks"),
        )
    )
    shown = F.array_join(F.transform(F.array_sort("_marks"), _repeated), ", ")
    prefix = F.when(
        F.col("n_labels") > 1, F.concat(F.lit("<b>Votes: ["), shown, F.lit("]</b><br>"))
    ).otherwise("")
    return groups.select(
        *keys,
        "key_concept",
        F.col("_won.label").alias("label"),
        F.col("_won.observations").alias("observations"),
        F.col("_won.evidence").alias("evidence"),
        F.concat(prefix, F.coalesce(F.col("_won.reason"), F.lit("None"))).alias("reason"),
        F.col("_seen.l").alias("first_label"),
        F.col("_seen.o.c").alias("first_choice"),
        F.col("_seen.o.r").alias("first_row"),
        "n_votes",
        "n_labels",
    )


def outvoted(voted: DataFrame) -> DataFrame:
    """Groups whose first vote lost."""
    return voted.where(F.col("first_label") != F.col("label"))


def concept_order(voted: DataFrame, keys: list[str] = STUDENT_KEY) -> DataFrame:
    """Per student, its concepts in order of first appearance (bounded by the rubric)."""
    entry = F.struct("first_choice", "first_row", "key_concept")
    return voted.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["key_concept"]).alias("concepts")
    )
