"""Helpers shared by the operators: Arrow tasks, chunks and bounded samples."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# Characters of text that a task holds as tokens at one time.
CHUNK_CHARS = 2_000_000


def widened(df: DataFrame, added: str = "") -> T.StructType:
    """The columns of ``df``, all nullable, and those of the DDL text ``added``."""
    own = [T.StructField(f.name, f.dataType, True) for f in df.schema]
    return T.StructType(own + (T.StructType.fromDDL(added).fields if added else []))


def arrow_map(df: DataFrame, module: str, name: str, schema: str | T.StructType, *args) -> DataFrame:
    """``mapInArrow`` with the function ``name`` of ``module``.

    Tasks import the module instead of unpickling the function, so what it keeps
    at module level (vocabularies, word caches) outlives the task. A worker serves one
    operator at a time: what others have kept there is let go first.
    """
    root = ROOT

    def run(batches):
        import importlib
        import sys

        if root not in sys.path:
            sys.path.insert(0, root)
        common = importlib.import_module("tallymark.llm.common")
        common.serve(module)
        yield from getattr(importlib.import_module(module), name)(batches, *args)
        common.trim()

    return df.mapInArrow(run, schema)


_served = ""


def serve(module: str) -> None:
    """Let go of what other operators keep in this worker."""
    global _served
    if module == _served:
        return
    for name, other in list(sys.modules.items()):
        if name.startswith("tallymark.llm.") and name != module and hasattr(other, "release"):
            other.release()
    gc.collect()
    trim()
    _served = module


def trim() -> None:
    """Give memory that is free back to the system, which idle workers share with others."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def text_chunks(
    batches: Iterable[pa.RecordBatch], text: int, size: int = CHUNK_CHARS
) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with about ``size`` characters; null text is ''."""
    for batch in batches:
        values, start, chars = batch.column(text).to_pylist(), 0, 0
        for at, value in enumerate(values):
            chars += len(value) if value else 0
            if chars >= size or at + 1 == len(values):
                yield batch.slice(start, at + 1 - start), [v or "" for v in values[start : at + 1]]
                start, chars = at + 1, 0


def held_out(doc_id: Column | str) -> Column:
    """True for the fifth of the documents that no model learns from."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def lowest_rows(rows: DataFrame, most: dict[str, int] | int) -> list[Row]:
    """At most ``most`` different rows of every label, those with the lowest ``order``.

    ``rows`` has label, order (a hash) and what to collect; rows of one label and
    order count once. A threshold per label keeps all but about twice as many rows
    out of the sort. Where a label's few hashes all lie above it, its rows are taken
    without one, so that no label that occurs is missed.
    """
    spark = rows.sparkSession
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    most = dict.fromkeys(counts, most) if isinstance(most, int) else most
    more = [c for c in rows.columns if c not in ("label", "order")]
    window = Window.partitionBy("label").orderBy("order")

    def lowest(near: DataFrame) -> list[Row]:
        once = near.groupBy("label", "order").agg(*[F.min(c).alias(c) for c in more])
        limits = spark.createDataFrame([(k, most.get(k, 0)) for k in counts], "label string, most long")
        ranked = once.withColumn("rank", F.row_number().over(window)).join(F.broadcast(limits), "label")
        return ranked.where("rank <= most").drop("most").collect()

    if not counts:
        return []
    # As many rows as there are labels, which the caller holds anyway.
    shares = [(k, int(min(1.0, (2 * most.get(k, 0) + 20) / n) * 1_000_003)) for k, n in counts.items()]
    shares = F.broadcast(spark.createDataFrame(shares, "label string, share long"))
    found = lowest(rows.join(shares, "label").where(F.pmod("order", F.lit(1_000_003)) < F.col("share")).drop("share"))
    missed = set(counts) - {r["label"] for r in found}
    if missed:
        found += lowest(rows.where(F.col("label").isin(list(missed))))
    return sorted(found, key=lambda r: (r["label"], r["rank"]))


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ordinal_rows(rows: DataFrame, times: Column, name: str) -> DataFrame:
    """Each row ``times`` times, numbered from 1 in ``name``."""
    return rows.withColumn(name, F.explode(F.sequence(F.lit(1), times.cast("int"))))


def free_name(columns: list[str], name: str) -> str:
    """``__name``, or longer, so that no column has it (Spark ignores the case)."""
    taken, name = {c.lower() for c in columns}, "__" + name
    while name in taken:
        name += "_"
    return name
