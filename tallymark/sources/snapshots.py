"""Versioned tables: parts in folders, and a manifest that says what is in a version.

A manifest names, for each part, the groups (values of the key columns) that the
version reads from it. Writers fill a new part and put the next manifest in place with
one rename, which is what makes the version current; groups that did not change stay
where they are. A writer that fails before leaves the old version as it was, and of two
writers that began at the same version the second one fails. Readers are pinned to the
version they opened. Parts that no kept version names are removed by a step of its own
(``prune``). A manifest has a line per group, so it is read by the driver.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART = "part"


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, store = _at(spark, path)
    return store.exists(at)


def rename(spark: SparkSession, source: str, target: str, replace: bool = False) -> None:
    """One rename in the store; an error if the target is there already."""
    at, store = _at(spark, target)
    store.mkdirs(at.getParent())
    if replace:
        store.delete(at, True)
    if store.exists(at) or not store.rename(_at(spark, source)[0], at):
        raise FileExistsError(f"{target} is there already")


def versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions, the current one last."""
    at, store = _at(spark, f"{path}/_manifests")
    if not store.exists(at):
        return []
    return sorted(int(s.getPath().getName()) for s in store.listStatus(at) if s.getPath().getName().isdigit())


def _manifest(spark: SparkSession, path: str, version: int) -> dict:
    """{"schema": ..., "keys": [...], "parts": {part: [[key values], ...]}}"""
    if version == 0:
        return {"schema": None, "keys": [], "parts": {}}
    at, store = _at(spark, f"{path}/_manifests/{version:012d}")
    opened = store.open(at)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8"))
    finally:
        opened.close()


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The rows of a version, the current one unless given; None where there is none."""
    known = versions(spark, path)
    if not known:
        return None
    manifest = _manifest(spark, path, known[-1] if version is None else version)
    schema = T.StructType.fromJson(manifest["schema"])
    if not manifest["parts"]:
        return spark.createDataFrame([], schema)
    keys = manifest["keys"]
    listed = [(part, *group) for part, groups in manifest["parts"].items() for group in groups]
    named = spark.createDataFrame(listed, ", ".join(f"{k} string" for k in [PART, *keys]))
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField(PART, T.StringType())])).option("basePath", path)
    rows = rows.parquet(*[f"{path}/{PART}={part}" for part in manifest["parts"]])
    return rows.join(F.broadcast(named), [PART, *keys], "left_semi").select(*[f.name for f in schema.fields])


def commit(rows: DataFrame, path: str, keys: list[str], replaced: DataFrame | None = None, expected: int | None = None) -> int:
    """Add ``rows`` as a part, without the groups of ``replaced``; returns the version.

    ``keys`` are string columns. ``expected`` is the version that ``rows`` were made
    from: if another writer has committed since, this one fails and changes nothing
    (the name of its manifest is taken).
    """
    spark = rows.sparkSession
    if expected is None:
        expected = max(versions(spark, path), default=0)
    old = _manifest(spark, path, expected)
    gone = {tuple(r) for r in replaced.select(*keys).distinct().collect()} if replaced is not None else set()
    parts = {part: [g for g in groups if tuple(g) not in gone] for part, groups in old["parts"].items()}
    name = uuid.uuid4().hex
    rows.write.partitionBy(*keys).parquet(f"{path}/{PART}={name}")
    written = spark.read.schema(rows.schema).parquet(f"{path}/{PART}={name}")
    parts[name] = sorted([list(r) for r in written.select(*keys).distinct().collect()])
    fields = {f["name"]: f for f in (old["schema"] or {"fields": []})["fields"]}
    fields |= {f["name"]: f for f in json.loads(rows.schema.json())["fields"]}
    manifest = {
        "schema": {"type": "struct", "fields": list(fields.values())},
        "keys": keys,
        "parts": {part: groups for part, groups in parts.items() if groups},
    }
    made = f"{path}/_manifests/.{name}"
    at, store = _at(spark, made)
    store.mkdirs(at.getParent())
    out = store.create(at, False)
    try:
        out.write(bytearray(json.dumps(manifest).encode()))
    finally:
        out.close()
    rename(spark, made, f"{path}/_manifests/{expected + 1:012d}")
    return expected + 1


def prune(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Remove all but the last ``keep`` versions, and the parts that none of them names.

    Not while anyone writes: a part that is being filled is named by no version yet.
    """
    known = versions(spark, path)
    if not known:
        return
    kept = {part for v in known[-keep:] for part in _manifest(spark, path, v)["parts"]}
    for version in known[:-keep]:
        at, store = _at(spark, f"{path}/_manifests/{version:012d}")
        store.delete(at, False)
    at, store = _at(spark, path)
    for status in store.listStatus(at):
        name = status.getPath().getName()
        if name.startswith(f"{PART}=") and name.removeprefix(f"{PART}=") not in kept:
            store.delete(status.getPath(), True)
