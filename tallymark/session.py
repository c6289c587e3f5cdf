"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

# What the jobs rely on: runtime re-planning (skewed joins are split, small
# sides become broadcasts after they were measured) and UTC timestamps.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Parsing answers and programs is heavy per byte: keep small shuffles wide.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(app: str = "tallymark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share.

    The folder named in ``spark.checkpoint.dir``, or ``_scratch`` in the warehouse
    (``spark.sql.warehouse.dir``), which executors share as well. Outside local mode
    the warehouse must have been set: its default is a folder of the driver's machine.
    What was made is removed when the driver ends.
    """
    setting, warehouse = "spark.checkpoint.dir", "spark.sql.warehouse.dir"
    own = spark.sparkContext.getConf()
    base = spark.conf.get(setting, None) or own.get(setting, None)
    if not base:
        local = spark.sparkContext.master.split("[")[0] == "local"
        if not local and not own.contains(warehouse):
            raise ValueError(f"set {setting} to a folder that driver and executors share")
        base = spark.conf.get(warehouse).rstrip("/") + "/_scratch"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


_made: list[str] = []


def made_so_far() -> int:
    """How many folders this process has made and not removed, for ``discard``."""
    return len(_made)


def discard(since: int, keep: int = 0) -> None:
    """Delete the folders made after ``since`` others, but for the last ``keep``.

    For a chain of steps whose tables are not read again once the next one is stored.
    """
    _delete(_made, since, len(_made) - keep)


@atexit.register
def remove_made() -> None:
    """Delete the folders that ``shared_folder`` has named in this process."""
    _delete(_made, 0, len(_made))


def _delete(made: list[str], first: int, last: int) -> None:
    jvm = SparkContext._jvm
    if jvm is None:
        return
    for name in made[first:last]:
        try:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)
        except Exception:  # noqa: BLE001 - the JVM or the store has gone already
            return
    del made[first:last]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several branches of a job read the same costly rows; unlike a
    cache, the written table survives the loss of executors.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
