"""URL rules: a blocked Bloom filter in front of an exact hash join.

A rule is a host and the beginning of a path; it fits its host and all subdomains.
Keys are the canonical ``host + path`` of the listed rules. A url can only meet keys
of the shapes that occur in the list (number of host labels, length of path), so it
has one candidate key per shape. The candidates are looked up in a blocked Bloom
filter: one block of 256 bits per key, one bit in each of its eight words. Keys that
pass are joined with the list, which removes false positives, and the longest rule
wins. The filter's size is bounded by ``MAX_BLOCKS`` whatever the list; its blocks
are built by a distributed aggregate and it alone goes to every task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import arrow_map
from tallymark.session import materialize

WORDS = 8  # of 32 bits, in a block
KEYS_PER_BLOCK = 8
MAX_BLOCKS = 1 << 20  # 32 MB
DEFAULT = "allow"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?`` or ``#``, A-Z in lower case; else ''."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?`` or ``#``; else ''."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def canonical_rules(rules: DataFrame) -> DataFrame:
    """Stored list: key, verdict, labels (of the host), path_length.

    Hosts are lower-cased; rules without host are left out; of equal rules with
    different verdicts, block stays.
    """
    host = F.translate(F.col("host"), UPPER, LOWER)
    listed = rules.where(F.col("host") != "").select(
        F.concat(host, F.coalesce("path", F.lit(""))).alias("key"),
        F.size(F.split(host, r"\.")).alias("labels"),
        F.length(F.coalesce("path", F.lit(""))).alias("path_length"),
        "verdict",
    )
    grouped = listed.groupBy("key", "labels", "path_length").agg(F.max("verdict").alias("verdict"))
    return materialize(grouped, "url-rules")


def bloom_blocks(keys: DataFrame, blocks: int) -> np.ndarray:
    """The filter over column ``key`` as an array of blocks x WORDS."""
    hashed = F.xxhash64("key")
    bit = [F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(h, {5 * i}) & 31 AS INT))") for i in range(WORDS)]
    place = F.shiftrightunsigned("h", 5 * WORDS) % blocks
    made = keys.select(hashed.alias("h")).groupBy(place.alias("block")).agg(*[F.bit_or(b).alias(f"w{i}") for i, b in enumerate(bit)])
    table = made.toArrow()  # at most ``blocks`` rows
    out = np.zeros((blocks, WORDS), dtype=np.uint32)
    at = table.column("block").to_numpy()
    for i in range(WORDS):
        out[at, i] = table.column(f"w{i}").to_numpy().astype(np.uint32)
    return out


def passes(keys: list[str], blocks: np.ndarray) -> np.ndarray:
    """True for keys whose eight bits are all set."""
    h = np.array([xxhash.xxh64_intdigest(k.encode(), 42) for k in keys], dtype=np.uint64)
    block = blocks[(h >> np.uint64(5 * WORDS)) % np.uint64(len(blocks))]
    shifts = np.arange(WORDS, dtype=np.uint64) * np.uint64(5)
    bits = ((h[:, None] >> shifts) & np.uint64(31)).astype(np.uint32)
    return (block >> bits & np.uint32(1)).all(axis=1)


def candidates(host: str, path: str, shapes: dict[int, list[int]]) -> list[str]:
    """One possible key per shape of the list."""
    found, labels = [], host.split(".")
    for count, lengths in shapes.items():
        if host and count <= len(labels):
            suffix = ".".join(labels[len(labels) - count :])
            found += [suffix + path[:size] for size in lengths if size <= len(path)]
    return found

# Rows of one set of candidates meet their verdict under so many keys.
SALTS = 32


def _probe_batches(batches, blocks: np.ndarray, shapes: dict[int, list[int]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        asked = [candidates(h, p, shapes) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        flat = [key for keys in asked for key in keys]
        good = passes(flat, blocks) if flat else np.zeros(0, bool)
        kept, at = [], 0
        for keys in asked:
            kept.append([k for k, ok in zip(keys, good[at : at + len(keys)]) if ok])
            at += len(keys)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept, pa.list_(pa.string()))], names=[*batch.schema.names, "keys"])


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule and verdict.

    ``rules`` has host, path and verdict (allow or block). A url without rule gets a
    null rule and ``default``, as do null urls and those without ``://``, whose host
    and path are empty. Of rules of one length the one with the longer host wins. An
    empty list leaves everything to the default. Repeated rows are kept; null ids
    too; other columns are not read.
    """
    listed = canonical_rules(rules)
    sizes = listed.select("labels", "path_length").distinct().collect()  # at most labels x path lengths
    shapes: dict[int, list[int]] = {}
    for row in sorted((r["labels"], r["path_length"]) for r in sizes):
        shapes.setdefault(row[0], []).append(row[1])
    blocks = min(MAX_BLOCKS, 1 + listed.count() // KEYS_PER_BLOCK)
    bloom = bloom_blocks(listed, blocks)
    url = F.col("url").cast("string")
    parted = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    probed = arrow_map(parted, __name__, "_probe_batches", "page_id bigint, host string, path string, keys array<string>", bloom, shapes)
    # Rows with the same candidates share their rule, so each set is judged once.
    sets = probed.where(F.size("keys") > 0).select("keys").distinct()
    order = F.struct(F.length("key"), F.length(F.substring_index("key", "/", 1)), "key")
    best = sets.select("keys", F.explode("keys").alias("key")).join(listed.select("key", "verdict"), "key")
    best = best.groupBy("keys").agg(F.max_by("key", order).alias("rule"), F.max_by("verdict", order).alias("verdict"))
    # Many rows share a set, most of all the empty one: a salt spreads them.
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    best = materialize(best, "url-verdicts").select("*", salts)
    salt = F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")
    found = probed.withColumn("salt", salt).join(best, ["keys", "salt"], "left")
    return found.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def parse_rule(text: str) -> tuple[str, str, str]:
    """(host, path, verdict) of a line like ``block example.com/en/``."""
    verdict, place = text.split()
    host, path = re.fullmatch(r"([^/]+)(.*)", place).groups()
    return host, path, verdict
