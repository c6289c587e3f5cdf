"""Exact duplicates by an extendible-hash index on shared files.

Every distinct text has one entry: its hash, the row with the largest doc_id, and
how many rows hold it. Map tasks combine equal texts of a batch first, so a text
that fills a third of the rows reaches its owner as one entry per batch. The hash
space is cut into key ranges of about ``RANGE_BYTES``; the owner task of a range inserts the entries into
an extendible-hash directory (overfull buckets split, the directory doubles),
chains different texts of one hash and tells equal texts by comparing bytes. The
index is a Parquet table in the shared folder, written by Spark's committer, so a
lost executor only repeats its ranges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import arrow_map, ordinal_rows, widened
from tallymark.session import materialize

# Distinct hashes a bucket holds before it splits.
BUCKET = 256
# Least number of key ranges per owner task; a range is what a task holds in memory at a time.
RANGES_PER_TASK = 4
# Bytes of text of a range, about: ranges are as many as the input needs.
RANGE_BYTES = 32 << 20
MARK = "__x_"  # prefix of the columns the index adds; see ``mark_for``
DEALT = ("hash", "n", "ties", "owner")  # what rows carry to their owner, behind their own columns


class ExtendibleIndex:
    """Hash -> chain of entries, in buckets under a doubling directory."""

    def __init__(self, capacity: int = BUCKET):
        self.capacity, self.depth = capacity, 0
        self.directory: list[dict] = [{"depth": 0, "bits": 0, "chains": {}}]

    def chain(self, key: int) -> list:
        """The chain of ``key``, made if new; splits the bucket if it is full."""
        while True:
            bucket = self.directory[key & (1 << self.depth) - 1]
            if key in bucket["chains"]:
                return bucket["chains"][key]
            if len(bucket["chains"]) < self.capacity or bucket["depth"] == 64:
                return bucket["chains"].setdefault(key, [])
            self._split(bucket)

    def _split(self, bucket: dict) -> None:
        bit = bucket["depth"]
        if bit == self.depth:
            self.directory += self.directory
            self.depth += 1
        chains = bucket["chains"]
        halves = [{"depth": bit + 1, "bits": bucket["bits"] | side << bit, "chains": {}} for side in (0, 1)]
        for key, chain in chains.items():
            halves[key >> bit & 1]["chains"][key] = chain
        for side in halves:
            for slot in range(side["bits"], len(self.directory), 1 << bit + 1):
                self.directory[slot] = side

    def buckets(self) -> list[dict]:
        return list({id(b): b for b in self.directory}.values())


def _newer(a, b) -> bool:
    """True when doc_id ``a`` beats ``b``; null is below every id."""
    return a is not None and (b is None or a > b)


def _combine(batches, text: int, key: int, mark: str = MARK) -> Iterator[pa.RecordBatch]:
    """One row per distinct text of a batch, with its hash and counts."""
    for batch in batches:
        best: dict[str, list] = {}
        ids = batch.column(key).to_pylist()
        for at, value in enumerate(batch.column(text).to_pylist()):
            entry = best.get(value or "")
            if entry is None:
                best[value or ""] = [at, 1, 1]
                continue
            entry[1] += 1
            if _newer(ids[at], ids[entry[0]]):
                entry[0], entry[2] = at, 1
            elif ids[at] == ids[entry[0]]:
                entry[2] += 1
        if not best:
            continue
        hashes = np.array([xxhash.xxh64_intdigest(t.encode()) for t in best], dtype=np.uint64).view(np.int64)
        rows = batch.take(pa.array([e[0] for e in best.values()], pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [*rows.columns, pa.array(hashes), pa.array([e[1] for e in best.values()], pa.int64()),
             pa.array([e[2] for e in best.values()], pa.int64())],
            names=[*batch.schema.names, mark + "hash", mark + "n", mark + "ties"],
        )


class KeyRange:
    """The entries of one key range, indexed batch by batch.

    Of a batch only rows that are an entry stay in memory, so a text's repeats are gone
    at once; rows that a later one replaced are dropped when they outnumber the others.
    An entry is [batch, row in it, rows with the text, rows that tie with it].
    """

    def __init__(self, text: int, key: int, capacity: int, mark: str):
        self.text, self.key, self.mark = text, key, mark
        self.index, self.held = ExtendibleIndex(capacity), []
        self.live = self.replaced = 0

    def _cell(self, entry: list, column: int):
        return self.held[entry[0]].column(column)[entry[1]].as_py()

    def add(self, batch: pa.RecordBatch) -> None:
        column = lambda name: batch.column(batch.schema.names.index(self.mark + name)).to_pylist()
        texts, ids, here = batch.column(self.text), batch.column(self.key).to_pylist(), len(self.held)
        self.held.append(batch)
        placed: dict[int, list] = {}
        for at, (hashed, n, ties) in enumerate(zip(column("hash"), column("n"), column("ties"))):
            value = texts[at].as_py() or ""
            chain = self.index.chain(hashed & 0xFFFF_FFFF_FFFF_FFFF)
            entry = next((e for e in chain if (self._cell(e, self.text) or "") == value), None)
            if entry is None:
                entry = [here, at, n, ties]
                chain.append(entry)
                placed[id(entry)] = entry
                self.live += 1
                continue
            entry[2] += n
            mine = self._cell(entry, self.key)
            if _newer(ids[at], mine):
                self.replaced += entry[0] != here
                entry[0], entry[1], entry[3] = here, at, ties
                placed[id(entry)] = entry
            elif ids[at] == mine:
                entry[3] += ties
        self._keep(here, list(placed.values()))
        if self.replaced > self.live:
            self._drop_replaced()

    def _keep(self, piece: int, entries: list[list]) -> None:
        self.held[piece] = self.held[piece].take(pa.array([e[1] for e in entries], pa.int64()))
        for at, entry in enumerate(entries):
            entry[1] = at

    def _drop_replaced(self) -> None:
        alive: list[list] = [[] for _ in self.held]
        for entry, *_ in self._entries():
            alive[entry[0]].append(entry)
        for piece, entries in enumerate(alive):
            self._keep(piece, entries)
        self.replaced = 0

    def _entries(self) -> Iterator[tuple[list, int, int, int]]:
        """Entry, its bucket's bits and depth, its place in the chain."""
        for bucket in self.index.buckets():
            for chain in bucket["chains"].values():
                for place, entry in enumerate(chain):
                    yield entry, bucket["bits"], bucket["depth"], place

    def rows(self) -> Iterator[pa.RecordBatch]:
        """The index rows, one held batch at a time."""
        found: list[list] = [[] for _ in self.held]
        for row in self._entries():
            found[row[0][0]].append(row)
        longs = lambda values: pa.array(values, pa.int64())
        for piece, entries in zip(self.held, found):
            if not entries:
                continue
            chosen = piece.take(longs([e[1] for e, *_ in entries]))
            names, plain = chosen.schema.names, chosen.num_columns - len(DEALT)
            texts = chosen.column(self.text).to_pylist()
            added = {
                "owner": chosen.column(names.index(self.mark + "owner")),
                "bucket": longs([bits for _, bits, _, _ in entries]),
                "depth": longs([depth for _, _, depth, _ in entries]),
                "chain": longs([place for *_, place in entries]),
                "hash": chosen.column(names.index(self.mark + "hash")),
                "sha256": pa.array([hashlib.sha256((t or "").encode()).hexdigest() for t in texts], pa.string()),
                "n": longs([e[2] for e, *_ in entries]),
                "ties": longs([e[3] for e, *_ in entries]),
            }
            made = pa.RecordBatch.from_arrays(
                [*chosen.columns[:plain], *added.values()], names=names[:plain] + [self.mark + n for n in added]
            )
            for start in range(0, made.num_rows, 2000):
                yield made.slice(start, 2000)


def _own(batches, text: int, key: int, capacity: int, mark: str = MARK) -> Iterator[pa.RecordBatch]:
    """Index entries of each key range; the rows of a range come together."""
    held, current = None, None
    for batch in batches:
        owners = batch.column(batch.schema.names.index(mark + "owner")).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(owners)) + 1).tolist(), len(owners)]
        for start, end in zip(cuts, cuts[1:]):
            if end > start:
                if held is None or owners[start] != current:
                    if held is not None:
                        yield from held.rows()
                    held, current = KeyRange(text, key, capacity, mark), owners[start]
                held.add(batch.slice(start, end - start))
    if held is not None:
        yield from held.rows()


def mark_for(docs: DataFrame) -> str:
    """``MARK``, made longer while a column of ``docs`` begins with it."""
    mark = MARK
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    return mark


def build_index(docs: DataFrame, owners: int | None = None, capacity: int = BUCKET) -> DataFrame:
    """The index of ``docs``: one row per distinct text, stored in the shared folder.

    Columns: those of the row that stays, and ``__x_owner``, ``__x_bucket``,
    ``__x_depth``, ``__x_chain`` (place among different texts of one hash),
    ``__x_hash``, ``__x_sha256``, ``__x_n`` (rows with the text), ``__x_ties`` (rows
    that hold both the text and the doc_id that stays). Null text counts as ''; a
    null doc_id is below every id. Where a column of ``docs`` begins with ``__x_`` the prefix
    is longer (``mark_for``). ``owners`` is the number of owner tasks, the
    session's shuffle partitions unless given.
    """
    owners = owners or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names, mark = docs.columns, mark_for(docs)
    text, key = names.index("text"), names.index("doc_id")
    combined = widened(docs, f"{mark}hash bigint, {mark}n bigint, {mark}ties bigint")
    entries = arrow_map(docs, __name__, "_combine", combined, text, key, mark)
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    ranges = max(owners * RANGES_PER_TASK, -(-size // RANGE_BYTES))
    # The high bits choose the range, the low ones the place in its directory.
    owner = F.floor(F.shiftrightunsigned(mark + "hash", 32) * F.lit(ranges) / F.lit(2.0**32)).cast("bigint")
    dealt = entries.withColumn(mark + "owner", owner).repartition(owners, mark + "owner").sortWithinPartitions(mark + "owner")
    added = ", ".join(
        f"{mark}{n} {t}"
        for n, t in [("owner", "bigint"), ("bucket", "bigint"), ("depth", "bigint"), ("chain", "bigint"),
                     ("hash", "bigint"), ("sha256", "string"), ("n", "bigint"), ("ties", "bigint")]
    )
    return materialize(arrow_map(dealt, __name__, "_own", widened(docs, added), text, key, capacity, mark), "exact-index")


def decisions(docs: DataFrame, owners: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Equal texts form a group; the row with the largest doc_id stays. Of rows that
    repeat both text and doc_id exactly one is kept. Null text is ''; null ids come
    last and never equal another id. An empty table gives no rows; other columns are
    not read. The join finds a row's entry by SHA-256, which the index made from
    texts whose bytes it had compared.
    """
    docs = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text")
    index = build_index(docs, owners).select(
        F.col("doc_id").alias("keep_id"), F.col(MARK + "sha256").alias("text_sha256"), F.col(MARK + "n").alias("group_size")
    )
    # Repeated (doc_id, text) rows are counted, joined once and numbered again.
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    rows = docs.select("doc_id", sha.alias("text_sha256")).groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("times"))
    joined = ordinal_rows(rows.join(index, "text_sha256"), F.col("times"), "ordinal")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("ordinal") == 1)
    return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, owners: int | None = None) -> DataFrame:
    """``docs`` with one row per distinct text, that of the largest doc_id.

    All columns are kept, whatever their names; the rows come from the index, so texts
    move once. Null text equals '' (the row of the largest doc_id stays as it is); null ids
    lose against others; of repeated rows one stays; an empty table gives no rows.
    """
    return build_index(docs, owners).select(*docs.columns)
