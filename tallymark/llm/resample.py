"""Importance resampling towards a target distribution over hashed word n-grams.

A text is scanned once: its words, joined by single blanks, give a running CRC-32
after every word. With the prefix CRCs ``P[a]`` and ``P[b]`` of the places where an
n-gram starts and ends, its own CRC is ``P[b] ^ shift(P[a], b - a)``: shifting a CRC
over k zero bytes is a linear map over GF(2), so it takes four table lookups per
n-gram and no byte of it is read again. The CRC modulo the number of buckets is the
feature. Tasks send one count per bucket, whatever they read; the table of gains has
one entry per bucket and is broadcast.

Drawing the highest noisy scores is sampling without replacement. Only numbers are
ranked: equal (doc_id, features, weight) rows are counted first, the counted rows are
sorted over all tasks by range, and a task's first rank follows from the totals of the
ranges before it (one number per task).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import arrow_map, ordinal_rows
from tallymark.session import materialize

BUCKETS = 10_000
LONGEST = 3  # words of an n-gram
MIN_WORDS = 20
PERCENT = 5
SEED = 42
# Text that a task scans at one time; its words and arrays take about forty times as much.
CHUNK_BYTES = 200_000

# Every ASCII byte but letters and digits is a separator; A-Z becomes a-z.
CLEAN = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 0x20 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


# ---- CRC-32 of substrings ------------------------------------------------------


def _zero_byte() -> np.ndarray:
    """What one zero byte makes of each of the 32 bits of a CRC."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(8):
        bits = (bits >> np.uint32(1)) ^ np.where(bits & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return bits


def _applied(matrix: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The GF(2) matrix (images of the 32 bits) times the vectors."""
    out = np.zeros_like(vectors)
    for bit in range(32):
        out ^= np.where(vectors >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


def _byte_tables(matrix: np.ndarray) -> np.ndarray:
    """The matrix as four tables, one per byte of the vector."""
    value = np.arange(256, dtype=np.uint32)
    return np.stack([_applied(matrix, value << np.uint32(8 * k)) for k in range(4)])


class Shifts:
    """Shifts of CRCs over any number of bytes: by table up to 255, by powers of 256 beyond."""

    def __init__(self):
        step = _zero_byte()
        matrix, tables = np.uint32(1) << np.arange(32, dtype=np.uint32), []
        for _ in range(256):
            tables.append(_byte_tables(matrix))
            matrix = _applied(step, matrix)
        self.short = np.stack(tables)  # [bytes, byte of the CRC, its value]
        self.high = []  # the shift over 256 * 2^k bytes
        for _ in range(32):
            self.high.append(_byte_tables(matrix))
            matrix = _applied(matrix, matrix)

    @staticmethod
    def _looked_up(table, crcs: np.ndarray) -> np.ndarray:
        out = table(0, crcs & np.uint32(255))
        for k in range(1, 4):
            out = out ^ table(k, crcs >> np.uint32(8 * k) & np.uint32(255))
        return out

    def over(self, crcs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Each CRC shifted over as many zero bytes as ``sizes`` says."""
        low = sizes & 255
        out = self._looked_up(lambda k, v: self.short[low, k, v], crcs)
        rest = sizes >> 8
        bit = 0
        while rest.any():
            at = np.flatnonzero(rest & 1)
            out[at] = self._looked_up(lambda k, v: self.high[bit][k, v], out[at])  # noqa: B023
            rest >>= 1
            bit += 1
        return out


_shifts: list[Shifts] = []


def shifts() -> Shifts:
    if not _shifts:
        _shifts.append(Shifts())
    return _shifts[0]


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(CLEAN).split() if text else []


def gram_crcs(texts: list[bytes | None], longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRCs of all n-grams of the texts, the text of each, and the words of each text."""
    parted = [words_of(t) for t in texts]
    counts = np.fromiter(map(len, parted), np.int64, len(parted))
    total = int(counts.sum())
    # The running CRCs: at the end of each word, and of the blank before it.
    ends, starts = np.empty(total, np.uint32), np.empty(total, np.uint32)
    at = 0
    for words in parted:
        if words:
            own = list(accumulate(words, lambda crc, word: crc32(word, crc32(b" ", crc)), initial=0))
            ends[at : at + len(words)] = own[1:]
            starts[at : at + len(words)] = own[:-1]
            at += len(words)
    blank = np.array([crc32(b" ", 0)], dtype=np.uint32)
    starts = shifts().over(starts, np.ones(total, np.int64)) ^ blank
    sizes = np.fromiter((len(w) for words in parted for w in words), np.int64, total)
    reach = np.cumsum(sizes + 1)  # bytes up to the end of each word
    owner = np.repeat(np.arange(len(parted)), counts)
    found, owners = [], []
    for n in range(1, longest + 1):
        if total < n:
            break
        inside = np.flatnonzero(owner[n - 1 :] == owner[: total - n + 1])
        last = inside + n - 1
        length = reach[last] - reach[inside] + sizes[inside]
        found.append(ends[last] ^ shifts().over(starts[inside], length))
        owners.append(owner[inside])
    if not found:
        return np.empty(0, np.uint32), np.empty(0, np.int64), counts
    return np.concatenate(found), np.concatenate(owners), counts


def _chunks(batches, text: int) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of the batches with about ``CHUNK_BYTES`` of text; only a slice's texts are copied."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start, size = 0, 0
        for at, own in enumerate(sizes):
            size += own
            if size >= CHUNK_BYTES or at + 1 == len(sizes):
                part = batch.slice(start, at + 1 - start)
                yield part, part.column(text).to_pylist()
                start, size = at + 1, 0


# ---- the two distributions -----------------------------------------------------


def _bucket_batches(batches, buckets: int, longest: int) -> Iterator[pa.RecordBatch]:
    """The task's features per bucket."""
    total = np.zeros(buckets, np.int64)
    for _, texts in _chunks(batches, 0):
        crcs, _, _ = gram_crcs(texts, longest)
        total += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["bucket", "n"])


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Features of the column ``text`` in each bucket, over all rows."""
    rows = texts.selectExpr("CAST(CAST(text AS STRING) AS BINARY) AS text")
    sums = arrow_map(rows, __name__, "_bucket_batches", "bucket int, n bigint", buckets, longest)
    out = np.zeros(buckets, np.int64)
    for row in sums.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row per bucket
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares, rounded down, per bucket."""
    size = len(source)
    all_source, all_target = float(source.sum()), float(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log((t + 1) * (all_source + size) / ((s + 1) * (all_target + size))))
            for s, t in zip(source.astype(float).tolist(), target.astype(float).tolist())
        ],
        dtype=np.int64,
    )


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Thousandths of the row's Gumbel noise, rounded down."""
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weight_batches(batches, table, longest: int, seed: int) -> Iterator[pa.RecordBatch]:
    gain = table.value
    for batch, texts in _chunks(batches, 1):
        crcs, owner, counts = gram_crcs(texts, longest)
        order = np.argsort(owner, kind="stable")
        summed = np.concatenate([[0], np.cumsum(gain[crcs[order] % np.uint32(len(gain))])])
        features = np.bincount(owner, minlength=len(texts))
        bounds = np.concatenate([[0], np.cumsum(features)])
        weight = summed[bounds[1:]] - summed[bounds[:-1]]
        ids = batch.column(0).to_pylist()
        score = weight + np.array([noise(i, seed) for i in ids], dtype=np.int64)
        arrays = [batch.column(0), *(pa.array(x.astype(np.int64)) for x in (counts, features, weight, score))]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_features", "weight", "score"])


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row; no shuffle."""
    rows = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(CAST(text AS STRING) AS BINARY) AS text")
    table = docs.sparkSession.sparkContext.broadcast(gain)
    schema = "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint"
    return arrow_map(rows, __name__, "_weight_batches", schema, table, longest, seed)


# ---- the draw --------------------------------------------------------------------


def _running_batches(batches) -> Iterator[pa.RecordBatch]:
    """Adds the rows before each counted row within its sorted partition."""
    from pyspark import TaskContext

    part, seen = TaskContext.get().partitionId(), 0
    for batch in batches:
        times = batch.column(batch.schema.names.index("times")).to_numpy()
        upto = np.cumsum(times) + seen
        more = [pa.array(np.full(len(times), part, np.int32)), pa.array(upto - times)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "part", "before"])
        seen = int(upto[-1]) if len(upto) else seen


def ranked(weighed: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """``weighed`` with ``rank``: 1, 2, ... for the drawn rows, null for the others.

    Of the N rows with at least ``min_words`` words, the floor(percent * N / 100) with
    the highest score are drawn; of equal scores those with the smaller doc_id, a null
    one last. Rows that are equal in every column get successive ranks.
    """
    names = ["doc_id", "n_words", "n_features", "weight", "score"]
    counted = weighed.groupBy(*names).agg(F.count(F.lit(1)).alias("times"))
    counted = materialize(counted, "weighed")
    long_enough = counted.where(F.col("n_words") >= min_words)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight"), F.asc("n_words")]
    parts = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_order = long_enough.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint, times bigint, part int, before bigint"
    placed = materialize(arrow_map(in_order, __name__, "_running_batches", schema), "ranked")
    totals = placed.groupBy("part").agg(F.sum("times").alias("n")).collect()  # one row per partition
    first, total = [], 0
    for row in sorted(totals, key=lambda r: r["part"]):
        first.append((row["part"], total))
        total += row["n"]
    drawn = percent * total // 100
    firsts = counted.sparkSession.createDataFrame(first, "part int, first bigint")
    rank = F.col("first") + F.col("before") + F.col("ordinal")
    out = ordinal_rows(placed.join(F.broadcast(firsts), "part"), F.col("times"), "ordinal")
    out = out.select(*names, F.when(rank <= drawn, rank).alias("rank"))
    short = ordinal_rows(counted.where(F.col("n_words") < min_words), F.col("times"), "ordinal")
    return out.union(short.select(*names, F.lit(None).cast("bigint").alias("rank")))


def draw(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS,
    buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_features, weight, score, rank.

    ``target`` has the texts to resemble. Null and empty texts have no words, no
    features and weight 0, and are never drawn (they have fewer than ``min_words``
    words); a null doc_id has the noise of the empty text and loses ties; very long
    texts are scanned whole; repeated rows are ranked one by one; other columns are not
    read. An empty table of documents gives no rows, an empty target only smoothed
    shares.
    """
    gain = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    return ranked(weigh(docs, gain, longest, seed), percent, min_words)
