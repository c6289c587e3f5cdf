"""Near duplicates: 64-bit SimHash, BK-trees per shard, connected components.

Two fingerprints at most two bits apart agree in at least six of their eight
bytes. Every distinct fingerprint therefore goes to 28 shards, one for each choice
of six bytes; the fingerprints of a shard share those 48 bits, so a shard has at
most 65,536 of them, whatever the data: no shard is hot, and its BK-tree fits a
task. Queries travel to the one tree that can hold their partners (the shuffle of
the shards), which bounds what a broadcast of trees would not. A query follows only
the children whose edge is within the radius of its own distance. A shard emits
the edges of a spanning forest, not all pairs; components of the union of these
edges are the components of all links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.common import arrow_map, free_name, text_chunks, widened
from tallymark.llm.components import components
from tallymark.session import materialize

WORDS = 3
SEED = 42
RADIUS = 2
BLOCKS = 8

# One mask per choice of the two bytes that may differ.
MASKS = [
    ((1 << 64) - 1) & ~(0xFF << 8 * a) & ~(0xFF << 8 * b) for a, b in combinations(range(BLOCKS), RADIUS)
]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


# ---- fingerprints ------------------------------------------------------------


def shingle_hashes(text: str, words: int = WORDS) -> list[int]:
    """XXH64 of the shingles of the lower-cased (A-Z) text, repeats included."""
    parts = text.encode("utf-8", "replace").lower().split()  # splits at \x20 and \x09-\x0D
    if not parts:
        return []
    if len(parts) < words:
        shingles = [b" ".join(parts)]
    else:
        shingles = list(map(b" ".join, zip(*(parts[i:] for i in range(words)))))
    return list(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)))


def fingerprints(texts: list[str], words: int = WORDS) -> np.ndarray:
    """Bit is 1 where over half of the shingle hashes have it; no words give 0."""
    hashes = [shingle_hashes(t, words) for t in texts]
    sizes = np.array([len(h) for h in hashes])
    out = np.zeros(len(texts), dtype=np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.concatenate([np.array(hashes[i], dtype=np.uint64) for i in full])
        bits = np.unpackbits(flat.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * ones > sizes[full][:, None], axis=1).view(">u8").ravel()
    return out


def _fingerprint_batches(batches, text: int, words: int) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_chunks(batches, text, 500_000):
        made = pa.array(fingerprints(texts, words).view(np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["doc_id", "fp"])


def fingerprint(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and ``fp`` (the fingerprint's bits as a signed long) of every row."""
    rows = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text")
    return arrow_map(rows, __name__, "_fingerprint_batches", "doc_id bigint, fp bigint", 1, words)


# ---- links -------------------------------------------------------------------


class BkTree:
    """Children are keyed by their Hamming distance to the parent."""

    def __init__(self, root: int):
        self.values, self.children = [root], [{}]

    def near(self, value: int, radius: int) -> list[int]:
        """Places of the values within ``radius``."""
        found, todo = [], [0]
        values, children = self.values, self.children
        while todo:
            at = todo.pop()
            apart = (values[at] ^ value).bit_count()
            if apart <= radius:
                found.append(at)
            below = children[at]
            for edge in range(max(1, apart - radius), apart + radius + 1):
                child = below.get(edge)
                if child is not None:
                    todo.append(child)
        return found

    def add(self, value: int) -> int:
        at = 0
        while True:
            edge = (self.values[at] ^ value).bit_count()
            child = self.children[at].get(edge)
            if child is None:
                self.children[at][edge] = len(self.values)
                self.values.append(value)
                self.children.append({})
                return len(self.values) - 1
            at = child


def shard_edges(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct ``values``."""
    tree, parent, edges = BkTree(values[0]), [0], []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for value in values[1:]:
        near = tree.near(value, radius)
        me = tree.add(value)
        parent.append(me)
        for other in near:
            a, b = root(me), root(other)
            if a != b:
                parent[a] = b
                edges.append((value, tree.values[other]))
    return edges


def _link_batches(batches, masks: list[int], radius: int) -> Iterator[pa.RecordBatch]:
    """Edges of the shards; rows come sorted by shard, so a shard is a run."""
    masks_ = np.array(masks, dtype=np.uint64)
    left_p, left_fp = np.empty(0, np.int64), np.empty(0, np.uint64)

    def linked(p: np.ndarray, fp: np.ndarray, last: bool):
        nonlocal left_p, left_fp
        kept = fp & masks_[p]
        new = np.flatnonzero((np.diff(p) != 0) | (np.diff(kept) != 0)) + 1
        cuts = np.concatenate([[0], new, [len(fp)]])
        if not last:  # the last run may go on in the next batch
            left_p, left_fp = p[cuts[-2] :], fp[cuts[-2] :]
            cuts = cuts[:-1]
        edges = []
        for at in np.flatnonzero(np.diff(cuts) > 1):
            edges += shard_edges(fp[cuts[at] : cuts[at + 1]].tolist(), radius)
        if edges:
            ends = np.array(edges, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

    for batch in batches:
        if batch.num_rows:
            p = np.concatenate([left_p, batch.column(0).to_numpy().astype(np.int64)])
            fp = np.concatenate([left_fp, batch.column(1).to_numpy().view(np.uint64)])
            yield from linked(p, fp, last=False)
    if len(left_fp):
        yield from linked(left_p, left_fp, last=True)


def links(distinct: DataFrame) -> DataFrame:
    """Spanning edges ``a, b`` among the distinct fingerprints in column ``fp``.

    Edges found in several shards may repeat.
    """
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    masks = F.array([F.lit(_signed(m)) for m in MASKS])
    shards = (
        distinct.select("fp", F.posexplode(masks).alias("p", "mask"))
        .select("p", "fp", F.col("fp").bitwiseAND(F.col("mask")).alias("shard"))
        .repartition(parts, "p", "shard")
        .sortWithinPartitions("p", "shard", "fp")
        .select("p", "fp")
    )
    return arrow_map(shards, __name__, "_link_batches", "a bigint, b bigint", MASKS, RADIUS)


def classes(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp and component_id.

    Texts without words (null, empty, blanks) have fingerprint 0, which links like
    any other. component_id is the smallest doc_id reachable over links; null ids
    are passed over, and a component of null ids alone has a null one. Repeated rows
    are kept; other columns are not read; an empty table gives no rows. Fingerprints
    are stored once and made distinct before anything else, so a third of all rows
    with one fingerprint cost one row.
    """
    return classes_with_root(docs).select("doc_id", "fp", "component_id")


def classes_with_root(docs: DataFrame) -> DataFrame:
    """``classes`` and ``root``, the fingerprint that names the component."""
    rows = materialize(fingerprint(docs), "simhash")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = components(materialize(links(nodes.select("fp")).distinct(), "simhash-links"))
    labelled = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = labelled.select("fp", "root").join(least, "root").select("fp", "root", "component_id")
    return rows.join(labels, "fp").select("doc_id", "fp", "component_id", "root")


def drop_near(docs: DataFrame) -> DataFrame:
    """``docs`` with one row per component, all columns kept.

    The row with the smallest doc_id stays (of rows that repeat it, the one whose
    fingerprint is lowest, then one of them). Rows are found by (doc_id, fp), which
    the map recomputes, so only rows of components with several members are listed
    as losers; a component of null ids alone keeps one row.
    """
    own, id_, fp, stay, times, row = (free_name(docs.columns, n) for n in ("own_fp", "id", "fp", "stays", "times", "row"))
    found = materialize(classes_with_root(docs), "simhash-classes")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("fp").alias("fp"))
    groups = found.groupBy("root").agg(F.min(first).alias("best"), F.count(F.lit(1)).alias("rows"))
    many = materialize(groups.where("rows > 1").select("root", "best"), "simhash-groups")
    members = found.join(many, "root").select(F.col("doc_id").alias(id_), F.col("fp").alias(fp), "best")
    stays = F.col(id_).eqNullSafe(F.col("best.id")) & (F.col(fp) == F.col("best.fp"))
    counted = members.groupBy(id_, fp, stays.alias(stay)).agg(F.count(F.lit(1)).alias(times))
    counted = materialize(counted.where(~F.col(stay) | (F.col(times) > 1)), "simhash-losers")
    marked = with_fingerprint(docs, own)
    same = F.col(own).eqNullSafe(F.col(fp)) & F.col("doc_id").eqNullSafe(F.col(id_))
    losers, repeated = counted.where(~F.col(stay)), counted.where(F.col(stay))
    kept = marked.join(losers, same, "left_anti")
    if not repeated.isEmpty():
        plain = kept.join(repeated, same, "left_anti")
        one = kept.join(repeated, same, "left_semi").withColumn(
            row, F.row_number().over(Window.partitionBy("doc_id", own).orderBy("text"))
        )
        kept = plain.unionByName(one.where(F.col(row) == 1).drop(row))
    return kept.select(*docs.columns)


def _append_batches(batches, text: int, words: int, name: str) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_chunks(batches, text, 500_000):
        made = pa.array(fingerprints(texts, words).view(np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, name])


def with_fingerprint(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` and their fingerprint in the new column ``name``."""
    return arrow_map(docs, __name__, "_append_batches", widened(docs, f"{name} bigint"), docs.columns.index("text"), WORDS, name)
