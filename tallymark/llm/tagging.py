"""Token tagging shared by the secret and personal-data operators.

A token is described by the parts of its shape. Scores of a position sum the parts
of the token itself, of its neighbours and of its file, each with weights of its
own. Every distinct description is scored once and looked up afterwards.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.chains import Bags, Climber, Stream, pair_sums
from tallymark.llm.common import lowest_rows

# Bounds of the training sample.
SAMPLE_ROWS = 1_000
SAMPLE_CHARS = 20_000
ROUNDS = 20
CACHED = 400_000  # tokens a worker remembers

EDGE = "edge"  # stands before the first and after the last token
VIEWS = ("own", "left", "left2", "right", "file")

Span = tuple[int, int, int]  # kind, start, end


class Tokens(dict):
    """Numbers tokens; ``kinds`` and ``keys`` have their description and skip key."""

    def __init__(self, describe: Callable[[str], str], key: Callable[[str], int]):
        super().__init__()
        self.describe, self.key = describe, key
        self.names: dict[str, int] = {EDGE: 0}
        self.kinds, self.keys = [], []

    def __missing__(self, token: str) -> int:
        self[token] = number = len(self)
        self.kinds.append(self.names.setdefault(self.describe(token), len(self.names)))
        self.keys.append(self.key(token))
        return number

    def number(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Descriptions and skip keys of all tokens, one text after the other."""
        if len(self) > CACHED:
            self.clear()
            self.kinds, self.keys = [], []
        ids = np.array([i for tokens in docs for i in map(self.__getitem__, tokens)], dtype=np.int64)
        if not len(ids):
            return ids, ids
        return np.array(self.kinds, np.int64)[ids], np.array(self.keys, np.int64)[ids]


class Tagger:
    """Weights over description parts, and the chain's transitions."""

    def __init__(self, labels: int, names: dict[str, int], weights: np.ndarray, trans: np.ndarray, start: np.ndarray, tie: float = 0.0):
        self.labels, self.names, self.tie = labels, names, tie
        self.weights, self.trans, self.start = weights, trans, start
        self.tables = {view: np.zeros((0, labels), np.float32) for view in VIEWS}

    def state(self) -> dict:
        return {"labels": self.labels, "names": self.names, "weights": self.weights, "trans": self.trans, "start": self.start, "tie": self.tie}

    def bags(self, view: str, descriptions: list[str]) -> Bags:
        names = self.names
        return Bags([[names[n] for p in d.split() if (n := f"{view}:{p}") in names] for d in descriptions])

    def scores(self, views: dict[str, np.ndarray], tokens: Tokens) -> np.ndarray:
        total = None
        known = list(tokens.names)
        for view, ids in views.items():
            table = self.tables[view]
            listed = FILE_BUCKETS if view == "file" else known
            if len(table) < len(listed):
                table = np.concatenate([table, self.bags(view, listed[len(table) :]).scores(self.weights).astype(np.float32)])
                self.tables[view] = table
            total = table[ids] if total is None else total + table[ids]
        return total


# Share of a file's tokens that are not plain words, in steps.
FILE_BUCKETS = [f"f{i}" for i in range(6)]


def views_of(kinds: np.ndarray, sizes: np.ndarray, plain: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Description numbers as seen from each position, and where texts begin."""
    n, ends = len(kinds), np.cumsum(sizes)
    full = sizes > 0
    first = np.zeros(n, bool)
    first[(ends - sizes)[full]] = True
    last = np.zeros(n, bool)
    last[ends[full] - 1] = True
    left = np.roll(kinds, 1)
    left[first] = 0
    left2 = np.roll(left, 1)
    left2[first] = 0
    right = np.roll(kinds, -1)
    right[last] = 0
    odd = np.add.reduceat((~plain[kinds]).astype(np.int64), (ends - sizes)[full]) if full.any() else np.zeros(0, np.int64)
    share = odd / sizes[full]
    bucket = np.digitize(share, [0.005, 0.02, 0.05, 0.15, 0.4])
    file = np.repeat(bucket, sizes[full])
    return {"own": kinds, "left": left, "left2": left2, "right": right, "file": file}, first


def fit(
    docs: list[tuple[list[str], list[int]]],
    labels: int,
    tokens: Tokens,
    plain: Callable[[str], bool],
    beliefs: Callable | None = None,
) -> Tagger:
    """Weights from tagged texts by gradient ascent on the likelihood.

    ``beliefs`` (scores, first, keys, sizes, tagger) may replace forward-backward by
    message passing that also gives the gradient of ``tie``.
    """
    docs = [d for d in docs if d[0]]
    kinds, keys = tokens.number([t for t, _ in docs])
    sizes = np.array([len(t) for t, _ in docs], dtype=np.int64)
    gold = np.array([y for _, ys in docs for y in ys], dtype=np.int64)
    known = list(tokens.names)
    seen: Counter[str] = Counter()
    for description in known:
        seen.update(set(description.split()))
    names = {f"{v}:{p}": 0 for v in VIEWS if v != "file" for p in sorted(seen)} | {f"file:{p}": 0 for p in FILE_BUCKETS}
    names = {name: i for i, name in enumerate(names)}
    tagger = Tagger(labels, names, np.zeros((len(names), labels)), np.zeros((labels, labels)), np.zeros(labels), 0.5)
    if not docs:
        return tagger
    views, first = views_of(kinds, sizes, np.array([plain(d) for d in known]))
    bags = {v: tagger.bags(v, FILE_BUCKETS if v == "file" else known) for v in VIEWS}
    inner = np.flatnonzero(~first)
    pairs = np.zeros((labels, labels))
    np.add.at(pairs, (gold[inner - 1], gold[inner]), 1)
    starts = np.bincount(gold[first], minlength=labels)
    climb = Climber(rate=0.4)
    for _ in range(ROUNDS):
        scores = sum(bags[v].scores(tagger.weights)[ids] for v, ids in views.items())
        if beliefs is None:
            post, alpha, ahead = Stream(scores, first, tagger.trans, tagger.start).forward_backward()
        else:
            post, alpha, ahead, slope = beliefs(scores, first, keys, sizes, tagger, gold)
            tagger.tie = float(np.clip(tagger.tie + 0.1 * np.sign(slope), 0.0, 3.0))
        rest = -post.astype(np.float64)
        rest[np.arange(len(gold)), gold] += 1
        gradient = np.zeros_like(tagger.weights)
        for view, ids in views.items():
            size = len(FILE_BUCKETS) if view == "file" else len(known)
            per = np.stack([np.bincount(ids, rest[:, c], size) for c in range(labels)], axis=1)
            gradient += bags[view].gather(per, len(names))
        climb.step("weights", tagger.weights, gradient)
        climb.step("trans", tagger.trans, pairs - pair_sums(alpha, ahead, first, tagger.trans))
        climb.step("start", tagger.start, starts - post[first].sum(axis=0))
    return tagger


def sample_texts(docs: DataFrame, kinds: dict[str, Column], rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> list[str]:
    """Texts to learn from: at most ``rows`` of at most ``chars`` characters.

    Half of them are any rows, those with the lowest hash of doc_id and text; the other
    half is shared among ``kinds`` (conditions on ``text`` that hold where a pattern of
    the kind may match), so that a kind is learned however rare it is.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.where(F.col("text").isNotNull() & (F.length("text") <= chars))
    labels = F.array(F.lit("any"), *[F.when(holds, F.lit(kind)) for kind, holds in kinds.items()])
    order = F.xxhash64(F.lit(7), F.col("doc_id"), F.col("text"))
    labelled = texts.select(F.explode(F.array_compact(labels)).alias("label"), order.alias("order"), "text")
    most = {kind: rows // 2 // len(kinds) for kind in kinds}
    found = lowest_rows(labelled, most | {"any": rows - sum(most.values())})
    return list({r["order"]: r["text"] for r in found}.values())


def free_of(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of ``spans`` that overlap nothing in ``taken``."""
    taken = sorted(taken)
    out, at = [], 0
    for start, end in sorted(spans):
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if at == len(taken) or taken[at][0] >= end:
            out.append((start, end))
    return out


def span_text(spans: list[tuple[str, int, int]], order: dict[str, int]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], order[x[0]], x[2])))


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint cover of sorted intervals, so that overlap tests see each place once."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(runs):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def result_batches(batch: pa.RecordBatch, columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    arrays = [batch.column(0), *(pa.array(values, kind) for values, kind in columns.values())]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", *columns])


def plain_flags(tokens: Tokens, plain: Callable[[str], bool]) -> np.ndarray:
    return np.array([plain(d) for d in tokens.names])


Batches = Iterator[pa.RecordBatch]
