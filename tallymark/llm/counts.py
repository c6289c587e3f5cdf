"""Token counts with a two-tier lookup and no shuffle of pre-tokens.

In the vocabulary no piece crosses the start of a word (a run of blanks and what
follows up to the next blank), so the count of a text is the sum over its words.
The first tier is a compact table of the lengths of the corpus' frequent words,
broadcast to every worker; the second is what the worker has encoded itself. The
frequent words are found over all rows: each task sums its words in a bounded
summary, and only the summaries' heads meet. Whatever the tables hold, counts are
the same: a missing word is encoded.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import arrow_map, text_chunks

# Words of the broadcast table (a bound), and of each task's part of it.
FREQUENT = 32_768
HEAD = 4_096
SUMMARY = 150_000  # words a task counts at a time
CACHED = 400_000  # words a worker remembers
SHORT = 48  # longer words are encoded and forgotten
LIMIT = 4_096

BLANK = "▁"  # stands for a blank in the vocabulary
PADDED = re.compile(r" +[^ ]*")


def words_of(text: str) -> list[str]:
    """Words with their leading blanks, but for the one blank that each has.

    The library puts a blank before a text and reads BLANK as one.
    """
    if not text:
        return []
    text = text.replace(BLANK, " ")
    if text[0] != " " and "  " not in text and text[-1] != " ":
        return text.split(" ")
    return [w[1:] for w in PADDED.findall(" " + text)]


class TokenCounter:
    """A worker's vocabulary and its two tables."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.known: dict[str, int] = {}
        self.frequent: dict[str, int] = {}
        self.mark = ""

    def load(self, frequent: list[str], lengths: np.ndarray, mark: str) -> None:
        if self.mark != mark:
            self.frequent, self.known, self.mark = dict(zip(frequent, lengths.tolist())), {}, mark

    def lengths(self, words: list[str]) -> list[int]:
        """Tokens of each word; the empty one is the blank that the library leaves out."""
        return [len(ids) if w else 1 for w, ids in zip(words, self.model.encode(words, num_threads=1))] if words else []

    def count(self, texts: list[str]) -> list[int]:
        split = [words_of(t) for t in texts]
        if len(self.known) > CACHED:
            self.known = {}
        known, frequent = self.known, self.frequent
        seen = set(chain.from_iterable(split))
        # The chunk's words in one small table: frequent ones, remembered ones, new ones.
        missed = [w for w in seen if w not in frequent and w not in known]
        own = dict(zip(missed, self.lengths(missed)))
        known.update((w, n) for w, n in own.items() if len(w) <= SHORT)
        table = {w: frequent[w] if w in frequent else own[w] if w in own else known[w] for w in seen}
        return [sum(map(table.__getitem__, words)) for words in split]


_counters: dict[str, TokenCounter] = {}


def release() -> None:
    """Forget what this worker keeps between tasks."""
    _counters.clear()


def counter(path: str) -> TokenCounter:
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def _summary_batches(batches) -> Iterator[pa.RecordBatch]:
    """The task's most frequent words and their counts."""
    seen: Counter[str] = Counter()
    for _, texts in text_chunks(batches, 0):
        seen.update(w for t in texts for w in words_of(t))
        if len(seen) > SUMMARY:
            seen = Counter(dict(seen.most_common(SUMMARY // 4)))
    head = [(w, n) for w, n in seen.most_common(HEAD) if n > 2 and len(w) <= SHORT]
    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in head], pa.string()), pa.array([n for _, n in head], pa.int64())], names=["word", "n"])


def frequent_words(texts: DataFrame, size: int = FREQUENT) -> list[str]:
    """At most ``size`` words that fill the corpus, over all rows of column ``text``."""
    heads = arrow_map(texts.select("text"), __name__, "_summary_batches", "word string, n bigint")
    ranked = heads.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size)
    return [r["word"] for r in ranked.collect()]


def _count_batches(batches, path: str, table) -> Iterator[pa.RecordBatch]:
    own = counter(path)
    own.load(*table.value)
    for batch, texts in text_chunks(batches, 1, 1_000_000):
        sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
        counts = pa.array(own.count(texts), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), sizes, counts], names=["doc_id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, size: int = FREQUENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    Counts are those of the whole text without begin and end tokens. Null and empty
    texts have none; special strings are ordinary text, as in the library; repeated
    rows and null ids are kept; no other column is read.
    """
    docs = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text")
    frequent = frequent_words(docs, size)
    lengths = np.array(counter(path).lengths(frequent), dtype=np.uint16)
    mark = xxhash.xxh64_hexdigest("\n".join([path, *frequent]))
    table = docs.sparkSession.sparkContext.broadcast((frequent, lengths, mark))
    counted = arrow_map(docs, __name__, "_count_batches", "doc_id bigint, n_bytes bigint, n_tokens bigint", path, table)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
