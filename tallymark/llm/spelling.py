"""Grouping of spelling variants one edit apart, by pivotal grams.

Bigrams have one global order, the rarest first. A word's prefix is its three first
bigrams in that order (with all that are equal to the third); its pivots are the two
of them that share no letter and are rarest together, chosen by dynamic programming.
One insertion, deletion or replacement spoils at most one of two disjoint bigrams.
So of two near words, take the one whose prefix ends first in the order: one of its
pivots stands in the other word, and it stands in that word's prefix.

Position limits: the edit lies on one side of the surviving pivot. Left of it or right
of it the words agree, so the pivot is indexed together with all letters on one side
and the length of the partner (equal, one more or one less), once per side. Candidates
meet in an equi-join on that key, and the edit distance is verified inside the join:
only near pairs leave it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import arrow_map
from tallymark.session import materialize

MIN_LETTERS = 6
MIN_COUNT = 5
TIMES = 5  # a form is at least so many times as frequent as the word
SAMPLE_MOD = 199
RUN = r"[A-Za-zÀ-ÿ]{%d,}"
LOWER = bytes(b + 0x20 if 0x41 <= b <= 0x5A else b for b in range(256))
# Words a task counts at a time; then they are sent on as partial counts.
HELD = 400_000

# ---- words -----------------------------------------------------------------------


def varied(run: str, seed: int) -> str:
    """The lower-cased run, without one letter if its hash with the document's says so."""
    h = crc32(run.encode(), seed)
    if h % SAMPLE_MOD:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _count_batches(batches, min_letters: int) -> Iterator[pa.RecordBatch]:
    """Partial counts of the words of the task."""
    runs = re.compile(RUN % min_letters)
    seen: Counter[str] = Counter()

    def sent() -> pa.RecordBatch:
        words = [w for w in seen if len(w) >= min_letters]
        made = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([seen[w] for w in words], pa.int64())], names=["word", "n"])
        seen.clear()
        return made

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not text:
                continue
            # Runs are the same before and after A-Z are lower-cased.
            found = runs.findall(text.translate(LOWER).decode())
            seed = crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for run in found:
                seen[varied(run, seed)] += 1
            if len(seen) > HELD:
                yield sent()
    yield sent()


def count_words(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """``word`` and ``n`` of the words that occur at least ``min_count`` times in all rows."""
    rows = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(CAST(text AS STRING) AS BINARY) AS text")
    partial = arrow_map(rows, __name__, "_count_batches", "word string, n bigint", min_letters)
    return partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# ---- pivots ------------------------------------------------------------------------


def bigrams(word: str) -> list[str]:
    return [word[i : i + 2] for i in range(len(word) - 1)]


def prefix_of(word: str, order: dict[str, int]) -> list[tuple[int, int]]:
    """(order, place) of the three first bigrams and of all that equal the third."""
    placed = sorted((order[g], i) for i, g in enumerate(bigrams(word)))
    return [p for p in placed if p[0] <= placed[2][0]]


def pivots_of(prefix: list[tuple[int, int]]) -> tuple[int, int]:
    """Places of the two disjoint bigrams of the prefix with the least sum of orders.

    Bigrams are taken by place. ``alone[k]`` is the best single one among the first k,
    and a pair ends at each bigram with the best single one at least two places before.
    """
    by_place = sorted((place, weight) for weight, place in prefix)
    alone: list[tuple[int, int]] = []
    best = None
    for k, (place, weight) in enumerate(by_place):
        j = k
        while j and by_place[j - 1][0] > place - 2:
            j -= 1
        if j:
            pair = (alone[j - 1][0] + weight, alone[j - 1][1], place)
            best = pair if best is None or pair < best else best
        own = (weight, place)
        alone.append(min(own, alone[-1]) if alone else own)
    return best[1], best[2]


def _key(side: str, letters: str, length: int) -> int:
    return xxhash.xxh64_intdigest(f"{side}{length}:{letters}".encode())


def _index_batches(batches, table) -> Iterator[pa.RecordBatch]:
    """Keys of the pivots and of the prefixes of each word."""
    order = table.value
    for batch in batches:
        words, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        keys, kinds, at, ends = [], [], [], []
        for i, word in enumerate(words):
            size, prefix = len(word), prefix_of(word, order)
            end = prefix[-1][0]
            for place in pivots_of(prefix):
                for length in (size - 1, size, size + 1):
                    keys += [_key("<", word[: place + 2], length), _key(">", word[place:], length)]
                    kinds += [True, True]
                    at += [i, i]
                    ends += [end, end]
            for _, place in prefix:
                keys += [_key("<", word[: place + 2], size), _key(">", word[place:], size)]
                kinds += [False, False]
                at += [i, i]
                ends += [end, end]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.array(keys, dtype=np.uint64).view(np.int64)),
                pa.array(kinds, pa.bool_()),
                pa.array(ends, pa.int32()),
                pa.array([words[i] for i in at], pa.string()),
                pa.array([counts[i] for i in at], pa.int64()),
            ],
            names=["key", "pivot", "end", "word", "n"],
        )


def _neighbours(a: str, b: str) -> Column:
    return F.levenshtein(F.col(a), F.col(b), 1) == 1


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs ``a, b`` (a before b) of near words with their counts ``n_a, n_b``.

    ``words`` has distinct ``word`` of at least four letters, and ``n``. The order of
    the bigrams has one entry per bigram in use, at most the alphabet squared (8,100).
    """
    grams = words.select(F.explode(F.expr("transform(sequence(1, length(word) - 1), i -> substring(word, i, 2))")).alias("gram"))
    counted = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()
    rarest = sorted((r["n"], r["gram"]) for r in counted)
    order = words.sparkSession.sparkContext.broadcast({gram: i for i, (_, gram) in enumerate(rarest)})
    schema = "key bigint, pivot boolean, end int, word string, n bigint"
    index = materialize(arrow_map(words.select("word", "n"), __name__, "_index_batches", schema, order), "gram-index")
    pivots = index.where("pivot").select("key", F.col("end").alias("end_a"), F.col("word").alias("a"), F.col("n").alias("n_a"))
    prefixes = index.where("NOT pivot").select(F.col("key").alias("key_b"), F.col("end").alias("end_b"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    met = (F.col("key") == F.col("key_b")) & (F.col("end_a") <= F.col("end_b")) & (F.col("a") != F.col("b")) & _neighbours("a", "b")
    found = pivots.join(prefixes, met)
    swap = F.col("a") > F.col("b")
    return found.select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
        F.when(swap, F.col("n_b")).otherwise(F.col("n_a")).alias("n_a"),
        F.when(swap, F.col("n_a")).otherwise(F.col("n_b")).alias("n_b"),
    ).distinct()


# ---- forms ---------------------------------------------------------------------------


def _roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` of the words that have a form.

    A form is at least ``TIMES`` times as frequent, so chains are short; each round
    follows as far again (word -> root of its root) until nothing changes.
    """
    known = materialize(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not known.where("moved").isEmpty():
        step = known.select(F.col("word").alias("at"), F.col("root").alias("beyond"))
        known = known.join(step, F.col("root") == F.col("at"), "left").select(
            "word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")
        )
        known = materialize(known, "roots")
    return known.select("word", "root")


def group_variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``words`` (word, n).

    Near words differ by exactly one inserted, deleted or replaced code point. The form
    is the near word of largest n (ties: smallest in code-point order) if that n is at
    least ``times`` the word's own; root follows forms to the last.
    """
    words = materialize(words.select("word", "n"), "words")
    pairs = materialize(near_pairs(words), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("other"), F.col("n_b").alias("m")).union(
        pairs.select("b", "n_b", "a", "n_a")
    )
    best = F.min(F.struct((-F.col("m")).alias("less"), F.col("other").alias("other")))
    around = both.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    fits = -F.col("best.less") >= times * F.col("n")
    around = materialize(
        around.select(
            "word", "n_near",
            F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"),
        ),
        "word-forms",
    )
    roots = _roots(around.where("form IS NOT NULL"))
    out = words.join(around, "word", "left").join(roots, "word", "left")
    return out.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "form_n",
    )


def variants(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, times: int = TIMES) -> DataFrame:
    """``group_variants`` of the words of all whole texts.

    Words are maximal runs of Latin letters, A-Z lower-cased; of every ``SAMPLE_MOD``-th
    (by a hash of doc_id and run) one letter is left out, so that variants exist in
    clean text. Null and empty texts have none; a null doc_id hashes as the empty text;
    repeated rows count again; long texts are read whole; other columns are not read; an
    empty table gives no rows. ``min_letters`` must be four at least.
    """
    return group_variants(count_words(docs, min_letters, min_count), times)
