"""Benchmark decontamination by winnowing, in DataFrame functions only.

The k-gram hashes of a text are cut into sliding windows of ``w`` hashes, and the
least of each window (the first of equal ones) is a fingerprint. Two texts that
share ``k + w - 1`` words share a window and so a fingerprint at the same place of
it: nothing as long as a benchmark window can be missed. A document's fingerprints
meet the distinct fingerprints of the items; each hit is extended to the windows
that contain it, and these are compared word by word, so no hash decides a match.

A text is cut into overlapping pieces of ``PIECE`` words, so that every window lies
inside one. Work and memory of a row are in proportion to its length.

The fingerprints of the items are broadcast where their measured size allows it,
so that texts do not move at all. Beyond ``broadcast_bytes`` they meet in a shuffle of
(row, place, hash) alone, and only documents with a hit give their words again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.expressions import let
from tallymark.llm.common import ordinal_rows, quoted, unused
from tallymark.session import materialize

WINDOW = 13
GRAM = 9
# Fingerprint and window tables of the items up to this size are broadcast.
BROADCAST_BYTES = 64_000_000
# Words of a piece, without the overlap with the next one.
PIECE = 2_048
# Bits of the filter for each contaminated text, and all its bits at most (64 MB).
FILTER_BITS, FILTER_MOST = 16, 1 << 29
# A document is contaminated when this share of its words is hit.
SHARE = 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of the text with A-Z in lower case; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _places(size: Column) -> Column:
    """0 .. size - 1; none for sizes below one."""
    return F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))


def shapes(lengths: list[int]) -> list[tuple[int, int, int]]:
    """(window length, k, w) with ``k + w - 1`` equal to the window length."""
    return [(n, min(n, GRAM), n - min(n, GRAM) + 1) for n in sorted(set(lengths))]


def fingerprints(hashes: Column, shape: tuple[int, int, int]) -> Column:
    """Winnowed fingerprints of the word hashes: array of (size, place, fp)."""
    length, k, w = shape

    def named(grams: Column, place: Column) -> Column:
        return F.struct(F.lit(length).alias("size"), place.alias("place"), grams[place].alias("fp"))

    def chosen(grams: Column) -> Column:
        if w == 1:
            return F.transform(_places(F.size(grams)), lambda i: named(grams, i))

        def least(j: Column) -> Column:
            return let(F.slice(grams, j + 1, w), lambda part: j + F.array_position(part, F.array_min(part)).cast("int") - 1)

        places = F.array_distinct(F.transform(_places(F.size(grams) - w + 1), least))
        return F.transform(places, lambda i: named(grams, i))

    grams = F.transform(_places(F.size(hashes) - k + 1), lambda i: F.xxhash64(F.lit(length), F.slice(hashes, i + 1, k)))
    return let(grams, chosen)


def _winnowed(parts: Column, sizes: list[tuple[int, int, int]]) -> Column:
    hashes = F.transform(parts, lambda x: F.xxhash64(x))
    return let(hashes, lambda h: F.concat(*[fingerprints(h, s) for s in sizes]))


def pieces(parts: Column, length: int) -> Column:
    """Overlapping pieces as (offset, words): every run of ``length`` words lies in one."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0)), F.lit(PIECE))
    return F.transform(starts, lambda at: F.struct(at.alias("offset"), F.slice(parts, at + 1, PIECE + length - 1).alias("words")))


def window_at(parts: Column, start: Column, size: Column) -> Column:
    """The window's words joined by blanks; words hold none, so this is exact."""
    return F.concat_ws(" ", F.slice(parts, start + 1, size))


def text_digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)


def item_tables(items: DataFrame, length: int = WINDOW) -> tuple[DataFrame, DataFrame, list[tuple[int, int, int]]]:
    """Stored distinct fingerprints and windows of the items, and their shapes."""
    parted = items.select(F.col("item_id").cast("bigint").alias("item_id"), words(F.col("text").cast("string")).alias("parts"))
    parted = parted.where(F.size("parts") > 0).withColumn("size", F.least(F.size("parts"), F.lit(length)))
    parted = materialize(parted, "benchmark-words")
    # At most ``length`` different window lengths.
    sizes = shapes([r["size"] for r in parted.select("size").distinct().collect()])
    windows = parted.select(
        "item_id", "size",
        F.explode(F.transform(_places(F.size("parts") - F.col("size") + 1), lambda i: window_at(F.col("parts"), i, F.col("size")))).alias("win"),
    ).distinct()
    fps = None
    for shape in sizes:
        own = parted.where(F.col("size") == shape[0]).select(F.explode(_winnowed(F.col("parts"), [shape])).alias("f")).select("f.size", "f.fp")
        fps = own if fps is None else fps.union(own)
    if fps is None:
        fps = parted.select("size", F.lit(0).cast("bigint").alias("fp")).limit(0)
    return materialize(fps.distinct(), "benchmark-fingerprints"), materialize(windows, "benchmark-windows"), sizes


def _bytes(table: DataFrame) -> int:
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def overlaps(docs: DataFrame, items: DataFrame, length: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of ``docs`` with what it shares with the benchmark.

    doc_id, n_words, n_hit (words inside a shared window), n_items, item_ids
    (sorted as strings), contaminated (n_hit > 0 and ``SHARE`` * n_hit >= n_words)
    and digest (SHA-256 of the text). Null and empty texts have no words and no hits;
    items without words have no windows, and an empty benchmark hits nothing. Null
    ids are kept; repeated rows are counted in one group and given back one by one; a
    null item_id is no item, but its windows hit. Other columns are not read.
    """
    docs = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text")
    fps, windows, sizes = item_tables(items, length)
    rows = docs.select("doc_id", text_digest(F.col("text")).alias("digest"), words(F.col("text")).alias("parts"))
    small = not sizes or _bytes(fps) <= broadcast_bytes
    spans = _in_place(rows, fps, sizes, length) if small else _shuffled(rows, fps, sizes, length)
    known = windows.withColumn("hit", F.lit(True))
    spans = spans.join(F.broadcast(known) if _bytes(windows) <= broadcast_bytes else known, ["size", "win"], "left")
    return _summed(spans.where((F.col("place") < 0) | F.col("hit")))


def _in_place(rows: DataFrame, fps: DataFrame, sizes: list[tuple[int, int, int]], length: int) -> DataFrame:
    """Spans of all documents; nothing is shuffled.

    The fingerprints are a column of their own before they are exploded, so that the
    explosion and the join run in generated code, where a piece's words are only
    pointed at; what hits takes the few words with it that its windows can need.
    """
    own = [F.lit(-1).alias("size"), F.lit(0).alias("place"), F.lit(-1).cast("bigint").alias("fp")]
    marks = F.slice(F.array(F.struct(*own)), 1, F.when(F.col("offset") == 0, 1).otherwise(0))  # once a document
    cut = rows.select("doc_id", "digest", F.size("parts").alias("n_words"), F.explode(pieces(F.col("parts"), length)).alias("piece"))
    cut = cut.select("doc_id", "digest", "n_words", "piece.offset", "piece.words")
    if sizes:
        marks = F.concat(marks, _winnowed(F.col("words"), sizes))
    # The outer form, as a filter on the array's size would compute it a second time.
    found = cut.withColumn("marks", marks).select("doc_id", "digest", "n_words", "offset", "words", F.explode_outer("marks").alias("f"))
    listed = fps.union(fps.sparkSession.range(1).select(F.lit(-1).alias("size"), F.lit(-1).cast("bigint").alias("fp")))
    hits = found.select("doc_id", "digest", "n_words", "offset", "words", "f.size", "f.place", "f.fp").join(F.broadcast(listed), ["size", "fp"])
    # A fingerprint of k words at ``place`` is inside the windows that start from
    # ``place + k - size`` to ``place``.
    first = F.greatest(F.lit(0), F.col("place") + F.least(F.col("size"), F.lit(GRAM)) - F.col("size"))
    near = F.when(F.col("size") > 0, F.slice("words", first + 1, F.col("place") - first + F.col("size")))
    place = F.when(F.col("size") > 0, F.col("place") - first).otherwise(-1)
    hits = hits.select("doc_id", "digest", "n_words", "size", place.alias("place"), (F.col("offset") + first).alias("first"), near.alias("parts"))
    return _extended(hits, F.col("first"))


def _shuffled(rows: DataFrame, fps: DataFrame, sizes: list[tuple[int, int, int]], length: int) -> DataFrame:
    """The same without a broadcast: first the hits, then the words of documents with hits."""
    cut = rows.select("doc_id", "digest", F.explode(pieces(F.col("parts"), length)).alias("piece"))
    found = cut.select("doc_id", "digest", "piece.offset", F.explode(_winnowed(F.col("piece.words"), sizes)).alias("f"))
    hits = found.select("doc_id", "digest", (F.col("f.place") + F.col("offset")).alias("place"), "f.size", "f.fp").join(fps, ["size", "fp"])
    hits = hits.groupBy(F.col("doc_id").alias("hit_id"), F.col("digest").alias("hit_digest")).agg(F.collect_set(F.struct("size", "place")).alias("hits"))
    same = (F.col("digest") == F.col("hit_digest")) & F.col("doc_id").eqNullSafe(F.col("hit_id"))

    def near(h: Column) -> Column:
        first = F.greatest(F.lit(0), h["place"] + F.least(h["size"], F.lit(GRAM)) - h["size"])
        return F.struct(h["size"].alias("size"), (h["place"] - first).alias("place"), first.alias("first"),
                        F.slice("parts", first + 1, h["place"] - first + h["size"]).alias("parts"))

    whole = rows.join(hits, same).select("doc_id", "digest", F.size("parts").alias("n_words"), F.explode(F.transform("hits", near)).alias("h"))
    spans = _extended(whole.select("doc_id", "digest", "n_words", "h.*"), F.col("first"))
    own = rows.select("doc_id", "digest", F.size("parts").alias("n_words"), F.lit(-1).alias("place"), F.lit(-1).alias("size"))
    return spans.union(own.select("*", F.lit(None).cast("int").alias("start"), F.lit(None).cast("string").alias("win")))


def _extended(hits: DataFrame, offset: Column) -> DataFrame:
    """Every window among the hit's own words (``parts``) that contains it.

    One row without a window where there is none; a place of -1 stands for the
    document itself, so that one without hits stays.
    """
    gram = F.least(F.col("size"), F.lit(GRAM))
    first = F.greatest(F.lit(0), F.col("place") + gram - F.col("size"))
    last = F.least(F.col("place"), F.size("parts") - F.col("size"))
    starts = F.when((F.col("place") >= 0) & (first <= last), F.sequence(first, last))
    spans = F.transform(starts, lambda s: F.struct((s + offset).alias("start"), window_at(F.col("parts"), s, F.col("size")).alias("win")))
    found = hits.select("doc_id", "digest", "n_words", "place", "size", F.explode_outer(spans).alias("span"))
    return found.select("doc_id", "digest", "n_words", "place", "size", "span.start", "span.win")


def _summed(spans: DataFrame) -> DataFrame:
    """Results of the documents from their own rows and their shared windows."""
    covered = F.aggregate(
        F.sort_array("starts"),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("hit")),
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["start"] + s["size"]).alias("end"),
            (acc["hit"] + F.greatest(F.lit(0), s["start"] + s["size"] - F.greatest(s["start"], acc["end"]))).alias("hit"),
        ),
        lambda acc: acc["hit"],
    )
    grouped = spans.groupBy("doc_id", "digest").agg(
        F.max("n_words").cast("bigint").alias("n_words"),
        F.count_if(F.col("place") < 0).alias("times"),
        F.collect_set(F.when(F.col("hit"), F.struct("start", "size"))).alias("starts"),
        F.collect_set("item_id").alias("items"),
    )
    found = grouped.select(
        "doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sort_array(F.transform("items", lambda i: i.cast("string"))).alias("item_ids"), "digest", "times",
    )
    dirty = (F.col("n_hit") > 0) & (F.lit(SHARE) * F.col("n_hit") >= F.col("n_words"))
    return ordinal_rows(found.withColumn("contaminated", dirty), F.col("times"), "ordinal").select(
        "doc_id", "n_words", "n_hit", "n_items", "item_ids", "contaminated", "digest"
    )


def _filter(keys: DataFrame, count: int) -> tuple[DataFrame, int]:
    """A bit for the hash of every ``key``: (bucket, bits) rows of 4 kB, and their number."""
    buckets = max(1, min(FILTER_MOST, FILTER_BITS * count) // 32_768)
    place = _place(F.col("key"), buckets)
    bits = keys.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    return bits, buckets


def _place(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets * 32_768)) + 1


def drop_contaminated(docs: DataFrame, items: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` without the contaminated ones, all columns kept.

    Null and empty texts are never contaminated; null ids and repeated rows are judged
    by their text alone; an empty benchmark or an empty table drops nothing. Texts do
    not move to learn a yes or no: the contaminated digests are broadcast up to
    ``broadcast_bytes`` of stored size. Beyond it a bitmap of their hashes (64 MB at
    most) is, and only the rows that pass it meet the digests in a join.
    """
    dirty = overlaps(docs, items).where("contaminated").select(F.unhex("digest").alias("key")).distinct()
    dirty = materialize(dirty, "contaminated")
    key, bucket, bits = unused(docs, "key"), unused(docs, "bucket"), unused(docs, "bits")
    digest = F.unhex(text_digest(F.col("text")))
    marked = docs.withColumn(key, digest)
    listed = dirty.withColumnRenamed("key", key)
    if _bytes(dirty) <= broadcast_bytes:
        return marked.join(F.broadcast(listed), key, "left_anti").select(*map(quoted, docs.columns))
    filled, buckets = _filter(dirty, dirty.count())
    filled = F.broadcast(materialize(filled, "contaminated-bits").toDF(bucket, bits))
    place = _place(F.col(key), buckets)
    looked = marked.join(filled, F.bitmap_bucket_number(place) == F.col(bucket), "left")
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    passes = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    clean = looked.where(~passes).select(*map(quoted, docs.columns))
    checked = looked.where(passes).drop(bucket, bits).join(listed, key, "left_anti")
    return clean.union(checked.select(*map(quoted, docs.columns)))
