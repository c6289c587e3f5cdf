"""Resampling, byte-level BPE and spelling variants against plain versions."""

import base64
import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from fixtures import ENGLISH, GERMAN, PASSAGE, TEXTS, documents, nobody, sorted_rows

import plain
from tallymark.llm import bytebpe, resample, spelling

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


# ---- 11: resampling ----------------------------------------------------------------


def test_any_gram_crc_from_two_prefixes():
    rng = random.Random(5)
    texts = [b"", None, b"One", " ".join(rng.choice(["a", "Zo\u00e9", "x" * 300, "7", "\u65e5\u672c", "y" * 70_000]) for _ in range(40)).encode(), b"...two, words!"]
    crcs, owner, counts = resample.gram_crcs(texts)
    got = [sorted(crcs[owner == i].tolist()) for i in range(len(texts))]
    for text, own, n in zip(texts, got, counts):
        words = resample.words_of(text)
        assert len(words) == n
        grams = [b" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
        assert own == sorted(map(zlib.crc32, grams))


def resampling_rows(spark, n=300):
    rng = random.Random(11)
    words = (ENGLISH + " " + GERMAN + " " + PASSAGE).split()
    texts = [" ".join(rng.choices(words, k=rng.choice([5, 19, 20, 21, 40]))) for _ in range(n)]
    return documents(spark, [*TEXTS, *texts, *texts[:40]])


def test_resampling(spark):
    docs, rows = resampling_rows(spark)
    target = spark.createDataFrame([(1, PASSAGE), (2, None), (3, "")], "item_id long, text string")
    got = resample.draw(docs.repartition(7), target).select("doc_id", "n_features", "weight", "score", "rank")
    want = plain.resampled_rows(rows, [PASSAGE, None, ""])
    assert sorted_rows(got.collect()) == sorted_rows(want)
    assert sum(r[4] is not None for r in want) == 10


def test_a_batch_is_scanned_in_small_parts():
    resample.shifts()
    texts = [b"The quick, brown fox jumps over a lazy dog: so it goes. " * 40, None, b""] * 2000
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["text"])
    tracemalloc.start()
    found = list(resample._bucket_batches([batch], 10_000, 3))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(found[0].column(1).to_pylist()) == 2000 * (3 * 480 - 3)
    assert peak < 20_000_000  # of a batch of 4.5 MB; 85 MB for 2 MB at a time
    slices = list(resample._chunks([batch.slice(3)], 0))
    assert [t for _, part in slices for t in part] == texts[3:]
    assert [part.num_rows for part, _ in slices] == [len(own) for _, own in slices]


def test_resampling_with_a_third_of_equal_rows(spark):
    same = [(7, ENGLISH + " " + ENGLISH)] * 400
    rows = same + [(i, f"{GERMAN} {GERMAN} {i}") for i in range(100, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([(1, ENGLISH)], "item_id long, text string")
    got = resample.draw(docs, target, percent=70).where("rank IS NOT NULL").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 491))
    assert [(r["score"], r["doc_id"]) for r in got] == sorted([(r["score"], r["doc_id"]) for r in got], key=lambda x: (-x[0], x[1]))


def test_resampling_of_no_rows(spark):
    target = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    assert resample.draw(nobody(spark), target).count() == 0
    docs, rows = documents(spark)
    got = resample.draw(docs, target.limit(0)).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted_rows(got.collect()) == sorted_rows(plain.resampled_rows(rows, []))


# ---- 12: byte-level BPE ------------------------------------------------------------


def library():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(count=400, seed=9):
    rng = random.Random(seed)
    letters = list(" ab'st<|>\u03a3\u00e9\u00df\u65e5\n\x1c\x85\u300012\t  ") + ["the", "tion", "\U0001f642", " \n ", "\u0301", "aaaa"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(count)]


def test_byte_bpe_equals_library(spark):
    own = library()
    docs, rows = documents(spark, TEXTS + odd_texts() + ["ab" * 40_000, "a" * 5_000, "the" * 3_000, " " * 999 + "x", "<|endoftext|>"])
    kept = [(i, t) for i, t in rows if i not in (None, 3, 7)]
    got = {r["doc_id"]: r for r in bytebpe.encode(docs.repartition(5), RANKS, PATTERN).collect()}
    for doc_id, text in kept:
        want = own.encode_ordinary(text or "")
        assert got[doc_id]["ids"] == want and got[doc_id]["n_tokens"] == len(want)
        assert bytes(got[doc_id]["decoded"]) == (text or "").encode() == own.decode_bytes(want)
    digests = bytebpe.encode(docs, RANKS, PATTERN, digests=True)
    assert digests.count() == len(rows)
    one = digests.where("doc_id = 13").first()
    assert one["ids_sha256"] == hashlib.sha256(np.array(got[13]["ids"], "<u4").tobytes()).hexdigest()
    assert one["decoded_sha256"] == hashlib.sha256(TEXTS[12].encode()).hexdigest()
    decoded = bytebpe.decode(bytebpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN)
    assert bytes(decoded.where("doc_id = 13").first()["decoded"]) == TEXTS[12].encode()
    assert bytebpe.encode(nobody(spark), RANKS, PATTERN).count() == 0


def lowest_rank_first(word, ranks):
    """Merge the leftmost pair of lowest rank until there is none."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        at = min(found)[1]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


@pytest.mark.parametrize("small", [0, 10**9])
def test_replay_where_late_pairs_have_lower_ranks(monkeypatch, small):
    """Vocabularies in no sensible order, merged as arrays and one by one."""
    monkeypatch.setattr(bytebpe, "SMALL", small)
    monkeypatch.setattr(bytebpe, "WAVES", 2)
    rng = random.Random(small + 1)
    for _ in range(40):
        tokens = {"".join(rng.choices("ab", k=rng.randint(2, 5))).encode() for _ in range(14)} | {b"abc", b"ca"}
        tokens = sorted(tokens)
        rng.shuffle(tokens)
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(tokens)}
        words = ["".join(rng.choices("abc", [5, 5, 1], k=rng.randint(1, 30))).encode() for _ in range(50)]
        ids, starts = bytebpe.Replay(words, bytebpe.Pairs(ranks), np.arange(256)).run()
        for word, a, b in zip(words, starts, starts[1:]):
            assert ids[a:b].tolist() == lowest_rank_first(word, ranks)


# ---- 13: spelling variants ----------------------------------------------------------


def misspelled(spark, count=260):
    rng = random.Random(21)
    base = ["weather", "market", "brauchen", "tionales", "aaaaaa", "abababab", "\u00e9trangers", "the\u00d7ories", "Z\u00fcrich\u00c9"]
    words = list(base)
    for _ in range(count):
        word = rng.choice(words)
        at = rng.randrange(len(word))
        words.append(rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice("abe\u00e9") + word[at:], word[:at] + rng.choice("abT") + word[at + 1 :]]))
    texts = []
    for i, word in enumerate(words):
        texts.append((word + " ") * rng.choice([2, 5, 6, 30, 200]) + rng.choice(["", word.upper(), "short", "12"]))
    return documents(spark, [*TEXTS, *texts])


def test_spelling_variants(spark):
    docs, rows = misspelled(spark)
    counts = plain.word_counts(rows)
    assert {r["word"]: r["n"] for r in spelling.count_words(docs).collect()} == counts
    got = spelling.variants(docs.repartition(5)).select("word", "form", "root", "n", "n_near", "form_n")
    want = plain.variant_rows(counts)
    assert sorted_rows(got.collect()) == sorted_rows(want)
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] != r[2] and r[1] for r in want)


def test_every_near_pair_is_found(spark):
    rng = random.Random(8)
    words = sorted({"".join(rng.choices("abc", k=rng.randint(6, 8))) for _ in range(500)})
    table = spark.createDataFrame([(w, 5 + i) for i, w in enumerate(words)], "word string, n long")
    got = {(r["a"], r["b"]): (r["n_a"], r["n_b"]) for r in spelling.near_pairs(table).collect()}
    number = {w: 5 + i for i, w in enumerate(words)}
    want = {(a, b): (number[a], number[b]) for i, a in enumerate(words) for b in words[i + 1 :] if plain.one_edit(a, b)}
    assert got == want and len(got) > 400


def test_pivots_are_the_rarest_disjoint_pair():
    rng = random.Random(3)
    for _ in range(300):
        word = "".join(rng.choices("abcd", k=rng.randint(6, 12)))
        grams = spelling.bigrams(word)
        order = {g: i for i, g in enumerate(rng.sample(sorted(set(grams)), len(set(grams))))}
        prefix = spelling.prefix_of(word, order)
        one, two = spelling.pivots_of(prefix)
        pairs = [(w1 + w2, p1, p2) for w1, p1 in prefix for w2, p2 in prefix if p2 >= p1 + 2]
        assert two >= one + 2 and order[grams[one]] + order[grams[two]] == min(pairs)[0]


def test_spelling_of_no_rows(spark):
    assert spelling.variants(nobody(spark)).count() == 0
    docs, _ = documents(spark, [None, "", "12 34", "abc"])
    assert spelling.variants(docs).count() == 0
