"""Language identification with a linear-chain conditional random field.

Every word of a text gets a language: features are affixes, letter n-grams and a
lexicon of training words, transitions are learned, and forward-backward gives each
word's posterior, so code-switched text is labelled piece by piece. The language of
a document is the one with the largest mean posterior.

The model is fitted on the driver from a bounded sample of labelled rows, which
covers every label: at most ``PER_LANGUAGE`` rows per language and of each at most
``MAX_CHARS`` characters, cut out of longer texts. Work and memory grow with words
times labels, so with K labels each has ``SAMPLE_CELLS`` / K^2 characters, at least
``LEAST_CHARS``; that only matters from five labels. Half of its training chains are whole texts, half are spliced from pieces of several
languages, which is where the transitions come from. Prediction covers whole texts;
a run of more than ``LONG`` letters, as in scripts without spaces, is several
positions of the chain.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.chains import Bags, Climber, Stream, pair_sums
from tallymark.llm.common import CHUNK_CHARS, arrow_map, held_out, lowest_rows, text_chunks, widened

UND = "und"
# Bounds of the training sample.
PER_LANGUAGE = 150
MAX_CHARS = 20_000
SAMPLE_CELLS = 48_000_000  # characters times labels, shared by the labels
LEAST_CHARS = 2_000  # of a label, however many there are
LEAST_ROWS = 10
GROUP_CELLS = 16_000_000  # words times labels that training holds at one time
# Most frequent features that are learned.
FEATURES = 60_000
ROUNDS = 25
PIECE, PIECES = 12, 8  # mean words and number of pieces of a spliced chain
CACHED = 100_000  # words a worker remembers
CHUNK = CHUNK_CHARS // 4  # characters whose posteriors a task holds at one time
# The pipeline keeps a text whose words are this sure of a language, the same or not.
MIN_SURE = 0.4

LETTERS = regex.compile(r"\p{L}+")
LONG = 40  # letters from which a run is read in pieces
JOIN = "-"  # stands where a piece is cut off


def words_of(text: str) -> list[str]:
    """Runs of letters, the positions of the chain; long runs as successive pieces."""
    words = LETTERS.findall(text.lower())
    if max(map(len, words), default=0) <= LONG:
        return words
    return [piece for word in words for piece in pieces_of(word)]


def pieces_of(word: str) -> list[str]:
    """Even pieces of a run of more than ``LONG`` letters, else the run itself.

    A piece that goes on ends with the next two letters and ``JOIN``, so that the
    n-grams over the cut are seen once.
    """
    size, count = len(word), -(-len(word) // LONG)
    cuts = [size * i // count for i in range(count + 1)]
    return [JOIN * (a > 0) + word[a : b + 2] + JOIN * (b < size) for a, b in zip(cuts, cuts[1:])]


def features_of(word: str) -> list[str]:
    """Affixes, n-grams and the word itself; a piece has affixes at true ends only."""
    begins, ends, core = word[0] != JOIN, word[-1] != JOIN, word.strip(JOIN)
    edged = f"^{core}$"
    names = [edged[:2], edged[:3], edged[:4]] if begins else []
    names += [edged[-2:], edged[-3:], edged[-4:]] if ends else []
    names.append("=" + word)
    names += [core[i : i + 2] for i in range(len(core) - 1 - (not ends))]
    names += [core[i : i + 3] for i in range(len(core) - 2)]
    return names


class LanguageModel:
    """Languages, feature numbers and the weights of the chain."""

    def __init__(self, languages: list[str], names: dict[str, int], weights: np.ndarray, trans: np.ndarray, start: np.ndarray):
        self.languages, self.names = languages, names
        self.weights, self.trans, self.start = (x.astype(np.float32) for x in (weights, trans, start))
        self.vocab, self.scores = _Vocab(), np.zeros((0, len(languages)), np.float32)

    def state(self) -> dict:
        """What tasks need to build the model again."""
        return {"languages": self.languages, "names": self.names, "weights": self.weights, "trans": self.trans, "start": self.start}

    def number(self, word: str) -> list[int]:
        names = self.names
        return [names[f] for f in features_of(word) if f in names]

    def emissions(self, words: list[list[str]]) -> np.ndarray:
        """Scores of all words, one text after the other; new words are scored once."""
        if len(self.vocab) > CACHED:
            self.vocab, self.scores = _Vocab(), self.scores[:0]
        ids = np.array(list(map(self.vocab.__getitem__, chain.from_iterable(words))), dtype=np.int64)
        if self.vocab.new:
            made = Bags([self.number(w) for w in self.vocab.new]).scores(self.weights)
            self.scores = np.concatenate([self.scores, made])
            self.vocab.new = []
        return self.scores[ids]

    def label_words(self, words: list[list[str]]) -> list[np.ndarray]:
        """Posterior of every language for every word of each text."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        if not sizes.sum():
            return [np.zeros((0, len(self.languages)), np.float32) for _ in words]
        ends = np.cumsum(sizes)
        first = np.zeros(int(ends[-1]), bool)
        first[(ends - sizes)[sizes > 0]] = True
        post = Stream(self.emissions(words), first, self.trans, self.start).forward_backward()[0]
        return np.split(post, ends[:-1])

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[float]]:
        """Language and its mean posterior, and the mean of each word's largest posterior."""
        words = [words_of(t) for t in texts]
        if not self.languages:
            return [UND] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        found, scores, sure = [], [], []
        for post in self.label_words(words):
            if len(post):
                mean = post.mean(axis=0, dtype=np.float64)
                best = int(mean.argmax())
                found.append(self.languages[best])
                scores.append(round(min(1.0, float(mean[best])), 6))
                sure.append(float(post.max(axis=1).mean(dtype=np.float64)))
            else:
                found.append(UND)
                scores.append(0.0)
                sure.append(0.0)
        return found, scores, sure


class _Vocab(dict):
    """Numbers words as they come; ``new`` lists those without a score yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


def _chains(texts: list[list[str]], langs: list[int]) -> tuple[list[list[str]], list[list[int]]]:
    """Whole texts, and as many chains spliced from pieces of texts."""
    rng = np.random.default_rng(11)
    words, labels = list(texts), [[lang] * len(t) for t, lang in zip(texts, langs)]
    pieces: dict[int, list[list[str]]] = {}
    for text, lang in zip(texts, langs):
        at = 0
        while at < len(text):
            size = int(rng.geometric(1 / PIECE))
            pieces.setdefault(lang, []).append(text[at : at + size])
            at += size
    known = sorted(pieces)
    for _ in range(len(texts) if known else 0):
        spliced, marks = [], []
        for lang in rng.choice(known, PIECES):
            piece = pieces[lang][int(rng.integers(len(pieces[lang])))]
            spliced += piece
            marks += [int(lang)] * len(piece)
        words.append(spliced)
        labels.append(marks)
    return words, labels


def _groups(sizes: np.ndarray, most: int) -> list[slice]:
    """Successive whole chains with at most ``most`` words, or one longer chain."""
    cuts, ends = [0], np.cumsum(sizes)
    for end, size in zip(ends.tolist(), sizes.tolist()):
        if end - cuts[-1] > most and end - size > cuts[-1]:
            cuts.append(end - size)
    return [slice(a, b) for a, b in zip(cuts, [*cuts[1:], int(ends[-1])])]


def train(rows: list[tuple[str, str]]) -> LanguageModel:
    """A model from (text, language) pairs; without any it knows no language."""
    languages = sorted({lang for _, lang in rows})
    k = len(languages)
    texts = [words_of(text) for text, _ in rows]
    place = {lang: i for i, lang in enumerate(languages)}
    words, labels = _chains(texts, [place[lang] for _, lang in rows])
    words, labels = [w for w in words if w], [y for y in labels if y]
    seen: Counter[str] = Counter()
    counts = Counter(chain.from_iterable(words))
    for word, times in counts.items():
        for name in features_of(word):
            seen[name] += times
    ranked = sorted((n for n, times in seen.items() if times > 1), key=lambda n: (-seen[n], n))[:FEATURES]
    names = {n: i for i, n in enumerate(ranked)}
    weights, trans, start = np.zeros((len(names), k)), np.zeros((k, k)), np.zeros(k)
    model = LanguageModel(languages, names, weights, trans, start)
    if not words:
        return model
    vocab = {w: i for i, w in enumerate(counts)}
    ids = np.array([vocab[w] for w in chain.from_iterable(words)])
    gold = np.array(list(chain.from_iterable(labels)))
    sizes = np.array([len(w) for w in words])
    first = np.zeros(len(ids), bool)
    first[np.cumsum(sizes) - sizes] = True
    bags = Bags([model.number(w) for w in vocab])
    groups = _groups(sizes, max(1, GROUP_CELLS // k))
    inner = np.flatnonzero(~first)
    gold_pairs = np.zeros((k, k))
    np.add.at(gold_pairs, (gold[inner - 1], gold[inner]), 1)
    gold_start = np.bincount(gold[first], minlength=k)
    climb = Climber()
    for _ in range(ROUNDS):
        scored = bags.scores(weights).astype(np.float32)
        per_word, pairs, begun = np.zeros((len(vocab), k)), np.zeros((k, k)), np.zeros(k)
        for group in groups:
            own, begins = ids[group], first[group]
            post, alpha, seen_ = Stream(scored[own], begins, trans, start).forward_backward()
            rest = -post.astype(np.float64)
            rest[np.arange(len(own)), gold[group]] += 1
            for c in range(k):
                per_word[:, c] += np.bincount(own, rest[:, c], len(vocab))
            pairs += pair_sums(alpha, seen_, begins, trans)
            begun += post[begins].sum(axis=0)
        climb.step("weights", weights, bags.gather(per_word, len(names)))
        climb.step("trans", trans, gold_pairs - pairs)
        climb.step("start", start, gold_start - begun)
    return LanguageModel(languages, names, weights, trans, start)


def _bounds(labels: int, per_language: int, max_chars: int) -> tuple[int, int]:
    """Rows of a label, and characters of a row, that are learned from."""
    share = max(LEAST_CHARS, SAMPLE_CELLS // max(1, labels) ** 2)
    rows = min(per_language, max(LEAST_ROWS, share // LEAST_CHARS))
    return rows, min(max_chars, max(1, share // rows))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, max_chars: int = MAX_CHARS) -> LanguageModel:
    """Learn from the text and lang of labelled rows that are not held out.

    Reads at most ``per_language`` rows of each language with letters in the text to
    the driver, those with the lowest hash of doc_id and text, and of each a piece of at most
    ``max_chars`` characters; fewer and shorter ones when there are many languages.
    """
    labelled = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text", "CAST(lang AS STRING) AS lang")
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id") & F.col("text").rlike(r"\p{L}"))
    labels = labelled.select("lang").distinct().count()
    most, chars = _bounds(labels, per_language, max_chars)
    spare = F.greatest(F.length("text") - chars, F.lit(0))
    start = F.pmod(F.xxhash64(F.lit(8), F.col("doc_id")), spare + 1) + 1
    # Where the piece would have no letters, it begins with the first letter.
    piece = F.substring("text", start.cast("int"), F.lit(chars))
    found = F.substring("text", F.regexp_instr("text", F.lit(r"\p{L}")), F.lit(chars))
    piece = F.when(spare == 0, F.col("text")).when(piece.rlike(r"\p{L}"), piece).otherwise(found)
    order = F.xxhash64(F.lit(7), F.col("doc_id"), F.col("text"))
    rows = lowest_rows(labelled.select(F.col("lang").alias("label"), order.alias("order"), piece.alias("text")), most)
    return train([(r["text"], r["label"]) for r in rows])


_models: dict[str, LanguageModel] = {}


def release() -> None:
    """Forget what this worker keeps between tasks."""
    _models.clear()


def _predict_batches(batches, text: int, kept: list[int], state: dict, key: str, least: float | None) -> Iterator[pa.RecordBatch]:
    if key not in _models:  # the worker's word memory outlives the task
        _models.clear()
        _models[key] = LanguageModel(**state)
    model = _models[key]
    size = max(1, min(CHUNK, 16 * CHUNK_CHARS // max(1, len(model.languages))))
    for batch, texts in text_chunks(batches, text, size):
        langs, scores, sure = model.predict(texts)
        names = [batch.schema.names[i] for i in kept]
        columns = [batch.column(i) for i in kept]
        if least is None:
            columns += [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "lang_pred", "score"])
        else:
            passes = [(s >= least and lang != UND) if model.languages else bool(words_of(t)) for lang, s, t in zip(langs, sure, texts)]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(passes, pa.bool_()))


def _key(model: LanguageModel) -> str:
    return xxhash.xxh64_hexdigest(b"".join(x.tobytes() for x in (model.weights, model.trans, model.start)) + repr(model.languages).encode())


def identify(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred and score.

    Without a model, one is fitted on the labelled rows. Null texts and texts
    without letters are ``und`` with score 0, as is everything when no row is
    labelled; equal scores go to the first language in order; a null doc_id is not
    held out; repeated rows are kept. lang, source and doc_id are not read here.
    """
    model = model or fit(docs)
    rows = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text")
    rows = rows.select("doc_id", "text", held_out("doc_id").alias("held_out"))
    return arrow_map(rows, __name__, "_predict_batches", "doc_id bigint, held_out boolean, lang_pred string, score double", 1, [0, 2], model.state(), _key(model), None)


def keep_identified(docs: DataFrame, least: float = MIN_SURE) -> DataFrame:
    """The rows of ``docs``, all columns, whose words' languages are known with ``least``.

    That is the mean over the words of the largest posterior, so a text in several
    languages stays when its words are sure. ``und`` texts go, and so do null and empty ones. When nothing is labelled, texts with letters
    stay. Null ids and repeated rows are judged by their text; an empty table stays empty.
    """
    model = fit(docs)
    every = list(range(len(docs.columns)))
    return arrow_map(docs, __name__, "_predict_batches", widened(docs), docs.columns.index("text"), every, model.state(), _key(model), least)
