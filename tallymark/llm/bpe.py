"""BPE encoding and decoding with segment trees over adjacent pair ranks.

A pre-token starts as one symbol per byte. Leaf ``i`` of its tree holds
``rank * leaves + i`` of the pair that starts at symbol ``i``, so the root is the
leftmost pair of the lowest rank. A merge changes three leaves (the pair, the one
before and the swallowed one) and the nodes above them: a logarithmic update. It
ends when the root holds no pair. Short pre-tokens of a chunk are merged together,
one tree per row of an array; long ones each have a tree of their own. What was
found for a pre-token is kept in the worker (bounded, see ``Memory``).
"""

from __future__ import annotations

import gc
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tallymark.llm.common import arrow_map, text_chunks

# What the younger part of a worker's memory may hold before it becomes the older one.
CACHED_WORDS = 37_500
CACHED_PRE_TOKENS = 75_000
# Rows whose texts a task copies at one time.
ROWS = 500
# Longer pre-tokens (in bytes) get a tree of their own and are not remembered.
SHORT = 64
NONE = np.iinfo(np.int32).max

# The pre-token pattern of the vocabulary's file.
WHITE_SPACE = regex.compile(r"\p{White_Space}+")
# str.split() takes these for white space, Unicode does not.
UNIT_SEPARATORS = regex.compile(r"[\x1c-\x1f]")
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, extra = [], 256
    for byte in range(256):
        letters.append(chr(byte if byte in shown else extra))
        extra += byte not in shown
    return letters


class Memory:
    """Entries of words in two parts, so that words in use outlive the rare ones.

    With more than ``most`` words the younger part becomes the older one, which is
    dropped; words that are met again move back to the younger part.
    """

    def __init__(self, most: int):
        self.most = most
        self.young: dict[str, tuple[bytes, str]] = {}
        self.old: dict[str, tuple[bytes, str]] = {}

    def missing(self, words: set[str]) -> list[str]:
        """The words without an entry; those with one are in the younger part now."""
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        young, old, none = self.young, self.old, []
        for word in words.difference(young):
            entry = old.get(word)
            if entry is None:
                none.append(word)
            else:
                young[word] = entry
        return none


class WordBpe:
    """A tokenizer file with word ends (``</w>``), lower case and byte letters."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int32)
        self.last = np.array([vocab[c + end] for c in letters], dtype=np.int32)
        pairs = [(vocab[a] << 16 | vocab[b], r, vocab[a + b]) for r, (a, b) in enumerate(model["merges"])]
        self.rank_of = {key: rank for key, rank, _ in pairs}
        self.merged = np.array([m for _, _, m in pairs], dtype=np.int32)
        self.keys = np.array(sorted(self.rank_of), dtype=np.int64)
        self.ranks = np.array([self.rank_of[k] for k in self.keys.tolist()], dtype=np.int32)
        self.pattern = regex.compile(PRE_TOKEN)
        self.lines = regex.compile(PRE_TOKEN + r"|\n")
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        # Of pre-tokens and of words between white space: ids and decoded text.
        self.known, self.words = Memory(CACHED_PRE_TOKENS), Memory(CACHED_WORDS)

    # ---- text -> pre-tokens ------------------------------------------------

    def pre_tokens(self, text: str) -> list[str]:
        """Pre-tokens of the normalised text; special strings stay whole."""
        parts = self.marks.split(text) if "<|" in text else [text]
        return list(chain.from_iterable([p] if i % 2 else self._plain(p) for i, p in enumerate(parts)))

    def _plain(self, text: str) -> list[str]:
        return self.pattern.findall(self._normalised(text))

    @staticmethod
    def _normalised(text: str) -> str:
        if not text.isascii():
            # Lower case goes letter by letter: a final sigma has no form of its own.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def pre_tokens_of(self, words: list[str]) -> list[list[str]]:
        """Pre-tokens of words without white space, found in one text of a line each."""
        marked = {at: self.pre_tokens(w) for at, w in enumerate(words) if "<|" in w}
        lines: list[list[str]] = [[]]
        for token in self.lines.findall(self._normalised("\n".join(words))):
            if token == "\n":
                lines.append([])
            else:
                lines[-1].append(token)
        for at, pre_tokens in marked.items():
            lines[at] = pre_tokens
        return lines

    # ---- pre-tokens -> ids -------------------------------------------------

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 16 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge_many(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of non-empty words of at most ``SHORT`` bytes, merged side by side."""
        found: list[np.ndarray] = [None] * len(words)  # type: ignore[list-item]
        lengths = np.array([len(w) for w in words])
        leaves = 1
        while leaves < 2 * SHORT:
            rows = np.flatnonzero((lengths <= leaves) & (lengths > leaves // 2))
            if len(rows):
                for row, ids in zip(rows.tolist(), self._merge_rows([words[r] for r in rows], lengths[rows], leaves)):
                    found[row] = ids
            leaves *= 2
        return found

    def _merge_rows(self, words: list[bytes], lengths: np.ndarray, leaves: int) -> list[np.ndarray]:
        count = len(words)
        raw = np.frombuffer(b"".join(w.ljust(leaves, b"\0") for w in words), dtype=np.uint8).reshape(count, leaves)
        symbols = np.full((count, leaves + 1), -1, dtype=np.int32)
        symbols[:, :leaves] = np.where(np.arange(leaves) < lengths[:, None], self.inner[raw], -1)
        ends = np.arange(count), lengths - 1
        symbols[ends] = self.last[raw[ends]]
        # Neighbours; ``leaves`` stands for none.
        after = np.tile(np.arange(1, leaves + 2, dtype=np.int32), (count, 1))
        after[np.arange(leaves + 1) >= lengths[:, None] - 1] = leaves
        before = np.tile(np.arange(-1, leaves, dtype=np.int32), (count, 1))
        before[:, 0] = leaves
        tree = np.full((count, 2 * leaves), NONE, dtype=np.int32)
        if leaves > 1:
            r, c = np.nonzero(np.arange(leaves) < lengths[:, None] - 1)
            rank = self._pair_ranks(symbols[r, c], symbols[r, c + 1])
            tree[r, leaves + c] = np.where(rank < NONE, rank * leaves + c, NONE)
            level = leaves // 2
            while level:
                tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
                level //= 2
        row = np.flatnonzero(tree[:, 1] < NONE) if leaves > 1 else np.empty(0, dtype=np.int64)
        while len(row):
            best = tree[row, 1]
            at, merged = best % leaves, self.merged[best // leaves]
            gone = after[row, at]
            beyond, prior = after[row, gone], before[row, at]
            symbols[row, at], symbols[row, gone] = merged, -1
            after[row, at] = beyond
            before[row, beyond] = at
            has_next, has_prior = beyond < leaves, prior < leaves
            tree[row, leaves + gone] = NONE
            rank = np.where(has_next, self._pair_ranks(merged, symbols[row, beyond]), NONE)
            tree[row, leaves + at] = np.where(rank < NONE, rank * leaves + at, NONE)
            pr, pa_, ps = row[has_prior], prior[has_prior], merged[has_prior]
            rank = self._pair_ranks(symbols[pr, pa_], ps)
            tree[pr, leaves + pa_] = np.where(rank < NONE, rank * leaves + pa_, NONE)
            places = [(row, leaves + gone), (row, leaves + at), (pr, leaves + pa_)]
            for _ in range(leaves.bit_length() - 1):
                places = [(r, n // 2) for r, n in places]
                for r, n in places:
                    tree[r, n] = np.minimum(tree[r, 2 * n], tree[r, 2 * n + 1])
            row = row[tree[row, 1] < NONE]
        keep = symbols[:, :leaves] >= 0
        ids = symbols[:, :leaves][keep].astype("<u4")
        bounds = [0, *np.cumsum(keep.sum(axis=1)).tolist()]
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]

    def merge_long(self, word: bytes) -> np.ndarray:
        """Ids of one word of any length: the same tree, alone."""
        size = len(word)
        symbols = self.inner[np.frombuffer(word, dtype=np.uint8)].tolist()
        symbols[-1] = int(self.last[word[-1]])
        rank_of, merged = self.rank_of, self.merged.tolist()
        leaves = 1 << max(1, (size - 1).bit_length())
        none = NONE * leaves
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))

        def leaf(at: int) -> int:
            nxt = after[at]
            if nxt >= size:
                return none
            rank = rank_of.get(symbols[at] << 16 | symbols[nxt])
            return none if rank is None else rank * leaves + at

        tree = [none] * (2 * leaves)
        tree[leaves : leaves + size] = [leaf(i) for i in range(size)]
        for node in range(leaves - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(at: int, value: int) -> None:
            node = leaves + at
            tree[node] = value
            node >>= 1
            while node:
                left, right = tree[2 * node], tree[2 * node + 1]
                value = left if left < right else right
                if tree[node] == value:
                    return
                tree[node] = value
                node >>= 1

        while tree[1] < none:
            rank, at = divmod(tree[1], leaves)
            gone = after[at]
            symbols[at], symbols[gone] = merged[rank], -1
            after[at] = beyond = after[gone]
            if beyond < size:
                before[beyond] = at
            put(gone, none)
            put(at, leaf(at))
            if before[at] >= 0:
                put(before[at], leaf(before[at]))
        return np.array([s for s in symbols if s >= 0], dtype=np.int32)

    def _learn(self, pre_tokens: Iterable[str]) -> dict[str, tuple[bytes, str]]:
        """Entries (ids, decoded text) of the pre-tokens that are not known yet.

        Those too long to be kept are returned, the others are remembered.
        """
        new = [w for w in pre_tokens if w not in self.special]
        raw = [w.encode("utf-8", "replace") for w in new]
        short = [i for i, w in enumerate(raw) if len(w) <= SHORT]
        for i, ids in zip(short, self.merge_many([raw[i] for i in short])):
            self.known.young[new[i]] = ids.tobytes(), self.decode(ids.tolist())
        long = {mark: (np.array([i], "<u4").tobytes(), self.decode([i])) for mark, i in self.special.items()}
        for word, data in zip(new, raw):
            if len(data) > SHORT:
                ids = self.merge_long(data)
                long[word] = ids.astype("<u4").tobytes(), self.decode(ids.tolist())
        return long

    def encode_texts(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Ids (little-endian, four bytes each) and decoded text of each text.

        White space ends a pre-token, so texts are looked up word by word; only
        words that the worker has not seen are normalised, split and merged.
        """
        # Many small lists and no cycles are made: the collector would only walk the memory.
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._encoded(texts)
        finally:
            if collects:
                gc.enable()

    def _encoded(self, texts: list[str]) -> list[tuple[bytes, str]]:
        split = [self._words(t) for t in texts]
        new = self.words.missing(set(chain.from_iterable(split)))
        inner = self.pre_tokens_of(new)
        long = self._learn(self.known.missing(set(chain.from_iterable(inner))))
        words, known = self.words.young, self.known.young
        for word, pre_tokens in zip(new, inner):
            words[word] = self._joined([known.get(p) or long[p] for p in pre_tokens])
        out = [self._joined([words[w] for w in parts]) for parts in split]
        for word in new:
            if len(word) > SHORT:
                del words[word]
        return out

    @staticmethod
    def _joined(entries: list[tuple[bytes, str]]) -> tuple[bytes, str]:
        if len(entries) == 1:
            return entries[0]
        return b"".join([e[0] for e in entries]), " ".join([e[1] for e in entries if e[0]])

    def _words(self, text: str) -> list[str]:
        """Parts between white space; special strings, which may hold none, stay whole."""
        if "<|" in text:
            text = self.marks.sub(r" \1 ", text)
        return text.split() if not UNIT_SEPARATORS.search(text) else WHITE_SPACE.split(text)

    # ---- ids -> text -------------------------------------------------------

    def decode(self, ids: Iterable[int]) -> str:
        """The file names no decoder, so names are joined by blanks; unknown ids are left out."""
        names = self.names
        return " ".join([names[i] for i in ids if i in names])


_loaded: dict[str, WordBpe] = {}


def release() -> None:
    """Forget what this worker keeps between tasks."""
    _loaded.clear()


def load(path: str) -> WordBpe:
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def _encode_batches(batches, path: str, digests: bool) -> Iterator[pa.RecordBatch]:
    bpe = load(path)
    # A few rows at a time, so that the texts of a batch are not all copied at once.
    few = (batch.slice(at, ROWS) for batch in batches for at in range(0, batch.num_rows, ROWS))
    for batch, texts in text_chunks(few, 1, 500_000):
        found = bpe.encode_texts(texts)
        counts = pa.array([len(ids) // 4 for ids, _ in found], pa.int64())
        if digests:
            sha = lambda data: hashlib.sha256(data).hexdigest()
            more = {
                "ids_sha256": pa.array([sha(ids) for ids, _ in found], pa.string()),
                "decoded_sha256": pa.array([sha(text.encode()) for _, text in found], pa.string()),
            }
        else:
            more = {
                "ids": pa.array([np.frombuffer(ids, dtype="<u4").astype(np.int32) for ids, _ in found], pa.list_(pa.int32())),
                "decoded": pa.array([text for _, text in found], pa.string()),
            }
        arrays = [batch.column(0), counts, *more.values()]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", *more])


def encode(docs: DataFrame, path: str, digests: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids and decoded text.

    ``digests`` gives ids_sha256 and decoded_sha256 instead. Null and empty texts
    have no tokens; a text of one very long word is merged in one tree; repeated
    rows and null ids are kept; no other column is read. No shuffle.
    """
    more = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return arrow_map(
        docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text"),
        __name__,
        "_encode_batches",
        f"doc_id bigint, n_tokens bigint, {more}",
        path,
        digests,
    )


def _decode_batches(batches, path: str) -> Iterator[pa.RecordBatch]:
    bpe = load(path)
    for batch in batches:
        texts = [bpe.decode(ids or []) for ids in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "decoded"])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of its ``ids``; null ids give ''."""
    rows = encoded.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(ids AS ARRAY<INT>) AS ids")
    return arrow_map(rows, __name__, "_decode_batches", "doc_id bigint, decoded string", path)
