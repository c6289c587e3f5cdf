"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct pre-tokens of a chunk of texts are laid out as one row of byte symbols.
An inverted index names, for every rank, the places whose symbol and the next one
form that pair. Ranks are then replayed in order over all words at once: the places
of the lowest rank merge from left to right, and only the two neighbours of a merge
are looked up again and put into the index. Where many words share a rank, its
places merge as arrays. A rank that becomes possible late and is lower than the
present one goes first in its word: the rest of that word waits, so each word sees
exactly the lowest-rank, leftmost-first merges. What was found for
a pre-token is kept in the worker (bounded, see ``CACHED``); texts never move.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tallymark.llm.common import arrow_map, text_chunks

# Entries a worker remembers; beyond it the memory starts anew.
CACHED = 300_000
# Longer parts (in letters) are encoded and forgotten.
SHORT = 64
# Letters of text whose new words are replayed together.
CHUNK = 8_000_000
# After so many ranks with fewer than so many places each, they go one by one.
WAVES, SMALL = 64, 40
NONE = np.iinfo(np.int64).max

# A pre-token starts at every blank before a letter, digit or mark, whatever stands
# before it, so texts are looked up part by part.
PARTS = re.compile(r" (?=\S)")

Entry = tuple[bytes, bytes]  # ids, four bytes each, and the decoded bytes


class Pairs:
    """Ranks of adjacent tokens, looked up one by one or many at a time."""

    def __init__(self, ranks: dict[bytes, int]):
        self.rank_of: dict[int, int] = {}
        late = set()
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.rank_of[left << 32 | right] = rank
                    late.update(r for r in (left, right) if r > rank)
        self.late = late  # ranks whose merge can make a pair of lower rank
        self.keys = np.array(sorted(self.rank_of), dtype=np.int64)
        self.ranks = np.array([self.rank_of[k] for k in self.keys.tolist()], dtype=np.int64)

    def many(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE where it is none (or a symbol is -1)."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (right >= 0), self.ranks[at], NONE)


class Replay:
    """Symbols of many words in one row, and the inverted index from rank to places."""

    def __init__(self, words: list[bytes], pairs: Pairs, byte_ids: np.ndarray):
        self.pairs = pairs
        self.ends = np.cumsum(np.array([len(w) for w in words], dtype=np.int64))
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        last = np.zeros(len(raw), dtype=bool)
        last[self.ends - 1] = True
        places = np.arange(len(raw))
        self.symbols = byte_ids[raw]
        self.after = np.where(last, -1, places + 1)
        self.before = np.where(np.concatenate([[True], last[:-1]]), -1, places - 1)
        two = np.arange(256)
        table = pairs.many(np.repeat(byte_ids[two], 256), np.tile(byte_ids[two], 256))
        ranks = np.where(last[:-1], NONE, table[raw[:-1].astype(np.int64) << 8 | raw[1:]])
        self.index: dict[int, list] = {}
        self.todo: list[int] = []
        self.list_places(ranks, places[:-1])

    def list_places(self, ranks: np.ndarray, places: np.ndarray) -> None:
        """Put the places of pairs into the index."""
        keep = ranks < NONE
        ranks, places = ranks[keep], places[keep]
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        starts = np.flatnonzero(np.diff(ranks, prepend=-1)).tolist()
        for rank, start, end in zip(ranks[starts].tolist(), starts, [*starts[1:], len(ranks)]):
            if rank in self.index:
                self.index[rank].append(places[start:end])
            else:
                self.index[rank] = [places[start:end]]
                heappush(self.todo, rank)

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and where each word starts among them."""
        waves, merged = 0, 0
        while self.todo:
            rank = heappop(self.todo)
            listed = self.index.pop(rank, None)
            if listed is None:
                continue
            places = np.unique(np.hstack(listed))
            waves, merged = waves + 1, merged + len(places)
            if not self.wave(rank, places):
                self.one_by_one(rank, places.tolist())
            if waves == WAVES:
                if merged < WAVES * SMALL:
                    self.finish()
                waves, merged = 0, 0
        symbols = np.asarray(self.symbols)
        kept = symbols >= 0
        return symbols[kept], np.concatenate([[0], np.cumsum(kept)[self.ends - 1]])

    def wave(self, rank: int, at: np.ndarray) -> bool:
        """Merge all places of a rank at once; False (and nothing done) if order matters."""
        pairs, symbols, after, before = self.pairs, self.symbols, self.after, self.before
        gone = after[at]
        at = at[(gone >= 0) & (pairs.many(symbols[at], symbols[gone]) == rank)]
        if not len(at):
            return True
        gone = after[at]
        touching = gone[:-1] == at[1:]
        if touching.any():
            # Of pairs that overlap in a chain, the first, third, ... merge.
            place = np.arange(len(at))
            first = np.maximum.accumulate(np.where(np.concatenate([[True], ~touching]), place, 0))
            at = at[(place - first) % 2 == 0]
            gone = after[at]
        beyond, prior = after[gone], before[at]
        if rank in pairs.late:
            # What each merge would see: its right neighbour as it is, its left one merged.
            right = pairs.many(np.full(len(at), rank), np.where(beyond >= 0, symbols[beyond], -1))
            left = np.where(prior >= 0, symbols[prior], 0)
            left[1:] = np.where((prior[1:] == at[:-1]) | (prior[1:] == gone[:-1]), rank, left[1:])
            left = np.where(prior >= 0, pairs.many(left, np.full(len(at), rank)), NONE)
            if min(right.min(), left.min()) < rank:
                return False
        symbols[at], symbols[gone] = rank, -1
        after[at], after[gone] = beyond, -1
        has = beyond >= 0
        before[beyond[has]] = at[has]
        prior = before[at]
        ranks = pairs.many(symbols[at[has]], symbols[beyond[has]])
        has_prior = prior >= 0
        # A left neighbour of the same wave has just listed the pair as its own.
        more = pairs.many(symbols[prior[has_prior]], symbols[at[has_prior]])
        self.list_places(np.concatenate([ranks, more]), np.concatenate([at[has], prior[has_prior]]))
        return True

    def one_by_one(self, rank: int, listed: list[int]) -> None:
        """Merge the places of a rank from left to right."""
        symbols, after, before, index, todo = self.symbols, self.after, self.before, self.index, self.todo
        get = self.pairs.rank_of.get
        waiting, wait_until = [], 0
        for at in listed:
            if at < wait_until:
                waiting.append(at)
                continue
            gone = after[at]
            if gone < 0 or get(symbols[at] << 32 | symbols[gone]) != rank:
                continue  # merged away since it was listed
            beyond, prior = after[gone], before[at]
            symbols[at], symbols[gone] = rank, -1
            after[at], after[gone] = beyond, -1
            late = rank
            if beyond >= 0:
                before[beyond] = at
                new = get(rank << 32 | symbols[beyond])
                if new is not None:
                    late = min(late, new)
                    if new in index:
                        index[new].append(at)
                    else:
                        index[new] = [at]
                        heappush(todo, new)
            if prior >= 0:
                new = get(symbols[prior] << 32 | rank)
                if new is not None:
                    late = min(late, new)
                    if new in index:
                        index[new].append(prior)
                    else:
                        index[new] = [prior]
                        heappush(todo, new)
            if late < rank:
                # The lower rank goes first in this word.
                wait_until = int(self.ends[np.searchsorted(self.ends, at, side="right")])
        if waiting:
            index[rank] = waiting
            heappush(todo, rank)

    def finish(self) -> None:
        """The remaining ranks have few places each: plain lists are faster than arrays."""
        self.symbols, self.after, self.before = self.symbols.tolist(), self.after.tolist(), self.before.tolist()
        self.index = {rank: np.hstack(listed).tolist() for rank, listed in self.index.items()}
        while self.todo:
            rank = heappop(self.todo)
            listed = self.index.pop(rank, None)
            if listed is not None:
                listed.sort()
                self.one_by_one(rank, listed)


class ByteBpe:
    """A file of ``base64 rank`` lines and a pre-token pattern, with a worker's memory."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.pairs = Pairs(self.ranks)
        # The library's white space is Unicode's, without \x1c-\x1f.
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.parts: dict[str, Entry] = {}  # of what stands between such blanks

    def decode(self, ids: Iterable[int]) -> bytes:
        """Bytes of the ids; unknown ids are left out."""
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids if i in tokens])

    def entries(self, words: list[str]) -> list[Entry]:
        """Ids and decoded bytes of every pre-token."""
        raw = [w.encode("utf-8", "replace") for w in words]
        # A pre-token that is a token as a whole is never merged.
        whole = [self.ranks.get(w) for w in raw]
        rest = [w for w, t in zip(raw, whole) if t is None]
        ids, starts = Replay(rest, self.pairs, self.byte_ids).run() if rest else (np.empty(0, np.int64), np.zeros(1, np.int64))
        data, tokens = ids.astype("<u4").tobytes(), [self.tokens[i] for i in ids.tolist()]
        decoded = b"".join(tokens)
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))])[starts].tolist()
        starts = (4 * starts).tolist()
        merged = iter([(data[a:b], decoded[c:d]) for a, b, c, d in zip(starts, starts[1:], at, at[1:])])
        return [next(merged) if t is None else (t.to_bytes(4, "little"), self.tokens[t]) for t in whole]

    def encode_texts(self, texts: list[str]) -> list[Entry]:
        if len(self.parts) > CACHED:
            self.parts.clear()
        split = [PARTS.split(t) for t in texts]
        # What stands before the first such blank has no blank of its own.
        new = list(set(chain.from_iterable([p[1:] for p in split])).difference(self.parts))
        firsts = list({p[0] for p in split})
        # Letters only are one pre-token; the pattern parts the rest.
        inner = [[" " + p] if p.isascii() and p.isalpha() else self.pattern.findall(" " + p) for p in new]
        first_inner = [self.pattern.findall(p) for p in firsts]
        words = list(set(chain.from_iterable(inner)).union(chain.from_iterable(first_inner)))
        known = dict(zip(words, self.entries(words)))

        def joined(pre_tokens: list[str]) -> Entry:
            if len(pre_tokens) == 1:
                return known[pre_tokens[0]]
            entries = [known[p] for p in pre_tokens]
            return b"".join([e[0] for e in entries]), b"".join([e[1] for e in entries])

        parts = self.parts
        parts.update(zip(new, map(joined, inner)))
        starts = dict(zip(firsts, map(joined, first_inner)))
        out = []
        for own in split:
            entries = [starts[own[0]], *[parts[p] for p in own[1:]]]
            out.append((b"".join([e[0] for e in entries]), b"".join([e[1] for e in entries])))
        for part in new:
            if len(part) > SHORT:
                del parts[part]
        return out


_loaded: dict[tuple[str, str], ByteBpe] = {}


def release() -> None:
    """Forget what this worker keeps between tasks."""
    _loaded.clear()


def load(path: str, pattern: str) -> ByteBpe:
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBpe(path, pattern)
    return _loaded[path, pattern]


def _encode_batches(batches, path: str, pattern: str, digests: bool) -> Iterator[pa.RecordBatch]:
    bpe = load(path, pattern)
    gc.disable()  # millions of small entries, none of them in a cycle
    for batch, texts in text_chunks(batches, 1, CHUNK):
        found = bpe.encode_texts(texts)
        if digests:
            more = {
                "ids_sha256": pa.array([hashlib.sha256(ids).hexdigest() for ids, _ in found], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(data).hexdigest() for _, data in found], pa.string()),
            }
        else:
            more = {
                "ids": pa.array([np.frombuffer(ids, dtype="<u4").astype(np.int32) for ids, _ in found], pa.list_(pa.int32())),
                "decoded": pa.array([data for _, data in found], pa.binary()),
            }
        counts = pa.array([len(ids) // 4 for ids, _ in found], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), counts, *more.values()], names=["doc_id", "n_tokens", *more])
    gc.enable()


def encode(docs: DataFrame, path: str, pattern: str, digests: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids and the decoded bytes.

    ``digests`` gives ids_sha256 and decoded_sha256 instead. Special strings inside
    texts are ordinary text. Null and empty texts have no tokens; a text of one very
    long word is replayed like any other; repeated rows and null ids are kept; no other
    column is read; an empty table gives no rows. No shuffle.
    """
    more = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary"
    rows = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text")
    schema = f"doc_id bigint, n_tokens bigint, {more}"
    return arrow_map(rows, __name__, "_encode_batches", schema, path, pattern, digests)


def _decode_batches(batches, path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    bpe = load(path, pattern)
    for batch in batches:
        data = [bpe.decode(ids or []) for ids in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "decoded"])


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the bytes of its ``ids``; null ids give none."""
    rows = encoded.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(ids AS ARRAY<INT>) AS ids")
    return arrow_map(rows, __name__, "_decode_batches", "doc_id bigint, decoded binary", path, pattern)
