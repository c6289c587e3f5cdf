"""Secrets: fixed patterns, and a linear-chain random field that adds to them.

The field tags tokens as begin, inside or outside of a secret. It sees the shape of
a token (character classes, length, entropy, keywords), the shapes of its neighbours
and how unlike prose its file is, and is decoded by Viterbi. It learns from the
patterns' matches in a bounded sample (``tagging.SAMPLE_ROWS`` rows of at most
``tagging.SAMPLE_CHARS`` characters, some of every kind); every whole text is then scanned and decoded.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm import tagging
from tallymark.llm.chains import Stream
from tallymark.llm.common import arrow_map, text_chunks
from tallymark.llm.tagging import Tagger, Tokens

OUT, BEGIN, INSIDE = range(3)
KINDS = ["assign", "access", "hex", "crf"]
ORDER = {kind: i for i, kind in enumerate(KINDS)}

# The patterns, and the least lengths of their matches.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 18
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")  # the matches of HEX that are long enough
KEYWORDS = ("pass", "secret", "token", "api")

TOKEN = re.compile(r"[\w+/.-]+|[=:]")
NAMED = re.compile(r"(?i)^(password|passwd|pwd|secret|token|api_?key|key|auth|bearer|credential)s?$")


def base_spans(text: str, long_tokens: bool | None = None) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the secret itself) of the patterns' matches."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= ASSIGN_LEAST:
                found.append(("assign", m.start(), m.end(), m.start(2)))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= ACCESS_LEAST:
                found.append(("access", m.start(), m.end(), m.start()))
    if long_tokens is not False:
        for m in HEX_LONG.finditer(text):
            found.append(("hex", m.start(), m.end(), m.start()))
    return found


def describe(token: str) -> str:
    """Parts of a token's shape."""
    if token in "=:":
        return "p" + token
    size = len(token)
    length = "l" + str(min(size, 3) if size < 4 else 4 if size < 8 else 8 if size < 12 else 12 if size < 16 else 16 if size < 24 else 24 if size < 40 else 40)
    if token.isalpha():
        kind = "lower" if token.islower() else "upper" if token.isupper() else "title" if token[1:].islower() else "mixed"
        named = " keyword" if size < 14 and NAMED.match(token) else ""
        return f"{kind} {length} {kind}{length}{named}"
    digits = sum(c.isdigit() for c in token)
    classes = "".join(
        name
        for name, has in (
            ("d", digits > 0),
            ("a", any(c.islower() for c in token)),
            ("A", any(c.isupper() for c in token)),
            ("s", "/" in token or "+" in token),
            ("p", "." in token),
            ("u", "_" in token or "-" in token),
        )
        if has
    )
    parts = [classes, length, classes + length]
    if NAMED.match(token):
        parts.append("keyword")
    if size >= 12:
        if re.fullmatch(r"[0-9a-fA-F]+", token) and digits < size:
            parts.append("hexlike")
        counts = Counter(token).values()
        entropy = -sum(n / size * math.log2(n / size) for n in counts)
        parts += [f"e{int(entropy * 2)}", "many" if digits * 5 >= size else "few"]
    if token.startswith("AKIA"):
        parts.append("akia")
    return " ".join(parts)


def plain(description: str) -> bool:
    return description.startswith(("lower", "title", "edge"))


def no_key(token: str) -> int:
    return 0


def tagged(text: str) -> tuple[list[str], list[int]]:
    """Tokens of a text and the tags that the patterns give them."""
    inside = tagging.merged([(value, end) for _, _, end, value in base_spans(text)])
    tokens, tags, at, open_ = [], [], 0, -1
    for m in TOKEN.finditer(text):
        while at < len(inside) and inside[at][1] <= m.start():
            at += 1
        tokens.append(m[0])
        if at < len(inside) and inside[at][0] < m.end():
            tags.append(INSIDE if open_ == at else BEGIN)
            open_ = at
        else:
            tags.append(OUT)
    return tokens, tags


def kinds() -> dict[str, Column]:
    """Where a pattern of each kind may match (a match always fulfils its condition)."""
    text, low = F.col("text"), F.lower("text")
    named = [low.contains(k) for k in KEYWORDS]
    return {
        "assign": reduce(or_, named) & text.rlike(rf"(?i)(pass|secret|token|api).{{0,8}}[:=][\"' ]*[A-Za-z0-9+/_.=-]{{{ASSIGN_LEAST},}}"),
        "access": text.contains("AKIA") & text.rlike(rf"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}"),
        "hex": text.rlike("[0-9a-f]{16}"),
    }


def fit(docs: DataFrame) -> Tagger:
    """Learn from a bounded sample (``tagging.sample_texts``) in which no kind is missing."""
    texts = tagging.sample_texts(docs, kinds())
    return tagging.fit([tagged(t) for t in texts], 3, Tokens(describe, no_key), plain)


def decode(texts: list[str], tagger: Tagger, tokens: Tokens) -> list[list[tuple[str, int, int]]]:
    """All spans of each text: those of the patterns and those the field adds."""
    split = [TOKEN.findall(t) for t in texts]
    kinds, _ = tokens.number(split)
    sizes = np.array([len(s) for s in split], dtype=np.int64)
    paths = [np.zeros(0, np.uint8)] * len(texts)
    if len(kinds):
        views, first = tagging.views_of(kinds, sizes, tagging.plain_flags(tokens, plain))
        path = Stream(tagger.scores(views, tokens), first, tagger.trans, tagger.start).viterbi()
        paths = np.split(path, np.cumsum(sizes)[:-1])
    out = []
    for text, words, path in zip(texts, split, paths):
        base = base_spans(text, any(len(w) > 15 for w in words))
        spans = [(k, s, e) for k, s, e, _ in base]
        if path.any():
            places = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
            tagged_ = np.flatnonzero(path).tolist()
            taken = tagging.merged([(s, e) for _, s, e, _ in base])
            free = set(tagging.free_of([places[at] for at in tagged_], taken))
            runs: list[tuple[int, int]] = []
            last = -2
            for at in tagged_:
                if places[at] not in free:  # runs end where a pattern has matched
                    continue
                if path[at] == INSIDE and last == at - 1:
                    runs[-1] = (runs[-1][0], places[at][1])
                else:
                    runs.append(places[at])
                last = at
            spans += [("crf", s, e) for s, e in runs]
        out.append(spans)
    return out


_workers: dict[str, tuple[Tagger, Tokens]] = {}


def release() -> None:
    """Forget what this worker keeps between tasks."""
    _workers.clear()


def _worker(state: dict) -> tuple[Tagger, Tokens]:
    key = xxhash.xxh64_hexdigest(state["weights"].tobytes() + state["trans"].tobytes())
    if key not in _workers:
        _workers.clear()
        _workers[key] = Tagger(**state), Tokens(describe, no_key)
    return _workers[key]


def _scan_batches(batches, state: dict) -> tagging.Batches:
    tagger, tokens = _worker(state)
    base = KINDS[:-1]
    for batch, texts in text_chunks(batches, 1):
        found = decode(texts, tagger, tokens)
        own = [[s for s in spans if s[0] != "crf"] for spans in found]
        columns = {f"n_{k}": ([sum(s[0] == k for s in spans) for spans in own], pa.int64()) for k in base}
        columns["base_sha256"] = [hashlib.sha256(tagging.span_text(s, ORDER).encode()).hexdigest() for s in own], pa.string()
        columns["spans"] = [tagging.span_text(s, ORDER) for s in found], pa.string()
        yield tagging.result_batches(batch, columns)


def scan(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    ``spans`` lists kind:start:end in code points; the kind of what the field adds
    is ``crf``, and it adds no token that a pattern's match overlaps. Null and empty
    texts have no spans; repeated rows and null ids are kept; other columns are not
    read. No shuffle.
    """
    tagger = tagger or fit(docs)
    rows = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text")
    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    return arrow_map(rows, __name__, "_scan_batches", schema, tagger.state())
