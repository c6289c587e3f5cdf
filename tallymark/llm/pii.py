"""Personal data: fixed patterns, and a skip-chain random field that adds to them.

Besides the chain over neighbouring tokens, occurrences of one entity (the same
address, the same digits, the same name) in a document are tied: a skip edge joins
each occurrence with the next one and rewards equal labels. Beliefs come from loopy
message passing: chains are solved exactly, messages cross the skip edges, and so on
until they have settled. Linking successive occurrences only keeps the edges fewer
than the tokens, however often an entity occurs, and still lets a label travel
through the document. A document none of whose tied tokens has more than
``UNSURE`` of a personal label after the chain pass is settled then.

The field learns from the patterns' matches in a bounded sample
(``tagging.SAMPLE_ROWS`` rows of at most ``tagging.SAMPLE_CHARS`` characters).
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm import tagging
from tallymark.llm.chains import Stream
from tallymark.llm.common import arrow_map, text_chunks
from tallymark.llm.tagging import Tagger, Tokens

BASE = ["email", "ip", "card", "phone"]
KINDS = BASE + [f"crf_{k}" for k in BASE]
ORDER = {kind: i for i, kind in enumerate(KINDS)}
OUT = 0  # label; the others are the places in BASE plus one

# Passes end when no message changes by more than SETTLED, or after PASSES of them.
PASSES = 40
SETTLED = 1e-2
DAMPING = 0.2
# Where no tied token has a larger chance of a label, messages only lower it further:
# they can change no belief of such a text by more than about this.
UNSURE = 1e-3
SURE = 0.9  # belief from which a token is added

# The patterns and what their matches must hold.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Takes every run of digits, so that the search leaps from one to the next; without the group it is none.
IP = re.compile(r"[0-9][0-9]*+((?:\.[0-9]++){3})?")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NO_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards, so that long words cost nothing."""
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            found.append((start, match.end()))
            floor = match.end()
        at = text.find("@", floor if match else at + 1)
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns' matches that hold what they must."""
    found = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text) if text.count(".") > 2 else ():
            if m[1] and all(len(p) < 4 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
                found.append(("ip", m.start(), m.end()))
        for m in CARD.finditer(text):
            digits = NO_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(NO_DIGIT.sub("", m[0])) <= 15:
                    found.append(("phone", m.start(), m.end()))
    return found


# ---- tokens --------------------------------------------------------------------

TOKEN = re.compile(r"\S+")  # the parts of str.split()
RUN = re.compile(r"[0-9]+|[^\W\d_]+|.", re.S)
MARKS = ".,;:!?\"'"
LONG = 60  # signs from which a shape is named by its hash


def describe(token: str) -> str:
    """The token's shape: runs of digits with their length, letters, marks."""
    if token.isalpha():
        return "title" if token[0].isupper() else "word"
    core = token.strip(MARKS)
    if core.isalpha():
        return "title end" if core[0].isupper() else "word end"
    shape = []
    for m in RUN.finditer(core):
        first = m[0][0]
        shape.append(f"{min(len(m[0]), 20)}" if first.isdigit() else "a" if first.isalpha() else first)
    text = "".join(shape).replace(" ", "_")
    named = text if len(text) <= LONG else xxhash.xxh64_hexdigest(text)
    digits = sum(c.isdigit() for c in core)
    parts = ["s" + named, f"d{min(digits, 20)}"]
    parts += [f"has{c}" for c in "@+().-%:/=" if c in core]
    parts += ["digits" if core.isdigit() else "mixed", "b" + text[:2], "t" + text[-2:]]
    return " ".join(parts)


def plain(description: str) -> bool:
    return description.startswith(("title", "word", "edge"))


def key(token: str) -> int:
    """Equal for occurrences of one entity, 0 for tokens that name none."""
    core = token.strip(MARKS)
    if core.isalpha():
        if len(core) < 4 or not core[0].isupper():
            return 0
    elif not any(c.isdigit() or c == "@" for c in core):
        return 0
    digits = NO_DIGIT.sub("", core)
    named = digits if len(digits) >= 6 and "@" not in core else core.casefold()
    return xxhash.xxh64_intdigest(named) >> 2 | 1


def skip_edges(keys: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of successive occurrences of a key within a text."""
    at = np.flatnonzero(keys)
    text = np.repeat(np.arange(len(sizes)), sizes)[at]
    order = np.lexsort((at, keys[at], text))
    at, text, own = at[order], text[order], keys[at][order]
    same = (own[1:] == own[:-1]) & (text[1:] == text[:-1])
    return at[:-1][same], at[1:][same]


def pass_messages(
    scores: np.ndarray, first: np.ndarray, edges: tuple[np.ndarray, np.ndarray], tagger: Tagger, passes: int = PASSES
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Beliefs after chain passes with messages over the skip edges between them.

    Passes go on until the messages have settled, at most ``passes`` of them. Also the scaled values of the last chain pass and, for training, the log cavity
    beliefs of both ends of every edge.
    """
    left, right = edges
    k = scores.shape[1]
    tied = np.exp(tagger.tie * np.eye(k)).astype(scores.dtype)
    to_left, to_right = np.zeros((len(left), k), scores.dtype), np.zeros((len(left), k), scores.dtype)
    cavity_left = cavity_right = to_left
    added = scores
    # A text is done when its own messages have settled, whatever is beside it.
    text = (np.cumsum(first) - 1)[left]
    moving = np.ones(int(first.sum()), bool)
    for turn in range(passes):
        post, alpha, ahead = Stream(added, first, tagger.trans, tagger.start).forward_backward()
        if not len(left) or turn + 1 == passes:
            break
        log = np.log(np.maximum(post, 1e-30))
        cavity_left, cavity_right = log[left] - to_left, log[right] - to_right
        change = np.zeros(len(moving))
        for cavity, message in ((cavity_left, to_right), (cavity_right, to_left)):
            cavity -= cavity.max(axis=1, keepdims=True)
            sent = np.log(np.exp(cavity) @ tied)
            step = (1 - DAMPING) * (sent - sent.max(axis=1, keepdims=True) - message)
            message += step * moving[text][:, None].astype(step.dtype)
            np.maximum.at(change, text, np.abs(step).max(axis=1))
        moving &= change >= SETTLED
        if not moving.any():
            break
        added = scores.copy()
        np.add.at(added, left, to_left)
        np.add.at(added, right, to_right)
    return post, alpha, ahead, cavity_left, cavity_right


def _training_beliefs(scores, first, keys, sizes, tagger, gold):
    edges = skip_edges(keys, sizes)
    post, alpha, ahead, a, b = pass_messages(scores, first, edges, tagger, 2)
    slope = 0.0
    if len(edges[0]):
        joint = np.exp(a)[:, :, None] * np.exp(b)[:, None, :] * np.exp(tagger.tie * np.eye(scores.shape[1]))
        agree = np.einsum("nkk->n", joint) / joint.sum(axis=(1, 2))
        slope = float(((gold[edges[0]] == gold[edges[1]]) - agree).sum())
    return post, alpha, ahead, slope


def tagged(text: str) -> tuple[list[str], list[int]]:
    """Tokens of a text and the labels that the patterns give them."""
    spans = sorted(((s, e, BASE.index(k) + 1) for k, s, e in base_spans(text)), key=lambda x: (x[0], -x[1]))
    tokens, labels, at = [], [], 0
    for m in TOKEN.finditer(text):
        while at < len(spans) and spans[at][1] <= m.start():
            at += 1
        tokens.append(m[0])
        labels.append(spans[at][2] if at < len(spans) and spans[at][0] < m.end() else OUT)
    return tokens, labels


def kinds() -> dict[str, Column]:
    """Where a pattern of each kind may match (a match always fulfils its condition)."""
    text = F.col("text")
    return {
        "email": text.contains("@") & text.rlike(r"@[A-Za-z0-9-]+\.[A-Za-z0-9-]"),
        "ip": text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"),
        "card": text.rlike(r"[0-9]([ -]?[0-9]){13}"),
        "phone": text.contains("+") & text.rlike(r"\+[0-9][ ().0-9-]{8,}[0-9]"),
    }


def fit(docs: DataFrame) -> Tagger:
    """Learn from a bounded sample (``tagging.sample_texts``) in which no kind is missing."""
    texts = [tagged(t) for t in tagging.sample_texts(docs, kinds())]
    return tagging.fit(texts, len(BASE) + 1, Tokens(describe, key), plain, _training_beliefs)


def beliefs(split: list[list[str]], tagger: Tagger, tokens: Tokens) -> list[np.ndarray]:
    """Belief of every label for every token of each text."""
    kinds, keys = tokens.number(split)
    sizes = np.array([len(s) for s in split], dtype=np.int64)
    if not len(kinds):
        return [np.zeros((0, tagger.labels), np.float32) for _ in split]
    views, first = tagging.views_of(kinds, sizes, tagging.plain_flags(tokens, plain))
    scores = tagger.scores(views, tokens)
    edges = skip_edges(keys, sizes)
    post = Stream(scores, first, tagger.trans, tagger.start).forward_backward()[0]
    if len(edges[0]):
        text = np.repeat(np.arange(len(sizes)), sizes)
        unsure = np.maximum(1 - post[edges[0], OUT], 1 - post[edges[1], OUT]) > UNSURE
        again = np.isin(text, text[edges[0][unsure]])
        if again.any():
            place = np.cumsum(again) - 1
            kept = again[edges[0]]
            inner = place[edges[0][kept]], place[edges[1][kept]]
            post[again] = pass_messages(scores[again], first[again], inner, tagger)[0]
    return np.split(post, np.cumsum(sizes)[:-1])


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start] in MARKS:
        start += 1
    while end > start and text[end - 1] in MARKS:
        end -= 1
    return start, end


def decode(texts: list[str], tagger: Tagger, tokens: Tokens) -> list[list[tuple[str, int, int]]]:
    """All spans of each text: those of the patterns and those the field adds."""
    split = [t.split() for t in texts]
    out = []
    for text, post in zip(texts, beliefs(split, tagger, tokens)):
        spans = base_spans(text)
        sure = np.flatnonzero(post[:, OUT] < 1 - SURE)
        if len(sure):
            places = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
            taken = tagging.merged([(s, e) for _, s, e in spans])
            free = set(tagging.free_of([places[at] for at in sure], taken))
            label = post.argmax(axis=1)
            runs: dict[tuple[int, int], int] = {}
            last, open_ = -2, (0, 0)
            for at in sure.tolist():
                if label[at] == OUT or post[at, label[at]] < SURE:
                    continue
                if places[at] not in free:  # runs end where a pattern has matched
                    continue
                start = places[at][0]
                if last == at - 1 and label[last] == label[at]:
                    start = open_[0]
                    runs.pop(open_)
                last, open_ = at, (start, places[at][1])
                runs[open_] = int(label[at])
            named = {trimmed(text, *run): kind for run, kind in runs.items()}
            spans = spans + [(KINDS[len(BASE) + kind - 1], *r) for r, kind in sorted(named.items()) if r[0] < r[1]]
        out.append(spans)
    return out


_workers: dict[str, tuple[Tagger, Tokens]] = {}


def release() -> None:
    """Forget what this worker keeps between tasks."""
    _workers.clear()


def _worker(state: dict) -> tuple[Tagger, Tokens]:
    mark = xxhash.xxh64_hexdigest(state["weights"].tobytes() + state["trans"].tobytes())
    if mark not in _workers:
        _workers.clear()
        _workers[mark] = Tagger(**state), Tokens(describe, key)
    return _workers[mark]


def _scan_batches(batches, state: dict) -> tagging.Batches:
    tagger, tokens = _worker(state)
    for batch, texts in text_chunks(batches, 1):
        found = decode(texts, tagger, tokens)
        own = [[s for s in spans if s[0] in BASE] for spans in found]
        columns = {f"n_{k}": ([sum(s[0] == k for s in spans) for spans in own], pa.int64()) for k in BASE}
        columns["base_sha256"] = [hashlib.sha256(tagging.span_text(s, ORDER).encode()).hexdigest() for s in own], pa.string()
        columns["spans"] = [tagging.span_text(s, ORDER) for s in found], pa.string()
        yield tagging.result_batches(batch, columns)


def scan(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    ``spans`` lists kind:start:end in code points; kinds of what the field adds are
    ``crf_email`` and so on, and it adds no token that a pattern's match overlaps. Null
    and empty texts have no spans; repeated rows and null ids are kept; other columns
    are not read. No shuffle.
    """
    tagger = tagger or fit(docs)
    rows = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text")
    counts = ", ".join(f"n_{k} bigint" for k in BASE)
    return arrow_map(rows, __name__, "_scan_batches", f"doc_id bigint, {counts}, base_sha256 string, spans string", tagger.state())
