"""Brute-force versions of the operators, row by row in plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash


def simhash_rows(rows):
    """(doc_id, fingerprint, component_id) by comparing all pairs."""
    prints = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    distinct = sorted(set(prints))
    group = {p: p for p in distinct}

    def root(p):
        while group[p] != p:
            p = group[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                group[root(b)] = root(a)
    least = {}
    for (doc_id, _), p in zip(rows, prints):
        known = [x for x in (doc_id, least.get(root(p))) if x is not None]
        least[root(p)] = min(known) if known else None
    return [(doc_id, f"{p:016x}", least[root(p)]) for (doc_id, _), p in zip(rows, prints)]


def overlap_rows(docs, items):
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for item, text in items:
        words = split(text)
        size = min(13, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            windows.setdefault(tuple(words[i : i + size]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        words, hit, found = split(text), set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                if tuple(words[i : i + size]) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[tuple(words[i : i + size])] - {None}
        sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(words)))
    return out


def exact_rows(rows):
    """(doc_id, keep_id, group_size, kept, text_sha256), one kept row per text."""
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out, used = [], set()
    for doc_id, text in rows:
        text = text or ""
        known = [d for d in groups[text] if d is not None]
        keep = max(known) if known else None
        kept = doc_id == keep and text not in used
        if kept:
            used.add(text)
        out.append((doc_id, keep, len(groups[text]), kept, hashlib.sha256(text.encode()).hexdigest()))
    return out


def url_rows(rows, rules, default="allow"):
    """(page_id, host, path, rule, verdict) by trying every rule."""
    out = []
    for page_id, url in rows:
        host, path = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.split(r"[/?#]", rest, maxsplit=1)[0]
            path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
            host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [
            (len(h) + len(p), len(h), h + p, v)
            for h, p, v in rules
            if host and (host == h or host.endswith("." + h)) and path.startswith(p)
        ]
        best = max(fits, default=None)
        out.append((page_id, host, path, best and best[2], best[3] if best else default))
    return out


def archive_rows(rows, least=1000):
    """(page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    groups = {}
    for page_id, html in rows:
        groups.setdefault(html or "", []).append(page_id)
    out = []
    for page_id, html in rows:
        data = (html or "").encode()
        known = [p for p in groups[html or ""] if p is not None]
        refers = max(known) if len(data) >= least and known and page_id != max(known) else None
        out.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return out


def secret_spans(text):
    """Matches of the fixed secret patterns, found with the plain expressions."""
    text, out = text or "", []
    pattern = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [("assign", m.start(), m.end()) for m in re.finditer(pattern, text, re.I | re.A) if len(m[2]) >= 12]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return out


def personal_spans(text):
    """Matches of the fixed patterns for personal data."""
    text, out = text or "", []
    email = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
    out += [("email", m.start(), m.end()) for m in re.finditer(email, text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        odd, even = digits[-1::-2], digits[-2::-2]
        if 14 <= len(digits) <= 19 and (sum(odd) + sum(sum(divmod(2 * d, 10)) for d in even)) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def spans_sha(spans, kinds):
    ordered = sorted(spans, key=lambda s: (s[1], kinds.index(s[0])))
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in ordered).encode()).hexdigest()


# ---- 11: resampling ----------------------------------------------------------------


def gram_buckets(text, buckets=10_000):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return words, [zlib.crc32(g.encode()) % buckets for g in grams]


def resampled_rows(rows, target, percent=5):
    """(doc_id, n_features, weight, score, rank) of each row."""
    source, wanted = Counter(), Counter()
    for _, text in rows:
        source.update(gram_buckets(text)[1])
    for text in target:
        wanted.update(gram_buckets(text)[1])
    s_all, t_all = sum(source.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s_all + 10000) / ((source[b] + 1) * (t_all + 10000))))
    out = []
    for doc_id, text in rows:
        words, buckets = gram_buckets(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, buckets))
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(buckets), weight, score, None, len(words)])
    drawn = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for rank, row in enumerate(drawn[: percent * len(drawn) // 100], 1):
        row[4] = rank
    return [tuple(r[:5]) for r in out]


# ---- 13: spelling variants ----------------------------------------------------------


def one_edit(a, b):
    """Exactly one inserted, deleted or replaced letter apart."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def word_counts(rows):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 6 and n >= 5}


def variant_rows(counts):
    """(word, form, root, n, n_near, form_n) of each word."""
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for word, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[word] = best if best is not None and counts[best] >= 5 * counts[word] else None

    def root(word):
        return word if form[word] is None else root(form[word])

    return [(w, form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items()]
