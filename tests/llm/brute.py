"""What the contracts say, in plain Python over a small list of rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

NO_ID = 2**63 - 1


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def substring(rows, width=13):
    """(doc_id, n_words, n_removed, sha256 of the kept words) of (doc_id, text)."""
    least = {}
    for i, text in rows:
        w, key = words(text), NO_ID if i is None else i
        for k in range(len(w) - width + 1):
            s = tuple(w[k : k + width])
            least[s] = min(key, least.get(s, NO_ID))
    out = []
    for i, text in rows:
        w, key, gone = words(text), NO_ID if i is None else i, set()
        for k in range(len(w) - width + 1):
            if least[tuple(w[k : k + width])] < key:
                gone.update(range(k, k + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def fingerprint(text, width=3):
    w = words(lowered(text))
    shingles = [w[k : k + width] for k in range(max(1, len(w) - width + 1))] if w else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(" ".join(s).encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def components(fps):
    """doc id -> smallest id reachable over fingerprints two or fewer bits apart."""
    ids = sorted(fps)
    values = np.array([fps[i] for i in ids], np.uint64)
    comp = list(range(len(ids)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for k in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[k]) <= 2).tolist():
            a, b = root(k), root(j)
            comp[max(a, b)] = min(a, b)
    return {i: ids[root(k)] for k, i in enumerate(ids)}


def contained(docs, items, width=5, share=0.8):
    def shingles(text):
        w = words(lowered(text))
        if not w:
            return set()
        return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))}

    wanted = [(i, shingles(t)) for i, t in items]
    out = []
    for d, t in docs:
        own = shingles(t)
        for i, s in wanted:
            if s and len(s & own) >= share * len(s) - 1e-9:
                out.append((d, i, len(s & own), len(s)))
    return out


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
_ALLOWED = re.compile(
    r"(?i)example|sample|dummy|placeholder|x{6}|0{6}|1234567|abcdefg|^sha(1|256|384|512)[-_=]"
    r"|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
)


def base_spans(t):
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(found)


def _entropy(window):
    return -sum(c / 20 * math.log2(c / 20) for c in Counter(window).values())


def all_spans(t):
    base = base_spans(t)
    more = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", t):
        h = m[0]
        if not (re.search("[0-9]", h) and re.search("[A-Za-z]", h)) or _ALLOWED.search(h):
            continue
        if any(a < m.end() and m.start() < b for a, _, b in base):
            continue
        classes = [("[0-9a-f]+|[0-9A-F]+", 2.95), ("[a-z0-9]+|[A-Z0-9]+", 3.44), ("[A-Za-z0-9]+", 3.68)]
        classes += [(".*[a-z].*[A-Z].*|.*[A-Z].*[a-z].*", 3.72), (".+", 3.9)]
        least = next(bound for pattern, bound in classes if re.fullmatch(pattern, h))
        if max(_entropy(h[i : i + 20]) for i in range(len(h) - 19)) >= least - 1e-12:
            more.append((m.start(), 3, m.end()))
    return sorted(base + more)


def spans_text(spans):
    names = ("assign", "access", "hex", "entropy")
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)


def groups(rows):
    """digest -> ids of (doc_id, text)."""
    found = defaultdict(list)
    for i, t in rows:
        found[hashlib.sha256(lowered(t).encode()).hexdigest()].append(i)
    return found
