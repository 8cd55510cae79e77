"""Plain-Python versions of the corpus operators, for small inputs."""

from __future__ import annotations

import hashlib
import re

LOWER = {c: c + 32 for c in range(65, 91)}


def substring_dedup(docs):
    """{doc_id: (n_bytes, n_removed, n_spans, sha256)} of (doc_id, text) with distinct ids; null ids are left out."""
    seen, out = set(), {}
    for i, text in sorted((d for d in docs if d[0] is not None), key=lambda d: d[0]):
        b = (text or "").encode()
        gone = bytearray(len(b))
        windows = [b[p : p + 50] for p in range(len(b) - 49)]
        for p, w in enumerate(windows):
            if w in seen:
                gone[p : p + 50] = b"\1" * 50
        seen.update(windows)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(w) < size:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(zip(*(w[k:] for k in range(size)), strict=False))


def components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_duplicates(docs, size, percent=80):
    """{doc_id: (n_shingles, component)}."""
    sets = {i: shingles(t, size) for i, t in docs}
    ids = sorted(sets)
    links = []
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            s, t = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                links.append((a, b))
    c = components(ids, links)
    return {i: (len(sets[i]), c[i]) for i in ids}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(docs, items, width=10):
    """{doc_id: (n_words, n_hit, item ids)}."""
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - width + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + width]), set()).add(item)
    out = {}
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                got = windows.get(tuple(w[k : k + n]))
                if got:
                    hit.update(range(k, k + n))
                    found |= got
        out[i] = (len(w), len(hit), sorted(map(str, found)))
    return out
