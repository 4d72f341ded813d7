"""Plain, slow versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def repeats(docs):
    """{id: (n_bytes, n_removed, n_spans, sha)} of the 50-byte rule."""
    seen, out = {}, {}
    for i in sorted(docs):
        b = (docs[i] or "").encode()
        cover = bytearray(len(b))
        for p in range(len(b) - 49):
            if seen.setdefault(b[p:p + 50], i) < i:
                cover[p:p + 50] = b"\1" * 50
        spans = sum(c and (k == 0 or not cover[k - 1]) for k, c in enumerate(cover))
        out[i] = (len(b), sum(cover), spans, hashlib.sha256(bytes(x for x, c in zip(b, cover) if not c)).hexdigest())
    return out


def shingles(text):
    w = words(text)
    return {k: 1 + math.log(v) for k, v in Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))).items()} if w else {}


def similarity(x, y):
    both = set(x) | set(y)
    return sum(1 / sum(max(x.get(f, 0) / x[e], y.get(f, 0) / y[e]) for f in both) for e in set(x) & set(y))


def groups(docs):
    """{id: smallest id of its near-duplicate group}"""
    first = {}
    for i in sorted(docs):
        first.setdefault(docs[i] or "", i)
    sets = {i: shingles(t) for t, i in first.items()}
    inverted, parent = defaultdict(list), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for k in s:
            inverted[k].append(i)
    for i, s in sets.items():
        for j, n in Counter(j for k in s for j in inverted[k] if j > i).items():
            if n / (len(s) + len(sets[j]) - n) > 0.6 and similarity(s, sets[j]) >= 0.8 and root(i) != root(j):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(first[t or ""]) for i, t in docs.items()}


def leaks(docs, items):
    """{id: (n_words, n_hit, sorted item ids)}"""
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k:k + 10])].add(str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for i, text in docs.items():
        w, hit, found = words(text), set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                ids = windows.get(tuple(w[k:k + m]))
                if ids:
                    hit.update(range(k, k + m))
                    found |= ids
        out[i] = (len(w), len(hit), sorted(found))
    return out


def base_secrets(text):
    """[(start, kind number, stop)] of the fixed patterns."""
    t, out = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out)
