"""Languages and the secret scan's own spans beside versions written out plainly."""

import hashlib
import math
import re
import zlib
from collections import Counter

import brute
from millrace.llm import queries, rank_order, secret_markov
from millrace.llm.common import stored

# --- rank-order profiles ---


def grams(text):
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    if not words:
        return Counter()
    s = " " + " ".join(words) + " "
    code = lambda part: sum(ord(c) << 21 * (len(part) - 1 - i) for i, c in enumerate(part))
    return Counter([code(c) for c in s if c != " "] + [code(s[i:i + 2]) for i in range(len(s) - 1)] + [code(s[i:i + 3]) for i in range(len(s) - 2)])


def top(counts, k):
    return sorted(counts, key=lambda g: (-counts[g], g))[:k]


def languages_by_hand(docs, size=rank_order.PROFILE, compared=rank_order.RANKED):
    """{id: (held out, language, score)}"""
    held, counts = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in docs}, {}
    for i, (lang, text) in docs.items():
        if not held[i] and lang is not None:
            counts.setdefault(lang, Counter()).update(grams(text))
    profiles = {lang: {g: r for r, g in enumerate(top(c, size))} for lang, c in counts.items() if c}
    out = {}
    for i, (_, text) in docs.items():
        own = top(grams(text), compared)
        if not own or not profiles:
            out[i] = held[i], "und", 0.0
            continue
        far = {lang: sum(abs(p[g] - r) if g in p else size for r, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(far), key=far.__getitem__)
        out[i] = held[i], best, max(0.0, 1 - far[best] / (size * len(own)))
    return out


def test_languages_equal_plain_distances(spark, sf_dir):
    docs = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: (r.held_out, r.lang_pred, r.score) for r in queries.op3_rank_order(spark, sf_dir).collect()}
    want = languages_by_hand(docs)
    assert set(got) == set(want)
    assert all(got[i][:2] == want[i][:2] and math.isclose(got[i][2], want[i][2], abs_tol=1e-12) for i in want)


def test_ties_of_counts_and_distances(spark):
    """Equal counts rank by n-gram, equal distances go to the first language by name; small profiles make both common."""
    texts = ["ab ba", "ba ab", "abc", "cab", "", None, "é É", "1 2", "a", "b", "zz", "日本 日", "ab ab ab", "bab aba"]
    docs = {i: (("x", "y", None)[i % 3], t) for i, t in enumerate(texts * 4)}
    df = spark.createDataFrame([(i, lang, t) for i, (lang, t) in docs.items()], "doc_id long, lang string, text string").repartition(3)
    held = [i for i in docs if zlib.crc32(str(i).encode()) % 4 == 2]
    profiles = rank_order.train(df.where(~df.doc_id.isin(held)))
    got = {r.doc_id: (r._lang.lang, r._lang.score) for r in rank_order.identify(df.drop("lang"), profiles).collect()}
    want = languages_by_hand(docs)
    assert got == {i: w[1:] for i, w in want.items()} and len({w[1] for w in want.values()}) == 3


# --- the secret scan's own spans ---

def spans_by_hand(text, ratio):
    """All spans (start, kind, stop) of a text, character by character. `ratio` is a table over classes of bytes."""
    base = brute.base_secrets(text)
    out, t = list(base), text or ""
    cls = [secret_markov.CLASS[c.encode()[0]] if c.isascii() else None for c in t]
    i = 0
    while i < len(t):
        j = i
        while j < len(t) and t[j].isascii() and ord(t[j]) in secret_markov.ALPHABET:
            j += 1
        if j - i >= secret_markov.TOKEN_CHARS:
            by = [[k for k, (a, _, b) in enumerate(base) if a <= x < b] for x in range(i, j)]
            # Stretches under base spans (kinds that touch them joined through overlaps) and free ones, in turn.
            edges, stretches = [], []
            for a, kind, b in sorted((max(i, a), kind, min(j, b)) for a, kind, b in base if a < j and b > i):
                if edges and a <= edges[-1][1]:
                    edges[-1] = [edges[-1][0], max(b, edges[-1][1]), edges[-1][2] or kind == 0]
                else:
                    edges.append([a, b, kind == 0])
            assert all(bool(by[x - i]) == any(a <= x < b for a, b, _ in edges) for x in range(i, j))
            walls = [[i, i, True], *edges, [j, j, True]]
            for left, right in zip(walls, walls[1:]):
                x, y = left[1], right[0]
                start, stop = (x if left[2] else left[0]), (y if right[2] else right[1])
                if x < y and stop - start >= secret_markov.TOKEN_CHARS:
                    steps = [float(ratio[cls[p - 1]][cls[p]]) for p in range(start + 1, stop)]
                    own = [float(ratio[cls[p - 1]][cls[p]]) for p in range(max(start + 1, x), min(stop, y + 1))]
                    if sum(steps) >= secret_markov.LEAST_TOTAL and sum(own) >= secret_markov.LEAST_MEAN * len(own):
                        if stretches and start < stretches[-1][1]:
                            start = stretches.pop()[0]
                        stretches.append((start, stop))
            out += [(a, 3, b) for a, b in stretches]
        i = max(j, i + 1)
    return sorted(out)


def test_secret_spans_equal_a_plain_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ratio = secret_markov.train(docs)
    mixed = "aZ3kQ9xW7vB2nM5pL8cR4tY6uJ1hG0fD"
    extra = [f"é {mixed} ü", f"password = {mixed}{mixed}.x", f"{mixed}0123456789abcdef{mixed} AKIA{'A1' * 10}", f"token: {mixed[:12]}_{mixed}", "the_name_of_the_river_ an_ordinary_name_of_things", None, "",
             f"日本 secret='{mixed}' {mixed}-{'deadbeef' * 3}-{mixed}", f"{'0123456789abcdef' * 2}-{mixed[:10]}"]
    texts = {r.doc_id: r.text for r in docs.collect()} | {90_000 + k: t for k, t in enumerate(extra)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    found = secret_markov.find_secrets(df, ratio)
    kinds = {k: i for i, k in enumerate(secret_markov.KINDS)}
    got = {r.doc_id: [(s.start, kinds[s.kind], s.stop) for s in r._secrets.spans] for r in found.collect()}
    want = {i: spans_by_hand(t, ratio) for i, t in texts.items()}
    assert got == want and sum(k == 3 for w in want.values() for _, k, _ in w) >= 3
    digest = {r.doc_id: (r.base_sha256, r.spans) for r in secret_markov.secret_digest(found).collect()}
    line = lambda spans: ",".join(f"{secret_markov.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    assert digest == {i: (hashlib.sha256(line([s for s in w if s[1] != 3]).encode()).hexdigest(), line(w)) for i, w in want.items()}
    assert re.match("^[a-z]+:", next(s for _, s in digest.values() if s)) and stored(found, "spans").count() == len(texts)
