"""Collocations beside a plain count, and the summaries' guarantee."""

import gc
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest

from millrace.llm import collocations as C, queries


def brute(docs, least=10, longest=3, contained=50, top=2000):
    """{(lang, rank): (phrase, a, l, r, n, score)}"""
    f, words = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            w = re.findall(r"[^ \t]+", piece)
            words[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = {}
    for lang, counts in f.items():
        found, longer = {}, Counter()
        for p, a in counts.items():
            if len(p) > 1 and a >= least:
                cuts = [(10 ** 6 * a * a // (counts[p[:j]] * counts[p[j:]]), j) for j in range(1, len(p))]
                score, j = min(cuts)
                found[p] = (a, counts[p[:j]], counts[p[j:]], score)
                for n in range(2, len(p)):
                    for s in range(len(p) - n + 1):
                        longer[p[s:s + n]] = max(longer[p[s:s + n]], a)
        kept = [(p, x) for p, x in found.items() if 100 * longer[p] < contained * x[0] or not longer[p]]
        kept.sort(key=lambda e: (-e[1][3], -e[1][0], " ".join(e[0]).encode()))
        for rank, (p, (a, left, right, score)) in enumerate(kept[:top], 1):
            out[lang, rank] = (" ".join(p), a, left, right, words[lang], score)
    return out


def rows_of(df):
    return {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


def frame(spark, docs):
    return spark.createDataFrame([(lang, t, "x", 1) for lang, t in docs], "lang string, text string, phrase string, n int").repartition(3)


def invented(seed, n):
    rng = random.Random(seed)
    say = ["New York City", "new york", "of the", "in the end", "Ünï Cödé", "a b c d", "日本 語"]
    return [(rng.choice(["en", "de", None, "", "en"]), "".join(rng.choice(say + ["w%d" % rng.randrange(30)]) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "; ", "\x0b"]) for _ in range(rng.randrange(60))))
            for _ in range(n)] + [("en", None), (None, ""), ("fr", "...,;"), ("xx", "one two")]


@pytest.mark.parametrize("chunk,longest,contained", [(6_000_000, 3, 50), (700, 3, 50), (700, 4, 80), (3000, 2, 50)])
def test_equals_a_plain_count(spark, monkeypatch, chunk, longest, contained):
    monkeypatch.setattr(C, "CHUNK_BYTES", chunk)
    docs = invented(longest, 250)
    got = rows_of(C.collocations(C.frequent_phrases(frame(spark, docs), longest=longest), contained, 40))
    want = brute(docs, longest=longest, contained=contained, top=40)
    assert got == want and len(want) > 40


def test_query_equals_a_plain_count(spark, sf_dir):
    docs = [(r.lang, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert rows_of(queries.op13_collocations(spark, sf_dir)) == brute(docs)


def test_awkward_tables(spark):
    assert C.collocations(C.frequent_phrases(frame(spark, []))).count() == 0
    assert C.collocations(C.frequent_phrases(frame(spark, [(None, None), ("a", ""), ("b", " \t.,")]))).count() == 0
    same = [("en", "hot pair here")] * 300 + [("en", "x " * 30_000)] + [("l%d" % i, "hot pair") for i in range(40)]
    assert rows_of(C.collocations(C.frequent_phrases(frame(spark, same)))) == brute(same)


def test_a_long_text_spreads_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK_BYTES", 500)
    docs = [("en", "alpha beta gamma, delta. " * 200), ("en", "no separator " * 200)]
    chunks = C.chunk_table(frame(spark, docs))
    assert chunks.count() > 8 and chunks.agg({"n_bytes": "sum"}).first()[0] == sum(len(t) for _, t in docs)
    assert rows_of(C.collocations(C.frequent_phrases(frame(spark, docs)))) == brute(docs)


def test_a_chunk_leaves_nothing_behind():
    """Words of chunks gone by don't wait for Python's search for cycles, and words as objects are never all held at once."""
    rng = np.random.default_rng(9)
    text = " ".join(f"w{x}" + "." * (x % 7 == 0) for x in (rng.zipf(1.3, 400_000) % 50_000).tolist()).encode()
    C._keys([C.Grams("en", text, 3)], 40)
    gc.collect()
    gc.disable()
    tracemalloc.start()
    try:
        keys, place, n = C._keys([C.Grams("en", text, 3)], 40)
        peak = tracemalloc.get_traced_memory()[1]
        assert int(n.sum()) > 900_000 and len(place) == len(n) and peak < 22 * len(text)
        del keys, place, n
        assert tracemalloc.get_traced_memory()[0] < 100_000
    finally:
        tracemalloc.stop()
        gc.enable()


def test_distinct_values_as_numpy_has_them():
    for values in (np.array([5, 3, 5, 5, 9, 3]), np.zeros(0, np.int64), np.array([7]), np.array([2 ** 64 - 1, 0, 2 ** 63], np.uint64)):
        for got, want in zip(C._distinct(values), np.unique(values, return_inverse=True, return_counts=True)):
            assert np.array_equal(got, want)


def test_every_frequent_key_survives_any_order_of_merges():
    rng = np.random.default_rng(4)
    for least in (2, 5, 10):
        keys = np.concatenate([rng.zipf(1.3, 4000) % 3000, np.repeat(np.arange(5000, 5060), least), rng.integers(10_000, 40_000, 3000)]).astype(np.uint64)
        rng.shuffle(keys)
        parts = np.array_split(keys, 17)
        half = [C.MisraGries(len(keys) // least) for _ in range(2)]
        for i, part in enumerate(parts):
            k, n = np.unique(part, return_counts=True)
            half[i % 2].merge([k], [n])
        both = C.MisraGries(len(keys) // least)
        both.taken = half[0].taken + half[1].taken
        both.merge([h.keys for h in half], [h.counts for h in half])
        assert both.taken < least and len(both.keys) <= both.capacity
        true = Counter(keys.tolist())
        assert {k for k, n in true.items() if n >= least} <= set(both.reaching(least).tolist())
        held = dict(zip(both.keys.tolist(), both.counts.tolist()))
        assert all(true[k] - both.taken <= n <= true[k] for k, n in held.items())
        assert len(both.reaching(least)) < len(true)


def test_scores_beyond_64_bits(spark):
    big = 4 * 10 ** 12
    counts = spark.createDataFrame([("en", "", 0, 10 ** 15), ("en", "a", 1, big + 3), ("en", "b", 1, big + 7), ("en", "a b", 2, big - 1)], "lang string, phrase string, k int, f long")
    (row,) = C.collocations(counts).collect()
    assert row.score == 10 ** 6 * (big - 1) ** 2 // ((big + 3) * (big + 7)) and (row.a, row.l, row.r, row.n) == (big - 1, big + 3, big + 7, 10 ** 15)
