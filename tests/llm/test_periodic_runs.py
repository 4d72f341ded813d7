"""Periodic runs beside a scan of every lag."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from millrace.llm import periodic_runs, queries
from millrace.llm.common import stored

SPACES = " \t\n\x0b\x0c\r"


def brute_runs(x, least=12):
    found = {}
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def words_of(text):
    return (text or "").translate({ord(c): " " for c in SPACES}).split(" ") if text else []


def brute_digest(doc_id, text):
    w = [x for x in words_of(text) if x]
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return periodic_digest(" ".join(w))


def periodic_digest(text):
    w = [x for x in words_of(text) if x]
    runs = brute_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


COLUMNS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_a_scan_of_every_lag(seed):
    rng = random.Random(seed)
    for _ in range(400):
        n, k = rng.randint(0, 90), rng.choice([1, 2, 3, 5, 20, 60])
        x = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.6:
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 2))
            x = [x[i] if i < a else x[a + (i - a) % p] for i in range(n)]
            for _ in range(rng.choice([0, 0, 1, 4])):
                x[rng.randrange(n)] = 999
        least = rng.choice([12, 12, 2, 5, 20])
        assert [tuple(r) for r in periodic_runs.runs_of(np.array(x, np.int64), least).tolist()] == brute_runs(x, least)


def test_segments_hold_every_word_twice():
    rng = np.random.default_rng(5)
    for _ in range(50):
        x = rng.integers(0, 40, 300)
        found = periodic_runs.segments(x)
        inside = np.zeros(len(x), bool)
        for s, e in found:
            assert e - s >= 12 and np.unique(x[s:e], return_counts=True)[1].min() >= 2
            inside[s:e] = True
        assert all(inside[s:s + n].all() for s, n, _ in brute_runs(x.tolist()))


def test_long_texts_take_few_steps():
    same, chain = np.zeros(50_000, np.int64), np.array([0] + [v for i in range(1, 20_000) for v in (i, i - 1)])
    assert periodic_runs.runs_of(same).tolist() == [[0, 50_000, 1]] and periodic_runs.segments(chain) == []
    assert periodic_runs.runs_of(np.tile(np.arange(9_000), 3)).tolist() == [[0, 27_000, 9_000]]


def test_query_equals_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in stored(queries.op11_periodic_runs(spark, sf_dir), "runs").collect()}
    chosen = [i for i, t in docs.items() if len(t or "") < 12_000]
    assert set(got) == set(docs) and len(chosen) > 100
    assert {i: got[i] for i in chosen} == {i: brute_digest(i, docs[i]) for i in chosen}


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "WINDOW", 40)
    say = "one two three " * 9
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, say), (4, say), (4, "other words"), (None, say), (5, f"in\tfront\n{say}\x0bbehind\r\n"), (6, "x " * 12), (7, "x " * 11),
            (8, "Ünï 日本 " * 8), (9, "w" * 200_000), (10, "a b " * 5 + "a c " + "a b " * 6), (11, "one two " * 12), (12, "\x00 " * 30)]
    docs = spark.createDataFrame([(i, t, "x", [1]) for i, t in rows], "doc_id long, text string, _periodic string, runs array<int>").repartition(3)
    out = periodic_runs.find_runs(docs)
    assert out.columns == [*docs.columns, "__periodic"]
    want = sorted(repr((i, *periodic_digest(t))) for i, t in rows)
    assert sorted(repr((r.doc_id, *[r[c] for c in COLUMNS])) for r in periodic_runs.run_digest(out).collect()) == want
    assert periodic_runs.run_digest(periodic_runs.find_runs(docs.limit(0))).count() == 0
