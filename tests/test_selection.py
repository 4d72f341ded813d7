"""Copies, pass rates, pairs and ratio masks beside plain versions."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.operators import selection as S, tokenlog as L


@pytest.mark.parametrize("hot_rows", [None, 20])
def test_exact_copies(spark, hot_rows):
    rng = random.Random(1)
    base = ["Hot  text\n", " hot text", "HOT TEXT", "other", "Ünï cödé", "", None, "  ", "a\tb", "a b"]
    rows = [(i, rng.choice(base)) for i in range(300)] + [(None, "other"), (None, None), (7, "again"), (7, "again")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "id long, text string, first string").repartition(4)
    out = S.exact_dedup(df, "id", "text", hot_rows=hot_rows)
    assert out.columns == ["id", "text", "text_md5", "copies", "first"]
    groups = defaultdict(list)
    form = lambda t: re.sub(r"\s+", " ", t or "").strip().lower()
    for i, t in rows:
        groups[form(t)].append(i)
    want = [(i, t, hashlib.md5(form(t).encode()).hexdigest(), len(groups[form(t)]), i == min(x for x in groups[form(t)] if x is not None)) for i, t in rows]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
    report = S.duplicate_report(out).first()
    assert (report["rows"], report.texts, report.removed) == (len(rows), len(groups), sum(not w[4] for w in want))
    empty = S.exact_dedup(df.limit(0), "id", "text")
    assert empty.count() == 0 and S.duplicate_report(empty).first().share == 0


def test_pass_rates(spark):
    rows = [("all", 1.0), ("all", 1.0), ("none", 0.0), ("none", 0.0), ("some", 1.0), ("some", 0.0), ("some", None), ("one", 0.0), ("soft", 0.6), ("soft", 0.9), (None, 0.2), (None, 0.7), ("gone", None)]
    df = spark.createDataFrame(rows, "p string, reward double")
    got = {r.p: (r.samples, r.pass_rate, r.signal, r.kept) for r in S.passrate_filter(df, "p").collect()}
    assert got == {"all": (2, 1.0, False, False), "none": (2, 0.0, False, False), "some": (2, 0.5, True, True), "one": (1, 0.0, False, False), "soft": (2, 1.0, True, False), None: (2, 0.5, True, True)}
    assert S.passrate_filter(df, "p", least=3).where("kept").count() == 0 and S.passrate_filter(df.limit(0), "p").count() == 0


def test_pairs(spark):
    rows = [("a", 1, "best", 1.0), ("a", 2, "worst", 0.0), ("a", 3, "tie best", 1.0), ("a", 4, "tie worst", 0.0), ("far", 1, "x" * 300, 1.0), ("far", 2, "y", 0.0), ("near", 1, "x", 0.6), ("near", 2, "y", 0.4),
            ("one", 1, "x", 1.0), ("null", 1, None, 1.0), ("null", 2, "y", 0.0), ("null", 3, "z", None), (None, 1, "p", 0.9), (None, 2, "q", 0.1)]
    df = spark.createDataFrame(rows, "p string, id int, text string, reward double")
    got = {r.p: (r.chosen_key, r.rejected_key, r.chosen, r.rejected, r.delta, r.apart) for r in S.preference_pairs(df, "p", "id", "text", F.length("text")).collect()}
    assert got == {"a": (1, 2, "best", "worst", 1.0, 1), None: (1, 2, "p", "q", 0.8, 0)}
    assert S.preference_pairs(df, "p", "id", "text", F.length("text"), least_delta=0.0).where("p = 'one'").count() == 0


def test_ratio_mask(spark):
    df = spark.createDataFrame([([0.5, 1.0, 1.2, 3.0, 1.0], [0.0, 1.0, 1.0, 1.0, 1.0]), ([0.1, 0.2], [1.0, 1.0]), ([], [])], "r array<double>, m array<double>")
    assert [x.k for x in df.select(L.ratio_mask(F.col("r"), F.col("m"), 0.8, 1.2).alias("k")).collect()] == [[0.0, 1.0, 1.0, 0.0, 1.0], [0.0, 0.0], []]
    (row,) = L.ratio_mask_report(df, "r", "m", 0.8, 1.2).collect()
    assert (row.tokens, row.kept, row.below, row.above) == (6, 3, 2, 1) and row.ratio_mean == pytest.approx(3.2 / 3)
    assert L.ratio_mask_report(df.limit(0), "r", "m", 0.8, 1.2).first().tokens == 0
