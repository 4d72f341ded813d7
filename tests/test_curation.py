"""Packing, mixing, upsampling and interleaving beside plain versions and on awkward rows."""

import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from millrace.operators import context as X, lines as L, mixing as M, packing as P

# --- packing ---


def best_fit(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=room.__getitem__)] -= n
        else:
            room.append(capacity - n)
    return len(room)


def lengths_of(seed, n, capacity):
    rng = random.Random(seed)
    return [rng.choice([rng.randint(1, capacity), rng.randint(1, capacity // 4), capacity // 2 + 1]) for _ in range(n)]


@pytest.mark.parametrize("seed,block_rows,blocks", [(1, 50_000, 1), (2, 500, 4), (3, 100, 20)])
def test_windows_hold_every_document_once(spark, seed, block_rows, blocks):
    sizes = lengths_of(seed, 2000, 512)
    df = spark.createDataFrame(list(enumerate(sizes)), "id long, n long").repartition(5)
    rows = P.pack_documents(df, "id", "n", 512, block_rows).collect()
    assert sorted((r.id, r.n) for r in rows) == list(enumerate(sizes))
    by_window = defaultdict(list)
    for r in rows:
        by_window[r.window].append((r.segment, r.start, r.n))
    for parts in by_window.values():
        parts.sort()
        assert [p[0] for p in parts] == list(range(1, len(parts) + 1))
        assert [p[1] for p in parts] == [sum(x[2] for x in parts[:k]) for k in range(len(parts))] and sum(p[2] for p in parts) <= 512
    assert len({w >> 32 for w in by_window}) == blocks
    assert len(by_window) <= 1.02 * best_fit(sizes, 512) + blocks


def test_packing_of_awkward_rows(spark):
    rows = [(1, 5), (1, 5), (None, 7), (2, None), (3, 0), (4, 64), (5, 65), (6, 10_000), (7, -3), (None, None)]
    df = spark.createDataFrame([(i, n, "x", 1) for i, n in rows], "id long, n int, window string, segment int")
    packed = P.pack_documents(df, "id", "n", 64)
    assert packed.columns == ["id", "n", "window", "segment", "start", "oversized"]
    got = packed.collect()
    assert sorted(map(repr, [(r.id, r.n) for r in got])) == sorted(map(repr, rows))
    assert {r.id for r in got if r.oversized} == {5, 6} and all(r.start == 0 for r in got if r.oversized)
    (report,) = P.packing_report(packed, "n", 64).collect()
    assert (report.documents, report.oversized, report.misplaced, report.overfull, report.well_filled) == (10, 2, 0, 0, True)
    full = P.windows(packed.where("not oversized"), "id", "n").collect()
    assert sum(len(w.documents) for w in full) == 8 and all(w.tokens == sum(w.lengths) <= 64 for w in full)
    empty = P.pack_documents(df.limit(0), "id", "n", 64)
    assert empty.count() == 0 and P.packing_report(empty, "n", 64).first().documents == 0


def test_packing_deals_a_shared_length_over_blocks(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 40).otherwise(F.col("id") % 97 + 1).alias("n"))
    per_block = P.pack_documents(df, "id", "n", 128, 250).groupBy(F.shiftright("window", 32).alias("b")).agg(F.count_if(F.col("n") == 40).alias("hot"), F.count(F.lit(1)).alias("rows")).collect()
    assert len(per_block) == 12 and all(r.rows == 250 and 75 <= r.hot <= 95 for r in per_block)


def test_report_sees_what_is_wrong(spark):
    rows = [(1, 0, 1, 0, 10, False), (2, 0, 2, 11, 10, False), (3, 1, 1, 0, 60, False), (4, 1, 2, 60, 10, False)]
    bad = spark.createDataFrame(rows, "id long, window long, segment int, start long, n long, oversized boolean")
    report = P.packing_report(bad, "n", 64).first()
    assert report.misplaced == 1 and report.overfull == 1


def test_segment_ids(spark):
    got = spark.range(1).select(P.segment_ids(F.array(*map(F.lit, [2, 0, 3])), 8).alias("s"), P.segment_ids(F.array().cast("array<int>"), 2).alias("e")).first()
    assert got.s == [1, 1, 3, 3, 3, 0, 0, 0] and got.e == [0, 0]


# --- mixing ---

def water_fill(available, weights, total):
    """Level by level, in fractions."""
    out, live, left = {s: 0 for s in available}, {s for s in available if weights.get(s, 0) > 0}, Fraction(total)
    while live:
        level = left / sum(weights[s] for s in live)
        short = {s for s in live if available[s] <= weights[s] * level}
        if not short:
            return out | {s: int(weights[s] * level) for s in live}
        for s in short:
            out[s] = available[s]
            left -= available[s]
        live -= short
    return out


@pytest.mark.parametrize("seed", range(4))
def test_budgets_fill_like_water(spark, seed):
    rng = random.Random(seed)
    available = {f"s{i}": rng.choice([0, 1, rng.randint(1, 50), rng.randint(1, 5000)]) for i in range(15)}
    weights = {f"s{i}": rng.randint(0, 9) for i in range(12)} | {"absent": 4}
    df = spark.createDataFrame(list(available.items()), "s string, available long")
    for total in (0, 17, 900, 6000, 10 ** 6):
        got = {r.s: r.budget for r in M.budgets(df, "s", weights, total).collect()}
        assert got == water_fill(available, weights, total)


def test_mixture_takes_what_the_budget_allows(spark):
    rng = random.Random(7)
    rows = [(i, "hot" if i % 3 else f"s{i % 5}", rng.randint(1, 90)) for i in range(3000)] + [(9000, None, 5), (9001, "s1", None), (9002, "unnamed", 8)]
    df = spark.createDataFrame([(i, s, n, "x") for i, s, n in rows], "id long, source string, n int, budget string").repartition(4)
    weights, available = {"hot": 1, "s0": 3, "s1": 1, "s2": 500}, Counter()
    for _, s, n in rows:
        available[s] += n or 0
    for total in (0, 5000, 40_000, 10 ** 9):
        want = water_fill({s: n for s, n in available.items() if s}, weights, total)
        mixed = M.mixture(df, "source", "id", "n", weights, total, seed=3)
        assert mixed.columns == df.columns
        got = mixed.collect()
        taken, largest = Counter(), 90
        for r in got:
            taken[r.source] += r.n or 0
        assert len({r.id for r in got}) == len(got) and set(taken) <= set(weights)
        assert all(want[s] - largest < taken[s] <= want[s] for s in weights if s in available)
        report = {r.source: r for r in M.mixture_report(df, mixed, "source", "n", weights, total).collect()}
        assert all(report[s].taken == taken[s] and report[s].budget == want[s] for s in want) and report[None].budget == 0
    again = {r.id for r in M.mixture(df.repartition(7), "source", "id", "n", weights, 40_000, seed=3).collect()}
    assert again == {r.id for r in M.mixture(df, "source", "id", "n", weights, 40_000, seed=3).collect()}
    assert M.mixture(df.limit(0), "source", "id", "n", weights, 100).count() == 0


@pytest.mark.parametrize("ratio,top,power", [(1.0, 6.0, 1), (0.6, 5.0, 1), (1.5, 7.0, 2), (0.5, 3.0, 3), (1.0, 2.0, 0), (1.0, 2.6, 1), (1.0, 3.3, 1)])
def test_curves_meet_their_targets(ratio, top, power):
    c = M.Curve.solve(ratio, top, power=power)
    steps = [c.below((k + 1) / 2000) - c.below(k / 2000) for k in range(2000)]
    assert abs(c.below(1.0) - ratio) < 1e-9 and c.below(0.4) == 0 and abs((c.below(1.0) - c.below(0.95)) / 0.05 - top) < 1e-6
    assert all(b >= a - 1e-11 for a, b in zip(steps, steps[1:]))
    f = lambda u: c.scale * u ** power * M.math.exp(c.rate * u)
    assert all(abs(steps[k] * 2000 - f((k + 0.5) / 2000 - 0.4)) < 1e-3 for k in range(801, 2000, 37))


def test_a_curve_that_cannot_rise_is_refused():
    with pytest.raises(ValueError):
        M.Curve.solve(3.0, 1.0)


def test_copies_follow_the_curve(spark):
    rows = [(i, "hot" if i % 2 else f"t{i % 3}", (i * 7919) % 1000 / 10) for i in range(6000)] + [(9000, None, 1.0), (9001, "t0", None), (9002, "hot", None)]
    df = spark.createDataFrame([(i, t, s, 1) for i, t, s in rows], "id long, topic string, score double, copy int").drop("copy").repartition(5)
    got = M.quality_upsample(df, "topic", "id", "score", {"t1": 0.7}, seed=2).collect()
    ranks = {}
    for topic in {t for _, t, _ in rows}:
        own = sorted(((s if s is not None else float("-inf"), i) for i, t, s in rows if t == topic))
        ranks |= {i: (k, len(own)) for k, (_, i) in enumerate(own)}
    copies = Counter(r.id for r in got)
    place = lambda i: ranks[i][0] / ranks[i][1]
    assert all(place(i) + 1 / ranks[i][1] > 0.4 for i in copies)
    for r in got:
        c = M.Curve.solve(0.7 if r.topic == "t1" else 1.0)
        k, n = ranks[r.id]
        assert abs(r.expected - n * (c.below((k + 1) / n) - c.below(k / n))) < 1e-9 and abs(copies[r.id] - r.expected) < 1
        assert r.copy <= copies[r.id]
    best = [r.expected for r in got if place(r.id) >= 0.95 and r.topic == "hot"]
    assert 5 <= min(best) and max(best) <= 7.2 and abs(sum(r.topic == "hot" for r in got) - 3000) < 60
    assert M.quality_upsample(df.limit(0), "topic", "id", "score").count() == 0


# --- interleaving ---

def neighbours(order):
    return sum(a == b for a, b in zip(order, order[1:]))


@pytest.mark.parametrize("sizes", [[1], [2, 1], [6, 5], [400, 401, 1], [60] * 20, [501, 300, 199], [700, 1, 1], [334, 333, 333]])
def test_sources_are_kept_apart(spark, sizes):
    rows = [(1000 * k + i, f"s{k}") for k, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, source string").repartition(3)
    got = sorted(M.interleave(df, "source", "id", seed=1).collect(), key=lambda r: r.position)
    n = len(rows)
    assert [r.position for r in got] == list(range(n)) and sorted((r.id, r.source) for r in got) == rows
    assert neighbours([r.source for r in got]) == max(0, 2 * max(sizes) - n - 1)
    if n > 900:  # every source is spread: each tenth has about a tenth of it
        for k, m in enumerate(sizes):
            if m >= 190:
                per = Counter(r.position * 10 // n for r in got if r.source == f"s{k}")
                assert all(0.6 * m / 10 <= per[t] <= 1.4 * m / 10 for t in range(10))


def test_interleaving_awkward_rows(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (2, None), (3, None), (None, None), (4, "b"), (5, "b")]
    df = spark.createDataFrame([(i, s, i) for i, s in rows], "id long, source string, position long")
    got = M.interleave(df, "source", "id")
    assert got.columns == ["id", "source", "position"]
    out = sorted(got.collect(), key=lambda r: r.position)
    assert [r.position for r in out] == list(range(8)) and sorted(map(repr, [(r.id, r.source) for r in out])) == sorted(map(repr, rows))
    report = M.neighbour_report(got, "source").first()
    assert (report["rows"], report.same_source, report.least) == (8, 0, 0)
    assert M.interleave(df.limit(0), "source", "id").count() == 0 and M.neighbour_report(got.limit(0), "source").first()["rows"] == 0


# --- recent turns ---

def recent(turns, keep, limit):
    """(context, tokens, kept) of every turn of one conversation, one after the other."""
    out, goal, total, context = [], 0, 0, 0
    for pos, cost in enumerate(max(1, c if c is not None else 1) for c in turns):
        if pos == 0:
            goal = total = cost
        elif pos == 1:
            total = goal + cost
        elif total + cost > limit:
            total, context = goal + cost, context + 1
        else:
            total += cost
        out.append((context, total))
    return [(c, t, i == 0 or i + keep >= len(out) or out[i + keep][0] != c) if keep else (c, t, i == 0) for i, (c, t) in enumerate(out)]


@pytest.mark.parametrize("keep,limit,bits", [(3, 40, 16), (2, 30, 5), (1, 7, 3), (5, 250, 8), (0, 31, 5)])
def test_recent_turns_equal_a_sequential_scan(spark, keep, limit, bits):
    """Long conversations over many blocks (bits: turns of a block), short ones beside them."""
    rng = random.Random(limit)
    talks = {i: [rng.choice([1, 2, 3, 9, limit + 5, None, 0]) for _ in range(n)] for i, n in enumerate([1, 2, 3, 40, 700, 1501, 64, 33, 32, 31])}
    talks |= {100: [1] * 900, 101: [limit] * 50, 102: [5 * limit] + [2] * 200}
    rows = [(c, t * 3, n, f"{c}/{t}") for c, ns in talks.items() for t, n in enumerate(ns)]
    df = spark.createDataFrame(rows, "conv long, turn long, n int, text string").repartition(4)
    got = {(r.conv, r.turn): (r.context, r.context_tokens, r.kept) for r in X.keep_recent(df, "conv", "turn", "n", keep, limit, bits).collect()}
    want = {(c, 3 * t): x for c, ns in talks.items() for t, x in enumerate(recent(ns, keep, limit))}
    assert got == want


def test_recent_turns_of_awkward_rows(spark):
    rows = [(None, 1, 5), (None, None, 5), (1, None, 3), (1, 2, 4), (1, 2, 4), (2, 0, None)]
    df = spark.createDataFrame([(c, t, n, "text", "x") for c, t, n in rows], "conv long, turn int, n int, text string, context string")
    got = X.keep_recent(df, "conv", "turn", "n", 1, 10)
    assert got.columns == ["conv", "turn", "n", "text", "context", "context_tokens", "kept"] and got.count() == len(rows)
    by = {(r.conv, r.turn): r for r in got.collect()}
    assert by[None, 1].context_tokens == 5 and by[None, None].context_tokens == 10 and by[1, None].context == 1
    assert {r.text for r in X.blanked(got, "text").collect() if not r.kept} <= {""}
    assert X.keep_recent(df.limit(0), "conv", "turn", "n", 1, 10).count() == 0


# --- repeated lines ---

def without_repeated(texts, least):
    in_rows = Counter(line for t in texts if t is not None for line in {x.strip() for x in t.split("\n")} - {""})
    out = []
    for t in texts:
        kept = None if t is None else [x for x in t.split("\n") if in_rows[x.strip()] < least]
        out.append((None if t is None else "\n".join(kept), 0 if t is None else len(t.split("\n")) - len(kept)))
    return out


@pytest.mark.parametrize("hot_rows", [None, 50])
def test_repeated_lines_go_and_the_order_stays(spark, hot_rows):
    rng = random.Random(3)
    lines = ["hot footer"] * 9 + [f"line {i}" for i in range(400)] + ["", " ", "\t hot footer ", "Menu | Home", "ß é 日本", "trailing  "]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randrange(12))) for _ in range(900)] + [None, "", "\n", "\n\n", "hot footer", "hot footer\nhot footer\n", "a\r\nhot footer\r\nb", None]
    texts += ["\n".join(f"own {i}" if i % 2 else "hot footer" for i in range(20_000))]
    df = spark.createDataFrame([(i % 800, t, "x") for i, t in enumerate(texts)], "id long, text string, lines_removed string").repartition(4)
    for least in (2, 5, 300):
        got = L.drop_repeated_lines(df, "text", least, hot_rows)
        assert got.columns == ["id", "text", "lines_removed"]
        want = [(i % 800, *x) for i, x in enumerate(without_repeated(texts, least))]
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert L.drop_repeated_lines(df.limit(0), "text", 2).count() == 0
