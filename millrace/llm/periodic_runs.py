"""Periodic runs of words: recursive frequency splitting, then a lag scan of the segments that are left.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), of length max(LEAST, 2q) or more, that no
neighbouring word extends. Every word of a run stands in it twice, so a word that occurs once within a segment belongs to no run
inside it and splits it. The parts are split again by their own counts until nothing changes; parts under LEAST words go. After a split
only the smaller parts, and words of the largest that occur in these, are looked at: n log n steps whatever the text.

In a surviving segment a run of period q shows as a stretch of max(q, LEAST - q) positions or more whose words equal those q later, so the
scan compares the words at multiples of that number only: n/q of them for lag q. Equal words are extended to both sides by a
table of ranks of 1, 2, 4, ... words, exactly. A run seen at several lags has its smallest as period.

Cases: null and empty texts and texts of blanks have no words and no run. A text is one record: its words are numbered a megabyte at
a time, and a text of n words takes some 100 n bytes, 8 n log n more in segments that repeat. Rows are judged one by one: null or
repeated ids, ties, other columns and empty tables change nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import annotated, free_name, per_text

LEAST = 12  # words in a run
WINDOW = 1 << 20  # bytes split into words at a time
PAIRS = 1 << 20  # (position, lag) pairs compared at a time
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
STRUCT = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def windows(raw: bytes) -> Iterator[list[bytes]]:
    """The words [^ \\t-\\r]+ of a text, some at a time."""
    start = 0
    while start < len(raw):
        end = _BLANK.search(raw, start + WINDOW)
        stop = end.start() if end else len(raw)
        yield raw[start:stop].split()
        start = stop


def numbered(raw: bytes) -> np.ndarray:
    """Words as numbers: the place where the word first occurs."""
    first, at, parts = {}, count(), [np.zeros(0, np.int64)]
    for words in windows(raw):
        parts.append(np.fromiter(map(first.setdefault, words, at), np.int64, len(words)))
    return np.concatenate(parts)


def segments(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """(start, stop) of the segments of `least` words or more in which every word occurs twice."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    same = ids[order[1:]] == ids[order[:-1]]
    before, after = np.full(n, -1), np.full(n, n)
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    out, stack = [], [(0, n, np.arange(n))] if n >= least else []
    while stack:
        lo, hi, look = stack.pop()
        rare = np.unique(look[(before[look] < lo) & (after[look] >= hi)])
        if not len(rare):
            out.append((lo, hi))
            continue
        edges = np.concatenate([[lo - 1], rare, [hi]])
        sizes = np.diff(edges) - 1
        largest = int(sizes.argmax())
        for k in np.flatnonzero(sizes >= least).tolist():
            s, e = int(edges[k]) + 1, int(edges[k + 1])
            if k == largest:  # here only neighbours of words outside can have become rare
                near = np.concatenate([after[lo:s], before[e:hi]])
                stack.append((s, e, near[(near >= s) & (near < e)]))
            else:
                stack.append((s, e, np.arange(s, e)))
    return sorted(out)


@lru_cache(256)
def _short_grid(m: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate(x) for x in zip(*_grid(m, least)))


def _grid(m: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and lags to compare in a segment of m words, in blocks of about PAIRS."""
    lag = 1
    while lag <= m // 2:
        step = max(lag, least - lag)
        at = np.arange(0, m - lag, step)
        ats, lags = [at], [np.full(len(at), lag)]
        size, lag = len(at), lag + 1
        while lag <= m // 2 and size < PAIRS:
            at = np.arange(0, m - lag, max(lag, least - lag))
            ats.append(at)
            lags.append(np.full(len(at), lag))
            size, lag = size + len(at), lag + 1
        yield np.concatenate(ats), np.concatenate(lags)


def _ranks(x: np.ndarray) -> list[np.ndarray]:
    """Per k, numbers of the stretches of 2**k words from every position; equal numbers, equal words."""
    out = [x]
    while 2 << (len(out) - 1) <= len(x):
        last, half = out[-1], 1 << (len(out) - 1)
        out.append(np.unique(last[:-half] * (int(last.max()) + 1) + last[half:], return_inverse=True)[1])
    return out


def _common(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray, way: int) -> np.ndarray:
    """How many words agree from positions a < b on (way 1), or up to and with them backwards (way -1)."""
    n, got = len(ranks[0]), np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        width = 1 << k
        i, j = (a + got, b + got) if way > 0 else (a - got - width + 1, b - got - width + 1)
        fits = np.flatnonzero(j + width <= n if way > 0 else i >= 0)
        got[fits[ranks[k][i[fits]] == ranks[k][j[fits]]]] += width
    return got


def lag_scan(x: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, stop, lag) of the runs of one segment; the lags of a run are its period and multiples of it."""
    m, ranks, out = len(x), None, [np.zeros((0, 3), np.int64)]
    for at, lag in [_short_grid(m, least)] if m <= 256 else _grid(m, least):
        hit = x[at] == x[at + lag]
        at, lag = at[hit], lag[hit]
        need = np.maximum(lag, least - lag)
        # Of four equal positions in a row around this one, two more follow or two stand before.
        end, begin = np.minimum(at + lag + 2, m - 1), np.maximum(at - 2, 0)
        ahead = (at + lag + 2 < m) & (x[at + 1] == x[end - 1]) & (x[end - lag] == x[end])
        back = (at >= 2) & (x[at - 1] == x[at + lag - 1]) & (x[begin] == x[begin + lag])
        kept = (need < 4) | ahead | back
        at, lag, need = at[kept], lag[kept], need[kept]
        if not len(at):
            continue
        ranks = ranks or _ranks(np.unique(x, return_inverse=True)[1])
        ahead, back = _common(ranks, at, at + lag, 1), _common(ranks, at - 1, at + lag - 1, -1)
        far = ahead + back >= need
        out.append(np.stack([(at - back)[far], (at + ahead + lag)[far], lag[far]], 1))
    return np.concatenate(out)


def runs_of(ids: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period."""
    found = [lag_scan(ids[s:e], least) + [s, s, 0] for s, e in segments(ids, least)]
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[first]
    rows[:, 1] -= rows[:, 0]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: those that no run holds behind its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges[:-1]) == 0


def _one(least: int):
    def run(text: str | None) -> dict:
        raw = (text or "").encode()
        ids = numbered(raw)
        runs = runs_of(ids, least)
        parts, at = [], 0
        kept = _kept(len(ids), runs) if len(runs) else None
        for words in windows(raw):
            chosen = words if kept is None else [words[i] for i in np.flatnonzero(kept[at:at + len(words)]).tolist()]
            at += len(words)
            if chosen:
                parts.append(b" ".join(chosen))
        return {"n_words": len(ids), "runs": [dict(zip(("start", "length", "period"), r)) for r in runs.tolist()], "collapsed": b" ".join(parts).decode()}

    return run


def find_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs and, as last column, a struct `_periodic` (with more underscores where docs has that name) of n_words, the runs by start and
    period, and the text without the words that a run repeats after its first period, joined by single blanks."""
    return annotated(docs, per_text(lambda: _one(least), STRUCT), "text", free_name("_periodic", docs))


def run_digest(found: DataFrame) -> DataFrame:
    """doc_id, number of runs, the longest (ties: smallest start, then period), digests of all runs and of the collapsed text; `found` as
    `find_runs` returns it."""
    name = found.columns[-1]
    runs = F.col(f"{name}.runs")
    line = F.transform(runs, lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    rows = found.select("doc_id", F.size(runs).cast("long").alias("n_runs"), best.alias("b"), F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
                        F.sha2(F.col(f"{name}.collapsed"), 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", (-F.col("b.s")).alias("start"), F.col("b.l").alias("length"), (-F.col("b.p")).alias("period"),
                       F.floor(1000 * F.col("b.l") / -F.col("b.p")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def repeated_from(doc_id: Column, text: Column) -> Column:
    """The text of the test rows: where h = crc32(doc_id) ends in 0, words from g mod n on repeat with a period given by g = h // 10 and
    the number of words. Other texts, those without words and rows without id stay."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def body(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        word = lambda i: F.element_at(words, (F.when(i < a, i).otherwise(a + F.pmod(i - a, p)) + 1).cast("int"))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), word), " ")).otherwise(text)

    split = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.when(h % 10 == 0, F.element_at(F.transform(F.array(split), body), 1)).otherwise(text)
