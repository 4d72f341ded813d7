"""Secret scan: fixed patterns, and tokens that a character Markov model of random strings explains better than one of
ordinary identifiers.

Both models are first-order Markov chains over 69 character classes. Their labelled samples come from all documents: the
characters inside base matches are random strings, every other adjacent pair of token characters is ordinary text. A token of 20 or more
characters is a secret when its log-likelihood ratio is high in total and per character. Where base matches cover some of a token, each part
outside them is judged by its own ratio per character; an access or hex match beside it, which may be a run within a longer secret, lends its length and total,
and the span holds both.

Cases: null and empty texts have no spans; without any base match there is no sample of random strings and only base
spans are found; repeated rows give repeated results; spans count code points. Time follows the length of a text, however many spans it holds.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import annotated, per_text

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
N = len(ALPHABET) + 2  # one class for other ASCII, one for the rest
CLASS = np.full(256, N - 1, np.int64)
CLASS[:128] = N - 2
CLASS[np.frombuffer(ALPHABET, np.uint8)] = np.arange(len(ALPHABET))
IS_HEX = bytes(49 if c in b"0123456789abcdef" else 48 for c in range(256))
IS_TOKEN = bytes(49 if c in ALPHABET else 48 for c in range(256))
TOKEN_CHARS, LEAST_TOTAL, LEAST_MEAN = 20, 12.0, 0.5
FIELDS = "spans array<struct<kind: string, start: int, stop: int>>"
MARK = "[secret]"


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind number, stop) of the fixed patterns. Cheap byte searches tell which patterns can match at all."""
    out = []
    low = raw.lower()
    if any(n in low for n in NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if b"1" * 16 in raw.translate(IS_HEX):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 16]
    return sorted(out)


def _points(text: str, raw: bytes) -> np.ndarray | None:
    """The byte at which every code point begins, and the end; None where both count alike."""
    if len(text) == len(raw):
        return None
    return np.append(np.flatnonzero(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80), len(raw))


def _byte_spans(points: np.ndarray | None, spans) -> list[tuple[int, int]]:
    if points is None:
        return [(a, b) for a, _, b in spans]
    return [(int(points[a]), int(points[b])) for a, _, b in spans]


class Known:
    """Base spans in bytes. Those of one kind don't overlap, so the ones that touch a token are found by two searches per kind."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.kinds = {kind: ([x for x, _, k in spans if k == kind], [y for _, y, k in spans if k == kind]) for kind in {k for _, _, k in spans}}

    def within(self, a: int, b: int) -> list[tuple[int, int, int]]:
        """(start, stop, kind) of the spans that touch [a, b), by start."""
        found = [(starts[i], stops[i], kind) for kind, (starts, stops) in self.kinds.items() for i in range(bisect_right(stops, a), bisect_left(starts, b))]
        return sorted(found)


def _random_stretches(raw: bytes, a: int, b: int, known: Known, ratio: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans of the parts of token raw[a:b] outside the base spans that look random, each with the access and hex matches beside it."""
    covered: list[list[int]] = []  # unions of base spans: start, stop, whether an assignment is among them
    for x, y, kind in known.within(a, b):
        x, y = max(a, x), min(b, y)
        if covered and x <= covered[-1][1]:
            covered[-1][1:] = max(covered[-1][1], y), covered[-1][2] or kind == 0
        else:
            covered.append([x, y, kind == 0])
    out: list[tuple[int, int]] = []
    for left, right in zip([[a, a, True], *covered], [*covered, [b, b, True]]):
        x, y = left[1], right[0]
        start, stop = x if left[2] else left[0], y if right[2] else right[1]
        if x == y or stop - start < TOKEN_CHARS:
            continue
        c = CLASS[np.frombuffer(raw[start:stop], np.uint8)]
        each = ratio[c[:-1], c[1:]]
        own = each[max(0, x - start - 1):y - start]
        if float(each.sum()) >= LEAST_TOTAL and float(own.sum()) >= LEAST_MEAN * len(own):
            if out and start < out[-1][1]:
                start = out.pop()[0]
            out.append((start, stop))
    return out


def transition_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(random, pair, n): adjacent character classes inside base matches and outside, over all documents. Each batch
    is one dense table, so a hot source or text only adds to the same few thousand counters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, N * N), np.int64)
        for batch in batches:
            for value in batch.column(0):
                t = value.as_py()
                if not t:
                    continue
                raw = t.encode("utf-8", "surrogatepass")
                c = CLASS[np.frombuffer(raw, np.uint8)]
                pairs = c[:-1] * N + c[1:]
                seen = np.bincount(pairs, minlength=N * N)
                for a, b in _byte_spans(_points(t, raw), base_spans(t, raw)):
                    inside = np.bincount(pairs[a:max(a, b - 1)], minlength=N * N)
                    total[1] += inside
                    seen -= np.minimum(inside, seen)
                total[0] += seen
        kind, pair = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kind == 1), pa.array(pair, pa.int32()), pa.array(total[kind, pair])],
                                         names=["random", "pair", "n"])

    rows = docs.select(text).mapInArrow(count, "random boolean, pair int, n long")
    return rows.groupBy("random", "pair").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text: str = "text") -> np.ndarray | None:
    """Log-likelihood ratio of each class pair, or None without a sample of random strings. At most 2 * 69 * 69 rows reach
    the driver. A fifth of the random model's mass is the uniform string over the alphabet, for pairs not yet seen."""
    counts = np.zeros((2, N, N))
    for r in transition_counts(docs, text).collect():
        counts[int(r.random), r.pair // N, r.pair % N] = r.n
    if not counts[1].sum():
        return None
    random = (counts[1] + 0.05) / (counts[1] + 0.05).sum(axis=1, keepdims=True)
    ordinary = (counts[0] + 0.5) / (counts[0] + 0.5).sum(axis=1, keepdims=True)
    return np.log(0.8 * random + 0.2 / len(ALPHABET)) - np.log(ordinary)


def find_secrets(docs: DataFrame, ratio: np.ndarray | None, name: str = "_secrets", text: str = "text", mark: str | None = None) -> DataFrame:
    """docs with a struct `name` of all spans by start, then kind; with a mark also the text `redacted` with it (null stays
    null), so that a task needs no second Python worker."""

    def scan():
        def one(t):
            if not t:
                return {"spans": [], "redacted": t}
            raw = t.encode("utf-8", "surrogatepass")
            spans = base_spans(t, raw)
            if ratio is not None and b"1" * TOKEN_CHARS in (marks := raw.translate(IS_TOKEN)):
                points = _points(t, raw)
                known = Known([(x, y, kind) for (x, y), (_, kind, _) in zip(_byte_spans(points, spans), spans)])
                for m in re.finditer(rb"1+", marks):
                    if m.end() - m.start() < TOKEN_CHARS:
                        continue
                    for a, b in _random_stretches(raw, *m.span(), known, ratio):
                        start = a if points is None else int(np.searchsorted(points, a))
                        spans.append((start, 3, start + b - a))
                spans.sort()
            found = {"spans": [{"kind": KINDS[k], "start": a, "stop": b} for a, k, b in spans]}
            return found if mark is None else found | {"redacted": marked(t, [(a, b) for a, _, b in spans], mark)}
        return one

    return annotated(docs, per_text(scan, FIELDS if mark is None else f"{FIELDS}, redacted string"), text, name)


def marked(t: str, spans: list[tuple[int, int]], mark: str) -> str:
    """The text with every union of overlapping spans replaced by the mark. One pass over text and spans."""
    parts, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            parts += [t[at:a], mark]
        at = max(at, b)
    return "".join(parts) + t[at:]


def redacted(text, spans, mark: str = MARK):
    """The text with its spans replaced by the mark, as a Column; null stays null."""
    @F.arrow_udf("string")
    def replaced(texts: pa.Array, all_spans: pa.Array) -> pa.Array:
        out = []
        for i in range(len(texts)):
            t, own = texts[i].as_py(), all_spans[i].as_py()
            out.append(marked(t, [(s["start"], s["stop"]) for s in own], mark) if t and own else t)
        return pa.array(out, pa.string())

    return replaced(text, spans)


def secret_digest(found: DataFrame, name: str = "_secrets") -> DataFrame:
    spans = F.col(f"{name}.spans")

    def joined(kept):
        return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    def n(kind):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter(spans, lambda s: s["kind"] != "markov")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))
