"""Removal of repeated 50-byte strings by sorting suffixes.

Every 50-byte window is tied to one suffix that starts inside it: of the 26 places where 25 bytes still fit into the window, the one whose 25 bytes hash lowest
(the first of equals). Equal windows choose the same place, so only these suffixes, about one in fourteen, are sorted, each with the bytes before it that its windows
reach. First all chunks exchange short hashes of the 25 bytes; suffixes whose hash occurs in one document only can't repeat and go no further. The
others are range-partitioned by their leading bytes: splitters come from a sample, equal beginnings never part, so no match crosses a boundary.

A bucket sorts its suffixes, and their left contexts read backwards, by multikey quicksort on 8-byte characters and compares neighbours.
Windows are equal if they lie equally far before suffixes that agree to the right and to the left; both follow from the common prefixes of neighbours. The smallest
document of each class comes out, and a byte goes if a window over it occurs in a smaller document.

A chunk sends equal suffix records once, for its smallest document; so a string that a third of all rows hold is one record per chunk.

Cases: null texts count as empty; texts under 50 bytes keep all; equal ids don't remove each other; a row without id keeps its text and removes
nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import exchange as X
from millrace.llm.common import stored
from millrace.llm.shingles import U, mix

LENGTH, GRAM = 50, 25
PLACES = LENGTH - GRAM + 1  # where a suffix may start in a window
BLOCK = 1_000_000  # bytes hashed at a time
BITS_SPARE = 10  # of the short hashes, beyond the logarithm of the input: one in a thousand meets another by chance
SAMPLE = 50_000  # suffixes that the splitters are drawn from
LEAD = 24  # bytes that decide the bucket
SECOND = 1 << 40
OUTPUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start: long, stop: long>>"
_LEFT = mix(np.arange(1, GRAM + 1, dtype=U)) | U(1)
_RIGHT = mix(np.arange(101, LENGTH + 101, dtype=U)) | U(1)


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from every place, built from hashes of 1, 2, 4, 8 and 16 bytes."""
    base = 0x9E3779B97F4A7C15
    power = {n: U(pow(base, n, 1 << 64)) for n in (1, 2, 4, 8)}
    h = {1: mix(b.astype(U) + U(1))}
    for n in (1, 2, 4, 8):
        h[2 * n] = h[n][:-n] * power[n] + h[n][n:]
    size = len(b) - GRAM + 1
    return mix((h[16][:size] * power[8] + h[8][16:16 + size]) * power[1] + h[1][24:24 + size])


class Suffixes:
    """The chosen suffixes of a chunk: start `at`, document, windows from `lo` to `hi` (positions in `data`), hash."""

    def __init__(self, chunk: X.Chunk):
        lengths = np.array([len(t) for t in chunk.texts], np.int64)
        self.start = np.cumsum(lengths) - lengths
        self.data = np.frombuffer(b"\0" * LENGTH + b"".join(chunk.texts) + b"\0" * LENGTH, np.uint8)  # padded for the gathers
        self.lengths, parts, i = lengths, [], 0
        while i < len(lengths):
            j, size = i, 0
            while j < len(lengths) and (size == 0 or size + lengths[j] <= BLOCK):
                size += lengths[j]
                j += 1
            parts.append(self._chosen(i, j))
            i = j
        self.at, self.doc, self.lo, self.hi, self.hash = (np.concatenate(x) if parts else np.zeros(0, np.int64) for x in zip(*parts)) if parts else [np.zeros(0, np.int64)] * 4 + [np.zeros(0, U)]
        fit = ~chunk.null_id[self.doc]
        self.at, self.doc, self.lo, self.hi, self.hash = self.at[fit], self.doc[fit], self.lo[fit], self.hi[fit], self.hash[fit]
        self.id = chunk.ids[self.doc]

    def _chosen(self, i: int, j: int):
        first, n = self.start[i] + LENGTH, int(self.lengths[i:j].sum())
        b = self.data[first:first + n]
        empty = np.zeros(0, np.int64)
        if n < LENGTH:
            return empty, empty, empty, empty, np.zeros(0, U)
        h = _gram_hashes(b)
        place_bits = U(max(20, n.bit_length()))
        low = (h >> place_bits) << place_bits | np.arange(len(h), dtype=U)
        for step in (1, 2, 4, 8, PLACES - 16):
            low = np.minimum(low[:-step], low[step:])
        at = (low & ((U(1) << place_bits) - U(1))).astype(np.int64)  # one per window start
        ends = np.cumsum(self.lengths[i:j])
        inside = np.zeros(len(at) + 1, np.int32)
        np.add.at(inside, np.minimum(ends - self.lengths[i:j], len(at)), 1)
        np.add.at(inside, np.minimum(np.maximum(ends - LENGTH + 1, ends - self.lengths[i:j]), len(at)), -1)
        valid = np.cumsum(inside[:-1]) > 0
        new = valid & np.concatenate([[True], (at[1:] != at[:-1]) | ~valid[:-1]])
        last = valid & np.concatenate([(at[1:] != at[:-1]) | ~valid[1:], [True]])
        lo, hi = np.flatnonzero(new), np.flatnonzero(last)
        doc = np.searchsorted(ends, lo, side="right") + i
        return at[lo] + first, doc, lo + first, hi + first, h[at[lo]]

    def leads(self, rows: np.ndarray) -> np.ndarray:
        view = np.lib.stride_tricks.sliding_window_view(self.data, LEAD)
        return np.ascontiguousarray(view[self.at[rows]]).view(f"S{LEAD}").reshape(-1)


def _short(h: np.ndarray, width: int) -> np.ndarray:
    return h >> U(64 - width)


def _edges(keys: np.ndarray, width: int, bits: int):
    edges = np.searchsorted(keys >> U(width - bits), np.arange((1 << bits) + 1, dtype=U))
    return [(b, int(edges[b]), int(edges[b + 1])) for b in range(1 << bits) if edges[b] < edges[b + 1]]


def hash_requests(width: int, bits: int, one_in: int):
    """Distinct short hashes; and, to bucket -1, the leading bytes of one in `one_in` suffixes."""

    def ask(chunk: X.Chunk):
        s = Suffixes(chunk)
        keys = np.unique(_short(s.hash, width))
        for b, i, j in _edges(keys, width, bits):
            yield b, X.pack(X.narrow(np.diff(keys[i:j], prepend=keys[i])), keys[i:i + 1])
        drawn = np.flatnonzero(mix(s.hash) % U(one_in) == 0)
        yield -1, X.pack(s.leads(drawn).view(np.uint8) if len(drawn) else np.zeros(0, np.uint8))
    return ask


def count_hashes(bucket: int, chunks: list[int], blobs: list[bytes]):
    if bucket == -1:
        yield -1, X.pack(np.concatenate([X.unpack(b)[0] for b in blobs]))
        return
    got = [np.cumsum(d.astype(U)) + first[0] for d, first in map(X.unpack, blobs)]
    ends = np.cumsum([len(g) for g in got])
    _, at, n = np.unique(np.concatenate(got), return_inverse=True, return_counts=True)
    for k, chunk in enumerate(chunks):
        yield chunk, np.packbits(n[at[ends[k] - len(got[k]):ends[k]]] > 1).tobytes()


class Records:
    """The distinct suffix records of a chunk that may repeat elsewhere, in the order of the second request."""

    def __init__(self, chunk: X.Chunk, replies: dict[int, bytes], width: int, bits: int, splitters: np.ndarray):
        s = self.s = Suffixes(chunk)
        keys, at = np.unique(_short(s.hash, width), return_inverse=True)
        often = np.zeros(len(keys), bool)
        for b, i, j in _edges(keys, width, bits):
            often[i:j] = np.unpackbits(np.frombuffer(replies[b], np.uint8), count=j - i).astype(bool)
        least, most = np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), np.iinfo(np.int64).min)
        np.minimum.at(least, at, s.id)
        np.maximum.at(most, at, s.id)
        self.rows = rows = np.flatnonzero((often | (least < most))[at])  # suffixes that take part
        view = np.lib.stride_tricks.sliding_window_view(s.data, LENGTH + GRAM)
        text = view[s.at[rows] - GRAM] if len(rows) else np.zeros((0, LENGTH + GRAM), np.uint8)
        self.n_left, self.n_right = s.at[rows] - s.lo[rows], s.hi[rows] + LENGTH - s.at[rows]
        left = np.where(np.arange(GRAM) < self.n_left[:, None], text[:, :GRAM][:, ::-1], 0).astype(np.uint8)
        right = np.where(np.arange(LENGTH) < self.n_right[:, None], text[:, GRAM:], 0).astype(np.uint8)
        digest = (self.n_left * 64 + self.n_right).astype(U)
        for j in range(GRAM):
            digest = digest + (left[:, j].astype(U) + U(1)) * _LEFT[j]
        for j in range(LENGTH):
            digest = digest + (right[:, j].astype(U) + U(1)) * _RIGHT[j]
        _, first, self.record = np.unique(mix(digest), return_index=True, return_inverse=True)
        self.least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.record, s.id[rows])
        bucket = np.searchsorted(splitters, s.leads(rows[first]), side="right") if len(first) else np.zeros(0, np.int64)
        self.order = np.argsort(bucket, kind="stable")
        self.bucket, self.first, self.left, self.right = bucket, first, left, right


def suffix_requests(width: int, bits: int, splitters: np.ndarray):
    def ask(number: int, chunk: X.Chunk, replies: dict[int, bytes]) -> pa.Table:
        r = Records(chunk, replies, width, bits, splitters)
        rows, sorted_buckets = [], r.bucket[r.order]
        cuts = np.flatnonzero(np.concatenate([[True], sorted_buckets[1:] != sorted_buckets[:-1]])) if len(sorted_buckets) else []
        for i, j in zip(cuts, [*cuts[1:], len(sorted_buckets)]):
            mine = r.order[i:j]
            f = r.first[mine]
            n_left, n_right = r.n_left[f], r.n_right[f]
            left = r.left[f][np.arange(GRAM) < n_left[:, None]]
            right = r.right[f][np.arange(LENGTH) < n_right[:, None]]
            rows.append((int(sorted_buckets[i]), number, X.pack(n_left.astype(np.uint8), n_right.astype(np.uint8), r.least[mine], left, right)))
        return X._batch(rows, X._schema(X.REQUEST))
    return ask


def multikey_order(characters: np.ndarray) -> np.ndarray:
    """Order of rows of 8-byte characters: each pass sorts the runs that are still equal by their next character."""
    order = np.arange(len(characters))
    group = np.zeros(len(order), np.int64)
    open_ = np.arange(len(order))  # positions in the order whose run is longer than one
    for c in range(characters.shape[1]):
        if not len(open_):
            break
        key, g = characters[order[open_], c], group[open_]
        s = np.lexsort((key, g))
        order[open_] = order[open_][s]
        key = key[s]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (key[1:] != key[:-1])])
        group[open_] = open_[np.flatnonzero(new)][np.cumsum(new) - 1]
        run = np.diff(np.append(np.flatnonzero(new), len(open_)))
        open_ = open_[np.repeat(run > 1, run)]
    return order


def _classes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte rows, and the length of the common prefix of each with the one before."""
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    order = multikey_order(padded.view(">u8").astype(U))
    s = rows[order]
    differ = s[1:] != s[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, np.concatenate([[0], common])


def compare_suffixes(bucket: int, chunks: list[int], blobs: list[bytes]):
    """For every record, a bit for each distance of a window before its suffix: whether a smaller document holds that window."""
    got = [X.unpack(b) for b in blobs]
    n_left, n_right, least = (np.concatenate([g[i] for g in got]) for i in range(3))
    n = len(least)
    left, right = np.zeros((n, GRAM), np.uint8), np.zeros((n, LENGTH), np.uint8)
    left[np.arange(GRAM) < n_left[:, None]] = np.concatenate([g[3] for g in got])
    right[np.arange(LENGTH) < n_right[:, None]] = np.concatenate([g[4] for g in got])
    by_right, common_right = _classes(right)
    by_left, common_left = _classes(left)
    bits = np.zeros((n, 32), bool)
    a, b = np.empty(n, np.int64), np.empty(n, np.int64)
    for back in range(PLACES):
        mine = np.flatnonzero((n_left >= back) & (n_right >= LENGTH - back))
        if not len(mine):
            continue
        a[by_right] = np.cumsum(common_right < LENGTH - back)
        b[by_left] = np.cumsum(common_left < back)
        key = a[mine] * (n + 1) + b[mine]
        s = np.argsort(key, kind="stable")
        new = np.flatnonzero(np.concatenate([[True], key[s][1:] != key[s][:-1]]))
        smallest = np.minimum.reduceat(least[mine[s]], new)
        bits[mine[s], back] = np.repeat(smallest, np.diff(np.append(new, len(mine)))) < least[mine[s]]
    ends = np.cumsum([len(g[0]) for g in got])
    packed = np.packbits(bits, axis=1)
    for k, chunk in enumerate(chunks):
        part = packed[ends[k] - len(got[k][0]):ends[k]]
        yield chunk, X.pack(*np.ascontiguousarray(part.T))


def kept(width: int, bits: int, splitters: np.ndarray):
    """The documents of a chunk with what is removed from them."""

    def go_on(number: int, chunk: X.Chunk, replies: dict[int, bytes]) -> pa.Table:
        r = Records(chunk, {b: x for b, x in replies.items() if b < SECOND}, width, bits, splitters)
        s, rows = r.s, r.rows
        gone = np.zeros(len(s.data) + 1, bool)
        if len(rows):
            answer = np.empty((len(r.order), 32), bool)
            got = [np.stack(X.unpack(replies[b]), axis=1) for b in sorted(replies) if b >= SECOND]
            answer[r.order] = np.unpackbits(np.concatenate(got), axis=1).astype(bool)
            again = s.id[rows] > r.least[r.record]
            for back in range(PLACES):
                fits = (r.n_left >= back) & (r.n_right >= LENGTH - back) & (again | answer[r.record, back])
                gone[s.at[rows[fits]] - back] = True
        windows = np.cumsum(gone, dtype=np.int32)
        covered = windows.copy()
        covered[LENGTH:] -= windows[:-LENGTH]
        covered = covered > 0
        out = []
        for start, text, null in zip((s.start + LENGTH).tolist(), chunk.texts, chunk.null_id.tolist()):
            c = covered[start:start + len(text)]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], c.view(np.int8), [0]]))) if c.any() else np.zeros(0, np.int64)
            spans = edges.reshape(-1, 2).tolist()
            left, at = [], 0
            for a, b in spans:
                left.append(text[at:a])
                at = b
            left.append(text[at:])
            out.append((len(text), sum(b - a for a, b in spans), len(spans), hashlib.sha256(b"".join(left)).hexdigest(), [{"start": a, "stop": b} for a, b in spans]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
        columns = [pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)]
        return pa.table([chunk.id_column(), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])
    return go_on


def remove_repeats(docs: DataFrame) -> DataFrame:
    """OUTPUT for every row of (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(False).alias("flag"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    chunks, size = X.chunk_table(rows, "suffix_chunks")
    bits = X.bucket_count(2 * size).bit_length() - 1
    width = min(63, max(1, size).bit_length() + BITS_SPARE)
    first = stored(X.answered(X.first_requests(chunks, hash_requests(width, bits, max(1, size // 14 // SAMPLE))), count_hashes), "suffix-hashes")
    drawn = [X.unpack(bytes(r.blob))[0] for r in first.where("chunk = -1").select("blob").collect()]
    sample = np.sort(np.concatenate(drawn).view(f"S{LEAD}")) if drawn and len(drawn[0]) else np.zeros(0, f"S{LEAD}")
    splitters = np.unique(sample[np.linspace(0, len(sample) - 1, (1 << bits) + 1).astype(np.int64)[1:-1]]) if len(sample) else sample
    known = first.where("chunk >= 0")
    asked = X.with_replies(chunks, known, suffix_requests(width, bits, splitters), X.REQUEST)
    second = X.answered(asked, compare_suffixes)
    replies = known.unionByName(second.withColumn("bucket", F.col("bucket") + SECOND))
    return X.with_replies(chunks, replies, kept(width, bits, splitters), OUTPUT)
