"""Phrase collocations by mergeable Misra-Gries summaries, then an exact count.

Texts are packed once into chunks. First pass: every chunk counts its n-grams of 1 to `longest` words by hashed key and sends every hash partition
one summary. The partition merges them: keys add up, and when more than its capacity are held, the largest count beyond the capacity is
taken from all. With a mass of m occurrences, a capacity of m // least loses less than `least` per key, so every n-gram of `least` occurrences or more
survives; its key goes on if what is held plus what was taken reaches `least`. Colliding keys only add survivors. The partition answers every
chunk with one bit per key. Second pass: chunks count the surviving n-grams exactly, as text, and Spark sums them.

A word or phrase that a third of all rows hold is one entry per chunk and partition. A partition holds as many entries as its share of
the mass divided by `least`, and the number of partitions follows the mass. There is a message per chunk and partition: at CHUNK_BYTES
and PARTITION_MASS some 60 KB each for 30 GB and 2 KB for 1 TB; beyond that both should grow with the executors' memory.

Scores, cuts and containment are DataFrame joins over the counted phrases, in whole decimal numbers of 38 digits.

Cases: null and empty texts have no words; a null language is `und`. Texts are cut between pieces, so a long text spreads over chunks; only
a piece without a separator is never cut. Ids are not read: repeated rows count as often as they stand. Other columns are not read.
Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import stored
from millrace.llm.exchange import narrow, pack, unpack
from millrace.llm.shingles import U, mix

LEAST = 10  # occurrences of a candidate
LONGEST = 3  # words of a candidate
CONTAINED = 50  # percent of a phrase's occurrences that a longer candidate must have to replace it
TOP = 2000  # phrases per language in the report
PARTS = 16  # of a language, ranked on their own first
CHUNK_BYTES = 6_000_000
PARTITION_MASS = 32_000_000  # occurrences of n-grams in a hash partition
PARTITIONS = 32  # at least
STRETCH = 100_000  # bytes of a chunk split into words at a time
_SEPARATORS = b".,;:!?\x0a\x0b\x0c\x0d"
_SEPARATOR, _GAP = re.compile(rb"[.,;:!?\x0a-\x0d]"), re.compile(rb"[\x20\x09.,;:!?\x0a-\x0d]")
_PLAIN = bytes.maketrans(_SEPARATORS + b"\t", b"\n" * len(_SEPARATORS) + b" ")
_FACTORS = [U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB)]
_CHUNK = pa.schema([("lang", pa.string()), ("text", pa.binary())])

# --- chunks of texts ---


def _cut(raw: bytes, size: int, separator: re.Pattern = _SEPARATOR) -> Iterator[bytes]:
    """Parts of a text of about `size` bytes that end at separators."""
    start = 0
    while start < len(raw):
        end = separator.search(raw, start + size - 1)
        stop = end.end() if end else len(raw)
        yield raw[start:stop]
        start = stop


def chunk_table(docs: DataFrame) -> DataFrame:
    """chunk, n_bytes, payload: texts by language, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, made = defaultdict(list), 0, 0
        task = TaskContext.get().partitionId()

        def chunk() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(held), pa.array([b"\n".join(t) for t in held.values()], pa.binary())], schema=_CHUNK)
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | made], pa.int64()), pa.array([size], pa.int64()),
                                               pa.array([zstandard.compress(rows.serialize().to_pybytes(), 3)], pa.binary())], names=["chunk", "n_bytes", "payload"])

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                for lang, text in zip(some.column(0).to_pylist(), some.column(1).cast(pa.binary()).to_pylist()):
                    for part in _cut(text or b"", CHUNK_BYTES):
                        held["und" if lang is None else lang].append(part)
                        size += len(part)
                        if size >= CHUNK_BYTES:
                            yield chunk()
                            held, size, made = defaultdict(list), 0, made + 1
        if held:
            yield chunk()

    return stored(docs.select("lang", "text").mapInArrow(run, "chunk long, n_bytes long, payload binary"), "chunks")


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in order, the place of every value among them, and how often each stands; numpy's own takes twice the memory."""
    order = np.argsort(values).astype(np.int32)  # chunks are far smaller
    values = values[order]
    first = np.concatenate([np.ones(min(1, len(values)), bool), values[1:] != values[:-1]])
    place = np.empty(len(values), np.int32)
    place[order] = np.cumsum(first, dtype=np.int32) - np.int32(1)
    starts = np.flatnonzero(first)
    return values[starts], place, np.diff(starts, append=len(values))


class Grams:
    """The distinct n-grams of one language in a chunk: word numbers (a column per word), counts and 64-bit hashes, by number of words."""

    def __init__(self, lang: str, text: bytes, longest: int):
        number = defaultdict()
        number.default_factory = number.__len__
        number[b""], number[b"\n"]  # 0 and 1: no word, end of a piece
        places = []  # the words as objects are many times the text, so few are held at once
        for part in _cut(text, STRETCH, _GAP):
            tokens = part.lower().translate(_PLAIN).replace(b"\n", b" \n ").split(b" ")
            some = np.fromiter(map(number.__getitem__, tokens), np.int32, len(tokens))
            places.append(some[some > 0])
        ids = np.concatenate(places) if places else np.zeros(0, np.int32)
        del places
        self.lang, self.words = lang, list(number)
        number.default_factory = None  # else the dictionary holds itself, and its words stay until Python looks for cycles
        del number
        seed = xxhash.xxh3_64_intdigest(lang.encode())
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.words), U, len(self.words))
        counts = np.bincount(ids, minlength=len(self.words))
        self.n_words = int(counts[2:].sum())
        have = (np.flatnonzero(counts[2:]) + 2).astype(np.int32)
        self.columns, self.counts, self.hashes = [have[:, None]], [counts[have]], []
        gram, fits = np.full(len(self.words), -1, np.int32), ids > 1  # number of the n-gram from every place, and whether it fits into its piece
        gram[have] = np.arange(len(have))
        gram = gram[ids]
        for k in range(1, longest):
            fits = fits[:-1] & (ids[k:] > 1)
            at = np.flatnonzero(fits)
            codes = gram[at].astype(np.int64)
            codes *= len(self.words)
            codes += ids[k:][at]
            codes, back, n = _distinct(codes)
            last = self.columns[-1]
            self.columns.append(np.column_stack([last[codes // len(self.words)], (codes % len(self.words)).astype(np.int32)]))
            self.counts.append(n)
            gram = np.full(len(fits), -1, np.int32)
            gram[at] = back
            del codes, back, at
        for k, words in enumerate(self.columns):
            mixed = np.full(len(words), k + 1, U)
            for j in range(k + 1):
                mixed += hashes[words[:, j]] * _FACTORS[j % 4] if j < 4 else mix(hashes[words[:, j]] + U(j))
            self.hashes.append(mix(mixed))

    def phrases(self, k: int, chosen: np.ndarray) -> pa.Array:
        words = pa.array(self.words, pa.binary())
        parts = [words.take(pa.array(column)) for column in self.columns[k][chosen].T]
        return pc.binary_join_element_wise(*parts, pa.scalar(b" ")).cast(pa.string())


def _grams(payload: bytes, longest: int) -> list[Grams]:
    rows = pa.ipc.read_record_batch(zstandard.decompress(payload), _CHUNK)
    return [Grams(lang.as_py(), text.as_py(), longest) for lang, text in zip(rows.column("lang"), rows.column("text"))]


def _keys(grams: list[Grams], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the place of every n-gram's key, and the occurrences of every n-gram."""
    all_keys = np.concatenate([np.zeros(0, U), *(h for g in grams for h in g.hashes)])
    for g in grams:
        g.hashes = []
    all_keys >>= U(64 - bits)
    keys, place, _ = _distinct(all_keys)
    del all_keys
    return keys, place, np.concatenate([np.zeros(0, np.int64), *(n for g in grams for n in g.counts)])


# --- summaries ---

class MisraGries:
    """A mergeable summary: what a key had is at most its count plus `taken`, and at least its count."""

    def __init__(self, capacity: int):
        self.capacity, self.taken = capacity, 0
        self.keys, self.counts = np.zeros(0, U), np.zeros(0, np.int64)

    def merge(self, keys: list[np.ndarray], counts: list[np.ndarray]) -> None:
        """Adds keyed counts, the entries of other summaries among them."""
        every = np.concatenate([self.keys, *keys])
        order = np.argsort(every, kind="stable")
        every, n = every[order], np.concatenate([self.counts, *counts])[order]
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
        self.keys, self.counts = every[first], np.add.reduceat(n, first) if len(first) else n
        if len(self.keys) > self.capacity:
            beyond = int(np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1])
            kept = self.counts > beyond
            self.keys, self.counts, self.taken = self.keys[kept], self.counts[kept] - beyond, self.taken + beyond

    def reaching(self, least: int) -> np.ndarray:
        """The keys that may have `least` occurrences."""
        return self.keys[self.counts + self.taken >= least]


def _summaries(chunks: DataFrame, longest: int, bits: int, parts: int) -> DataFrame:
    """part, chunk, mass, blob: every chunk's keys and counts for every hash partition."""
    low = bits - (parts.bit_length() - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                grams = _grams(batch.column(1)[i].as_py(), longest)
                for g in grams:  # only hashes and counts are sent
                    g.columns, g.words = [], []
                keys, place, n = _keys(grams, bits)
                del grams
                totals = np.bincount(place, n, len(keys)).astype(np.int64)
                del place, n
                edges = np.searchsorted(keys, np.arange(parts + 1, dtype=U) << U(low))
                spans = [(p, a, b) for p, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
                blobs = [pack(narrow(np.diff(keys[a:b], prepend=U(p) << U(low))), narrow(totals[a:b])) for p, a, b in spans]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in spans], pa.int64()), pa.array([batch.column(0)[i].as_py()] * len(spans), pa.int64()),
                                                  pa.array([int(totals[a:b].sum()) for _, a, b in spans], pa.int64()), pa.array(blobs, pa.binary())],
                                                 names=["part", "chunk", "mass", "blob"])

    return chunks.select("chunk", "payload").mapInArrow(run, "part long, chunk long, mass long, blob binary")


def _survivors(summaries: DataFrame, least: int, low: int) -> DataFrame:
    """chunk, part, bits: for every key of a chunk's summary whether it may have `least` occurrences."""

    def run(key, table):
        part, blobs = key[0].as_py(), table.column("blob")
        base = U(part) << U(low)
        mass = pc.sum(table.column("mass")).as_py()
        held, waiting, size = MisraGries(mass // least), [], 0
        for blob in blobs:
            steps, n = unpack(blob.as_py())
            waiting.append((base + np.cumsum(steps.astype(U)), n.astype(np.int64)))
            size += len(n)
            if size > max(held.capacity, 100_000):
                held.merge(*map(list, zip(*waiting)))
                waiting, size = [], 0
        held.merge(*(map(list, zip(*waiting)) if waiting else ([], [])))
        alive = held.reaching(least)
        answers = []
        for blob in blobs:
            keys = base + np.cumsum(unpack(blob.as_py())[0].astype(U))
            at = np.minimum(np.searchsorted(alive, keys), max(len(alive) - 1, 0))
            answers.append(zstandard.compress(np.packbits(alive[at] == keys if len(alive) else np.zeros(len(keys), bool)).tobytes(), 1))
        return pa.table([table.column("chunk"), pa.array([part] * len(answers), pa.int64()), pa.array(answers, pa.binary())], names=["chunk", "part", "bits"])

    return summaries.groupBy("part").applyInArrow(run, "chunk long, part long, bits binary")


def _counted(chunks: DataFrame, answers: DataFrame, longest: int, bits: int, parts: int) -> DataFrame:
    """lang, phrase, k, n: a chunk's occurrences of the surviving n-grams of k words; k = 0 has its number of words."""
    low = bits - (parts.bit_length() - 1)

    def run(left, right):
        grams = _grams(left.column("payload")[0].as_py(), longest)
        keys, place, _ = _keys(grams, bits)
        alive = np.zeros(len(keys), bool)
        edges = np.searchsorted(keys, np.arange(parts + 1, dtype=U) << U(low))
        for part, answer in zip(right.column("part").to_pylist(), right.column("bits").to_pylist()):
            a, b = edges[part], edges[part + 1]
            alive[a:b] = np.unpackbits(np.frombuffer(zstandard.decompress(answer), np.uint8), count=b - a).astype(bool)
        flags, out = alive[place], []
        starts = accumulate([len(n) for g in grams for n in g.counts], initial=0)
        for g in grams:
            out.append((pa.array([g.lang]), pa.array([""]), 0, np.array([g.n_words])))
            for k, n in enumerate(g.counts):
                at = next(starts)
                chosen = np.flatnonzero(flags[at:at + len(n)])
                if len(chosen):
                    out.append((pa.array([g.lang]).take(pa.array(np.zeros(len(chosen), np.int64))), g.phrases(k, chosen), k + 1, n[chosen]))
        columns = ("lang", "phrase", "k", "n")
        tables = [pa.table([a, p, pa.array(np.full(len(n), k, np.int32)), pa.array(n, pa.int64())], names=columns) for a, p, k, n in out]
        return pa.concat_tables(tables) if tables else pa.table([pa.array([], t) for t in (pa.string(), pa.string(), pa.int32(), pa.int64())], names=columns)

    return chunks.select("chunk", "payload").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, "lang string, phrase string, k int, n long")


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """lang, phrase (words joined by blanks), k, f: all phrases of 1 to `longest` words with `least` occurrences or more; the row of k = 0 and empty phrase has
    the words of the language."""
    chunks = chunk_table(docs)
    mass = (chunks.agg(F.sum("n_bytes")).first()[0] or 0) * longest // 6 + 1
    parts = PARTITIONS
    while parts * PARTITION_MASS < mass:
        parts *= 2
    bits = min(64, mass.bit_length() + 12)
    summaries = _summaries(chunks, longest, bits, parts)
    answers = _survivors(summaries, least, bits - (parts.bit_length() - 1))
    rows = _counted(chunks, answers, longest, bits, parts)
    counts = rows.groupBy("lang", "phrase", "k").agg(F.sum("n").alias("f")).where((F.col("f") >= least) | (F.col("k") == 0))
    return stored(counts, "phrases")


# --- scores ---

def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(10**6 a a / (l r)), exactly."""
    whole = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", whole(a) * whole(a) * F.lit(1_000_000).cast("decimal(7,0)"), whole(left) * whole(right))


def collocations(counts: DataFrame, contained: int = CONTAINED, top: int | None = TOP) -> DataFrame:
    """The first `top` phrases (None: all) of every language by score, occurrences, text: lang, rank, phrase, a, l, r, n, score. `counts` as frequent_phrases gives
    it. The weakest cut of a phrase counts (ties: the shortest left part); phrases inside a longer one with `contained` percent of their occurrences
    are left out."""
    words = F.split("phrase", " ", -1)
    part = lambda start, n: F.array_join(F.slice(words, start, n), " ")
    whole = counts.where("k >= 2").select("lang", "phrase", "k", F.col("f").alias("a"))
    cuts = F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda j: F.struct(j.alias("cut"), part(F.lit(1), j).alias("left"), part(j + 1, F.col("k") - j).alias("right")))
    cut = whole.select("lang", "phrase", "k", "a", F.inline(cuts))
    for side, f in (("left", "l"), ("right", "r")):
        cut = cut.join(counts.where("k >= 1").select("lang", F.col("phrase").alias(side), F.col("f").alias(f)), ["lang", side])
    weakest = F.min(F.struct(_score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "cut", "l", "r")).alias("w")
    scored = cut.groupBy("lang", "phrase", "k", "a").agg(weakest).select("lang", "phrase", "a", "w.l", "w.r", "w.score")
    # Shorter phrases inside longer ones: every stretch of two words or more.
    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda s: part(s, n))))
    longer = whole.where("k >= 3").select("lang", "a", F.explode(inside).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    rows = scored.join(longer, ["lang", "phrase"], "left").where(F.col("_longer").isNull() | (100 * F.col("_longer") < contained * F.col("a")))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    if top is not None:  # first within parts of a language, so that the last step sees PARTS * top rows of it at most
        part_of = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
        rows = rows.withColumn("_i", F.row_number().over(Window.partitionBy("lang", part_of).orderBy(*order))).where(F.col("_i") <= top)
    ranked = rows.select("lang", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long").alias("rank"), "phrase", "a", "l", "r", "score")
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.join(counts.where("k = 0").select("lang", F.col("f").alias("n")), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
