"""Katz backoff language model of word pairs over a corpus.

P(w | v) = d(r) r / c(v) for a pair seen r times, alpha(v) P(w) for any other. d are Good-Turing discounts (counts over 5 stay as they are), alpha(v) is the
mass that discounting frees after v, divided by the single-word mass of the words not seen after v, so every context sums to one. The single-word level is
discounted likewise; what it frees is the probability of an unknown word, at which the recursion ends. Where nothing is
freed, one more occurrence is set aside for the rest.

Counts live in tables partitioned by key bucket. First round: word counts. Second round: pair counts, and for each context how many of its
pairs were seen once, twice, ... and the single-word mass of its seen words; alpha(v) is linear in these, so the discounts may come from
the whole corpus afterwards. Contexts of very many occurrences are split over several keys and their sums added up where they are used.

Cases: a null text counts as empty, its only token is the end; with no training document every word is unknown and of probability one;
repeated rows count as often as they occur; tokens that fall together in 64 hash bits count as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import exchange as X
from millrace.llm.common import stored
from millrace.llm.shingles import U, mix, run_hashes

DISCOUNTED = 5  # counts up to here are discounted
HOT = 2_000_000  # occurrences of a context per key
PIECE = 1_000_000  # bytes of text hashed at a time
START, END = U(0x243F6A8885A308D3), U(0x13198A2E03707344)
IN_WORD = np.ones(256, bool)
IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
SECOND = 1 << 40  # added to the bucket numbers of the second round's replies
OUTPUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def discounts(n: np.ndarray) -> np.ndarray:
    """d(1..k) from the counts of counts n(1..k+1): Good-Turing, or one subtracted share where those don't lie in (0, 1]."""
    k, n = DISCOUNTED, n.astype(float)
    if not n[0]:
        return np.ones(k)
    r = np.arange(1, k + 1)
    rest = (k + 1) * n[k] / n[0]
    if n[:k].all() and rest < 1:
        d = ((r + 1) * n[1:k + 1] / n[:k] / r - rest) / (1 - rest)
        if (d > 0).all() and (d <= 1).all():
            return d
    return 1 - min(0.9, n[0] / (n[0] + 2 * n[1])) / r


class Level:
    """Discounted probabilities r / total, and the mass they leave."""

    def __init__(self, n: np.ndarray):
        self.d = np.concatenate([[0.0], discounts(n)])

    def freed(self, by_count: list[np.ndarray], total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(mass left over, factor on the seen probabilities) from the numbers of entries seen 1..k times."""
        total = np.maximum(total, 1)
        left = sum((1 - self.d[r]) * r * by_count[r - 1] for r in range(1, DISCOUNTED + 1)) / total
        none = left <= 1e-12
        return np.where(none, 1 / (total + 1), left), np.where(none, total / (total + 1), 1.0)

    def seen(self, r: np.ndarray, total) -> np.ndarray:
        return np.where(r <= DISCOUNTED, self.d[np.minimum(r, DISCOUNTED)], 1.0) * r / np.maximum(total, 1)


class Words(Level):
    """The single-word level."""

    def __init__(self, stats: np.ndarray):
        self.total, self.distinct, n = int(stats[0]), int(stats[1]), stats[2:]
        super().__init__(n)
        left, self.factor = self.freed(list(n[:DISCOUNTED]), np.array(self.total))
        self.unknown = float(left) if self.total else 1.0

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.seen(c, self.total) * self.factor, self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.total + 0.5 * (self.distinct + 1)))


def _pieces(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about a megabyte: hashing takes some fifty bytes for each byte of text at a time."""
    i, size = 0, 0
    for j, t in enumerate(texts):
        if size and size + len(t) > PIECE:
            yield i, j
            i, size = j, 0
        size += len(t)
    if i < len(texts):
        yield i, len(texts)


def tokens(chunk: X.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(document number, hash) of all tokens in order, each document closed by its end."""
    owners, outs = [np.zeros(0, np.int64)], [np.zeros(0, U)]
    for i, j in _pieces(chunk.texts):
        owner, h = run_hashes([t.lower() for t in chunk.texts[i:j]], IN_WORD, b" ")
        n = np.bincount(owner, minlength=j - i)
        out = np.empty(len(h) + len(n), U)
        out[np.arange(len(h)) + owner] = h
        out[np.cumsum(n + 1) - 1] = END
        owners.append(np.repeat(np.arange(i, j), n + 1))
        outs.append(out)
    return np.concatenate(owners), np.concatenate(outs)


def _deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=U(0))


def _buckets(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of the sorted keys, by their leading bits."""
    edges = np.searchsorted(keys >> U(64 - bits), np.arange((1 << bits) + 1, dtype=U))
    for b in range(1 << bits):
        if edges[b] < edges[b + 1]:
            yield b, int(edges[b]), int(edges[b + 1])


def _of_counts(total: np.ndarray) -> list[int]:
    return [int((total == r).sum()) for r in range(1, DISCOUNTED + 2)]


def word_requests(bits: int):
    def ask(chunk: X.Chunk):
        owner, tok = tokens(chunk)
        words, at = np.unique(tok, return_inverse=True)
        counts = np.bincount(at[~chunk.flag[owner]], minlength=len(words))
        for b, i, j in _buckets(words, bits):
            yield b, X.pack(_deltas(words[i:j]), X.narrow(counts[i:j]))
    return ask


def count_words(bucket: int, chunks: list[int], blobs: list[bytes]):
    got = [X.unpack(b) for b in blobs]
    sizes = np.cumsum([0] + [len(g[0]) for g in got])
    _, at = np.unique(np.concatenate([np.cumsum(g[0]) for g in got]), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate([g[1] for g in got])).astype(np.int64)
    for k, chunk in enumerate(chunks):
        yield chunk, X.pack(X.narrow(total[at[sizes[k]:sizes[k + 1]]]))
    yield -1, X.pack(np.array([total.sum(), (total > 0).sum(), *_of_counts(total)], np.int64))


class Pairs:
    """What a chunk asks in the second round, in the order of its request; built again to read the reply."""

    def __init__(self, chunk: X.Chunk, replies: dict[int, bytes]):
        self.owner, tok = tokens(chunk)
        self.words, at = np.unique(tok, return_inverse=True)
        self.c = np.concatenate([X.unpack(replies[b])[0] for b in sorted(replies) if b < SECOND]).astype(np.int64)
        first = np.concatenate([[True], self.owner[1:] != self.owner[:-1]])
        # The context of a document's first token is the start, seen once per training document, as often as the end.
        before = np.concatenate([[0], at[:-1]])
        before[first] = len(self.words)
        self.c_tok = self.c[at]
        occurs = np.concatenate([self.c, self.c[self.words == END]])
        self.c_before = occurs[before]
        self.asked = (self.c_before > 0) & (self.c_tok > 0)
        pair, self.at = np.unique(before[self.asked] * (len(self.words) + 1) + at[self.asked], return_inverse=True)
        v, w = pair // (len(self.words) + 1), pair % (len(self.words) + 1)
        self.counts = np.bincount(self.at[~chunk.flag[self.owner[self.asked]]], minlength=len(pair))
        # Contexts that occur here, each with one key per HOT occurrences.
        names = np.concatenate([self.words, [START]])
        context = np.unique(before[self.c_before > 0])
        parts = 1 + occurs[context] // HOT
        start = np.cumsum(parts) - parts
        whose = np.repeat(np.arange(len(context)), parts)
        salt = np.arange(len(whose)) - start[whose]
        keys = mix(names[context[whose]] + salt.astype(U) * U(0x9E3779B97F4A7C15) + U(1))
        order = np.argsort(keys)
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.arange(len(keys))
        self.keys, self.key_context = keys[order], whose[order]
        place = np.searchsorted(context, v)
        row = rank[start[place] + (mix(self.words[w]) % parts[place].astype(U)).astype(np.int64)]
        self.order = np.lexsort((self.words[w], row))
        self.row, self.w = row[self.order], w[self.order]
        self.context, self.before, self.occurs = context, before, occurs


def pair_requests(bits: int):
    def ask(number: int, chunk: X.Chunk, replies: dict[int, bytes]) -> pa.Table:
        p = Pairs(chunk, replies)
        runs = np.bincount(p.row, minlength=len(p.keys))
        ends = np.concatenate([[0], np.cumsum(runs)])
        w, counts, c = p.words[p.w], p.counts[p.order], p.c[p.w]
        rows = []
        for b, i, j in _buckets(p.keys, bits):
            a, z = ends[i], ends[j]
            rows.append((b, number, X.pack(_deltas(p.keys[i:j]), X.narrow(runs[i:j]), (w[a:z] >> U(32)).astype(np.uint32), w[a:z].astype(np.uint32),
                                           X.narrow(counts[a:z]), X.narrow(c[a:z]))))
        return X._batch(rows, X._schema(X.REQUEST))
    return ask


def count_pairs(level: Words):
    def combine(bucket: int, chunks: list[int], blobs: list[bytes]):
        got = [X.unpack(b) for b in blobs]
        keys = np.concatenate([np.cumsum(g[0]) for g in got])
        runs = np.concatenate([g[1] for g in got]).astype(np.int64)
        w = np.concatenate([g[2].astype(U) << U(32) | g[3] for g in got])
        counts, c = np.concatenate([g[4] for g in got]).astype(np.int64), np.concatenate([g[5] for g in got]).astype(np.int64)
        contexts, context = np.unique(keys, return_inverse=True)
        of = np.repeat(context, runs)
        _, first, at = np.unique(mix(contexts[of] ^ mix(w)), return_index=True, return_inverse=True)
        total = np.bincount(at, weights=counts, minlength=len(first)).astype(np.int64)
        mine, seen = of[first], total > 0
        by_count = [np.bincount(mine[total == r], minlength=len(contexts)) for r in range(1, DISCOUNTED + 1)]
        mass = np.bincount(mine[seen], weights=level.p(c[first[seen]]), minlength=len(contexts))
        key_end, pair_end = np.cumsum([len(g[0]) for g in got]), np.cumsum([len(g[2]) for g in got])
        for k, chunk in enumerate(chunks):
            ask, pairs = context[key_end[k] - len(got[k][0]):key_end[k]], at[pair_end[k] - len(got[k][2]):pair_end[k]]
            yield chunk, X.pack(X.narrow(total[pairs]), *[X.narrow(n[ask]) for n in by_count], mass[ask])
        yield -1, X.pack(np.array(_of_counts(total), np.int64))
    return combine


def scored(words: Words, pairs: Level):
    """Log probabilities of a chunk's documents from the replies of both rounds."""

    def go_on(number: int, chunk: X.Chunk, replies: dict[int, bytes]) -> pa.Table:
        p = Pairs(chunk, replies)
        got = [X.unpack(replies[b]) for b in sorted(replies) if b >= SECOND]
        one = words.p(p.c_tok)
        prob = one.copy()
        if got:
            total = np.empty(len(p.order), np.int64)
            total[p.order] = np.concatenate([g[0] for g in got])
            # Sums of a context's keys; its seen words have their mass from the same counts everywhere.
            n = [np.bincount(p.key_context, weights=np.concatenate([g[r] for g in got]), minlength=len(p.context)) for r in range(1, DISCOUNTED + 1)]
            mass = np.bincount(p.key_context, weights=np.concatenate([g[-1] for g in got]), minlength=len(p.context))
            occurs = p.occurs[p.context]
            left, factor = pairs.freed(n, occurs)
            alpha = left / (1 - mass)
            known = np.flatnonzero(p.c_before > 0)
            place = np.searchsorted(p.context, p.before[known])
            r = np.zeros(len(one), np.int64)
            r[p.asked] = total[p.at]
            r = r[known]
            prob[known] = np.where(r > 0, pairs.seen(r, occurs[place]) * factor[place], alpha[place] * one[known])
        n_docs = len(chunk.ids)

        def per_doc(x):
            return np.bincount(p.owner, weights=x, minlength=n_docs)

        n_tokens = np.bincount(p.owner, minlength=n_docs)
        return pa.table([chunk.id_column(), pa.array(chunk.flag), pa.array(n_tokens), pa.array(per_doc(p.c_tok > 0).astype(np.int64)),
                         pa.array(np.full(n_docs, words.total)), pa.array(per_doc(words.base(p.c_tok))), pa.array(per_doc(np.log10(prob)))],
                        names=[x.split()[0] for x in OUTPUT.split(", ")])
    return go_on


def _sums(replies: DataFrame, width: int) -> np.ndarray:
    """The buckets' statistics, added up."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([X.unpack(b)[0] for b in batch.column(0).to_pylist()]).sum(axis=0) if batch.num_rows else np.zeros(width, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int64()), pa.array(x)], names=["i", "x"])

    out = np.zeros(width, np.int64)
    for r in replies.where("chunk = -1").select("blob").mapInArrow(read, "i long, x long").groupBy("i").agg(F.sum("x").alias("x")).collect():
        out[r.i] = r.x
    return out


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """OUTPUT for every row of (doc_id, text); rows that are held out are scored and not learned from."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("flag"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    chunks, size = X.chunk_table(rows, "katz_chunks")
    bits = X.bucket_count(size).bit_length() - 1
    first = stored(X.answered(X.first_requests(chunks, word_requests(bits)), count_words), "katz-words")
    words = Words(_sums(first, DISCOUNTED + 3))
    known = first.where("chunk >= 0")
    asked = X.with_replies(chunks, known, pair_requests(bits), X.REQUEST)
    second = stored(X.answered(asked, count_pairs(words)), "katz-pairs")
    pairs = Level(_sums(second, DISCOUNTED + 1))
    replies = known.unionByName(second.where("chunk >= 0").withColumn("bucket", F.col("bucket") + SECOND))
    return X.with_replies(chunks, replies, scored(words, pairs), OUTPUT)
