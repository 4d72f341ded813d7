"""Near duplicates by ProbMinHash, banding and verification.

A text is its five-word shingles, weighted by 1 + ln(count). Each shingle is a Poisson process of arrivals at the registers, of
rate equal to its weight; a register keeps the shingle that came first. The chance that two texts agree in a register is
their probability Jaccard similarity. Arrivals later than a text's latest register can't change it, so generation ends early.

Bands of seven registers name buckets. Exact copies are one node. Within a bucket every node is first compared with the smallest
one, by the exact similarity of the whole texts. Where a bucket then still holds several components, nodes that can't be similar to any other
are set aside, and all nodes outside the largest component are compared with the nodes of other components, by whole texts where
an exact upper bound of the similarity (see `may_link`) doesn't rule it out. So texts that meet in a bucket end in one group exactly if links join them, and a
large bucket of copies costs one comparison per member, not one per pair.

Cases: texts without words have no shingles and only join exact copies of themselves (null counts as empty); texts of one to four words are one
shingle; a row without id is a group of its own with null group; rows that repeat an id with another text fall in one group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stored
from millrace.llm.shingles import U, mix, weighted_shingles

THRESHOLD = 0.8
ROWS, BANDS = 7, 42
WORDS = -(-ROWS * BANDS // 16)
PARITIES = 1024
SLICE = 128


def weights(counts: np.ndarray) -> np.ndarray:
    return 1 + np.log(counts)


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, m: int = ROWS * BANDS) -> np.ndarray:
    """The element that arrives first at each of m registers, for n texts. Elements of small texts send several arrivals a round,
    so that the number of rounds grows with log m only."""
    best = np.full(n * m, np.inf)
    sig = np.zeros(n * m, U)
    size = np.bincount(owner, minlength=n)
    per_round = np.maximum(1, -(-m // np.maximum(1, size)))
    active, x, sent = np.arange(len(owner)), np.zeros(len(owner)), np.zeros(len(owner), np.int64)
    while len(active):
        reps = per_round[owner[active]]
        first = np.cumsum(reps) - reps
        flat = np.repeat(np.arange(len(active)), reps)
        who = active[flat]
        z = mix(element[who] + (sent[who] + np.arange(len(flat)) - first[flat] + 1).astype(U) * U(0x9E3779B97F4A7C15))
        gap = -np.log1p(-(z >> U(11)).astype(np.float64) * 2.0 ** -53) / weight[who]
        total = np.cumsum(gap)
        at = total - (total - gap)[first][flat] + x[who]
        slot = owner[who] * m + (mix(z ^ U(0xA0761D6478BD642F)) % U(m)).astype(np.int64)
        early = at < best[slot]
        np.minimum.at(best, slot[early], at[early])
        won = early & (at == best[slot])
        sig[slot[won]] = element[who[won]]
        x[active] = at[first + reps - 1]
        sent[active] += reps
        latest = best.reshape(n, m).max(axis=1)
        active = active[x[active] < latest[owner[active]]]
    return sig.reshape(n, m)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One signed 64-bit key per text and band."""
    n = len(sig)
    parts = mix(sig).reshape(n, BANDS, ROWS)
    key = np.tile(np.arange(1, BANDS + 1, dtype=U) * U(0x632BE59BD9B4E019), (n, 1))
    for j in range(ROWS):
        key = mix(key * U(0x9E3779B97F4A7C15) + parts[:, :, j])
    return key.view(np.int64)


def sketches(sig: np.ndarray) -> np.ndarray:
    """Four bits of every register, sixteen registers to a signed 64-bit number; the last ones padded with zeros. They estimate a
    similarity and rule nothing out, so no link depends on them."""
    n, m = sig.shape
    four = np.zeros((n, WORDS * 16), U)
    four[:, :m] = mix(sig) & U(15)
    return (four.reshape(n, WORDS, 16) << (np.arange(16, dtype=U) * U(4))).sum(axis=2, dtype=U).view(np.int64)


def unlike(a: Column, b: Column) -> Column:
    """In how many registers two sketches differ."""
    def differ(x: Column) -> Column:
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111)))
    return reduce(add, [differ(a[i].bitwiseXOR(b[i])) for i in range(WORDS)])


def parities(owner: np.ndarray, element: np.ndarray, n: int) -> np.ndarray:
    """For n texts, whether each of PARITIES cells holds an odd number of the text's distinct shingles; 64 cells to a signed number. A cell where two
    texts differ holds a shingle that only one of them has."""
    cell = (mix(element) & U(PARITIES - 1)).astype(np.int64)
    odd = np.bincount(owner * PARITIES + cell, minlength=n * PARITIES).astype(np.uint8) & 1
    return np.packbits(odd.reshape(n, PARITIES), axis=1).view(np.int64)


def bulks(owner: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """The total weight of each text less half its number of distinct shingles."""
    return np.bincount(owner, weights=weight, minlength=n) - np.bincount(owner, minlength=n) / 2


def may_link(parity_a: Column, parity_b: Column, bulk_a: Column, bulk_b: Column) -> Column:
    """False only for pairs below the threshold. The similarity is at most C / (C + S), C the sum over common shingles of the larger
    weight, S the weight of the others, as max(x'/x, y'/y) >= max(x', y') / max(x, y). No weight is below 1, so with D cells of different parity
    S >= D and C <= T - S / 2, T the sum of both bulks: the similarity is at most (T - D / 2) / (T + D / 2)."""
    d = reduce(add, [F.bit_count(parity_a[i].bitwiseXOR(parity_b[i])) for i in range(PARITIES // 64)])
    return d * F.lit(1 + THRESHOLD) <= (bulk_a + bulk_b) * F.lit(2 * (1 - THRESHOLD)) + F.lit(1e-6)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard of two sorted weighted sets: the sum over common elements of one over
    sum(max(x'/x, y'/y)), with all ratios split by one sort."""
    both = np.union1d(a[0], b[0])
    x, y = np.zeros(len(both)), np.zeros(len(both))
    x[np.searchsorted(both, a[0])] = a[1]
    y[np.searchsorted(both, b[0])] = b[1]
    with np.errstate(divide="ignore"):
        order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    above, below = x[::-1].cumsum()[::-1], np.concatenate([[0.0], y.cumsum()[:-1]])
    common = (x > 0) & (y > 0)
    return float((1 / (above[common] / x[common] + below[common] / y[common])).sum())


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            yield batch.slice(i, SLICE)


def text_nodes(docs: DataFrame) -> DataFrame:
    """(node, copy, keys, parity, bulk) per distinct text: its smallest id, its digest, its bucket keys, what bounds its similarities."""

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            texts = batch.column(2).to_pylist()
            owner, element, counts = weighted_shingles(texts)
            full = np.bincount(owner, minlength=len(texts)) > 0
            w = weights(counts)
            sig = signatures(owner, element, w, len(texts))
            keys = band_keys(sig)
            packed = [k.tobytes() if ok else b"" for k, ok in zip(keys, full)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary()),
                                              pa.array(list(parities(owner, element, len(texts))), pa.list_(pa.int64())), pa.array(bulks(owner, w, len(texts)))],
                                             names=["doc_id", "copy", "keys", "parity", "bulk"])

    rows = _with_copy(docs).mapInArrow(bands, "doc_id long, copy string, keys binary, parity array<long>, bulk double")
    return rows.groupBy("copy").agg(F.min("doc_id").alias("node"), *[F.first(c).alias(c) for c in ("keys", "parity", "bulk")])


def _with_copy(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text).alias("copy"), text.alias("text"))


def bucket_rows(nodes: DataFrame) -> DataFrame:
    """(bucket, node) of buckets with several nodes."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            packed = batch.column(1).to_pylist()
            n = [len(p) // 8 for p in packed]
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(packed), np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), n))],
                                             names=["bucket", "node"])

    rows = nodes.select("node", "keys").mapInArrow(unpack, "bucket long, node long")
    shared = rows.groupBy("bucket").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last").select("bucket", "leader")
    return rows.join(shared, "bucket")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) of the pairs whose texts are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple] = {}

        def shown(node, text):
            if node not in known:
                if len(known) >= 64:
                    known.clear()
                _, h, c = weighted_shingles([text])
                known[node] = (h, weights(c))
            return known[node]

        for batch in _sliced(batches):
            a, b, s, t = (batch.column(i).to_pylist() for i in range(4))
            kept = [i for i in range(len(a)) if similarity(shown(a[i], s[i]), shown(b[i], t[i])) >= THRESHOLD - 1e-12]
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in kept], pa.int64()), pa.array([b[i] for i in kept], pa.int64())], names=["a", "b"])

    with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("s")), "a")
    both = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("t")), "b").select("a", "b", "s", "t")
    return both.mapInArrow(check, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that a node is linked to, directly or not. Every round takes the smallest label among the
    neighbours, then the label of that label; rounds grow with the logarithm of the longest chain. Labels live in the shared folder."""
    both = stored(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "edges")
    labels = stored(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("component")), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("v"), "component"), "v").groupBy("u").agg(F.min("component").alias("near"))
                .join(labels.select(F.col("node").alias("u"), "component"), "u")
                .select(F.col("u").alias("node"), F.least("near", "component").alias("hop"), F.col("component").alias("was")))
        jump = labels.select(F.col("node").alias("hop"), F.col("component").alias("beyond"))
        after = stored(near.join(jump, "hop", "left").select("node", F.least("hop", F.coalesce("beyond", "hop")).alias("component"), "was"), "labels")
        labels = after.select("node", "component")
        if after.where("component <> was").isEmpty():
            return labels


def _mixed(placed: DataFrame) -> DataFrame:
    """The rows (bucket, node, component) of buckets with several components, and the largest component."""
    held = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    mixed = (held.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.count("*").alias("k"))
             .where("k > 1").select("bucket", "largest"))
    return placed.join(mixed, "bucket")


def isolated(texts: DataFrame) -> DataFrame:
    """(node) of the texts that no other of these texts can be similar to: the similarity is at most the share of a text's weight
    on shingles that others hold too. Heavily edited copies in large buckets go this way, without a comparison."""

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            owner, element, counts = weighted_shingles(batch.column(1).to_pylist())
            w = weights(counts)
            w = w / np.bincount(owner, weights=w, minlength=batch.num_rows)[owner]
            yield pa.RecordBatch.from_arrays([pa.array(element.view(np.int64)), pa.array(batch.column(0).to_numpy()[owner]), pa.array(w)], names=["shingle", "node", "share"])

    rows = texts.select("node", "text").mapInArrow(shares, "shingle long, node long, share double")
    lone = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node"), F.min("share").alias("share")).where("n = 1")
    return lone.groupBy("node").agg(F.sum("share").alias("lone")).where(F.col("lone") > 1 - THRESHOLD + 1e-9).select("node")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_id (smallest id with the same text), group_id (smallest id of the group), n_links
    (verified links of the document's text to other texts)."""
    docs = docs.select("doc_id", "text")
    nodes = stored(text_nodes(docs), "nodes")
    buckets = stored(bucket_rows(nodes), "buckets")
    stars = stored(buckets.where("leader <> node").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    wanted = buckets.select("node").distinct()
    texts = stored(docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("node"), F.coalesce("text", F.lit("")).alias("text"))
                   .join(wanted, "node").dropDuplicates(["node"]), "texts")
    links = stored(verified(stars, texts), "links")
    found = components(links)

    placed = stored(buckets.select("bucket", "node").join(found, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component")), "placed")
    placed = _mixed(placed)
    alone = stored(isolated(placed.select("node").distinct().join(texts, "node")), "isolated")
    open_ = _mixed(placed.select("bucket", "node", "component").join(alone, "node", "left_anti"))
    held = open_.groupBy("node").agg(F.collect_set("bucket").alias("buckets")).join(nodes.select("node", "parity", "bulk"), "node")
    open_ = stored(open_.join(held, "node"), "open")
    left = open_.where("component <> largest").select("bucket", F.col("node").alias("x"), F.col("component").alias("cx"), F.col("parity").alias("px"), F.col("bulk").alias("wx"),
                                                               F.col("buckets").alias("bx"), "largest")
    right = open_.select("bucket", F.col("node").alias("y"), F.col("component").alias("cy"), F.col("parity").alias("py"), F.col("bulk").alias("wy"), F.col("buckets").alias("by"))
    # A pair comes once: from the smallest bucket that it shares, and in one order where both stand outside the largest component.
    near = ((left["bucket"] == right["bucket"]) & (F.col("cx") != F.col("cy")) & ((F.col("cy") == F.col("largest")) | (F.col("x") < F.col("y")))
            & may_link(F.col("px"), F.col("py"), F.col("wx"), F.col("wy")) & (F.array_min(F.array_intersect("bx", "by")) == left["bucket"]))
    more = (left.join(right, near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
            .join(stars, ["a", "b"], "left_anti"))
    late = stored(verified(more, texts), "links")
    if not late.isEmpty():
        links = links.unionByName(late)
        found = components(links)

    degree = (links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links")))
    grouped = nodes.select("node", "copy").join(found, "node", "left").join(degree, "node", "left").select(
        "copy", F.col("node").alias("text_id"), F.coalesce("component", "node").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    members = _with_copy(docs).select("doc_id", "copy").join(grouped, "copy").drop("copy")
    lone = docs.where("doc_id is null").select(F.col("doc_id").cast("long").alias("doc_id"), *[F.lit(None).cast("long").alias(c) for c in ("text_id", "group_id")],
                                               F.lit(0).cast("long").alias("n_links"))
    return members.unionByName(lone)
