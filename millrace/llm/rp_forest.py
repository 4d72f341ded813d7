"""Approximate nearest neighbours by a forest of random-projection trees.

Every tree splits a bounded sample at the median of the projection on the difference of two of its points, down to small leaves. All rows are
then passed down all trees. A query walks the trees together: one priority queue holds open branches of every tree, ordered by the summed squares
of the margins by which the query lies on their other side, and leaves are taken from it until they hold the wanted number of
rows. Queries and rows meet by leaf: a leaf's rows are ranked for the queries that took it by their exact inner product in double precision, and the
best of all leaves are merged.

How many rows a query wants is measured, not set: for a bounded sample of queries the true neighbours are found by comparing them with all rows, and
the smallest number that reaches the target recall on them is taken. Structured vectors need few rows; vectors without structure need most of the
index, as nothing can be ruled out there.

Neighbouring leaves of a tree share a bucket, to which a query is sent once with the leaves it took. A tree has BUCKETS of them at most, whatever its
size, so what queries are sent and what they find grow with their number alone. Crowded buckets are cut into parts, the queries of a bucket into turns of about
CELL_QUERIES; each part and turn is a cell, whose rows pass its queries in batches, so memory is bounded by a batch and the queries of a cell. No query
vector but the sample's passes through the driver. Equal vectors are one entry of the index; of each entry the k + 1 smallest ids are kept,
which is all a result of k can need.

Cases: vectors that are null, zero, hold null or non-finite components, or have another length than most take no part, neither do
null ids; repeated rows count once; ties go to the smaller id; an empty table gives an empty result; fewer rows than k are all returned.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import stored

K = 20
TREES = 4
SAMPLE = 20_000  # vectors that the trees are built on
MOST_LEAVES = 512  # of a tree
LEAF_ROWS = 400  # rows of the index in a leaf, as long as that makes no more leaves
RECALL = 0.94  # wanted on the sample of queries
TRIED = 300  # queries in that sample
BUCKETS = 4  # of a tree, at most
CELL = ["bucket", "part", "turn"]
CELL_ROWS, CELL_QUERIES = 2_000, 5_000  # rows of a bucket at least, queries of a cell


@dataclass
class Tree:
    directions: np.ndarray
    thresholds: np.ndarray
    children: np.ndarray  # (node, 2): a node, or -1 - leaf
    leaves: int

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64) if len(self.thresholds) else np.full(len(x), -1)
        while (open_ := np.flatnonzero(at >= 0)).size:
            node = at[open_]
            right = np.einsum("ij,ij->i", x[open_], self.directions[node]) >= self.thresholds[node]
            at[open_] = self.children[node, right.astype(np.int64)]
        return -1 - at


def build(sample: np.ndarray, rng: np.random.Generator, leaf: int) -> Tree:
    directions, thresholds, children, leaves = [], [], [], 0
    todo = [(np.arange(len(sample)), None)]
    while todo:
        rows, place = todo.pop()
        node = None
        if len(rows) > leaf:
            a, b = sample[rng.choice(rows, 2, replace=False)]
            d = a - b
            p = sample[rows] @ d
            t = float(np.median(p))
            if (p < t).any():
                node = len(thresholds)
                directions.append(d / np.linalg.norm(d))
                thresholds.append(t / np.linalg.norm(d))
                children.append([0, 0])
                todo += [(rows[p < t], (node, 0)), (rows[p >= t], (node, 1))]
        if node is None:
            node, leaves = -1 - leaves, leaves + 1
        if place:
            children[place[0]][place[1]] = node
    dim = sample.shape[1]
    return Tree(np.array(directions).reshape(-1, dim), np.array(thresholds), np.array(children, np.int64).reshape(-1, 2), leaves)


def walk(forest: list[Tree], offsets: np.ndarray, q: np.ndarray) -> Iterator[int]:
    """The leaves (of all trees, numbered through) in the order in which a query takes them, by the shared queue."""
    margins = [(t.directions @ q - t.thresholds).tolist() for t in forest]
    queue = [(0.0, k, 0 if len(t.thresholds) else -1) for k, t in enumerate(forest)]
    while queue:
        far, k, node = heapq.heappop(queue)
        if node < 0:
            yield int(offsets[k]) - 1 - node
            continue
        m = margins[k][node]
        left, right = forest[k].children[node].tolist()
        heapq.heappush(queue, (far + max(0.0, m) ** 2, k, left))
        heapq.heappush(queue, (far + max(0.0, -m) ** 2, k, right))


def taken(forest: list[Tree], sizes: np.ndarray, offsets: np.ndarray, q: np.ndarray, wanted: float) -> list[int]:
    """The first leaves of the walk that hold the wanted number of rows, a row counted in every tree."""
    out, have = [], 0
    for leaf in walk(forest, offsets, q):
        if have >= wanted:
            break
        out.append(leaf)
        have += int(sizes[leaf])
    return out


def needed(forest: list[Tree], sizes: np.ndarray, offsets: np.ndarray, tried: list[tuple[np.ndarray, np.ndarray]], recall: float) -> float:
    """The smallest number of rows at which the walks find `recall` of the true neighbours. `tried`: a query, and the leaves of its true neighbours
    (one row each, a column per tree)."""
    at = []
    for q, leaves in tried:
        before, have = np.zeros(int(offsets[-1])), 0
        for leaf in walk(forest, offsets, q):
            before[leaf] = have
            have += int(sizes[leaf])
        at.append(before[leaves].min(axis=1))
    found = np.sort(np.concatenate(at)) if at else np.zeros(0)
    return float(found[min(len(found) - 1, int(np.ceil(recall * len(found))))]) + 1 if len(found) else 1.0


def vectors(df: DataFrame) -> DataFrame:
    """(vec_id, k1, k2, v) of the rows that take part; the keys name equal vectors."""
    v = F.col("embedding").cast("array<double>")
    fine = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    good = df.where("vec_id is not null and embedding is not null").where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: x + 0.0).alias("v"))
    usual = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    good = good.where(F.size("v") == (usual.n if usual else 0))
    return good.select("vec_id", F.xxhash64("v").alias("k1"), F.xxhash64("v", F.lit(1)).alias("k2"), "v")


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def neighbours(df: DataFrame, query_every: int = 20, k: int = K, figures: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) for the queries, rows of (vec_id, embedding) whose id is divisible by query_every. `figures` receives the number of
    entries, of leaves, and of rows that a query wants, counted in every tree."""
    spark = df.sparkSession
    rows = vectors(df)
    order = W.partitionBy("k1", "k2").orderBy("vec_id")
    entries = stored(rows.dropDuplicates(["vec_id", "k1", "k2"]).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).groupBy("k1", "k2")
                     .agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("v").alias("v"))
                     .select("k1", "k2", "ids", F.col("ids")[0].alias("entry"), "v"), "entries")
    total = entries.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = rows.where(F.col("vec_id") % query_every == 0).select("vec_id", "k1", "k2").distinct()
    asked = stored(asked.join(entries.select("k1", "k2", "entry"), ["k1", "k2"]).select(F.col("vec_id").alias("query_id"), "entry"), "asked")
    walkers = stored(asked.select("entry").distinct().join(entries.select("entry", "v"), "entry"), "walkers")

    sample = np.array([r.v for r in entries.orderBy(F.xxhash64("entry", F.lit(3))).limit(SAMPLE).select("v").collect()])
    leaves = int(min(MOST_LEAVES, max(1, total // LEAF_ROWS), max(1, len(sample) // 8)))
    forest = [build(sample, np.random.default_rng(seed), max(1, len(sample) // leaves)) for seed in range(TREES)]
    offsets = np.cumsum([0] + [t.leaves for t in forest])
    sent = spark.sparkContext.broadcast(forest)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            leaf = np.stack([t.leaf_of(x) + o for t, o in zip(sent.value, offsets)], axis=1) if len(x) else np.zeros((0, TREES), np.int64)
            places = pa.FixedSizeListArray.from_arrays(pa.array(leaf.reshape(-1), pa.int32()), TREES).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), places], names=["entry", "v", "leaves"])

    index = stored(entries.select("entry", "v").mapInArrow(place, "entry long, v array<double>, leaves array<int>"), "index")
    sizes = np.zeros(int(offsets[-1]), np.int64)  # leaves are as many as the sample allows
    for r in index.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect():
        sizes[r.leaf] = r["count"]
    wanted = needed(forest, sizes, offsets, _true_leaves(walkers, index, k + 1), RECALL)

    if figures is not None:
        figures |= {"entries": total, "leaves": int(offsets[-1]), "wanted": wanted}

    room = max(CELL_ROWS, -(-total // BUCKETS))
    bucket, n_buckets = np.zeros(len(sizes), np.int64), 0  # of every leaf, by the rows of its tree before it
    for a, b in zip(offsets, offsets[1:]):
        bucket[a:b] = n_buckets + (np.cumsum(sizes[a:b]) - sizes[a:b]) // room
        n_buckets = int(bucket[b - 1]) + 1

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, own, which = [], [], []
            for i, q in enumerate(_matrix(batch.column(1))):
                leaves = np.sort(np.array(taken(sent.value, sizes, offsets, q, wanted), np.int64))
                for some in np.split(leaves, np.flatnonzero(np.diff(bucket[leaves])) + 1):
                    place.append(i)
                    own.append(some)
                    which.append(int(bucket[some[0]]))
            at = pa.array(place, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(own, pa.list_(pa.int32())), pa.array(which, pa.int64())], names=["query", "q", "leaves", "bucket"])

    walks = stored(walkers.repartition(max(1, min(total // 2000, 10_000)), "entry").mapInArrow(go, "query long, q array<double>, leaves array<int>, bucket long"), "walks")
    asks, rows_in = np.zeros(n_buckets, np.int64), np.bincount(bucket, sizes, n_buckets).astype(np.int64)
    for r in walks.groupBy("bucket").count().collect():
        asks[r.bucket] = r["count"]
    if figures is not None:
        figures |= {"sent": int(asks.sum())}
    # Rows of a bucket are dealt to parts, its queries to turns; each part and turn is a cell, to which both sides are sent.
    parts, turns = (F.element_at(F.array(*[F.lit(int(max(1, -(-n // (2 * most))))) for n in counts]), F.col("bucket").cast("int") + 1) for counts, most in ((rows_in, room), (asks, CELL_QUERIES)))
    bucket_of = F.element_at(F.array(*[F.lit(int(b)) for b in bucket]), F.col("leaf") + 1).cast("long")
    left = (index.select("entry", "v", F.explode("leaves").alias("leaf")).withColumn("bucket", bucket_of)
            .withColumn("part", F.pmod(F.xxhash64("entry"), parts).cast("int")).withColumn("turn", F.explode(F.sequence(F.lit(0), turns - 1))))
    right = walks.withColumn("turn", F.pmod(F.xxhash64("query"), turns).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    cell = [*CELL, "of_index"]  # a cell's queries come before its rows
    both = (right.select(*CELL, F.lit(0).alias("of_index"), F.col("query").alias("id"), F.col("q").alias("v"), "leaves")
            .unionByName(left.select(*CELL, F.lit(1).alias("of_index"), F.col("entry").alias("id"), "v", F.array("leaf").alias("leaves"))))
    found = both.repartition(*CELL).sortWithinPartitions(*cell, "leaves").mapInArrow(_ranked(k + 1), "query long, entry long, score double").dropDuplicates(["query", "entry"])
    top = W.partitionBy("query").orderBy(F.desc("score"), "entry")
    near = found.withColumn("n", F.row_number().over(top)).where(F.col("n") <= k + 1)
    ids = near.join(entries.select("entry", "ids"), "entry").select("query", "score", F.explode("ids").alias("vec_id"))
    ranked = (ids.withColumn("n", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1)
              .groupBy("query").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("list")))
    own = F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return (asked.join(ranked, asked.entry == ranked.query).select("query_id", F.posexplode(own).alias("at", "hit"))
            .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score")))


def _best(queries: np.ndarray, entries: np.ndarray, k: int, n_rows: int, scores) -> pa.Table:
    """The best k rows for every query, with all that tie with the last; `scores(a, b)` has those of queries a to b, -inf for rows that don't count."""
    out = [pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["query", "entry", "score"])]
    step = max(1, 8_000_000 // max(1, n_rows))
    for i in range(0, len(queries) if n_rows else 0, step):
        score = scores(i, i + step)
        least = np.partition(score, n_rows - k, axis=1)[:, n_rows - k] if n_rows > k else np.full(len(score), -np.inf)
        who, what = np.nonzero((score >= least[:, None]) & (score > -np.inf))
        out.append(pa.table([pa.array(queries[i + who]), pa.array(entries[what]), pa.array(score[who, what])], names=["query", "entry", "score"]))
    return pa.concat_tables(out)


class Cell:
    """The queries of a cell with the leaves they took, and the best k rows of each so far."""

    def __init__(self, k: int):
        self.k, self.parts = k, []
        self.who, self.entry, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def ask(self, batch: pa.RecordBatch) -> None:
        self.parts.append((batch.column("id").to_numpy(), _matrix(batch.column("v")), np.diff(batch.column("leaves").offsets.to_numpy()), batch.column("leaves").flatten().to_numpy()))

    def begin(self) -> None:
        """All queries are here."""
        names, q, lengths, asked = zip(*self.parts)
        self.names, self.q, asked = np.concatenate(names), np.concatenate(q), np.concatenate(asked)
        asker = np.repeat(np.arange(len(self.q)), np.concatenate(lengths))
        by_leaf = np.argsort(asked, kind="stable")  # queries of a leaf stay in order
        self.asker, self.asked, self.parts = asker[by_leaf], asked[by_leaf], []

    def rank(self, batch: pa.RecordBatch) -> None:
        """Rows in the order of their leaves, ranked for the queries that took these."""
        if self.parts:
            self.begin()
        elif not hasattr(self, "q"):
            return  # nobody asks here
        x, leaf = _matrix(batch.column("v")), batch.column("leaves").flatten().to_numpy()

        def scores(a: int, b: int) -> np.ndarray:
            out = np.full((len(self.q[a:b]), len(x)), -np.inf)
            for one in np.unique(leaf).tolist():
                lo, hi = np.searchsorted(leaf, one), np.searchsorted(leaf, one, "right")
                who = self.asker[np.searchsorted(self.asked, one):np.searchsorted(self.asked, one, "right")]
                who = who[(who >= a) & (who < b)]
                if len(who):
                    out[who - a, lo:hi] = self.q[who] @ x[lo:hi].T
            return out

        new = _best(np.arange(len(self.q)), batch.column("id").to_numpy(), self.k, len(x), scores)
        who, entry, score = (np.concatenate([old, new.column(c).to_numpy()]) for old, c in ((self.who, "query"), (self.entry, "entry"), (self.score, "score")))
        order = np.lexsort((entry, -score, who))
        sorted_ = who[order]
        order = order[np.arange(len(order)) - np.searchsorted(sorted_, sorted_) < self.k]
        self.who, self.entry, self.score = who[order], entry[order], score[order]

    def found(self) -> pa.RecordBatch:
        names = self.names[self.who] if len(self.who) else self.who
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(self.entry), pa.array(self.score)], names=["query", "entry", "score"])


def _ranked(k: int):
    """Cells in order, the queries of each before its rows: the best k rows of the cell for every query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cell = None, Cell(k)
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in (*CELL, "of_index")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                key, some = keys[a].tolist(), batch.slice(a, b - a)
                if key[:-1] != at:
                    yield cell.found()
                    at, cell = key[:-1], Cell(k)
                cell.rank(some) if key[-1] else cell.ask(some)
        yield cell.found()

    return run


def _true_leaves(walkers: DataFrame, index: DataFrame, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For a sample of TRIED queries: the vector, and the leaves of its k nearest rows, found among all."""
    tried = walkers.orderBy(F.xxhash64("entry", F.lit(5))).limit(TRIED).collect()
    names, q = np.array([r.entry for r in tried], np.int64), np.array([r.v for r in tried])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            yield from _best(names, batch.column(0).to_numpy(), k, len(x), lambda a, b, x=x: q[a:b] @ x.T).to_batches()

    if not len(names):
        return []
    near = index.select("entry", "v").mapInArrow(best, "query long, entry long, score double")
    near = near.withColumn("n", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "entry"))).where((F.col("n") <= k) & (F.col("entry") != F.col("query")))
    held = dict(zip(names.tolist(), ([] for _ in names)))
    for r in near.join(index.select("entry", "leaves"), "entry").select("query", "leaves").collect():  # TRIED * k rows
        held[r.query].append(r.leaves)
    return [(v, np.array(held[n])) for n, v in zip(names.tolist(), q) if held[n]]
