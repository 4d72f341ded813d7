"""One representative for each group of similar prompts: k-means over their embeddings, in rounds.

The centres of a round are k vectors that every task gets; a task multiplies blocks of its rows with all of them and returns one sum per centre,
so a round reads the rows once, moves k sums per task, and brings k sums to the driver. Clusters that hold too much are split once more, all at the same
time, each by centres of its own: at most k * split centres in all. The rows themselves are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.operators.sampling import seeded_sample
from millrace.session import written

ROWS = 4096  # rows multiplied with the centres at a time
Centres = Mapping[int, np.ndarray]  # by the cluster that they split; 0 for the first level


def _usable(vector: Column, size: int | None) -> Column:
    sound = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    long = F.size(vector) > 0 if size is None else F.size(vector) == size
    return F.coalesce(vector.isNotNull() & long & sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(vector: Column) -> Column:
    doubles = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(doubles, lambda x: x / norm)


def _nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre (ties: the first) and its squared distance."""
    apart = (rows * rows).sum(1)[:, None] - 2 * rows @ centres.T + (centres * centres).sum(1)[None, :]
    best = apart.argmin(1)
    return best, np.maximum(apart[np.arange(len(rows)), best], 0)


def _blocks(batch: pa.RecordBatch, centres: Centres) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(parent, places in the batch, vectors), some rows at a time. The batch has columns _parent and _unit."""
    parents = batch.column(batch.schema.names.index("_parent")).to_numpy(zero_copy_only=False)
    flat = batch.column(batch.schema.names.index("_unit"))
    for parent in np.unique(parents).tolist():
        at = np.flatnonzero(parents == parent)
        for i in range(0, len(at), ROWS):
            some = at[i:i + ROWS]
            values = flat.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False)
            yield parent, some, values.reshape(len(some), -1)


def _sums(rows: DataFrame, centres: Centres) -> list:
    """(parent, cluster, n, cost, sum of vectors) of one round; rows: _parent, _unit."""
    schema = "_parent long, _cluster long, _n long, _cost double, _sum array<double>"

    def table(entries) -> pa.Table:
        columns = list(zip(*entries)) or [()] * 5
        types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()))
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, types)], names=["_parent", "_cluster", "_n", "_cost", "_sum"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            for parent, _, vectors in _blocks(batch, centres):
                best, apart = _nearest(vectors, centres[parent])
                for k in np.unique(best).tolist():
                    own = best == k
                    entry = held.setdefault((parent, k), [0, 0.0, 0.0])
                    entry[0], entry[1], entry[2] = entry[0] + int(own.sum()), entry[1] + float(apart[own].sum()), entry[2] + vectors[own].sum(0)
        yield from table([(p, k, n, cost, total.tolist()) for (p, k), (n, cost, total) in held.items()]).to_batches()

    def merged(key, part):
        vectors = np.stack([np.array(v) for v in part.column("_sum").to_pylist()])
        return table([(key[0].as_py(), key[1].as_py(), sum(part.column("_n").to_pylist()), float(np.sum(part.column("_cost").to_pylist())), vectors.sum(0).tolist())])

    return rows.select("_parent", "_unit").mapInArrow(partial, schema).groupBy("_parent", "_cluster").applyInArrow(merged, schema).collect()


@dataclass
class Clustering:
    centres: dict[int, np.ndarray]
    costs: list[float] = field(default_factory=list)  # the summed squared distances in front of every round
    sizes: dict[tuple[int, int], int] = field(default_factory=dict)  # rows of every cluster as last assigned


def rounds_of(rows: DataFrame, centres: Centres, rounds: int, least_gain: float = 1e-4) -> Clustering:
    """Lloyd's rounds from the given centres; stops early when a round gains less than ``least_gain`` of the cost. A centre without rows stays."""
    out = Clustering({p: c.copy() for p, c in centres.items()})
    for _ in range(rounds + 1):
        sums = _sums(rows, out.centres)
        out.costs.append(sum(r._cost for r in sums))
        out.sizes = {(r._parent, r._cluster): r._n for r in sums}
        if len(out.costs) > rounds or (len(out.costs) > 1 and out.costs[-2] - out.costs[-1] <= least_gain * out.costs[-2]):
            break
        for r in sums:
            out.centres[r._parent][r._cluster] = np.array(r._sum) / r._n
    return out


def _assigned(rows: DataFrame, centres: Centres) -> DataFrame:
    """rows with _cluster and _distance of the nearest centre of their parent; null where the parent has none."""
    schema = T.StructType([*rows.schema.fields, T.StructField("_cluster", T.LongType()), T.StructField("_distance", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            for parent, at, vectors in _blocks(batch, centres):
                if parent in centres:
                    best, apart = _nearest(vectors, centres[parent])
                    cluster[at], distance[at] = best, np.sqrt(apart)
            none = cluster < 0
            yield pa.RecordBatch.from_arrays([*[c.cast(t) for c, t in zip(batch.columns, arrow.types)], pa.array(cluster, pa.int64(), mask=none), pa.array(distance, mask=none)], schema=arrow)

    return rows.mapInArrow(run, schema)


def _seeds(rows: DataFrame, key: str, n: int, seed: int) -> np.ndarray:
    drawn = seeded_sample(rows.select(key, "_unit"), key, n, seed).collect()  # n vectors
    drawn.sort(key=lambda r: (r[key] is None, r[key]))
    return np.array([r["_unit"] for r in drawn])


def semantic_dedup(df: DataFrame, key: str, vector: str, k: int, rounds: int = 10, max_share: float = 0.1, split: int = 8, seed: int = 0) -> tuple[DataFrame, list[Clustering]]:
    """df with cluster, distance (to its centre, vectors taken at length 1) and representative (columns of these names are replaced), and the levels' clusterings.

    Clusters that hold more than ``max_share`` of the rows are split by up to ``split`` centres of their own. The row nearest to its centre represents
    the cluster (ties: the smallest key). Rows whose vector is null, empty, zero, holds null or non-finite numbers, or has another
    length than the smallest key's sound one have no cluster and represent themselves, as nothing can be said about them.
    """
    df = df.drop("cluster", "distance", "representative")
    sound = df.where(_usable(F.col(vector), None))
    size = sound.agg(F.min(F.struct(F.col(key), F.size(vector).alias("n"))).alias("m")).first()["m"]
    usable = _usable(F.col(vector), size["n"] if size else 0)
    rows = written(df.where(usable).withColumns({"_unit": _unit(F.col(vector)), "_parent": F.lit(0).cast("bigint")}), "vectors")
    others = df.where(~usable)
    levels = []
    if size:
        levels.append(rounds_of(rows, {0: _seeds(rows, key, k, seed)}, rounds))
        first = _assigned(rows, levels[0].centres)
        total = sum(levels[0].sizes.values())
        large = [c for (_, c), n in sorted(levels[0].sizes.items()) if n > max_share * total and n > 1]
        parts = first.withColumnsRenamed({"_cluster": "_own", "_distance": "_far"}).withColumn("_parent", F.col("_own") + 1).select(*df.columns, "_unit", "_parent", "_own", "_far")
        if large:
            parts = written(parts, "clusters")
            inner = parts.where(F.col("_own").isin(large))
            levels.append(rounds_of(inner, {c + 1: _seeds(parts.where(F.col("_own") == c), key, split, seed + 1 + c) for c in large}, rounds))
        found = _assigned(parts, levels[1].centres if large else {})
        cluster = F.col("_own") * F.lit(split + 1) + F.coalesce(F.col("_cluster") + 1, F.lit(0))
        found = found.select(*df.columns, cluster.alias("cluster"), F.coalesce("_distance", "_far").alias("distance"))
    else:
        found = rows.select(*df.columns, F.lit(None).cast("bigint").alias("cluster"), F.lit(None).cast("double").alias("distance"))
    found = written(found, "assigned")
    nearest = found.groupBy("cluster").agg(F.min(F.struct("distance", F.col(key).alias("_k"))).alias("_best"))
    chosen = F.struct("distance", F.col(key).alias("_k")).eqNullSafe(F.col("_best"))
    kept = found.join(F.broadcast(nearest), "cluster").select(*df.columns, "cluster", "distance", chosen.alias("representative"))  # k * (split + 1) rows at most
    alone = others.select(*df.columns, F.lit(None).cast("bigint").alias("cluster"), F.lit(None).cast("double").alias("distance"), F.lit(True).alias("representative"))
    return kept.unionByName(alone), levels
