"""Splits, shards, limits, samples and batches over a dense global index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.functions.text import hash60
from millrace.operators.ordering import first_rows, global_index

SPLIT_SCALE = 10_000
HASH_BITS = 40  # block width for an order given by a 60-bit hash: about a million blocks


def split_of(idx: Column, val_ratio: float) -> Column:
    """'val' for the first ``val_ratio`` of every 10000 positions, else 'train'."""
    threshold = int(val_ratio * SPLIT_SCALE)
    if threshold <= 0:
        return F.lit("train")
    return F.when(F.pmod(idx, F.lit(SPLIT_SCALE)) < threshold, "val").otherwise("train")


def holdout_split(df: DataFrame, val_ratio: float, idx: str = "idx") -> DataFrame:
    return df.withColumn("split", split_of(F.col(idx), val_ratio))


def shard_rows(df: DataFrame, shards: int, idx: str = "idx") -> DataFrame:
    return df.withColumn("shard", F.pmod(F.col(idx), F.lit(shards)).cast("int"))


def write_shards(df: DataFrame, path: str, rows_per_file: int = 1_000_000, idx: str = "idx") -> None:
    """One folder per split and shard; a reader of one shard reads only its folder.

    Rows are first brought together by shard and stretch of the index: files of even size, none of them large.
    """
    stretch = F.floor(F.col(idx) / rows_per_file)
    df.repartition("split", "shard", stretch).write.mode("overwrite").partitionBy("split", "shard").parquet(path)


def resume_state(df: DataFrame, idx: str = "idx") -> DataFrame:
    """Next position per shard after the rows of ``df``."""
    return df.groupBy("shard").agg((F.max(idx) + 1).alias("next_idx"))


def resume_from(df: DataFrame, state: DataFrame, idx: str = "idx") -> DataFrame:
    """Rows at or behind the saved position of their shard; a shard without state starts at 0."""
    joined = df.join(F.broadcast(state), "shard", "left")  # one row per shard
    return joined.filter(F.col(idx) >= F.coalesce("next_idx", F.lit(0))).drop("next_idx")


def skip_batches(df: DataFrame, step: int, grad_accum: int, batch: int, idx: str = "idx") -> DataFrame:
    """Rows behind the batches that ``step`` updates have used."""
    return df.filter(F.col(idx) >= step * grad_accum * batch)


def head_limit(df: DataFrame, order: str, rows: int | None) -> DataFrame:
    return df if not rows else first_rows(df, order, rows)


def seeded_sample(df: DataFrame, key: str, rows: int, seed: int = 0) -> DataFrame:
    """``rows`` rows drawn from the whole frame: the smallest seeded hashes of the key.

    The draw does not depend on the partitioning, and no task holds more of it than a block of hashes.
    """
    return first_rows(df.withColumn("_h", hash60(F.lit(seed), F.col(key))), "_h", rows, bits=HASH_BITS, tie=[key]).drop("_h")


def shorten(text: Column, chars: int = 500) -> Column:
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))).otherwise(text)


def shuffled(df: DataFrame, key: str, seed: int = 0, name: str = "pos") -> DataFrame:
    """Dense position in a seeded random order."""
    hashed = df.withColumn("_h", hash60(F.lit(seed), F.col(key)))
    return global_index(hashed, "_h", name, bits=HASH_BITS, tie=[key]).drop("_h")


def batches(df: DataFrame, key: str, size: int, seed: int = 0, drop_last: bool = False) -> DataFrame:
    """Shuffle and cut into batches of ``size``; ``drop_last`` leaves out an incomplete one."""
    out = shuffled(df, key, seed).withColumn("batch", F.floor(F.col("pos") / size))
    if drop_last:
        total = df.agg(F.count(F.lit(1)).alias("n"))
        out = out.filter(F.col("batch") < total.select(F.floor(F.col("n") / size)).scalar())
    return out


def refill(prompts: DataFrame, key: str, missing: int, first_group_id: int, seed: int = 0, round_no: int = 0) -> DataFrame:
    """``missing`` prompts drawn with replacement, each under a new group id."""
    spark: SparkSession = prompts.sparkSession
    indexed = global_index(prompts, key, "_i")
    n = prompts.count()
    slots = spark.range(missing).withColumn("_i", F.pmod(hash60(F.lit(seed), F.lit(round_no), F.col("id")), F.lit(max(n, 1))))
    drawn = slots.join(indexed, "_i")
    return drawn.select(F.col("id").alias("slot"), (F.col("id") + first_group_id).alias("new_group_id"), *prompts.columns)


def split_sizes(df: DataFrame, val_ratio: float, idx: str = "idx") -> DataFrame:
    """Estimated and exact sizes of both splits."""
    n = F.count(F.lit(1))
    val = F.count_if(split_of(F.col(idx), val_ratio) == "val")
    est = F.floor(n * F.lit(val_ratio)) if val_ratio > 0 else F.lit(0).cast("bigint")
    return df.agg(n.alias("total"), est.alias("val_estimate"), (n - est).alias("train_estimate"),
                  val.alias("val_exact"), (n - val).alias("train_exact"))


def plan_steps(df: DataFrame, processes: int, batch: int, grad_accum: int, epochs: int,
               by: list[str] | None = None) -> DataFrame:
    """Update steps that a corpus of this size needs."""
    n = df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("rows"))
    per_process = F.ceil(F.col("rows") / processes)
    per_epoch = F.ceil(per_process / batch)
    updates = F.ceil(per_epoch / grad_accum)
    return n.select(*(by or []), "rows", per_epoch.alias("batches_per_epoch"), (updates * epochs).alias("total_steps"))


def plan_rollouts(df: DataFrame, batch: int, processes: int, epochs: int, group_size: int, train_batch: int,
                  grad_accum: int, epochs_per_step: int = 1, max_prompts: int | None = None,
                  max_steps: int | None = None) -> DataFrame:
    """Prompts, rollout steps and optimizer steps planned for a prompt set."""
    per_step = max(batch * max(processes, 1), 1)
    micro = max(1, batch * group_size // max(1, train_batch))
    optim = -(-micro // max(1, grad_accum)) * max(1, epochs_per_step)
    prompts = F.col("num_prompts") * epochs
    if max_prompts:
        prompts = F.least(prompts, F.lit(max_prompts))
    steps = F.ceil(prompts / per_step)
    optimizer = steps * optim
    if max_steps:
        optimizer = F.least(optimizer, F.lit(max_steps))
    return df.agg(F.count(F.lit(1)).alias("num_prompts")).select(
        "num_prompts", prompts.alias("planned_prompts"), steps.alias("rollout_steps"),
        (F.ceil(F.col("num_prompts") / per_step) * epochs).alias("uncapped_steps"),
        F.greatest(optimizer, F.lit(1)).alias("optimizer_steps"))


def shard_overlap(df: DataFrame, sample_hash: Column, shard: str = "shard") -> DataFrame:
    """Samples seen more than once: copies, and the shards they fall into."""
    return (df.select(sample_hash.alias("sample_hash"), shard).groupBy("sample_hash")
            .agg(F.count(F.lit(1)).alias("copies"), F.countDistinct(shard).alias("shards")).filter("copies > 1"))


def overlap_summary(df: DataFrame, sample_hash: Column) -> DataFrame:
    """Total, distinct and duplicate sample counts."""
    per_hash = df.select(sample_hash.alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    return per_hash.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct_samples"),
                        (F.sum("n") - F.count(F.lit(1))).alias("duplicates"))
