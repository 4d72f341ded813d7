"""Streaming twins of the batch operators.

Every query ends in versioned batch folders: a replayed micro-batch overwrites its own folder, so a
restart from the checkpoint adds nothing twice. Views read the folders back. State is either built-in
aggregation, combined before the shuffle, or a bounded table; no row-by-row state code runs in Python.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.functions.text import instant
from millrace.operators.groups import success_store
from millrace.operators.runs import newest_rows


# ---- running and reading back --------------------------------------------------------------------
def _finish(df: DataFrame, folder: str, save: Callable[[DataFrame, int], None], mode: str) -> None:
    running = (df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint")
               .trigger(availableNow=True).foreachBatch(save).start())
    running.awaitTermination()


def run_to_end(df: DataFrame, folder: str, mode: str = "append") -> None:
    """Process what is there in micro-batches and stop; the checkpoint lets a later call go on."""
    _finish(df, folder, lambda rows, batch: rows.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}"), mode)


def written(spark: SparkSession, folder: str, schema) -> DataFrame:
    """All rows written so far, with their batch number."""
    fields = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return spark.read.schema(f"{fields}, batch bigint").parquet(f"{folder}/out")


def newest_per_key(rows: DataFrame, *keys: str) -> DataFrame:
    """The row of the last batch for each key."""
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("_r")).select(*keys, "_r.*")


# ---- stateless and built-in state ----------------------------------------------------------------
def latest_state(metrics: DataFrame) -> DataFrame:
    """Newest row and row count per run (update mode)."""
    columns = [c for c in metrics.columns if c != "run_id"]
    return metrics.groupBy("run_id").agg(F.max_by(F.struct(*columns), F.col("seq")).alias("r"),
                                         F.count(F.lit(1)).alias("rows")).select("run_id", "rows", "r.*")


def dedupe_steps(metrics: DataFrame, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Drop rows whose run and step came before, within the lateness allowed."""
    timed = metrics.withColumn(ts, instant(metrics, ts))
    return timed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["run_id", "step"])


def rates(metrics: DataFrame, ts: str = "ts", size: str = "10 minutes", slide: str = "1 minute", delay: str = "1 hour") -> DataFrame:
    """Mean reward and prompts per second per run over sliding windows."""
    timed = metrics.withColumn(ts, instant(metrics, ts)).withWatermark(ts, delay)
    out = timed.groupBy("run_id", F.window(ts, size, slide).alias("w")).agg(
        F.avg("reward").alias("reward"), F.sum("prompts_generated").alias("prompts"), F.count(F.lit(1)).alias("n"))
    seconds = F.unix_seconds("w.end") - F.unix_seconds("w.start")
    return out.select("run_id", F.col("w.start").alias("window_start"), "reward", "n",
                      (F.col("prompts") / seconds).alias("prompts_per_second"))


def group_signal(scored: DataFrame, size: int) -> DataFrame:
    """Per group: completions so far, reward range, whether complete and whether it carries a signal (update mode).

    Three numbers per group are the whole state; rows of one group are combined before the shuffle.
    """
    out = scored.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.min("reward").alias("lo"), F.max("reward").alias("hi"))
    return out.select("*", (F.col("n") >= size).alias("complete"), (F.col("hi") != F.col("lo")).alias("kept"))


# ---- bounded tables fed by a stream --------------------------------------------------------------
# A bounded choice per key (newest rows, drawn successes) of a union is the choice of the choices. Each
# micro-batch writes its own choice; every ``fold`` batches one also takes in the folders before it, so
# a view reads a limited number of folders. Earlier folders stay untouched and may be expired.
Reduce = Callable[[DataFrame], DataFrame]


def reduce_to_end(df: DataFrame, folder: str, reduce: Reduce, fold: int = 32) -> None:
    def save(rows: DataFrame, batch: int) -> None:
        kept = reduce(rows)
        if batch and batch % fold == 0:
            before = written(rows.sparkSession, folder, rows.schema).filter(F.col("batch").between(batch - fold, batch - 1))
            kept = reduce(kept.unionByName(before.drop("batch")))
        kept.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    _finish(df, folder, save, "append")


def reduced_view(spark: SparkSession, folder: str, schema, reduce: Reduce, fold: int = 32) -> DataFrame:
    rows = written(spark, folder, schema)
    top = rows.agg(F.max("batch").alias("b")).first()["b"] or 0
    return reduce(rows.filter(F.col("batch") >= top - top % fold).drop("batch"))


def newest(keep: int) -> Reduce:
    """Newest ``keep`` rows per run."""
    return lambda df: newest_rows(df, keep)


def successes(keep: int = 5, threshold: float = 0.5, seed: int = 0) -> Reduce:
    """Up to ``keep`` successes per prompt, the same draw as in batch."""
    return lambda df: success_store(df, "group_id", "comp_id", keep=keep, threshold=threshold, seed=seed).drop("slot")


# ---- aggregates without stream state ---------------------------------------------------------------
# Sums, extremes and newest rows of a union follow from those of its parts. Each micro-batch writes its own, which are combined when
# folders are folded, so neither memory nor a view grows with the number of batches, late rows count, and no watermark is needed.
@dataclass(frozen=True)
class Folded:
    start: Callable[[DataFrame], DataFrame]  # rows as aggregates of one row
    merge: Reduce
    finish: Callable[[DataFrame], DataFrame]

    def run(self, df: DataFrame, folder: str, fold: int = 32) -> None:
        reduce_to_end(self.start(df), folder, self.merge, fold)

    def view(self, df: DataFrame, folder: str, fold: int = 32) -> DataFrame:
        """The result so far; ``df`` is the stream or any frame of its shape."""
        return self.finish(reduced_view(df.sparkSession, folder, self.start(df).schema, self.merge, fold))


def folded_latest() -> Folded:
    """As ``latest_state``."""
    def merge(df):
        others = [c for c in df.columns if c not in ("run_id", "rows")]
        return df.groupBy("run_id").agg(F.sum("rows").alias("rows"), F.max_by(F.struct(*others), "seq").alias("r")).select("run_id", "rows", "r.*")

    def start(df):
        return df.select("run_id", F.lit(1).cast("bigint").alias("rows"), *[c for c in df.columns if c != "run_id"])

    return Folded(start, merge, lambda df: df)


def folded_signal(size: int) -> Folded:
    """As ``group_signal``."""
    def merge(df):
        return df.groupBy("group_id").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))

    return Folded(lambda df: df.select("group_id", F.lit(1).cast("bigint").alias("n"), F.col("reward").alias("lo"), F.col("reward").alias("hi")), merge,
                  lambda df: df.select("*", (F.col("n") >= size).alias("complete"), (F.col("hi") != F.col("lo")).alias("kept")))


def folded_rates(ts: str = "ts", size: str = "10 minutes", slide: str = "1 minute") -> Folded:
    """As ``rates``, with late rows."""
    keys, sums = ["run_id", "window_start", "seconds"], ["total", "known", "prompts", "n"]

    def start(df):
        cut = df.withColumn(ts, instant(df, ts)).where(F.col(ts).isNotNull()).withColumn("w", F.window(ts, size, slide))
        one = {"total": F.coalesce(F.col("reward").cast("double"), F.lit(0.0)), "known": F.col("reward").isNotNull().cast("bigint"), "prompts": F.coalesce(F.col("prompts_generated").cast("bigint"), F.lit(0)), "n": F.lit(1).cast("bigint")}
        return cut.select("run_id", F.col("w.start").alias("window_start"), (F.unix_seconds("w.end") - F.unix_seconds("w.start")).alias("seconds"), *[v.alias(k) for k, v in one.items()])

    def merge(df):
        return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])

    def finish(df):
        return df.select("run_id", "window_start", F.try_divide("total", "known").alias("reward"), "n", (F.col("prompts") / F.col("seconds")).alias("prompts_per_second"))

    return Folded(start, merge, finish)
