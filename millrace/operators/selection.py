"""Which copies, prompts and answer pairs go on: exact duplicates, pass rates, preference pairs. One grouped pass each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.text import SPACE, strip
from millrace.operators.skew import join_groups
from millrace.session import written


def normal_form(text: Column) -> Column:
    """Lower case, one blank for any white space, none at the ends."""
    return F.lower(strip(F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " ")))


def exact_dedup(df: DataFrame, key: str, text: str, spread: list[str] | None = None, hot_rows: int | None = None) -> DataFrame:
    """df with text_md5 (of the normal form), copies, and first: whether the row has the smallest key among its copies (columns of these names are
    replaced).

    Keys and counts of a text are combined before the shuffle and joined back with salting, so a text that a third of all rows share is no
    task's load. Null texts are empty texts and copies of each other; null keys come last; rows that share text and key are all first.
    """
    df = df.drop("text_md5", "copies", "first")
    rows = df.withColumn("text_md5", F.md5(normal_form(F.col(text))))
    groups = written(rows.groupBy("text_md5").agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("_least")), "copies")
    out = join_groups(rows, groups, ["text_md5"], groups, "copies", spread=spread or [key], hot_rows=hot_rows)
    return out.withColumn("first", F.col(key).eqNullSafe(F.col("_least"))).select(*rows.columns, "copies", "first")


def duplicate_report(marked: DataFrame) -> DataFrame:
    """rows, different texts, rows that go, and their share."""
    gone = F.count_if(~F.col("first"))
    return marked.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("text_md5").alias("texts"), gone.alias("removed"), F.coalesce(F.try_divide(gone, F.count(F.lit(1))), F.lit(0.0)).alias("share"))


def passrate_filter(df: DataFrame, by: str, reward: str = "reward", threshold: float = 0.5, least: int = 1) -> DataFrame:
    """Per prompt: samples, pass_rate (share of rewards of ``threshold`` or more), signal (rewards differ) and kept: prompts with a signal and at least
    ``least`` samples, of which some fail. Null rewards are no samples."""
    rows = df.where(F.col(reward).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("samples"), F.avg((F.col(reward) >= threshold).cast("double")).alias("pass_rate"),
                                                               (F.max(reward) > F.min(reward)).alias("signal"))
    return rows.withColumn("kept", F.col("signal") & (F.col("samples") >= least) & (F.col("pass_rate") < 1))


def preference_pairs(df: DataFrame, by: str, key: str, completion: str, size: Column, reward: str = "reward", least_delta: float = 0.5, most_apart: int = 100) -> DataFrame:
    """Per prompt the pair of its best and its worst completion (ties: the smallest key): chosen, rejected, delta, apart (difference in tokens), for pairs whose rewards are at least
    ``least_delta`` apart and whose sizes at most ``most_apart``. Null rewards and completions take no part."""
    rows = df.where(F.col(reward).isNotNull() & F.col(completion).isNotNull()).select(by, F.col(reward).alias("_r"), F.col(key).alias("_k"), F.col(completion).alias("_c"), size.alias("_n"))
    item, high, low = F.struct("_k", "_c", "_n", "_r"), F.struct(-F.col("_r"), F.col("_k")), F.struct(F.col("_r"), F.col("_k"))
    pairs = rows.groupBy(by).agg(F.min_by(item, high).alias("_best"), F.min_by(item, low).alias("_worst"))
    out = pairs.select(by, F.col("_best._k").alias("chosen_key"), F.col("_worst._k").alias("rejected_key"), F.col("_best._c").alias("chosen"), F.col("_worst._c").alias("rejected"),
                       (F.col("_best._r") - F.col("_worst._r")).alias("delta"), F.abs(F.col("_best._n") - F.col("_worst._n")).alias("apart"))
    return out.where((F.col("delta") >= least_delta) & (F.col("delta") > 0) & (F.col("apart") <= most_apart))
