"""Joins of rows with one-row-per-group tables when a group may hold a large share of all rows.

The adaptive skew join does not split a join whose other side is an aggregate on the same key, so hot
groups are salted here: their rows are spread over several join keys and the group's row is repeated for
each. Only the list of hot keys is broadcast: of n rows at most n / HOT_ROWS keys can be hot, a million of 10^12.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

HOT_ROWS = 1_000_000


def hot_keys(counts: DataFrame, by: Sequence[str], n: str = "n", hot_rows: int | None = None) -> DataFrame:
    """Keys with more than ``hot_rows`` rows and the number of parts to cut them into."""
    hot_rows = hot_rows or HOT_ROWS
    return counts.filter(F.col(n) > hot_rows).select(*by, F.ceil(F.col(n) / hot_rows).alias("_parts"))


def with_parts(df: DataFrame, hot: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add ``_parts`` (null for a key that is not hot)."""
    return df.join(F.broadcast(hot), list(by), "left")


def join_groups(rows: DataFrame, groups: DataFrame, by: Sequence[str], counts: DataFrame, n: str = "n", how: str = "inner",
                spread: Sequence[str] | Column | None = None, hot_rows: int | None = None) -> DataFrame:
    """``rows`` joined with ``groups`` (one row per key) on ``by``.

    ``counts`` has the number of rows per key. ``spread`` names columns that tell rows of a group apart
    (default: all others); their hash chooses the part, so a recomputed task chooses the same.
    """
    by = list(by)
    hot = hot_keys(counts, by, n, hot_rows)
    mark = F.xxhash64(*(spread or [c for c in rows.columns if c not in by]))
    cut = with_parts(rows, hot, by).withColumn(
        "_part", F.when(F.col("_parts").isNotNull(), F.pmod(mark, F.col("_parts"))).otherwise(F.lit(0).cast("bigint"))).drop("_parts")
    last = F.coalesce("_parts", F.lit(1)) - 1
    copies = with_parts(groups, hot, by).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).drop("_parts")
    return cut.join(copies, [*by, "_part"], how).drop("_part")
