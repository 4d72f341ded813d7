"""Scoring of completion tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions import rewards as R
from millrace.functions.text import computed_once


def with_components(df: DataFrame, parts: Mapping[str, Column]) -> DataFrame:
    """Add one guarded reward column per component."""
    return computed_once(df, **{n: R.guard(c) for n, c in parts.items()})


def default_parts(style: str = "deepseek", completion: str = "completion",
                  reference: str = "reference_answer") -> dict[str, Column]:
    c, r = F.col(completion), F.col(reference)
    return {"format": R.format_reward(c, style), "reasoning": R.reasoning_reward(c, style),
            "answer": R.integer_reward(c, r, style)}


# Weights of the default mix.
DEFAULT_WEIGHTS = {"format": 1.0, "reasoning": 0.5, "answer": 2.0}


def score_default(df: DataFrame, style: str = "deepseek", normalise: bool = True) -> DataFrame:
    """Add the default mix as ``reward``."""
    scored = with_components(df, default_parts(style))
    mix = R.combine({n: (F.col(n), w) for n, w in DEFAULT_WEIGHTS.items()}, normalise)
    return scored.withColumn("reward", mix)


def component_long(df: DataFrame, names: list[str]) -> DataFrame:
    """One row per completion and component: ``component, value``."""
    pairs = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n) for n in names]))
    return df.select("*", F.explode(pairs).alias("component", "value"))


def accuracy(df: DataFrame, order_by: str, reward: str = "reward", samples: int | None = 100,
             passing: float = 0.5) -> DataFrame:
    """Share of passing rewards, mean and count over the first ``samples`` rows in order."""
    first = df.select(order_by, reward)
    if samples is not None:
        first = first.orderBy(order_by).limit(samples)
    return first.agg(F.coalesce(F.avg(F.when(F.col(reward) >= passing, 1.0).otherwise(0.0)), F.lit(0.0)).alias("accuracy"),
                     F.coalesce(F.avg(reward), F.lit(0.0)).alias("mean_reward"), F.count(F.lit(1)).alias("samples"))
