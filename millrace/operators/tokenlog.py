"""Reports over logged per-token log-probabilities. Vectors stay arrays; each row is reduced on its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Clamp of the log ratio and bound of the loss for a negative advantage.
LOG_RATIO_LIMIT = 20.0
DUAL_CLIP = 3.0


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mask_of(values: Column, prompt_len: Column) -> Column:
    """1 from the first completion position on, else 0."""
    return F.transform(values, lambda _, i: F.when(i >= prompt_len - 1, 1.0).otherwise(0.0))


def times(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def kl_k3(logp: Column, logp_ref: Column, mask: Column | None = None) -> Column:
    """exp(d) - d - 1 per token, with d = (reference - policy) inside the mask."""
    d = F.zip_with(logp_ref, logp, lambda r, p: r - p)
    d = times(d, mask) if mask is not None else d
    return F.transform(d, lambda x: F.exp(x) - x - 1)


def masked_mean(values: Column, mask: Column) -> Column:
    return total(times(values, mask)) / F.greatest(total(mask), F.lit(1e-8))


def masked_sum(values: Column, mask: Column, constant: float | None = None) -> Column:
    s = total(times(values, mask))
    return s / F.lit(float(constant)) if constant and constant > 0 else s


def ratio(logp_new: Column, logp_old: Column) -> Column:
    return F.zip_with(logp_new, logp_old, lambda n, o: F.exp(
        F.greatest(F.least(n - o, F.lit(LOG_RATIO_LIMIT)), F.lit(-LOG_RATIO_LIMIT))))


def policy_loss(ratios: Column, advantage: Column, kl: Column | None = None, low: float = 0.2, high: float = 0.2,
                kl_weight: float = 0.0) -> Column:
    """Clipped surrogate loss per token; bounded from above for a negative advantage."""
    def one(r):
        clipped = F.greatest(F.least(r, F.lit(1.0 + high)), F.lit(1.0 - low))
        worst = F.greatest(-advantage * r, -advantage * clipped)
        return F.when(advantage < 0, F.least(-advantage * F.lit(DUAL_CLIP), worst)).otherwise(worst)

    losses = F.transform(ratios, one)
    return losses if kl is None or kl_weight == 0 else F.zip_with(losses, kl, lambda x, k: x + kl_weight * k)


def aggregate_loss(df: DataFrame, loss: str, mask: str, by: list[str] | None = None, constant: float = 1024.0) -> DataFrame:
    """The three ways to reduce token losses: by token, by fixed length, by sample."""
    rows = df.select(*(by or []), masked_sum(F.col(loss), F.col(mask)).alias("s"), total(F.col(mask)).alias("m"))
    return rows.groupBy(*(by or [])).agg(
        (F.sum("s") / F.greatest(F.sum("m"), F.lit(1.0))).alias("token_level"),
        F.avg(F.col("s") / F.lit(float(constant))).alias("fixed_length"),
        F.avg(F.col("s") / F.greatest(F.col("m"), F.lit(1e-8))).alias("sample_level"))


def ratio_report(df: DataFrame, ratios: str, advantage: str, kl: str, mask: str, low: float = 0.2, high: float = 0.2,
                 masked: bool = False) -> DataFrame:
    """Ratio, clipping and divergence figures. As logged, all positions count; only divergence is masked.

    ``masked`` restricts the ratio figures to completion tokens.
    """
    kl_sum, mask_sum = total(times(F.col(kl), F.col(mask))), total(F.col(mask))
    rows = df.agg(F.avg(advantage).alias("advantages_mean"), F.stddev_samp(advantage).alias("advantages_std"),
                  (F.sum(kl_sum) / F.greatest(F.sum(mask_sum), F.lit(1e-8))).alias("kl_mean"))
    token = df.select(advantage, F.explode(F.arrays_zip(F.col(ratios).alias("r"), F.col(mask).alias("m"))).alias("z"))
    if masked:
        token = token.filter("z.m = 1")
    r, a = F.col("z.r"), F.col(advantage)
    clipped = (r < 1 - low) | (r > 1 + high)
    bounded = F.greatest(-a * r, -a * F.greatest(F.least(r, F.lit(1.0 + high)), F.lit(1.0 - low))) > -a * DUAL_CLIP
    figures = token.agg(F.avg(r).alias("ratio_mean"), F.stddev_samp(r).alias("ratio_std"), F.min(r).alias("ratio_min"),
                        F.max(r).alias("ratio_max"), F.avg(clipped.cast("double")).alias("clip_fraction"),
                        F.avg(((a < 0) & bounded).cast("double")).alias("dual_clip_fraction"))
    return figures.select("*", *[rows.select(c).scalar().alias(c) for c in rows.columns])


def entropy(df: DataFrame, logp: str, mask: str) -> DataFrame:
    """Mean of -p log p of the chosen tokens inside the mask."""
    h = F.transform(F.col(logp), lambda x: -F.exp(x) * x)
    rows = df.select(total(times(h, F.col(mask))).alias("s"), total(F.col(mask)).alias("m"))
    return rows.agg((F.sum("s") / F.greatest(F.sum("m"), F.lit(1e-8))).alias("entropy"), F.sum("m").alias("tokens"))


def _mix(s: Column, t: Column, alpha: float) -> Column:
    """log((1 - alpha) e^s + alpha e^t), shifted by the larger term."""
    a, b = s + F.log(F.lit(1 - alpha)), t + F.log(F.lit(alpha))
    top = F.greatest(a, b)
    return top + F.log(F.exp(a - top) + F.exp(b - top))


def distill_token(student: Column, teacher: Column, old: Column | None = None, alpha: float = 0.5,
                  is_clip: float | None = 2.0) -> Column:
    """Distillation loss per token from the chosen tokens' log-probabilities."""
    def one(s, t):
        if alpha == 0.0:
            return F.exp(t) * (t - s)
        if alpha == 1.0:
            return (s - t) * s
        m = _mix(s, t, alpha)
        return (1 - alpha) * F.exp(s) * (s - m) + alpha * F.exp(t) * (t - m)

    loss = F.zip_with(student, teacher, one)
    if old is None or is_clip is None:
        return loss
    return times(loss, F.transform(ratio(student, old), lambda r: F.least(r, F.lit(float(is_clip)))))


def _renormalised(values: Column) -> Column:
    top = F.array_max(values)
    z = top + F.log(total(F.transform(values, lambda x: F.exp(x - top))))
    return F.transform(values, lambda x: x - z)


def distill_topk(student: Column, teacher: Column, alpha: float = 0.5) -> Column:
    """Distillation loss per position from top-k vectors, compared by rank."""
    def one(s, t):
        if alpha == 0.0:
            return F.exp(t) * (t - s)
        if alpha == 1.0:
            return F.exp(s) * (s - t)
        m = _mix(s, t, alpha)
        return (1 - alpha) * F.exp(s) * (s - m) + alpha * F.exp(t) * (t - m)

    return F.zip_with(student, teacher, lambda s, t: total(F.zip_with(_renormalised(s), _renormalised(t), one)))


def combined_loss(policy: DataFrame, distilled: DataFrame, by: list[str], weight: float = 1.0) -> DataFrame:
    """Policy loss plus weighted distillation loss; the policy loss alone where there is no teacher."""
    return policy.join(distilled, by, "left").select(
        *by, "policy_loss", F.coalesce("distill_loss", F.lit(0.0)).alias("distill_loss"),
        (F.col("policy_loss") + weight * F.coalesce("distill_loss", F.lit(0.0))).alias("total_loss"))


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def nonfinite_report(df: DataFrame, run: str, step: str, loss: str) -> DataFrame:
    """Per run: usable and skipped rows, and the first step with a loss that is no finite number."""
    bad = ~is_finite(F.col(loss))
    return df.groupBy(run).agg(F.count_if(~bad).alias("kept"), F.count_if(bad).alias("skipped"),
                               F.min(F.when(bad, F.col(step))).alias("first_bad_step"),
                               (F.count_if(bad) > 0).alias("diverged"))


def ratio_mask(ratios: Column, mask: Column, low: float, high: float) -> Column:
    """The mask without tokens whose ratio lies outside [low, high]: both far too likely and far too unlikely tokens get no gradient."""
    return F.zip_with(mask, ratios, lambda m, r: F.when((r >= low) & (r <= high), m).otherwise(0.0))


def ratio_mask_report(df: DataFrame, ratios: str, mask: str, low: float, high: float, by: list[str] | None = None) -> DataFrame:
    """tokens inside the mask, how many are left, those masked from below and from above, and the mean ratio of those left."""
    kept = ratio_mask(F.col(ratios), F.col(mask), low, high)
    under = F.zip_with(F.col(mask), F.col(ratios), lambda m, r: F.when(r < low, m).otherwise(0.0))
    rows = df.select(*(by or []), total(F.col(mask)).alias("n"), total(kept).alias("k"), total(under).alias("u"), total(times(F.col(ratios), kept)).alias("r"))
    n, k, u = (F.coalesce(F.sum(c), F.lit(0.0)).cast("bigint") for c in ("n", "k", "u"))
    return rows.groupBy(*(by or [])).agg(n.alias("tokens"), k.alias("kept"), u.alias("below"), (n - k - u).alias("above"), F.try_divide(F.sum("r"), F.sum("k")).alias("ratio_mean"))
