"""Token-log reports over the log-probability frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import groups as G, tokenlog as L
from millrace.plans.frames import frame, over
from millrace.plans.registry import query

# Check side: one row per token.
TOK = """tok AS (SELECT vec_id, group_id, i, logp_new[i] AS n, logp_old[i] AS o, logp_ref[i] AS r, CASE WHEN i >= prompt_len THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS m
  FROM (SELECT *, unnest(range(1, len(logp_new) + 1)) AS i FROM logprobs) u),
adv AS (SELECT vec_id, CASE WHEN count(*) OVER g = 1 THEN reward ELSE (reward - avg(reward) OVER g) / CASE WHEN stddev_samp(reward) OVER g < 0.000001 THEN 1 ELSE stddev_samp(reward) OVER g END END AS a
  FROM logprobs WINDOW g AS (PARTITION BY group_id)),
full_ AS (SELECT tok.*, a, exp(greatest(least(n - o, 20), -20)) AS ratio, exp((r - n) * m) - (r - n) * m - 1 AS kl FROM tok JOIN adv ON tok.vec_id = adv.vec_id),
clip AS (SELECT *, greatest(-a * ratio, -a * greatest(least(ratio, 1.2), 0.8)) AS worst FROM full_),
lossy AS (SELECT *, CASE WHEN a < 0 THEN least(-a * 3, worst) ELSE worst END + 0.1 * kl AS loss FROM clip)"""


def sql(body):
    body = body.strip()
    rest = body[5:] if body.upper().startswith("WITH ") else None
    return over(f"WITH {TOK}{', ' + rest if rest else ' ' + body}", "logprobs")


def logs(spark, sf):
    df = frame(spark, sf, "logprobs")
    return df.withColumn("mask", L.mask_of(F.col("logp_new"), F.col("prompt_len")))


def with_loss(spark, sf):
    """Token losses with the group-relative advantage."""
    df = G.group_advantage(logs(spark, sf), ["group_id"], spread=["vec_id"])
    df = df.withColumns({"ratio": L.ratio(F.col("logp_new"), F.col("logp_old")),
                         "kl": L.kl_k3(F.col("logp_new"), F.col("logp_ref"), F.col("mask"))})
    return df.withColumn("loss", L.policy_loss(F.col("ratio"), F.col("advantage"), F.col("kl"), kl_weight=0.1))


def r6(c):
    return F.transform(c, lambda x: F.round(x, 6))


@query("kl_k3", sql("SELECT vec_id, list(round(kl, 6) ORDER BY i) AS kl FROM full_ GROUP BY vec_id"))
def kl_k3(spark, sf):
    return logs(spark, sf).select("vec_id", r6(L.kl_k3(F.col("logp_new"), F.col("logp_ref"), F.col("mask"))).alias("kl"))


@query("masked_mean", sql("""
SELECT vec_id, round(sum(n * m) / greatest(sum(m), 1e-8), 6) AS mean, round(sum(n * m), 6) AS total, round(sum(n * m) / 1024, 6) AS per_constant FROM tok GROUP BY vec_id"""))
def masked_mean(spark, sf):
    v, m = F.col("logp_new"), F.col("mask")
    return logs(spark, sf).select("vec_id", F.round(L.masked_mean(v, m), 6).alias("mean"), F.round(L.masked_sum(v, m), 6).alias("total"),
                                  F.round(L.masked_sum(v, m, 1024), 6).alias("per_constant"))


@query("policy_loss", sql("SELECT vec_id, list(round(loss, 6) ORDER BY i) AS loss FROM lossy GROUP BY vec_id"))
def policy_loss(spark, sf):
    return with_loss(spark, sf).select("vec_id", r6(F.col("loss")).alias("loss"))


@query("loss_aggregate", sql("""
WITH per AS (SELECT vec_id, sum(loss * m) AS s, sum(m) AS c FROM lossy GROUP BY vec_id)
SELECT round(sum(s) / greatest(sum(c), 1), 6) AS token_level, round(avg(s / 1024), 6) AS fixed_length, round(avg(s / greatest(c, 1e-8)), 6) AS sample_level FROM per"""))
def loss_aggregate(spark, sf):
    out = L.aggregate_loss(with_loss(spark, sf), "loss", "mask")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("ratio_report", sql("""
SELECT round(avg(ratio), 6) AS ratio_mean, round(stddev_samp(ratio), 6) AS ratio_std, round(min(ratio), 6) AS ratio_min, round(max(ratio), 6) AS ratio_max,
  round(avg(CASE WHEN ratio < 0.8 OR ratio > 1.2 THEN 1.0 ELSE 0.0 END), 6) AS clip_fraction,
  round(avg(CASE WHEN a < 0 AND worst > -a * 3 THEN 1.0 ELSE 0.0 END), 6) AS dual_clip_fraction,
  (SELECT round(avg(a), 6) + 0.0 FROM adv) AS advantages_mean, (SELECT round(stddev_samp(a), 6) FROM adv) AS advantages_std,
  round(sum(kl * m) / sum(m), 6) AS kl_mean FROM clip"""))
def ratio_report(spark, sf):
    out = L.ratio_report(with_loss(spark, sf), "ratio", "advantage", "kl", "mask")
    return out.select(*[(F.round(c, 6) + 0.0).alias(c) for c in out.columns])


@query("entropy", sql("SELECT round(sum(-exp(n) * n * m) / sum(m), 6) AS entropy, sum(m) AS tokens FROM tok"))
def entropy(spark, sf):
    return L.entropy(logs(spark, sf), "logp_new", "mask").withColumn("entropy", F.round("entropy", 6))


ALPHAS = (0.0, 1.0, 0.5)
S_MIX = "(greatest(n, r) + ln(0.5) + ln(exp(n - greatest(n, r)) + exp(r - greatest(n, r))))"
S_DISTILL = f"""CASE alpha WHEN 0 THEN exp(r) * (r - n) WHEN 1 THEN (n - r) * n
  ELSE 0.5 * exp(n) * (n - {S_MIX}) + 0.5 * exp(r) * (r - {S_MIX}) END * least(exp(greatest(least(n - o, 20), -20)), 2)"""


@query("distill_token", sql(f"""
WITH d AS (SELECT alpha, vec_id, m * CASE WHEN vec_id % 3 <> 0 THEN 1 ELSE 0 END AS w, {S_DISTILL} AS l FROM tok, (VALUES (0.0::DOUBLE), (1.0), (0.5)) v(alpha)),
per AS (SELECT alpha, vec_id, sum(l * w) AS s, sum(w) AS c FROM d GROUP BY ALL)
SELECT alpha, round(sum(s) / greatest(sum(c), 1), 6) AS token_level, round(avg(s / 1024), 6) AS fixed_length, round(avg(s / greatest(c, 1e-8)), 6) AS sample_level FROM per GROUP BY alpha"""))
def distill_token(spark, sf):
    taught = F.when(F.col("vec_id") % 3 != 0, 1.0).otherwise(0.0)
    df = logs(spark, sf).withColumn("mask", F.transform("mask", lambda m: m * taught))
    s, t, o = F.col("logp_new"), F.col("logp_ref"), F.col("logp_old")
    per_alpha = F.array(*[F.struct(F.lit(a).alias("alpha"), L.distill_token(s, t, o, a).alias("loss")) for a in ALPHAS])
    long = df.select("mask", F.explode(per_alpha).alias("x")).select("mask", "x.alpha", "x.loss")
    out = L.aggregate_loss(long, "loss", "mask", ["alpha"])
    return out.select("alpha", *[F.round(c, 6).alias(c) for c in out.columns if c != "alpha"])


@query("distill_topk", sql("""
WITH kk AS (SELECT vec_id, CAST(floor((i - 1) / 8) AS INT) AS pos, (i - 1) % 8 AS rank, n, r FROM tok),
z AS (SELECT vec_id, pos, ln(sum(exp(n))) AS zn, ln(sum(exp(r))) AS zr FROM kk GROUP BY ALL),
q AS (SELECT kk.vec_id, kk.pos, n - zn AS n, r - zr AS r FROM kk JOIN z ON kk.vec_id = z.vec_id AND kk.pos = z.pos),
x AS (SELECT *, ln(0.5 * exp(n) + 0.5 * exp(r)) AS m FROM q)
SELECT vec_id, pos, round(sum(exp(r) * (r - n)), 6) AS forward, round(sum(exp(n) * (n - r)), 6) AS reverse,
  round(sum(0.5 * exp(n) * (n - m) + 0.5 * exp(r) * (r - m)), 6) AS jensen FROM x GROUP BY ALL"""))
def distill_topk(spark, sf):
    def by_position(c):
        return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(c, i * 8 + 1, F.lit(8)))

    s, t = by_position(F.col("logp_new")), by_position(F.col("logp_ref"))
    df = frame(spark, sf, "logprobs").select("vec_id", s.alias("s"), t.alias("t"))
    df = df.select("vec_id", *[L.distill_topk(F.col("s"), F.col("t"), a).alias(n)
                               for n, a in (("forward", 0.0), ("reverse", 1.0), ("jensen", 0.5))])
    long = df.select("vec_id", F.posexplode(F.arrays_zip("forward", "reverse", "jensen")).alias("pos", "z"))
    return long.select("vec_id", "pos", *[F.round(f"z.{c}", 6).alias(c) for c in ("forward", "reverse", "jensen")])


@query("combined_loss", sql(f"""
WITH p AS (SELECT group_id, avg(s / greatest(c, 1e-8)) AS policy_loss FROM (SELECT group_id, vec_id, sum(loss * m) AS s, sum(m) AS c FROM lossy GROUP BY ALL) t GROUP BY group_id),
d AS (SELECT group_id, avg(s / greatest(c, 1e-8)) AS distill_loss FROM (SELECT group_id, vec_id, sum(l * m) AS s, sum(m) AS c FROM (
    SELECT *, {S_DISTILL} AS l FROM tok, (VALUES (0.5::DOUBLE)) v(alpha) WHERE vec_id % 3 <> 0 AND group_id % 4 <> 1) u GROUP BY ALL) t GROUP BY group_id)
SELECT p.group_id, round(policy_loss, 6) AS policy_loss, round(coalesce(distill_loss, 0), 6) AS distill_loss,
  round(policy_loss + 0.7 * coalesce(distill_loss, 0), 6) AS total_loss FROM p LEFT JOIN d ON p.group_id = d.group_id"""))
def combined_loss(spark, sf):
    policy = L.aggregate_loss(with_loss(spark, sf), "loss", "mask", ["group_id"]).select(
        "group_id", F.col("sample_level").alias("policy_loss"))
    taught = logs(spark, sf).filter("vec_id % 3 <> 0 AND group_id % 4 <> 1").withColumn(
        "loss", L.distill_token(F.col("logp_new"), F.col("logp_ref"), F.col("logp_old"), 0.5))
    distilled = L.aggregate_loss(taught, "loss", "mask", ["group_id"]).select(
        "group_id", F.col("sample_level").alias("distill_loss"))
    out = L.combined_loss(policy, distilled, ["group_id"], 0.7)
    return out.select("group_id", *[F.round(c, 6).alias(c) for c in out.columns if c != "group_id"])


@query("nonfinite_skip", over("""
SELECT run_id, count(*) FILTER (WHERE loss IS NOT NULL) AS kept, count(*) FILTER (WHERE loss IS NULL) AS skipped,
  min(step) FILTER (WHERE loss IS NULL) AS first_bad_step, count(*) FILTER (WHERE loss IS NULL) > 0 AS diverged FROM metrics GROUP BY run_id""", "metrics"))
def nonfinite_skip(spark, sf):
    df = frame(spark, sf, "metrics").withColumn("loss", F.coalesce("loss", F.lit(float("nan"))))
    return L.nonfinite_report(df, "run_id", "step", "loss")


@query("ratio_mask", sql("""
SELECT vec_id % 5 AS part, CAST(sum(m) AS BIGINT) AS tokens, CAST(sum(CASE WHEN ratio BETWEEN 0.9 AND 0.995 THEN m ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN ratio < 0.9 THEN m ELSE 0 END) AS BIGINT) AS below, CAST(sum(CASE WHEN ratio > 0.995 THEN m ELSE 0 END) AS BIGINT) AS above,
  round(sum(CASE WHEN ratio BETWEEN 0.9 AND 0.995 THEN m * ratio ELSE 0 END) / sum(CASE WHEN ratio BETWEEN 0.9 AND 0.995 THEN m ELSE 0 END), 6) AS ratio_mean FROM clip GROUP BY 1"""))
def ratio_mask(spark, sf):
    df = logs(spark, sf).withColumns({"part": F.col("vec_id") % 5, "ratio": L.ratio(F.col("logp_new"), F.col("logp_old"))})
    return L.ratio_mask_report(df, "ratio", "mask", 0.9, 0.995, ["part"]).withColumn("ratio_mean", F.round("ratio_mean", 6))
