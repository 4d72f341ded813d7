"""Run-metrics queries over the metrics frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import tokens as E
from millrace.operators import runs as J
from millrace.plans.frames import frame, over
from millrace.plans.indexing import INDEXED, texts
from millrace.plans.registry import query


def metrics(spark, sf):
    return frame(spark, sf, "metrics")


def sql(body):
    return over(body, "metrics")


def r6(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


ELAPSED = """el AS (SELECT run_id, (epoch_us(arg_max(ts, seq)) - epoch_us(arg_min(ts, seq))) / 1000000.0 AS sec, arg_min(step, seq) AS s0, arg_max(step, seq) AS s1 FROM metrics GROUP BY run_id)"""


LATEST = """
SELECT run_id, n AS "rows", step AS current_step, round(reward, 6) AS reward, round(loss, 6) AS current_loss, CAST(0 AS DOUBLE) AS current_lr,
  coalesce(status, 'training') AS status
FROM (SELECT *, count(*) OVER (PARTITION BY run_id) AS n, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS r FROM metrics) t WHERE r = 1"""


@query("latest_per_run", sql(LATEST))
def latest_per_run(spark, sf):
    return r6(J.latest(metrics(spark, sf)), "reward", "current_loss")


@query("histories", sql("""
SELECT run_id, CAST(floor(pos / 500) AS BIGINT) AS chunk, list(step ORDER BY pos) AS step_history, list(round(reward, 6) ORDER BY pos) AS reward_history, list(round(loss, 6) ORDER BY pos) AS loss_history
FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) - 1 AS pos FROM metrics) t GROUP BY ALL"""))
def histories(spark, sf):
    return J.histories(r6(metrics(spark, sf), "reward", "loss"), ["step", "reward", "loss"], chunk=500)


@query("run_totals", sql("""
SELECT run_id, CAST(sum(coalesce(prompts_generated, 0)) AS BIGINT) AS prompts_generated_total, CAST(sum(coalesce(prompts_used, 0)) AS BIGINT) AS prompts_used_total,
  CAST(count(*) * 8 AS BIGINT) AS completions_generated_total FROM metrics GROUP BY run_id"""))
def run_totals(spark, sf):
    df = J.positions(metrics(spark, sf)).withColumn("completions_generated_total", (F.col("pos") + 1) * 8)
    return J.totals(df, ["prompts_generated", "prompts_used", "completions_generated", "experiences_tuned"])


@query("elapsed_eta", sql(f"""WITH {ELAPSED}
SELECT run_id, round(sec, 6) AS elapsed_seconds, round(CASE WHEN s1 > s0 AND sec > 0 THEN sec / (s1 - s0) * greatest(0, 9000 - s1) ELSE 0 END, 4) AS eta_seconds,
  round(CASE WHEN s1 > s0 THEN sec / (s1 - s0) ELSE 0 END, 6) AS seconds_per_step FROM el"""))
def elapsed_eta(spark, sf):
    out = J.elapsed_eta(metrics(spark, sf), "step", "ts", F.lit(9000))
    return r6(out, "elapsed_seconds", "seconds_per_step").withColumn("eta_seconds", F.round("eta_seconds", 4))


@query("rolling_mean", sql("""
SELECT run_id, seq, CASE WHEN n > 10 THEN round(avg(reward) OVER w, 6) END AS reward_smooth, CASE WHEN n > 10 THEN round(avg(loss) OVER w, 6) END AS loss_smooth
FROM (SELECT *, count(*) OVER (PARTITION BY run_id) AS n FROM metrics) t
WINDOW w AS (PARTITION BY run_id ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"""))
def rolling_mean(spark, sf):
    df = metrics(spark, sf).select("run_id", "seq", "reward", "loss")
    out = J.rolling_mean(df, {"reward": "reward_smooth", "loss": "loss_smooth"})
    return r6(out, "reward_smooth", "loss_smooth").drop("reward", "loss")


@query("rolling_outcomes", sql("""
SELECT run_id, seq, round(avg(CASE WHEN outcome > 0 THEN 1.0 ELSE 0.0 END) OVER w, 3) AS win_rate, round(avg(CASE WHEN outcome = 0 THEN 1.0 ELSE 0.0 END) OVER w, 3) AS draw_rate,
  round(avg(CASE WHEN outcome < 0 THEN 1.0 ELSE 0.0 END) OVER w, 3) AS loss_rate
FROM metrics WINDOW w AS (PARTITION BY run_id ORDER BY seq ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)"""))
def rolling_outcomes(spark, sf):
    return J.rolling_outcomes(metrics(spark, sf).select("run_id", "seq", "outcome"), "outcome").drop("outcome")


@query("eval_winrate", sql("""
SELECT run_id, count(*) AS games, count(*) FILTER (WHERE outcome > 0) AS wins, count(*) FILTER (WHERE outcome = 0) AS draws, count(*) FILTER (WHERE outcome < 0) AS losses,
  round(avg(CASE WHEN outcome > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM metrics GROUP BY run_id"""))
def eval_winrate(spark, sf):
    return r6(J.winrate(metrics(spark, sf), "outcome"), "win_rate")


@query("decimate", sql("""
WITH t AS (SELECT run_id, seq, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS r FROM metrics),
u AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS n FROM t WHERE r <= 500)
SELECT run_id, seq FROM u WHERE n <= 60 OR (n - r) % greatest(1, CAST(floor(n / 60) AS BIGINT)) = 0"""))
def decimate(spark, sf):
    return J.decimate(metrics(spark, sf).select("run_id", "seq"), last=500, target=60)


@query("decimate_default", sql("""
WITH t AS (SELECT run_id, seq, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS r FROM metrics),
u AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS n FROM t WHERE r <= 2000)
SELECT run_id, seq FROM u WHERE n <= 1200 OR (n - r) % greatest(1, CAST(floor(n / 1200) AS BIGINT)) = 0"""))
def decimate_default(spark, sf):
    return J.decimate(metrics(spark, sf).select("run_id", "seq"))


CONFIG = """conf AS (SELECT run_id, count(*) * 12 AS dataset_total, max(step) AS rollout_step, sum(prompts_generated) AS logged FROM metrics GROUP BY run_id)"""


@query("dataset_progress", sql(f"""WITH {CONFIG}
SELECT run_id, CAST(greatest(logged, rollout_step * 4 * 2) AS BIGINT) AS prompts_seen, CAST(greatest(logged, rollout_step * 4 * 2) * 8 AS BIGINT) AS completions_seen,
  round(least(100, greatest(logged, rollout_step * 4 * 2) / dataset_total * 100.0), 6) AS dataset_pct FROM conf"""))
def dataset_progress(spark, sf):
    df = metrics(spark, sf)
    config = df.groupBy("run_id").agg((F.count(F.lit(1)) * 12).alias("dataset_total"), F.max("step").alias("rollout_step"),
                                      F.lit(4).alias("batch"), F.lit(2).alias("gpus"))
    return r6(J.dataset_progress(J.totals(df, ["prompts_generated"]), config, 8), "dataset_pct")


@query("throughput", sql(f"""WITH {ELAPSED}, tot AS (SELECT run_id, sum(prompts_generated) AS p, sum(prompts_used) AS u FROM metrics GROUP BY run_id)
SELECT el.run_id, round(p / sec, 6) AS prompts_generated_per_second, round(u / sec, 6) AS prompts_used_per_second,
  round(s1 * 4 * 2 / greatest(1.0, sec), 6) AS samples_per_second FROM el JOIN tot ON el.run_id = tot.run_id"""))
def throughput(spark, sf):
    df = metrics(spark, sf)
    counted = ["prompts_generated", "prompts_used"]
    return r6(J.run_rates(df, "step", "ts", counted, 4, 2), *[f"{c}_per_second" for c in counted], "samples_per_second")


@query("progress_pct", sql("""
SELECT run_id, round(greatest(0, least(100, arg_max(step, seq) / CAST(400 AS DOUBLE) * 100)), 6) AS progress FROM metrics GROUP BY run_id"""))
def progress_pct(spark, sf):
    out = J.latest(metrics(spark, sf)).select("run_id", J.clamp_pct(F.col("current_step"), F.lit(400)).alias("progress"))
    return r6(out, "progress")


@query("loss_smoothing", sql("""
WITH u AS (SELECT run_id, step + 1 AS step, avg(loss) AS l FROM metrics GROUP BY ALL), top AS (SELECT run_id, max(step) AS t FROM u GROUP BY run_id)
SELECT u.run_id, CASE WHEN step = 1 THEN 1 ELSE CAST(ceil(step / 10) AS BIGINT) * 10 END AS log_step, round(avg(l), 6) AS loss FROM u JOIN top ON u.run_id = top.run_id
WHERE CASE WHEN step = 1 THEN 1 ELSE CAST(ceil(step / 10) AS BIGINT) * 10 END <= t GROUP BY ALL"""))
def loss_smoothing(spark, sf):
    df = metrics(spark, sf).withColumn("step", F.col("step") + 1)
    return r6(J.loss_smoothing(df, "step", "loss"), "loss")


@query("val_loss_mean", sql("""
WITH b AS (SELECT run_id, step, avg(loss) AS l FROM metrics GROUP BY ALL), f AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step) AS r FROM b)
SELECT run_id, round(avg(l), 6) AS val_loss, count(*) AS batches FROM f WHERE r <= 50 GROUP BY run_id"""))
def val_loss_mean(spark, sf):
    return r6(J.val_loss(metrics(spark, sf), "step", "loss", 50), "val_loss")


def checkpoints(spark, sf):
    """Checkpoints are written at the log rows with an error."""
    return metrics(spark, sf).filter("status = 'error'").select("run_id", "seq", "step")


@query("checkpoint_list", sql("""
WITH c AS (SELECT *, last_value(loss IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cur FROM metrics)
SELECT run_id, seq, step, round(cur, 6) AS loss FROM c WHERE status = 'error'"""))
def checkpoint_list(spark, sf):
    return r6(J.checkpoint_losses(checkpoints(spark, sf), metrics(spark, sf)), "loss")


@query("dedupe_steps", sql("""
SELECT run_id, seq, step FROM (SELECT run_id, seq, step, lag(step) OVER (PARTITION BY run_id ORDER BY seq) AS p FROM metrics) t WHERE p IS NULL OR p <> step"""))
def dedupe_steps(spark, sf):
    return J.dedupe_steps(metrics(spark, sf).select("run_id", "seq", "step"))


@query("train_val_overlay", sql("""
WITH tr AS (SELECT run_id, step, avg(loss) AS train_loss FROM metrics WHERE status = 'training' GROUP BY ALL), va AS (SELECT run_id, step, avg(reward) AS val_loss FROM metrics WHERE status = 'error' GROUP BY ALL)
SELECT coalesce(tr.run_id, va.run_id) AS run_id, coalesce(tr.step, va.step) AS step, round(train_loss, 6) AS train_loss, round(val_loss, 6) AS val_loss
FROM tr FULL OUTER JOIN va ON tr.run_id = va.run_id AND tr.step = va.step"""))
def train_val_overlay(spark, sf):
    df = metrics(spark, sf)
    train = df.filter("status = 'training'").groupBy("run_id", "step").agg(F.avg("loss").alias("train_loss"))
    val = df.filter("status = 'error'").groupBy("run_id", "step").agg(F.avg("reward").alias("val_loss"))
    return r6(J.overlay(train, val), "train_loss", "val_loss")


@query("stop_reason", sql("""
WITH s AS (SELECT run_id, max(step) AS s, CAST(floor(avg(step) * 2) AS BIGINT) AS planned FROM metrics GROUP BY run_id)
SELECT run_id, s AS current_step, CASE WHEN s >= planned THEN 'max_train_steps_reached' ELSE 'epochs_completed_or_dataloader_exhausted' END AS stop_reason,
  CASE WHEN planned > 0 AND s < planned THEN s ELSE planned END AS total_steps FROM s"""))
def stop_reason(spark, sf):
    state = metrics(spark, sf).groupBy("run_id").agg(F.max("step").alias("current_step"), F.floor(F.avg("step") * 2).alias("planned"))
    return J.stop_reason(state, "current_step", "planned").drop("planned")


@query("corpus_budget", over(f"""WITH {INDEXED},
n AS (SELECT source, CAST(sum(len(regexp_extract_all(text, '<\\|eos\\|>|[\\p{{L}}\\p{{N}}_]+|[^\\s\\p{{L}}\\p{{N}}_]'))) AS BIGINT) AS tokens FROM indexed GROUP BY source)
SELECT source, tokens, tokens / 20.0::DOUBLE AS params, 6.0::DOUBLE * (tokens / 20.0::DOUBLE) * tokens AS flops, tokens * 4 AS bytes,
  round(6.0::DOUBLE * (tokens / 20.0::DOUBLE) * tokens / (312e12 * 0.3) / 86400 * 1e9, 6) AS nano_device_days FROM n""", "lines"))
def corpus_budget(spark, sf):
    out = J.corpus_budget(texts(spark, sf), ["source"], F.size(E.tokens(F.col("text"))))
    return out.withColumn("nano_device_days", F.round(F.col("device_days") * 1e9, 6)).drop("device_days")


@query("checkpoint_backfill", sql("""
WITH f AS (SELECT run_id, step, arg_min(seq, seq) AS first_seq FROM metrics GROUP BY ALL)
SELECT c.run_id, c.seq, c.step, round(coalesce(CASE WHEN c.seq % 2 = 0 THEN c.reward END, m.loss), 6) AS loss FROM metrics c JOIN f ON c.run_id = f.run_id AND c.step = f.step
JOIN metrics m ON m.run_id = f.run_id AND m.seq = f.first_seq WHERE c.status = 'error'"""))
def checkpoint_backfill(spark, sf):
    marks = metrics(spark, sf).filter("status = 'error'").select(
        "run_id", "seq", "step", F.when(F.col("seq") % 2 == 0, F.col("reward")).alias("loss"))
    return r6(J.checkpoint_backfill(marks, metrics(spark, sf)), "loss")
