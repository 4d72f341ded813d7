"""Group statistics, replay and teacher queries over scored completions."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import rewards as R
from millrace.functions.text import computed_once
from millrace.operators import groups as G, selection as S
from millrace.plans.frames import frame, over, spread, table
from millrace.plans.registry import query
from millrace.plans.scoring import s_format, s_integer_reward
from millrace.session import written

# Scored completions: one reward per completion, used by every query here.
SCORED = (f"SELECT *, {s_format('completion')} + {s_integer_reward('completion', 'reference_answer')} AS reward, "
          "concat('run_', CAST(group_id % 4 AS VARCHAR)) AS run_id FROM completions")


def scored(spark, sf, once=False):
    """Scored completions. ``once`` for queries that filter on the reward (see ``computed_once``); the others
    leave the reward a plain expression, which the optimizer drops where it is not needed."""
    reward = R.guard(R.format_reward(F.col("completion"))) + R.guard(
        R.integer_reward(F.col("completion"), F.col("reference_answer")))
    run = F.concat(F.lit("run_"), (F.col("group_id") % 4).cast("string"))
    rows = frame(spark, sf, "completions").withColumn("run_id", run)
    return computed_once(rows, reward=reward) if once else rows.withColumn("reward", reward)


def sql(body: str) -> str:
    body = body.strip()
    rest = body[5:] if body.upper().startswith("WITH ") else None
    return over(f"WITH scored AS ({SCORED}){', ' + rest if rest else ' ' + body}", "completions")


HASH = "CAST(('0x' || substr(md5(concat_ws('|', {})), 1, 15)) AS UBIGINT)"


@query("group_advantage", sql("""
SELECT group_id, comp_id, round(CASE WHEN n = 1 THEN reward ELSE (reward - mean) / CASE WHEN std < 0.000001 THEN 1 ELSE std END END, 6) AS grpo,
  round(CASE WHEN n = 1 THEN reward ELSE reward - mean END, 6) AS drgrpo
FROM (SELECT *, count(*) OVER g AS n, avg(reward) OVER g AS mean, stddev_samp(reward) OVER g AS std FROM scored
  WINDOW g AS (PARTITION BY group_id)) t"""))
def group_advantage(spark, sf):
    df = scored(spark, sf).select("group_id", "comp_id", "reward")
    out, r = G.with_group_stats(df, ["group_id"], spread=["comp_id"]), F.col("reward")
    return out.select("group_id", "comp_id", F.round(G.advantage(r), 6).alias("grpo"),
                      F.round(G.advantage(r, use_std=False), 6).alias("drgrpo"))


@query("zero_gradient_filter", sql("""
SELECT group_id, comp_id, round(reward, 6) AS reward FROM scored
WHERE group_id IN (SELECT group_id FROM scored GROUP BY group_id HAVING count(DISTINCT reward) > 1)"""))
def zero_gradient_filter(spark, sf):
    df = written(scored(spark, sf).select("group_id", "comp_id", "reward"), "scored")  # read twice, scored once
    return G.zero_gradient_filter(df, ["group_id"], spread=["comp_id"]).withColumn("reward", F.round("reward", 6))


@query("batch_baseline", over("""
WITH m AS (SELECT avg(reward) AS mean, stddev_samp(reward) AS std FROM logprobs),
a AS (SELECT vec_id, (reward - mean) / (std + 1e-8) AS adv, list_slice(logp_new, prompt_len, 64) AS lp FROM logprobs, m)
SELECT vec_id, round(adv, 6) AS advantage, round(-adv * list_sum(lp) / len(lp), 6) AS loss FROM a""", "logprobs"))
def batch_baseline(spark, sf):
    df = frame(spark, sf, "logprobs").select("vec_id", "prompt_len", "logp_new", "reward")
    df = G.normalise_batch(df, "reward", "advantage", when_over=1e-8)
    acted = F.slice("logp_new", F.col("prompt_len").cast("int"), F.lit(64))
    total = F.aggregate(acted, F.lit(0.0), lambda a, x: a + x)
    return df.select("vec_id", F.round("advantage", 6).alias("advantage"),
                     F.round(-F.col("advantage") * total / F.size(acted), 6).alias("loss"))


@query("replay_fifo", sql("SELECT group_id, comp_id FROM scored ORDER BY group_id DESC, comp_id DESC LIMIT 1000"))
def replay_fifo(spark, sf):
    return G.replay_newest(scored(spark, sf).select("group_id", "comp_id"), ["group_id", "comp_id"], 1000)


@query("replay_stats", sql("""
SELECT count(*) AS size, count(DISTINCT group_id) AS num_groups, round(avg(reward), 6) AS returns_mean,
  round(stddev_samp(reward), 6) AS returns_std, round(max(reward), 6) AS returns_max, round(min(reward), 6) AS returns_min FROM scored"""))
def replay_stats(spark, sf):
    out = G.replay_stats(scored(spark, sf), "group_id")
    return out.select("size", "num_groups", *[F.round(c, 6).alias(c) for c in out.columns if c.startswith("returns")])


STORE = ("store AS (SELECT group_id, comp_id, prompt, completion, reward, row_number() OVER (PARTITION BY group_id ORDER BY "
         + HASH.format("'0', CAST(group_id AS VARCHAR), comp_id") + ", comp_id) AS slot FROM scored WHERE reward >= 0.5 QUALIFY slot <= 5)")


@query("success_store", sql(f"WITH {STORE} SELECT group_id, comp_id, slot, completion, round(reward, 6) AS reward FROM store"))
def success_store(spark, sf):
    out = G.success_store(scored(spark, sf, once=True), "group_id", "comp_id")
    return out.select("group_id", "comp_id", F.col("slot").cast("bigint").alias("slot"), "completion", F.round("reward", 6).alias("reward"))


@query("assign_teacher", sql(f"""WITH {STORE}, size AS (SELECT group_id, count(*) AS k FROM store GROUP BY group_id)
SELECT s.group_id, s.comp_id, t.completion AS teacher_completion, k IS NOT NULL AS has_teacher
FROM scored s LEFT JOIN size ON s.group_id = size.group_id
LEFT JOIN store t ON t.group_id = s.group_id AND t.slot = 1 + {HASH.format("'0', 'pick', CAST(s.group_id AS VARCHAR), s.comp_id")} % k"""))
def assign_teacher(spark, sf):
    rows, store = scored(spark, sf), G.success_store(scored(spark, sf, once=True), "group_id", "comp_id")
    out = G.assign_teacher(rows.select("group_id", "comp_id"), store, "group_id", "comp_id")
    return out.select("group_id", "comp_id", "teacher_completion", "has_teacher")


@query("reprompt", sql("""
SELECT group_id, comp_id, substr(concat('Here is the problem:', chr(10), 'How many for order ', CAST(group_id AS VARCHAR), '?', chr(10), chr(10),
  'Here is a successful solution for reference:', chr(10), completion, chr(10), chr(10), 'Now solve this problem step by step.',
  CASE WHEN is_truncated THEN concat(chr(10), 'Previous attempt feedback:', chr(10), 'Too long.', chr(10)) ELSE '' END), 1, 4096) AS text
FROM scored WHERE reward >= 0.5"""))
def reprompt(spark, sf):
    df = scored(spark, sf, once=True).filter(F.col("reward") >= 0.5)
    note = F.when(F.col("is_truncated"), "Too long.")
    return df.select("group_id", "comp_id", G.reprompt(F.col("prompt"), F.col("completion"), note).alias("text"))


@query("best_worst", sql("""
WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY reward DESC, comp_id) AS up,
  row_number() OVER (PARTITION BY group_id ORDER BY reward, comp_id) AS down FROM scored)
SELECT b.group_id, round(b.reward, 6) AS best_reward, b.completion AS best_completion,
  CASE WHEN w.reward < b.reward THEN round(w.reward, 6) END AS worst_reward, CASE WHEN w.reward < b.reward THEN w.completion END AS worst_completion
FROM ranked b JOIN ranked w ON b.group_id = w.group_id AND b.up = 1 AND w.down = 1"""))
def best_worst(spark, sf):
    out = G.best_worst(scored(spark, sf), "group_id", "comp_id")
    return out.select("group_id", "best_completion", "worst_completion",
                      *[F.round(c, 6).alias(c) for c in ("best_reward", "worst_reward")])


@query("reward_bands", sql("""
SELECT CASE WHEN reward > 0.5 THEN 'high' WHEN reward > 0 THEN 'middle' ELSE 'low' END AS band, count(*) AS n,
  max(length(completion)) AS longest FROM scored GROUP BY 1"""))
def reward_bands(spark, sf):
    df = scored(spark, sf, once=True).select(G.reward_band(F.col("reward")).alias("band"),
                                  F.length(G.preview_text(F.col("completion"))).alias("len"))
    return df.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max("len").cast("bigint").alias("longest"))


@query("rollout_counters", sql("""
WITH grp AS (SELECT run_id, step, group_id, count(*) AS n, sum(reward) AS s, max(reward) > min(reward) AS used FROM scored GROUP BY ALL),
st AS (SELECT run_id, step, sum(s) / sum(n) AS mean, CAST(sum(n) AS BIGINT) AS c, count(*) FILTER (WHERE used) AS u,
  CAST(coalesce(sum(n) FILTER (WHERE used), 0) AS BIGINT) AS e, CAST(floor(sum(n) / 4) AS BIGINT) AS p FROM grp GROUP BY ALL)
SELECT run_id, step, round(mean, 6) AS batch_reward_mean, c AS completions_generated, u AS prompts_used, e AS experiences_tuned,
  p AS prompts_generated, greatest(0, p - u) AS filtered_groups, CAST(sum(p) OVER w AS BIGINT) AS cum_prompts_generated,
  CAST(sum(u) OVER w AS BIGINT) AS cum_prompts_used, CAST(sum(c) OVER w AS BIGINT) AS cum_completions_generated,
  CAST(sum(e) OVER w AS BIGINT) AS cum_experiences_tuned
FROM st WINDOW w AS (PARTITION BY run_id ORDER BY step)"""))
def rollout_counters(spark, sf):
    out = G.rollout_counters(scored(spark, sf), "run_id", "step", "group_id", 4)
    return out.withColumn("batch_reward_mean", F.round("batch_reward_mean", 6))


@query("epoch_summary", over("""
SELECT run_id, CAST(floor(step / 100) AS BIGINT) AS epoch, round(coalesce(avg(reward), 0), 6) AS mean_reward, round(coalesce(avg(loss), 0), 6) AS mean_loss
FROM metrics GROUP BY ALL""", "metrics"))
def epoch_summary(spark, sf):
    df = frame(spark, sf, "metrics").withColumn("epoch", F.floor(F.col("step") / 100))
    return df.groupBy("run_id", "epoch").agg(
        F.round(F.coalesce(F.avg("reward"), F.lit(0.0)), 6).alias("mean_reward"),
        F.round(F.coalesce(F.avg("loss"), F.lit(0.0)), 6).alias("mean_loss"))


@query("attach_reference", over("SELECT prompt_id, question, answer, brand FROM prompts", "prompts"))
def attach_reference(spark, sf):
    df = frame(spark, sf, "prompts")
    return G.attach_reference(df.select("prompt_id", "question"), df.select("prompt_id", "answer", "brand"), "prompt_id")


STEP_ROWS = "SELECT traj_id, step_key, reward, value, done, row_number() OVER (PARTITION BY traj_id ORDER BY step_key) - 1 AS t FROM steps"


@query("gae", over(f"""
WITH RECURSIVE s AS (SELECT *, coalesce(lead(value) OVER (PARTITION BY traj_id ORDER BY step_key), 0) AS nv,
    count(*) OVER (PARTITION BY traj_id) AS n FROM ({STEP_ROWS}) u),
d AS (SELECT *, reward + 0.9 * nv * CASE WHEN done THEN 0 ELSE 1 END - value AS delta, 0.9 * 0.95 * CASE WHEN done THEN 0 ELSE 1 END AS c FROM s),
walk AS (SELECT traj_id, t, step_key, value, CAST(delta AS DOUBLE) AS adv FROM d WHERE t = n - 1
  UNION ALL SELECT d.traj_id, d.t, d.step_key, d.value, CAST(d.delta + d.c * walk.adv AS DOUBLE)
  FROM d JOIN walk ON d.traj_id = walk.traj_id AND d.t = walk.t - 1)
SELECT traj_id, step_key, round(adv, 6) AS advantage, round(adv + value, 6) AS returns FROM walk""", "steps"))
def gae(spark, sf):
    out = G.gae(frame(spark, sf, "steps"), "traj_id", "step_key", gamma=0.9, lam=0.95)
    return out.select("traj_id", "step_key", F.round("advantage", 6).alias("advantage"), F.round("returns", 6).alias("returns"))


@query("adv_normalise", over("""
SELECT step_key, round((reward - avg(reward) OVER ()) / (stddev_samp(reward) OVER () + 1e-8), 6) AS advantage FROM steps""", "steps"))
def adv_normalise(spark, sf):
    out = G.normalise_batch(frame(spark, sf, "steps").select("step_key", "reward"), "reward", "advantage")
    return out.select("step_key", F.round("advantage", 6).alias("advantage"))


@query("passrate_filter", sql("""
SELECT group_id, count(*) AS samples, round(avg(CASE WHEN reward >= 1 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate, max(reward) > min(reward) AS signal,
  max(reward) > min(reward) AND count(*) >= 3 AND avg(CASE WHEN reward >= 1 THEN 1.0 ELSE 0.0 END) < 1 AS kept FROM scored GROUP BY group_id"""))
def passrate_filter(spark, sf):
    out = S.passrate_filter(scored(spark, sf, once=True).select("group_id", "reward"), "group_id", threshold=1.0, least=3)
    return out.withColumn("pass_rate", F.round("pass_rate", 6))


@query("preference_pairs", sql("""
WITH p AS (SELECT group_id, arg_min(struct_pack(k := comp_id, c := completion, n := length(completion), r := reward), struct_pack(a := -reward, b := comp_id)) AS x,
  arg_min(struct_pack(k := comp_id, c := completion, n := length(completion), r := reward), struct_pack(a := reward, b := comp_id)) AS y FROM scored GROUP BY group_id)
SELECT group_id, x.k AS chosen_key, y.k AS rejected_key, x.c AS chosen, y.c AS rejected, round(x.r - y.r, 6) AS delta, CAST(abs(x.n - y.n) AS INT) AS apart
FROM p WHERE x.r - y.r >= 0.5 AND abs(x.n - y.n) <= 60"""))
def preference_pairs(spark, sf):
    df = scored(spark, sf, once=True).select("group_id", "comp_id", "completion", "reward")
    out = S.preference_pairs(df, "group_id", "comp_id", "completion", F.length("completion"), most_apart=60)
    return out.withColumn("delta", F.round("delta", 6))
