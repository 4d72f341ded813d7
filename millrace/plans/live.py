"""Streaming queries: each runs over the whole table as a stream and is read back as a batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import rewards as R
from millrace.functions.text import computed_once
from millrace.plans.corpus import METRICS_SCHEMA, VALID, metrics_text, s_trim
from millrace.plans.fields import LANG, SCORE
from millrace.plans.frames import over, stream
from millrace.plans.group_stats import STORE, sql as scored_sql
from millrace.plans.registry import query
from millrace.plans.run_logs import LATEST
from millrace.session import shared_dir
from millrace.sources import runs as SR, text as ST
from millrace.streaming import live as K


def through(spark, df, label, mode="append"):
    folder = shared_dir(spark, label)
    K.run_to_end(df, folder, mode)
    return K.written(spark, folder, df.schema)


def kept(spark, df, label, reduce):
    folder = shared_dir(spark, label)
    K.reduce_to_end(df, folder, reduce)
    return K.reduced_view(spark, folder, df.schema, reduce)


def folded(spark, df, label, table):
    folder = shared_dir(spark, label)
    table.run(df, folder)
    return table.view(df, folder)


def scored_stream(spark, sf):
    reward = R.guard(R.format_reward(F.col("completion"))) + R.guard(
        R.integer_reward(F.col("completion"), F.col("reference_answer")))
    rows = stream(spark, sf, "completions").select("group_id", "comp_id", "completion", "reference_answer")
    return computed_once(rows, reward=reward).drop("reference_answer")


@query("stream_metrics_latest", over(LATEST.replace("FROM metrics)", "FROM (SELECT * FROM metrics WHERE seq % 89 <> 7 AND seq % 83 <> 3) m)")
                                     .replace("CAST(0 AS DOUBLE) AS current_lr,", ""), "metrics"))
def stream_metrics_latest(spark, sf):
    df = stream(spark, sf, "metrics").drop("ts")
    whole = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    line = F.when(F.col("seq") % 89 == 7, "  ").when(F.col("seq") % 83 == 3, F.substring(whole, 1, 25)).otherwise(whole)
    last = folded(spark, SR.parse_metrics(df.select(line.alias("line")), METRICS_SCHEMA), "latest", K.folded_latest())
    return last.select("run_id", "rows", F.col("step").alias("current_step"), F.round("reward", 6).alias("reward"),
                       F.round("loss", 6).alias("current_loss"), F.coalesce("status", F.lit("training")).alias("status"))


@query("stream_extract", over(f"""SELECT doc_id, strlen(line) AS bytes FROM lines
WHERE {VALID} AND ({SCORE} IS NULL OR {SCORE} >= 0.3) AND ({LANG} IS NULL OR contains(lower({LANG}), 'e'))""", "lines"))
def stream_extract(spark, sf):
    kept = ST.extract(stream(spark, sf, "lines").select("doc_id", "line"), "doc_id", "score", 0.3, "lang", "E")
    return through(spark, kept, "extract").select("doc_id", F.octet_length("line").cast("bigint").alias("bytes"))


@query("stream_score", scored_sql("""
SELECT group_id, count(*) AS n, round(min(reward), 6) AS lo, round(max(reward), 6) AS hi, count(*) >= 4 AS complete, max(reward) <> min(reward) AS kept
FROM scored GROUP BY group_id"""))
def stream_score(spark, sf):
    last = folded(spark, scored_stream(spark, sf), "score", K.folded_signal(4))
    return last.withColumns({"lo": F.round("lo", 6), "hi": F.round("hi", 6)})


@query("stream_replay", over("""
SELECT run_id, seq, round(reward, 6) AS reward FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS r FROM metrics) t WHERE r <= 64""", "metrics"))
def stream_replay(spark, sf):
    rows = stream(spark, sf, "metrics").select("run_id", "seq", "reward")
    return kept(spark, rows, "replay", K.newest(64)).withColumn("reward", F.round("reward", 6))


@query("stream_success_store", scored_sql(f"WITH {STORE} SELECT group_id, comp_id, completion, round(reward, 6) AS reward FROM store"))
def stream_success_store(spark, sf):
    return kept(spark, scored_stream(spark, sf), "success", K.successes()).withColumn("reward", F.round("reward", 6))


@query("stream_dedupe_steps", over("SELECT DISTINCT run_id, step FROM metrics", "metrics"))
def stream_dedupe_steps(spark, sf):
    return through(spark, K.dedupe_steps(stream(spark, sf, "metrics")), "dedupe").select("run_id", "step")


@query("stream_rates", over("""
WITH w AS (SELECT run_id, reward, prompts_generated, CAST(floor(epoch_us(ts) / 60000000) AS BIGINT) - unnest(range(10)) AS minute FROM metrics)
SELECT run_id, minute * 60 AS window_start, round(avg(reward), 6) AS reward, count(*) AS n, round(sum(prompts_generated) / 600.0, 6) AS prompts_per_second
FROM w GROUP BY run_id, minute""", "metrics"))
def stream_rates(spark, sf):
    last = folded(spark, stream(spark, sf, "metrics"), "rates", K.folded_rates())
    return last.select("run_id", F.unix_seconds("window_start").alias("window_start"), F.round("reward", 6).alias("reward"), "n",
                       F.round("prompts_per_second", 6).alias("prompts_per_second"))
