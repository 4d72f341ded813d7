"""Index, split, shard, sample and batch queries over the corpus lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import paths as P
from millrace.functions.text import strip
from millrace.operators import groups as G, sampling as C
from millrace.operators.ordering import global_index
from millrace.plans.corpus import TEXT_OF, VALID, lines, s_trim
from millrace.plans.frames import frame, over, spread, table
from millrace.plans.group_stats import SCORED, scored
from millrace.plans.registry import query
from millrace.session import shared_dir
from millrace.sources import text as ST


def texts(spark, sf):
    return ST.jsonl_texts(lines(spark, sf).select("doc_id", "source", "line"))


# Surviving texts with their dense position, on the check side.
INDEXED = f"""{TEXT_OF}, kept AS (SELECT p.doc_id, d.source, {s_trim('p.text')} AS text FROM parsed p JOIN documents d ON p.doc_id = d.doc_id WHERE {s_trim('p.text')} <> ''),
indexed AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM kept)"""


def indexed(spark, sf, *columns):
    return global_index(texts(spark, sf).select("doc_id", *columns), "doc_id")


def sql(body):
    body = body.strip()
    rest = body[5:] if body.upper().startswith("WITH ") else None
    return over(f"WITH {INDEXED}{', ' + rest if rest else ' ' + body}", "lines")


def s_hash(*parts):
    return f"CAST(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15)) AS UBIGINT)"


@query("global_index", sql("""
SELECT 'texts' AS base, doc_id, idx FROM indexed UNION ALL
SELECT 'lines', doc_id, row_number() OVER (ORDER BY doc_id) - 1 FROM lines"""))
def index_both(spark, sf):
    kept = indexed(spark, sf).select(F.lit("texts").alias("base"), "doc_id", "idx")
    raw = global_index(lines(spark, sf).select("doc_id"), "doc_id").select(F.lit("lines").alias("base"), "doc_id", "idx")
    return kept.unionByName(raw)


@query("global_index_text", "SELECT p_name, p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS idx FROM part")
def global_index_text(spark, sf):
    return global_index(table(spark, sf, "part").select("p_name", "p_partkey"), "p_name", tie=["p_partkey"])


@query("holdout_split", sql("SELECT doc_id, idx, CASE WHEN idx % 10000 < 500 THEN 'val' ELSE 'train' END AS split FROM indexed"))
def holdout_split(spark, sf):
    return C.holdout_split(indexed(spark, sf), 0.05)


@query("shard_rows", sql("""
SELECT doc_id, idx, CASE WHEN idx % 10000 < 100 THEN 'val' ELSE 'train' END AS split, CAST(idx % 8 AS INT) AS shard FROM indexed"""))
def shard_rows(spark, sf):
    path = shared_dir(spark, "shards")
    C.write_shards(C.shard_rows(C.holdout_split(indexed(spark, sf), 0.01), 8), path)
    return spark.read.schema("doc_id bigint, idx bigint, split string, shard int").parquet(path)


@query("resume_from", sql("""
WITH half AS (SELECT idx % 4 AS shard, max(idx) + 1 AS next_idx FROM indexed WHERE doc_id < (SELECT avg(doc_id) FROM documents) GROUP BY 1)
SELECT doc_id, idx, CAST(idx % 4 AS INT) AS shard FROM indexed LEFT JOIN half ON idx % 4 = half.shard WHERE idx >= coalesce(next_idx, 0)"""))
def resume_from(spark, sf):
    df = C.shard_rows(indexed(spark, sf), 4)
    middle = table(spark, sf, "documents").agg(F.avg("doc_id").alias("m")).select("m").scalar()
    return C.resume_from(df, C.resume_state(df.filter(F.col("doc_id") < middle)), "idx").select("doc_id", "idx", "shard")


@query("head_limit", over("SELECT prompt_id, question FROM prompts WHERE question <> '' AND answer <> '' ORDER BY prompt_id LIMIT 120", "prompts"))
def head_limit(spark, sf):
    df = frame(spark, sf, "prompts").filter("question <> '' AND answer <> ''").select("prompt_id", "question")
    return C.head_limit(df, "prompt_id", 120)


@query("byte_cap", sql("""
SELECT * FROM (SELECT doc_id, strlen(text) + 1 AS bytes, CAST(sum(strlen(text) + 1) OVER (ORDER BY doc_id) AS BIGINT) AS total_bytes FROM indexed) t
WHERE total_bytes <= 250000"""))
def byte_cap(spark, sf):
    return ST.byte_cap(texts(spark, sf), "doc_id", F.col("text"), 250_000).select("doc_id", "bytes", "total_bytes")


@query("reservoir_sample", sql(f"""
SELECT doc_id, CASE WHEN length(text) > 500 THEN concat(substr(text, 1, 500), '...') ELSE text END AS shown FROM (
  SELECT doc_id, text FROM indexed ORDER BY {s_hash("'7'", "CAST(doc_id AS VARCHAR)")}, doc_id LIMIT 10) t"""))
def reservoir_sample(spark, sf):
    drawn = C.seeded_sample(texts(spark, sf).select("doc_id", "text"), "doc_id", 10, seed=7)
    return drawn.select("doc_id", C.shorten(F.col("text")).alias("shown"))


@query("batches", over(f"""
WITH o AS (SELECT prompt_id, row_number() OVER (ORDER BY {s_hash("'3'", "CAST(prompt_id AS VARCHAR)")}, prompt_id) - 1 AS pos, count(*) OVER () AS n FROM prompts)
SELECT prompt_id, CAST(floor(pos / 16) AS BIGINT) AS batch, pos FROM o WHERE floor(pos / 16) < floor(n / 16)""", "prompts"))
def batches(spark, sf):
    return C.batches(frame(spark, sf, "prompts").select("prompt_id"), "prompt_id", 16, seed=3, drop_last=True).select("prompt_id", "batch", "pos")


@query("oversample_refill", over(f"""
WITH scored AS ({SCORED}), grp AS (SELECT group_id, max(reward) > min(reward) AS used FROM scored GROUP BY group_id),
need AS (SELECT count(*) FILTER (WHERE NOT used) AS missing, max(group_id) + 1 AS first_id FROM grp),
pool AS (SELECT prompt_id, row_number() OVER (ORDER BY prompt_id) - 1 AS i, count(*) OVER () AS n FROM prompts),
slots AS (SELECT unnest(range(missing)) AS slot, first_id FROM need)
SELECT slot, slot + first_id AS new_group_id, prompt_id FROM slots JOIN pool
ON i = {s_hash("'0'", "'0'", "CAST(slot AS VARCHAR)")} % n""", "completions", "prompts"))
def oversample_refill(spark, sf):
    df = scored(spark, sf).select("group_id", "reward")
    groups = G.group_stats(df, ["group_id"]).select("group_id", (F.col("hi") != F.col("lo")).alias("used"))
    need = groups.agg(F.count_if(~F.col("used")).alias("missing"), (F.max("group_id") + 1).alias("first_id")).first()
    prompts = frame(spark, sf, "prompts").select("prompt_id")
    return C.refill(prompts, "prompt_id", need["missing"], need["first_id"])


@query("split_sizes", sql("""
SELECT count(*) AS total, CAST(floor(count(*) * 0.03) AS BIGINT) AS val_estimate, count(*) - CAST(floor(count(*) * 0.03) AS BIGINT) AS train_estimate,
  count(*) FILTER (WHERE idx % 10000 < 300) AS val_exact, count(*) FILTER (WHERE idx % 10000 >= 300) AS train_exact FROM indexed"""))
def split_sizes(spark, sf):
    return C.split_sizes(indexed(spark, sf), 0.03)


@query("plan_steps", sql("""
SELECT source, count(*) AS "rows", CAST(ceil(ceil(count(*) / 4) / 2) AS BIGINT) AS batches_per_epoch,
  CAST(ceil(ceil(ceil(count(*) / 4) / 2) / 3) * 2 AS BIGINT) AS total_steps FROM indexed GROUP BY source"""))
def plan_steps(spark, sf):
    return C.plan_steps(texts(spark, sf), processes=4, batch=2, grad_accum=3, epochs=2, by=["source"])


@query("plan_rollouts", over("""
SELECT count(*) AS num_prompts, least(count(*) * 2, 5000) AS planned_prompts, CAST(ceil(least(count(*) * 2, 5000) / 8) AS BIGINT) AS rollout_steps,
  CAST(ceil(count(*) / 8) * 2 AS BIGINT) AS uncapped_steps, CAST(ceil(least(count(*) * 2, 5000) / 8) * 2 AS BIGINT) AS optimizer_steps FROM prompts""", "prompts"))
def plan_rollouts(spark, sf):
    return C.plan_rollouts(frame(spark, sf, "prompts"), batch=4, processes=2, epochs=2, group_size=8, train_batch=4,
                           grad_accum=4, max_prompts=5000)


@query("shard_overlap_check", sql("""
WITH c AS (SELECT md5(text) AS sample_hash, count(*) AS copies, count(DISTINCT idx % 4) AS shards FROM indexed GROUP BY 1)
SELECT sample_hash, copies, shards, (SELECT CAST(sum(copies) - count(*) AS BIGINT) FROM c) AS duplicates FROM c WHERE copies > 1"""))
def shard_overlap_check(spark, sf):
    df = C.shard_rows(indexed(spark, sf, "text"), 4)
    totals = C.overlap_summary(df, F.md5("text"))
    return C.shard_overlap(df, F.md5("text")).withColumn("duplicates", totals.select("duplicates").scalar())
