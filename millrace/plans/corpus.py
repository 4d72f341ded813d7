"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import chat as D
from millrace.plans.frames import frame, over
from millrace.plans.registry import query
from millrace.plans.scoring import s_format
from millrace.session import shared_dir
from millrace.sources import runs as SR, text as ST

# SQL twin of a parsed line: null unless the line is a JSON object.
VALID = "json_valid(line) AND line <> ''"


def lines(spark, sf):
    return frame(spark, sf, "lines")


@query("scan_text", over("SELECT doc_id, trim(line) AS text FROM lines WHERE trim(line) <> ''", "lines"))
def scan_text(spark, sf):
    return ST.plain_texts(lines(spark, sf).select("doc_id", "line"))


TEXT_OF = f"""parsed AS (SELECT doc_id, coalesce(json_extract_string(CASE WHEN {VALID} THEN line END, '$.text'), '') AS text
  FROM lines WHERE {VALID})"""


def s_trim(x):
    return f"regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"


@query("scan_jsonl_text", over(f"""WITH {TEXT_OF}
SELECT 'strict' AS mode, doc_id, {s_trim('text')} AS text FROM parsed WHERE {s_trim('text')} <> ''
UNION ALL SELECT 'loose', doc_id, text FROM parsed""", "lines"))
def scan_jsonl_text(spark, sf):
    df = lines(spark, sf).select("doc_id", "line")
    strict = ST.jsonl_texts(df).select(F.lit("strict").alias("mode"), "doc_id", "text")
    return strict.unionByName(ST.jsonl_texts(df, strict=False).select(F.lit("loose").alias("mode"), "doc_id", "text"))


@query("scan_gzip", over(f"WITH {TEXT_OF} SELECT {s_trim('text')} AS text FROM parsed WHERE {s_trim('text')} <> ''", "lines"))
def scan_gzip(spark, sf):
    path = shared_dir(spark, "gzip") + "/corpus.jsonl.gz"
    ST.write_jsonl(lines(spark, sf), path, gzip=True)
    return ST.read_corpus(spark, path)


@query("scan_sft_audit", over(f"""
SELECT count(*) AS total_lines, count(*) FILTER (WHERE {VALID}) AS parsed, count(*) - count(*) FILTER (WHERE ok) AS skipped,
  count(*) FILTER (WHERE ok) AS valid_examples, (count(*) - count(*) FILTER (WHERE ok)) / count(*) > 0.1 AS warn
FROM (SELECT *, {VALID} AND {s_trim("coalesce(json_extract_string(CASE WHEN " + VALID + " THEN line END, '$.text'), '')")} <> '' AS ok FROM lines) t""", "lines"))
def scan_sft_audit(spark, sf):
    from millrace.functions import paths as P
    r = F.col("record")
    segments = D.instruct_segments(P.text_at(r, "lang"), P.text_at(r, "text"))
    return ST.audit(lines(spark, sf), D.text_only(segments))


@query("scan_rl_jsonl", over("SELECT prompt_id, question AS prompt, answer AS reference_answer, brand FROM prompts", "prompts"))
def scan_rl_jsonl(spark, sf):
    df = frame(spark, sf, "prompts")
    as_lines = df.select("prompt_id", F.to_json(F.struct("question", "answer", "brand")).alias("line"))
    blank = df.select("prompt_id", F.lit("  ").alias("line"))
    out = ST.prompt_records(as_lines.unionByName(blank), "question", "answer")
    return out.select("prompt_id", "prompt", "reference_answer",
                      F.try_variant_get("metadata", "$.brand", "string").alias("brand"))


@query("scan_records", over("SELECT prompt_id, question AS prompt, answer AS reference_answer, brand FROM prompts", "prompts"))
def scan_records(spark, sf):
    kv = F.create_map(*[x for k in ("question", "answer", "brand") for x in (F.lit(k), F.col(k))])
    out = ST.from_records(frame(spark, sf, "prompts").select("prompt_id", kv.alias("r")), "r", "question", "answer")
    return out.select("prompt_id", "prompt", "reference_answer", F.col("metadata")["brand"].alias("brand"))


@query("scan_preview", over(f"""
WITH first AS (SELECT doc_id, line FROM lines WHERE {VALID} ORDER BY doc_id LIMIT 20),
f AS (SELECT doc_id, unnest(['doc_id', 'text', 'lang', 'score']) AS field, line FROM first),
p AS (SELECT field, doc_id, json_extract_string(line, '$.' || field) AS val FROM f WHERE list_contains(json_keys(line), field))
SELECT field, count(*) AS present, coalesce(arg_min(coalesce(val, ''), doc_id), '') AS example FROM p GROUP BY field""", "lines"))
def scan_preview(spark, sf):
    return ST.field_preview(ST.records(lines(spark, sf).select("doc_id", "line")), "doc_id")


@query("scan_catalog", over("""
SELECT 'plain' AS kind, CAST(sum(strlen(line) + 1) AS BIGINT) AS bytes, true AS found FROM lines UNION ALL SELECT 'zipped', NULL, true""", "lines"))
def scan_catalog(spark, sf):
    root = shared_dir(spark, "catalog")
    ST.write_jsonl(lines(spark, sf), f"{root}/plain")
    df = ST.plain_texts(lines(spark, sf)).select(F.col("text").alias("line"))
    ST.write_jsonl(df, f"{root}/zipped", gzip=True)
    kind = F.when(F.col("name").endswith(".gz"), "zipped").otherwise("plain")
    sized = ST.catalog(spark, root).groupBy(kind.alias("kind")).agg(F.sum("bytes").alias("total"))
    return sized.select("kind", F.when(F.col("kind") == "plain", F.col("total")).alias("bytes"), (F.col("total") > 0).alias("found"))


CAP = 400_000


@query("extract_filtered", over(f"""
WITH ok AS (SELECT doc_id, line, TRY_CAST(json_extract_string(CASE WHEN {VALID} THEN line END, '$.score') AS DOUBLE) AS score,
    json_extract_string(CASE WHEN {VALID} THEN line END, '$.lang') AS l FROM lines WHERE {VALID}),
kept AS (SELECT doc_id, strlen(line) + 1 AS bytes FROM ok WHERE NOT coalesce(score < 0.3, false) AND (l IS NULL OR contains(lower(l), 'e'))),
run AS (SELECT doc_id, bytes, CAST(sum(bytes) OVER (ORDER BY doc_id) AS BIGINT) AS total_bytes FROM kept)
SELECT * FROM run WHERE total_bytes <= {CAP}""", "lines"))
def extract_filtered(spark, sf):
    path = shared_dir(spark, "extract")
    kept = ST.extract(lines(spark, sf).select("doc_id", "line"), "doc_id", "score", 0.3, "lang", "E", max_bytes=CAP)
    kept.write.parquet(path)
    return spark.read.parquet(path).select("doc_id", "bytes", "total_bytes")


@query("extract_rows", over(f"""
SELECT doc_id, line FROM (SELECT doc_id, line, row_number() OVER (ORDER BY doc_id) AS n FROM lines WHERE {VALID}) t WHERE n <= 150""", "lines"))
def extract_rows(spark, sf):
    return ST.extract(lines(spark, sf).select("doc_id", "line"), "doc_id", max_rows=150).select("doc_id", "line")


FIXED = ["step", "reward", "loss"]
METRICS_SCHEMA = "run_id string, seq bigint, step bigint, reward double, loss double, status string, prompts_used int, prompts_generated int, outcome int"


def metric_columns(prefix=""):
    return ("run_id, seq, step, round(reward, 6) AS reward, round(loss, 6) AS loss, status, prompts_used, "
            "prompts_generated, outcome")


def rounded(df):
    return df.withColumn("reward", F.round("reward", 6)).withColumn("loss", F.round("loss", 6))


@query("sink_metrics", over(f"SELECT {metric_columns()} FROM metrics", "metrics"))
def sink_metrics(spark, sf):
    path = shared_dir(spark, "metrics")
    SR.write_metrics(frame(spark, sf, "metrics"), path, FIXED)
    return rounded(SR.read_metrics(spark, path, METRICS_SCHEMA))


def metrics_text(spark, sf):
    """The metrics log as lines, some blank and some cut short."""
    df = frame(spark, sf, "metrics").drop("ts")
    whole = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    line = F.when(F.col("seq") % 89 == 7, "  ").when(F.col("seq") % 83 == 3, F.substring(whole, 1, 25)).otherwise(whole)
    return df.select(F.col("seq").alias("log_seq"), line.alias("line"))


@query("scan_metrics", over(f"SELECT {metric_columns()} FROM metrics WHERE seq % 89 <> 7 AND seq % 83 <> 3", "metrics"))
def scan_metrics(spark, sf):
    return rounded(SR.parse_metrics(metrics_text(spark, sf).select("line"), METRICS_SCHEMA))


@query("tail_lines", over(f"""SELECT {metric_columns()} FROM (SELECT * FROM metrics WHERE seq % 89 <> 7 ORDER BY seq DESC LIMIT 700) t
WHERE seq % 83 <> 3""", "metrics"))
def tail_lines(spark, sf):
    return rounded(SR.tail_lines(metrics_text(spark, sf), "log_seq", METRICS_SCHEMA, last=700).drop("log_seq"))


SAMPLES_SCHEMA = ("group_id bigint, part bigint, prompt string, keys array<string>, completions array<string>, "
                  "rewards array<double>, full_texts array<string>")


def with_format_reward(spark, sf):
    from millrace.functions.rewards import format_reward
    return frame(spark, sf, "completions").select("group_id", "comp_id", "prompt", "completion",
                                                  format_reward(F.col("completion")).alias("reward"))


@query("sink_samples", over(f"""SELECT group_id, comp_id, completion, {s_format('completion')} AS reward, concat(prompt, completion) AS full_text
FROM completions""", "completions"))
def sink_samples(spark, sf):
    path = shared_dir(spark, "samples")
    SR.write_samples(SR.sample_rows(with_format_reward(spark, sf), ["group_id"], "comp_id"), path, gzip=True)
    return SR.explode_samples(SR.read_samples(spark, path, SAMPLES_SCHEMA), ["group_id"])


@query("run_registry", over("""
WITH conf AS (SELECT run_id, min(ts) AS started, count(*) AS planned FROM metrics GROUP BY run_id),
stat AS (SELECT run_id, max(seq) AS last_seq, 'error' AS status FROM metrics WHERE status = 'error' AND reward > 0.35 GROUP BY run_id)
SELECT conf.run_id, planned, status, last_seq FROM conf LEFT JOIN stat ON conf.run_id = stat.run_id ORDER BY started DESC, conf.run_id LIMIT 200""", "metrics"))
def run_registry(spark, sf):
    m = frame(spark, sf, "metrics")
    root = shared_dir(spark, "runs")
    conf = m.groupBy("run_id").agg(F.min("ts").alias("started"), F.count(F.lit(1)).alias("planned"))
    stat = m.filter("status = 'error' AND reward > 0.35").groupBy("run_id").agg(
        F.max("seq").alias("last_seq"), F.lit("error").alias("status"))
    conf.write.partitionBy("run_id").json(f"{root}/config")
    stat.write.partitionBy("run_id").json(f"{root}/status")
    configs = spark.read.schema("started timestamp, planned bigint, run_id string").json(f"{root}/config")
    statuses = spark.read.schema("last_seq bigint, status string, run_id string").json(f"{root}/status")
    return SR.registry(configs, statuses, "started").select("run_id", "planned", "status", "last_seq")
