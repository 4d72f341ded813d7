"""Derived frames: the given tables reshaped into the inputs the operators expect.

Each frame is one SQL text that both engines run (two texts where the dialects differ). All are plain
projections, so they stay partition-local at any size. ``table`` is the only reader of the test tables.
Divisors such as 499 keep values off the exact ties on which the engines' rounding differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.functions.text import computed_once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """Deal out an input that has fewer splits than the cluster has cores; larger inputs pass unchanged.

    ``like`` is a batch read of the same files, for a stream whose splits are not known beforehand.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    splits = (df if like is None else like).rdd.getNumPartitions()
    return df.repartition(wanted) if splits < wanted else df


LINES_SPARK = """
SELECT doc_id, lang, source, CASE doc_id % 20
  WHEN 3 THEN ''
  WHEN 7 THEN '{{"text": broken'
  WHEN 11 THEN to_json(named_struct('lang', lang))
  WHEN 13 THEN to_json(named_struct('text', '  '))
  ELSE to_json(named_struct('doc_id', doc_id, 'text', text, 'lang', lang, 'score', CASE
    WHEN doc_id % 9 = 0 THEN NULL
    ELSE CAST((doc_id % 100) / 100.0D AS DOUBLE) END), map('ignoreNullFields', 'false')) END AS line
FROM {documents}"""
LINES_DUCK = """
SELECT doc_id, lang, source, CASE doc_id % 20
  WHEN 3 THEN ''
  WHEN 7 THEN '{"text": broken'
  WHEN 11 THEN CAST(json_object('lang', lang) AS VARCHAR)
  WHEN 13 THEN CAST(json_object('text', '  ') AS VARCHAR)
  ELSE CAST(json_object('doc_id', doc_id, 'text', text, 'lang', lang, 'score', CASE
    WHEN doc_id % 9 = 0 THEN NULL
    ELSE (doc_id % 100) / 100.0 END) AS VARCHAR) END AS line
FROM documents"""

MESSAGES = """
SELECT conv_id, turn, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END AS sender,
  role, text AS content
FROM {conversations}"""

PAIRS = """
SELECT q.conv_id, q.turn, q.text AS instruction, a.text AS output
FROM {conversations} q JOIN {conversations} a ON q.conv_id = a.conv_id AND q.turn + 1 = a.turn
WHERE q.role = 'user' AND a.role = 'assistant'"""

PROMPTS = """
SELECT p_partkey AS prompt_id, CASE
    WHEN p_partkey % 25 = 0 THEN ''
    ELSE concat('A crate holds ', CAST(p_size AS VARCHAR(20)), ' units. How many units are in ',
      CAST(p_partkey % 90 + 1 AS VARCHAR(20)), ' crates?') END AS question,
  CASE p_partkey % 6
    WHEN 0 THEN concat('Multiply. #### ', CAST(p_size * (p_partkey % 90 + 1) AS VARCHAR(20)))
    WHEN 1 THEN concat('Multiply. #### 1,', CAST(100 + p_size AS VARCHAR(20)))
    WHEN 2 THEN concat('It is ', CAST(p_size AS VARCHAR(20)), ' then ', CAST(p_size * 2 AS VARCHAR(20)))
    WHEN 3 THEN 'no number here'
    WHEN 4 THEN concat('#### -', CAST(p_size AS VARCHAR(20)), '.50')
    ELSE '' END AS answer,
  p_brand AS brand, p_type AS difficulty
FROM {part}"""

COMPLETIONS = """
SELECT group_id, comp_id, step, prompt, reference_answer, is_truncated, CASE v
  WHEN 0 THEN concat('<think>Step 1: we add the parts, therefore the total is found after a short check.</think><answer>', q, '</answer>')
  WHEN 1 THEN concat('<think>short</think><answer>', r, '</answer>')
  WHEN 2 THEN concat('<reasoning>', chr(10), '- first', chr(10), '- second', chr(10), '</reasoning>', chr(10), '<answer> ', r, ' </answer>')
  WHEN 3 THEN concat('The answer is ', r)
  WHEN 4 THEN concat('work ... #### ', q)
  WHEN 5 THEN concat('<answer>', q, '</answer><think>late</think>')
  WHEN 6 THEN concat('<think>open only, value 1,', q, ' or 3 5')
  WHEN 7 THEN concat('<think>a</think><think>b</think><answer>', q, '.5</answer>')
  WHEN 8 THEN concat('<answer>', r)
  WHEN 9 THEN concat('<think>x1 = ', q, ', x2 = ', r, '</think><answer>x1 = ', q, ', x2 = ', r, '</answer>')
  ELSE 'no digits at all' END AS completion
FROM (SELECT l_orderkey AS group_id,
    concat(CAST(l_linenumber AS VARCHAR(20)), '-', CAST(l_partkey AS VARCHAR(20)), '-', CAST(l_suppkey AS VARCHAR(20))) AS comp_id,
    CAST(l_orderkey % 64 AS INT) AS step,
    concat('User: How many for order ', CAST(l_orderkey AS VARCHAR(20)), '? Assistant:') AS prompt,
    CAST(l_orderkey % 50 + 1 AS VARCHAR(20)) AS reference_answer, CAST(l_orderkey % 50 + 1 AS VARCHAR(20)) AS r,
    CAST(CAST(l_quantity AS INT) AS VARCHAR(20)) AS q, (l_partkey + l_suppkey) % 11 AS v,
    l_linenumber = 7 AS is_truncated
  FROM {lineitem}) t"""

LOGPROBS_SPARK = """
SELECT vec_id, label AS group_id, 8 + vec_id % 9 AS prompt_len,
  transform(embedding, x -> -abs(CAST(x AS DOUBLE)) * 4.0D) AS logp_old,
  transform(embedding, x -> -abs(CAST(x AS DOUBLE)) * 4.4D) AS logp_new,
  transform(embedding, x -> -abs(CAST(x AS DOUBLE)) * 3.8D) AS logp_ref, (vec_id % 5) / 4.0D AS reward
FROM {embeddings}"""
LOGPROBS_DUCK = """
SELECT vec_id, label AS group_id, 8 + vec_id % 9 AS prompt_len,
  list_transform(embedding, lambda x: -abs(x::DOUBLE) * 4) AS logp_old,
  list_transform(embedding, lambda x: -abs(x::DOUBLE) * 4.4) AS logp_new,
  list_transform(embedding, lambda x: -abs(x::DOUBLE) * 3.8) AS logp_ref, (vec_id % 5) / 4.0 AS reward
FROM embeddings"""

METRICS = """
SELECT run_id, seq, step, ts, reward, CASE WHEN seq % 97 = 5 THEN CAST(NULL AS DOUBLE)
    ELSE 1 / (CAST(1.37 AS DOUBLE) + step) + reward / 10 END AS loss,
  status, prompts_used, prompts_generated, outcome
FROM (SELECT concat('run_', CAST(user_id % 10 AS VARCHAR(20))) AS run_id, event_id AS seq,
    CAST((event_id - event_id % 20) / 20 AS BIGINT) AS step, ts, value / 499 AS reward,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN CAST(NULL AS VARCHAR(20)) ELSE 'training' END AS status,
    CAST(event_id % 9 AS INT) AS prompts_used, 9 AS prompts_generated,
    CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS outcome
  FROM {events}) t"""

STEPS = """
SELECT user_id AS traj_id, event_id AS step_key, value / 499 AS reward,
  CAST(event_id % 100 AS DOUBLE) / 100 AS value, event_type = 'purchase' AS done
FROM {events}"""

_SPARK = {"lines": (LINES_SPARK, "documents"), "messages": (MESSAGES, "conversations"),
          "pairs": (PAIRS, "conversations"), "prompts": (PROMPTS, "part"), "completions": (COMPLETIONS, "lineitem"),
          "logprobs": (LOGPROBS_SPARK, "embeddings"), "metrics": (METRICS, "events"), "steps": (STEPS, "events")}


_COSTLY = {"lines": "line", "completions": "completion"}  # columns made here that a real log would store


def _shaped(spark: SparkSession, name: str, rows: DataFrame) -> DataFrame:
    text, source = _SPARK[name]
    df = spark.sql(text, **{source: rows})
    return computed_once(df, **{c: F.col(c)}) if (c := _COSTLY.get(name)) else df


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _shaped(spark, name, spread(table(spark, sf_dir, _SPARK[name][1])))


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same frame over a streaming read of its table, a file or a folder of files as in batch.

    A stream takes a single file by a pattern only, so the name is written as one.
    """
    source = _SPARK[name][1]
    batch = table(spark, sf_dir, source)
    rows = spark.readStream.schema(batch.schema).parquet(f"{sf_dir}/{source[:-1]}[{source[-1]}].parquet")
    return _shaped(spark, name, spread(rows, like=batch))


_DUCK = {"lines": LINES_DUCK, "logprobs": LOGPROBS_DUCK}
for _n, (_t, _s) in _SPARK.items():
    _DUCK.setdefault(_n, _t.replace("{" + _s + "}", _s))


def over(body: str, *names: str) -> str:
    """SQL over derived frames: ``body`` with the named frames as leading common table expressions.

    ``body`` may itself start with further ``WITH`` parts.
    """
    ctes = ",\n".join(f"{n} AS ({_DUCK[n]})" for n in names)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        recursive = body[5:15].upper().startswith("RECURSIVE ")
        rest = body[15:] if recursive else body[5:]
        return f"WITH {'RECURSIVE ' if recursive else ''}{ctes},\n{rest}"
    return f"WITH {ctes}\n{body}"
