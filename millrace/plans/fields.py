"""Field paths, schema discovery, predicates, field mapping and templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import paths as P
from millrace.functions.text import strip
from millrace.operators import chat as D, fields as B
from millrace.plans.corpus import VALID, lines, s_trim
from millrace.plans.frames import frame, over
from millrace.plans.registry import query
from millrace.sources import text as ST


def conversation_records(spark, sf):
    """Each conversation as one VARIANT record: id, meta.turns, meta.tags, messages[].from/.value."""
    conv = D.assemble(frame(spark, sf, "messages").select("conv_id", "turn", "sender", "content"), "conv_id", "turn",
                      ["sender", "content"])
    shaped = F.to_json(F.struct(
        F.col("conv_id").alias("id"),
        F.struct(F.size("messages").alias("turns"), F.array(F.lit("a"), F.lit(" "), F.lit("b")).alias("tags")).alias("meta"),
        F.transform("messages", lambda m: F.struct(m["sender"].alias("from"), m["content"].alias("value"))).alias("messages")))
    return conv.select("conv_id", F.parse_json(shaped).alias("record"))


@query("nested_get", over("""
SELECT conv_id, CAST(count(*) AS VARCHAR) AS turns, arg_min(content, turn) AS first_text, arg_min(content, turn) FILTER (WHERE turn >= 1) AS second_text,
  string_agg(sender, ',' ORDER BY turn) AS senders, CAST(NULL AS VARCHAR) AS missing FROM messages GROUP BY conv_id""", "messages"))
def nested_get(spark, sf):
    r = F.col("record")
    one = lambda path: F.try_variant_get(P.get(r, path), "$", "string")
    senders = F.array_join(F.try_variant_get(P.get(r, "messages[].from [список]"), "$", "array<string>"), ",")
    return conversation_records(spark, sf).select(
        "conv_id", one("meta.turns").alias("turns"), one("messages[0].value").alias("first_text"),
        one("messages[1].value").alias("second_text"), senders.alias("senders"), one("meta.nothing.x").alias("missing"))


@query("as_text", over("""
SELECT conv_id, string_agg(content, chr(10) ORDER BY turn) AS all_text, concat('a', chr(10), 'b') AS tags,
  CAST(count(*) AS VARCHAR) AS turns, '' AS missing FROM messages WHERE true GROUP BY conv_id""", "messages"))
def as_text(spark, sf):
    r = F.col("record")
    return conversation_records(spark, sf).select(
        "conv_id", P.text_at(r, "messages[].value").alias("all_text"), P.text_at(r, "meta.tags").alias("tags"),
        P.text_at(r, "meta.turns").alias("turns"), P.text_at(r, "nope").alias("missing"))


@query("leaf_paths", over("""
SELECT 'id' AS path, 'leaf' AS kind, 0 AS depth, count(DISTINCT conv_id) AS present FROM messages UNION ALL
SELECT 'meta', 'folder', 0, count(DISTINCT conv_id) FROM messages UNION ALL
SELECT 'meta.tags', 'list', 1, count(DISTINCT conv_id) FROM messages UNION ALL
SELECT 'meta.tags[0]', 'leaf', 2, count(DISTINCT conv_id) FROM messages UNION ALL
SELECT 'meta.turns', 'leaf', 1, count(DISTINCT conv_id) FROM messages UNION ALL
SELECT 'messages', 'list', 0, count(DISTINCT conv_id) FROM messages UNION ALL
SELECT 'messages[].from', 'leaf', 1, count(DISTINCT conv_id) FROM messages UNION ALL
SELECT 'messages[].value', 'leaf', 1, count(DISTINCT conv_id) FROM messages""", "messages"))
def leaf_paths(spark, sf):
    return B.field_tree(conversation_records(spark, sf), "record")


@query("detect_format", over("""
SELECT 'chat' AS format, 'messages' AS messages_field, 'from' AS role_field, 'value' AS content_field,
  max(CASE WHEN contains(sender, 'system') THEN sender END) AS system_role, max(CASE WHEN sender IN ('user', 'human') THEN sender END) AS user_role,
  max(CASE WHEN sender IN ('assistant', 'gpt', 'bot') THEN sender END) AS assistant_role FROM messages""", "messages"))
def detect_format(spark, sf):
    return B.detect_format(conversation_records(spark, sf), "record")


SCORE = f"TRY_CAST(json_extract_string(CASE WHEN {VALID} THEN line END, '$.score') AS DOUBLE)"
LANG = f"json_extract_string(CASE WHEN {VALID} THEN line END, '$.lang')"


@query("filter_min_score", over(f"SELECT doc_id FROM lines WHERE {VALID} AND ({SCORE} IS NULL OR {SCORE} >= 0.4)", "lines"))
def filter_min_score(spark, sf):
    r = ST.records(lines(spark, sf).select("doc_id", "line"))
    return r.filter(ST.min_score(F.try_variant_get("record", "$.score", "string"), 0.4)).select("doc_id")


@query("filter_contains", over(f"SELECT doc_id FROM lines WHERE {VALID} AND ({LANG} IS NULL OR contains(lower({LANG}), 'e'))", "lines"))
def filter_contains(spark, sf):
    r = ST.records(lines(spark, sf).select("doc_id", "line"))
    return r.filter(ST.has_word(F.try_variant_get("record", "$.lang", "string"), "E")).select("doc_id")


@query("filter_min_chars", over(f"SELECT conv_id, turn FROM messages WHERE length({s_trim('content')}) >= 100", "messages"))
def filter_min_chars(spark, sf):
    return B.min_chars(frame(spark, sf, "messages"), "content", 100).select("conv_id", "turn")


@query("filter_required", over("SELECT prompt_id, question, answer FROM prompts WHERE question <> '' AND answer <> ''", "prompts"))
def filter_required(spark, sf):
    return B.required(frame(spark, sf, "prompts"), "question", "answer").select("prompt_id", "question", "answer")


@query("filter_answer_range", over("""
SELECT prompt_id, f FROM (SELECT prompt_id, CASE
  WHEN contains(answer, '####') THEN replace(regexp_extract(answer, '####\\s*(-?[0-9]+(?:,[0-9]+)?(?:\\.[0-9]+)?)', 1), ',', '')
  WHEN regexp_matches(answer, '[0-9]') THEN regexp_extract_all(answer, '[0-9]+')[-1] ELSE answer END AS f FROM prompts) t
WHERE TRY_CAST(f AS DOUBLE) IS NULL OR TRY_CAST(f AS DOUBLE) BETWEEN 0 AND 500""", "prompts"))
def filter_answer_range(spark, sf):
    from millrace.functions.extract import final_answer
    df = frame(spark, sf, "prompts").select("prompt_id", final_answer(F.col("answer")).alias("f"))
    return B.answer_range(df, "f", 0, 500)


def open_records(spark, sf):
    """The prompts as JSON records whose field names differ from row to row."""
    q, a = F.col("question"), F.col("answer")
    rest = [F.col("brand"), F.col("difficulty")]
    keep_null = {"ignoreNullFields": "false"}
    kind = F.col("prompt_id") % 4
    line = (F.when(kind == 0, F.to_json(F.struct("question", "answer", *rest)))
            .when(kind == 1, F.to_json(F.struct(F.lit(None).cast("string").alias("question"), q.alias("problem"), a.alias("solution"), *rest), keep_null))
            .when(kind == 2, F.to_json(F.struct(q.alias("prompt"), a.alias("response"), *rest)))
            .otherwise(F.to_json(F.struct(q.alias("other"), a.alias("answer"), *rest))))
    return frame(spark, sf, "prompts").select("prompt_id", P.parse(line).alias("record"))


MAPPED = """mapped AS (SELECT *, CASE WHEN prompt_id % 4 IN (1, 3) THEN '' ELSE question END AS raw_prompt, answer AS raw_answer,
  CASE WHEN contains(answer, '####') THEN replace(regexp_extract(answer, '####\\s*(-?[0-9]+(?:,[0-9]+)?(?:\\.[0-9]+)?)', 1), ',', '') ELSE answer END AS ref
  FROM prompts)"""


@query("map_fields", over(f"WITH {MAPPED} SELECT prompt_id, raw_prompt, raw_answer, ref AS reference FROM mapped", "prompts"))
def map_fields(spark, sf):
    return B.map_fields(open_records(spark, sf)).drop("record")


@query("apply_template", over(f"""WITH {MAPPED}
SELECT prompt_id, concat('Q: ', raw_prompt, ' [', brand, '|', ref, '] {{{{metadata.nothing}}}}') AS prompt FROM mapped""".replace("{{{{", "{{").replace("}}}}", "}}"), "prompts"))
def apply_template(spark, sf):
    df = B.map_fields(open_records(spark, sf))
    return df.select("prompt_id", B.fill_template(
        "Q: {{prompt}} [{{metadata.brand}}|{{reference}}] {{metadata.nothing}}", F.col("raw_prompt"), F.col("reference"),
        F.col("record")).alias("prompt"))


@query("collect_metadata", over(f"""WITH {MAPPED}
SELECT prompt_id, raw_answer AS full_answer, raw_prompt, brand, difficulty, CASE prompt_id % 4 WHEN 0 THEN 6 WHEN 1 THEN 7 WHEN 2 THEN 6 ELSE 6 END AS n_keys
FROM mapped""", "prompts"))
def collect_metadata(spark, sf):
    df = B.map_fields(open_records(spark, sf))
    m = B.metadata_map(F.col("record"), F.col("raw_prompt"), F.col("raw_answer"))
    df = df.select("prompt_id", m.alias("m"))
    return df.select("prompt_id", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("full_answer", "raw_prompt", "brand", "difficulty")],
                     F.size("m").alias("n_keys"))


@query("adapt_source", over("""
SELECT prompt_id, CASE prompt_id % 4 WHEN 0 THEN 'gsm8k' WHEN 1 THEN 'gsm8k_ru' WHEN 2 THEN 'math_ru' ELSE 'mgsm' END AS source, question, answer FROM prompts""", "prompts"))
def adapt_source(spark, sf):
    df = frame(spark, sf, "prompts")
    sources = {}
    for i, (name, (q, a)) in enumerate(B.SOURCE_FIELDS.items()):
        sources[name] = df.filter(F.col("prompt_id") % 4 == i).select("prompt_id", F.col("question").alias(q), F.col("answer").alias(a))
    return B.adapt_sources(sources, ["prompt_id"])
