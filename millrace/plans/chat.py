"""Chat and instruction rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.text import computed_once, strip
from millrace.operators import chat as D, sampling as C
from millrace.plans.frames import frame, over
from millrace.plans.registry import query

EOS = "<|eos|>"
ROLES = {"system": "system", "human": "user", "gpt": "assistant"}

# Check side: messages with standard roles and the rank of each system message; 'sys' is the system text used.
STD = """std AS (SELECT conv_id, turn, CASE sender WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE 'system' END AS role, content FROM messages
  WHERE sender IN ('system', 'human', 'gpt')),
head AS (SELECT conv_id, count(*) FILTER (WHERE role = 'assistant') > 0 AS has_bot, count(*) FILTER (WHERE role = 'system') > 0 AS has_sys,
  arg_min(content, turn) FILTER (WHERE role = 'system') AS said FROM std GROUP BY conv_id)"""


def messages(spark, sf, default_system=D.SYSTEM):
    """Conversations with standard-role messages."""
    df = frame(spark, sf, "messages").select("conv_id", "turn", F.col("sender").alias("role"), "content")
    conv = D.assemble(df, "conv_id", "turn", ["role", "content"])
    return conv.select("conv_id", D.normalise_roles(F.col("messages"), ROLES, default_system=default_system).alias("messages"))


@query("normalise_roles", over(f"""WITH {STD}
SELECT conv_id, string_agg(role || ':' || content, '|' ORDER BY turn) AS flat FROM (
  SELECT conv_id, turn, role, content FROM std UNION ALL SELECT conv_id, -1, 'system', 'You are a helpful assistant.' FROM head WHERE NOT has_sys) t GROUP BY conv_id""", "messages"))
def normalise_roles(spark, sf):
    flat = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return messages(spark, sf).select("conv_id", flat.alias("flat"))


SEGMENTS = f"""{STD},
seg AS (SELECT conv_id, -1 AS turn, 0 AS part, concat(CASE WHEN trim(coalesce(said, '')) <> '' THEN said ELSE 'You are a helpful assistant.' END, chr(10), chr(10)) AS t, false AS train FROM head WHERE has_bot
  UNION ALL SELECT s.conv_id, turn, 0, concat('### User:', chr(10), content, chr(10), chr(10)), false FROM std s JOIN head h ON s.conv_id = h.conv_id AND has_bot WHERE role = 'user'
  UNION ALL SELECT conv_id, turn, 0, '### Assistant:', false FROM std WHERE role = 'assistant'
  UNION ALL SELECT conv_id, turn, 1, concat(chr(10), content, chr(10), chr(10)), true FROM std WHERE role = 'assistant'
  UNION ALL SELECT conv_id, 1000000, 0, '{EOS}', true FROM head WHERE has_bot),
placed AS (SELECT *, CAST(sum(length(t)) OVER w AS INT) AS e, CAST(sum(length(t)) OVER w AS INT) - CAST(length(t) AS INT) AS s FROM seg WINDOW w AS (PARTITION BY conv_id ORDER BY turn, part))"""


@query("chat_tags", over(f"WITH {SEGMENTS} SELECT conv_id, string_agg(t, '' ORDER BY turn, part) AS text FROM placed GROUP BY conv_id", "messages"))
def chat_tags(spark, sf):
    df = computed_once(messages(spark, sf, None), text=D.text_only(D.chat_segments(F.col("messages"), EOS)))
    return df.filter("text IS NOT NULL").select("conv_id", "text")


@query("spans", over(f"WITH {SEGMENTS} SELECT conv_id, s AS start, e AS \"end\", t AS span_text FROM placed WHERE train", "messages"))
def spans(spark, sf):
    df = computed_once(messages(spark, sf, None), r=D.render(D.chat_segments(F.col("messages"), EOS)))
    long = df.filter("r IS NOT NULL").select("conv_id", "r.text", F.explode("r.spans").alias("s"))
    return long.select("conv_id", "s.start", "s.end", F.substring(
        F.col("text"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("span_text"))


@query("instruct_tags", over(f"""
SELECT conv_id, turn, concat('You are a helpful assistant.', chr(10), chr(10), '### User:', chr(10), instruction, chr(10), chr(10), '### Assistant:', chr(10), output, chr(10), chr(10), '{EOS}') AS text,
  CAST(length(instruction) + length(concat('You are a helpful assistant.', '..', '### User:', '.', '..', '### Assistant:')) AS INT) AS start, CAST(length(instruction) + length(output) + 3 + length(concat('You are a helpful assistant.', '..', '### User:', '.', '..', '### Assistant:')) AS INT) AS "end"
FROM pairs WHERE trim(output) <> ''""", "pairs"))
def instruct_tags(spark, sf):
    r = D.render(D.instruct_segments(F.col("instruction"), F.col("output"), eos=EOS))
    df = computed_once(frame(spark, sf, "pairs"), r=r).filter("r IS NOT NULL")
    first = F.try_element_at("r.spans", F.lit(1))
    return df.select("conv_id", "turn", "r.text", first["start"].alias("start"), first["end"].alias("end"))


CHATML = f"""{STD}, rendered AS (SELECT conv_id, turn, role, concat('<|im_start|>', role, chr(10), content, '<|im_end|>', chr(10)) AS t FROM (
  SELECT conv_id, turn, role, content FROM std UNION ALL SELECT conv_id, -1, 'system', 'You are a helpful assistant.' FROM head WHERE NOT has_sys) u)"""


@query("chatml_render", over(f"WITH {CHATML} SELECT conv_id, string_agg(t, '' ORDER BY turn) AS text FROM rendered GROUP BY conv_id", "messages"))
def chatml_render(spark, sf):
    return messages(spark, sf).select("conv_id", D.chatml(F.col("messages")).alias("text"))


@query("instruct_chatml", over("""
SELECT conv_id, turn, concat('<|im_start|>system', chr(10), 'You are a helpful assistant.<|im_end|>', chr(10), '<|im_start|>user', chr(10), instruction,
  CASE WHEN conv_id % 2 = 0 THEN concat(chr(10), chr(10), 'Input: ', CAST(conv_id AS VARCHAR)) ELSE '' END,
  '<|im_end|>', chr(10), '<|im_start|>assistant', chr(10), output, '<|im_end|>') AS text FROM pairs""", "pairs"))
def instruct_chatml(spark, sf):
    extra = F.when(F.col("conv_id") % 2 == 0, F.col("conv_id").cast("string"))
    return frame(spark, sf, "pairs").select(
        "conv_id", "turn", D.chatml_instruct(F.col("instruction"), F.col("output"), extra).alias("text"))


@query("template_spans", over(f"""WITH {CHATML}, placed AS (SELECT *, CAST(sum(length(t)) OVER w AS INT) AS e, CAST(sum(length(t)) OVER w - length(t) AS INT) AS s
  FROM rendered WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT p.conv_id, s + 22 AS start, e AS "end" FROM placed p WHERE role = 'assistant'
UNION ALL SELECT p.conv_id, max(e), max(e) + {len(EOS)} FROM placed p JOIN head h ON p.conv_id = h.conv_id AND has_bot GROUP BY p.conv_id""", "messages"))
def template_spans(spark, sf):
    df = computed_once(messages(spark, sf), r=D.chatml_spans(F.col("messages"), EOS)).filter("r IS NOT NULL")
    return df.select("conv_id", F.explode("r.spans").alias("s")).select("conv_id", "s.start", "s.end")


@query("rl_prompt", over("""
SELECT prompt_id, 2 AS n_messages, concat('Be brief.', chr(10), chr(10), 'User: ', question, chr(10), chr(10), 'Assistant:') AS custom_text,
  position('<answer> answer here </answer>' IN d) > 0 AND ends_with(d, question || chr(10) || chr(10) || 'Assistant:') AS deepseek_ok
FROM (SELECT *, concat('...<answer> answer here </answer>', chr(10), chr(10), 'User: ', question, chr(10), chr(10), 'Assistant:') AS d FROM prompts) t""", "prompts"))
def rl_prompt(spark, sf):
    q = F.col("question")
    custom, deep = D.reasoning_prompt(q, custom="Be brief."), D.reasoning_prompt(q)
    ok = deep["text"].contains("<answer> answer here </answer>") & F.endswith(deep["text"], F.concat(q, F.lit("\n\nAssistant:")))
    return frame(spark, sf, "prompts").select("prompt_id", F.size(deep["messages"]).alias("n_messages"),
                                              custom["text"].alias("custom_text"), ok.alias("deepseek_ok"))


@query("plain_render", over(f"""WITH {STD}
SELECT conv_id, concat(string_agg(concat(upper(substr(role, 1, 1)), substr(role, 2), ': ', content, chr(10), chr(10)), '' ORDER BY turn), 'Assistant: ') AS text FROM std GROUP BY conv_id""", "messages"))
def plain_render(spark, sf):
    return messages(spark, sf, None).select("conv_id", D.plain(F.col("messages"), generation=True).alias("text"))


@query("format_preview", over(f"""WITH {SEGMENTS}, txt AS (SELECT conv_id, string_agg(t, '' ORDER BY turn, part) AS text FROM placed GROUP BY conv_id)
SELECT conv_id, text FROM txt WHERE length(trim(text)) >= 10
ORDER BY CAST(('0x' || substr(md5(concat_ws('|', '5', CAST(conv_id AS VARCHAR))), 1, 15)) AS UBIGINT), conv_id LIMIT 10""", "messages"))
def format_preview(spark, sf):
    df = chat_tags(spark, sf).filter(F.length(strip(F.col("text"))) >= 10)
    return C.seeded_sample(df, "conv_id", 10, seed=5)


@query("message_text", over("""
SELECT conv_id, CASE conv_id % 3 WHEN 1 THEN count(*)::VARCHAR ELSE arg_min(content, turn) END AS text,
  CASE conv_id % 3 WHEN 0 THEN coalesce(arg_max(content, turn) FILTER (WHERE role = 'user'), arg_max(content, turn))
    WHEN 1 THEN count(*)::VARCHAR ELSE arg_min(content, turn) END AS question
FROM messages GROUP BY conv_id""", "messages"))
def message_text(spark, sf):
    df = frame(spark, sf, "messages").select("conv_id", "turn", "role", "content")
    conv = D.assemble(df, "conv_id", "turn", ["role", "content"])
    kind = F.col("conv_id") % 3
    # A list of messages, a plain text, or a single message.
    v = (F.when(kind == 0, F.parse_json(F.to_json("messages")))
         .when(kind == 1, F.to_variant_object(F.array(F.size("messages").cast("string"))))
         .otherwise(F.parse_json(F.to_json(F.try_element_at("messages", F.lit(1))))))
    v = F.when(kind == 1, F.try_variant_get(v, "$[0]", "variant")).otherwise(v)
    df = conv.select("conv_id", v.alias("v"))
    return df.select("conv_id", D.message_text(F.col("v")).alias("text"), D.last_user_message(F.col("v")).alias("question"))
