"""Tokens, label masks and padding."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import tokens as E
from millrace.functions.text import computed_once
from millrace.operators import chat as D, masks as M
from millrace.plans.chat import EOS, SEGMENTS, messages
from millrace.plans.frames import frame, over, spread, table
from millrace.plans.indexing import INDEXED, texts
from millrace.plans.registry import query

LENGTH = 128
SFT_LENGTH = 512

S_WORDS = r"<\|eos\|>|[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
S_PIECES = r"<\|eos\|>|\s+|[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"


def s_id(t):
    return (f"CAST(CASE WHEN {t} = '{EOS}' THEN 1 ELSE CAST(('0x' || substr(md5({t}), 1, 8)) AS UBIGINT) % 50000 + 2 END AS INT)")


S_IDS = f"list_transform(list_slice(regexp_extract_all(text, '{S_WORDS}'), 1, {LENGTH}), lambda t: {s_id('t')})"


@query("encode_fixed", over(f"""WITH {INDEXED}
SELECT doc_id, list_concat(ids, list_transform(range({LENGTH} - len(ids)), lambda x: CAST(0 AS INT))) AS input_ids,
  list_transform(range({LENGTH}), lambda x: CASE WHEN x < len(ids) THEN 1 ELSE 0 END) AS attention_mask
FROM (SELECT doc_id, {S_IDS} AS ids FROM indexed) t""", "lines"))
def encode_fixed(spark, sf):
    df = texts(spark, sf).select("doc_id", E.encode_fixed(F.col("text"), LENGTH).alias("e"))
    return df.select("doc_id", "e.input_ids", "e.attention_mask")


@query("causal_labels", over(f"""WITH {INDEXED}
SELECT doc_id, list_concat(ids, list_transform(range({LENGTH} - len(ids)), lambda x: CAST(-100 AS INT))) AS labels
FROM (SELECT doc_id, {S_IDS} AS ids FROM indexed) t""", "lines"))
def causal_labels(spark, sf):
    df = encode_fixed(spark, sf)
    return df.select("doc_id", E.causal_labels(F.col("input_ids"), F.col("attention_mask")).alias("labels"))


# Check side: token rows of the rendered conversations with offsets; 'lab' is the label.
TOKENS = f"""{SEGMENTS}, txt AS (SELECT conv_id, string_agg(t, '' ORDER BY turn, part) AS text FROM placed GROUP BY conv_id),
pieces AS (SELECT conv_id, unnest(regexp_extract_all(text, '{S_PIECES}')) AS tok, generate_subscripts(regexp_extract_all(text, '{S_PIECES}'), 1) AS i FROM txt),
spotted AS (SELECT *, CAST(sum(length(tok)) OVER (PARTITION BY conv_id ORDER BY i) AS INT) AS e FROM pieces),
words AS (SELECT conv_id, tok, e, e - CAST(length(tok) AS INT) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS rn FROM spotted WHERE trim(replace(replace(tok, chr(10), ''), chr(9), '')) <> ''),
cut AS (SELECT *, rn - 1 AS pos FROM words WHERE rn <= {SFT_LENGTH}),
inside AS (SELECT DISTINCT c.conv_id, c.pos FROM cut c JOIN placed p ON c.conv_id = p.conv_id AND p.train AND c.s >= p.s AND c.e <= p.e),
lab AS (SELECT c.conv_id, c.pos, {s_id('c.tok')} AS id, i.pos IS NOT NULL AS train FROM cut c LEFT JOIN inside i ON c.conv_id = i.conv_id AND c.pos = i.pos),
alive AS (SELECT conv_id FROM lab GROUP BY conv_id HAVING bool_or(train))"""


def examples(spark, sf):
    df = computed_once(messages(spark, sf, None), r=D.render(D.chat_segments(F.col("messages"), EOS)))
    df = df.filter("r IS NOT NULL").select("conv_id", "r.text", "r.spans")
    return M.sft_examples(df, E.word_tokens(SFT_LENGTH), SFT_LENGTH)


@query("sft_labels", over(f"""WITH {TOKENS},
full_ AS (SELECT conv_id, pos, id, CASE WHEN train THEN id ELSE -100 END AS label, 1 AS m FROM lab WHERE conv_id IN (SELECT conv_id FROM alive)
  UNION ALL SELECT conv_id, p, 0, -100, 0 FROM (SELECT conv_id, max(pos) AS top FROM lab WHERE conv_id IN (SELECT conv_id FROM alive) GROUP BY conv_id) z, range({SFT_LENGTH}) r(p) WHERE p > top)
SELECT conv_id, list(CAST(id AS INT) ORDER BY pos) AS input_ids, list(CAST(m AS INT) ORDER BY pos) AS attention_mask, list(CAST(label AS INT) ORDER BY pos) AS labels FROM full_ GROUP BY conv_id""", "messages"))
def sft_labels(spark, sf):
    return examples(spark, sf)


@query("mask_report", over(f"""WITH {TOKENS}
SELECT conv_id, count(*) AS valid_tokens, count(*) FILTER (WHERE train) AS trainable_tokens, round(100.0 * count(*) FILTER (WHERE train) / count(*), 6) AS trainable_pct
FROM lab WHERE conv_id IN (SELECT conv_id FROM alive) GROUP BY conv_id""", "messages"))
def mask_report(spark, sf):
    out = M.mask_report(examples(spark, sf), "conv_id")
    return out.select("conv_id", F.col("valid_tokens").cast("bigint").alias("valid_tokens"),
                      F.col("trainable_tokens").cast("bigint").alias("trainable_tokens"), F.round("trainable_pct", 6).alias("trainable_pct"))


@query("mask_listing", over(f"""WITH {TOKENS}
SELECT conv_id, pos, id AS token_id, CASE WHEN train THEN 'TRAIN' ELSE 'MASKED' END AS marker FROM lab
WHERE conv_id IN (SELECT conv_id FROM alive) AND pos < 50""", "messages"))
def mask_listing(spark, sf):
    return M.mask_listing(examples(spark, sf), "conv_id").withColumn("pos", F.col("pos").cast("bigint"))


# Vectors of uneven length in batches of 16, cut from the log-probability frame.
VECTORS = """vectors AS (SELECT vec_id, CAST(floor(vec_id / 16) AS BIGINT) AS batch, prompt_len, list_slice(logp_new, 1, 20 + prompt_len) AS v FROM logprobs),
sizes AS (SELECT batch, max(len(v)) AS top, arg_min(prompt_len, vec_id) AS batch_prompt_len FROM vectors GROUP BY batch)"""


def vectors(spark, sf):
    return frame(spark, sf, "logprobs").select(
        "vec_id", F.floor(F.col("vec_id") / 16).alias("batch"), "prompt_len",
        F.slice("logp_new", F.lit(1), (F.col("prompt_len") + 20).cast("int")).alias("v"))


def rounded(c):
    return F.transform(c, lambda x: F.round(x, 6))


@query("pad_group", over(f"""WITH {VECTORS}
SELECT v.batch, vec_id, batch_prompt_len, list_transform(list_concat(list_transform(range(top - len(v)), lambda x: CAST(0 AS DOUBLE)), v), lambda x: round(x, 6)) AS v
FROM vectors v JOIN sizes s ON v.batch = s.batch""", "logprobs"))
def pad_group(spark, sf):
    return M.pad_group(vectors(spark, sf), "batch", "vec_id", "v", "prompt_len").withColumn("v", rounded("v"))


@query("unbatch", over(f"""WITH {VECTORS}
SELECT batch, row_number() OVER (PARTITION BY batch ORDER BY vec_id) - 1 AS pos, vec_id, prompt_len, list_transform(v, lambda x: round(x, 6)) AS v, '' AS text FROM vectors""", "logprobs"))
def unbatch(spark, sf):
    batched = M.collate(vectors(spark, sf), "batch", "vec_id", "prompt_len", "v")
    return M.unbatch(batched, "batch", "vec_id", "prompt_len", "v").withColumns(
        {"v": rounded("v"), "pos": F.col("pos").cast("bigint")})


S_COMPLETION = """ids AS (SELECT vec_id, 8 + vec_id % 9 AS prompt_len, list_transform(embedding, lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 1000) AS INT) % 23) AS ids FROM embeddings)"""


def completion_ids(spark, sf):
    ids = F.transform("embedding", lambda x: (F.floor(F.abs(x.cast("double")) * 1000) % 23).cast("int"))
    return spread(table(spark, sf, "embeddings")).select("vec_id", (8 + F.col("vec_id") % 9).alias("prompt_len"), ids.alias("ids"))


@query("trim_completion", f"""WITH {S_COMPLETION}
SELECT vec_id, list_filter(ids, lambda x: x <> 0) AS other_pad, CASE WHEN list_contains(ids, 3) THEN list_slice(ids, 1, list_position(ids, 3)) ELSE ids END AS same_pad FROM ids""")
def trim_completion(spark, sf):
    ids = F.col("ids")
    return completion_ids(spark, sf).select("vec_id", E.trim_completion(ids, 0, 1).alias("other_pad"),
                                            E.trim_completion(ids, 3, 3).alias("same_pad"))


@query("action_mask", f"""WITH {S_COMPLETION}
SELECT vec_id, list_transform(range(total - 1), lambda i: i >= prompt_len - 1) AS mask FROM (
  SELECT *, prompt_len + len(list_filter(ids, lambda x: x <> 0)) AS total FROM ids) t WHERE total >= 2""")
def action_mask(spark, sf):
    total = F.col("prompt_len") + F.size(E.trim_completion(F.col("ids"), 0, 1))
    out = completion_ids(spark, sf).select("vec_id", E.action_mask(total, F.col("prompt_len")).alias("mask"))
    return out.filter("mask IS NOT NULL")


@query("truncation_flag", f"""WITH {S_COMPLETION}
SELECT vec_id, len(list_filter(ids, lambda x: x <> 0)) >= 62 AS by_length, len(list_filter(ids, lambda x: x <> 0)) >= 62 OR vec_id % 7 = 0 AS by_either FROM ids""")
def truncation_flag(spark, sf):
    reason = F.when(F.col("vec_id") % 7 == 0, "length").otherwise("stop")
    return completion_ids(spark, sf).select("vec_id", E.is_truncated(F.col("ids"), 0, 62).alias("by_length"),
                                            E.is_truncated(F.col("ids"), 0, 62, reason).alias("by_either"))
