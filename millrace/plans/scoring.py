"""Answer extraction and rewards over the completion frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import extract as X, rewards as R, rules as U
from millrace.operators import groups as G, scoring as S
from millrace.plans.frames import frame, over
from millrace.plans.registry import query

KEYS = ["group_id", "comp_id"]


def C():
    return F.col("completion")


def REF():
    return F.col("reference_answer")



# ---- SQL pieces for the check side -------------------------------------------------------------
def s_strip(x):
    return f"regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"


def s_body(x, tag):
    return (f"CASE WHEN regexp_matches({x}, '(?s)<{tag}>.*?</{tag}>') THEN "
            + s_strip(f"regexp_extract({x}, '(?s)<{tag}>(.*?)</{tag}>', 1)") + " END")


def s_number(x):
    t = f"regexp_replace({s_strip(x)}, '([0-9])\\s+([0-9])', '\\1\\2', 'g')"
    for _ in range(2):
        t = f"regexp_replace({t}, ',([0-9]{{1,2}})([^0-9]|$)', '.\\1\\2', 'g')"
    t = f"regexp_replace({t}, '([0-9]),([0-9]{{3}})', '\\1\\2', 'g')"
    return (f"coalesce(TRY_CAST(regexp_extract({t}, '[-+]?[0-9]+\\.?[0-9]*') AS DOUBLE), "
            f"TRY_CAST(regexp_extract({t}, '[-+]?\\.[0-9]+') AS DOUBLE))")


def s_integer(x):
    return (f"TRY_CAST(coalesce(nullif(regexp_extract({x}, '####\\s*(-?[0-9]+)', 1), ''), "
            f"nullif(regexp_extract({x}, '(?i)(?:the answer is|answer is)\\s*(-?[0-9]+)', 1), ''), "
            f"nullif(regexp_extract({x}, '<answer>\\s*(-?[0-9]+)\\s*</answer>', 1), ''), "
            f"regexp_extract_all({x}, '-?[0-9]+')[-1]) AS DECIMAL(38,0))")


def s_count(x, tag):
    return f"len(string_split({x}, '{tag}')) - 1"


def s_format(x, tag="think"):
    return (f"CASE WHEN least({s_count(x, f'<{tag}>')}, {s_count(x, f'</{tag}>')}) = 1 "
            f"AND least({s_count(x, '<answer>')}, {s_count(x, '</answer>')}) = 1 "
            f"AND strpos({x}, '</{tag}>') < strpos({x}, '<answer>') THEN CAST(0.2 AS DOUBLE) "
            f"WHEN (contains({x}, '<{tag}>') AND contains({x}, '</{tag}>')) "
            f"OR (contains({x}, '<answer>') AND contains({x}, '</answer>')) THEN CAST(0.1 AS DOUBLE) "
            f"ELSE CAST(0 AS DOUBLE) END")


def s_integer_reward(x, ref, tag="think"):
    a, b = s_integer(x), s_integer(ref)
    return (f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN CAST(0 AS DOUBLE) ELSE least(CAST(1 AS DOUBLE), "
            f"CASE WHEN {a} = {b} THEN CAST(1 AS DOUBLE) WHEN abs({a} - {b}) = 1 THEN CAST(0.3 AS DOUBLE) "
            f"ELSE CAST(0 AS DOUBLE) END + CASE WHEN contains({x}, '<{tag}>') AND contains({x}, '</{tag}>') "
            f"THEN CAST(0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) END")


def s_reasoning(x, tag="think", cap=0.3):
    b = s_body(x, tag)
    words = " OR ".join(f"contains(lower(b), '{w}')" for w in
                        ("therefore", "because", "thus", "hence", "so", "we get", "we find", "calculate", "solve", "equals"))
    return (f"(SELECT CASE WHEN coalesce(b, '') = '' THEN CAST(0 AS DOUBLE) ELSE least(CAST({cap} AS DOUBLE), "
            f"CASE WHEN len(regexp_extract_all(b, '\\S+')) >= 10 THEN CAST(0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END "
            f"+ CASE WHEN regexp_matches(b, '[0-9]+[.)]\\s') OR regexp_matches(b, '[-•]\\s') "
            f"OR regexp_matches(lower(b), 'step\\s*[0-9]+') OR regexp_matches(lower(b), 'firstly|secondly') "
            f"THEN CAST(0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END "
            f"+ CASE WHEN {words} THEN CAST(0.05 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) END "
            f"FROM (SELECT {b} AS b))")


def s_roots(x):
    return (f"list_sort(list_transform(CASE WHEN regexp_matches({x}, 'x[0-9]*\\s*=\\s*[-+]?[0-9]+') "
            f"THEN regexp_extract_all({x}, 'x[0-9]*\\s*=\\s*([-+]?[0-9]+(?:\\.[0-9]+)?)', 1) "
            f"ELSE regexp_extract_all({x}, '[-+]?[0-9]+(?:\\.[0-9]+)?') END, lambda r: CAST(r AS DOUBLE)))")


def s_response(x):
    return (f"coalesce(CASE WHEN regexp_matches({x}, '(?is)<answer>\\s*(.*?)\\s*</answer>') THEN "
            + s_strip(f"regexp_extract({x}, '(?is)<answer>\\s*(.*?)\\s*</answer>', 1)") + " END, "
            f"replace(nullif(regexp_extract({x}, '####\\s*(-?[0-9]+(?:,[0-9]{{3}})*(?:\\.[0-9]+)?)', 1), ''), ',', ''), "
            f"CASE WHEN contains({x}, '####') THEN nullif(regexp_extract(string_split({x}, '####')[-1], '-?[0-9]+(?:\\.[0-9]+)?'), '') END, "
            f"regexp_extract_all({x}, '-?[0-9]+(?:\\.[0-9]+)?')[-1])")


def s_mix(x="completion", ref="reference_answer"):
    return (f"({s_format(x)} * 1.0 + {s_reasoning(x)} * 0.5 + {s_integer_reward(x, ref)} * 2.0) "
            "/ CAST(3.5 AS DOUBLE)")


def per_row(value: str, name: str) -> str:
    return over(f"SELECT group_id, comp_id, {value} AS {name} FROM completions", "completions")


def scored(spark, sf, column, name):
    return frame(spark, sf, "completions").select(*KEYS, column.alias(name))


# ---- extraction --------------------------------------------------------------------------------
@query("extract_tags", over(
    f"SELECT group_id, comp_id, {s_body('completion', 'think')} AS think, {s_body('completion', 'reasoning')} AS reasoning, "
    f"{s_body('completion', 'answer')} AS answer FROM completions", "completions"))
def extract_tags(spark, sf):
    return frame(spark, sf, "completions").select(
        *KEYS, X.reasoning_body(C()).alias("think"), X.reasoning_body(C(), "simple").alias("reasoning"),
        X.answer_body(C()).alias("answer"))


@query("extract_number", per_row(s_number("completion"), "number"))
def extract_number(spark, sf):
    return scored(spark, sf, X.number_in(C()), "number")


@query("final_answer", over("""
SELECT prompt_id, CASE
  WHEN regexp_matches(answer, '####\\s*-?[0-9]') THEN replace(regexp_extract(answer, '####\\s*(-?[0-9]+(?:,[0-9]+)?(?:\\.[0-9]+)?)', 1), ',', '')
  WHEN regexp_matches(answer, '[0-9]') THEN replace(regexp_extract_all(answer, '-?[0-9]+(?:,[0-9]+)?(?:\\.[0-9]+)?')[-1], ',', '')
  ELSE trim(answer) END AS final FROM prompts""", "prompts"))
def final_answer(spark, sf):
    return frame(spark, sf, "prompts").select("prompt_id", X.final_answer(F.col("answer")).alias("final"))


@query("gsm8k_answer", per_row(s_integer("completion"), "number"))
def gsm8k_answer(spark, sf):
    return scored(spark, sf, X.integer_answer(C()), "number")


@query("normalise_math", over(f"""
SELECT group_id, comp_id, CASE WHEN contains(t, '.') THEN regexp_replace(regexp_replace(t, '0+$', ''), '\\.+$', '') ELSE t END AS normal
FROM (SELECT group_id, comp_id, {s_strip("replace(" + s_strip("replace(" + s_strip("replace(" + s_strip("replace(lower(a), 'meters', '')") + ", 'km', '')") + ", 'kg', '')") + ", '$', '')")} AS t
  FROM (SELECT group_id, comp_id, {s_body('completion', 'answer')} AS a FROM completions) u) v""", "completions"))
def normalise_math(spark, sf):
    return scored(spark, sf, X.normal_form(X.answer_body(C())), "normal")


@query("parse_roots", per_row(s_roots("completion"), "roots"))
def parse_roots(spark, sf):
    return scored(spark, sf, X.roots(C()), "roots")


@query("extract_response", per_row(s_response("completion"), "response"))
def extract_response(spark, sf):
    return scored(spark, sf, X.response_answer(C()), "response")


@query("split_hash_answer", over("""
SELECT prompt_id, trim(string_split(answer, '####')[-1]) AS truth,
  CASE WHEN contains(answer, '####') THEN regexp_extract(trim(replace(string_split(answer, '####')[-1], ',', '')), '^[^ ]*') ELSE answer END AS truth_word
FROM prompts""", "prompts"))
def split_hash_answer(spark, sf):
    a = F.col("answer")
    return frame(spark, sf, "prompts").select("prompt_id", X.after_hash(a).alias("truth"), X.after_hash_word(a).alias("truth_word"))


# ---- rewards -----------------------------------------------------------------------------------
@query("reward_format", over(
    f"SELECT group_id, comp_id, {s_format('completion')} AS deepseek, {s_format('completion', 'reasoning')} AS simple FROM completions",
    "completions"))
def reward_format(spark, sf):
    return frame(spark, sf, "completions").select(
        *KEYS, R.format_reward(C()).alias("deepseek"), R.format_reward(C(), "simple").alias("simple"))


@query("reward_reasoning", over(
    f"SELECT group_id, comp_id, round({s_reasoning('completion')}, 6) AS deepseek, "
    f"round({s_reasoning('completion', 'reasoning')}, 6) AS simple FROM completions", "completions"))
def reward_reasoning(spark, sf):
    return frame(spark, sf, "completions").select(
        *KEYS, F.round(R.reasoning_reward(C()), 6).alias("deepseek"),
        F.round(R.reasoning_reward(C(), "simple"), 6).alias("simple"))


@query("reward_truncation", per_row(
    "CASE WHEN NOT is_truncated THEN CAST(0 AS DOUBLE) WHEN contains(completion, '<answer>') OR contains(completion, '</answer>') "
    "THEN CAST(-0.5 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END", "reward"))
def reward_truncation(spark, sf):
    return scored(spark, sf, R.truncation_reward(C(), F.col("is_truncated")), "reward")


@query("reward_math", over(f"""
SELECT group_id, comp_id, CASE WHEN abs(a - b) < 0.0001 THEN CAST(1 AS DOUBLE) WHEN abs(a - b) < 0.5 THEN CAST(0.5 AS DOUBLE)
  ELSE CAST(0 AS DOUBLE) END AS reward
FROM (SELECT group_id, comp_id, {s_number("(" + s_body('completion', 'answer') + ")")} AS a, {s_number('reference_answer')} AS b FROM completions) t""",
    "completions"))
def reward_math(spark, sf):
    return scored(spark, sf, R.math_reward(C(), REF()), "reward")


@query("reward_gsm8k", per_row(s_integer_reward("completion", "reference_answer"), "reward"))
def reward_gsm8k(spark, sf):
    return scored(spark, sf, R.integer_reward(C(), REF()), "reward")


@query("reward_expression", over(f"""
SELECT group_id, comp_id, CASE WHEN body IS NULL THEN CAST(0 AS DOUBLE)
  WHEN a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN abs(a - b) < 0.0001 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
  WHEN len(ra) > 0 AND len(rb) > 0 THEN CASE WHEN len(ra) <> len(rb) THEN CAST(0 AS DOUBLE) ELSE
    CAST(len(list_filter(list_zip(ra, rb), lambda p: abs(p[1] - p[2]) < 0.0001)) AS DOUBLE) / len(rb) END
  WHEN lower(body) = lower(reference_answer) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS reward
FROM (SELECT group_id, comp_id, body, reference_answer, {s_number('body')} AS a, {s_number('reference_answer')} AS b,
    {s_roots('body')} AS ra, {s_roots('reference_answer')} AS rb
  FROM (SELECT *, {s_body('completion', 'answer')} AS body FROM completions) u) v""", "completions"))
def reward_expression(spark, sf):
    return scored(spark, sf, R.expression_reward(C(), REF()), "reward")


@query("reward_combined", over(
    f"SELECT group_id, comp_id, round({s_mix()}, 6) AS reward, "
    f"round({s_format('completion')} + {s_reasoning('completion')} * 0.5 + {s_integer_reward('completion', 'reference_answer')} * 2, 6) AS plain_sum "
    "FROM completions", "completions"))
def reward_combined(spark, sf):
    parts = S.default_parts()
    df = S.with_components(frame(spark, sf, "completions"), parts)
    mix = {n: (F.col(n), S.DEFAULT_WEIGHTS[n]) for n in parts}
    return df.select(*KEYS, F.round(R.combine(mix), 6).alias("reward"), F.round(R.combine(mix, False), 6).alias("plain_sum"))


@query("reward_components", over(f"""
SELECT component, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS hi FROM (
  SELECT 'format' AS component, {s_format('completion')} AS value FROM completions UNION ALL
  SELECT 'reasoning', {s_reasoning('completion')} FROM completions UNION ALL
  SELECT 'answer', {s_integer_reward('completion', 'reference_answer')} FROM completions) t GROUP BY component""", "completions"))
def reward_components(spark, sf):
    parts = S.default_parts()
    long = S.component_long(S.with_components(frame(spark, sf, "completions"), parts), list(parts))
    return long.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"),
                                         F.max("value").alias("hi"))


@query("reward_rules", over("""
SELECT group_id, comp_id, round(
  1.0 * CASE WHEN contains(completion, '<reasoning>') AND contains(completion, '</reasoning>') AND contains(completion, '<answer>')
    AND contains(completion, '</answer>') THEN 1 ELSE 0 END
  + 2.0 * CASE WHEN abs(TRY_CAST(regexp_extract(completion, '<answer>\\s*([0-9]+)\\s*</answer>', 1) AS DOUBLE)
      - TRY_CAST(reference_answer AS DOUBLE)) <= 0.01 THEN 1 ELSE 0 END
  + 0.5 * CASE WHEN length(r) BETWEEN 50 AND 2000 THEN least(length(r) / CAST(200 AS DOUBLE), 1) ELSE 0 END, 6) AS reward,
  round(CASE WHEN t = '' THEN 0 ELSE least(length(t) / CAST(500 AS DOUBLE), 1) END, 6) AS formula_reward
FROM (SELECT *, regexp_extract(completion, '(?s)<reasoning>(.*?)</reasoning>', 1) AS r,
  regexp_extract(completion, '(?s)<think>(.*?)</think>', 1) AS t FROM completions) u""", "completions"))
def reward_rules(spark, sf):
    think = [{"reward_formula": U.PRESET_RULES["formula"]["reward_formula"],
              "extractors": [{"name": "reasoning", "pattern": r"<think>(.*?)</think>", "flags": "DOTALL"}]}]
    return frame(spark, sf, "completions").select(
        *KEYS, F.round(U.rule_reward(U.DEFAULT_RULES, C(), REF()), 6).alias("reward"),
        F.round(U.rule_reward(think, C(), REF()), 6).alias("formula_reward"))


CONDITIONS = {
    "has_text": {"type": "contains", "value": "answer is {{reference}}"},
    "lacks_text": {"type": "not_contains", "value": "<think>"},
    "fits": {"type": "matches", "pattern": r"####\s*\d+"},
    "fits_not": {"type": "not_matches", "pattern": "therefore"},
    "same": {"type": "equals", "value": "no digits at all  "},
    "same_number": {"type": "equals_numeric", "left": "{{response}}", "right": "{{reference}}", "tolerance": 0.01},
    "over": {"type": "greater", "left": "{{reference}}", "value": 25},
    "under": {"type": "less", "left": "{{reference}}", "value": 10},
    "mid_length": {"type": "length_between", "min": 20, "max": 60},
    "long": {"type": "length_min", "min": 60},
    "short": {"type": "length_max", "max": 16},
    "unknown": {"type": "no_such_kind"},
}


@query("rule_conditions", over("""
SELECT group_id, comp_id, contains(completion, concat('answer is ', reference_answer)) AS has_text,
  NOT contains(completion, '<think>') AS lacks_text, regexp_matches(completion, '####\\s*[0-9]+') AS fits,
  NOT regexp_matches(completion, 'therefore') AS fits_not, completion = 'no digits at all' AS same,
  coalesce(abs(TRY_CAST(regexp_replace(completion, '[^0-9.\\-]', '', 'g') AS DOUBLE) - CAST(reference_answer AS DOUBLE)) <= 0.01, false) AS same_number,
  CAST(reference_answer AS DOUBLE) > 25 AS "over", CAST(reference_answer AS DOUBLE) < 10 AS "under",
  length(completion) BETWEEN 20 AND 60 AS mid_length, length(completion) >= 60 AS "long", length(completion) <= 16 AS short,
  false AS unknown FROM completions""", "completions"))
def rule_conditions(spark, sf):
    values = {"response": C(), "reference": REF(), "prompt": F.col("prompt")}
    return frame(spark, sf, "completions").select(
        *KEYS, *[U.condition(c, values).alias(n) for n, c in CONDITIONS.items()])


@query("rule_formula", over("""
SELECT group_id, comp_id, round(least(length(completion) / CAST(200 AS DOUBLE), 1), 6) AS share,
  CASE WHEN regexp_extract(completion, '<answer>([^<]*)', 1) = reference_answer THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS equal_text,
  round(coalesce(1 / nullif(CAST(reference_answer AS DOUBLE) - 7, 0), 0), 6) AS inverse,
  CAST(abs(CAST(reference_answer AS INT) - 20) AS DOUBLE) AS gap, CAST(0 AS DOUBLE) AS refused FROM completions""", "completions"))
def rule_formula(spark, sf):
    pulled = F.regexp_extract(C(), r"<answer>([^<]*)", 1)
    values = {"response": C(), "reference": REF(), "prompt": F.col("prompt"), "extracted.a": pulled}
    texts = {"share": "min(len({{response}}) / 200, 1.0)", "equal_text": "{{extracted.a}} == {{reference}}",
             "inverse": "1 / (float({{reference}}) - 7)", "gap": "abs(int({{reference}}) - 20)",
             "refused": "__import__('os').getcwd()"}
    return frame(spark, sf, "completions").select(
        *KEYS, *[(F.round(U.formula(t, values), 6) if n in ("share", "inverse") else U.formula(t, values)).alias(n)
                 for n, t in texts.items()])


@query("rule_substitute", per_row(
    "concat('[', prompt, '|', completion, '|', reference_answer, '|', CAST(group_id AS VARCHAR), ']')", "filled"))
def rule_substitute(spark, sf):
    values = {"response": C(), "reference": REF(), "prompt": F.col("prompt"), "metadata.order": F.col("group_id")}
    return scored(spark, sf, U.substitute("[{{prompt}}|{{response}}|{{reference}}|{{metadata.order}}]", values), "filled")


@query("reward_answer_tag", over("""
SELECT group_id, comp_id, CASE WHEN regexp_matches(completion, '(?is)<answer>\\s*.+?\\s*</answer>') THEN CAST(1 AS DOUBLE)
    WHEN contains(lower(completion), '<answer>') THEN CAST(0.3 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS tags,
  CASE WHEN regexp_matches(completion, '####\\s*-?[0-9]+') THEN CAST(1 AS DOUBLE) WHEN contains(completion, '####') THEN CAST(0.3 AS DOUBLE)
    ELSE CAST(0 AS DOUBLE) END AS hash FROM completions""", "completions"))
def reward_answer_tag(spark, sf):
    return frame(spark, sf, "completions").select(*KEYS, R.tag_reward(C()).alias("tags"), R.tag_reward(C(), False).alias("hash"))


@query("reward_correctness", over(f"""
SELECT group_id, comp_id, CASE WHEN found IS NULL THEN CAST(-1 AS DOUBLE) WHEN guess IS NULL OR truth IS NULL THEN
    CASE WHEN lower(trim(found)) = lower(trim(reference_answer)) THEN CAST(3 AS DOUBLE) ELSE CAST(-0.5 AS DOUBLE) END
  WHEN guess = truth THEN CAST(3 AS DOUBLE) WHEN truth <> 0 AND guess / truth >= 0.9 AND guess / truth <= 1.1 THEN CAST(1 AS DOUBLE)
  ELSE CAST(-0.5 AS DOUBLE) END AS reward
FROM (SELECT *, TRY_CAST(replace(trim(found), ',', '') AS DOUBLE) AS guess, TRY_CAST(replace(reference_answer, ',', '') AS DOUBLE) AS truth
  FROM (SELECT *, {s_response('completion')} AS found FROM completions) u) v""", "completions"))
def reward_correctness(spark, sf):
    return scored(spark, sf, R.correctness_reward(C(), REF()), "reward")


@query("reward_constant", over(
    "SELECT group_id, comp_id, CAST(0.25 AS DOUBLE) AS constant, CASE WHEN contains(completion, '####') THEN CAST(1 AS DOUBLE) "
    "ELSE CAST(-1 AS DOUBLE) END AS \"binary\" FROM completions", "completions"))
def reward_constant(spark, sf):
    return frame(spark, sf, "completions").select(
        *KEYS, R.constant_reward(0.25).alias("constant"), R.binary_reward(C().contains("####"), 1.0, -1.0).alias("binary"))


@query("reward_overlong", per_row(
    "CASE WHEN length(completion) > 80 THEN CAST(-1 AS DOUBLE) WHEN length(completion) >= 30 THEN round((length(completion) - 30) / CAST(50 AS DOUBLE) * -1, 6) "
    "ELSE CAST(0 AS DOUBLE) END", "reward"))
def reward_overlong(spark, sf):
    return scored(spark, sf, F.round(R.overlong_penalty(F.length(C()), 80, 50), 6), "reward")


@query("reward_guard", per_row(
    "coalesce(TRY_CAST(regexp_extract(completion, '<answer>([0-9]+)</answer>', 1) AS DOUBLE), CAST(0 AS DOUBLE))", "reward"))
def reward_guard(spark, sf):
    raw = F.regexp_extract(C(), r"<answer>([0-9]+)</answer>", 1).try_cast("double")
    return scored(spark, sf, R.guard(F.coalesce(raw, F.lit(float("nan")))), "reward")


@query("udf_reward", per_row(
    "CASE WHEN length(completion) = 0 THEN CAST(0 AS DOUBLE) ELSE round(length(reference_answer) / CAST(length(completion) AS DOUBLE), 6) END", "reward"))
def udf_reward(spark, sf):
    share = R.register_reward("share", lambda completion, reference: len(reference) / len(completion))
    return scored(spark, sf, F.round(share(C(), REF()), 6), "reward")


@query("eval_accuracy", over(f"""
SELECT round(avg(CASE WHEN r >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(r), 6) AS mean_reward, count(*) AS samples
FROM (SELECT {s_integer_reward('completion', 'reference_answer')} AS r FROM completions ORDER BY group_id, comp_id LIMIT 100) t""", "completions"))
def eval_accuracy(spark, sf):
    df = frame(spark, sf, "completions").select(F.struct(*KEYS).alias("k"), R.integer_reward(C(), REF()).alias("reward"))
    out = S.accuracy(df, "k")
    return out.select(F.round("accuracy", 6).alias("accuracy"), F.round("mean_reward", 6).alias("mean_reward"), "samples")


# ---- flagship ----------------------------------------------------------------------------------
@query("signal_groups", over(f"""
SELECT group_id, count(*) AS n, round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS std, round(min(r), 6) AS lo, round(max(r), 6) AS hi
FROM (SELECT group_id, {s_format('completion')} + {s_integer_reward('completion', 'reference_answer')} AS r FROM completions) t
GROUP BY group_id HAVING max(r) <> min(r)""", "completions"))
def signal_groups(spark, sf):
    reward = R.guard(R.format_reward(C())) + R.guard(R.integer_reward(C(), REF()))
    df = frame(spark, sf, "completions").select("group_id", reward.alias("reward"))
    out = G.signal_summary(df, ["group_id"])
    return out.select("group_id", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "lo", "hi")])
