"""Extraction and reward quirks on hand-derived cases."""

import re

import pytest
from pyspark.sql import functions as F

from golden import cases as G
from millrace.functions import extract as X, patterns as T2, rewards as R, rules as U, text as T


def values(spark, rows, column):
    """``column`` over rows of texts, in order."""
    width = len(rows[0])
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{k} string" for k in range(width)))
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def close(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == (pytest.approx(w) if isinstance(w, float) else w), (got, want)


@pytest.mark.parametrize("cases,fn", [
    (G.NUMBERS, X.number_in), (G.FINAL, X.final_answer), (G.INTEGERS, X.integer_answer), (G.NORMAL, X.normal_form),
    (G.ROOTS, X.roots), (G.RESPONSES, X.response_answer), (G.FORMAT, R.format_reward), (G.REASONING, R.reasoning_reward)],
    ids=["number", "final", "integer", "normal", "roots", "response", "format", "reasoning"])
def test_one_text(spark, cases, fn):
    close(values(spark, [(a,) for a, _ in cases], fn(F.col("c0"))), [w for _, w in cases])


@pytest.mark.parametrize("cases,fn", [(G.INTEGER_REWARD, R.integer_reward), (G.EXPRESSION, R.expression_reward), (G.CORRECTNESS, R.correctness_reward)],
                         ids=["integer", "expression", "correctness"])
def test_two_texts(spark, cases, fn):
    close(values(spark, [(a, b) for a, b, _ in cases], fn(F.col("c0"), F.col("c1"))), [w for *_, w in cases])


def test_truncation(spark):
    rows = [(a, str(b)) for a, b, _ in G.TRUNCATION]
    close(values(spark, rows, R.truncation_reward(F.col("c0"), F.col("c1") == "True")), [w for *_, w in G.TRUNCATION])


def test_strip_takes_all_white_space(spark):
    assert values(spark, [("  \t a b \n",), ("",)], T.strip(F.col("c0"))) == ["a b", ""]


def test_between_takes_the_first_pair(spark):
    rows = [("<a>x</a><a>y</a>",), ("</a><a>z",), ("</a><a>q</a>",)]
    assert values(spark, rows, T.between(F.col("c0"), "<a>", "</a>")) == ["x", None, "q"]


def test_overlong(spark):
    lengths = [("10",), ("60",), ("80",), ("81",)]
    close(values(spark, lengths, R.overlong_penalty(F.col("c0").cast("int"), 80, 40)), [0.0, -0.5, -1.0, -1.0])


def rule(spark, rules, response, reference="5", **kw):
    return values(spark, [(response, reference)], U.rule_reward(rules, F.col("c0"), F.col("c1"), **kw))[0]


def test_substitution_is_literal_and_in_order(spark):
    # Text put in for the response holds a later mark, which is then replaced; an earlier one is not.
    got = values(spark, [("{{reference}}|{{response}}", "R")], U.substitute("{{response}}", {"response": F.col("c0"), "reference": F.col("c1")}))
    assert got == ["R|{{response}}"]


def test_rule_presets(spark):
    P = U.PRESET_RULES
    assert rule(spark, [P["number"]], "<answer>5</answer>") == 1.0
    assert rule(spark, [P["repetition"]], "abcdefghijklmnopqrstu" * 2) == -0.25
    assert rule(spark, [P["repetition"]], "short") == 0.25
    assert rule(spark, [P["length"]], "x" * 200) == 0.5
    assert rule(spark, [P["keyword"]], "therefore") == pytest.approx(0.15)
    assert rule(spark, [P["formula"]], "<reasoning>" + "y" * 250 + "</reasoning>") == 0.5


def test_rules_disabled_and_normalised(spark):
    rules = [{"weight": 3.0, "reward_formula": "1.0"}, {"weight": 1.0, "reward_formula": "0.0"}, {"enabled": False, "reward_formula": "9"}]
    assert rule(spark, rules, "x") == 3.0
    assert rule(spark, rules, "x", normalise=True) == 0.75


@pytest.mark.parametrize("text,want", [
    ("1 if 'a' in {{response}} else 0", 1.0), ("len({{response}}) > 2", 1.0), ("1/0", 0.0), ("{{response}}", 0.0), ("float({{reference}}) // 2", 2.0),
    ("-7 % 3", 2.0), ("max(1, 2, 3) - abs(-1)", 2.0), ("int(2.9)", 2.0), ("int('x')", 0.0), ("().__class__", 0.0), ("open('f')", 0.0), ("not {{response}}", 0.0),
    ("{{response}} == 5", 0.0), ("1 <", 0.0), ("2 ** 3", 8.0), ("10.0 ** 400", 0.0),
    ("1.0 and 0.5", 0.5), ("0 or 3", 3.0), ("'' or 2", 2.0), ("1 if float('x') > 0 else 5", 0.0), ("(-8.0) ** 0.5", 0.0), ("float('inf')", 0.0), ("{{unknown}}", 0.0)])
def test_formula(spark, text, want):
    got = values(spark, [("abc", "5")], U.formula(text, {"response": F.col("c0"), "reference": F.col("c1")}))
    assert got == [want]


def test_bad_pattern_gives_empty_text(spark):
    rules = [{"extractors": [{"name": "a", "pattern": "("}], "conditions": [{"type": "equals", "target": "{{extracted.a}}", "value": ""}]}]
    assert rule(spark, rules, "x") == 1.0


@pytest.mark.parametrize("pattern,text,want", [
    (r"(?P<a>\d+)", "ab 12", "12"), (r"((?:a|b)*)c?", "ab" * 20_000, "ab" * 20_000), (r"(?<=x)y", "xy", "y"), ("a{,2}b", "aab", "aab"), (r"[[a]+", "x[a", "[a"),
    (r"(x)?y", "y", ""), (r"(?:b|(a+))", "aaa", "aaa"), (r"a.b", "a\u2028b", "a\u2028b"), (r"(a|b)+", "a" * 1_000_000, "a"), (r"x$", "x\n", "x"),
    (r"ответ:\s*(\w+)", "ответ: да", "да"), (r"\d+", "x ٣٤ 5", "٣٤"), (r"a\s+b", "a\u00a0\x1f\u2003b", "a\u00a0\x1f\u2003b"), (r"[\w-]+", "«да-нет»", "да-нет"), (r"[^\s]+", "\u3000слово\u3000", "слово"),
    (r"\W+", "да, нет", ", "), (r"\D+", "٣да٣", "да"), (r"\S+", "\x85é\x85", "é"), (r"[^\W\d]+", "12да3", "да"), (r"[]\d]+", "a]٣]", "]٣]"), (r"[^]\s]+", "] ab]", "ab"), (r"\\d(\d)", "\\d٣", "٣"),
    (r"(?:№|#)\s*(\d+)", "№ 17", "17"), (r"\[(\w)\]", "[é]", "é")])
def test_patterns_mean_what_they_mean_in_python(spark, pattern, text, want):
    m = re.search(pattern, text)
    assert ((m[1] if m.re.groups else m[0]) or "") == want
    assert values(spark, [(text,)], T2.first_group(F.col("c0"), pattern)) == [want]
    assert values(spark, [(text,)], T2.found(F.col("c0"), pattern)) == [True]


def test_registered_reward_guards_failures(spark):
    fn = R.register_reward("ratio", lambda a, b: float(a) / float(b))
    assert values(spark, [("6", "3"), ("6", "0"), ("x", "1"), ("nan", "1")], fn(F.col("c0"), F.col("c1"))) == [2.0, 0.0, 0.0, 0.0]
