"""Reward formulas as Column expressions over a completion and its reference answer."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, functions as F

from millrace.functions import extract as X
from millrace.functions.text import SPACE, count_of, let, strip

# Signs of step-by-step reasoning and connecting words.
STEP_PATTERNS = [r"\d+[\.\)]\s", r"[-•]\s", r"(?:шаг|step)\s*\d+",
                 r"(?:во-первых|во-вторых|в-третьих|firstly|secondly)"]
KEYWORDS = ["следовательно", "потому что", "значит", "таким образом", "поэтому", "отсюда", "получаем",
            "вычисляем", "находим", "подставим", "решим", "равно",
            "therefore", "because", "thus", "hence", "so", "we get", "we find", "calculate", "solve", "equals"]


def format_reward(c: Column, style: str = "deepseek", full: float = 0.2, partial: float = 0.1) -> Column:
    """Full mark for one pair of each tag with reasoning first, part mark for any whole pair."""
    opening, closing = X.reasoning_tags(style)
    single = (F.least(count_of(c, opening), count_of(c, closing)) == 1) & (
        F.least(count_of(c, "<answer>"), count_of(c, "</answer>")) == 1)
    ordered = F.instr(c, closing) < F.instr(c, "<answer>")
    any_pair = (c.contains(opening) & c.contains(closing)) | (c.contains("<answer>") & c.contains("</answer>"))
    return F.when(single & ordered, full).when(any_pair, partial).otherwise(0.0)


def reasoning_reward(c: Column, style: str = "deepseek", min_words: int = 10, step: float = 0.1,
                     keyword: float = 0.05, cap: float = 0.3) -> Column:
    """Marks for length, visible steps and connecting words of the reasoning part, capped."""
    def score(body):
        words = F.regexp_count(body, F.lit(SPACE + "+")) + 1  # the body is stripped; a split compiles its pattern for every row
        steps = body.rlike("(?iu)(?:" + "|".join(STEP_PATTERNS) + ")")
        linked = let(F.lower(body), lambda low: reduce(or_, [low.contains(word) for word in KEYWORDS]))
        marks = (F.when(words >= min_words, 0.1).otherwise(0.0) + F.when(steps, step).otherwise(0.0)
                 + F.when(linked, keyword).otherwise(0.0))
        return F.when(F.coalesce(body, F.lit("")) == "", 0.0).otherwise(F.least(marks, F.lit(cap)))

    return let(X.reasoning_body(c, style), score)


def truncation_reward(c: Column, truncated: Column, soft: float = -0.5, hard: float = -1.0) -> Column:
    answered = c.contains("<answer>") | c.contains("</answer>")
    return F.when(~truncated, 0.0).when(answered, soft).otherwise(hard)


def math_reward(c: Column, reference: Column, exact: float = 1.0, near: float = 0.5,
                tolerance: float = 1e-4, near_tolerance: float = 0.5) -> Column:
    gap = F.abs(X.number_in(X.answer_body(c)) - X.number_in(reference))
    return let(gap, lambda g: F.when(g < tolerance, exact).when(g < near_tolerance, near).otherwise(0.0))


def integer_reward(c: Column, reference: Column, style: str = "deepseek", correct: float = 1.0,
                   close: float = 0.3, bonus: float = 0.1) -> Column:
    """Whole-number match, smaller mark when off by one, bonus for reasoning tags, at most 1."""
    opening, closing = X.reasoning_tags(style)
    extra = F.when(c.contains(opening) & c.contains(closing), bonus).otherwise(0.0)

    def mark(t):
        base = F.when(t["a"] == t["b"], correct).when(_neighbours(t["a"], t["b"]), close).otherwise(0.0)
        return F.when(t["a"].isNull() | t["b"].isNull(), 0.0).otherwise(F.least(base + extra, F.lit(1.0)))

    return let(F.struct(X.integer_digits(c).alias("a"), X.reference_digits(reference).alias("b")), mark)


def _neighbours(a: Column, b: Column) -> Column:
    """Whether two whole numbers in digits differ by one. Beyond 37 digits the leading ones must be equal, so a carry into them is
    not seen."""
    def number(x):
        return F.when(F.length(x) <= 37, x.try_cast("decimal(37,0)")).otherwise(F.right(x, F.lit(37)).try_cast("decimal(37,0)"))

    def head(x):
        return F.when(F.length(x) > 37, F.left(x, F.length(x) - 37)).otherwise("")

    return F.coalesce((head(a) == head(b)) & (F.abs(number(a) - number(b)) == 1), F.lit(False))


def expression_reward(c: Column, reference: Column, tolerance: float = 1e-4) -> Column:
    """Number match, else share of equal sorted roots, else equality of normal forms."""

    def by_number(t):
        return F.when(F.abs(t["a"] - t["b"]) < tolerance, 1.0).otherwise(0.0)

    def by_roots(t):
        hits = F.size(F.filter(F.arrays_zip(t["mine"], t["theirs"]), lambda p: F.abs(p["mine"] - p["theirs"]) < tolerance))
        return F.when(F.size(t["mine"]) == F.size(t["theirs"]), F.try_divide(hits, F.size(t["theirs"]))).otherwise(0.0)

    def by_text(body):
        return F.when(X.normal_form(body) == X.normal_form(reference), 1.0).otherwise(0.0)

    def without_number(body):
        pair = F.struct(X.roots(body).alias("mine"), X.roots(reference).alias("theirs"))
        return let(pair, lambda t: F.when((F.size(t["mine"]) > 0) & (F.size(t["theirs"]) > 0), by_roots(t)).otherwise(by_text(body)))

    def judge(body):
        pair = F.struct(X.number_in(body).alias("a"), X.number_in(reference).alias("b"))
        return let(pair, lambda t: F.when(t["a"].isNotNull() & t["b"].isNotNull(), by_number(t)).otherwise(without_number(body)))

    return let(X.answer_body(c), lambda body: F.when(body.isNull(), 0.0).otherwise(judge(body)))


def combine(parts: Mapping[str, tuple[Column, float]], normalise: bool = True) -> Column:
    """Weighted sum of component rewards, divided by the weights when ``normalise``."""
    total = sum(w for _, w in parts.values())
    value = None
    for column, weight in parts.values():
        term = column * F.lit(float(weight))
        value = term if value is None else value + term
    return value / F.lit(float(total)) if normalise and total > 0 else value


def tag_reward(c: Column, use_tags: bool = True) -> Column:
    """1 for a filled answer form, 0.3 for its opening alone."""
    if use_tags:
        return F.when(c.rlike(r"(?is)<answer>\s*.+?\s*</answer>"), 1.0).when(
            F.lower(c).contains("<answer>"), 0.3).otherwise(0.0)
    return F.when(c.rlike(r"####\s*-?\d+"), 1.0).when(c.contains("####"), 0.3).otherwise(0.0)


def correctness_reward(c: Column, truth: Column, use_tags: bool = True) -> Column:
    """-1 no answer, 3 equal, 1 within ten percent, -0.5 wrong; text compared when not numeric."""
    def number(x):
        return F.replace(strip(x), F.lit(","), F.lit("")).try_cast("double")

    def numeric(t):
        ratio = F.when(t["value"] == 0, 0.0).otherwise(F.try_divide(t["guess"], t["value"]))
        return F.when(t["guess"] == t["value"], 3.0).when(ratio.between(0.9, 1.1), 1.0).otherwise(-0.5)

    def judge(found):
        textual = F.when(F.lower(strip(found)) == F.lower(strip(truth)), 3.0).otherwise(-0.5)
        pair = F.struct(number(found).alias("guess"), number(truth).alias("value"))
        both = let(pair, lambda t: F.when(t["guess"].isNotNull() & t["value"].isNotNull(), numeric(t)).otherwise(textual))
        return F.when(found.isNull(), -1.0).when(truth.isNull(), 0.0).otherwise(both)

    return let(X.response_answer(c, use_tags), judge)


def constant_reward(value: float) -> Column:
    return F.lit(float(value))


def binary_reward(condition: Column, true_value: float = 1.0, false_value: float = 0.0) -> Column:
    return F.when(condition, float(true_value)).otherwise(float(false_value))


def overlong_penalty(length: Column, max_length: int, buffer: int = 0, penalty: float = -1.0) -> Column:
    """0 below the buffer zone, linear inside it, the full penalty above the maximum."""
    start = max_length - buffer
    inside = (length - start).cast("double") / float(max(buffer, 1)) * float(penalty)
    return F.when(length > max_length, float(penalty)).when(length >= start, inside).otherwise(0.0)


def guard(c: Column) -> Column:
    """A reward that is not a number counts as zero."""
    return F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))


def register_reward(name: str, fn: Callable[[str, str], float]) -> Callable[[Column, Column], Column]:
    """Wrap a Python row function as a reward that runs on Arrow batches; a failing row scores 0."""

    @F.pandas_udf("double")
    def scored(completion: pd.Series, reference: pd.Series) -> pd.Series:
        def one(a, b):
            try:
                return float(fn(a, b))
            except Exception:
                return 0.0
        return pd.Series([one(a, b) for a, b in zip(completion, reference)], dtype="float64")

    return lambda completion, reference: guard(scored(completion, reference)).alias(name)
