"""Answer extraction from completions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from millrace.functions.text import after_last, between, find, find_any, last_match, let, strip

# Unit words, taken off in this order.
UNITS = ["руб", "рублей", "рубля", "$", "€", "долларов", "meters", "km", "kg", "г", "кг", "м"]

# Number and answer patterns.
HASH_GROUPED = r"####\s*(-?\d+(?:,\d+)?(?:\.\d+)?)"
NUMBER_GROUPED = r"-?\d+(?:,\d+)?(?:\.\d+)?"
HASH_THOUSANDS = r"####\s*(-?\d+(?:,\d{3})*(?:\.\d+)?)"
NUMBER_PLAIN = r"-?\d+(?:\.\d+)?"
HASH_INTEGER = r"####\s*(-?\d+)"
PHRASE_ANSWER = r"(?iu)(?:the answer is|answer is|ответ[:\s]+)[\s]*(-?\d+)"
PHRASE_TOTAL = r"(?iu)(?:итого|всего|получаем)[:\s]*(-?\d+)"
TAG_INTEGER = r"<answer>\s*(-?\d+)\s*</answer>"
ROOT_PAIR = r"x\d*\s*=\s*([-+]?\d+(?:\.\d+)?)"
SIGNED_NUMBER = r"[-+]?\d+(?:\.\d+)?"

REASONING_TAGS = {"deepseek": ("<think>", "</think>"), "simple": ("<reasoning>", "</reasoning>")}


def reasoning_tags(style: str) -> tuple[str, str]:
    return REASONING_TAGS["deepseek" if style == "deepseek" else "simple"]


def reasoning_body(c: Column, style: str = "deepseek") -> Column:
    return strip(between(c, *reasoning_tags(style)))


def answer_body(c: Column) -> Column:
    return strip(between(c, "<answer>", "</answer>"))


def number_in(c: Column) -> Column:
    """First number of a text after space, comma and thousands clean-up."""
    t = F.regexp_replace(strip(c), r"(\d)\s+(\d)", "$1$2")
    t = F.regexp_replace(t, r",(\d{1,2})(?!\d)", ".$1")
    t = F.regexp_replace(t, r"(\d),(\d{3})", "$1$2")

    def first(t):
        return F.coalesce(find(r"[-+]?\d+\.?\d*", t).try_cast("double"), find(r"[-+]?\.\d+", t).try_cast("double"))

    return F.when(c.rlike(r"\d"), let(t, first))


def final_answer(c: Column) -> Column:
    """Number after the hash mark, else the last number, else the stripped text."""
    return F.coalesce(
        F.replace(find(HASH_GROUPED, c, 1), F.lit(","), F.lit("")),
        F.replace(last_match(NUMBER_GROUPED, c), F.lit(","), F.lit("")),
        strip(c),
    )


def integer_digits(c: Column) -> Column:
    """Whole-number answer as written, by the order: hash mark, phrase, tag, last integer; without leading zeros."""
    low = F.lower(c)  # plain substring tests keep the costlier patterns off most rows
    phrase = low.contains("answer is") | low.contains("ответ")
    total = low.contains("итого") | low.contains("всего") | low.contains("получаем")
    picks = [F.when(c.contains("####"), find(HASH_INTEGER, c, 1)), F.when(phrase, find(PHRASE_ANSWER, c, 1)),
             F.when(total, find(PHRASE_TOTAL, c, 1)), F.when(c.contains("<answer>"), find(TAG_INTEGER, c, 1)),
             last_match(r"(-?\d+)", c, 1)]

    def without_zeros(n):
        padded = n.startswith("0") | n.startswith("-0")
        return F.when(padded, F.regexp_replace(F.regexp_replace(n, r"\A(-?)0+(?=\d)", "$1"), r"\A-0\z", "0")).otherwise(n)

    return let(F.coalesce(*picks), without_zeros)


def integer_answer(c: Column) -> Column:
    """``integer_digits`` as a number of up to 38 digits."""
    return integer_digits(c).try_cast("decimal(38,0)")


def reference_digits(c: Column) -> Column:
    """As ``integer_digits``, falling back to the truncated first number."""
    return F.coalesce(integer_digits(c), number_in(c).try_cast("bigint").cast("string"))


def normal_form(c: Column) -> Column:
    """Lower-cased answer without units, a leading fraction as quotient, no trailing zeros."""
    t = F.lower(strip(c))
    for unit in UNITS:
        t = strip(F.replace(t, F.lit(unit), F.lit("")))
    return let(let(t, _quotient), _without_zeros)


def _quotient(t: Column) -> Column:
    fraction = r"\A(\d+)\s*/\s*(\d+)"
    top = F.regexp_extract(t, fraction, 1).try_cast("double")
    bottom = F.regexp_extract(t, fraction, 2).try_cast("double")
    return F.coalesce(F.try_divide(top, F.nullif(bottom, F.lit(0.0))).cast("string"), t)


def _without_zeros(t: Column) -> Column:
    return F.when(t.contains("."), F.regexp_replace(F.regexp_replace(t, r"0+\z", ""), r"\.+\z", "")).otherwise(t)


def roots(c: Column) -> Column:
    """Sorted numbers of ``x1 = a`` pairs, or of the whole text when there are none."""
    pairs = F.regexp_extract_all(c, F.lit(ROOT_PAIR), F.lit(1))
    plain = F.regexp_extract_all(c, F.lit(SIGNED_NUMBER), F.lit(0))
    return F.array_sort(F.transform(F.when(F.size(pairs) > 0, pairs).otherwise(plain),
                                    lambda x: x.try_cast("double")))


def response_answer(c: Column, use_tags: bool = True) -> Column:
    """Answer text by the order: tag, hash number, first number after the last hash, last number."""
    picks = []
    if use_tags:
        picks.append(strip(find_any(r"(?is)<answer>\s*(.*?)\s*</answer>", c, 1)))
    picks.append(F.replace(find(HASH_THOUSANDS, c, 1), F.lit(","), F.lit("")))
    picks.append(F.when(c.contains("####"), find(NUMBER_PLAIN, after_last(c, "####"))))
    picks.append(last_match(NUMBER_PLAIN, c))
    return F.coalesce(*picks)


def after_hash(c: Column) -> Column:
    return strip(after_last(c, "####"))


def after_hash_word(c: Column) -> Column:
    """As ``after_hash`` without commas, first word only."""
    clean = strip(F.replace(after_hash(c), F.lit(","), F.lit("")))
    return F.when(c.contains("####"), F.regexp_extract(clean, r"\A\S*", 0)).otherwise(c)
