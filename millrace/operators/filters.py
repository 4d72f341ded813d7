"""Rules that leave web texts and conversations out of a corpus, each with its reason. Everything is a Column expression or a grouped sum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.text import computed_once, count_of, is_blank, let, strip
from millrace.operators.ordering import global_index, previous

WORD = r"[\p{L}\p{N}_]+"
# Elements whose content is no text, elements that end a line, and entities.
SILENT = ("script", "style", "noscript", "template", "nav", "head")
BLOCK = ("p", "div", "br", "li", "ul", "ol", "tr", "table", "section", "article", "header", "footer", "main", "aside", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote")
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}
LIST_LINE = r"^\s*([-*+•]|\d{1,3}[.)])\s"
ADULT = ("porn", "xxx", "casino")
# The inside of a tag: a ">" within quotes doesn't end it. Possessive, so that a page with a broken tag costs no more than its length.
_INSIDE = r"""(?:[^"'>]++|"[^"]*+"|'[^']*+')*+"""


def html_to_text(html: Column) -> Column:
    """Visible text of a page: comments, silent elements (to the end of the page if unclosed) and tags go, block elements end lines, entities are
    read, blanks run together, empty lines go. A page without markup keeps its text."""
    out = F.regexp_replace(html, r"(?s)<!--.*?(-->|\z)", "")
    for name in SILENT:
        out = F.regexp_replace(out, rf"(?is)<{name}\b[^>]*>.*?(</{name}\s*>|\z)", "\n")
    out = F.regexp_replace(out, rf"(?i)</?({'|'.join(BLOCK)})\b{_INSIDE}>", "\n")
    out = F.regexp_replace(out, rf"</?[A-Za-z!]{_INSIDE}>", "")
    for entity, char in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.regexp_replace(out, r"[ \t\r\f]+", " ")
    return F.regexp_replace(F.regexp_replace(out, r" ?\n[ \n]*", "\n"), r"^[ \n]+|[ \n]+$", "")


def repeated_share(words: Column, n: int) -> Column:
    """Share of the n-grams of a text that stand in it before; 0 for fewer than n words."""
    grams = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.xxhash64(*[F.element_at(words, i + k) for k in range(n)]))
    share = let(grams, lambda g: 1 - F.size(F.array_distinct(g)).cast("double") / F.size(g))
    return F.when(F.size(words) >= n, share).otherwise(0.0)


def list_share(text: Column) -> Column:
    """Share of the lines with text that begin like a list item."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: ~is_blank(x))
    return let(lines, lambda xs: F.when(F.size(xs) > 0, F.size(F.filter(xs, lambda x: x.rlike(LIST_LINE))).cast("double") / F.size(xs)).otherwise(0.0))


def first_reason(rules: dict[str, Column]) -> Column:
    """The name of the first rule that holds, null if none does."""
    return F.coalesce(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])


def heuristic_filter(df: DataFrame, text: str, min_words: int = 20, max_words: int = 100_000, unique_exponent: float = 0.55, max_lists: float = 0.6, n: int = 3,
                     max_repeated: float = 0.3, adult: Sequence[str] = ADULT, adult_words: int = 2) -> DataFrame:
    """df with n_words, unique_share, list_share, repeated_share and reason (columns of these names are replaced): the first of `empty`, `short`, `long`, `lists`, `repetition`,
    `vocabulary` (fewer different words than ``n_words ** unique_exponent``: long texts repeat more) and `adult` (``adult_words`` of the listed words) that holds; null for
    texts that stay. Null and blank texts are empty."""
    df = df.drop("n_words", "unique_share", "list_share", "repeated_share", "reason")
    value = F.coalesce(F.col(text), F.lit(""))
    words = computed_once(df.withColumn("_text", value), _words=F.regexp_extract_all(F.lower(value), F.lit(WORD), F.lit(0)))
    size = F.size("_words")
    shares = words.withColumns({"n_words": size.cast("bigint"), "list_share": list_share(F.col("_text"))})
    listed = F.size(F.filter("_words", lambda w: w.isin(*adult))) if adult else F.lit(0)
    shares = computed_once(shares, _unique=F.size(F.array_distinct("_words")).cast("bigint"), repeated_share=repeated_share(F.col("_words"), n), _adult=listed)
    count = F.col("n_words").cast("double")
    rules = {"empty": is_blank(F.col("_text")), "short": count < min_words, "long": count > max_words, "lists": F.col("list_share") > max_lists,
             "repetition": F.col("repeated_share") > max_repeated, "vocabulary": F.col("_unique") < F.pow(count, F.lit(unique_exponent)), "adult": F.col("_adult") >= adult_words}
    unique = F.when(count > 0, F.col("_unique") / count).otherwise(0.0)
    return shares.select(*df.columns, "n_words", unique.alias("unique_share"), "list_share", "repeated_share", first_reason(rules).alias("reason"))


# --- conversations ---

# Which role may follow which; names of developers; licence words; Han characters.
FOLLOWS = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant", "tool")}
DEVELOPERS = ("openai", "chatgpt", "anthropic", "deepseek", "mistral", "alibaba")
LICENCES = ("non-commercial", "noncommercial", "all rights reserved", "no license", "unknown license")
HAN = r"[\x{4E00}-\x{9FFF}]"
OPEN, CLOSE = "<think>", "</think>"


def sft_filter(df: DataFrame, conversation: str, turn: str, role: str = "role", text: str = "text", max_repeated: float = 0.5, max_han: float = 0.2,
               developers: Sequence[str] = DEVELOPERS, licences: Sequence[str] = LICENCES) -> DataFrame:
    """One row per conversation: turns, and the reasons to leave it out, in a fixed order (none: it stays).

    `order`: a role follows another that it may not follow, or opens the conversation without right; `unanswered`: the last turn is not the assistant's;
    `unclosed`: an answer opens a reasoning chain and doesn't close it, or closes one that it didn't open; `blank`: an answer without text; `licence`,
    `developer`: any turn names one; `repetition`, `han`: an answer repeats its n-grams or consists of Han characters beyond the share allowed.

    The role before a turn comes over blocks of turns and every reason is a flag that is summed, so no conversation is gathered, however long. Turns
    without number come last; null roles and texts are empty; rows without conversation form one.
    """
    order = F.coalesce(F.col(turn).cast("bigint"), F.lit((1 << 62) - 1))
    named = df.select(F.col(conversation).alias("_id"), F.coalesce(F.concat(F.lit("c"), F.col(conversation).cast("string")), F.lit("")).alias("_c"), order.alias("_turn"),
                      F.lower(strip(F.coalesce(F.col(role), F.lit("")))).alias("_role"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    answer = F.col("_role") == "assistant"
    low = F.lower("_text")
    words = F.regexp_extract_all(low, F.lit(WORD), F.lit(0))
    opened, closed = F.instr("_text", OPEN), F.instr("_text", CLOSE)
    unclosed = (count_of(F.col("_text"), OPEN) != count_of(F.col("_text"), CLOSE)) | ((closed > 0) & (closed < opened))
    solid = F.length(F.regexp_replace("_text", r"\s", ""))
    han = F.length("_text") - F.length(F.regexp_replace("_text", HAN, ""))
    names = lambda listed: F.exists(F.array(*[F.lit(x) for x in listed]), lambda x: F.contains(low, x)) if listed else F.lit(False)
    flags = {"unclosed": answer & unclosed, "blank": answer & is_blank(F.col("_text")), "licence": names(licences), "developer": names(developers),
             "repetition": answer & (let(words, lambda w: repeated_share(w, 3)) > max_repeated), "han": answer & (han > max_han * solid)}
    marked = named.select("_id", "_c", "_turn", "_role", *[f.alias(n) for n, f in flags.items()])
    rows = previous(global_index(marked, "_turn", "_pos", by=["_c"]), ["_c"], "_pos", "_role", "_last")
    may = F.create_map(*[x for k, v in FOLLOWS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    allowed = F.coalesce(F.array_contains(F.try_element_at(may, F.coalesce("_last", F.lit(""))), F.col("_role")), F.lit(False))
    sums = rows.groupBy("_c").agg(F.first("_id").alias(conversation), F.count(F.lit(1)).alias("turns"), F.bool_or(~allowed).alias("order"),
                                  (F.max_by("_role", "_pos") != "assistant").alias("unanswered"), *[F.bool_or(n).alias(n) for n in flags])
    reasons = F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in ("order", "unanswered", *flags)]))
    return sums.select(conversation, "turns", reasons.alias("reasons"))


def reason_counts(filtered: DataFrame, reasons: str = "reasons") -> DataFrame:
    """reason, rows: how many rows each reason leaves out; rows without one under `kept`."""
    named = F.when(F.size(reasons) > 0, F.col(reasons)).otherwise(F.array(F.lit("kept")))
    return filtered.select(F.explode(named).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))
