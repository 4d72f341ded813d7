"""Filters with reasons beside plain versions."""


from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.operators import filters as H

PAGES = [
    ("<p>one</p><p>two</p>", "one\ntwo"), ("plain < text & more", "plain < text & more"), ("a<br>b<BR/>c", "a\nb\nc"), ('<a title="x > y">link</a> end', "link end"),
    ("<script>var t='</p>';</script>shown", "shown"), ("<SCRIPT src=x>a<b</SCRIPT >x", "x"), ("before<script>never closed <p>gone", "before"), ("x<!-- a <p> --> y", "x y"), ("x<!-- open", "x"),
    ("<style>p{}</style ><nav><ul><li>menu</ul></nav>text", "text"), ("&lt;b&gt; &amp;amp; &quot;q&quot;&nbsp;&#39;s", "<b> &amp; \"q\" 's"), ("<h1>T</h1>\n\n  <div>  a  b </div>", "T\na b"),
    ("<p class='a\"b>c'>in</p>", "in"), ("<preface>kept</preface>", "kept"), ("", ""), ("<p", "<p"), ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2")]


def test_html_to_text(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(PAGES)] + [(99, None)], "i int, html string")
    got = {r.i: r.text for r in df.select("i", H.html_to_text(F.col("html")).alias("text")).collect()}
    assert got == {i: t for i, (_, t) in enumerate(PAGES)} | {99: None}


def test_broken_pages_cost_no_more_than_their_length(spark):
    broken = ["<p " + "a " * 100_000, "<" * 100_000, '<p title="' + "x'" * 50_000, "<div " + "a='b' " * 50_000 + ">in", "<!--" * 20_000]
    df = spark.createDataFrame(list(enumerate(broken)), "i int, html string").repartition(1)
    got = {r.i: r.text for r in df.select("i", H.html_to_text(F.col("html")).alias("text")).collect()}
    assert got[3] == "in" and got[4] == "" and got[1] == "<" * 100_000


def test_repeated_share(spark):
    for words, n in ((["a"] * 10, 3), ("a b c a b c a b d".split(), 3), (["a", "b"], 3), ([], 2), (["a", "b", "c"], 3), ("x y x y x".split(), 2)):
        grams = [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]
        want = 1 - len(set(grams)) / len(grams) if grams else 0.0
        row = spark.createDataFrame([(words,)], "w array<string>").select(H.repeated_share(F.col("w"), n).alias("s")).first()
        assert row.s == pytest.approx(want)


NORMAL = " ".join(f"word{i}" for i in range(60))
TEXTS = [(None, "empty"), ("", "empty"), (" \n\t ", "empty"), ("too few words", "short"), (NORMAL, None), ("- a one\n* b two\n1. c three\n2) d four\n" * 8, "lists"), ("one two three four " * 30, "repetition"),
         (" ".join(f"{a} {b}" for a in "abcdefghij" for b in "abcdefghij"), "vocabulary"), (NORMAL + " casino and Porn", "adult"), (NORMAL + " casino", None), ("w " * 100, "long")]


def test_every_reason(spark):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, (t, _) in enumerate(TEXTS)] + [(4, NORMAL, "clash", 1)], "i int, text string, reason string, n_words int")
    out = H.heuristic_filter(df, "text")
    assert out.columns == ["i", "text", "n_words", "unique_share", "list_share", "repeated_share", "reason"]
    got = {r.i: r for r in out.collect()}
    want = {i: r for i, (_, r) in enumerate(TEXTS)} | {10: "repetition"}
    assert {i: r.reason for i, r in got.items()} == want and out.count() == len(TEXTS) + 1
    assert H.heuristic_filter(df, "text", max_words=99).where("i = 10").first().reason == "long"
    assert got[4].unique_share == 1.0 and got[5].list_share == 1.0 and got[0].n_words == 0
    assert H.heuristic_filter(df.limit(0), "text").count() == 0 and H.heuristic_filter(df, "text", adult=()).where("reason = 'adult'").count() == 0


FINE = [("system", "Be kind."), ("user", "Hello there"), ("assistant", "<think>greet</think>Hello, how can I help?"), ("user", "Bye"), ("assistant", "Goodbye!")]
TALKS = {
    1: (FINE, []), 2: (FINE[1:], []), 3: (FINE[:2], ["unanswered"]), 4: ([FINE[1], FINE[1], FINE[4]], ["order"]), 5: ([FINE[2]], ["order"]),
    6: ([FINE[1], ("assistant", "<think>never closed")], ["unclosed"]), 7: ([FINE[1], ("assistant", "</think> then <think>")], ["unclosed"]), 8: ([FINE[1], ("assistant", "  \n")], ["blank"]),
    9: ([("user", "Released as Non-Commercial only"), FINE[4]], ["licence"]), 10: ([FINE[1], ("assistant", "I am ChatGPT, by OpenAI")], ["developer"]),
    11: ([FINE[1], ("assistant", "yes we can " * 20)], ["repetition"]), 12: ([FINE[1], ("assistant", "答案是四十二 ok")], ["han"]), 13: ([FINE[1], ("assistant", "the word 好 in a long answer of many letters")], []),
    14: ([FINE[1], ("assistant", "call"), ("tool", "42"), ("assistant", "It is 42")], []), 15: ([(None, "x")], ["order", "unanswered"]), 16: ([("USER ", "hi"), ("Assistant", "hello")], []),
    17: ([FINE[1], ("assistant", None)], ["blank"]), 18: ([FINE[1], FINE[0], FINE[4]], ["order"])}


def test_conversations(spark):
    rows = [(c, 10 * t, role, text, "x") for c, (talk, _) in TALKS.items() for t, (role, text) in enumerate(talk)]
    rows += [(None, 0, "user", "hi", "x"), (None, 1, "assistant", "hello", "x"), (20, None, "assistant", "last", "x"), (20, 1, "user", "first", "x")]
    df = spark.createDataFrame(rows, "conv long, turn int, role string, text string, reasons string").repartition(4)
    out = H.sft_filter(df, "conv", "turn")
    got = {r.conv: (r.turns, r.reasons) for r in out.collect()}
    assert got == {c: (len(t), want) for c, (t, want) in TALKS.items()} | {None: (2, []), 20: (2, [])}
    counts = Counter(x for _, want in [*TALKS.values(), ([], []), ([], [])] for x in (want or ["kept"]))
    assert {r.reason: r["rows"] for r in H.reason_counts(out).collect()} == counts
    assert H.sft_filter(df.limit(0), "conv", "turn").count() == 0


def test_a_conversation_longer_than_a_block(spark):
    """140,000 turns over three blocks; the role order breaks only across the first block's edge."""
    turns = spark.range(140_000).select(F.lit(7).alias("conv"), F.col("id").alias("turn"), F.when((F.col("id") % 2 == 0) != (F.col("id") >= 65_536), "user").otherwise("assistant").alias("role"), F.lit("some text").alias("text"))
    (row,) = H.sft_filter(turns, "conv", "turn").collect()
    assert (row.turns, row.reasons) == (140_000, ["order", "unanswered"])
    fine = turns.withColumn("role", F.when(F.col("turn") % 2 == 0, "user").otherwise("assistant"))
    assert H.sft_filter(fine, "conv", "turn").first().reasons == []
