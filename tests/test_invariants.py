"""Properties that hold whatever the partitioning, on the given tables and on small skewed frames."""

import hashlib
import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from millrace.functions import paths as P, tokens as E
from millrace.operators import chat as D, fields as B, groups as G, masks as M, ordering as O, runs as J, sampling as C
from millrace.plans.frames import frame
from millrace.plans.masks import examples


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.fixture(scope="module")
def skewed(spark):
    """One run holds most rows; keys are sparse and out of order."""
    rnd = random.Random(1)
    keys = rnd.sample(range(-5000, 50_000), 900)
    data = [("hot" if i % 10 else f"r{i % 7}", k, rnd.random(), None if i % 11 == 0 else float(i % 13)) for i, k in enumerate(keys)]
    return spark.createDataFrame(data, "run_id string, seq bigint, reward double, loss double")


def by_run(df):
    out = {}
    for r in df.orderBy("seq").collect():
        out.setdefault(r["run_id"], []).append(r)
    return out


@pytest.mark.parametrize("parts,bits", [(1, 20), (7, 4), (7, 2)])
def test_index_is_dense_and_ordered(spark, skewed, parts, bits):
    df = skewed.repartition(parts)
    got = O.running_totals(df, "seq", {"i": F.lit(1), "s": F.col("seq")}, by=["run_id"], bits=bits)
    for group in by_run(got).values():
        assert [r["i"] for r in group] == list(range(len(group)))
        total = 0
        for r in group:
            assert r["s"] == total
            total += r["seq"]
    whole = O.global_index(df, "seq", bits=bits)
    assert [r["idx"] for r in whole.orderBy("seq").collect()] == list(range(900))


@pytest.mark.parametrize("key", ["seq", "name"])
@pytest.mark.parametrize("n", [0, 1, 250, 900, 5000])
def test_first_rows(skewed, key, n):
    df = skewed.repartition(5).withColumn("name", F.lpad(F.col("seq").cast("string"), 8, "x"))
    want = [r[key] for r in df.orderBy(key).limit(n).collect()]
    assert [r[key] for r in O.first_rows(df, key, n, bits=4).orderBy(key).collect()] == want


@pytest.mark.parametrize("limit", [0, 7, 3000, 10**9])
def test_within_total(skewed, limit):
    df = skewed.withColumn("size", F.pmod(F.col("seq"), F.lit(13)))
    got = O.within_total(df, "seq", "size", limit, "total", bits=4).orderBy("seq").collect()
    total, want = 0, []
    for r in df.orderBy("seq").collect():
        total += r["size"]
        if total <= limit:
            want.append((r["seq"], total))
    assert [(r["seq"], r["total"]) for r in got] == want


@pytest.mark.parametrize("bits", [3, 16])
def test_following_over_blocks(skewed, bits):
    placed = O.global_index(skewed, "seq", "pos", by=["run_id"])
    for group in by_run(O.following(placed, ["run_id"], "pos", "reward", "next", bits=bits)).values():
        assert [r["next"] for r in group] == [r["reward"] for r in group[1:]] + [None]


@pytest.mark.parametrize("bits", [3, 16])
def test_trailing_window_over_blocks(skewed, bits):
    placed = O.global_index(skewed, "seq", "pos", by=["run_id"])
    got = O.trailing(placed, ["run_id"], "pos", 7, {"m": (F.max, "reward"), "n": (F.count, "reward")}, bits=bits)
    for group in by_run(got).values():
        for i, r in enumerate(group):
            window = [x["reward"] for x in group[max(0, i - 6):i + 1]]
            assert (r["m"], r["n"]) == (max(window), len(window))


@pytest.mark.parametrize("bits", [3, 16])
def test_trailing_counts_over_blocks(skewed, bits):
    placed = O.global_index(skewed, "seq", "pos", by=["run_id"])
    got = O.trailing_counts(placed, ["run_id"], "pos", 7, {"k": F.col("reward") > 0.5}, bits=bits)
    for group in by_run(got).values():
        for i, r in enumerate(group):
            assert r["k"] == sum(x["reward"] > 0.5 for x in group[max(0, i - 6):i + 1])


@pytest.mark.parametrize("bits", [1, 16])
def test_previous_over_blocks(skewed, bits):
    placed = O.global_index(skewed, "seq", "pos", by=["run_id"])
    for group in by_run(O.previous(placed, ["run_id"], "pos", "seq", "before", bits=bits)).values():
        assert [r["before"] for r in group] == [None, *[r["seq"] for r in group[:-1]]]


@pytest.mark.parametrize("bits", [2, 20])
def test_carry_last(skewed, bits):
    got = O.carry_last(skewed, ["run_id"], "seq", "loss", "held", bits=bits)
    for group in by_run(got).values():
        last = None
        for r in group:
            last = r["loss"] if r["loss"] is not None else last
            assert r["held"] == last


def test_gae_blocks_equal_one_walk(spark, skewed, monkeypatch):
    steps = skewed.select(F.col("run_id").alias("traj"), F.col("seq").alias("t"), "reward", F.coalesce("loss", F.lit(0.5)).alias("value"),
                          (F.col("seq") % 50 == 0).alias("done"))
    monkeypatch.setattr(G, "GAE_BITS", 3)
    got = by_run(G.gae(steps, "traj", "t", 0.9, 0.8).withColumnsRenamed({"traj": "run_id", "t": "seq"}))
    src = by_run(steps.withColumnsRenamed({"traj": "run_id", "t": "seq"}))
    for run, group in src.items():
        a, nv = 0.0, 0.0
        for r, g in zip(reversed(group), reversed(got[run])):
            live = 0.0 if r["done"] else 1.0
            a = r["reward"] + 0.9 * nv * live - r["value"] + 0.9 * 0.8 * live * a
            nv = r["value"]
            assert g["advantage"] == pytest.approx(a) and g["returns"] == pytest.approx(a + r["value"])


def test_split_and_shards_partition_the_index(spark):
    df = C.shard_rows(C.holdout_split(spark.range(25_000).withColumnRenamed("id", "idx"), 0.0301), 7)
    counts = {(r["split"], r["shard"]): r["n"] for r in df.groupBy("split", "shard").agg(F.count("*").alias("n")).collect()}
    assert sum(counts.values()) == 25_000 and {s for _, s in counts} == set(range(7))
    assert df.filter("split = 'val'").count() == 301 * 3
    assert df.filter("(idx % 10000 < 301) <> (split = 'val')").count() == 0
    assert spark.range(5).withColumnRenamed("id", "idx").select(C.split_of(F.col("idx"), 0.0)).distinct().collect()[0][0] == "train"


def test_small_corpus_goes_to_validation(spark):
    df = spark.range(400).withColumnRenamed("id", "idx")
    row = C.split_sizes(df, 0.05).first()
    assert (row["val_estimate"], row["val_exact"], row["train_exact"]) == (20, 400, 0)


@pytest.mark.parametrize("parts", [1, 7])
def test_samples_and_batches_do_not_depend_on_partitions(spark, parts):
    df = spark.range(1000).repartition(parts)
    assert rows(C.seeded_sample(df, "id", 5, 3), "id") == rows(C.seeded_sample(spark.range(1000), "id", 5, 3), "id")
    b = C.batches(df, "id", 64, 1, drop_last=True)
    sizes = [r["n"] for r in b.groupBy("batch").agg(F.count("*").alias("n")).collect()]
    assert sizes == [64] * 15
    assert rows(b, "id") == rows(C.batches(spark.range(1000), "id", 64, 1, drop_last=True), "id")


def test_refill_draws_with_replacement(spark):
    prompts = spark.range(10).withColumnRenamed("id", "p")
    got = C.refill(prompts, "p", 50, 1000).collect()
    assert len(got) == 50 and len({r["new_group_id"] for r in got}) == 50 and len({r["p"] for r in got}) <= 10


def test_advantages(spark):
    data = [(1, "a", 1.0), (1, "b", 0.0), (2, "a", 0.7), (3, "a", 0.5), (3, "b", 0.5)]
    df = spark.createDataFrame(data, "g int, k string, reward double")
    got = {(r["g"], r["k"]): r["advantage"] for r in G.group_advantage(df, ["g"]).collect()}
    assert got[(2, "a")] == 0.7 and got[(3, "a")] == 0.0
    assert got[(1, "a")] == pytest.approx(0.5 / 0.5 ** 0.5) and got[(1, "a")] + got[(1, "b")] == pytest.approx(0)
    assert {r["g"] for r in G.zero_gradient_filter(df, ["g"]).collect()} == {1}


def test_replay_limit_is_not_for_groups(spark):
    df = spark.range(10)
    assert G.replay_newest(df, ["id"], 3).count() == 3
    assert G.replay_newest(df, ["id"], 3, grouped=True).count() == 10
    assert G.replay_newest(df, ["id"], 3, grouped=True, enforce_on_groups=True).count() == 3


def test_reprompt_finds_the_question(spark):
    prompts = ["S\nUser: a? Assistant:", "<|user|>\nb?<|assistant|>", "[INST] c? [/INST]", "d?"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(prompts)], "i int, p string")
    assert [r[0] for r in df.orderBy("i").select(G.question_of(F.col("p"))).collect()] == ["a?", "b?", "c?", "d?"]
    long = df.select(G.reprompt(F.col("p"), F.repeat(F.lit("x"), 9000))).first()[0]
    assert len(long) == 4096


def test_unpaired_reference_is_an_error(spark):
    left, right = spark.range(3).withColumn("q", F.lit("q")), spark.range(4).withColumn("a", F.lit("a"))
    with pytest.raises(Exception, match="do not pair up"):
        G.attach_reference(left, right, "id").collect()


def test_long_conversations_render_in_about_linear_time(spark):
    seconds = []
    for n in (15_000, 60_000):
        df = spark.range(n).select(F.lit(1).alias("c"), "id", F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("x").alias("content"))
        record = D.assemble(df, "c", "id", ["role", "content"])
        start = time.perf_counter()
        row = record.select(F.size(D.render(D.chat_segments(F.col("messages")))["spans"]), F.size(D.chatml_spans(F.col("messages"))["spans"])).first()
        seconds.append(time.perf_counter() - start)
        assert list(row) == [n // 2, n // 2]
    assert seconds[1] < 8 * seconds[0] + 5


def test_a_plugged_in_tokenizer_gives_the_same_columns_as_the_default(spark):
    def encode(text):
        for m in re.finditer(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]", text):
            yield int(hashlib.md5(m.group().encode()).hexdigest()[:8], 16) % E.VOCAB + E.FIRST_ID, m.start(), m.end()

    df = spark.createDataFrame([("Two words,  then  a_b !?",), ("",), ("   lead and  trail  ",), ("x" * 50 + " y z",)], "t string")
    for length in (3, 100):
        both = df.select(E.offset_tokenizer(encode, length)(F.col("t")).alias("p"), E.word_tokens(length)(F.col("t")).alias("j")).collect()
        assert [tuple(map(list, r.p)) for r in both] == [tuple(map(list, r.j)) for r in both]


def test_texts_of_values_are_those_of_python(spark):
    texts = ["1", "1.0", "72.0", "1e20", "1.5e-7", "-0.00012", "123456789.125", "1e15", "1e16", "12345678901234567890", "true", "null", '"x"', "[1, 2]",
             '[1, [2, 3.5, "a\'b", null, true]]', '{"a": ["q", 7]}', "100000000.0", "-1.5e300", "0.0001", "0.00001", '"it\\"s"']

    def plain(v):
        return "" if v is None else "\n".join(str(x) for x in v if x is not None and str(x).strip()) if isinstance(v, list) else str(v)

    df = spark.createDataFrame([(i, f'{{"it\'s": {v}}}') for i, v in enumerate(texts)], "i int, line string")
    got = [r.t for r in df.orderBy("i").select(P.text_at(P.parse(F.col("line")), "it's").alias("t")).collect()]
    assert got == [plain(json.loads(v)) for v in texts]


def test_spans_lie_in_the_text_and_labels_in_the_spans(spark, sf_dir):
    df = frame(spark, sf_dir, "pairs").select(D.render(D.instruct_segments(F.col("instruction"), F.col("output"), eos="<|eos|>")).alias("r"))
    for r in df.collect():
        text, spans = r["r"]["text"], r["r"]["spans"]
        assert all(0 <= s["start"] < s["end"] <= len(text) for s in spans)
        assert text[spans[-1]["start"]:] == "<|eos|>" and text[spans[0]["start"]] == "\n"
    for r in examples(spark, sf_dir).collect():
        assert len(r["input_ids"]) == len(r["labels"]) == len(r["attention_mask"]) == 512
        assert all(l in (-100, i) for l, i in zip(r["labels"], r["input_ids"]))
        assert all(l == -100 for l, m in zip(r["labels"], r["attention_mask"]) if m == 0)
        assert any(l != -100 for l in r["labels"])


def test_label_rules(spark):
    # A token across a span's edge and an empty token are not trained; a last end token always is.
    df = spark.createDataFrame([([5, 6, 7, 1], [0, 3, 6, 9], [3, 7, 6, 9], [(0, 4), (6, 9)])],
                               "ids array<int>, s array<int>, e array<int>, spans array<struct<start:int,end:int>>")
    got = df.select(E.span_labels(F.col("ids"), F.col("s"), F.col("e"), F.col("spans"))).first()[0]
    assert got == [5, -100, -100, 1]


def test_trim_completion(spark):
    df = spark.createDataFrame([([4, 9, 3, 3, 3],), ([4, 5],), ([3],)], "x array<int>")
    assert [r[0] for r in df.select(E.trim_completion(F.col("x"), 3, 3)).collect()] == [[4, 9, 3], [4, 5], [3]]
    assert [r[0] for r in df.select(E.trim_completion(F.col("x"), 3, 9)).collect()] == [[4, 9], [4, 5], []]


def test_chat_without_assistant_is_null(spark):
    m = F.array(F.struct(F.lit("user").alias("role"), F.lit("hi").alias("content")))
    row = spark.range(1).select(D.chat_segments(m).alias("a"), D.chatml_spans(m).alias("b")).first()
    assert row["a"] is None and row["b"] is None


def test_null_scores_pass(spark):
    df = spark.createDataFrame([("7",), ("n/a",), (None,), ("-3",), ("1,000",)], "a string")
    assert [r[0] for r in B.answer_range(df, "a", 0, 500).collect()] == ["7", "n/a", None]


def test_dedupe_keeps_the_first_of_each_stretch(spark):
    df = spark.createDataFrame([("r", i, s) for i, s in enumerate([1, 1, 2, 2, 1, 3])], "run_id string, seq bigint, step bigint")
    assert [r["seq"] for r in J.dedupe_steps(df).orderBy("seq").collect()] == [0, 2, 4, 5]


def test_single_row_run_counts_from_now(spark):
    df = spark.sql("SELECT 'r' AS run_id, 1L AS seq, 3L AS step, timestamp'2024-01-01 00:00:00' AS ts")
    row = J.elapsed_eta(df, "step", "ts", F.lit(10), now=F.lit("2024-01-01 00:01:00").cast("timestamp")).first()
    assert (row["elapsed_seconds"], row["eta_seconds"]) == (60.0, 0.0)


@pytest.mark.parametrize("last", [20, 300])
def test_newest_rows_by_rank_and_by_position(skewed, last, monkeypatch):
    monkeypatch.setattr(J, "RANK_LIMIT", 100)
    got, src = by_run(J.newest_rows(skewed, last)), by_run(skewed)
    assert {k: [r["seq"] for r in v] for k, v in got.items()} == {k: [r["seq"] for r in v][-last:] for k, v in src.items()}
    thin = by_run(J.decimate(skewed, last, 10))["hot"]
    assert [r["seq"] for r in thin] == [r["seq"] for r in src["hot"]][-last:][::last // 10]


def test_template_marks_inside_inserted_text(spark):
    v = F.parse_json(F.lit('{"a": "1", "b": null}'))
    row = spark.range(1).select(B.fill_template("{{prompt}} {{metadata.b}} {{metadata.c}}", F.lit("x {{metadata.a}}"), F.lit("r"), v, ["a"])).first()
    assert row[0] == "x 1  {{metadata.c}}"


def test_history_chunks_hold_every_row_in_order(skewed):
    got = J.histories(skewed, ["seq", "loss"], chunk=50).collect()
    assert max(len(r["seq_history"]) for r in got) == 50
    joined = [x for r in sorted(got, key=lambda r: r["chunk"]) if r["run_id"] == "hot" for x in r["seq_history"]]
    assert joined == sorted(joined) and len(joined) == skewed.filter("run_id = 'hot'").count()
