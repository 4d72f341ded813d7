"""Hot groups are cut and results stay the same, also when nothing is broadcast."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import groups as G, skew as S


@pytest.fixture(scope="module")
def rows(spark):
    k = F.when(F.col("id") % 3 == 0, F.lit(0).cast("bigint")).otherwise(F.col("id") % 101)
    return spark.range(6000).select(F.col("id").alias("row"), k.alias("g"), (F.col("id") % 7 / 6).alias("reward"))


@pytest.fixture(params=["10485760", "-1"])
def threshold(spark, request):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def same(a, b):
    assert a.columns == b.columns
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
@pytest.mark.parametrize("hot_rows", [50, 10**6])
def test_salted_join_equals_plain_join(rows, threshold, how, hot_rows):
    stats = rows.groupBy("g").agg(F.count("*").alias("n"), F.avg("reward").alias("m"))
    some = stats.filter("g % 5 <> 1").select("g", "m")
    got = S.join_groups(rows, some, ["g"], stats, how=how, spread=["row"], hot_rows=hot_rows)
    same(got, rows.join(some, "g", how).select(*got.columns))


def test_a_hot_group_is_spread(rows):
    stats = rows.groupBy("g").agg(F.count("*").alias("n"))
    hot = {r["g"]: r["_parts"] for r in S.hot_keys(stats, ["g"], hot_rows=500).collect()}
    assert hot == {0: 5}


def test_advantage_of_a_hot_group(rows, threshold, monkeypatch):
    plain = {(r["row"]): r["advantage"] for r in G.group_advantage(rows, ["g"], spread=["row"]).collect()}
    monkeypatch.setattr(S, "HOT_ROWS", 50)
    again = {(r["row"]): r["advantage"] for r in G.group_advantage(rows, ["g"], spread=["row"]).collect()}
    assert plain.keys() == again.keys() and all(plain[k] == pytest.approx(again[k]) for k in plain)
    assert len(plain) == 6000


def test_teacher_of_a_hot_prompt(rows, threshold):
    df = rows.select("g", F.col("row").cast("string").alias("k"), "reward", F.lit("p").alias("prompt"), F.lit("c").alias("completion"))
    store = G.success_store(df, "g", "k", threshold=0.9)
    assert store.groupBy("g").count().agg(F.max("count")).first()[0] <= 5
    got = G.assign_teacher(df.select("g", "k"), store, "g", "k")
    assert got.count() == 6000
    taught = {r["g"] for r in store.select("g").distinct().collect()}
    assert got.filter("has_teacher").select("g").distinct().count() == len(taught)
