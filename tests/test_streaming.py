"""File by file, restarted from its checkpoint, a stream ends where the batch does."""

import pytest
from pyspark.sql import functions as F

from millrace.plans.frames import frame
from millrace.streaming import live as K

COLUMNS = ["run_id", "seq", "step", "ts", "reward", "prompts_generated"]


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return frame(spark, sf_dir, "metrics").select(*COLUMNS)


def feed(rows, folder, part):
    rows.filter(F.col("seq") % 5 == part).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def source(spark, rows, folder):
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def sets(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def run_twice(spark, rows, folder, start):
    """Two calls on one checkpoint: three files, then the other two."""
    for part in (0, 1, 2):
        feed(rows, folder, part)
    start(source(spark, rows, folder))
    for part in (3, 4):
        feed(rows, folder, part)
    start(source(spark, rows, folder))


def test_latest_state(spark, rows, tmp_path):
    run_twice(spark, rows, tmp_path, lambda s: K.run_to_end(K.latest_state(s), str(tmp_path), "update"))
    schema = K.latest_state(rows).schema
    got = K.newest_per_key(K.written(spark, str(tmp_path), schema), "run_id")
    assert sets(got, "run_id", "rows", "seq", "reward") == sets(K.latest_state(rows), "run_id", "rows", "seq", "reward")


@pytest.mark.parametrize("fold", [2, 32])
def test_bounded_table(spark, rows, tmp_path, fold):
    reduce = K.newest(20)
    run_twice(spark, rows, tmp_path, lambda s: K.reduce_to_end(s, str(tmp_path), reduce, fold))
    got = K.reduced_view(spark, str(tmp_path), rows.schema, reduce, fold)
    assert sets(got, "run_id", "seq") == sets(reduce(rows), "run_id", "seq")


def test_group_signal(spark, rows, tmp_path):
    def shaped(df):
        return K.group_signal(df.select((F.col("step") % 40).alias("group_id"), "reward"), 4)
    run_twice(spark, rows, tmp_path, lambda s: K.run_to_end(shaped(s), str(tmp_path), "update"))
    got = K.newest_per_key(K.written(spark, str(tmp_path), shaped(rows).schema), "group_id")
    assert sets(got, "group_id", "n", "lo", "hi", "complete") == sets(shaped(rows), "group_id", "n", "lo", "hi", "complete")


def test_dedupe_with_enough_lateness(spark, rows, tmp_path):
    run_twice(spark, rows, tmp_path, lambda s: K.run_to_end(K.dedupe_steps(s, delay="60 days"), str(tmp_path)))
    got = K.written(spark, str(tmp_path), rows.schema)
    assert sets(got, "run_id", "step") == sets(rows.select("run_id", "step").distinct(), "run_id", "step")


def test_rows_behind_the_watermark_are_dropped(spark, rows, tmp_path):
    early, late = rows.filter("seq < 300"), rows.filter("seq >= 300")
    for part in (late, early):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        K.run_to_end(K.rates(source(spark, rows, tmp_path), delay="1 hour"), str(tmp_path), "update")
    got = K.newest_per_key(K.written(spark, str(tmp_path), K.rates(rows).schema), "run_id", "window_start")
    assert sets(got, "run_id", "window_start", "n") == sets(K.rates(late), "run_id", "window_start", "n")


def test_a_restart_with_nothing_new_adds_nothing(spark, rows, tmp_path):
    feed(rows, tmp_path, 0)
    for _ in range(2):
        K.run_to_end(source(spark, rows, tmp_path).select(*COLUMNS), str(tmp_path))
    assert K.written(spark, str(tmp_path), rows.schema).count() == rows.filter("seq % 5 = 0").count()


def test_windows_do_not_depend_on_the_session_zone(spark, rows):
    before = spark.conf.get("spark.sql.session.timeZone")
    want = sets(K.rates(rows).select(F.unix_seconds("window_start").alias("w"), "n"), "w", "n")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert sets(K.rates(rows).select(F.unix_seconds("window_start").alias("w"), "n"), "w", "n") == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("fold", [2, 32])
def test_folded_tables_equal_the_batch(spark, rows, tmp_path, fold):
    """Five micro-batches, two calls; no state is kept between them but the folders."""
    grouped = lambda df: df.select((F.col("step") % 40).alias("group_id"), "reward")
    cases = [("latest", K.folded_latest(), lambda df: df, K.latest_state, ["run_id", "rows", "seq", "reward"]),
             ("signal", K.folded_signal(4), grouped, lambda df: K.group_signal(df, 4), ["group_id", "n", "lo", "hi", "complete", "kept"]),
             ("rates", K.folded_rates(), lambda df: df, K.rates, ["run_id", "window_start", "n", "prompts_per_second"])]
    for part in (0, 1, 2):
        feed(rows, tmp_path, part)
    for name, table, shape, _, _ in cases:
        table.run(shape(source(spark, rows, tmp_path)), f"{tmp_path}/{name}", fold)
    for part in (3, 4):
        feed(rows, tmp_path, part)
    for name, table, shape, batch, columns in cases:
        table.run(shape(source(spark, rows, tmp_path)), f"{tmp_path}/{name}", fold)
        assert sets(table.view(shape(rows), f"{tmp_path}/{name}", fold), *columns) == sets(batch(shape(rows)), *columns)
        assert "StateStore" not in str(list((tmp_path / name / "checkpoint").iterdir())) and not (tmp_path / name / "checkpoint" / "state").exists()


def test_folded_rates_count_late_rows(spark, rows, tmp_path):
    for part in (rows.filter("seq >= 300"), rows.filter("seq < 300")):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        K.folded_rates().run(source(spark, rows, tmp_path), str(tmp_path))
    assert sets(K.folded_rates().view(rows, str(tmp_path)), "run_id", "window_start", "n") == sets(K.rates(rows), "run_id", "window_start", "n")


def test_streamed_tables_may_be_folders(spark, sf_dir, tmp_path):
    from millrace.plans.live import stream_extract

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    of_folder, of_file = stream_extract(spark, str(tmp_path)), stream_extract(spark, sf_dir)
    assert sorted(of_folder.collect()) == sorted(of_file.collect()) != []
