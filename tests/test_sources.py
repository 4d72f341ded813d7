"""Reading and writing of files."""

import gzip
import json
import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import paths as P
from millrace.operators import fields as B
from millrace.operators.ordering import file_line_key, global_index
from millrace.sources import runs as SR, text as ST

LINES = ['{"text": " a "}', "", "{broken", '{"other": 1}', '{"text": ""}', '[1]', '{"text": null}', '{"text": "b"}']


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "c.jsonl").write_text("\n".join(LINES) + "\n")
    (tmp_path / "c.txt").write_text(" a \n\n\t\nb\n")
    with gzip.open(tmp_path / "c.jsonl.gz", "wt") as f:
        f.write("\n".join(LINES) + "\n")
    (tmp_path / "c.json").write_text(json.dumps([{"x": 1}, {"y": "z"}]))
    (tmp_path / "c.csv").write_text("x,y\n1,2\n")
    return tmp_path


def texts(df):
    return sorted(r["text"] for r in df.collect())


def test_corpus_formats(spark, folder):
    assert texts(ST.read_corpus(spark, f"{folder}/c.jsonl")) == ["a", "b"]
    assert texts(ST.read_corpus(spark, f"{folder}/c.jsonl", strict=False)) == ["", "", "", "", " a ", "b"]
    assert texts(ST.read_corpus(spark, f"{folder}/c.jsonl.gz")) == ["a", "b"]
    assert texts(ST.read_corpus(spark, f"{folder}/c.txt")) == ["a", "b"]
    with pytest.raises(ValueError):
        ST.read_corpus(spark, f"{folder}/c.json")


def test_preview_and_catalog(spark, folder):
    assert set(ST.read_preview(spark, f"{folder}/c.json").columns) == {"x", "y"}
    assert ST.read_preview(spark, f"{folder}/c.csv").first()["y"] == "2"
    assert {r["name"] for r in ST.catalog(spark, str(folder)).collect()} == {"c.jsonl", "c.txt", "c.jsonl.gz"}


def test_preview_of_an_object_of_columns(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"x": [1, 2], "y": "z"}, indent=1))
    row = ST.read_preview(spark, f"{tmp_path}/c.json").first()
    assert (row["x"], row["y"]) == (1, "z")


def test_suggested_fields():
    assert B.suggest_fields(["text", "label", "problem"]) == ("problem", "label")
    assert B.suggest_fields(["x"]) == (None, None)


def test_broken_prompt_line_is_an_error(spark):
    df = spark.createDataFrame([("{bad",)], "line string")
    with pytest.raises(Exception):
        ST.prompt_records(df).collect()


def test_missing_record_key_is_an_error(spark):
    df = spark.createDataFrame([({"prompt": "p"},)], "r map<string,string>")
    with pytest.raises(Exception, match="record without answer"):
        ST.from_records(df, "r").collect()


def test_lines_keep_file_order(spark, tmp_path):
    path = tmp_path / "big.txt"
    path.write_text("".join(f"line {i}\n" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = file_line_key(ST.read_lines(spark, str(path)))
        assert df.rdd.getNumPartitions() > 3
        got = global_index(df, "line_key", bits=33)
        assert got.filter(F.col("line") != F.concat(F.lit("line "), F.col("idx").cast("string"))).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_metrics_sink_leaves_out_other_types(spark, tmp_path):
    df = spark.sql("SELECT 1 AS step, 2.5D AS loss, 'ok' AS status, array(1) AS extra, CAST(NULL AS DOUBLE) AS kl")
    SR.write_metrics(df, f"{tmp_path}/m", ["step", "loss"])
    SR.write_metrics(df, f"{tmp_path}/m", ["step", "loss"])
    lines = [r[0] for r in spark.read.text(f"{tmp_path}/m").collect()]
    assert len(lines) == 2 and json.loads(lines[0]) == {"step": 1, "loss": 2.5, "status": "ok", "kl": None}


def test_run_files(spark, tmp_path):
    for run, text in (("r1", '{"status": "training"}'), ("r2", '{"status": "error",\n "n": 1}')):
        (tmp_path / run).mkdir()
        (tmp_path / run / "status.json").write_text(text)
    got = SR.read_run_files(spark, str(tmp_path), "status.json", "status string")
    assert {(r["run_id"], r["status"]) for r in got.collect()} == {("r1", "training"), ("r2", "error")}


def test_empty_runs_are_dropped_unless_at_work(spark):
    data = [("a", 0, 0, "done"), ("b", 0, 0, "training"), ("c", 3, 0, "done"), ("d", None, None, None)]
    df = spark.createDataFrame(data, "run_id string, current_step int, checkpoints int, status string")
    assert {r["run_id"] for r in SR.without_empty(df).collect()} == {"b", "c"}


def test_large_sample_groups_are_cut(spark):
    df = spark.range(1000).select(F.lit(1).alias("g"), F.col("id").cast("string").alias("k"), F.lit("p").alias("prompt"),
                                  F.lit("c").alias("completion"), F.lit(0.5).alias("reward"))
    rows = SR.sample_rows(df, ["g"], "k", per_row=100)
    assert rows.count() == 10
    assert SR.explode_samples(rows, ["g"]).select("comp_id").distinct().count() == 1000


RECORD = {"a": {"b": "x", "n": None, "f": True}, "m": [{"c": "1"}, {"d": 2}, "s"], "l": ["p", " ", None, "q"], "k": [[{"z": 1}]]}


@pytest.mark.parametrize("path,want", [
    ("a.b", "x"), ("a.f", "True"), ("a.n", ""), ("a.x.y", ""), ("m[0].c", "1"), ("m[9].c", ""), ("m[1].d", "2"), ("l [список из 4 эл.]", "p\nq"), ("l[3]", "q"),
    ("m[].c", "1"), ("", ""), ("a.b.c", ""), ("k[0]", "{'z': 1}")])
def test_paths(spark, path, want):
    df = spark.createDataFrame([(json.dumps(RECORD),)], "line string").select(P.parse(F.col("line")).alias("v"))
    assert df.select(P.text_at(F.col("v"), path)).first()[0] == want


def test_lenient_paths(spark):
    df = spark.createDataFrame([(json.dumps(RECORD),)], "line string").select(P.parse(F.col("line")).alias("v"))
    row = df.select(F.to_json(P.get(F.col("v"), "m[].c")), F.to_json(P.get(F.col("v"), "m[].c", lenient=True)),
                    P.as_text(P.get(F.col("v"), "m.0.c", lenient=True))).first()
    assert json.loads(row[0]) == ["1", None, None] and json.loads(row[1]) == ["1", None] and row[2] == "1"


def test_wide_rows_are_never_broadcast(spark):
    """Behind a dropped VARIANT the planner takes lines for a small table; with few blocks it broadcast them, not the block sums."""
    lines = spark.range(300).select("id", F.concat(F.lit('{"text": "a'), F.col("id").cast("string"), F.lit('"}')).alias("line"))
    for df in (ST.extract(lines, "id", max_rows=20), ST.extract(lines, "id", max_bytes=100), global_index(ST.jsonl_texts(lines), "id")):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert [r.id for r in ST.extract(lines, "id", max_rows=3).orderBy("id").collect()] == [0, 1, 2]
    assert ST.extract(lines.where("id < 0"), "id", max_rows=3).count() == ST.extract(lines, "id", max_bytes=1).count() == 0


def test_sample_rows_move_completions_once(spark, tmp_path):
    """Prompts of few completions need no join with the sizes: one exchange of the rows is left."""
    rows = [(i // 3, f"k{i}", "p", f"c{i}", 0.1) for i in range(30)] + [(None, "x", "p", "c", 0.1)]
    df = spark.createDataFrame(rows, "g int, k string, prompt string, completion string, reward double")
    out = SR.sample_rows(df, ["g"], "k")
    assert len(re.findall(r"Exchange hashpartitioning", out._jdf.queryExecution().executedPlan().toString())) == 1
    assert sorted(r.comp_id for r in SR.explode_samples(out, ["g"]).collect()) == sorted(r[1] for r in rows[:-1])
