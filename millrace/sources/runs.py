"""Run logs: metrics lines, sample lines, run folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from millrace.functions import paths as P
from millrace.functions.text import computed_once, strip
from millrace.operators.skew import join_groups
from millrace.session import written

_PLAIN = (T.StringType, T.NumericType)


def metrics_lines(df: DataFrame, fixed: list[str]) -> DataFrame:
    """One JSON line per row: the fixed keys, then every further number or text column; others are left out."""
    extra = [f.name for f in df.schema.fields if f.name not in fixed and isinstance(f.dataType, _PLAIN)]
    return df.select(F.to_json(F.struct(*fixed, *extra), {"ignoreNullFields": "false"}).alias("value"))


def write_metrics(df: DataFrame, path: str, fixed: list[str]) -> None:
    metrics_lines(df, fixed).write.mode("append").text(path)


def read_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return parse_metrics(spark.read.text(path), schema, "value")


def parse_metrics(lines: DataFrame, schema: str, line: str = "line") -> DataFrame:
    """Metrics rows of JSON lines; blank and broken lines are skipped."""
    fields = T.StructType.fromDDL(schema).fields
    rest = [c for c in lines.columns if c != line]
    parsed = computed_once(lines.filter(strip(F.col(line)) != ""), _v=P.parse(F.col(line))).filter("_v IS NOT NULL")
    return parsed.select(*rest, *[F.try_variant_get("_v", f"$.{f.name}", f.dataType.simpleString()).alias(f.name)
                                  for f in fields])


def tail_lines(lines: DataFrame, order: str, schema: str, last: int = 5000, line: str = "line") -> DataFrame:
    """Parsed rows among the last ``last`` non-blank lines; broken ones count towards the limit."""
    newest = lines.filter(strip(F.col(line)) != "").orderBy(F.col(order).desc()).limit(last)
    return parse_metrics(newest, schema, line)


def sample_rows(df: DataFrame, by: list[str], key: str, per_row: int = 256) -> DataFrame:
    """Completions gathered per prompt into nested sample rows; those of no prompt are left out.

    A prompt with very many completions is written as several rows, so no row grows without bound. Only such prompts are written to a table
    that the completions are joined with; while it is small the completions are not moved for it.
    """
    df = df.dropna(subset=by)
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / per_row).alias("rows_out"))
    crowded = written(sizes.where("rows_out > 1"), "crowded")
    item = F.struct(key, "completion", "reward")
    rows = (join_groups(df, crowded.drop("n"), by, crowded, how="left", spread=[key])
            .withColumn("part", F.pmod(F.xxhash64(F.lit("part"), key), F.coalesce("rows_out", F.lit(1))))
            .groupBy(*by, "part").agg(F.first("prompt").alias("prompt"), F.sort_array(F.collect_list(item)).alias("items")))
    return rows.select(*by, "part", "prompt", F.transform("items", lambda x: x[key]).alias("keys"),
                       F.transform("items", lambda x: x["completion"]).alias("completions"),
                       F.transform("items", lambda x: x["reward"]).alias("rewards"),
                       F.transform("items", lambda x: F.concat(F.col("prompt"), x["completion"])).alias("full_texts"))


def write_samples(df: DataFrame, path: str, gzip: bool = False) -> None:
    df.write.mode("append").option("compression", "gzip" if gzip else "none").json(path)


def read_samples(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def explode_samples(df: DataFrame, by: list[str]) -> DataFrame:
    """One row per completion of sample rows."""
    zipped = F.arrays_zip("keys", "completions", "rewards", "full_texts")
    return df.select(*by, F.explode(zipped).alias("z")).select(
        *by, F.col("z.keys").alias("comp_id"), F.col("z.completions").alias("completion"),
        F.col("z.rewards").alias("reward"), F.col("z.full_texts").alias("full_text"))


def read_run_files(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """One JSON file per run folder (``root/<run>/<name>``) with the run's folder name."""
    df = spark.read.schema(schema).option("multiLine", True).json(f"{root}/*/{name}")
    return df.withColumn("run_id", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def registry(configs: DataFrame, statuses: DataFrame, newest: str, limit: int = 200) -> DataFrame:
    """Runs with their status, newest first."""
    return (configs.join(statuses, "run_id", "left")
            .orderBy(F.col(newest).desc(), F.col("run_id")).limit(limit))


def without_empty(runs: DataFrame) -> DataFrame:
    """Drop runs that did nothing unless they are still at work."""
    idle = (F.coalesce("current_step", F.lit(0)) == 0) & (F.coalesce("checkpoints", F.lit(0)) == 0)
    busy = F.coalesce("status", F.lit("unknown")).isin("training", "running")
    return runs.filter(~idle | busy)
