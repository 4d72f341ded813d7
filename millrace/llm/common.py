"""Helpers shared by the training-data operators: tables, folds, Arrow row functions, shared tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from millrace.session import shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")  # on bytes: every byte of a non-ASCII letter belongs to the word
SLICE = 256  # rows turned into Python values at a time


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; columns that a table has besides are never read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as empty text."""
    return (F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % n).cast("int")


def words(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased, as UTF-8 bytes; null has none."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def per_text(make: Callable[[], Callable], returns: str):
    """A scalar Arrow UDF over a text column. `make` runs once per task and gives a function from one text (or None)
    to the fields of `returns`, a struct in DDL."""
    struct = T.StructType.fromDDL(returns)
    arrow = to_arrow_type(struct)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = make()
        for column in batches:
            parts = [pa.array([one(t) for t in column.slice(i, SLICE).to_pylist()], type=arrow)
                     for i in range(0, len(column), SLICE)]
            yield pa.concat_arrays(parts) if parts else pa.array([], type=arrow)

    return F.arrow_udf(run, struct)


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in Arrow batches of at most SLICE from here on in this session, unless it has set fewer, so that workers and executors hold few
    texts at a time: what a worker once took it hardly gives back. No result depends on it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= SLICE:
        spark.conf.set(key, SLICE)


def free_name(name: str, *taken) -> str:
    """`name`, with as many underscores in front as it takes to differ (in any case of letters) from all columns of the frames."""
    used = {c.lower() for df in taken for c in df.columns}
    while name.lower() in used:
        name = f"_{name}"
    return name


def annotated(df: DataFrame, udf, text: str, name: str) -> DataFrame:
    """df with the struct column `name` computed from its text column; rows keep all their columns."""
    if name in df.columns:
        raise ValueError(f"the column {name} exists already")
    return df.withColumn(name, udf(F.col(text)))


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, and a lost executor costs only a read."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
