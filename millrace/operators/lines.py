"""Lines that many documents share: menus, footers, licence lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.text import let, strip
from millrace.operators.skew import join_groups
from millrace.session import written


def _key(line: Column) -> list[Column]:
    """128 bits of a line without the white space around it."""
    return [F.xxhash64(strip(line)), F.xxhash64(F.lit("line"), strip(line))]


def line_counts(df: DataFrame, text: str) -> DataFrame:
    """_k1, _k2, n: in how many rows a line stands. Lines of white space are no lines. Counts are combined before they are shuffled,
    so a line of a third of all rows costs one row per task."""
    own = F.transform(F.filter(F.split(text, "\n", -1), lambda x: strip(x) != ""), lambda x: F.struct(*[k.alias(n) for k, n in zip(_key(x), ("_k1", "_k2"))]))
    return df.select(F.inline(F.array_distinct(own))).groupBy("_k1", "_k2").agg(F.count(F.lit(1)).alias("n"))


def without_places(lines: Column, places: Column) -> Column:
    """The lines but those at the places (from 0, in order): the stretches between the places, joined."""
    edges = F.concat(F.array(F.lit(-1)), places, F.array(F.size(lines)))
    gaps = F.transform(F.sequence(F.lit(1), F.size(places) + 1), lambda i: F.struct((F.element_at(edges, i) + 1).alias("at"), (F.element_at(edges, i + 1) - F.element_at(edges, i) - 1).alias("n")))
    return F.flatten(F.transform(gaps, lambda g: F.slice(lines, g["at"] + 1, g["n"])))


def drop_repeated_lines(df: DataFrame, text: str, min_documents: int, hot_rows: int | None = None) -> DataFrame:
    """df with the lines that stand in ``min_documents`` rows or more taken out of the text, and lines_removed (a column of this name is replaced).

    Lines are compared without white space around them; blank lines stay. What is left keeps its order. Only keys and places of lines are
    shuffled, texts once, by row. A null text stays null, a text of repeated lines only becomes empty; equal rows are rows of their own.
    """
    df = df.drop("lines_removed")
    rows = written(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    counts = written(line_counts(rows, text).where(F.col("n") >= min_documents), "lines")
    places = rows.select("_row", F.posexplode(F.split(text, "\n", -1)).alias("_at", "_line")).where(strip(F.col("_line")) != "")
    keyed = places.select("_row", "_at", *[k.alias(n) for k, n in zip(_key(F.col("_line")), ("_k1", "_k2"))])
    hits = join_groups(keyed, counts.select("_k1", "_k2"), ["_k1", "_k2"], counts, spread=["_row", "_at"], hot_rows=hot_rows)
    gone = hits.groupBy("_row").agg(F.sort_array(F.collect_list("_at")).alias("_gone"))
    left = let(F.split(text, "\n", -1), lambda lines: F.array_join(without_places(lines, F.col("_gone")), "\n"))
    joined = rows.join(gone, "_row", "left")
    return joined.withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(left)).select(*df.columns, F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint").alias("lines_removed"))
