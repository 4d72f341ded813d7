"""Order-dependent work without a global sort into one task.

Rows are cut into blocks by their key; each block is handled on its own and block totals, a far
smaller table, carry the state from block to block. A block of a unique integer key holds at most
``2**bits`` rows, so no task grows with the data, whatever share of it one group holds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from millrace.session import shared_dir, written

BITS = 16  # rows of a block: at most 65,536, so that wide rows still sort in memory
SUPER_BITS = 24  # blocks of a super-block; block totals are narrow


def _blocked(df: DataFrame, key: str, bits: int, by: Sequence[str] = ()) -> DataFrame:
    """Add ``_b``, a block number that grows with the key. Integers are cut at fixed places. Keys of other kinds are
    range-partitioned once, and the rows written with their partition's number, so that every later use sees the same blocks."""
    if isinstance(df.schema[key].dataType, T.IntegralType):
        return df.withColumn("_b", F.shiftright(F.col(key).cast("bigint"), bits))
    path = shared_dir(df.sparkSession, "blocks")
    df.repartitionByRange(*by, key).withColumn("_b", F.spark_partition_id().cast("bigint")).write.parquet(path)
    return df.sparkSession.read.schema(T.StructType([*df.schema.fields, T.StructField("_b", T.LongType())])).parquet(path)


def _before(window_keys, order, end):
    order = [order] if isinstance(order, str) else order
    return Window.partitionBy(*window_keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)


def _sums(columns, window):
    return [F.coalesce(F.sum(c).over(window), F.lit(0)) for c in columns]


def _offsets(tagged: DataFrame, by: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """Per block, the sums over all blocks before it, as ``_off_<name>``: within super-blocks, then over these."""
    blocks = tagged.groupBy(*by, "_b").agg(*[c.alias(n) for n, c in sums.items()]).withColumn("_t", F.shiftright(F.col("_b"), SUPER_BITS))
    tops = blocks.groupBy(*by, "_t").agg(*[F.sum(n).alias(n) for n in sums])
    tops = tops.select(*by, "_t", *[c.alias(f"_top_{n}") for c, n in zip(_sums(sums, _before(by, "_t", -1)), sums)])
    mids = blocks.select(*by, "_t", "_b", *[c.alias(f"_mid_{n}") for c, n in zip(_sums(sums, _before([*by, "_t"], "_b", -1)), sums)])
    return mids.join(tops.hint("merge"), [*by, "_t"]).select(*by, "_b", *[(F.col(f"_mid_{n}") + F.col(f"_top_{n}")).alias(f"_off_{n}") for n in sums])


def _near(tagged: DataFrame, before: DataFrame) -> DataFrame:
    """Rows of the blocks in ``before``, the first ones in key order, with their offsets. The blocks are written and the last one's number
    leaves the other rows out before any is moved; neither side is broadcast, as the planner can take wide rows for a small table."""
    before = written(before, "before")
    last = before.agg(F.max("_b").alias("b")).first()["b"]
    return tagged.where(F.col("_b") <= F.lit(last).cast("bigint")).join(before.hint("merge"), "_b")


def running_totals(df: DataFrame, key: str, values: Mapping[str, Column], by: Sequence[str] = (),
                   inclusive: bool = False, bits: int = BITS, tie: Sequence[str] = ()) -> DataFrame:
    """Add, per entry of ``values``, its sum over all rows before this one (and this one if ``inclusive``).

    ``key`` is unique (within ``by``) together with ``tie``. All groups are cut along the key.
    """
    by, names = list(by), list(values)
    tagged = _blocked(df, key, bits, by).select("*", *[values[n].alias(f"_v_{n}") for n in names])
    local = _before([*by, "_b"], [key, *tie], 0 if inclusive else -1)
    inner = tagged.select(*df.columns, "_b", *[c.alias(f"_in_{n}") for c, n in zip(_sums([f"_v_{n}" for n in names], local), names)])
    offsets = _offsets(tagged, by, {n: F.sum(f"_v_{n}") for n in names})
    # Both sides are cut by block already; without the hint the planner may broadcast the rows.
    return inner.join(offsets.hint("merge"), [*by, "_b"]).select(*df.columns, *[(F.col(f"_in_{n}") + F.col(f"_off_{n}")).alias(n) for n in names])


def first_rows(df: DataFrame, key: str, rows: int, bits: int = BITS, tie: Sequence[str] = ()) -> DataFrame:
    """The first ``rows`` rows in key order. Block counts place the cut; only rows of the blocks before it are moved, and no block is
    larger than its width."""
    tagged = _blocked(df, key, bits)
    near = _offsets(tagged.select("_b"), (), {"n": F.count(F.lit(1))}).where(F.col("_off_n") < rows)
    place = F.row_number().over(Window.partitionBy("_b").orderBy(key, *tie))
    return _near(tagged, near).withColumn("_n", place).where(F.col("_off_n") + F.col("_n") <= rows).select(*df.columns)


def within_total(df: DataFrame, key: str, size: str, limit: int, name: str, bits: int = BITS) -> DataFrame:
    """Longest prefix in key order whose sizes add up to at most ``limit``, with the running sum; the cut is placed as in ``first_rows``."""
    tagged = _blocked(df, key, bits)
    near = _offsets(tagged.select("_b", size), (), {"n": F.sum(size)}).where(F.col("_off_n") <= limit)
    so_far = F.sum(size).over(_before(["_b"], key, 0))
    kept = _near(tagged, near).withColumn(name, (F.col("_off_n") + so_far).cast("bigint"))
    return kept.where(F.col(name) <= limit).select(*df.columns, name)


def global_index(df: DataFrame, key: str, name: str = "idx", by: Sequence[str] = (), bits: int = BITS,
                 tie: Sequence[str] = ()) -> DataFrame:
    """Dense 0-based position in key order."""
    return running_totals(df, key, {name: F.lit(1).cast("bigint")}, by=by, bits=bits, tie=tie)


def file_line_key(df: DataFrame, name: str = "line_key") -> DataFrame:
    """A key in file order for a freshly read text file: split number above bit 33, line number below.

    Use it with ``bits=33`` so that a block is one input split.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


def _blocks_with_tail(df: DataFrame, pos: str, rows: int, bits: int) -> DataFrame:
    """Rows by block of positions ``_b``; each block also gets the last ``rows - 1`` rows of the block before it."""
    size = 1 << bits
    if rows > size:
        raise ValueError("a trailing window must fit into one block")
    b = F.shiftright(F.col(pos), bits)
    in_tail = F.pmod(F.col(pos), F.lit(size)) >= size - (rows - 1)
    spread = F.when(in_tail, F.array(b, b + 1)).otherwise(F.array(b)) if rows > 1 else F.array(b)
    return df.withColumn("_b", F.explode(spread)).withColumn("_own", F.col("_b") == b)


def trailing(df: DataFrame, by: Sequence[str], pos: str, rows: int, exprs: dict[str, tuple], bits: int = 16) -> DataFrame:
    """Aggregates over this row and the ``rows - 1`` before it, per group, by dense position.

    ``exprs`` maps an output name to ``(function, column)``. A group is never gathered in one task.
    """
    cut = _blocks_with_tail(df, pos, rows, bits)
    w = Window.partitionBy(*by, "_b").orderBy(pos).rowsBetween(-(rows - 1), 0)
    out = cut.select("*", *[fn(column).over(w).alias(name) for name, (fn, column) in exprs.items()])
    return out.filter("_own").drop("_b", "_own")


def trailing_counts(df: DataFrame, by: Sequence[str], pos: str, rows: int, flags: dict[str, Column], bits: int = 16) -> DataFrame:
    """How often each flag held among this row and the ``rows - 1`` before it.

    Running counts less those ``rows`` back: the cost per row does not depend on the width.
    """
    cut = _blocks_with_tail(df.withColumns({f"_f_{n}": c.cast("bigint") for n, c in flags.items()}), pos, rows, bits)
    order = Window.partitionBy(*by, "_b").orderBy(pos)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = cut.select("*", *[F.sum(f"_f_{n}").over(so_far).alias(f"_c_{n}") for n in flags])
    out = run.select("*", *[(F.col(f"_c_{n}") - F.coalesce(F.lag(f"_c_{n}", rows).over(order), F.lit(0))).alias(n) for n in flags])
    return out.filter("_own").select(*df.columns, *flags)


def previous(df: DataFrame, by: Sequence[str], pos: str, column: str, name: str, bits: int = 16) -> DataFrame:
    """Value of ``column`` in the row before, per group, by dense position (null on the first)."""
    order = Window.partitionBy(*by, "_b").orderBy(pos)
    out = _blocks_with_tail(df, pos, 2, bits).withColumn(name, F.lag(column).over(order))
    return out.filter("_own").drop("_b", "_own")


def following(df: DataFrame, by: Sequence[str], pos: str, column: str, name: str, bits: int = 16) -> DataFrame:
    """Value of ``column`` in the row after, per group, by dense position (null on the last). Each block also gets the next one's first row."""
    b = F.shiftright(F.col(pos), bits)
    first = (F.pmod(F.col(pos), F.lit(1 << bits)) == 0) & (F.col(pos) > 0)
    cut = df.withColumn("_b", F.explode(F.when(first, F.array(b, b - 1)).otherwise(F.array(b)))).withColumn("_own", F.col("_b") == b)
    out = cut.withColumn(name, F.lead(column).over(Window.partitionBy(*by, "_b").orderBy(pos)))
    return out.filter("_own").drop("_b", "_own")


def carry_last(df: DataFrame, by: Sequence[str], key: str, column: str, name: str, bits: int = BITS) -> DataFrame:
    """Last non-null ``column`` at or before each row, per group, in key order (an as-of lookup)."""
    by = list(by)
    tagged = df.withColumn("_b", F.shiftright(F.col(key), bits))
    local = Window.partitionBy(*by, "_b").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    ends = tagged.groupBy(*by, "_b").agg(
        F.max_by(F.when(F.col(column).isNotNull(), F.col(column)),
                 F.when(F.col(column).isNotNull(), F.col(key))).alias("_last"))
    # The last value before a block: within its super-block, else from the super-blocks before. Block ends are written: both steps read them.
    ends = written(ends, "ends").withColumn("_t", F.shiftright(F.col("_b"), SUPER_BITS))
    within, over = _before([*by, "_t"], "_b", -1), _before(by, "_t", -1)
    tops = ends.groupBy(*by, "_t").agg(F.max_by(F.when(F.col("_last").isNotNull(), F.col("_last")), F.when(F.col("_last").isNotNull(), F.col("_b"))).alias("_end"))
    tops = tops.select(*by, "_t", F.last("_end", ignorenulls=True).over(over).alias("_far"))
    near = ends.select(*by, "_t", "_b", F.last("_last", ignorenulls=True).over(within).alias("_near"))
    ends = near.join(tops.hint("merge"), [*by, "_t"]).select(*by, "_b", F.coalesce("_near", "_far").alias("_before"))
    return (tagged.withColumn("_here", F.last(column, ignorenulls=True).over(local))
            .join(ends.hint("merge"), [*by, "_b"])
            .withColumn(name, F.coalesce("_here", "_before"))
            .select(*df.columns, name))
