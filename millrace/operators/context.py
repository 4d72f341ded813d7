"""What of a long conversation stays in an agent's context: the goal and the recent turns, with a reset at a token limit.

Resets depend on the sum since the last one, so a conversation is a chain. It is cut into blocks of turns. A context never holds more turns than
the limit has tokens, fewer than a block, so a context that begins in a block ends in it or in the next one. For every turn of a block the
place where a chain that starts there leaves the block is found on its own; these steps are then combined two by two over blocks, so the
state in front of every block is known after log2(blocks) joins, and all blocks are scanned at once. No conversation has to fit into a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.operators.ordering import global_index
from millrace.session import written

BITS = 16  # turns of a block: at least 65,536
_STATE = ["_goal", "_carry", "_before"]


def _steps(turns: DataFrame, goals: DataFrame, limit: int, bits: int) -> DataFrame:
    """For every turn of every block that has one behind it: where a chain of contexts that begins there enters the next block (null: not at all),
    the sum it brings to the end of the block, and the contexts it begins on the way."""
    width = 1 << bits
    block = F.shiftright("_pos", bits)
    near = F.when((block > 0) & (F.pmod(F.col("_pos"), F.lit(width)) < limit), F.array(block, block - 1)).otherwise(F.array(block))
    spread = turns.withColumn("_block", F.explode(near)).join(goals, ["_c", "_block"])

    def run(key, table):
        table = table.sort_by("_pos")
        pos, cost = (table.column(c).to_numpy().astype(np.int64) for c in ("_pos", "_cost"))
        first, goal = int(key[1].as_py()) * width, table.column("_goal")[0].as_py()
        own = int(np.searchsorted(pos, first + width))
        total = np.concatenate([[0], np.cumsum(cost)])
        # The context of turn p ends before the first turn that takes the sum over the limit; it has one turn at least.
        after = np.maximum(np.searchsorted(total, limit - goal + total[:own], "right") - 1, np.arange(own) + 1)
        leaves, last, begun = np.where(after >= own, after, 0).tolist(), list(range(own)), [1] * own
        for p, q in zip(range(own - 1, -1, -1), after[::-1].tolist()):
            if q < own:
                leaves[p], last[p], begun[p] = leaves[q], last[q], begun[q] + 1
        carry = goal + total[own] - total[np.array(last, np.int64)]
        enters = pa.array([int(pos[q]) if q < len(pos) else None for q in leaves], pa.int64())
        n = pa.array([key[0].as_py()] * own, pa.string()), pa.array([key[1].as_py()] * own, pa.int64())
        return pa.table([*n, pa.array(pos[:own]), enters, pa.array(carry), pa.array(begun, pa.int64())], names=["_c", "_block", "_from", "_to", "_carry", "_begun"])

    return spread.groupBy("_c", "_block").applyInArrow(run, "_c string, _block long, _from long, _to long, _carry long, _begun long")


def _block_states(turns: DataFrame, limit: int, bits: int) -> DataFrame | None:
    """_c, _block, the goal's tokens, the sum and the number of contexts in front of every block but the first of its conversation."""
    block = F.shiftright("_pos", bits)
    most = turns.agg(F.max(block)).first()[0] or 0  # one number: how often to double
    if not most:
        return None
    long = turns.groupBy("_c").agg(F.max(block).alias("_blocks"), F.max(F.when(F.col("_pos") == 0, F.col("_cost"))).alias("_goal")).where("_blocks > 0")
    goals = written(long.select("_c", "_goal", F.explode(F.sequence(F.lit(0).cast("bigint"), "_blocks")).alias("_block")), "goals")
    first = _steps(turns.select("_c", "_pos", "_cost"), goals, limit, bits)
    steps = lift = written(first, "steps")
    known = goals.where("_block = 0").select("_c", "_block", F.lit(1).cast("bigint").alias("_from"), F.lit(0).cast("bigint").alias("_before"))
    width = 1
    while width <= most:
        reached = known.join(lift, ["_c", "_block", "_from"]).where("_to is not null")
        known = written(known.unionByName(reached.select("_c", (F.col("_block") + width).alias("_block"), F.col("_to").alias("_from"), (F.col("_before") + F.col("_begun")).alias("_before"))), "known")
        width *= 2
        if width <= most:
            on = lift.select("_c", (F.col("_block") - width // 2).alias("_block"), F.col("_from").alias("_to"), F.col("_to").alias("_next"), F.col("_begun").alias("_more"))
            lift = written(lift.join(on, ["_c", "_block", "_to"]).select("_c", "_block", "_from", F.col("_next").alias("_to"), "_carry", (F.col("_begun") + F.col("_more")).alias("_begun")), "lift")
    # A block's last sum is the state in front of the next one.
    ends = known.join(steps, ["_c", "_block", "_from"]).select("_c", (F.col("_block") + 1).alias("_block"), "_carry", (F.col("_before") + F.col("_begun")).alias("_before"))
    return ends.join(goals, ["_c", "_block"]).select("_c", "_block", *_STATE)


def _scan(rows: DataFrame, limit: int) -> DataFrame:
    """Every block in order, from the state in front of it: context and sum of each turn."""
    out = T.StructType([*[f for f in rows.schema.fields if f.name not in _STATE], T.StructField("_context", T.LongType()), T.StructField("_sum", T.LongType())])
    arrow, passed = to_arrow_schema(out), [f.name for f in rows.schema.fields if f.name not in _STATE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, goal, total, context = None, 0, 0, 0
        for batch in batches:
            contexts, sums = [], []
            for c, b, pos, cost, *state in zip(*[batch.column(batch.schema.names.index(n)).to_pylist() for n in ("_c", "_block", "_pos", "_cost", *_STATE)]):
                if (c, b) != at:
                    at = (c, b)
                    goal, total, context = state if b else (cost, 0, 0)
                if pos == 0:
                    total = cost
                elif pos == 1 or total + cost > limit:
                    total, context = goal + cost, context + 1
                else:
                    total += cost
                contexts.append(max(context - 1, 0))
                sums.append(total)
            columns = [batch.column(batch.schema.names.index(n)).cast(t) for n, t in zip(passed, arrow.types)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(contexts, pa.int64()), pa.array(sums, pa.int64())], schema=arrow)

    return rows.mapInArrow(run, out)


def keep_recent(df: DataFrame, conversation: str, turn: str, size: str, keep: int, limit: int, bits: int = BITS) -> DataFrame:
    """df with context (from 0), context_tokens (the goal and the turns of the context up to this one) and kept (columns of these names are replaced).

    The first turn is the goal and belongs to every context. A turn that would take the sum over ``limit`` tokens begins a new context with
    the goal and itself. Of a context the last ``keep`` turns are kept; the goal always is. A turn counts one token at least; null sizes are 0.

    Turns without number come last, conversations without id are one conversation, and equal numbers keep some order of their own.
    """
    df = df.drop("context", "context_tokens", "kept")
    while 1 << bits <= limit:
        bits += 1
    cost = F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(1)), F.lit(1)).cast("bigint")
    named = df.withColumns({"_c": F.coalesce(F.concat(F.lit("c"), F.col(conversation).cast("string")), F.lit("")), "_turn": F.coalesce(F.col(turn).cast("bigint"), F.lit((1 << 62) - 1)), "_cost": cost})
    rows = written(global_index(named, "_turn", "_pos", by=["_c"]).drop("_turn"), "turns")
    states = _block_states(rows, limit, bits)
    blocks = rows.withColumn("_block", F.shiftright("_pos", bits))
    if states is None:
        blocks = blocks.withColumns({c: F.lit(None).cast("bigint") for c in _STATE})
    else:
        blocks = blocks.join(states, ["_c", "_block"], "left")
    found = written(_scan(blocks.repartition("_c", "_block").sortWithinPartitions("_c", "_block", "_pos"), limit), "contexts")
    # A turn is among the last `keep` of its context if the turn `keep` places on belongs to another one, or to none.
    later = found.select("_c", (F.col("_pos") - keep).alias("_pos"), F.col("_context").alias("_later"))
    kept = (F.col("_pos") == 0) | F.col("_later").isNull() | (F.col("_later") != F.col("_context"))
    out = found.join(later, ["_c", "_pos"], "left")
    return out.select(*df.columns, F.col("_context").alias("context"), F.col("_sum").alias("context_tokens"), (kept if keep > 0 else F.col("_pos") == 0).alias("kept"))


def blanked(df: DataFrame, text: str) -> DataFrame:
    """The text of turns that aren't kept is empty."""
    return df.withColumn(text, F.when(F.col("kept"), F.col(text)).otherwise(F.lit("")))
