"""Best-fit packing of whole documents into windows of a fixed number of tokens.

Documents are ordered by length (ties by hash) and dealt in turn to blocks of at most BLOCK_ROWS, so every block has the lengths of the whole table
in small. A block is packed longest first: an ordered index of free room gives the fullest window that still holds the document. Blocks know
nothing of each other; each leaves one nearly empty window at most.

Cases: a null or negative length counts as 0, and a document of length 0 takes a segment without tokens. A document over the capacity is never
cut: it stands alone in a window marked `oversized`. Null and repeated ids are packed row by row; an empty table has no windows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.text import hash60
from millrace.operators.ordering import global_index

BLOCK_ROWS = 50_000
_HASH = 40  # bits of the hash behind a length
_BLOCK_BITS = 24  # ordered keys of one length fall into 2**16 blocks


class FreeRoom:
    """Windows by free room: the fullest one with room for a length in log time."""

    def __init__(self, capacity: int):
        self.capacity, self.windows = capacity, 0
        self.rooms: list[int] = []  # values that occur, in order
        self.at: dict[int, list[int]] = defaultdict(list)

    def place(self, length: int) -> tuple[int, int]:
        """(window, first token) for a document."""
        k = bisect_left(self.rooms, length)
        if k == len(self.rooms):
            room, window, self.windows = self.capacity, self.windows, self.windows + 1
        else:
            room = self.rooms[k]
            window = self.at[room].pop()
            if not self.at[room]:
                del self.rooms[k]
        left = room - length
        if not self.at[left]:
            insort(self.rooms, left)
        self.at[left].append(window)
        return window, self.capacity - room


def pack_documents(df: DataFrame, key: str, length: str, capacity: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """df with window, segment (from 1 in a window), start (first token) and oversized (columns of these names are replaced)."""
    df = df.drop("window", "segment", "start", "oversized")
    size = F.greatest(F.coalesce(F.col(length).cast("bigint"), F.lit(0)), F.lit(0))
    order = F.shiftleft(F.least(size, F.lit(1 << 22)), _HASH) + F.shiftright(hash60(F.coalesce(F.col(key).cast("string"), F.lit(""))), 60 - _HASH)
    ranked = global_index(df.withColumns({"_size": size, "_order": order}), "_order", "_rank", bits=_BLOCK_BITS, tie=[key])
    blocks = df.agg(F.ceil(F.greatest(F.count(F.lit(1)), F.lit(1)) / block_rows).alias("n")).select("n").scalar()
    dealt = ranked.drop("_order").withColumn("_block", F.pmod(F.col("_rank"), blocks))
    own = df.columns
    schema = dealt.select(*df.columns).withColumns({"window": F.lit(0).cast("bigint"), "segment": F.lit(0), "start": F.lit(0).cast("bigint"), "oversized": F.lit(False)}).schema

    def pack(group, table):
        table = table.sort_by([("_rank", "descending")])
        room, count, rows = FreeRoom(capacity), defaultdict(int), []
        for n in table.column("_size").to_pylist():
            if n > capacity:
                window, start, room.windows = room.windows, 0, room.windows + 1
            else:
                window, start = room.place(n)
            count[window] += 1
            rows.append((group[0].as_py() << 32 | window, count[window], start, n > capacity))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.bool_()))]
        return pa.table([*[table.column(c) for c in own], *columns], names=[*own, "window", "segment", "start", "oversized"])

    return dealt.groupBy("_block").applyInArrow(pack, schema)


def windows(packed: DataFrame, key: str, length: str) -> DataFrame:
    """One row per window: its documents in order, where each starts, and the number of tokens. A window holds no more documents than it
    has tokens, those of length 0 aside."""
    part = F.struct("segment", F.col(key).alias("key"), "start", F.greatest(F.coalesce(F.col(length), F.lit(0)), F.lit(0)).cast("bigint").alias("n"))
    rows = packed.groupBy("window", "oversized").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return rows.select("window", "oversized", F.col("parts.key").alias("documents"), F.col("parts.start").alias("starts"), F.col("parts.n").alias("lengths"),
                       F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, p: a + p["n"]).alias("tokens"))


def segment_ids(lengths: Column, capacity: int) -> Column:
    """The segment number of every token of a window, 0 behind the last: attention stays within equal numbers."""
    own = F.flatten(F.transform(lengths, lambda n, i: F.array_repeat(i + 1, n.cast("int"))))
    return F.concat(own, F.array_repeat(F.lit(0), F.greatest(F.lit(0), F.lit(capacity) - F.size(own))))


def packing_report(packed: DataFrame, length: str, capacity: int) -> DataFrame:
    """documents, tokens, windows, oversized documents, documents that don't start where the one before them in the window ends, windows over the
    capacity, and whether the windows are at most 2 % (and one for each block) more than the tokens need."""
    n = F.greatest(F.coalesce(F.col(length).cast("bigint"), F.lit(0)), F.lit(0))
    # In a gapless window of k segments the starts add up to what the lengths say, and the end is the sum of lengths.
    per_window = packed.groupBy("window", "oversized").agg(F.count(F.lit(1)).alias("k"), F.sum(n).alias("tokens"), F.max(F.col("start") + n).alias("stop"), F.min("start").alias("first"),
                                                           F.countDistinct("segment").alias("segments"), F.max("segment").alias("last"))
    kept = ~F.col("oversized")
    wrong = (F.col("first") != 0) | (F.col("stop") != F.col("tokens")) | (F.col("segments") != F.col("k")) | (F.col("last") != F.col("k"))
    least = F.ceil(F.sum(F.when(kept, F.col("tokens")).otherwise(0)) / capacity)
    blocks = F.countDistinct(F.shiftright("window", 32))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per_window.agg(total("k").alias("documents"), total("tokens").alias("tokens"), total(F.when(~kept, F.col("k")).otherwise(0)).alias("oversized"),
                          F.count_if(wrong).alias("misplaced"), F.count_if(kept & (F.col("tokens") > capacity)).alias("overfull"),
                          F.coalesce(F.count_if(kept) <= 1.02 * least + blocks, F.lit(True)).alias("well_filled"))
