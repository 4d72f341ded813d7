"""Best-fit packing of documents into token sequences by linear grouping.

Documents become token ids and one closing id; only those over the capacity are cut, so that all pieces but the first are full.
The plan needs no more than how many pieces have each length, at most `capacity` numbers, which are counted by Spark:

1. Pieces longer than a bound, from long to short, are dealt into groups of equal number, and every length is rounded up to the
   longest of its group. A linear program over configurations (which groups share a sequence) is solved by column generation: the dual
   prices make a knapsack that finds the next configuration. Whole multiples of the configurations are taken.
2. Pieces take the places of their group in order, with their own lengths, so sequences of one configuration differ in few stretches
   and every stretch is known by its first number, size and free room.
3. What is left, small pieces above all, goes longest first to where it fits best, on stretches instead of single sequences.

Steps 1 to 3 work on length counts and stretches, whose number depends on the capacity and not on the pieces, and run on the driver; a few bounds
are tried and the plan of fewest sequences is kept. It says for ranks a to b of length l: sequence and offset. Spark numbers the pieces of a length
(ranks within a task, then sums over tasks) and looks each up. No group of rows is gathered: a length that a third of all pieces
share is a range of ranks.

Cases: null and empty texts are one closing id. A text is cut at places that part tokens whatever stands beside them and encoded a
megabyte at a time. Repeated rows, null and repeated ids are packed one by one; other columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from codecs import charmap_decode
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.llm.common import SLICE, free_name, stored

CAPACITY = 2048
GROUPS = 48
BOUNDS = (2, 3, 4, 6, 8)  # long: over this part of the capacity
WINDOW = 1 << 20  # characters encoded at a time
REMEMBERED = 600_000  # distinct strings whose ids a worker keeps
_RANK_BITS = 44

# --- tokens ---

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
# Parts of a text that begin and end between two tokens of any text, for pre-tokenizers that take an optional blank with letters, digits or
# marks: a place before a blank or line end after anything but white space, or before a mark after a letter, parts tokens.
_BLANK_CUT = re.compile(r"(?= (?<=\S ))")
_PARTS = re.compile(rf" ?[{_LETTERS}]+(?=[ \n.,;:!?]|\Z)|[.,;:!?]+(?=[ \n])|(?s:.+?)(?=(?<=\S)[ \n]|(?<=[{_LETTERS}])[.,;:!?]|\Z)")
_WORD = re.compile(rf" ?[{_LETTERS}]+\Z")


class _Parts(dict):
    """The ids of parts, found when they are first asked for."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model = tokenizer, tokenizer.model
        # How the pre-tokenizer spells the bytes of a blank and the letters.
        letters, spelled = re.findall(rf"[{_LETTERS}]", "".join(map(chr, range(256)))), ["\ufffe"] * 256
        for c in [" ", *letters]:
            for byte, x in zip(c.encode(), tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0], strict=True):
                spelled[byte] = x
        self.spelled = "".join(spelled)

    def __missing__(self, part: str) -> bytes:
        """A word is one token of the pre-tokenizer, so the model alone gives its ids."""
        if _WORD.match(part):
            ids = [t.id for t in self.model.tokenize(charmap_decode(part.encode(), "strict", self.spelled)[0])]
        else:
            ids = self.tokenizer.encode(part, add_special_tokens=False).ids
        raw = self[part] = array("I", ids).tobytes()
        return raw


class Encoder:
    """Ids of texts as little-endian 32-bit numbers. Parts of texts are encoded once and remembered, where the tokenizer is a byte-level BPE with
    the pre-tokenizer the parts are made for; other tokenizers get whole texts, as do texts with a special token."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task for every core
        self.tokenizer, parts = Tokenizer.from_str(spec), json.loads(spec)
        before = parts.get("pre_tokenizer") or {}
        self.by_parts = (parts["model"]["type"] == "BPE" and parts.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space")
                         and before.get("use_regex", True))
        self.special = [t["content"] for t in parts.get("added_tokens", [])]
        self.known = _Parts(self.tokenizer) if self.by_parts else None

    def encode(self, text: str) -> bytes:
        if not self.by_parts or any(s in text for s in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        return b"".join([b"".join(map(self.known.__getitem__, _PARTS.findall(window))) for window in _windows(text)])


def _windows(text: str) -> Iterator[str]:
    start = 0
    while start < len(text):
        end = _BLANK_CUT.search(text, start + WINDOW)
        stop = end.start() if end else len(text)
        yield text[start:stop]
        start = stop


_encoders: dict[str, Encoder] = {}  # of this worker, with what they remember


def cut_documents(docs: DataFrame, tokenizer_json: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece (from 0), start (ids before it), length, ids_crc32 of every piece; with_ids adds its ids."""
    with open(tokenizer_json, encoding="utf-8") as f:
        spec = f.read()
    end = np.array([end_id], "<u4").tobytes()
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = str(zlib.crc32(spec.encode()))
        encoder = _encoders.get(key) or _encoders.setdefault(key, Encoder(spec))
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                some = batch.slice(i, SLICE)
                rows = []
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    ids = encoder.encode(text or "") + end
                    n, start, piece = len(ids) // 4, 0, 0
                    stop = n - (n - 1) // capacity * capacity
                    while start < n:
                        own = ids[4 * start:4 * stop]
                        rows.append((doc_id, piece, start, stop - start, zlib.crc32(own), *([np.frombuffer(own, "<i4")] * with_ids)))
                        start, stop, piece = stop, stop + capacity, piece + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


# --- the plan, from counts of lengths ---

def _knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The dearest choice of sizes, each as often as wanted, that fits."""
    c = np.arange(capacity + 1)
    rest = c[None, :] - sizes[:, None]
    best, layers = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        worth = np.where(rest >= 0, best[np.maximum(rest, 0)] + prices[:, None], -1.0)
        pick = worth.argmax(axis=0)
        value = worth[pick, c]
        better = value > best + 1e-12
        if not better.any():
            break
        layers.append(np.where(better, pick, -1))
        best = np.where(better, value, best)
    pattern, room = np.zeros(len(sizes), np.int64), capacity
    for pick in reversed(layers):
        if pick[room] >= 0:
            pattern[pick[room]] += 1
            room -= int(sizes[pick[room]])
    return float((pattern * prices).sum()), pattern


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(how many of each size, how many sequences): the whole parts of an optimal fractional packing."""
    n = len(sizes)
    patterns = np.diag(capacity // sizes).astype(float)
    inverse, used = np.diag(1.0 / np.diag(patterns)), demand / np.diag(patterns)
    for step in range(60 * n):
        prices = inverse.sum(axis=0)
        value, pattern = _knapsack(sizes, np.maximum(prices, 0), capacity)
        if value <= 1 + 1e-9 or used.sum() * (1 - 1 / value) < 0.01:
            break
        change = inverse @ pattern
        ratio = np.where(change > 1e-9, np.maximum(used, 0) / np.where(change > 1e-9, change, 1), np.inf)
        leaves = int(ratio.argmin())
        patterns[:, leaves] = pattern
        if step % 40 == 39:
            inverse = np.linalg.inv(patterns)
        else:
            row = inverse[leaves] / change[leaves]
            inverse -= np.outer(change, row)
            inverse[leaves] = row
        used = inverse @ demand
    return [(patterns[:, j].astype(np.int64), int(used[j] + 1e-6)) for j in np.argsort(-used) if used[j] + 1e-6 >= 1]


class Plan:
    """Rows (length, first rank, pieces per sequence, first sequence, offset), and the number of sequences."""

    def __init__(self, capacity: int):
        self.capacity, self.rows, self.sequences = capacity, [], 0
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free room -> (first sequence, number)
        self.has = np.zeros(capacity + 1, bool)

    def add(self, free: int, first: int, n: int) -> None:
        if free and n:
            self.open[free].append((first, n))
            self.has[free] = True

    def fill(self, pattern: np.ndarray, n: int, queues: list[deque]) -> None:
        """n new sequences of a configuration; pieces come from the queue of their group."""
        block = [(self.sequences, n, 0)]
        self.sequences += n
        for queue in [q for q, times in zip(queues, pattern.tolist()) for _ in range(times)]:
            filled = []
            for first, m, used in block:
                while m and queue:
                    length, rank, have = queue.popleft()
                    take = min(have, m)
                    self.rows.append((length, rank, 1, first, used))
                    filled.append((first, take, used + length))
                    first, m = first + take, m - take
                    if have > take:
                        queue.appendleft((length, rank + take, have - take))
                if m:
                    filled.append((first, m, used))
            block = filled
        for first, m, used in block:
            self.add(self.capacity - used, first, m)

    def best_fit(self, length: int, rank: int, n: int) -> None:
        """n pieces of one length, each into the fullest sequence that has room for it."""
        while n:
            free = length + int(self.has[length:].argmax())
            if not self.has[free]:
                m = -(-n // (self.capacity // length))
                self.add(self.capacity, self.sequences, m)
                self.sequences += m
                continue
            first, m = self.open[free].pop()
            self.has[free] = bool(self.open[free])
            each = free // length
            full = min(m, n // each)
            for each, times in ((each, full), (n - full * each, int(full < m and full * each < n))):
                if times:
                    self.rows.append((length, rank, each, first, self.capacity - free))
                    self.add(free - each * length, first, times)
                    rank, n, first, m = rank + each * times, n - each * times, first + times, m - times
            self.add(free, first, m)


def _grouped(counts: np.ndarray, capacity: int, bound: int, groups: int) -> Plan:
    plan = Plan(capacity)
    if counts[capacity]:
        plan.fill(np.array([1]), int(counts[capacity]), [deque([(capacity, 0, int(counts[capacity]))])])
    left = [(length, 0, int(counts[length])) for length in np.flatnonzero(counts[:bound + 1]).tolist()]
    long = (np.flatnonzero(counts[bound + 1:capacity]) + bound + 1)[::-1].tolist()
    total, done, queues = int(counts[bound + 1:capacity].sum()), 0, []
    for length in long:
        rank, n = 0, int(counts[length])
        while n:
            group = done * groups // total
            take = min(n, -(-(group + 1) * total // groups) - done)
            if not queues or queues[-1][0] != group:
                queues.append((group, deque()))
            queues[-1][1].append((length, rank, take))
            rank, n, done = rank + take, n - take, done + take
    waiting = [q for _, q in queues]
    if waiting:
        sizes, at = np.unique([q[0][0] for q in waiting], return_inverse=True)  # groups of one length are one size
        merged = [deque(x for q, k in zip(waiting, at.tolist()) if k == i for x in q) for i in range(len(sizes))]
        demand = np.array([sum(n for _, _, n in q) for q in merged], float)
        for pattern, n in configurations(sizes, demand, capacity):
            plan.fill(pattern, n, merged)
        left += [x for q in merged for x in q]
    for length, rank, n in sorted(left, reverse=True):
        plan.best_fit(length, rank, n)
    return plan


def plan_packing(counts: np.ndarray, groups: int = GROUPS) -> Plan:
    """The plan of fewest sequences; counts[l] pieces have length l, the last l is the capacity."""
    capacity = len(counts) - 1
    return min((_grouped(counts, capacity, capacity // part, groups) for part in BOUNDS), key=lambda p: p.sequences)


# --- pieces to places ---

def _ranked(items: DataFrame, length: str, part: str, rank: str) -> DataFrame:
    """Every row's task, and how many rows of its length the task had before it."""
    schema = T.StructType([*items.schema.fields, T.StructField(part, T.LongType()), T.StructField(rank, T.LongType())])
    arrow, at = to_arrow_schema(schema), items.columns.index(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            ranks = []
            for n in batch.column(at).to_pylist():
                ranks.append(seen[n])
                seen[n] += 1
            yield pa.RecordBatch.from_arrays([*[c.cast(t) for c, t in zip(batch.columns, arrow.types)], pa.array([task] * len(ranks), pa.int64()), pa.array(ranks, pa.int64())],
                                             schema=arrow)

    return items.mapInArrow(run, schema)


def pack(items: DataFrame, capacity: int = CAPACITY, length: str = "length", groups: int = GROUPS) -> DataFrame:
    """Rows with a place: their columns and sequence_id, offset (which replace columns of these names). Null lengths and those outside 1 to
    capacity get none (null)."""
    items = items.drop("sequence_id", "offset")
    part, rank, before = (free_name(n, items) for n in ("_part", "_rank", "_before"))
    rows = stored(_ranked(items, length, part, rank), "pieces")
    per_task = rows.where(F.col(length).between(1, capacity)).groupBy(length, part).agg(F.count(F.lit(1)).alias("_n"))
    counts = np.zeros(capacity + 1, np.int64)
    for n, k in per_task.groupBy(length).agg(F.sum("_n")).collect():  # at most `capacity` rows
        counts[n] = k
    plan = plan_packing(counts, groups)
    table = np.array(sorted(plan.rows), np.int64).reshape(-1, 5)
    keys = (table[:, 0] << _RANK_BITS) | table[:, 1]

    @F.arrow_udf("struct<sequence_id:long,offset:long>")
    def place(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        known = np.array(ranks.is_valid())
        size, at = (x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (lengths, ranks))
        row = table[np.maximum(np.searchsorted(keys, (size << _RANK_BITS) | at, "right") - 1, 0)] if len(table) else np.ones((len(size), 5), np.int64)
        k = at - row[:, 1]
        values = (row[:, 3] + k // row[:, 2], row[:, 4] + k % row[:, 2] * size)
        return pa.StructArray.from_arrays([pa.array(v, pa.int64(), mask=~known) for v in values], ["sequence_id", "offset"])

    over = Window.partitionBy(length).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = per_task.select(length, part, F.coalesce(F.sum("_n").over(over), F.lit(0)).alias(before))
    found = rows.join(starts, [length, part], "left").withColumn(before, place(F.col(length), F.col(before) + F.col(rank)))
    return found.select(*items.columns, F.col(f"{before}.sequence_id").alias("sequence_id"), F.col(f"{before}.offset").alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, the ids in order, and the starts of its pieces, from pieces packed with their ids; a sequence holds at most the capacity."""
    members = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    rows = packed.where("sequence_id is not null").groupBy("sequence_id").agg(members.alias("m"))
    return rows.select("sequence_id", F.flatten(F.col("m.ids")).alias("ids"), F.col("m.offset").alias("starts"), F.col("m.doc_id").alias("doc_ids"))
