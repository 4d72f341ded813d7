"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The symbols are words, a block is two adjacent words. All patterns of one length m form a group with a shift table: for a
block, how far the window may move without passing the end of an occurrence (m - 1 for a block of no pattern). At shift 0
the block is a pattern's last one; its bucket holds the patterns that end so, and comparing the words decides.

Cases: null or word-free texts have no words and no hits; an item without words has no window; items of the same id count once;
an item of null id takes no part; a document word is counted once however many windows cover it.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import annotated, free_name, per_text, words

WINDOW = 10
BLOCK_PAIRS = 100_000  # windows searched for at a time, whatever the size of the benchmark
FIELDS = "n_words long, hits array<struct<start: int, stop: int>>, items array<string>"


class Group:
    """Shift table and buckets of the patterns with m words."""

    def __init__(self, m: int, patterns: dict[tuple[bytes, ...], list[str]]):
        self.m, self.b = m, min(2, m)
        self.most = m - self.b + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict] = defaultdict(dict)
        for words_, ids in patterns.items():
            for end in range(self.b, m + 1):
                block = words_[end - self.b:end]
                self.shift[block] = min(self.shift.get(block, self.most), m - end)
            self.buckets[words_[m - self.b:]][words_] = ids

    def search(self, text: list[bytes]):
        """(start, item ids) of every occurrence."""
        m, most, shift, n = self.m, self.most, self.shift, len(text)
        end = m
        while end <= n:
            block = (text[end - 2], text[end - 1]) if m > 1 else (text[end - 1],)
            step = shift.get(block, most)
            if step:
                end += step
                continue
            ids = self.buckets[block].get(tuple(text[end - m:end]))
            if ids is not None:
                yield end - m, ids
            end += 1


def compile_groups(pairs: list[tuple[bytes, str]]) -> list[Group]:
    """Groups from (words joined by blanks, item id) pairs."""
    by_length: dict[int, dict] = defaultdict(lambda: defaultdict(list))
    for joined, item in pairs:
        key = tuple(joined.split(b" "))
        by_length[len(key)][key].append(item)
    return [Group(m, dict(p)) for m, p in sorted(by_length.items())]


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def item_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (window, item): ten consecutive words, or all words of a shorter item."""

    def windows():
        def one(t):
            w = words(t)
            spans = range(max(1, len(w) - WINDOW + 1)) if w else ()
            return {"windows": list({b" ".join(w[i:i + WINDOW]) for i in spans})}
        return one

    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).where("item is not null")
    return (annotated(items, per_text(windows, "windows array<binary>"), "text", "_w")
            .select("item", F.explode("_w.windows").alias("window")).distinct())


def find_leaks(docs: DataFrame, benchmark: DataFrame, name: str = "_leaks", text: str = "text") -> DataFrame:
    """docs with a struct `name`: n_words, hits (maximal word ranges), items (ids whose windows occur).

    Windows go out in blocks of about BLOCK_PAIRS; each block is one more column over the same rows, so the documents are
    never shuffled and the memory of a task doesn't grow with the benchmark."""
    spark = docs.sparkSession
    pairs = item_windows(benchmark).cache()
    n_blocks = -(-max(1, pairs.count()) // BLOCK_PAIRS)
    parts = []
    for k in range(n_blocks):
        mine = pairs.where(F.pmod(F.xxhash64("window", "item"), F.lit(n_blocks)) == k)
        sent = spark.sparkContext.broadcast([(bytes(r.window), r.item) for r in mine.collect()])

        def search(sent=sent):
            groups = compile_groups(sent.value)

            def one(t):
                w = words(t)
                ranges, items = [], set()
                for g in groups:
                    for start, ids in g.search(w):
                        ranges.append((start, start + g.m))
                        items.update(ids)
                return {"n_words": len(w), "hits": [{"start": a, "stop": b} for a, b in _merged(ranges)], "items": sorted(items)}
            return one

        parts.append(free_name(f"{name}_{k}", docs))
        docs = annotated(docs, per_text(search, FIELDS), text, parts[-1])
    pairs.unpersist()
    if n_blocks == 1:
        return docs.withColumnRenamed(parts[0], name)

    def joined(field):
        return F.flatten(F.array(*[F.col(f"{p}.{field}") for p in parts]))

    both = per_struct_merge(joined("hits"))
    return (docs.withColumn(name, F.struct(F.col(f"{parts[0]}.n_words").alias("n_words"), both.alias("hits"),
                                           F.array_sort(F.array_distinct(joined("items"))).alias("items"))).drop(*parts))


def per_struct_merge(hits):
    """Maximal ranges of an array of (start, stop), by a running maximum over the sorted ranges."""
    first = F.array_sort(hits)
    return F.aggregate(first, F.filter(first, lambda x: F.lit(False)), lambda acc, x: F.when(
        (F.size(acc) > 0) & (x["start"] <= F.element_at(acc, -1)["stop"]),
        F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                 F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"),
                                  F.greatest(F.element_at(acc, -1)["stop"], x["stop"]).alias("stop")))))
        .otherwise(F.concat(acc, F.array(x))))


def leak_digest(leaks: DataFrame, name: str = "_leaks") -> DataFrame:
    """One row per document: counts, the digest of its item ids, the verdict."""
    hits, items = F.col(f"{name}.hits"), F.col(f"{name}.items")
    n_hit = F.aggregate(hits, F.lit(0).cast("long"), lambda a, x: a + (x["stop"] - x["start"]))
    return leaks.select("doc_id", F.col(f"{name}.n_words").alias("n_words"), n_hit.alias("n_hit"),
                        F.size(items).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
                        (n_hit > 0).alias("contaminated"))


