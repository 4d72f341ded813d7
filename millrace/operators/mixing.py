"""How much of what goes into a corpus, and in which order: token budgets by source, copies by quality, interleaved sources."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.functions.text import computed_once, hash60, let
from millrace.operators.ordering import carry_last, global_index, previous, running_totals
from millrace.operators.sampling import HASH_BITS
from millrace.session import written

# --- token budgets ---


def _column(x: int | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("bigint")


def budgets(available: DataFrame, by: str, weights: Mapping[str, int], total: int | Column) -> DataFrame:
    """``by``, available, weight, budget: ``total`` tokens shared out by weight. A source with less than its share gives all it has, and the others
    share what it leaves, by the same weights (water-filling). Whole numbers throughout; a source without weight gets 0."""
    named = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    rows = available.withColumn("weight", F.coalesce(F.try_element_at(named, F.col(by)), F.lit(0)).cast("bigint"))
    wide = lambda c: c.cast("decimal(20,0)")
    # In order of available per weight the sources that give everything come first: one row per source is sorted here.
    order = Window.orderBy((F.col("available") / F.col("weight")).asc(), by)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    weighted = rows.where("weight > 0")
    rest = weighted.withColumns({
        "_left": _column(total) - F.coalesce(F.sum("available").over(before), F.lit(0)),
        "_weights": F.coalesce(F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)), F.lit(0))})
    short = wide(F.col("available")) * wide(F.col("_weights")) <= wide(F.col("weight")) * wide(F.col("_left"))
    level = F.max(F.when(~short, F.struct(F.col("_weights").alias("w"), F.col("_left").alias("left")))).over(Window.partitionBy())
    share = F.call_function("div", wide(F.col("weight")) * wide(F.col("_level.left")), wide(F.col("_level.w")))
    shared = rest.withColumns({"_short": short, "_level": level}).withColumn("budget", F.when(F.col("_short"), F.col("available")).otherwise(share).cast("bigint"))
    shared = shared.select(*rows.columns, "budget")
    return shared.unionByName(rows.where("weight <= 0").withColumn("budget", F.lit(0).cast("bigint")))


def mixture(df: DataFrame, by: str, key: str, size: str, weights: Mapping[str, int], total: int | Column, seed: int = 0) -> DataFrame:
    """The rows of a mix of ``total`` tokens: of every source the first rows in a seeded order whose sizes add up to no more than its budget. What is left
    of a budget is less than its next row. A source that holds most rows is cut along the order, never gathered.

    Null sources have no weight and null sizes count as 0; of equal keys each counts.
    """
    tokens = F.coalesce(F.col(size), F.lit(0)).cast("bigint")
    available = df.groupBy(by).agg(F.sum(tokens).alias("available"))
    shares = written(budgets(available, by, weights, total).select(by, F.col("budget").alias("_budget")), "budgets")
    ordered = df.where(F.col(by).isin(*weights)).withColumn("_h", hash60(F.lit(seed), F.col(key)))
    summed = running_totals(ordered, "_h", {"_so_far": tokens}, by=[by], inclusive=True, bits=HASH_BITS, tie=[key])
    return summed.join(shares, by).where(F.col("_so_far") <= F.col("_budget")).select(*df.columns)


def mixture_report(df: DataFrame, mixed: DataFrame, by: str, size: str, weights: Mapping[str, int], total: int | Column) -> DataFrame:
    """Per source: available, weight, budget, and rows and tokens taken."""
    tokens = F.coalesce(F.col(size), F.lit(0)).cast("bigint")
    available = df.groupBy(by).agg(F.sum(tokens).alias("available"))
    taken = mixed.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), F.sum(tokens).alias("taken"))
    rows = budgets(available, by, weights, total).join(taken, by, "left")
    return rows.select(by, "available", "weight", "budget", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("taken", F.lit(0)).alias("taken"))


# --- copies by quality ---

@dataclass(frozen=True)
class Curve:
    """Copies at the quality rank x in [0, 1]: 0 up to ``start``, then scale * u**power * exp(rate * u) with u = x - start."""

    start: float
    power: int
    rate: float
    scale: float

    def integral(self, u, exp=math.exp):
        """The copies of all ranks up to ``start + u``, as a share of the documents; ``u`` may be a number or a column."""
        if abs(self.rate) < 2:  # the series of exp; the recursion below cancels digits there
            out = 0.0
            for k in range(23, -1, -1):
                out = self.rate ** k / math.factorial(k) / (self.power + 1 + k) + u * out
            for _ in range(self.power + 1):
                out = u * out
            return self.scale * out
        # By parts: I_p = u**p e**(ru) / r - p / r I_(p-1).
        e = exp(self.rate * u)
        out, power = (e - 1.0) / self.rate, 1.0
        for p in range(1, self.power + 1):
            power = power * u
            out = power * e / self.rate - p / self.rate * out
        return self.scale * out

    def below(self, x: float) -> float:
        return self.integral(max(x - self.start, 0.0))

    def column(self, x: Column) -> Column:
        return let(F.greatest(x - self.start, F.lit(0.0)), lambda u: self.integral(u, F.exp))

    @staticmethod
    def solve(ratio: float, top_copies: float = 6.0, top: float = 0.05, start: float = 0.4, power: int = 1) -> Curve:
        """The curve with ``ratio`` copies per document over all and ``top_copies`` over the best ``top``, rising from ``start`` on."""
        flat = 1 - start

        def share(rate: float) -> float:
            c = Curve(start, power, rate, 1.0)
            return 1 - c.below(1 - top) / c.below(1.0)

        low, high, wanted = -power / flat, 300.0, top * top_copies / ratio
        if not share(low) <= wanted <= share(high):
            raise ValueError(f"no rising curve has {ratio} copies on average and {top_copies} at the top")
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if share(middle) < wanted else (low, middle)
        return Curve(start, power, low, ratio / Curve(start, power, low, 1.0).below(1.0))


def expected_copies(rank: Column, n: Column, curve: Curve) -> Column:
    """The curve's mean over the stretch of a document that is ``rank``-th of n (from 0), so that a topic's copies add up to the curve's integral."""
    return n * (curve.column((rank + 1) / n) - curve.column(rank / n))


def quality_upsample(df: DataFrame, topic: str, key: str, score: str, ratios: Mapping[str, float] | None = None, ratio: float = 1.0, seed: int = 0, **shape) -> DataFrame:
    """df with ``expected`` and a row for each copy (``copy`` from 1). Within a topic the worst documents are left out and the best repeated, along the
    topic's curve: whole copies, and one more for the fraction by a hash of the key.

    Ranks are exact and run over blocks of the score order, so no topic has to fit into a task. Equal scores go by key; a null score is the
    worst, a null topic is a topic.
    """
    topics = F.coalesce(F.col(topic).cast("string"), F.lit(""))
    rows = df.withColumns({"_topic": topics, "_score": F.coalesce(F.col(score).cast("double"), F.lit(float("-inf")))})
    ranked = global_index(rows, "_score", "_rank", by=["_topic"], tie=[key])
    sizes = written(df.groupBy(topics.alias("_topic")).agg(F.count(F.lit(1)).alias("_n")), "topics")
    value = expected_copies(F.col("_rank"), F.col("_n"), Curve.solve(ratio, **shape))
    for name, own in (ratios or {}).items():
        value = F.when(F.col("_topic") == name, expected_copies(F.col("_rank"), F.col("_n"), Curve.solve(own, **shape))).otherwise(value)
    drawn = hash60(F.lit(seed), F.col(key)) / F.lit(float(1 << 60))
    counted = computed_once(ranked.join(sizes, "_topic"), expected=value)
    copies = (F.floor("expected") + (drawn < F.col("expected") - F.floor("expected")).cast("int")).cast("int")
    return counted.withColumn("_copies", copies).where("_copies > 0").select(*df.columns, "expected", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("copy"))


# --- interleaving ---

_GOLDEN = 11400714819323198485  # 2**64 over the golden ratio, odd
_KEY_BITS = 43  # of 63: blocks of the pairs' order


def interleave(df: DataFrame, by: str, key: str, seed: int = 0, name: str = "position") -> DataFrame:
    """df in an order that spreads every source evenly and keeps rows of one source apart, as ``name`` from 0.

    Rows stand by source, the largest first, in seeded order within each. Row j goes with row j + half, which is of another source unless one has more
    than half of all rows. Pairs are put in the order of j times the golden ratio, modulo 1: consecutive j, and so the rows of a source,
    lie evenly over it. A pair whose first row meets its own source is turned around. Whether a pair is turned depends on the one before in one
    of four ways (never, always, as that one, unlike that one), so the turns follow from the last pair that settles it and the
    parity of the changes since, summed over blocks. The neighbours of one source are as few as can be: none, or those that a source of more than half forces.

    Null sources are a source of their own; of equal keys each row has a place; a column ``name`` is replaced.
    """
    df = df.drop(name)
    source = F.coalesce(F.col(by).cast("string"), F.lit("\0"))
    rows = df.select(source.alias("_s"), F.col(key).alias("_key"), F.struct(*df.columns).alias("_row"), hash60(F.lit(seed), F.col(key)).alias("_h"))
    sizes = df.groupBy(source.alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    first = F.coalesce(F.sum("_n").over(Window.orderBy(F.desc("_n"), "_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per source
    total = F.sum("_n").over(Window.partitionBy())
    starts = written(sizes.select("_s", first.alias("_first"), total.alias("_total")), "sources")
    placed = global_index(rows, "_h", "_i", by=["_s"], bits=HASH_BITS, tie=["_key"]).join(starts, "_s")
    half, j = F.floor((F.col("_total") + 1) / 2), F.col("_first") + F.col("_i")
    slots = placed.withColumns({"_half": half, "_j": j}).withColumn("_slot", F.when(F.col("_j") < F.col("_half"), F.col("_j")).otherwise(F.col("_j") - F.col("_half")))
    side = lambda second: F.any_value(F.when((F.col("_j") >= F.col("_half")) == second, F.struct("_s", "_row")), True)
    pairs = slots.groupBy("_slot").agg(side(False).alias("_one"), side(True).alias("_two"), F.any_value("_total").alias("_total"))
    # The row without partner (the total is odd) comes first.
    turn = F.floor(F.pmod((F.col("_slot") + 1).cast("decimal(19,0)") * F.lit(str(_GOLDEN)).cast("decimal(20,0)"), F.lit(str(1 << 64)).cast("decimal(20,0)")) / 2).cast("bigint")
    pairs = pairs.withColumn("_w", F.when(F.col("_two").isNull(), F.lit(-1).cast("bigint")).otherwise(turn))
    pairs = written(global_index(pairs, "_w", "_no", bits=_KEY_BITS, tie=["_slot"]), "pairs")

    ends = pairs.select("_no", F.struct(F.col("_one._s").alias("a"), F.coalesce("_two._s", "_one._s").alias("b")).alias("_p"))
    ends = previous(ends, [], "_no", "_p", "_q")
    meets = lambda end: F.coalesce(F.col(f"_q.{end}") == F.col("_p.a"), F.lit(False))
    ways = ends.select("_no", meets("b").alias("_m0"), meets("a").alias("_m1"))  # turned, if the pair before was not, or was
    ways = running_totals(ways, "_no", {"_changes": (F.col("_m0") & ~F.col("_m1")).cast("bigint")}, inclusive=True)
    settled = F.when(F.col("_m0") == F.col("_m1"), 2 * F.col("_changes") + F.col("_m0").cast("bigint"))
    ways = carry_last(ways.withColumn("_settled", settled), [], "_no", "_settled", "_last")
    turned = F.pmod(F.col("_last") + F.col("_changes") - F.shiftright("_last", 1), F.lit(2)) == 1
    both = pairs.join(ways.select("_no", turned.alias("_turned")), "_no")
    place = 2 * F.col("_no") - F.when((F.col("_total") % 2 == 1) & (F.col("_no") > 0), 1).otherwise(0)
    out = F.array(F.struct(F.when(F.col("_turned"), F.col("_two")).otherwise(F.col("_one")).alias("x"), place.alias(name)),
                  F.struct(F.when(F.col("_turned"), F.col("_one")).otherwise(F.col("_two")).alias("x"), (place + 1).alias(name)))
    flat = both.select(F.inline(out)).where("x is not null")
    return flat.select("x._row.*", name)


def neighbour_report(df: DataFrame, by: str, name: str = "position") -> DataFrame:
    """rows, rows next to one of their own source, and the smallest number any order has."""
    source = F.coalesce(F.col(by).cast("string"), F.lit("\0"))
    rows = previous(df.select(source.alias("_s"), name), [], name, "_s", "_q")
    per = rows.groupBy("_s").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_s") == F.col("_q")).alias("same"))
    least = F.greatest(F.lit(0).cast("bigint"), 2 * F.max("n") - F.sum("n") - 1)
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("same"), F.lit(0)).alias("same_source"), F.coalesce(least, F.lit(0)).alias("least"))
