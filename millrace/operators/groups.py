"""Group statistics, signal filters, replay and teacher selection over scored completions.

Group sizes are arbitrary: statistics are aggregated map-side first and joined back by key, with hot groups
salted, so a group holding a large share of the rows never lands in one window or one join task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from millrace.functions.text import after_last, before_first, computed_once, hash60, strip
from millrace.operators.ordering import first_rows, following, global_index
from millrace.operators.skew import join_groups
from millrace.session import written


def group_stats(df: DataFrame, by: Sequence[str], reward: str = "reward") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(reward).alias("mean"),
                               F.stddev_samp(reward).alias("std"), F.min(reward).alias("lo"),
                               F.max(reward).alias("hi"))


def with_group_stats(df: DataFrame, by: Sequence[str], reward: str = "reward",
                     spread: Sequence[str] | None = None) -> DataFrame:
    """Add ``n``, ``mean`` and ``std`` of the row's group. The statistics are written once: sizes, hot groups and values are read from there, and the
    rows themselves are read twice."""
    stats = written(group_stats(df.select(*by, reward), by, reward), "groups")
    return join_groups(df, stats.select(*by, "n", "mean", "std"), by, stats, spread=spread).select(*df.columns, "n", "mean", "std")


def advantage(reward: Column, use_std: bool = True, eps: float = 1e-6) -> Column:
    """Reward relative to its group: centred, and divided by the sample deviation when that is not tiny.

    The single member of a group keeps its reward. Reads ``n``, ``mean`` and ``std``.
    """
    centred = reward - F.col("mean")
    scaled = centred / F.when(F.col("std") < eps, 1.0).otherwise(F.col("std")) if use_std else centred
    return F.when(F.col("n") == 1, reward).otherwise(scaled)


def group_advantage(df: DataFrame, by: Sequence[str], reward: str = "reward", use_std: bool = True,
                    eps: float = 1e-6, spread: Sequence[str] | None = None) -> DataFrame:
    """Add ``advantage``. ``spread`` names row ids, used to cut hot groups."""
    return with_group_stats(df, by, reward, spread).select(*df.columns, advantage(F.col(reward), use_std, eps).alias("advantage"))


def zero_gradient_filter(df: DataFrame, by: Sequence[str], reward: str = "reward", spread: Sequence[str] | None = None) -> DataFrame:
    """Keep the groups whose rewards differ; a single member never carries a signal. The groups are written once, as in ``with_group_stats``."""
    stats = written(df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(reward).alias("lo"), F.max(reward).alias("hi")), "groups")
    return join_groups(df, stats.filter("hi <> lo").select(*by), by, stats, how="left_semi", spread=spread)


def signal_summary(df: DataFrame, by: Sequence[str], reward: str = "reward") -> DataFrame:
    """Per group with a signal: size, mean, deviation and spread of the rewards."""
    return group_stats(df, by, reward).filter("hi <> lo")


def normalise_batch(df: DataFrame, value: str, name: str, floor: float = 1e-8, when_over: float | None = None,
                    centre: bool = True) -> DataFrame:
    """(v - mean) / (sample deviation + floor) over the whole frame.

    With ``when_over`` the division happens only for a deviation above it.
    """
    moments = df.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    mean, std = moments.select("mean").scalar(), moments.select("std").scalar()
    shifted = F.col(value) - mean if centre else F.col(value)
    divided = shifted / (std + floor)
    if when_over is not None:
        divided = F.when(std > when_over, divided).otherwise(shifted)
    return df.withColumn(name, divided)


def replay_newest(df: DataFrame, order: Sequence[str], limit: int | None, grouped: bool = False,
                  enforce_on_groups: bool = False) -> DataFrame:
    """The newest ``limit`` rows. Rows added as groups are not limited unless asked for."""
    if limit is None or (grouped and not enforce_on_groups):
        return df
    first, *rest = order
    if not isinstance(df.schema[first].dataType, T.IntegralType):
        return df.orderBy(*[F.col(c).desc() for c in order]).limit(limit)
    # Numbers descending are numbers again, so the cut is placed by block counts and only the last block is ordered.
    newest = F.coalesce(F.try_subtract(F.lit(0).cast("bigint"), F.col(first).cast("bigint")), F.lit((1 << 63) - 1))
    return first_rows(df.withColumn("_newest", newest), "_newest", limit, tie=[F.col(c).desc() for c in rest]).drop("_newest")


def replay_stats(df: DataFrame, by: str, reward: str = "reward") -> DataFrame:
    zero = F.lit(0.0)
    return df.agg(F.count(F.lit(1)).alias("size"), F.countDistinct(by).alias("num_groups"),
                  F.coalesce(F.avg(reward), zero).alias("returns_mean"), F.stddev_samp(reward).alias("returns_std"),
                  F.coalesce(F.max(reward), zero).alias("returns_max"), F.coalesce(F.min(reward), zero).alias("returns_min"))


def success_store(df: DataFrame, by: str, key: str, reward: str = "reward", keep: int = 5,
                  threshold: float = 0.5, seed: int = 0) -> DataFrame:
    """Up to ``keep`` successful completions per prompt, drawn by a seeded hash of prompt and completion id.

    The rank filter is pushed below the shuffle, so every task sends at most ``keep`` rows per prompt.
    """
    draw = hash60(F.lit(seed), F.col(by), F.col(key))
    w = Window.partitionBy(by).orderBy("_draw", key)
    return (computed_once(df.filter(F.col(reward) >= threshold), _draw=draw)
            .withColumn("slot", F.row_number().over(w)).filter(F.col("slot") <= keep).drop("_draw"))


def assign_teacher(df: DataFrame, store: DataFrame, by: str, key: str, seed: int = 0) -> DataFrame:
    """Give each row one stored success of its prompt, picked by hash; ``has_teacher`` tells if there is one. Store and group sizes are written once."""
    store = written(store, "store")
    held = store.groupBy(by).agg(F.count(F.lit(1)).alias("_held"))
    pick = F.pmod(hash60(F.lit(seed), F.lit("pick"), F.col(by), F.col(key)), F.col("_held")) + 1
    counts = written(df.groupBy(by).agg(F.count(F.lit(1)).alias("n")), "groups")
    # Only the number of stored rows is joined to all rows; a text is fetched once its slot is known.
    picked = join_groups(df, held, [by], counts, how="left", spread=[key]).withColumn("_slot", pick.cast("int")).drop("_held")
    texts = store.select(by, F.col("slot").cast("int").alias("_slot"), F.col("prompt").alias("teacher_prompt"), F.col("completion").alias("teacher_completion"),
                         F.lit(True).alias("_found"))
    return picked.join(texts, [by, "_slot"], "left").select(
        *df.columns, "teacher_prompt", "teacher_completion", F.coalesce("_found", F.lit(False)).alias("has_teacher"))


# The text shown to a teacher.
REPROMPT = ("Here is the problem:\n{question}\n\nHere is a successful solution for reference:\n"
            "{successful_solution}\n\nNow solve this problem step by step.")
FEEDBACK = "\nPrevious attempt feedback:\n{feedback}\n"


def question_of(prompt: Column) -> Column:
    """The user's part of a rendered prompt."""
    out = prompt
    for opening, closing in (("[INST]", "[/INST]"), ("<|user|>", "<|assistant|>"), ("User:", "Assistant:")):
        out = F.when(prompt.contains(opening), strip(before_first(after_last(prompt, opening), closing))).otherwise(out)
    return out


def reprompt(prompt: Column, solution: Column, feedback: Column | None = None, max_chars: int = 4096) -> Column:
    def fill(template: str, **fields: Column) -> Column:
        parts, rest = [], template
        for name, column in fields.items():
            head, rest = rest.split("{" + name + "}", 1)
            parts += [F.lit(head), column]
        return F.concat(*parts, F.lit(rest))

    text = fill(REPROMPT, question=question_of(prompt), successful_solution=solution)
    if feedback is not None:
        said = F.when(F.coalesce(feedback, F.lit("")) != "", fill(FEEDBACK, feedback=feedback)).otherwise("")
        text = F.concat(text, said)
    return F.substring(text, 1, max_chars)


def best_worst(df: DataFrame, by: str, key: str, reward: str = "reward") -> DataFrame:
    """Best and worst completion per group, ties to the first; no worst when all are equal."""
    up, down = F.struct(F.col(reward), F.col(key)), F.struct(-F.col(reward), F.col(key))
    out = df.groupBy(by).agg(F.max(reward).alias("best_reward"), F.min_by("completion", down).alias("best_completion"),
                             F.min(reward).alias("_low"), F.min_by("completion", up).alias("_worst"))
    lower = F.col("_low") < F.col("best_reward")
    return out.select(by, "best_reward", "best_completion", F.when(lower, F.col("_low")).alias("worst_reward"),
                      F.when(lower, F.col("_worst")).alias("worst_completion"))


def reward_band(reward: Column) -> Column:
    return F.when(reward > 0.5, "high").when(reward > 0, "middle").otherwise("low")


def preview_text(text: Column, chars: int = 500) -> Column:
    return F.concat(F.substring(text, 1, chars), F.when(F.length(text) > chars, "...").otherwise(""))


def rollout_counters(df: DataFrame, run: str, step: str, group: str, group_size: int, reward: str = "reward") -> DataFrame:
    """Per run and step: mean reward, prompts generated and used, filtered groups, experiences, running sums."""
    groups = df.groupBy(run, step, group).agg(
        F.count(F.lit(1)).alias("n"), F.sum(reward).alias("s"), F.min(reward).alias("lo"), F.max(reward).alias("hi"))
    used = F.col("hi") != F.col("lo")
    steps = groups.groupBy(run, step).agg(
        (F.sum("s") / F.sum("n")).alias("batch_reward_mean"), F.sum("n").alias("completions_generated"),
        F.count_if(used).alias("prompts_used"),
        F.coalesce(F.sum(F.when(used, F.col("n"))), F.lit(0)).alias("experiences_tuned"))
    steps = steps.withColumn("prompts_generated", F.floor(F.col("completions_generated") / group_size)).withColumn(
        "filtered_groups", F.greatest(F.lit(0).cast("bigint"), F.col("prompts_generated") - F.col("prompts_used")))
    # One row per step is left by now, so a run's steps fit one ordered window.
    so_far = Window.partitionBy(run).orderBy(step).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = ["prompts_generated", "prompts_used", "completions_generated", "experiences_tuned"]
    return steps.withColumns({f"cum_{c}": F.sum(c).over(so_far) for c in counted})


def attach_reference(prompts: DataFrame, references: DataFrame, on: str) -> DataFrame:
    """Pair prompts with references by key; a key found on one side only is an error."""
    left = prompts.withColumn("_l", F.lit(True))
    right = references.withColumn("_r", F.lit(True))
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    joined = left.join(right, on, "full_outer")
    checked = F.when(both, F.col(on)).otherwise(F.raise_error(F.lit("prompts and references do not pair up")))
    rest = [c for c in joined.columns if c not in (on, "_l", "_r")]
    return joined.select(checked.alias(on), *rest)


GAE_BITS = 8  # steps per block: 256


def _backward(items: DataFrame, traj: str, levels: int) -> DataFrame:
    """Solve a(i) = d(i) + c(i) * a(i+1), from the end, for rows ``traj, i, d, c, extra``; adds ``a``.

    A block of 256 rows folds to one offset and slope; the blocks form the same problem one level up.
    """
    row = F.struct("i", "d", "c", "extra")
    blocks = (items.withColumn("b", F.shiftright("i", GAE_BITS)).groupBy(traj, "b")
              .agg(F.sort_array(F.collect_list(row), asc=False).alias("rows")))
    if levels > 1:
        folded = F.aggregate("rows", F.struct(F.lit(0.0).alias("off"), F.lit(1.0).alias("slope")),
                             lambda acc, x: F.struct((x["d"] + x["c"] * acc["off"]).alias("off"),
                                                     (x["c"] * acc["slope"]).alias("slope")))
        upper = blocks.select(traj, F.col("b").alias("i"), folded.alias("f")).select(
            traj, "i", F.col("f.off").alias("d"), F.col("f.slope").alias("c"), F.lit(0).alias("extra"))
        starts = _backward(upper, traj, levels - 1).select(traj, (F.col("i") - 1).alias("b"), F.col("a").alias("tail"))
        blocks = blocks.join(starts, [traj, "b"], "left")
    else:
        blocks = blocks.withColumn("tail", F.lit(0.0))
    empty = F.array().cast("array<double>")
    walked = F.aggregate(
        "rows", F.struct(F.coalesce("tail", F.lit(0.0)).alias("a"), empty.alias("out")),
        lambda acc, x: F.struct((x["d"] + x["c"] * acc["a"]).alias("a"),
                                F.concat(acc["out"], F.array(x["d"] + x["c"] * acc["a"])).alias("out")),
        lambda acc: acc["out"])
    return (blocks.select(traj, F.explode(F.arrays_zip("rows", walked.alias("a"))).alias("z"))
            .select(traj, "z.rows.i", "z.rows.extra", "z.a"))


def gae(df: DataFrame, traj: str, key: str, gamma: float = 0.99, lam: float = 0.95) -> DataFrame:
    """Generalised advantage estimates and returns, walking each trajectory backwards.

    No task holds more of a trajectory than one block. The number of levels follows from the longest one.
    """
    pos = global_index(df.select(traj, key, "reward", "value", "done"), key, "i", by=[traj])
    longest = df.groupBy(traj).count().agg(F.max("count")).first()[0] or 1
    levels = max(1, -(-(int(longest) - 1).bit_length() // GAE_BITS))
    live = F.when(F.col("done"), 0.0).otherwise(1.0)
    delta = F.col("reward") + gamma * F.coalesce("next_value", F.lit(0.0)) * live - F.col("value")
    items = following(pos, [traj], "i", "value", "next_value").select(
        traj, "i", delta.alias("d"), (gamma * lam * live).alias("c"), F.struct(key, "value").alias("extra"))
    return _backward(items, traj, levels).select(
        traj, f"extra.{key}", F.col("a").alias("advantage"), (F.col("a") + F.col("extra.value")).alias("returns"))
