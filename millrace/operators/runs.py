"""Run-metrics analytics: newest state, totals, timing, smoothing, checkpoints.

A metrics frame has ``run_id``, an integer ``seq`` giving the log order, and metric columns. Few runs may
hold most of the rows, so order-dependent figures work on blocks of positions, never on a whole run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.functions.text import instant
from millrace.operators.ordering import carry_last, global_index, previous, trailing, trailing_counts
from millrace.operators.skew import join_groups
from millrace.session import written

RUN, SEQ = "run_id", "seq"


def _first_of(df: DataFrame, names: list[str], default: Column) -> Column:
    """Value of the first column that the log has; whether a column exists decides, not whether it is null."""
    return next((F.col(f"r.{n}") for n in names if n in df.columns), default)


def latest(df: DataFrame) -> DataFrame:
    """Newest row of each run with the usual fallbacks for step, reward, rate and status."""
    last = df.groupBy(RUN).agg(F.max_by(F.struct(*df.columns), F.col(SEQ)).alias("r"), F.count(F.lit(1)).alias("rows"))
    return last.select(
        RUN, "rows", _first_of(df, ["current_step", "rollout_step", "step"], F.col("rows") - 1).alias("current_step"),
        _first_of(df, ["reward", "batch_reward_mean"], F.lit(0.0)).alias("reward"),
        _first_of(df, ["loss"], F.lit(0.0)).alias("current_loss"),
        _first_of(df, ["learning_rate", "lr"], F.lit(0.0)).alias("current_lr"),
        F.coalesce(_first_of(df, ["status"], F.lit(None).cast("string")), F.lit("training")).alias("status"))


def positions(df: DataFrame) -> DataFrame:
    """Add ``pos``, the dense 0-based position of a row in its run."""
    return global_index(df, SEQ, "pos", by=[RUN])


def histories(df: DataFrame, columns: list[str], chunk: int = 10_000) -> DataFrame:
    """History arrays per run in log order, cut into chunks so that no array grows with the run."""
    if "learning_rate" not in df.columns and "lr" in df.columns and "learning_rate" in columns:
        df = df.withColumnRenamed("lr", "learning_rate")
    cut = positions(df).withColumn("chunk", F.floor(F.col("pos") / chunk))
    rows = cut.groupBy(RUN, "chunk").agg(F.sort_array(F.collect_list(F.struct("pos", *columns))).alias("h"))
    return rows.select(RUN, "chunk", *[F.col(f"h.{c}").alias(f"{c}_history") for c in columns])


def totals(df: DataFrame, counters: list[str]) -> DataFrame:
    """Last ``<counter>_total`` where the log has that column, else the sum of the counter; null counts as 0."""
    out = []
    for c in counters:
        if f"{c}_total" in df.columns:
            out.append(F.max_by(F.coalesce(f"{c}_total", F.lit(0)), F.col(SEQ)).alias(f"{c}_total"))
        elif c in df.columns:
            out.append(F.sum(F.coalesce(c, F.lit(0))).alias(f"{c}_total"))
    return df.groupBy(RUN).agg(*out)


def elapsed_eta(df: DataFrame, step: str, ts: str, total_steps: Column | None = None, now: Column | None = None) -> DataFrame:
    """Elapsed and remaining seconds per run; 0 where undefined. ``now`` stands in for a run of one row."""
    ends = df.groupBy(RUN).agg(
        F.count(F.lit(1)).alias("rows"), F.min_by(step, SEQ).alias("s0"), F.max_by(step, SEQ).alias("s1"),
        F.min_by(ts, SEQ).alias("t0"), F.max_by(ts, SEQ).alias("t1"))
    end = F.when(F.col("rows") == 1, now if now is not None else F.current_timestamp()).otherwise(instant(ends, "t1"))
    seconds = (F.unix_micros(end) - F.unix_micros(instant(ends, "t0"))) / 1e6
    timed = ends.withColumn("elapsed_seconds", F.greatest(F.lit(0.0), F.coalesce(seconds, F.lit(0.0))))
    moved = F.greatest(F.lit(0), F.col("s1") - F.col("s0"))
    if total_steps is None:
        return timed.select(RUN, "elapsed_seconds", F.lit(0.0).alias("eta_seconds"), (moved * 0.0).alias("seconds_per_step"))
    pace = F.try_divide(F.col("elapsed_seconds"), F.when(moved > 0, moved))
    left = F.greatest(F.lit(0), total_steps - F.col("s1"))
    return timed.select(RUN, "elapsed_seconds", F.coalesce(pace * left, F.lit(0.0)).alias("eta_seconds"),
                        F.coalesce(pace, F.lit(0.0)).alias("seconds_per_step"))


def rolling_mean(df: DataFrame, names: dict[str, str], width: int = 10, scaled: bool = True) -> DataFrame:
    """Trailing means, ``names`` mapping a column to its smoothed name.

    With ``scaled`` the width is ``min(width, rows // 4)`` and runs of up to ``width`` rows stay unsmoothed (null).
    """
    held = {f"_w_{c}": (F.collect_list, F.struct(c)) for c in names}
    out = trailing(positions(df), [RUN], "pos", width, held)
    if scaled:
        sizes = written(df.groupBy(RUN).agg(F.count(F.lit(1)).alias("_n")), "sizes")
        out = join_groups(out, sizes, [RUN], sizes, "_n", spread=["pos"])

    def mean(c):
        values = F.col(f"_w_{c}.{c}")
        if scaled:
            k = F.greatest(F.lit(1), F.least(F.lit(width), F.floor(F.col("_n") / 4)).cast("int"))
            values = F.slice(values, F.greatest(F.lit(1), F.size(values) - k + 1), k)
        kept = F.filter(values, lambda x: x.isNotNull())
        value = F.try_divide(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x), F.size(kept))
        return F.when(F.col("_n") > width, value) if scaled else value

    return out.select(*df.columns, *[mean(c).alias(n) for c, n in names.items()])


def rolling_outcomes(df: DataFrame, outcome: str, width: int = 200) -> DataFrame:
    """Share of wins, draws and losses among the last ``width`` results."""
    o = F.col(outcome)
    flags = {"win_rate": o > 0, "draw_rate": o == 0, "loss_rate": o < 0}
    out = trailing_counts(positions(df), [RUN], "pos", width, flags)
    seen = F.least(F.col("pos") + 1, F.lit(width))
    return out.select(*df.columns, *[F.round(F.col(c) / seen, 3).alias(c) for c in flags])


def winrate(df: DataFrame, outcome: str) -> DataFrame:
    o = F.col(outcome)
    return df.groupBy(RUN).agg(F.count(F.lit(1)).alias("games"), F.count_if(o > 0).alias("wins"), F.count_if(o == 0).alias("draws"),
                               F.count_if(o < 0).alias("losses"), F.avg(F.when(o > 0, 1.0).otherwise(0.0)).alias("win_rate"))


RANK_LIMIT = 1000  # up to here Spark applies a rank filter before the shuffle


def newest_rows(df: DataFrame, last: int) -> DataFrame:
    """The last rows of each run in log order."""
    if last <= RANK_LIMIT:
        newest = Window.partitionBy(RUN).orderBy(F.col(SEQ).desc())
        return df.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= last).drop("_r")
    sizes = written(df.groupBy(RUN).agg(F.count(F.lit(1)).alias("_n")), "sizes")
    placed = join_groups(positions(df), sizes, [RUN], sizes, "_n", spread=["pos"])
    return placed.filter(F.col("pos") >= F.col("_n") - last).select(*df.columns)


def decimate(df: DataFrame, last: int = 2000, target: int = 1200) -> DataFrame:
    """The last rows of each run, thinned to about ``target``."""
    run = Window.partitionBy(RUN)  # at most ``last`` rows by now
    tail = newest_rows(df, last).select("*", F.count(F.lit(1)).over(run).alias("_n"),
                                        F.row_number().over(run.orderBy(SEQ)).alias("_i"))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / target))
    keep = F.when(F.col("_n") > target, F.pmod(F.col("_i") - 1, step) == 0).otherwise(True)
    return tail.filter(keep).select(*df.columns)


def dataset_progress(totals_df: DataFrame, config: DataFrame, group_size: int) -> DataFrame:
    """Prompts seen (logged or estimated from steps), completions, and the share of the data set."""
    df = totals_df.join(config, RUN)
    seen = F.greatest(F.coalesce("prompts_generated_total", F.lit(0)), F.col("rollout_step") * F.col("batch") * F.greatest(F.lit(1), F.col("gpus")))
    completions = F.coalesce("completions_generated_total", seen * group_size) if "completions_generated_total" in df.columns else seen * group_size
    return df.select(RUN, seen.alias("prompts_seen"), completions.alias("completions_seen"),
                     clamp_pct(seen, F.col("dataset_total")).alias("dataset_pct"))


def clamp_pct(part: Column, whole: Column) -> Column:
    share = F.when(whole > 0, part / whole * 100.0).otherwise(0.0)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(100.0), share)), F.lit(0.0))


def throughput(df: DataFrame, seconds: str, counters: list[str], *also: Column) -> DataFrame:
    """Counter per second for each ``<counter>_total``."""
    return df.select(RUN, *[F.when(F.col(seconds) > 0, F.col(f"{c}_total") / F.col(seconds)).alias(f"{c}_per_second")
                            for c in counters], *also)


def samples_per_second(step: Column, batch: int, accum: int, seconds: Column) -> Column:
    return step * batch * accum / F.greatest(F.lit(1.0), seconds)


def run_rates(df: DataFrame, step: str, ts: str, counters: list[str], batch: int, accum: int) -> DataFrame:
    """Counters and samples per second of each run, from one grouping of the log."""
    ends = df.groupBy(RUN).agg(F.min_by(ts, SEQ).alias("t0"), F.max_by(ts, SEQ).alias("t1"), F.count(F.lit(1)).alias("rows"), F.max_by(step, SEQ).alias("current_step"),
                               *[F.sum(F.coalesce(c, F.lit(0))).alias(f"{c}_total") for c in counters])
    end = F.when(F.col("rows") == 1, F.current_timestamp()).otherwise(instant(ends, "t1"))
    seconds = F.greatest(F.lit(0.0), F.coalesce((F.unix_micros(end) - F.unix_micros(instant(ends, "t0"))) / 1e6, F.lit(0.0)))
    timed = ends.withColumn("elapsed_seconds", seconds)
    return throughput(timed, "elapsed_seconds", counters, samples_per_second(F.col("current_step"), batch, accum, F.col("elapsed_seconds")).alias("samples_per_second"))


def loss_smoothing(df: DataFrame, step: str, loss: str, log_every: int = 10) -> DataFrame:
    """Micro losses to update means to means per log window: step 1, then every ``log_every`` steps.

    A last window that has not reached its end is not logged.
    """
    updates = df.groupBy(RUN, step).agg(F.avg(loss).alias("update_loss"))
    window_end = F.when(F.col(step) == 1, 1).otherwise(F.ceil(F.col(step) / log_every) * log_every).cast("bigint")
    logged = updates.groupBy(RUN, window_end.alias("log_step")).agg(F.avg("update_loss").alias("loss"))
    reach = df.groupBy(RUN).agg(F.max(step).alias("_top"))
    return logged.join(reach, RUN).filter("log_step <= _top").drop("_top")


def val_loss(df: DataFrame, batch: str, loss: str, batches: int) -> DataFrame:
    """Mean over the first batches of the loss averaged over ranks."""
    per_batch = df.groupBy(RUN, batch).agg(F.avg(loss).alias("_l"))
    first = Window.partitionBy(RUN).orderBy(batch)
    return (per_batch.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= batches)
            .groupBy(RUN).agg(F.avg("_l").alias("val_loss"), F.count(F.lit(1)).alias("batches")))


def checkpoint_losses(checkpoints: DataFrame, log: DataFrame, loss: str = "loss") -> DataFrame:
    """Each checkpoint with the last logged loss at or before it (an as-of join by ``seq``)."""
    marks = checkpoints.select(RUN, (F.col(SEQ) * 2 + 1).alias("_k"), F.lit(True).alias("_mark"), F.lit(None).cast("double").alias(loss))
    rows = log.select(RUN, (F.col(SEQ) * 2).alias("_k"), F.lit(False).alias("_mark"), F.col(loss).cast("double").alias(loss))
    filled = carry_last(rows.unionByName(marks), [RUN], "_k", loss, "_carried")
    found = filled.filter("_mark").select(RUN, F.shiftright("_k", 1).alias(SEQ), F.col("_carried").alias(loss))
    return checkpoints.join(found, [RUN, SEQ], "left")


def checkpoint_backfill(checkpoints: DataFrame, log: DataFrame, loss: str = "loss") -> DataFrame:
    """A checkpoint without loss takes that of the first log row of the same step."""
    first = log.groupBy(RUN, "step").agg(F.min_by(loss, SEQ).alias("_logged"))
    return checkpoints.join(first, [RUN, "step"], "left").withColumn(loss, F.coalesce(loss, "_logged")).drop("_logged")


def dedupe_steps(df: DataFrame, step: str = "step") -> DataFrame:
    """Drop a row whose step equals that of the row before it in its run."""
    placed = previous(positions(df), [RUN], "pos", step, "_prev")
    return placed.filter(F.col("_prev").isNull() | (F.col("_prev") != F.col(step))).select(*df.columns)


def overlay(train: DataFrame, val: DataFrame) -> DataFrame:
    """Train and validation series on one step axis."""
    return train.join(val, [RUN, "step"], "full_outer")


def stop_reason(state: DataFrame, step: str, planned: str) -> DataFrame:
    """Why each run ended, and its total steps corrected to what was done."""
    reached = F.col(step) >= F.col(planned)
    short = (F.col(planned) > 0) & (F.col(step) < F.col(planned))
    return state.withColumns({
        "stop_reason": F.when(reached, "max_train_steps_reached").otherwise("epochs_completed_or_dataloader_exhausted"),
        "total_steps": F.when(short, F.col(step)).otherwise(F.col(planned))})


# Fixed values of the budget rule.
TOKENS_PER_PARAM = 20
FLOPS_PER_PARAM_TOKEN = 6
BYTES_PER_TOKEN = 4
DEVICE_FLOPS = 312e12 * 0.3


def corpus_budget(df: DataFrame, by: list[str], tokens: Column) -> DataFrame:
    """Model size, compute, bytes and device days that the tokens of each source call for."""
    t = F.col("tokens")
    params = t / TOKENS_PER_PARAM
    flops = FLOPS_PER_PARAM_TOKEN * params * t
    return df.groupBy(*by).agg(F.sum(tokens).alias("tokens")).select(
        *by, "tokens", params.alias("params"), flops.alias("flops"), (t * BYTES_PER_TOKEN).alias("bytes"),
        (flops / DEVICE_FLOPS / 86400).alias("device_days"))
