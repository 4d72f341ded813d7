"""Plans keep data-sized rows out of single tasks, cross joins and per-row Python."""

import re

import pytest

from __spark_entry__ import queries

# Queries that read a written or streamed result have no plan of their own to look at.
LOOK_AT = ["signal_groups", "group_advantage", "zero_gradient_filter", "success_store", "assign_teacher", "best_worst", "gae", "global_index",
           "holdout_split", "byte_cap", "batches", "rolling_mean", "rolling_outcomes", "histories", "checkpoint_list", "dedupe_steps",
           "loss_smoothing", "policy_loss", "encode_fixed", "reward_combined", "reward_rules", "map_fields", "nested_get", "pad_group",
           "shard_overlap_check", "decimate", "train_val_overlay", "attach_reference"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LOOK_AT)
def test_no_cross_join_and_no_row_python(spark, sf_dir, name):
    text = plan(queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text and "FlatMapGroupsInPandas" not in text


@pytest.mark.parametrize("name", LOOK_AT)
def test_only_totals_and_limits_meet_in_one_partition(spark, sf_dir, name):
    text = plan(queries()[name](spark, sf_dir))
    for single in re.finditer(r"Exchange SinglePartition.*\n(.*)\n", text):
        assert "HashAggregate" in single.group(1) or "LocalLimit" in single.group(1), single.group()


@pytest.mark.parametrize("name", ["byte_cap", "extract_rows", "head_limit", "reservoir_sample"])
def test_prefixes_need_no_global_limit(spark, sf_dir, name):
    assert "GlobalLimit" not in plan(queries()[name](spark, sf_dir)) and "TakeOrdered" not in plan(queries()[name](spark, sf_dir))


@pytest.mark.parametrize("name,most", [("histories", 3), ("dedupe_steps", 3), ("gae", 3), ("byte_cap", 3), ("throughput", 1)])
def test_logs_are_scanned_for_rows_and_block_sums(spark, sf_dir, name, most):
    """Once for the rows; the block sums appear twice in the plan and share one exchange."""
    assert len(re.findall("FileScan", plan(queries()[name](spark, sf_dir)))) <= most


@pytest.mark.parametrize("name", ["sft_labels", "mask_report", "mask_listing"])
def test_default_tokens_stay_in_the_jvm(spark, sf_dir, name):
    assert "Python" not in plan(queries()[name](spark, sf_dir)) and "Arrow" not in plan(queries()[name](spark, sf_dir))


def test_rank_limits_run_before_the_shuffle(spark, sf_dir):
    for name in ("success_store", "decimate"):
        assert re.search(r"WindowGroupLimit.*Partial", plan(queries()[name](spark, sf_dir)))


def test_scans_read_only_what_they_need(spark, sf_dir):
    text = plan(queries()["signal_groups"](spark, sf_dir))
    assert "l_orderkey" in text and "l_shipdate" not in text and "l_extendedprice" not in text


@pytest.mark.parametrize("name,table,most", [("group_advantage", "lineitem", 1), ("zero_gradient_filter", "lineitem", 1), ("assign_teacher", "lineitem", 1)])
def test_group_joins_read_written_groups(spark, sf_dir, name, table, most):
    """The groups come from a table written before; the plan itself scans the rows once."""
    assert len(re.findall(rf"FileScan.*{table}[.]parquet", plan(queries()[name](spark, sf_dir)))) <= most


def test_newest_rows_need_no_global_limit(spark, sf_dir):
    text = plan(queries()["replay_fifo"](spark, sf_dir))
    assert "GlobalLimit" not in text and "TakeOrdered" not in text
