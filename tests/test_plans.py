"""The physical plans: how often rows move, and what must never appear."""

import re

import pytest
from conftest import bars_of, walk

from barloom.operators import patterns as P
from barloom.operators import structure as M
from barloom.operators.indicators import indicator_frame
from barloom.operators.series import frame, number_rows
from barloom.plans import all_oracles, all_queries
from barloom.plans.registry import QUERIES

HEAVY = {
    "signal_scores", "agent_votes", "agent_decision", "agent_summary", "classifier_cross_validation",
    "classifier_members", "calibrated_probability", "stacked_probability", "meta_label", "model_status",
    "signal_chain", "signal_block_reasons", "agent_track_record", "agent_reasons", "agent_critique", "engine_snapshot_full",
    "series_forest_folds", "series_forest_status", "series_calibration", "series_stack",
}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def numbered(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "bars")
    number_rows(bars_of(spark, walk(300, "a", 1))).write.parquet(path)
    return spark.read.parquet(path)


def test_a_family_of_windows_moves_the_rows_once(numbered):
    f = frame(numbered, back=600).then(*M.STRUCTURE, (P.wyckoff, P.supply_demand, P.harmonics), P.candle_reaction)
    plan = plan_of(f.core())
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
    assert len(re.findall(r"\bSort \[", plan)) == 1


def test_scans_add_only_the_small_summaries(numbered):
    plan = plan_of(indicator_frame(numbered, ["averages", "macd", "rsi"]).core("ema_20", "macd_signal", "rsi_14"))
    # Summary per sub-block, its spread to later sub-blocks, and the rows with the markers.
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 3
    assert len(re.findall(r"\bSort \[", plan)) == 1


def test_scan_reads_only_needed_columns(numbered):
    plan = plan_of(indicator_frame(numbered, ["rsi"]).core("rsi_14"))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert "volume" not in schema and "open" not in schema and "close" in schema


def test_time_filter_reaches_the_files(spark, samples):
    plan = plan_of(QUERIES["ticks_in_interval"](spark, samples))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(ts", plan)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - HEAVY))
def test_no_theta_join_and_no_python(spark, samples, name):
    plan = plan_of(QUERIES[name](spark, samples))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan


def test_every_query_with_sql_is_registered():
    assert set(all_oracles()) <= set(all_queries())
    assert len(all_queries()) - len(all_oracles()) <= 6
