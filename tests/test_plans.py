"""Shapes of physical plans that matter at scale."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from stationlake.operators.ordered import BLOCK
from stationlake.plans import standins
from stationlake.plans.catalogue import QUERIES
from stationlake.sources import links, tables

SF_DIR = "/root/testdata/sf0.001"
PYTHON_ALLOWED = {
    "read_zip_archives", "fit_ar1", "fit_seasonal_ar", "grid_search_cv", "grid_search_best",
    "grid_search_full", "predict_in_sample", "forecast_horizon_ar", "forecast_horizon_days",
}


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_global_window_and_no_python(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF_DIR))
    for line in plan.splitlines():
        match = re.search(r"Window \[.*windowspecdefinition\((.*?)\)", line)
        if match:
            assert not re.match(r"[\w]+#\d+L? (ASC|DESC)", match.group(1)), line
    if name not in PYTHON_ALLOWED:
        assert "Python" not in plan and "MapInPandas" not in plan


@pytest.mark.parametrize(
    "name", ["ffill_limited", "interpolate_linear", "replace_outliers_rolling_iqr", "rolling_stats_720"]
)
def test_series_windows_run_on_blocks(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF_DIR))
    windows = [l for l in plan.splitlines() if "series_pos" in l and re.search(r"\bWindow \[", l)]
    assert windows and all(BLOCK in l for l in windows)


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "years")
    orders = standins.table(spark, SF_DIR, "orders").withColumn("year", F.year("o_orderdate"))
    tables.write_parquet(orders, path)
    picked = links.filter_year_range(tables.read_parquet(spark, path), 1996, 1997).filter("o_totalprice > 10")
    plan = picked.select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*year", plan)
    assert "GreaterThan(o_totalprice,10.0)" in plan
    assert "o_orderpriority" not in plan.split("ReadSchema")[1]


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from stationlake.session import scratch_root

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        conf = Conf()
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_root(Session())


def test_shuffle_partitions_follow_the_input(spark, monkeypatch):
    from stationlake import session

    usual = spark.conf.get("spark.sql.shuffle.partitions")
    assert session.size_shuffles(spark, SF_DIR) == int(usual)
    assert spark.conf.get(session._INITIAL, None) is None
    try:
        monkeypatch.setattr(session, "TARGET_PARTITION_BYTES", 1000)
        entry.queries()["null_sentinels"](spark, SF_DIR)
        sized = int(spark.conf.get(session._INITIAL))
        assert sized > int(usual) == int(spark.conf.get("spark.sql.shuffle.partitions"))
        monkeypatch.setattr(session, "MOST_PARTITIONS", 9)
        assert session.size_shuffles(spark, SF_DIR) == 9
    finally:
        monkeypatch.undo()
        # the next query takes its own number
        entry.queries()["null_sentinels"](spark, SF_DIR)
    assert spark.conf.get(session._INITIAL, None) is None


def jobs_of(spark, group, run):
    context = spark.sparkContext
    context.setJobGroup(group, group)
    try:
        run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    return len(context.statusTracker().getJobIdsForGroup(group))


def test_few_jobs_for_residuals_and_the_whole_grid(spark):
    from stationlake.operators import evaluation, forecasting

    rows, hours = standins.forecasts(spark, SF_DIR), standins.filled_grid(spark, SF_DIR)
    diagnostics = lambda: evaluation.residual_diagnostics(rows, ["station", "model"], "temp_c", ["hour_ts"]).collect()
    assert jobs_of(spark, "residuals", diagnostics) <= 10
    orders = forecasting.param_grid()
    assert jobs_of(spark, "orders", lambda: forecasting.grid_search_cv(hours, ["station"], "temp_c", orders).collect()) <= 20
    # one pass over blocks for all differencings
    moments = forecasting._all_moments(hours, ["station"], "temp_c", forecasting._differencings(orders), 3, 0, 1000)
    plan = moments._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and plan.count("explode") == 1


def test_station_lines_are_read_and_classified_once(spark, tmp_path):
    from stationlake.sources import station_files

    (tmp_path / "a.csv").write_text("UF:;DF\nDATA;HORA;TEMPERATURA DO AR - BULBO SECO, HORARIA (°C)\n2013-01-01;00:00;1\n")
    out = station_files.read_station_files(spark, str(tmp_path))
    plan = plan_of(out)
    assert "[value" not in plan and "RLIKE" not in plan.upper()
    assert out.count() == 1


def test_quantiles_sort_no_values(spark, monkeypatch):
    from stationlake.operators import ordered

    monkeypatch.setattr(ordered, "lay_out", None)
    rows = standins.cleared(spark, SF_DIR)
    assert ordered.exact_quantiles(rows, ["station"], "temp_c", {"m": 0.5}).count() == 5


def test_means_are_broadcast_without_shuffling_the_readings(spark):
    from stationlake.operators.features import group_scale

    scaled = group_scale(standins.cleared(spark, SF_DIR), ["station"], "temp_c")
    plan = scaled._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_large_key_table_is_not_broadcast(spark):
    from stationlake.operators.features import group_scale

    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10")
        scaled = group_scale(standins.cleared(spark, SF_DIR), ["station"], "temp_c")
        plan = scaled._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    finally:
        spark.conf.set(key, before)
