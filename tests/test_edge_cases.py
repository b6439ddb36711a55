"""Null keys, zones, infinities, headless files, and workers away from the repository."""

import os
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from helpers import KEYS, laid
from pyspark.sql import functions as F

from stationlake.functions import text
from stationlake.operators import aggregates, cleaning, features, forecasting, quality
from stationlake.sources import station_files, tables
from stationlake.streaming import aggregates as streaming


@pytest.mark.parametrize("wild", [-9999.0, float("inf")])
def test_a_wild_value_leaves_later_windows_alone(spark, wild):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(20, 3, 200), 2)
    x[60] = wild
    rows = [("a", t, float(v)) for t, v in enumerate(x)]
    got = features.rolling_stats(laid(spark, rows), KEYS, "x", 24, block_rows=64).toPandas()
    got = got.sort_values("t").reset_index(drop=True)
    frames = pd.Series(x).rolling(24, min_periods=1)
    clean = np.array([t < 60 or t >= 84 for t in range(200)])
    for name, wanted in (("mean", frames.mean()), ("std", frames.std()), ("skew", frames.skew()), ("kurt", frames.kurt())):
        # pandas keeps running totals too, so clean windows are computed one by one
        exact = np.array([getattr(pd.Series(x[max(0, t - 23) : t + 1]), name)() for t in range(200)])
        have = got[f"x_24_{name}"].astype(float).to_numpy()
        ok = clean & ~np.isnan(exact)
        np.testing.assert_allclose(have[ok], exact[ok], atol=1e-6, err_msg=f"{name} {len(wanted)}")


def test_bins_do_not_depend_on_the_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        ts = F.lit("2017-10-15 00:30:00").cast("timestamp_ntz")
        row = spark.range(1).select(
            aggregates.floor_time(ts, "hour").cast("string").alias("h"),
            aggregates.floor_time(ts, "day").cast("string").alias("d"),
        ).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert tuple(row) == ("2017-10-15 00:00:00", "2017-10-15 00:00:00")


def test_stream_windows_do_not_depend_on_the_zone(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("t.parquet", "out", "checkpoint"))
    rows = [("a", "2017-10-15 00:30:00", 1.0), ("a", "2017-10-15 00:45:00", 3.0), ("a", "2017-10-17 09:00:00", 1.0)]
    df = spark.createDataFrame(rows, "station string, ts string, temp_c double")
    df = df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.write.parquet(source)  # a table that is a folder
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        stream = streaming.stream_daily_aggregate(
            streaming.stream_table(spark, str(tmp_path), "t", df.schema), ["station"], ["temp_c"]
        )
        streaming.run_to_end(stream, out, checkpoint)
        got = [(str(r.window_start), r.rows) for r in spark.read.schema(stream.schema).parquet(out).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == [("2017-10-15 00:00:00", 2)]


def test_null_keys(spark):
    loaded = spark.createDataFrame([(None, 1), ("a", 2)], "k string, v int")
    fresh = spark.createDataFrame([(None, 3), ("b", 4)], "k string, v int")
    assert [r.v for r in tables.only_new(fresh, loaded, ["k"]).collect()] == [4]
    closed = spark.createDataFrame([(None, 1, 2)], "station string, w int, rows int")
    batch = spark.createDataFrame([(None, 1, 9), (None, 2, 3)], "station string, w int, rows int")
    flushed = streaming.flush_open(closed, batch, ["station", "w"]).collect()
    assert sorted((r.w, r.rows) for r in flushed) == [(1, 2), (2, 3)]
    rows = spark.createDataFrame([(None, None, "p"), (None, "s", None), ("a", "t", "q")], "station string, x string, y string")
    filled = cleaning.fill_mode(rows, ["station"], ["x", "y"]).collect()
    assert sorted(map(tuple, filled), key=str) == sorted([(None, "s", "p"), (None, "s", "p"), ("a", "t", "q")], key=str)
    values = [(None, "1")] * 3 + [("a", "1")] * 4 + [("a", None), (None, "x"), (None, "1"), ("a", "2")]
    report = quality.validation_report(
        spark.createDataFrame(values, "station string, v string"), ["station"], "v", {"v": "double"}, 0.1
    ).first()
    assert report.missing_rate == pytest.approx(2 / 11)


def test_only_finite_numbers(spark):
    texts = ["1.5", " 2 ", "inf", "-Infinity", "1e999", "NaN", "", None, "x"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.n for r in rows.select("i", text.number(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == [1.5, 2.0] + [None] * 7


def test_files_without_header_are_named(spark):
    head = ["UF:;DF", "DATA (YYYY-MM-DD);HORA (UTC);TEMPERATURA DO AR - BULBO SECO, HORARIA (°C);"]
    row = "2013-01-01;00:00;21,4;"
    files = {"good": [*head, row], "bare": [row], "odd": ["UF:;DF", "Dia;Hora;TEMP", row], "empty": head}
    lines = spark.createDataFrame([(p, x) for p, xs in files.items() for x in xs], "path string, line string")
    assert [r.path for r in station_files.parse_station_lines(lines).collect()] == ["good"]
    rejects = {r.path: (r.reason, r.lines) for r in station_files.rejected_files(lines).collect()}
    assert rejects == {
        "bare": ("no header line", 1), "odd": ("no header line", 2), "empty": ("no data line", 0)
    }


def test_csv_columns_are_bound_by_name(spark, tmp_path):
    for i, content in enumerate(["temp_c,humidity\n21.5,88\n", "humidity,other,temp_c\n87,z,20.5\n", "temp_c\n1.5\n"]):
        (tmp_path / f"{i}.csv").write_text(content)
    schema = spark.createDataFrame([], "temp_c float, humidity float").schema
    got = sorted(map(tuple, tables.read_typed_csv(spark, str(tmp_path), schema).collect()))
    assert got == [(1.5, None), (20.5, 87.0), (21.5, 88.0)]
    plan = tables.read_typed_csv(spark, str(tmp_path / "0.csv"), schema)
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_versions(spark):
    runs = spark.createDataFrame([("m", 1), ("m", 2), ("n", 1)], "name string, run_ts int")
    assert forecasting.version_exists(runs, "m", 2)
    assert not forecasting.version_exists(runs, "n", 2)


def test_workers_find_the_package_from_elsewhere(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import sys; sys.path.insert(0, {repo!r})\n"
        "import __spark_entry__ as entry\n"
        "from stationlake.session import local_session\n"
        "spark = local_session('2', 'elsewhere')\n"
        "print('rows', entry.queries()['read_zip_archives'](spark, '/root/testdata/sf0.001').count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert "rows 868" in run.stdout, run.stderr[-2000:]


def hourly(spark, series):
    """A laid out grid of ``{station: values}``."""
    rows = [(k, t, v) for k, vs in series.items() for t, v in enumerate(vs)]
    df = laid(spark, rows)
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    return df.withColumn("hour_ts", start + F.make_dt_interval(hours=F.col("t")))


def test_gap_beyond_a_test_block(spark):
    rng = np.random.default_rng(1)
    y = np.cumsum(rng.normal(0, 1, 100)) + 20
    grid = hourly(spark, {"a": [float(v) for v in y], "b": [1.0, 2.0, 3.0]})
    order = forecasting.Order(1, 0, 0, 0, 1)
    found = {r.station: r for r in forecasting.grid_search_cv(grid, KEYS, "x", [order], 3, 40).collect()}
    scores = []
    for fold in (1, 2, 3):
        start = 100 - (3 - fold + 1) * 25
        t = np.arange(1, max(1, start - 40))
        if len(t) < 2:
            continue
        beta = np.linalg.lstsq(np.column_stack([np.ones(len(t)), y[t - 1]]), y[t], rcond=None)[0]
        s = np.arange(start, start + 25)
        scores.append(np.sqrt(np.mean((y[s] - beta[0] - beta[1] * y[s - 1]) ** 2)))
    assert found["a"].folds == len(scores) == 2
    assert found["a"].rmse == pytest.approx(np.mean(scores), abs=1e-6)
    # too short for four blocks, but not lost
    assert (found["b"].folds, found["b"].rmse) == (0, None)


def test_every_station_is_in_the_horizon(spark, monkeypatch):
    rng = np.random.default_rng(2)
    series = {f"s{i}": [float(v) for v in rng.normal(10, 1, 60)] for i in range(5)}
    series["hole"] = [*series["s0"][:-1], None]
    grid = hourly(spark, series)
    order = forecasting.Order(1, 0, 0, 0, 1)
    fitted = forecasting.fit_seasonal_ar(grid, KEYS, "x", order).where("station <> 's4'")
    monkeypatch.setattr(forecasting, "HELD_VALUES", 25)
    rows = forecasting.forecast_horizon(grid, KEYS, "x", fitted, order, 10, unit="hours").collect()
    status = {r.station: r.status for r in rows}
    assert status == {**{f"s{i}": "ok" for i in range(4)}, "s4": "no model", "hole": "gap at the end"}
    assert len(rows) == 4 * 10 + 2
    first = min(r.hour_ts for r in rows if r.station == "s0")
    assert str(first) == "2024-01-03 12:00:00"
    with pytest.raises(ValueError, match="1 hour"):
        forecasting.forecast_horizon(grid, KEYS, "x", fitted, order, 10, unit="days")


def test_default_models_equal_the_single_ones(spark):
    rng = np.random.default_rng(3)
    grid = hourly(spark, {"a": [float(v) for v in rng.normal(10, 1, 80)], "b": [1.0, None, 3.0] * 12})
    one = forecasting.run_models(grid, KEYS, "x")
    each = forecasting.run_models(grid, KEYS, "x", forecasting.MODELS)
    assert one.columns == each.columns

    def rows(df):
        return sorted(
            (r.station, r.model, str(r.hour_ts), *(round(v, 9) for v in (r.forecast, r.lower_bound, r.upper_bound)))
            for r in df.collect()
        )

    assert rows(one) == rows(each)


def test_scratch_is_cleared(spark, monkeypatch, tmp_path):
    from stationlake import session

    monkeypatch.setattr(session, "_MADE", [])
    monkeypatch.setattr(session, "scratch_root", lambda _: str(tmp_path))
    assert session.materialise(spark.range(3), "kept").count() == 3
    assert len(list(tmp_path.iterdir())) == 1
    assert session.clear_scratch(spark) == 1
    assert list(tmp_path.iterdir()) == []
