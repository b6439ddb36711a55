"""Autoregressions, splits and evaluation against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stationlake.operators import evaluation, forecasting, periods, splits
from stationlake.operators.forecasting import Order, param_grid
from stationlake.operators.ordered import POS, SIZE

KEYS = ["station"]


def series(n=200, seed=0):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    return 20 + 5 * np.sin(2 * np.pi * t / 12) + 0.02 * t + rng.normal(0, 1, n).cumsum() * 0.3


@pytest.fixture(scope="module")
def values():
    return {"a": series(200, 1), "b": series(160, 2)}


@pytest.fixture(scope="module")
def grid(spark, values):
    start = pd.Timestamp("2024-01-01")
    rows = [
        (k, (start + pd.Timedelta(hours=i)).to_pydatetime(), i, len(v), float(x))
        for k, v in values.items()
        for i, x in enumerate(v)
    ]
    return spark.createDataFrame(
        rows, f"station string, hour_ts timestamp_ntz, {POS} long, {SIZE} long, temp_c double"
    ).cache()


def difference(y, order):
    w = y.copy()
    for step in [1] * order.d + [order.s] * order.D:
        w = np.concatenate([np.full(step, np.nan), w[step:] - w[:-step]])
    return w


def design(w, lags):
    x = np.stack([np.ones(len(w))] + [np.concatenate([np.full(k, np.nan), w[:-k]]) for k in lags], 1)
    return x


ORDERS = [Order(1, 0, 0, 0, 12), Order(2, 1, 0, 0, 12), Order(1, 0, 1, 1, 12), Order(2, 1, 1, 1, 12), Order(0, 1, 0, 1, 12)]


@pytest.mark.parametrize("order", ORDERS, ids=lambda o: o.name)
@pytest.mark.parametrize("block", [17, 10_000])
def test_fit_and_in_sample(spark, grid, values, order, block):
    fitted = forecasting.fit_seasonal_ar(grid, KEYS, "temp_c", order, block_rows=block)
    got = {r.station: r for r in fitted.collect()}
    predicted = forecasting.predict_in_sample(grid, KEYS, "temp_c", fitted, order, block_rows=block)
    predicted = {(r.station, r[POS]): r.forecast for r in predicted.collect()}
    for k, y in values.items():
        w = difference(y, order)
        x = design(w, order.lags)
        ok = ~np.isnan(w) & ~np.isnan(x).any(1)
        beta = np.linalg.lstsq(x[ok], w[ok], rcond=None)[0]
        np.testing.assert_allclose([got[k].intercept, *got[k].coefficients], beta, atol=1e-6)
        resid = w[ok] - x[ok] @ beta
        assert got[k].sigma == pytest.approx(np.sqrt(resid @ resid / (ok.sum() - len(beta))), abs=1e-6)
        for pos in np.flatnonzero(ok):
            assert predicted[(k, pos)] == pytest.approx(y[pos] - w[pos] + x[pos] @ beta, abs=1e-5)


@pytest.mark.parametrize("order", ORDERS, ids=lambda o: o.name)
def test_horizon_recursion(spark, grid, values, order):
    fitted = forecasting.fit_seasonal_ar(grid, KEYS, "temp_c", order)
    rows = forecasting.forecast_horizon(grid, KEYS, "temp_c", fitted, order, 30).orderBy("hour_ts").collect()
    betas = {r.station: [r.intercept, *r.coefficients] for r in fitted.collect()}
    for k, y in values.items():
        path = list(y)
        for _ in range(30):
            w = difference(np.array([*path, 0.0]), order)
            target = betas[k][0] + sum(b * w[-1 - lag] for b, lag in zip(betas[k][1:], order.lags))
            path.append(target - w[-1])
        mine = [r for r in rows if r.station == k]
        np.testing.assert_allclose([r.forecast for r in mine], path[len(y):], atol=1e-5)
        widths = [r.upper_bound - r.lower_bound for r in mine]
        assert all(b >= a - 1e-9 for a, b in zip(widths, widths[1:]))


@pytest.mark.parametrize("gap", [0, 5])
def test_grid_search(spark, grid, values, gap):
    orders = param_grid(p=(0, 1, 2), d=(0, 1), P=(0, 1), D=(0, 1), s=(12,))
    got = {
        (r.station, r.order_name): r.rmse
        for r in forecasting.grid_search_cv(grid, KEYS, "temp_c", orders, 3, gap, 50).collect()
    }
    assert len(got) == 2 * len(orders)
    all_lags = {(d, D): sorted({l for o in orders if (o.d, o.D) == (d, D) for l in o.lags}) for d in (0, 1) for D in (0, 1)}
    for k, y in values.items():
        n, size = len(y), len(y) // 4
        for o in orders:
            w = difference(y, o)
            shared = design(w, all_lags[(o.d, o.D)])
            ok = ~np.isnan(w) & ~np.isnan(shared).any(1)
            x = design(w, o.lags)
            pos = np.arange(n)
            scores = []
            for fold in (1, 2, 3):
                start = n - (3 - fold + 1) * size
                train, test = ok & (pos < start - gap), ok & (pos >= start) & (pos < start + size)
                beta = np.linalg.lstsq(x[train], w[train], rcond=None)[0]
                scores.append(np.sqrt(np.mean((w[test] - x[test] @ beta) ** 2)))
            assert got[(k, o.name)] == pytest.approx(np.mean(scores), abs=1e-5), (k, o.name)


def test_best_order_ties_by_name(spark):
    df = spark.createDataFrame([("a", "z", 1.0), ("a", "b", 1.0), ("a", "c", 2.0)], "station string, order_name string, rmse double")
    assert forecasting.best_order(df, KEYS).first().order_name == "b"


def test_failing_model_is_left_out(spark, grid):
    def broken(*_):
        raise RuntimeError("no")

    out = forecasting.run_models(grid, KEYS, "temp_c", {"bad": broken, "persistence": forecasting.persistence})
    assert [r.model for r in out.select("model").distinct().collect()] == ["persistence"]
    with pytest.raises(ValueError, match="bad: no"):
        forecasting.run_models(grid, KEYS, "temp_c", {"bad": broken})


def test_splits_cover_once(spark, grid):
    rows = splits.split_chronological(grid)
    counts = {(r.station, r.split): r["count"] for r in rows.groupBy("station", "split").count().collect()}
    assert counts[("a", "train")] == 140 and counts[("a", "validation")] == 30 and counts[("a", "test")] == 30
    folds = splits.ts_cv_folds(grid, 3).filter("role = 'test'")
    assert folds.count() == folds.select("station", POS).distinct().count() == 3 * 50 + 3 * 40


def test_sample_takes_all_of_a_small_group(spark):
    df = spark.range(1000).withColumn("k", F.when(F.col("id") < 900, "big").otherwise(F.col("id").cast("string")))
    got = splits.sample_per_group(df, ["k"], 5, "id").groupBy("k").count()
    assert {r["count"] for r in got.filter("k = 'big'").collect()} == {5}
    assert got.count() == 101


def test_metrics_edge_cases(spark):
    df = spark.createDataFrame(
        [("exact", 5.0, 5.0), ("exact", 5.0, 5.0), ("off", 5.0, 6.0), ("off", 5.0, 6.0), ("zero", 0.0, 1.0), ("zero", 2.0, 1.0)],
        "model string, y double, forecast double",
    )
    got = {r.model: r for r in evaluation.forecast_metrics(df, ["model"], "y").collect()}
    assert got["exact"].r2 == 1.0 and got["exact"].rmse == 0.0
    assert got["off"].r2 == 0.0 and got["off"].mape == pytest.approx(20.0)
    assert got["zero"].mape > 1e15 and got["zero"].r2 == 0.0


def test_weights_sum_to_one(spark):
    metrics = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 0.0)], "model string, rmse double")
    weights = {r.model: r.weight for r in evaluation.ensemble_weights(metrics).collect()}
    assert sum(weights.values()) == pytest.approx(1.0) and weights["c"] == pytest.approx(1.0)


def test_differences_are_symmetric(spark):
    df = spark.createDataFrame(
        [("s", 1, "a", 1.0), ("s", 1, "b", 3.0), ("s", 2, "a", 2.0), ("s", 2, "b", 1.0), ("s", 2, "c", 0.0)],
        "station string, t int, model string, forecast double",
    )
    got = {(r.model_a, r.model_b): r.difference for r in evaluation.model_differences(df, ["station", "t"], ["a", "b", "c"]).collect()}
    assert got[("a", "b")] == got[("b", "a")] == 1.5 and got[("a", "a")] == 0.0 and got[("a", "c")] == 2.0


def test_normal_quantiles(spark):
    from statistics import NormalDist

    from stationlake.functions.stats import normal_quantile

    df = spark.range(1, 100).select((F.col("id") / 100).alias("p"))
    for r in df.select("p", normal_quantile(F.col("p")).alias("z")).collect():
        assert r.z == pytest.approx(NormalDist().inv_cdf(r.p), abs=4.5e-4)


def test_model_that_fails_in_a_task_leaves_the_others(spark, grid):
    def fails(rows, keys, column):
        bad = F.when(F.col("station") == "b", F.raise_error(F.lit("not this station"))).otherwise(F.col(column))
        return forecasting.persistence(rows.withColumn(column, bad.cast("double")), keys, column)

    models = {"fails": fails, "persistence": forecasting.persistence, "plan": lambda *_: 1 / 0}
    rows, status = forecasting.run_each(grid, KEYS, "temp_c", models)
    assert [r.model for r in rows.select("model").distinct().collect()] == ["persistence"]
    found = {r.model: r for r in status.collect()}
    assert {m: r.ok for m, r in found.items()} == {"fails": False, "persistence": True, "plan": False}
    assert "not this station" in found["fails"].reason and "zero" in found["plan"].reason
    assert found["persistence"].reason is None
    none, status = forecasting.run_each(grid, KEYS, "temp_c", {"fails": fails})
    assert none is None and status.first().ok is False


def diagnostics(e, lags):
    e = np.array([x for x in e if x is not None])
    n, c = len(e), e - e.mean()
    rho = [(c[k:] @ c[:-k]) / (c @ c) if k < n else 0.0 for k in range(1, lags + 1)]
    return e.mean(), e.std(), n * (n + 2) * sum(r * r / (n - k) for k, r in enumerate(rho, 1) if k < n)


@pytest.mark.parametrize("block", [3, 17, 10_000])
def test_residual_diagnostics_by_blocks(spark, block):
    rng = np.random.default_rng(4)
    series = {"a": [float(x) for x in rng.normal(1000, 1, 90).cumsum() * 0.01 + 1e6], "b": [1.0, 5.0, 2.0, 4.0]}
    series["a"][10:40] = [None] * 30  # blocks without a residual, and lags across them
    rows = [(k, i, None if x is None else x + 3.0, 3.0) for k, v in series.items() for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, f"station string, {POS} long, y double, forecast double")
    got = evaluation.residual_diagnostics(df, KEYS, "y", [POS], 10, block_rows=block)
    assert got.count() == 2
    for r in got.collect():
        wanted = diagnostics(series[r.station], 10)
        np.testing.assert_allclose([r["mean"], r["std"], r.ljung_box], wanted, rtol=1e-7)
        e = np.array([x for x in series[r.station] if x is not None])
        c = (e - e.mean()) / e.std()
        jb = len(e) / 6 * (np.mean(c**3) ** 2 + (np.mean(c**4) - 3) ** 2 / 4)
        assert r.jarque_bera_p == pytest.approx(np.exp(-jb / 2), rel=1e-6)


def test_residuals_with_positions_are_not_numbered_again(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "lay_out", None)
    df = spark.createDataFrame([("a", 0, 1.0, 2.0), ("a", 1, 4.0, 2.0)], f"station string, {POS} long, y double, forecast double")
    assert evaluation.residual_diagnostics(df, KEYS, "y", []).first()["mean"] == 0.5


# --- calendars ---


def readings(spark, rows):
    df = spark.createDataFrame(rows, "station string, t string, x double")
    return df.select("station", F.col("t").cast("timestamp_ntz").alias("ts"), "x")


@pytest.mark.parametrize("name,starts", [
    ("day", ["2024-02-27", "2024-02-28", "2024-02-29", "2024-03-01", "2024-03-02"]),
    ("12 hours", [f"2024-02-{d} {h}" for d in (27, 28, 29) for h in ("00", "12")] + ["2024-03-01 00", "2024-03-01 12", "2024-03-02 00"]),
    ("month", ["2024-02", "2024-03"]),
    ("15 minutes", None),
])
def test_grid_positions_follow_the_calendar(spark, name, starts):
    frequency = periods.Frequency.parse(name)
    rows = [("a", "2024-02-27 05:10:00", 1.0), ("a", "2024-02-27 07:50:00", 3.0), ("a", "2024-03-02 00:00:00", 5.0), ("b", "1969-12-31 23:59:59", 2.0), ("c", None, 1.0)]
    grid = periods.resample_mean(readings(spark, rows), KEYS, ["x"], frequency)
    assert periods.frequency_of(grid) == frequency
    found = sorted((r.station, r[POS], r.hour_ts, r.x, r[SIZE]) for r in grid.where("station = 'a'").collect())
    assert [f[1] for f in found] == list(range(len(found))) and {f[4] for f in found} == {len(found)}
    if starts:
        assert [pd.Timestamp(f[2]) for f in found] == [pd.Timestamp(s if len(s) < 12 else s + ":00") for s in starts]
    # a bin holds what pandas puts into it
    pandas = {"day": "D", "12 hours": "12h", "month": "MS", "15 minutes": "15min"}[name]
    x = pd.Series([1.0, 3.0, 5.0], pd.to_datetime([r[1] for r in rows[:3]])).resample(pandas).mean()
    assert [pd.Timestamp(f[2]) for f in found] == list(x.index)
    np.testing.assert_allclose([np.nan if f[3] is None else f[3] for f in found], x.to_numpy())
    before = grid.where("station = 'b'").first()
    wanted = {"day": "1969-12-31", "12 hours": "1969-12-31 12:00", "month": "1969-12-01", "15 minutes": "1969-12-31 23:45"}
    assert pd.Timestamp(before.hour_ts) == pd.Timestamp(wanted[name])


def test_months_are_forecast_on_their_calendar(spark):
    rng = np.random.default_rng(6)
    months = pd.date_range("2020-01-01", periods=40, freq="MS")
    rows = [("a", str(t), float(x)) for t, x in zip(months, rng.normal(10, 1, 40))]
    rows += [("short", str(t), float(i)) for i, t in enumerate(months[:3])]
    grid = periods.resample_mean(readings(spark, rows), KEYS, ["x"], periods.Frequency("month"))
    order = Order(p=1)
    fitted = forecasting.fit_seasonal_ar(grid, KEYS, "x", order)
    out = forecasting.forecast_horizon(grid, KEYS, "x", fitted, order, 14, unit="months").collect()
    found = sorted(r.hour_ts for r in out if r.station == "a")
    assert [pd.Timestamp(t) for t in found] == list(pd.date_range("2023-05-01", periods=14, freq="MS"))
    # two rows with a lag, two coefficients: nothing left for a deviation
    assert [r.status for r in out if r.station == "short"] == ["too short"]
    naive = forecasting.seasonal_naive_horizon(grid.where("station = 'a'"), KEYS, "x", 2, 12).collect()
    assert sorted(str(r.hour_ts)[:7] for r in naive) == ["2023-05", "2023-06"]
    with pytest.raises(ValueError, match="1 month"):
        forecasting.forecast_horizon(grid, KEYS, "x", fitted, order, 14, unit="hours")


def test_frequency_survives_the_fills(spark):
    from stationlake.operators.cleaning import carry_and_interpolate
    from stationlake.session import materialise

    grid = periods.resample_mean(
        readings(spark, [("a", "2024-01-01", 1.0), ("a", "2024-01-05", 5.0)]), KEYS, ["x"], periods.DAILY
    )
    filled = materialise(carry_and_interpolate(grid, KEYS, ["x"], 1, 9), "filled")
    assert periods.frequency_of(filled) == periods.DAILY
    assert [r.x for r in filled.orderBy(POS).collect()] == pytest.approx([1, 1, 1 + 4 / 3, 1 + 8 / 3, 5])


def test_bad_frequencies():
    for bad in ("fortnight", "0 days", "", "1.5 hours"):
        with pytest.raises(ValueError):
            periods.Frequency.parse(bad)
