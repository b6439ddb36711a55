"""Forecasts, their evaluation, ensembles and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stationlake.operators import evaluation, forecasting
from stationlake.operators.cleaning import interpolate_linear
from stationlake.operators.forecasting import Order
from stationlake.operators.ordered import POS, SIZE
from stationlake.operators.periods import DAILY, Frequency, resample_mean
from stationlake.plans.registry import big, query, sql_stamp, stamp, t, tidy
from stationlake.plans.standins import (
    CLEARED_SQL,
    FILLED_SQL,
    FORECASTS_SQL,
    MODEL_NAMES,
    STATION,
    cleared,
    filled_grid,
    forecasts,
    grid,
    interpolate_sql,
)
from stationlake.session import materialise

BOUNDS = ["forecast", "lower_bound", "upper_bound"]


def _bounds_sql(prefix=""):
    return ", ".join(f"{t(prefix + c)} AS {c}" for c in BOUNDS)


def _bounds():
    return [tidy(c).alias(c) for c in BOUNDS]


# --- autoregressions ---

AR1_SQL = FILLED_SQL + """,
x AS (SELECT *, lag(temp_c) OVER (PARTITION BY station ORDER BY pos) AS x1 FROM filled),
fit AS (SELECT station, regr_slope(temp_c, x1) AS b, regr_intercept(temp_c, x1) AS a, count(*) AS n,
   sqrt((regr_syy(temp_c, x1) - regr_slope(temp_c, x1) * regr_sxy(temp_c, x1)) / (count(*) - 2)) AS sigma
  FROM x WHERE x1 IS NOT NULL AND temp_c IS NOT NULL GROUP BY 1)"""
AR1 = Order(p=1)


@query("fit_ar1", AR1_SQL + f""" SELECT station, n, {t('a')} AS intercept, {t('b')} AS slope, {t('sigma')} AS sigma,
 {t('6 + n * (ln(2 * pi() * sigma * sigma * (n - 2) / n) + 1)')} AS aic,
 {t('3 * ln(n) + n * (ln(2 * pi() * sigma * sigma * (n - 2) / n) + 1)')} AS bic FROM fit""")
def fit_ar1(spark, sf_dir):
    fitted = forecasting.fit_seasonal_ar(filled_grid(spark, sf_dir), STATION, "temp_c", AR1)
    return fitted.select(
        "station", "n", tidy("intercept").alias("intercept"),
        tidy(F.col("coefficients")[0]).alias("slope"), tidy("sigma").alias("sigma"),
        tidy("aic").alias("aic"), tidy("bic").alias("bic"),
    )


@query("fit_seasonal_ar", FILLED_SQL + f""",
d AS (SELECT *, temp_c - lag(temp_c) OVER (PARTITION BY station ORDER BY pos) AS w FROM filled),
x AS (SELECT *, lag(w, 1) OVER (PARTITION BY station ORDER BY pos) AS x1, lag(w, 24) OVER (PARTITION BY station ORDER BY pos) AS x2 FROM d),
c AS (SELECT * FROM x WHERE w IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL),
m AS (SELECT station, count(*) AS n, avg(w) AS mw, avg(x1) AS m1, avg(x2) AS m2, covar_pop(x1, x1) AS s11, covar_pop(x2, x2) AS s22,
   covar_pop(x1, x2) AS s12, covar_pop(w, x1) AS s1, covar_pop(w, x2) AS s2 FROM c GROUP BY 1),
b AS (SELECT *, (s1 * s22 - s2 * s12) / (s11 * s22 - s12 * s12) AS b1, (s2 * s11 - s1 * s12) / (s11 * s22 - s12 * s12) AS b2 FROM m)
 SELECT station, n, {t('mw - b1 * m1 - b2 * m2')} AS intercept, {t('b1')} AS lag_1, {t('b2')} AS lag_24 FROM b""")
def fit_seasonal_ar(spark, sf_dir):
    """One lag, one difference and one seasonal lag."""
    order = Order(p=1, d=1, P=1, s=24)
    fitted = forecasting.fit_seasonal_ar(filled_grid(spark, sf_dir), STATION, "temp_c", order)
    return fitted.select(
        "station", "n", tidy("intercept").alias("intercept"),
        tidy(F.col("coefficients")[0]).alias("lag_1"), tidy(F.col("coefficients")[1]).alias("lag_24"),
    )


SMALL_GRID = forecasting.param_grid(p=(0, 1), d=(0, 1), P=(0,), D=(0,), s=(24,))


def _fold_scores_sql():
    return FILLED_SQL + """,
d AS (SELECT *, temp_c - lag(temp_c) OVER (PARTITION BY station ORDER BY pos) AS dw FROM filled),
v AS (
  SELECT station, pos, n, 0 AS d, temp_c AS w, lag(temp_c) OVER (PARTITION BY station ORDER BY pos) AS x FROM d
  UNION ALL SELECT station, pos, n, 1, dw, lag(dw) OVER (PARTITION BY station ORDER BY pos) FROM d),
f AS (SELECT v.*, fold, n - (3 - fold + 1) * (n // 4) AS start, n // 4 AS size
  FROM v, (SELECT unnest([1, 2, 3]) AS fold) WHERE w IS NOT NULL AND x IS NOT NULL),
fit AS (SELECT station, d, fold, regr_slope(w, x) AS b, regr_intercept(w, x) AS a, avg(w) AS m
  FROM f WHERE pos < start GROUP BY 1, 2, 3),
e AS (SELECT f.station, f.d, f.fold, sqrt(avg((w - a - b * x) ** 2)) AS r1, sqrt(avg((w - m) ** 2)) AS r0
  FROM f JOIN fit ON fit.station = f.station AND fit.d = f.d AND fit.fold = f.fold
  WHERE pos >= start AND pos < start + size GROUP BY 1, 2, 3),
scores AS (
  SELECT station, '(1,' || d || ')(0,0,24)' AS order_name, avg(r1) AS rmse, count(*) AS folds FROM e GROUP BY 1, d
  UNION ALL SELECT station, '(0,' || d || ')(0,0,24)', avg(r0), count(*) FROM e GROUP BY 1, d)"""


@query("grid_search_cv", _fold_scores_sql() + f" SELECT station, order_name, {t('rmse')} AS rmse, folds FROM scores")
def grid_search_cv(spark, sf_dir):
    scores = forecasting.grid_search_cv(filled_grid(spark, sf_dir), STATION, "temp_c", SMALL_GRID)
    return scores.withColumn("rmse", tidy("rmse"))


@query("grid_search_best", _fold_scores_sql() + f""" SELECT station, order_name, {t('rmse')} AS rmse FROM (
  SELECT *, row_number() OVER (PARTITION BY station ORDER BY rmse, order_name) AS r FROM scores) WHERE r = 1""")
def grid_search_best(spark, sf_dir):
    scores = forecasting.grid_search_cv(filled_grid(spark, sf_dir), STATION, "temp_c", SMALL_GRID)
    return forecasting.best_order(scores, STATION).withColumn("rmse", tidy("rmse"))


def _full_grid_sql():
    """Scores of all 48 orders: least squares of up to three lags in closed form."""
    back = lambda c, k: f"lag({c}, {k}) OVER (PARTITION BY station ORDER BY pos)"
    parts = []
    for d, D, s in ((d, D, s) for d in (0, 1) for D in (0, 1) for s in (12, 24)):
        taps = Order(0, d, 0, D, s).difference()
        w = " ".join(f"{'-' if c < 0 else '+'} {back('temp_c', k) if k else 'temp_c'}" for k, c in taps.items())
        parts.append(
            f"SELECT station, pos, n, {d} AS d, {D} AS dd, {s} AS s, w, {back('w', 1)} AS x1, {back('w', 2)} AS x2, "
            f"{back('w', s)} AS x3 FROM (SELECT station, pos, n, {w} AS w FROM filled)"
        )
    pairs = ["w1", "w2", "w3", "11", "22", "33", "12", "13", "23"]
    name = lambda i: "w" if i == "w" else f"x{i}"
    covariances = ", ".join(f"covar_pop({name(a)}, {name(b)}) AS c{a}{b}" for a, b in pairs)
    two = lambda i, j: (
        f"(cw{i} * c{j}{j} - cw{j} * c{i}{j}) / (c{i}{i} * c{j}{j} - c{i}{j} * c{i}{j})",
        f"(cw{j} * c{i}{i} - cw{i} * c{i}{j}) / (c{i}{i} * c{j}{j} - c{i}{j} * c{i}{j})",
    )
    det = "(c11 * (c22 * c33 - c23 * c23) - c12 * (c12 * c33 - c23 * c13) + c13 * (c12 * c23 - c22 * c13))"
    three = (
        f"(cw1 * (c22 * c33 - c23 * c23) - c12 * (cw2 * c33 - c23 * cw3) + c13 * (cw2 * c23 - c22 * cw3)) / {det}",
        f"(c11 * (cw2 * c33 - cw3 * c23) - cw1 * (c12 * c33 - c23 * c13) + c13 * (c12 * cw3 - cw2 * c13)) / {det}",
        f"(c11 * (c22 * cw3 - c23 * cw2) - c12 * (c12 * cw3 - cw2 * c13) + cw1 * (c12 * c23 - c22 * c13)) / {det}",
    )
    slopes = {
        (0, 0): ("0.0", "0.0", "0.0"),
        (1, 0): ("cw1 / c11", "0.0", "0.0"),
        (0, 1): ("0.0", "0.0", "cw3 / c33"),
        (2, 0): (*two(1, 2), "0.0"),
        (1, 1): (two(1, 3)[0], "0.0", two(1, 3)[1]),
        (2, 1): three,
    }
    models = " UNION ALL ".join(
        f"SELECT *, {p} AS p, {P} AS pp, {b[0]} AS b1, {b[1]} AS b2, {b[2]} AS b3 FROM fit" for (p, P), b in slopes.items()
    )
    return FILLED_SQL + f""",
v AS ({' UNION ALL '.join(parts)}),
f AS (SELECT v.*, fold, n - (3 - fold + 1) * (n // 4) AS start, n // 4 AS size FROM v, (SELECT unnest([1, 2, 3]) AS fold)
  WHERE w IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL),
fit AS (SELECT station, d, dd, s, fold, avg(w) AS mw, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, {covariances}
  FROM f WHERE pos < start GROUP BY 1, 2, 3, 4, 5),
model AS ({models}),
e AS (SELECT f.station, p, f.d, pp, f.dd, f.s, f.fold,
    sqrt(avg((w - mw - b1 * (x1 - m1) - b2 * (x2 - m2) - b3 * (x3 - m3)) ** 2)) AS rmse
  FROM f JOIN model m ON m.station = f.station AND m.d = f.d AND m.dd = f.dd AND m.s = f.s AND m.fold = f.fold
  WHERE pos >= start AND pos < start + size GROUP BY 1, 2, 3, 4, 5, 6, 7)
 SELECT station, '(' || p || ',' || d || ')(' || pp || ',' || dd || ',' || s || ')' AS order_name, {t('avg(rmse)')} AS rmse,
   count(*) AS folds FROM e GROUP BY station, p, d, pp, dd, s"""


@query("grid_search_full", _full_grid_sql())
def grid_search_full(spark, sf_dir):
    """All 48 orders from one pass over the readings."""
    scores = forecasting.grid_search_cv(
        filled_grid(spark, sf_dir), STATION, "temp_c", forecasting.param_grid()
    )
    return scores.withColumn("rmse", tidy("rmse"))


@query("predict_in_sample", AR1_SQL + f""" SELECT x.station, {sql_stamp('hour_ts')} AS hour_ts,
 {t('a + b * x1')} AS forecast, {t('a + b * x1 - 1.96 * sigma')} AS lower_bound, {t('a + b * x1 + 1.96 * sigma')} AS upper_bound
 FROM x JOIN fit USING (station) WHERE x1 IS NOT NULL AND temp_c IS NOT NULL""")
def predict_in_sample(spark, sf_dir):
    hours = filled_grid(spark, sf_dir)
    fitted = forecasting.fit_seasonal_ar(hours, STATION, "temp_c", AR1)
    rows = forecasting.predict_in_sample(hours, STATION, "temp_c", fitted, AR1)
    return rows.select("station", stamp("hour_ts").alias("hour_ts"), *_bounds())


STEPS = 48


@query("forecast_horizon_ar", AR1_SQL + f""",
last AS (SELECT station, hour_ts AS end_ts, temp_c AS y FROM filled WHERE pos = n - 1 AND temp_c IS NOT NULL),
h AS (SELECT station, end_ts + INTERVAL 1 HOUR * i AS hour_ts, a * (1 - b ** i) / (1 - b) + b ** i * y AS forecast,
   1.96 * sigma * sqrt((1 - b ** (2 * i)) / (1 - b * b)) AS half
  FROM last JOIN fit USING (station), (SELECT unnest(generate_series(1, {STEPS})) AS i))
 SELECT station, {sql_stamp('hour_ts')} AS hour_ts, {t('forecast')} AS forecast, {t('forecast - half')} AS lower_bound,
   {t('forecast + half')} AS upper_bound, 'ok' AS status FROM h
 UNION ALL SELECT station, NULL, NULL, NULL, NULL, 'gap at the end' FROM filled WHERE pos = n - 1 AND temp_c IS NULL""")
def forecast_horizon_ar(spark, sf_dir):
    hours = filled_grid(spark, sf_dir)
    fitted = forecasting.fit_seasonal_ar(hours, STATION, "temp_c", AR1)
    future = forecasting.forecast_horizon(hours, STATION, "temp_c", fitted, AR1, STEPS)
    return future.select("station", stamp("hour_ts").alias("hour_ts"), *_bounds(), "status")


DAYS_SQL = (
    CLEARED_SQL
    + """,
dmean AS (SELECT station, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS h, avg(temp_c) AS temp_c FROM cleared GROUP BY 1, 2),
dspan AS (SELECT station, min(h) AS a, max(h) AS b FROM dmean GROUP BY 1),
dday AS (SELECT station, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS hour_ts FROM dspan),
days AS (SELECT dday.station, hour_ts, temp_c, row_number() OVER (PARTITION BY dday.station ORDER BY hour_ts) - 1 AS pos,
    count(*) OVER (PARTITION BY dday.station) AS n
  FROM dday LEFT JOIN dmean ON dday.station = dmean.station AND dday.hour_ts = dmean.h)"""
    + interpolate_sql("days", "filled", 3)
)


def _daily(spark, sf_dir):
    """Daily means of a station, short gaps filled."""
    days = resample_mean(cleared(spark, sf_dir), STATION, ["temp_c"], DAILY)
    return materialise(interpolate_linear(days, STATION, ["temp_c"], 3), "days")


@query("resample_daily_mean", DAYS_SQL + f" SELECT station, {sql_stamp('hour_ts')} AS obs_date, pos, n, {t('temp_c')} AS temp_c FROM days")
def resample_daily_mean(spark, sf_dir):
    days = resample_mean(cleared(spark, sf_dir), STATION, ["temp_c"], DAILY)
    return days.select(
        "station", stamp("hour_ts").alias("obs_date"), F.col(POS).alias("pos"), F.col(SIZE).alias("n"),
        tidy("temp_c").alias("temp_c"),
    )


@query("resample_six_hours", CLEARED_SQL + f""" ,
six AS (SELECT station, time_bucket(INTERVAL 6 HOUR, ts) AS h, avg(temp_c) AS temp_c FROM cleared GROUP BY 1, 2),
sspan AS (SELECT station, min(h) AS a, max(h) AS b FROM six GROUP BY 1),
step AS (SELECT station, unnest(generate_series(a, b, INTERVAL 6 HOUR)) AS hour_ts FROM sspan)
 SELECT step.station, {sql_stamp('hour_ts')} AS period_start, {t('temp_c')} AS temp_c
 FROM step LEFT JOIN six ON six.station = step.station AND six.h = step.hour_ts""")
def resample_six_hours(spark, sf_dir):
    six = resample_mean(cleared(spark, sf_dir), STATION, ["temp_c"], Frequency("hour", 6))
    return six.select("station", stamp("hour_ts").alias("period_start"), tidy("temp_c").alias("temp_c"))


@query("forecast_horizon_days", DAYS_SQL + f""",
x AS (SELECT *, lag(temp_c) OVER (PARTITION BY station ORDER BY pos) AS x1 FROM filled),
fit AS (SELECT station, regr_slope(temp_c, x1) AS b, regr_intercept(temp_c, x1) AS a,
   sqrt((regr_syy(temp_c, x1) - regr_slope(temp_c, x1) * regr_sxy(temp_c, x1)) / (count(*) - 2)) AS sigma
  FROM x WHERE x1 IS NOT NULL AND temp_c IS NOT NULL GROUP BY 1),
last AS (SELECT station, hour_ts AS end_ts, temp_c AS y FROM filled WHERE pos = n - 1 AND temp_c IS NOT NULL),
h AS (SELECT station, end_ts + INTERVAL 1 DAY * i AS hour_ts, a * (1 - b ** i) / (1 - b) + b ** i * y AS forecast,
   1.96 * sigma * sqrt((1 - b ** (2 * i)) / (1 - b * b)) AS half
  FROM last JOIN fit USING (station), (SELECT unnest(generate_series(1, 90)) AS i))
 SELECT station, {sql_stamp('hour_ts')} AS obs_date, {t('forecast')} AS forecast, {t('forecast - half')} AS lower_bound,
   {t('forecast + half')} AS upper_bound, 'ok' AS status FROM h
 UNION ALL SELECT station, NULL, NULL, NULL, NULL, 'gap at the end' FROM filled WHERE pos = n - 1 AND temp_c IS NULL""")
def forecast_horizon_days(spark, sf_dir):
    """Ninety days on a daily grid, models fitted on it."""
    days = _daily(spark, sf_dir)
    fitted = forecasting.fit_seasonal_ar(days, STATION, "temp_c", AR1)
    future = forecasting.forecast_horizon(days, STATION, "temp_c", fitted, AR1, 90, unit="days")
    return future.select("station", stamp("hour_ts").alias("obs_date"), *_bounds(), "status")


@query("forecast_horizon_naive", FILLED_SQL + f""",
last AS (SELECT station, pos - n + 24 AS ph, temp_c FROM filled WHERE pos >= n - 24),
f AS (SELECT station, max(hour_ts) AS e FROM filled GROUP BY 1),
s AS (SELECT station, e + INTERVAL 1 HOUR * i AS hour_ts, i, (i - 1) % 24 AS ph FROM f, (SELECT unnest(generate_series(1, 72)) AS i))
 SELECT s.station, {sql_stamp('s.hour_ts')} AS hour_ts, i AS step, {t('temp_c')} AS forecast
 FROM s LEFT JOIN last ON last.station = s.station AND last.ph = s.ph""")
def forecast_horizon_naive(spark, sf_dir):
    future = forecasting.seasonal_naive_horizon(filled_grid(spark, sf_dir), STATION, "temp_c", 72)
    return future.select(
        "station", stamp("hour_ts").alias("hour_ts"), big("step").alias("step"),
        tidy("forecast").alias("forecast"),
    )


@query("mc_interval", CLEARED_SQL + f""" SELECT station, {sql_stamp("date_trunc('hour', ts)")} AS hour_ts, {t('avg(temp_c)')} AS forecast,
 {t('avg(temp_c) - 1.96 * stddev_pop(temp_c)')} AS lower_bound, {t('avg(temp_c) + 1.96 * stddev_pop(temp_c)')} AS upper_bound
 FROM cleared GROUP BY 1, 2""")
def mc_interval(spark, sf_dir):
    """The readings of an hour stand for the samples of a step."""
    samples = cleared(spark, sf_dir).withColumn("hour_ts", stamp(F.date_trunc("hour", "ts")))
    return forecasting.mc_interval(samples, ["station", "hour_ts"], "temp_c").select(
        "station", "hour_ts", *_bounds()
    )


@query("quantile_interval", FORECASTS_SQL + f""",
q AS (SELECT station, model, quantile_cont(temp_c - forecast, 0.1) AS lo, quantile_cont(temp_c - forecast, 0.9) AS hi FROM fc GROUP BY 1, 2)
 SELECT fc.station, fc.model, {sql_stamp('hour_ts')} AS hour_ts, {t('forecast')} AS forecast,
  {t('forecast + lo')} AS lower_bound, {t('forecast + hi')} AS upper_bound
 FROM fc JOIN q ON q.station = fc.station AND q.model = fc.model""")
def quantile_interval(spark, sf_dir):
    rows = forecasting.quantile_interval(
        forecasts(spark, sf_dir), ["station", "model"], "temp_c", 0.1, 0.9
    )
    return rows.select("station", "model", stamp("hour_ts").alias("hour_ts"), *_bounds())


@query("run_models", FORECASTS_SQL + f""" SELECT station, model, {sql_stamp('hour_ts')} AS hour_ts, {_bounds_sql()} FROM fc""")
def run_models(spark, sf_dir):
    rows = forecasts(spark, sf_dir)
    return rows.select("station", "model", stamp("hour_ts").alias("hour_ts"), *_bounds())


def complete_persistence(hours, keys, column):
    """Persistence that accepts no gap: a NULL in the series fails the task that meets it."""
    gap = F.raise_error(F.lit("a gap is left")).cast("double")
    whole = hours.withColumn(column, F.when(F.col(column).isNull(), gap).otherwise(F.col(column)))
    return forecasting.persistence(whole, keys, column)


@query("run_models_status", FORECASTS_SQL + """,
gap AS (SELECT count(*) FILTER (temp_c IS NULL) > 0 AS there FROM filled)
 SELECT model, true AS ok, NULL::VARCHAR AS reason, count(*) AS "rows" FROM fc GROUP BY model
 UNION ALL SELECT 'complete_persistence', NOT there, CASE WHEN there THEN 'a gap is left' END,
  CASE WHEN there THEN 0 ELSE (SELECT count(*) FROM fc WHERE model = 'persistence') END FROM gap""")
def run_models_status(spark, sf_dir):
    """Each model run by itself; one fails in its tasks where the filled grid keeps gaps."""
    models = {**forecasting.MODELS, "complete_persistence": complete_persistence}
    rows, status = forecasting.run_each(filled_grid(spark, sf_dir), STATION, "temp_c", models)
    found = rows.groupBy("model").agg(F.count(F.lit(1)).alias("rows"))
    known = F.when(F.col("reason").contains("a gap is left"), "a gap is left").otherwise(F.col("reason"))
    return status.join(found, "model", "left").select(
        "model", "ok", known.alias("reason"), F.coalesce("rows", F.lit(0).cast("long")).alias("rows")
    )


# --- alignment and metrics ---


@query("align_actual_forecast", FORECASTS_SQL + f""" SELECT fc.station, fc.model, {sql_stamp('fc.hour_ts')} AS hour_ts,
 {t('grid.temp_c')} AS actual, {t('fc.forecast')} AS forecast
 FROM fc JOIN grid ON grid.station = fc.station AND grid.hour_ts = fc.hour_ts""")
def align_actual_forecast(spark, sf_dir):
    """Forecasts against the observed (unfilled) hourly means."""
    actual = grid(spark, sf_dir).select("station", "hour_ts", F.col("temp_c").alias("actual"))
    predicted = forecasts(spark, sf_dir).select("station", "hour_ts", "model", "forecast")
    rows = evaluation.align_actual_forecast(actual, predicted, ["station", "hour_ts"])
    return rows.select(
        "station", "model", stamp("hour_ts").alias("hour_ts"), tidy("actual").alias("actual"),
        tidy("forecast").alias("forecast"),
    )


@query("align_models", FORECASTS_SQL + f""" SELECT station, {sql_stamp('hour_ts')} AS hour_ts,
 {', '.join(f"{t(f'''max(CASE WHEN model = '{m}' THEN forecast END)''')} AS {m}" for m in MODEL_NAMES)}
 FROM fc GROUP BY station, hour_ts""")
def align_models(spark, sf_dir):
    wide = evaluation.align_models(forecasts(spark, sf_dir), ["station", "hour_ts"], MODEL_NAMES)
    return wide.select(
        "station", stamp("hour_ts").alias("hour_ts"), *[tidy(m).alias(m) for m in MODEL_NAMES]
    )


METRIC_SQL = {
    "rmse": "sqrt(avg((temp_c - forecast) ** 2))",
    "mae": "avg(abs(temp_c - forecast))",
    "r2": "1 - sum((temp_c - forecast) ** 2) / (var_pop(temp_c) * count(*))",
    "mape": "avg(abs(temp_c - forecast) / greatest(abs(temp_c), 2.220446049250313e-16)) * 100",
    "coverage": "avg(CASE WHEN temp_c BETWEEN lower_bound AND upper_bound THEN 1.0 ELSE 0.0 END) * 100",
    "mean_width": "avg(upper_bound - lower_bound)",
}
POINT = ["rmse", "mae", "r2", "mape"]
METRICS_SQL = FORECASTS_SQL + """,
met AS (SELECT model, """ + ", ".join(f"{e} AS {n}" for n, e in METRIC_SQL.items()) + """
  FROM fc WHERE temp_c IS NOT NULL GROUP BY model)"""


@query("forecast_metrics", FORECASTS_SQL + " SELECT station, model, " + ", ".join(
    f"{t(METRIC_SQL[n])} AS {n}" for n in POINT) + " FROM fc WHERE temp_c IS NOT NULL GROUP BY 1, 2")
def forecast_metrics(spark, sf_dir):
    rows = evaluation.forecast_metrics(forecasts(spark, sf_dir), ["station", "model"], "temp_c")
    return rows.select("station", "model", *[tidy(n).alias(n) for n in POINT])


SCORE_SQL = """avg((upper_bound - lower_bound) + 2 / 0.05 * greatest(lower_bound - temp_c, 0)
  + 2 / 0.05 * greatest(temp_c - upper_bound, 0))"""


@query("interval_metrics", FORECASTS_SQL + f""" SELECT station, model, {t(METRIC_SQL['coverage'])} AS coverage,
 {t(METRIC_SQL['mean_width'])} AS mean_width FROM fc WHERE temp_c IS NOT NULL GROUP BY 1, 2""")
def interval_metrics(spark, sf_dir):
    rows = evaluation.interval_metrics(forecasts(spark, sf_dir), ["station", "model"], "temp_c")
    return rows.select("station", "model", *[tidy(n).alias(n) for n in ("coverage", "mean_width")])


@query("interval_score", FORECASTS_SQL + f""" SELECT model, {t(METRIC_SQL['coverage'])} AS coverage,
 {t(SCORE_SQL)} AS interval_score FROM fc WHERE temp_c IS NOT NULL GROUP BY 1""")
def interval_score(spark, sf_dir):
    rows = evaluation.interval_metrics(forecasts(spark, sf_dir), ["model"], "temp_c")
    return rows.select("model", *[tidy(n).alias(n) for n in ("coverage", "interval_score")])


def _metric_rows(pick):
    return " UNION ALL ".join(
        f"SELECT '{n}' AS metric, " + ", ".join(
            pick(f"(SELECT {n} FROM met WHERE model = '{m}')") + f" AS {m}" for m in MODEL_NAMES
        )
        for n in evaluation.REPORTED
    )


@query("compare_models", METRICS_SQL + " " + _metric_rows(lambda e: f"round({e}, 4)"))
def compare_models(spark, sf_dir):
    return evaluation.compare_models(forecasts(spark, sf_dir), "temp_c", MODEL_NAMES)


@query("metrics_transpose", METRICS_SQL + " " + _metric_rows(t))
def metrics_transpose(spark, sf_dir):
    metrics = evaluation.evaluate_models(forecasts(spark, sf_dir), "temp_c")
    flipped = evaluation.metrics_transpose(metrics, MODEL_NAMES)
    return flipped.withColumns({m: tidy(m) for m in MODEL_NAMES})


@query("best_model", METRICS_SQL + f" SELECT model, {t('rmse')} AS rmse FROM met ORDER BY met.rmse, model LIMIT 1")
def best_model(spark, sf_dir):
    metrics = evaluation.evaluate_models(forecasts(spark, sf_dir), "temp_c")
    return evaluation.best_model(metrics).withColumn("rmse", tidy("rmse"))


@query("threshold_check", METRICS_SQL + """ SELECT model, rmse <= 2.0 AS rmse_ok, mae <= 1.5 AS mae_ok, mape <= 10.0 AS mape_ok,
 r2 >= 0.8 AS r2_ok, rmse <= 2.0 AND mae <= 1.5 AND mape <= 10.0 AND r2 >= 0.8 AS all_ok FROM met""")
def threshold_check(spark, sf_dir):
    metrics = evaluation.evaluate_models(forecasts(spark, sf_dir), "temp_c")
    return evaluation.threshold_check(metrics)


@query("residual_analysis", FORECASTS_SQL + f""" SELECT station, model, {t('avg(temp_c - forecast)')} AS mean,
 {t('stddev_pop(temp_c - forecast)')} AS std, {t('skewness(temp_c - forecast)')} AS skewness,
 {t('kurtosis(temp_c - forecast)')} AS kurtosis FROM fc WHERE temp_c IS NOT NULL GROUP BY 1, 2""")
def residual_analysis(spark, sf_dir):
    rows = evaluation.residual_analysis(forecasts(spark, sf_dir), ["station", "model"], "temp_c")
    return rows.select(
        "station", "model", *[tidy(c).alias(c) for c in ("mean", "std", "skewness", "kurtosis")]
    )


LAGS = range(1, 11)


@query("residual_diagnostics", FORECASTS_SQL + f""",
e AS (SELECT station, model, pos, temp_c - forecast AS e, count(*) OVER (PARTITION BY station, model) AS n,
   temp_c - forecast - avg(temp_c - forecast) OVER (PARTITION BY station, model) AS c FROM fc WHERE temp_c IS NOT NULL),
l AS (SELECT *, {', '.join(f"lag(c, {k}) OVER (PARTITION BY station, model ORDER BY pos) AS c{k}" for k in LAGS)} FROM e),
s AS (SELECT station, model, any_value(n) AS n, avg(e) AS mean, stddev_pop(e) AS std, avg(c * c * c) / avg(c * c) ** 1.5 AS g1,
   avg(c * c * c * c) / (avg(c * c) * avg(c * c)) - 3 AS g2, {', '.join(f"sum(c * c{k}) / sum(c * c) AS r{k}" for k in LAGS)} FROM l GROUP BY 1, 2)
 SELECT station, model, {t('mean')} AS mean, {t('std')} AS std, {t('exp(-(n / 6 * (g1 * g1 + g2 * g2 / 4)) / 2)')} AS jarque_bera_p,
   {t('n * (n + 2) * (' + ' + '.join(f'r{k} * r{k} / (n - {k})' for k in LAGS) + ')')} AS ljung_box FROM s""")
def residual_diagnostics(spark, sf_dir):
    rows = evaluation.residual_diagnostics(
        forecasts(spark, sf_dir), ["station", "model"], "temp_c", ["hour_ts"]
    )
    return rows.select(
        "station", "model", *[tidy(c).alias(c) for c in ("mean", "std", "jarque_bera_p", "ljung_box")]
    )


WEIGHTS_SQL = METRICS_SQL + """,
wt AS (SELECT model, (1 / rmse) / (SELECT sum(1 / rmse) FROM met) AS weight FROM met)"""


@query("ensemble_weights", WEIGHTS_SQL + f" SELECT model, {t('weight')} AS weight FROM wt")
def ensemble_weights(spark, sf_dir):
    metrics = evaluation.evaluate_models(forecasts(spark, sf_dir), "temp_c")
    return evaluation.ensemble_weights(metrics).withColumn("weight", tidy("weight"))


@query("ensemble_forecast", WEIGHTS_SQL + f""" SELECT station, {sql_stamp('hour_ts')} AS hour_ts,
 {t('sum(weight * forecast) / sum(weight)')} AS forecast, {t('quantile_cont(lower_bound, 0.025)')} AS lower_bound,
 {t('quantile_cont(upper_bound, 0.975)')} AS upper_bound FROM fc JOIN wt USING (model) GROUP BY station, hour_ts""")
def ensemble_forecast(spark, sf_dir):
    rows = forecasts(spark, sf_dir)
    weights = evaluation.ensemble_weights(evaluation.evaluate_models(rows, "temp_c"))
    combined = evaluation.ensemble_forecast(rows, weights, ["station", "hour_ts"])
    return combined.select("station", stamp("hour_ts").alias("hour_ts"), *_bounds())


@query("model_agreement", FORECASTS_SQL + f""" SELECT station, {sql_stamp('hour_ts')} AS hour_ts,
 {t('stddev_samp(forecast)')} AS std, {t('avg(forecast)')} AS mean FROM fc GROUP BY station, hour_ts""")
def model_agreement(spark, sf_dir):
    rows = evaluation.model_agreement(forecasts(spark, sf_dir), ["station", "hour_ts"])
    return rows.select(
        "station", stamp("hour_ts").alias("hour_ts"), tidy("std").alias("std"), tidy("mean").alias("mean")
    )


@query("model_differences", FORECASTS_SQL + f""",
p AS (SELECT a.model AS model_a, b.model AS model_b, avg(abs(a.forecast - b.forecast)) AS difference
  FROM fc a JOIN fc b ON a.station = b.station AND a.hour_ts = b.hour_ts GROUP BY 1, 2)
 SELECT model_a, model_b, {t('difference')} AS difference FROM p""")
def model_differences(spark, sf_dir):
    rows = evaluation.model_differences(
        forecasts(spark, sf_dir), ["station", "hour_ts"], MODEL_NAMES
    )
    return rows.withColumn("difference", tidy("difference"))


@query("interval_width_series", FORECASTS_SQL + f""" SELECT station, model, {sql_stamp('hour_ts')} AS hour_ts,
 {t('upper_bound - lower_bound')} AS width FROM fc""")
def interval_width_series(spark, sf_dir):
    rows = evaluation.interval_width_series(forecasts(spark, sf_dir), ["station", "hour_ts"])
    return rows.select("station", "model", stamp("hour_ts").alias("hour_ts"), tidy("width").alias("width"))


@query("forecast_after", FORECASTS_SQL + f""" SELECT station, model, {sql_stamp('hour_ts')} AS hour_ts, {t('forecast')} AS value,
 'forecast' AS kind FROM fc WHERE hour_ts >= TIMESTAMP '2024-01-20 00:00:00'
 UNION ALL SELECT station, 'history', {sql_stamp('hour_ts')}, {t('temp_c')}, 'history' FROM filled
 WHERE hour_ts < TIMESTAMP '2024-01-20 00:00:00'""")
def forecast_after(spark, sf_dir):
    """What a forecast plot shows: history before the start, predictions from it on."""
    start = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    future = evaluation.forecast_after(forecasts(spark, sf_dir), "hour_ts", start).select(
        "station", "model", stamp("hour_ts").alias("hour_ts"), tidy("forecast").alias("value"),
        F.lit("forecast").alias("kind"),
    )
    history = evaluation.history_before(filled_grid(spark, sf_dir), "hour_ts", start).select(
        "station", F.lit("history").alias("model"), stamp("hour_ts").alias("hour_ts"),
        tidy("temp_c").alias("value"), F.lit("history").alias("kind"),
    )
    return future.unionByName(history)


QQ_T = "sqrt(-2 * ln(least(p, 1 - p)))"
QQ_Z = """(tt - (2.515517 + tt * (0.802853 + tt * 0.010328))
   / (1.0 + tt * (1.432788 + tt * (0.189269 + tt * 0.001308))))"""


@query("qq_points", CLEARED_SQL + f""",
e AS (SELECT station, reading_id, precip_mm - humidity AS residual FROM cleared),
r AS (SELECT *, row_number() OVER w AS rank, (row_number() OVER w - 0.5::DOUBLE) / count(*) OVER (PARTITION BY station) AS p FROM e
  WINDOW w AS (PARTITION BY station ORDER BY residual, reading_id)),
q AS (SELECT *, {QQ_T} AS tt FROM r)
 SELECT station, reading_id, rank, {t('residual')} AS residual, {t(f'CASE WHEN p < 0.5 THEN -{QQ_Z} ELSE {QQ_Z} END')} AS theoretical FROM q""")
def qq_points(spark, sf_dir):
    rows = cleared(spark, sf_dir).withColumnRenamed("humidity", "forecast")
    points = evaluation.qq_points(rows, STATION, "precip_mm", ["reading_id"])
    return points.select(
        "station", "reading_id", "rank", tidy("residual").alias("residual"),
        tidy("theoretical").alias("theoretical"),
    )


IMPORTANCE = ["humidity", "precip_mm", "hour", "day"]


@query("rank_importance", CLEARED_SQL + f""",
x AS (SELECT station, temp_c, humidity, precip_mm, CAST(hour(ts) AS DOUBLE) AS "hour", CAST(day(ts) AS DOUBLE) AS "day" FROM cleared),
i AS ({' UNION ALL '.join(f'''SELECT station, '{f}' AS feature, coalesce(CASE WHEN NOT isnan(corr("{f}", temp_c)) THEN abs(corr("{f}", temp_c)) END, 0) AS importance FROM x GROUP BY 1''' for f in IMPORTANCE)})
 SELECT station, feature, {t('importance')} AS importance,
   row_number() OVER (PARTITION BY station ORDER BY round(importance, 9) DESC, feature) AS rank FROM i""")
def rank_importance(spark, sf_dir):
    rows = cleared(spark, sf_dir).withColumns(
        {"hour": F.hour("ts").cast("double"), "day": F.dayofmonth("ts").cast("double")}
    )
    ranked = evaluation.rank_importance(rows, STATION, IMPORTANCE, "temp_c")
    return ranked.select(
        "station", "feature", tidy("importance").alias("importance"), big("rank").alias("rank")
    )
