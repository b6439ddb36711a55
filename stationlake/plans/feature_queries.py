"""Features, windows, scaling and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from stationlake.operators import cleaning, features
from stationlake.operators.aggregates import resample_hourly_mean
from stationlake.operators.splits import split_chronological
from stationlake.plans.registry import big, query, sql_stamp, stamp, t, tidy
from stationlake.plans.standins import (
    CLEARED_SQL,
    FILLED_SQL,
    FRAME,
    GRID_SQL,
    LAID_SQL,
    STATION,
    cleared,
    filled_grid,
    grid,
    laid,
    table,
)

PARTS = ["year", "month", "day", "hour", "day_of_week", "week_of_year", "day_of_year", "is_weekend"]
PARTS_SQL = """year(ts) AS "year", month(ts) AS "month", day(ts) AS "day", hour(ts) AS "hour",
 isodow(ts) - 1 AS day_of_week, weekofyear(ts) AS week_of_year, dayofyear(ts) AS day_of_year,
 CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend"""


@query("calendar_features", f"""SELECT event_id, {', '.join(f'CAST("{p}" AS BIGINT) AS "{p}"' for p in PARTS)}
 FROM (SELECT event_id, {PARTS_SQL} FROM events)""")
def calendar_features(spark, sf_dir):
    rows = features.calendar_features(table(spark, sf_dir, "events"))
    return rows.select("event_id", *[big(p).alias(p) for p in PARTS])


@query("calendar_of_orders", f"""SELECT "year", "week_of_year", is_weekend, count(*) AS n_rows FROM (SELECT
 CAST(year(o_orderdate) AS BIGINT) AS "year", CAST(weekofyear(o_orderdate) AS BIGINT) AS week_of_year,
 CAST(CASE WHEN isodow(o_orderdate) >= 6 THEN 1 ELSE 0 END AS BIGINT) AS is_weekend FROM orders) GROUP BY ALL""")
def calendar_of_orders(spark, sf_dir):
    rows = features.calendar_features(table(spark, sf_dir, "orders"), "o_orderdate")
    return rows.groupBy(*[big(c).alias(c) for c in ("year", "week_of_year", "is_weekend")]).agg(
        F.count(F.lit(1)).alias("n_rows")
    )


@query("cyclic_month", f"""SELECT o_orderkey, {t('sin(2 * pi() * month(o_orderdate) / 12)')} AS month_sin,
 {t('cos(2 * pi() * month(o_orderdate) / 12)')} AS month_cos FROM orders""")
def cyclic_month(spark, sf_dir):
    rows = features.calendar_features(table(spark, sf_dir, "orders"), "o_orderdate")
    return features.cyclic_encode(rows, {"month": 12}).select(
        "o_orderkey", tidy("month_sin").alias("month_sin"), tidy("month_cos").alias("month_cos")
    )


CYCLES = {"hour": ("hour(ts)", 24), "day": ("day(ts)", 31), "month": ("month(ts)", 12),
          "day_of_week": ("(isodow(ts) - 1)", 7)}


@query("cyclic_calendar", "SELECT event_id, " + ", ".join(
    f"{t(f'{fn}(2 * pi() * {e} / {p})')} AS {c}_{fn}" for c, (e, p) in CYCLES.items() for fn in ("sin", "cos"))
    + " FROM events")
def cyclic_calendar(spark, sf_dir):
    rows = features.calendar_features(table(spark, sf_dir, "events"))
    encoded = features.cyclic_encode(rows, features.CALENDAR_PERIODS)
    names = [f"{c}_{fn}" for c in features.CALENDAR_PERIODS for fn in ("sin", "cos")]
    return encoded.select("event_id", *[tidy(c).alias(c) for c in names])


@query("rolling_centered", LAID_SQL + f""" SELECT reading_id, {t('avg(temp_c) OVER w')} AS temp_c_mean_24,
 {t('stddev_samp(temp_c) OVER w')} AS temp_c_std_24 FROM laid WINDOW w AS ({FRAME} 12 PRECEDING AND 11 FOLLOWING)""")
def rolling_centered(spark, sf_dir):
    rows = features.rolling_centered(laid(spark, sf_dir), STATION, "temp_c", 24)
    return rows.select("reading_id", *[tidy(c).alias(c) for c in ("temp_c_mean_24", "temp_c_std_24")])


@query("weather_flags", CLEARED_SQL + """,
h AS (SELECT * REPLACE (CASE WHEN humidity BETWEEN 60 AND 69 THEN NULL ELSE humidity END AS humidity) FROM cleared),
m AS (SELECT *, coalesce(humidity, avg(humidity) OVER (PARTITION BY station)) AS hum FROM h)
 SELECT reading_id, CAST(coalesce(precip_mm, 0) > 0 AS BIGINT) AS is_raining, CAST(hum > 70 AS BIGINT) AS is_humid FROM m""")
def weather_flags(spark, sf_dir):
    dry = cleared(spark, sf_dir).withColumn(
        "humidity", F.when(~F.col("humidity").between(60, 69), F.col("humidity"))
    )
    flagged = features.weather_flags(dry, STATION)
    return flagged.select("reading_id", *[big(c).alias(c) for c in ("is_raining", "is_humid")])


@query("time_index", CLEARED_SQL + f""" SELECT reading_id,
 {t("date_diff('microsecond', min(ts) OVER (PARTITION BY station), ts) / 1e6 / 3600")} AS time_index FROM cleared""")
def time_index(spark, sf_dir):
    return features.time_index(cleared(spark, sf_dir), STATION).select(
        "reading_id", tidy("time_index").alias("time_index")
    )


def _decompose_sql(period):
    h = period // 2
    return FILLED_SQL + f""",
tr AS (SELECT *, pos % {period} AS ph, CASE WHEN pos >= {h} AND pos + {h} < n THEN
   (sum(temp_c) OVER ({FRAME} {h - 1} PRECEDING AND {h - 1} FOLLOWING)
    + 0.5 * (lag(temp_c, {h}) OVER (PARTITION BY station ORDER BY pos) + lead(temp_c, {h}) OVER (PARTITION BY station ORDER BY pos))) / {period} END AS trend FROM filled),
eff AS (SELECT station, ph, avg(temp_c - trend) AS e FROM tr GROUP BY 1, 2),
sea AS (SELECT station, ph, e - avg(e) OVER (PARTITION BY station) AS seasonal FROM eff)
 SELECT tr.station, {sql_stamp('hour_ts')} AS hour_ts, {t('trend')} AS trend, {t('seasonal')} AS seasonal,
   {t('temp_c - trend - seasonal')} AS residual
 FROM tr LEFT JOIN sea ON sea.station = tr.station AND sea.ph = tr.ph"""


def _decomposed(spark, sf_dir, period):
    parts = features.seasonal_decompose(filled_grid(spark, sf_dir), STATION, "temp_c", period)
    return parts.select(
        "station", stamp("hour_ts").alias("hour_ts"),
        *[tidy(c).alias(c) for c in ("trend", "seasonal", "residual")],
    )


@query("seasonal_decompose_weekly", _decompose_sql(168))
def seasonal_decompose_weekly(spark, sf_dir):
    return _decomposed(spark, sf_dir, 168)


@query("seasonal_decompose_daily", _decompose_sql(24))
def seasonal_decompose_daily(spark, sf_dir):
    return _decomposed(spark, sf_dir, 24)


TRAIN_SQL = LAID_SQL + """,
tr AS (SELECT min(temp_c) AS lo, max(temp_c) AS hi, min(humidity) AS hlo, max(humidity) AS hhi
  FROM laid WHERE pos < floor(n * 0.7::DOUBLE))"""


@query("minmax_scale", TRAIN_SQL + f""" SELECT reading_id, {t('(temp_c - lo) / (hi - lo)')} AS temp_c,
 {t('(humidity - hlo) / (hhi - hlo)')} AS humidity FROM laid, tr""")
def minmax_scale(spark, sf_dir):
    rows = split_chronological(laid(spark, sf_dir, "temp_c", "humidity"))
    columns = ["temp_c", "humidity"]
    bounds = features.scale_bounds(rows.filter("split = 'train'"), columns)
    scaled = features.minmax_scale(rows, bounds, columns)
    return scaled.select("reading_id", *[tidy(c).alias(c) for c in columns])


@query("minmax_inverse", CLEARED_SQL + f" SELECT reading_id, {t('temp_c')} AS temp_c FROM cleared")
def minmax_inverse(spark, sf_dir):
    rows = cleared(spark, sf_dir).select("reading_id", "temp_c")
    bounds = features.scale_bounds(rows, ["temp_c"])
    scaled = features.minmax_scale(rows, bounds, ["temp_c"])
    back = features.minmax_inverse(scaled, bounds, ["temp_c"])
    return back.select("reading_id", tidy("temp_c").alias("temp_c"))


def _thousandths(values):
    """Every element of an array as text, so that all of them are compared."""

    def shown(v):
        whole = F.round(v.cast("double") * 1000).cast("long").cast("string")
        return F.when(F.isnan(v), "-").otherwise(whole)

    return F.array_join(F.transform(values, shown), ",")


def _thousandths_sql(values):
    whole = "CAST(CAST(round(CAST(CAST(v AS FLOAT) AS DOUBLE) * 1000) AS BIGINT) AS VARCHAR)"
    return f"array_to_string(list_transform({values}, lambda v: coalesce({whole}, '-')), ',')"


@query("sliding_sequences", FILLED_SQL + f""",
s AS (SELECT station, pos, list(temp_c) OVER w AS l FROM filled WINDOW w AS ({FRAME} 24 PRECEDING AND CURRENT ROW))
 SELECT station, pos - 24 AS start_pos, CAST(24 AS BIGINT) AS x_length, {_thousandths_sql('l[1:24]')} AS x,
   {t('CAST(l[25] AS FLOAT)')} AS y
 FROM s WHERE len(l) = 25""")
def sliding_sequences(spark, sf_dir):
    windows = features.sliding_sequences(
        filled_grid(spark, sf_dir), STATION, ["temp_c"], "temp_c", length=25
    )
    return windows.select(
        "station", "start_pos", big(F.size("x")).alias("x_length"),
        _thousandths(F.transform("x", lambda r: r[0])).alias("x"), tidy("y").alias("y"),
    )


@query("sliding_sequences_strided", FILLED_SQL + f""",
s AS (SELECT station, pos, list(temp_c) OVER w AS l, list(hour(hour_ts)) OVER w AS h
 FROM filled WINDOW w AS ({FRAME} 168 PRECEDING AND CURRENT ROW))
 SELECT station, pos - 168 AS start_pos, {_thousandths_sql('l[1:168]')} AS x, {_thousandths_sql('h[1:168]')} AS hours,
   {t('CAST(l[169] AS FLOAT)')} AS y
 FROM s WHERE len(l) = 169 AND (pos - 168) % 24 = 0""")
def sliding_sequences_strided(spark, sf_dir):
    """A week of two inputs, one window a day."""
    rows = filled_grid(spark, sf_dir).withColumn("hour", F.hour("hour_ts"))
    windows = features.sliding_sequences(rows, STATION, ["temp_c", "hour"], "temp_c", 169, stride=24)
    return windows.select(
        "station", "start_pos", _thousandths(F.transform("x", lambda r: r[0])).alias("x"),
        _thousandths(F.transform("x", lambda r: r[1])).alias("hours"), tidy("y").alias("y"),
    )


@query("encoder_decoder_windows", FILLED_SQL + f""",
w AS (SELECT station, pos, list(temp_c) OVER p AS enc, list(temp_c) OVER f AS dec,
   list(hour(hour_ts)) OVER f AS hours, list(isodow(hour_ts) - 1) OVER f AS days
 FROM filled WINDOW p AS ({FRAME} 48 PRECEDING AND 1 PRECEDING), f AS ({FRAME} CURRENT ROW AND 11 FOLLOWING))
 SELECT station, pos AS start_pos, CAST(len(enc) AS BIGINT) AS encoder_length, CAST(len(dec) AS BIGINT) AS decoder_length,
   {_thousandths_sql('enc')} AS encoder, {_thousandths_sql('dec')} AS decoder_target,
   {_thousandths_sql('hours')} AS known_hour, {_thousandths_sql('days')} AS known_day
 FROM w WHERE len(enc) >= 24 AND len(dec) >= 1 AND pos % 6 = 0""")
def encoder_decoder_windows(spark, sf_dir):
    """One window per six start hours: the stride is the parameter of the operator."""
    rows = features.calendar_features(filled_grid(spark, sf_dir), "hour_ts")
    windows = features.encoder_decoder_windows(
        rows, STATION, "temp_c", ["hour", "day_of_week"], 24, 48, 12, stride=6
    )
    return windows.select(
        "station", "start_pos", big(F.size("encoder")).alias("encoder_length"),
        big(F.size("decoder_target")).alias("decoder_length"),
        _thousandths("encoder").alias("encoder"), _thousandths("decoder_target").alias("decoder_target"),
        _thousandths(F.transform("decoder_known", lambda r: r[0])).alias("known_hour"),
        _thousandths(F.transform("decoder_known", lambda r: r[1])).alias("known_day"),
    )


@query("group_scale", CLEARED_SQL + f""" SELECT reading_id,
 {t('(temp_c - avg(temp_c) OVER w) / stddev_samp(temp_c) OVER w')} AS temp_c_scaled
 FROM cleared WINDOW w AS (PARTITION BY station)""")
def group_scale(spark, sf_dir):
    return features.group_scale(cleared(spark, sf_dir), STATION, "temp_c").select(
        "reading_id", tidy("temp_c_scaled").alias("temp_c_scaled")
    )


@query("softplus_inverse", CLEARED_SQL + f""" SELECT reading_id, {t('ln(1 + exp((humidity - 50) / 25))')} AS positive FROM cleared""")
def softplus_inverse(spark, sf_dir):
    return cleared(spark, sf_dir).select(
        "reading_id", tidy(features.softplus((F.col("humidity") - 50) / 25)).alias("positive")
    )


@query("robust_scale", CLEARED_SQL + f""",
q AS (SELECT station, quantile_cont(temp_c, 0.01) AS lo, quantile_cont(temp_c, 0.5) AS mid, quantile_cont(temp_c, 0.99) AS hi FROM cleared GROUP BY 1)
 SELECT reading_id, {t('(temp_c - mid) / (hi - lo)')} AS temp_c_robust FROM cleared JOIN q USING (station)""")
def robust_scale(spark, sf_dir):
    return features.robust_scale(cleared(spark, sf_dir), STATION, "temp_c").select(
        "reading_id", tidy("temp_c_robust").alias("temp_c_robust")
    )


STATS = ["mean", "std", "min", "max", "range", "skew", "kurt"]


def _rolling_sql(rows):
    return GRID_SQL + f""" SELECT station, {sql_stamp('hour_ts')} AS hour_ts,
 {t('avg(temp_c) OVER w')} AS temp_c_{rows}_mean, {t('stddev_samp(temp_c) OVER w')} AS temp_c_{rows}_std,
 {t('min(temp_c) OVER w')} AS temp_c_{rows}_min, {t('max(temp_c) OVER w')} AS temp_c_{rows}_max,
 {t('max(temp_c) OVER w - min(temp_c) OVER w')} AS temp_c_{rows}_range,
 {t('CASE WHEN count(temp_c) OVER w > 2 AND max(temp_c) OVER w > min(temp_c) OVER w THEN skewness(temp_c) OVER w END')} AS temp_c_{rows}_skew,
 {t('CASE WHEN count(temp_c) OVER w > 3 AND max(temp_c) OVER w > min(temp_c) OVER w THEN kurtosis(temp_c) OVER w END')} AS temp_c_{rows}_kurt
 FROM grid WINDOW w AS ({FRAME} {rows - 1} PRECEDING AND CURRENT ROW)"""


def _rolling(spark, sf_dir, rows):
    hourly = resample_hourly_mean(cleared(spark, sf_dir), STATION, ["temp_c"])
    stats = features.rolling_stats(hourly, STATION, "temp_c", rows)
    names = [f"temp_c_{rows}_{s}" for s in STATS]
    return stats.select("station", stamp("hour_ts").alias("hour_ts"), *[tidy(c).alias(c) for c in names])


for _rows in (24, 48, 72, 168, 336, 504, 720, 2160, 4320):
    query(f"rolling_stats_{_rows}", _rolling_sql(_rows))(
        lambda spark, sf_dir, rows=_rows: _rolling(spark, sf_dir, rows)
    )


@query("interaction_features", CLEARED_SQL + f""" SELECT reading_id, {t('temp_c * humidity')} AS temp_c_x_humidity,
 {t('precip_mm * temp_c')} AS precip_mm_x_temp_c FROM cleared""")
def interaction_features(spark, sf_dir):
    pairs = [("temp_c", "humidity"), ("precip_mm", "temp_c")]
    rows = features.interaction_features(cleared(spark, sf_dir), pairs)
    return rows.select("reading_id", *[tidy(f"{a}_x_{b}").alias(f"{a}_x_{b}") for a, b in pairs])


@query("season_flags", """WITH hol AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders
   WHERE o_orderpriority = '1-URGENT' AND day(o_orderdate) = 1)
 SELECT o_orderkey, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'summer' WHEN month(o_orderdate) IN (3, 4, 5) THEN 'autumn'
   WHEN month(o_orderdate) IN (6, 7, 8) THEN 'winter' ELSE 'spring' END AS season,
   CAST(isodow(o_orderdate) >= 6 AS BIGINT) AS is_weekend, CAST(d IS NOT NULL AS BIGINT) AS is_holiday
 FROM orders LEFT JOIN hol ON CAST(o_orderdate AS DATE) = d""")
def season_flags(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    # a calendar of marked dates, derived from the data
    holidays = orders.filter(
        (F.col("o_orderpriority") == "1-URGENT") & (F.dayofmonth("o_orderdate") == 1)
    ).select(F.to_date("o_orderdate").alias("holiday"))
    rows = features.season_flags(orders, holidays, "o_orderdate")
    return rows.select("o_orderkey", "season", big("is_weekend").alias("is_weekend"),
                       big("is_holiday").alias("is_holiday"))


@query("rolling_zscore_outliers", LAID_SQL + f""",
z AS (SELECT reading_id, temp_c, (temp_c - avg(temp_c) OVER w) / nullif(stddev_samp(temp_c) OVER w, 0) AS zscore
 FROM laid WINDOW w AS ({FRAME} 719 PRECEDING AND CURRENT ROW))
 SELECT reading_id, {t('zscore')} AS zscore, coalesce(abs(zscore) > 2.5, false) AS is_outlier,
   {t('CASE WHEN coalesce(abs(zscore) > 2.5, false) THEN NULL ELSE temp_c END')} AS temp_c FROM z""")
def rolling_zscore_outliers(spark, sf_dir):
    rows = features.rolling_zscore_outliers(laid(spark, sf_dir), STATION, "temp_c", 720, 2.5)
    return rows.select("reading_id", tidy("zscore").alias("zscore"), "is_outlier",
                       tidy("temp_c").alias("temp_c"))


@query("seasonal_interpolate", CLEARED_SQL + f""" SELECT reading_id,
 {t('coalesce(temp_c, avg(temp_c) OVER (PARTITION BY station, month(ts), day(ts), hour(ts)))')} AS temp_c FROM cleared""")
def seasonal_interpolate(spark, sf_dir):
    parts = {"month": F.month("ts"), "day": F.dayofmonth("ts"), "hour": F.hour("ts")}
    return cleaning.fill_seasonal_mean(cleared(spark, sf_dir), STATION, "temp_c", parts).select(
        "reading_id", tidy("temp_c").alias("temp_c")
    )


@query("fill_categorical_mode", CLEARED_SQL + """,
s AS (SELECT *, CASE WHEN humidity >= 20 THEN CAST(user_id % 9 AS VARCHAR) END AS sensor FROM cleared),
c AS (SELECT station, sensor, count(*) AS n FROM s WHERE sensor IS NOT NULL GROUP BY 1, 2),
b AS (SELECT station, sensor AS best, row_number() OVER (PARTITION BY station ORDER BY n DESC, sensor) AS r FROM c)
 SELECT reading_id, coalesce(sensor, best) AS sensor FROM s LEFT JOIN b ON b.station = s.station AND r = 1""")
def fill_categorical_mode(spark, sf_dir):
    rows = cleared(spark, sf_dir).withColumn(
        "sensor", F.when(F.col("humidity") >= 20, (F.col("user_id") % 9).cast("string"))
    )
    return cleaning.fill_mode(rows, STATION, ["sensor"]).select("reading_id", "sensor")


@query("column_screen", CLEARED_SQL + f""",
x AS (SELECT temp_c, humidity, precip_mm, temp_c * 2 + 1 AS twice, 1.0 AS flat FROM cleared),
s AS (SELECT avg(CASE WHEN temp_c IS NULL THEN 1.0 ELSE 0.0 END) m1, avg(CASE WHEN humidity IS NULL THEN 1.0 ELSE 0.0 END) m2,
  avg(CASE WHEN precip_mm IS NULL THEN 1.0 ELSE 0.0 END) m3, var_samp(temp_c) v1, var_samp(humidity) v2,
  var_samp(precip_mm) v3, var_samp(twice) v4, abs(corr(temp_c, humidity)) c12, abs(corr(temp_c, precip_mm)) c13,
  abs(corr(humidity, precip_mm)) c23, abs(corr(humidity, twice)) c24, abs(corr(precip_mm, twice)) c34 FROM x)
 SELECT 'temp_c' AS "column", {t('m1')} AS missing, {t('v1')} AS variance, {t('0')} AS strongest_corr, m1 > 0.2 OR v1 < 0.01 AS drop_column FROM s
 UNION ALL SELECT 'humidity', {t('m2')}, {t('v2')}, {t('c12')}, m2 > 0.2 OR v2 < 0.01 OR c12 > 0.95 FROM s
 UNION ALL SELECT 'precip_mm', {t('m3')}, {t('v3')}, {t('greatest(c13, c23)')}, m3 > 0.2 OR v3 < 0.01 OR greatest(c13, c23) > 0.95 FROM s
 UNION ALL SELECT 'twice', {t('m1')}, {t('v4')}, {t('1')}, true FROM s
 UNION ALL SELECT 'flat', {t('0')}, {t('0')}, {t('0')}, true FROM s""")
def column_screen(spark, sf_dir):
    rows = cleared(spark, sf_dir).select(
        "temp_c", "humidity", "precip_mm", (F.col("temp_c") * 2 + 1).alias("twice"),
        F.lit(1.0).alias("flat"),
    )
    screen = features.column_screen(rows, rows.columns)
    return screen.withColumns({c: tidy(c) for c in ("missing", "variance", "strongest_corr")})


@query("drop_screened", CLEARED_SQL + f" SELECT reading_id, {t('humidity')} AS humidity FROM cleared")
def drop_screened(spark, sf_dir):
    rows = cleared(spark, sf_dir).select(
        "reading_id", "humidity", (F.col("humidity") * 3).alias("thrice"), F.lit(1.0).alias("flat")
    )
    screen = features.column_screen(rows, ["humidity", "thrice", "flat"])
    return features.drop_screened(rows, screen).withColumn("humidity", tidy("humidity"))
