"""Cleaning operators over the stand-in series."""

from __future__ import annotations

from pyspark.sql import functions as F

from stationlake.operators import cleaning
from stationlake.operators.aggregates import daily_station_aggregate
from stationlake.operators.ordered import lay_out
from stationlake.plans.registry import big, query, stamp, sql_stamp, t, tidy
from stationlake.plans.standins import (
    CLEARED_SQL,
    FRAME,
    LAID_SQL,
    ORDER,
    SERIES_SQL,
    STATION,
    by_user,
    cleared,
    ffill_sql,
    interpolate_sql,
    laid,
    series,
)


def _row(df, column="temp_c"):
    return df.select("reading_id", "station", tidy(column).alias(column))


ROW_SQL = f" SELECT reading_id, station, {t('temp_c')} AS temp_c FROM "


@query("flagship_daily_station", LAID_SQL + ffill_sql("laid", "f") + f"""
 SELECT station, strftime(ts, '%Y-%m-%d') AS obs_date, count(temp_c) AS n_values, {t('avg(temp_c)')} AS temp_c
 FROM f GROUP BY 1, 2""")
def flagship_daily_station(spark, sf_dir):
    filled = cleaning.ffill(laid(spark, sf_dir), STATION, ["temp_c"], 6)
    return filled.groupBy("station", F.date_format("ts", "yyyy-MM-dd").alias("obs_date")).agg(
        F.count("temp_c").alias("n_values"), tidy(F.avg("temp_c")).alias("temp_c")
    )


@query("null_sentinels", SERIES_SQL + f""" SELECT reading_id, station,
 CASE WHEN temp_c IN (-9999, -999, -99, 9999) THEN NULL ELSE {t('temp_c')} END AS temp_c FROM series""")
def null_sentinels(spark, sf_dir):
    return _row(cleaning.null_sentinels(series(spark, sf_dir), ["temp_c"]))


@query("null_out_of_range", SERIES_SQL + f""" SELECT reading_id,
 {t('CASE WHEN temp_c BETWEEN -40 AND 50 THEN temp_c END')} AS temp_c,
 {t('CASE WHEN humidity BETWEEN 0 AND 100 THEN humidity END')} AS humidity,
 {t('CASE WHEN precip_mm BETWEEN 0 AND 500 THEN precip_mm END')} AS precip_mm FROM series""")
def null_out_of_range(spark, sf_dir):
    return cleaning.null_out_of_range(series(spark, sf_dir)).select(
        "reading_id", *[tidy(c).alias(c) for c in ("temp_c", "humidity", "precip_mm")]
    )


@query("ffill_limited", LAID_SQL + ffill_sql("laid", "f") + ROW_SQL + "f")
def ffill_limited(spark, sf_dir):
    return _row(cleaning.ffill(laid(spark, sf_dir), STATION, ["temp_c"], 6))


@query("ffill_sparse_users", CLEARED_SQL + """,
laid AS (SELECT * REPLACE (CAST(user_id AS VARCHAR) AS station),
   row_number() OVER (PARTITION BY user_id ORDER BY ts, reading_id) - 1 AS pos FROM cleared)"""
+ ffill_sql("laid", "f") + ROW_SQL + "f")
def ffill_sparse_users(spark, sf_dir):
    users = by_user(spark, sf_dir).select("station", *ORDER, "temp_c")
    return _row(cleaning.ffill(lay_out(users, STATION, ORDER), STATION, ["temp_c"], 6))


@query("bfill_limited", LAID_SQL + f""" SELECT reading_id, station,
 {t(f'first_value(temp_c IGNORE NULLS) OVER ({FRAME} CURRENT ROW AND 24 FOLLOWING)')} AS temp_c FROM laid""")
def bfill_limited(spark, sf_dir):
    return _row(cleaning.bfill(laid(spark, sf_dir), STATION, ["temp_c"], 24))


@query("interpolate_linear", LAID_SQL + interpolate_sql("laid", "f") + ROW_SQL + "f")
def interpolate_linear(spark, sf_dir):
    return _row(cleaning.interpolate_linear(laid(spark, sf_dir), STATION, ["temp_c"], 24))


@query("fill_gaps_hourly",
       LAID_SQL + ffill_sql("laid", "c") + interpolate_sql("c", "f") + ROW_SQL + "f")
def fill_gaps_hourly(spark, sf_dir):
    raw = series(spark, sf_dir).select("station", *ORDER, "temp_c")
    return _row(cleaning.fill_gaps_hourly(lay_out(raw, STATION, ORDER), STATION, ["temp_c"]))


@query("replace_outliers_rolling_iqr", LAID_SQL + ffill_sql("laid", "c") + interpolate_sql("c", "f") + f""",
q AS (SELECT *, quantile_cont(temp_c, 0.25) OVER w AS q1, quantile_cont(temp_c, 0.5) OVER w AS q2,
   quantile_cont(temp_c, 0.75) OVER w AS q3, count(temp_c) OVER w AS seen
 FROM f WINDOW w AS ({FRAME} 12 PRECEDING AND 11 FOLLOWING))
 SELECT reading_id, station, {t('''CASE WHEN seen = 24 AND abs(temp_c - q2) > 1.5 * (q3 - q1) THEN q2 ELSE temp_c END''')} AS temp_c FROM q""")
def replace_outliers_rolling_iqr(spark, sf_dir):
    filled = cleaning.fill_gaps_hourly(laid(spark, sf_dir), STATION, ["temp_c"])
    return _row(cleaning.replace_outliers_rolling_iqr(filled, STATION, ["temp_c"], 24, 1.5))


@query("fill_seasonal_mean", CLEARED_SQL + f""" SELECT reading_id, station,
 {t('coalesce(temp_c, avg(temp_c) OVER (PARTITION BY station, month(ts), day(ts)))')} AS temp_c FROM cleared""")
def fill_seasonal_mean(spark, sf_dir):
    parts = {"month": F.month("ts"), "day": F.dayofmonth("ts")}
    return _row(cleaning.fill_seasonal_mean(cleared(spark, sf_dir), STATION, "temp_c", parts))


@query("fill_column_mean", CLEARED_SQL + f""" SELECT reading_id, station,
 {t('coalesce(temp_c, avg(temp_c) OVER (PARTITION BY station), avg(temp_c) OVER ())')} AS temp_c FROM cleared""")
def fill_column_mean(spark, sf_dir):
    return _row(cleaning.fill_column_mean(cleared(spark, sf_dir), STATION, ["temp_c"]))


@query("fill_chain", LAID_SQL + f""",
ff AS (SELECT * REPLACE (last_value(temp_c IGNORE NULLS) OVER ({FRAME} 24 PRECEDING AND CURRENT ROW) AS temp_c) FROM laid),
fb AS (SELECT * REPLACE (first_value(temp_c IGNORE NULLS) OVER ({FRAME} CURRENT ROW AND 24 FOLLOWING) AS temp_c) FROM ff)
 SELECT reading_id, station,
 {t('coalesce(temp_c, avg(temp_c) OVER (PARTITION BY station), avg(temp_c) OVER ())')} AS temp_c FROM fb""")
def fill_chain(spark, sf_dir):
    return _row(cleaning.fill_chain(laid(spark, sf_dir), STATION, ["temp_c"], 24))


@query("clean_then_daily", LAID_SQL.replace("FROM cleared\n)", "FROM in_range\n)").replace(
    "laid AS (", """in_range AS (SELECT * REPLACE (CASE WHEN temp_c BETWEEN -40 AND 50 THEN temp_c END AS temp_c) FROM cleared),
laid AS (""") + ffill_sql("laid", "c") + interpolate_sql("c", "f") + f""",
cats AS (SELECT strftime(ts, '%Y-%m-%d') AS obs_date, station, user_id % 7 AS grp, count(*) AS n FROM f GROUP BY ALL),
best AS (SELECT obs_date, station, grp, row_number() OVER (PARTITION BY obs_date, station ORDER BY n DESC, CAST(grp AS VARCHAR)) AS r FROM cats)
 SELECT f.station, strftime(ts, '%Y-%m-%d') AS obs_date, count(*) AS "rows",
   {sql_stamp('min(ts)')} AS first_ts, {t('avg(temp_c)')} AS temp_c, any_value(CAST(best.grp AS VARCHAR)) AS sensor
 FROM f JOIN best ON best.r = 1 AND best.station = f.station AND best.obs_date = strftime(ts, '%Y-%m-%d')
 GROUP BY 1, 2""")
def clean_then_daily(spark, sf_dir):
    """Sentinels, ranges, fills, then mean and mode per day, in one plan."""
    raw = series(spark, sf_dir).select(
        "station", *ORDER, "temp_c", (F.col("user_id") % 7).cast("string").alias("sensor")
    )
    cleaned = lay_out(cleaning.clean_row(raw, ["temp_c"]), STATION, ORDER)
    filled = cleaning.carry_and_interpolate(cleaned, STATION, ["temp_c"], 6, 24)
    dated = filled.withColumn("obs_date", F.date_format("ts", "yyyy-MM-dd"))
    daily = daily_station_aggregate(dated, ["station", "obs_date"], ["temp_c"], ["sensor"])
    return daily.select(
        "station", "obs_date", big("rows").alias("rows"), stamp("ts").alias("first_ts"),
        tidy("temp_c").alias("temp_c"), "sensor",
    )
