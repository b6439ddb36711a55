"""Aggregates, profiles and quality reports over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stationlake.operators import aggregates, cleaning, quality
from stationlake.operators.ordered import lay_out
from stationlake.plans.registry import big, query, sql_stamp, stamp, t, tidy
from stationlake.plans.standins import (
    CLEARED_SQL,
    GRID_SQL,
    LAID_SQL,
    ORDER,
    STATION,
    by_user,
    cleared,
    grid,
    laid,
    series,
    table,
)


@query("daily_station_aggregate", CLEARED_SQL + f""",
cats AS (SELECT strftime(ts, '%Y-%m-%d') AS obs_date, user_id, category, count(*) AS n FROM cleared GROUP BY ALL),
best AS (SELECT obs_date, user_id, category, row_number() OVER (PARTITION BY obs_date, user_id ORDER BY n DESC, category) AS r FROM cats)
 SELECT strftime(c.ts, '%Y-%m-%d') AS obs_date, c.user_id, count(*) AS "rows", {sql_stamp('min(c.ts)')} AS first_ts,
   {t('avg(temp_c)')} AS temp_c, {t('avg(humidity)')} AS humidity, any_value(best.category) AS category
 FROM cleared c JOIN best ON best.r = 1 AND best.user_id = c.user_id AND best.obs_date = strftime(c.ts, '%Y-%m-%d')
 GROUP BY 1, 2""")
def daily_station_aggregate(spark, sf_dir):
    dated = by_user(spark, sf_dir).withColumn("obs_date", F.date_format("ts", "yyyy-MM-dd"))
    daily = aggregates.daily_station_aggregate(
        dated, ["obs_date", "user_id"], ["temp_c", "humidity"], ["category"]
    )
    return daily.select(
        "obs_date", "user_id", big("rows").alias("rows"), stamp("ts").alias("first_ts"),
        tidy("temp_c").alias("temp_c"), tidy("humidity").alias("humidity"), "category",
    )


HOURLY_SQL = """,
hagg AS (
 SELECT station, date_trunc('hour', ts) AS h, avg(temp_c) AS temp_c_mean, min(temp_c) AS temp_c_min,
  max(temp_c) AS temp_c_max, stddev_samp(temp_c) AS temp_c_std, coalesce(sum(precip_mm), 0) AS precip_mm_sum,
  max(precip_mm) AS precip_mm_max, avg(humidity) AS humidity_mean, min(humidity) AS humidity_min,
  max(humidity) AS humidity_max
 FROM cleared GROUP BY 1, 2)"""
HOURLY_MEASURES = [
    "temp_c_mean", "temp_c_min", "temp_c_max", "temp_c_std", "precip_mm_sum", "precip_mm_max",
    "humidity_mean", "humidity_min", "humidity_max",
]


@query("hourly_aggregate", CLEARED_SQL + HOURLY_SQL + f""" SELECT station, {sql_stamp('h')} AS hour_ts,
 {', '.join(f"{t(c)} AS {c}" for c in HOURLY_MEASURES)} FROM hagg""")
def hourly_aggregate(spark, sf_dir):
    hourly = aggregates.hourly_aggregate(cleared(spark, sf_dir), STATION)
    return hourly.select(
        "station", stamp("hour_ts").alias("hour_ts"), *[tidy(c).alias(c) for c in HOURLY_MEASURES]
    )


@query("derived_hourly_features", CLEARED_SQL + HOURLY_SQL + f""" SELECT station, {sql_stamp('h')} AS hour_ts,
 {t('temp_c_max - temp_c_min')} AS temp_range, {t('precip_mm_sum / 1.0')} AS precip_intensity,
 CAST(hour(h) AS BIGINT) AS "hour", CAST(day(h) AS BIGINT) AS "day", CAST(month(h) AS BIGINT) AS "month",
 CAST(year(h) AS BIGINT) AS "year" FROM hagg""")
def derived_hourly_features(spark, sf_dir):
    hourly = aggregates.hourly_aggregate(cleared(spark, sf_dir), STATION)
    return aggregates.derived_hourly_features(hourly).select(
        "station", stamp("hour_ts").alias("hour_ts"), tidy("temp_range").alias("temp_range"),
        tidy("precip_intensity").alias("precip_intensity"),
        *[big(c).alias(c) for c in ("hour", "day", "month", "year")],
    )


@query("resample_hourly_mean", GRID_SQL + f""" SELECT station, {sql_stamp('hour_ts')} AS hour_ts,
 pos AS series_pos, n AS series_rows, {t('temp_c')} AS temp_c, {t('precip_mm')} AS precip_mm FROM grid""")
def resample_hourly_mean(spark, sf_dir):
    return grid(spark, sf_dir).select(
        "station", stamp("hour_ts").alias("hour_ts"), big("series_pos").alias("series_pos"),
        big("series_rows").alias("series_rows"), tidy("temp_c").alias("temp_c"),
        tidy("precip_mm").alias("precip_mm"),
    )


def _describe_sql(c):
    return f"""SELECT station, '{c}' AS "column", count({c}) AS "count", {t(f'avg({c})')} AS mean,
  {t(f'stddev_samp({c})')} AS std, {t(f'min({c})')} AS "min", {t(f'quantile_cont({c}, 0.25)')} AS p25,
  {t(f'quantile_cont({c}, 0.5)')} AS p50, {t(f'quantile_cont({c}, 0.75)')} AS p75, {t(f'max({c})')} AS "max"
 FROM cleared GROUP BY station"""


@query("describe", CLEARED_SQL + " " + " UNION ALL ".join(_describe_sql(c) for c in ("temp_c", "precip_mm")))
def describe(spark, sf_dir):
    stats = aggregates.describe(cleared(spark, sf_dir), STATION, ["temp_c", "precip_mm"])
    return stats.select(
        "station", "column", "count",
        *[tidy(c).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")],
    )


PROFILED = ["station", "user_id", "reading_id", "ts", "temp_c", "humidity", "precip_mm", "category"]


@query("null_profile", CLEARED_SQL + " " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS nulls, count(*) AS "rows",
 {t(f'count(*) FILTER ({c} IS NULL) / count(*)')} AS null_ratio FROM cleared""" for c in PROFILED))
def null_profile(spark, sf_dir):
    return aggregates.null_profile(cleared(spark, sf_dir)).withColumn(
        "null_ratio", tidy("null_ratio")
    )


@query("all_null_columns", """SELECT * FROM (SELECT 'no_reading' AS "column",
 count(CASE WHEN value < 0 THEN value END) AS seen FROM events
 UNION ALL SELECT 'value', count(value) FROM events) WHERE seen = 0""".replace("SELECT * FROM", 'SELECT "column" FROM', 1))
def all_null_columns(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "value", F.when(F.col("value") < 0, F.col("value")).alias("no_reading")
    )
    return aggregates.all_null_columns(events)


@query("dataset_info", f"""SELECT count(*) AS "rows", CAST(6 AS BIGINT) AS "columns",
 'event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double,props:string' AS types,
 {sql_stamp('min(ts)')} AS first_ts, {sql_stamp('max(ts)')} AS last_ts FROM events""")
def dataset_info(spark, sf_dir):
    info = aggregates.dataset_info(table(spark, sf_dir, "events"))
    return info.select(
        "rows", "columns", "types", stamp("first_ts").alias("first_ts"), stamp("last_ts").alias("last_ts")
    )


@query("aggregation_stats", CLEARED_SQL + f""" SELECT station, count(*) AS rows_before,
 count(DISTINCT date_trunc('hour', ts)) AS rows_after, {t('avg(CASE WHEN temp_c IS NULL THEN 1.0 ELSE 0.0 END)')} AS temp_c_null_ratio
 FROM cleared GROUP BY station""")
def aggregation_stats(spark, sf_dir):
    stats = aggregates.aggregation_stats(cleared(spark, sf_dir), STATION, ["temp_c"])
    return stats.withColumn("temp_c_null_ratio", tidy("temp_c_null_ratio"))


REPORTED = (
    ("station", "string", "categorical", "false"), ("user_id", "bigint", "other", "false"),
    ("reading_id", "bigint", "other", "false"), ("ts", "timestamp_ntz", "time", "false"),
    ("temp_c", "double", "numeric", "true"), ("humidity", "double", "numeric", "true"),
    ("precip_mm", "double", "numeric", "true"), ("category", "string", "other", "false"),
)


@query("dtype_report", CLEARED_SQL + " UNION ALL ".join(
    f""" SELECT '{c}' AS "column", '{kind}' AS "type", '{role}' AS "role", {needed} AS "required",
 count({c}) AS "values" FROM cleared""" for c, kind, role, needed in REPORTED))
def dtype_report(spark, sf_dir):
    return aggregates.dtype_report(cleared(spark, sf_dir))


@query("missing_rate_report", CLEARED_SQL + f""" SELECT station, grouping(station) = 1 AS is_total, count(*) AS "rows",
 count(*) FILTER (temp_c IS NULL) AS missing, {t('count(*) FILTER (temp_c IS NULL) / count(*)')} AS missing_rate,
 count(*) FILTER (temp_c IS NULL) / count(*) > 0.2 AS warning,
 {t('1 - count(*) FILTER (temp_c IS NULL) / count(*)')} AS quality_score
 FROM cleared GROUP BY ROLLUP (station)""")
def missing_rate_report(spark, sf_dir):
    report = quality.missing_rate_report(cleared(spark, sf_dir), STATION, "temp_c")
    return report.withColumns({c: tidy(c) for c in ("missing_rate", "quality_score")})


# a text form of the readings with values that do not convert
RAW_SQL = """raw AS (
  SELECT event_type AS station,
    CASE WHEN k < 5 THEN 'n/a' WHEN k BETWEEN 5 AND 9 THEN NULL ELSE CAST(value AS VARCHAR) END AS temp_text,
    CASE WHEN k = 99 THEN 'unknown' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts_text
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
)"""


def raw_texts(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("station"),
        F.when(k < 5, "n/a").when(k.between(5, 9), None).otherwise(F.col("value").cast("string")).alias("temp_text"),
        F.when(k == 99, "unknown").otherwise(stamp("ts")).alias("ts_text"),
    )


@query("validate_types", f"""WITH {RAW_SQL}
 SELECT 'temp_text' AS "column", 'double' AS expected,
   count(*) FILTER (temp_text IS NOT NULL AND TRY_CAST(temp_text AS DOUBLE) IS NULL) AS failures FROM raw
 UNION ALL SELECT 'ts_text', 'timestamp_ntz',
   count(*) FILTER (ts_text IS NOT NULL AND TRY_CAST(ts_text AS TIMESTAMP) IS NULL) FROM raw""")
def validate_types(spark, sf_dir):
    return quality.validate_types(
        raw_texts(spark, sf_dir), {"temp_text": "double", "ts_text": "timestamp_ntz"}
    )


@query("validate_aggregate", CLEARED_SQL + HOURLY_SQL + """,
b AS (SELECT station, count(*) AS n, avg(temp_c_mean) AS m1, stddev_samp(temp_c_mean) AS s1,
   avg(precip_mm_sum) AS m2, stddev_samp(precip_mm_sum) AS s2,
   count(*) FILTER (temp_c_mean IS NULL) AS z1, count(*) FILTER (precip_mm_sum IS NULL) AS z2 FROM hagg GROUP BY 1),
f AS (SELECT hagg.station, count(*) FILTER (abs(temp_c_mean - m1) > 3 * s1) AS f1,
   count(*) FILTER (abs(precip_mm_sum - m2) > 3 * s2) AS f2 FROM hagg JOIN b ON b.station = hagg.station GROUP BY 1)
 SELECT b.station, n AS "rows", """ + t("greatest(z1, z2) / n") + " AS worst_null_ratio, " + t("greatest(f1, f2) / n") + """ AS worst_outlier_ratio,
   n >= 10 AND greatest(z1, z2) / n <= 0.3 AND greatest(f1, f2) / n <= 0.01 AS is_valid
 FROM b JOIN f ON b.station = f.station""")
def validate_aggregate(spark, sf_dir):
    hourly = aggregates.hourly_aggregate(cleared(spark, sf_dir), STATION)
    report = quality.validate_aggregate(hourly, STATION, ["temp_c_mean", "precip_mm_sum"])
    return report.withColumns({c: tidy(c) for c in ("worst_null_ratio", "worst_outlier_ratio")})


@query("find_time_gaps", LAID_SQL + f""",
g AS (SELECT station, reading_id, ts, lag(ts) OVER (PARTITION BY station ORDER BY pos) AS previous_ts FROM laid)
 SELECT station, reading_id, {sql_stamp('previous_ts')} AS previous_ts,
 {t("date_diff('microsecond', previous_ts, ts) / 1e6")} AS gap_seconds
 FROM g WHERE date_diff('microsecond', previous_ts, ts) > 3600000000""")
def find_time_gaps(spark, sf_dir):
    gaps = quality.find_time_gaps(laid(spark, sf_dir), STATION)
    return gaps.select(
        "station", "reading_id", stamp("previous_ts").alias("previous_ts"),
        tidy("gap_seconds").alias("gap_seconds"),
    )


@query("count_time_gaps_by_user", CLEARED_SQL + """,
g AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, reading_id) AS previous_ts FROM cleared)
 SELECT CAST(user_id AS VARCHAR) AS station, count(*) AS gaps FROM g
 WHERE date_diff('microsecond', previous_ts, ts) > 3600000000 GROUP BY 1""")
def count_time_gaps_by_user(spark, sf_dir):
    users = lay_out(by_user(spark, sf_dir).select("station", *ORDER), STATION, ORDER)
    return quality.find_time_gaps(users, STATION).groupBy("station").agg(
        F.count(F.lit(1)).alias("gaps")
    )


@query("non_empty", """SELECT event_type AS station, count(*) AS "rows" FROM events GROUP BY 1""")
def non_empty(spark, sf_dir):
    rows = quality.require_rows(quality.require_columns(series(spark, sf_dir), ["ts", "temp_c"]))
    return rows.groupBy("station").agg(F.count(F.lit(1)).alias("rows"))


@query("validation_report", f"""WITH {RAW_SQL},
s AS (SELECT station, count(*) AS n, count(*) FILTER (TRY_CAST(temp_text AS DOUBLE) IS NULL) AS z FROM raw GROUP BY 1),
a AS (SELECT sum(z) / sum(n) AS rate, count(*) FILTER (z / n > 0.2) AS above FROM s),
e AS (SELECT count(*) FILTER (TRY_CAST(temp_text AS DOUBLE) IS NULL AND temp_text IS NOT NULL) AS bad_temp,
  count(*) FILTER (TRY_CAST(ts_text AS TIMESTAMP) IS NULL) AS bad_ts FROM raw)
 SELECT bad_temp = 0 AND bad_ts = 0 AS is_valid,
  concat_ws('; ', CASE WHEN bad_temp > 0 THEN 'temp_text: ' || bad_temp || ' not double' END,
    CASE WHEN bad_ts > 0 THEN 'ts_text: ' || bad_ts || ' not timestamp_ntz' END) AS errors,
  concat_ws('; ', CASE WHEN rate > 0.2 THEN 'missing rate above limit' END,
    CASE WHEN above > 0 THEN 'stations with missing rate above limit' END) AS warnings,
  {t('rate')} AS missing_rate, {t('1 - rate')} AS quality_score FROM a, e""")
def validation_report(spark, sf_dir):
    report = quality.validation_report(
        raw_texts(spark, sf_dir), STATION, "temp_text",
        {"temp_text": "double", "ts_text": "timestamp_ntz"},
    )
    return report.select(
        "is_valid", F.concat_ws("; ", "errors").alias("errors"),
        F.concat_ws("; ", "warnings").alias("warnings"),
        tidy("missing_rate").alias("missing_rate"), tidy("quality_score").alias("quality_score"),
    )


# stations without a name
UNNAMED_SQL = """unnamed AS (SELECT CASE WHEN event_type = 'click' THEN NULL ELSE event_type END AS station,
  event_id, CASE WHEN k < 25 THEN NULL ELSE value END AS temp_c,
  CASE WHEN k < 50 THEN NULL WHEN k < 70 THEN 'b' ELSE 'a' END AS sensor,
  CASE WHEN k % 3 = 0 THEN NULL ELSE 'x' || (k % 5) END AS place
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""


def unnamed(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.when(F.col("event_type") != "click", F.col("event_type")).alias("station"),
        "event_id",
        F.when(k >= 25, F.col("value")).alias("temp_c"),
        F.when(k >= 70, "a").when(k >= 50, "b").alias("sensor"),
        F.when(k % 3 != 0, F.concat(F.lit("x"), (k % 5).cast("string"))).alias("place"),
    )


@query("missing_rate_unnamed_station", f"""WITH {UNNAMED_SQL}
 SELECT station, grouping(station) = 1 AS is_total, count(*) AS "rows",
  {t('count(*) FILTER (temp_c IS NULL) / count(*)')} AS missing_rate FROM unnamed GROUP BY ROLLUP (station)""")
def missing_rate_unnamed_station(spark, sf_dir):
    report = quality.missing_rate_report(unnamed(spark, sf_dir), ["station"], "temp_c")
    return report.select("station", "is_total", "rows", tidy("missing_rate").alias("missing_rate"))


@query("fill_mode_unnamed_station", f"""WITH {UNNAMED_SQL},
 c AS (SELECT station, 'sensor' AS what, sensor AS v, count(*) AS n FROM unnamed WHERE sensor IS NOT NULL GROUP BY ALL
  UNION ALL SELECT station, 'place', place, count(*) FROM unnamed WHERE place IS NOT NULL GROUP BY ALL),
 m AS (SELECT station, what, v FROM c QUALIFY row_number() OVER (PARTITION BY station, what ORDER BY n DESC, v) = 1)
 SELECT event_id, coalesce(u.sensor, a.v) AS sensor, coalesce(u.place, b.v) AS place FROM unnamed u
  LEFT JOIN m a ON a.what = 'sensor' AND a.station IS NOT DISTINCT FROM u.station
  LEFT JOIN m b ON b.what = 'place' AND b.station IS NOT DISTINCT FROM u.station""")
def fill_mode_unnamed_station(spark, sf_dir):
    """Two text columns of stations of which one has no name: no row is lost or doubled."""
    filled = cleaning.fill_mode(unnamed(spark, sf_dir), ["station"], ["sensor", "place"])
    return filled.select("event_id", "sensor", "place")
