"""The given tables seen as station series, in Spark and in SQL.

``events`` is a stream of readings: the event type is a dense station, the user a
sparse one.  Missing readings, sentinel codes and outages follow from the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlake.operators import forecasting
from stationlake.operators.aggregates import resample_hourly_mean
from stationlake.operators.cleaning import carry_and_interpolate, null_sentinels
from stationlake.operators.ordered import lay_out
from stationlake.session import materialise

STATION = ["station"]
ORDER = ["ts", "reading_id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(events: DataFrame) -> DataFrame:
    """Station readings from a batch or streaming frame of events."""
    k = F.get_json_object("props", "$.k").cast("int")
    day = F.dayofmonth("ts")
    outage = (
        ((F.col("event_type") == "click") & day.between(5, 6))
        | ((F.col("event_type") == "view") & (day == 1))
        | ((F.col("event_type") == "error") & (day == 30))
    )
    return events.select(
        F.col("event_type").alias("station"),
        "user_id",
        F.col("event_id").alias("reading_id"),
        "ts",
        F.when(outage | k.between(30, 49), None)
        .when(k == 7, -9999.0)
        .when(k == 8, -99.0)
        .otherwise(F.col("value"))
        .alias("temp_c"),
        k.cast("double").alias("humidity"),
        F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("value")).alias("precip_mm"),
        F.col("event_type").alias("category"),
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings(table(spark, sf_dir, "events"))


def cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return null_sentinels(series(spark, sf_dir), ["temp_c"])


def by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sparse stations."""
    return cleared(spark, sf_dir).withColumn("station", F.col("user_id").cast("string"))


def laid(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    chosen = cleared(spark, sf_dir).select(*STATION, *ORDER, *(columns or ["temp_c"]))
    return lay_out(chosen, STATION, ORDER)


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample_hourly_mean(
        cleared(spark, sf_dir), STATION, ["temp_c", "humidity", "precip_mm"]
    )


def filled_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly target without gaps, written once because several steps read it."""
    hourly = resample_hourly_mean(cleared(spark, sf_dir), STATION, ["temp_c"])
    return materialise(carry_and_interpolate(hourly, STATION, ["temp_c"], 6, 24), "grid")


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-step forecasts of three models, written once."""
    return materialise(
        forecasting.run_models(filled_grid(spark, sf_dir), STATION, "temp_c"), "forecasts"
    )


MODEL_NAMES = ["moving_average", "persistence", "seasonal_naive"]

# --- the same in SQL ---

SERIES_SQL = """WITH series AS (
  SELECT event_type AS station, user_id, event_id AS reading_id, ts,
    CASE WHEN (event_type = 'click' AND day(ts) BETWEEN 5 AND 6)
           OR (event_type = 'view' AND day(ts) = 1)
           OR (event_type = 'error' AND day(ts) = 30)
           OR k BETWEEN 30 AND 49 THEN NULL
         WHEN k = 7 THEN -9999.0::DOUBLE WHEN k = 8 THEN -99.0::DOUBLE ELSE value END AS temp_c,
    CAST(k AS DOUBLE) AS humidity,
    CASE WHEN event_type = 'error' THEN 0.0::DOUBLE ELSE value END AS precip_mm,
    event_type AS category
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
)"""

CLEARED_SQL = SERIES_SQL + """,
cleared AS (
  SELECT * REPLACE (CASE WHEN temp_c IN (-9999, -999, -99, 9999) THEN NULL ELSE temp_c END AS temp_c)
  FROM series
)"""

LAID_SQL = CLEARED_SQL + """,
laid AS (
  SELECT *, row_number() OVER (PARTITION BY station ORDER BY ts, reading_id) - 1 AS pos,
    count(*) OVER (PARTITION BY station) AS n
  FROM cleared
)"""

FRAME = "PARTITION BY station ORDER BY pos ROWS BETWEEN"


def ffill_sql(source: str, out: str, column: str = "temp_c", limit: int = 6) -> str:
    return f""",
{out} AS (
  SELECT * REPLACE (last_value({column} IGNORE NULLS) OVER ({FRAME} {limit} PRECEDING AND CURRENT ROW) AS {column})
  FROM {source}
)"""


def interpolate_sql(source: str, out: str, limit: int = 24) -> str:
    return f""",
{out}_near AS (
  SELECT *,
    last_value(CASE WHEN temp_c IS NOT NULL THEN pos END IGNORE NULLS) OVER ({FRAME} UNBOUNDED PRECEDING AND CURRENT ROW) AS pp,
    last_value(temp_c IGNORE NULLS) OVER ({FRAME} UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
    first_value(CASE WHEN temp_c IS NOT NULL THEN pos END IGNORE NULLS) OVER ({FRAME} CURRENT ROW AND UNBOUNDED FOLLOWING) AS np,
    first_value(temp_c IGNORE NULLS) OVER ({FRAME} CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv
  FROM {source}
),
{out} AS (
  SELECT * EXCLUDE (pp, pv, np, nv) REPLACE (
    CASE WHEN temp_c IS NOT NULL THEN temp_c
         WHEN pp IS NOT NULL AND np IS NOT NULL THEN
           CASE WHEN pos - pp <= {limit} OR np - pos <= {limit} THEN pv + (nv - pv) * (pos - pp) / (np - pp) END
         WHEN np IS NOT NULL THEN CASE WHEN np - pos <= {limit} THEN nv END
         WHEN pp IS NOT NULL THEN CASE WHEN pos - pp <= {limit} THEN pv END END AS temp_c)
  FROM {out}_near
)"""


GRID_SQL = CLEARED_SQL + """,
hourly AS (
  SELECT station, date_trunc('hour', ts) AS h, avg(temp_c) AS temp_c, avg(humidity) AS humidity,
    avg(precip_mm) AS precip_mm
  FROM cleared GROUP BY 1, 2
),
span AS (SELECT station, min(h) AS a, max(h) AS b FROM hourly GROUP BY 1),
hours AS (SELECT station, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS hour_ts FROM span),
grid AS (
  SELECT hours.station, hour_ts, temp_c, humidity, precip_mm,
    row_number() OVER (PARTITION BY hours.station ORDER BY hour_ts) - 1 AS pos,
    count(*) OVER (PARTITION BY hours.station) AS n
  FROM hours LEFT JOIN hourly ON hours.station = hourly.station AND hours.hour_ts = hourly.h
)"""

FILLED_SQL = (
    GRID_SQL + ffill_sql("grid", "carried") + interpolate_sql("carried", "filled")
)

FORECASTS_SQL = FILLED_SQL + f""",
points AS (
  SELECT station, hour_ts, pos, temp_c, 'seasonal_naive' AS model,
    lag(temp_c, 24) OVER (PARTITION BY station ORDER BY pos) AS forecast FROM filled
  UNION ALL
  SELECT station, hour_ts, pos, temp_c, 'moving_average',
    avg(temp_c) OVER ({FRAME} 24 PRECEDING AND 1 PRECEDING) FROM filled
  UNION ALL
  SELECT station, hour_ts, pos, temp_c, 'persistence',
    lag(temp_c) OVER (PARTITION BY station ORDER BY pos) FROM filled
),
fc AS (
  SELECT *, forecast - 1.96 * sigma AS lower_bound, forecast + 1.96 * sigma AS upper_bound
  FROM (SELECT *, stddev_pop(temp_c - forecast) OVER (PARTITION BY station, model) AS sigma
        FROM points WHERE forecast IS NOT NULL)
)"""
