"""Unions, samples, splits, joins and versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from stationlake.operators import evaluation, forecasting, splits
from stationlake.operators.ordered import attach, lay_out
from stationlake.plans.registry import big, query, sql_stamp, stamp, t, tidy
from stationlake.plans.standins import (
    CLEARED_SQL,
    LAID_SQL,
    ORDER,
    STATION,
    by_user,
    cleared,
    laid,
    series,
    table,
)


@query("concat_stations", f"""SELECT reading_id, station, {t('temp_c')} AS temp_c, {t('humidity')} AS humidity FROM (
 SELECT event_id AS reading_id, event_type AS station, value AS temp_c, NULL::DOUBLE AS humidity FROM events
 UNION ALL SELECT l_orderkey, l_shipmode, l_quantity, l_tax FROM (SELECT *, l_returnflag AS l_shipmode FROM lineitem))""")
def concat_stations(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("reading_id"), F.col("event_type").alias("station"),
        F.col("value").alias("temp_c"),
    )
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_tax").alias("humidity"), F.col("l_quantity").alias("temp_c"),
        F.col("l_returnflag").alias("station"), F.col("l_orderkey").alias("reading_id"),
    )
    return splits.concat_stations([events, lines]).select(
        "reading_id", "station", tidy("temp_c").alias("temp_c"), tidy("humidity").alias("humidity")
    )


ORDER_YEARS = "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS \"year\" FROM orders"


def _order_years(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))


for _years in (5, 10):

    @query(f"period_bucket_{_years}", f"""SELECT CAST(floor("year" / {_years}) * {_years} AS BIGINT) AS period_start,
 CAST(least(floor("year" / {_years}) * {_years} + {_years - 1}, (SELECT max(year(o_orderdate)) FROM orders)) AS BIGINT) AS period_end,
 count(*) AS n_rows FROM ({ORDER_YEARS}) GROUP BY 1, 2""")
    def period_bucket(spark, sf_dir, years=_years):
        buckets = splits.period_bucket(_order_years(spark, sf_dir), years)
        return buckets.groupBy(
            big("period_start").alias("period_start"), big("period_end").alias("period_end")
        ).agg(F.count(F.lit(1)).alias("n_rows"))


@query("count_by_year", f'SELECT "year", count(*) AS "rows" FROM ({ORDER_YEARS}) GROUP BY 1')
def count_by_year(spark, sf_dir):
    return splits.count_by_year(_order_years(spark, sf_dir)).withColumn("year", big("year"))


@query("sample_per_year", f"""SELECT o_orderkey, "year" FROM (SELECT *, row_number() OVER (
 PARTITION BY "year" ORDER BY md5(concat('42:', o_orderkey)), o_orderkey) AS r FROM ({ORDER_YEARS})) WHERE r <= 100""")
def sample_per_year(spark, sf_dir):
    sampled = splits.sample_per_group(_order_years(spark, sf_dir), ["year"], 100, "o_orderkey")
    return sampled.withColumn("year", big("year"))


@query("sample_rows", """SELECT event_id, event_type FROM events
 ORDER BY md5(concat('42:', event_id)), event_id LIMIT 5000""")
def sample_rows(spark, sf_dir):
    """The limit is the sample size of the operator."""
    return splits.sample_rows(table(spark, sf_dir, "events"), 5000, "event_id").select(
        "event_id", "event_type"
    )


@query("split_holdout_year", """SELECT o_orderkey,
 CASE WHEN year(o_orderdate) = 1998 THEN 'test' ELSE 'train' END AS split FROM orders""")
def split_holdout_year(spark, sf_dir):
    rows = splits.split_holdout_year(_order_years(spark, sf_dir), 1998)
    return rows.select("o_orderkey", "split")


def _split_sql(train, validation):
    return LAID_SQL + f""" SELECT reading_id, station, CASE WHEN pos < floor(n * {train}::DOUBLE) THEN 'train'
 WHEN pos < floor(n * {train}::DOUBLE) + floor(n * {validation}::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM laid"""


@query("split_chronological", _split_sql(0.7, 0.15))
def split_chronological(spark, sf_dir):
    rows = splits.split_chronological(laid(spark, sf_dir))
    return rows.select("reading_id", "station", "split")


@query("split_test20_validation10", _split_sql(0.7, 0.1))
def split_test20_validation10(spark, sf_dir):
    rows = splits.split_chronological(laid(spark, sf_dir), 0.7, 0.1)
    return rows.select("reading_id", "station", "split")


def _folds_sql(folds, gap):
    return CLEARED_SQL + f""",
laid AS (SELECT CAST(user_id AS VARCHAR) AS station, reading_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, reading_id) - 1 AS pos,
   count(*) OVER (PARTITION BY user_id) AS n FROM cleared),
f AS (SELECT *, n // {folds + 1} AS size, n - ({folds} - fold + 1) * (n // {folds + 1}) AS start
  FROM laid, (SELECT unnest(generate_series(1, {folds})) AS fold))
 SELECT station, reading_id, fold, CASE WHEN pos < start - {gap} THEN 'train' ELSE 'test' END AS role FROM f
 WHERE pos < start - {gap} OR (pos >= start AND pos < start + size)"""


def _folds(spark, sf_dir, folds, gap):
    users = lay_out(by_user(spark, sf_dir).select("station", *ORDER), STATION, ORDER)
    rows = splits.ts_cv_folds(users, folds, gap)
    return rows.select("station", "reading_id", big("fold").alias("fold"), "role")


@query("ts_cv_folds", _folds_sql(3, 0))
def ts_cv_folds(spark, sf_dir):
    return _folds(spark, sf_dir, 3, 0)


@query("ts_cv_folds_gap", _folds_sql(5, 24))
def ts_cv_folds_gap(spark, sf_dir):
    return _folds(spark, sf_dir, 5, 24)


@query("sort_by_time", f"""SELECT event_type AS station, event_id, {sql_stamp('ts')} AS ts FROM events
 ORDER BY event_type, ts, event_id""")
def sort_by_time(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("station", F.col("event_type"))
    return splits.sort_by_time(rows, ["station"], ["ts", "event_id"]).select(
        "station", "event_id", stamp("ts").alias("ts")
    )


@query("series_positions", LAID_SQL + " SELECT reading_id, station, pos AS series_pos, n AS series_rows FROM laid")
def series_positions(spark, sf_dir):
    return laid(spark, sf_dir).select("reading_id", "station", "series_pos", "series_rows")


@query("join_group_mean", CLEARED_SQL + f""" SELECT reading_id,
 {t('avg(temp_c) OVER (PARTITION BY station, day(ts))')} AS temp_c_group_mean FROM cleared""")
def join_group_mean(spark, sf_dir):
    rows = cleared(spark, sf_dir).withColumn("day", F.dayofmonth("ts"))
    return evaluation.join_group_mean(rows, ["station", "day"], "temp_c").select(
        "reading_id", tidy("temp_c_group_mean").alias("temp_c_group_mean")
    )


@query("station_metadata_join", """SELECT s_suppkey, s_name, n_name, r_name FROM supplier
 LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def station_metadata_join(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    regions = table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    joined = attach(table(spark, sf_dir, "supplier"), nations, ["s_nationkey"])
    return attach(joined, regions, ["n_regionkey"]).select("s_suppkey", "s_name", "n_name", "r_name")


@query("param_grid", """SELECT station, p, d, P_ AS seasonal_p, D_ AS seasonal_d, s,
 '(' || p || ',' || d || ')(' || P_ || ',' || D_ || ',' || s || ')' AS order_name
 FROM (SELECT DISTINCT event_type AS station FROM events),
 (SELECT unnest([0, 1, 2])::BIGINT AS p), (SELECT unnest([0, 1])::BIGINT AS d),
 (SELECT unnest([0, 1])::BIGINT AS P_), (SELECT unnest([0, 1])::BIGINT AS D_), (SELECT unnest([12, 24])::BIGINT AS s)""")
def param_grid(spark, sf_dir):
    """Every station with every point of the grid; the grid has a fixed 48 points."""
    points = forecasting.param_grid_frame(spark, forecasting.param_grid())
    stations = series(spark, sf_dir).select("station").distinct()
    return stations.crossJoin(F.broadcast(points)).select(
        "station", *[big(a).alias(b) for a, b in
                     (("p", "p"), ("d", "d"), ("P_", "seasonal_p"), ("D_", "seasonal_d"), ("s", "s"))],
        "order_name",
    )


VERSIONS_SQL = """runs AS (SELECT c_mktsegment AS name, o_orderdate AS run_ts, o_orderkey, o_totalprice
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


@query("latest_version", f"""WITH {VERSIONS_SQL}
 SELECT name, {sql_stamp('run_ts')} AS run_ts, o_orderkey, {t('o_totalprice')} AS score FROM (
   SELECT *, row_number() OVER (PARTITION BY name ORDER BY run_ts DESC, o_orderkey DESC) AS r FROM runs) WHERE r = 1""")
def latest_version(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("name")
    )
    runs = table(spark, sf_dir, "orders").join(customers, "o_custkey").select(
        "name", F.col("o_orderdate").alias("run_ts"), "o_orderkey", "o_totalprice",
        F.struct("o_orderdate", "o_orderkey").alias("version"),
    )
    return forecasting.latest_version(runs, ["name"], "version").select(
        "name", stamp("run_ts").alias("run_ts"), "o_orderkey", tidy("o_totalprice").alias("score")
    )
