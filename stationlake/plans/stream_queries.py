"""Streaming runs over the events, compared with the batch result in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stationlake.plans.registry import query, sql_stamp, stamp, t, tidy
from stationlake.plans.standins import CLEARED_SQL, STATION, readings, table
from stationlake.session import scratch_path
from stationlake.streaming import aggregates as streaming

CLEANED_SQL = CLEARED_SQL + """,
c AS (SELECT * REPLACE (CASE WHEN temp_c BETWEEN -40 AND 50 THEN temp_c END AS temp_c,
   CASE WHEN precip_mm BETWEEN 0 AND 500 THEN precip_mm END AS precip_mm) FROM cleared)"""


def _source(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return readings(streaming.stream_table(spark, sf_dir, "events", schema))


def _run(spark, stream, label):
    path, checkpoint = scratch_path(spark, label), scratch_path(spark, f"{label}-checkpoint")
    streaming.run_to_end(stream, path, checkpoint)
    return spark.read.schema(stream.schema).parquet(path)


# windows that end at or before the watermark, one hour behind the last reading; what a stream has
# written when its data end
CLOSED = "HAVING min(date_trunc('{0}', ts)) + INTERVAL 1 {0} <= (SELECT max(ts) - INTERVAL 1 HOUR FROM c)"


@query("stream_daily_aggregate", CLEANED_SQL + f""" SELECT station, {sql_stamp("date_trunc('day', ts)")} AS obs_date, count(*) AS "rows",
 {t('avg(temp_c)')} AS temp_c_mean, {t('min(temp_c)')} AS temp_c_min, {t('max(temp_c)')} AS temp_c_max FROM c GROUP BY 1, 2
 {CLOSED.format('day')}""")
def stream_daily_aggregate(spark, sf_dir):
    """The days that the stream itself has closed."""
    cleaned = streaming.stream_clean(_source(spark, sf_dir), ["temp_c"])
    days = _run(
        spark, streaming.stream_daily_aggregate(cleaned, STATION, ["temp_c"]), "stream-day"
    )
    return days.select(
        "station", stamp("window_start").alias("obs_date"), "rows",
        *[tidy(f"temp_c_{f}").alias(f"temp_c_{f}") for f in ("mean", "min", "max")],
    )


@query("stream_hourly_aggregate", CLEANED_SQL + f""" SELECT station, {sql_stamp("date_trunc('hour', ts)")} AS hour_ts,
 {t('avg(temp_c)')} AS temp_c_mean, {t('stddev_samp(temp_c)')} AS temp_c_std, {t('sum(precip_mm)')} AS precip_mm_sum FROM c GROUP BY 1, 2
 {CLOSED.format('hour')}""")
def stream_hourly_aggregate(spark, sf_dir):
    """The hours that the stream itself has closed."""
    aggregates = {
        "temp_c_mean": F.avg("temp_c"),
        "temp_c_std": F.stddev_samp("temp_c"),
        "precip_mm_sum": F.sum("precip_mm"),
    }
    cleaned = streaming.stream_clean(_source(spark, sf_dir), ["temp_c"])
    hours = _run(spark, streaming.stream_hourly_aggregate(cleaned, STATION, aggregates), "stream-hour")
    return hours.select(
        "station", stamp("window_start").alias("hour_ts"), *[tidy(c).alias(c) for c in aggregates]
    )


def _finished(spark, sf_dir, label, build):
    """All windows of a stream: those it closes as it goes and, by a marker, the last ones."""
    path, checkpoint, markers = (scratch_path(spark, f"{label}-{n}") for n in ("rows", "checkpoint", "markers"))
    source = streaming.with_markers(_source(spark, sf_dir), markers)
    stream = build(streaming.stream_clean(source, ["temp_c"]))
    streaming.run_to_end(stream, path, checkpoint)
    streaming.finish(stream, path, checkpoint, markers)
    return spark.read.schema(stream.schema).parquet(path)


@query("stream_daily_finished", CLEANED_SQL + f""" SELECT station, {sql_stamp("date_trunc('day', ts)")} AS obs_date, count(*) AS "rows",
 {t('avg(temp_c)')} AS temp_c_mean, {t('min(temp_c)')} AS temp_c_min, {t('max(temp_c)')} AS temp_c_max FROM c GROUP BY 1, 2""")
def stream_daily_finished(spark, sf_dir):
    """All days, the last ones closed by the stream at the end of its data."""
    days = _finished(
        spark, sf_dir, "finish-day", lambda df: streaming.stream_daily_aggregate(df, STATION, ["temp_c"])
    )
    return days.select(
        "station", stamp("window_start").alias("obs_date"), "rows",
        *[tidy(f"temp_c_{f}").alias(f"temp_c_{f}") for f in ("mean", "min", "max")],
    )


@query("stream_hourly_finished", CLEANED_SQL + f""" SELECT station, {sql_stamp("date_trunc('hour', ts)")} AS hour_ts,
 {t('avg(temp_c)')} AS temp_c_mean, {t('sum(precip_mm)')} AS precip_mm_sum FROM c GROUP BY 1, 2""")
def stream_hourly_finished(spark, sf_dir):
    """All hours, the last ones closed by the stream at the end of its data."""
    aggregates = {"temp_c_mean": F.avg("temp_c"), "precip_mm_sum": F.sum("precip_mm")}
    hours = _finished(
        spark, sf_dir, "finish-hour",
        lambda df: streaming.stream_hourly_aggregate(df, STATION, aggregates),
    )
    return hours.select(
        "station", stamp("window_start").alias("hour_ts"), *[tidy(c).alias(c) for c in aggregates]
    )


@query("stream_late_counts", CLEANED_SQL + """,
r AS (SELECT CASE WHEN reading_id % 3 = 0 THEN 2 ELSE 1 END AS run, ts, date_trunc('day', ts) + INTERVAL 1 DAY AS stop FROM c),
m AS (SELECT max(ts) FILTER (run = 1) - INTERVAL 1 HOUR AS w1, max(ts) - INTERVAL 1 HOUR AS w2 FROM r),
k AS (SELECT r.*, run = 2 AND stop <= w1 AS late, stop <= w1 AS first, stop <= w2 AS second FROM r, m)
 SELECT 1 AS run, count(*) FILTER (run = 1) AS readings, count(*) FILTER (run = 1 AND first) AS closed,
   count(*) FILTER (run = 1 AND NOT first) AS "open", CAST(0 AS BIGINT) AS late FROM k
 UNION ALL SELECT 2, count(*) FILTER (run = 2), count(*) FILTER (NOT first AND second),
   count(*) FILTER (NOT first AND NOT second), count(*) FILTER (late) FROM k
 UNION ALL SELECT 3, 0, count(*) FILTER (NOT first AND NOT second), 0, 0 FROM k""")
def stream_late_counts(spark, sf_dir):
    """What became of the readings of three runs: the first, one with late readings, the finish."""
    source, path, checkpoint, markers = (
        scratch_path(spark, f"late-{n}") for n in ("source", "rows", "checkpoint", "markers")
    )
    events = table(spark, sf_dir, "events")
    counts = []
    for part in (F.col("event_id") % 3 != 0, F.col("event_id") % 3 == 0):
        events.where(part).write.mode("append").parquet(source)
        rows = streaming.with_markers(
            readings(streaming.read_stream(spark, source, events.schema)), markers
        )
        days = streaming.stream_daily_aggregate(
            streaming.stream_clean(rows, ["temp_c"]), STATION, ["temp_c"]
        )
        counts.append(streaming.run_counted(days, path, checkpoint))
    counts.append(streaming.finish(days, path, checkpoint, markers))
    names = ["readings", "closed", "open", "late"]
    return spark.createDataFrame(
        [(i, *[c[n] for n in names]) for i, c in enumerate(counts, 1)],
        "run int, readings long, closed long, open long, late long",
    )


@query("stream_clean", CLEANED_SQL + f""" SELECT reading_id, {t('temp_c')} AS temp_c,
 {t('precip_mm')} AS precip_mm FROM c""")
def stream_clean(spark, sf_dir):
    cleaned = streaming.stream_clean(_source(spark, sf_dir), ["temp_c"])
    rows = _run(spark, cleaned.select("reading_id", "temp_c", "precip_mm"), "stream-clean")
    return rows.select("reading_id", tidy("temp_c").alias("temp_c"), tidy("precip_mm").alias("precip_mm"))


@query("stream_resume", CLEANED_SQL + f""" SELECT reading_id, {t('temp_c')} AS temp_c FROM c""")
def stream_resume(spark, sf_dir):
    """Readings that arrive between two runs are in the result, each once."""
    source, path, checkpoint = (
        scratch_path(spark, f"resume-{n}") for n in ("source", "rows", "checkpoint")
    )
    events = table(spark, sf_dir, "events")
    for part in (F.col("event_id") % 3 == 0, F.col("event_id") % 3 != 0):
        events.where(part).write.mode("append").parquet(source)
        cleaned = streaming.stream_clean(
            readings(streaming.read_stream(spark, source, events.schema)), ["temp_c"]
        )
        streaming.run_to_end(cleaned.select("reading_id", "temp_c"), path, checkpoint)
    rows = spark.read.schema("reading_id long, temp_c double").parquet(path)
    return rows.select("reading_id", tidy("temp_c").alias("temp_c"))
