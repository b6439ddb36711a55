"""Streams end with the rows of the batch, late readings are dropped, runs resume."""

from pyspark.sql import functions as F

from stationlake.streaming import aggregates as streaming

SCHEMA = "station string, ts timestamp_ntz, temp_c double"


def write(spark, path, rows):
    spark.createDataFrame(rows, "station string, ts string, temp_c double").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz")
    ).coalesce(1).write.mode("append").parquet(path)


def daily(spark, source):
    schema = spark.createDataFrame([], SCHEMA).schema
    return streaming.stream_daily_aggregate(
        streaming.read_stream(spark, source, schema), ["station"], ["temp_c"]
    )


def rows_of(spark, out, stream):
    got = spark.read.schema(stream.schema).parquet(out)
    return sorted((r.station, str(r.window_start.date()), r.rows) for r in got.collect())


def test_open_day_is_held_back_and_resumed(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    write(spark, source, [("a", "2024-01-01 01:00:00", 1.0), ("a", "2024-01-01 23:00:00", 3.0),
                          ("a", "2024-01-02 05:00:00", 5.0)])
    stream = daily(spark, source)
    streaming.run_to_end(stream, out, checkpoint)
    assert rows_of(spark, out, stream) == [("a", "2024-01-01", 2)]

    # a late reading for the closed day is dropped, the open day goes on
    write(spark, source, [("a", "2024-01-01 02:00:00", 9.0), ("a", "2024-01-02 06:00:00", 7.0),
                          ("a", "2024-01-03 04:00:00", 7.0)])
    stream = daily(spark, source)
    streaming.run_to_end(stream, out, checkpoint)
    assert rows_of(spark, out, stream) == [("a", "2024-01-01", 2), ("a", "2024-01-02", 2)]


def test_stream_closes_its_last_windows_and_counts_late_readings(spark, tmp_path):
    source, out, checkpoint, markers = (str(tmp_path / n) for n in ("in", "out", "checkpoint", "markers"))
    schema = spark.createDataFrame([], SCHEMA).schema

    def stream():
        rows = streaming.with_markers(streaming.read_stream(spark, source, schema), markers)
        return streaming.stream_daily_aggregate(rows, ["station"], ["temp_c"])

    write(spark, source, [("a", "2024-01-01 01:00:00", 1.0), ("a", "2024-01-02 05:00:00", 5.0),
                          (None, "2024-01-02 06:00:00", 5.0), ("a", None, 5.0)])
    assert streaming.run_counted(stream(), out, checkpoint) == {
        "readings": 3, "undated": 1, "closed": 1, "open": 2, "late": 0,
    }
    # two late readings of one station and day, which Spark's own metric counts as one
    write(spark, source, [("a", "2024-01-01 02:00:00", 9.0), ("a", "2024-01-01 03:00:00", 9.0),
                          ("b", "2024-01-01 03:00:00", 9.0), ("a", "2024-01-02 07:00:00", 7.0)])
    assert streaming.run_counted(stream(), out, checkpoint) == {
        "readings": 4, "undated": 0, "closed": 0, "open": 3, "late": 3,
    }
    assert streaming.finish(stream(), out, checkpoint, markers) == {
        "readings": 0, "undated": 0, "closed": 3, "open": 0, "late": 0,
    }
    got = spark.read.parquet(out).collect()
    assert {(r.station, str(r.window_start.date()), r.rows) for r in got} == {
        ("a", "2024-01-01", 1), ("a", "2024-01-02", 2), (None, "2024-01-02", 1),
    }
    # finishing again changes nothing, the next day may still come
    assert streaming.finish(stream(), out, checkpoint, markers)["closed"] == 0
    write(spark, source, [("a", "2024-01-03 00:00:00", 1.0), ("a", "2024-01-02 23:59:59", 1.0)])
    counts = streaming.run_counted(stream(), out, checkpoint)
    assert (counts["readings"], counts["open"], counts["late"]) == (2, 1, 1)
    assert streaming.finish(stream(), out, checkpoint, markers)["closed"] == 1
    assert spark.read.parquet(out).count() == len(got) + 1


def test_finishing_a_stream_without_readings(spark, tmp_path):
    source, out, checkpoint, markers = (str(tmp_path / n) for n in ("in", "out", "checkpoint", "markers"))
    write(spark, source, [])
    schema = spark.createDataFrame([], SCHEMA).schema
    rows = streaming.with_markers(streaming.read_stream(spark, source, schema), markers)
    stream = streaming.stream_daily_aggregate(rows, ["station"], ["temp_c"])
    assert set(streaming.finish(stream, out, checkpoint, markers).values()) == {0}
