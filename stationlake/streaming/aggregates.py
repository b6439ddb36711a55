"""Daily and hourly aggregates of a growing folder of readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationlake.operators.cleaning import clean_row

#: True in rows that only move the watermark.
MARKER = "_marker"

_PROGRESS = "spark.sql.streaming.numRecentProgressUpdates"


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType, pattern: str = "*.parquet"
) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(path)


def stream_table(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    """A table of ``folder`` as a stream, whether it is one file or a folder of files."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.getFileStatus(hadoop).isDirectory():
        return read_stream(spark, f"{folder}/{name}.parquet", schema)
    return read_stream(spark, folder, schema, f"{name}.parquet")


def stream_clean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Stateless cleaning; the same code as for a batch frame."""
    return clean_row(df, columns)


def windowed(
    df: DataFrame, keys: list[str], ts: str, width: str, aggregates: dict[str, Column],
    late: str = "1 hour",
) -> DataFrame:
    """Tumbling windows per station; a reading later than ``late`` is dropped.

    A watermark needs an instant, so times without zone are taken as UTC on the way in and out:
    no window depends on the zone of the session.  What comes in and what windows hold when they
    close is observed, see `run_counted`; markers (`with_markers`) move the watermark and count
    nowhere.
    """
    reading = ~F.col(MARKER) if MARKER in df.columns else F.lit(True)
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", epoch, F.col(ts).cast("timestamp_ntz"))
    timed = df.withColumn("_event_time", F.timestamp_micros(micros)).withWatermark(
        "_event_time", late
    )
    started = epoch + F.make_dt_interval(secs=F.unix_seconds("_w.start"))
    dated = F.col("_event_time").isNotNull()
    seen = timed.observe(
        "came", F.count(F.when(reading & dated, 1)).alias("readings"), F.count(F.when(reading & ~dated, 1)).alias("undated")
    )
    closed = (
        seen.groupBy(F.window("_event_time", width).alias("_w"), *keys)
        # first, so that it is the first value of the state
        .agg(F.count(F.when(reading, 1)).alias("_readings"), *[e.alias(n) for n, e in aggregates.items()])
        .where("_readings > 0")
        .observe("went", F.coalesce(F.sum("_readings"), F.lit(0)).alias("readings"))
    )
    return closed.select(*keys, started.alias("window_start"), *aggregates)


def daily_aggregates(columns: list[str]) -> dict[str, Column]:
    return {
        "rows": F.count(F.lit(1)),
        **{f"{c}_mean": F.avg(c) for c in columns},
        **{f"{c}_min": F.min(c) for c in columns},
        **{f"{c}_max": F.max(c) for c in columns},
    }


def stream_daily_aggregate(
    df: DataFrame, keys: list[str], columns: list[str], ts: str = "ts", late: str = "1 hour"
) -> DataFrame:
    return windowed(df, keys, ts, "1 day", daily_aggregates(columns), late)


def stream_hourly_aggregate(
    df: DataFrame, keys: list[str], aggregates: dict[str, Column], ts: str = "ts",
    late: str = "1 hour",
) -> DataFrame:
    return windowed(df, keys, ts, "1 hour", aggregates, late)


def flush_open(closed: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Closed windows of a stream plus those still open, the latter taken from a batch.

    For the end of the data, where the stream reads no markers; with them see `finish`.
    """
    there = closed.select(*[F.col(k).alias(f"_closed_{k}") for k in keys])
    same = [batch[k].eqNullSafe(there[f"_closed_{k}"]) for k in keys]
    still_open = batch.join(there, same, "left_anti")
    return closed.unionByName(still_open.select(closed.columns))


def with_markers(stream: DataFrame, folder: str, ts: str = "ts") -> DataFrame:
    """The stream and the markers of ``folder``: rows with nothing but a time, see `finish`."""
    spark = stream.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    markers = spark.readStream.schema(T.StructType([T.StructField(ts, T.TimestampNTZType())])).parquet(folder)
    return stream.withColumn(MARKER, F.lit(False)).unionByName(
        markers.withColumn(MARKER, F.lit(True)), allowMissingColumns=True
    )


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> list[dict]:
    """Process what is there now, then stop; a later run goes on from ``checkpoint``.

    Append mode writes a window once it is closed and holds the open ones back.  Returns the
    progress of all batches.
    """
    spark = stream.sparkSession
    kept = spark.conf.get(_PROGRESS, None)
    spark.conf.set(_PROGRESS, "100000")
    try:
        query = (
            stream.writeStream.format("parquet")
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        spark.conf.unset(_PROGRESS) if kept is None else spark.conf.set(_PROGRESS, kept)
    return query.recentProgress


def open_windows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``window_end, readings`` of the windows that a stream of `windowed` holds open."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(hadoop) or len(files.listStatus(hadoop)) == 0:
        return spark.createDataFrame([], "window_end timestamp, readings long")
    state = spark.read.format("statestore").load(checkpoint)
    # several values of a state may have the same name: they are told apart by place
    value = state.schema["value"].dataType
    renamed = T.StructType([T.StructField(f"v{i}", f.dataType) for i, f in enumerate(value)])
    return state.select(
        F.col("key").getField(state.schema["key"].dataType[0].name)["end"].alias("window_end"),
        F.col("value").cast(renamed)["v0"].alias("readings"),
    ).where("readings > 0")


def run_counted(stream: DataFrame, path: str, checkpoint: str) -> dict[str, int]:
    """Run to the end and account for every reading of a `windowed` stream.

    ``readings`` came in, ``undated`` ones had no time, ``closed`` are in windows that this run wrote,
    ``open`` in windows that wait; ``late`` came after their window was closed and were dropped.
    """
    spark = stream.sparkSession

    def waiting() -> int:
        return open_windows(spark, checkpoint).agg(F.sum("readings")).first()[0] or 0

    before = waiting()
    progress = run_to_end(stream, path, checkpoint)

    def total(name: str, value: str) -> int:
        found = [dict(p["observedMetrics"]).get(name) for p in progress]
        return sum(row[value] or 0 for row in found if row is not None)

    came, closed, after = total("came", "readings"), total("went", "readings"), waiting()
    return {
        "readings": came,
        "undated": total("came", "undated"),
        "closed": closed,
        "open": after,
        "late": came + before - closed - after,
    }


def finish(
    stream: DataFrame, path: str, checkpoint: str, markers: str, late: str = "1 hour", ts: str = "ts"
) -> dict[str, int]:
    """Close the open windows through the stream itself, at the end of the data.

    A marker that lies ``late`` behind the last open window moves the watermark to that window's end.
    Later periods may still come; ``stream`` must read ``markers`` (`with_markers`) from the start.
    """
    spark = stream.sparkSession
    ends = open_windows(spark, checkpoint).agg(F.max("window_end").alias("at")).where("at is not null")
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    instant = epoch + F.make_dt_interval(secs=F.unix_seconds("at"))
    ends.select((instant + F.expr(f"INTERVAL {late}")).alias(ts)).write.mode("append").parquet(markers)
    return run_counted(stream, path, checkpoint)
