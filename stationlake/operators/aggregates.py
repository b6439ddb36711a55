"""Daily and hourly aggregates, grids and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationlake.operators.ordered import attach, exact_quantiles
from stationlake.operators.periods import HOUR, HOURLY, resample_mean
from stationlake.schema import HOURLY_FUNCTIONS, MEASURES, REQUIRED, STATION_KEYS, numeric_columns


def floor_time(ts: Column, unit: str) -> Column:
    """Start of the day or hour, from the parts of ``ts``, so that no zone comes in."""
    day = ts.cast("date").cast("timestamp_ntz")
    if unit == "day":
        return day
    if unit == "hour":
        return day + F.make_dt_interval(hours=F.hour(ts))
    raise ValueError(f"unit {unit} is not known")


def most_frequent(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Most frequent non-null text per group, ties to the smallest.

    One aggregate for all columns: map tasks count equal values, a group holds one count per
    distinct text.
    """
    return df.groupBy(*keys).agg(*[F.mode(c, True).alias(c) for c in columns])


def daily_station_aggregate(
    df: DataFrame, keys: list[str], numeric: list[str], text: list[str] = (), ts: str | None = "ts"
) -> DataFrame:
    """Mean of numbers and mode of texts per key; rows with a NULL key are dropped."""
    known = df.dropna(subset=keys)
    return known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        *([F.min(ts).alias(ts)] if ts else []),
        *[F.avg(c).alias(c) for c in numeric],
        *[F.mode(c, True).alias(c) for c in text],
    )


AGGREGATES = {
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "std": F.stddev_samp,
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0)),
}


def hourly_aggregate(
    df: DataFrame, keys: list[str], ts: str = "ts",
    functions: dict[str, list[str]] = HOURLY_FUNCTIONS,
) -> DataFrame:
    """Configured functions per station and hour, named ``<column>_<function>``."""
    return df.groupBy(*keys, floor_time(F.col(ts), "hour").alias(HOUR)).agg(
        *[
            AGGREGATES[f](c).alias(f"{c}_{f}")
            for c, names in functions.items()
            if c in df.columns
            for f in names
        ]
    )


def derived_hourly_features(hourly: DataFrame) -> DataFrame:
    """Temperature range, precipitation per hour and calendar parts."""
    return hourly.withColumns(
        {
            "temp_range": F.col("temp_c_max") - F.col("temp_c_min"),
            "precip_intensity": F.col("precip_mm_sum") / 1.0,
            "hour": F.hour(HOUR),
            "day": F.dayofmonth(HOUR),
            "month": F.month(HOUR),
            "year": F.year(HOUR),
        }
    )


def resample_hourly_mean(
    df: DataFrame, keys: list[str], columns: list[str], ts: str = "ts"
) -> DataFrame:
    """One row per hour from the first to the last reading of a station, laid out."""
    return resample_mean(df, keys, columns, HOURLY, ts)


def describe(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Count, mean, std, min, quartiles and max per numeric column, one row each."""
    named = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("_v")) for c in columns]
    # one row per value, so that all columns share one aggregate and one layout
    stacked = df.select(*keys, F.inline(F.array(*named)))
    by = [*keys, "column"]
    basic = stacked.groupBy(*by).agg(
        F.count("_v").alias("count"),
        F.avg("_v").alias("mean"),
        F.stddev_samp("_v").alias("std"),
        F.min("_v").alias("min"),
        F.max("_v").alias("max"),
    )
    quartiles = exact_quantiles(stacked, by, "_v", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return attach(basic, quartiles, by).select(
        *by, "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def null_profile(df: DataFrame) -> DataFrame:
    """Null count and ratio of every column, in one pass over the data."""
    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns],
    )
    return counted.select(
        "_rows",
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in df.columns])
        ).alias("_p"),
    ).select(
        "_p.column",
        "_p.nulls",
        F.col("_rows").alias("rows"),
        (F.col("_p.nulls") / F.col("_rows")).alias("null_ratio"),
    )


def all_null_columns(df: DataFrame) -> DataFrame:
    """Columns that hold no value at all."""
    return null_profile(df).filter(F.col("nulls") == F.col("rows")).select("column")


def dataset_info(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows, columns, types and time range as one row."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")
    ).select(
        "rows",
        F.lit(len(df.columns)).cast("long").alias("columns"),
        F.lit(",".join(f"{n}:{t}" for n, t in df.dtypes)).alias("types"),
        "first_ts",
        "last_ts",
    )


def aggregation_stats(df: DataFrame, keys: list[str], columns: list[str], ts: str = "ts") -> DataFrame:
    """Rows before, hourly bins after, and null ratios per station."""
    per_hour = df.groupBy(*keys, floor_time(F.col(ts), "hour").alias(HOUR)).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(f"_seen_{c}") for c in columns]
    )
    return per_hour.groupBy(*keys).agg(
        F.sum("_rows").alias("rows_before"),
        F.count(F.lit(1)).alias("rows_after"),
        *[
            (1 - F.sum(f"_seen_{c}") / F.sum("_rows")).alias(f"{c}_null_ratio")
            for c in columns
        ],
    )


def dtype_report(df: DataFrame) -> DataFrame:
    """Type, role and number of values of every column."""
    roles = {
        **{c: "numeric" for c in [*MEASURES, "latitude", "longitude", "altitude"]},
        **{c: "categorical" for c in ["region", "state", "station", "wmo_code"]},
        **{c: "time" for c in ["ts", "obs_date"]},
    }
    counted = df.agg(*[F.count(c).alias(c) for c in df.columns])
    rows = [
        F.struct(
            F.lit(name).alias("column"),
            F.lit(kind).alias("type"),
            F.lit(roles.get(name, "other")).alias("role"),
            F.lit(name in REQUIRED).alias("required"),
            F.col(name).alias("values"),
        )
        for name, kind in df.dtypes
    ]
    return counted.select(F.inline(F.array(*rows)))


def daily_keys(df: DataFrame) -> list[str]:
    return [k for k in ["obs_date", *STATION_KEYS, "year"] if k in df.columns]


def measure_columns(df: DataFrame) -> list[str]:
    return [c for c in numeric_columns(df, exclude=(POS, SIZE)) if c in MEASURES]
