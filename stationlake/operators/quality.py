"""Data quality reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationlake.operators.ordered import BLOCK_ROWS, attach, attach_stored, over_rows
from stationlake.schema import REQUIRED


def require_columns(df: DataFrame, columns: list[str] = REQUIRED) -> DataFrame:
    """The same frame; raises before any job runs when a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df


def require_rows(df: DataFrame) -> DataFrame:
    """The same frame; raises when it has no row."""
    if df.isEmpty():
        raise ValueError("no data loaded")
    return df


def missing_rate_report(
    df: DataFrame, keys: list[str], target: str, limit: float = 0.2
) -> DataFrame:
    """Null rate, warning and score per station; ``is_total`` marks the row of all stations."""
    per_key = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(target).isNull()).alias("missing")
    )
    total = per_key.agg(F.sum("rows").alias("rows"), F.sum("missing").alias("missing"))
    both = per_key.withColumn("is_total", F.lit(False)).unionByName(
        total.withColumn("is_total", F.lit(True)), allowMissingColumns=True
    )
    rate = F.col("missing") / F.col("rows")
    return both.select(
        *keys,
        "is_total",
        "rows",
        "missing",
        rate.alias("missing_rate"),
        (rate > limit).alias("warning"),
        (1 - rate).alias("quality_score"),
    )


def validate_types(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Texts per column that do not convert to the expected type."""
    counted = df.agg(
        *[
            F.count_if(F.col(c).isNotNull() & F.trim(c).try_cast(to).isNull()).alias(c)
            for c, to in expected.items()
        ]
    )
    rows = [
        F.struct(F.lit(c).alias("column"), F.lit(to).alias("expected"), F.col(c).alias("failures"))
        for c, to in expected.items()
    ]
    return counted.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def validate_aggregate(
    df: DataFrame,
    keys: list[str],
    columns: list[str],
    min_rows: int = 10,
    max_null_ratio: float = 0.3,
    sigmas: float = 3.0,
    max_outlier_ratio: float = 0.01,
) -> DataFrame:
    """Checks of row count, null ratio and share of values beyond ``sigmas`` deviations."""
    basic = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        *[
            e
            for c in columns
            for e in (
                F.avg(c).alias(f"_mean_{c}"),
                F.stddev_samp(c).alias(f"_std_{c}"),
                F.count_if(F.col(c).isNull()).alias(f"_nulls_{c}"),
            )
        ],
    )
    centres = basic.select(*keys, *[f"_{p}_{c}" for c in columns for p in ("mean", "std")])
    beyond = attach_stored(df.select(*keys, *columns), centres, keys).groupBy(*keys).agg(
        *[
            F.count_if(
                F.abs(F.col(c) - F.col(f"_mean_{c}")) > sigmas * F.col(f"_std_{c}")
            ).alias(f"_far_{c}")
            for c in columns
        ]
    )
    report = attach(basic, beyond, keys)

    def largest(prefix: str) -> Column:
        ratios = [F.col(f"_{prefix}_{c}") / F.col("rows") for c in columns]
        return reduce(F.greatest, ratios) if len(ratios) > 1 else ratios[0]

    return report.select(
        *keys,
        "rows",
        largest("nulls").alias("worst_null_ratio"),
        largest("far").alias("worst_outlier_ratio"),
    ).withColumn(
        "is_valid",
        (F.col("rows") >= min_rows)
        & (F.col("worst_null_ratio") <= max_null_ratio)
        & (F.col("worst_outlier_ratio") <= max_outlier_ratio),
    )


def find_time_gaps(
    laid: DataFrame, keys: list[str], ts: str = "ts", max_seconds: int = 3600,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Readings that come more than ``max_seconds`` after the one before."""
    gap = F.timestamp_diff("MICROSECOND", F.col("previous_ts"), F.col(ts)) / 1e6
    return (
        over_rows(laid, keys, 1, 0, lambda w: {"previous_ts": F.lag(ts).over(w)}, block_rows)
        .withColumn("gap_seconds", gap)
        .filter(F.col("gap_seconds") > max_seconds)
    )


def validation_report(
    df: DataFrame, keys: list[str], target: str, expected: dict[str, str], limit: float = 0.2
) -> DataFrame:
    """One row: validity, errors, warnings, missing rate and score."""
    types = validate_types(df, expected).agg(
        F.sort_array(
            F.collect_list(
                F.when(
                    F.col("failures") > 0,
                    F.concat(F.col("column"), F.lit(": "), F.col("failures").cast("string"),
                             F.lit(" not "), F.col("expected")),
                )
            )
        ).alias("type_errors")
    )
    # text that is no number counts as missing here
    as_number = df.withColumn(target, F.trim(target).try_cast("double"))
    per_key = missing_rate_report(as_number, keys, target, limit)
    is_total = F.col("is_total")
    overall = per_key.agg(
        F.coalesce(F.max(F.when(is_total, F.col("rows"))), F.lit(0)).alias("rows"),
        F.max(F.when(is_total, F.col("missing_rate"))).alias("missing_rate"),
        F.count_if(~is_total & F.col("warning")).alias("stations_above_limit"),
    )
    # both sides are one row
    joined = overall.crossJoin(F.broadcast(types))
    errors = F.array_compact(
        F.concat(
            F.col("type_errors"),
            F.array(F.when(F.col("rows") == 0, F.lit("no data loaded"))),
        )
    )
    warnings = F.array_compact(
        F.array(
            F.when(F.col("missing_rate") > limit, F.lit("missing rate above limit")),
            F.when(F.col("stations_above_limit") > 0, F.lit("stations with missing rate above limit")),
        )
    )
    return joined.select(
        (F.size(errors) == 0).alias("is_valid"),
        errors.alias("errors"),
        warnings.alias("warnings"),
        "missing_rate",
        (1 - F.col("missing_rate")).alias("quality_score"),
    )
