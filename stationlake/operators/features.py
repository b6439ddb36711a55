"""Calendar, rolling, decomposition, scaling and sequence features."""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationlake.functions.stats import cyclic, sample_kurtosis, sample_skewness
from stationlake.operators.ordered import (
    BLOCK,
    BLOCK_ROWS,
    POS,
    SIZE,
    Blocks,
    attach,
    attach_stored,
    exact_quantiles,
    over_rows,
)
from stationlake.session import materialise


def calendar_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Parts of the date; Monday is day 0."""
    return df.withColumns(
        {
            "year": F.year(ts),
            "month": F.month(ts),
            "day": F.dayofmonth(ts),
            "hour": F.hour(ts),
            "day_of_week": F.weekday(ts),
            "week_of_year": F.weekofyear(ts),
            "day_of_year": F.dayofyear(ts),
            "is_weekend": (F.weekday(ts) >= 5).cast("int"),
        }
    )


def cyclic_encode(df: DataFrame, periods: dict[str, float]) -> DataFrame:
    """``<column>_sin`` and ``<column>_cos`` for each column and its period."""
    encoded = {}
    for c, period in periods.items():
        encoded[f"{c}_sin"], encoded[f"{c}_cos"] = cyclic(F.col(c), period)
    return df.withColumns(encoded)


# Rows per cycle of the calendar parts.
CALENDAR_PERIODS = {"hour": 24, "day": 31, "month": 12, "day_of_week": 7}


def season_flags(df: DataFrame, holidays: DataFrame | None = None, ts: str = "ts") -> DataFrame:
    """Southern-hemisphere season, weekend and holiday flags.

    ``holidays`` has one row per calendar date in ``holiday``; it is a calendar, so
    its size does not grow with the readings.
    """
    month = F.month(ts)
    season = (
        F.when(month.isin(12, 1, 2), "summer")
        .when(month.isin(3, 4, 5), "autumn")
        .when(month.isin(6, 7, 8), "winter")
        .otherwise("spring")
    )
    out = df.withColumns({"season": season, "is_weekend": (F.weekday(ts) >= 5).cast("int")})
    if holidays is None:
        return out.withColumn("is_holiday", F.lit(0))
    dates = holidays.select(F.col("holiday").alias("_holiday")).distinct()
    return (
        out.join(dates, F.to_date(ts) == F.col("_holiday"), "left")
        .withColumn("is_holiday", F.col("_holiday").isNotNull().cast("int"))
        .drop("_holiday")
    )


def rolling_centered(
    laid: DataFrame, keys: list[str], column: str, rows: int = 24, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Mean and sample deviation of the centred frame, from one value on."""
    before, after = rows // 2, rows - 1 - rows // 2

    def stats(w):
        frame = w.rowsBetween(-before, after)
        return {
            f"{column}_mean_{rows}": F.avg(column).over(frame),
            f"{column}_std_{rows}": F.stddev_samp(column).over(frame),
        }

    return over_rows(laid, keys, before, after, stats, block_rows)


def weather_flags(df: DataFrame, keys: list[str], humid_above: float = 70.0) -> DataFrame:
    """``is_raining`` and ``is_humid``; missing humidity counts as the station mean."""
    means = df.groupBy(*keys).agg(F.avg("humidity").alias("_humidity"))
    return (
        attach_stored(df, means, keys)
        .withColumns(
            {
                "is_raining": (F.coalesce("precip_mm", F.lit(0.0)) > 0).cast("int"),
                "is_humid": F.coalesce(
                    (F.coalesce("humidity", "_humidity") > humid_above).cast("int"), F.lit(0)
                ),
            }
        )
        .drop("_humidity")
    )


def time_index(df: DataFrame, keys: list[str], ts: str = "ts", seconds: int = 3600) -> DataFrame:
    """Time since the first reading of the station, in units of ``seconds``."""
    starts = df.groupBy(*keys).agg(F.min(ts).alias("_start"))
    passed = F.timestamp_diff("MICROSECOND", F.col("_start"), F.col(ts)) / 1e6
    return attach_stored(df, starts, keys).withColumn("time_index", passed / seconds).drop("_start")


def seasonal_decompose(
    grid: DataFrame, keys: list[str], column: str, period: int = 168,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Additive trend, seasonal and residual of a gap-free laid-out series."""
    half = period // 2

    def trend(w):
        if period % 2:
            total = F.sum(column).over(w.rowsBetween(-half, half))
        else:
            total = F.sum(column).over(w.rowsBetween(-half + 1, half - 1)) + 0.5 * (
                F.lag(column, half).over(w) + F.lead(column, half).over(w)
            )
        inside = (F.col(POS) >= half) & (F.col(POS) + half < F.col(SIZE))
        return {"trend": F.when(inside, total / period)}

    with_trend = over_rows(grid, keys, half, half, trend, block_rows).withColumn(
        "_phase", F.col(POS) % period
    )
    # at most `period` rows per series
    phases = with_trend.groupBy(*keys, "_phase").agg(
        F.avg(F.col(column) - F.col("trend")).alias("_effect")
    )
    centre = phases.groupBy(*keys).agg(F.avg("_effect").alias("_centre"))
    seasonal = attach(phases, centre, keys).select(
        *keys, "_phase", (F.col("_effect") - F.col("_centre")).alias("seasonal")
    )
    return (
        attach_stored(with_trend, seasonal, [*keys, "_phase"])
        .withColumn("residual", F.col(column) - F.col("trend") - F.col("seasonal"))
        .drop("_phase")
    )


def scale_bounds(train: DataFrame, columns: list[str]) -> DataFrame:
    """Minimum and maximum of each column: one row, fitted on the training part."""
    return train.agg(
        *[f(c).cast("double").alias(f"_{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    )


def _drop_bounds(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*[f"_{n}_{c}" for c in columns for n in ("min", "max")])


def minmax_scale(df: DataFrame, bounds: DataFrame, columns: list[str]) -> DataFrame:
    """(x − min)/(max − min); a constant column becomes 0."""
    scaled = {}
    for c in columns:
        low, high = F.col(f"_min_{c}"), F.col(f"_max_{c}")
        scaled[c] = F.when(high == low, F.col(c) * 0.0).otherwise(
            F.try_divide(F.col(c) - low, high - low)
        )
    return _drop_bounds(df.crossJoin(F.broadcast(bounds)).withColumns(scaled), columns)


def minmax_inverse(df: DataFrame, bounds: DataFrame, columns: list[str]) -> DataFrame:
    """Back to the original scale."""
    restored = {
        c: F.col(c) * (F.col(f"_max_{c}") - F.col(f"_min_{c}")) + F.col(f"_min_{c}")
        for c in columns
    }
    return _drop_bounds(df.crossJoin(F.broadcast(bounds)).withColumns(restored), columns)


def group_scale(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """z-score of the target per station; a station without spread gets 0."""
    stats = df.groupBy(*keys).agg(
        F.avg(column).alias("_mean"), F.stddev_samp(column).alias("_std")
    )
    spread = F.col("_std")
    scaled = F.when(
        spread > 0, F.try_divide(F.col(column) - F.col("_mean"), spread)
    ).when(
        F.col(column).isNotNull(), F.lit(0.0)
    )
    return attach_stored(df, stats, keys).withColumn(f"{column}_scaled", scaled).drop("_mean", "_std")


def softplus(c: Column) -> Column:
    """Positive transform of a normalised prediction: log(1 + exp(x))."""
    return F.greatest(c, F.lit(0.0)) + F.log1p(F.exp(-F.abs(c)))


def robust_scale(
    df: DataFrame, keys: list[str], column: str, low: float = 0.01, high: float = 0.99
) -> DataFrame:
    """(x − median)/(high quantile − low quantile) with exact quantiles."""
    quantiles = exact_quantiles(df, keys, column, {"_low": low, "_mid": 0.5, "_high": high})
    scaled = (F.col(column) - F.col("_mid")) / F.nullif(
        F.col("_high") - F.col("_low"), F.lit(0.0)
    )
    return (
        attach_stored(df, quantiles, keys)
        .withColumn(f"{column}_robust", scaled)
        .drop("_low", "_mid", "_high")
    )


def _value(c: str) -> Column:
    return F.coalesce(F.col(c).cast("float"), F.lit(float("nan")))


def _members(laid: DataFrame, keys: list[str], first: Column, last: Column, stride: int, row: Column) -> DataFrame:
    """Rows of every window, in order, as ``_rows`` per key and window number ``_k``.

    ``first`` and ``last`` bound the numbers of the windows that a row lies in.  A row goes only to
    windows that exist, so ``length / stride`` rows move for each, and a window is one small group.
    """
    spread = laid.select(
        *keys,
        F.col(SIZE).alias("_size"),
        F.struct(F.col(POS).alias("pos"), row.alias("row")).alias("_row"),
        F.when(first <= last, F.sequence(first, last)).alias("_ks"),
    )
    return (
        spread.select(*keys, "_size", "_row", F.explode("_ks").alias("_k"))
        .groupBy(*keys, "_k")
        .agg(
            F.max("_size").alias("_size"),
            F.array_sort(
                F.collect_list("_row"), lambda a, b: (a["pos"] - b["pos"]).cast("int")
            ).alias("_rows"),
        )
        .withColumn("start_pos", F.col("_k") * stride)
    )


def _up(pos: Column, stride: int) -> Column:
    """The lowest window number whose start is at or after ``pos``."""
    return F.ceil(F.greatest(pos, F.lit(0)) / stride)


def sliding_sequences(
    laid: DataFrame, keys: list[str], columns: list[str], target: str, length: int, stride: int = 1
) -> DataFrame:
    """Windows of ``length`` consecutive rows: ``x`` = all but the last, ``y`` = last target.

    One window starts every ``stride`` rows; the data grows by ``length/stride``.
    """
    pos = F.col(POS)
    row = F.struct(F.array(*[_value(c) for c in columns]).alias("x"), F.col(target).cast("float").alias("y"))
    last = F.least(F.floor(pos / stride), F.floor((F.col(SIZE) - length) / stride))
    windows = _members(laid, keys, _up(pos - (length - 1), stride), last, stride, row)
    inputs = F.slice("_rows", 1, length - 1)
    return windows.select(
        *keys,
        "start_pos",
        F.transform(inputs, lambda r: r["row"]["x"]).alias("x"),
        F.element_at("_rows", length)["row"]["y"].alias("y"),
    )


def encoder_decoder_windows(
    laid: DataFrame, keys: list[str], target: str, known: list[str], min_encoder: int,
    max_encoder: int, max_decoder: int, stride: int = 1,
) -> DataFrame:
    """Per start row: history of the target, then known inputs and targets to come.

    A window starts every ``stride`` rows where at least ``min_encoder`` rows lie before.
    """
    pos = F.col(POS)
    row = F.struct(F.array(*[_value(c) for c in known]).alias("known"), _value(target).alias("target"))
    first = _up(F.greatest(pos - (max_decoder - 1), F.lit(min_encoder)), stride)
    last = F.least(F.floor((pos + max_encoder) / stride), F.floor((F.col(SIZE) - 1) / stride))
    windows = _members(laid, keys, first, last, stride, row)
    history = F.least(F.col("start_pos"), F.lit(max_encoder)).cast("int")
    past = F.slice("_rows", F.lit(1), history)
    coming = F.slice("_rows", history + 1, F.lit(max_decoder))
    return windows.select(
        *keys,
        "start_pos",
        F.transform(past, lambda r: r["row"]["target"]).alias("encoder"),
        F.transform(coming, lambda r: r["row"]["known"]).alias("decoder_known"),
        F.transform(coming, lambda r: r["row"]["target"]).alias("decoder_target"),
    )


def _power_sums(laid, keys, column, rows, block_rows):
    """Count and sums of powers 1..4 of the trailing frame, from totals of chunks.

    A frame is its chunk of ``rows`` rows so far and the rest of the earlier chunk, so the
    cost does not grow with the frame and a wild value touches the frames of two chunks
    only.  Values are centred by the mean of the station's finite values first.
    """
    finite = F.when(F.abs(column) < float("inf"), F.col(column))
    means = laid.groupBy(*keys).agg(F.avg(finite).alias("_centre"))
    blocks = Blocks.of(attach_stored(laid, means, keys), keys, rows, 0, block_rows)
    x = F.col(column) - F.col("_centre")
    powers = {"n": F.col(column).isNotNull().cast("double"), "s1": x, "s2": x * x,
              "s3": x * x * x, "s4": x * x * x * x}
    chunked = blocks.with_columns({"_part": F.expr(f"{POS} div {rows}L")})
    by_chunk = Window.partitionBy(*blocks.keys, BLOCK, "_part")
    start = Window.unboundedPreceding
    ahead = by_chunk.orderBy(POS).rowsBetween(start, 0)
    back = by_chunk.orderBy(F.col(POS).desc()).rowsBetween(start, 0)
    values = {k: F.coalesce(e, F.lit(0.0)) for k, e in powers.items()}
    totals = chunked.with_columns(
        {f"_t_{k}": F.sum(e).over(ahead) for k, e in values.items()}
        | {f"_r_{k}": F.sum(e).over(back) for k, e in values.items()}
    )
    # the last row of a chunk has the whole chunk as its frame
    ends = F.col(POS) % rows == rows - 1
    summed = totals.with_columns(
        {
            f"_{k}": F.when(ends, F.col(f"_t_{k}")).otherwise(
                F.col(f"_t_{k}")
                + F.coalesce(F.lag(f"_r_{k}", rows - 1).over(totals.window), F.lit(0.0))
            )
            for k in powers
        }
    )
    helpers = ["_part", *[f"_{t}_{k}" for k in powers for t in "tr"]]
    return Blocks(summed.df.drop(*helpers), summed.keys, summed.block_rows)


def rolling_extremes(blocks: Blocks, column: str, rows: int, prefix: str) -> Blocks:
    """Trailing minimum and maximum with running extremes of chunks of ``rows`` rows.

    A frame ends in one chunk and starts in the one before (or in the same): its
    extreme is that of the chunk so far and of the rest of the earlier chunk.
    """
    chunked = blocks.with_columns({"_chunk": F.expr(f"{POS} div {rows}L")})
    by_chunk = Window.partitionBy(*blocks.keys, BLOCK, "_chunk")
    ahead, back = by_chunk.orderBy(POS), by_chunk.orderBy(F.col(POS).desc())
    start = Window.unboundedPreceding
    chunked = chunked.with_columns(
        {
            "_min_in": F.min(column).over(ahead.rowsBetween(start, 0)),
            "_max_in": F.max(column).over(ahead.rowsBetween(start, 0)),
            "_min_rest": F.min(column).over(back.rowsBetween(start, 0)),
            "_max_rest": F.max(column).over(back.rowsBetween(start, 0)),
        }
    )
    w = chunked.window
    done = chunked.with_columns(
        {
            f"{prefix}_min": F.least("_min_in", F.lag("_min_rest", rows - 1).over(w)),
            f"{prefix}_max": F.greatest("_max_in", F.lag("_max_rest", rows - 1).over(w)),
        }
    )
    helpers = ["_chunk", "_min_in", "_max_in", "_min_rest", "_max_rest"]
    return Blocks(done.df.drop(*helpers), done.keys, done.block_rows)


def rolling_stats(
    laid: DataFrame, keys: list[str], column: str, rows: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Mean, std, min, max, range, skew and kurtosis of the trailing ``rows`` rows."""
    blocks = _power_sums(laid, keys, column, rows, block_rows)
    prefix = f"{column}_{rows}"
    blocks = rolling_extremes(blocks, column, rows, prefix)
    n = F.nullif(F.col("_n"), F.lit(0.0))
    s1, s2, s3, s4 = (F.col(f"_{k}") for k in ("s1", "s2", "s3", "s4"))
    mean = s1 / n
    m2 = F.greatest(s2 / n - mean * mean, F.lit(0.0))
    m3 = s3 / n - 3 * mean * s2 / n + 2 * mean * mean * mean
    m4 = s4 / n - 4 * mean * s3 / n + 6 * mean * mean * s2 / n - 3 * mean * mean * mean * mean
    flat = m2 <= 1e-12
    stats = {
        f"{prefix}_mean": F.when(n > 0, F.col("_centre") + mean),
        f"{prefix}_std": F.when(n > 1, F.sqrt(F.try_divide(m2 * n, n - 1))),
        f"{prefix}_range": F.col(f"{prefix}_max") - F.col(f"{prefix}_min"),
        f"{prefix}_skew": F.when(~flat, sample_skewness(F.try_divide(m3, F.pow(m2, F.lit(1.5))), n)),
        f"{prefix}_kurt": F.when(~flat, sample_kurtosis(F.try_divide(m4, m2 * m2) - 3, n)),
    }
    helpers = [f"_{k}" for k in ("n", "s1", "s2", "s3", "s4")]
    return blocks.with_columns({k: F.when(n > 0, e) for k, e in stats.items()}).home().drop(
        "_centre", *helpers
    )


def interaction_features(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Product of each pair, named ``<a>_x_<b>``."""
    return df.withColumns({f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in pairs})


def rolling_zscore_outliers(
    laid: DataFrame, keys: list[str], column: str, rows: int = 720, limit: float = 3.0,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """z-score in the trailing frame and a flag; flagged values become NULL."""
    blocks = _power_sums(laid, keys, column, rows, block_rows)
    n, s1, s2 = F.nullif(F.col("_n"), F.lit(0.0)), F.col("_s1"), F.col("_s2")
    mean = s1 / n
    variance = F.try_divide(F.greatest(s2 / n - mean * mean, F.lit(0.0)) * n, n - 1)
    deviation = F.sqrt(variance)
    score = F.when(
        deviation > 1e-9, F.try_divide(F.col(column) - F.col("_centre") - mean, deviation)
    )
    helpers = [f"_{k}" for k in ("n", "s1", "s2", "s3", "s4")]
    flagged = blocks.with_columns({"zscore": score}).home().drop("_centre", *helpers)
    is_outlier = F.coalesce(F.abs("zscore") > limit, F.lit(False))
    return flagged.withColumn("is_outlier", is_outlier).withColumn(
        column, F.when(~F.col("is_outlier"), F.col(column))
    )


PAIR_SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]


def _gram(batches, columns: list[str], shift: list[float]):
    """Sums over the rows of a task for each pair of columns, over rows that have both.

    Five matrix products per batch, however many columns there are.
    """
    total = None
    for batch in batches:
        values = np.column_stack(
            [batch.column(c).to_numpy(zero_copy_only=False).astype(float) - s for c, s in zip(columns, shift)]
        )
        there = np.column_stack(
            [batch.column(c).is_valid().to_numpy(zero_copy_only=False) for c in columns]
        ).astype(float)
        x = np.where(there > 0, values, 0.0)
        found = np.stack([there.T @ there, x.T @ there, there.T @ x, (x * x).T @ there, there.T @ (x * x), x.T @ x])
        total = found if total is None else total + found
    if total is not None:
        at, to = np.triu_indices(len(columns))
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int32()), pa.array(to, pa.int32()), *[pa.array(m[at, to]) for m in total]],
            ["a", "b", *PAIR_SUMS],
        )


def pair_sums(df: DataFrame, columns: list[str]) -> DataFrame:
    """``a, b`` and the sums of `PAIR_SUMS` for each pair of columns, numbered from 0.

    A task hands on one row per pair; values are shifted by the means of a few rows, which changes no
    variance or correlation but keeps their digits.
    """
    chosen = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    names = chosen.columns
    few = chosen.limit(1000).select(*[F.avg(c).alias(c) for c in names]).first()
    shift = [few[c] if few[c] is not None and math.isfinite(few[c]) else 0.0 for c in names]
    sums = chosen.mapInArrow(
        partial(_gram, columns=names, shift=shift), "a int, b int, " + ", ".join(f"{c} double" for c in PAIR_SUMS)
    )
    return sums.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in PAIR_SUMS])


def column_screen(
    df: DataFrame, columns: list[str], max_missing: float = 0.2, max_corr: float = 0.95,
    min_variance: float = 0.01,
) -> DataFrame:
    """Reasons to drop columns: too many NULLs, too little variance, too correlated.

    Of a correlated pair the later column is the one to drop.  One aggregate of six sums serves any
    number of columns; the result has one row per column.
    """
    sums = materialise(pair_sums(df, columns), "pairs")
    n = F.nullif(F.col("n"), F.lit(0.0))
    vx, vy = (F.greatest(F.col(f"s{c}{c}") / n - (F.col(f"s{c}") / n) ** 2, F.lit(0.0)) for c in "xy")
    covariance = F.col("sxy") / n - F.col("sx") / n * (F.col("sy") / n)
    spread = F.sqrt(vx) * F.sqrt(vy)
    strongest = (
        sums.where("a < b")
        .groupBy("b")
        .agg(F.max(F.abs(F.when(spread > 1e-12, covariance / spread))).alias("_corr"))
    )
    rows = df.agg(F.count(F.lit(1)).alias("_rows"))
    own = sums.where("a = b").select(
        F.col("a").alias("b"),
        F.col("n"),
        F.try_divide(F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("n") - 1).alias("variance"),
    )
    names = df.sparkSession.createDataFrame(list(enumerate(columns)), "b int, column string")
    # all sides have one row per column, ``rows`` has one
    return (
        names.join(own, "b", "left")
        .join(strongest, "b", "left")
        .crossJoin(F.broadcast(rows))
        .select(
            "column",
            F.try_divide(F.col("_rows") - F.coalesce("n", F.lit(0.0)), F.col("_rows")).alias("missing"),
            F.when(F.col("variance") < 0, 0.0).otherwise(F.col("variance")).alias("variance"),
            F.coalesce(F.when(~F.isnan("_corr"), F.col("_corr")), F.lit(0.0)).alias("strongest_corr"),
        )
        .withColumn(
            "drop_column",
            (F.col("missing") > max_missing)
            | F.coalesce(F.col("variance") < min_variance, F.lit(True))
            | (F.col("strongest_corr") > max_corr),
        )
    )


def drop_screened(df: DataFrame, screen: DataFrame) -> DataFrame:
    """Drop the columns the screen names; its result is one row per column."""
    names = [r["column"] for r in screen.filter("drop_column").select("column").collect()]
    return df.drop(*names)
