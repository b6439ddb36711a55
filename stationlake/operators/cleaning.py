"""Cleaning of station series: sentinels, ranges, limited fills, outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationlake.operators.aggregates import most_frequent
from stationlake.operators.ordered import (
    BLOCK_ROWS,
    POS,
    Blocks,
    attach_stored,
    neighbours,
    over_rows,
)
from stationlake.schema import SENTINELS, VALID_RANGES, CleaningSettings, numeric_columns
from stationlake.session import materialise


def null_sentinels(
    df: DataFrame, columns: list[str] | None = None, sentinels: list[float] = SENTINELS
) -> DataFrame:
    """Missing-value codes become NULL."""
    columns = numeric_columns(df) if columns is None else columns
    return df.withColumns({c: F.when(~F.col(c).isin(sentinels), F.col(c)) for c in columns})


def null_out_of_range(
    df: DataFrame, ranges: dict[str, tuple[float, float]] = VALID_RANGES
) -> DataFrame:
    """Values outside the inclusive valid range become NULL; absent columns are skipped."""
    return df.withColumns(
        {
            c: F.when(F.col(c).between(low, high), F.col(c))
            for c, (low, high) in ranges.items()
            if c in df.columns
        }
    )


def ffill(
    laid: DataFrame, keys: list[str], columns: list[str], limit: int = 6,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Carry the last value forward over at most ``limit`` rows."""
    return over_rows(
        laid, keys, limit, 0,
        lambda w: {c: F.last(c, ignorenulls=True).over(w.rowsBetween(-limit, 0)) for c in columns},
        block_rows,
    )


def bfill(
    laid: DataFrame, keys: list[str], columns: list[str], limit: int = 24,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Carry the next value back over at most ``limit`` rows."""
    return over_rows(
        laid, keys, 0, limit,
        lambda w: {c: F.first(c, ignorenulls=True).over(w.rowsBetween(0, limit)) for c in columns},
        block_rows,
    )


def _filled(c: str, carry: int, reach: int) -> Column:
    pos = F.col(POS)
    before, value_before = F.col(f"prev_pos_{c}"), F.col(f"prev_{c}")
    after, value_after = F.col(f"next_pos_{c}"), F.col(f"next_{c}")
    # last row that holds the earlier value once it has been carried forward
    start = before + carry
    near = (pos - start <= reach) | (after - pos <= reach)
    line = value_before + (value_after - value_before) * (pos - start) / (after - start)
    return (
        F.when(F.col(c).isNotNull(), F.col(c))
        .when(pos - before <= carry, value_before)
        .when(before.isNotNull() & after.isNotNull(), F.when(near, line))
        .when(after.isNotNull(), F.when(after - pos <= reach, value_after))
        .when(before.isNotNull(), F.when(pos - start <= reach, value_before))
    )


def carry_and_interpolate(
    laid: DataFrame, keys: list[str], columns: list[str], carry: int, reach: int,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Forward fill over ``carry`` rows, then interpolate within ``reach`` rows, in one pass."""
    near = neighbours(laid, keys, columns, block_rows)
    filled = near.withColumns({c: _filled(c, carry, reach) for c in columns})
    return filled.drop(
        *[f"{side}_{part}{c}" for side in ("prev", "next") for part in ("pos_", "") for c in columns]
    )


def interpolate_linear(
    laid: DataFrame, keys: list[str], columns: list[str], limit: int = 24,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Linear fill by position, at most ``limit`` rows from either end of a gap."""
    return carry_and_interpolate(laid, keys, columns, 0, limit, block_rows)


def fill_gaps_hourly(
    laid: DataFrame, keys: list[str], columns: list[str],
    settings: CleaningSettings = CleaningSettings(), block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Sentinels to NULL, carry forward, then interpolate."""
    cleared = null_sentinels(laid, columns, list(settings.sentinels))
    return carry_and_interpolate(
        cleared, keys, columns, settings.carry_limit, settings.interpolate_limit, block_rows
    )


def replace_outliers_rolling_iqr(
    laid: DataFrame, keys: list[str], columns: list[str], rows: int = 24, width: float = 3.0,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Replace values beyond rolling median ± ``width``·IQR by the rolling median.

    The centred frame of an even size holds ``rows/2`` rows before and one less
    after; a frame that is cut off or holds a NULL changes nothing.  The values of a frame are
    sorted once for all its quantiles.
    """
    before, after = rows // 2, rows - 1 - rows // 2
    blocks = Blocks.of(laid, keys, before, after, block_rows)
    frame = blocks.window.rowsBetween(-before, after)
    blocks = blocks.with_columns(
        {f"_q_{c}": F.sort_array(F.collect_list(c).over(frame)) for c in columns}
    )

    def quantile(c: str, level: float) -> Column:
        at = level * (rows - 1)
        low, part = int(at), at - int(at)
        value = F.get(f"_q_{c}", F.lit(low))
        return value + (F.get(f"_q_{c}", F.lit(low + 1)) - value) * part if part else value

    changed = {}
    for c in columns:
        middle = quantile(c, 0.5)
        far = F.abs(F.col(c) - middle) > width * (quantile(c, 0.75) - quantile(c, 0.25))
        # a frame that is cut off or has a NULL lists fewer values
        changed[c] = F.when((F.size(f"_q_{c}") == rows) & far, middle).otherwise(F.col(c))
    return blocks.with_columns(changed).home().drop(*[f"_q_{c}" for c in columns])


def fill_seasonal_mean(
    df: DataFrame, keys: list[str], column: str, parts: dict[str, Column]
) -> DataFrame:
    """NULL becomes the mean of the same season, e.g. the same month and day.

    The means are aggregated before they are joined back, so that a station or a
    season with many rows is never gathered in one place.
    """
    tagged = df.withColumns({f"_season_{n}": e for n, e in parts.items()})
    season = [*keys, *[f"_season_{n}" for n in parts]]
    means = tagged.groupBy(*season).agg(F.avg(column).alias("_season_mean"))
    return (
        attach_stored(tagged, means, season)
        .withColumn(column, F.coalesce(column, "_season_mean"))
        .drop("_season_mean", *[f"_season_{n}" for n in parts])
    )


def fill_column_mean(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """NULL becomes the mean of the station, or of all stations if it has no value.

    Sums per station are written once; the mean of all stations comes from them.
    """
    sums = materialise(
        df.groupBy(*keys).agg(
            *[F.sum(F.col(c).cast("double")).alias(f"_sum_{c}") for c in columns],
            *[F.count(c).alias(f"_count_{c}") for c in columns],
        ),
        "sums",
    )
    overall = sums.agg(
        *[
            F.try_divide(F.sum(f"_sum_{c}"), F.sum(f"_count_{c}")).alias(f"_all_{c}")
            for c in columns
        ]
    )
    own = {c: F.try_divide(F.col(f"_sum_{c}"), F.col(f"_count_{c}")) for c in columns}
    # the other side is one row
    means = sums.crossJoin(F.broadcast(overall)).select(
        *keys, *[F.coalesce(own[c], F.col(f"_all_{c}")).alias(f"_mean_{c}") for c in columns]
    )
    return (
        attach_stored(df, means, keys)
        .withColumns({c: F.coalesce(c, f"_mean_{c}") for c in columns})
        .drop(*[f"_mean_{c}" for c in columns])
    )


def fill_chain(
    laid: DataFrame, keys: list[str], columns: list[str], limit: int = 24,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Carry forward, then back, over ``limit`` rows each; the rest gets the mean.

    The mean is that of the filled column.
    """

    def fills(w):
        return {
            c: F.coalesce(
                F.last(c, ignorenulls=True).over(w.rowsBetween(-limit, 0)),
                F.first(c, ignorenulls=True).over(w.rowsBetween(0, limit)),
            )
            for c in columns
        }

    return fill_column_mean(over_rows(laid, keys, limit, limit, fills, block_rows), keys, columns)


def clean_row(df: DataFrame, columns: list[str]) -> DataFrame:
    """The stateless part of cleaning, valid for batch and streaming frames."""
    return null_out_of_range(null_sentinels(df, columns))


def fill_mode(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """NULL text becomes the most frequent text of the station."""
    modes = most_frequent(df, keys, columns).select(
        *keys, *[F.col(c).alias(f"_mode_{c}") for c in columns]
    )
    return (
        attach_stored(df, modes, keys)
        .withColumns({c: F.coalesce(c, f"_mode_{c}") for c in columns})
        .drop(*[f"_mode_{c}" for c in columns])
    )
