"""Unions, period buckets, samples and splits in time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationlake.operators.ordered import POS, SIZE, attach_stored, lay_out


def concat_stations(frames: list[DataFrame]) -> DataFrame:
    """Bag union by column name; a column absent from one frame is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def period_bucket(df: DataFrame, years: int, year: str = "year") -> DataFrame:
    """Start and end of the ``years``-long period; the last one ends with the data."""
    latest = df.agg(F.max(year).alias("_latest"))
    start = (F.floor(F.col(year) / years) * years).cast("int")
    return (
        df.crossJoin(F.broadcast(latest))
        .withColumn("period_start", start)
        .withColumn("period_end", F.least(F.col("period_start") + (years - 1), F.col("_latest")))
        .drop("_latest")
    )


def count_by_year(df: DataFrame, year: str = "year") -> DataFrame:
    return df.groupBy(year).agg(F.count(F.lit(1)).alias("rows"))


def draw(seed: int, row_id: str) -> Column:
    """A fixed pseudo-random order of rows."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string")).cast("binary"))


def _lowest_draws(df: DataFrame, keys: list[str], n: int, row_id: str, seed: int) -> DataFrame:
    """At least the ``n`` lowest draws per key and few more, or all rows of a smaller key.

    Rows are counted by the first digits of their draw; the counts are summed up in
    order and tell which first digits hold the ``n`` lowest draws.
    """
    drawn = df.withColumn("_draw", draw(seed, row_id)).withColumn(
        "_bucket", F.substring("_draw", 1, DRAW_DIGITS)
    )
    counts = drawn.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    needed = lay_out(counts, keys, ["_bucket"], weight="_n").filter(F.col(POS) < n)
    last = needed.groupBy(*keys).agg(F.max("_bucket").alias("_last"))
    return attach_stored(drawn, last, keys).filter(F.col("_bucket") <= F.col("_last"))


# 16^5 first digits: a million counts per key, each of a millionth of its rows
DRAW_DIGITS = 5
DRAW_COLUMNS = ["_draw", "_bucket", "_last"]


def sample_per_group(
    df: DataFrame, keys: list[str], n: int, row_id: str, seed: int = 42
) -> DataFrame:
    """``n`` random rows per key, all rows of a smaller key.

    Only rows that can be among the ``n`` are ranked, so a key with very many rows
    is not ranked in one task.
    """
    in_key = Window.partitionBy(*keys).orderBy("_draw", row_id)
    return (
        _lowest_draws(df, keys, n, row_id, seed)
        .withColumn("_rank", F.row_number().over(in_key))
        .filter(F.col("_rank") <= n)
        .drop("_rank", *DRAW_COLUMNS)
    )


def sample_rows(df: DataFrame, n: int, row_id: str, seed: int = 42) -> DataFrame:
    """``n`` random rows without replacement."""
    low = _lowest_draws(df, [], n, row_id, seed)
    return low.orderBy("_draw", row_id).limit(n).drop(*DRAW_COLUMNS)


def split_holdout_year(df: DataFrame, holdout: int, year: str = "year") -> DataFrame:
    """``split`` = test for the held-out year, train for all others and for NULL."""
    is_test = F.col(year).eqNullSafe(F.lit(holdout))
    return df.withColumn("split", F.when(is_test, "test").otherwise("train"))


def split_chronological(laid: DataFrame, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """First rows of each series train, next validation, the rest test."""
    first = F.floor(F.col(SIZE) * train)
    second = first + F.floor(F.col(SIZE) * validation)
    return laid.withColumn(
        "split",
        F.when(F.col(POS) < first, "train").when(F.col(POS) < second, "validation").otherwise("test"),
    )


def ts_cv_folds(laid: DataFrame, folds: int = 3, gap: int = 0) -> DataFrame:
    """Expanding-window folds: one row per reading, fold and role (train or test).

    ``gap`` rows between the training part and the test block are left out.
    """
    size = F.floor(F.col(SIZE) / (folds + 1))
    by_fold = laid.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    start = F.col(SIZE) - (folds - F.col("fold") + 1) * size
    role = F.when(F.col(POS) < start - gap, "train").when(
        (F.col(POS) >= start) & (F.col(POS) < start + size), "test"
    )
    return by_fold.withColumn("role", role).filter(F.col("role").isNotNull())


def sort_by_time(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Total order by range partitioning, so that no single task sorts everything."""
    return df.orderBy(*keys, *order)
