"""Grids of any calendar frequency: periods as whole numbers, and the frequency a grid carries.

Every period of a frequency has a number; neighbours differ by one, whatever their length in hours.
A grid's positions are differences of numbers, so months and days need no special case later.
The frequency is kept as metadata of the grid's time column and read back by the forecasts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationlake.operators.ordered import POS, SIZE, attach
from stationlake.session import materialise

HOUR = "hour_ts"

#: Periods of a series generated by one row at a time.
CHUNK = 1024

_MICROS = {"minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}


def _floor_div(c: Column, n: int) -> Column:
    return ((c - F.pmod(c, F.lit(n))) / n).cast("long")


def _epoch() -> Column:
    return F.lit("1970-01-01").cast("timestamp_ntz")


@dataclass(frozen=True)
class Frequency:
    """``step`` minutes, hours, days or months.

    Minutes, hours and days are counted from 1970-01-01, months from January of year 0, so
    that three months are calendar quarters.
    """

    unit: str = "hour"
    step: int = 1

    def __post_init__(self):
        if self.unit not in (*_MICROS, "month") or self.step < 1:
            raise ValueError(f"{self.step} {self.unit} is not a frequency")

    @staticmethod
    def parse(text: str) -> Frequency:
        """``"hour"``, ``"days"``, ``"6 hours"``."""
        found = re.fullmatch(r"\s*(\d+)?\s*([a-z]+?)s?\s*", text)
        if not found:
            raise ValueError(f"{text!r} is not a frequency")
        return Frequency(found[2], int(found[1] or 1))

    @property
    def name(self) -> str:
        return f"{self.step} {self.unit}"

    def number(self, ts: Column) -> Column:
        """Number of the period that ``ts`` lies in."""
        ts = ts.cast("timestamp_ntz")
        if self.unit == "month":
            return _floor_div(F.year(ts).cast("long") * 12 + F.month(ts) - 1, self.step)
        micros = F.timestamp_diff("MICROSECOND", _epoch(), ts)
        return _floor_div(micros, _MICROS[self.unit] * self.step)

    def start(self, number: Column) -> Column:
        """First instant of a period."""
        if self.unit == "month":
            months = number * self.step
            year = _floor_div(months, 12).cast("int")
            return F.make_timestamp_ntz(
                year, (F.pmod(months, F.lit(12)) + 1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0)
            )
        # days and minutes of the day, each within the range of an interval's parts
        minutes = number * (_MICROS[self.unit] // _MICROS["minute"] * self.step)
        days, rest = _floor_div(minutes, 1440).cast("int"), F.pmod(minutes, F.lit(1440)).cast("int")
        return _epoch() + F.make_dt_interval(days=days, mins=rest)

    def later(self, ts: Column, steps: Column) -> Column:
        """The start of the period ``steps`` periods after that of ``ts``."""
        return self.start(self.number(ts) + steps)


HOURLY = Frequency("hour")
DAILY = Frequency("day")


def frequency_of(grid: DataFrame, time: str = HOUR) -> Frequency:
    """The frequency that a grid's time column carries; hourly if it carries none."""
    name = grid.schema[time].metadata.get("frequency")
    return Frequency.parse(name) if name else HOURLY


def with_frequency(df: DataFrame, frequency: Frequency, time: str = HOUR) -> DataFrame:
    return df.withColumn(time, F.col(time).alias(time, metadata={"frequency": frequency.name}))


def resample_mean(
    df: DataFrame, keys: list[str], columns: list[str], frequency: Frequency = HOURLY, ts: str = "ts"
) -> DataFrame:
    """One row per period from the first to the last reading of a series, means in its columns.

    Readings are averaged before anything else is done and the means are written once, so a
    series is bounded by the periods it spans and the readings are read once.  The result is laid out:
    positions follow from the period's number, no sort is needed.
    """
    means = materialise(
        df.where(F.col(ts).isNotNull())
        .groupBy(*keys, frequency.number(F.col(ts)).alias("_period"))
        .agg(*[F.avg(c).alias(c) for c in columns]),
        "means",
    )
    spans = means.groupBy(*keys).agg(
        F.min("_period").alias("_first"), F.max("_period").alias("_last")
    )
    chunks = spans.withColumn(
        "_chunk",
        F.explode(F.sequence(_floor_div(F.col("_first"), CHUNK), _floor_div(F.col("_last"), CHUNK))),
    )
    periods = chunks.withColumn(
        "_period",
        F.explode(
            F.sequence(
                F.greatest(F.col("_chunk") * CHUNK, F.col("_first")),
                F.least(F.col("_chunk") * CHUNK + CHUNK - 1, F.col("_last")),
            )
        ),
    ).select(
        *keys,
        "_period",
        (F.col("_period") - F.col("_first")).alias(POS),
        (F.col("_last") - F.col("_first") + 1).alias(SIZE),
    )
    grid = attach(periods, means, [*keys, "_period"])
    return with_frequency(
        grid.select(
            *keys, frequency.start(F.col("_period")).alias(HOUR), POS, SIZE, *columns
        ),
        frequency,
    )
