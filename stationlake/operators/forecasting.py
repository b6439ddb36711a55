"""Forecasts of many stations at once.

A seasonal autoregression is a linear regression on lagged, differenced values.
Its sufficient statistics (sums of products) are Spark aggregates, so a station
may have any number of readings; Python only solves the small systems, many
stations per Arrow batch, and runs the recursion over the last few values.
"""

from __future__ import annotations

from dataclasses import dataclass
import warnings
from functools import partial, reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationlake.operators.ordered import (
    BLOCK_ROWS,
    POS,
    SIZE,
    Blocks,
    attach,
    attach_stored,
    exact_quantiles,
    over_rows,
)
from stationlake.operators.periods import HOUR, Frequency, frequency_of
from stationlake.session import materialise

FORECAST_COLUMNS = ["model", "forecast", "lower_bound", "upper_bound"]
Z95 = 1.96
#: Values of a horizon that one Python batch holds.
HELD_VALUES = 2_000_000


@dataclass(frozen=True)
class Order:
    """p lags and d differences, P seasonal lags and D seasonal differences of period s."""

    p: int = 1
    d: int = 0
    P: int = 0
    D: int = 0
    s: int = 24

    @property
    def lags(self) -> list[int]:
        return sorted({*range(1, self.p + 1), *(self.s * i for i in range(1, self.P + 1))})

    @property
    def name(self) -> str:
        return f"({self.p},{self.d})({self.P},{self.D},{self.s})"

    @property
    def memory(self) -> int:
        """Rows of history that one step needs."""
        return self.d + self.s * self.D + max(self.lags, default=0)

    def difference(self) -> dict[int, int]:
        """Coefficient of each lag in (1−B)^d (1−B^s)^D."""
        taps = {0: 1}
        for step in [1] * self.d + [self.s] * self.D:
            shifted = {lag + step: -c for lag, c in taps.items()}
            taps = {k: taps.get(k, 0) + shifted.get(k, 0) for k in {*taps, *shifted}}
        return {k: c for k, c in sorted(taps.items()) if c}


def param_grid(
    p=(0, 1, 2), d=(0, 1), P=(0, 1), D=(0, 1), s=(12, 24)
) -> list[Order]:
    """Cross product of orders and seasonal orders; a point without a lag is a mean model."""
    return [Order(*point) for point in product(p, d, P, D, s)]


def param_grid_frame(spark, grid: list[Order]) -> DataFrame:
    rows = [(o.name, o.p, o.d, o.P, o.D, o.s) for o in grid]
    return spark.createDataFrame(rows, "order_name string, p int, d int, P_ int, D_ int, s int")


def _differenced(column: str, order: Order, w) -> Column:
    terms = [
        (F.col(column) if lag == 0 else F.lag(column, lag).over(w)) * c
        for lag, c in order.difference().items()
    ]
    return reduce(lambda a, b: a + b, terms)


def _lag_names(lags: list[int]) -> list[str]:
    return [f"_x{lag}" for lag in lags]


def lagged(
    grid: DataFrame, keys: list[str], column: str, order: Order, lags: list[int],
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Adds ``_w`` (differenced value) and ``_x<lag>`` (its lags); NULL without history."""
    reach = order.d + order.s * order.D + max(lags, default=0)
    blocks = Blocks.of(grid, keys, reach, 0, block_rows)
    blocks = blocks.with_columns({"_w": _differenced(column, order, blocks.window)})
    lagging = {n: F.lag("_w", lag).over(blocks.window) for n, lag in zip(_lag_names(lags), lags)}
    return (blocks.with_columns(lagging) if lagging else blocks).home()


def _products(lags: list[int]) -> dict[str, Column]:
    """Sums of products of (1, x…, w): the upper triangle of the moment matrix."""
    names = ["_one", *_lag_names(lags), "_w"]
    return {
        f"m_{i}_{j}": F.sum(F.col(a) * F.col(b))
        for i, a in enumerate(names)
        for j, b in enumerate(names)
        if j >= i
    }


def _moment_arrays(batch: pd.DataFrame, size: int, prefix: str = "m_") -> np.ndarray:
    out = np.zeros((len(batch), size, size))
    for i in range(size):
        for j in range(i, size):
            out[:, i, j] = out[:, j, i] = batch[f"{prefix}{i}_{j}"].to_numpy(float)
    return out


def _solve(moments: np.ndarray, use: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and residual sum of squares of regressing the last column on ``use``."""
    a = moments[:, use][:, :, use]
    b = moments[:, use, -1]
    beta = np.einsum("nij,nj->ni", np.linalg.pinv(a, rcond=1e-12, hermitian=True), b)
    sse = (
        moments[:, -1, -1]
        - 2 * np.einsum("ni,ni->n", beta, b)
        + np.einsum("ni,nij,nj->n", beta, a, beta)
    )
    return beta, np.maximum(sse, 0.0)


def _known(values: np.ndarray, there: np.ndarray) -> list[float | None]:
    return [float(v) if t else None for v, t in zip(values, there)]


def fit_seasonal_ar(
    grid: DataFrame, keys: list[str], column: str, order: Order, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Per station: intercept and lag coefficients, residual deviation, AIC and BIC.

    A station with no more rows than coefficients has no deviation, no AIC and no BIC.
    """
    lags = order.lags
    rows = lagged(grid, keys, column, order, lags, block_rows).withColumn("_one", F.lit(1.0))
    complete = reduce(
        lambda a, b: a & b, [F.col(n).isNotNull() for n in ["_w", *_lag_names(lags)]]
    )
    moments = rows.filter(complete).groupBy(*keys).agg(*[e.alias(n) for n, e in _products(lags).items()])
    size = len(lags) + 2
    schema = T.StructType(
        [grid.schema[k] for k in keys]
        + [
            T.StructField("order_name", T.StringType()),
            T.StructField("n", T.LongType()),
            T.StructField("intercept", T.DoubleType()),
            T.StructField("coefficients", T.ArrayType(T.DoubleType())),
            T.StructField("sigma", T.DoubleType()),
            T.StructField("aic", T.DoubleType()),
            T.StructField("bic", T.DoubleType()),
        ]
    )
    name = order.name

    def solve(batches):
        for batch in batches:
            if batch.empty:
                continue
            m = _moment_arrays(batch, size)
            beta, sse = _solve(m, list(range(size - 1)))
            n = m[:, 0, 0]
            k = size - 1
            log_likelihood = -0.5 * n * (np.log(2 * np.pi * np.maximum(sse, 1e-12) / n) + 1)
            out = batch[keys].copy()
            out["order_name"] = name
            out["n"] = n.astype("int64")
            out["intercept"] = beta[:, 0]
            out["coefficients"] = [list(b[1:]) for b in beta]
            free = n > k
            out["sigma"] = _known(np.sqrt(sse / np.maximum(n - k, 1)), free)
            out["aic"] = _known(2 * (k + 1) - 2 * log_likelihood, free)
            out["bic"] = _known(np.log(n) * (k + 1) - 2 * log_likelihood, free)
            yield out

    return moments.mapInPandas(solve, schema)


@dataclass(frozen=True)
class Differencing:
    """Orders with the same differencing: they share one moment matrix of all their lags."""

    d: int
    D: int
    s: int
    members: tuple[Order, ...]

    @property
    def lags(self) -> list[int]:
        return sorted({lag for o in self.members for lag in o.lags})

    @property
    def taps(self) -> dict[int, int]:
        return Order(0, self.d, 0, self.D, self.s).difference()

    @property
    def size(self) -> int:
        return len(self.lags) + 2

    def names(self, i: int) -> list[str]:
        return [f"_{i}x{lag}" for lag in self.lags]


def _differencings(orders: list[Order]) -> list[Differencing]:
    shared: dict[tuple[int, int, int], list[Order]] = {}
    for o in orders:
        shared.setdefault((o.d, o.D, o.s), []).append(o)
    return [Differencing(*key, tuple(members)) for key, members in shared.items()]


def _all_moments(
    grid: DataFrame, keys: list[str], column: str, groups: list[Differencing], folds: int, gap: int,
    block_rows: int,
) -> DataFrame:
    """Moment matrices of every differencing, per station and part of the folds, in one pass."""
    reach = max(max(g.taps) + max(g.lags, default=0) for g in groups)
    blocks = Blocks.of(grid.select(*keys, POS, SIZE, column), keys, reach, 0, block_rows)
    w = blocks.window
    # what several differencings lag is lagged once
    back = sorted({lag for g in groups for lag in g.taps if lag})
    blocks = blocks.with_columns({f"_y{lag}": F.lag(column, lag).over(w) for lag in back})

    def differenced(g):
        terms = [F.col(f"_y{lag}" if lag else column) * c for lag, c in g.taps.items()]
        return reduce(lambda a, b: a + b, terms)

    blocks = blocks.with_columns({f"_w{i}": differenced(g) for i, g in enumerate(groups)})
    lagging = {
        name: F.lag(f"_w{i}", lag).over(w)
        for i, g in enumerate(groups)
        for name, lag in zip(g.names(i), g.lags)
    }
    rows = (blocks.with_columns(lagging) if lagging else blocks).home()
    size = F.floor(F.col(SIZE) / (folds + 1))
    head = F.col(SIZE) - folds * size
    # segment 0 is the first training part, segment i the test block of fold i
    segment = F.when(F.col(POS) < head, F.lit(0)).otherwise(
        F.floor((F.col(POS) - head) / size).cast("int") + 1
    )
    # a row is trained on from the fold whose test block begins at least ``gap`` rows later
    first = F.greatest(F.lit(1), F.floor((F.col(POS) + gap - head) / size).cast("int") + 2)
    sums = []
    for i, g in enumerate(groups):
        names = [*g.names(i), f"_w{i}"]
        there = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])
        factors = [F.lit(1.0), *[F.col(n) for n in names]]
        sums += [
            F.sum(F.when(there, factors[a] * factors[b])).alias(f"m{i}_{a}_{b}")
            for a in range(g.size)
            for b in range(a, g.size)
        ]
    return (
        rows.filter(size > 0)
        .withColumn("_segment", segment)
        .withColumn("_first", first)
        .groupBy(*keys, "_segment", "_first")
        .agg(*sums)
    )


def grid_search_cv(
    grid: DataFrame, keys: list[str], column: str, orders: list[Order], folds: int = 3,
    gap: int = 0, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """RMSE of every order on expanding-window folds, averaged over the folds, per station.

    Orders with the same differencing share one moment matrix of all lags; a smaller order is
    a part of it.  The matrices of all differencings come from one pass over blocks of the readings.
    A fold trains on the sum of the matrices of the earlier segments and is scored from the matrix
    of its own segment.
    """
    groups = _differencings(orders)
    moments = materialise(_all_moments(grid, keys, column, groups, folds, gap, block_rows), "moments")
    names = [c for c in moments.columns if c.startswith("m") and c not in keys]
    # a few small rows per station and fold
    train = (
        moments.select(
            *keys,
            F.explode(F.sequence(F.col("_first"), F.greatest("_first", F.lit(folds)))).alias("fold"),
            *names,
        )
        .filter(F.col("fold") <= folds)
        .groupBy(*keys, "fold")
        .agg(*[F.sum(n).alias(n) for n in names])
    )
    test = (
        moments.filter("_segment >= 1")
        .groupBy(*keys, F.col("_segment").alias("fold"))
        .agg(*[F.sum(n).alias(f"t{n}") for n in names])
    )
    both = attach(train, test, [*keys, "fold"], "inner")
    scores = both.mapInPandas(
        partial(_score_orders, keys=keys, groups=groups),
        T.StructType(
            [grid.schema[k] for k in keys]
            + [
                T.StructField("order_name", T.StringType()),
                T.StructField("rmse", T.DoubleType()),
            ]
        ),
    )
    # a station that no fold could score is there too, with no order and no folds
    stations = moments.select(*keys).unionByName(grid.select(*keys)).distinct()
    scored = scores.groupBy(*keys, "order_name").agg(
        F.avg("rmse").alias("rmse"), F.count(F.lit(1)).alias("folds")
    )
    return attach(stations, materialise(scored, "scores"), keys).withColumn(
        "folds", F.coalesce("folds", F.lit(0).cast("long"))
    )


def _score_orders(batches, keys: list[str], groups: list[Differencing]):
    for batch in batches:
        for i, g in enumerate(groups):
            # a fold without complete rows on either side scores no order of the differencing
            usable = batch[(batch[f"m{i}_0_0"] > 0) & (batch[f"tm{i}_0_0"] > 0)]
            if usable.empty:
                continue
            fit = _moment_arrays(usable, g.size, f"m{i}_")
            held = _moment_arrays(usable, g.size, f"tm{i}_")
            for o in g.members:
                use = [0, *[1 + g.lags.index(lag) for lag in o.lags]]
                beta, _ = _solve(fit, use)
                a, b = held[:, use][:, :, use], held[:, use, -1]
                sse = (
                    held[:, -1, -1]
                    - 2 * np.einsum("ni,ni->n", beta, b)
                    + np.einsum("ni,nij,nj->n", beta, a, beta)
                )
                out = usable[keys].copy()
                out["order_name"] = o.name
                out["rmse"] = np.sqrt(np.maximum(sse, 0.0) / held[:, 0, 0])
                yield out


def best_order(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Order with the lowest mean RMSE per station."""
    return scores.groupBy(*keys).agg(
        F.min_by("order_name", F.struct("rmse", "order_name")).alias("order_name"),
        F.min("rmse").alias("rmse"),
    )


def predict_in_sample(
    grid: DataFrame, keys: list[str], column: str, fitted: DataFrame, order: Order,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One-step predictions with 95 % bounds where there is enough history."""
    lags = order.lags
    rows = attach_stored(
        lagged(grid, keys, column, order, lags, block_rows),
        fitted.select(*keys, "intercept", "coefficients", "sigma"),
        keys,
    )
    step = reduce(
        lambda a, b: a + b,
        [F.col("intercept")]
        + [F.col("coefficients")[i] * F.col(n) for i, n in enumerate(_lag_names(lags))],
    )
    # forecast of the value itself: the known past of the differencing is added back
    forecast = step + (F.col(column) - F.col("_w"))
    half = Z95 * F.col("sigma")
    return (
        rows.withColumn("forecast", forecast)
        .filter(F.col("forecast").isNotNull())
        .withColumns(
            {
                "model": F.lit(order.name),
                "lower_bound": F.col("forecast") - half,
                "upper_bound": F.col("forecast") + half,
            }
        )
        .select(*keys, HOUR, POS, column, *FORECAST_COLUMNS)
    )


def forecast_horizon(
    grid: DataFrame, keys: list[str], column: str, fitted: DataFrame, order: Order, steps: int,
    unit: str | None = None,
) -> DataFrame:
    """``steps`` future periods of the grid per station by recursion over the last few values.

    The calendar is the grid's own (`frequency_of`); a ``unit`` that differs from it is an error.
    Only the last ``order.memory`` values of a station leave the JVM.  ``status`` is ``ok``; a
    station that can't be forecast has one row that says why: ``gap at the end`` if one of
    those values is missing, ``no model`` if ``fitted`` has none for it, ``too short`` if it has no
    deviation of residuals.
    """
    frequency = frequency_of(grid)
    if unit is not None and Frequency.parse(unit) != frequency:
        raise ValueError(f"the grid has a period of {frequency.name}, not {unit}")
    memory = max(order.memory, 1)
    tail = (
        grid.filter(F.col(POS) >= F.col(SIZE) - memory)
        .groupBy(*keys)
        .agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct(F.col(POS), F.col(column).alias("v")))),
                lambda r: r["v"],
            ).alias("tail"),
            F.max(HOUR).alias("_end"),
        )
    )
    models = fitted.select(*keys, "intercept", "coefficients", "sigma")
    whole = (F.size("tail") == memory) & ~F.exists("tail", lambda v: v.isNull())
    status = (
        F.when(~whole, "gap at the end")
        .when(F.col("intercept").isNull(), "no model")
        .when(F.col("sigma").isNull(), "too short")
        .otherwise("ok")
    )
    every = materialise(attach(tail, models, keys, "left").withColumn("status", status), "tails")
    state = every.filter("status = 'ok'")
    lags = order.lags
    taps = order.difference()
    schema = T.StructType(
        [grid.schema[k] for k in keys]
        + [
            T.StructField("_end", T.TimestampNTZType()),
            T.StructField("forecasts", T.ArrayType(T.DoubleType())),
            T.StructField("spreads", T.ArrayType(T.DoubleType())),
        ]
    )

    def parts(batches):
        # few enough stations that their steps fit in memory
        most = max(1, HELD_VALUES // max(1, steps))
        for batch in batches:
            for start in range(0, len(batch), most):
                yield batch.iloc[start : start + most].reset_index(drop=True)

    def recurse(batches):
        for batch in parts(batches):
            history = np.stack(batch["tail"].to_numpy()).astype(float)
            beta = np.array([list(c) for c in batch["coefficients"]], dtype=float).reshape(
                len(batch), len(lags)
            )
            intercept = batch["intercept"].to_numpy(float)
            sigma = batch["sigma"].to_numpy(float)
            reach = max(taps)
            values = np.concatenate([history, np.zeros((len(batch), steps))], axis=1)
            start = history.shape[1]
            # weights of past shocks in a later value, for the width of the bounds
            shocks = np.zeros((len(batch), steps))

            def diff(at: int) -> np.ndarray:
                return sum(c * values[:, at - k] for k, c in taps.items())

            full = {k: -c for k, c in taps.items() if k}
            weights = np.zeros((len(batch), max([*lags, 0]) + reach + 1))
            for k, c in full.items():
                weights[:, k] += c
            for i, lag in enumerate(lags):
                for k, c in taps.items():
                    weights[:, lag + k] += beta[:, i] * c
            for step in range(steps):
                at = start + step
                w = intercept + sum(
                    (beta[:, i] * diff(at - lag) for i, lag in enumerate(lags)),
                    np.zeros(len(batch)),
                )
                values[:, at] = w - sum(
                    (c * values[:, at - k] for k, c in taps.items() if k), np.zeros(len(batch))
                )
                shocks[:, step] = 1.0 if step == 0 else 0.0
                for back in range(1, min(step, weights.shape[1] - 1) + 1):
                    shocks[:, step] += weights[:, back] * shocks[:, step - back]
            spread = sigma[:, None] * np.sqrt(np.cumsum(shocks**2, axis=1))
            out = batch[[*keys, "_end"]].copy()
            out["forecasts"] = list(values[:, start:])
            out["spreads"] = list(spread)
            yield out

    known = (
        state.drop("status").mapInPandas(recurse, schema)
        .select(
            *keys, "_end", F.posexplode(F.arrays_zip("forecasts", "spreads")).alias("_step", "_f")
        )
        .select(
            *keys,
            frequency.later(F.col("_end"), F.col("_step") + 1).alias(HOUR),
            F.lit(order.name).alias("model"),
            F.col("_f.forecasts").alias("forecast"),
            (F.col("_f.forecasts") - Z95 * F.col("_f.spreads")).alias("lower_bound"),
            (F.col("_f.forecasts") + Z95 * F.col("_f.spreads")).alias("upper_bound"),
            F.lit("ok").alias("status"),
        )
    )
    without = every.filter("status <> 'ok'").select(*keys, F.lit(order.name).alias("model"), "status")
    return known.unionByName(without, allowMissingColumns=True)


def _with_bounds(rows: DataFrame, keys: list[str], column: str, model: str) -> DataFrame:
    """Bounds from the deviation of the residuals of the station."""
    known = rows.filter(F.col("forecast").isNotNull())
    spread = known.groupBy(*keys).agg(
        F.stddev_pop(F.col(column) - F.col("forecast")).alias("_sigma")
    )
    half = Z95 * F.col("_sigma")
    return (
        attach_stored(known, spread, keys)
        .withColumns(
            {
                "model": F.lit(model),
                "lower_bound": F.col("forecast") - half,
                "upper_bound": F.col("forecast") + half,
            }
        )
        .select(*keys, HOUR, POS, column, *FORECAST_COLUMNS)
    )


def seasonal_naive(
    grid: DataFrame, keys: list[str], column: str, season: int = 24, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The value one season ago."""
    rows = over_rows(
        grid, keys, season, 0, lambda w: {"forecast": F.lag(column, season).over(w)}, block_rows
    )
    return _with_bounds(rows, keys, column, "seasonal_naive")


def moving_average(
    grid: DataFrame, keys: list[str], column: str, rows: int = 24, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The mean of the ``rows`` rows before."""
    averaged = over_rows(
        grid, keys, rows, 0,
        lambda w: {"forecast": F.avg(column).over(w.rowsBetween(-rows, -1))}, block_rows,
    )
    return _with_bounds(averaged, keys, column, "moving_average")


def persistence(
    grid: DataFrame, keys: list[str], column: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The value one row ago."""
    rows = over_rows(grid, keys, 1, 0, lambda w: {"forecast": F.lag(column).over(w)}, block_rows)
    return _with_bounds(rows, keys, column, "persistence")


def seasonal_naive_horizon(
    grid: DataFrame, keys: list[str], column: str, steps: int, season: int = 24
) -> DataFrame:
    """Future periods of the grid repeat the last season: a join on the position within it."""
    last = grid.filter(F.col(POS) >= F.col(SIZE) - season).select(
        *keys, (F.col(POS) - F.col(SIZE) + season).cast("int").alias("_phase"),
        F.col(column).alias("forecast"),
    )
    ends = grid.groupBy(*keys).agg(F.max(HOUR).alias("_end"))
    future = ends.select(*keys, "_end", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    future = future.withColumn("_phase", (F.col("step") - 1) % season)
    return attach(future, last, [*keys, "_phase"]).select(
        *keys,
        frequency_of(grid).later(F.col("_end"), F.col("step")).alias(HOUR),
        "step",
        "forecast",
    )


def mc_interval(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and 1.96 population deviations around it over the samples of a step."""
    grouped = samples.groupBy(*keys).agg(
        F.avg(value).alias("forecast"), F.stddev_pop(value).alias("_std")
    )
    return grouped.select(
        *keys,
        "forecast",
        (F.col("forecast") - Z95 * F.col("_std")).alias("lower_bound"),
        (F.col("forecast") + Z95 * F.col("_std")).alias("upper_bound"),
    )


def quantile_interval(
    forecasts: DataFrame, keys: list[str], actual: str, low: float = 0.1, high: float = 0.9
) -> DataFrame:
    """Bounds from residual quantiles per key, added to the point forecast."""
    residuals = forecasts.withColumn("_residual", F.col(actual) - F.col("forecast"))
    quantiles = exact_quantiles(residuals, keys, "_residual", {"_low": low, "_high": high})
    return (
        attach_stored(forecasts, quantiles, keys)
        .withColumn("lower_bound", F.col("forecast") + F.col("_low"))
        .withColumn("upper_bound", F.col("forecast") + F.col("_high"))
        .drop("_low", "_high")
    )


MODELS = {
    "seasonal_naive": seasonal_naive,
    "moving_average": moving_average,
    "persistence": persistence,
}


def run_models(
    grid: DataFrame, keys: list[str], column: str, models: dict | None = None
) -> DataFrame:
    """Predictions of every model as one long frame; the default ones in one pass.

    Of models given by name, one that fails is left out with a warning that says why, see
    `run_each`; if all fail, it is an error.
    """
    if models is None:
        return default_models(grid, keys, column)
    frames, failures = try_models(grid, keys, column, models)
    reasons = "; ".join(f"{name}: {reason}" for name, reason in failures.items())
    if not frames:
        raise ValueError("no model could be run: " + reasons)
    if failures:
        warnings.warn(f"models left out: {reasons}", stacklevel=2)
    return reduce(DataFrame.unionByName, frames.values())


def run_each(
    grid: DataFrame, keys: list[str], column: str, models: dict
) -> tuple[DataFrame | None, DataFrame]:
    """Predictions of the models that ran, and one row ``(model, ok, reason)`` for each.

    Every model is planned, run and written by itself, so one that fails, be it in a task on some
    station, leaves the others alone.  Without a model that ran there are no predictions.
    """
    frames, failures = try_models(grid, keys, column, models)
    status = grid.sparkSession.createDataFrame(
        [(name, name in frames, failures.get(name)) for name in models],
        "model string, ok boolean, reason string",
    )
    return (reduce(DataFrame.unionByName, frames.values()) if frames else None), status


def try_models(
    grid: DataFrame, keys: list[str], column: str, models: dict
) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Written predictions of the models that ran, and the reasons of the others, by name."""
    frames, failures = {}, {}
    for name, model in models.items():
        try:
            frames[name] = materialise(
                model(grid, keys, column).withColumn("model", F.lit(name)), "model"
            )
        except Exception as error:  # isolate one model's failure from the others
            failures[name] = (str(error).splitlines() or [type(error).__name__])[0]
    return frames, failures


def default_models(
    grid: DataFrame, keys: list[str], column: str, season: int = 24, rows: int = 24,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The three models of `MODELS` with one shuffle of the rows and one of their residuals."""

    def forecasts(w):
        return {
            "seasonal_naive": F.lag(column, season).over(w),
            "moving_average": F.avg(column).over(w.rowsBetween(-rows, -1)),
            "persistence": F.lag(column).over(w),
        }

    wide = over_rows(grid, keys, max(season, rows), 0, forecasts, block_rows)
    each = F.array(
        *[F.struct(F.lit(m).alias("model"), F.col(m).alias("forecast")) for m in MODELS]
    )
    long = wide.select(*keys, HOUR, POS, column, F.inline(each)).filter("forecast is not null")
    long = materialise(long, "model-rows")
    spread = long.groupBy(*keys, "model").agg(
        F.stddev_pop(F.col(column) - F.col("forecast")).alias("_sigma")
    )
    half = Z95 * F.col("_sigma")
    return (
        attach_stored(long, spread, [*keys, "model"])
        .withColumns(
            {"lower_bound": F.col("forecast") - half, "upper_bound": F.col("forecast") + half}
        )
        .select(*keys, HOUR, POS, column, *FORECAST_COLUMNS)
    )


def latest_version(runs: DataFrame, keys: list[str], run_ts: str = "run_ts") -> DataFrame:
    """Row of the newest run per name."""
    others = [c for c in runs.columns if c not in keys]
    newest = runs.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(run_ts)).alias("_r"))
    return newest.select(*keys, "_r.*")


def version_exists(runs: DataFrame, name: str, version) -> bool:
    return not runs.filter((F.col("name") == name) & (F.col("run_ts") == version)).isEmpty()
