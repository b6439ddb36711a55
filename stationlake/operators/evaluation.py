"""Alignment, metrics, comparison, ensembles and report tables of forecasts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationlake.functions.stats import (
    correlation,
    jarque_bera,
    jarque_bera_p,
    normal_quantile,
    sample_kurtosis,
    sample_skewness,
)
from stationlake.operators.ordered import (
    BLOCK,
    BLOCK_ROWS,
    POS,
    SIZE,
    Blocks,
    attach,
    attach_stored,
    lay_out,
)
from stationlake.schema import METRIC_LIMITS
from stationlake.session import materialise

EPSILON = 2.220446049250313e-16


def align_actual_forecast(actual: DataFrame, forecast: DataFrame, keys: list[str]) -> DataFrame:
    """Actual values and forecasts of the same station and time."""
    return actual.join(forecast, keys, "inner")


def align_models(forecasts: DataFrame, keys: list[str], models: list[str]) -> DataFrame:
    """One column per model; naming the models saves a job."""
    return forecasts.groupBy(*keys).pivot("model", models).agg(F.first("forecast"))


def join_group_mean(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Mean of the group next to every row."""
    means = df.groupBy(*keys).agg(F.avg(column).alias(f"{column}_group_mean"))
    return attach_stored(df, means, keys)


def metric_columns(y: Column, f: Column) -> dict[str, Column]:
    """RMSE, MAE, R² and MAPE as aggregates."""
    e = y - f
    sse, spread = F.sum(e * e), F.var_pop(y) * F.count(e)
    return {
        "rmse": F.sqrt(F.avg(e * e)),
        "mae": F.avg(F.abs(e)),
        "r2": F.when(spread > 0, 1 - F.try_divide(sse, spread)).otherwise(F.when(sse == 0, 1.0).otherwise(0.0)),
        "mape": F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(EPSILON))) * 100,
    }


def _scored(forecasts: DataFrame, actual: str) -> DataFrame:
    return forecasts.filter(F.col(actual).isNotNull() & F.col("forecast").isNotNull())


def forecast_metrics(forecasts: DataFrame, keys: list[str], actual: str) -> DataFrame:
    """Point metrics per key over rows with both values."""
    metrics = metric_columns(F.col(actual), F.col("forecast"))
    return _scored(forecasts, actual).groupBy(*keys).agg(*[e.alias(n) for n, e in metrics.items()])


def interval_columns(actual: str, alpha: float = 0.05) -> dict[str, Column]:
    y, low, high = F.col(actual), F.col("lower_bound"), F.col("upper_bound")
    below, above = F.greatest(low - y, F.lit(0.0)), F.greatest(y - high, F.lit(0.0))
    return {
        "coverage": F.avg(y.between(low, high).cast("double")) * 100,
        "mean_width": F.avg(high - low),
        "interval_score": F.avg((high - low) + 2 / alpha * (below + above)),
    }


def interval_metrics(
    forecasts: DataFrame, keys: list[str], actual: str, alpha: float = 0.05
) -> DataFrame:
    """Coverage in percent (inclusive bounds), mean width and interval score."""
    columns = interval_columns(actual, alpha)
    return _scored(forecasts, actual).groupBy(*keys).agg(*[e.alias(n) for n, e in columns.items()])


REPORTED = ["rmse", "mae", "r2", "mape", "coverage", "mean_width"]


def evaluate_models(forecasts: DataFrame, actual: str, keys: list[str] = ("model",)) -> DataFrame:
    """Point and interval metrics per model in one aggregate."""
    columns = {
        **metric_columns(F.col(actual), F.col("forecast")),
        **interval_columns(actual),
    }
    return _scored(forecasts, actual).groupBy(*keys).agg(*[columns[n].alias(n) for n in REPORTED])


def metrics_long(metrics: DataFrame, names: list[str] = REPORTED) -> DataFrame:
    """``(model, metric, value)`` rows."""
    return metrics.select(
        "model",
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])
        ).alias("_m"),
    ).select("model", "_m.metric", "_m.value")


def metrics_transpose(
    metrics: DataFrame, models: list[str], names: list[str] = REPORTED
) -> DataFrame:
    """Metrics × models from models × metrics."""
    return metrics_long(metrics, names).groupBy("metric").pivot("model", models).agg(F.first("value"))


def compare_models(forecasts: DataFrame, actual: str, models: list[str], digits: int = 4) -> DataFrame:
    """Rounded metrics, one column per model."""
    flipped = metrics_transpose(evaluate_models(forecasts, actual), models)
    return flipped.withColumns({m: F.round(m, digits) for m in models})


def best_model(metrics: DataFrame) -> DataFrame:
    """Model with the lowest RMSE, ties by name."""
    return metrics.agg(
        F.min_by("model", F.struct("rmse", "model")).alias("model"), F.min("rmse").alias("rmse")
    )


def threshold_check(metrics: DataFrame, limits: dict[str, float] = METRIC_LIMITS) -> DataFrame:
    """Pass or fail of every metric against its limit; R² must be at least its limit."""
    checks = {
        f"{n}_ok": (F.col(n) >= limit) if n == "r2" else (F.col(n) <= limit)
        for n, limit in limits.items()
    }
    passed = reduce(lambda a, b: a & b, checks.values())
    return metrics.select("model", *[e.alias(n) for n, e in checks.items()], passed.alias("all_ok"))


def residual_analysis(forecasts: DataFrame, keys: list[str], actual: str) -> DataFrame:
    """Mean, population deviation, and bias-corrected skewness and excess kurtosis."""
    e = F.col(actual) - F.col("forecast")
    grouped = _scored(forecasts, actual).groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("_n"),
        F.avg(e).alias("mean"),
        F.stddev_pop(e).alias("std"),
        F.skewness(e).alias("_g1"),
        F.kurtosis(e).alias("_g2"),
    )
    n = F.col("_n")
    return grouped.select(
        *keys,
        "mean",
        "std",
        sample_skewness(F.col("_g1"), n).alias("skewness"),
        sample_kurtosis(F.col("_g2"), n).alias("kurtosis"),
    )


def residual_diagnostics(
    forecasts: DataFrame, keys: list[str], actual: str, order: list[str], lags: int = 10,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Mean, deviation, Jarque–Bera p-value and Ljung–Box statistic of the residuals.

    Rows that carry positions are not numbered again; others are, by ``order``.  Each block of positions
    gives its sums of powers and of products ``k`` rows apart, centred by its own mean, and its
    first and last ``lags`` residuals; the blocks of a series are then put together exactly.
    """
    scored = _scored(forecasts, actual).withColumn("_e", F.col(actual) - F.col("forecast"))
    if POS in scored.columns:
        laid = scored.select(*keys, POS, "_e")
    else:
        laid = lay_out(scored.select(*keys, *order, "_e"), keys, order)
    blocks = materialise(_residual_blocks(laid, keys, lags, block_rows), "residuals")
    return _ljung_box(_moments_about_mean(blocks, keys, lags), keys, lags)


def _residual_blocks(laid: DataFrame, keys: list[str], lags: int, block_rows: int) -> DataFrame:
    """One row per block: count, mean, central sums, products by lag, first and last residuals."""
    blocks = Blocks.of(laid, keys, block_rows=block_rows)
    whole = Window.partitionBy(*keys, BLOCK)
    w = blocks.window
    rows = blocks.df.withColumns(
        {
            "_c": F.col("_e") - F.avg("_e").over(whole),
            "_i": F.row_number().over(w),
            "_n": F.count(F.lit(1)).over(whole),
        }
    )
    back = {f"_l{k}": F.lag("_c", k).over(w) for k in range(1, lags + 1)}
    entry = F.struct("_i", "_e")
    at_end = F.col("_n") - F.col("_i") < lags

    def listed(where):
        return F.transform(F.sort_array(F.collect_list(F.when(where, entry))), lambda r: r["_e"])

    c = F.col("_c")
    return rows.withColumns(back).groupBy(*keys, BLOCK).agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg("_e").alias("_mean"),
        *[F.sum(reduce(lambda a, b: a * b, [c] * p)).alias(f"_p{p}") for p in (2, 3, 4)],
        F.array(*[F.coalesce(F.sum(c * F.col(f"_l{k}")), F.lit(0.0)) for k in range(1, lags + 1)]).alias("_products"),
        listed(F.col("_i") <= lags).alias("_first"),
        listed(at_end).alias("_last"),
    )


def _moments_about_mean(blocks: DataFrame, keys: list[str], lags: int) -> DataFrame:
    """Count, mean and, about the mean of the whole series, sums of powers and of lagged products."""
    series = Window.partitionBy(*keys)
    # a block has a residual, so the last ``lags`` before it lie in that many blocks
    earlier = series.orderBy(BLOCK).rowsBetween(-lags, -1)
    mean = F.sum(F.col("_n") * F.col("_mean")).over(series) / F.sum("_n").over(series)
    found = blocks.withColumns(
        {"_all": mean, "_before": F.flatten(F.collect_list("_last").over(earlier))}
    ).withColumn("_d", F.col("_mean") - F.col("_all"))
    d, n = F.col("_d"), F.col("_n").cast("double")

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x - F.col("_mean"))

    def about(k: int) -> Column:
        # pairs inside the block, moved from its mean to that of the series
        pairs = F.greatest(n - k, F.lit(0.0))
        head = total(F.slice("_first", 1, k))
        size = F.least(F.size("_last"), F.lit(k))
        tail = total(F.slice("_last", F.size("_last") - size + 1, size))
        inside = F.col("_products")[k - 1] - d * (head + tail) + pairs * d * d
        # pairs of one of its first residuals and one before the block
        across = F.aggregate(
            F.sequence(F.lit(1), F.least(F.lit(k), F.size("_first"))),
            F.lit(0.0),
            lambda a, i: a
            + F.coalesce(
                (F.get("_first", i - 1) - F.col("_all"))
                * (F.get("_before", F.size("_before") - (k - i + 1)) - F.col("_all")),
                F.lit(0.0),
            ),
        )
        return F.when(pairs > 0, inside).otherwise(0.0) + across

    p2, p3, p4 = (F.col(f"_p{p}") for p in (2, 3, 4))
    return found.groupBy(*keys).agg(
        F.sum("_n").cast("double").alias("n"),
        F.max("_all").alias("mean"),
        F.sum(p2 + n * d * d).alias("_s2"),
        F.sum(p3 + 3 * d * p2 + n * d * d * d).alias("_s3"),
        F.sum(p4 + 4 * d * p3 + 6 * d * d * p2 + n * d * d * d * d).alias("_s4"),
        *[F.sum(about(k)).alias(f"_r{k}") for k in range(1, lags + 1)],
    )


def _ljung_box(moments: DataFrame, keys: list[str], lags: int) -> DataFrame:
    n, variance = F.col("n"), F.col("_s2") / F.col("n")
    skewness = F.try_divide(F.col("_s3") / n, F.pow(variance, F.lit(1.5)))
    kurtosis = F.try_divide(F.col("_s4") / n, variance * variance) - 3
    correlations = [
        F.coalesce(F.try_divide(F.col(f"_r{k}"), F.col("_s2")), F.lit(0.0)) for k in range(1, lags + 1)
    ]
    parts = [F.coalesce(F.try_divide(r * r, n - k), F.lit(0.0)) for k, r in enumerate(correlations, 1)]
    return moments.select(
        *keys,
        "mean",
        F.sqrt(variance).alias("std"),
        jarque_bera_p(jarque_bera(skewness, kurtosis, n)).alias("jarque_bera_p"),
        (n * (n + 2) * reduce(lambda a, b: a + b, parts)).alias("ljung_box"),
    )


def ensemble_weights(metrics: DataFrame) -> DataFrame:
    """Weights proportional to 1/RMSE that sum to one."""
    inverse = metrics.select("model", (1 / F.greatest("rmse", F.lit(EPSILON))).alias("_inverse"))
    # one row per model
    total = inverse.agg(F.sum("_inverse").alias("_total"))
    return inverse.crossJoin(F.broadcast(total)).select(
        "model", (F.col("_inverse") / F.col("_total")).alias("weight")
    )


def ensemble_forecast(forecasts: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted mean of the models; bounds are the outer percentiles of their bounds.

    Where a model has no forecast, the weights of the others are scaled up.
    """
    weighted = attach_stored(forecasts, weights, ["model"], "inner")
    return weighted.groupBy(*keys).agg(
        (F.sum(F.col("weight") * F.col("forecast")) / F.sum("weight")).alias("forecast"),
        F.percentile("lower_bound", 0.025).alias("lower_bound"),
        F.percentile("upper_bound", 0.975).alias("upper_bound"),
    )


def model_agreement(forecasts: DataFrame, keys: list[str]) -> DataFrame:
    """Deviation across models and their mean per time."""
    return forecasts.groupBy(*keys).agg(
        F.stddev_samp("forecast").alias("std"), F.avg("forecast").alias("mean")
    )


def model_differences(forecasts: DataFrame, keys: list[str], models: list[str]) -> DataFrame:
    """Mean absolute difference of every pair of models, with 0 on the diagonal.

    The models of a time are put side by side by one aggregate, so no join of the
    forecasts with themselves is needed.
    """
    wide = align_models(forecasts, keys, models)
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i + 1:]]
    sums = wide.agg(*[F.avg(F.abs(F.col(a) - F.col(b))).alias(f"{a}|{b}") for a, b in pairs])
    cells = [(a, b, F.col(f"{a}|{b}")) for a, b in pairs]
    cells += [(b, a, c) for a, b, c in cells]
    cells += [(m, m, F.lit(0.0)) for m in models]
    return sums.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), c.alias("difference")
                    )
                    for a, b, c in cells
                ]
            )
        ).alias("_c")
    ).select("_c.*")


def interval_width_series(forecasts: DataFrame, keys: list[str]) -> DataFrame:
    return forecasts.select(
        *keys, "model", (F.col("upper_bound") - F.col("lower_bound")).alias("width")
    )


def forecast_after(forecasts: DataFrame, ts: str, start) -> DataFrame:
    """Predictions from ``start`` on."""
    return forecasts.filter(F.col(ts) >= start)


def history_before(rows: DataFrame, ts: str, start) -> DataFrame:
    return rows.filter(F.col(ts) < start)


def qq_points(
    forecasts: DataFrame, keys: list[str], actual: str, row_id: list[str]
) -> DataFrame:
    """Ordered residuals against normal quantiles of evenly spaced probabilities."""
    residuals = _scored(forecasts, actual).select(
        *keys, *row_id, (F.col(actual) - F.col("forecast")).alias("residual")
    )
    laid = lay_out(residuals, keys, ["residual", *row_id])
    p = (F.col(POS) + 0.5) / F.col(SIZE)
    return laid.select(
        *keys,
        *row_id,
        (F.col(POS) + 1).alias("rank"),
        "residual",
        normal_quantile(p).alias("theoretical"),
    )


def rank_importance(
    df: DataFrame, keys: list[str], features: list[str], target: str
) -> DataFrame:
    """Features by absolute correlation with the target, largest first."""
    counted = df.groupBy(*keys).agg(*[F.abs(correlation(F.col(f), F.col(target))).alias(f) for f in features])
    # one row per key and feature
    long = counted.select(
        *keys,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(f).alias("feature"), F.coalesce(F.col(f), F.lit(0.0)).alias("importance"))
                    for f in features
                ]
            )
        ).alias("_f"),
    ).select(*keys, "_f.*")
    w = Window.partitionBy(*keys).orderBy(F.col("importance").desc(), "feature")
    return long.withColumn("rank", F.row_number().over(w))
