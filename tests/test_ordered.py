"""Block-wise work equals station-wide work, whatever the block size."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stationlake.operators import cleaning, features, quality
from stationlake.operators.ordered import exact_quantiles, lay_out, neighbours, over_rows
from tests.helpers import KEYS, assert_same, expected, frame, laid, random_rows

BLOCKS = [3, 10, 1000]


def test_positions_count_each_series(spark):
    rows = random_rows(1)
    got = laid(spark, rows).toPandas().sort_values(["station", "t"])
    assert (got["t"] == got["series_pos"]).all()
    sizes = got.groupby("station")["series_rows"].agg(["min", "max", "size"])
    assert (sizes["min"] == sizes["size"]).all() and (sizes["max"] == sizes["size"]).all()


def test_null_key_is_a_series(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 1)], "station string, t int")
    got = {(r.station, r.t): r.series_pos for r in lay_out(df, KEYS, ["t"], partitions=3).collect()}
    assert got == {(None, 1): 0, (None, 2): 1, ("a", 1): 0}


def test_hot_station_is_spread_over_tasks(spark):
    df = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("s"), F.col("id").cast("string")))
        .otherwise("hot").alias("station"), F.col("id").alias("t"),
    )
    numbered = lay_out(df, KEYS, ["t"], partitions=16)
    stored = spark.read.parquet(*numbered.inputFiles()).filter("station = 'hot'")
    parts = stored.select("_metadata.file_name").distinct().count()
    assert parts >= 8
    hot = numbered.filter("station = 'hot'").agg(
        F.max("series_pos"), F.countDistinct("series_pos"), F.max("series_rows")
    ).first()
    n = df.filter("station = 'hot'").count()
    assert tuple(hot) == (n - 1, n, n)


@pytest.mark.parametrize("block", BLOCKS)
@pytest.mark.parametrize("limit", [1, 6])
def test_ffill(spark, block, limit):
    rows = random_rows(2)
    got = cleaning.ffill(laid(spark, rows), KEYS, ["x"], limit, block_rows=block)
    assert_same(got, expected(rows, lambda s: s.ffill(limit=limit)))


@pytest.mark.parametrize("block", BLOCKS)
def test_bfill(spark, block):
    rows = random_rows(3)
    got = cleaning.bfill(laid(spark, rows), KEYS, ["x"], 24, block_rows=block)
    assert_same(got, expected(rows, lambda s: s.bfill(limit=24)))


def pandas_interpolate(s, limit):
    if s.notna().sum() == 0:
        return s
    return s.interpolate(method="linear", limit=limit, limit_direction="both")


@pytest.mark.parametrize("block", BLOCKS)
@pytest.mark.parametrize("limit", [2, 24])
def test_interpolate(spark, block, limit):
    rows = random_rows(4)
    got = cleaning.interpolate_linear(laid(spark, rows), KEYS, ["x"], limit, block_rows=block)
    assert_same(got, expected(rows, lambda s: pandas_interpolate(s, limit)))


@pytest.mark.parametrize("block", BLOCKS)
def test_carry_and_interpolate_is_fill_then_interpolate(spark, block):
    rows = random_rows(5)
    got = cleaning.carry_and_interpolate(laid(spark, rows), KEYS, ["x"], 6, 24, block_rows=block)
    assert_same(got, expected(rows, lambda s: pandas_interpolate(s.ffill(limit=6), 24)))


def test_long_gap_example(spark):
    values = [None] * 30 + [1.0] + [None] * 70 + [72.0] + [None] * 40
    rows = [("s", t, v) for t, v in enumerate(values)]
    got = cleaning.carry_and_interpolate(laid(spark, rows), KEYS, ["x"], 6, 24, block_rows=20)
    x = [r.x for r in got.orderBy("t").collect()]
    empty = {t for t, v in enumerate(x) if v is None}
    assert empty == {*range(0, 6), *range(61, 77), *range(132, 142)}
    assert x[37] == pytest.approx(1 + 71 / 65)


@pytest.mark.parametrize("block", BLOCKS)
def test_two_columns_do_not_mix(spark, block):
    rows = random_rows(6)
    df = laid(spark, rows).withColumn("z", F.when(F.col("t") % 4 == 0, F.col("t").cast("double")))
    got = cleaning.carry_and_interpolate(df, KEYS, ["x", "z"], 0, 24, block_rows=block)
    assert_same(got, expected(rows, lambda s: pandas_interpolate(s, 24)))
    z = {(r.station, r.t): r.z for r in got.collect()}
    assert z[("s0", 5)] == 5.0 and z[("s0", 149)] == 148.0


@pytest.mark.parametrize("block", BLOCKS)
def test_outliers(spark, block):
    rows = [("a", t, 1e6 if t == 30 else float(t)) for t in range(60)]
    rows += [("b", t, float(t % 5)) for t in range(23)]

    def replace(s):
        roll = s.rolling(24, center=True)
        low, mid, high = (roll.quantile(q) for q in (0.25, 0.5, 0.75))
        far = (s > mid + 3 * (high - low)) | (s < mid - 3 * (high - low))
        return s.where(~far, mid)

    got = cleaning.replace_outliers_rolling_iqr(laid(spark, rows), KEYS, ["x"], 24, 3.0, block)
    assert_same(got, expected(rows, replace))


@pytest.mark.parametrize("block", BLOCKS)
def test_fill_chain(spark, block):
    rows = random_rows(7)
    overall = pd.concat(
        [
            g.sort_values("t")["x"].astype(float).ffill(limit=24).bfill(limit=24)
            for _, g in pd.DataFrame(rows, columns=["station", "t", "x"]).groupby("station")
        ]
    ).mean()

    def chain(s):
        s = s.ffill(limit=24).bfill(limit=24)
        mean = s.mean()
        return s.fillna(overall if np.isnan(mean) else mean)

    got = cleaning.fill_chain(laid(spark, rows), KEYS, ["x"], 24, block_rows=block)
    assert_same(got, expected(rows, chain))


@pytest.mark.parametrize("block", BLOCKS)
def test_rolling_centered(spark, block):
    rows = random_rows(8)
    got = features.rolling_centered(laid(spark, rows), KEYS, "x", 24, block_rows=block)
    wanted = expected(rows, lambda s: s.rolling(24, center=True, min_periods=1).mean())
    assert_same(got, wanted, "x_mean_24")
    wanted = expected(rows, lambda s: s.rolling(24, center=True, min_periods=1).std())
    assert_same(got, wanted, "x_std_24")


@pytest.mark.parametrize("block", BLOCKS)
@pytest.mark.parametrize("rows_in_frame", [4, 30])
def test_rolling_stats(spark, block, rows_in_frame):
    rows = random_rows(9)
    got = features.rolling_stats(laid(spark, rows), KEYS, "x", rows_in_frame, block_rows=block)
    got = got.cache()
    for name in ("mean", "std", "min", "max", "skew", "kurt"):
        wanted = expected(
            rows, lambda s: getattr(s.rolling(rows_in_frame, min_periods=1), name)()
        )
        mine = got.select("station", "t", f"x_{rows_in_frame}_{name}").toPandas()
        mine = mine.sort_values(["station", "t"]).iloc[:, 2].astype(float).to_numpy()
        np.testing.assert_allclose(mine, wanted["y"].to_numpy(), atol=1e-6, err_msg=name)


@pytest.mark.parametrize("block", BLOCKS)
def test_neighbours_cross_empty_blocks(spark, block):
    rows = [("s", t, 5.0 if t in (0, 90) else None) for t in range(100)]
    got = neighbours(laid(spark, rows), KEYS, ["x"], block_rows=block)
    near = {r.t: (r.prev_pos_x, r.next_pos_x) for r in got.collect()}
    assert near[50] == (0, 90) and near[0] == (0, 0) and near[95] == (90, None)


@pytest.mark.parametrize("block", BLOCKS)
def test_lag_over_blocks(spark, block):
    rows = random_rows(10)
    got = over_rows(
        laid(spark, rows), KEYS, 5, 0, lambda w: {"x": F.lag("x", 5).over(w)}, block_rows=block
    )
    assert_same(got, expected(rows, lambda s: s.shift(5)))


def test_exact_quantiles_with_many_equal_values(spark):
    rng = np.random.default_rng(3)
    values = np.round(np.where(rng.random(4000) < 0.4, 0.0, rng.normal(0, 1, 4000)), 2)
    df = frame(spark, [("a", i, float(v)) for i, v in enumerate(values)] + [("b", 0, 7.0)])
    got = {r.station: r for r in exact_quantiles(df, KEYS, "x", {"lo": 0.1, "mid": 0.5, "hi": 0.975}).collect()}
    assert got["a"].lo == pytest.approx(np.quantile(values, 0.1))
    assert got["a"].mid == pytest.approx(np.quantile(values, 0.5))
    assert got["a"].hi == pytest.approx(np.quantile(values, 0.975))
    assert (got["b"].lo, got["b"].hi) == (7.0, 7.0)


@pytest.mark.parametrize("cells", [2, 5, 4096])
def test_exact_quantiles_of_awkward_values(spark, monkeypatch, cells):
    from stationlake.operators import ordered

    monkeypatch.setattr(ordered, "CELLS", cells)
    rng = np.random.default_rng(4)
    series = {
        "wide": np.r_[rng.normal(0, 1, 60), 1e308, -1e308, 1e-300, -1e-300],
        "near": 20 + rng.integers(0, 9, 80) * 1e-12,
        "jump": np.r_[np.zeros(50), np.full(3, 1e6)],
        "one": np.array([3.0]),
        "two": np.array([-1.0, 2.0]),
    }
    rows = [(k, i, float(x)) for k, v in series.items() for i, x in enumerate(v)] + [("none", 0, None)]
    levels = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.77, "e": 1.0}
    got = {r.station: r for r in exact_quantiles(frame(spark, rows), KEYS, "x", levels).collect()}
    assert set(got) == set(series)
    for k, v in series.items():
        for name, level in levels.items():
            at = level * (len(v) - 1)
            low, high = np.sort(v)[[int(np.floor(at)), int(np.ceil(at))]]
            assert got[k][name] == pytest.approx(low + (high - low) * (at - np.floor(at)), rel=1e-12, abs=1e-12), (k, name)
    # endless values have no width to cut; without keys all rows are one series
    odd = frame(spark, [("a", 0, float("inf")), ("a", 1, 1.0), ("a", 2, 2.0)])
    assert exact_quantiles(odd, KEYS, "x", {"m": 0.5, "lo": 0.0}).first()[1:] == (2.0, 1.0)
    assert exact_quantiles(frame(spark, rows[:64]), [], "x", {"m": 0.5}).first().m == pytest.approx(np.quantile(series["wide"], 0.5))


@pytest.mark.parametrize("stride", [1, 3, 8, 20])
def test_sequences(spark, stride):
    rows = random_rows(11, missing=0.0)
    got = features.sliding_sequences(laid(spark, rows), KEYS, ["x"], "x", 8, stride)
    by_station = {
        k: g.sort_values("t")["x"].astype("float32").to_numpy()
        for k, g in pd.DataFrame(rows, columns=["station", "t", "x"]).groupby("station")
    }
    seen = got.collect()
    assert sorted((r.station, r.start_pos) for r in seen) == sorted(
        (k, at) for k, v in by_station.items() for at in range(0, len(v) - 7, stride)
    )
    for r in seen:
        v = by_station[r.station]
        wanted = v[r.start_pos:r.start_pos + 7]
        np.testing.assert_allclose(np.array(r.x)[:, 0], wanted, equal_nan=True)
        np.testing.assert_allclose(r.y if r.y is not None else np.nan, v[r.start_pos + 7])


def test_windows_move_only_their_own_rows(spark):
    rows = [("a", t, float(t)) for t in range(1000)]
    df = laid(spark, rows)
    first, last = features.F.ceil((features.F.col("series_pos") - 7) / 50), features.F.floor(features.F.col("series_pos") / 50)
    spread = df.where(first <= last).count()
    got = features.sliding_sequences(df, KEYS, ["x"], "x", 8, 50)
    assert got.count() == 20 and spread == 20 * 8


@pytest.mark.parametrize("stride", [1, 4, 9])
def test_encoder_decoder_elements(spark, stride):
    rows = random_rows(5, sizes=(60, 11, 3), missing=0.2)
    by_station = {
        k: [x for _, x in sorted((t, x) for s, t, x in rows if s == k)] for k in {r[0] for r in rows}
    }
    got = features.encoder_decoder_windows(laid(spark, rows), KEYS, "x", ["t", "x"], 2, 7, 5, stride)
    found = {(r.station, r.start_pos): r for r in got.collect()}
    assert set(found) == {
        (k, at) for k, v in by_station.items() for at in range(0, len(v), stride) if at >= 2
    }

    def same(a, b):
        np.testing.assert_allclose(
            np.array(a, float), np.array([np.nan if x is None else x for x in b], float).astype("float32")
        )

    for (k, at), r in found.items():
        v = by_station[k]
        same(r.encoder, v[max(0, at - 7) : at])
        same(r.decoder_target, v[at : at + 5])
        same([x[0] for x in r.decoder_known], range(at, min(len(v), at + 5)))
        same([x[1] for x in r.decoder_known], v[at : at + 5])


def test_encoder_decoder(spark):
    rows = [("a", t, float(t)) for t in range(40)] + [("b", t, 0.0) for t in range(5)]
    got = features.encoder_decoder_windows(
        laid(spark, rows), KEYS, "x", ["t"], 4, 10, 6
    ).collect()
    assert {r.start_pos for r in got if r.station == "a"} == set(range(4, 40))
    assert {r.start_pos for r in got if r.station == "b"} == {4}
    one = next(r for r in got if r.station == "a" and r.start_pos == 37)
    assert one.encoder == [float(v) for v in range(27, 37)]
    assert one.decoder_target == [37.0, 38.0, 39.0]
    assert one.decoder_known == [[37.0], [38.0], [39.0]]


@pytest.mark.parametrize("block", BLOCKS)
def test_zscore_outliers(spark, block):
    rows = random_rows(12, missing=0.1)
    got = features.rolling_zscore_outliers(laid(spark, rows), KEYS, "x", 30, 2.0, block_rows=block)
    wanted = expected(
        rows,
        lambda s: (s - s.rolling(30, min_periods=1).mean()) / s.rolling(30, min_periods=1).std(),
    )
    assert_same(got, wanted, "zscore")
    assert got.filter("is_outlier and x is not null").count() == 0


def test_time_gaps_stay_within_station(spark):
    df = spark.sql(
        "select * from values ('a', timestamp_ntz'2024-01-01 00:00:00', 1),"
        "('b', timestamp_ntz'2024-01-01 05:00:00', 2), ('a', timestamp_ntz'2024-01-01 01:00:00', 3),"
        "('a', timestamp_ntz'2024-01-01 03:30:00', 4) as v(station, ts, id)"
    )
    gaps = quality.find_time_gaps(lay_out(df, KEYS, ["ts", "id"]), KEYS, block_rows=2).collect()
    assert [(g.station, g.id, g.gap_seconds) for g in gaps] == [("a", 4, 9000.0)]
