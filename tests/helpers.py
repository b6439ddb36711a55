import numpy as np
import pandas as pd

from stationlake.operators.ordered import lay_out

KEYS = ["station"]


def frame(spark, rows):
    """Rows of ``(station, t, x)``."""
    return spark.createDataFrame(rows, "station string, t int, x double")


def random_rows(seed=0, sizes=(150, 23, 1, 40), missing=0.3):
    """Stations of different sizes with random gaps; the first holds most rows."""
    rng = np.random.default_rng(seed)
    rows = []
    for i, n in enumerate(sizes):
        x = np.round(rng.normal(20, 5, n), 2)
        gone = rng.random(n) < missing
        if n > 100:
            gone[40:110] = True
            gone[:9] = True
        rows += [(f"s{i}", t, None if g else float(v)) for t, (v, g) in enumerate(zip(x, gone))]
    rng.shuffle(rows)
    return [(str(a), int(b), None if c is None else float(c)) for a, b, c in rows]


def laid(spark, rows, partitions=7):
    return lay_out(frame(spark, rows), KEYS, ["t"], partitions=partitions)


def expected(rows, fn):
    """``fn`` applied by pandas to each station in order."""
    pdf = pd.DataFrame(rows, columns=["station", "t", "x"]).sort_values(["station", "t"])
    out = pdf.groupby("station", group_keys=False)["x"].apply(lambda s: fn(s.astype(float)))
    return pdf.assign(y=out)[["station", "t", "y"]].reset_index(drop=True)


def assert_same(actual, wanted, column="x"):
    got = actual.select("station", "t", column).toPandas().sort_values(["station", "t"])
    got = got.reset_index(drop=True)
    assert len(got) == len(wanted)
    assert list(got["t"]) == list(wanted["t"])
    np.testing.assert_allclose(
        got[column].astype(float).to_numpy(), wanted["y"].astype(float).to_numpy(), atol=1e-9
    )
