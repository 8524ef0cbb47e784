"""Rolling-origin backtest against a refit from scratch at every origin."""

import numpy as np
import pandas as pd
import pytest

from tidewatch.operators.backtest import rolling_origin


def refit(g):
    """Forecasts of one sorted series by least squares on all rows before each day."""
    out = {}
    days = (pd.to_datetime(g["date"]) - pd.Timestamp("2024-01-01")).dt.days.to_numpy(float)
    dow, y = pd.to_datetime(g["date"]).dt.weekday.to_numpy(), g["value"].to_numpy(float)
    for i in range(21, len(y)):
        x = np.column_stack([days[:i], *[(dow[:i] == d).astype(float) for d in range(7)]])
        fit, *_ = np.linalg.lstsq(x, y[:i], rcond=None)
        m = y[:i].mean()
        z = y[:i] - m
        phi, *_ = np.linalg.lstsq(np.column_stack([z[1:-1], z[:-2]]), z[2:], rcond=None)
        w = 0.8 ** np.arange(10)
        out[g["date"].iloc[i]] = {"seasonal": fit[0] * days[i] + fit[1 + dow[i]], "ar2": m + phi[0] * z[-1] + phi[1] * z[-2], "smoothing": (w * y[i - 10:i][::-1]).sum() / w.sum()}
    return out


def test_every_origin_equals_a_refit(spark):
    rng = np.random.default_rng(3)
    rows = []
    for key, n in (("a", 60), ("b", 40), ("short", 15)):
        dates = pd.date_range("2024-01-03", periods=n)
        level = 1e6 if key == "b" else 50
        rows += [(key, d.to_pydatetime(), float(level + 3 * t + 10 * (d.weekday() > 4) + rng.normal(0, 4))) for t, d in enumerate(dates) if t % 11 or t < 21]
    got = rolling_origin(spark.createDataFrame(rows, "k string, date timestamp_ntz, value double"), "k").toPandas()
    pdf = pd.DataFrame(rows, columns=["k", "date", "value"])
    assert set(got["k"]) == {"a", "b"}
    for key in "ab":
        want = refit(pdf[pdf.k == key].reset_index(drop=True))
        own = got[got.k == key]
        assert len(own) == 3 * len(want)
        for r in own.itertuples():
            assert r.predicted == pytest.approx(want[r.date][r.model], rel=1e-6, abs=1e-6)
        one = own[own.model == "ar2"].sort_values("date")
        off = (one.actual - one.predicted).to_numpy()
        reach = [0.0] + [1.96 * np.sqrt((off[:i] ** 2).mean()) for i in range(1, len(off))]
        assert (one.upper - one.predicted).to_numpy() == pytest.approx(reach)


def test_flat_and_empty_series(spark):
    flat = [("k", d.to_pydatetime(), 7.0) for d in pd.date_range("2024-01-01", periods=30)]
    got = rolling_origin(spark.createDataFrame(flat, "k string, date timestamp_ntz, value double"), "k").collect()
    assert len(got) == 27 and all(r.predicted == r.lower == r.upper == 7.0 for r in got)
    assert rolling_origin(spark.createDataFrame([], "k string, date timestamp_ntz, value double"), "k").count() == 0
