"""Chained regressions from cross products against refitting on the filled table."""

import numpy as np
import pytest

from tidewatch.operators.clean import impute_iterative


def plain(table, rounds):
    middle, spread = np.nanmean(table, axis=0), np.nanstd(table, axis=0)
    z = np.nan_to_num((table - middle) / spread)
    gap = np.isnan(table)
    for _ in range(rounds):
        for c in range(z.shape[1]):
            x = np.column_stack([np.ones(len(z)), np.delete(z, c, axis=1)])
            w, *_ = np.linalg.lstsq(x[~gap[:, c]], z[~gap[:, c], c], rcond=None)
            z[gap[:, c], c] = (x @ w)[gap[:, c]]
    return z * spread + middle


@pytest.mark.parametrize("rounds", [1, 4])
def test_equals_refits_of_the_filled_table(spark, rounds):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(300, 2))
    table = np.column_stack([base[:, 0] * 5 + 100, base @ [1, 2] + rng.normal(size=300) * .1, base @ [-3, 1] * 1e6 + 1e9, rng.normal(size=300)])
    table[rng.random(table.shape) < 0.2] = np.nan
    rows = [(i, *[None if np.isnan(x) else float(x) for x in r], "x") for i, r in enumerate(table)]
    got = impute_iterative(spark.createDataFrame(rows, "id int, a double, b double, c double, d double, gaps string"), list("abcd"), rounds)
    assert got.columns == ["id", "a", "b", "c", "d", "gaps"]
    found = np.array([[r[c] for c in "abcd"] for r in sorted(got.collect(), key=lambda r: r.id)])
    want = plain(table, rounds)
    assert found / np.abs(want).max(axis=0) == pytest.approx(want / np.abs(want).max(axis=0), abs=1e-8)


def test_columns_without_values_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, 2.0, None, 4), (2, None, None, 5), (3, float("nan"), None, 9), (4, 3.0, None, None)], "id int, a double, b double, c int")
    got = {r.id: (r.a, r.b, r.c) for r in impute_iterative(frame, ["a", "b", "c"]).collect()}
    assert all(b is None for _, b, _ in got.values()) and all(a is not None and a == a and c is not None for a, _, c in got.values())
    assert got[1] == (2.0, None, 4.0)
    assert impute_iterative(frame.where("id < 0"), ["a", "c"]).count() == 0
    with pytest.raises(ValueError):
        impute_iterative(frame, [f"c{i}" for i in range(13)])
