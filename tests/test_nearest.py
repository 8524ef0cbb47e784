"""Nearest-row imputation over many columns against a plain search."""

import math
import random

import pytest

from tidewatch.operators import nearest
from tidewatch.operators.nearest import impute_nearest_all, nearest_rows

COLUMNS = ["a", "b", "c"]
SCHEMA = "id bigint, a double, b double, c double, other string, n int"


def plain(rows, k):
    out = {}
    means = [([r[i] for r in rows if r[i] is not None and r[i] == r[i]] or [None]) for i in (1, 2, 3)]
    known = lambda x: x is not None and x == x
    for t in rows:
        values = list(t[1:4])
        for i in range(3):
            if known(t[1 + i]):
                continue
            found = []
            for x in rows:
                both = [j for j in (1, 2, 3) if known(t[j]) and known(x[j])]
                if t[0] is not None and x[0] is not None and both and known(x[1 + i]):
                    total = 0.0
                    for j in both:
                        total += (t[j] - x[j]) * (t[j] - x[j])
                    found.append((total * 3 / len(both), x[0], x[1 + i]))
            best = sorted(found)[:k] or ([(0, 0, sum(means[i]) / len(means[i]))] if means[i] != [None] else [])
            values[i] = sum(b[2] for b in best) / len(best) if best else None
        out.setdefault(t[0], []).append(tuple(values))
    return out


def made(n, seed=1):
    rng = random.Random(seed)
    pick = lambda x, p: None if rng.random() < p else x
    rows = [(i, pick(rng.gauss(0, 1) + 5 * (i % 4), 0.2), pick(float(rng.randrange(6)), 0.3), pick(rng.random() * 100, 0.1), "x", i) for i in range(n)]
    rows += [(n + i, 1.0, None, 2.0, "same", 0) for i in range(40)] + [(n + 50 + i, 1.0, 3.0 + i % 2, 2.0, "same", 0) for i in range(40)]  # ties
    return rows + [(n + 100, None, None, None, "empty", 0), (n + 101, math.nan, 1.0, None, "nan", 0), (None, None, 1.0, 2.0, "no id", 0)]


def agree(got, want):
    found = {}
    for r in got.collect():
        found.setdefault(r.id, []).append((r.a, r.b, r.c))
    assert found.keys() == want.keys()
    for i, values in want.items():
        for a, b in zip(found[i], values):
            assert a == pytest.approx(b), i


@pytest.mark.parametrize("chunk,first,blocks,k", [(1024, 2, 4096, 5), (16, 2, 4096, 5), (9, 1, 8, 3), (16, 2, 4096, 400)])
def test_all_columns(spark, monkeypatch, chunk, first, blocks, k):
    for name, value in (("CHUNK", chunk), ("FIRST_BLOCKS", first), ("MOST_BLOCKS", blocks)):
        monkeypatch.setattr(nearest, name, value)
    rows = made(300)
    got = impute_nearest_all(spark.createDataFrame(rows, SCHEMA), COLUMNS, "id", k)
    assert got.columns == ["id", "a", "b", "c", "other", "n"]
    agree(got, plain(rows, k))


def test_far_blocks_are_not_met(spark, monkeypatch):
    """Two clusters far apart: a block of one cluster meets no block of the other."""
    monkeypatch.setattr(nearest, "CHUNK", 32)
    rows = [(i, float(i % 50) + 1e6 * (i >= 400), float(i % 7), None if i % 10 == 0 else float(i), "x", i) for i in range(800)]
    bounds = nearest.Bounds(nearest.packed(spark.createDataFrame(rows, SCHEMA), COLUMNS, "id"), 3)
    gaps = [n for n in range(len(bounds.block)) if bounds.mask[n] != 7 and bounds.hi[n][0] - bounds.lo[n][0] < 1e5]
    assert gaps
    for n in gaps:
        mask = int(bounds.mask[n])
        chosen = bounds.within(mask, bounds.of(mask, bounds.lo[n], bounds.hi[n]), [1e4] * 3)
        near = (bounds.lo[:, 0] < 1e5) == (bounds.lo[n][0] < 1e5)
        straddles = bounds.hi[:, 0] - bounds.lo[:, 0] > 1e5
        assert chosen.any() and not chosen[~near & ~straddles].any()


def test_rows_equal_in_the_shared_columns(spark):
    """Of rows that an incomplete row cannot tell apart only the k smallest ids are met, however many there are."""
    rows = [(i, 1.0, 2.0, None if i % 20 == 0 else float(i), "x", i) for i in range(600)] + [(600 + i, 7.0, 2.0, 1.0, "x", i) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    bounds = nearest.Bounds(nearest.packed(df, COLUMNS, "id"), 3)
    assert bounds.n[bounds.mask == 7].sum() <= 10
    got = {r.id: r.c for r in impute_nearest_all(df, COLUMNS, "id").collect()}
    assert {got[i] for i in range(0, 600, 20)} == {3.0}  # of the rows 1 to 5


def test_none_and_no_values(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert impute_nearest_all(none, COLUMNS, "id").count() == 0
    blank = spark.createDataFrame([(1, None, None, 1.0, "x", 0), (2, None, 2.0, None, "x", 0)], SCHEMA)
    got = {r.id: (r.a, r.b, r.c) for r in impute_nearest_all(blank, COLUMNS, "id").collect()}
    assert got == {1: (None, 2.0, 1.0), 2: (None, 2.0, 1.0)}
    assert nearest_rows(blank, COLUMNS, "id", 5).count() == 0
