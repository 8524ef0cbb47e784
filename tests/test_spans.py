"""Windows over a time span: folds and quantiles against plain range frames, both forms, with one key holding most rows."""

import math

import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from tidewatch.functions import order_spans
from tidewatch.functions.order_spans import span_quantiles
from tidewatch.functions.spans import span_folds, span_kurtosis, span_skew, span_totals
from tidewatch.operators import alerts, features_rolling
from tidewatch.session import SMALL_BYTES_KEY

SPAN = 600


@pytest.fixture(params=["small", "cut"])
def mode(request, spark):
    spark.conf.set(SMALL_BYTES_KEY, "0" if request.param == "cut" else str(2 ** 26))
    yield request.param
    spark.conf.set(SMALL_BYTES_KEY, str(2 ** 26))


@pytest.fixture(scope="module")
def rows(spark):
    """Key 'hot' has two thirds, nulls in x, equal times, a null key, a key without values, one value far off."""
    i = F.col("id")
    made = spark.range(1500).select(
        i, F.when(i % 3 != 0, "hot").when(i % 501 == 0, None).otherwise(F.concat(F.lit("k"), (i % 7).cast("string"))).alias("k"),
        F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, cast(id * 37 % 1100 as int), 0)").alias("ts"),
        F.when((i % 5 == 0) | (i % 7 == 6) & (i % 3 == 0), None).otherwise(((i * 13) % 101) / 4.0 + F.when(i == 700, 1e7).otherwise(0.0)).alias("x"))
    return made.unionByName(spark.sql("select 9000L as id, 'one' as k, timestamp_ntz'2024-01-01' as ts, 2.5D as x"))


def frame(closed):
    return Window.partitionBy("k").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-SPAN * 1_000_000 + (0 if closed else 1), 0)


def table(df):
    return {r["id"]: tuple(r)[1:] for r in df.collect()}


def agree(got, want, digits=9):
    got, want = table(got), table(want)
    assert got.keys() == want.keys()
    for k, values in want.items():
        for a, b in zip(got[k], values):
            assert (a is None) == (b is None or b != b) and (a is None or a == pytest.approx(b, rel=10.0 ** -digits, abs=10.0 ** -digits)), (k, got[k], values)


@pytest.mark.parametrize("closed", [False, True])
def test_folds(rows, mode, closed):
    w = frame(closed)
    folds = {"lo": (F.col("x"), "min"), "hi": (F.col("x"), "max"), "all": (F.col("x"), "sum"), "last": (F.struct("ts", "id"), "max")}
    got = span_folds(rows, ["k"], folds, "ts", SPAN, closed).select("id", "lo", "hi", "all", F.col("last.id"))
    agree(got, rows.select("id", F.min("x").over(w), F.max("x").over(w), F.sum("x").over(w), F.max(F.struct("ts", "id")).over(w)["id"]))


def test_shape_of_windows(rows, mode):
    near = rows.where("x < 100")
    pdf = near.toPandas()
    want = {}
    for _, g in pdf.groupby("k", dropna=False):
        for r in g.itertuples():
            v = g[(g.ts > r.ts - pd.Timedelta(seconds=SPAN)) & (g.ts <= r.ts)].x
            want[r.id] = (v.skew() if len(v) > 2 else None, v.kurt() if len(v) > 3 else None)
    got = table(span_totals(near, ["k"], ["x"], "ts", SPAN, powers=4).select("id", span_skew("x"), span_kurtosis("x")))
    for k, values in want.items():
        for a, b in zip(got[k], values):
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, abs=1e-7))


@pytest.mark.parametrize("method,closed", [("linear", False), ("index", True), ("exclusive", True)])
def test_quantiles(rows, mode, method, closed):
    probs = [0.0, 0.25, 0.5, 0.99, 1.0]
    got = table(span_quantiles(rows, ["k"], "x", "ts", SPAN, probs, method, closed).select("id", "_n", "_q"))
    lists = table(rows.select("id", F.array_sort(F.collect_list("x").over(frame(closed))).alias("v")))
    for k, (v,) in lists.items():
        n, q = got[k]
        assert n == len(v) and (q is None) == (not v)
        for p, x in zip(probs, q or ()):
            at = {"linear": p * (n - 1), "index": min(int(n * p), n - 1), "exclusive": min(max((n + 1) * p - 1, 0), n - 1)}[method]
            low, high = v[math.floor(at)], v[math.ceil(at)]
            assert x == pytest.approx(low + (high - low) * (at - math.floor(at)))


def test_quantiles_of_many_levels(spark, mode, monkeypatch):
    monkeypatch.setattr(order_spans, "BITS", 2)
    some = spark.range(900).select("id", F.lit("k").alias("k"), F.expr("timestamp'2024-01-01' + make_dt_interval(0, 0, cast(id % 450 as int), 0)").alias("ts"),
                                   (F.xxhash64("id") % 1000 / 7).alias("x"))
    got = span_quantiles(some, ["k"], "x", "ts", 200, [0.5]).select("id", F.col("_q")[0])
    w = Window.partitionBy("k").orderBy(F.unix_micros("ts")).rangeBetween(-199_999_999, 0)
    agree(got, some.select("id", F.expr("percentile(x, 0.5D)").over(w)))


@pytest.mark.parametrize("most,batch", [(1 << 20, 1 << 18), (1 << 20, 50), (300, 50), (0, 1)])
@pytest.mark.parametrize("method,closed", [("linear", False), ("index", True)])
def test_buckets_and_hot_buckets_agree(rows, mode, monkeypatch, most, batch, method, closed):
    """Batches that cut between buckets, buckets that go by digits, and both at once."""
    monkeypatch.setattr(order_spans, "MOST_ROWS", most)
    monkeypatch.setattr(order_spans, "BATCH_ROWS", batch)
    got = span_quantiles(rows, ["k"], "x", "ts", SPAN, [0.3, 0.9], method, closed).select("id", "_n", "_q")
    lists = table(rows.select("id", F.array_sort(F.collect_list("x").over(frame(closed))).alias("v")))
    found = table(got)
    assert found.keys() == lists.keys()
    for k, (v,) in lists.items():
        n, q = found[k]
        assert n == len(v) and (q is None) == (not v)
        for p, x in zip([0.3, 0.9], q or ()):
            at = min(int(n * p), n - 1) if method == "index" else p * (n - 1)
            low, high = v[math.floor(at)], v[math.ceil(at)]
            assert x == pytest.approx(low + (high - low) * (at - math.floor(at)))


def test_buckets_are_not_sorted_level_by_level(rows, mode, monkeypatch):
    """A large input without a hot bucket needs neither range cuts nor a key in one task."""
    def no(*_, **__):
        raise AssertionError("range cuts")

    monkeypatch.setattr(order_spans, "Slices", no)
    plan = span_quantiles(rows, ["k"], "x", "ts", SPAN, [0.5])._jdf.queryExecution().toString()
    assert "FlatMapGroupsInArrow" not in plan
    assert "RepartitionByExpression [k" in plan


def test_without_keys_and_empty(spark, rows, mode):
    got = span_quantiles(rows, [], "x", "ts", SPAN, [0.5]).select("id", F.col("_q")[0])
    w = Window.orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-SPAN * 1_000_000 + 1, 0)
    agree(got, rows.select("id", F.expr("percentile(x, 0.5D)").over(w)))
    none = rows.where("id < 0")
    assert span_quantiles(none, ["k"], "x", "ts", SPAN, [0.5]).count() == span_totals(none, ["k"], ["x"], "ts", SPAN).count() == 0


def test_no_window_is_held(spark, rows):
    """Large inputs: neither lists of values nor range frames, whatever a metric holds."""
    spark.conf.set(SMALL_BYTES_KEY, "0")
    rows = rows.where("id < 200")
    points = rows.select(F.col("k").alias("metric"), "ts", F.col("x").alias("value"), F.col("id").alias("point_id"))
    plans = [alerts.window_statistics(points, 300), alerts.percentile_limits(points), alerts.index_percentiles(points), alerts.usage_patterns(points),
             features_rolling.rolling_shape(rows, ["k"], ["x"], SPAN, "s", "ts"), features_rolling.rolling_quantiles(rows, ["k"], ["x"], 1, ts="ts")]
    for plan in plans:
        text = plan._jdf.queryExecution().toString()
        assert "RangeFrame" not in text and "percentile(" not in text and "InPandas" not in text
        assert "collect_list(value" not in text and "collect_list(x" not in text
    spark.conf.set(SMALL_BYTES_KEY, str(2 ** 26))
