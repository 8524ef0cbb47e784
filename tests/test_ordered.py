"""Ordered primitives: the range-cut forms against plain windows, with one key holding most rows."""

import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from tidewatch.functions.ordered import RowFrames, Slices, TimeFrames, per_key
from tidewatch.functions.quantiles import group_quantiles
from tidewatch.functions.ranks import gini, with_ranks, with_running_share
from tidewatch.functions.spacing import spaced
from tidewatch.functions.spans import span_count, span_mean, span_std, span_totals
from tidewatch.operators import clean, quality
from tidewatch.session import SMALL_BYTES_KEY


@pytest.fixture(params=["small", "cut"])
def mode(request, spark):
    spark.conf.set(SMALL_BYTES_KEY, "0" if request.param == "cut" else str(2 ** 26))
    yield request.param
    spark.conf.set(SMALL_BYTES_KEY, str(2 ** 26))


@pytest.fixture(scope="module")
def rows(spark):
    """2000 rows; key 'hot' has two thirds, some nulls in x, equal times, one null key."""
    i = F.col("id")
    return spark.range(2000).select(
        i, F.when(i % 3 != 0, "hot").when(i % 501 == 0, None).otherwise(F.concat(F.lit("k"), (i % 7).cast("string"))).alias("k"),
        F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, cast(id * 37 % 1500 as int), 0)").alias("ts"),
        F.when(i % 5 == 0, None).otherwise(((i * 13) % 101) / 4.0).alias("x"))


def same(a, b):
    key = lambda r: tuple((v is None, str(v)) for v in r)
    x = sorted((tuple(None if isinstance(v, float) and pd.isna(v) else round(v, 9) if isinstance(v, float) else v for v in r) for r in a.collect()), key=key)
    y = sorted((tuple(None if isinstance(v, float) and pd.isna(v) else round(v, 9) if isinstance(v, float) else v for v in r) for r in b.collect()), key=key)
    assert x == y


def test_running_previous_filled(rows, mode):
    w = Window.partitionBy("k").orderBy("ts", "id")
    s = Slices(rows, ["k"], ["ts", "id"], slices=7)
    got = s.previous(s.running(s.df, {"r": F.coalesce("x", F.lit(0.0)), "n": F.lit(1)}), {"p": "x", "pid": "id"})
    got = s.done(s.filled_back(s.filled(got, {"f": F.col("x")}), {"b": F.col("x")}))
    frame = w.rowsBetween(Window.unboundedPreceding, 0)
    want = rows.select("*", F.sum(F.coalesce("x", F.lit(0.0))).over(frame).alias("r"), F.row_number().over(w).cast("bigint").alias("n"),
                       F.lag("x").over(w).alias("p"), F.lag("id").over(w).alias("pid"), F.last("x", ignorenulls=True).over(frame).alias("f"),
                       F.first("x", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("b"))
    same(got.select(want.columns), want)


@pytest.mark.parametrize("block", [None, 10, 64])
def test_row_frames(rows, mode, block):
    f = RowFrames(rows, ["k"], ["ts", "id"], before=9, after=3, block=block)
    got = f.done(f.df.withColumns({"a": F.sum("x").over(f.rows(-9)), "l": F.lag("id", 7).over(f.window), "c": F.count("id").over(f.rows(-5, 3))}))
    w = Window.partitionBy("k").orderBy("ts", "id")
    want = rows.select("*", F.sum("x").over(w.rowsBetween(-9, 0)).alias("a"), F.lag("id", 7).over(w).alias("l"), F.count("id").over(w.rowsBetween(-5, 3)).alias("c"))
    same(got.select(want.columns), want)


def test_time_frames(rows):
    f = TimeFrames(rows, ["k"], "ts", 3600)
    got = f.done(f.df.withColumns({"open": F.count("id").over(f.span(3600)), "closed": F.count("id").over(f.span(3600, closed=True))}))
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("k").orderBy(t)
    want = rows.select("*", F.count("id").over(w.rangeBetween(-3_599_999_999, 0)).alias("open"), F.count("id").over(w.rangeBetween(-3_600_000_000, 0)).alias("closed"))
    same(got.select(want.columns), want)


@pytest.mark.parametrize("method,exact", [("linear", "linear"), ("index", None), ("exclusive", None)])
def test_group_quantiles(rows, mode, method, exact):
    got = {r["k"]: r for r in group_quantiles(rows.filter("k is not null"), ["k"], ["x"], [0.1, 0.5, 0.9], method).collect()}
    pdf = rows.filter("k is not null and x is not null").select("k", "x").toPandas()
    for k, g in pdf.groupby("k"):
        v, n = sorted(g["x"]), len(g)
        for p in (0.1, 0.5, 0.9):
            if method == "linear":
                at = p * (n - 1)
            elif method == "index":
                at = min(int(n * p), n - 1)
            else:
                at = min(max(p * (n + 1) - 1, 0), n - 1)
            lo = int(at)
            want = v[lo] + (v[min(lo + 1, n - 1)] - v[lo]) * (at - lo)
            assert got[k][f"x_p{int(p * 100)}"] == pytest.approx(want)


@pytest.mark.parametrize("closed", [False, True])
def test_span_totals_equal_range_frames(rows, mode, closed):
    span = 600
    start = -span * 1_000_000 + (0 if closed else 1)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("k").orderBy("_t").rangeBetween(start, 0)
    want = rows.withColumn("_t", us).select("id", F.count("x").over(w).alias("n"), F.avg("x").over(w).alias("m"), F.stddev_samp("x").over(w).alias("s"),
                                            F.stddev_pop("x").over(w).alias("p")).toPandas().set_index("id").sort_index()
    got = span_totals(rows, ["k"], ["x"], "ts", span, closed).select(
        "id", span_count("x").alias("n"), span_mean("x").alias("m"), span_std("x").alias("s"), span_std("x", sample=False).alias("p")).toPandas().set_index("id").sort_index()
    assert (got["n"] == want["n"]).all()
    for c in ("m", "s", "p"):
        assert got[c].to_numpy(float) == pytest.approx(want[c].to_numpy(float), nan_ok=True, abs=1e-9)


def test_both_forms_agree_on_all_rows(spark, rows):
    """Null values, groups of nulls and null keys included."""
    data = rows.unionByName(rows.sparkSession.sql("select 9000L as id, 'none' as k, timestamp_ntz'2024-01-01' as ts, cast(null as double) as x"))
    found = {}
    for limit in ("0", str(2 ** 26)):
        spark.conf.set(SMALL_BYTES_KEY, limit)
        ranks = {(r["id"], r["d"], r["p"]) for r in with_ranks(data, "x", dense="d", pct="p").collect()}
        by_key = {(r["id"], r["d"], r["p"]) for r in with_ranks(data.filter("k is not null"), "x", ["k"], dense="d", pct="p").collect()}
        quantiles = {tuple(r) for r in group_quantiles(data, ["k"], ["x"], [0.25, 0.5]).select("k", F.round("x_p25", 9), F.round("x_p50", 9)).collect()}
        found[limit] = (ranks, by_key, quantiles)
    assert found["0"] == found[str(2 ** 26)]
    assert ("none", None, None) in found["0"][2] and (9000, None, None) in found["0"][0]


def test_ranks_shares_gini(rows, mode):
    pdf = rows.toPandas()
    got = with_ranks(rows, "x", dense="d", pct="p").toPandas().set_index("id").sort_index()
    want = pdf.set_index("id").sort_index()["x"]
    known = want.notna()
    assert (got["d"][known] == want.rank(method="dense", ascending=False)[known]).all()
    assert got["p"][known].to_numpy() == pytest.approx(want.rank(pct=True)[known].to_numpy())
    totals = rows.filter("x is not null").groupBy("k").agg(F.sum("x").alias("t")).filter("k is not null")
    share = with_running_share(totals, "t", "k", "s", "c").toPandas().sort_values("t", ascending=False)
    assert share["c"].to_numpy() == pytest.approx((share["t"].cumsum() / share["t"].sum() * 100).to_numpy())
    v = sorted(want[known])
    n = len(v)
    expected = 2 * sum((i + 1) * x for i, x in enumerate(v)) / (n * sum(v)) - (n + 1) / n
    assert gini(rows, "x").first()[0] == pytest.approx(expected)


@pytest.mark.parametrize("minutes", [0, 1, 7, 90])
def test_spaced_rows(rows, mode, minutes):
    got = {r["id"] for r in spaced(rows, ["k"], "ts", "id", minutes * 60).collect()}
    want = set()
    for _, g in rows.filter("k is not null").toPandas().sort_values(["ts", "id"]).groupby("k"):
        last = None
        for r in g.itertuples():
            if last is None or (r.ts - last).total_seconds() >= minutes * 60:
                want.add(r.id)
                last = r.ts
    assert got == want


def test_empty_and_single(spark, mode):
    empty = spark.createDataFrame([], "id bigint, k string, ts timestamp_ntz, x double")
    s = Slices(empty, ["k"], ["ts", "id"])
    assert s.running(s.df, {"n": F.lit(1)}).count() == 0
    assert group_quantiles(empty, ["k"], ["x"], [0.5]).count() == 0
    one = spark.sql("select 1L as id, 'a' as k, timestamp_ntz'2024-01-01' as ts, 2.0D as x")
    assert group_quantiles(one, ["k"], ["x"], [0.5]).first()["x_p50"] == 2.0
    assert spaced(one, ["k"], "ts", "id", 60).count() == 1


def test_memory_of_a_fold_does_not_grow_with_merged_tasks(spark):
    """Windows of a fold keep the number of ranges they were dealt to, and key values are joined by their written size."""
    spark.conf.set(SMALL_BYTES_KEY, "0")
    rows = spark.range(300).select("id", (F.col("id") % 3).alias("k"))
    cut = Slices(rows, ["k"], ["id"], slices=6)
    plan = cut.running(cut.df, {"n": F.lit(1).cast("bigint")})
    assert cut.count == 6 and "REPARTITION_BY_NUM" in plan._jdf.queryExecution().executedPlan().toString()
    assert plan.agg(F.sum("n")).first()[0] == 3 * 50 * 101
    assert "Relation" in per_key(rows.groupBy("k").count())._jdf.queryExecution().analyzed().toString()
    spark.conf.set(SMALL_BYTES_KEY, str(2 ** 26))


def test_stage_scores_run_their_parts_once(spark):
    """Overall scores, and the mean over stages, read the scored parts instead of the table."""
    log = spark.createDataFrame([("a", 1.0, "2024-01-05"), ("b", 2.0, "x"), ("c", 3.0, None)], "QUERY_ID string, CREDITS_USED double, WHEN_AT string")
    plan = quality.pipeline_scores({"raw": log})._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "LocalRelation" not in plan and "try_to_timestamp" not in plan
    got = [r.t for r in spark.createDataFrame([("2024-01-05",), ("U-1",), ("2024-01-05 01:02:03",), ("2024-1-5",), (None,), ("12345",)], "v string")
           .select(clean.parse_time(F.col("v")).cast("string").alias("t")).collect()]
    assert got == ["2024-01-05 00:00:00", None, "2024-01-05 01:02:03", None, None, None]
