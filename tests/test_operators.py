"""Edge rows: cut boundaries, zero bottoms, nulls, ties, empty and constant input, streaming twins."""

import math
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.functions.expressions import correlation, cut, kurtosis_corrected, ratio, skew_corrected
from tidewatch.operators import alerts, clean, cost, dimensional, featuretables, forecast, lineage, querylog, temporal, usage
from tidewatch.session import SMALL_BYTES_KEY
from tidewatch.sources import history
from tidewatch.streaming import monitors


def test_cut_is_right_closed(spark):
    got = [r[0] for r in spark.createDataFrame([(x,) for x in (0.0, 1.0, 1.5, 10.0, 11.0, None)], "x double").select(cut(F.col("x"), [0, 1, 10], ["a", "b"])).collect()]
    assert got == [None, "a", "b", "b", None, None]


def test_ratio_and_shape(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 2.0), (None, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(ratio(F.col("a"), F.col("b"))).collect()] == [0.0, 0.5, None]
    x = [1.0, 2.0, 2.0, 3.0, 9.0]
    row = spark.createDataFrame([(v,) for v in x], "x double").agg(skew_corrected("x"), kurtosis_corrected("x")).first()
    assert row[0] == pytest.approx(pd.Series(x).skew()) and row[1] == pytest.approx(pd.Series(x).kurt())
    flat = spark.createDataFrame([(5.0, 1.0), (5.0, 2.0), (5.0, 3.0), (5.0, 4.0)], "x double, y double")
    assert flat.agg(skew_corrected("x"), correlation("x", "y")).first() == (0.0, None)


def test_temporal_edges(spark):
    df = spark.createDataFrame([("2024-01-07 23:00:00", 1.0), ("2024-01-08 00:00:00", None), ("2024-03-31 10:00:00", 3.0)], "t string, m double").withColumn("t", F.col("t").cast("timestamp_ntz"))
    weekly = {str(r["time_group"])[:10]: r["m_sum"] for r in temporal.aggregate_periods(df, "t", "weekly", {"m": ["sum"]}).collect()}
    assert weekly["2024-01-01"] == 1.0 and weekly["2024-01-08"] is None
    filled = temporal.fill_periods(temporal.aggregate_periods(df, "t", "weekly", {"m": ["sum"]}), "weekly")
    assert filled.count() == 13 and filled.filter("time_group = '2024-03-25'").first()["m_sum"] == 3.0
    with pytest.raises(ValueError):
        temporal.with_period(df, "t", "yearly")
    assert temporal.aggregate_periods(df.limit(0), "t", "daily", {"m": ["sum"]}, [50]).count() == 0


def test_interpolation_keeps_leading_gap(spark):
    df = spark.createDataFrame([(1, None), (2, 2.0), (3, None), (4, 4.0), (5, None)], "i int, x double")
    assert [r["x"] for r in clean.interpolate(df, ["x"], ["i"]).orderBy("i").collect()] == [None, 2.0, 3.0, 4.0, 4.0]


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None)], "i int, k string")
    assert {r["i"] for r in clean.drop_exact(df, ["k"], "first", "i").collect()} == {1, 3, 4}
    assert {r["i"] for r in clean.drop_exact(df, ["k"], "last", "i").collect()} == {2, 3, 5}
    assert {r["i"] for r in clean.drop_exact(df, ["k"], "none").collect()} == {3}


def test_near_copies_against_brute_force(spark):
    base = [" ".join(f"w{(i * 7 + j * j) % 97}" for j in range(120)) for i in range(6)]
    texts = base + [base[0], base[1] + " tail", base[2].replace("w5 ", "w6 ", 1), base[3].upper()]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    def sets(t):
        w = t.lower().split()
        return {" ".join(w[i:i + 3]) for i in range(max(len(w) - 2, 1))}
    s = [sets(t) for t in texts]
    want = {i for i in range(len(texts)) if not any(len(s[i] & s[j]) / len(s[i] | s[j]) >= 0.95 for j in range(i))}
    assert {r["id"] for r in clean.drop_near(df, "id", "t").collect()} == want


def test_near_copies_behind_an_unlike_leader(spark):
    base = [f"w{j}" for j in range(400)]
    texts = [" ".join(f"x{i}" if j % 50 == i else w for j, w in enumerate(base)) for i in range(40)]  # unlike each other
    texts += [" ".join(base), " ".join(base) + " tail"]
    sets = [{" ".join(w[i:i + 3]) for i in range(len(w) - 2)} for w in (t.split() for t in texts)]
    want = {i for i in range(len(texts)) if not any(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.95 for j in range(i))}
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    assert want == set(range(41))
    assert {r["id"] for r in clean.drop_near(df, "id", "t").collect()} == want


def test_constant_columns_have_no_outliers(spark):
    df = spark.createDataFrame([(5.0,)] * 12 + [(None,)], "x double")
    for method in clean.FENCES:
        assert clean.handle_outliers(df, ["x"], method, "flag").filter("x_outlier_flag").count() == 0


def test_session_gap_equal_to_timeout_stays(spark):
    df = spark.createDataFrame([("1", "u", "2024-01-01 00:00:00"), ("2", "u", "2024-01-01 01:00:00"), ("3", "u", "2024-01-01 02:00:01")], "QUERY_ID string, USER_NAME string, START_TIME string")
    df = df.withColumn("START_TIME", F.col("START_TIME").cast("timestamp_ntz"))
    assert {r["QUERY_ID"]: r["session_id"] for r in usage.with_sessions(df).collect()} == {"1": 0, "2": 0, "3": 1}


def test_open_interval_never_closes(spark):
    df = spark.createDataFrame([("w", 0, None), ("w", 10, 20), ("w", 20, 30)], "WAREHOUSE_NAME string, START_TIME int, END_TIME int")
    assert usage.max_concurrency(df).first()["estimated_max_concurrency"] == 3  # a start counts before an end at 20


def test_dimension_errors_and_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0)], "d string, m double")
    with pytest.raises(ValueError):
        dimensional.usable_dimensions(df, ["absent"])
    assert dimensional.usable_dimensions(df, ["d", "absent"]) == ["d"]
    assert dimensional.aggregate_by(df, ["d"], {"m": ["sum"]}, min_support=1).count() == 1


def test_gini_of_equal_costs_is_zero(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "USER_NAME string, CREDITS_USED double")
    assert cost.cost_inequality(df, ["USER_NAME"]).first()["cost_gini"] == pytest.approx(0.0)


def test_statement_pattern(spark):
    df = spark.createDataFrame([("select *  from t where a='x' and b = 12",)], "q string")
    assert df.select(querylog.statement_pattern(F.col("q"))).first()[0] == "SELECT * FROM T WHERE A='?' AND B = ?"


def test_point_in_time_equal_time_counts(spark):
    ts = lambda c: F.col(c).cast("timestamp_ntz")
    f = spark.createDataFrame([("e", "2024-01-01", 1.0), ("e", "2024-01-03", 3.0)], "id string, t string, v double").select("id", ts("t").alias("_event_timestamp"), "v")
    s = spark.createDataFrame([("e", "2023-12-31"), ("e", "2024-01-03"), ("x", "2024-01-03")], "id string, at string").withColumn("at", ts("at"))
    got = {(r["id"], str(r["at"])[:10]): r["v"] for r in featuretables.as_of_join(s, f, "id", "at", ["v"], "v").collect()}
    assert got == {("e", "2023-12-31"): None, ("e", "2024-01-03"): 3.0, ("x", "2024-01-03"): None}


def test_lineage_ends_in_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c")], "source string, target string").withColumn("relation", F.lit("r"))
    assert {(r["node_id"], r["depth"]) for r in lineage.reachable(edges, "a").collect()} == {("b", 1), ("c", 1)}
    assert lineage.would_cycle(edges.limit(1), "a", "b").first()[0] == 1


def test_incremental_pull_reads_only_new_rows(spark, tmp_path):
    day = lambda n: spark.createDataFrame([(str(i), f"2024-01-{i:02d}") for i in range(1, n)], "EVENT_ID string, t string").select("EVENT_ID", F.col("t").cast("timestamp_ntz").alias("EVENT_TIMESTAMP"))
    root = str(tmp_path / "store")
    assert history.pull_increment(day(9), "user_activity", root, "2024-01-08 12:00:00").count() == 7  # look-back of 7 days
    assert history.pull_increment(day(12), "user_activity", root, "2024-01-11 12:00:00").count() == 10
    assert history.pull_increment(day(12), "user_activity", root, "2024-01-11 12:00:00").count() == 10


def test_incremental_pull_takes_late_ties_and_repeats_failed_pulls(spark, tmp_path):
    rows = lambda *ids: spark.createDataFrame([(i, t) for i, t in ids], "EVENT_ID string, t string").select("EVENT_ID", F.col("t").cast("timestamp_ntz").alias("EVENT_TIMESTAMP"))
    stored = lambda: sorted(r["EVENT_ID"] for r in spark.read.parquet(f"{root}/user_activity_raw").collect())
    root = str(tmp_path / "store")
    first = [("a", "2024-01-05"), ("b", "2024-01-06")]
    history.pull_increment(rows(*first), "user_activity", root, "2024-01-07 00:00:00")
    late = [*first, ("tie", "2024-01-06"), ("c", "2024-01-08")]
    history.pull_increment(rows(*late), "user_activity", root, "2024-01-09 00:00:00")
    assert stored() == ["a", "b", "c", "tie"]
    # a pull that stored its rows but failed before the mark: rows of a batch without a mark
    orphan = history.with_collection(rows(("d", "2024-01-10")), "2024-01-11 00:00:00", "x").drop("_collection_batch")
    orphan.write.parquet(f"{root}/user_activity_raw/_collection_batch=user_activity_raw_20240111_000000")
    more = [*late, ("d", "2024-01-10"), ("e", "2024-01-10")]
    for as_of in ("2024-01-11 00:00:00", "2024-01-12 00:00:00"):
        history.pull_increment(rows(*more), "user_activity", root, as_of)
        assert stored() == ["a", "b", "c", "d", "e", "tie"]


def test_lineage_follows_long_chains(spark):
    edges = spark.range(30).selectExpr("concat('n', id) as source", "concat('n', id + 1) as target", "'r' as relation")
    found = lineage.dependencies(edges, "n30")
    assert found.count() == 30 and found.agg(F.max("depth")).first()[0] == 30
    assert lineage.would_cycle(edges, "n0", "n30").first()[0] == 1


@pytest.fixture(scope="module")
def points(spark):
    return spark.range(300).select(F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("metric"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, cast(id as int), 0)").alias("ts"),
                                   ((F.col("id") * 7) % 31).cast("double").alias("value"), F.col("id").alias("point_id"))


@pytest.mark.parametrize("limit", [0, 2 ** 26])
def test_recursive_mean(spark, points, limit):
    spark.conf.set(SMALL_BYTES_KEY, str(limit))
    got = alerts.recursive_mean(points).toPandas().sort_values("point_id")
    spark.conf.set(SMALL_BYTES_KEY, str(2 ** 26))
    for _, g in got.groupby("metric"):
        assert g["baseline"].to_numpy() == pytest.approx(g["value"].ewm(alpha=0.1, adjust=False).mean().to_numpy())


def test_rule_trees(spark, points):
    c = lambda op, v: alerts.Condition("hot", "latest", op, v, 3600)
    yes, no = c(">=", 0.0), c("<", 0.0)
    rules = [alerts.Rule("and", alerts.Group("AND", (yes, no))), alerts.Rule("or", alerts.Group("OR", (yes, no))), alerts.Rule("not", alerts.Group("NOT", (yes, no))),
             alerts.Rule("empty", alerts.Group("OR", ()))]
    got = {r["rule_id"]: r["is_triggered"] for r in alerts.evaluate_rules(points, rules, "2024-01-01 05:00:00").collect()}
    assert got == {"and": 0, "or": 1, "not": 1, "empty": 0}


def test_firing_respects_cooldown_and_hourly_cap(spark):
    hits = spark.range(120).select(F.lit("r").alias("rule_id"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, cast(id as int), 0)").alias("minute"))
    minutes = sorted(r["minute"].hour * 60 + r["minute"].minute for r in alerts.fired(hits, 600, 3).collect())
    assert minutes == [0, 10, 20, 60, 70, 80]


def test_stream_cooldown_matches_batch(spark, points, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    # rows reach the stream in several files and out of order
    events = points.select(F.col("point_id").alias("event_id"), "ts", F.lit(1).cast("bigint").alias("user_id"), F.col("metric").alias("event_type"), "value", F.lit("{}").alias("props"))
    for i, part in enumerate(events.orderBy(F.desc("ts")).randomSplit([1.0, 1.0, 1.0], seed=1)):
        part.coalesce(1).write.parquet(f"{source}/run={i}")
    # a row of another metric, long after the others, closes the stream
    spark.sql("select -1L as event_id, timestamp_ntz'2024-03-01' as ts, 1L as user_id, 'end' as event_type, 99.0D as value, '{}' as props").write.parquet(f"{source}/run=end")
    stream = spark.readStream.schema("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").option("recursiveFileLookup", "true").parquet(source)
    stream = stream.select(F.col("event_type").alias("metric"), F.col("ts").cast("timestamp").alias("ts"), "value", F.col("event_id").alias("point_id"))
    monitors.run_to_end(monitors.cooled_alerts(stream.filter("value > 15"), 1200, late="6 hours"), out, str(tmp_path / "cp"))
    got = {(r["metric"], r["ts"]) for r in spark.read.schema("metric string, ts timestamp, value double").parquet(out).collect()}
    want = set()
    for metric, g in points.filter("value > 15").toPandas().sort_values("ts").groupby("metric"):
        last = None
        for r in g.itertuples():
            if last is None or (r.ts - last).total_seconds() >= 1200:
                want.add((metric, r.ts.to_pydatetime()))
                last = r.ts
    assert {x for x in got if x[0] != "end"} == want


def test_stream_dedup_and_latest(spark, points, tmp_path):
    source = str(tmp_path / "in")
    points.unionByName(points).write.parquet(source)
    stream = spark.readStream.schema(points.schema).parquet(source).withColumn("ts", F.col("ts").cast("timestamp"))
    name = f"d{uuid.uuid4().hex}"
    run = monitors.deduplicated(stream, ["point_id"]).writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table(name).count() == 300
    run = monitors.keep_latest(stream, str(tmp_path / "latest"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert {r["metric"]: r["point_id"] for r in spark.read.parquet(f"{tmp_path}/latest/version=0").collect()} == {"hot": 299, "cold": 297}


def test_forecast_is_deterministic_and_floored(spark):
    daily = spark.range(40).select(F.lit("s").alias("k"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(cast(id as int))").alias("date"), (40 - F.col("id")).cast("double").alias("value"))
    a, b = (forecast.seasonal_forecast(daily, "k", 60).toPandas() for _ in range(2))
    assert (a["predicted"] == b["predicted"]).all() and (a["predicted"] >= 0).all() and len(a) == 60
    flat = daily.withColumn("value", F.lit(3.0))
    assert forecast.ar2_forecast(flat, "k", 3).toPandas()["predicted"].tolist() == [3.0, 3.0, 3.0]


def test_plans_keep_rows_out_of_one_partition(spark):
    """No row-level sort of a whole table in one task once the input is not known to be small."""
    spark.conf.set(SMALL_BYTES_KEY, "0")
    try:
        import __spark_entry__ as entry
        for name in ("ua09_sessions", "ca21_idle_time", "rf09_lags", "cl16_interpolated", "fs10_point_in_time"):
            plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
            assert "SinglePartition" not in plan, name
    finally:
        spark.conf.set(SMALL_BYTES_KEY, str(2 ** 26))


def test_pushdown_reaches_the_scan(spark):
    from tidewatch.sources.tables import query_log
    plan = usage.volume_segments(query_log(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema"):]
    assert "props" not in schema and "user_id" in schema


def test_pair_correlations_match_pandas(spark):
    from tidewatch.operators.features_pattern import drop_correlated, pair_correlations
    df = spark.range(200).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2 + F.when(F.col("id") % 5 == 0, None).otherwise(0)).cast("double").alias("b"),
                                 ((F.col("id") * 37) % 101).cast("double").alias("c"), F.lit(1.0).alias("flat"))
    got = pair_correlations(df, df.columns)
    want = df.toPandas().corr().to_numpy()
    assert got[0, 1] == pytest.approx(1.0) and got[0, 2] == pytest.approx(want[0, 2]) and got[1, 2] == pytest.approx(want[1, 2]) and math.isnan(got[0, 3])
    assert drop_correlated(df).columns == ["a", "c", "flat"]


def test_cost_by_dimension_reads_once(spark, tmp_path):
    """Large inputs are read once, equal in result to small ones; the cost's median follows from that of the credits."""
    rows = [(f"w{i % 3}" if i % 11 else None, None if i % 7 == 0 else i * i % 101 / 7, float(i), float(i % 5), None if i % 3 == 1 else i % 13) for i in range(200)]
    names = "WAREHOUSE_NAME string, CREDITS_USED double, EXECUTION_TIME_MS double, BYTES_SCANNED double, ROWS_PRODUCED long"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/facts")
    facts = spark.read.parquet(f"{tmp_path}/facts")
    small = cost.cost_by_dimension(facts, "WAREHOUSE_NAME")
    spark.conf.set(SMALL_BYTES_KEY, "0")
    try:
        large = cost.cost_by_dimension(facts, "WAREHOUSE_NAME")
        assert not set(large.inputFiles()) & set(facts.inputFiles())
        got = {r["WAREHOUSE_NAME"]: r for r in large.collect()}
    finally:
        spark.conf.set(SMALL_BYTES_KEY, str(2 ** 26))
    assert large.columns == small.columns
    want = {r["WAREHOUSE_NAME"]: r for r in small.collect()}
    assert got.keys() == want.keys() == {"w0", "w1", "w2"}
    for k, row in want.items():
        assert list(got[k])[1:] == pytest.approx(list(row)[1:])
