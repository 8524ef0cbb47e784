"""Usage aggregation: totals, patterns, sessions, workload, users, warehouses, concurrency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from tidewatch.functions.expressions import attach, cut, flag, one_row, period, seconds_between
from tidewatch.functions.ordered import Slices, same_keys_join
from tidewatch.functions.quantiles import group_quantiles, quantile_row
from tidewatch.functions.ranks import with_ranks

# Limits of the segments and patterns.
INF = float("inf")
VOLUME = ([0, 10, 100, 1000, INF], ["low", "medium", "high", "very_high"])
CREDIT = ([0, 1, 10, 100, INF], ["light", "moderate", "heavy", "very_heavy"])
ACTIVITY = ([0, 4, 8, 16, 24], ["narrow", "focused", "broad", "continuous"])
COMPLEXITY = ([0, 1000, 10000, 60000, INF], ["simple", "moderate", "complex", "very_complex"])
EFFICIENCY = ([0, 0.001, 0.01, 0.1, INF], ["very_efficient", "efficient", "moderate", "inefficient"])
PERCENTILES = (0.5, 0.75, 0.9, 0.95, 0.99)
MIN_FREQUENCY = 5
SESSION_MINUTES = 60.0
SESSION_ROWS = 3
TIME = "START_TIME"


def _span_hours():
    us = F.unix_micros(F.col(TIME).cast("timestamp"))
    return (F.max(us) - F.min(us)) / 3.6e9


def modes(df: DataFrame, keys: Sequence[str], column: str, value: str, size: str | None = None) -> DataFrame:
    """Most frequent value of ``column`` per group (smallest on a tie) and optionally its count.

    Counts (group, value) pairs first: a hot group is reduced before it meets one task.
    """
    keys = list(keys)
    pairs = df.filter(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    best = F.struct((-F.col("_n")).alias("neg"), F.col("_v").alias("v"))
    out = pairs.groupBy(*keys).agg(F.min(best).alias("_b"))
    cols = [F.col("_b.v").alias(value)] + ([(-F.col("_b.neg")).alias(size)] if size else [])
    return out.select(*keys, *cols)


def distincts(df: DataFrame, keys: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """Distinct counts per group, by first reducing to distinct pairs: ``{column: output}``."""
    keys = list(keys)
    pairs = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])).alias("p"))
    pairs = pairs.filter("p.v is not null").select(*keys, "p.c", "p.v").distinct()
    return pairs.groupBy(*keys).agg(*[F.count(F.when(F.col("c") == c, 1)).alias(name) for c, name in columns.items()])


def basic_usage(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row: totals, distinct counts, span, rates, metric statistics, time distribution."""
    n = F.count(F.lit(1))
    row = df.agg(
        n.alias("total_queries"), _span_hours().alias("analysis_period_hours"),
        (n / F.greatest(_span_hours(), F.lit(1.0))).alias("queries_per_hour"),
        F.min(TIME).alias("analysis_start"), F.max(TIME).alias("analysis_end"),
        *[f(m).alias(f"{m}_{k}") for m in metrics for k, f in (("total", F.sum), ("mean", F.avg), ("std", F.stddev_samp))])
    distinct = distincts(df, [], {"USER_NAME": "unique_users", "WAREHOUSE_NAME": "unique_warehouses",
                                  "DATABASE_NAME": "unique_databases"})
    q = quantile_row(df, list(metrics), list(PERCENTILES))
    q = q.withColumns({f"{m}_median": F.col(f"{m}_p50") for m in metrics})
    return one_row(row, distinct, q, time_distribution(df))


def time_distribution(df: DataFrame, business: tuple[int, int] = (9, 17)) -> DataFrame:
    """One row: peak and off-peak hour, spread over hours, peak weekday, weekend and office-hour shares."""
    cells = df.groupBy(F.hour(TIME).alias("hour"), F.weekday(TIME).alias("dow")).agg(F.count("*").alias("n"))
    hours = cells.groupBy("hour").agg(F.sum("n").alias("n"))
    days = cells.groupBy("dow").agg(F.sum("n").alias("n"))
    by_hour = hours.agg(
        F.min(F.struct((-F.col("n")).alias("n"), "hour"))["hour"].alias("peak_hour"),
        F.min(F.struct("n", "hour"))["hour"].alias("off_peak_hour"),
        F.var_samp("n").alias("hour_variance"),
        (F.sum(F.when(F.col("hour").between(*business), F.col("n")).otherwise(0)) / F.sum("n")).alias("business_hours_query_ratio"))
    by_day = days.agg(
        F.min(F.struct((-F.col("n")).alias("n"), "dow"))["dow"].alias("peak_day_of_week"),
        (F.sum(F.when(F.col("dow") >= 5, F.col("n")).otherwise(0)) / F.sum("n")).alias("weekend_query_ratio"))
    return one_row(by_hour, by_day)


def query_type_patterns(df: DataFrame) -> DataFrame:
    rows = df.dropna(subset=["QUERY_TYPE"])
    agg = rows.groupBy("QUERY_TYPE").agg(
        F.count("QUERY_ID").alias("QUERY_ID_count"), F.sum("CREDITS_USED").alias("CREDITS_USED_sum"),
        F.avg("CREDITS_USED").alias("CREDITS_USED_mean"), F.stddev_samp("CREDITS_USED").alias("CREDITS_USED_std"),
        F.avg("EXECUTION_TIME_MS").alias("EXECUTION_TIME_MS_mean"),
        F.stddev_samp("EXECUTION_TIME_MS").alias("EXECUTION_TIME_MS_std"))
    medians = group_quantiles(rows, ["QUERY_TYPE"], ["EXECUTION_TIME_MS"], [0.5])
    medians = medians.withColumnRenamed("EXECUTION_TIME_MS_p50", "EXECUTION_TIME_MS_median")
    return same_keys_join(agg, medians, ["QUERY_TYPE"], "left").withColumn("pattern_type", F.lit("query_type"))


def _patterns(df: DataFrame, keys: Sequence[str], name: str, spread: bool, users: bool, minimum: int) -> DataFrame:
    keys = [k for k in keys if k in df.columns]
    rows = df.dropna(subset=keys)
    aggs = [F.count("QUERY_ID").alias("QUERY_ID_count"), F.sum("CREDITS_USED").alias("CREDITS_USED_sum"),
            F.avg("CREDITS_USED").alias("CREDITS_USED_mean")]
    if spread:
        aggs += [F.stddev_samp("CREDITS_USED").alias("CREDITS_USED_std"),
                 F.avg("EXECUTION_TIME_MS").alias("EXECUTION_TIME_MS_mean"),
                 F.stddev_samp("EXECUTION_TIME_MS").alias("EXECUTION_TIME_MS_std")]
    out = rows.groupBy(*keys).agg(*aggs)
    if users:
        out = same_keys_join(out, distincts(rows, keys, {"USER_NAME": "USER_NAME_nunique"}), keys, "left")
    return out.filter(F.col("QUERY_ID_count") >= minimum).withColumn("pattern_type", F.lit(name))


def database_patterns(df: DataFrame, minimum: int = MIN_FREQUENCY) -> DataFrame:
    return _patterns(df, ["DATABASE_NAME", "SCHEMA_NAME"], "database_access", False, True, minimum)


def user_patterns(df: DataFrame, minimum: int = MIN_FREQUENCY) -> DataFrame:
    return _patterns(df, ["USER_NAME", "QUERY_TYPE"], "user_query", True, False, minimum)


def warehouse_patterns(df: DataFrame, minimum: int = MIN_FREQUENCY) -> DataFrame:
    return _patterns(df, ["WAREHOUSE_NAME", "QUERY_TYPE"], "warehouse_usage", False, True, minimum)


def all_patterns(df: DataFrame, minimum: int = MIN_FREQUENCY) -> DataFrame:
    """The four pattern tables stacked, ranked within each kind."""
    out = query_type_patterns(df)
    for part in (database_patterns(df, minimum), user_patterns(df, minimum), warehouse_patterns(df, minimum)):
        out = out.unionByName(part, allowMissingColumns=True)
    # equal totals must tie whatever order their rows were added in
    return rank_patterns(out.withColumn("CREDITS_USED_sum", F.round("CREDITS_USED_sum", 9)))


def rank_patterns(patterns: DataFrame) -> DataFrame:
    by = ["pattern_type"]
    out = with_ranks(patterns, "QUERY_ID_count", by, "frequency_rank", "frequency_percentile")
    out = with_ranks(out, "CREDITS_USED_sum", by, "cost_rank", "cost_percentile")
    return out.withColumns({"is_high_frequency": flag(F.col("frequency_percentile") >= 0.8),
                            "is_rare_pattern": flag(F.col("frequency_percentile") <= 0.2),
                            "is_high_cost_pattern": flag(F.col("cost_percentile") >= 0.8)})


def with_sessions(df: DataFrame, user: str = "USER_NAME", ts: str = TIME, tie: str = "QUERY_ID",
                  minutes: float = SESSION_MINUTES) -> DataFrame:
    """Number the sessions of each user: a new one starts after a gap above ``minutes``."""
    slices = Slices(df.dropna(subset=[user]), [user], [ts, tie])
    rows = slices.previous(slices.df, {"_before": ts})
    gap = seconds_between(F.col("_before"), F.col(ts)) / 60
    rows = slices.running(rows, {"session_id": flag(gap > minutes)})
    return slices.done(rows).drop("_before")


def session_statistics(df: DataFrame, minutes: float = SESSION_MINUTES, min_rows: int = SESSION_ROWS) -> DataFrame:
    """One row per session with at least ``min_rows`` queries."""
    rows = with_sessions(df, minutes=minutes)
    us = F.unix_micros(F.col(TIME).cast("timestamp"))
    keys = ["USER_NAME", "session_id"]
    out = rows.groupBy(*keys).agg(
        F.min(TIME).alias("session_start"), F.max(TIME).alias("session_end"),
        ((F.max(us) - F.min(us)) / 6e7).alias("session_duration_minutes"), F.count("*").alias("query_count"),
        F.sum("CREDITS_USED").alias("total_credits"), F.avg("CREDITS_USED").alias("avg_credits_per_query"),
        F.sum("EXECUTION_TIME_MS").alias("total_execution_time_ms"), F.avg("EXECUTION_TIME_MS").alias("avg_execution_time_ms"),
        F.count_distinct("QUERY_TYPE").alias("unique_query_types"),
        F.count_distinct("DATABASE_NAME").alias("unique_databases"))
    out = out.filter(F.col("query_count") >= min_rows)
    floor = F.greatest("session_duration_minutes", F.lit(1.0))
    return out.withColumns({
        "queries_per_minute": F.col("query_count") / floor, "credits_per_minute": F.col("total_credits") / floor,
        "query_type_diversity": F.col("unique_query_types") / F.col("query_count"),
        "database_diversity": F.col("unique_databases") / F.col("query_count"),
    }).withColumnRenamed("USER_NAME", "user_name").drop("session_id")


def workload(df: DataFrame) -> DataFrame:
    """Load by hour of day, weekday and date in one pass, with peak flags and credit ranks."""
    rows = df.select("QUERY_ID", "CREDITS_USED", "EXECUTION_TIME_MS", F.hour(TIME).alias("hour"),
                     F.weekday(TIME).alias("day_of_week"), period(F.col(TIME), "day").alias("date"))
    sets = [[F.col("hour")], [F.col("day_of_week")], [F.col("date")]]
    kind = (F.when(F.grouping("hour") == 0, "hourly").when(F.grouping("day_of_week") == 0, "day_of_week")
            .otherwise("daily"))
    out = rows.groupingSets(sets, "hour", "day_of_week", "date").agg(
        F.count("QUERY_ID").alias("QUERY_ID_count"), F.sum("CREDITS_USED").alias("CREDITS_USED_sum"),
        F.avg("CREDITS_USED").alias("CREDITS_USED_mean"), F.sum("EXECUTION_TIME_MS").alias("EXECUTION_TIME_MS_sum"),
        F.avg("EXECUTION_TIME_MS").alias("EXECUTION_TIME_MS_mean"), kind.alias("pattern_type"))
    limits = out.agg(F.expr("percentile(QUERY_ID_count, 0.9D)").alias("hi"),
                     F.expr("percentile(QUERY_ID_count, 0.25D)").alias("lo"))
    out = attach(out, limits)
    out = out.withColumns({"is_peak_period": flag(F.col("QUERY_ID_count") >= F.col("_s.hi")),
                           "is_off_peak_period": flag(F.col("QUERY_ID_count") <= F.col("_s.lo"))}).drop("_s")
    return with_ranks(out, "CREDITS_USED_sum", dense="credits_rank", pct="credits_percentile")


def user_behavior(df: DataFrame) -> DataFrame:
    """One row per user: activity, preferences and resource use, with segments."""
    k = ["USER_NAME"]
    rows = df.dropna(subset=k).withColumns({"_hour": F.hour(TIME), "_dow": F.weekday(TIME)})
    us = F.unix_micros(F.col(TIME).cast("timestamp"))
    out = rows.groupBy(*k).agg(
        F.count("*").alias("total_queries"), F.min(TIME).alias("first_query"), F.max(TIME).alias("last_query"),
        (F.floor((F.max(us) - F.min(us)) / 86_400_000_000) + 1).alias("activity_period_days"),
        F.sum("CREDITS_USED").alias("total_credits"), F.avg("CREDITS_USED").alias("avg_credits_per_query"),
        F.stddev_samp("CREDITS_USED").alias("credits_std"), F.max("CREDITS_USED").alias("max_single_query_credits"),
        F.avg("EXECUTION_TIME_MS").alias("avg_execution_time_ms"),
        F.stddev_samp("EXECUTION_TIME_MS").alias("execution_time_std"),
        F.max("EXECUTION_TIME_MS").alias("max_execution_time_ms"),
        F.avg("BYTES_SCANNED").alias("avg_bytes_scanned"), F.max("BYTES_SCANNED").alias("max_bytes_scanned"))
    parts = [
        modes(rows, k, "_hour", "most_active_hour"), modes(rows, k, "_dow", "most_active_day"),
        modes(rows, k, "QUERY_TYPE", "primary_query_type", "_type_rows"),
        modes(rows, k, "DATABASE_NAME", "primary_database"), modes(rows, k, "WAREHOUSE_NAME", "primary_warehouse"),
        distincts(rows, k, {"_hour": "hour_diversity", "QUERY_TYPE": "query_type_diversity",
                            "DATABASE_NAME": "unique_databases_accessed", "WAREHOUSE_NAME": "unique_warehouses_used"}),
    ]
    for part in parts:
        out = same_keys_join(out, part, k, "left")
    out = out.withColumns({
        "queries_per_day": F.col("total_queries") / F.greatest("activity_period_days", F.lit(1)),
        "query_type_concentration": F.col("_type_rows") / F.col("total_queries")}).drop("_type_rows")
    return add_user_segments(out).withColumnRenamed("USER_NAME", "user_name")


def add_user_segments(users: DataFrame) -> DataFrame:
    return users.withColumns({
        "volume_segment": cut(F.col("total_queries"), *VOLUME), "credit_segment": cut(F.col("total_credits"), *CREDIT),
        "activity_pattern": cut(F.col("hour_diversity"), *ACTIVITY),
        "complexity_segment": cut(F.col("avg_execution_time_ms"), *COMPLEXITY)})


def warehouse_utilization(df: DataFrame) -> DataFrame:
    k = ["WAREHOUSE_NAME"]
    rows = df.dropna(subset=k).withColumn("_hour", F.hour(TIME))
    out = rows.groupBy(*k).agg(
        F.count("*").alias("total_queries"), F.min(TIME).alias("first_query"), F.max(TIME).alias("last_query"),
        _span_hours().alias("activity_period_hours"),
        F.sum("CREDITS_USED").alias("total_credits"), F.avg("CREDITS_USED").alias("avg_credits_per_query"),
        F.max("CREDITS_USED").alias("max_single_query_credits"),
        F.avg("EXECUTION_TIME_MS").alias("avg_execution_time_ms"), F.max("EXECUTION_TIME_MS").alias("max_execution_time_ms"))
    p95 = group_quantiles(rows, k, ["EXECUTION_TIME_MS"], [0.95]).withColumnRenamed("EXECUTION_TIME_MS_p95", "execution_time_p95")
    parts = [
        p95, modes(rows, k, "USER_NAME", "primary_user", "_user_rows"), modes(rows, k, "QUERY_TYPE", "primary_query_type"),
        modes(rows, k, "DATABASE_NAME", "primary_database"), modes(rows, k, "_hour", "peak_hour"),
        distincts(rows, k, {"USER_NAME": "unique_users", "QUERY_TYPE": "unique_query_types",
                            "DATABASE_NAME": "unique_databases", "_hour": "active_hours"})]
    for part in parts:
        out = same_keys_join(out, part, k, "left")
    hours = F.greatest("activity_period_hours", F.lit(1.0))
    return out.withColumns({
        "queries_per_hour": F.col("total_queries") / hours, "credits_per_hour": F.col("total_credits") / hours,
        "user_concentration": F.col("_user_rows") / F.col("total_queries")}) \
        .drop("_user_rows").withColumnRenamed("WAREHOUSE_NAME", "warehouse_name")


def add_warehouse_efficiency(wh: DataFrame) -> DataFrame:
    wh = with_ranks(wh, "queries_per_hour", dense="query_efficiency_rank", pct="query_efficiency_percentile")
    wh = with_ranks(wh, "credits_per_hour", dense="credit_efficiency_rank", pct="credit_efficiency_percentile")
    wh = wh.withColumn("queries_per_user", F.col("total_queries") / F.col("unique_users"))
    return with_ranks(wh, "queries_per_user", dense="user_utilization_rank")


def max_concurrency(df: DataFrame, key: str = "WAREHOUSE_NAME", start: str = TIME, end: str = "END_TIME") -> DataFrame:
    """Largest number of open intervals per key; a row without end never closes.

    Starts and ends become +1 and -1 events; at one instant starts count before ends.
    """
    rows = df.dropna(subset=[key])
    events = rows.select(key, F.explode(F.array(
        F.struct(F.col(start).alias("t"), F.lit(0).alias("order"), F.lit(1).alias("delta")),
        F.struct(F.col(end).alias("t"), F.lit(1).alias("order"), F.lit(-1).alias("delta")))).alias("e"))
    steps = (events.select(key, "e.*").filter("t is not null")
             .groupBy(key, "t", "order").agg(F.sum("delta").alias("delta")))
    slices = Slices(steps, [key], ["t", "order"])
    open_now = slices.running(slices.df, {"_open": F.col("delta")})
    return open_now.groupBy(key).agg(F.max("_open").alias("estimated_max_concurrency"))


def hourly_load(df: DataFrame) -> DataFrame:
    return (df.dropna(subset=["WAREHOUSE_NAME"]).groupBy("WAREHOUSE_NAME", F.hour(TIME).alias("hour"))
            .agg(F.count("*").alias("n"), F.stddev_samp("EXECUTION_TIME_MS").alias("spread")))


def warehouse_capacity(df: DataFrame) -> DataFrame:
    """Peak, mean and deviation of the load per hour of day, and the largest concurrency."""
    load = hourly_load(df).groupBy("WAREHOUSE_NAME").agg(
        F.max("n").alias("peak_hourly_load"), F.avg("n").alias("avg_hourly_load"),
        F.stddev_samp("n").alias("load_variability"))
    return same_keys_join(load, max_concurrency(df), ["WAREHOUSE_NAME"], "left")


def concurrency_patterns(df: DataFrame) -> DataFrame:
    return hourly_load(df).groupBy("WAREHOUSE_NAME").agg(
        F.avg("n").alias("avg_hourly_queries"), F.max("n").alias("peak_hourly_queries"),
        F.var_samp("n").alias("concurrency_variance"),
        F.min(F.struct((-F.col("n")).alias("n"), "hour"))["hour"].alias("peak_hour"))


def resource_contention(df: DataFrame) -> DataFrame:
    """Hours of day whose time deviation exceeds the 80th percentile of the hourly deviations."""
    hours = hourly_load(df)
    limits = hours.groupBy("WAREHOUSE_NAME").agg(F.expr("percentile(spread, 0.8D)").alias("_limit"))
    hours = same_keys_join(hours, limits, ["WAREHOUSE_NAME"], "left")
    high = F.count_if(F.col("spread") > F.col("_limit"))
    return hours.groupBy("WAREHOUSE_NAME").agg(
        high.alias("high_contention_hours"), F.avg("spread").alias("avg_execution_variance"),
        F.min(F.struct((-F.col("spread")).alias("s"), "hour"))["hour"].alias("peak_variance_hour"),
        (high / F.count(F.lit(1))).alias("contention_indicator"))


def forecasting_features(df: DataFrame) -> DataFrame:
    """Daily queries, credits and users with relative changes and full 7-day means."""
    rows = df.withColumn("date", period(F.col(TIME), "day"))
    daily = rows.groupBy("date").agg(F.count("QUERY_ID").alias("daily_queries"), F.sum("CREDITS_USED").alias("daily_credits"))
    daily = same_keys_join(daily, distincts(rows, ["date"], {"USER_NAME": "daily_users"}), ["date"], "left")
    w = Window.orderBy("date")  # one row per calendar day
    week = w.rowsBetween(-6, 0)
    out = {}
    for c, name in (("daily_queries", "query"), ("daily_credits", "credit"), ("daily_users", "user")):
        before = F.lag(c).over(w)
        out[f"{name}_trend"] = F.when(before != 0, (F.col(c) - before) / before)
        if name != "user":
            out[f"{name}_ma_7"] = F.when(F.count(F.lit(1)).over(week) == 7, F.avg(c).over(week))
    dow = F.weekday("date")
    return daily.withColumns(out | {"day_of_week": dow, "is_weekend": flag(dow >= 5)})


def volume_segments(df: DataFrame) -> DataFrame:
    out = df.dropna(subset=["USER_NAME"]).groupBy("USER_NAME").agg(
        F.count("QUERY_ID").alias("query_count"), F.sum("CREDITS_USED").alias("total_credits"))
    return out.withColumn("volume_segment", cut(F.col("query_count"), *VOLUME))


def efficiency_segments(df: DataFrame) -> DataFrame:
    out = df.dropna(subset=["USER_NAME"]).groupBy("USER_NAME").agg(
        F.sum("CREDITS_USED").alias("CREDITS_USED_sum"), F.avg("CREDITS_USED").alias("CREDITS_USED_mean"),
        F.avg("EXECUTION_TIME_MS").alias("EXECUTION_TIME_MS_mean"), F.sum("ROWS_PRODUCED").alias("ROWS_PRODUCED_sum"))
    out = out.withColumn("credits_per_row", F.col("CREDITS_USED_sum") / (F.col("ROWS_PRODUCED_sum") + 1))
    return out.withColumn("efficiency_segment", cut(F.col("credits_per_row"), *EFFICIENCY))


def usage_tables(df: DataFrame, metrics: Sequence[str], advanced: bool = False) -> dict[str, DataFrame]:
    """All usage tables by name, lazy."""
    out = {"basic_usage": basic_usage(df, metrics), "query_patterns": all_patterns(df),
           "session_analysis": session_statistics(df), "workload_patterns": workload(df),
           "user_behavior": user_behavior(df), "warehouse_utilization": warehouse_utilization(df)}
    if advanced:
        out |= {"concurrency_analysis": concurrency_patterns(df), "resource_contention": resource_contention(df),
                "usage_forecasting": forecasting_features(df)}
    return out


def patterns_view(df: DataFrame, kind: str) -> DataFrame:
    """Execution, temporal or resource patterns."""
    views = {"execution": all_patterns, "temporal": workload, "resource": concurrency_patterns}
    if kind not in views:
        raise ValueError(f"Unsupported pattern type: {kind}")
    return views[kind](df)


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, rows) of a bag of tables."""
    parts = [t.agg(F.lit(name).alias("table_name"), F.count("*").alias("rows")) for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
