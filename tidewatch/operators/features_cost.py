"""Row-level cost features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidewatch.functions.expressions import attach, clip, cut, flag, one_row, ratio
from tidewatch.functions.globals import TableStats, with_group
from tidewatch.functions.ordered import RowFrames, Slices, same_keys_join
from tidewatch.functions.quantiles import label, quantile_row
from tidewatch.functions.ranks import gini, with_ranks
from tidewatch.operators.features_usage import GIB, LEVELS, SIZES, lookup
from tidewatch.operators.usage import modes

INF = float("inf")
RATE = 2.0
# Cost and efficiency classes, credits per hour by size.
COST_CLASSES = ([0, 1, 10, 100, INF], ["low", "medium", "high", "very_high"])
EFFICIENCY_CLASSES = ([0, 0.2, 0.5, 0.8, 1], ["low", "medium", "high", "very_high"])
HOURLY_CREDITS = {"X-SMALL": 1, "SMALL": 2, "MEDIUM": 4, "LARGE": 8, "X-LARGE": 16, "2X-LARGE": 32, "3X-LARGE": 64, "4X-LARGE": 128}
C = "CREDITS_USED"


def basic_cost(df: DataFrame) -> DataFrame:
    """Cost, logs, class, zero and top-tenth flags, compute and cloud split, credits per elapsed hour."""
    stats = TableStats(df, [C], [0.9], ())
    x, cloud = F.col(C), F.col("CREDITS_USED_CLOUD_SERVICES")
    compute, hours = F.col("CREDITS_USED_COMPUTE"), F.col("TOTAL_ELAPSED_TIME") / 3.6e6
    return stats.done(stats.df.withColumns({
        "cost_usd": x * RATE, "log_credits_used": F.log1p(x), "log_cost_usd": F.log1p(x * RATE),
        "cost_category": cut(x, *COST_CLASSES, include_lowest=True), "is_zero_cost": flag(x == 0), "is_high_cost": flag(x > stats.q(C, 0.9)),
        "cost_usd_compute": compute * RATE, "cost_usd_cloud_services": cloud * RATE,
        "compute_credits_ratio": ratio(compute, compute + cloud), "cloud_services_credits_ratio": ratio(cloud, compute + cloud),
        "total_elapsed_time_hours": hours, "credits_per_hour": ratio(x, hours), "cost_per_hour_usd": ratio(x, hours) * RATE}))


def cost_efficiency(df: DataFrame) -> DataFrame:
    x, gb, t = F.col(C), F.col("BYTES_SCANNED") / GIB, F.col("EXECUTION_TIME_MS")
    rows, parts = F.col("ROWS_PRODUCED"), F.col("PARTITIONS_SCANNED")
    df = df.withColumns({
        "credits_per_gb_scanned": ratio(x, gb), "gb_per_credit": ratio(gb, x), "credits_per_million_rows": ratio(x, rows / 1e6),
        "rows_per_credit": ratio(rows, x), "credits_per_execution_hour": ratio(x, t / 3.6e6), "execution_time_per_credit": ratio(t, x),
        "credits_per_partition": ratio(x, parts), "partitions_per_credit": ratio(parts, x)})
    stats = TableStats(df, ["gb_per_credit", "execution_time_per_credit"], [0.1, 0.9], ())
    speed = stats.scaled("execution_time_per_credit")
    score = (F.coalesce(stats.scaled("gb_per_credit"), F.lit(0.0)) + F.coalesce(1 - speed, F.lit(1.0))) / 2
    out = stats.df.withColumn("cost_efficiency_score", score)
    return stats.done(out).withColumn("efficiency_category", cut(F.col("cost_efficiency_score"), *EFFICIENCY_CLASSES, include_lowest=True))


def cost_distribution(df: DataFrame) -> DataFrame:
    """Percentile flags and ratios, z, outlier, skew, kurtosis, percentile rank and concentration."""
    stats = TableStats(df, [C], LEVELS, ("mean", "std", "skew", "kurt"))
    out = {}
    for p in LEVELS:
        out |= {f"cost_above_{label(p)}": flag(F.col(C) > stats.q(C, p)), f"cost_ratio_to_{label(p)}": ratio(F.col(C), stats.q(C, p))}
    out |= {"cost_z_score": stats.z(C), "cost_is_outlier": flag(F.abs(stats.z(C)) > 3),
            "cost_skewness": F.when(stats.rows >= 10, stats.m(C, "skew")), "cost_kurtosis": F.when(stats.rows >= 10, stats.m(C, "kurt"))}
    rows = stats.done(stats.df.withColumns(out))
    # (n + 1 - 2*sum(cumulative)/total)/n equals the Gini coefficient
    rows = rows.withColumn("cost_concentration", gini(df, C).scalar())
    return with_ranks(rows, C, pct="cost_percentile_rank")


def warehouse_cost(df: DataFrame) -> DataFrame:
    x, hours = F.col(C), F.col("TOTAL_ELAPSED_TIME") / 3.6e6
    per_hour = F.coalesce(lookup(HOURLY_CREDITS, F.col("WAREHOUSE_SIZE")), F.lit(0))
    expected = per_hour * hours
    actual = ratio(x, expected)
    df = with_group(df, ["WAREHOUSE_NAME"], {"warehouse_usage_frequency": F.count("*"), "warehouse_avg_cost": F.avg(C)})
    df = df.withColumn("_top", modes(df, [], "WAREHOUSE_NAME", "v").scalar())
    return df.withColumns({
        "expected_credits_per_hour": per_hour, "warehouse_size_numeric": F.coalesce(lookup(SIZES, F.col("WAREHOUSE_SIZE")), F.lit(0)),
        "actual_vs_expected_credits_ratio": actual, "credits_variance_from_expected": x - expected, "warehouse_efficiency": ratio(F.lit(1.0), actual),
        "is_primary_warehouse": flag(F.col("WAREHOUSE_NAME") == F.col("_top")), "above_warehouse_avg_cost": flag(x > F.col("warehouse_avg_cost"))}).drop("_top")


def user_cost(df: DataFrame) -> DataFrame:
    users = df.dropna(subset=["USER_NAME"]).groupBy("USER_NAME").agg(F.sum(C).alias("user_total_cost"), F.avg(C).alias("user_avg_cost"), F.count("*").alias("_n"))
    users = with_ranks(users, "user_total_cost", dense="user_cost_rank")
    users = attach(users, quantile_row(users, ["user_total_cost"], [0.8]))
    users = users.withColumns({"is_high_cost_user": flag(F.col("user_total_cost") >= F.col("_s.user_total_cost_p80")),
                               "user_cost_per_query": F.col("user_total_cost") / F.col("_n")}).drop("_s", "_n")
    out = same_keys_join(df, users, ["USER_NAME"], "left")
    out = with_group(out, ["DATABASE_NAME"], {"database_total_cost": F.sum(C), "database_avg_cost": F.avg(C)})
    out = out.withColumn("_all", df.agg(F.sum(C)).scalar())
    against = F.when(F.col("user_avg_cost") != 0, F.col(C) / F.col("user_avg_cost"))
    return out.withColumns({
        "user_cost_vs_avg_ratio": against, "above_user_avg_cost": flag(against > 1),
        "database_cost_share": F.col("database_total_cost") / F.col("_all"), "above_database_avg_cost": flag(F.col(C) > F.col("database_avg_cost"))}).drop("_all")


def cost_optimisation(df: DataFrame) -> DataFrame:
    """Flags that need the efficiency, warehouse and distribution features, which are added first."""
    df = cost_efficiency(warehouse_cost(df))
    stats = TableStats(df, [C, "EXECUTION_TIME_MS"], [0.5, 0.8], ("mean", "std"))
    x, used = F.col(C), F.col("actual_vs_expected_credits_ratio")
    z = F.least(F.abs(F.coalesce(stats.z(C), F.lit(0.0))), F.lit(3.0)) / 3
    score = (z + (1 - F.col("cost_efficiency_score"))) / 2
    return stats.done(stats.df.withColumns({
        "optimization_candidate": flag((x > stats.q(C, 0.8)) & (F.col("EXECUTION_TIME_MS") > stats.q("EXECUTION_TIME_MS", 0.8))),
        "needs_optimization": flag(F.col("cost_efficiency_score") < 0.3), "warehouse_underutilized": flag(used < 0.5), "warehouse_overutilized": flag(used > 1.5),
        "high_cost_zero_results": flag((x > stats.q(C, 0.5)) & (F.col("ROWS_PRODUCED") == 0)),
        "cost_anomaly_score": score, "is_cost_anomaly": flag(score > 0.7)}))


def comparative_cost(df: DataFrame) -> DataFrame:
    stats = TableStats(df, [C], [0.25, 0.5, 0.75], ("mean", "std"))
    x, q1, median, q3 = F.col(C), stats.q(C, 0.25), stats.q(C, 0.5), stats.q(C, 0.75)
    mean, std, off = stats.m(C, "mean"), stats.m(C, "std"), F.abs(F.col(C) - stats.q(C, 0.5))
    return stats.done(stats.df.withColumns({
        "cost_vs_global_median": ratio(x, median), "cost_vs_global_mean": ratio(x, mean), "cost_below_median": flag(x < median),
        "cost_below_mean": flag(x < mean), "cost_within_iqr": flag((x >= q1) & (x <= q3)), "cost_above_q75": flag(x > q3), "cost_below_q25": flag(x < q1),
        "cost_deviation_from_median": off, "cost_deviation_normalized": ratio(off, std)}))


def cost_forecasting(df: DataFrame, keys: Sequence[str] = (), ts: str = "START_TIME", tie: str = "QUERY_ID") -> DataFrame:
    """Cumulative cost, means of the last 7 and 30 rows, velocity, acceleration, typical weekday and hour cost."""
    slices = Slices(df, list(keys), [ts, tie])
    rows = slices.done(slices.running(slices.df, {"cumulative_cost": F.col(C)}))
    frames = RowFrames(rows, list(keys), [ts, tie], before=30)
    w = frames.window
    step = F.coalesce(F.col(C) - F.lag(C).over(w), F.lit(0.0))
    rows = frames.df.withColumns({
        "cost_ma_7": F.avg(C).over(frames.rows(-6)), "cost_ma_30": F.avg(C).over(frames.rows(-29)), "cost_velocity": step})
    rows = rows.withColumn("cost_acceleration", F.coalesce(F.col("cost_velocity") - F.lag("cost_velocity").over(w), F.lit(0.0)))
    rows = frames.done(rows)
    t = F.col(ts)
    rows = rows.withColumns({"day_of_week": F.weekday(t), "hour_of_day": F.hour(t), "day_of_month": F.dayofmonth(t), "month_of_year": F.month(t)})
    rows = with_group(rows, ["day_of_week"], {"typical_dow_cost": F.avg(C)})
    rows = with_group(rows, ["hour_of_day"], {"typical_hour_cost": F.avg(C)})
    first, last = F.dayofmonth(t) == 1, F.dayofmonth(F.last_day(t)) == F.dayofmonth(t)
    return rows.withColumns({
        "cost_vs_typical_dow": F.when(F.col("typical_dow_cost") != 0, F.col(C) / F.col("typical_dow_cost")),
        "cost_vs_typical_hour": F.when(F.col("typical_hour_cost") != 0, F.col(C) / F.col("typical_hour_cost")),
        "is_month_start": flag(first), "is_month_end": flag(last), "is_quarter_start": flag(first & (F.month(t) % 3 == 1)),
        "is_quarter_end": flag(last & (F.month(t) % 3 == 0)), "days_since_month_start": F.datediff(t, F.trunc(t, "month")),
        "days_since_quarter_start": F.datediff(t, F.trunc(t, "quarter"))})


def all_cost_features(df: DataFrame) -> DataFrame:
    for step in (basic_cost, cost_distribution, user_cost, cost_optimisation, comparative_cost, cost_forecasting):
        df = step(df)
    return df
