"""Row-level usage features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.expressions import attach, clip, cut, flag, one_row, period, ratio
from tidewatch.functions.globals import TableStats, with_group
from tidewatch.functions.ordered import same_keys_join
from tidewatch.functions.quantiles import label, quantile_row
from tidewatch.functions.ranks import with_ranks

INF = float("inf")
GIB = 1024 ** 3
# Classes, statement kinds, size codes, roles.
TIME_CLASSES = ([0, 1000, 5000, 30000, 300000, INF], ["very_fast", "fast", "medium", "slow", "very_slow"])
QUEUE_CLASSES = ([0, 100, 1000, 10000, INF], ["no_queue", "short_queue", "medium_queue", "long_queue"])
VOLUME_CLASSES = ([0, 1024 ** 2, GIB, 10 * GIB, INF], ["small", "medium", "large", "very_large"])
ROW_CLASSES = ([0, 100, 10000, 1000000, INF], ["small", "medium", "large", "very_large"])
PARTITION_CLASSES = ([0, 1, 10, 100, INF], ["single", "few", "many", "massive"])
USER_CLASSES = ([0, 1, 10, 50, INF], ["rare", "occasional", "regular", "power"])
SESSION_CLASSES = ([0, 1, 5, 20, INF], ["single", "light", "moderate", "heavy"])
STATEMENTS = ("SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "DROP")
SIZES = {"X-SMALL": 1, "SMALL": 2, "MEDIUM": 3, "LARGE": 4, "X-LARGE": 5, "2X-LARGE": 6, "3X-LARGE": 7, "4X-LARGE": 8}
ROLES = ("SYSADMIN", "ACCOUNTADMIN", "PUBLIC", "ANALYST")
METRICS = {"execution_time": "EXECUTION_TIME_MS", "bytes_scanned": "BYTES_SCANNED", "rows_produced": "ROWS_PRODUCED"}
LEVELS = (0.25, 0.5, 0.75, 0.9, 0.95)


def lookup(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def basic_usage(df: DataFrame) -> DataFrame:
    t, q, c, b, r = (F.col(x) for x in ("EXECUTION_TIME_MS", "QUEUE_TIME_MS", "COMPILATION_TIME_MS", "BYTES_SCANNED", "ROWS_PRODUCED"))
    return df.withColumns({
        "execution_time_seconds": t / 1000, "execution_time_minutes": t / 60000, "log_execution_time": F.log1p(t),
        "execution_time_category": cut(t, *TIME_CLASSES, include_lowest=True),
        "queue_time_seconds": q / 1000, "log_queue_time": F.log1p(q), "queue_time_category": cut(q, *QUEUE_CLASSES, include_lowest=True),
        "log_compilation_time": F.log1p(c), "gb_scanned": b / GIB, "log_bytes_scanned": F.log1p(b),
        "data_volume_category": cut(b, *VOLUME_CLASSES, include_lowest=True),
        "log_rows_produced": F.log1p(r), "row_count_category": cut(r, *ROW_CLASSES, include_lowest=True)})


def efficiency(df: DataFrame) -> DataFrame:
    t, q, c, b, r = (F.col(x) for x in ("EXECUTION_TIME_MS", "QUEUE_TIME_MS", "COMPILATION_TIME_MS", "BYTES_SCANNED", "ROWS_PRODUCED"))
    per_row, throughput = ratio(b, r), ratio(b, t)
    return df.withColumns({
        "queue_to_execution_ratio": ratio(q, t), "total_time_ms": t + q, "execution_efficiency": ratio(t, t + q),
        "compilation_overhead_ratio": ratio(c, t), "bytes_per_row": per_row, "log_bytes_per_row": F.log1p(per_row),
        "data_throughput": throughput, "log_data_throughput": F.log1p(throughput), "row_processing_rate": ratio(r, t)})


def complexity(df: DataFrame, kind: str = "STATEMENT_TYPE") -> DataFrame:
    """Statement flags, partition class, size code, and .3 time + .3 bytes + .2 partitions + .2 size."""
    upper = F.upper(kind)
    stats = TableStats(df, ["EXECUTION_TIME_MS", "BYTES_SCANNED", "PARTITIONS_SCANNED"], [0.1, 0.9], moments=())
    size = F.coalesce(lookup(SIZES, F.col("WAREHOUSE_SIZE")), F.lit(0))
    score = (stats.scaled("EXECUTION_TIME_MS") * 0.3 + stats.scaled("BYTES_SCANNED") * 0.3
             + stats.scaled("PARTITIONS_SCANNED") * 0.2 + (size - 1) / 7 * 0.2)
    out = stats.df.withColumns({
        **{f"is_{s.lower()}_query": flag(F.contains(upper, F.lit(s))) for s in STATEMENTS},
        "is_ddl_query": flag(upper.rlike("CREATE|DROP|ALTER")), "is_dml_query": flag(upper.rlike("INSERT|UPDATE|DELETE")),
        "log_partitions_scanned": F.log1p("PARTITIONS_SCANNED"), "partition_complexity": cut(F.col("PARTITIONS_SCANNED"), *PARTITION_CLASSES, include_lowest=True),
        "warehouse_size_numeric": size, "query_complexity_score": clip(score, 0, 1)})
    return stats.done(out)


def utilisation(df: DataFrame) -> DataFrame:
    """Write amplification, modified rows and a score from execution efficiency and scaled throughput."""
    df = efficiency(df)
    stats = TableStats(df, ["data_throughput"], [0.1, 0.9], moments=())
    b, w, r = F.col("BYTES_SCANNED"), F.col("BYTES_WRITTEN"), F.col("ROWS_PRODUCED")
    modified = F.col("ROWS_INSERTED") + F.col("ROWS_UPDATED") + F.col("ROWS_DELETED")
    return stats.done(stats.df.withColumns({
        "write_amplification": ratio(w, b), "data_transformation_ratio": ratio(b - w, b), "total_modified_rows": modified,
        "modification_to_production_ratio": ratio(modified, r),
        "resource_utilization_score": (F.col("execution_efficiency") + stats.scaled("data_throughput")) / 2}))


def user_behavior(df: DataFrame) -> DataFrame:
    users = df.dropna(subset=["USER_NAME"]).groupBy("USER_NAME").agg(F.count("*").alias("user_query_frequency"))
    users = with_ranks(users, "user_query_frequency", dense="user_activity_rank")
    users = attach(users, quantile_row(users, ["user_query_frequency"], [0.8]))
    users = users.withColumn("is_high_activity_user", flag(F.col("user_query_frequency") >= F.col("_s.user_query_frequency_p80"))).drop("_s")
    out = same_keys_join(df, users, ["USER_NAME"], "left")
    out = with_group(out, ["ROLE_NAME"], {"role_usage_frequency": F.count("*")})
    out = with_group(out, ["SESSION_ID"], {"queries_per_session": F.count("*")})
    role = F.upper("ROLE_NAME")
    return out.withColumns({
        "user_activity_category": cut(F.col("user_query_frequency"), *USER_CLASSES, include_lowest=True),
        "session_activity_category": cut(F.col("queries_per_session"), *SESSION_CLASSES, include_lowest=True),
        **{f"is_{r.lower()}_role": flag(F.contains(role, F.lit(r))) for r in ROLES}})


def workload(df: DataFrame, ts: str = "START_TIME") -> DataFrame:
    """Frequencies of database and warehouse, the primary one, and rows per hour and day."""
    out = with_group(df, ["DATABASE_NAME"], {"database_usage_frequency": F.count("*")})
    out = with_group(out, ["WAREHOUSE_NAME"], {"warehouse_usage_frequency": F.count("*")})
    counts = df.dropna(subset=["DATABASE_NAME"]).groupBy("DATABASE_NAME").agg(F.count("*").alias("n"))
    top = counts.agg(F.min_by("DATABASE_NAME", F.struct(-F.col("n"), F.col("DATABASE_NAME"))).alias("primary"))
    kinds = df.select("WAREHOUSE_NAME").distinct().agg(F.count("WAREHOUSE_NAME").alias("warehouses"))
    out = attach(out, one_row(top, kinds))
    out = out.withColumns({"_hour": period(F.col(ts), "hour"), "_day": period(F.col(ts), "day")})
    out = with_group(out, ["_hour"], {"hourly_query_density": F.count("*")})
    out = with_group(out, ["_day"], {"daily_query_density": F.count("*")})
    return out.withColumns({"is_primary_database": flag(F.col("DATABASE_NAME") == F.col("_s.primary")),
                            "warehouse_diversity": F.col("_s.warehouses")}).drop("_s", "_hour", "_day")


def statistical(df: DataFrame) -> DataFrame:
    """Above-percentile flags, z-score, outlier flag, population skew and kurtosis (from 10 rows on)."""
    stats = TableStats(df, list(METRICS.values()), LEVELS, ("mean", "std", "skew", "kurt"))
    out = {}
    for name, c in METRICS.items():
        out |= {f"{name}_is_above_{label(p)}": flag(F.col(c) > stats.q(c, p)) for p in LEVELS}
        out |= {f"{name}_z_score": stats.z(c), f"{name}_is_outlier": flag(F.abs(stats.z(c)) > 3),
                f"{name}_skewness": F.when(stats.rows >= 10, stats.m(c, "skew")), f"{name}_kurtosis": F.when(stats.rows >= 10, stats.m(c, "kurt"))}
    return stats.done(stats.df.withColumns(out))


def comparative(df: DataFrame) -> DataFrame:
    """Each value against its user's mean and the global median and mean."""
    df = with_group(df, ["USER_NAME"], {f"_u_{n}": F.avg(METRICS[n]) for n in ("execution_time", "bytes_scanned")})
    stats = TableStats(df, list(METRICS.values()), [0.5], ("mean",))
    out = {}
    for n in ("execution_time", "bytes_scanned"):
        r = F.when(F.col(f"_u_{n}") != 0, F.col(METRICS[n]) / F.col(f"_u_{n}"))
        out |= {f"{n}_vs_user_avg_ratio": r, f"{n}_above_user_avg": flag(r > 1)}
    for n, c in METRICS.items():
        x, median, mean = F.col(c), stats.q(c, 0.5), stats.m(c, "mean")
        out |= {f"{n}_vs_global_median_ratio": F.when(median != 0, x / median), f"{n}_vs_global_mean_ratio": F.when(mean != 0, x / mean),
                f"{n}_above_global_median": flag(x > median), f"{n}_above_global_mean": flag(x > mean)}
    return stats.done(stats.df.withColumns(out)).drop("_u_execution_time", "_u_bytes_scanned")


def all_usage_features(df: DataFrame) -> DataFrame:
    for step in (basic_usage, complexity, utilisation, user_behavior, workload, statistical, comparative):
        df = step(df)
    return df
