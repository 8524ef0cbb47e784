"""Insight queries: parameterised reports and findings on cost and usage series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tidewatch.functions.expressions import attach, one_row, period

# The columns a report may group or filter by, and the period units.
GROUPABLE = ("WAREHOUSE_NAME", "DATABASE_NAME", "SCHEMA_NAME", "USER_NAME", "ROLE_NAME", "QUERY_TYPE", "SERVICE_TYPE")
PERIODS = ("hour", "day", "week", "month", "quarter", "year")
SEVERITIES = ("low", "medium", "high", "critical")


def in_range(df: DataFrame, time: str, start: str, end: str, where: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Rows with ``start <= time <= end`` and the given column values; bound parameters, no text splicing."""
    df = df.filter((F.col(time) >= F.lit(start).cast("timestamp_ntz")) & (F.col(time) <= F.lit(end).cast("timestamp_ntz")))
    for column, values in (where or {}).items():
        _allowed(column)
        df = df.filter(F.col(column).isin(*values))
    return df


def _allowed(column: str) -> None:
    if column not in GROUPABLE:
        raise ValueError(f"column {column} is not allowed here")


def _limited(df: DataFrame, order: Sequence[Column], limit: int | None) -> DataFrame:
    df = df.orderBy(*order)
    return df.limit(limit) if limit else df


def cost_overview(df: DataFrame, unit: str, start: str, end: str, limit: int | None = None, where=None, time="START_TIME") -> DataFrame:
    """Total, storage and compute cost per period, newest first."""
    if unit not in PERIODS:
        raise ValueError(f"period {unit} is not allowed")
    out = in_range(df, time, start, end, where).groupBy(period(F.col(time), unit).alias("period")).agg(
        F.sum("COST_USD").alias("total_cost"), F.sum("STORAGE_COST").alias("storage_cost"), F.sum("COMPUTE_COST").alias("compute_cost"))
    return _limited(out, [F.desc("period")], limit)


def cost_breakdown(df: DataFrame, by: str, start: str, end: str, limit: int | None = None, where=None, time="START_TIME") -> DataFrame:
    _allowed(by)
    out = in_range(df, time, start, end, where).groupBy(F.col(by).alias("category")).agg(
        F.sum("COST_USD").alias("total_cost"), F.count("*").alias("record_count"), F.avg("COST_USD").alias("avg_cost"))
    return _limited(out, [F.desc("total_cost"), F.col("category")], limit)


def usage_overview(df: DataFrame, unit: str, start: str, end: str, limit: int | None = None, where=None, time="START_TIME") -> DataFrame:
    if unit not in PERIODS:
        raise ValueError(f"period {unit} is not allowed")
    out = in_range(df, time, start, end, where).groupBy(period(F.col(time), unit).alias("period")).agg(
        F.count("*").alias("query_count"), F.sum("EXECUTION_TIME_MS").alias("total_execution_time"),
        F.avg("EXECUTION_TIME_MS").alias("avg_execution_time"), F.sum("BYTES_SCANNED").alias("total_bytes_scanned"))
    return _limited(out, [F.desc("period")], limit)


def user_activity(df: DataFrame, start: str, end: str, limit: int | None = None, where=None, time="DATE") -> DataFrame:
    """From daily user rows (USER_NAME, DATE, QUERY_COUNT, TOTAL_EXECUTION_TIME, SESSION_COUNT)."""
    out = in_range(df, time, start, end, where).groupBy("USER_NAME").agg(
        F.sum("QUERY_COUNT").alias("total_queries"), F.avg("TOTAL_EXECUTION_TIME").alias("avg_execution_time"),
        F.sum("SESSION_COUNT").alias("total_sessions"))
    return _limited(out, [F.desc("total_queries"), F.col("USER_NAME")], limit)


def warehouse_report(df: DataFrame, start: str, end: str, limit: int | None = None, where=None, time="START_TIME") -> DataFrame:
    out = in_range(df, time, start, end, where).groupBy("WAREHOUSE_NAME", F.col("SIZE").alias("warehouse_size")).agg(
        F.avg("UTILIZATION_PERCENT").alias("avg_utilization"), F.avg("QUEUE_TIME_SECONDS").alias("avg_queue_time"))
    return _limited(out, [F.desc("avg_utilization"), F.col("WAREHOUSE_NAME")], limit)


def slowest_queries(df: DataFrame, start: str, end: str, limit: int = 100, where=None, time="START_TIME") -> DataFrame:
    """The ``limit`` slowest queries with the first 100 characters of their text."""
    out = in_range(df, time, start, end, where).select(
        "QUERY_ID", "USER_NAME", "WAREHOUSE_NAME", "EXECUTION_TIME_MS", "BYTES_SCANNED", F.left("QUERY_TEXT", F.lit(100)).alias("query_preview"))
    return _limited(out, [F.desc("EXECUTION_TIME_MS"), F.col("QUERY_ID")], limit)


def daily_totals(df: DataFrame, value: str, time: str = "START_TIME", name: str = "cost") -> DataFrame:
    return df.groupBy(period(F.col(time), "day").alias("date")).agg(F.sum(value).alias(name))


def weekly_change(daily: DataFrame, limit: float = 20.0, high: float = 50.0) -> DataFrame:
    """Last 7 days against the 7 before; a row only when the change exceeds ``limit`` percent."""
    n = F.row_number().over(Window.orderBy(F.desc("date")))  # one row per calendar day
    row = daily.withColumn("_n", n).agg(
        F.sum(F.when(F.col("_n") <= 7, F.col("cost"))).alias("recent_week_cost"),
        F.sum(F.when(F.col("_n").between(8, 14), F.col("cost"))).alias("previous_week_cost"), F.count("*").alias("_days"))
    change = (F.col("recent_week_cost") - F.col("previous_week_cost")) / F.col("previous_week_cost") * 100
    out = row.filter((F.col("_days") >= 7) & (F.col("previous_week_cost") > 0)).withColumn("change_percent", change).drop("_days")
    return out.filter(F.abs("change_percent") > limit).withColumns({
        "direction": F.when(F.col("change_percent") > 0, "increased").otherwise("decreased"),
        "severity": F.when(F.abs("change_percent") > high, "high").otherwise("medium")})


def monthly_change(daily: DataFrame, limit: float = 15.0) -> DataFrame:
    """Mean of the last 2 ISO weeks against the 2 before."""
    weekly = daily.groupBy(period(F.col("date"), "week").alias("week")).agg(F.sum("cost").alias("cost"))
    n = F.row_number().over(Window.orderBy(F.desc("week")))  # one row per calendar week
    row = weekly.withColumn("_n", n).agg(
        F.avg(F.when(F.col("_n") <= 2, F.col("cost"))).alias("recent_weekly_avg"),
        F.avg(F.when(F.col("_n").between(3, 4), F.col("cost"))).alias("previous_weekly_avg"), F.count("*").alias("_weeks"))
    trend = (F.col("recent_weekly_avg") - F.col("previous_weekly_avg")) / F.col("previous_weekly_avg") * 100
    out = row.filter((F.col("_weeks") >= 4) & (F.col("previous_weekly_avg") > 0)).withColumn("trend_percent", trend).drop("_weeks")
    return out.filter(F.abs("trend_percent") > limit).withColumn(
        "direction", F.when(F.col("trend_percent") > 0, "upward").otherwise("downward"))


def warehouse_balance(df: DataFrame, share_limit: float = 60.0, ratio_limit: float = 10.0, key: str = "WAREHOUSE_NAME", cost: str = "COST_USD") -> DataFrame:
    """(finding, measure, top, bottom): one warehouse over 60 % of the cost; top over 10 times the bottom."""
    totals = df.dropna(subset=[key]).groupBy(key).agg(F.sum(cost).alias("c"))
    row = totals.agg(F.count("*").alias("n"), F.sum("c").alias("t"), F.max("c").alias("hi"), F.min("c").alias("lo"),
                     F.min_by(key, F.struct(-F.col("c"), F.col(key))).alias("top"),
                     F.min_by(key, F.struct(F.col("c"), F.col(key))).alias("bottom"))
    share, spread = F.col("hi") / F.col("t") * 100, F.col("hi") / F.col("lo")
    mark = lambda name, value: F.struct(F.lit(name).alias("finding"), value.alias("measure"), F.col("top"), F.col("bottom"))
    return row.select(F.explode(F.array_compact(F.array(
        F.when((F.col("n") > 1) & (share > share_limit), mark("cost_concentration", share)),
        F.when((F.col("n") > 2) & (spread > ratio_limit), mark("cost_imbalance", spread))))).alias("m")).select("m.*")


def cost_spikes(daily: DataFrame, percent: float = 50.0) -> DataFrame:
    """Days above the mean of their own trailing 7 days by more than ``percent``."""
    w = Window.orderBy("date").rowsBetween(-6, 0)  # one row per calendar day
    mean = F.when(F.count(F.lit(1)).over(w) == 7, F.avg("cost").over(w))
    out = daily.withColumn("average_cost", mean).filter("average_cost > 0")
    return (out.withColumn("spike_percent", (F.col("cost") - F.col("average_cost")) / F.col("average_cost") * 100)
            .filter(F.col("spike_percent") > percent))


def compute_storage_mix(df: DataFrame) -> DataFrame:
    """Compute and storage shares; a finding when compute is over 80 % or storage over 70 %."""
    row = df.agg(F.sum("COMPUTE_COST").alias("compute_cost"), F.sum("STORAGE_COST").alias("storage_cost"))
    total = F.col("compute_cost") + F.col("storage_cost")
    row = row.withColumn("total_cost", total).filter("total_cost > 0").withColumns({
        "compute_percent": F.col("compute_cost") / total * 100, "storage_percent": F.col("storage_cost") / total * 100})
    return row.withColumn("finding", F.when(F.col("compute_percent") > 80, "high_compute_ratio")
                          .when(F.col("storage_percent") > 70, "high_storage_ratio").otherwise("balanced"))


def warehouse_efficiency(df: DataFrame, key: str = "WAREHOUSE_NAME", credits: str = "CREDITS_USED", cost: str = "COST_USD") -> DataFrame:
    """(finding, warehouse, measure): cost per credit over 3; under 5 % of credits and under 10 credits."""
    totals = df.dropna(subset=[key]).groupBy(key).agg(F.sum(credits).alias("credits"), F.sum(cost).alias("cost"))
    totals = totals.withColumn("_all", totals.agg(F.sum("credits")).scalar())
    per, share = F.col("cost") / F.col("credits"), F.col("credits") / F.col("_all") * 100
    mark = lambda name, value: F.struct(F.lit(name).alias("finding"), F.col(key).alias("warehouse"), value.alias("measure"))
    return totals.select(F.explode(F.array_compact(F.array(
        F.when((F.col("credits") > 0) & (per > 3.0), mark("high_cost_per_credit", per)),
        F.when((F.col("_all") > 0) & (share < 5) & (F.col("credits") < 10), mark("idle_warehouse", share))))).alias("m")).select("m.*")


def credit_peak(daily: DataFrame, factor: float = 3.0) -> DataFrame:
    """The dearest day when it exceeds ``factor`` times the mean day (first day on a tie)."""
    row = daily.agg(F.max("cost").alias("max_credits"), F.avg("cost").alias("avg_credits"), F.count("*").alias("_n"),
                    F.min_by("date", F.struct(-F.col("cost"), F.col("date"))).alias("spike_date"))
    return (row.filter((F.col("_n") >= 7) & (F.col("max_credits") > F.col("avg_credits") * factor)).drop("_n")
            .withColumn("spike_ratio", F.col("max_credits") / F.col("avg_credits")))


def half_trend(daily: DataFrame, value: str, margin: float, medium: float) -> DataFrame:
    """Mean of the first half of the rows against the second half; a row unless stable."""
    n = F.row_number().over(Window.orderBy("date"))  # one row per calendar day
    rows = daily.withColumns({"_n": n, "_half": F.floor(F.count("*").over(Window.partitionBy()) / 2)})
    row = rows.agg(F.avg(F.when(F.col("_n") <= F.col("_half"), F.col(value))).alias("first_period_avg"),
                   F.avg(F.when(F.col("_n") > F.col("_half"), F.col(value))).alias("second_period_avg"), F.count("*").alias("_rows"))
    a, b = F.col("first_period_avg"), F.col("second_period_avg")
    row = row.withColumn("trend_direction", F.when(b > a * (1 + margin), "increasing").when(b < a * (1 - margin), "decreasing"))
    row = row.filter((F.col("_rows") >= 3) & F.col("trend_direction").isNotNull()).drop("_rows")
    row = row.withColumn("change_percent", F.abs(b - a) / a * 100)
    return row.withColumn("severity", F.when(F.col("change_percent") > medium, "medium").otherwise("low"))


def series_anomalies(daily: DataFrame, value: str, limit: float = 2.0) -> DataFrame:
    """Rows more than ``limit`` sample deviations from the mean."""
    stats = daily.agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    z = F.when(F.col("_s.s") > 0, F.abs((F.col(value) - F.col("_s.m")) / F.col("_s.s"))).otherwise(0.0)
    return (attach(daily, stats).withColumns({"mean_value": F.col("_s.m"), "z_score": z}).drop("_s")
            .filter(F.col("z_score") > limit))


def usage_findings(daily: DataFrame, df: DataFrame) -> DataFrame:
    """(finding, measure, mean): a day over twice the mean day; mean time over 30 s."""
    peak = daily.agg(F.max("query_count").cast("double").alias("measure"), F.avg("query_count").alias("mean"))
    slow = df.agg(F.avg("EXECUTION_TIME_MS").alias("measure"), F.avg("EXECUTION_TIME_MS").alias("mean"))
    return (peak.filter("measure > mean * 2").withColumn("finding", F.lit("peak_usage"))
            .unionByName(slow.filter("measure > 30000").withColumn("finding", F.lit("slow_queries"))))


def all_findings(costs: DataFrame, log: DataFrame) -> DataFrame:
    """(date, category, title, severity) of every finding on a cost table and a query log."""
    daily = daily_totals(costs, "COST_USD")
    counts = log.groupBy(period(F.col("START_TIME"), "day").alias("date")).agg(F.count("*").alias("query_count"))
    last = daily.agg(F.max("date").alias("d"))
    note = lambda df, category, title, severity, date=None: df.select(
        (F.col(date) if date else last.scalar()).alias("date"), F.lit(category).alias("category"),
        (title if isinstance(title, Column) else F.lit(title)).alias("title"),
        (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"))
    parts = [
        note(weekly_change(daily), "cost", "weekly_cost_trend", F.col("severity")),
        note(monthly_change(daily), "cost", "monthly_cost_trend", "medium"),
        note(warehouse_balance(costs), "cost", F.col("finding"), "medium"),
        note(cost_spikes(daily), "cost", "cost_spike", "high", "date"),
        note(compute_storage_mix(costs).filter("finding <> 'balanced'"), "cost", F.col("finding"), "medium"),
        note(series_anomalies(daily, "cost"), "anomaly", "cost_anomaly", "medium", "date"),
        note(series_anomalies(counts, "query_count"), "anomaly", "usage_anomaly", "medium", "date"),
        note(half_trend(daily, "cost", 0.1, 20.0), "trend", "cost_trend", F.col("severity")),
        note(half_trend(counts, "query_count", 0.2, 30.0), "trend", "usage_trend", F.col("severity")),
        note(usage_findings(counts, log), "usage", F.col("finding"), "medium")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def findings_summary(findings: DataFrame) -> DataFrame:
    """One row: how many findings, the worst severity, the largest category and the health status."""
    order = F.element_at(F.create_map(*[x for i, s in enumerate(SEVERITIES) for x in (F.lit(s), F.lit(i))]), F.col("severity"))
    by_kind = findings.groupBy("category").agg(F.count("*").alias("n"))
    worst = findings.agg(F.count("*").alias("total_insights"), F.max_by("severity", order).alias("overall_severity"),
                         *[F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in SEVERITIES])
    top = by_kind.agg(F.min_by("category", F.struct(-F.col("n"), F.col("category"))).alias("top_category"))
    row = one_row(worst, top)
    worst_is = F.col("overall_severity")
    return row.withColumns({
        "overall_severity": F.coalesce(worst_is, F.lit("low")), "top_category": F.coalesce("top_category", F.lit("general")),
        "health_status": F.when(worst_is == "critical", "critical issues detected").when(worst_is == "high", "attention required")
        .when(worst_is == "medium", "monitoring recommended").otherwise("system healthy")})


def findings_by_day(findings: DataFrame) -> DataFrame:
    """Findings per day in total and by severity."""
    return findings.groupBy("date").agg(F.count("*").alias("total_insights"),
                                        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def key_metrics(report: DataFrame, value: str, category: str | None = None, time: str | None = None) -> DataFrame:
    """One row: total, mean and extremes of a report, its top category and the first-to-last change."""
    aggs = [F.count("*").alias("row_count"), F.sum(value).alias("total"), F.avg(value).alias("mean"),
            F.max(value).alias("largest"), F.min(value).alias("smallest")]
    if category:
        aggs += [F.count_distinct(category).alias("categories"),
                 F.min_by(category, F.struct(-F.col(value), F.col(category))).alias("top_category")]
    if time:
        first, last = F.min_by(value, time), F.max_by(value, time)
        aggs.append(F.when((F.count("*") < 2) | (first == 0), F.lit(0.0)).otherwise((last - first) / first * 100).alias("trend_percent"))
    return report.agg(*aggs)
