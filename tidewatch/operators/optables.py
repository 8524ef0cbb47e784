"""Operational tables, logs and call statistics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch.functions.expressions import flag, one_row, period, seconds_between
from tidewatch.functions.ordered import same_keys_join
from tidewatch.functions.quantiles import group_quantiles

# The six operational tables.
TABLES = {
    "data_collection_runs": "run_id string, data_source string, started_at timestamp_ntz, finished_at timestamp_ntz, status string, records bigint, error string",
    "model_training_runs": "run_id string, model string, started_at timestamp_ntz, finished_at timestamp_ntz, status string, metrics string",
    "alert_history": "alert_id string, rule_id string, severity string, created_at timestamp_ntz, resolved_at timestamp_ntz, status string, message string",
    "system_metrics": "metric_name string, value double, at timestamp_ntz, labels map<string,string>",
    "configuration_history": "change_id string, config_key string, old_value string, new_value string, changed_at timestamp_ntz, changed_by string",
    "file_metadata": "file_path string, area string, size_bytes bigint, created_at timestamp_ntz, expires_at timestamp_ntz",
}
LEVEL = r"\b(DEBUG|INFO|WARNING|ERROR|CRITICAL)\b"


def create_tables(spark: SparkSession, root: str) -> None:
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{root}/{name}")


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def append(df: DataFrame, root: str, name: str) -> None:
    df.write.mode("append").parquet(f"{root}/{name}")


def newest(df: DataFrame, time: str, tie: str, where: Column | None = None, limit: int = 100) -> DataFrame:
    """History page: newest first."""
    if where is not None:
        df = df.filter(where)
    return df.orderBy(F.desc(time), tie).limit(limit)


def _ago(as_of: str, **parts) -> Column:
    return F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(**{k: F.lit(v) for k, v in parts.items()})


def recent_metrics(df: DataFrame, name: str, as_of: str, hours: int) -> DataFrame:
    return df.filter((F.col("metric_name") == name) & (F.col("at") >= _ago(as_of, hours=hours))).orderBy("at")


def expired_files(files: DataFrame, as_of: str) -> DataFrame:
    return files.filter(F.col("expires_at") < F.lit(as_of).cast("timestamp_ntz"))


def kept_records(df: DataFrame, time: str, as_of: str, days: int, only_resolved: bool = False) -> DataFrame:
    """Records after retention; with ``only_resolved`` open ones stay whatever their age."""
    old = F.col(time) < _ago(as_of, days=days)
    return df.filter(~(old & (F.col("status") == "resolved")) if only_resolved else ~old)


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        row = df.agg(F.lit(name).alias("table_name"), F.count("*").alias("rows"))
        out = row if out is None else out.unionByName(row)
    return out


def stored_bytes(spark: SparkSession, root: str) -> DataFrame:
    """(area, files, bytes) of the first folder level; only the listing is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    area = F.regexp_extract("path", root.rstrip("/") + r"/([^/]+)/", 1)
    return files.groupBy(area.alias("area")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def select_points(df: DataFrame, name: str, start: str, end: str, labels: Mapping[str, str] | None = None) -> DataFrame:
    """Metric points by name, time and label values (labels is a map column)."""
    t = F.col("at")
    df = df.filter((F.col("metric_name") == name) & (t >= F.lit(start).cast("timestamp_ntz")) & (t <= F.lit(end).cast("timestamp_ntz")))
    for k, v in (labels or {}).items():
        df = df.filter(F.col("labels")[k] == v)
    return df


def aggregate_points(df: DataFrame, as_of: str, minutes: int) -> DataFrame:
    rows = df.filter((F.col("at") >= _ago(as_of, mins=minutes)) & (F.col("at") <= F.lit(as_of).cast("timestamp_ntz")))
    return rows.groupBy("metric_name").agg(F.count("*").alias("points"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.sum("value").alias("sum"))


def log_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Text lines with their level; UNKNOWN when none is named."""
    level = F.regexp_extract(F.upper(column), LEVEL, 1)
    return lines.withColumn("level", F.when(level == "", "UNKNOWN").otherwise(level))


def level_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("level").agg(F.count("*").alias("lines"))


def endpoint_statistics(calls: DataFrame) -> DataFrame:
    """Per (method, endpoint): calls, times, p95 by index, error rate."""
    k = ["method", "endpoint"]
    out = calls.groupBy(*k).agg(F.count("*").alias("calls"), F.avg("duration_ms").alias("avg_ms"), F.min("duration_ms").alias("min_ms"), F.max("duration_ms").alias("max_ms"),
                                F.count_if(F.col("status") >= 400).alias("errors"), F.max("at").alias("last_call"))
    p = group_quantiles(calls, k, ["duration_ms"], [0.95], "index").withColumnRenamed("duration_ms_p95", "p95_ms")
    return same_keys_join(out, p, k, "left").withColumn("error_rate", F.col("errors") / F.col("calls"))


def slow_endpoints(stats: DataFrame, threshold_ms: float, limit: int = 10) -> DataFrame:
    return stats.filter(F.col("avg_ms") >= threshold_ms).orderBy(F.desc("avg_ms"), "endpoint", "method").limit(limit)


def failing_endpoints(stats: DataFrame, rate: float, least_calls: int = 10) -> DataFrame:
    return stats.filter((F.col("error_rate") >= rate) & (F.col("calls") >= least_calls))


def throughput(calls: DataFrame, as_of: str, minutes: int) -> DataFrame:
    rows = calls.filter((F.col("at") >= _ago(as_of, mins=minutes)) & (F.col("at") <= F.lit(as_of).cast("timestamp_ntz")))
    return rows.agg(F.count("*").alias("calls"), (F.count("*") / minutes).alias("calls_per_minute"), F.avg("duration_ms").alias("avg_ms"))


def traffic(calls: DataFrame) -> DataFrame:
    """(hour, calls, is_peak): traffic by hour of day."""
    hours = calls.groupBy(F.hour("at").alias("hour")).agg(F.count("*").alias("calls"))
    peak = hours.agg(F.min_by("hour", F.struct(-F.col("calls"), F.col("hour"))))
    return hours.withColumn("is_peak", flag(F.col("hour") == peak.scalar()))


def popularity(calls: DataFrame, limit: int = 20) -> DataFrame:
    return calls.groupBy("endpoint").agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), "endpoint").limit(limit)


def baseline_deviations(current: DataFrame, baseline: DataFrame, key: str, factor: float) -> DataFrame:
    """Values whose relative deviation from the baseline exceeds ``factor``."""
    rows = same_keys_join(current, baseline.select(key, F.col("value").alias("baseline")), [key], "inner")
    off = F.when(F.col("baseline") != 0, F.abs(F.col("value") - F.col("baseline")) / F.abs("baseline"))
    return rows.withColumn("deviation", off).filter(F.col("deviation") > factor)


def collection_summary(runs: DataFrame, as_of: str, hours: int) -> DataFrame:
    rows = runs.filter(F.col("started_at") >= _ago(as_of, hours=hours))
    return rows.groupBy("data_source").agg(
        F.count("*").alias("runs"), F.count_if(F.col("status") == "success").alias("successful"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.sum("records").alias("records"), F.avg(seconds_between(F.col("started_at"), F.col("finished_at"))).alias("avg_seconds"), F.max("finished_at").alias("last_finished"))
