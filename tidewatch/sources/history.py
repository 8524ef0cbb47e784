"""History sources: declared columns, incremental pulls and collection marks."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.functions.expressions import one_row
from tidewatch.functions.ordered import same_keys_join


@dataclass(frozen=True)
class Source:
    table: str
    time: str
    keys: tuple[str, ...]
    description: str
    columns: tuple[str, ...]


# The four history sources and the columns read from each.
SOURCES = {
    "warehouse_usage": Source(
        "warehouse_usage_raw", "START_TIME", ("START_TIME", "WAREHOUSE_ID"), "Metering per warehouse",
        ("START_TIME", "END_TIME", "WAREHOUSE_ID", "WAREHOUSE_NAME", "CREDITS_USED", "CREDITS_USED_COMPUTE",
         "CREDITS_USED_CLOUD_SERVICES", "BYTES_SCANNED", "BYTES_WRITTEN", "BYTES_DELETED",
         "BYTES_SPILLED_TO_REMOTE_STORAGE", "BYTES_SPILLED_TO_LOCAL_STORAGE", "BYTES_SENT_OVER_THE_NETWORK")),
    "query_history": Source(
        "query_history_raw", "START_TIME", ("QUERY_ID",), "Query executions",
        ("QUERY_ID", "QUERY_TEXT", "DATABASE_NAME", "SCHEMA_NAME", "QUERY_TYPE", "SESSION_ID", "USER_NAME",
         "ROLE_NAME", "WAREHOUSE_NAME", "WAREHOUSE_SIZE", "WAREHOUSE_TYPE", "CLUSTER_NUMBER", "QUERY_TAG",
         "EXECUTION_STATUS", "ERROR_CODE", "ERROR_MESSAGE", "START_TIME", "END_TIME", "TOTAL_ELAPSED_TIME",
         "BYTES_SCANNED", "PERCENTAGE_SCANNED_FROM_CACHE", "BYTES_WRITTEN", "BYTES_WRITTEN_TO_RESULT",
         "BYTES_READ_FROM_RESULT", "ROWS_PRODUCED", "ROWS_INSERTED", "ROWS_UPDATED", "ROWS_DELETED", "ROWS_UNLOADED",
         "BYTES_DELETED", "PARTITIONS_SCANNED", "PARTITIONS_TOTAL", "BYTES_SPILLED_TO_LOCAL_STORAGE",
         "BYTES_SPILLED_TO_REMOTE_STORAGE", "BYTES_SENT_OVER_THE_NETWORK", "COMPILATION_TIME", "EXECUTION_TIME",
         "QUEUED_PROVISIONING_TIME", "QUEUED_REPAIR_TIME", "QUEUED_OVERLOAD_TIME", "TRANSACTION_BLOCKED_TIME",
         "OUTBOUND_DATA_TRANSFER_CLOUD", "OUTBOUND_DATA_TRANSFER_REGION", "OUTBOUND_DATA_TRANSFER_BYTES",
         "INBOUND_DATA_TRANSFER_BYTES", "CREDITS_USED_CLOUD_SERVICES", "RELEASE_VERSION", "DRIVER_TYPE",
         "DRIVER_VERSION", "CLIENT_APPLICATION_ID", "CLIENT_ENVIRONMENT")),
    "user_activity": Source(
        "user_activity_raw", "EVENT_TIMESTAMP", ("EVENT_ID",), "Logins",
        ("EVENT_ID", "EVENT_TIMESTAMP", "EVENT_TYPE", "USER_NAME", "CLIENT_IP", "REPORTED_CLIENT_TYPE",
         "REPORTED_CLIENT_VERSION", "FIRST_AUTHENTICATION_FACTOR", "SECOND_AUTHENTICATION_FACTOR", "IS_SUCCESS",
         "ERROR_CODE", "ERROR_MESSAGE", "RELATED_EVENT_ID", "CONNECTION_ID", "CLIENT_ENVIRONMENT")),
    "warehouse_load": Source(
        "warehouse_load_raw", "START_TIME", ("START_TIME", "WAREHOUSE_ID"), "Load and queueing per warehouse",
        ("START_TIME", "END_TIME", "WAREHOUSE_ID", "WAREHOUSE_NAME", "AVG_RUNNING", "AVG_QUEUED_LOAD",
         "AVG_QUEUED_PROVISIONING", "AVG_BLOCKED")),
}
LOOKBACK_DAYS = 7
MARK_SCHEMA = "source_name string, last_collected timestamp_ntz"


def open_source(spark: SparkSession, fmt: str, **options: str) -> DataFrame:
    """Any Spark source: files (``path``) or ``jdbc``; filters and columns are pushed by the reader."""
    reader = spark.read.format(fmt).options(**{k: v for k, v in options.items() if k != "path"})
    return reader.load(options["path"]) if "path" in options else reader.load()


def select_source(df: DataFrame, name: str, since: str | None = None, max_rows: int | None = None) -> DataFrame:
    """Declared columns that are present, from ``since`` on; the newest ``max_rows`` if asked for."""
    source = SOURCES[name]
    if since is not None:
        df = df.filter(F.col(source.time) >= F.lit(since).cast("timestamp_ntz"))
    df = df.select(*[c for c in source.columns if c in df.columns])
    return df.orderBy(F.desc(source.time)).limit(max_rows) if max_rows else df


def history_with_status(df: DataFrame, since: str, statuses=("SUCCESS", "FAIL", "CANCELLED"),
                        with_text: bool = False, preview: int = 200) -> DataFrame:
    """Finished queries from ``since`` on, with the full text or only its start."""
    df = df.filter((F.col("START_TIME") >= F.lit(since).cast("timestamp_ntz")) & F.col("EXECUTION_STATUS").isin(*statuses))
    if with_text:
        return df
    return df.withColumn("QUERY_TEXT_PREVIEW", F.left(F.col("QUERY_TEXT"), F.lit(preview))).drop("QUERY_TEXT")


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None where there is none yet; any other failure is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def read_marks(spark: SparkSession, root: str) -> DataFrame:
    """(source_name, last_collected): the newest mark of each source."""
    marks = existing(spark, f"{root}/collection_marks")
    if marks is None:
        marks = spark.createDataFrame([], MARK_SCHEMA)
    return marks.groupBy("source_name").agg(F.max("last_collected").alias("last_collected"))


def pull_increment(df: DataFrame, name: str, root: str, as_of: str, full: bool = False) -> DataFrame:
    """Store rows from the source's mark (or the look-back) on and then move the mark.

    Each pull has a partition, and rows from the mark on that are stored already are left out by
    the source's keys. So late rows at the time of the mark are taken, and a pull that failed
    before its mark was written can be repeated, at the same time or later, without loss or doubles.
    """
    spark, source = df.sparkSession, SOURCES[name]
    mark = None if full else next((r["last_collected"] for r in read_marks(spark, root)
                                   .filter(F.col("source_name") == name).collect()), None)
    time = F.col(source.time)
    now = F.lit(as_of).cast("timestamp_ntz")
    since = F.lit(mark) if mark is not None else now - F.expr(f"interval {LOOKBACK_DAYS} days")
    batch = f"{source.table}_{as_of}".replace(" ", "_").replace(":", "").replace("-", "")
    rows = df.filter((time >= since) & (time <= now))
    path, keys = f"{root}/{source.table}", [k for k in source.keys if k in df.columns]
    before = None if full else existing(spark, path)
    if before is not None and keys:
        rows = same_keys_join(rows, before.filter(time >= since).select(*keys).distinct(), keys, "left_anti")
    own = f"{path}/_collection_batch={batch}"
    with_collection(rows, as_of, batch).drop("_collection_batch").write.mode("append").parquet(own)
    stored = spark.read.parquet(path)
    moved = spark.read.parquet(own).agg(F.max(source.time).alias("last_collected"))
    moved = moved.filter("last_collected is not null").select(F.lit(name).alias("source_name"), "last_collected")
    moved.write.mode("append").parquet(f"{root}/collection_marks")
    return stored


def with_collection(df: DataFrame, as_of: str, batch: str) -> DataFrame:
    return df.withColumns({"_collected_at": F.lit(as_of).cast("timestamp_ntz"), "_collection_batch": F.lit(batch)})


def collection_status(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(source_name, record_count, last_collected, description) per source."""
    out = None
    for name, df in tables.items():
        source = SOURCES[name]
        row = df.agg(F.lit(name).alias("source_name"), F.count("*").alias("record_count"),
                     F.max(source.time).alias("last_collected"), F.lit(source.description).alias("description"))
        out = row if out is None else out.unionByName(row)
    return out
