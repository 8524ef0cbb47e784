"""Typed views over the test tables: a query log, cost facts, and metric points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


# The declared schema of each input table; no footer is read to infer it.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{folder}/{name}.parquet")


def query_log(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as query history rows."""
    e = table(spark, folder, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1)
    uid, value = F.col("user_id"), F.col("value")
    return e.select(
        F.col("event_id").cast("string").alias("QUERY_ID"),
        F.col("ts").alias("START_TIME"),
        F.expr("ts + make_dt_interval(0, 0, 0, cast(floor(value * 10) as int))").alias("END_TIME"),
        F.concat(F.lit("U"), uid.cast("string")).alias("USER_NAME"),
        F.concat(F.lit("R"), (uid % 5).cast("string")).alias("ROLE_NAME"),
        F.concat(F.lit("WH"), (uid % 4).cast("string")).alias("WAREHOUSE_NAME"),
        F.concat(F.lit("DB"), (uid % 3).cast("string")).alias("DATABASE_NAME"),
        F.col("event_type").alias("QUERY_TYPE"),
        F.when(F.col("event_type") == "error", "FAIL").otherwise("SUCCESS").alias("EXECUTION_STATUS"),
        (value / 100).alias("CREDITS_USED"),
        (value * 1000).alias("EXECUTION_TIME_MS"),
        k.cast("bigint").alias("ROWS_PRODUCED"),
        (k.cast("bigint") * 1048576).alias("BYTES_SCANNED"),
        F.concat(F.lit("SELECT * FROM "), F.col("event_type"), F.lit(" WHERE k = "), k).alias("QUERY_TEXT"),
    )


QUERY_LOG_SQL = """
select cast(event_id as varchar) as QUERY_ID, ts as START_TIME,
  ts + cast(floor(value*10) as int) * interval '1' second as END_TIME,
  concat('U', cast(user_id as varchar)) as USER_NAME, concat('R', cast(user_id % 5 as varchar)) as ROLE_NAME,
  concat('WH', cast(user_id % 4 as varchar)) as WAREHOUSE_NAME, concat('DB', cast(user_id % 3 as varchar)) as DATABASE_NAME,
  event_type as QUERY_TYPE, case when event_type='error' then 'FAIL' else 'SUCCESS' end as EXECUTION_STATUS,
  value/100 as CREDITS_USED, value*1000 as EXECUTION_TIME_MS,
  cast(regexp_extract(props,'([0-9]+)',1) as bigint) as ROWS_PRODUCED,
  cast(regexp_extract(props,'([0-9]+)',1) as bigint)*1048576 as BYTES_SCANNED,
  concat('SELECT * FROM ', event_type, ' WHERE k = ', regexp_extract(props,'([0-9]+)',1)) as QUERY_TEXT
from events
"""


def cost_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines with customer geography, as cost rows over many dimensions."""
    li = table(spark, folder, "lineitem")
    o = table(spark, folder, "orders")
    c = table(spark, folder, "customer")
    n = table(spark, folder, "nation")
    r = table(spark, folder, "region")
    # Large tables join on their keys; the dimension tables are left to the size-checked planner.
    joined = (li.join(o, li.l_orderkey == o.o_orderkey)
              .join(c, o.o_custkey == c.c_custkey)
              .join(n, c.c_nationkey == n.n_nationkey)
              .join(r, n.n_regionkey == r.r_regionkey))
    return joined.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                    F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("QUERY_ID"),
        F.col("o_orderdate").alias("START_TIME"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("USER_NAME"),
        F.col("n_name").alias("WAREHOUSE_NAME"),
        F.col("r_name").alias("DATABASE_NAME"),
        F.col("c_mktsegment").alias("SCHEMA_NAME"),
        F.col("o_orderpriority").alias("QUERY_TYPE"),
        F.col("l_shipdate").alias("END_TIME"),
        (F.col("l_extendedprice") / 10000).alias("CREDITS_USED"),
        F.col("l_quantity").alias("ROWS_PRODUCED"),
        F.col("l_extendedprice").alias("EXECUTION_TIME_MS"),
        (F.col("l_quantity") * 1e8).alias("BYTES_SCANNED"),
    )


COST_FACTS_SQL = """
select concat_ws('-', cast(l_orderkey as varchar), cast(l_linenumber as varchar), cast(l_partkey as varchar), cast(l_suppkey as varchar)) as QUERY_ID,
  o_orderdate as START_TIME, concat('C', cast(o_custkey as varchar)) as USER_NAME, n_name as WAREHOUSE_NAME,
  r_name as DATABASE_NAME, c_mktsegment as SCHEMA_NAME, o_orderpriority as QUERY_TYPE, l_shipdate as END_TIME,
  l_extendedprice/10000 as CREDITS_USED, l_quantity as ROWS_PRODUCED, l_extendedprice as EXECUTION_TIME_MS,
  l_quantity*1e8 as BYTES_SCANNED
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
  join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
"""


def metric_points(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as metric points (metric, ts, value, point_id)."""
    return table(spark, folder, "events").select(
        F.col("event_type").alias("metric"), "ts", "value", F.col("event_id").alias("point_id"))


METRIC_POINTS_SQL = "select event_type as metric, ts, value, event_id as point_id from events"


def dirty_log(spark: SparkSession, folder: str) -> DataFrame:
    """The query log with gaps, repeats and text columns, all made by rule."""
    e = table(spark, folder, "events")
    i = F.col("event_id")
    return e.select(
        i.alias("row_id"),
        "ts",
        F.concat(F.lit("U"), (F.col("user_id") % 50).cast("string")).alias("user_name"),
        F.when(i % 7 == 0, None).otherwise(F.col("event_type")).alias("kind"),
        F.when(i % 17 == 0, None).otherwise(F.col("value")).alias("value"),
        F.when(i % 10 < 9, None).otherwise(F.col("value") * 2).alias("sparse"),
        F.when(i % 23 == 0, None).otherwise(F.col("ts")).alias("seen_at"),
        F.when(i % 29 == 0, F.lit("n/a")).otherwise(F.col("value").cast("decimal(12,2)").cast("string")).alias("value_text"),
        F.when(F.col("user_id") % 2 == 0, F.lit("Yes")).otherwise(F.lit("no")).alias("flag_text"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time_text"),
    )


DIRTY_LOG_SQL = """
select event_id as row_id, ts, concat('U', cast(user_id % 50 as varchar)) as user_name,
  case when event_id % 7 = 0 then null else event_type end as kind,
  case when event_id % 17 = 0 then null else value end as value,
  case when event_id % 10 < 9 then null else value * 2 end as sparse,
  case when event_id % 23 = 0 then null else ts end as seen_at,
  case when event_id % 29 = 0 then 'n/a' else cast(cast(value as decimal(12,2)) as varchar) end as value_text,
  case when user_id % 2 = 0 then 'Yes' else 'no' end as flag_text,
  strftime(ts, '%Y-%m-%d %H:%M:%S') as time_text
from events
"""


def query_history(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as wide query history; every 20th row comes twice."""
    e = table(spark, folder, "events")
    e = e.unionByName(e.filter(F.col("event_id") % 20 == 0))
    i, k = F.col("event_id"), F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    kind = (F.when(F.col("event_type").isin("view", "click"), "SELECT").when(F.col("event_type") == "purchase", "INSERT")
            .when(F.col("event_type") == "signup", "CREATE").when(i % 3 == 0, None).otherwise("CALL"))
    text = F.concat(F.lit("SELECT * FROM "), F.col("event_type"), F.lit(" WHERE k = "), k.cast("string"))
    return e.select(
        i.cast("string").alias("QUERY_ID"), text.alias("QUERY_TEXT"),
        F.concat(F.lit("DB"), (F.col("user_id") % 3).cast("string")).alias("DATABASE_NAME"),
        kind.alias("QUERY_TYPE"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("USER_NAME"),
        F.concat(F.lit("WH"), (F.col("user_id") % 4).cast("string")).alias("WAREHOUSE_NAME"),
        F.when(i % 4 == 0, "nightly ETL").when(i % 4 == 1, "adhoc").alias("QUERY_TAG"),
        F.when(F.col("event_type") == "error", "FAIL").when(i % 11 == 0, "CANCELLED").when(i % 13 == 0, "RUNNING")
        .otherwise("SUCCESS").alias("EXECUTION_STATUS"),
        F.when(i % 97 == 0, None).otherwise(F.col("ts")).alias("START_TIME"),
        F.expr("ts + make_dt_interval(0, 0, 0, cast(floor(value) as int))").alias("END_TIME"),
        F.when(i % 37 == 0, "bad").otherwise(F.floor(F.col("value") * 1000).cast("string")).alias("TOTAL_ELAPSED_TIME"),
        (k * 1048576 * 20).alias("BYTES_SCANNED"), k.cast("double").alias("PERCENTAGE_SCANNED_FROM_CACHE"),
        F.when(i % 19 == 0, None).otherwise(k).alias("ROWS_PRODUCED"),
        F.when(i % 7 == 0, k * 1048576 * 3).otherwise(F.lit(0)).alias("BYTES_SPILLED_TO_LOCAL_STORAGE"),
        F.when(i % 21 == 0, k * 1048576).otherwise(F.lit(0)).alias("BYTES_SPILLED_TO_REMOTE_STORAGE"),
        (F.col("value") * 100).alias("QUEUED_OVERLOAD_TIME"), (F.col("value") / 100).alias("CREDITS_USED_CLOUD_SERVICES"))


QUERY_HISTORY_SQL = """
select cast(event_id as varchar) as QUERY_ID, concat('SELECT * FROM ', event_type, ' WHERE k = ', cast(k as varchar)) as QUERY_TEXT,
  concat('DB', cast(user_id % 3 as varchar)) as DATABASE_NAME,
  case when event_type in ('view','click') then 'SELECT' when event_type = 'purchase' then 'INSERT' when event_type = 'signup' then 'CREATE' when event_id % 3 = 0 then null else 'CALL' end as QUERY_TYPE,
  concat('U', cast(user_id as varchar)) as USER_NAME, concat('WH', cast(user_id % 4 as varchar)) as WAREHOUSE_NAME,
  case event_id % 4 when 0 then 'nightly ETL' when 1 then 'adhoc' end as QUERY_TAG,
  case when event_type = 'error' then 'FAIL' when event_id % 11 = 0 then 'CANCELLED' when event_id % 13 = 0 then 'RUNNING' else 'SUCCESS' end as EXECUTION_STATUS,
  case when event_id % 97 = 0 then null else ts end as START_TIME, ts + cast(floor(value) as int) * interval '1' second as END_TIME,
  case when event_id % 37 = 0 then 'bad' else cast(cast(floor(value*1000) as bigint) as varchar) end as TOTAL_ELAPSED_TIME,
  k*1048576*20 as BYTES_SCANNED, k::double as PERCENTAGE_SCANNED_FROM_CACHE, case when event_id % 19 = 0 then null else k end as ROWS_PRODUCED,
  case when event_id % 7 = 0 then k*1048576*3 else 0 end as BYTES_SPILLED_TO_LOCAL_STORAGE, case when event_id % 21 = 0 then k*1048576 else 0 end as BYTES_SPILLED_TO_REMOTE_STORAGE,
  value*100 as QUEUED_OVERLOAD_TIME, value/100 as CREDITS_USED_CLOUD_SERVICES
from (select *, cast(regexp_extract(props,'([0-9]+)',1) as bigint) as k from (select * from events union all select * from events where event_id % 20 = 0))
"""


def _hourly_rows(spark: SparkSession, folder: str):
    e = table(spark, folder, "events")
    start = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    e = e.withColumns({"k": F.regexp_extract("props", "([0-9]+)", 1).cast("bigint"), "START_TIME": start})
    return e.withColumn("END_TIME", F.when(F.col("event_id") % 31 == 0, F.col("START_TIME"))
                        .otherwise(F.expr("START_TIME + interval 1 hour")))


def metering_history(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as hourly metering rows; (START_TIME, WAREHOUSE_ID) repeats."""
    e = _hourly_rows(spark, folder)
    share = F.when(F.col("event_id") % 3 == 0, 0.4).otherwise(0.9)
    return e.select(
        F.col("event_id").alias("SEQ"), "START_TIME", "END_TIME", (F.col("user_id") % 4).alias("WAREHOUSE_ID"),
        F.concat(F.lit("WH"), (F.col("user_id") % 4).cast("string")).alias("WAREHOUSE_NAME"),
        F.when(F.col("user_id") % 5 == 0, "PIPE").otherwise("WAREHOUSE_METERING").alias("SERVICE_TYPE"),
        (F.col("value") / 100).alias("CREDITS_USED"), (F.col("value") / 100 * share).alias("CREDITS_USED_COMPUTE"),
        (F.col("value") / 1000).alias("CREDITS_USED_CLOUD_SERVICES"),
        (F.col("k") * 1073741824).alias("BYTES_SCANNED"), (F.col("k") * 1048576).alias("BYTES_WRITTEN"))


METERING_SQL = """
select event_id as SEQ, START_TIME, case when event_id % 31 = 0 then START_TIME else START_TIME + interval 1 hour end as END_TIME, user_id % 4 as WAREHOUSE_ID,
  concat('WH', cast(user_id % 4 as varchar)) as WAREHOUSE_NAME, case when user_id % 5 = 0 then 'PIPE' else 'WAREHOUSE_METERING' end as SERVICE_TYPE,
  value/100 as CREDITS_USED, value/100 * case when event_id % 3 = 0 then 0.4::double else 0.9::double end as CREDITS_USED_COMPUTE, value/1000 as CREDITS_USED_CLOUD_SERVICES,
  k*1073741824 as BYTES_SCANNED, k*1048576 as BYTES_WRITTEN
from (select *, date_trunc('hour', ts)::timestamp as START_TIME, cast(regexp_extract(props,'([0-9]+)',1) as bigint) as k from events)
"""


def load_history(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as hourly load rows."""
    e = _hourly_rows(spark, folder)
    k = F.col("k")
    return e.select(
        F.col("event_id").alias("SEQ"), "START_TIME", "END_TIME", (F.col("user_id") % 4).alias("WAREHOUSE_ID"),
        F.concat(F.lit("WH"), (F.col("user_id") % 4).cast("string")).alias("WAREHOUSE_NAME"),
        (F.col("value") / 200).alias("AVG_RUNNING"), (k / 200.0).alias("AVG_QUEUED_LOAD"),
        ((k % 10) / 100.0).alias("AVG_QUEUED_PROVISIONING"), ((k % 7) / 50.0).alias("AVG_BLOCKED"))


LOAD_SQL = """
select event_id as SEQ, START_TIME, case when event_id % 31 = 0 then START_TIME else START_TIME + interval 1 hour end as END_TIME, user_id % 4 as WAREHOUSE_ID,
  concat('WH', cast(user_id % 4 as varchar)) as WAREHOUSE_NAME, value/200 as AVG_RUNNING, k/200.0::double as AVG_QUEUED_LOAD, (k%10)/100.0::double as AVG_QUEUED_PROVISIONING, (k%7)/50.0::double as AVG_BLOCKED
from (select *, date_trunc('hour', ts)::timestamp as START_TIME, cast(regexp_extract(props,'([0-9]+)',1) as bigint) as k from events)
"""

# Client types by user number, for the login view.
LOGIN_CLIENTS = ["JDBC_DRIVER", "ODBC_DRIVER", "PYTHON_CONNECTOR", "WEB_UI", "SQL_CLI", "OTHER_CLIENT"]


def login_history(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as login rows."""
    e = table(spark, folder, "events")
    client = F.element_at(F.array(*[F.lit(c) for c in LOGIN_CLIENTS]), (F.col("user_id") % 6 + 1).cast("int"))
    return e.select(
        F.col("event_id").cast("string").alias("EVENT_ID"), F.col("ts").alias("EVENT_TIMESTAMP"),
        F.lit("LOGIN").alias("EVENT_TYPE"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("USER_NAME"),
        client.alias("REPORTED_CLIENT_TYPE"),
        F.when(F.col("event_type") == "error", "NO").otherwise("YES").alias("IS_SUCCESS"))


LOGIN_SQL = """
select cast(event_id as varchar) as EVENT_ID, ts as EVENT_TIMESTAMP, 'LOGIN' as EVENT_TYPE, concat('U', cast(user_id as varchar)) as USER_NAME,
  ['JDBC_DRIVER','ODBC_DRIVER','PYTHON_CONNECTOR','WEB_UI','SQL_CLI','OTHER_CLIENT'][user_id % 6 + 1] as REPORTED_CLIENT_TYPE,
  case when event_type = 'error' then 'NO' else 'YES' end as IS_SUCCESS from events
"""


def storage_usage(spark: SparkSession, folder: str) -> DataFrame:
    """``orders`` as daily storage rows per database."""
    o = table(spark, folder, "orders")
    return o.select(
        F.col("o_orderdate").alias("USAGE_DATE"), F.concat(F.lit("DB"), F.substring("o_orderpriority", 1, 1)).alias("DATABASE_NAME"),
        (F.col("o_totalprice") * 1e7).alias("AVERAGE_DATABASE_BYTES"), (F.col("o_totalprice") * 1e6).alias("AVERAGE_FAILSAFE_BYTES"))


STORAGE_SQL = """
select o_orderdate as USAGE_DATE, concat('DB', substr(o_orderpriority,1,1)) as DATABASE_NAME, o_totalprice*1e7 as AVERAGE_DATABASE_BYTES, o_totalprice*1e6 as AVERAGE_FAILSAFE_BYTES from orders
"""


# Warehouse sizes by user number, for the wide log view.
LOG_SIZES = ["X-SMALL", "SMALL", "MEDIUM", "LARGE", "X-LARGE"]


def wide_log(spark: SparkSession, folder: str) -> DataFrame:
    """The query log with queue, compile, partition, write and session columns."""
    log = query_log(spark, folder)
    k, user = F.col("ROWS_PRODUCED"), F.substring("USER_NAME", 2, 20).cast("bigint")
    size = F.element_at(F.array(*[F.lit(s) for s in LOG_SIZES]), (user % 5 + 1).cast("int"))
    return log.withColumns({
        "QUEUE_TIME_MS": ((k % 20) * 600).cast("double"), "COMPILATION_TIME_MS": (k * 3).cast("double"), "PARTITIONS_SCANNED": k * 2,
        "BYTES_WRITTEN": k * 1000, "ROWS_INSERTED": k % 5, "ROWS_UPDATED": k % 3, "ROWS_DELETED": k % 2, "WAREHOUSE_SIZE": size,
        "SESSION_ID": F.concat("USER_NAME", F.lit("-"), F.date_format("START_TIME", "yyyyMMdd")),
        "STATEMENT_TYPE": F.when(F.col("QUERY_TYPE").isin("view", "click"), "SELECT").when(F.col("QUERY_TYPE") == "purchase", "INSERT")
        .when(F.col("QUERY_TYPE") == "signup", "CREATE_TABLE").otherwise("UPDATE")})


WIDE_LOG_SQL = f"""
select *, ((ROWS_PRODUCED % 20) * 600)::double as QUEUE_TIME_MS, (ROWS_PRODUCED * 3)::double as COMPILATION_TIME_MS, ROWS_PRODUCED * 2 as PARTITIONS_SCANNED, ROWS_PRODUCED * 1000 as BYTES_WRITTEN,
  ROWS_PRODUCED % 5 as ROWS_INSERTED, ROWS_PRODUCED % 3 as ROWS_UPDATED, ROWS_PRODUCED % 2 as ROWS_DELETED,
  ['X-SMALL','SMALL','MEDIUM','LARGE','X-LARGE'][cast(substr(USER_NAME,2) as bigint) % 5 + 1] as WAREHOUSE_SIZE, USER_NAME || '-' || strftime(START_TIME, '%Y%m%d') as SESSION_ID,
  case when QUERY_TYPE in ('view','click') then 'SELECT' when QUERY_TYPE = 'purchase' then 'INSERT' when QUERY_TYPE = 'signup' then 'CREATE_TABLE' else 'UPDATE' end as STATEMENT_TYPE
from ({QUERY_LOG_SQL})
"""
