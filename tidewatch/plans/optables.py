"""Queries over operational tables, logs and files."""

import uuid

from pyspark.sql import functions as F

from tidewatch.operators import optables as P
from tidewatch.operators import temporal as T
from tidewatch.plans.registry import query
from tidewatch.session import scratch_root
from tidewatch.sources import files
from tidewatch.sources.tables import query_log, table

AS_OF = "2024-01-25 00:00:00"


def _path(spark):
    return f"{scratch_root(spark)}/tidewatch/{uuid.uuid4().hex}"


@query("st01_saved_table", "select count(*) as rows, 4 as columns, count(*) filter (CREDITS_USED > 1) as dear from qlog")
def saved_table(spark, d):
    root = _path(spark)
    note = files.save_table(query_log(spark, d).select("QUERY_ID", "CREDITS_USED", "USER_NAME"), root, "log", created_at=AS_OF)
    back = files.load_table(spark, root, "log")
    return back.agg(F.lit(note["rows"]).alias("rows"), F.lit(note["columns"]).alias("columns"), F.count_if(F.col("CREDITS_USED") > 1).alias("dear"))


@query("st02_loaded_table", "select QUERY_ID, round(CREDITS_USED,6) as CREDITS_USED from qlog where CREDITS_USED > 1")
def loaded_table(spark, d):
    root = _path(spark)
    files.save_table(query_log(spark, d), root, "log", "raw")
    return files.load_table(spark, root, "log", "raw", ["QUERY_ID", "CREDITS_USED"], F.col("CREDITS_USED") > 1)


@query("st03_any_format", "select 'csv' as format, count(*) as rows, round(sum(CREDITS_USED),6) as credits from qlog union all select 'json', count(*), round(sum(CREDITS_USED),6) from qlog union all select 'parquet', count(*), round(sum(CREDITS_USED),6) from qlog")
def any_format(spark, d):
    root, out = _path(spark), None
    log = query_log(spark, d).select("QUERY_ID", "CREDITS_USED")
    for kind in ("csv", "json", "parquet"):
        writer = log.write.option("header", True) if kind == "csv" else log.write
        writer.format(kind).save(f"{root}/log.{kind}")
        row = files.read_any(spark, f"{root}/log.{kind}", log.schema).agg(F.lit(kind).alias("format"), F.count("*").alias("rows"), F.sum("CREDITS_USED").alias("credits"))
        out = row if out is None else out.unionByName(row)
    return out


@query("ta15_saved_tables", "select date_trunc('day', START_TIME)::timestamp as time_group, count(*) as query_count from qlog group by 1")
def saved_tables(spark, d):
    root = _path(spark)
    daily = T.aggregate_periods(query_log(spark, d), "START_TIME", "daily", {})
    files.save_tables({"daily": daily}, root, "parquet")
    return spark.read.schema(daily.schema).parquet(f"{root}/daily.parquet")


@query("ta12_aggregation_tables", "select 'temporal' as table_name, count(distinct date_trunc('day', START_TIME)) as rows from qlog union all select 'dimensional', count(distinct (WAREHOUSE_NAME, QUERY_TYPE)) from qlog union all select 'cost', count(distinct date_trunc('week', START_TIME)) from qlog union all select 'usage', 24+7+count(distinct date_trunc('day', START_TIME)) from qlog")
def aggregation_tables(spark, d):
    from tidewatch.operators import cost, dimensional, usage
    log = query_log(spark, d)
    return P.row_counts({"temporal": T.aggregate_periods(log, "START_TIME", "daily", {"CREDITS_USED": ["sum"]}),
                         "dimensional": dimensional.aggregate_by(log, ["WAREHOUSE_NAME", "QUERY_TYPE"], {"CREDITS_USED": ["sum"]}),
                         "cost": cost.cost_series(log, "weekly"), "usage": usage.workload(log)})


def _runs(spark, d):
    o = table(spark, d, "events")
    return o.select(F.col("event_id").cast("string").alias("run_id"), F.col("event_type").alias("data_source"), F.col("ts").alias("started_at"),
                    F.expr("ts + make_dt_interval(0, 0, 0, cast(floor(value) as int))").alias("finished_at"), F.when(F.col("user_id") % 4 == 0, "failed").otherwise("success").alias("status"),
                    (F.col("user_id") * 10).alias("records"), F.lit(None).cast("string").alias("error"))


RUNS = "rn as (select cast(event_id as varchar) as run_id, event_type as data_source, ts as started_at, ts + cast(floor(value) as int) * interval 1 second as finished_at, case when user_id % 4 = 0 then 'failed' else 'success' end as status, user_id*10 as records from events)"


@query("st04_operational_tables", f"with {RUNS} select 'data_collection_runs' as table_name, count(*) as rows from rn union all select unnest(['model_training_runs','alert_history','system_metrics','configuration_history','file_metadata']), 0")
def operational_tables(spark, d):
    root = _path(spark)
    P.create_tables(spark, root)
    P.append(_runs(spark, d), root, "data_collection_runs")
    return P.row_counts({name: P.table(spark, root, name) for name in P.TABLES})


@query("st05_run_history", f"with {RUNS} select run_id, data_source, started_at, status, records from rn where data_source = 'view' order by started_at desc, run_id limit 50")
def run_history(spark, d):
    return P.newest(_runs(spark, d), "started_at", "run_id", F.col("data_source") == "view", 50).select("run_id", "data_source", "started_at", "status", "records")


def _metrics(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_type").alias("metric_name"), "value", F.col("ts").alias("at"), F.create_map(F.lit("host"), F.concat(F.lit("h"), (F.col("user_id") % 3).cast("string"))).alias("labels"))


@query("st06_recent_metrics", f"select event_type as metric_name, value, ts as \"at\" from events where event_type = 'click' and ts >= timestamp '{AS_OF}' - interval 48 hour")
def recent_metrics(spark, d):
    return P.recent_metrics(_metrics(spark, d), "click", AS_OF, 48).drop("labels")


@query("st07_kept_records", f"select event_id, ts, case when event_type='error' then 'open' else 'resolved' end as status from events where not (ts < timestamp '{AS_OF}' - interval 10 day and event_type <> 'error')")
def kept_records(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", F.when(F.col("event_type") == "error", "open").otherwise("resolved").alias("status"))
    return P.kept_records(e, "ts", AS_OF, 10, only_resolved=True)


@query("st07_expired_files", f"select event_id, ts + interval 5 day as expires_at from events where ts + interval 5 day < timestamp '{AS_OF}'")
def expired_files(spark, d):
    return P.expired_files(table(spark, d, "events").select("event_id", F.expr("ts + interval 5 days").alias("expires_at")), AS_OF)


@query("st08_row_counts", "select 'events' as table_name, count(*) as rows from events union all select 'orders', count(*) from orders union all select 'lineitem', count(*) from lineitem")
def row_counts(spark, d):
    return P.row_counts({n: table(spark, d, n) for n in ("events", "orders", "lineitem")})


@query("st08_stored_bytes")
def stored_bytes(spark, d):
    root = _path(spark)
    files.save_table(query_log(spark, d), root, "log", "raw")
    files.save_table(query_log(spark, d).groupBy("USER_NAME").count(), root, "users", "exports")
    return P.stored_bytes(spark, root)


@query("st09_selected_points", "select event_type as metric_name, value, ts as \"at\" from events where event_type = 'view' and user_id % 3 = 1 and ts between timestamp '2024-01-05' and timestamp '2024-01-15'")
def selected_points(spark, d):
    return P.select_points(_metrics(spark, d), "view", "2024-01-05 00:00:00", "2024-01-15 00:00:00", {"host": "h1"}).drop("labels")


@query("st09_aggregated_points", f"select event_type as metric_name, count(*) as points, round(avg(value),6) as mean, min(value) as min, max(value) as max, round(sum(value),6) as sum from events where ts between timestamp '{AS_OF}' - interval 600 minute and timestamp '{AS_OF}' group by 1")
def aggregated_points(spark, d):
    return P.aggregate_points(_metrics(spark, d), AS_OF, 600)


@query("st10_log_levels", "select case event_type when 'error' then 'ERROR' when 'view' then 'INFO' when 'click' then 'UNKNOWN' when 'signup' then 'WARNING' else 'DEBUG' end as level, count(*) as lines from events group by 1")
def log_levels(spark, d):
    root = _path(spark)
    k = F.col("event_type")
    level = F.when(k == "error", "ERROR").when(k == "view", "info").when(k == "click", "informal").when(k == "signup", "WARNING").otherwise("debug")
    table(spark, d, "events").select(F.concat_ws(" - ", F.col("ts").cast("string"), level, F.col("props"))).write.text(root)
    return P.level_counts(P.log_lines(spark.read.text(root)))


def _calls(spark, d):
    e = table(spark, d, "events")
    return e.select(F.when(F.col("event_type") == "purchase", "POST").otherwise("GET").alias("method"), F.concat(F.lit("/api/"), F.col("event_type"), F.lit("/"), (F.col("user_id") % 9).cast("string")).alias("endpoint"),
                    F.col("value").alias("duration_ms"), F.when(F.col("event_id") % 11 == 0, 500).otherwise(200).alias("status"), F.col("ts").alias("at"))


CALLS = "cl as (select case when event_type='purchase' then 'POST' else 'GET' end as method, '/api/' || event_type || '/' || (user_id % 9) as endpoint, value as duration_ms, case when event_id % 11 = 0 then 500 else 200 end as status, ts from events)"
EPS = CALLS + """, o as (select *, row_number() over (partition by method, endpoint order by duration_ms)-1 as i, count(*) over (partition by method, endpoint) as n from cl),
es as (select method, endpoint, count(*) as calls, avg(duration_ms) as a, min(duration_ms) as min_ms, max(duration_ms) as max_ms, count(*) filter (status >= 400) as errors, max(ts) as last_call, max(duration_ms) filter (i = floor(n*0.95::double)) as p95_ms from o group by 1, 2)"""
EP = "method, endpoint, calls, round(a,6) as avg_ms, min_ms, max_ms, errors, last_call, p95_ms, round(errors/calls,6) as error_rate"


@query("st11_endpoint_statistics", f"with {EPS} select {EP} from es")
def endpoint_statistics(spark, d):
    return P.endpoint_statistics(_calls(spark, d))


@query("st12_slow_endpoints", f"with {EPS} select {EP} from es where a >= 50 order by a desc, endpoint, method limit 10")
def slow_endpoints(spark, d):
    return P.slow_endpoints(P.endpoint_statistics(_calls(spark, d)), 50.0)


@query("st12_failing_endpoints", f"with {EPS} select {EP} from es where errors/calls >= 0.1::double and calls >= 10")
def failing_endpoints(spark, d):
    return P.failing_endpoints(P.endpoint_statistics(_calls(spark, d)), 0.1)


@query("st13_throughput", f"with {CALLS} select count(*) as calls, round(count(*)/600,6) as calls_per_minute, round(avg(duration_ms),6) as avg_ms from cl where ts between timestamp '{AS_OF}' - interval 600 minute and timestamp '{AS_OF}'")
def throughput(spark, d):
    return P.throughput(_calls(spark, d), AS_OF, 600)


@query("st13_traffic", f"with {CALLS}, h as (select hour(ts) as hour, count(*) as calls from cl group by 1) select hour, calls, case when hour = (select min_by(hour, (-calls, hour)) from h) then 1 else 0 end as is_peak from h")
def traffic(spark, d):
    return P.traffic(_calls(spark, d))


@query("st13_popularity", f"with {CALLS} select endpoint, count(*) as calls from cl group by 1 order by 2 desc, 1 limit 20")
def popularity(spark, d):
    return P.popularity(_calls(spark, d))


@query("st14_baseline_deviations", """with b as (select user_id, avg(value) as b from events where ts < timestamp '2024-01-15' group by 1), c as (select user_id, avg(value) as c from events where ts >= timestamp '2024-01-15' group by 1)
select c.user_id, round(c,6) as value, round(b,6) as baseline, round(abs(c-b)/b,6) as deviation from c join b using (user_id) where abs(c-b)/b > 0.3""")
def baseline_deviations(spark, d):
    e, cut = table(spark, d, "events"), F.lit("2024-01-15").cast("timestamp_ntz")
    mean = lambda cond: e.filter(cond).groupBy("user_id").agg(F.avg("value").alias("value"))
    return P.baseline_deviations(mean(F.col("ts") >= cut), mean(F.col("ts") < cut), "user_id", 0.3)


@query("st15_collection_summary", f"with {RUNS} select data_source, count(*) as runs, count(*) filter (status='success') as successful, count(*) filter (status='failed') as failed, cast(sum(records) as bigint) as records, round(avg(epoch_us(finished_at)-epoch_us(started_at))/1e6,6) as avg_seconds, max(finished_at) as last_finished from rn where started_at >= timestamp '{AS_OF}' - interval 72 hour group by 1")
def collection_summary(spark, d):
    return P.collection_summary(_runs(spark, d), AS_OF, 72)
