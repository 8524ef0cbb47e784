"""Queries over collected history."""

from pyspark.sql import functions as F

from tidewatch.operators import ingest as I
from tidewatch.plans.registry import query
from tidewatch.session import scratch_root
from tidewatch.sources import history as H
from tidewatch.sources import tables as S

SINCE = "2024-01-10 00:00:00"
INF = "1e300"


def _cut(x, edges, labels):
    return "case " + " ".join(f"when {x} > {a} and {x} <= {b} then '{t}'" for a, b, t in zip(edges, edges[1:], labels)) + " end"


@query("in01_usage_source", f"""
select START_TIME, END_TIME, WAREHOUSE_ID, WAREHOUSE_NAME, round(CREDITS_USED,6) as CREDITS_USED, round(CREDITS_USED_COMPUTE,6) as CREDITS_USED_COMPUTE,
 round(CREDITS_USED_CLOUD_SERVICES,6) as CREDITS_USED_CLOUD_SERVICES, BYTES_SCANNED, BYTES_WRITTEN from metering where START_TIME >= timestamp '{SINCE}'""")
def usage_source(spark, d):
    return H.select_source(S.metering_history(spark, d), "warehouse_usage", SINCE)


HIST_COLS = """QUERY_ID, QUERY_TEXT, DATABASE_NAME, QUERY_TYPE, USER_NAME, WAREHOUSE_NAME, QUERY_TAG, EXECUTION_STATUS, START_TIME, END_TIME, TOTAL_ELAPSED_TIME, BYTES_SCANNED,
 PERCENTAGE_SCANNED_FROM_CACHE, ROWS_PRODUCED, BYTES_SPILLED_TO_LOCAL_STORAGE, BYTES_SPILLED_TO_REMOTE_STORAGE, round(QUEUED_OVERLOAD_TIME,6) as QUEUED_OVERLOAD_TIME,
 round(CREDITS_USED_CLOUD_SERVICES,6) as CREDITS_USED_CLOUD_SERVICES"""


@query("in02_query_source", f"select {HIST_COLS} from qhist where START_TIME >= timestamp '{SINCE}'")
def query_source(spark, d):
    return H.select_source(S.query_history(spark, d), "query_history", SINCE)


@query("in03_login_source", f"select EVENT_ID, EVENT_TIMESTAMP, EVENT_TYPE, USER_NAME, REPORTED_CLIENT_TYPE, IS_SUCCESS from logins where EVENT_TIMESTAMP >= timestamp '{SINCE}'")
def login_source(spark, d):
    return H.select_source(S.login_history(spark, d), "user_activity", SINCE)


@query("in04_load_source", f"""
select START_TIME, END_TIME, WAREHOUSE_ID, WAREHOUSE_NAME, round(AVG_RUNNING,6) as AVG_RUNNING, round(AVG_QUEUED_LOAD,6) as AVG_QUEUED_LOAD,
 round(AVG_QUEUED_PROVISIONING,6) as AVG_QUEUED_PROVISIONING, round(AVG_BLOCKED,6) as AVG_BLOCKED from loads where START_TIME >= timestamp '{SINCE}'""")
def load_source(spark, d):
    return H.select_source(S.load_history(spark, d), "warehouse_load", SINCE)


@query("in05_incremental_pull", """
select EVENT_ID, EVENT_TIMESTAMP, USER_NAME, IS_SUCCESS,
 case when EVENT_TIMESTAMP <= timestamp '2024-01-15 00:00:00' then 'user_activity_raw_20240115_000000' else 'user_activity_raw_20240120_000000' end as batch
from logins where EVENT_TIMESTAMP >= timestamp '2024-01-08 00:00:00' and EVENT_TIMESTAMP <= timestamp '2024-01-20 00:00:00'""")
def incremental_pull(spark, d):
    import uuid
    root = f"{scratch_root(spark)}/tidewatch/{uuid.uuid4().hex}"
    logins = S.login_history(spark, d).select("EVENT_ID", "EVENT_TIMESTAMP", "USER_NAME", "IS_SUCCESS")
    H.pull_increment(logins, "user_activity", root, "2024-01-15 00:00:00")
    stored = H.pull_increment(logins, "user_activity", root, "2024-01-20 00:00:00")
    return stored.withColumnRenamed("_collection_batch", "batch").drop("_collected_at")


@query("in06_clean_source", f"""
select distinct {HIST_COLS.replace("TOTAL_ELAPSED_TIME", "try_cast(TOTAL_ELAPSED_TIME as double) as TOTAL_ELAPSED_TIME", 1)} from qhist where START_TIME is not null""")
def clean_source(spark, d):
    return I.clean_source(S.query_history(spark, d), "query_history")


@query("in07_collected_rows", """
select EVENT_ID, EVENT_TIMESTAMP, EVENT_TYPE, USER_NAME, REPORTED_CLIENT_TYPE, IS_SUCCESS, timestamp '2024-02-01 00:00:00' as "_collected_at", 'b1' as "_collection_batch" from logins""")
def collected_rows(spark, d):
    return H.with_collection(S.login_history(spark, d), "2024-02-01 00:00:00", "b1")


@query("in08_collection_status", """
select 'warehouse_usage' as source_name, count(*) as record_count, max(START_TIME) as last_collected, 'Metering per warehouse' as description from metering
union all select 'query_history', count(*), max(START_TIME), 'Query executions' from qhist
union all select 'user_activity', count(*), max(EVENT_TIMESTAMP), 'Logins' from logins
union all select 'warehouse_load', count(*), max(START_TIME), 'Load and queueing per warehouse' from loads""")
def collection_status(spark, d):
    return H.collection_status({"warehouse_usage": S.metering_history(spark, d), "query_history": S.query_history(spark, d),
                                "user_activity": S.login_history(spark, d), "warehouse_load": S.load_history(spark, d)})


@query("in09_finished_queries", f"""
select QUERY_ID, EXECUTION_STATUS, START_TIME, left(QUERY_TEXT, 200) as QUERY_TEXT_PREVIEW from qhist where START_TIME >= timestamp '{SINCE}' and EXECUTION_STATUS in ('SUCCESS','FAIL','CANCELLED')""")
def finished_queries(spark, d):
    return H.history_with_status(S.query_history(spark, d), SINCE).select("QUERY_ID", "EXECUTION_STATUS", "START_TIME", "QUERY_TEXT_PREVIEW")


CLEAN = """cq as (select distinct * replace (coalesce(try_cast(TOTAL_ELAPSED_TIME as double),0) as TOTAL_ELAPSED_TIME, coalesce(BYTES_SCANNED,0)::double as BYTES_SCANNED,
 coalesce(ROWS_PRODUCED,0)::double as ROWS_PRODUCED) from qhist where START_TIME is not null and QUERY_ID is not null)"""
DERIVED = CLEAN + f""", dq as (select *, ms as QUERY_DURATION_MS, case when ms > 0 then BYTES_SCANNED*1000/ms else 0 end as BYTES_PER_SECOND, case when ms > 0 then ROWS_PRODUCED*1000/ms else 0 end as ROWS_PER_SECOND,
 PERCENTAGE_SCANNED_FROM_CACHE/100 as CACHE_HIT_RATIO, case when BYTES_SCANNED > 0 then (BYTES_SPILLED_TO_LOCAL_STORAGE+BYTES_SPILLED_TO_REMOTE_STORAGE)/BYTES_SCANNED else 0 end as SPILLAGE_RATIO,
 case when ms > 0 then QUEUED_OVERLOAD_TIME/ms else 0 end as WAIT_TIME_RATIO, {_cut('ms', [0, 1e3, 1e4, 6e4, 3e5, INF], ['Fast', 'Normal', 'Slow', 'Very Slow', 'Extremely Slow'])} as PERFORMANCE_CLASS,
 case when QUERY_TYPE is null then 'unknown' when QUERY_TYPE = 'SELECT' then 'read_queries' when QUERY_TYPE in ('INSERT','UPDATE','DELETE') then 'write_queries' when QUERY_TYPE in ('CREATE','ALTER','DROP') then 'ddl_queries'
  when QUERY_TYPE = 'COPY' then 'data_loading' when QUERY_TYPE = 'UNLOAD' then 'data_export' else 'other' end as QUERY_CATEGORY,
 coalesce(regexp_matches(QUERY_TAG, '(?i)automated|scheduled|pipeline|etl|job'), false) as IS_AUTOMATED,
 (BYTES_SCANNED > 1e9 or ms > 60000 or CREDITS_USED_CLOUD_SERVICES > 1) as IS_RESOURCE_INTENSIVE
 from (select *, (epoch_us(END_TIME)-epoch_us(START_TIME))/1000 as ms from cq))"""


@query("in10_clean_queries", f"with {CLEAN} select QUERY_ID, START_TIME, TOTAL_ELAPSED_TIME, BYTES_SCANNED, ROWS_PRODUCED from cq")
def clean_queries(spark, d):
    return I.clean_queries(S.query_history(spark, d)).select("QUERY_ID", "START_TIME", "TOTAL_ELAPSED_TIME", "BYTES_SCANNED", "ROWS_PRODUCED")


@query("in11_derived_metrics", f"""with {DERIVED} select QUERY_ID, round(QUERY_DURATION_MS,6) as QUERY_DURATION_MS, round(BYTES_PER_SECOND,6) as BYTES_PER_SECOND, round(ROWS_PER_SECOND,6) as ROWS_PER_SECOND,
 round(CACHE_HIT_RATIO,6) as CACHE_HIT_RATIO, round(SPILLAGE_RATIO,6) as SPILLAGE_RATIO, round(WAIT_TIME_RATIO,6) as WAIT_TIME_RATIO, PERFORMANCE_CLASS from dq""")
def derived_metrics(spark, d):
    return I.derive_query_metrics(I.clean_queries(S.query_history(spark, d))).select(
        "QUERY_ID", "QUERY_DURATION_MS", "BYTES_PER_SECOND", "ROWS_PER_SECOND", "CACHE_HIT_RATIO", "SPILLAGE_RATIO", "WAIT_TIME_RATIO", "PERFORMANCE_CLASS")


@query("in12_categories", f"with {DERIVED} select QUERY_ID, QUERY_CATEGORY, IS_AUTOMATED, IS_RESOURCE_INTENSIVE from dq")
def categories(spark, d):
    return I.query_metrics(S.query_history(spark, d)).select("QUERY_ID", "QUERY_CATEGORY", "IS_AUTOMATED", "IS_RESOURCE_INTENSIVE")


@query("in13_performance_summary", f"""with {DERIVED} select count(*) as total_queries, count(*) filter (EXECUTION_STATUS='SUCCESS') as successful_queries, count(*) filter (EXECUTION_STATUS='FAIL') as failed_queries,
 count(*) filter (EXECUTION_STATUS='CANCELLED') as cancelled_queries, round(avg(ms),6) as avg_duration_ms, round(median(ms),6) as median_duration_ms, sum(BYTES_SCANNED) as total_bytes_scanned,
 sum(ROWS_PRODUCED) as total_rows_produced, round(avg(CACHE_HIT_RATIO),6) as avg_cache_hit_ratio, count(*) filter (ms > 60000) as slow_queries_count from dq""")
def performance_summary(spark, d):
    return I.performance_summary(I.query_metrics(S.query_history(spark, d)))


@query("in14_performance_issues", f"""with {DERIVED}, m as (select 'slow_queries' as issue, ms as measure, QUERY_ID from dq where ms > 60000 union all select 'high_spillage', SPILLAGE_RATIO, QUERY_ID from dq where SPILLAGE_RATIO > 0.1
 union all select 'low_cache_utilization', CACHE_HIT_RATIO, QUERY_ID from dq where CACHE_HIT_RATIO < 0.1)
select issue, count(*) as count, round(avg(measure),6) as avg_measure, array_to_string(list_sort(list(QUERY_ID))[1:5], ',') as sample_query_ids from m group by 1""")
def performance_issues(spark, d):
    return I.performance_issues(I.query_metrics(S.query_history(spark, d)))


@query("in15_opportunities", f"""with {DERIVED}, t as (select QUERY_TEXT, count(*) as n from dq group by 1 having count(*) > 5)
select 'repeated_queries' as type, count(*) as count, max(n)::double as measure from t having count(*) > 0
union all select 'large_table_scans', count(*), round(avg(b),6) from (select BYTES_SCANNED*10 as b from dq) where b > 1e10 having count(*) > 0""")
def optimisation_opportunities(spark, d):
    metrics = I.query_metrics(S.query_history(spark, d))
    return I.optimisation_opportunities(metrics.withColumn("BYTES_SCANNED", F.col("BYTES_SCANNED") * 10))


@query("in16_resource_patterns", f"""with {DERIVED}, l as (select 'by_warehouse' as pattern, WAREHOUSE_NAME as value, ms, BYTES_SCANNED from dq union all select 'by_user', USER_NAME, ms, BYTES_SCANNED from dq
 union all select 'by_hour', cast(hour(START_TIME) as varchar), ms, BYTES_SCANNED from dq)
select pattern, value, count(*) as query_count, round_even(avg(ms),2) as mean_duration_ms, round_even(sum(ms),2) as total_duration_ms, sum(BYTES_SCANNED) as bytes_scanned from l group by 1, 2""")
def resource_patterns(spark, d):
    return I.resource_patterns(I.query_metrics(S.query_history(spark, d)))


@query("in17_hourly_trends", f"""with {DERIVED} select date_trunc('hour', START_TIME)::timestamp as hour, count(*) as query_count, round(avg(ms),6) as avg_duration_ms, sum(BYTES_SCANNED) as bytes_scanned,
 round(avg(CACHE_HIT_RATIO),6) as cache_hit_ratio from dq group by 1""")
def hourly_trends(spark, d):
    return I.hourly_trends(I.query_metrics(S.query_history(spark, d)))


@query("in18_query_recommendations", f"""with {DERIVED}, r as (select avg(ms) as d, avg(CACHE_HIT_RATIO) as c, avg(SPILLAGE_RATIO) as s, avg(case when EXECUTION_STATUS <> 'SUCCESS' then 1.0 else 0 end) as e from dq)
select 'optimize_frequent_queries' as recommendation, round(d,6) as measure, 30000::double as threshold from r where d > 30000 union all select 'enable_result_caching', round(c,6), 0.3 from r where c < 0.3
union all select 'use_larger_warehouse', round(s,6), 0.05 from r where s > 0.05 union all select 'review_failed_queries', round(e,6), 0.05 from r where e > 0.05""")
def query_recommendations(spark, d):
    return I.query_recommendations(I.query_metrics(S.query_history(spark, d)))


USAGE = f"""cu as (select * from metering qualify row_number() over (partition by START_TIME, WAREHOUSE_ID order by SEQ) = 1),
du as (select *, case when h > 0 then CREDITS_USED/h else 0 end as CREDITS_PER_HOUR, case when h > 0 then (BYTES_SCANNED+BYTES_WRITTEN)/1073741824.0::double/h else 0 end as DATA_THROUGHPUT_GB_PER_HOUR,
 case when CREDITS_USED > 0 then CREDITS_USED_COMPUTE/CREDITS_USED else 0 end as COMPUTE_CREDIT_RATIO, case when CREDITS_USED > 0 then CREDITS_USED_CLOUD_SERVICES/CREDITS_USED else 0 end as CLOUD_SERVICES_RATIO,
 CREDITS_USED*3 as ESTIMATED_COST_USD, hour(START_TIME) as HOUR_OF_DAY, isodow(START_TIME)-1 as DAY_OF_WEEK from (select *, (epoch_us(END_TIME)-epoch_us(START_TIME))/3.6e9 as h from cu))"""
LOAD = f"""cl as (select *, AVG_RUNNING+AVG_QUEUED_LOAD+AVG_QUEUED_PROVISIONING+AVG_BLOCKED as t from loads qualify row_number() over (partition by START_TIME, WAREHOUSE_ID order by SEQ) = 1),
dl as (select *, t as TOTAL_LOAD, case when t > 0 then AVG_RUNNING/t else 0 end as UTILIZATION_RATIO, case when t > 0 then (AVG_QUEUED_LOAD+AVG_QUEUED_PROVISIONING)/t else 0 end as QUEUE_RATIO,
 case when t > 0 then AVG_BLOCKED/t else 0 end as BLOCKED_RATIO, {_cut('t', [0, 0.2, 0.5, 0.8, 1.0, INF], ['Low', 'Medium', 'High', 'Very High', 'Overloaded'])} as LOAD_CLASSIFICATION from cl)"""


def _usage(spark, d):
    return I.derive_usage_metrics(I.clean_usage(S.metering_history(spark, d), "SEQ"))


def _load(spark, d):
    return I.derive_load_metrics(I.clean_load(S.load_history(spark, d), "SEQ"))


@query("in19_clean_usage", f"with {USAGE} select SEQ, START_TIME, WAREHOUSE_ID, round(CREDITS_USED,6) as CREDITS_USED, BYTES_SCANNED::double as BYTES_SCANNED from cu")
def clean_usage(spark, d):
    return I.clean_usage(S.metering_history(spark, d), "SEQ").select("SEQ", "START_TIME", "WAREHOUSE_ID", "CREDITS_USED", "BYTES_SCANNED")


@query("in19_clean_load", f"with {LOAD} select SEQ, START_TIME, WAREHOUSE_ID, round(AVG_RUNNING,6) as AVG_RUNNING, round(AVG_BLOCKED,6) as AVG_BLOCKED from cl")
def clean_load(spark, d):
    return I.clean_load(S.load_history(spark, d), "SEQ").select("SEQ", "START_TIME", "WAREHOUSE_ID", "AVG_RUNNING", "AVG_BLOCKED")


U6 = ", ".join(f"round({c},6) as {c}" for c in ("CREDITS_PER_HOUR", "DATA_THROUGHPUT_GB_PER_HOUR", "COMPUTE_CREDIT_RATIO", "CLOUD_SERVICES_RATIO", "ESTIMATED_COST_USD"))


@query("in20_usage_metrics", f"with {USAGE} select SEQ, {U6}, h as PERIOD_DURATION_HOURS, HOUR_OF_DAY, DAY_OF_WEEK from du")
def usage_metrics(spark, d):
    return _usage(spark, d).select("SEQ", "PERIOD_DURATION_HOURS", "CREDITS_PER_HOUR", "DATA_THROUGHPUT_GB_PER_HOUR", "COMPUTE_CREDIT_RATIO",
                                   "CLOUD_SERVICES_RATIO", "ESTIMATED_COST_USD", "HOUR_OF_DAY", "DAY_OF_WEEK")


L6 = ", ".join(f"round({c},6) as {c}" for c in ("TOTAL_LOAD", "UTILIZATION_RATIO", "QUEUE_RATIO", "BLOCKED_RATIO"))


@query("in21_load_metrics", f"with {LOAD} select SEQ, {L6}, LOAD_CLASSIFICATION from dl")
def load_metrics(spark, d):
    return _load(spark, d).select("SEQ", "TOTAL_LOAD", "UTILIZATION_RATIO", "QUEUE_RATIO", "BLOCKED_RATIO", "LOAD_CLASSIFICATION")


@query("in22_usage_summary", f"""with {USAGE} select round(sum(CREDITS_USED),6) as total_credits_used, round(avg(CREDITS_PER_HOUR),6) as avg_credits_per_hour, round(sum(ESTIMATED_COST_USD),6) as total_estimated_cost,
 count(distinct WAREHOUSE_NAME) as unique_warehouses from du""")
def usage_summary(spark, d):
    return I.usage_summary(_usage(spark, d))


@query("in22_usage_by_warehouse", f"""with {USAGE} select WAREHOUSE_NAME, {', '.join(f'round_even({f}({c}),2) as {c}' for c, f in (('CREDITS_USED', 'sum'), ('ESTIMATED_COST_USD', 'sum'),
 ('CREDITS_PER_HOUR', 'avg'), ('DATA_THROUGHPUT_GB_PER_HOUR', 'avg'), ('COMPUTE_CREDIT_RATIO', 'avg')))} from du group by 1""")
def usage_by_warehouse(spark, d):
    return I.usage_by_warehouse(_usage(spark, d))


@query("in22_usage_by_time", f"""with {USAGE} select 'hourly' as pattern, HOUR_OF_DAY as slot, round(sum(CREDITS_USED),6) as credits from du group by 2
 union all select 'daily', DAY_OF_WEEK, round(sum(CREDITS_USED),6) from du group by 2""")
def usage_by_time(spark, d):
    return I.usage_by_time(_usage(spark, d))


@query("in23_load_summary", f"""with {LOAD} select round(avg(UTILIZATION_RATIO),6) as avg_utilization, round(avg(QUEUE_RATIO),6) as avg_queue_ratio, round(avg(BLOCKED_RATIO),6) as avg_blocked_ratio,
 round(max(TOTAL_LOAD),6) as peak_load, count(*) filter (TOTAL_LOAD > 1) as overloaded_periods from dl""")
def load_summary(spark, d):
    return I.load_summary(_load(spark, d))


@query("in23_load_by_warehouse", f"""with {LOAD} select WAREHOUSE_NAME, round_even(avg(UTILIZATION_RATIO),3) as UTILIZATION_RATIO, round_even(avg(QUEUE_RATIO),3) as QUEUE_RATIO,
 round_even(avg(BLOCKED_RATIO),3) as BLOCKED_RATIO, round_even(max(TOTAL_LOAD),3) as TOTAL_LOAD from dl group by 1""")
def load_by_warehouse(spark, d):
    return I.load_by_warehouse(_load(spark, d))


@query("in23_load_distribution", f"with {LOAD} select LOAD_CLASSIFICATION, count(*) as periods from dl where LOAD_CLASSIFICATION is not null group by 1")
def load_distribution(spark, d):
    return I.load_distribution(_load(spark, d))


SAVE = USAGE + """, sv as ((select 'high_cost_warehouses' as type, WAREHOUSE_NAME as name, sum(ESTIMATED_COST_USD) as cost, null::double as share from du group by 2 having sum(ESTIMATED_COST_USD) > 30 order by 3 desc, 2 limit 5)
 union all select 'low_efficiency_periods', null, sum(ESTIMATED_COST_USD), null from du where COMPUTE_CREDIT_RATIO < 0.5 having count(*) > 0
 union all select 'weekend_usage', null, w, w/t*100 from (select sum(ESTIMATED_COST_USD) filter (DAY_OF_WEEK >= 5) as w, sum(ESTIMATED_COST_USD) as t from du) where w/t*100 > 20)"""


@query("in24_cost_opportunities", f"with {SAVE} select type, name, round(cost,6) as cost, round(share,6) as share from sv")
def cost_opportunities(spark, d):
    return I.cost_opportunities(_usage(spark, d))


LISS = LOAD + """, li as (select 'high_queue_times' as type, QUEUE_RATIO as v, WAREHOUSE_NAME as w from dl where QUEUE_RATIO > 0.3 union all select 'overloaded_warehouses', TOTAL_LOAD, WAREHOUSE_NAME from dl where TOTAL_LOAD > 1
 union all select 'high_blocked_ratio', BLOCKED_RATIO, WAREHOUSE_NAME from dl where BLOCKED_RATIO > 0.1),
 lx as (select type, count(*) as count, case when type = 'overloaded_warehouses' then max(v) else avg(v) end as measure, array_to_string(list_sort(list(distinct w)), ',') as affected_warehouses from li group by 1)"""


@query("in25_load_issues", f"with {LISS} select type, count, round(measure,6) as measure, affected_warehouses from lx")
def load_issues(spark, d):
    return I.load_issues(_load(spark, d))


@query("in26_warehouse_recommendations", f"""with {USAGE}, {LOAD}, r as (select (select avg(CREDITS_PER_HOUR)*3 from du) as cost, (select avg(COMPUTE_CREDIT_RATIO) from du) as compute, (select avg(UTILIZATION_RATIO) from dl) as used, (select avg(QUEUE_RATIO) from dl) as queue)
select 'suspend_idle_and_resize' as recommendation, round(cost,6) as measure, 50::double as threshold from r where cost > 50 union all select 'review_compute_share', round(compute,6), 0.7 from r where compute < 0.7
union all select 'consolidate_workloads', round(used,6), 0.3 from r where used < 0.3 union all select 'scale_up_for_queueing', round(queue,6), 0.2 from r where queue > 0.2
union all select 'monitor_regularly', 1, 0 union all select 'consider_auto_scaling', 1, 0""")
def warehouse_recommendations(spark, d):
    return I.warehouse_recommendations(_usage(spark, d), _load(spark, d))


@query("in26_action_items", f"""with {SAVE}, {LISS}, a as (select 'High' as priority, 'Performance' as category, type as title, 'Immediate' as urgency, 0::double as cost_impact from lx
 union all select case when c > 100 then 'High' else 'Medium' end, 'Cost Optimization', type, 'Medium', c from (select type, coalesce(max(case when type = 'low_efficiency_periods' then cost end),0) as c from sv group by 1))
select priority, category, title, urgency, round(cost_impact,6) as cost_impact, case priority when 'High' then 1 when 'Medium' then 2 else 3 end as "order" from a""")
def action_items(spark, d):
    return I.action_items(_usage(spark, d), _load(spark, d))


@query("in26_executive_summary", f"""with {SAVE}, {LISS} select round((select sum(ESTIMATED_COST_USD) from du),6) as total_cost, (select count(distinct WAREHOUSE_NAME) from du) as warehouse_count,
 round((select avg(UTILIZATION_RATIO) from dl),6) as avg_utilization, (select count(*) from lx) as performance_issues_count, (select count(distinct type) from sv) as optimization_opportunities_count,
 case when (select sum(ESTIMATED_COST_USD) from du) > 1000 then 1 else 0 end as is_high_cost, case when (select avg(UTILIZATION_RATIO) from dl) < 0.5 then 1 else 0 end as is_low_utilization""")
def executive_summary(spark, d):
    return I.executive_summary(_usage(spark, d), _load(spark, d))


LOGIN = """lg as (select *, hour(EVENT_TIMESTAMP) as HOUR_OF_DAY, isodow(EVENT_TIMESTAMP)-1 as DAY_OF_WEEK, isodow(EVENT_TIMESTAMP) >= 6 as IS_WEEKEND, hour(EVENT_TIMESTAMP) between 8 and 18 as IS_BUSINESS_HOURS,
 case REPORTED_CLIENT_TYPE when 'JDBC_DRIVER' then 'Application' when 'ODBC_DRIVER' then 'Application' when 'PYTHON_CONNECTOR' then 'Script/API' when 'WEB_UI' then 'Web Interface' when 'SQL_CLI' then 'CLI Tool' else 'Other' end as CLIENT_CATEGORY from logins)"""


@query("in27_login_features", f"with {LOGIN} select EVENT_ID, HOUR_OF_DAY, DAY_OF_WEEK, IS_WEEKEND, IS_BUSINESS_HOURS, CLIENT_CATEGORY from lg")
def login_features(spark, d):
    return I.login_features(S.login_history(spark, d)).select("EVENT_ID", "HOUR_OF_DAY", "DAY_OF_WEEK", "IS_WEEKEND", "IS_BUSINESS_HOURS", "CLIENT_CATEGORY")


@query("in28_login_summary", f"""with {LOGIN} select count(*) as total_logins, count(distinct USER_NAME) as unique_users, round(avg((IS_SUCCESS='YES')::int),6) as success_rate, round(avg(IS_WEEKEND::int),6) as weekend_activity_ratio,
 round(avg(IS_BUSINESS_HOURS::int),6) as business_hours_ratio from lg""")
def login_summary(spark, d):
    return I.login_summary(I.login_features(S.login_history(spark, d)))


@query("in28_login_patterns", f"""with {LOGIN} (select 'top_users' as pattern, USER_NAME as name, count(*) as logins from lg group by 2 order by 3 desc, 2 limit 10)
union all select 'client_usage', CLIENT_CATEGORY, count(*) from lg group by 2 union all select 'hourly_pattern', cast(HOUR_OF_DAY as varchar), count(*) from lg group by 2
union all (select 'failed_logins', USER_NAME, count(*) from lg where IS_SUCCESS = 'NO' group by 2 order by 3 desc, 2 limit 10)""")
def login_patterns(spark, d):
    return I.login_patterns(I.login_features(S.login_history(spark, d)))


@query("in29_metering_costs", """select SEQ, round(CREDITS_USED*3,6) as ESTIMATED_COST_USD, round(CREDITS_USED_COMPUTE*3,6) as COMPUTE_COST_USD, round(CREDITS_USED_CLOUD_SERVICES*3,6) as CLOUD_SERVICES_COST_USD,
 date_trunc('day', START_TIME)::timestamp as DATE, hour(START_TIME) as HOUR, isodow(START_TIME)-1 as DAY_OF_WEEK from metering""")
def metering_costs(spark, d):
    return I.metering_costs(S.metering_history(spark, d)).select(
        "SEQ", "ESTIMATED_COST_USD", "COMPUTE_COST_USD", "CLOUD_SERVICES_COST_USD", "DATE", "HOUR", "DAY_OF_WEEK")


STORE = """st as (select *, AVERAGE_DATABASE_BYTES/1099511627776*(40.0::double/30) as s, AVERAGE_FAILSAFE_BYTES/1099511627776*(40.0::double/30)*0.5 as f from storage)"""


@query("in30_storage_costs", f"with {STORE} select USAGE_DATE, DATABASE_NAME, round(s,6) as STORAGE_COST_USD, round(f,6) as FAILSAFE_COST_USD, round(s+f,6) as TOTAL_STORAGE_COST_USD from st")
def storage_costs(spark, d):
    return I.storage_costs(S.storage_usage(spark, d)).drop("AVERAGE_DATABASE_BYTES", "AVERAGE_FAILSAFE_BYTES")


@query("in31_metering_report", """with m as (select date_trunc('day', START_TIME) as dd, SERVICE_TYPE, CREDITS_USED*3 as c from metering), y as (select dd, sum(c) as c from m group by 1)
select 'total' as section, null::varchar as name, round(sum(c),6) as cost from y union all select 'daily_mean', null, round(avg(c),6) from y union all select 'cost_by_service', SERVICE_TYPE, round(sum(c),6) from m group by 2
union all (select 'cost_trend', strftime(dd, '%Y-%m-%d'), round(c,6) from y order by dd desc limit 7)""")
def metering_report(spark, d):
    return I.cost_report(I.metering_costs(S.metering_history(spark, d)), "ESTIMATED_COST_USD", "SERVICE_TYPE", "DATE", "cost_by_service")


@query("in31_storage_report", f"""with {STORE}, y as (select USAGE_DATE as dd, sum(s+f) as c from st group by 1)
select 'total' as section, null::varchar as name, round(sum(c),6) as cost from y union all select 'daily_mean', null, round(avg(c),6) from y union all select 'cost_by_database', DATABASE_NAME, round(sum(s+f),6) from st group by 2
union all (select 'cost_trend', strftime(dd, '%Y-%m-%d'), round(c,6) from y order by dd desc limit 7)""")
def storage_report(spark, d):
    return I.cost_report(I.storage_costs(S.storage_usage(spark, d)), "TOTAL_STORAGE_COST_USD", "DATABASE_NAME", "USAGE_DATE", "cost_by_database")


@query("in32_total_costs", f"""with {STORE}, r as (select (select sum(CREDITS_USED*3) from metering) as c, (select sum(s+f) from st) as s)
select round(c,6) as compute_cost_usd, round(s,6) as storage_cost_usd, round(c+s,6) as total_cost_usd, round(c/(c+s)*100,6) as compute_pct, round(s/(c+s)*100,6) as storage_pct from r""")
def total_costs(spark, d):
    return I.total_costs(I.metering_costs(S.metering_history(spark, d)), I.storage_costs(S.storage_usage(spark, d)))
