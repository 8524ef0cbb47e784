"""Queries over usage aggregation."""

from pyspark.sql import functions as F

from tidewatch.operators import usage as U
from tidewatch.plans.dimensional import PCT
from tidewatch.plans.registry import query
from tidewatch.sources.tables import cost_facts, query_log

SPAN = "(epoch_us(max(START_TIME))-epoch_us(min(START_TIME)))/3.6e9"
DIST = """select min_by(hour, (-n, hour)) as peak_hour, min_by(hour, (n, hour)) as off_peak_hour, var_samp(n) as hour_variance,
  sum(case when hour between 9 and 17 then n else 0 end)/sum(n) as business_hours_query_ratio from (select hour(START_TIME) as hour, count(*) as n from qlog group by 1)"""
DIST_DAY = """select min_by(dow, (-n, dow)) as peak_day_of_week, sum(case when dow >= 5 then n else 0 end)/sum(n) as weekend_query_ratio
  from (select isodow(START_TIME)-1 as dow, count(*) as n from qlog group by 1)"""
DIST_COLS = """peak_hour, off_peak_hour, round(hour_variance,6) as hour_variance, round(business_hours_query_ratio,6) as business_hours_query_ratio,
  peak_day_of_week, round(weekend_query_ratio,6) as weekend_query_ratio"""
PS = ", ".join(f"round(quantile_cont(CREDITS_USED,{p}),6) as CREDITS_USED_p{int(p*100)}" for p in (0.5, 0.75, 0.9, 0.95, 0.99))


@query("ua02_basic_usage", f"""
select a.*, {DIST_COLS} from (select count(*) as total_queries, count(distinct USER_NAME) as unique_users, count(distinct WAREHOUSE_NAME) as unique_warehouses,
  count(distinct DATABASE_NAME) as unique_databases, round({SPAN},6) as analysis_period_hours, round(count(*)/greatest({SPAN},1),6) as queries_per_hour,
  min(START_TIME) as analysis_start, max(START_TIME) as analysis_end, round(sum(CREDITS_USED),6) as CREDITS_USED_total, round(avg(CREDITS_USED),6) as CREDITS_USED_mean,
  round(median(CREDITS_USED),6) as CREDITS_USED_median, round(stddev_samp(CREDITS_USED),6) as CREDITS_USED_std, {PS} from qlog) a, ({DIST}), ({DIST_DAY})""")
def basic_usage(spark, d):
    return U.basic_usage(query_log(spark, d), ["CREDITS_USED"])


@query("ua03_time_distribution", f"select {DIST_COLS} from ({DIST}), ({DIST_DAY})")
def time_distribution(spark, d):
    return U.time_distribution(query_log(spark, d))


def _pat(keys, name, spread, users, t="qlog", having="having count(*) >= 5"):
    cols = ["QUERY_TYPE", "DATABASE_NAME", "SCHEMA_NAME", "USER_NAME", "WAREHOUSE_NAME"]
    key = ", ".join((k if k in keys else f"null::varchar as {k}") for k in cols)
    if t == "qlog":
        key = key.replace("null::varchar as SCHEMA_NAME, ", "")
    s = "stddev_samp(CREDITS_USED)" if spread else "null::double"
    em = "avg(EXECUTION_TIME_MS)" if spread else "null::double"
    es = "stddev_samp(EXECUTION_TIME_MS)" if spread else "null::double"
    md = "median(EXECUTION_TIME_MS)" if name == "query_type" else "null::double"
    u = "count(distinct USER_NAME)" if users else "null::bigint"
    return (f"select {key}, count(*) as QUERY_ID_count, sum(CREDITS_USED) as CREDITS_USED_sum, avg(CREDITS_USED) as CREDITS_USED_mean, {s} as CREDITS_USED_std, "
            f"{em} as EXECUTION_TIME_MS_mean, {es} as EXECUTION_TIME_MS_std, {md} as EXECUTION_TIME_MS_median, {u} as USER_NAME_nunique, "
            f"'{name}' as pattern_type from {t} group by {', '.join(keys)} {having}")


PATTERNS = " union all ".join([_pat(["QUERY_TYPE"], "query_type", True, False, having=""), _pat(["DATABASE_NAME"], "database_access", False, True),
                               _pat(["USER_NAME", "QUERY_TYPE"], "user_query", True, False), _pat(["WAREHOUSE_NAME", "QUERY_TYPE"], "warehouse_usage", False, True)])
ROUND_PATTERN = ", ".join(f"round({c},6) as {c}" for c in ("CREDITS_USED_sum", "CREDITS_USED_mean", "CREDITS_USED_std", "EXECUTION_TIME_MS_mean",
                                                         "EXECUTION_TIME_MS_std", "EXECUTION_TIME_MS_median"))


@query("ua04_query_patterns", f"""
with p as (select * replace (round(CREDITS_USED_sum, 9) as CREDITS_USED_sum) from ({PATTERNS})),
r as (select *, dense_rank() over (partition by pattern_type order by QUERY_ID_count desc) as frequency_rank, {PCT('QUERY_ID_count', 'pattern_type')} as frequency_percentile,
 dense_rank() over (partition by pattern_type order by CREDITS_USED_sum desc) as cost_rank, {PCT('CREDITS_USED_sum', 'pattern_type')} as cost_percentile from p)
select QUERY_TYPE, DATABASE_NAME, USER_NAME, WAREHOUSE_NAME, QUERY_ID_count, USER_NAME_nunique, pattern_type, {ROUND_PATTERN}, frequency_rank, round(frequency_percentile,6) as frequency_percentile,
 cost_rank, round(cost_percentile,6) as cost_percentile, case when frequency_percentile >= 0.8 then 1 else 0 end as is_high_frequency,
 case when frequency_percentile <= 0.2 then 1 else 0 end as is_rare_pattern, case when cost_percentile >= 0.8 then 1 else 0 end as is_high_cost_pattern from r""")
def query_patterns(spark, d):
    return U.all_patterns(query_log(spark, d))


@query("ua05_database_patterns", """
select DATABASE_NAME, SCHEMA_NAME, count(*) as QUERY_ID_count, round(sum(CREDITS_USED),6) as CREDITS_USED_sum, round(avg(CREDITS_USED),6) as CREDITS_USED_mean,
  count(distinct USER_NAME) as USER_NAME_nunique, 'database_access' as pattern_type from facts group by 1, 2 having count(*) >= 5""")
def database_patterns(spark, d):
    return U.database_patterns(cost_facts(spark, d))


@query("ua06_user_patterns", """
select USER_NAME, QUERY_TYPE, count(*) as QUERY_ID_count, round(sum(CREDITS_USED),6) as CREDITS_USED_sum, round(avg(CREDITS_USED),6) as CREDITS_USED_mean,
  round(stddev_samp(CREDITS_USED),6) as CREDITS_USED_std, round(avg(EXECUTION_TIME_MS),6) as EXECUTION_TIME_MS_mean, round(stddev_samp(EXECUTION_TIME_MS),6) as EXECUTION_TIME_MS_std,
  'user_query' as pattern_type from facts group by 1, 2 having count(*) >= 5""")
def user_patterns(spark, d):
    return U.user_patterns(cost_facts(spark, d))


@query("ua07_warehouse_patterns", """
select WAREHOUSE_NAME, QUERY_TYPE, count(*) as QUERY_ID_count, round(sum(CREDITS_USED),6) as CREDITS_USED_sum, round(avg(CREDITS_USED),6) as CREDITS_USED_mean,
  count(distinct USER_NAME) as USER_NAME_nunique, 'warehouse_usage' as pattern_type from facts group by 1, 2 having count(*) >= 5""")
def warehouse_patterns(spark, d):
    return U.warehouse_patterns(cost_facts(spark, d))


@query("ua08_pattern_ranks", f"""
with p as (select USER_NAME, count(*) as n, max(CREDITS_USED) as s, 'user_query' as pattern_type from qlog group by 1
  union all select WAREHOUSE_NAME, count(*), max(CREDITS_USED), 'warehouse_usage' from qlog group by 1),
r as (select *, dense_rank() over (partition by pattern_type order by n desc) as frequency_rank, {PCT('n', 'pattern_type')} as frequency_percentile,
 dense_rank() over (partition by pattern_type order by s desc) as cost_rank, {PCT('s', 'pattern_type')} as cost_percentile from p)
select USER_NAME, pattern_type, n as QUERY_ID_count, round(s,6) as CREDITS_USED_sum, frequency_rank, round(frequency_percentile,6) as frequency_percentile, cost_rank,
 round(cost_percentile,6) as cost_percentile, case when frequency_percentile >= 0.8 then 1 else 0 end as is_high_frequency,
 case when frequency_percentile <= 0.2 then 1 else 0 end as is_rare_pattern, case when cost_percentile >= 0.8 then 1 else 0 end as is_high_cost_pattern from r""")
def pattern_ranks(spark, d):
    log = query_log(spark, d)
    part = lambda key, kind: log.groupBy(F.col(key).alias("USER_NAME")).agg(
        F.count("*").alias("QUERY_ID_count"), F.max("CREDITS_USED").alias("CREDITS_USED_sum"),
        F.lit(kind).alias("pattern_type"))
    return U.rank_patterns(part("USER_NAME", "user_query").unionByName(part("WAREHOUSE_NAME", "warehouse_usage")))


SESSIONS = """with g as (select *, case when (epoch_us(START_TIME)-epoch_us(lag(START_TIME) over w))/6e7 > 60 then 1 else 0 end as b from qlog
  window w as (partition by USER_NAME order by START_TIME, QUERY_ID)),
s as (select *, sum(b) over (partition by USER_NAME order by START_TIME, QUERY_ID rows unbounded preceding) as session_id from g)"""


@query("ua09_sessions", SESSIONS + " select QUERY_ID, USER_NAME, cast(session_id as bigint) as session_id from s")
def sessions(spark, d):
    return U.with_sessions(query_log(spark, d)).select("QUERY_ID", "USER_NAME", "session_id")


DUR = "(epoch_us(max(START_TIME))-epoch_us(min(START_TIME)))/6e7"


@query("ua10_session_statistics", SESSIONS.replace("qlog", "(select * replace (WAREHOUSE_NAME as USER_NAME) from qlog)").replace("> 60", "> 10") + f"""
select USER_NAME as user_name, min(START_TIME) as session_start, max(START_TIME) as session_end, round({DUR},6) as session_duration_minutes, count(*) as query_count,
  round(sum(CREDITS_USED),6) as total_credits, round(avg(CREDITS_USED),6) as avg_credits_per_query, round(sum(EXECUTION_TIME_MS),6) as total_execution_time_ms,
  round(avg(EXECUTION_TIME_MS),6) as avg_execution_time_ms, count(distinct QUERY_TYPE) as unique_query_types, count(distinct DATABASE_NAME) as unique_databases,
  round(count(*)/greatest({DUR},1),6) as queries_per_minute, round(sum(CREDITS_USED)/greatest({DUR},1),6) as credits_per_minute,
  round(count(distinct QUERY_TYPE)/count(*),6) as query_type_diversity, round(count(distinct DATABASE_NAME)/count(*),6) as database_diversity
from s group by USER_NAME, session_id having count(*) >= 3""")
def session_statistics(spark, d):
    # sessions of a warehouse: long enough to hold several queries
    log = query_log(spark, d).withColumn("USER_NAME", F.col("WAREHOUSE_NAME"))
    return U.session_statistics(log, minutes=10)


WORK = ", ".join(f"{f}(x.{c}) as {c}_{n}" for c, n, f in (("CREDITS_USED", "sum", "sum"), ("CREDITS_USED", "mean", "avg"),
                                                       ("EXECUTION_TIME_MS", "sum", "sum"), ("EXECUTION_TIME_MS", "mean", "avg")))
WORKLOAD = f"""with l as (select hour(START_TIME) as hour, null::bigint as day_of_week, null::timestamp as date, count(*) as QUERY_ID_count, {WORK}, 'hourly' as pattern_type from qlog x group by 1
 union all select null, isodow(START_TIME)-1, null, count(*), {WORK}, 'day_of_week' from qlog x group by 2
 union all select null, null, date_trunc('day', START_TIME)::timestamp, count(*), {WORK}, 'daily' from qlog x group by 3)"""


@query("ua11_workload", WORKLOAD + f""", m as (select * replace (round(CREDITS_USED_sum,6) as CREDITS_USED_sum) from l)
select hour, day_of_week, date, QUERY_ID_count, CREDITS_USED_sum, round(CREDITS_USED_mean,6) as CREDITS_USED_mean, round(EXECUTION_TIME_MS_sum,6) as EXECUTION_TIME_MS_sum,
 round(EXECUTION_TIME_MS_mean,6) as EXECUTION_TIME_MS_mean, pattern_type, case when QUERY_ID_count >= (select quantile_cont(QUERY_ID_count,0.9) from l) then 1 else 0 end as is_peak_period,
 case when QUERY_ID_count <= (select quantile_cont(QUERY_ID_count,0.25) from l) then 1 else 0 end as is_off_peak_period,
 dense_rank() over (order by CREDITS_USED_sum desc) as credits_rank, round({PCT('CREDITS_USED_sum')},6) as credits_percentile from m""")
def workload(spark, d):
    return U.workload(query_log(spark, d))


def _mode(key, col, t="qlog"):
    return (f"(select {key}, min_by({col}, (-n, {col})) as v, max(n) as n from (select {key}, {col}, count(*) as n from {t} where {col} is not null group by 1, 2) group by 1)")


LOGX = "(select *, hour(START_TIME) as h, isodow(START_TIME)-1 as w from qlog)"
BEHAVIOR = f"""select a.*, mh.v as most_active_hour, md.v as most_active_day, qt.v as primary_query_type, qt.n/total_queries as query_type_concentration, db.v as primary_database, wh.v as primary_warehouse
from (select USER_NAME, count(*) as total_queries, min(START_TIME) as first_query, max(START_TIME) as last_query,
 cast(floor((epoch_us(max(START_TIME))-epoch_us(min(START_TIME)))/86400e6) as bigint)+1 as activity_period_days, sum(CREDITS_USED) as total_credits, avg(CREDITS_USED) as avg_credits_per_query,
 stddev_samp(CREDITS_USED) as credits_std, max(CREDITS_USED) as max_single_query_credits, avg(EXECUTION_TIME_MS) as avg_execution_time_ms, stddev_samp(EXECUTION_TIME_MS) as execution_time_std,
 max(EXECUTION_TIME_MS) as max_execution_time_ms, avg(BYTES_SCANNED) as avg_bytes_scanned, max(BYTES_SCANNED) as max_bytes_scanned, count(distinct h) as hour_diversity,
 count(distinct QUERY_TYPE) as query_type_diversity, count(distinct DATABASE_NAME) as unique_databases_accessed, count(distinct WAREHOUSE_NAME) as unique_warehouses_used from {LOGX} group by 1) a
join {_mode('USER_NAME', 'h', LOGX)} mh using (USER_NAME) join {_mode('USER_NAME', 'w', LOGX)} md using (USER_NAME) join {_mode('USER_NAME', 'QUERY_TYPE')} qt using (USER_NAME)
join {_mode('USER_NAME', 'DATABASE_NAME')} db using (USER_NAME) join {_mode('USER_NAME', 'WAREHOUSE_NAME')} wh using (USER_NAME)"""


def _cut(x, edges, labels):
    return "case " + " ".join(f"when {x} > {a} and {x} <= {b} then '{t}'" for a, b, t in zip(edges, edges[1:], labels)) + " end"


BIG = "1e300"
SEGMENTS = ", ".join([
    _cut("total_queries", [0, 10, 100, 1000, BIG], ["low", "medium", "high", "very_high"]) + " as volume_segment",
    _cut("total_credits", [0, 1, 10, 100, BIG], ["light", "moderate", "heavy", "very_heavy"]) + " as credit_segment",
    _cut("hour_diversity", [0, 4, 8, 16, 24], ["narrow", "focused", "broad", "continuous"]) + " as activity_pattern",
    _cut("avg_execution_time_ms", [0, 1000, 10000, 60000, BIG], ["simple", "moderate", "complex", "very_complex"]) + " as complexity_segment"])


@query("ua13_user_behavior", f"""
select USER_NAME as user_name, total_queries, first_query, last_query, activity_period_days, max_bytes_scanned, hour_diversity, query_type_diversity, unique_databases_accessed, unique_warehouses_used,
 most_active_hour, most_active_day, primary_query_type, primary_database, primary_warehouse, round(total_queries/activity_period_days,6) as queries_per_day,
 {', '.join(f"round({c},6) as {c}" for c in ('total_credits', 'avg_credits_per_query', 'credits_std', 'max_single_query_credits', 'avg_execution_time_ms', 'execution_time_std', 'max_execution_time_ms', 'avg_bytes_scanned', 'query_type_concentration'))},
 {SEGMENTS} from ({BEHAVIOR})""")
def user_behavior(spark, d):
    return U.user_behavior(query_log(spark, d))


@query("ua14_user_segments", f"""
with u as (select USER_NAME, count(*) as total_queries, sum(CREDITS_USED) as total_credits, count(distinct month(START_TIME)) as hour_diversity,
  avg(EXECUTION_TIME_MS) as avg_execution_time_ms from facts group by 1)
select USER_NAME, {SEGMENTS} from u""")
def user_segments(spark, d):
    users = cost_facts(spark, d).withColumn("_month", F.month("START_TIME"))
    agg = users.groupBy("USER_NAME").agg(
        F.count("*").alias("total_queries"), F.sum("CREDITS_USED").alias("total_credits"),
        F.count_distinct("_month").alias("hour_diversity"), F.avg("EXECUTION_TIME_MS").alias("avg_execution_time_ms"))
    return U.add_user_segments(agg).select("USER_NAME", "volume_segment", "credit_segment", "activity_pattern", "complexity_segment")


WAREHOUSES = f"""select a.*, pu.v as primary_user, pu.n/total_queries as user_concentration, qt.v as primary_query_type, db.v as primary_database, ph.v as peak_hour
from (select WAREHOUSE_NAME, count(*) as total_queries, min(START_TIME) as first_query, max(START_TIME) as last_query, {SPAN} as activity_period_hours, sum(CREDITS_USED) as total_credits,
 avg(CREDITS_USED) as avg_credits_per_query, max(CREDITS_USED) as max_single_query_credits, avg(EXECUTION_TIME_MS) as avg_execution_time_ms, max(EXECUTION_TIME_MS) as max_execution_time_ms,
 quantile_cont(EXECUTION_TIME_MS,0.95) as execution_time_p95, count(distinct USER_NAME) as unique_users, count(distinct QUERY_TYPE) as unique_query_types, count(distinct DATABASE_NAME) as unique_databases,
 count(distinct h) as active_hours, count(*)/greatest({SPAN},1) as queries_per_hour, sum(CREDITS_USED)/greatest({SPAN},1) as credits_per_hour from {LOGX} group by 1) a
join {_mode('WAREHOUSE_NAME', 'USER_NAME')} pu using (WAREHOUSE_NAME) join {_mode('WAREHOUSE_NAME', 'QUERY_TYPE')} qt using (WAREHOUSE_NAME)
join {_mode('WAREHOUSE_NAME', 'DATABASE_NAME')} db using (WAREHOUSE_NAME) join {_mode('WAREHOUSE_NAME', 'h', LOGX)} ph using (WAREHOUSE_NAME)"""
WH_EXACT = "total_queries, first_query, last_query, unique_users, unique_query_types, unique_databases, active_hours, primary_user, primary_query_type, primary_database, peak_hour"
WH_ROUND = ", ".join(f"round({c},6) as {c}" for c in (
    "activity_period_hours", "total_credits", "avg_credits_per_query", "max_single_query_credits", "avg_execution_time_ms", "max_execution_time_ms",
    "execution_time_p95", "queries_per_hour", "credits_per_hour", "user_concentration"))


@query("ua15_warehouse_utilization", f"select WAREHOUSE_NAME as warehouse_name, {WH_EXACT}, {WH_ROUND} from ({WAREHOUSES})")
def warehouse_utilization(spark, d):
    return U.warehouse_utilization(query_log(spark, d))


@query("ua16_warehouse_efficiency", f"""
with w as (select WAREHOUSE_NAME, queries_per_hour, credits_per_hour, total_queries/unique_users as queries_per_user from ({WAREHOUSES}))
select WAREHOUSE_NAME as warehouse_name, dense_rank() over (order by queries_per_hour desc) as query_efficiency_rank, round({PCT('queries_per_hour')},6) as query_efficiency_percentile,
 dense_rank() over (order by credits_per_hour desc) as credit_efficiency_rank, round({PCT('credits_per_hour')},6) as credit_efficiency_percentile, round(queries_per_user,6) as queries_per_user,
 dense_rank() over (order by queries_per_user desc) as user_utilization_rank from w""")
def warehouse_efficiency(spark, d):
    wh = U.add_warehouse_efficiency(U.warehouse_utilization(query_log(spark, d)))
    return wh.select("warehouse_name", "query_efficiency_rank", "query_efficiency_percentile", "credit_efficiency_rank",
                     "credit_efficiency_percentile", "queries_per_user", "user_utilization_rank")


OPEN = """ev as (select WAREHOUSE_NAME, START_TIME as t, 0 as o, 1 as delta from qlog union all select WAREHOUSE_NAME, END_TIME, 1, -1 from qlog where END_TIME is not null),
 op as (select WAREHOUSE_NAME, sum(delta) over (partition by WAREHOUSE_NAME order by t, o rows unbounded preceding) as n from ev)"""


@query("ua17_warehouse_capacity", f"""
with h as (select WAREHOUSE_NAME, hour(START_TIME) as hour, count(*) as n from qlog group by 1, 2), {OPEN}
select WAREHOUSE_NAME, max(n) as peak_hourly_load, round(avg(n),6) as avg_hourly_load, round(stddev_samp(n),6) as load_variability,
 (select cast(max(n) as bigint) from op where op.WAREHOUSE_NAME = h.WAREHOUSE_NAME) as estimated_max_concurrency from h group by 1""")
def warehouse_capacity(spark, d):
    return U.warehouse_capacity(query_log(spark, d))


@query("ua18_max_concurrency", f"with {OPEN} select WAREHOUSE_NAME, cast(max(n) as bigint) as estimated_max_concurrency from op group by 1")
def max_concurrency(spark, d):
    return U.max_concurrency(query_log(spark, d))


@query("ua19_volume_segments", f"""
select USER_NAME, count(*) as query_count, round(sum(CREDITS_USED),6) as total_credits, {_cut('count(*)', [0, 10, 100, 1000, BIG], ['low', 'medium', 'high', 'very_high'])} as volume_segment from facts group by 1""")
def volume_segments(spark, d):
    return U.volume_segments(cost_facts(spark, d))


@query("ua20_efficiency_segments", f"""
select USER_NAME, round(sum(CREDITS_USED),6) as CREDITS_USED_sum, round(avg(CREDITS_USED),6) as CREDITS_USED_mean, round(avg(EXECUTION_TIME_MS),6) as EXECUTION_TIME_MS_mean,
 cast(sum(ROWS_PRODUCED) as bigint) as ROWS_PRODUCED_sum, round(sum(CREDITS_USED)/(sum(ROWS_PRODUCED)+1),6) as credits_per_row,
 {_cut('sum(CREDITS_USED)/(sum(ROWS_PRODUCED)+1)', [0, 0.001, 0.01, 0.1, BIG], ['very_efficient', 'efficient', 'moderate', 'inefficient'])} as efficiency_segment from qlog group by 1""")
def efficiency_segments(spark, d):
    return U.efficiency_segments(query_log(spark, d))


@query("ua21_concurrency_patterns", """
with h as (select WAREHOUSE_NAME, hour(START_TIME) as hour, count(*) as n from qlog group by 1, 2)
select WAREHOUSE_NAME, round(avg(n),6) as avg_hourly_queries, max(n) as peak_hourly_queries, round(var_samp(n),6) as concurrency_variance, min_by(hour, (-n, hour)) as peak_hour from h group by 1""")
def concurrency_patterns(spark, d):
    return U.concurrency_patterns(query_log(spark, d))


@query("ua22_resource_contention", """
with h as (select WAREHOUSE_NAME, hour(START_TIME) as hour, stddev_samp(EXECUTION_TIME_MS) as s from qlog group by 1, 2),
l as (select WAREHOUSE_NAME, quantile_cont(s,0.8) as l from h group by 1)
select WAREHOUSE_NAME, count(*) filter (s > l) as high_contention_hours, round(avg(s),6) as avg_execution_variance, min_by(hour, (-s, hour)) as peak_variance_hour,
 round(count(*) filter (s > l)/count(*),6) as contention_indicator from h join l using (WAREHOUSE_NAME) group by 1""")
def resource_contention(spark, d):
    return U.resource_contention(query_log(spark, d))


@query("ua23_forecasting_features", """
with dd as (select date_trunc('day', START_TIME)::timestamp as date, count(*) as q, sum(CREDITS_USED) as c, count(distinct USER_NAME) as u from qlog group by 1), n as (select *, row_number() over (order by date) as i from dd)
select date, q as daily_queries, round(c,6) as daily_credits, u as daily_users, round((q-lag(q) over (order by i))/lag(q) over (order by i),6) as query_trend,
 round((c-lag(c) over (order by i))/lag(c) over (order by i),6) as credit_trend, round((u-lag(u) over (order by i))/lag(u) over (order by i),6) as user_trend,
 round(case when i >= 7 then avg(q) over (order by i rows 6 preceding) end,6) as query_ma_7, round(case when i >= 7 then avg(c) over (order by i rows 6 preceding) end,6) as credit_ma_7,
 isodow(date)-1 as day_of_week, case when isodow(date) >= 6 then 1 else 0 end as is_weekend from n""")
def forecasting_features(spark, d):
    return U.forecasting_features(query_log(spark, d))


@query("ua24_resource_patterns", """
with h as (select WAREHOUSE_NAME, hour(START_TIME) as hour, count(*) as n from facts group by 1, 2)
select WAREHOUSE_NAME, round(avg(n),6) as avg_hourly_queries, max(n) as peak_hourly_queries, round(var_samp(n),6) as concurrency_variance, min_by(hour, (-n, hour)) as peak_hour from h group by 1""")
def resource_patterns(spark, d):
    return U.patterns_view(cost_facts(spark, d), "resource")


@query("ua01_usage_tables", f"""
{SESSIONS}, p as ({PATTERNS}), {WORKLOAD[5:]}
select 'basic_usage' as table_name, 1 as rows union all select 'query_patterns', count(*) from p
union all select 'session_analysis', count(*) from (select 1 from s group by USER_NAME, session_id having count(*) >= 3)
union all select 'workload_patterns', count(*) from l union all select 'user_behavior', count(distinct USER_NAME) from qlog
union all select 'warehouse_utilization', count(distinct WAREHOUSE_NAME) from qlog union all select 'concurrency_analysis', count(distinct WAREHOUSE_NAME) from qlog
union all select 'resource_contention', count(distinct WAREHOUSE_NAME) from qlog union all select 'usage_forecasting', count(distinct date_trunc('day', START_TIME)) from qlog""")
def usage_tables(spark, d):
    return U.table_sizes(U.usage_tables(query_log(spark, d), ["CREDITS_USED"], advanced=True))
