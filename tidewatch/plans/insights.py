"""Queries over insight reports."""

from pyspark.sql import functions as F

from tidewatch.operators import insights as N
from tidewatch.plans.registry import query
from tidewatch.sources.tables import cost_facts, metering_history, query_log, table

A, B = "2024-01-05 00:00:00", "2024-01-25 00:00:00"
RANGE = f"START_TIME >= timestamp '{A}' and START_TIME <= timestamp '{B}'"
COSTS = "costs as (select *, CREDITS_USED*3 as COST_USD, CREDITS_USED_COMPUTE*3 as COMPUTE_COST, CREDITS_USED_CLOUD_SERVICES*3 as STORAGE_COST from metering)"


def _costs(spark, d):
    return metering_history(spark, d).withColumns({
        "COST_USD": F.col("CREDITS_USED") * 3, "COMPUTE_COST": F.col("CREDITS_USED_COMPUTE") * 3,
        "STORAGE_COST": F.col("CREDITS_USED_CLOUD_SERVICES") * 3})


@query("sq01_cost_overview", f"""with {COSTS} select date_trunc('week', START_TIME)::timestamp as period, round(sum(COST_USD),6) as total_cost, round(sum(STORAGE_COST),6) as storage_cost,
 round(sum(COMPUTE_COST),6) as compute_cost from costs where {RANGE} and WAREHOUSE_NAME in ('WH1','WH2') group by 1""")
def cost_overview(spark, d):
    return N.cost_overview(_costs(spark, d), "week", A, B, where={"WAREHOUSE_NAME": ["WH1", "WH2"]})


@query("sq02_cost_breakdown", f"""with {COSTS} select SERVICE_TYPE || '' as category, round(sum(COST_USD),6) as total_cost, count(*) as record_count, round(avg(COST_USD),6) as avg_cost from costs where {RANGE} group by 1 order by 2 desc limit 10""")
def cost_breakdown(spark, d):
    return N.cost_breakdown(_costs(spark, d), "SERVICE_TYPE", A, B, limit=10)


@query("sq03_usage_overview", f"""select date_trunc('day', START_TIME)::timestamp as period, count(*) as query_count, round(sum(EXECUTION_TIME_MS),6) as total_execution_time, round(avg(EXECUTION_TIME_MS),6) as avg_execution_time,
 cast(sum(BYTES_SCANNED) as bigint) as total_bytes_scanned from qlog where {RANGE} group by 1""")
def usage_overview(spark, d):
    return N.usage_overview(query_log(spark, d), "day", A, B)


@query("sq04_user_activity", f"""with u as (select USER_NAME, date_trunc('day', START_TIME) as DATE, count(*) as q, sum(EXECUTION_TIME_MS) as t, count(distinct hour(START_TIME)) as s from qlog group by 1, 2)
select USER_NAME, cast(sum(q) as bigint) as total_queries, round(avg(t),6) as avg_execution_time, cast(sum(s) as bigint) as total_sessions from u where DATE >= timestamp '{A}' and DATE <= timestamp '{B}' group by 1 order by 2 desc, 1 limit 50""")
def user_activity(spark, d):
    log = query_log(spark, d).withColumns({"DATE": F.date_trunc("day", "START_TIME").cast("timestamp_ntz"), "_h": F.hour("START_TIME")})
    daily = log.groupBy("USER_NAME", "DATE").agg(F.count("*").alias("QUERY_COUNT"), F.sum("EXECUTION_TIME_MS").alias("TOTAL_EXECUTION_TIME"),
                                                 F.count_distinct("_h").alias("SESSION_COUNT"))
    return N.user_activity(daily, A, B, limit=50)


@query("sq05_warehouse_report", f"""select WAREHOUSE_NAME, ROLE_NAME as warehouse_size, round(avg(ROWS_PRODUCED),6) as avg_utilization, round(avg(EXECUTION_TIME_MS/1000),6) as avg_queue_time from qlog where {RANGE} group by 1, 2""")
def warehouse_report(spark, d):
    log = query_log(spark, d).withColumns({"SIZE": F.col("ROLE_NAME"), "UTILIZATION_PERCENT": F.col("ROWS_PRODUCED"),
                                           "QUEUE_TIME_SECONDS": F.col("EXECUTION_TIME_MS") / 1000})
    return N.warehouse_report(log, A, B)


@query("sq06_slowest_queries", f"""select QUERY_ID, USER_NAME, WAREHOUSE_NAME, round(EXECUTION_TIME_MS,6) as EXECUTION_TIME_MS, BYTES_SCANNED, left(QUERY_TEXT, 100) as query_preview from qlog where {RANGE}
 order by qlog.EXECUTION_TIME_MS desc, QUERY_ID limit 100""")
def slowest_queries(spark, d):
    return N.slowest_queries(query_log(spark, d), A, B)


DAYS = "dd as (select date_trunc('day', START_TIME)::timestamp as date, sum(CREDITS_USED*2) as cost, row_number() over (order by date_trunc('day', START_TIME) desc) as n from facts group by 1, date_trunc('day', START_TIME))"


def _facts(spark, d):
    return cost_facts(spark, d).withColumn("COST_USD", F.col("CREDITS_USED") * 2)


def _daily(spark, d):
    return N.daily_totals(_facts(spark, d), "COST_USD")


@query("sq08_weekly_change", f"""with {DAYS}, r as (select sum(cost) filter (n <= 7) as a, sum(cost) filter (n between 8 and 14) as b from dd), c as (select *, (a-b)/b*100 as p from r)
select round(a,6) as recent_week_cost, round(b,6) as previous_week_cost, round(p,6) as change_percent, case when p > 0 then 'increased' else 'decreased' end as direction, case when abs(p) > 50 then 'high' else 'medium' end as severity from c where abs(p) > 2""")
def weekly_change(spark, d):
    return N.weekly_change(_daily(spark, d), limit=2.0)


@query("sq09_monthly_change", f"""with {DAYS}, w as (select date_trunc('week', date) as week, sum(cost) as cost, row_number() over (order by date_trunc('week', date) desc) as n from dd group by date_trunc('week', date)),
r as (select avg(cost) filter (n <= 2) as a, avg(cost) filter (n between 3 and 4) as b from w), c as (select *, (a-b)/b*100 as p from r)
select round(a,6) as recent_weekly_avg, round(b,6) as previous_weekly_avg, round(p,6) as trend_percent, case when p > 0 then 'upward' else 'downward' end as direction from c where abs(p) > 1""")
def monthly_change(spark, d):
    return N.monthly_change(_daily(spark, d), limit=1.0)


@query("sq10_warehouse_balance", """with t as (select USER_NAME as w, sum(CREDITS_USED*2) as c from facts group by 1), r as (select sum(c) as t, max(c) as hi, min(c) as lo, min_by(w, (-c, w)) as top, min_by(w, (c, w)) as bottom from t)
select 'cost_concentration' as finding, round(hi/t*100,6) as measure, top, bottom from r where hi/t*100 > 0.1 union all select 'cost_imbalance', round(hi/lo,6), top, bottom from r where hi/lo > 10""")
def warehouse_balance(spark, d):
    return N.warehouse_balance(_facts(spark, d), share_limit=0.1, key="USER_NAME")


@query("sq11_cost_spikes", f"""with {DAYS}, m as (select date, cost, case when count(*) over w = 7 then avg(cost) over w end as a from dd window w as (order by date rows 6 preceding))
select date, round(cost,6) as cost, round(a,6) as average_cost, round((cost-a)/a*100,6) as spike_percent from m where a > 0 and (cost-a)/a*100 > 50""")
def cost_spikes(spark, d):
    return N.cost_spikes(_daily(spark, d))


@query("sq12_compute_storage_mix", f"""with {COSTS}, r as (select sum(COMPUTE_COST) as c, sum(STORAGE_COST) as s from costs)
select round(c,6) as compute_cost, round(s,6) as storage_cost, round(c+s,6) as total_cost, round(c/(c+s)*100,6) as compute_percent, round(s/(c+s)*100,6) as storage_percent,
 case when c/(c+s) > 0.8 then 'high_compute_ratio' when s/(c+s) > 0.7 then 'high_storage_ratio' else 'balanced' end as finding from r""")
def compute_storage_mix(spark, d):
    return N.compute_storage_mix(_costs(spark, d))


@query("sq13_warehouse_efficiency", """with t as (select USER_NAME as w, sum(CREDITS_USED) as c, sum(CREDITS_USED*(1+ROWS_PRODUCED/10.0)) as u from qlog group by 1), r as (select *, sum(c) over () as a from t)
select 'high_cost_per_credit' as finding, w as warehouse, round(u/c,6) as measure from r where u/c > 3 union all select 'idle_warehouse', w, round(c/a*100,6) from r where c/a*100 < 5 and c < 10""")
def warehouse_efficiency(spark, d):
    log = query_log(spark, d).withColumn("COST_USD", F.col("CREDITS_USED") * (1 + F.col("ROWS_PRODUCED") / 10.0))
    return N.warehouse_efficiency(log, key="USER_NAME")


@query("sq14_credit_peak", """with dd as (select date_trunc('day', START_TIME)::timestamp as date, sum(CREDITS_USED) as cost from facts group by 1)
select round(max(cost),6) as max_credits, round(avg(cost),6) as avg_credits, min_by(date, (-cost, date)) as spike_date, round(max(cost)/avg(cost),6) as spike_ratio from dd having max(cost) > 1.5*avg(cost)""")
def credit_peak(spark, d):
    return N.credit_peak(N.daily_totals(cost_facts(spark, d), "CREDITS_USED"), factor=1.5)


@query("sq15_half_trend", f"""with {DAYS}, k as (select floor(count(*)/2) as h, count(*) as c from dd), r as (select avg(cost) filter (c - n + 1 <= h) as a, avg(cost) filter (c - n + 1 > h) as b from dd, k)
select round(a,6) as first_period_avg, round(b,6) as second_period_avg, case when b > a*1.0001 then 'increasing' else 'decreasing' end as trend_direction, round(abs(b-a)/a*100,6) as change_percent,
 case when abs(b-a)/a*100 > 20 then 'medium' else 'low' end as severity from r where b > a*1.0001 or b < a*0.9999""")
def half_trend(spark, d):
    return N.half_trend(_daily(spark, d), "cost", 0.0001, 20.0)


@query("sq16_series_anomalies", f"""with {DAYS}, s as (select avg(cost) as m, stddev_samp(cost) as s from dd)
select date, round(cost,6) as cost, round(m,6) as mean_value, round(abs(cost-m)/s,6) as z_score from dd, s where abs(cost-m)/s > 2""")
def series_anomalies(spark, d):
    return N.series_anomalies(_daily(spark, d), "cost")


@query("sq17_usage_findings", """with q as (select count(*) as c from facts group by date_trunc('day', START_TIME)), r as (select max(c)::double as m, avg(c) as a from q), t as (select avg(EXECUTION_TIME_MS) as t from facts)
select round(m,6) as measure, round(a,6) as mean, 'peak_usage' as finding from r where m > 2*a union all select round(t,6), round(t,6), 'slow_queries' from t where t > 30000""")
def usage_findings(spark, d):
    facts = cost_facts(spark, d)
    daily = facts.groupBy(F.date_trunc("day", "START_TIME").alias("date")).agg(F.count("*").alias("query_count"))
    return N.usage_findings(daily, facts)


FINDINGS = f"""{DAYS.replace('dd as', 'dd0 as').replace('CREDITS_USED*2', 'CREDITS_USED*3').replace('facts', 'metering')}, dd as (select date, cost, n, count(*) over () as c from dd0), l as (select max(date) as l from dd),
q as (select date_trunc('day', START_TIME)::timestamp as date, count(*) as v, row_number() over (order by date_trunc('day', START_TIME)) as i from qlog group by 1, date_trunc('day', START_TIME)), {COSTS},
f as (
 select l as date, 'cost' as category, 'weekly_cost_trend' as title, case when abs(p) > 50 then 'high' else 'medium' end as severity from l, (select (a-b)/b*100 as p from (select sum(cost) filter (n <= 7) as a, sum(cost) filter (n between 8 and 14) as b from dd)) where abs(p) > 20
 union all select l, 'cost', 'monthly_cost_trend', 'medium' from l, (select (a-b)/b*100 as p, k from (select avg(cost) filter (n <= 2) as a, avg(cost) filter (n between 3 and 4) as b, count(*) as k from (select sum(cost) as cost, row_number() over (order by date_trunc('week', date) desc) as n from dd group by date_trunc('week', date)))) where abs(p) > 15 and k >= 4
 union all select l, 'cost', 'cost_concentration', 'medium' from l, (select max(c)/sum(c)*100 as s from (select sum(COST_USD) as c from costs group by WAREHOUSE_NAME)) where s > 60
 union all select l, 'cost', 'cost_imbalance', 'medium' from l, (select max(c)/min(c) as s from (select sum(COST_USD) as c from costs group by WAREHOUSE_NAME)) where s > 10
 union all select date, 'cost', 'cost_spike', 'high' from (select date, cost, case when count(*) over w = 7 then avg(cost) over w end as a from dd window w as (order by date rows 6 preceding)) where a > 0 and (cost-a)/a*100 > 50
 union all select l, 'cost', case when c/(c+s) > 0.8 then 'high_compute_ratio' else 'high_storage_ratio' end, 'medium' from l, (select sum(COMPUTE_COST) as c, sum(STORAGE_COST) as s from costs) where c/(c+s) > 0.8 or s/(c+s) > 0.7
 union all select date, 'anomaly', 'cost_anomaly', 'medium' from dd, (select avg(cost) as m, stddev_samp(cost) as sd from dd) where abs(cost-m)/sd > 2
 union all select date, 'anomaly', 'usage_anomaly', 'medium' from q, (select avg(v) as m, stddev_samp(v) as sd from q) where abs(v-m)/sd > 2
 union all select l, 'trend', 'cost_trend', case when abs(b-a)/a*100 > 20 then 'medium' else 'low' end from l, (select avg(cost) filter (c-n+1 <= floor(c/2)) as a, avg(cost) filter (c-n+1 > floor(c/2)) as b from dd) where b > a*1.1 or b < a*0.9
 union all select l, 'trend', 'usage_trend', case when abs(b-a)/a*100 > 30 then 'medium' else 'low' end from l, (select avg(v) filter (i <= floor(k/2)) as a, avg(v) filter (i > floor(k/2)) as b from q, (select count(*) as k from q)) where b > a*1.2 or b < a*0.8
 union all select l, 'usage', 'peak_usage', 'medium' from l, (select max(v) as m, avg(v) as a from q) where m > 2*a
 union all select l, 'usage', 'slow_queries', 'medium' from l, (select avg(EXECUTION_TIME_MS) as t from qlog) where t > 30000)"""


def _findings(spark, d):
    return N.all_findings(_costs(spark, d), query_log(spark, d))


@query("sq18_findings", f"with {FINDINGS} select date, category, title, severity from f")
def findings(spark, d):
    return _findings(spark, d)


@query("sq18_findings_summary", f"""with {FINDINGS}, s as (select count(*) as total_insights, max(case severity when 'low' then 0 when 'medium' then 1 when 'high' then 2 else 3 end) as w from f)
select total_insights, ['low','medium','high','critical'][w+1] as overall_severity, (select count(*) from f where severity='low') as low_count, (select count(*) from f where severity='medium') as medium_count,
 (select count(*) from f where severity='high') as high_count, (select count(*) from f where severity='critical') as critical_count, (select category from f group by 1 order by count(*) desc, 1 limit 1) as top_category,
 ['system healthy','monitoring recommended','attention required','critical issues detected'][w+1] as health_status from s""")
def findings_summary(spark, d):
    return N.findings_summary(_findings(spark, d))


@query("sq18_findings_by_day", f"""with {FINDINGS} select date, count(*) as total_insights, count(*) filter (severity='low') as low, count(*) filter (severity='medium') as medium, count(*) filter (severity='high') as high,
 count(*) filter (severity='critical') as critical from f group by 1""")
def findings_by_day(spark, d):
    return N.findings_by_day(_findings(spark, d))


@query("sq19_key_metrics", """with m as (select date_trunc('month', START_TIME)::timestamp as period, DATABASE_NAME as category, sum(CREDITS_USED*2) as v from facts group by 1, 2), t as (select period, sum(v) as v from m group by 1)
select count(*) as row_count, round(sum(v),6) as total, round(avg(v),6) as mean, round(max(v),6) as largest, round(min(v),6) as smallest, round((max_by(v, period)-min_by(v, period))/min_by(v, period)*100,6) as trend_percent,
 12::bigint as categories, (select strftime(period, '%Y-%m') from t order by v desc, 1 limit 1) as top_category from t""".replace("12::bigint as categories", "count(distinct period) as categories"))
def key_metrics(spark, d):
    report = N.cost_overview(_facts(spark, d).withColumns({"STORAGE_COST": F.lit(0.0), "COMPUTE_COST": F.col("COST_USD")}),
                             "month", "1990-01-01 00:00:00", "2030-01-01 00:00:00")
    report = report.withColumn("name", F.date_format("period", "yyyy-MM"))
    return N.key_metrics(report, "total_cost", "name", "period")
