"""Queries over row-level features."""

from pyspark.sql import functions as F

from tidewatch.operators import features_cost as FC
from tidewatch.operators import features_pattern as FP
from tidewatch.operators import features_rolling as FR
from tidewatch.operators import features_time as FT
from tidewatch.operators import features_usage as FU
from tidewatch.plans.dimensional import PCT
from tidewatch.plans.registry import query
from tidewatch.sources.tables import cost_facts, query_log, wide_log

BIG = "1e300"


def cut(x, edges, labels):
    """SQL of right-closed classes that include the lowest edge."""
    parts = [f"when {x} {'>=' if i == 0 else '>'} {a} and {x} <= {b} then '{t}'" for i, (a, b, t) in enumerate(zip(edges, edges[1:], labels))]
    return "case " + " ".join(parts) + " end"


def fl(cond):
    return f"case when {cond} then 1 else 0 end"


def r6(expr, name):
    return f"round({expr}, 6)+0.0 as {name}"


def _wide(spark, d):
    return wide_log(spark, d)


def _cost(spark, d):
    k = F.col("ROWS_PRODUCED")
    return wide_log(spark, d).withColumns({
        "CREDITS_USED_COMPUTE": F.col("CREDITS_USED") * 0.9, "CREDITS_USED_CLOUD_SERVICES": F.col("CREDITS_USED") * (k % 3) / 10,
        "TOTAL_ELAPSED_TIME": F.col("EXECUTION_TIME_MS") + F.col("QUEUE_TIME_MS"),
        "EXECUTION_TIME_MS": F.col("EXECUTION_TIME_MS") * (1 + k % 4)})


COST = """clog as (select * replace (EXECUTION_TIME_MS*(1 + ROWS_PRODUCED % 4) as EXECUTION_TIME_MS), CREDITS_USED*0.9 as CREDITS_USED_COMPUTE, CREDITS_USED*(ROWS_PRODUCED % 3)/10 as CREDITS_USED_CLOUD_SERVICES,
 EXECUTION_TIME_MS + QUEUE_TIME_MS as TOTAL_ELAPSED_TIME from wlog)"""


def added(fn, source=_wide, extra=("QUERY_ID",)):
    """Only the columns a feature step adds, with the row id."""
    def run(spark, d):
        rows = source(spark, d)
        out = fn(rows)
        return out.select(*extra, *[c for c in out.columns if c not in rows.columns and c not in extra])
    return run


T = "START_TIME"
query("tf01_time_components", f"""select QUERY_ID, hour({T}) as hour_of_day, isodow({T})-1 as day_of_week, day({T}) as day_of_month, dayofyear({T}) as day_of_year, weekofyear({T}) as week_of_year, month({T}) as month_of_year,
 quarter({T}) as quarter, year({T}) as year, {cut(f'hour({T})', [0, 6, 12, 18, 24], ['night', 'morning', 'afternoon', 'evening'])} as time_of_day from qlog""")(added(FT.time_components, query_log))


def _cyc(name, expr, size):
    return f"{r6(f'sin(2*pi()*({expr})/{size})', name + '_sin')}, {r6(f'cos(2*pi()*({expr})/{size})', name + '_cos')}"


query("tf02_cyclical", f"""select QUERY_ID, {_cyc('hour', f'hour({T})', 24)}, {_cyc('dow', f'isodow({T})-1', 7)}, {_cyc('dom', f'day({T})', 30.5)}, {_cyc('month', f'month({T})', 12)}, {_cyc('quarter', f'quarter({T})', 4)} from qlog""")(
    added(FT.cyclical_features, query_log))
DAYTIME, WEEK = f"(hour({T}) >= 9 and hour({T}) < 17)", f"isodow({T}) < 6"
query("tf03_business_indicators", f"""select QUERY_ID, {fl(WEEK)} as is_business_day, {fl('not ' + WEEK)} as is_weekend, {fl(DAYTIME)} as is_business_hours, {fl(WEEK + ' and ' + DAYTIME)} as is_business_time,
 {fl(WEEK + ' and not ' + DAYTIME)} as is_after_hours, {fl('not (' + WEEK + ' and ' + DAYTIME + ')')} as is_non_business_time from qlog""")(added(FT.business_indicators, query_log))


def _orders(spark, d):
    return cost_facts(spark, d).select("QUERY_ID", "START_TIME", "END_TIME")


query("tf04_seasonality", f"""select QUERY_ID, case when month({T}) in (12,1,2) then 'winter' when month({T}) in (3,4,5) then 'spring' when month({T}) in (6,7,8) then 'summer' else 'fall' end as season, monthname({T}) as month_name, dayname({T}) as day_name,
 {fl(f'day({T})=1')} as is_month_start, {fl(f'day({T}+interval 1 day)=1')} as is_month_end, {fl(f'day({T})=1 and month({T}) in (1,4,7,10)')} as is_quarter_start, {fl(f'day({T}+interval 1 day)=1 and month({T}) in (3,6,9,12)')} as is_quarter_end,
 {fl(f'dayofyear({T})=1')} as is_year_start, {fl(f'month({T})=12 and day({T})=31')} as is_year_end, day(last_day({T})) as days_in_month, {fl(f'day(last_day(make_date(year({T})::int,2,1)))=29')} as is_leap_year from facts""")(
    added(FT.seasonality_features, _orders))
query("tf05_relative_time", f"""with b as (select min({T}) as a, max({T}) as z from facts) select QUERY_ID, {r6(f'(epoch_us({T})-epoch_us(a))/3.6e9', 'hours_since_dataset_start')}, {r6(f'(epoch_us(z)-epoch_us({T}))/3.6e9', 'hours_until_dataset_end')},
 day({T})-1 as days_since_month_start, date_diff('day', {T}::date, last_day({T})) as days_until_month_end, date_diff('day', date_trunc('quarter',{T})::date, {T}::date) as days_since_quarter_start,
 date_diff('day', {T}::date, (date_trunc('quarter',{T}) + interval 3 month - interval 1 day)::date) as days_until_quarter_end, dayofyear({T})-1 as days_since_year_start from facts, b""")(added(FT.relative_time, _orders))
query("tf06_time_indicators", f"""select QUERY_ID, {fl(f'hour({T}) in (9,10,11,14,15,16)')} as is_peak_hours, {fl(f'hour({T}) in (0,1,2,3,4,5,22,23)')} as is_off_peak_hours, {fl(f'month({T}) in (3,6,9,12)')} as is_quarter_end_month,
 {fl(f'month({T}) in (11,12,1)')} as is_holiday_month, {fl(f'hour({T}) between 7 and 9')} as is_morning_rush, {fl(f'hour({T}) between 17 and 19')} as is_evening_rush, {fl(f'hour({T}) between 12 and 13')} as is_lunch_hour from qlog""")(
    added(FT.time_indicators, query_log))
S = "((epoch_us(END_TIME)-epoch_us(START_TIME))/1e6)"
query("tf07_durations", f"""select QUERY_ID, {r6(S, 'duration_seconds_query')}, {r6(S + '/60', 'duration_minutes_query')}, {r6(S + '/3600', 'duration_hours_query')}, {r6(f'ln(1+{S})', 'log_duration_seconds_query')},
 {cut(S + '/60', [0, 1, 5, 15, 60, 240, BIG], ['very_short', 'short', 'medium', 'long', 'very_long', 'extremely_long'])} as duration_category_query from qlog""")(added(lambda df: FT.duration_features(df), query_log))

E, Q, CT, B, R = "EXECUTION_TIME_MS", "QUEUE_TIME_MS", "COMPILATION_TIME_MS", "BYTES_SCANNED", "ROWS_PRODUCED"
G = 1024 ** 3


def div(a, b):
    return f"(case when {b} > 0 then ({a})/({b}) else 0 end)"


query("uf01_basic_usage", f"""select QUERY_ID, {r6(E + '/1000', 'execution_time_seconds')}, {r6(E + '/60000', 'execution_time_minutes')}, {r6(f'ln(1+{E})', 'log_execution_time')},
 {cut(E, [0, 1000, 5000, 30000, 300000, BIG], ['very_fast', 'fast', 'medium', 'slow', 'very_slow'])} as execution_time_category, {r6(Q + '/1000', 'queue_time_seconds')}, {r6(f'ln(1+{Q})', 'log_queue_time')},
 {cut(Q, [0, 100, 1000, 10000, BIG], ['no_queue', 'short_queue', 'medium_queue', 'long_queue'])} as queue_time_category, {r6(f'ln(1+{CT})', 'log_compilation_time')}, {r6(f'{B}/{G}', 'gb_scanned')}, {r6(f'ln(1+{B})', 'log_bytes_scanned')},
 {cut(B, [0, 1024**2, G, 10*G, BIG], ['small', 'medium', 'large', 'very_large'])} as data_volume_category, {r6(f'ln(1+{R})', 'log_rows_produced')}, {cut(R, [0, 100, 10000, 1000000, BIG], ['small', 'medium', 'large', 'very_large'])} as row_count_category from wlog""")(
    added(FU.basic_usage))
EFF = f"""{r6(div(Q, E), 'queue_to_execution_ratio')}, {r6(f'{E}+{Q}', 'total_time_ms')}, {r6(div(E, f'({E}+{Q})'), 'execution_efficiency')}, {r6(div(CT, E), 'compilation_overhead_ratio')}, {r6(div(B, R), 'bytes_per_row')},
 {r6(f'ln(1+{div(B, R)})', 'log_bytes_per_row')}, {r6(div(B, E), 'data_throughput')}, {r6(f'ln(1+{div(B, E)})', 'log_data_throughput')}, {r6(div(R, E), 'row_processing_rate')}"""
query("uf02_efficiency", f"select QUERY_ID, {EFF} from wlog")(added(FU.efficiency))


def q(col, p, t):
    return f"(select quantile_cont({col},{p}) from {t})"


def scaled(col, t):
    return f"greatest(0, least(1, ({col}-{q(col, 0.1, t)})/({q(col, 0.9, t)}-{q(col, 0.1, t)})))"


SIZE = "(list_position(['X-SMALL','SMALL','MEDIUM','LARGE','X-LARGE'], WAREHOUSE_SIZE))"
ST = "upper(STATEMENT_TYPE)"
query("uf03_complexity", f"""select QUERY_ID, {', '.join(f"{fl(f"contains({ST},'{s}')")} as is_{s.lower()}_query" for s in FU.STATEMENTS)}, {fl(f"regexp_matches({ST},'CREATE|DROP|ALTER')")} as is_ddl_query,
 {fl(f"regexp_matches({ST},'INSERT|UPDATE|DELETE')")} as is_dml_query, {r6('ln(1+PARTITIONS_SCANNED)', 'log_partitions_scanned')}, {cut('PARTITIONS_SCANNED', [0, 1, 10, 100, BIG], ['single', 'few', 'many', 'massive'])} as partition_complexity,
 {SIZE} as warehouse_size_numeric, {r6(f"greatest(0, least(1, {scaled(E, 'wlog')}*0.3 + {scaled(B, 'wlog')}*0.3 + {scaled('PARTITIONS_SCANNED', 'wlog')}*0.2 + ({SIZE}-1)/7.0*0.2))", 'query_complexity_score')} from wlog""")(added(FU.complexity))
query("uf04_utilisation", f"""with x as (select *, {div(B, E)} as tp, {div(E, f'({E}+{Q})')} as ee, ROWS_INSERTED+ROWS_UPDATED+ROWS_DELETED as m from wlog)
select QUERY_ID, {EFF}, {r6(div('BYTES_WRITTEN', B), 'write_amplification')}, {r6(div(f'{B}-BYTES_WRITTEN', B), 'data_transformation_ratio')}, m as total_modified_rows, {r6(div('m', R), 'modification_to_production_ratio')},
 {r6(f"(ee + {scaled('tp', 'x')})/2", 'resource_utilization_score')} from x""")(added(FU.utilisation))
query("uf05_user_behavior", f"""with u as (select USER_NAME, count(*) as n, dense_rank() over (order by count(*) desc) as rk from wlog group by 1), s as (select SESSION_ID, count(*) as n from wlog group by 1), ro as (select ROLE_NAME, count(*) as n from wlog group by 1)
select QUERY_ID, u.n as user_query_frequency, u.rk as user_activity_rank, {fl('u.n >= (select quantile_cont(n,0.8) from u)')} as is_high_activity_user, {cut('u.n', [0, 1, 10, 50, BIG], ['rare', 'occasional', 'regular', 'power'])} as user_activity_category,
 ro.n as role_usage_frequency, {', '.join(f"0 as is_{r.lower()}_role" for r in FU.ROLES)}, s.n as queries_per_session, {cut('s.n', [0, 1, 5, 20, BIG], ['single', 'light', 'moderate', 'heavy'])} as session_activity_category
 from wlog join u using (USER_NAME) join s using (SESSION_ID) join ro using (ROLE_NAME)""")(added(FU.user_behavior))
query("uf06_workload", f"""with p as (select DATABASE_NAME as top from wlog group by 1 order by count(*) desc, 1 limit 1)
select QUERY_ID, count(*) over (partition by DATABASE_NAME) as database_usage_frequency, count(*) over (partition by WAREHOUSE_NAME) as warehouse_usage_frequency, {fl('DATABASE_NAME = top')} as is_primary_database,
 (select count(distinct WAREHOUSE_NAME) from wlog) as warehouse_diversity, count(*) over (partition by date_trunc('hour', START_TIME)) as hourly_query_density, count(*) over (partition by date_trunc('day', START_TIME)) as daily_query_density from wlog, p""")(
    added(FU.workload))
M = {"execution_time": E, "bytes_scanned": B, "rows_produced": R}


def _pop(c, t):
    return f"(select avg(pow(({c}-m)/s,3)) from {t}, (select avg({c}) as m, stddev_pop({c}) as s from {t}))", f"(select avg(pow(({c}-m)/s,4))-3 from {t}, (select avg({c}) as m, stddev_pop({c}) as s from {t}))"


query("uf07_statistical", "select QUERY_ID, " + ", ".join(
    ", ".join(f"{fl(f'{c} > {q(c, p, "wlog")}')} as {n}_is_above_p{int(p*100)}" for p in (0.25, 0.5, 0.75, 0.9, 0.95))
    + f", {r6(f'({c}-(select avg({c}) from wlog))/(select stddev_samp({c}) from wlog)', n + '_z_score')}, {fl(f'abs(({c}-(select avg({c}) from wlog))/(select stddev_samp({c}) from wlog)) > 3')} as {n}_is_outlier, {r6(_pop(c, 'wlog')[0], n + '_skewness')}, {r6(_pop(c, 'wlog')[1], n + '_kurtosis')}"
    for n, c in M.items()) + " from wlog")(added(FU.statistical))
query("uf08_comparative", f"""with u as (select USER_NAME, avg({E}) as e, avg({B}) as b from wlog group by 1)
select QUERY_ID, {r6(f'{E}/e', 'execution_time_vs_user_avg_ratio')}, {fl(f'{E}/e > 1')} as execution_time_above_user_avg, {r6(f'{B}/b', 'bytes_scanned_vs_user_avg_ratio')}, {fl(f'{B}/b > 1')} as bytes_scanned_above_user_avg,
 {', '.join(f"{r6(f'{c}/{q(c, 0.5, "wlog")}', n + '_vs_global_median_ratio')}, {r6(f'{c}/(select avg({c}) from wlog)', n + '_vs_global_mean_ratio')}, {fl(f'{c} > {q(c, 0.5, "wlog")}')} as {n}_above_global_median, {fl(f'{c} > (select avg({c}) from wlog)')} as {n}_above_global_mean" for n, c in M.items())}
 from wlog join u using (USER_NAME)""")(added(FU.comparative))

C = "CREDITS_USED"
CC, CS, TH = "CREDITS_USED_COMPUTE", "CREDITS_USED_CLOUD_SERVICES", "(TOTAL_ELAPSED_TIME/3.6e6)"
query("cf01_basic_cost", f"""with {COST} select QUERY_ID, {r6(f'{C}*2', 'cost_usd')}, {r6(f'ln(1+{C})', 'log_credits_used')}, {r6(f'ln(1+{C}*2)', 'log_cost_usd')}, {cut(C, [0, 1, 10, 100, BIG], ['low', 'medium', 'high', 'very_high'])} as cost_category,
 {fl(f'{C} = 0')} as is_zero_cost, {fl(f'{C} > {q(C, 0.9, "clog")}')} as is_high_cost, {r6(f'{CC}*2', 'cost_usd_compute')}, {r6(f'{CS}*2', 'cost_usd_cloud_services')}, {r6(div(CC, f'({CC}+{CS})'), 'compute_credits_ratio')},
 {r6(div(CS, f'({CC}+{CS})'), 'cloud_services_credits_ratio')}, {r6(TH, 'total_elapsed_time_hours')}, {r6(div(C, TH), 'credits_per_hour')}, {r6(div(C, TH) + '*2', 'cost_per_hour_usd')} from clog""")(added(FC.basic_cost, _cost))
GB, P = f"({B}/{G})", "PARTITIONS_SCANNED"
CEFF = f"""ce as (select *, {div(GB, C)} as gpc, {div(E, C)} as epc from clog), cs as (select *, (coalesce({scaled('gpc', 'ce')},0) + coalesce(1-{scaled('epc', 'ce')},1))/2 as score from ce)"""
CEFF_COLS = f"""{r6(div(C, GB), 'credits_per_gb_scanned')}, {r6('gpc', 'gb_per_credit')}, {r6(div(C, f'({R}/1e6)'), 'credits_per_million_rows')}, {r6(div(R, C), 'rows_per_credit')}, {r6(div(C, f'({E}/3.6e6)'), 'credits_per_execution_hour')},
 {r6('epc', 'execution_time_per_credit')}, {r6(div(C, P), 'credits_per_partition')}, {r6(div(P, C), 'partitions_per_credit')}, {r6('score', 'cost_efficiency_score')}, {cut('score', [0, 0.2, 0.5, 0.8, 1], ['low', 'medium', 'high', 'very_high'])} as efficiency_category"""
query("cf02_cost_efficiency", f"with {COST}, {CEFF} select QUERY_ID, {CEFF_COLS} from cs")(added(FC.cost_efficiency, _cost))
query("cf03_cost_distribution", f"""with {COST} select QUERY_ID, {', '.join(f"{fl(f'{C} > {q(C, p, "clog")}')} as cost_above_p{int(p*100)}, {r6(f'{C}/{q(C, p, "clog")}', f'cost_ratio_to_p{int(p*100)}')}" for p in (0.25, 0.5, 0.75, 0.9, 0.95))},
 {r6(f'({C}-(select avg({C}) from clog))/(select stddev_samp({C}) from clog)', 'cost_z_score')}, {fl(f'abs(({C}-(select avg({C}) from clog))/(select stddev_samp({C}) from clog)) > 3')} as cost_is_outlier, {r6(_pop(C, 'clog')[0], 'cost_skewness')}, {r6(_pop(C, 'clog')[1], 'cost_kurtosis')},
 {r6(PCT(C), 'cost_percentile_rank')}, round((select 2.0*sum(i*x)/(count(*)*sum(x))-(count(*)+1.0)/count(*) from (select {C} as x, row_number() over (order by {C}) as i from clog)),6)+0.0 as cost_concentration from clog""")(added(FC.cost_distribution, _cost))
EXP = "([1,2,4,8,16][" + SIZE + f"]*{TH})"
WCOST = f"""count(*) over (partition by WAREHOUSE_NAME) as warehouse_usage_frequency, round(avg({C}) over (partition by WAREHOUSE_NAME),6) as warehouse_avg_cost, [1,2,4,8,16][{SIZE}] as expected_credits_per_hour, {SIZE} as warehouse_size_numeric,
 {r6(div(C, EXP), 'actual_vs_expected_credits_ratio')}, {r6(f'{C}-{EXP}', 'credits_variance_from_expected')}, {r6(div('1.0', div(C, EXP)), 'warehouse_efficiency')}, {fl('WAREHOUSE_NAME = (select WAREHOUSE_NAME from clog group by 1 order by count(*) desc, 1 limit 1)')} as is_primary_warehouse,
 {fl(f'{C} > avg({C}) over (partition by WAREHOUSE_NAME)')} as above_warehouse_avg_cost"""
query("cf04_warehouse_cost", f"with {COST} select QUERY_ID, {WCOST} from clog")(added(FC.warehouse_cost, _cost))
query("cf05_user_cost", f"""with {COST}, u as (select USER_NAME, sum({C}) as s, avg({C}) as m, dense_rank() over (order by sum({C}) desc) as rk from clog group by 1), dbt as (select DATABASE_NAME, sum({C}) as s, avg({C}) as m from clog group by 1)
select QUERY_ID, {r6('u.s', 'user_total_cost')}, {r6('u.m', 'user_avg_cost')}, u.rk as user_cost_rank, {fl('u.s >= (select quantile_cont(s,0.8) from u)')} as is_high_cost_user, {r6('u.m', 'user_cost_per_query')}, {r6('dbt.s', 'database_total_cost')}, {r6('dbt.m', 'database_avg_cost')},
 {r6(f'{C}/u.m', 'user_cost_vs_avg_ratio')}, {fl(f'{C}/u.m > 1')} as above_user_avg_cost, {r6(f'dbt.s/(select sum({C}) from clog)', 'database_cost_share')}, {fl(f'{C} > dbt.m')} as above_database_avg_cost from clog join u using (USER_NAME) join dbt using (DATABASE_NAME)""")(
    added(FC.user_cost, _cost))
Z = f"least(abs(({C}-(select avg({C}) from clog))/(select stddev_samp({C}) from clog)),3)/3"
query("cf06_cost_optimisation", f"""with {COST}, {CEFF} select QUERY_ID, {CEFF_COLS}, {WCOST}, {fl(f'{C} > {q(C, 0.8, "clog")} and {E} > {q(E, 0.8, "clog")}')} as optimization_candidate, {fl('score < 0.3')} as needs_optimization,
 {fl(div(C, EXP) + ' < 0.5')} as warehouse_underutilized, {fl(div(C, EXP) + ' > 1.5')} as warehouse_overutilized, {fl(f'{C} > {q(C, 0.5, "clog")} and {R} = 0')} as high_cost_zero_results, {r6(f'({Z} + 1 - score)/2', 'cost_anomaly_score')},
 {fl(f'({Z} + 1 - score)/2 > 0.7')} as is_cost_anomaly from cs""")(added(FC.cost_optimisation, _cost))
MED = q(C, 0.5, "clog")
query("cf07_comparative_cost", f"""with {COST} select QUERY_ID, {r6(f'{C}/{MED}', 'cost_vs_global_median')}, {r6(f'{C}/(select avg({C}) from clog)', 'cost_vs_global_mean')}, {fl(f'{C} < {MED}')} as cost_below_median, {fl(f'{C} < (select avg({C}) from clog)')} as cost_below_mean,
 {fl(f'{C} between {q(C, 0.25, "clog")} and {q(C, 0.75, "clog")}')} as cost_within_iqr, {fl(f'{C} > {q(C, 0.75, "clog")}')} as cost_above_q75, {fl(f'{C} < {q(C, 0.25, "clog")}')} as cost_below_q25, {r6(f'abs({C}-{MED})', 'cost_deviation_from_median')},
 {r6(f'abs({C}-{MED})/(select stddev_samp({C}) from clog)', 'cost_deviation_normalized')} from clog""")(added(FC.comparative_cost, _cost))
OW = "order by START_TIME, QUERY_ID"
query("cf08_cost_forecasting", f"""with v as (select *, coalesce({C}-lag({C}) over ({OW}),0) as vel from qlog), x as (select *, round(sum({C}) over ({OW} rows unbounded preceding),8)+0.0 as cumulative_cost, round(avg({C}) over ({OW} rows 6 preceding),8)+0.0 as cost_ma_7, round(avg({C}) over ({OW} rows 29 preceding),8)+0.0 as cost_ma_30,
 round(vel,8)+0.0 as cost_velocity, round(coalesce(vel-lag(vel) over ({OW}),0),8)+0.0 as cost_acceleration, avg({C}) over (partition by isodow({T})) as dw, avg({C}) over (partition by hour({T})) as hw from v)
select QUERY_ID, cumulative_cost, cost_ma_7, cost_ma_30, cost_velocity, cost_acceleration, isodow({T})-1 as day_of_week, hour({T}) as hour_of_day, day({T}) as day_of_month, month({T}) as month_of_year, round(dw,8) as typical_dow_cost, round(hw,8) as typical_hour_cost,
 round({C}/dw,8) as cost_vs_typical_dow, round({C}/hw,8) as cost_vs_typical_hour, {fl(f'day({T})=1')} as is_month_start, {fl(f'day({T}+interval 1 day)=1')} as is_month_end, {fl(f'day({T})=1 and month({T}) in (1,4,7,10)')} as is_quarter_start,
 {fl(f'day({T}+interval 1 day)=1 and month({T}) in (3,6,9,12)')} as is_quarter_end, day({T})-1 as days_since_month_start, date_diff('day', date_trunc('quarter',{T})::date, {T}::date) as days_since_quarter_start from x""", digits=8)(added(FC.cost_forecasting, query_log))

K = ["USER_NAME"]
DAYS7 = 7 * 86400


RANGE = "partition by USER_NAME order by epoch_us(START_TIME) range between {n} preceding and current row"


def rng(seconds):
    return RANGE.format(n=seconds * 1_000_000 - 1)


def _sums(w, suffix, c=C):
    return (f"round(count({c}) over ({w}),6)::bigint as {c}_rolling_{suffix}_count, round(sum({c}) over ({w}),6)+0.0 as {c}_rolling_{suffix}_sum, round(avg({c}) over ({w}),6)+0.0 as {c}_rolling_{suffix}_mean, "
            f"round(case when count({c}) over ({w}) > 1 then stddev_samp({c}) over ({w}) end,6)+0.0 as {c}_rolling_{suffix}_std")


query("rf01_rolling_hours", f"select QUERY_ID, {_sums(rng(24 * 3600), '24h')} from qlog", settled=True)(added(lambda df: FR.rolling_sums(df, K, [C], 24 * 3600, "24h"), query_log))
query("rf02_rolling_days", f"select QUERY_ID, {_sums(rng(DAYS7), '7d')} from qlog", settled=True)(added(lambda df: FR.rolling_sums(df, K, [C], DAYS7, "7d"), query_log))
W7 = rng(DAYS7)
query("rf02_rolling_shape", f"""select QUERY_ID, round(min({C}) over w,6)+0.0 as {C}_rolling_7d_min, round(max({C}) over w,6)+0.0 as {C}_rolling_7d_max, round(quantile_cont({C},0.5) over w,6)+0.0 as {C}_rolling_7d_median,
 round(case when count({C}) over w >= 3 then skewness({C}) over w end,6)+0.0 as {C}_rolling_7d_skew, round(case when count({C}) over w >= 4 then kurtosis({C}) over w end,6)+0.0 as {C}_rolling_7d_kurt from qlog window w as ({W7})""")(
    added(lambda df: FR.rolling_shape(df, K, [C], DAYS7, "7d"), query_log))
query("rf03_rolling_quantiles", f"select QUERY_ID, {', '.join(f'round(quantile_cont({C},{p}) over w,6)+0.0 as {C}_rolling_14d_p{int(p*100)}' for p in (0.25, 0.75, 0.9, 0.95))} from qlog window w as ({rng(14 * 86400)})")(
    added(lambda df: FR.rolling_quantiles(df, K, [C], 14), query_log))
UW = "partition by USER_NAME order by i"
NUM = "n as (select *, row_number() over (partition by USER_NAME order by START_TIME, QUERY_ID) as i from qlog)"


def rows(n):
    return f"({UW} rows {n - 1} preceding)"


def ful(e, n, size=None):
    return f"(case when count(*) over {rows(n)} = {size or n} then {e} end)"


query("rf04_rolling_trends", f"""with {NUM}, m as (select *, {ful(f'avg({C}) over {rows(7)} - avg({C}) over {rows(14)}', 14)} as macd from n)
select QUERY_ID, {', '.join(f'''round(case when count(*) over {rows(k)} >= 2 then regr_slope({C}, i) over {rows(k)} end,6)+0.0 as {C}_trend_{k}d, sign(case when count(*) over {rows(k)} >= 2 then regr_slope({C}, i) over {rows(k)} end)::double as {C}_trend_direction_{k}d,
 round(case when count(*) over {rows(k)} >= 3 then regr_r2({C}, i) over {rows(k)} end,6)+0.0 as {C}_trend_strength_{k}d, round(coalesce({C}/lag({C},{k}) over ({UW}) - 1,0),6)+0.0 as {C}_momentum_{k}d''' for k in (7, 14))},
 round(macd,6)+0.0 as {C}_macd_14d, round(case when count(macd) over {rows(3)} = 3 then avg(macd) over {rows(3)} end,6)+0.0 as {C}_macd_signal_14d from m""")(added(lambda df: FR.rolling_trends(df, K, [C], (7, 14)), query_log))
query("rf05_rolling_volatility", f"""with {NUM}, d as (select *, sign({C}-lag({C}) over ({UW})) as dd from n), t as (select *, case when lag(dd) over ({UW}) is not null then case when dd <> lag(dd) over ({UW}) then 1 else 0 end end as tt from d),
q as (select *, case when i >= 7 then list({C}) over {rows(7)} end as v, quantile_cont({C},0.25) over {rows(7)} as q1, quantile_cont({C},0.75) over {rows(7)} as q3, coalesce({ful(f'stddev_samp({C}) over {rows(7)}/avg({C}) over {rows(7)}', 7)},0) as cv from t)
select QUERY_ID, round(cv,6)+0.0 as {C}_volatility_7d, round(coalesce({ful(f'(max({C}) over {rows(7)}-min({C}) over {rows(7)})/avg({C}) over {rows(7)}', 7)},0),6)+0.0 as {C}_relative_range_7d, round(1/(1+cv),6)+0.0 as {C}_stability_7d,
 cast(case when count(dd) over {rows(7)} = 7 then sum(tt) over {rows(6)} end as bigint) as {C}_direction_changes_7d, cast(len(list_filter(v, lambda x: x < q1-1.5*(q3-q1) or x > q3+1.5*(q3-q1))) as bigint) as {C}_outlier_count_7d from q""")(
    added(lambda df: FR.rolling_volatility(df, K, [C], (7,)), query_log))


def _chg(k):
    old = f"lag({C},{k}) over ({UW})"
    return (f"round({C}-{old},6)+0.0 as {C}_change_{k}d, round(coalesce(({C}-{old})/{old},0),6)+0.0 as {C}_pct_change_{k}d, round(coalesce(ln({C}/{old}),0),6)+0.0 as {C}_log_change_{k}d, round(abs({C}-{old}),6)+0.0 as {C}_change_magnitude_{k}d, "
            f"sign({C}-{old})::double as {C}_change_direction_{k}d, round({C}-{old},6)+0.0 as {C}_cumulative_change_{k}d")


query("rf06_rolling_changes", f"""with {NUM}, c as (select *, {C}-lag({C},3) over ({UW}) as c3 from n) select QUERY_ID, {_chg(1)}, {_chg(3)}, round(c3-lag(c3) over ({UW}),6)+0.0 as {C}_acceleration_3d from c""")(
    added(lambda df: FR.rolling_changes(df, K, [C], (1, 3)), query_log))


def _pairs(k):
    out = []
    for a, b in FR.PAIRS:
        out.append(f"round(coalesce({ful(f'case when stddev_pop({a}) over {rows(k)} > 0 and stddev_pop({b}) over {rows(k)} > 0 then corr({a},{b}) over {rows(k)} end', k)},0),5)+0.0 as {a}_{b}_corr_{k}d")
        out.append(f"round(coalesce({ful(f'avg({a}) over {rows(k)}/nullif(avg({b}) over {rows(k)},0)', k)},0),5)+0.0 as {a}_{b}_ratio_{k}d")
        if a == C and b == B:
            out.append(f"round(coalesce({ful(f'avg({b}) over {rows(k)}/nullif(avg({a}) over {rows(k)},0)', k)},0),5)+0.0 as {b}_per_credit_{k}d")
    out.append(f"round(coalesce({ful(f'sum({C}) over {rows(k)}/nullif(sum({E}) over {rows(k)}/3.6e6,0)', k)},0),5)+0.0 as credits_per_hour_{k}d")
    return ", ".join(out)


query("rf07_rolling_pairs", f"with {NUM.replace('qlog', 'clog')}, {COST} select QUERY_ID, {_pairs(7)} from n".replace(f"with {NUM.replace('qlog', 'clog')}, {COST}", f"with {COST}, {NUM.replace('qlog', 'clog')}"), digits=5)(
    added(lambda df: FR.rolling_pairs(df, K, (7,)), _cost))


def _sea(cond, name):
    w = f"({UW} rows unbounded preceding)"
    return f"round(avg(case when {cond} then {C} end) over {w},6)+0.0 as {C}_rolling_{name}_mean"


query("rf08_seasonal_means", f"""with {NUM} select QUERY_ID, {', '.join([_sea(f'isodow({T})={x + 1}', f'dow_{x}') for x in range(7)] + [_sea(f'hour({T})={h}', f'hour_{h}') for h in (9, 12, 15, 18)] + [_sea(f'month({T})=1', 'month_1'), _sea(f'isodow({T})<6', 'business'), _sea(f'isodow({T})>=6', 'weekend')])} from n""", settled=True)(
    added(lambda df: FR.seasonal_means(df, K, [C], months=(1,)), query_log))
query("rf09_lags", f"with {NUM} select QUERY_ID, " + ", ".join(
    f"round(lag({C},{k}) over ({UW}),6)+0.0 as {C}_lag_{k}, round({C}-lag({C},{k}) over ({UW}),6)+0.0 as {C}_lag_diff_{k}, round(coalesce({C}/lag({C},{k}) over ({UW}),1),6)+0.0 as {C}_lag_ratio_{k}" for k in (1, 2, 3, 7, 14)) + " from n")(
    added(lambda df: FR.lag_features(df, K, [C]), query_log))


def _grp(k):
    w = f"partition by WAREHOUSE_NAME order by epoch_us(START_TIME) range between {k * 86400 * 1_000_000 - 1} preceding and current row"
    return f"round(avg({C}) over ({w}),6)+0.0 as {C}_group_WAREHOUSE_NAME_rolling_{k}d, round({C}-avg({C}) over ({w}),6)+0.0 as {C}_vs_group_WAREHOUSE_NAME_{k}d"


query("rf10_grouped_means", f"select QUERY_ID, {_grp(7)}, {_grp(14)} from qlog", settled=True)(added(lambda df: FR.grouped_means(df, "WAREHOUSE_NAME", [C], (7, 14)), query_log))

query("pf01_user_patterns", f"""with b as (select *, hour({T}) as h from wlog), u as (select USER_NAME, count(*) as n, coalesce(stddev_samp({C})/avg({C}),0) as cv, avg(case when h between 9 and 17 then 1.0 else 0 end) as bh, count(distinct SESSION_ID) as s, count(distinct h) as hd, count(distinct QUERY_TYPE) as qt from b group by 1),
mo as (select USER_NAME, min_by(h, (-n, h)) as mh from (select USER_NAME, h, count(*) as n from b group by 1, 2) group by 1)
select QUERY_ID, u.n as user_activity_score, {r6('cv', 'user_behavior_consistency')}, {r6('bh', 'user_business_hours_preference')}, hd as user_time_diversity, qt as user_query_type_diversity, mh as user_preferred_hour, {r6('u.n/(select max(n) from u)', 'user_activity_score_normalized')},
 {fl('s > 1')} as user_multi_session, count(*) over (partition by SESSION_ID) as session_length, count(*) over (partition by ROLE_NAME) as role_usage_frequency, count(*) over (partition by USER_NAME, ROLE_NAME) as user_role_combination_frequency from b join u using (USER_NAME) join mo using (USER_NAME)""")(
    added(FP.user_patterns))
SCORE = "(" + "+".join(scaled(c, "x") for c in FP.SCALED) + ")/4"
INTENS = " ".join(f"when ri {'>=' if i == 0 else '>'} {q('ri', a, 'x')} and ri <= {q('ri', b, 'x')} then '{t}'" for i, (a, b, t) in enumerate(zip((0, .25, .5, .75), (.25, .5, .75, 1), FP.INTENSITY_LABELS)))
SEL = f"(case when {B} > 0 then greatest(0, least(1, {R}*100/{B})) else 0 end)"
query("pf02_complexity_patterns", f"""with {COST}, x as (select *, {div(C, f'({E}/1000)')} as ri from clog), y as (select *, {SCORE} as sc from x)
select QUERY_ID, {r6('ri', 'resource_intensity')}, {r6('sc', 'query_complexity_score')}, {cut('sc', [0, .2, .5, .8, 1], ['simple', 'moderate', 'complex', 'very_complex'])} as complexity_category, case {INTENS} end as resource_efficiency_class,
 {r6(SEL, 'query_selectivity')}, {cut(SEL, [0, .01, .1, .5, 1], ['highly_selective', 'selective', 'moderate', 'broad'])} as selectivity_pattern from y""")(added(FP.complexity_patterns, _cost))
query("pf03_resource_patterns", f"""with x as (select *, {div(R, C)} as es, count(*) over (partition by WAREHOUSE_NAME) as wl from wlog), dv as (select USER_NAME, count(distinct DATABASE_NAME) as n from wlog group by 1)
select QUERY_ID, wl as warehouse_load, count(*) over (partition by DATABASE_NAME) as database_usage_frequency, dv.n as user_database_diversity, {r6('es', 'resource_efficiency_score')}, {r6('wl/(select max(wl) from x)', 'warehouse_preference_score')}, {fl('dv.n > 1')} as is_cross_database_user,
 {fl(f'{C} > {q(C, 0.8, "x")} and {R} < {q(R, 0.2, "x")}')} as potential_waste_indicator, {r6(f'greatest(0, least(1, es/{q("es", 0.95, "x")}))', 'resource_efficiency_score_normalized')}, {fl(f'{Q} > 1000')} as experiences_queuing,
 {cut(Q, [0, 1000, 10000, 60000, BIG], ['no_queue', 'short', 'medium', 'long'])} as queue_severity from x join dv using (USER_NAME)""")(added(FP.resource_patterns))
query("pf04_temporal_patterns", f"""with h as (select hour({T}) as h, count(*) as n from qlog group by 1), pk as (select h from h order by n desc, h limit 3), op as (select h from h order by n, h limit 3),
x as (select *, count(*) over w as c, (epoch_us(max({T}) over w)-epoch_us(min({T}) over w))/1e6 as s, coalesce((epoch_us({T})-epoch_us(lag({T}) over ({OW})))/1e6,0) as g from qlog window w as ({OW} rows between 5 preceding and 4 following)), y as (select *, case when c > 1 then c/greatest(s/60,1) else 0 end as qd from x)
select QUERY_ID, {r6('qd', 'query_density')}, {r6('g', 'time_since_last_query')}, {fl(f'hour({T}) in (select h from pk)')} as is_peak_hour, {fl(f'hour({T}) in (select h from op)')} as is_off_peak_hour, {fl(f'isodow({T}) >= 6')} as is_weekend_activity,
 {fl(f'day({T}) >= 25')} as is_month_end_activity, {fl(f'day({T}+interval 1 day)=1 and month({T}) in (3,6,9,12)')} as is_quarter_end_activity, {fl('qd > (select quantile_cont(qd,0.9) from y)')} as is_burst_activity,
 {r6('(select 1/(1+stddev_samp(g)/avg(g)) from y)', 'timing_regularity_score')}, {fl('g > 3600')} as follows_long_gap from y""")(added(FP.temporal_patterns, query_log))


def zz(c, t="clog"):
    return f"(({c}-(select avg({c}) from {t}))/(select stddev_samp({c}) from {t}))"


query("pf05_anomaly_patterns", f"""with {COST} select QUERY_ID, {', '.join(f"{fl(f'abs({zz(c)}) > 3')} as {c}_is_anomaly, {fl(f'{c} > {q(c, 0.99, "clog")}')} as {c}_is_extreme, {fl(f'{c} < {q(c, .25, "clog")}-1.5*({q(c, .75, "clog")}-{q(c, .25, "clog")}) or {c} > {q(c, .75, "clog")}+1.5*({q(c, .75, "clog")}-{q(c, .25, "clog")})')} as {c}_is_outlier_iqr" for c in FP.ANOMALY)},
 {r6('(' + '+'.join(f'abs({zz(c)})' for c in FP.ANOMALY) + ')/3', 'multivariate_anomaly_score')}, {fl('(' + '+'.join(f'abs({zz(c)})' for c in FP.ANOMALY) + ')/3 > 3')} as is_anomaly,
 {', '.join(f"{fl(f'abs(({c}-avg({c}) over (partition by USER_NAME))/nullif(stddev_samp({c}) over (partition by USER_NAME),0)) > 2')} as {c}_user_anomaly" for c in FP.ANOMALY[:2])} from clog""")(added(FP.anomaly_patterns, _cost))


def bin_(c):
    return "(" + "+".join(fl(f"{zz(c)} >= {e}") for e in (-2, -1, 0, 1, 2)) + ")"


query("pf06_advanced_patterns", f"""with {COST}, n as (select *, row_number() over ({OW}) as i from clog), x as (select *, regr_slope({E}, i) over f as sl, 0.1*stddev_samp({E}) over f as sd, count(*) over f as c5, case when count(*) over t = 10 and stddev_pop({C}) over t > 0 and stddev_pop({B}) over t > 0 then corr({C},{B}) over t end as cr,
 {' || '.join(bin_(c) for c in FP.SIGNATURE)} as sg from n window f as (order by i rows 4 preceding), t as (order by i rows 9 preceding))
select QUERY_ID, case when c5 = 5 then case when sl > sd then 1 when sl < -sd then -1 else 0 end else 0 end as recent_execution_trend, {r6('coalesce(cr,0)', f'rolling_correlation_{C}_{B}')}, {fl('abs(cr) > 0.7')} as has_strong_correlation, sg as workload_signature,
 count(*) over (partition by sg) as signature_frequency, {fl('count(*) over (partition by sg) >= 3')} as is_common_pattern from x""")(added(FP.advanced_patterns, _cost))


@query("pf07_clusters")
def clusters(spark, d):
    rows = _wide(spark, d).select("QUERY_ID", C, E, B, R)
    return FP.clustering_patterns(rows, [C, E, B, R])


@query("fe01_generated_features")
def generated_features(spark, d):
    out = FP.generate(_cost(spark, d).drop("CREDITS_USED_COMPUTE", "CREDITS_USED_CLOUD_SERVICES", "TOTAL_ELAPSED_TIME"), ("time", "rolling"), most=40)
    return out.select([c for c in out.columns if c != "QUERY_TEXT"])


@query("fe02_uncorrelated", f"select QUERY_ID, round({C},6) as {C}, {R} from qlog")
def uncorrelated(spark, d):
    return FP.drop_correlated(query_log(spark, d).select("QUERY_ID", C, E, R, B))


@query("fe03_top_variance", f"select QUERY_ID, QUERY_TYPE, {B}, round({E},6) as {E} from qlog")
def top_variance(spark, d):
    return FP.keep_by_variance(query_log(spark, d).select("QUERY_ID", "QUERY_TYPE", C, E, R, B), 4)


@query("fe04_priority_features", f"select {B}, round({C},6) as {C}, QUERY_ID from qlog")
def priority_features(spark, d):
    return FP.keep_by_priority(query_log(spark, d).select("QUERY_ID", "QUERY_TYPE", C, B), [B, "absent", C], 3)


@query("fe05_feature_summary", """with n as (select count(*) filter (kind is null) as k, count(*) filter (value is null) as v from dirty)
select 'kind' as feature, 'string' as data_type, k as missing_values, 'time' as categories from n union all select 'execution_cost', 'double', v, 'cost,usage' from n union all select 'cost_ratio', 'double', v, 'cost,pattern' from n""")
def feature_summary(spark, d):
    from tidewatch.sources.tables import dirty_log
    rows = dirty_log(spark, d)
    # the category of a feature follows from its name alone
    out = rows.select("kind", F.col("value").alias("execution_cost"), F.col("value").alias("cost_ratio"))
    return FP.feature_summary(out.withColumnRenamed("kind", "weekly_kind")).withColumn(
        "feature", F.when(F.col("feature") == "weekly_kind", "kind").otherwise(F.col("feature")))


@query("fe06_feature_importance", f"select unnest(['{E}','{R}','{B}']) as feature, unnest([round(abs(corr({E},{C})),6), round(abs(corr({R},{C})),6), round(abs(corr({B},{C})),6)]) as importance from qlog")
def feature_importance(spark, d):
    return FP.feature_importance(query_log(spark, d).select(C, E, R, B), C)
