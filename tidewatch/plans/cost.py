"""Queries over cost aggregation."""

from pyspark.sql import functions as F

from tidewatch.operators import cost as C
from tidewatch.plans.dimensional import PCT
from tidewatch.plans.registry import query
from tidewatch.sources.tables import cost_facts, query_log

PS = [0.5, 0.75, 0.9, 0.95, 0.99]
CLASSES = [("low_cost_query", 0.01), ("medium_cost_query", 0.1), ("high_cost_query", 1.0), ("very_high_cost_query", 10.0)]
BASIC = """round(sum(CREDITS_USED),6) as total_credits_used, round(sum(CREDITS_USED*2.0),6) as total_cost_amount, count(*) as total_queries,
  round(sum(CREDITS_USED)/count(*),6) as avg_credits_per_query, round(sum(CREDITS_USED*2.0)/count(*),6) as avg_cost_per_query, 'USD' as currency,
  min(START_TIME) as analysis_period_start, max(START_TIME) as analysis_period_end,
  round((epoch_us(max(START_TIME))-epoch_us(min(START_TIME)))/3.6e9,6) as analysis_duration_hours,
  """ + ", ".join(f"count(*) filter (CREDITS_USED >= {v}) as {k}_count, round(count(*) filter (CREDITS_USED >= {v})*100.0/count(*),6) as {k}_percentage" for k, v in CLASSES) \
    + ", " + ", ".join(f"round(quantile_cont(CREDITS_USED,{p}),6) as credits_p{int(p*100)}, round(quantile_cont(CREDITS_USED*2.0,{p}),6) as cost_p{int(p*100)}" for p in PS)
EFFICIENCY = """round(sum(CREDITS_USED)/greatest(sum(ROWS_PRODUCED),1),6) as credits_per_row, round(sum(CREDITS_USED*2)/greatest(sum(ROWS_PRODUCED),1),6) as cost_per_row,
  round(sum(CREDITS_USED)/greatest(sum(BYTES_SCANNED)/1e9,1),6) as credits_per_gb, round(sum(CREDITS_USED*2)/greatest(sum(BYTES_SCANNED)/1e9,1),6) as cost_per_gb,
  round(sum(CREDITS_USED)/greatest(sum(EXECUTION_TIME_MS)/3.6e6,1),6) as credits_per_hour, round(sum(CREDITS_USED*2)/greatest(sum(EXECUTION_TIME_MS)/3.6e6,1),6) as cost_per_hour,
  round(median(CREDITS_USED),6) as credits_per_query_median, round(quantile_cont(CREDITS_USED,0.9),6) as credits_per_query_p90, round(stddev_samp(CREDITS_USED),6) as credits_per_query_std,
  round(median(CREDITS_USED*2),6) as cost_per_query_median, round(quantile_cont(CREDITS_USED*2,0.9),6) as cost_per_query_p90, round(stddev_samp(CREDITS_USED*2),6) as cost_per_query_std"""
SAVINGS = """select d*0.3 as potential_savings_query_opt, d*0.3/t*100 as potential_savings_query_opt_percentage, w*0.2 as potential_savings_warehouse_opt, w*0.2/t*100 as potential_savings_warehouse_opt_percentage
from (select sum(CREDITS_USED*2) filter (CREDITS_USED*2 >= (select quantile_cont(CREDITS_USED*2,0.9) from {t})) as d, sum(CREDITS_USED*2) as t from {t}),
 (select coalesce(sum(c) filter (c < 0.5*(select median(c) from (select sum(CREDITS_USED*2) as c from {t} group by WAREHOUSE_NAME))),0) as w from (select sum(CREDITS_USED*2) as c from {t} group by WAREHOUSE_NAME))"""


def _gini(dim, t):
    return (f"(select 2.0*sum(i*c)/(count(*)*sum(c))-(count(*)+1.0)/count(*) from "
            f"(select c, row_number() over (order by c) as i from (select sum(CREDITS_USED*2) as c from {t} group by {dim})))")


@query("ca01_cost_summary", f"""
select *, {', '.join(f'round({_gini(x, "qlog")},6) as {x}_cost_gini' for x in C.ALLOCATION_DIMENSIONS)},
  3.0::double as cost_spike_threshold, 3.0::double as usage_spike_threshold, 1000.0::double as daily_budget_target, 7000.0::double as weekly_budget_target,
  30000.0::double as monthly_budget_target, 90000.0::double as quarterly_budget_target
from (select {BASIC}, {EFFICIENCY} from qlog),
  (select round(columns(*),6) from ({SAVINGS.format(t='qlog')}))""")
def cost_summary(spark, d):
    return C.cost_summary(query_log(spark, d))


@query("ca02_basic_cost", f"select {BASIC} from facts")
def basic_cost(spark, d):
    return C.basic_summary(cost_facts(spark, d))


@query("ca03_top_consumers", """
with l as (select 'USER_NAME' as dimension, USER_NAME as value, sum(CREDITS_USED*2) as cost from facts group by 2
  union all select 'WAREHOUSE_NAME', WAREHOUSE_NAME, sum(CREDITS_USED*2) from facts group by 2
  union all select 'QUERY_TYPE', QUERY_TYPE, sum(CREDITS_USED*2) from facts group by 2)
select dimension, value, round(cost,6) as cost, round(cost/(select sum(CREDITS_USED*2) from facts)*100,6) as percentage,
  row_number() over (partition by dimension order by cost desc, value) as rank from l qualify rank <= 10""")
def top_consumers(spark, d):
    return C.top_consumers(cost_facts(spark, d), ["USER_NAME", "WAREHOUSE_NAME", "QUERY_TYPE"])


@query("ca04_cost_gini", " union all ".join(
    f"select '{x}' as dimension, round({_gini(x, 'facts')},6) as cost_gini" for x in ("USER_NAME", "WAREHOUSE_NAME", "QUERY_TYPE")))
def cost_gini(spark, d):
    return C.cost_inequality(cost_facts(spark, d), ["USER_NAME", "WAREHOUSE_NAME", "QUERY_TYPE"])


@query("ca05_efficiency", f"select {EFFICIENCY} from qlog")
def cost_efficiency(spark, d):
    return C.efficiency_summary(query_log(spark, d))


@query("ca07_savings", f"select round(columns(*),6) from ({SAVINGS.format(t='facts')})")
def savings(spark, d):
    return C.savings_summary(cost_facts(spark, d))


SIX = ", ".join(f"round({f}({e}),6) as {c}_{n}" for c, e in (("CREDITS_USED", "CREDITS_USED"), ("cost_amount", "CREDITS_USED*2"))
                for n, f in (("sum", "sum"), ("mean", "avg"), ("median", "median"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")))


@query("ca08_cost_by_dimension", f"""
select WAREHOUSE_NAME, {SIX}, count(CREDITS_USED) as CREDITS_USED_count,
  {', '.join(f"round(sum({c}),6) as {c}_sum, round(avg({c}),6) as {c}_mean, round(median({c}),6) as {c}_median" for c in ('EXECUTION_TIME_MS', 'BYTES_SCANNED', 'ROWS_PRODUCED'))}
from facts group by 1""")
def cost_by_dimension(spark, d):
    return C.cost_by_dimension(cost_facts(spark, d), "WAREHOUSE_NAME")


USERS = ("with g as (select USER_NAME, sum(CREDITS_USED) as c, sum(CREDITS_USED*2) as s, count(CREDITS_USED) as n, "
         "sum(ROWS_PRODUCED) as r, sum(BYTES_SCANNED) as b from facts group by 1)")


@query("ca09_cost_shares", USERS + """,
x as (select USER_NAME, s/(select sum(s) from g)*100 as p, sum(s) over (order by s desc, USER_NAME rows unbounded preceding)/(select sum(s) from g)*100 as cum from g)
select USER_NAME, round(p,6) as cost_share_percentage, round(cum,6) as cumulative_cost_share, case when cum <= 20 then 1 else 0 end as is_top_20_percent,
  case when cum <= 80 then 1 else 0 end as is_pareto_contributor from x""")
def cost_shares(spark, d):
    agg = C.with_cost(cost_facts(spark, d)).groupBy("USER_NAME").agg(F.sum(C.COST).alias("cost_amount_sum"))
    return C.add_cost_shares(agg, "USER_NAME").drop("cost_amount_sum")


@query("ca10_cost_ranks", f"""
with g as (select USER_NAME, max(CREDITS_USED) as c, max(CREDITS_USED)*2 as s, count(CREDITS_USED) as n from facts group by 1)
select USER_NAME, {', '.join(f"dense_rank() over (order by {v} desc) as {k}_rank, round({PCT(v)},6) as {k}_percentile" for v, k in (('s', 'cost'), ('c', 'credits'), ('n', 'query_volume')))} from g""")
def cost_ranks(spark, d):
    # dearest query per user: many users tie on the volume, few on the cost
    agg = cost_facts(spark, d).groupBy("USER_NAME").agg(
        F.max("CREDITS_USED").alias("CREDITS_USED_sum"), F.count("CREDITS_USED").alias("CREDITS_USED_count"))
    agg = agg.withColumn("cost_amount_sum", F.col("CREDITS_USED_sum") * 2)
    return C.add_cost_ranks(agg).drop("CREDITS_USED_sum", "CREDITS_USED_count", "cost_amount_sum")


@query("ca11_cost_ratios", USERS + """
select USER_NAME, round(c/n,6) as credits_per_query_efficiency, round(s/n,6) as cost_per_query_efficiency, round(c/(r+1),6) as credits_per_row_efficiency,
  round(s/(r+1),6) as cost_per_row_efficiency, round(c/(b/1e9+1),6) as credits_per_gb_efficiency, round(s/(b/1e9+1),6) as cost_per_gb_efficiency from g""")
def cost_ratios(spark, d):
    agg = C.with_cost(cost_facts(spark, d)).groupBy("USER_NAME").agg(
        F.sum("CREDITS_USED").alias("CREDITS_USED_sum"), F.count("CREDITS_USED").alias("CREDITS_USED_count"),
        F.sum("cost_amount").alias("cost_amount_sum"), F.sum("ROWS_PRODUCED").alias("ROWS_PRODUCED_sum"),
        F.sum("BYTES_SCANNED").alias("BYTES_SCANNED_sum"))
    out = C.add_cost_ratios(agg)
    return out.select("USER_NAME", *[c for c in out.columns if c.endswith("_efficiency")])


METRICS = ("EXECUTION_TIME_MS", "BYTES_SCANNED", "ROWS_PRODUCED")


@query("ca12_cost_series", f"""
select date_trunc('month', START_TIME)::timestamp as time_group, round(sum(CREDITS_USED),6) as CREDITS_USED_sum, round(avg(CREDITS_USED),6) as CREDITS_USED_mean,
  count(CREDITS_USED) as CREDITS_USED_count, round(sum(CREDITS_USED*2),6) as cost_amount_sum, round(avg(CREDITS_USED*2),6) as cost_amount_mean,
  {', '.join(f"round(sum({c}),6) as {c}_sum, round(avg({c}),6) as {c}_mean" for c in METRICS)} from facts group by 1""")
def cost_series(spark, d):
    return C.cost_series(cost_facts(spark, d), "monthly")


DAY = ("with day as (select date_trunc('day', START_TIME)::timestamp as time_group, sum(CREDITS_USED) as credits, sum(CREDITS_USED*2) as cost "
       "from qlog group by 1), n as (select *, row_number() over (order by time_group) as i from day)")


def _full(e, n):
    return f"case when i >= {n} then {e} over (order by i rows between {n-1} preceding and current row) end"


@query("ca13_series_changes", DAY + " select time_group, " + ", ".join(
    [f"round({c} - lag({c}) over (order by i),8) as {c}_change, round(({c} - lag({c}) over (order by i))/lag({c}) over (order by i),8) as {c}_pct_change, "
     f"round({_full(f'stddev_samp({c})', 5)},8) as {c}_volatility" for c in ("cost", "credits")]
    + [f"round({_full(f'avg({c})', n)},8) as {c}_ma_{n}" for c in ("cost", "credits") for n in (3, 7, 14, 30)]) + " from n", digits=8)
def series_changes(spark, d):
    out = C.add_series_changes(C.cost_series(query_log(spark, d), "daily"), "daily")
    return out.select("time_group", *[c for c in out.columns if c.split("_")[-1].isdigit() or c.endswith(("change", "volatility"))])


@query("ca14_budget_tracking", DAY + """ select time_group, round(cost,6) as budget_actual, 1000.0::double as budget_target, round(cost-1000,6) as budget_variance,
  round((cost-1000)/1000*100,6) as budget_variance_pct, case when cost > 1000 then 1 else 0 end as is_over_budget,
  round(sum(cost) over (order by i),6) as cumulative_cost, i*1000.0::double as cumulative_budget, round(sum(cost) over (order by i) - i*1000,6) as cumulative_variance from n""")
def budget_tracking(spark, d):
    series = C.cost_series(query_log(spark, d), "daily")
    return C.add_budget(series, "daily").drop(*[c for c in series.columns if c != "time_group"])


@query("ca15_series_trend", DAY + f""" select time_group, round(regr_slope(cost, i) over (),6) as cost_trend_slope, round(regr_slope(credits, i) over (),6) as credits_trend_slope,
  sign(regr_slope(cost, i) over ())::double as cost_trend_direction, sign(regr_slope(credits, i) over ())::double as credits_trend_direction,
  round({_full('regr_slope(cost, i)', 5)},6) as cost_rolling_trend from n""")
def series_trend(spark, d):
    series = C.cost_series(query_log(spark, d), "daily")
    return C.add_series_trend(series).drop(*[c for c in series.columns if c != "time_group"])


HIGH = "with q as (select *, CREDITS_USED*2 as cost from facts), h as (select * from q where CREDITS_USED >= (select quantile_cont(CREDITS_USED,0.95) from q))"


@query("ca17_high_cost_queries", HIGH + """
select round((select quantile_cont(CREDITS_USED,0.95) from q),6) as threshold_credits, count(*) as count, round(sum(cost),6) as total_cost,
  round(sum(cost)/(select sum(cost) from q)*100,6) as percentage_of_total_cost, round(avg(cost),6) as avg_cost from h""")
def high_cost_queries(spark, d):
    return C.high_cost_queries(cost_facts(spark, d))


@query("ca17_high_cost_patterns", HIGH + """
select 'QUERY_TYPE' as dimension, QUERY_TYPE as value, round(sum(cost),6) as cost from h group by 2
union all select 'DATABASE_NAME', DATABASE_NAME, round(sum(cost),6) from h group by 2
union all (select 'USER_NAME', USER_NAME, round(sum(cost),6) as c from h group by 2 order by c desc, 2 limit 5)""")
def high_cost_patterns(spark, d):
    return C.high_cost_patterns(cost_facts(spark, d))


@query("ca18_inefficient_users", """
with u as (select USER_NAME, sum(CREDITS_USED) as credits_sum, avg(CREDITS_USED) as credits_mean, count(*) as query_count, sum(CREDITS_USED*2) as cost_sum,
  sum(CREDITS_USED)/(sum(ROWS_PRODUCED)+1) as credits_per_row from qlog group by 1), t as (select quantile_cont(credits_mean,0.75) as t from u)
select USER_NAME, round(credits_sum,6) as credits_sum, round(credits_mean,6) as credits_mean, query_count, round(cost_sum,6) as cost_sum,
  round(credits_per_row,6) as credits_per_row, round(t,6) as threshold_credits_per_query from u, t where credits_mean >= t""")
def inefficient_users(spark, d):
    return C.inefficient_users(query_log(spark, d))


@query("ca19_underused_warehouses", """
with w as (select WAREHOUSE_NAME, sum(CREDITS_USED) as credits_sum, sum(CREDITS_USED*2) as cost_sum,
  sum(CREDITS_USED)/greatest((epoch_us(max(START_TIME))-epoch_us(min(START_TIME)))/3.6e9,1) as credits_per_hour
  from (select USER_NAME as WAREHOUSE_NAME, START_TIME, CREDITS_USED from facts) group by 1), t as (select median(credits_per_hour)*0.25 as t from w)
select WAREHOUSE_NAME, round(credits_sum,6) as credits_sum, round(cost_sum,6) as cost_sum, round(credits_per_hour,6) as credits_per_hour,
  round(t,6) as threshold_credits_per_hour, round(cost_sum*0.3,6) as potential_savings from w, t where credits_per_hour < t""")
def underused_warehouses(spark, d):
    # one warehouse per customer: enough of them for some to be little used
    facts = cost_facts(spark, d).withColumn("WAREHOUSE_NAME", F.col("USER_NAME"))
    return C.underused_warehouses(facts)


@query("ca20_cost_spikes", """
with dd as (select date_trunc('day', START_TIME)::timestamp as date, sum(CREDITS_USED) as credits from facts group by 1),
t as (select avg(credits)+3*stddev_samp(credits) as t from dd)
select date, round(credits,6) as credits, round(t,6) as threshold_credits, round(credits*2,6) as spike_cost from dd, t where credits > t""")
def cost_spikes(spark, d):
    return C.cost_spikes(cost_facts(spark, d))


@query("ca21_idle_time", """
with g as (select WAREHOUSE_NAME, (epoch_us(START_TIME)-epoch_us(lag(START_TIME) over (partition by WAREHOUSE_NAME order by START_TIME, QUERY_ID)))/6e7 as gap
  from (select USER_NAME as WAREHOUSE_NAME, START_TIME, QUERY_ID from qlog))
select WAREHOUSE_NAME, round(avg(gap),6) as avg_gap_minutes, round(max(gap),6) as max_gap_minutes, count(*) filter (gap > 60) as idle_periods_count,
  round(coalesce(sum(gap) filter (gap > 60),0)/60,6) as total_idle_hours from g group by 1 having avg(gap) is not null""")
def idle_time(spark, d):
    return C.idle_time(query_log(spark, d).withColumn("WAREHOUSE_NAME", F.col("USER_NAME")))


@query("ca22_optimisation_candidates", """
with q as (select *, CREDITS_USED/(ROWS_PRODUCED+1) as pr from qlog), t as (select QUERY_TEXT, count(*) as n, sum(CREDITS_USED) as s from qlog group by 1)
select count(*) filter (CREDITS_USED > (select quantile_cont(CREDITS_USED,0.8) from q) and pr > (select quantile_cont(pr,0.9) from q)) as high_cost_low_output,
  count(*) filter (EXECUTION_TIME_MS > (select quantile_cont(EXECUTION_TIME_MS,0.9) from q) and CREDITS_USED > (select quantile_cont(CREDITS_USED,0.9) from q)) as long_and_expensive,
  (select count(*) from t where n > 5 and s > (select quantile_cont(s,0.8) from t)) as repeated_expensive_patterns from q""")
def optimisation_candidates(spark, d):
    return C.optimisation_candidates(query_log(spark, d))


@query("ca23_warehouse_sizing", """
select WAREHOUSE_NAME, round(avg(CREDITS_USED),6) as avg_credits_per_query, round(max(CREDITS_USED),6) as max_credits_per_query, round(sum(CREDITS_USED*2),6) as total_cost,
  round(avg(CREDITS_USED)/max(CREDITS_USED),6) as utilization_ratio, case when avg(CREDITS_USED)/max(CREDITS_USED) < 0.3 then 'downsize'
  when avg(CREDITS_USED)/max(CREDITS_USED) > 0.8 then 'upsize' else 'optimal' end as recommendation from facts group by 1""")
def warehouse_sizing(spark, d):
    return C.warehouse_sizing(cost_facts(spark, d))


@query("ca16_opportunities", HIGH.replace("facts", "qlog") + """,
u as (select avg(CREDITS_USED) as m from qlog group by USER_NAME),
w as (select sum(CREDITS_USED)/greatest((epoch_us(max(START_TIME))-epoch_us(min(START_TIME)))/3.6e9,1) as r from qlog group by WAREHOUSE_NAME),
dd as (select sum(CREDITS_USED) as c from qlog group by date_trunc('day', START_TIME))
select 'high_cost_queries' as opportunity, 1 as rows
union all select 'inefficient_users', count(*) from u where m >= (select quantile_cont(m,0.75) from u)
union all select 'underutilized_warehouses', count(*) from w where r < 0.25*(select median(r) from w)
union all select 'cost_spikes', count(*) from dd where c > (select avg(c)+3*stddev_samp(c) from dd)
union all select 'idle_time_analysis', count(distinct WAREHOUSE_NAME) from qlog
union all select 'query_optimization_candidates', 1
union all select 'warehouse_sizing_recommendations', count(distinct WAREHOUSE_NAME) from qlog""")
def opportunities(spark, d):
    return C.opportunity_counts(query_log(spark, d))
