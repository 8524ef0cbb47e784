"""Queries over time aggregation."""

from pyspark.sql import functions as F

from tidewatch.operators import temporal as T
from tidewatch.plans.registry import query
from tidewatch.sources import files
from tidewatch.sources.tables import cost_facts, query_log

STATS = {"CREDITS_USED": ["sum", "mean", "max", "min", "std"],
         "EXECUTION_TIME_MS": ["mean", "median", "max", "std"],
         "ROWS_PRODUCED": ["sum", "mean", "count"]}


def _daily(spark, d):
    return T.aggregate_periods(query_log(spark, d), "START_TIME", "daily", {"CREDITS_USED": ["sum", "mean"]})


DAILY = ("with day as (select date_trunc('day', START_TIME)::timestamp as time_group, sum(CREDITS_USED) as s, "
         "avg(CREDITS_USED) as m from qlog group by 1)")


@query("ta02_period_starts", """
select level, time_group, count(*) as query_count from (
  select 'hourly' as level, date_trunc('hour', START_TIME)::timestamp as time_group from facts
  union all select 'daily', date_trunc('day', START_TIME)::timestamp from facts
  union all select 'weekly', date_trunc('week', START_TIME)::timestamp from facts
  union all select 'monthly', date_trunc('month', START_TIME)::timestamp from facts
  union all select 'quarterly', date_trunc('quarter', START_TIME)::timestamp from facts)
group by 1, 2""")
def period_starts(spark, d):
    facts = cost_facts(spark, d).select("START_TIME")
    starts = facts.select(F.explode(F.array(*[
        F.struct(F.lit(level).alias("level"), T.period(F.col("START_TIME"), unit).alias("time_group"))
        for level, unit in T.UNITS.items()])).alias("p")).select("p.*")
    return starts.groupBy("level", "time_group").agg(F.count("*").alias("query_count"))


@query("ta03_hourly_statistics", """
select date_trunc('hour', START_TIME)::timestamp as time_group, count(*) as query_count,
  round(sum(CREDITS_USED),6) as CREDITS_USED_sum, round(avg(CREDITS_USED),6) as CREDITS_USED_mean,
  round(max(CREDITS_USED),6) as CREDITS_USED_max, round(min(CREDITS_USED),6) as CREDITS_USED_min,
  round(stddev_samp(CREDITS_USED),6) as CREDITS_USED_std,
  round(avg(EXECUTION_TIME_MS),6) as EXECUTION_TIME_MS_mean, round(median(EXECUTION_TIME_MS),6) as EXECUTION_TIME_MS_median,
  round(max(EXECUTION_TIME_MS),6) as EXECUTION_TIME_MS_max, round(stddev_samp(EXECUTION_TIME_MS),6) as EXECUTION_TIME_MS_std,
  cast(sum(ROWS_PRODUCED) as bigint) as ROWS_PRODUCED_sum, round(avg(ROWS_PRODUCED),6) as ROWS_PRODUCED_mean,
  count(ROWS_PRODUCED) as ROWS_PRODUCED_count
from qlog group by 1""")
def hourly_statistics(spark, d):
    return T.aggregate_periods(query_log(spark, d), "START_TIME", "hourly", STATS)


@query("ta03_daily_percentiles", """
select date_trunc('day', START_TIME)::timestamp as time_group, count(*) as query_count, round(sum(CREDITS_USED),6) as CREDITS_USED_sum,
  round(quantile_cont(CREDITS_USED, 0.25),6) as CREDITS_USED_p25, round(quantile_cont(CREDITS_USED, 0.5),6) as CREDITS_USED_p50,
  round(quantile_cont(CREDITS_USED, 0.75),6) as CREDITS_USED_p75, round(quantile_cont(CREDITS_USED, 0.9),6) as CREDITS_USED_p90,
  round(quantile_cont(CREDITS_USED, 0.95),6) as CREDITS_USED_p95, round(quantile_cont(CREDITS_USED, 0.99),6) as CREDITS_USED_p99
from qlog group by 1""")
def daily_percentiles(spark, d):
    return T.aggregate_periods(query_log(spark, d), "START_TIME", "daily", {"CREDITS_USED": ["sum"]},
                               [25, 50, 75, 90, 95, 99])


CALENDAR_COLS = """year(t) as year, month(t) as month, quarter(t) as quarter, isodow(t)-1 as day_of_week, day(t) as day_of_month,
  dayofyear(t) as day_of_year, weekofyear(t) as week_of_year, case when isodow(t) < 6 then 1 else 0 end as is_business_day,
  case when isodow(t) >= 6 then 1 else 0 end as is_weekend,
  case month(t) when 12 then 'winter' when 1 then 'winter' when 2 then 'winter' when 3 then 'spring' when 4 then 'spring' when 5 then 'spring'
    when 6 then 'summer' when 7 then 'summer' when 8 then 'summer' else 'fall' end as season,
  case when day(t)=1 then 1 else 0 end as is_month_start, case when day(t + interval 1 day)=1 then 1 else 0 end as is_month_end,
  case when day(t)=1 and month(t) in (1,4,7,10) then 1 else 0 end as is_quarter_start,
  case when day(t + interval 1 day)=1 and month(t) in (3,6,9,12) then 1 else 0 end as is_quarter_end,
  case when day(t)=1 and month(t)=1 then 1 else 0 end as is_year_start,
  case when day(t)=31 and month(t)=12 then 1 else 0 end as is_year_end"""


@query("ta04_calendar_columns", f"""
select t as time_group, query_count, {CALENDAR_COLS}
from (select date_trunc('day', START_TIME)::timestamp as t, count(*) as query_count from facts group by 1)""")
def calendar_columns(spark, d):
    series = T.aggregate_periods(cost_facts(spark, d), "START_TIME", "daily", {})
    return T.calendar_columns(series, "daily")


TREND = """round(s - lag(s) over w, 6) as CREDITS_USED_sum_trend, sign(s - lag(s) over w)::double as CREDITS_USED_sum_trend_direction,
  round(coalesce((s - lag(s) over w) / lag(s) over w, 0), 6) as CREDITS_USED_sum_pct_change,
  round(case when count(*) over w5 >= 2 then regr_slope(s, i) over w5 end, 6) as CREDITS_USED_sum_rolling_trend"""


@query("ta05_trends", DAILY + f""", n as (select *, row_number() over (order by time_group) as i from day)
select time_group, {TREND} from n
window w as (order by time_group), w5 as (order by time_group rows between 4 preceding and current row)""")
def trends(spark, d):
    return T.add_trends(_daily(spark, d), ["CREDITS_USED_sum"]).drop("query_count", "CREDITS_USED_sum", "CREDITS_USED_mean")


@query("ta06_seasonality", """
with h as (select distinct date_trunc('hour', START_TIME)::timestamp as t from qlog)
select t as time_group, round(sin(2*pi()*hour(t)/24),6)+0.0 as hour_sin, round(cos(2*pi()*hour(t)/24),6)+0.0 as hour_cos,
  round(sin(2*pi()*(isodow(t)-1)/7),6)+0.0 as dow_sin, round(cos(2*pi()*(isodow(t)-1)/7),6)+0.0 as dow_cos,
  round(sin(2*pi()*quarter(t)/4),6)+0.0 as quarter_sin, round(cos(2*pi()*quarter(t)/4),6)+0.0 as quarter_cos from h""")
def seasonality(spark, d):
    series = T.aggregate_periods(query_log(spark, d), "START_TIME", "hourly", {})
    return T.add_seasonality(series, "hourly").drop("query_count")


GROWTH = """round(coalesce((s - lag(s) over w) / lag(s) over w, 0), 6) as CREDITS_USED_sum_growth_rate,
  round(coalesce((s - lag(s, 52) over w) / lag(s, 52) over w, 0), 6) as CREDITS_USED_sum_yoy_growth,
  round(case when count(*) over w12 >= 4 then case when first(s) over w12 <= 0 then 0 else pow(s / first(s) over w12, 1.0 / count(*) over w12) - 1 end end, 6) as CREDITS_USED_sum_cagr"""


@query("ta07_growth", f"""
with week as (select date_trunc('week', START_TIME)::timestamp as time_group, sum(CREDITS_USED) as s from facts group by 1)
select time_group, round(s,6) as CREDITS_USED_sum, {GROWTH} from week
window w as (order by time_group), w12 as (order by time_group rows between 11 preceding and current row)""")
def growth(spark, d):
    series = T.aggregate_periods(cost_facts(spark, d), "START_TIME", "weekly", {"CREDITS_USED": ["sum"]})
    return T.add_growth(series, ["CREDITS_USED_sum"]).drop("query_count")


def _ema(col, span):
    return (f"(select round(sum(b.{col} * pow(1-2.0/({span}+1), n.i-b.i)) / sum(pow(1-2.0/({span}+1), n.i-b.i)), 6) "
            f"from n b where b.i <= n.i)")


def _averages(col, name, spans):
    parts = []
    for n in spans:
        frame = f"over (order by time_group rows between {n-1} preceding and current row)"
        parts += [f"round(avg({col}) {frame}, 6) as {name}_ma_{n}", f"round(stddev_samp({col}) {frame}, 6) as {name}_std_{n}",
                  f"{_ema(col, n)} as {name}_ema_{n}"]
    return ", ".join(parts)


@query("ta08_moving_averages", DAILY + f""", n as (select *, row_number() over (order by time_group) as i from day)
select time_group, {_averages('s', 'CREDITS_USED_sum', [3, 7, 14, 30])} from n""")
def moving_averages(spark, d):
    series = T.add_moving_averages(_daily(spark, d), ["CREDITS_USED_sum"], "daily")
    return series.drop("query_count", "CREDITS_USED_sum", "CREDITS_USED_mean")


# Odd hours go to the hour before, which leaves gaps.
GAPS = """with hour as (select (date_trunc('hour', START_TIME) - to_hours(hour(START_TIME) % 2))::timestamp as time_group, sum(CREDITS_USED) as s, min(QUERY_TYPE) as k
  from qlog group by 1),
grid as (select unnest(generate_series((select min(time_group) from hour), (select max(time_group) from hour), interval 1 hour)) as time_group)"""


def _sparse_hours(spark, d):
    log = query_log(spark, d).withColumn("START_TIME", F.expr("START_TIME - make_dt_interval(0, hour(START_TIME) % 2)"))
    return T.with_period(log, "START_TIME", "hourly").groupBy(T.PERIOD).agg(
        F.sum("CREDITS_USED").alias("credits"), F.min("QUERY_TYPE").alias("kind"))


@query("ta09_filled_periods", GAPS + """
select g.time_group, round(coalesce(s, 0), 6) as credits, coalesce(k, 'Missing') as kind
from grid g left join hour h on g.time_group = h.time_group""")
def filled_periods(spark, d):
    return T.fill_periods(_sparse_hours(spark, d), "hourly")


@query("ta09_interpolated_periods", GAPS + """,
j as (select g.time_group, s, coalesce(k, 'Missing') as kind, row_number() over (order by g.time_group) as i
  from grid g left join hour h on g.time_group = h.time_group),
p as (select *, last_value(case when s is not null then i end ignore nulls) over (order by i) as pi,
  last_value(s ignore nulls) over (order by i) as ps,
  first_value(case when s is not null then i end ignore nulls) over (order by i rows between current row and unbounded following) as ni,
  first_value(s ignore nulls) over (order by i rows between current row and unbounded following) as ns from j)
select time_group, kind, round(case when s is not null then s else ps + (ns-ps)*(i-pi)/(ni-pi) end, 6) as credits from p""")
def interpolated_periods(spark, d):
    return T.fill_periods(_sparse_hours(spark, d), "hourly", interpolate=True)


WEEKLY_DIGITS = 8  # two-row means of six-digit sums end in a half


@query("ta01_weekly_series", f"""
with week as (select date_trunc('week', START_TIME)::timestamp as time_group, count(*) as c, sum(CREDITS_USED) as s from facts group by 1),
n as (select *, row_number() over (order by time_group) as i, time_group as t from week),
x as (select time_group, c as query_count, round(s,6) as CREDITS_USED_sum, year(t) as year, month(t) as month, quarter(t) as quarter,
  {CALENDAR_COLS[CALENDAR_COLS.index("case month(t)"):]},
  {TREND}, {GROWTH}, {_averages('s', 'CREDITS_USED_sum', [2, 4, 8, 12, 26])},
  round(sin(2*pi()*weekofyear(t)/52),6)+0.0 as woy_sin, round(cos(2*pi()*weekofyear(t)/52),6)+0.0 as woy_cos,
  round(sin(2*pi()*month(t)/12),6)+0.0 as month_sin, round(cos(2*pi()*month(t)/12),6)+0.0 as month_cos,
  round(sin(2*pi()*quarter(t)/4),6)+0.0 as quarter_sin, round(cos(2*pi()*quarter(t)/4),6)+0.0 as quarter_cos
from n
window w as (order by time_group), w5 as (order by time_group rows between 4 preceding and current row),
  w12 as (order by time_group rows between 11 preceding and current row))
select time_group, season, coalesce(columns(* exclude (time_group, season)), 0) from x""".replace(", 6)", ", 8)").replace(",6)", ",8)"), digits=WEEKLY_DIGITS)
def weekly_series(spark, d):
    return T.aggregate_series(cost_facts(spark, d), "START_TIME", "weekly", {"CREDITS_USED": ["sum"]})


@query("ta11_prepared_log", """
select QUERY_ID, date_trunc('day', START_TIME)::timestamp as date, hour(START_TIME) as hour, isodow(START_TIME)-1 as day_of_week,
  month(START_TIME) as month, quarter(START_TIME) as quarter, 1 as query_count,
  round(coalesce(case when ROWS_PRODUCED % 5 = 0 then null else CREDITS_USED end, 0), 6) as CREDITS_USED,
  case when row_number() over (partition by USER_NAME order by START_TIME, QUERY_ID) = 1 then 1 else 0 end as session_count
from qlog""")
def prepared_log(spark, d):
    log = query_log(spark, d).withColumn(
        "CREDITS_USED", F.when(F.col("ROWS_PRODUCED") % 5 == 0, None).otherwise(F.col("CREDITS_USED")))
    out = T.prepare_log(log, metrics=["CREDITS_USED"], session="USER_NAME")
    return out.select("QUERY_ID", "date", "hour", "day_of_week", "month", "quarter", "query_count",
                      "CREDITS_USED", "session_count")


@query("ta13_summary_output", """
with day as (select date_trunc('day', START_TIME)::timestamp as time_group, count(*) as query_count, sum(CREDITS_USED) as CREDITS_USED_sum,
  max(CREDITS_USED) as CREDITS_USED_max from qlog group by 1)
select time_group, query_count, round(CREDITS_USED_sum,6) as CREDITS_USED_sum, 'temporal' as aggregation_type,
  timestamp '2024-02-01 00:00:00' as aggregation_timestamp, (select count(*) from day) as row_count from day""")
def summary_output(spark, d):
    daily = T.aggregate_periods(query_log(spark, d), "START_TIME", "daily", {"CREDITS_USED": ["sum", "max"]})
    return T.shape_output(daily, "temporal", "summary", "2024-02-01 00:00:00")


@query("ta14_validated_output", """
select 'daily' as table_name, count(*) as rows, 1 as not_empty, 0 as all_null_columns, 0 as negative_columns
from (select distinct date_trunc('day', START_TIME) from qlog)""")
def validated_output(spark, d):
    return T.validate_output(_daily(spark, d), "daily")
