"""Queries over forecasts, profiles and peaks."""

from pyspark.sql import functions as F

from tidewatch.operators import forecast as C
from tidewatch.operators.backtest import rolling_origin
from tidewatch.functions.expressions import period
from tidewatch.operators import usage as U
from tidewatch.plans.registry import query
from tidewatch.sources.tables import cost_facts, metric_points, query_log

START = "2024-02-01 00:00:00"


def _seconds():
    return F.col("EXECUTION_TIME_MS") / 100


def _daily(spark, d):
    return query_log(spark, d).groupBy("WAREHOUSE_NAME", period(F.col("START_TIME"), "day").alias("date")).agg(F.sum("CREDITS_USED").alias("value"))


def _hourly(spark, d):
    return query_log(spark, d).groupBy(period(F.col("START_TIME"), "hour").alias("hour")).agg(F.count("*").alias("n"))


DAILY = "dl as (select WAREHOUSE_NAME, date_trunc('day', START_TIME)::timestamp as date, sum(CREDITS_USED) as value from qlog group by 1, 2)"


@query("fc01_seasonal_forecast")
def seasonal_forecast(spark, d):
    return C.seasonal_forecast(_daily(spark, d), "WAREHOUSE_NAME", 14)


AR = DAILY + """, c as (select *, value - avg(value) over (partition by WAREHOUSE_NAME) as x0, avg(value) over (partition by WAREHOUSE_NAME) as m from dl), l as (select *, lag(x0) over w as x1, lag(x0,2) over w as x2 from c window w as (partition by WAREHOUSE_NAME order by date)),
p as (select WAREHOUSE_NAME, sum(x1*x1) as a, sum(x1*x2) as b, sum(x2*x2) as c, sum(x0*x1) as d, sum(x0*x2) as e, sum(x0*x0) as f, count(*) as n, max(m) as m, max_by(x0, date) as l1, max_by(x1, date) as l2, max(date) as ld from l where x2 is not null group by 1),
k as (select *, (d*c-e*b)/(a*c-b*b) as p1, (e*a-d*b)/(a*c-b*b) as p2 from p), s as (select *, sqrt(greatest((f-p1*d-p2*e)/n,0)) as sg from k)"""


@query("fc02_ar2_coefficients", f"with {AR} select WAREHOUSE_NAME, round(m,6) as mean, round(p1,6) as phi1, round(p2,6) as phi2, round(sg,6) as sigma, round(l1,6) as last1, round(l2,6) as last2, ld as last_date from s")
def ar2_coefficients(spark, d):
    return C.ar2_coefficients(_daily(spark, d), "WAREHOUSE_NAME")


@query("fc02_ar2_forecast", f"""with {AR}, h as (select WAREHOUSE_NAME, m, sg, ld, p1*l1+p2*l2 as y1, p1*(p1*l1+p2*l2)+p2*l1 as y2, p1*(p1*(p1*l1+p2*l2)+p2*l1)+p2*(p1*l1+p2*l2) as y3 from s), u as (select *, unnest([1,2,3]) as step, unnest([y1,y2,y3]) as y from h)
select WAREHOUSE_NAME, step, ld + step * interval 1 day as date, round(greatest(m+y,0),6) as predicted, round(greatest(greatest(m+y,0)-1.96*sg*sqrt(step),0),6) as lower, round(greatest(m+y,0)+1.96*sg*sqrt(step),6) as upper from u""")
def ar2_forecast(spark, d):
    return C.ar2_forecast(_daily(spark, d), "WAREHOUSE_NAME", 3)


@query("fc03_smoothing_forecast", f"""with {DAILY}, r as (select *, row_number() over (partition by WAREHOUSE_NAME order by date desc) as n from dl) select WAREHOUSE_NAME, round(sum(value*pow(0.8,n-1))/sum(pow(0.8,n-1)),6) as predicted from r where n <= 10 group by 1""")
def smoothing_forecast(spark, d):
    return C.smoothing_forecast(_daily(spark, d), "WAREHOUSE_NAME")


def _models(spark, d):
    """Simple model forecasts per day: the share of each query type, scaled to the day."""
    log = query_log(spark, d)
    y = F.sum("CREDITS_USED") * 5
    return log.groupBy(F.col("QUERY_TYPE").alias("model"), period(F.col("START_TIME"), "day").alias("date")).agg(
        y.alias("predicted"), (y * 0.85).alias("lower"), (y * 1.15).alias("upper"))


MODELS = """ms as (select QUERY_TYPE as model, date_trunc('day', START_TIME)::timestamp as date, sum(CREDITS_USED)*5 as predicted, sum(CREDITS_USED)*5*0.85 as lower, sum(CREDITS_USED)*5*1.15 as upper from qlog group by 1, 2),
ac as (select date_trunc('day', START_TIME)::timestamp as date, sum(CREDITS_USED) as actual from qlog group by 1),
er as (select model, avg(abs(actual-predicted)) as mae, avg(pow(actual-predicted,2)) as mse, sqrt(avg(pow(actual-predicted,2))) as rmse, avg(case when actual <> 0 then abs((actual-predicted)/actual) else 0 end)*100 as mape from ms join ac using (date) group by 1)"""


def _errors(spark, d):
    actual = query_log(spark, d).groupBy(period(F.col("START_TIME"), "day").alias("date")).agg(F.sum("CREDITS_USED").alias("actual"))
    return C.errors(_models(spark, d).join(actual, "date"), "actual", "predicted", ["model"])


@query("fc04_weighted_ensemble", f"with {MODELS}, w as (select ms.*, 1/greatest(mape,0.1) as w from ms join er using (model)) select date, round(sum(predicted*w)/sum(w),6) as predicted, round(sum(lower*w)/sum(w),6) as lower, round(sum(upper*w)/sum(w),6) as upper from w group by 1")
def weighted_ensemble(spark, d):
    return C.weighted_ensemble(_models(spark, d), _errors(spark, d).withColumn("error", F.col("mape")))


@query("fc05_votes", f"with {MODELS} select date, round(median(predicted),6) as median_vote, round(min(lower),6) as lower, round(max(upper),6) as upper, round(avg(predicted),6) as mean_vote from ms group by 1")
def votes(spark, d):
    return C.vote(_models(spark, d))


@query("fc06_model_consensus", f"""with {MODELS}, m as (select date, avg(predicted) as m, var_pop(predicted) as v from ms group by 1), a as (select date, avg(case when abs(predicted-m) <= abs(m)*0.1 then 1.0 else 0 end) as a, max(v) as v from ms join m using (date) group by 1), r as (select avg(v) as v, avg(a) as a from a)
select round(v,6) as prediction_variance, round(a,6) as agreement, case when a > 0.8 then 'strong' when a > 0.6 then 'moderate' else 'weak' end as strength from r""")
def model_consensus(spark, d):
    return C.model_consensus(_models(spark, d))


@query("fc07_errors", f"with {MODELS} select model, round(mae,6) as mae, round(mse,6) as mse, round(rmse,6) as rmse, round(mape,6) as mape from er")
def errors(spark, d):
    return _errors(spark, d)


@query("fc08_model_ranking", f"with {MODELS} select model, round(mape,6) as mape, row_number() over (order by mape, model) as rank from er")
def model_ranking(spark, d):
    return C.rank_models(_errors(spark, d).select("model", "mape"))


# --- the same, fed by forecasts that each model made from the days before ---

SERIES = "WAREHOUSE_NAME"


def _backtest(spark, d):
    return rolling_origin(_daily(spark, d), SERIES)


def _backtest_errors(spark, d):
    return C.errors(_backtest(spark, d), "actual", "predicted", [SERIES, "model"])


#: The check refits each model from all rows before each day.
BACKTEST = DAILY + """, o as (select *, datediff('day', date '2024-01-01', date::date)::double as t, isodow(date) as d, row_number() over w as i, lag(value) over w as y1, lag(value, 2) over w as y2 from dl window w as (partition by WAREHOUSE_NAME order by date)),
p as (select a.WAREHOUSE_NAME, a.i, x.t, x.d, x.value, x.y1, x.y2, x.i as j from o a join o x on x.WAREHOUSE_NAME = a.WAREHOUSE_NAME and x.i < a.i where a.i > 21),
wd as (select WAREHOUSE_NAME, i, d, avg(t) as mt, avg(value) as my from p group by 1, 2, 3),
sl as (select WAREHOUSE_NAME, i, coalesce(sum((t-mt)*(value-my))/nullif(sum((t-mt)*(t-mt)),0),0) as b from p join wd using (WAREHOUSE_NAME, i, d) group by 1, 2),
mn as (select WAREHOUSE_NAME, i, avg(value) as m from p group by 1, 2),
cr as (select WAREHOUSE_NAME, i, m, sum((y1-m)*(y1-m)) as a, sum((y1-m)*(y2-m)) as b, sum((y2-m)*(y2-m)) as c, sum((value-m)*(y1-m)) as d, sum((value-m)*(y2-m)) as e from p join mn using (WAREHOUSE_NAME, i) where y2 is not null group by 1, 2, 3),
sm as (select WAREHOUSE_NAME, i, sum(value*pow(0.8,i-j-1))/sum(pow(0.8,i-j-1)) as s from p where i-j <= 10 group by 1, 2),
f0 as (select o.WAREHOUSE_NAME, o.date, o.value as actual, o.i, coalesce(my + sl.b*(o.t-mt), m) as f1, m + (cr.d*cr.c-cr.e*cr.b)/(cr.a*cr.c-cr.b*cr.b)*(o.y1-m) + (cr.e*cr.a-cr.d*cr.b)/(cr.a*cr.c-cr.b*cr.b)*(o.y2-m) as f2, s as f3
 from o join sl using (WAREHOUSE_NAME, i) join cr using (WAREHOUSE_NAME, i) join sm using (WAREHOUSE_NAME, i) left join wd on wd.WAREHOUSE_NAME = o.WAREHOUSE_NAME and wd.i = o.i and wd.d = o.d),
f as (select WAREHOUSE_NAME, date, actual, unnest(['seasonal', 'ar2', 'smoothing']) as model, unnest([greatest(f1,0), greatest(f2,0), greatest(f3,0)]) as predicted from f0),
bt as (select *, greatest(predicted - 1.96::double*s, 0) as lower, predicted + 1.96::double*s as upper from (select *, sqrt(coalesce(avg((actual-predicted)*(actual-predicted)) over (partition by WAREHOUSE_NAME, model order by date rows between unbounded preceding and 1 preceding), 0)) as s from f)),
be as (select WAREHOUSE_NAME, model, avg(abs(actual-predicted)) as mae, avg(pow(actual-predicted,2)) as mse, sqrt(avg(pow(actual-predicted,2))) as rmse, avg(case when actual <> 0 then abs((actual-predicted)/actual) else 0 end)*100 as mape from bt group by 1, 2)"""


@query("fc01_backtest", f"with {BACKTEST} select WAREHOUSE_NAME, date, round(actual,6) as actual, model, round(predicted,6) as predicted, round(lower,6) as lower, round(upper,6) as upper from bt")
def backtest(spark, d):
    return _backtest(spark, d)


@query("fc04_backtest_ensemble", f"with {BACKTEST}, w as (select bt.*, 1/greatest(mape,0.1) as w from bt join be using (WAREHOUSE_NAME, model)) select WAREHOUSE_NAME, date, round(sum(predicted*w)/sum(w),6) as predicted, round(sum(lower*w)/sum(w),6) as lower, round(sum(upper*w)/sum(w),6) as upper from w group by 1, 2")
def backtest_ensemble(spark, d):
    return C.weighted_ensemble(_backtest(spark, d), _backtest_errors(spark, d).withColumn("error", F.col("mape")), [SERIES])


@query("fc05_backtest_votes", f"with {BACKTEST} select WAREHOUSE_NAME, date, round(median(predicted),6) as median_vote, round(min(lower),6) as lower, round(max(upper),6) as upper, round(avg(predicted),6) as mean_vote from bt group by 1, 2")
def backtest_votes(spark, d):
    return C.vote(_backtest(spark, d), [SERIES])


@query("fc06_backtest_consensus", f"""with {BACKTEST}, m as (select WAREHOUSE_NAME, date, avg(predicted) as m, var_pop(predicted) as v from bt group by 1, 2), a as (select WAREHOUSE_NAME, date, avg(case when abs(predicted-m) <= abs(m)*0.1 then 1.0 else 0 end) as a, max(v) as v from bt join m using (WAREHOUSE_NAME, date) group by 1, 2), r as (select WAREHOUSE_NAME, avg(v) as v, avg(a) as a from a group by 1)
select WAREHOUSE_NAME, round(v,6) as prediction_variance, round(a,6) as agreement, case when a > 0.8 then 'strong' when a > 0.6 then 'moderate' else 'weak' end as strength from r""")
def backtest_consensus(spark, d):
    return C.model_consensus(_backtest(spark, d), [SERIES])


@query("fc07_backtest_errors", f"with {BACKTEST} select WAREHOUSE_NAME, model, round(mae,6) as mae, round(mse,6) as mse, round(rmse,6) as rmse, round(mape,6) as mape from be")
def backtest_errors(spark, d):
    return _backtest_errors(spark, d)


@query("fc08_backtest_ranking", f"with {BACKTEST} select WAREHOUSE_NAME, model, round(mape,6) as mape, row_number() over (partition by WAREHOUSE_NAME order by mape, model) as rank from be")
def backtest_ranking(spark, d):
    return C.rank_models(_backtest_errors(spark, d).select(SERIES, "model", "mape"), [SERIES])


@query("fc21_backtest_correlation", f"with {BACKTEST} select WAREHOUSE_NAME, model, round(corr(actual,predicted),6) as correlation from bt group by 1, 2")
def backtest_correlation(spark, d):
    return C.fit_correlation(_backtest(spark, d), "actual", "predicted", [SERIES, "model"])


@query("fc09_horizons", f"with {DAILY}, l as (select WAREHOUSE_NAME, max(date) as l from dl group by 1) select WAREHOUSE_NAME, l + i * interval 7 day as date from l, range(1, 13) t(i)")
def horizons(spark, d):
    return C.horizon(_daily(spark, d).groupBy("WAREHOUSE_NAME").agg(F.max("date").alias("last_date")), "WAREHOUSE_NAME", "weekly")


HOURLY = "hr as (select date_trunc('hour', START_TIME)::timestamp as hour, count(*) as n from qlog group by 1)"
CLASS = "case when EXECUTION_TIME_MS/100 <= 10 then 'simple' when EXECUTION_TIME_MS/100 <= 60 then 'medium' when EXECUTION_TIME_MS/100 <= 300 then 'complex' else 'heavy' end"


@query("fc10_volume_patterns", f"with {HOURLY} select 'hourly' as pattern, hour(hour) as slot, round(avg(n),6) as mean_count from hr group by 2 union all select 'daily', isodow(hour)-1, round(avg(n),6) from hr group by 2")
def volume_patterns(spark, d):
    return C.volume_patterns(_hourly(spark, d))


@query("fc10_class_shares", f"select {CLASS} as complexity, count(*) as n, round(count(*)/(select count(*) from qlog),6) as share from qlog group by 1")
def class_shares(spark, d):
    return C.class_shares(query_log(spark, d), _seconds())


@query("fc11_weighted_load", f"""select date_trunc('hour', START_TIME)::timestamp as hour, count(*) as n, round(count(*)*avg(case {CLASS} when 'simple' then 1.0 when 'medium' then 2.5 when 'complex' then 5.0 else 10.0 end::double),6) as weighted_load from qlog group by 1""")
def weighted_load(spark, d):
    return C.weighted_load(query_log(spark, d), _seconds())


@query("fc12_class_entropy", f"with s as (select count(*)/(select count(*) from qlog) as p from qlog group by {CLASS}) select round(-sum(p*log2(p)),6) as entropy_bits from s")
def class_entropy(spark, d):
    return C.class_entropy(C.class_shares(query_log(spark, d), _seconds()))


@query("fc13_power_users", """with u as (select USER_NAME, count(*) as n, avg(CREDITS_USED) as m from facts group by 1) select USER_NAME, n as total_queries, round(m,6) as mean_credits, case when n > 2*(select avg(n) from u) then 1 else 0 end as is_power_user from u""")
def power_users(spark, d):
    return C.power_users(cost_facts(spark, d))


def _index(value, table, widen, top):
    clip = (lambda e: f"greatest(0, least({top}, {e}))") if top else (lambda e: f"greatest(0, {e})")
    return f"""ix as (select hour(hour) as h, avg({value}) as m from {table} group by 1), dx as (select isodow(hour)-1 as d, avg({value}) as m from {table} group by 1), sx as (select avg({value}) as m, stddev_pop({value}) as s, min(hour) as t0 from {table}),
g as (select timestamp '{START}' + i * interval 1 hour as hour from range(0, 48) t(i)),
y as (select g.hour, greatest(0, sx.m * ix.m/(select avg(m) from ix) * dx.m/(select avg(m) from dx) * (1 + 0.02*floor((epoch(g.hour)-epoch(t0))/86400)/30)) as y, sx.s as s from g join ix on ix.h = hour(g.hour) join dx on dx.d = isodow(g.hour)-1, sx),
fx as (select hour, {clip('y')} as predicted, {clip(f'y-1.96*{widen}*s')} as lower, {clip(f'y+1.96*{widen}*s')} as upper from y)"""


@query("fc14_index_forecast", f"with {HOURLY}, {_index('n', 'hr', 1.2, None)} select hour, round(predicted,6) as predicted, round(lower,6) as lower, round(upper,6) as upper from fx")
def index_forecast(spark, d):
    return C.index_forecast(_hourly(spark, d), 48, START)


@query("fc15_resource_need", f"with {HOURLY}, {_index('n', 'hr', 1.2, None)} select round(max(predicted),6) as peak_load, round(avg(predicted),6) as avg_load, round(greatest(max(predicted)/100,1),6) as compute_units, round(greatest(max(predicted)/50,1),6) as memory_units, case when max(predicted) > avg(predicted)*1.5 then 1 else 0 end as needs_scaling from fx")
def resource_need(spark, d):
    return C.resource_need(C.index_forecast(_hourly(spark, d), 48, START))


def _sessions(spark, d):
    s = U.session_statistics(query_log(spark, d), minutes=600, min_rows=1)
    return s.select(F.col("user_name").alias("USER_NAME"), F.col("session_start").alias("start"), F.col("query_count").alias("activity"), F.col("session_duration_minutes").alias("minutes"))


SESS = """g as (select *, case when (epoch_us(START_TIME)-epoch_us(lag(START_TIME) over w))/6e7 > 600 then 1 else 0 end as b from qlog window w as (partition by USER_NAME order by START_TIME, QUERY_ID)), s0 as (select *, sum(b) over (partition by USER_NAME order by START_TIME, QUERY_ID rows unbounded preceding) as sid from g),
se as (select USER_NAME, min(START_TIME) as start, count(*) as activity, (epoch_us(max(START_TIME))-epoch_us(min(START_TIME)))/6e7 as minutes from s0 group by USER_NAME, sid),
pr as (select USER_NAME, count(*) as total_sessions, cast(sum(activity) as bigint) as total_activity, avg(activity) as aa, avg(minutes) as am, count(distinct hour(start)) as hc, avg((activity < 10)::int) as l1, avg((activity >= 10 and activity < 50)::int) as l2, avg((minutes < 15)::int) as s1, avg((minutes >= 15 and minutes < 60)::int) as s2, avg((minutes >= 60 and minutes < 240)::int) as s3, avg((minutes >= 240)::int) as s4,
 list_sort(list(distinct hour(start))) as hs, list_sort(list(distinct isodow(start)-1)) as ds from se group by 1)"""


@query("fc16_user_profiles", f"""with {SESS} select USER_NAME, total_sessions, total_activity, round(aa,6) as avg_activity_per_session, round(am,6) as avg_session_minutes, round(l1,6) as low_share, round(l2,6) as medium_share, round(s1,6) as short_share, round(s2,6) as mid_share, round(s3,6) as long_share, round(s4,6) as extended_share, hc as active_hours_count from pr""")
def user_profiles(spark, d):
    return C.user_profiles(_sessions(spark, d)).drop("active_hours", "active_days", "high_share", "very_high_share")


@query("fc17_activity_patterns", f"with {SESS} select 'hourly' as pattern, hour(start) as slot, round(avg(activity),6) as mean_activity, count(distinct USER_NAME) as users from se group by 2 union all select 'daily', isodow(start)-1, round(avg(activity),6), count(distinct USER_NAME) from se group by 2")
def activity_patterns(spark, d):
    return C.activity_patterns(_sessions(spark, d))


@query("fc18_user_forecast", f"""with {SESS}, hx as (select hour(start) as h, avg(activity) as m from se group by 1), gr as (select timestamp '{START}' + i * interval 1 hour as hour from range(0, 24) t(i))
select USER_NAME, hour, round(case when list_contains(hs, hour(hour)) and list_contains(ds, isodow(hour)-1) then aa*coalesce((select m from hx where h = hour(gr.hour))/(select avg(m) from hx),1) else 0 end,6) as predicted from pr, gr""")
def user_forecast(spark, d):
    sessions = _sessions(spark, d)
    return C.user_forecast(C.user_profiles(sessions), C.activity_patterns(sessions), START, 24)


@query("fc19_user_types", f"with {SESS} select USER_NAME, case when aa > 50 and total_sessions > 20 and hc > 8 then 'power_user' when aa > 15 and total_sessions > 5 then 'regular_user' when total_sessions <= 5 or aa <= 15 then 'occasional_user' when hc <= 4 then 'specialized_user' else 'regular_user' end as user_type from pr")
def user_types(spark, d):
    return C.user_types(C.user_profiles(_sessions(spark, d)))


@query("fc20_churn_risk", f"""with {SESS}, r as (select *, (1-least(1,aa/50)+1-least(1,total_sessions/20)+1-least(1,hc/12))/3 as r from pr) select USER_NAME, round(case when total_sessions < 3 then least(1, r*1.5) else r end,3) as churn_risk from r""")
def churn_risk(spark, d):
    return C.churn_risk(C.user_profiles(_sessions(spark, d)))


@query("fc21_fit_correlation", f"with {MODELS} select round(corr(actual,predicted),6) as correlation from ms join ac using (date)")
def fit_correlation(spark, d):
    actual = query_log(spark, d).groupBy(period(F.col("START_TIME"), "day").alias("date")).agg(F.sum("CREDITS_USED").alias("actual"))
    return C.fit_correlation(_models(spark, d).join(actual, "date"), "actual", "predicted")


USED = "ut as (select date_trunc('hour', START_TIME)::timestamp as hour, least(sum(EXECUTION_TIME_MS)/1.2e6, 1.0) as utilization from qlog group by 1), cm as (select avg(utilization) as a, max(utilization) as mx, min(utilization) as mn, var_pop(utilization) as v, avg((utilization > 0.8)::int)*100 as o from ut)"


def _used(spark, d):
    return query_log(spark, d).groupBy(period(F.col("START_TIME"), "hour").alias("hour")).agg(F.least(F.sum("EXECUTION_TIME_MS") / 1.2e6, F.lit(1.0)).alias("utilization"))


@query("fc22_capacity_metrics", f"with {USED} select round(a,6) as avg_utilization, round(mx,6) as max_utilization, round(mn,6) as min_utilization, round(v,6) as utilization_variance, round(o,6) as over_threshold_pct from cm")
def capacity_metrics(spark, d):
    return C.capacity_metrics(_used(spark, d))


ACT = f"{USED}, {_index('utilization', 'ut', 1.5, 1.0)}, ax as (select *, case when predicted > 0.8 then 'scale_up' when predicted < 0.3 then 'scale_down' else 'maintain' end as action from fx)"


def _actions(spark, d):
    return C.scaling_actions(C.index_forecast(_used(spark, d), 48, START, "utilization", 1.0, 1.5))


@query("fc23_utilisation_forecast", f"with {ACT} select hour, round(predicted,6) as predicted, round(lower,6) as lower, round(upper,6) as upper, action from ax")
def utilisation_forecast(spark, d):
    return _actions(spark, d)


@query("fc24_scaling_summary", f"""with {ACT}, r as (select count(*) as hours, count(*) filter (action='scale_up') as u, count(*) filter (action='scale_down') as w, max(predicted) as p, min_by(hour, (-predicted, hour)) as ph from ax)
select hours, u as scale_up_hours, w as scale_down_hours, round(p,6) as peak, ph as peak_hour, case when u > hours*0.3 then 'upgrade' when w > hours*0.5 then 'downgrade' else 'keep' end as recommendation from r""")
def scaling_summary(spark, d):
    return C.scaling_summary(_actions(spark, d))


@query("fc25_efficiency", f"""with {USED}, e as (select 100*(1-abs(a-0.75)/0.75) as u, 100*(1-v) as s, 100*(1-o/100) as w, a from cm) select round((u+s+w)/3,6) as efficiency_score, round(u,6) as utilization_score, round(s,6) as stability_score, round(w,6) as availability_score,
 case when u < 50 then case when a < 0.5 then 'downsize' else 'upsize' end else 'keep' end as size_advice, case when s < 60 then 1 else 0 end as needs_auto_scaling from e""")
def efficiency(spark, d):
    return C.efficiency(C.capacity_metrics(_used(spark, d)))


def _load_points(spark, d):
    """Hourly totals per query type: peaks last several hours there."""
    return metric_points(spark, d).groupBy("metric", period(F.col("ts"), "hour").alias("ts")).agg(F.sum("value").alias("value"), F.min("point_id").alias("point_id"))


LP = "lp as (select metric, date_trunc('hour', ts)::timestamp as ts, sum(value) as value, min(point_id) as point_id from points group by 1, 2), ob as (select metric, value, row_number() over (partition by metric order by value)-1 as i, count(*) over (partition by metric) as n from lp)"
PB = "pb as (select metric, avg(value) as mean, stddev_pop(value) as std, max(value) as max, " + ", ".join(f"max(value) filter (i = floor(n*{p}::double)) as p{int(p*100)}" for p in (0.5, 0.75, 0.9, 0.95, 0.99)) + " from ob group by 1)"


@query("fc26_peak_baselines", f"with {LP}, {PB} select metric, round(mean,6) as mean, round(std,6) as std, round(max,6) as max, {', '.join(f'round(p{p},6) as value_p{p}' for p in (50, 75, 90, 95, 99))} from pb")
def peak_baselines(spark, d):
    return C.peak_baselines(_load_points(spark, d))


PK = f"""{LP}, {PB}, hv as (select lp.*, value >= p90 as hi, mean, lag(value >= p90) over (partition by metric order by ts) as was from lp join pb using (metric)), rn as (select *, sum((hi and not coalesce(was,false))::int) over (partition by metric order by ts) as run from hv),
pk as (select metric, run, min(ts) filter (hi) as start_time, max(ts) as end_time, max(value) filter (hi) as peak_value, min_by(ts, (-value, ts)) filter (hi) as peak_time, avg(value) filter (hi) as avg_value, max(mean) as mean from rn where hi or was group by 1, 2),
px as (select *, (epoch(end_time)-epoch(start_time))/3600 as duration_hours, peak_value/mean as intensity from pk where (epoch(end_time)-epoch(start_time))/3600 >= 2)"""


@query("fc27_peaks", f"with {PK} select metric, start_time, end_time, round(peak_value,6) as peak_value, peak_time, round(avg_value,6) as avg_value, round(duration_hours,6) as duration_hours, round(intensity,6) as intensity, case when intensity < 1 then 'extreme' when intensity < 2 then 'moderate' when intensity < 3 then 'high' when intensity < 5 then 'severe' else 'extreme' end as type from px")
def peaks(spark, d):
    return C.peaks(_load_points(spark, d))


@query("fc28_peak_shares", f"with {PK} select 'hourly' as pattern, hour(start_time) as slot, count(*) as peaks, round(count(*)/(select count(*) from px),6) as share from px group by 2 union all select 'daily', isodow(start_time)-1, count(*), round(count(*)/(select count(*) from px),6) from px group by 2")
def peak_shares(spark, d):
    return C.peak_shares(C.peaks(_load_points(spark, d)))


@query("fc30_peak_summary", f"""with {PK} select count(*) as total_peaks, round(count(*)/greatest(floor((epoch(max(start_time))-epoch(min(start_time)))/86400),1),6) as peaks_per_day, round(avg(intensity),6) as avg_intensity, round(max(intensity),6) as max_intensity, round(stddev_pop(intensity),6) as intensity_std,
 round(avg(duration_hours),6) as avg_duration, round(max(duration_hours),6) as max_duration, round(min(duration_hours),6) as min_duration, round(stddev_pop(duration_hours),6) as duration_std from px""")
def peak_summary(spark, d):
    return C.peak_summary(C.peaks(_load_points(spark, d)))


@query("fc29_peak_forecast", f"""with {PK}, hs as (select hour(start_time) as h, count(*)/(select count(*) from px) as s from px group by 1), ds as (select isodow(start_time)-1 as d, count(*)/(select count(*) from px) as s from px group by 1), gr as (select timestamp '{START}' + i * interval 1 hour as hour from range(0, 48) t(i)),
p as (select hour, least((coalesce(hs.s,0)+coalesce(ds.s,0))/2,1) as p from gr left join hs on hs.h = hour(gr.hour) left join ds on ds.d = isodow(gr.hour)-1) select hour, round(p,6) as probability, case when p > 0.5 then 1 else 0 end as is_peak, case when p > 0.5 then 'high' when p > 0.2 then 'medium' else 'low' end as risk from p""")
def peak_forecast(spark, d):
    return C.peak_forecast(C.peak_shares(C.peaks(_load_points(spark, d))), START, 48)


@query("fc31_combined_recommendations", f"""with {HOURLY}, {_index('n', 'hr', 1.2, None)}, rn as (select case when max(predicted) > avg(predicted)*1.5 then 1 else 0 end as s from fx), r as (select 'volume' as source, case when s = 1 then 'scale_for_peak' else 'keep_capacity' end as recommendation, case when s = 1 then 2 else 0 end as p from rn
 union all select 'utilization', rec, case rec when 'upgrade' then 2 when 'downgrade' then 1 else 0 end from (with {ACT.replace('fx as', 'fy as').replace('from fx)', 'from fy)')} select case when count(*) filter (action='scale_up') > count(*)*0.3 then 'upgrade' when count(*) filter (action='scale_down') > count(*)*0.5 then 'downgrade' else 'keep' end as rec from ax)
 union all select 'peaks', case when n > 0 then 'prepare_for_peaks' else 'no_peak_expected' end, case when n > 5 then 2 when n > 0 then 1 else 0 end from (with {PK}, hs as (select hour(start_time) as h, count(*)/(select count(*) from px) as s from px group by 1), ds as (select isodow(start_time)-1 as d, count(*)/(select count(*) from px) as s from px group by 1),
 gr as (select timestamp '{START}' + i * interval 1 hour as hour from range(0, 48) t(i)) select count(*) filter (least((coalesce(hs.s,0)+coalesce(ds.s,0))/2,1) > 0.5) as n from gr left join hs on hs.h = hour(gr.hour) left join ds on ds.d = isodow(gr.hour)-1))
select source, recommendation, ['low','medium','high'][p+1] as priority from r union all select 'overall', 'risk', ['low','medium','high'][max(p)+1] from r""")
def combined_recommendations(spark, d):
    need = C.resource_need(C.index_forecast(_hourly(spark, d), 48, START))
    peak = C.peak_forecast(C.peak_shares(C.peaks(_load_points(spark, d))), START, 48)
    return C.combined_recommendations(need, C.scaling_summary(_actions(spark, d)), peak)
