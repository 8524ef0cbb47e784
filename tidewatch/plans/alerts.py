"""Queries over alerting."""

from pyspark.sql import functions as F

from tidewatch.operators import alerts as L
from tidewatch.plans.registry import query
from tidewatch.session import scratch_path
from tidewatch.sources.tables import metering_history, metric_points, query_log, table
from tidewatch.streaming import monitors as M

AS_OF = "2024-01-20 12:00:00"


def rng(s):
    return f"partition by metric order by epoch_us(ts) range between {s * 1000000} preceding and current row"


def sev(x, a, b, c, op=">="):
    return f"case when {x} {op} {a} then 'critical' when {x} {op} {b} then 'high' when {x} {op} {c} then 'medium' else 'low' end"


def _limits(spark, d):
    """Threshold table: mean times 2 per metric, over and under."""
    stats = metric_points(spark, d).groupBy("metric").agg(F.avg("value").alias("m"))
    return stats.select("metric", F.explode(F.array(
        F.struct(F.lit("over").alias("threshold_id"), F.lit(">").alias("op"), F.round(F.col("m") * 2, 3).alias("limit")),
        F.struct(F.lit("under").alias("threshold_id"), F.lit("<=").alias("op"), F.lit(1.0).alias("limit")))).alias("t")).select("metric", "t.*")


DISORDER = "1 hour"


def _closed_points(spark, d):
    return M.closed(M.event_points(spark, d), d, scratch_path(spark))


def _emitted(stream, *times):
    """What a bounded stream has appended, without its closing row."""
    spark, out = stream.sparkSession, scratch_path(stream.sparkSession)
    M.run_to_end(stream, f"{out}/rows", f"{out}/state")
    rows = spark.read.schema(stream.schema).parquet(f"{out}/rows").filter(F.col("metric") != M.CLOSING)
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in times})


EXCEEDED = """vx as (select p.*, threshold_id, op, "limit" from points p join tl using (metric) where (op = '>' and value > "limit") or (op = '<=' and value <= "limit"))"""
LIMITS = """tl as (select metric, 'over' as threshold_id, '>' as op, round(avg(value)*2,3) as "limit" from points group by 1 union all select distinct metric, 'under', '<=', 1.0 from points)"""


@query("al01_window_statistics", f"select metric, ts, value, point_id, count(value) over w as window_count, round(avg(value) over w,6) as window_mean, min(value) over w as window_min, max(value) over w as window_max, value as window_latest from points window w as ({rng(3600)})")
def window_statistics(spark, d):
    return L.window_statistics(metric_points(spark, d), 3600)


@query("al01_stream_windows", """with w as (select metric, ts, point_id, value, date_trunc('hour', ts)::timestamp - i * interval 1 hour as window_start from points, range(0, 3) t(i))
select metric, window_start, count(*) as points, round(avg(value),6) as mean, min(value) as min, max(value) as max, arg_max(value, (ts, point_id)) as latest from w group by 1, 2""")
def stream_windows(spark, d):
    windows = M.sliding_statistics(_closed_points(spark, d), "3 hours", "1 hour", DISORDER)
    return _emitted(windows, "window_start")


@query("al01_stream_sessions", """with p as (select *, ts - lag(ts) over (partition by metric order by ts, point_id) >= interval 20 minutes as far from points),
s as (select *, count(*) filter (far) over (partition by metric order by ts, point_id) as n from p)
select metric, min(ts) as session_start, max(ts) + interval 20 minutes as session_end, count(*) as points, round(sum(value),6) as total from s group by metric, n""")
def stream_sessions(spark, d):
    return _emitted(M.sessions(_closed_points(spark, d), gap="20 minutes", late=DISORDER), "session_start", "session_end")


@query("al03_stream_violations", f"""with {LIMITS}, {EXCEEDED} select metric, ts, value, point_id, threshold_id, op, "limit" from vx""")
def stream_violations(spark, d):
    hits = M.threshold_violations(M.event_points(spark, d), _limits(spark, d))
    return _emitted(hits.select("metric", "ts", "value", "point_id", "threshold_id", "op", "limit"), "ts")


@query("al08_stream_distinct", "select metric, ts, value, point_id from points")
def stream_distinct(spark, d):
    """Every event arrives twice and leaves once."""
    twice = M.event_points(spark, d).withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    return _emitted(M.deduplicated(twice, ["point_id"], DISORDER), "ts")


@query("al02_window_anomalies", f"""with x as (select *, count(value) over w as n, avg(value) over w as m, stddev_pop(value) over w as s from points window w as ({rng(14400)})) select metric, ts, value, point_id, round(m,6) as window_mean, round(s,6) as window_std, round(abs(value-m)/s,6) as deviation,
 {sev('abs(value-m)/s', 4, 3, 2, '>')} as severity from x where n > 5 and s > 0 and abs(value-m)/s > 2""")
def window_anomalies(spark, d):
    return L.window_anomalies(metric_points(spark, d), 14400)


EXC = """case when op = '>' then (value-"limit")/"limit" else ("limit"-value)/"limit" end"""
VIOL = f"""vl as (select p.*, threshold_id, op, "limit", {sev(EXC, 1, 0.5, 0.2)} as severity from points p join tl using (metric) where (op = '>' and value > "limit") or (op = '<=' and value <= "limit" + 1e-9))"""


@query("al03_threshold_violations", f"""with {LIMITS}, {VIOL} select metric, ts, value, point_id, threshold_id, op, "limit", severity from vl""")
def threshold_violations(spark, d):
    return L.check_thresholds(metric_points(spark, d), _limits(spark, d))


@query("al04_dynamic_limits", f"select metric, ts, value, point_id, round(least(greatest(avg(value) over w * 1.2, 10), 100),6) as dynamic_limit from points window w as ({rng(3600)})")
def dynamic_limits(spark, d):
    return L.dynamic_limits(metric_points(spark, d), 0.2, 10, 100)


@query("al05_adaptive_limits", f"select metric, ts, value, point_id, round(case when count(value) over w >= 4 then avg(value) over w + 2*stddev_samp(value) over w else 80 end,6) as adaptive_limit from points window w as ({rng(3600)})")
def adaptive_limits(spark, d):
    return L.adaptive_limits(metric_points(spark, d), 80.0, 2.0, 4)


@query("al06_percentile_limits", f"""with x as (select *, list_sort(list(value) over w) as v from points window w as ({rng(3600)})), y as (select *, len(v) as n, least(greatest((len(v)+1)*0.75::double,1),len(v)) as q from x)
select metric, ts, value, point_id, round(case when n >= 4 then v[floor(q)::int] + (v[ceil(q)::int]-v[floor(q)::int])*(q-floor(q)) else 5 end,6) as percentile_limit from y""")
def percentile_limits(spark, d):
    return L.percentile_limits(metric_points(spark, d), 0.75, 5.0, 4)


@query("al07_adapted_limits", f"""with {LIMITS}, s as (select metric, avg(value)+2*stddev_samp(value) as n from points group by 1) select metric, threshold_id, op, round(case when abs(n-"limit")/abs("limit") > 0.1 then n else "limit" end,6) as "limit", case when abs(n-"limit")/abs("limit") > 0.1 then 1 else 0 end as is_adapted from tl join s using (metric)""")
def adapted_limits(spark, d):
    return L.adapt_limits(_limits(spark, d), metric_points(spark, d))


def exq(p):
    return f"(v[floor(least(greatest((n+1)*{p}::double,1),n))::int] + (v[ceil(least(greatest((n+1)*{p}::double,1),n))::int]-v[floor(least(greatest((n+1)*{p}::double,1),n))::int])*(least(greatest((n+1)*{p}::double,1),n)-floor(least(greatest((n+1)*{p}::double,1),n))))"


@query("al08_metric_statistics", f"""with x as (select metric, count(*) as n, avg(value) as m, min(value) as mn, max(value) as mx, stddev_samp(value) as s, list_sort(list(value)) as v from points group by 1)
select metric, n as points, round(m,6) as mean, mn as min, mx as max, round(s,6) as std, round({exq(0.5)},6) as value_p50, round({exq(0.95)},6) as value_p95, round({exq(0.99)},6) as value_p99 from x""")
def metric_statistics(spark, d):
    return L.metric_statistics(metric_points(spark, d))


def _history(spark, d):
    return L.spend_history(metering_history(spark, d).withColumn("COST_USD", F.col("CREDITS_USED") * 3))


HIST = "sh as (select date_trunc('day', START_TIME)::timestamp as date, SERVICE_TYPE as cost_type, sum(CREDITS_USED*3) as spend from metering group by 1, 2 union all select date_trunc('day', START_TIME)::timestamp, 'total', sum(CREDITS_USED*3) from metering group by 1)"


def _budgets(spark, d):
    """Budgets from the data: the mean day and its multiples."""
    mean = _history(spark, d).filter("cost_type = 'total'").agg(F.round(F.avg("spend"), 2).alias("m"))
    return mean.select(F.explode(F.array(*[F.struct(F.lit(f"b_{p}").alias("budget_id"), F.lit(p).alias("period"), (F.col("m") * k).alias("amount"))
                                           for p, k in (("daily", 1.0), ("weekly", 9.0), ("monthly", 30.0), ("yearly", 365.0))])).alias("b")).select("b.*")


USE = HIST + f""", bm as (select round(avg(spend),2) as m from sh where cost_type = 'total'), bt as (select unnest(['daily','weekly','monthly','yearly']) as period, unnest([1,9,30,365])::double as k, m from bm),
bu as (select 'b_' || period as budget_id, period, m*k as amount, coalesce((select sum(spend) from sh where cost_type='total' and date <= timestamp '{AS_OF}' and date >= case bt.period when 'daily' then timestamp '2024-01-20' when 'weekly' then timestamp '2024-01-13' else timestamp '2024-01-01' end),0) as spend from bt)"""


@query("al09_budget_use", f"with {USE} select budget_id, period, round(amount,6) as amount, round(spend,6) as spend, round(spend/amount*100,6) as spend_percentage from bu")
def budget_use(spark, d):
    return L.budget_use(_history(spark, d), _budgets(spark, d), AS_OF)


@query("al10_budget_alerts", f"with {USE}, l as (select *, unnest([25,50,80,90])::double as level from bu) select budget_id, period, round(amount,6) as amount, round(spend,6) as spend, round(spend/amount*100,6) as spend_percentage, level, {sev('level/100', 0.9, 0.8, 0.5)} as severity from l where spend/amount*100 >= level")
def budget_alerts(spark, d):
    return L.budget_alerts(L.budget_use(_history(spark, d), _budgets(spark, d), AS_OF), (25, 50, 80, 90))


@query("al11_spend_history", f"with {HIST} select date, cost_type, round(spend,6) as spend from sh")
def spend_history(spark, d):
    return _history(spark, d)


@query("al11_spend_trend", f"with {HIST}, g as (select timestamp '2024-01-20' - i * interval 1 day as date from range(0, 30) t(i)) select g.date, round(coalesce(spend,0),6) as spend from g left join (select * from sh where cost_type='total') s on s.date = g.date")
def spend_trend(spark, d):
    return L.spend_trend(_history(spark, d), AS_OF)


@query("al12_threshold_counts", f"with {LIMITS}, {VIOL} select metric, threshold_id, severity, count(*) as violations from vl group by 1, 2, 3")
def threshold_counts(spark, d):
    rows = L.check_thresholds(metric_points(spark, d), _limits(spark, d))
    return rows.groupBy("metric", "threshold_id", "severity").agg(F.count("*").alias("violations"))


OW = "partition by metric order by ts, point_id"
EMA = f"""with recursive o as (select *, row_number() over ({OW}) as i from points), e as (select metric, ts, value, point_id, i, value as baseline from o where i = 1 union all select o.metric, o.ts, o.value, o.point_id, o.i, 0.1*o.value + 0.9*e.baseline from e join o on o.metric = e.metric and o.i = e.i + 1)"""


@query("al14_recursive_means", EMA + " select metric, ts, value, point_id, round(baseline,6) as baseline from e")
def recursive_means(spark, d):
    return L.recursive_mean(metric_points(spark, d))


@query("al15_usage_patterns", f"""with b as (select *, avg(value) over ({OW} rows between 5 preceding and 1 preceding) as bf, min(value) over ({OW} rows 4 preceding) as l5, count(value) over ({OW} rows 4 preceding) as n5, count(value) over w as n, avg(value) over w as m, stddev_pop(value) over w as s,
 case when count(value) over w >= 2 then regr_slope(value, epoch_us(ts)/1e6-1700000000) over w end as sl from points window w as ({rng(3600)}))
select metric, ts, value, point_id, case when n >= 10 and value > 2*bf then 1 else 0 end as is_spike, case when n >= 2 and sl > 0 and sl*60/m > 0.1 then 1 else 0 end as is_gradual_increase, case when n >= 15 and s/m > 0.5 then 1 else 0 end as is_oscillating, case when n5 = 5 and l5 > 90 then 1 else 0 end as is_exhausted from b""")
def usage_patterns(spark, d):
    return L.usage_patterns(metric_points(spark, d))


@query("al19_usage_summary", "select metric, count(*) as points, round(avg(value),6) as mean, max(value) as max, arg_max(value, (ts, point_id)) as latest, max(ts) as last_seen, round(arg_max(value, (ts, point_id))/avg(value),6) as latest_vs_mean from points group by 1")
def usage_summary(spark, d):
    return L.usage_summary(metric_points(spark, d))


@query("al20_sla_breaches", f"with t as (select metric, round(avg(value),2) as target from points group by 1) select p.metric, ts, value, point_id, target, round(value/target,6) as ratio, {sev('value/target', 3, 2, 1.5)} as severity from points p join t using (metric) where value > target*(1+0.1::double)")
def sla_breaches(spark, d):
    points = metric_points(spark, d)
    return L.sla_breaches(points, points.groupBy("metric").agg(F.round(F.avg("value"), 2).alias("target")))


@query("al21_index_percentiles", f"""with x as (select *, list_sort(list(value) over w) as v from points window w as ({rng(3600)})) select metric, ts, value, point_id, case when len(v) > 10 then v[least(floor(len(v)*0.95::double),len(v)-1)::int+1] end as p95, case when len(v) > 10 then v[least(floor(len(v)*0.99::double),len(v)-1)::int+1] end as p99 from x""")
def index_percentiles(spark, d):
    return L.index_percentiles(metric_points(spark, d))


@query("al22_degradation", EMA + f" select metric, ts, value, point_id, round(baseline,6) as baseline, round((value-baseline)/baseline,6) as degradation, {sev('(value-baseline)/baseline', 1, 0.5, 0.3)} as severity from e where (value-baseline)/baseline > 0.2")
def degradation(spark, d):
    return L.degradation(metric_points(spark, d))


TREND = f"""with x as (select metric, value, row_number() over ({OW})-1 as i from points where ts > timestamp '{AS_OF}' - interval 1 hour and ts <= timestamp '{AS_OF}'), r as (select metric, count(*) as n, regr_slope(value,i) as s, regr_intercept(value,i) as c, regr_r2(value,i) as r from x group by 1 having count(*) >= 2)"""


@query("al23_trends", TREND + " select metric, n as points, round(s,6) as slope, round(c,6) as intercept, round(r,6) as r_squared, case when abs(s) < 0.01 then 'stable' when s > 0 then 'increasing' else 'decreasing' end as direction, case when abs(s) > 0.1 and r > 0.7 then 1 else 0 end as is_alert from r")
def trends(spark, d):
    return L.trends(metric_points(spark, d), AS_OF).filter("points >= 2")


@query("al24_performance_summary", TREND + """, u as (select metric, count(*) as points, avg(value) as m from points group by 1) select u.metric, u.points, round(m,6) as mean, round(s,6) as slope from u left join r using (metric)""")
def performance_summary(spark, d):
    points = metric_points(spark, d)
    t = L.trends(points, AS_OF).filter("points >= 2").select("metric", "slope")
    return L.usage_summary(points).select("metric", "points", "mean").join(t, "metric", "left")


def _window(s):
    return f"""(select metric, {s} as seconds, arg_max(value, (ts, point_id)) as latest, avg(value) as avg, max(value) as max, min(value) as min, sum(value) as sum, count(*)::double as count, coalesce(stddev_samp(value),0) as std, coalesce(var_samp(value),0) as variance, arg_min(value, (ts, point_id)) as first,
 (epoch_us(max(ts))-epoch_us(min(ts)))/1e6 as span, list_sort(list(value)) as v, count(*) as n, list(value order by ts, point_id) as seq from points where ts <= timestamp '{AS_OF}' and ts >= timestamp '{AS_OF}' - interval {s} second group by 1)"""


AGG = f"wa as (select * from {_window(3600)} union all select * from {_window(14400)})"
Z = "case when n >= 3 then abs(latest - list_avg(seq[1:n-1]))/list_stddev_samp(seq[1:n-1]) else 0 end"
ROWS = f"""wx as (select *, {exq(0.5)} as median, {exq(0.95)} as p95, {exq(0.99)} as p99, case when n >= 2 and span > 0 then (latest-"first")/span else 0 end as rate, case when n >= 2 then latest-"first" else 0 end as delta, {Z} as anomaly_score from wa)"""
A15 = ("latest", "avg", "max", "min", "sum", "count", "median", "std", "variance", "p95", "p99", "first", "rate", "delta", "anomaly_score")


@query("al25_window_aggregates", f"""with {AGG}, {ROWS} select metric, seconds, {', '.join(f'round("{a}",6) as "{a}"' for a in A15)} from wx where metric in ('view','click')""")
def window_aggregates(spark, d):
    return L.window_aggregates(metric_points(spark, d), [(m, s) for m in ("view", "click") for s in (3600, 14400)], AS_OF)


C1, C2, C3, C4 = (L.Condition("view", "avg", ">", 40.0, 14400), L.Condition("click", "max", "<", 100.0, 14400), L.Condition("error", "count", ">=", 3.0, 3600), L.Condition("absent", "latest", ">", 0.0, 300))
CONDS = """cn as (select 0 as condition_id, 'view' as metric, 14400 as seconds, 'avg' as aggregation, '>' as op, 40.0::double as threshold, (select "avg" from wx where metric='view' and seconds=14400) as current union all select 1, 'click', 14400, 'max', '<', 100.0, (select "max" from wx where metric='click' and seconds=14400)
 union all select 2, 'error', 3600, 'count', '>=', 3.0, (select "count" from wx where metric='error' and seconds=3600) union all select 3, 'absent', 300, 'latest', '>', 0.0, null),
cx as (select *, case when coalesce(case op when '>' then current > threshold when '<' then current < threshold else current >= threshold end, false) then 1 else 0 end as is_met from cn)"""


@query("al27_conditions", f"with {AGG}, {ROWS}, {CONDS} select condition_id, metric, seconds, aggregation, op, threshold, round(current,6) as current, is_met from cx")
def conditions(spark, d):
    return L.evaluate_conditions(metric_points(spark, d), [C1, C2, C3, C4], AS_OF)


def _rules():
    return [L.composite_rule("all", [C1, C2]), L.composite_rule("any", [C1, C3, C4], "OR"), L.Rule("none", L.Group("NOT", (C2, C4))), L.Rule("empty", L.Group("AND", ())),
            L.Rule("nested", L.Group("AND", (L.Group("OR", (C1, C3)), L.Group("NOT", (C4,)))), "critical")]


@query("al29_rules", f"""with {AGG}, {ROWS}, {CONDS}, m as (select max(is_met) filter (condition_id=0)=1 as c1, max(is_met) filter (condition_id=1)=1 as c2, max(is_met) filter (condition_id=2)=1 as c3, max(is_met) filter (condition_id=3)=1 as c4 from cx)
select 'all' as rule_id, 'high' as severity, (c1 and c2)::int as is_triggered from m union all select 'any', 'high', (c1 or c3 or c4)::int from m union all select 'none', 'medium', (not (c2 and c4))::int from m union all select 'empty', 'medium', 0 union all select 'nested', 'critical', ((c1 or c3) and not c4)::int from m""")
def rules(spark, d):
    return L.evaluate_rules(metric_points(spark, d), _rules(), AS_OF)


def _hits(spark, d):
    points = metric_points(spark, d)
    table_ = points.select("metric").distinct().select(F.col("metric").alias("rule_id"), "metric", F.lit(">").alias("op"), F.lit(50.0).alias("limit"))
    return L.minute_hits(points, table_)


FIRED = """with recursive h as (select metric as rule_id, date_trunc('minute', ts)::timestamp as minute from points group by 1, 2 having avg(value) > 50), o as (select *, row_number() over (partition by rule_id order by minute) as i from h),
f as (select rule_id, minute, i, minute as last, true as ok from o where i = 1 union all select o.rule_id, o.minute, o.i, case when o.minute >= f.last + interval 2 hour then o.minute else f.last end, o.minute >= f.last + interval 2 hour from f join o on o.rule_id = f.rule_id and o.i = f.i + 1)"""


@query("al30_fired", FIRED + " select rule_id, minute from f where ok")
def fired(spark, d):
    return L.fired(_hits(spark, d), 7200, 10)


@query("al30_stream_cooldown", """with recursive h as (select *, row_number() over (partition by metric order by ts, value) as n from points where value > 50),
f as (select metric, ts, value, n, ts as last, true as ok from h where n = 1 union all
 select h.metric, h.ts, h.value, h.n, case when h.ts - f.last >= interval 2 hours then h.ts else f.last end, h.ts - f.last >= interval 2 hours from f join h on h.metric = f.metric and h.n = f.n + 1)
select metric, ts, value from f where ok""")
def stream_cooldown(spark, d):
    return _emitted(M.cooled_alerts(_closed_points(spark, d).filter("value > 50"), 7200, DISORDER), "ts")


@query("al31_rule_statistics", FIRED + " select rule_id, count(*) as evaluations_met, count(*) filter (ok) as fired, max(minute) filter (ok) as last_fired, round(count(*) filter (ok)/count(*),6) as fire_rate from f group by 1")
def rule_statistics(spark, d):
    hits = _hits(spark, d)
    return L.rule_statistics(hits, L.fired(hits, 7200, 10))


@query("al32_dynamic_severity")
def dynamic_severity(spark, d):
    return L.dynamic_severity(metric_points(spark, d), [r for r in _rules() if r.tree.parts], AS_OF)


@query("al33_severity_distribution")
def severity_distribution(spark, d):
    return dynamic_severity(spark, d).groupBy("level").agg(F.count("*").alias("rules"))


AGG34 = "wa as (" + " union all ".join(f"select * from {_window(s)}" for s in (300, 900, 3600, 14400)) + ")"
PREDICTED = f"""hm as (select metric, date_trunc('hour', ts) as date, avg(value) as value from points where ts <= timestamp '{AS_OF}' group by 1, 2),
hr as (select *, row_number() over (partition by metric order by date desc) as n from hm), pr as (select metric, sum(value*pow(0.8,n-1))/sum(pow(0.8,n-1)) as predicted from hr where n <= 10 group by 1)"""


def _met(metric, seconds, test):
    return f"coalesce((select {test} from wx where metric = '{metric}' and seconds = {seconds}), false)::int"


@query("al34_templates", f"""with {AGG34}, {ROWS}, {PREDICTED} select 'cost' as rule_id, 'high' as severity, {_met('purchase', 300, 'latest > 80')} as is_triggered
union all select 'slow', 'medium', {_met('view', 14400, '"avg" > 20 and p95 > 30')} union all select 'odd', 'high', {_met('click', 14400, 'anomaly_score > 2')}
union all select 'soon', 'medium', coalesce((select predicted > 10 from pr where metric = 'view'), false)::int union all select 'later', 'medium', coalesce((select predicted > 1000 from pr where metric = 'view'), false)::int
union all select 'rate', 'medium', {_met('error', 900, 'rate > 0.1 or "std" > 30')} union all select 'spend_medium', 'medium', {_met('signup', 300, 'latest > 20')} union all select 'spend_critical', 'critical', {_met('signup', 300, 'latest > 90')}
union all select 'both', 'high', {_met('view', 14400, '"avg" > 40')} * {_met('click', 14400, '"max" < 100')}
union all select 'either', 'high', greatest({_met('view', 14400, '"avg" > 40')}, {_met('error', 3600, '"count" >= 3')})""")
def templates(spark, d):
    points = metric_points(spark, d)
    made = [L.cost_threshold_rule("cost", "purchase", 80.0), L.degradation_rule("slow", "view", 20.0, 14400), L.anomaly_rule("odd", "click", 2.0, 14400),
            L.predictive_rule("soon", "view", 10.0), L.predictive_rule("later", "view", 1000.0), L.pattern_rule("rate", "error", 0.1, 30.0),
            *L.escalating_rules("spend", "signup", {"medium": 20.0, "critical": 90.0}), L.composite_rule("both", [C1, C2]), L.composite_rule("either", [C1, C3], "OR")]
    return L.evaluate_rules(points.unionByName(L.predicted_points(points, AS_OF)), made, AS_OF)


def _audit(spark, d):
    # a number is left out after every 60 events
    e = table(spark, d, "events")
    log = e.select((F.col("event_id") + F.floor(F.col("event_id") / 60)).alias("sequence"), F.col("ts").alias("at"), "event_type", F.concat(F.lit("U"), (F.col("user_id") % 20).cast("string")).alias("user_id"),
                   F.when(F.col("event_type") == "error", "high").otherwise("low").alias("severity"), F.concat(F.lit("/r"), (F.col("user_id") % 7).cast("string")).alias("resource"),
                   F.when((F.col("event_type") == "error") & (F.col("user_id") % 3 == 0), "failure").otherwise("success").alias("outcome"))
    return log.withColumn("hash", F.when(F.col("sequence") % 500 == 1, "tampered").otherwise(L.record_hash()))


AUDIT = """au as (select event_id + event_id // 60 as sequence, ts as "at", event_type, 'U' || (user_id % 20) as user_id, case when event_type='error' then 'high' else 'low' end as severity, '/r' || (user_id % 7) as resource, case when event_type='error' and user_id % 3 = 0 then 'failure' else 'success' end as outcome from events)"""


@query("al35_audit_search", f"""with {AUDIT} select sequence, "at", event_type, user_id, severity, resource, outcome from au where "at" >= timestamp '2024-01-05 00:00:00' and "at" <= timestamp '2024-01-20 00:00:00' and event_type in ('error','click') and user_id = 'U3' order by "at" desc, sequence limit 50""")
def audit_search(spark, d):
    return L.search_events(_audit(spark, d), "2024-01-05 00:00:00", "2024-01-20 00:00:00", ["error", "click"], "U3", limit=50).drop("hash")


@query("al36_audit_report", f"""with {AUDIT} select 'event_type' as section, event_type as name, count(*) as events from au group by 2 union all select 'severity', severity, count(*) from au group by 2 union all select 'user_event', user_id || ':' || event_type, count(*) from au group by 2
 union all select 'resource', resource, count(*) from au group by 2 union all select 'suspicious_user', user_id, count(*) from au group by 2 having count(*) > 1000 or count(*) filter (outcome='failure') > 10""")
def audit_report(spark, d):
    return L.audit_report(_audit(spark, d))


@query("al37_audit_integrity", f"with {AUDIT} select 'hash_mismatch' as issue, sequence from au where sequence % 500 = 1 union all select 'missing_sequence', event_id + event_id // 60 + 1 from events where event_id % 60 = 59 and event_id < (select max(event_id) from events)")
def audit_integrity(spark, d):
    return L.verify_integrity(_audit(spark, d))


@query("al28_condition_details", f"""with {AGG}, {ROWS}, {CONDS}, lp as (select metric, value, row_number() over (partition by metric order by ts desc, point_id desc) as n from points where ts <= timestamp '{AS_OF}'), ls as (select metric, string_agg(value::varchar, ',' order by n) as last_points from lp where n <= 10 group by 1)
select cx.condition_id, cx.metric, cx.seconds, cx.aggregation, cx.op, cx.threshold, round(cx.current,6) as current, cx.is_met, wx."count", round(wx."avg",6) as "avg", wx."min", wx."max", round(wx."std",6) as "std", last_points
from cx left join wx on wx.metric = cx.metric and wx.seconds = cx.seconds left join ls on ls.metric = cx.metric""")
def condition_details(spark, d):
    return L.condition_details(metric_points(spark, d), [C1, C2, C3, C4], AS_OF)
