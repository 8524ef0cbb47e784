"""Queries over anomaly detection."""

from pyspark.sql import functions as F

from tidewatch.operators import anomaly as A
from tidewatch.plans.registry import query
from tidewatch.sources.tables import metric_points, query_log

BASE = """bs as (select metric, avg(value) as mean, stddev_pop(value) as std, min(value) as min, max(value) as max, count(*) as points from points group by 1),
o as (select metric, value, row_number() over (partition by metric order by value) - 1 as i, count(*) over (partition by metric) as n from points),
qs as (select metric, max(value) filter (i = floor(n*0.25)) as q1, max(value) filter (i = floor(n*0.5)) as median, max(value) filter (i = floor(n*0.75)) as q3 from o group by 1)"""
FOUND = BASE + """, hm as (select metric, hour(ts) as h, avg(value) as e from points group by 1, 2),
z as (select p.*, abs(value-mean)/greatest(std,0.001) as z_score, abs(value-e)/greatest(e,0.001) as seasonal_deviation, (value < q1-1.5*(q3-q1) or value > q3+1.5*(q3-q1)) as iq from points p join bs using (metric) join qs using (metric) join hm on hm.metric = p.metric and hm.h = hour(p.ts)),
f as (select *, case when z_score > 3 then 1 else 0 end as is_z_anomaly, case when seasonal_deviation > 0.5 then 1 else 0 end as is_seasonal_anomaly, case when iq then 1 else 0 end as is_iqr_anomaly,
 case when greatest(z_score,seasonal_deviation) > 4 then 'critical' when greatest(z_score,seasonal_deviation) > 3 then 'high' when greatest(z_score,seasonal_deviation) > 2 then 'medium' else 'low' end as severity from z where z_score > 3 or seasonal_deviation > 0.5 or iq)"""


@query("an01_baselines", f"""with {BASE} select metric, round(mean,6) as mean, round(std,6) as std, min, max, points, q1, median, q3, round(mean-3*std,6) as z_lower_bound, round(mean+3*std,6) as z_upper_bound,
 round(q1-1.5*(q3-q1),6) as iqr_lower_bound, round(q3+1.5*(q3-q1),6) as iqr_upper_bound from bs join qs using (metric)""")
def baselines(spark, d):
    return A.baselines(metric_points(spark, d))


@query("an02_seasonal_means", """select metric, 'hourly' as pattern, hour(ts) as slot, round(avg(value),6) as mean_value from points group by 1, 3 union all select metric, 'daily', isodow(ts)-1, round(avg(value),6) from points group by 1, 3""")
def seasonal_means(spark, d):
    return A.seasonal_means(metric_points(spark, d))


@query("an03_detected", f"with {FOUND} select metric, ts, value, point_id, round(z_score,6) as z_score, round(seasonal_deviation,6) as seasonal_deviation, is_z_anomaly, is_seasonal_anomaly, is_iqr_anomaly, severity from f")
def detected(spark, d):
    return A.detect(metric_points(spark, d))


@query("an04_severity_counts", f"with {FOUND} select severity, count(*) as anomalies from f group by 1")
def severity_counts(spark, d):
    return A.detect(metric_points(spark, d)).groupBy("severity").agg(F.count("*").alias("anomalies"))


@query("an05_scores", f"with {FOUND}, g as (select ts, max(z_score) as z from f group by 1) select t.ts, round(coalesce(z/5,0),6) as anomaly_score, case when z is not null then 1 else 0 end as is_anomaly from (select distinct ts from points) t left join g using (ts)")
def scores(spark, d):
    points = metric_points(spark, d)
    return A.scores(points, A.detect(points))


@query("an06_evaluation", f"""with {FOUND}, g as (select distinct point_id from f), r as (select (g.point_id is not null) as p, value > 100 as a from points left join g using (point_id)), c as (select count(*) filter (p and a) as tp, count(*) filter (p and not a) as fp, count(*) filter (not p and not a) as tn, count(*) filter (not p and a) as fn from r)
select tp as true_positives, fp as false_positives, tn as true_negatives, fn as false_negatives, round(tp/(tp+fp),6) as precision, round(tp/(tp+fn),6) as recall, round(2*(tp/(tp+fp))*(tp/(tp+fn))/((tp/(tp+fp))+(tp/(tp+fn))),6) as f1_score, round((tp+tn)/(tp+fp+tn+fn),6) as accuracy from c""")
def evaluation(spark, d):
    points = metric_points(spark, d)
    found = A.detect(points).select("point_id").withColumn("predicted", F.lit(1))
    rows = points.join(found, "point_id", "left").withColumns({"predicted": F.coalesce("predicted", F.lit(0)), "actual": (F.col("value") > 100).cast("int")})
    return A.evaluate(rows, "predicted", "actual")


@query("an07_deviation_importance", f"with {BASE} select metric, round(std/sum(std) over (),6) as importance from bs")
def deviation_importance(spark, d):
    return A.deviation_importance(metric_points(spark, d))


COLS = ["CREDITS_USED", "ROWS_PRODUCED"]


@query("an08_standardised", "select QUERY_ID, round((CREDITS_USED-avg(CREDITS_USED) over ())/stddev_pop(CREDITS_USED) over (),6)+0.0 as CREDITS_USED, round((ROWS_PRODUCED-avg(ROWS_PRODUCED) over ())/stddev_pop(ROWS_PRODUCED) over (),6)+0.0 as ROWS_PRODUCED from qlog")
def standardised(spark, d):
    return A.standardise(query_log(spark, d).select("QUERY_ID", *COLS), COLS)


@query("an09_forest")
def forest(spark, d):
    log = A.standardise(query_log(spark, d).select("QUERY_ID", *COLS), COLS)
    return A.train_forest(log, COLS, "QUERY_ID")


@query("an11_isolation_forest")
def isolation_forest(spark, d):
    return A.isolation_forest(query_log(spark, d).select("QUERY_ID", *COLS), COLS, "QUERY_ID")


ZT = ", ".join(f"({c}-avg({c}) over ())/stddev_samp({c}) over () as z_{c}" for c in ("CREDITS_USED", "ROWS_PRODUCED", "BYTES_SCANNED", "hour_no"))


@query("an12_explanations", f"""with x as (select QUERY_ID, {ZT} from (select *, hour(START_TIME) as hour_no from qlog)), l as (select QUERY_ID, 'CREDITS_USED' as feature, z_CREDITS_USED as z from x union all select QUERY_ID, 'ROWS_PRODUCED', z_ROWS_PRODUCED from x union all select QUERY_ID, 'hour_no', z_hour_no from x)
select QUERY_ID, row_number() over (partition by QUERY_ID order by abs(z) desc, feature desc) as rank, feature, round(z,6) as z_score from l qualify rank <= 2""")
def explanations(spark, d):
    log = query_log(spark, d).withColumn("hour_no", F.hour("START_TIME"))
    return A.explain(log, ["CREDITS_USED", "ROWS_PRODUCED", "hour_no"], "QUERY_ID", top=2)


@query("an13_forest_importance")
def forest_importance(spark, d):
    log = A.standardise(query_log(spark, d).select("QUERY_ID", *COLS), COLS)
    return A.forest_importance(A.train_forest(log, COLS, "QUERY_ID"), COLS)


def _parts(spark, d):
    found = A.detect(metric_points(spark, d)).withColumn("score", F.col("z_score"))
    return {"iqr": found.filter("is_iqr_anomaly = 1"), "seasonal": found.filter("is_seasonal_anomaly = 1"), "z_score": found.filter("is_z_anomaly = 1")}


ENS = FOUND + """, e as (select ts, z_score as s, severity, 'iqr' as method from f where is_iqr_anomaly = 1 union all select ts, z_score, severity, 'seasonal' from f where is_seasonal_anomaly = 1 union all select ts, z_score, severity, 'z_score' from f where is_z_anomaly = 1)"""


@query("an14_ensemble", f"""with {ENS} select ts, array_to_string(list_sort(list(distinct method)), ',') as methods, count(*) as consensus, round(avg(s),6) as avg_score, round(max(s),6) as max_score,
 ['low','medium','high','critical'][max(case severity when 'low' then 1 when 'medium' then 2 when 'high' then 3 else 4 end)] as severity from e group by 1""")
def ensemble(spark, d):
    return A.ensemble(_parts(spark, d))


@query("an15_consensus", f"""with {ENS}, g as (select ts, max((method='iqr')::int) as i, max((method='seasonal')::int) as s, max((method='z_score')::int) as z from e group by 1)
select round((sum(i*s)/sum(greatest(i,s)) + sum(i*z)/sum(greatest(i,z)) + sum(s*z)/sum(greatest(s,z)))/3,6) as consensus_score from g""")
def consensus(spark, d):
    return A.consensus(_parts(spark, d))


@query("an16_mean_scores", f"""with {FOUND}, a as (select ts, max(z_score)/5 as z from f group by 1), b as (select ts, max(z_score)/5 as z from f where is_iqr_anomaly = 1 group by 1)
select t.ts, round((coalesce(a.z,0)+coalesce(b.z,0))/2,6) as score from (select distinct ts from points) t left join a using (ts) left join b using (ts)""")
def mean_scores(spark, d):
    points = metric_points(spark, d)
    found = A.detect(points)
    return A.mean_scores({"all": A.scores(points, found), "iqr": A.scores(points, found.filter("is_iqr_anomaly = 1"))})


@query("cl23_forest_flags")
def forest_flags(spark, d):
    """One column, contamination 0.1."""
    return A.isolation_forest(query_log(spark, d).select("QUERY_ID", "CREDITS_USED"), ["CREDITS_USED"], "QUERY_ID").select("QUERY_ID", "anomaly_score", "is_anomaly")
