"""Queries over validation and quality."""

import uuid

from pyspark.sql import functions as F

from tidewatch.operators import ingest as I
from tidewatch.operators import quality as V
from tidewatch.plans.ingest import DERIVED
from tidewatch.plans.registry import query
from tidewatch.session import scratch_root
from tidewatch.sources import tables as S

COLS = ["row_id", "ts", "user_name", "kind", "value", "sparse", "seen_at"]
AS_OF = "2024-01-25 00:00:00"


def _dirty(spark, d):
    return S.dirty_log(spark, d).select(*COLS)


def _log(spark, d):
    log = S.query_log(spark, d).select("QUERY_ID", "START_TIME", "END_TIME", "USER_NAME", "QUERY_TYPE", "CREDITS_USED", "EXECUTION_TIME_MS", "ROWS_PRODUCED", "BYTES_SCANNED")
    return log.withColumn("CREDITS_USED", F.when(F.col("ROWS_PRODUCED") == 7, -F.col("CREDITS_USED")).otherwise(F.col("CREDITS_USED")))


LOG = """vlog as (select QUERY_ID, START_TIME, END_TIME, USER_NAME, QUERY_TYPE, case when ROWS_PRODUCED = 7 then -CREDITS_USED else CREDITS_USED end as CREDITS_USED, EXECUTION_TIME_MS, ROWS_PRODUCED, BYTES_SCANNED from qlog)"""
TWICE = "tw as (select row_id, ts, user_name, kind, value, sparse, seen_at from dirty union all select row_id, ts, user_name, kind, value, sparse, seen_at from dirty where row_id % 10 = 0)"


@query("va03_basic_checks", f"""with {TWICE} select count(*) as row_count, 7 as column_count, 3 as numeric_columns, 2 as categorical_columns, 2 as datetime_columns, 0 as columns_with_all_null, 0 as constant_columns,
 count(*) filter (value is null) + count(*) filter (sparse is null) as missing_numbers, 0 as infinite_values, 0 as negative_values, 0 as is_empty, count(*)-(select count(*) from dirty) as duplicate_rows from tw""")
def basic_checks(spark, d):
    rows = _dirty(spark, d)
    return V.basic_checks(rows.unionByName(rows.filter("row_id % 10 = 0")))


def _each(template, cols=COLS):
    return " union all ".join(template.replace("{c}", c) for c in cols)


COMPLETE = _each("select '{c}' as column_name, count(*)-count({c}) as missing_count, (count(*)-count({c}))*100.0/count(*) as missing_percentage, count({c})/count(*) as completeness_score from dirty")


@query("va04_completeness", f"select column_name, missing_count, round(missing_percentage,6) as missing_percentage, round(completeness_score,6) as completeness_score from ({COMPLETE})")
def completeness(spark, d):
    return V.completeness(_dirty(spark, d))


@query("va05_uniqueness", _each("select '{c}' as column_name, count(distinct {c}) as unique_count, count({c}) as total_non_null, round(count(distinct {c})/greatest(count({c}),1),6) as uniqueness_score, count({c})-count(distinct {c}) as duplicate_count from dirty"))
def uniqueness(spark, d):
    return V.uniqueness(_dirty(spark, d))


@query("va06_type_consistency", """select unnest(['row_id','user_name','value_text','time_text']) as column_name, unnest([1.0,1.0,0.5,1.0])::double as validity_score""")
def type_consistency(spark, d):
    return V.type_consistency(S.dirty_log(spark, d).select("row_id", "user_name", "value_text", "time_text"))


CONSTRAINTS = """select 'credits_non_negative' as "constraint", count(*) filter (not coalesce(CREDITS_USED >= 0, false)) as violations from vlog union all select 'execution_time_positive', count(*) filter (not coalesce(EXECUTION_TIME_MS > 0, false)) from vlog
 union all select 'bytes_scanned_non_negative', count(*) filter (not coalesce(BYTES_SCANNED >= 0, false)) from vlog union all select 'rows_produced_non_negative', count(*) filter (not coalesce(ROWS_PRODUCED >= 0, false)) from vlog
 union all select 'start_before_end', count(*) filter (not coalesce(START_TIME <= END_TIME, false)) from vlog"""


@query("va07_constraints", f"""with {LOG} select "constraint", violations, case when violations = 0 then 1 else 0 end as constraint_satisfied, case when violations = 0 then 1.0 else 0.0 end::double as constraint_score from ({CONSTRAINTS})""")
def constraints(spark, d):
    return V.constraints(_log(spark, d))


NUMS = ["CREDITS_USED", "EXECUTION_TIME_MS", "ROWS_PRODUCED", "BYTES_SCANNED"]
DISTR = _each("""select '{c}' as column_name, skewness({c}) as skewness, kurtosis({c}) as kurtosis, count(*) filter ({c} < q1-1.5*(q3-q1) or {c} > q3+1.5*(q3-q1)) as outlier_count, count({c}) as n
 from vlog, (select quantile_cont({c},0.25) as q1, quantile_cont({c},0.75) as q3 from vlog)""", NUMS)


@query("va08_distributions", f"""with {LOG} select column_name, round(skewness,6) as skewness, round(kurtosis,6) as kurtosis, outlier_count, round(outlier_count*100.0/n,6) as outlier_percentage,
 round(1-least(abs(skewness)/3,1)-least(outlier_count/n,0.1),6) as distribution_score from ({DISTR})""")
def distributions(spark, d):
    return V.distributions(_log(spark, d))


@query("va09_correlations", f"""with {LOG}, r as ({' union all '.join(f"select corr({a},{b}) as r from vlog" for i, a in enumerate(NUMS) for b in NUMS[i+1:])})
select count(*) filter (abs(r) > 0.8) as high_correlations, round(max(abs(r)),6) as max_correlation, round(1-least(count(*) filter (abs(r) > 0.8)/10,1),6) as correlation_score from r""")
def correlation_check(spark, d):
    return V.correlation_check(_log(spark, d))


RULES = {"QUERY_ID": V.ColumnRule("string", False), "USER_NAME": V.ColumnRule("string", True, max_length=3), "CREDITS_USED": V.ColumnRule("float", False, 0.0, 3.0),
         "ROWS_PRODUCED": V.ColumnRule("string"), "ERROR_CODE": V.ColumnRule("string")}


@query("va11_schema_check", f"""with {LOG} select 'ERROR_CODE' as column_name, 'missing_column' as issue, 1 as violation_count union all select unnest(['START_TIME','END_TIME','QUERY_TYPE','EXECUTION_TIME_MS','BYTES_SCANNED']), 'extra_column', 1
 union all select 'ROWS_PRODUCED', 'type_mismatch', 1 union all select 'USER_NAME', 'max_length', count(*) from vlog where length(USER_NAME) > 3 having count(*) > 0 union all select 'CREDITS_USED', 'min_value', count(*) from vlog where CREDITS_USED < 0 having count(*) > 0
 union all select 'CREDITS_USED', 'max_value', count(*) from vlog where CREDITS_USED > 3 having count(*) > 0""")
def schema_check(spark, d):
    return V.schema_check(_log(spark, d), RULES)


@query("va12_temporal_check", f"""with moved as (select * replace (START_TIME + to_days(case when START_TIME >= timestamp '2024-01-15 00:00:00' then 2 else 0 end) as START_TIME) from qlog), o as (select START_TIME as t, QUERY_ID, (epoch_us(START_TIME)-epoch_us(lag(START_TIME) over (order by START_TIME, QUERY_ID)))/3.6e9 as g, lag(START_TIME) over (order by QUERY_ID) as b from moved)
select count(*) filter (g > 24) as large_gaps_count, round(max(g),6) as max_gap_hours, round(avg(g),6) as avg_gap_hours, round(1-count(*) filter (g > 24)/count(*),6) as continuity_score, count(*) filter (b > t) as out_of_order,
 case when count(*) filter (b > t) = 0 then 1 else 0 end as is_chronological, count(*) filter (t > timestamp '{AS_OF}') as future_count, round(count(*) filter (t > timestamp '{AS_OF}')*100.0/count(*),6) as future_percentage,
 round(1-count(*) filter (t > timestamp '{AS_OF}')/count(*),6) as timeliness_score from o""")
def temporal_check(spark, d):
    # the second half two days later: a gap appears
    later = F.expr("START_TIME + make_dt_interval(case when START_TIME >= timestamp_ntz'2024-01-15 00:00:00' then 2 else 0 end)")
    return V.temporal_check(S.query_log(spark, d).withColumn("START_TIME", later), "START_TIME", "QUERY_ID", AS_OF)


READY = """select count(*) as actual_samples, greatest(0, avg((value is null)::int), avg((sparse is null)::int)) as max_missing_rate, 1-(avg((value is null)::int)+avg((sparse is null)::int))/3 as missing_score,
 case when var_samp(row_id) < 0.001 then 1 else 0 end + case when var_samp(value) < 0.001 then 1 else 0 end + case when var_samp(sparse) < 0.001 then 1 else 0 end as low_variance_features,
 case when abs(corr(row_id,value)) > 0.95 then 1 else 0 end + case when abs(corr(row_id,sparse)) > 0.95 then 1 else 0 end + case when abs(corr(value,sparse)) > 0.95 then 1 else 0 end as high_correlation_pairs from dirty"""


@query("va13_ml_readiness", f"""with r as ({READY}) select actual_samples, round(max_missing_rate,6) as max_missing_rate, round(missing_score,6) as missing_score, low_variance_features, high_correlation_pairs, round(least(actual_samples/1000,1),6) as sample_adequacy_score,
 case when max_missing_rate <= 0.05 then 1 else 0 end as acceptable_missing_rate, round(1-low_variance_features/3,6) as variance_score, round(1-high_correlation_pairs/3,6) as correlation_score from r""")
def ml_readiness(spark, d):
    return V.ml_readiness(S.dirty_log(spark, d).select("row_id", "value", "sparse"))


@query("va14_variance_importance", f"""with {LOG}, v as ({_each("select '{c}' as column_name, var_samp({c}) as v from vlog", NUMS)})
select column_name, round(v/sum(v) over (),6) as importance, case when v/sum(v) over () < 0.01 then 1 else 0 end as is_low from v""")
def variance_importance(spark, d):
    return V.variance_importance(_log(spark, d))


def _cmp(c):
    return f"""select '{c}' as column_name, round((avg(a.{c})-(select avg({c}) from qlog))/(select avg({c}) from qlog)*100,6) as mean_change_pct, round((stddev_samp(a.{c})-(select stddev_samp({c}) from qlog))/(select stddev_samp({c}) from qlog)*100,6) as std_change_pct,
 round((median(a.{c})-(select median({c}) from qlog))/(select median({c}) from qlog)*100,6) as median_change_pct from vlog a"""


@query("va15_comparison", f"with {LOG} " + " union all ".join(_cmp(c) for c in NUMS))
def comparison(spark, d):
    return V.compare_with(_log(spark, d), S.query_log(spark, d).select(*NUMS))


@query("va15_shape_comparison", "select (select count(*) from qlog) as current_rows, (select count(*) from qlog) as reference_rows, 'EXECUTION_TIME_MS,ROWS_PRODUCED' as columns_added, 'QUERY_TEXT' as columns_removed, 0 as shape_consistent")
def shape_comparison(spark, d):
    log = S.query_log(spark, d)
    return V.compare_shape(log.select("QUERY_ID", "EXECUTION_TIME_MS", "ROWS_PRODUCED"), log.select("QUERY_ID", "QUERY_TEXT"))


SCORES = f"""{LOG}, acc as (select case when violations = 0 then 1.0 else 0.0 end as s from ({CONSTRAINTS}) union all select 1-least(abs(skewness)/3,1)-least(outlier_count/n,0.1) from ({DISTR})),
rd as (select (least(count(*)/1000,1) + 1 + 1 - ({' + '.join(f"case when var_samp({c}) < 0.001 then 1 else 0 end" for c in NUMS)})/4 + 1 - ({' + '.join(f"case when abs(corr({a},{b})) > 0.95 then 1 else 0 end" for i, a in enumerate(NUMS) for b in NUMS[i+1:])})/6)/4 as m from vlog),
sc as (select 'raw_data_validation' as stage, 'completeness' as dimension, 1.0::double as score union all select 'raw_data_validation', 'consistency', 1 union all select 'raw_data_validation', 'accuracy', avg(s) from acc union all select 'raw_data_validation', 'schema_compliance', 1
 union all select 'raw_data_validation', 'ml_readiness', 1 union all select 'ml_readiness_validation', 'completeness', 1 union all select 'ml_readiness_validation', 'consistency', 1 union all select 'ml_readiness_validation', 'accuracy', avg(s) from acc
 union all select 'ml_readiness_validation', 'schema_compliance', 1 union all select 'ml_readiness_validation', 'ml_readiness', m from rd),
ov as (select * from sc union all select stage, 'overall', avg(score) from sc group by 1)"""


@query("va01_stage_scores", f"with {SCORES} select stage, dimension, round(score,6) as score from ov where stage = 'raw_data_validation'")
def stage_scores(spark, d):
    return V.stage_scores(_log(spark, d), "raw_data_validation")


@query("va02_pipeline_scores", f"with {SCORES} select stage, dimension, round(score,6) as score from ov union all select '*', 'overall', round(avg(score),6) from ov where dimension = 'overall'")
def pipeline_scores(spark, d):
    log = _log(spark, d)
    return V.pipeline_scores({"raw_data_validation": log, "ml_readiness_validation": log})


@query("va16_failures", f"""with {SCORES}, t as (select unnest(['completeness','consistency','accuracy','timeliness','validity','overall']) as dimension, unnest([0.95,0.98,0.99,0.95,0.97,0.9])::double as threshold)
select stage, dimension, round(score,6) as score, threshold from ov join t using (dimension) where score < threshold""")
def failures(spark, d):
    log = _log(spark, d)
    return V.failures(V.pipeline_scores({"raw_data_validation": log, "ml_readiness_validation": log}).filter("stage <> '*'"))


@query("va16_recommendations", """with c as (select avg(s) as s from (select 1.0 as s from range(3) union all select count(value)/count(*) from dirty union all select count(sparse)/count(*) from dirty union all select count(kind)/count(*) from dirty union all select count(seen_at)/count(*) from dirty))
select 'dirty' as stage, 'impute_missing_values' as recommendation from c where s < 0.9""")
def recommendations(spark, d):
    return V.recommendations(V.stage_scores(_dirty(spark, d), "dirty").filter("dimension <> 'overall'"))


@query("va17_cross_stage", """select 'raw_data_validation' as from_stage, 'cleaned_data_validation' as to_stage, (select count(*) from qlog) as rows, (select count(*) from qlog) as next_rows, 1 as is_consistent, 'BYTES_SCANNED' as removed_columns, 0 as lacks_new_features
union all select 'cleaned_data_validation', 'feature_validation', (select count(*) from qlog), (select count(*) from qlog), 1, '', 1""")
def cross_stage(spark, d):
    log = S.query_log(spark, d).select("QUERY_ID", "ROWS_PRODUCED", "BYTES_SCANNED")
    clean = log.drop("BYTES_SCANNED")
    return V.cross_stage({"raw_data_validation": log, "cleaned_data_validation": clean, "feature_validation": clean})


HISTORY = "hs as (select DATABASE_NAME as stage, date_trunc('day', START_TIME)::timestamp as run_at, avg(CREDITS_USED) as overall, case when avg(CREDITS_USED) > 0.5 then 1 else 0 end as passed from qlog group by 1, 2)"


@query("va19_history_metrics", f"""with {HISTORY.replace("group by 1, 2", "where DATABASE_NAME is not null group by 1, 2")}, b as (select * from hs union all select '*', run_at, avg(overall), max(passed) from hs group by run_at),
a as (select stage, avg(overall) as m, count(*) as n, count(*) filter (passed=1) as p, min_by(overall, run_at) as f, max_by(overall, run_at) as l from b where stage <> '*' group by 1 union all select '*', avg(overall), count(*), count(*) filter (passed=1), min_by(overall, run_at::varchar || stage), max_by(overall, run_at::varchar || stage) from hs)
select stage, round(m,6) as mean_score, n as validations, p as passed, case when n > 1 and l > f then 'improving' else 'stable' end as trend from a""")
def history_metrics(spark, d):
    log = S.query_log(spark, d).filter("DATABASE_NAME is not null")
    hist = log.groupBy(F.col("DATABASE_NAME").alias("stage"), F.date_trunc("day", "START_TIME").alias("run_at")).agg(F.avg("CREDITS_USED").alias("overall"))
    return V.history_metrics(hist.withColumn("passed", (F.col("overall") > 0.5).cast("int")))


def _q(spark, d):
    return S.query_history(spark, d)


QUAL = f"""(select 'required_fields_complete' as rule_name, 'completeness' as rule_type, 'critical' as severity, 0.95 as threshold, count(*) filter (QUERY_ID is null)+count(*) filter (START_TIME is null)+count(*) filter (USER_NAME is null) as affected, 3*count(*) as total from qhist
 union all select 'timestamp_completeness','completeness','critical',0.99, count(*) filter (START_TIME is null)+count(*) filter (END_TIME is null)+count(*) filter (TOTAL_ELAPSED_TIME is null)+count(*) filter (QUEUED_OVERLOAD_TIME is null), 4*count(*) from qhist
 union all select 'numeric_ranges','accuracy','warning',0.95, sum(o)::bigint, sum(n)::bigint from ({_each("select count(*) filter ({c} < q1-1.5*(q3-q1) or {c} > q3+1.5*(q3-q1)) as o, count({c}) as n from qhist, (select quantile_cont({c}::double,0.25) as q1, quantile_cont({c}::double,0.75) as q3 from qhist)", ["BYTES_SCANNED", "PERCENTAGE_SCANNED_FROM_CACHE", "ROWS_PRODUCED", "BYTES_SPILLED_TO_LOCAL_STORAGE", "BYTES_SPILLED_TO_REMOTE_STORAGE", "QUEUED_OVERLOAD_TIME", "CREDITS_USED_CLOUD_SERVICES"])})
 union all select 'positive_credits','accuracy','critical',0.99, count(*) filter (CREDITS_USED_CLOUD_SERVICES < 0), count(CREDITS_USED_CLOUD_SERVICES) from qhist
 union all select 'timestamp_order','consistency','critical',0.99, count(*) filter (START_TIME >= END_TIME), count(*) filter (START_TIME is not null and END_TIME is not null) from qhist
 union all select 'user_name_format','consistency','warning',0.9, count(*) filter (not regexp_matches(USER_NAME, '^[A-Za-z][A-Za-z0-9_.@-]*$')), count(USER_NAME) from qhist
 union all select 'data_freshness','timeliness','warning',0.95, count(*) filter (START_TIME < timestamp '2024-01-24 00:00:00')+count(*) filter (END_TIME < timestamp '2024-01-24 00:00:00'), count(START_TIME)+count(END_TIME) from qhist
 union all select 'enum_values','validity','critical',0.99, count(*) filter (EXECUTION_STATUS not in ('SUCCESS','FAIL','CANCELLED','RUNNING')), count(EXECUTION_STATUS) from qhist)"""
QRULES = f"qr as (select rule_name, rule_type, severity, threshold::double as threshold, affected, total, case when total > 0 then 1-affected/total else 1 end as score from {QUAL})"


@query("qc01_quality_summary", f"""with {QRULES}, w as (select *, case when score >= threshold then 1 else 0 end as p, case severity when 'critical' then 3.0 else 2.0 end as w from qr), s as (select sum(score*w)/sum(w) as o, count(*) as n, sum(p)::bigint as p, count(*) filter (p=0) as f, count(*) filter (p=0 and severity='critical') as c from w)
select round(o,6) as overall_score, n as total_rules, p as passed_rules, f as failed_rules, c as critical_failures, case when o >= 0.95 then 'A' when o >= 0.9 then 'B' when o >= 0.8 then 'C' when o >= 0.7 then 'D' else 'F' end as quality_grade,
 case when c > 0 or o < 0.8 then 1 else 0 end as needs_attention from s""")
def quality_summary(spark, d):
    return V.quality_summary(V.quality_rules(_q(spark, d), "query_history_raw", AS_OF))


def _rules(kind):
    return f"with {QRULES} select rule_name, rule_type, severity, threshold, affected, total, round(score,6) as score, case when score >= threshold then 1 else 0 end as passed from qr where rule_type = '{kind}'"


def _by_kind(kind):
    def run(spark, d):
        return V.quality_rules(_q(spark, d), "query_history_raw", AS_OF).filter(F.col("rule_type") == kind)
    return run


for _name, _kind in (("qc02_completeness", "completeness"), ("qc03_accuracy", "accuracy"), ("qc04_consistency", "consistency"),
                     ("qc05_timeliness", "timeliness"), ("qc06_validity", "validity")):
    query(_name, _rules(_kind))(_by_kind(_kind))


@query("sv01_validated_usage", """select 'START_TIME,WAREHOUSE_ID' as field, 'primary_key' as "check", count(*)-count(distinct (START_TIME, WAREHOUSE_ID)) as violations from metering""")
def validated_usage(spark, d):
    return V.validate_table(S.metering_history(spark, d), "warehouse_usage_raw")


FIELDS = """select 'START_TIME' as field, 'null' as "check", count(*) as violations from qhist where START_TIME is null union all select 'TOTAL_ELAPSED_TIME', 'type', count(*) from qhist where TOTAL_ELAPSED_TIME = 'bad'
 union all select 'ROWS_PRODUCED', 'null', count(*) from qhist where ROWS_PRODUCED is null"""


@query("sv01_validated_queries", FIELDS)
def validated_queries(spark, d):
    return V.validate_table(_q(spark, d), "query_history_raw")


@query("sv02_type_failures", """select 'TOTAL_ELAPSED_TIME' as field, 'type' as "check", count(*) as violations from qhist where TOTAL_ELAPSED_TIME is not null and try_cast(TOTAL_ELAPSED_TIME as bigint) is null""")
def type_failures(spark, d):
    return V.field_checks(_q(spark, d), V.SCHEMAS["query_history_raw"]).filter("check = 'type'")


@query("sv03_field_limits", """select 'kind' as field, 'allowed_values' as "check", count(*) as violations from dirty where kind not in ('view','click') union all select 'kind', 'null', count(*) from dirty where kind is null
 union all select 'value', 'min_value', count(*) from dirty where value < 1 union all select 'value', 'max_value', count(*) from dirty where value > 100 union all select 'user_name', 'pattern', count(*) from dirty where not regexp_matches(user_name, '^U[0-4]')
 union all select 'value', 'null', count(*) from dirty where value is null""")
def field_limits(spark, d):
    schema = V.TableSchema((V.Field("kind", "string", allowed=("view", "click")), V.Field("value", "float", min_value=1, max_value=100), V.Field("user_name", "string", pattern="U[0-4]")))
    return V.field_checks(S.dirty_log(spark, d), schema)


@query("sv04_key_violations", """select 'user_name,kind' as field, 'primary_key' as "check", count(*)-count(distinct (user_name, kind)) as violations from dirty""")
def key_violations(spark, d):
    return V.key_violations(S.dirty_log(spark, d), ["user_name", "kind"])


@query("sv04_orphans", """select 'o_custkey' as field, 'foreign_key' as "check", count(*) as violations from orders where case when o_orderstatus = 'P' then -o_custkey else o_custkey end not in (select c_custkey from customer)""")
def orphans(spark, d):
    # pending orders get keys that no customer has
    key = F.when(F.col("o_orderstatus") == "P", -F.col("o_custkey")).otherwise(F.col("o_custkey"))
    return V.orphans(S.table(spark, d, "orders").withColumn("o_custkey", key), "o_custkey", S.table(spark, d, "customer"), "c_custkey")


@query("sv05_conformed", """select QUERY_ID, START_TIME, END_TIME, USER_NAME, WAREHOUSE_NAME, EXECUTION_STATUS, try_cast(TOTAL_ELAPSED_TIME as bigint) as TOTAL_ELAPSED_TIME, BYTES_SCANNED, ROWS_PRODUCED from qhist""")
def conformed(spark, d):
    return V.conform(_q(spark, d), "query_history_raw")


@query("sv06_table_anomalies", f"""select 'high_volume' as type, null::varchar as column_name, count(*) as count, null::double as share from qhist having count(*) > 1000
 union all select 'future_timestamps', 'START_TIME', count(*), null from qhist where START_TIME > timestamp '{AS_OF}' union all select 'future_timestamps', 'END_TIME', count(*), null from qhist where END_TIME > timestamp '{AS_OF}'
 union all select * from ({_each("select 'extreme_values', '{c}' as column_name, count(*) filter ({c} < q1-3*(q3-q1) or {c} > q3+3*(q3-q1)) as o, round(count(*) filter ({c} < q1-3*(q3-q1) or {c} > q3+3*(q3-q1))/count({c}),6) as s from qhist, (select quantile_cont({c}::double,0.25) as q1, quantile_cont({c}::double,0.75) as q3 from qhist)", ["BYTES_SCANNED", "ROWS_PRODUCED", "BYTES_SPILLED_TO_LOCAL_STORAGE", "QUEUED_OVERLOAD_TIME"])}) where s > 0.05""")
def table_anomalies(spark, d):
    rows = _q(spark, d).select("START_TIME", "END_TIME", "BYTES_SCANNED", "ROWS_PRODUCED", "BYTES_SPILLED_TO_LOCAL_STORAGE", "QUEUED_OVERLOAD_TIME")
    return V.table_anomalies(rows, AS_OF, volume=(100, 1000))


@query("sv09_lineage_records", """select 'events' as source, 'query_history_raw' as target, timestamp '2024-02-01 00:00:00' as tracked_at, count(*) as row_count from qhist
 union all select 'events', 'warehouse_usage_raw', timestamp '2024-02-01 00:00:00', count(*) from metering""")
def lineage_records(spark, d):
    path = f"{scratch_root(spark)}/tidewatch/{uuid.uuid4().hex}"
    V.track_collection(_q(spark, d), "events", "query_history_raw", "2024-02-01 00:00:00", path)
    V.track_collection(S.metering_history(spark, d), "events", "warehouse_usage_raw", "2024-02-01 00:00:00", path)
    V.track_collection(S.storage_usage(spark, d), "orders", "storage_raw", "2024-02-01 00:00:00", path)
    return V.lineage_of(spark.read.parquet(path), "events")
