"""Queries over cleaning."""

from pyspark.sql import functions as F

from tidewatch.operators import clean as C
from tidewatch.plans.registry import query
from tidewatch.operators.nearest import impute_nearest_all
from tidewatch.sources.tables import dirty_log, query_history, query_log, table

COLUMNS = ["row_id", "ts", "user_name", "kind", "value", "sparse", "seen_at"]
BASE = "row_id, ts, user_name, kind, round(value,6) as value, round(sparse,6) as sparse, seen_at"


def _dirty(spark, d):
    return dirty_log(spark, d).select(*COLUMNS)


def _twice(spark, d):
    rows = _dirty(spark, d)
    return rows.unionByName(rows.filter(F.col("row_id") % 10 == 0))


TWICE = f"twice as (select * from (select row_id, ts, user_name, kind, value, sparse, seen_at from dirty) union all (select row_id, ts, user_name, kind, value, sparse, seen_at from dirty where row_id % 10 = 0))"
Q1 = "(select quantile_cont(value,0.25) as q1, quantile_cont(value,0.75) as q3 from dirty)"
IQR = f"(select q1-1.5*(q3-q1) as lo, q3+1.5*(q3-q1) as hi from {Q1})"


@query("cl01_cleaned_table", f"""
with {TWICE}, u as (select distinct * from twice), md as (select median(value) as m from u), mk as (select kind as k from u where kind is not null group by 1 order by count(*) desc, 1 limit 1),
i as (select row_id, ts, user_name, coalesce(kind, k) as kind, coalesce(value, m) as value, coalesce(seen_at, last_value(seen_at ignore nulls) over (order by ts, row_id)) as seen_at from u, md, mk),
b as (select quantile_cont(value,0.25) as q1, quantile_cont(value,0.75) as q3 from i)
select row_id, ts, user_name, kind, round(value,6) as value, seen_at from i, b where value between q1-1.5*(q3-q1) and q3+1.5*(q3-q1)""")
def cleaned_table(spark, d):
    stages = C.clean_table(_twice(spark, d), ["ts", "row_id"], skip=["row_id", "user_name"], outlier_columns=["value"])
    return stages["types"]


@query("cl02_comparison", f"""
with {TWICE}, u as (select distinct * from twice), n as (select sum((kind is null)::int+(value is null)::int+(sparse is null)::int+(seen_at is null)::int) as a from twice), m as (select sum((kind is null)::int+(value is null)::int+(sparse is null)::int+(seen_at is null)::int) as b from u)
select (select count(*) from twice) as original_rows, cast(a as bigint) as original_nulls, (select count(*) from u) as cleaned_rows, cast(b as bigint) as cleaned_nulls, (select count(*) from twice)-(select count(*) from u) as row_delta,
 true as same_columns, b <= a as nulls_reduced, b <= a as is_valid from n, m""")
def comparison(spark, d):
    rows = _twice(spark, d)
    return C.compare_cleaned(rows, C.drop_exact(rows))


@query("cl03_cleaning_report", f"""
with {TWICE}, u as (select distinct * from twice), md as (select median(value) as m from u), i as (select coalesce(value, m) as value from u, md), b as (select quantile_cont(value,0.25) as q1, quantile_cont(value,0.75) as q3 from i),
o as (select count(*) as n from i, b where value between q1-1.5*(q3-q1) and q3+1.5*(q3-q1)), t as (select count(*) as n from twice)
select t.n as initial_rows, o.n as final_rows, t.n-o.n as rows_removed, round(o.n*100.0/t.n,6) as retention_percentage, 'duplicates,missing_values,outliers,types' as steps from o, t""")
def cleaning_report(spark, d):
    return C.cleaning_report(C.clean_table(_twice(spark, d), ["ts", "row_id"], skip=["row_id", "user_name"], outlier_columns=["value"]))


@query("cl04_standardised_log", """select QUERY_ID, upper(concat('u', USER_NAME)) as USER_NAME, WAREHOUSE_NAME, START_TIME, try_cast(TOTAL_ELAPSED_TIME as double) as TOTAL_ELAPSED_TIME from qhist""")
def standardised_log(spark, d):
    rows = query_history(spark, d).select(
        "QUERY_ID", F.concat(F.lit("u"), F.lower("USER_NAME")).alias("USER_NAME"), F.lower("WAREHOUSE_NAME").alias("WAREHOUSE_NAME"),
        F.date_format("START_TIME", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("START_TIME"), "TOTAL_ELAPSED_TIME")
    return C.standardise_log(rows)


@query("cl05_exact_dedup", f"with {TWICE} select distinct {BASE} from twice")
def exact_dedup(spark, d):
    return C.drop_exact(_twice(spark, d))


@query("cl05_keep_last", "select user_name, kind, max(row_id) as row_id, arg_max(ts, row_id) as ts from dirty group by 1, 2")
def keep_last(spark, d):
    rows = dirty_log(spark, d).select("user_name", "kind", "row_id", "ts")
    return C.drop_exact(rows, ["user_name", "kind"], keep="last", order="row_id")


@query("cl05_keep_none", f"with {TWICE} select {BASE} from dirty where row_id % 10 <> 0")
def keep_none(spark, d):
    return C.drop_exact(_twice(spark, d), COLUMNS, keep="none")


@query("cl06_near_copies")
def near_copies(spark, d):
    return C.drop_near(table(spark, d, "documents"), "doc_id", "text", shingle=5).select("doc_id", "lang", "source", "n_chars")


@query("cl07_spaced_rows", """with recursive o as (select QUERY_ID, USER_NAME, START_TIME, row_number() over (partition by USER_NAME order by START_TIME, QUERY_ID) as i from qlog),
k as (select USER_NAME, QUERY_ID, START_TIME, i, START_TIME as last, true as kept from o where i = 1
 union all select o.USER_NAME, o.QUERY_ID, o.START_TIME, o.i, case when o.START_TIME >= k.last + interval 600 minute then o.START_TIME else k.last end, o.START_TIME >= k.last + interval 600 minute from k join o on o.USER_NAME = k.USER_NAME and o.i = k.i + 1)
select QUERY_ID, USER_NAME, START_TIME from k where kept""")
def spaced_rows(spark, d):
    log = query_log(spark, d).select("QUERY_ID", "USER_NAME", "START_TIME")
    return C.drop_within(log, ["USER_NAME"], "START_TIME", "QUERY_ID", 600)


@query("cl08_duplicate_report", """with g as (select user_name, kind, count(*) as n from dirty group by 1, 2)
select cast(sum(n) as bigint) as total_records, cast(coalesce(sum(n) filter (n > 1),0) as bigint) as duplicate_records, count(*) filter (n > 1) as duplicate_groups, round(coalesce(sum(n) filter (n > 1),0)*100.0/sum(n),6) as duplicate_percentage from g""")
def duplicate_report(spark, d):
    return C.duplicate_report(dirty_log(spark, d), ["user_name", "kind"])


@query("cl09_dropped_sparse", """select row_id, ts, user_name, kind, round(value,6) as value, seen_at from dirty
 where ((kind is null)::int + (value is null)::int + (seen_at is null)::int)/6.0 <= 0.3""")
def dropped_sparse(spark, d):
    return C.drop_sparse(_dirty(spark, d), row_limit=0.3)


@query("cl10_imputed_by_type", """with md as (select median(value) as m, median(sparse) as s from dirty), mk as (select kind as k from dirty where kind is not null group by 1 order by count(*) desc, 1 limit 1)
select row_id, ts, user_name, coalesce(kind,k) as kind, round(coalesce(value,m),6) as value, round(coalesce(sparse,s),6) as sparse, last_value(seen_at ignore nulls) over (order by ts, row_id) as seen_at from dirty, md, mk""")
def imputed_by_type(spark, d):
    return C.impute_by_type(_dirty(spark, d), ["ts", "row_id"], skip=["row_id", "user_name"])


@query("cl11_imputed_numbers", """with s as (select avg(value) as a, median(value) as m from dirty), f as (select value as f from dirty where value is not null group by 1 order by count(*) desc, 1 limit 1)
select row_id, round(coalesce(value,a),6) as mean_value, round(coalesce(value,m),6) as median_value, round(coalesce(value,f),6) as frequent_value from dirty, s, f""")
def imputed_numbers(spark, d):
    rows = dirty_log(spark, d).select("row_id", F.col("value").alias("mean_value"), F.col("value").alias("median_value"), F.col("value").alias("frequent_value"))
    rows = C.impute_numeric(rows, ["mean_value"], "mean")
    rows = C.impute_numeric(rows, ["median_value"], "median")
    return C.impute_numeric(rows, ["frequent_value"], "most_frequent")


@query("cl12_imputed_nearest", """with p as (select row_id, user_no as x, value, row_number() over (order by user_no, row_id) as pos, count(value) over (order by user_no, row_id rows unbounded preceding) as rk from (select row_id, cast(substr(user_name,2) as double) as user_no, value from dirty)),
d as (select rk as slot, x as dx, value as dy from p where value is not null), t as (select row_id, x, rk from p where value is null),
c as (select t.row_id, dy, row_number() over (partition by t.row_id order by abs(x-dx), case when slot <= rk then rk-slot else slot-rk-1 end, slot) as n from t, d), f as (select row_id, avg(dy) as f from c where n <= 5 group by 1)
select dirty.row_id, round(coalesce(value, f),6) as value from dirty left join f on dirty.row_id = f.row_id""")
def imputed_nearest(spark, d):
    rows = dirty_log(spark, d).select("row_id", "value", F.expr("cast(substr(user_name, 2) as double)").alias("user_no"))
    return C.impute_nearest(rows, "value", "user_no", "row_id").drop("user_no")


NEAR = " + ".join(f"case when t.{c} is not null and x.{c} is not null then (t.{c} - x.{c}) * (t.{c} - x.{c}) else 0 end" for c in "abc")
BOTH = " + ".join(f"(t.{c} is not null and x.{c} is not null)::int" for c in "abc")


@query("cl12_imputed_nearest_all", f"""with r as (select row_id, value as a, cast(substr(user_name, 2) as double) as b, (hour(seen_at) * 60 + minute(seen_at))::double as c from dirty),
p as (select t.row_id, t.a as ta, t.c as tc, x.a, x.c, x.row_id as other, ({NEAR}) * 3.0::double / ({BOTH}) as d from r t join r x on t.row_id <> x.row_id where (t.a is null or t.c is null) and ({BOTH}) > 0),
fa as (select row_id, avg(a) as f from (select * from p where ta is null and a is not null qualify row_number() over (partition by row_id order by d, other) <= 5) group by 1),
fc as (select row_id, avg(c) as f from (select * from p where tc is null and c is not null qualify row_number() over (partition by row_id order by d, other) <= 5) group by 1)
select r.row_id, round(coalesce(a, fa.f),6) as value, b as user_no, round(coalesce(c, fc.f),6) as seen_minute from r left join fa on fa.row_id = r.row_id left join fc on fc.row_id = r.row_id""")
def imputed_nearest_all(spark, d):
    minute = (F.hour("seen_at") * 60 + F.minute("seen_at")).cast("double")
    rows = dirty_log(spark, d).select("row_id", "value", F.expr("cast(substr(user_name, 2) as double)").alias("user_no"), minute.alias("seen_minute"))
    return impute_nearest_all(rows, ["value", "user_no", "seen_minute"], "row_id")


def _refit(name, source, y, other):
    """One regression of ``y`` on ``other`` and the time over the rows that had it; its gaps get the prediction."""
    return f"""{name} as (select s.* replace (case when g_{y} then my + ((suy*svv - svy*suv)*({other}-mu) + (svy*suu - suy*suv)*("at"-mv))/(suu*svv - suv*suv) else {y} end as {y}) from {source} s,
 (select avg({y}) as my, avg({other}) as mu, avg("at") as mv, covar_pop({other},{y}) as suy, covar_pop("at",{y}) as svy, var_pop({other}) as suu, var_pop("at") as svv, covar_pop({other},"at") as suv from {source} where not g_{y}))"""


CHAINED = """c0 as (select row_id, value is null as g_value, sparse is null as g_sparse, coalesce(value, avg(value) over ()) as value, coalesce(sparse, avg(sparse) over ()) as sparse, epoch_us(ts)::double as "at" from dirty),
""" + ",\n".join(_refit(f"c{i + 1}", f"c{i}", y, other) for i, (y, other) in enumerate([("value", "sparse"), ("sparse", "value")] * 2))


@query("cl13_imputed_iterative", f"with {CHAINED} select row_id, round(value,6) as value, round(sparse,6) as sparse, \"at\" from c4")
def imputed_iterative(spark, d):
    rows = dirty_log(spark, d).select("row_id", "value", "sparse", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("at"))
    return C.impute_iterative(rows, ["value", "sparse", "at"], rounds=2)


@query("cl14_imputed_text", """with m as (select kind as k from dirty where kind is not null group by 1 order by count(*) desc, 1 limit 1)
select row_id, coalesce(kind, k) as frequent_kind, coalesce(kind, 'UNKNOWN') as constant_kind from dirty, m""")
def imputed_text(spark, d):
    rows = dirty_log(spark, d).select("row_id", F.col("kind").alias("frequent_kind"), F.col("kind").alias("constant_kind"))
    return C.impute_text(C.impute_text(rows, ["frequent_kind"]), ["constant_kind"], "constant")


@query("cl15_filled_times", """select row_id, last_value(seen_at ignore nulls) over (partition by user_name order by ts, row_id) as forward,
 first_value(seen_at ignore nulls) over (partition by user_name order by ts, row_id rows between current row and unbounded following) as backward from dirty""")
def filled_times(spark, d):
    rows = dirty_log(spark, d).select("row_id", "ts", "user_name", F.col("seen_at").alias("forward"), F.col("seen_at").alias("backward"))
    rows = C.impute_times(rows, ["forward"], ["ts", "row_id"], ["user_name"], "ffill")
    return C.impute_times(rows, ["backward"], ["ts", "row_id"], ["user_name"], "bfill").select("row_id", "forward", "backward")


@query("cl16_interpolated", """with o as (select *, row_number() over (partition by user_name order by ts, row_id) as i from dirty),
p as (select *, last_value(case when sparse is not null then i end ignore nulls) over w as pi, last_value(sparse ignore nulls) over w as ps, first_value(case when sparse is not null then i end ignore nulls) over f as ni, first_value(sparse ignore nulls) over f as ns
 from o window w as (partition by user_name order by i), f as (partition by user_name order by i rows between current row and unbounded following))
select row_id, round(case when sparse is not null then sparse when ni is null then ps else ps+(ns-ps)*(i-pi)/(ni-pi) end,6) as sparse from p""")
def interpolated(spark, d):
    rows = dirty_log(spark, d).select("row_id", "ts", "user_name", "sparse")
    return C.interpolate(rows, ["sparse"], ["ts", "row_id"], ["user_name"]).select("row_id", "sparse")


@query("cl17_imputed_auto", """with md as (select median(value) as m from dirty), mk as (select kind as k from dirty where kind is not null group by 1 order by count(*) desc, 1 limit 1)
select row_id, ts, user_name, coalesce(kind,k) as kind, round(coalesce(value,m),6) as value, last_value(seen_at ignore nulls) over (order by ts, row_id) as seen_at from dirty, md, mk""")
def imputed_auto(spark, d):
    return C.impute_auto(_dirty(spark, d), ["ts", "row_id"], skip=["row_id", "user_name"])


@query("cl18_missing_report", """with r as (select count(*) as n, count(*)-count(kind) as k, count(*)-count(value) as v, count(*)-count(sparse) as s, count(*)-count(seen_at) as t from dirty)
select 'row_id' as column_name, 0 as missing_count, 0.0::double as missing_percentage, 'bigint' as data_type union all select 'ts', 0, 0, 'timestamp_ntz' union all select 'user_name', 0, 0, 'string'
union all select 'kind', k, round(k*100.0/n,6), 'string' from r union all select 'value', v, round(v*100.0/n,6), 'double' from r union all select 'sparse', s, round(s*100.0/n,6), 'double' from r
union all select 'seen_at', t, round(t*100.0/n,6), 'timestamp_ntz' from r union all select '*', k+v+s+t, round((k+v+s+t)*100.0/(n*7),6), 'table' from r""")
def missing_report(spark, d):
    return C.missing_report(_dirty(spark, d))


@query("cl18_missing_patterns", """select '000' || (kind is null)::int || (value is null)::int || (sparse is null)::int || (seen_at is null)::int as pattern, count(*) as rows from dirty group by 1""")
def missing_patterns(spark, d):
    return C.missing_patterns(_dirty(spark, d))


@query("cl19_outliers_removed", f"""with a as (select d.* from (select row_id, value, value*value as square from dirty) d, {IQR} b where value is null or value between lo and hi),
b as (select quantile_cont(square,0.25) as q1, quantile_cont(square,0.75) as q3 from a)
select row_id, round(value,6) as value, round(square,6) as square from a, b where square is null or square between q1-1.5*(q3-q1) and q3+1.5*(q3-q1)""")
def outliers_removed(spark, d):
    rows = dirty_log(spark, d).select("row_id", "value", (F.col("value") * F.col("value")).alias("square"))
    return C.handle_outliers(rows, ["value", "square"], "iqr", "remove")


def _flags(name, fence_sql):
    return f"select row_id, coalesce(value < lo or value > hi, false) as value_outlier_flag from dirty, ({fence_sql})"


@query("cl20_iqr_flags", f"select row_id, coalesce(value < lo or value > hi, false) as value_outlier_flag from dirty, {IQR}")
def iqr_flags(spark, d):
    return C.handle_outliers(dirty_log(spark, d).select("row_id", "value"), ["value"], "iqr", "flag").drop("value")


@query("cl21_zscore_flags", _flags("zscore", "select avg(value)-3*stddev_pop(value) as lo, avg(value)+3*stddev_pop(value) as hi from dirty"))
def zscore_flags(spark, d):
    return C.handle_outliers(dirty_log(spark, d).select("row_id", "value"), ["value"], "zscore", "flag").drop("value")


@query("cl22_modified_zscore_flags", """with m as (select median(value) as m from dirty), x as (select median(abs(value-m)) as mad from dirty, m)
select row_id, coalesce(abs(0.6745*(value-m)/mad) > 3.5, false) as value_outlier_flag from dirty, m, x""")
def modified_zscore_flags(spark, d):
    return C.handle_outliers(dirty_log(spark, d).select("row_id", "value"), ["value"], "modified_zscore", "flag").drop("value")


@query("cl24_percentile_flags", _flags("percentile", "select quantile_cont(value,0.01) as lo, quantile_cont(value,0.99) as hi from dirty"))
def percentile_flags(spark, d):
    return C.handle_outliers(dirty_log(spark, d).select("row_id", "value"), ["value"], "percentile", "flag").drop("value")


@query("cl25_capped", f"""with z as (select avg(value)-3*stddev_pop(value) as a, avg(value)+3*stddev_pop(value) as b from dirty)
select row_id, round(case when value < a or value > b then greatest(lo, least(hi, value)) else value end,6) as value from dirty, {IQR}, z""")
def capped(spark, d):
    return C.handle_outliers(dirty_log(spark, d).select("row_id", "value"), ["value"], "zscore", "cap")


@query("cl27_transformed", """select row_id, round(ln(1+p),6) as all_positive, round(sqrt(abs(value)),6) as value from (select row_id, value, coalesce(value, 1) as p from dirty)""")
def transformed(spark, d):
    rows = dirty_log(spark, d).select("row_id", "value", F.coalesce("value", F.lit(1.0)).alias("all_positive"))
    return C.handle_outliers(rows, ["value", "all_positive"], action="transform")


@query("cl28_removed_zscore", """select row_id, round(value,6) as value from dirty, (select avg(value)-3*stddev_pop(value) as lo, avg(value)+3*stddev_pop(value) as hi from dirty) where value is null or value between lo and hi""")
def removed_zscore(spark, d):
    return C.handle_outliers(dirty_log(spark, d).select("row_id", "value"), ["value"], "zscore", "remove")


def _report(c):
    return f"""select '{c}' as column_name, count({c}) as count, round(avg({c}),6) as mean, round(median({c}),6) as median, round(stddev_samp({c}),6) as std, min({c})::double as min, max({c})::double as max,
 count(*) filter ({c} < q1-1.5*(q3-q1) or {c} > q3+1.5*(q3-q1)) as iqr_count, count(*) filter (abs({c}-m) > 3*sd) as zscore_count, count(*) filter ({c} < p1 or {c} > p99) as percentile_count,
 round(count(*) filter ({c} < q1-1.5*(q3-q1) or {c} > q3+1.5*(q3-q1))*100.0/count({c}),6) as iqr_percentage, round(count(*) filter (abs({c}-m) > 3*sd)*100.0/count({c}),6) as zscore_percentage,
 round(count(*) filter ({c} < p1 or {c} > p99)*100.0/count({c}),6) as percentile_percentage
 from dirty, (select quantile_cont({c},0.25) as q1, quantile_cont({c},0.75) as q3, avg({c}) as m, stddev_pop({c}) as sd, quantile_cont({c},0.01) as p1, quantile_cont({c},0.99) as p99 from dirty)"""


@query("cl29_outlier_report", _report("value") + " union all " + _report("sparse"))
def outlier_report(spark, d):
    return C.outlier_report(dirty_log(spark, d), ["value", "sparse"])


TEXTS = ["user_name", "kind", "value_text", "flag_text", "time_text"]


@query("cl30_converted_types", """select row_id, user_name, kind, try_cast(value_text as double) as value_text, flag_text = 'Yes' as flag_text, cast(time_text as timestamp) as time_text from dirty""")
def converted_types(spark, d):
    return C.convert_types(dirty_log(spark, d).select("row_id", *TEXTS))


@query("cl31_time_share", "select 'time_text' as column_name, count(*) as rows, 1.0::double as time_share, 'timestamp' as recommended_type from dirty")
def time_share(spark, d):
    return C.recommend_types(C.type_profile(dirty_log(spark, d), ["time_text"])).select("column_name", "rows", "time_share", "recommended_type")


@query("cl32_boolean_share", "select 'flag_text' as column_name, count(*) as rows, 1.0::double as boolean_share, 'boolean' as recommended_type from dirty")
def boolean_share(spark, d):
    return C.recommend_types(C.type_profile(dirty_log(spark, d), ["flag_text"])).select("column_name", "rows", "boolean_share", "recommended_type")


@query("cl33_number_share", """select 'value_text' as column_name, count(*) as rows, round(count(try_cast(value_text as double))/count(value_text),6) as number_share, false as whole_numbers, 'double' as recommended_type from dirty""")
def number_share(spark, d):
    return C.recommend_types(C.type_profile(dirty_log(spark, d), ["value_text"])).select("column_name", "rows", "number_share", "whole_numbers", "recommended_type")


@query("cl36_downcast", "select row_id, round(cast(value as float)::double,6) as value, row_id % 100 as small from dirty")
def downcast(spark, d):
    rows = dirty_log(spark, d).select("row_id", "value", (F.col("row_id") % 100).alias("small"))
    return C.downcast(rows).withColumn("value", F.col("value").cast("double"))


@query("cl37_converted_by_name", """select row_id, cast(time_text as timestamp) as START_TIME, flag_text = 'Yes' as IS_ACTIVE, kind as OTHER from dirty""")
def converted_by_name(spark, d):
    rows = dirty_log(spark, d).select("row_id", F.col("time_text").alias("START_TIME"), F.col("flag_text").alias("IS_ACTIVE"), F.col("kind").alias("OTHER"))
    return C.convert_by_name(rows)


@query("cl38_type_report", """select 'user_name' as column_name, count(*) as rows, count(user_name) as known, 0.0::double as time_share, 0.0::double as boolean_share, 0.0::double as number_share, count(distinct user_name) as distinct_values, 'category' as recommended_type from dirty
union all select 'kind', count(*), count(kind), 0, 0, 0, count(distinct kind), 'category' from dirty
union all select 'value_text', count(*), count(value_text), 0, round(count(*) filter (lower(value_text) in ('1','0','true','false','yes','no','on','off'))/count(value_text),6), round(count(try_cast(value_text as double))/count(value_text),6), count(distinct value_text), 'double' from dirty
union all select 'flag_text', count(*), count(flag_text), 0, 1, 0, count(distinct flag_text), 'boolean' from dirty
union all select 'time_text', count(*), count(time_text), 1, 0, 0, count(distinct time_text), 'timestamp' from dirty""")
def type_report(spark, d):
    return C.recommend_types(C.type_profile(dirty_log(spark, d), TEXTS)).drop("whole_numbers")
