"""Queries over dimensional aggregation."""

from pyspark.sql import functions as F

from tidewatch.operators import dimensional as D
from tidewatch.plans.registry import query
from tidewatch.sources.tables import cost_facts, query_log

STATS = {"CREDITS_USED": ["sum", "mean", "max", "std"], "EXECUTION_TIME_MS": ["mean", "median"]}
DIMS = ["DATABASE_NAME", "WAREHOUSE_NAME", "QUERY_TYPE"]


def PCT(v, part=""):
    """SQL of the average-tie percentile rank."""
    over = f"partition by {part}" if part else ""
    peers = f"partition by {part + ',' if part else ''} {v}"
    return (f"(rank() over ({over} order by {v}) + (count(*) over ({peers}) - 1) / 2.0) / count(*) over ({over})")


@query("da01_by_dimensions", """
select DATABASE_NAME, QUERY_TYPE, count(*) as query_count, round(sum(CREDITS_USED),6) as CREDITS_USED_sum,
  round(avg(CREDITS_USED),6) as CREDITS_USED_mean, round(max(CREDITS_USED),6) as CREDITS_USED_max,
  round(stddev_samp(CREDITS_USED),6) as CREDITS_USED_std, round(avg(EXECUTION_TIME_MS),6) as EXECUTION_TIME_MS_mean,
  round(median(EXECUTION_TIME_MS),6) as EXECUTION_TIME_MS_median
from facts group by 1, 2 having count(*) >= 5""")
def by_dimensions(spark, d):
    return D.aggregate_by(cost_facts(spark, d), ["DATABASE_NAME", "QUERY_TYPE"], STATS)


@query("da02_usable_dimensions", """
select * from (select 'USER_NAME' as dimension, count(distinct USER_NAME) as cardinality, case when count(distinct USER_NAME) <= 1000 then 1 else 0 end as is_kept from facts
union all select 'WAREHOUSE_NAME', count(distinct WAREHOUSE_NAME), case when count(distinct WAREHOUSE_NAME) <= 1000 then 1 else 0 end from facts
union all select 'QUERY_TYPE', count(distinct QUERY_TYPE), case when count(distinct QUERY_TYPE) <= 1000 then 1 else 0 end from facts)""")
def usable_dimensions(spark, d):
    dims = D.cardinalities(cost_facts(spark, d), ["USER_NAME", "WAREHOUSE_NAME", "QUERY_TYPE"])
    return dims.withColumn("is_kept", (F.col("cardinality") <= D.MAX_CARDINALITY).cast("int"))


@query("da03_group_percentiles", """
select WAREHOUSE_NAME, count(*) as query_count, round(sum(CREDITS_USED),6) as CREDITS_USED_sum,
  round(quantile_cont(CREDITS_USED, 0.5),6) as CREDITS_USED_p50, round(quantile_cont(CREDITS_USED, 0.9),6) as CREDITS_USED_p90,
  round(quantile_cont(CREDITS_USED, 0.99),6) as CREDITS_USED_p99
from facts group by 1 having count(*) >= 5""")
def group_percentiles(spark, d):
    return D.aggregate_by(cost_facts(spark, d), ["WAREHOUSE_NAME"], {"CREDITS_USED": ["sum"]}, [50, 90, 99])


@query("da04_rankings", f"""
with g as (select USER_NAME, count(*) as query_count, max(ROWS_PRODUCED) as ROWS_PRODUCED_max from facts group by 1 having count(*) >= 5)
select USER_NAME, query_count, ROWS_PRODUCED_max, dense_rank() over (order by ROWS_PRODUCED_max desc) as ROWS_PRODUCED_max_rank,
  round({PCT('ROWS_PRODUCED_max')}, 6) as ROWS_PRODUCED_max_percentile,
  case when dense_rank() over (order by ROWS_PRODUCED_max desc) <= 50 then 1 else 0 end as ROWS_PRODUCED_max_top_50 from g""")
def rankings(spark, d):
    agg = D.aggregate_by(cost_facts(spark, d), ["USER_NAME"], {"ROWS_PRODUCED": ["max"]})
    return D.add_rankings(agg, ["ROWS_PRODUCED_max"])


@query("da05_distribution", """
select QUERY_TYPE, count(*) as query_count, round(sum(CREDITS_USED),6) as CREDITS_USED_sum, round(skewness(CREDITS_USED),6) as CREDITS_USED_skewness,
  round(kurtosis(CREDITS_USED),6) as CREDITS_USED_kurtosis, round(stddev_samp(CREDITS_USED)/(avg(CREDITS_USED)+1e-10),6) as CREDITS_USED_cv,
  round(quantile_cont(CREDITS_USED,0.75)-quantile_cont(CREDITS_USED,0.25),6) as CREDITS_USED_iqr, round(max(CREDITS_USED)-min(CREDITS_USED),6) as CREDITS_USED_range
from facts group by 1""")
def distribution(spark, d):
    facts = cost_facts(spark, d)
    agg = D.aggregate_by(facts, ["QUERY_TYPE"], {"CREDITS_USED": ["sum"]})
    return D.add_distribution(agg, facts, ["QUERY_TYPE"], ["CREDITS_USED"])


RATIO_SQL = ", ".join(
    f"{expr} as {name}" for name, expr in [
        ("credits_per_row", "c/(r+1e-10)"), ("credits_per_byte", "c/(b+1e-10)"), ("time_per_row", "t/(r+1e-10)"),
        ("time_per_byte", "t/(b+1e-10)"), ("bytes_per_row", "b/(r+1e-10)"), ("queries_per_credit", "n/(c+1e-10)")])
RATIO_NAMES = ["credits_per_row", "credits_per_byte", "time_per_row", "time_per_byte", "bytes_per_row", "queries_per_credit"]


@query("da06_efficiency", f"""
with g as (select WAREHOUSE_NAME, count(*) as n, sum(CREDITS_USED) as c, sum(ROWS_PRODUCED) as r, sum(BYTES_SCANNED) as b, sum(EXECUTION_TIME_MS) as t,
    avg(BYTES_SCANNED) as bm, avg(EXECUTION_TIME_MS) as tm from qlog group by 1),
x as (select *, {RATIO_SQL} from g)
select WAREHOUSE_NAME, {', '.join(f"round({r},6) as {r}, dense_rank() over (order by {r}) as {r}_rank, round({PCT(r)},6) as {r}_percentile" for r in RATIO_NAMES)},
  round(c/(t/1000+1e-10),6) as resource_intensity, round(sqrt(bm*tm),3) as complexity_score from x""")
def efficiency(spark, d):
    stats = {"CREDITS_USED": ["sum"], "ROWS_PRODUCED": ["sum"], "BYTES_SCANNED": ["sum", "mean"],
             "EXECUTION_TIME_MS": ["sum", "mean"]}
    agg = D.aggregate_by(query_log(spark, d), ["WAREHOUSE_NAME"], stats)
    out = D.add_efficiency(agg, {"credits": "CREDITS_USED", "rows": "ROWS_PRODUCED", "bytes": "BYTES_SCANNED",
                                 "time": "EXECUTION_TIME_MS"})
    out = out.withColumn("complexity_score", F.round("complexity_score", 3))
    return out.drop("query_count", *[f"{m}_{f}" for m, fs in stats.items() for f in fs])


@query("da07_outliers", """
with g as (select USER_NAME, count(*) as query_count, sum(CREDITS_USED) as s from facts group by 1 having count(*) >= 5),
b as (select quantile_cont(s,0.25) as q1, quantile_cont(s,0.75) as q3, avg(s) as m, stddev_samp(s) as sd from g)
select USER_NAME, query_count, round(s,6) as CREDITS_USED_sum, case when s < q1-1.5*(q3-q1) or s > q3+1.5*(q3-q1) then 1 else 0 end as CREDITS_USED_sum_is_outlier,
  round(abs((s-m)/sd),6) as CREDITS_USED_sum_z_score, case when abs((s-m)/sd) > 3 then 1 else 0 end as CREDITS_USED_sum_is_extreme from g, b""")
def outliers(spark, d):
    agg = D.aggregate_by(cost_facts(spark, d), ["USER_NAME"], {"CREDITS_USED": ["sum"]})
    return D.add_outliers(agg, ["CREDITS_USED_sum"])


@query("da08_hierarchy", """
with l as (
 select DATABASE_NAME, null as WAREHOUSE_NAME, null as USER_NAME, count(*) as query_count, sum(CREDITS_USED) as s, 1 as hierarchy_level, DATABASE_NAME as hierarchy_path, '' as parent from facts group by 1
 union all select DATABASE_NAME, WAREHOUSE_NAME, null, count(*), sum(CREDITS_USED), 2, DATABASE_NAME || ' > ' || WAREHOUSE_NAME, DATABASE_NAME from facts group by 1, 2
 union all select DATABASE_NAME, WAREHOUSE_NAME, USER_NAME, count(*), sum(CREDITS_USED), 3, DATABASE_NAME || ' > ' || WAREHOUSE_NAME || ' > ' || USER_NAME, DATABASE_NAME || ' > ' || WAREHOUSE_NAME from facts group by 1, 2, 3)
select DATABASE_NAME, WAREHOUSE_NAME, USER_NAME, query_count, round(s,6) as CREDITS_USED_sum, hierarchy_level, 'geography' as hierarchy_name, hierarchy_path,
  round(case when hierarchy_level > 1 then query_count/(sum(query_count) over p + 1e-10) end,6) as query_count_parent_share,
  round(case when hierarchy_level > 1 then s/(sum(s) over p + 1e-10) end,6) as CREDITS_USED_sum_parent_share
from l window p as (partition by hierarchy_level, parent)""")
def hierarchy(spark, d):
    return D.aggregate_hierarchy(cost_facts(spark, d), "geography", ["DATABASE_NAME", "WAREHOUSE_NAME", "USER_NAME"],
                                 {"CREDITS_USED": ["sum"]})


@query("da09_combinations", """
with g as (
 select DATABASE_NAME, QUERY_TYPE, null as SCHEMA_NAME, count(*) as n, sum(CREDITS_USED) as s, avg(CREDITS_USED) as m, 'DATABASE_NAME_x_QUERY_TYPE' as c, 2 as k from facts group by 1, 2
 union all select DATABASE_NAME, null, SCHEMA_NAME, count(*), sum(CREDITS_USED), avg(CREDITS_USED), 'DATABASE_NAME_x_SCHEMA_NAME', 2 from facts group by 1, 3
 union all select null, QUERY_TYPE, SCHEMA_NAME, count(*), sum(CREDITS_USED), avg(CREDITS_USED), 'QUERY_TYPE_x_SCHEMA_NAME', 2 from facts group by 2, 3
 union all select DATABASE_NAME, QUERY_TYPE, SCHEMA_NAME, count(*), sum(CREDITS_USED), avg(CREDITS_USED), 'DATABASE_NAME_x_QUERY_TYPE_x_SCHEMA_NAME', 3 from facts group by 1, 2, 3)
select DATABASE_NAME, QUERY_TYPE, SCHEMA_NAME, n as query_count, round(s,6) as CREDITS_USED_sum, round(m,6) as CREDITS_USED_mean, c as dimension_combination, k as num_dimensions
from g where n >= 5""")
def dimension_combinations(spark, d):
    return D.aggregate_combinations(cost_facts(spark, d), ["DATABASE_NAME", "QUERY_TYPE", "SCHEMA_NAME"],
                                    {"CREDITS_USED": ["sum", "mean"]})


@query("da10_interaction", """
with g as (select DATABASE_NAME, QUERY_TYPE, count(*) as query_count, sum(CREDITS_USED) as s from facts group by 1, 2)
select DATABASE_NAME, QUERY_TYPE, query_count, round(s,6) as CREDITS_USED_sum,
  round((select stddev_samp(s)/(avg(s)+1e-10) from g),6) as CREDITS_USED_sum_interaction_strength,
  round((select avg(v) from (select var_samp(s) as v from g group by DATABASE_NAME))/((select var_samp(s) from g)+1e-10),6) as CREDITS_USED_sum_DATABASE_NAME_dominance,
  round((select avg(v) from (select var_samp(s) as v from g group by QUERY_TYPE))/((select var_samp(s) from g)+1e-10),6) as CREDITS_USED_sum_QUERY_TYPE_dominance
from g""")
def interaction(spark, d):
    agg = D.aggregate_by(cost_facts(spark, d), ["DATABASE_NAME", "QUERY_TYPE"], {"CREDITS_USED": ["sum"]})
    return D.interaction(agg, ["DATABASE_NAME", "QUERY_TYPE"], ["CREDITS_USED_sum"])


def _profile_sql(dim):
    return f"""select '{dim}' as dimension_name, count(*) as cardinality, (select count(*) from qlog) as total_records,
  (select count(*) from qlog where {dim} is null) as null_count, 0.0::double as null_percentage,
  (select sum(n) from (select count(*) as n from qlog group by {dim} order by n desc limit 10))/(select count(*) from qlog)::double as concentration_ratio_top10,
  (select sum(n) from (select count(*) as n from qlog group by {dim} order by n desc limit 20))/(select count(*) from qlog)::double as concentration_ratio_top20,
  min(n) as min_frequency, max(n) as max_frequency, avg(n) as mean_frequency, stddev_samp(n) as frequency_std,
  2.0*sum(i*n)/(count(*)*sum(n)) - (count(*)+1.0)/count(*) as gini_coefficient,
  (select sum(k*pow(m-(select avg(CREDITS_USED) from qlog),2))/(select count(*) from qlog)/(select var_samp(CREDITS_USED) from qlog)
    from (select count(*) as k, avg(CREDITS_USED) as m from qlog group by {dim})) as importance_score
from (select count(*) as n, row_number() over (order by count(*)) as i from qlog group by {dim})"""


@query("da11_dimension_profiles", """
select dimension_name, cardinality, total_records, null_count, null_percentage, round(concentration_ratio_top10,6) as concentration_ratio_top10,
  round(concentration_ratio_top20,6) as concentration_ratio_top20, min_frequency, max_frequency, round(mean_frequency,6) as mean_frequency,
  round(frequency_std,6) as frequency_std, round(gini_coefficient,6) as gini_coefficient, round(importance_score,6) as importance_score
from (""" + " union all ".join(_profile_sql(x) for x in ("USER_NAME", "WAREHOUSE_NAME", "QUERY_TYPE")) + ")")
def dimension_profiles(spark, d):
    return D.dimension_profiles(query_log(spark, d), ["USER_NAME", "WAREHOUSE_NAME", "QUERY_TYPE"], ["CREDITS_USED"])


@query("da11_top_values", """
select 'USER_NAME' as dimension, USER_NAME as value, count(*) as frequency, row_number() over (order by count(*) desc, USER_NAME) as rank
from facts group by 2 qualify rank <= 50""")
def top_values(spark, d):
    return D.top_values(cost_facts(spark, d), ["USER_NAME"])


@query("da12_importance", """
select 'WAREHOUSE_NAME' as dimension, round((c + e)/2, 6) as importance_score from (
select least(1, sum(n*pow(cm-(select avg(CREDITS_USED) from facts),2))/(select count(*) from facts)/(select var_samp(CREDITS_USED) from facts)) as c,
  least(1, sum(n*pow(rm-(select avg(ROWS_PRODUCED) from facts),2))/(select count(*) from facts)/(select var_samp(ROWS_PRODUCED) from facts)) as e
from (select count(*) as n, avg(CREDITS_USED) as cm, avg(ROWS_PRODUCED) as rm from facts group by WAREHOUSE_NAME))""")
def importance(spark, d):
    return D.importance(cost_facts(spark, d), ["WAREHOUSE_NAME"], ["CREDITS_USED", "ROWS_PRODUCED"])
