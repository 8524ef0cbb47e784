"""Queries over query-log mining."""

from pyspark.sql import functions as F

from tidewatch.operators import querylog as Q
from tidewatch.plans.registry import query
from tidewatch.sources.tables import query_log, table

# Fixed texts: statement shapes given to the log rows by row number.
SHAPE_SQL = """stm as (select *, case cast(QUERY_ID as bigint) % 6 when 0 then 'select a, b from t_' || lower(QUERY_TYPE) || ' where b > ' || ROWS_PRODUCED || ' order by a'
 when 1 then 'SELECT * FROM orders o JOIN t_' || lower(QUERY_TYPE) || ' ON k = k2 WHERE name = ''x' || ROWS_PRODUCED || ''' GROUP BY a'
 when 2 then 'INSERT INTO log_' || lower(QUERY_TYPE) || ' VALUES (' || ROWS_PRODUCED || ')' when 3 then 'update t_' || lower(QUERY_TYPE) || ' set a = 1 where id = ' || ROWS_PRODUCED
 when 4 then 'SELECT  *   FROM t_' || lower(QUERY_TYPE) else 'CALL refresh(' || ROWS_PRODUCED || ')' end as STM from qlog)"""
PATTERN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(upper(STM)), '''[^'']*''', '''?''', 'g'), '"[^"]*"', '"?"', 'g'), '\b\d+\b', '?', 'g'), '\s+', ' ', 'g')"""
STATS = f"""{SHAPE_SQL}, pat as (select {PATTERN} as query_pattern, count(*) as total_executions, sum(EXECUTION_TIME_MS) as total_duration_ms, avg(EXECUTION_TIME_MS) as avg_duration_ms, min(EXECUTION_TIME_MS) as min_duration_ms,
 max(EXECUTION_TIME_MS) as max_duration_ms, cast(sum(ROWS_PRODUCED) as bigint) as total_rows, count(*) filter (EXECUTION_STATUS='FAIL') as failure_count, max(START_TIME) as last_executed from stm group by 1)"""
ROUNDED = ", ".join(f"round({c},6) as {c}" for c in ("total_duration_ms", "avg_duration_ms", "min_duration_ms", "max_duration_ms"))
COLS = f"query_pattern, md5(query_pattern) as query_hash, total_executions, {ROUNDED}, total_rows, failure_count, last_executed"


def statements(spark, d):
    log = query_log(spark, d)
    kind, n = F.lower("QUERY_TYPE"), F.col("ROWS_PRODUCED").cast("string")
    i = F.col("QUERY_ID").cast("bigint") % 6
    text = (F.when(i == 0, F.concat(F.lit("select a, b from t_"), kind, F.lit(" where b > "), n, F.lit(" order by a")))
            .when(i == 1, F.concat(F.lit("SELECT * FROM orders o JOIN t_"), kind, F.lit(" ON k = k2 WHERE name = 'x"), n, F.lit("' GROUP BY a")))
            .when(i == 2, F.concat(F.lit("INSERT INTO log_"), kind, F.lit(" VALUES ("), n, F.lit(")")))
            .when(i == 3, F.concat(F.lit("update t_"), kind, F.lit(" set a = 1 where id = "), n))
            .when(i == 4, F.concat(F.lit("SELECT  *   FROM t_"), kind)).otherwise(F.concat(F.lit("CALL refresh("), n, F.lit(")"))))
    return log.withColumn("QUERY_TEXT", text)


@query("ql01_pattern_statistics", f"with {STATS} select {COLS} from pat")
def pattern_statistics(spark, d):
    return Q.pattern_statistics(statements(spark, d))


@query("ql02_slow_patterns", f"with {STATS} select {COLS} from pat where avg_duration_ms >= 1000 order by pat.avg_duration_ms desc, query_pattern limit 10")
def slow_patterns(spark, d):
    return Q.slow_patterns(Q.pattern_statistics(statements(spark, d)))


@query("ql02_frequent_patterns", f"with {STATS} select {COLS} from pat order by total_executions desc, query_pattern limit 10")
def frequent_patterns(spark, d):
    return Q.frequent_patterns(Q.pattern_statistics(statements(spark, d)))


@query("ql02_pattern_summary", f"""with {STATS} select count(*) as total_queries, cast(sum(total_executions) as bigint) as total_executions, round(sum(total_duration_ms)/sum(total_executions),6) as avg_execution_time_ms,
 count(*) filter (avg_duration_ms >= 1000) as slow_query_count, cast(sum(failure_count) as bigint) as failed_query_count from pat""")
def pattern_summary(spark, d):
    return Q.pattern_summary(Q.pattern_statistics(statements(spark, d)))


TABLES = """tab as (select lower(regexp_extract(STM, '(?i)\\b(?:FROM|JOIN|INSERT\\s+INTO|UPDATE)\\s+(\\w+)', 1)) as table_name, count(*) as query_count, sum(EXECUTION_TIME_MS) as total_duration_ms, avg(EXECUTION_TIME_MS) as avg_duration_ms
 from stm group by 1 having table_name <> '')"""


@query("ql03_table_statistics", f"with {SHAPE_SQL}, {TABLES} select table_name, query_count, round(total_duration_ms,6) as total_duration_ms, round(avg_duration_ms,6) as avg_duration_ms from tab")
def table_statistics(spark, d):
    return Q.table_statistics(statements(spark, d))


@query("ql03_suggestions", f"""with {STATS}, {TABLES} select 'optimize_slow_patterns' as suggestion, null::varchar as subject, count(*)::double as measure from pat where avg_duration_ms > 1000 and total_executions > 5 having count(*) > 0
union all select 'index_table', table_name, round(avg_duration_ms,6) from tab where query_count > 100 and avg_duration_ms > 500
union all select 'replace_select_star', null, count(*) from pat where contains(query_pattern, 'SELECT *') and total_executions > 10 having count(*) > 0""")
def suggestions(spark, d):
    log = statements(spark, d)
    return Q.suggestions(Q.pattern_statistics(log), Q.table_statistics(log))


@query("ql03_table_executions", f"""with {SHAPE_SQL} select QUERY_ID, START_TIME from stm where lower(regexp_extract(STM, '(?i)\\b(?:FROM|JOIN|INSERT\\s+INTO|UPDATE)\\s+(\\w+)', 1)) = 't_view' and START_TIME >= timestamp '2024-01-10 00:00:00'""")
def table_executions(spark, d):
    return Q.executions_of(statements(spark, d), "t_view", "2024-01-10 00:00:00").select("QUERY_ID", "START_TIME")


@query("ql04_column_usage", f"""with {SHAPE_SQL}, t as (select QUERY_ID, STM, unnest(list_distinct(list_transform(regexp_extract_all(STM, '(?i)\\b(?:FROM|JOIN|INSERT\\s+INTO|UPDATE)\\s+(\\w+)', 1), lambda x: lower(x)))) as table_name from stm),
c as (select table_name, 'where' as role, unnest(list_distinct(list_transform(regexp_extract_all(STM, '(?i)(?:WHERE|AND|OR)\\s+(\\w+)\\s*[=<>!]', 1), lambda x: lower(x)))) as column_name from t
 union all select table_name, 'join', unnest(list_distinct(list_transform(regexp_extract_all(STM, '(?i)\\bON\\s+(\\w+)\\s*=', 1), lambda x: lower(x)))) from t
 union all select table_name, 'order_by', unnest(list_distinct(list_transform(regexp_extract_all(STM, '(?i)ORDER\\s+BY\\s+(\\w+)', 1), lambda x: lower(x)))) from t
 union all select table_name, 'group_by', unnest(list_distinct(list_transform(regexp_extract_all(STM, '(?i)GROUP\\s+BY\\s+(\\w+)', 1), lambda x: lower(x)))) from t)
select table_name, role, column_name, count(*) as uses from c group by 1, 2, 3""")
def column_usage(spark, d):
    return Q.column_usage(statements(spark, d))


@query("ql05_statement_report", f"""with {SHAPE_SQL}, p as (select {PATTERN} as pat, min(STM) as s from stm group by 1), f as (select s, case when regexp_extract(upper(ltrim(s)), '^(SELECT|INSERT|UPDATE|DELETE|CREATE|DROP|ALTER)', 1) = '' then 'UNKNOWN'
 else regexp_extract(upper(ltrim(s)), '^(SELECT|INSERT|UPDATE|DELETE|CREATE|DROP|ALTER)', 1) end as k, list_distinct(list_transform(regexp_extract_all(s, '(?i)\\b(?:FROM|JOIN|INSERT\\s+INTO|UPDATE)\\s+(\\w+)', 1), lambda x: lower(x))) as t from p),
u as (select unnest(t) as name from f)
select 'query_type' as section, k as name, count(*) as count from f group by 2 union all (select 'table', name, count(*) from u group by 2 order by 3 desc, 2 limit 10)
union all select 'issue', 'missing_where_clause', count(*) from f where k = 'SELECT' and not regexp_matches(s, '(?i)\\bWHERE\\b') union all select 'issue', 'select_star_usage', count(*) from f where regexp_matches(s, '(?i)SELECT\\s+\\*')
union all select 'issue', 'potential_cartesian_product', count(*) from f where len(t) > 1 and not regexp_matches(s, '(?i)\\bJOIN\\b') union all select 'issue', 'missing_order_by', count(*) from f where k = 'SELECT' and not regexp_matches(s, '(?i)ORDER\\s+BY')""")
def statement_report(spark, d):
    return Q.statement_report(statements(spark, d))


@query("ql06_access_patterns", """with g as (select USER_NAME, START_TIME, (epoch_us(START_TIME)-epoch_us(lag(START_TIME) over (partition by USER_NAME order by START_TIME, QUERY_ID)))/1e6 as gap from qlog),
s as (select USER_NAME, count(*) as accesses, avg(gap) as a, stddev_pop(gap) as sd, avg(case when START_TIME >= timestamp '2024-01-30 22:00:00' then 1.0 else 0 end) as r from g group by 1),
n as (select USER_NAME, avg(case when abs(gap-a) < a*0.5 then 1.0 else 0 end) as sim from g join s using (USER_NAME) where gap is not null group by 1)
select USER_NAME, accesses, round(a,6) as avg_interval, round(r,6) as recent_share, round(sim,6) as similar_share, round(sd/a,6) as variation,
 case when accesses < 3 then 'random' when r > 0.7 then 'temporal' when sd/a < 0.3 then case when a < 60 then 'frequency' else 'seasonal' end when accesses > 10 and sim > 0.6 then 'sequential' else 'random' end as access_pattern
from s left join n using (USER_NAME)""")
def access_patterns(spark, d):
    return Q.access_patterns(query_log(spark, d), "USER_NAME", "START_TIME", "QUERY_ID", "2024-01-30 23:00:00")


@query("ql07_slow_calls", """with m as (select QUERY_TYPE, avg(EXECUTION_TIME_MS) as m from qlog group by 1)
select QUERY_ID, q.QUERY_TYPE, round(EXECUTION_TIME_MS,6) as EXECUTION_TIME_MS, round(m,6) as group_mean from qlog q join m on q.QUERY_TYPE = m.QUERY_TYPE where EXECUTION_TIME_MS > 3*m""")
def slow_calls(spark, d):
    return Q.slow_calls(query_log(spark, d).select("QUERY_ID", "QUERY_TYPE", "EXECUTION_TIME_MS"), "QUERY_TYPE", "EXECUTION_TIME_MS")
