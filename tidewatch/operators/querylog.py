"""Query-log mining: statement patterns, tables and columns used, access regularity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.expressions import flag, one_row, seconds_between
from tidewatch.functions.ordered import Slices, same_keys_join

# Statement kinds, limits.
KINDS = ("SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "DROP", "ALTER")
SLOW_MS = 1000.0
# Fixed patterns: a table follows FROM, JOIN, INSERT INTO or UPDATE; a column follows its clause.
TABLE = r"(?i)\b(?:FROM|JOIN|INSERT\s+INTO|UPDATE)\s+(\w+)"
COLUMN_ROLES = {"where": r"(?i)(?:WHERE|AND|OR)\s+(\w+)\s*[=<>!]", "join": r"(?i)\bON\s+(\w+)\s*=",
                "order_by": r"(?i)ORDER\s+BY\s+(\w+)", "group_by": r"(?i)GROUP\s+BY\s+(\w+)"}


def statement_pattern(text: Column) -> Column:
    """Upper case, literals and numbers as ?, single blanks."""
    p = F.trim(F.upper(text))
    p = F.regexp_replace(p, r"'[^']*'", "'?'")
    p = F.regexp_replace(p, r'"[^"]*"', '"?"')
    p = F.regexp_replace(p, r"\b\d+\b", "?")
    return F.regexp_replace(p, r"\s+", " ")


def statement_kind(text: Column) -> Column:
    kind = F.upper(F.regexp_extract(F.ltrim(text), r"^(?i)(" + "|".join(KINDS) + ")", 1))
    return F.when(kind == "", "UNKNOWN").otherwise(kind)


def pattern_statistics(df: DataFrame, text: str = "QUERY_TEXT") -> DataFrame:
    """Per pattern: md5, runs, times, rows, failures, last run."""
    rows = df.filter(F.col(text).isNotNull()).withColumn("query_pattern", statement_pattern(F.col(text)))
    ms = "EXECUTION_TIME_MS"
    return rows.groupBy("query_pattern").agg(
        F.count("*").alias("total_executions"), F.sum(ms).alias("total_duration_ms"), F.avg(ms).alias("avg_duration_ms"),
        F.min(ms).alias("min_duration_ms"), F.max(ms).alias("max_duration_ms"), F.sum("ROWS_PRODUCED").alias("total_rows"),
        F.count_if(F.col("EXECUTION_STATUS") == "FAIL").alias("failure_count"), F.max("START_TIME").alias("last_executed")) \
        .withColumn("query_hash", F.md5(F.encode("query_pattern", "utf-8")))


def slow_patterns(stats: DataFrame, threshold: float = SLOW_MS, limit: int = 10) -> DataFrame:
    return stats.filter(F.col("avg_duration_ms") >= threshold).orderBy(F.desc("avg_duration_ms"), "query_pattern").limit(limit)


def frequent_patterns(stats: DataFrame, limit: int = 10) -> DataFrame:
    return stats.orderBy(F.desc("total_executions"), "query_pattern").limit(limit)


def pattern_summary(stats: DataFrame, threshold: float = SLOW_MS) -> DataFrame:
    return stats.agg(
        F.count("*").alias("total_queries"), F.sum("total_executions").alias("total_executions"),
        (F.sum("total_duration_ms") / F.sum("total_executions")).alias("avg_execution_time_ms"),
        F.count_if(F.col("avg_duration_ms") >= threshold).alias("slow_query_count"), F.sum("failure_count").alias("failed_query_count"))


def table_statistics(df: DataFrame, text: str = "QUERY_TEXT") -> DataFrame:
    """Per first table of the statement: runs and times."""
    name = F.lower(F.regexp_extract(F.col(text), TABLE, 1))
    return (df.withColumn("table_name", F.when(name != "", name)).dropna(subset=["table_name"]).groupBy("table_name")
            .agg(F.count("*").alias("query_count"), F.sum("EXECUTION_TIME_MS").alias("total_duration_ms"),
                 F.avg("EXECUTION_TIME_MS").alias("avg_duration_ms")))


def suggestions(stats: DataFrame, tables: DataFrame, threshold: float = SLOW_MS) -> DataFrame:
    """(suggestion, subject, measure): slow repeated patterns, heavy tables, SELECT * patterns."""
    slow = stats.agg(F.count_if((F.col("avg_duration_ms") > threshold) & (F.col("total_executions") > 5)).cast("double").alias("measure"))
    star = stats.agg(F.count_if(F.contains("query_pattern", F.lit("SELECT *")) & (F.col("total_executions") > 10)).cast("double").alias("measure"))
    heavy = tables.filter((F.col("query_count") > 100) & (F.col("avg_duration_ms") > 500)).select(
        F.lit("index_table").alias("suggestion"), F.col("table_name").alias("subject"), F.col("avg_duration_ms").alias("measure"))
    named = lambda df, name: df.filter("measure > 0").select(F.lit(name).alias("suggestion"), F.lit(None).cast("string").alias("subject"), "measure")
    return named(slow, "optimize_slow_patterns").unionByName(heavy).unionByName(named(star, "replace_select_star"))


def executions_of(df: DataFrame, table: str, since: str, text: str = "QUERY_TEXT") -> DataFrame:
    name = F.lower(F.regexp_extract(F.col(text), TABLE, 1))
    return df.filter((F.col("START_TIME") >= F.lit(since).cast("timestamp_ntz")) & (name == table.lower()))


def _columns_in(role: str, pattern: str) -> Column:
    names = F.array_distinct(F.transform(F.regexp_extract_all("t", F.lit(pattern), 1), F.lower))
    pairs = F.transform(names, lambda c: F.struct(F.lit(role).alias("role"), c.alias("column_name")))
    return pairs.cast("array<struct<role:string,column_name:string>>")


def column_usage(df: DataFrame, text: str = "QUERY_TEXT") -> DataFrame:
    """(table_name, role, column_name, uses): every table of a statement with each column its clauses name.

    Distinct statements are counted first, so each text is parsed once however often it ran.
    """
    texts = df.filter(F.col(text).isNotNull()).groupBy(F.col(text).alias("t")).agg(F.count("*").alias("runs"))
    tables = F.array_distinct(F.transform(F.regexp_extract_all("t", F.lit(TABLE), 1), F.lower))
    found = F.flatten(F.array(*[_columns_in(role, p) for role, p in COLUMN_ROLES.items()]))
    rows = texts.select("runs", F.explode(tables).alias("table_name"), found.alias("found"))
    rows = rows.select("runs", "table_name", F.explode("found").alias("f"))
    return rows.groupBy("table_name", "f.role", "f.column_name").agg(F.sum("runs").alias("uses"))


def statement_features(df: DataFrame, text: str = "QUERY_TEXT") -> DataFrame:
    """Per pattern: kind, tables and issue flags."""
    t = F.col(text)
    patterns = df.filter(t.isNotNull()).groupBy(statement_pattern(t).alias("query_pattern")).agg(
        F.count("*").alias("runs"), F.min(text).alias("t"))
    p = F.col("t")
    kind = statement_kind(p)
    tables = F.array_distinct(F.transform(F.regexp_extract_all("t", F.lit(TABLE), 1), F.lower))
    select = kind == "SELECT"
    return patterns.withColumns({
        "query_type": kind, "tables": tables,
        "missing_where_clause": flag(select & ~p.rlike(r"(?i)\bWHERE\b")),
        "select_star_usage": flag(p.rlike(r"(?i)SELECT\s+\*")),
        "potential_cartesian_product": flag((F.size(tables) > 1) & ~p.rlike(r"(?i)\bJOIN\b")),
        "missing_order_by": flag(select & ~p.rlike(r"(?i)ORDER\s+BY"))}).drop("t")


def statement_report(df: DataFrame, top: int = 10) -> DataFrame:
    """(section, name, count): kinds, the most used tables, issues."""
    f = statement_features(df)
    kinds = f.groupBy(F.col("query_type").alias("name")).agg(F.count("*").alias("count")).select(F.lit("query_type").alias("section"), "name", "count")
    tables = (f.select(F.explode("tables").alias("name")).groupBy("name").agg(F.count("*").alias("count"))
              .orderBy(F.desc("count"), "name").limit(top).select(F.lit("table").alias("section"), "name", "count"))
    names = ["missing_where_clause", "select_star_usage", "potential_cartesian_product", "missing_order_by"]
    issues = f.agg(*[F.sum(n).alias(n) for n in names]).select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("name"), F.col(n).alias("count")) for n in names])).alias("i"))
    issues = issues.select(F.lit("issue").alias("section"), "i.name", "i.count")
    return kinds.unionByName(tables).unionByName(issues)


def access_patterns(df: DataFrame, key: str, ts: str, tie: str, as_of: str) -> DataFrame:
    """Per key, from the gaps between accesses: temporal, frequency, seasonal, sequential or random."""
    rows = df.select(key, ts, tie).dropna(subset=[key])
    slices = Slices(rows, [key], [ts, tie])
    gaps = slices.done(slices.previous(slices.df, {"_before": ts})).withColumn("_gap", seconds_between(F.col("_before"), F.col(ts)))
    now = F.lit(as_of).cast("timestamp_ntz")
    recent = F.col(ts) >= now - F.expr("interval 1 hour")
    stats = gaps.groupBy(key).agg(F.count("*").alias("accesses"), F.avg("_gap").alias("avg_interval"),
                                  F.stddev_pop("_gap").alias("_sd"), F.avg(flag(recent)).alias("recent_share"))
    near = same_keys_join(gaps.filter("_gap is not null"), stats.select(key, "avg_interval"), [key], "inner")
    near = near.groupBy(key).agg(F.avg(flag(F.abs(F.col("_gap") - F.col("avg_interval")) < F.col("avg_interval") * 0.5)).alias("similar_share"))
    out = same_keys_join(stats, near, [key], "left")
    cv = F.when(F.col("avg_interval") > 0, F.col("_sd") / F.col("avg_interval"))
    kind = (F.when(F.col("accesses") < 3, "random").when(F.col("recent_share") > 0.7, "temporal")
            .when(cv < 0.3, F.when(F.col("avg_interval") < 60, "frequency").otherwise("seasonal"))
            .when((F.col("accesses") > 10) & (F.col("similar_share") > 0.6), "sequential").otherwise("random"))
    return out.withColumns({"variation": cv, "access_pattern": kind}).drop("_sd")


def slow_calls(df: DataFrame, group: str, value: str, factor: float = 3.0) -> DataFrame:
    """Calls slower than ``factor`` times the mean of their group.

    The group means are joined back, so a hot group is not gathered for a window.
    """
    means = df.groupBy(group).agg(F.avg(value).alias("group_mean"))
    return same_keys_join(df, means, [group], "inner").filter(F.col(value) > F.col("group_mean") * factor)
