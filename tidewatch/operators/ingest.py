"""Cleaning and derivation of collected history: queries, metering, load, logins, storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tidewatch.functions.expressions import attach, cut, flag, one_row, period, ratio, seconds_between
from tidewatch.functions.quantiles import quantile_row
from tidewatch.functions.ordered import same_keys_join
from tidewatch.operators.usage import distincts
from tidewatch.sources.history import SOURCES

# Limits, maps and prices of the derivations.
INF = float("inf")
SPEED_CLASSES = ([0, 1e3, 1e4, 6e4, 3e5, INF], ["Fast", "Normal", "Slow", "Very Slow", "Extremely Slow"])
LOAD_CLASSES = ([0, 0.2, 0.5, 0.8, 1.0, INF], ["Low", "Medium", "High", "Very High", "Overloaded"])
CATEGORIES = {"SELECT": "read_queries", "INSERT": "write_queries", "UPDATE": "write_queries", "DELETE": "write_queries",
              "CREATE": "ddl_queries", "ALTER": "ddl_queries", "DROP": "ddl_queries", "COPY": "data_loading",
              "UNLOAD": "data_export"}
CLIENTS = {"JDBC_DRIVER": "Application", "ODBC_DRIVER": "Application", "PYTHON_CONNECTOR": "Script/API",
           "WEB_UI": "Web Interface", "SQL_CLI": "CLI Tool"}
AUTOMATED = "(?i)automated|scheduled|pipeline|etl|job"
NUMERIC_PARTS = ("CREDIT", "BYTE", "ROW", "TIME", "SIZE")
QUERY_NUMBERS = ("TOTAL_ELAPSED_TIME", "BYTES_SCANNED", "BYTES_WRITTEN", "ROWS_PRODUCED", "COMPILATION_TIME",
                 "EXECUTION_TIME", "QUEUED_PROVISIONING_TIME", "QUEUED_REPAIR_TIME", "QUEUED_OVERLOAD_TIME",
                 "TRANSACTION_BLOCKED_TIME")
USAGE_NUMBERS = ("CREDITS_USED", "CREDITS_USED_COMPUTE", "CREDITS_USED_CLOUD_SERVICES", "BYTES_SCANNED",
                 "BYTES_WRITTEN", "BYTES_DELETED")
LOAD_NUMBERS = ("AVG_RUNNING", "AVG_QUEUED_LOAD", "AVG_QUEUED_PROVISIONING", "AVG_BLOCKED")
SLOW_MS = 60_000
CREDIT_RATE = 3.0
STORAGE_PER_TIB_DAY = 40.0 / 30
GIB, TIB = 1024 ** 3, 1024 ** 4


def first_by_key(df: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """One row per key: the first by ``order``, or any when rows of a key are copies.

    An aggregate, not a window, so copies combine before the shuffle.
    """
    if order is None:
        return df.dropDuplicates(list(keys))
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r"))
            .select(*keys, "_r.*").select(*df.columns))


def clean_source(df: DataFrame, name: str, order: str | None = None) -> DataFrame:
    """Dedup by the source key, drop rows without time, cast text columns by their names."""
    source = SOURCES[name]
    out = first_by_key(df, source.keys, order).dropna(subset=[source.time])
    casts = {}
    for f in out.schema.fields:
        upper = f.name.upper()
        if f.dataType.typeName() != "string":
            continue
        if upper in ("START_TIME", "END_TIME", "EVENT_TIMESTAMP"):
            casts[f.name] = F.expr(f"try_to_timestamp(`{f.name}`)").cast("timestamp_ntz")
        elif any(part in upper for part in NUMERIC_PARTS):
            casts[f.name] = F.expr(f"try_cast(`{f.name}` as double)")
    return out.withColumns(casts)


def _numbers(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.expr(f"try_cast(`{c}` as double)"), F.lit(0.0)) for c in names if c in df.columns})


def clean_queries(df: DataFrame) -> DataFrame:
    return _numbers(first_by_key(df, ["QUERY_ID"]), QUERY_NUMBERS).dropna(subset=["QUERY_ID", "START_TIME"])


def clean_usage(df: DataFrame, order: str | None = None) -> DataFrame:
    return _numbers(first_by_key(df, ["START_TIME", "WAREHOUSE_ID"], order), USAGE_NUMBERS).dropna(subset=["WAREHOUSE_ID", "START_TIME"])


def clean_load(df: DataFrame, order: str | None = None) -> DataFrame:
    return _numbers(first_by_key(df, ["START_TIME", "WAREHOUSE_ID"], order), LOAD_NUMBERS).dropna(subset=["WAREHOUSE_ID", "START_TIME"])


def _or_zero(df: DataFrame, *names: str) -> Column:
    present = [F.col(n) for n in names if n in df.columns]
    return sum(present[1:], present[0]) if present else F.lit(0.0)


def derive_query_metrics(df: DataFrame) -> DataFrame:
    """Duration, throughput, cache, spill and wait ratios (0 on a zero bottom) and a speed class."""
    df = df.withColumn("QUERY_DURATION_MS", seconds_between(F.col("START_TIME"), F.col("END_TIME")) * 1000)
    ms = F.col("QUERY_DURATION_MS")
    spilled = _or_zero(df, "BYTES_SPILLED_TO_LOCAL_STORAGE", "BYTES_SPILLED_TO_REMOTE_STORAGE")
    waited = _or_zero(df, "QUEUED_PROVISIONING_TIME", "QUEUED_REPAIR_TIME", "QUEUED_OVERLOAD_TIME", "TRANSACTION_BLOCKED_TIME")
    return df.withColumns({
        "BYTES_PER_SECOND": ratio(F.col("BYTES_SCANNED") * 1000, ms), "ROWS_PER_SECOND": ratio(F.col("ROWS_PRODUCED") * 1000, ms),
        "CACHE_HIT_RATIO": _or_zero(df, "PERCENTAGE_SCANNED_FROM_CACHE") / 100,
        "SPILLAGE_RATIO": ratio(spilled, F.col("BYTES_SCANNED")), "WAIT_TIME_RATIO": ratio(waited, ms),
        "PERFORMANCE_CLASS": cut(ms, *SPEED_CLASSES)})


def categorize_queries(df: DataFrame) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])
    kind = F.col("QUERY_TYPE")
    return df.withColumns({
        "QUERY_CATEGORY": F.when(kind.isNull() | (kind == ""), "unknown").otherwise(F.coalesce(F.try_element_at(kinds, kind), F.lit("other"))),
        "IS_AUTOMATED": F.coalesce(F.col("QUERY_TAG").rlike(AUTOMATED), F.lit(False)),
        "IS_RESOURCE_INTENSIVE": F.coalesce((F.col("BYTES_SCANNED") > 1e9) | (F.col("QUERY_DURATION_MS") > SLOW_MS)
                                            | (F.col("CREDITS_USED_CLOUD_SERVICES") > 1.0), F.lit(False))})


def query_metrics(df: DataFrame) -> DataFrame:
    return categorize_queries(derive_query_metrics(clean_queries(df)))


def performance_summary(df: DataFrame) -> DataFrame:
    status = F.col("EXECUTION_STATUS")
    row = df.agg(
        F.count("*").alias("total_queries"), F.count_if(status == "SUCCESS").alias("successful_queries"),
        F.count_if(status == "FAIL").alias("failed_queries"), F.count_if(status == "CANCELLED").alias("cancelled_queries"),
        F.avg("QUERY_DURATION_MS").alias("avg_duration_ms"), F.sum("BYTES_SCANNED").alias("total_bytes_scanned"),
        F.sum("ROWS_PRODUCED").alias("total_rows_produced"), F.avg("CACHE_HIT_RATIO").alias("avg_cache_hit_ratio"),
        F.count_if(F.col("QUERY_DURATION_MS") > SLOW_MS).alias("slow_queries_count"))
    middle = quantile_row(df, ["QUERY_DURATION_MS"], [0.5]).withColumnRenamed("QUERY_DURATION_MS_p50", "median_duration_ms")
    return one_row(row, middle)


# Issue name, measured column, limit, direction.
ISSUES = [("slow_queries", "QUERY_DURATION_MS", SLOW_MS, ">"), ("high_spillage", "SPILLAGE_RATIO", 0.1, ">"),
          ("low_cache_utilization", "CACHE_HIT_RATIO", 0.1, "<")]


def performance_issues(df: DataFrame, samples: int = 5) -> DataFrame:
    """Issue rows with count, mean measure and the ``samples`` smallest query ids."""
    marks = [F.when(F.col(c) > limit if sign == ">" else F.col(c) < limit,
                    F.struct(F.lit(name).alias("issue"), F.col(c).alias("measure"), F.col("QUERY_ID").alias("id")))
             for name, c, limit, sign in ISSUES]
    long = df.select(F.explode(F.array_compact(F.array(*marks))).alias("m")).select("m.*")
    totals = long.groupBy("issue").agg(F.count("*").alias("count"), F.avg("measure").alias("avg_measure"))
    w = Window.partitionBy("issue").orderBy("id")
    # the rank filter keeps only the first ids of each task before the shuffle
    first = long.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= samples)
    ids = first.groupBy("issue").agg(F.concat_ws(",", F.array_sort(F.collect_list("id"))).alias("sample_query_ids"))
    return same_keys_join(totals, ids, ["issue"], "left")


def optimisation_opportunities(df: DataFrame) -> DataFrame:
    """(type, count, measure): whole texts run more than 5 times, and scans over 10 GB."""
    texts = df.groupBy(F.xxhash64("QUERY_TEXT"), F.sha1(F.col("QUERY_TEXT").cast("binary"))).agg(F.count("*").alias("n")).filter("n > 5")
    repeated = texts.agg(F.lit("repeated_queries").alias("type"), F.count("*").alias("count"), F.max("n").cast("double").alias("measure"))
    large = df.filter(F.col("BYTES_SCANNED") > 1e10).agg(
        F.lit("large_table_scans").alias("type"), F.count("*").alias("count"), F.avg("BYTES_SCANNED").alias("measure"))
    return repeated.unionByName(large).filter(F.col("count") > 0)


def resource_patterns(df: DataFrame) -> DataFrame:
    """By warehouse, by user and by hour in one pass; numbers rounded half-even to 2 digits."""
    rows = df.withColumn("HOUR", F.hour("START_TIME").cast("string"))
    long = rows.select("QUERY_DURATION_MS", "BYTES_SCANNED", F.explode(F.array(*[
        F.struct(F.lit(kind).alias("pattern"), F.col(c).alias("value"))
        for kind, c in (("by_warehouse", "WAREHOUSE_NAME"), ("by_user", "USER_NAME"), ("by_hour", "HOUR"))])).alias("p"))
    return long.filter("p.value is not null").groupBy("p.pattern", "p.value").agg(
        F.count("*").alias("query_count"), F.bround(F.avg("QUERY_DURATION_MS"), 2).alias("mean_duration_ms"),
        F.bround(F.sum("QUERY_DURATION_MS"), 2).alias("total_duration_ms"), F.sum("BYTES_SCANNED").alias("bytes_scanned"))


def hourly_trends(df: DataFrame) -> DataFrame:
    return df.groupBy(period(F.col("START_TIME"), "hour").alias("hour")).agg(
        F.count("QUERY_ID").alias("query_count"), F.avg("QUERY_DURATION_MS").alias("avg_duration_ms"),
        F.sum("BYTES_SCANNED").alias("bytes_scanned"), F.avg("CACHE_HIT_RATIO").alias("cache_hit_ratio"))


def query_recommendations(df: DataFrame) -> DataFrame:
    """(recommendation, measure, threshold) for each limit that is crossed."""
    row = df.agg(F.avg("QUERY_DURATION_MS").alias("d"), F.avg("CACHE_HIT_RATIO").alias("c"), F.avg("SPILLAGE_RATIO").alias("s"),
                 F.avg(flag(F.coalesce(F.col("EXECUTION_STATUS") != "SUCCESS", F.lit(True)))).alias("e"))
    rules = [("optimize_frequent_queries", "d", 30000.0, ">"), ("enable_result_caching", "c", 0.3, "<"),
             ("use_larger_warehouse", "s", 0.05, ">"), ("review_failed_queries", "e", 0.05, ">")]
    return _crossed(row, rules)


def _crossed(row: DataFrame, rules) -> DataFrame:
    marks = [F.when(F.col(c) > limit if sign == ">" else F.col(c) < limit, F.struct(
        F.lit(name).alias("recommendation"), F.col(c).alias("measure"), F.lit(float(limit)).alias("threshold")))
        for name, c, limit, sign in rules]
    return row.select(F.explode(F.array_compact(F.array(*marks))).alias("m")).select("m.*")


def derive_usage_metrics(df: DataFrame) -> DataFrame:
    """Hours, credits and GiB per hour, credit shares, cost and date parts of metering rows."""
    df = df.withColumn("PERIOD_DURATION_HOURS", seconds_between(F.col("START_TIME"), F.col("END_TIME")) / 3600)
    hours, used = F.col("PERIOD_DURATION_HOURS"), F.col("CREDITS_USED")
    return df.withColumns({
        "CREDITS_PER_HOUR": ratio(used, hours),
        "DATA_THROUGHPUT_GB_PER_HOUR": ratio(_or_zero(df, "BYTES_SCANNED", "BYTES_WRITTEN") / GIB, hours),
        "COMPUTE_CREDIT_RATIO": ratio(F.col("CREDITS_USED_COMPUTE"), used),
        "CLOUD_SERVICES_RATIO": ratio(F.col("CREDITS_USED_CLOUD_SERVICES"), used),
        "ESTIMATED_COST_USD": used * CREDIT_RATE, "HOUR_OF_DAY": F.hour("START_TIME"),
        "DAY_OF_WEEK": F.weekday("START_TIME"), "DATE": period(F.col("START_TIME"), "day")})


def derive_load_metrics(df: DataFrame) -> DataFrame:
    df = df.withColumn("TOTAL_LOAD", _or_zero(df, *LOAD_NUMBERS))
    total = F.col("TOTAL_LOAD")
    return df.withColumns({
        "UTILIZATION_RATIO": ratio(F.col("AVG_RUNNING"), total),
        "QUEUE_RATIO": ratio(F.col("AVG_QUEUED_LOAD") + F.col("AVG_QUEUED_PROVISIONING"), total),
        "BLOCKED_RATIO": ratio(F.col("AVG_BLOCKED"), total), "LOAD_CLASSIFICATION": cut(total, *LOAD_CLASSES),
        "HOUR_OF_DAY": F.hour("START_TIME"), "DAY_OF_WEEK": F.weekday("START_TIME"), "DATE": period(F.col("START_TIME"), "day")})


def usage_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.sum("CREDITS_USED").alias("total_credits_used"), F.avg("CREDITS_PER_HOUR").alias("avg_credits_per_hour"),
                  F.sum("ESTIMATED_COST_USD").alias("total_estimated_cost"), F.count_distinct("WAREHOUSE_NAME").alias("unique_warehouses"))


def usage_by_warehouse(df: DataFrame) -> DataFrame:
    return df.groupBy("WAREHOUSE_NAME").agg(
        F.bround(F.sum("CREDITS_USED"), 2).alias("CREDITS_USED"), F.bround(F.sum("ESTIMATED_COST_USD"), 2).alias("ESTIMATED_COST_USD"),
        F.bround(F.avg("CREDITS_PER_HOUR"), 2).alias("CREDITS_PER_HOUR"),
        F.bround(F.avg("DATA_THROUGHPUT_GB_PER_HOUR"), 2).alias("DATA_THROUGHPUT_GB_PER_HOUR"),
        F.bround(F.avg("COMPUTE_CREDIT_RATIO"), 2).alias("COMPUTE_CREDIT_RATIO"))


def usage_by_time(df: DataFrame) -> DataFrame:
    """(pattern, slot, credits) by hour of day and weekday."""
    cells = df.groupBy("HOUR_OF_DAY", "DAY_OF_WEEK").agg(F.sum("CREDITS_USED").alias("c"))
    long = cells.select("c", F.explode(F.array(
        F.struct(F.lit("hourly").alias("pattern"), F.col("HOUR_OF_DAY").alias("slot")),
        F.struct(F.lit("daily").alias("pattern"), F.col("DAY_OF_WEEK").alias("slot")))).alias("p"))
    return long.groupBy("p.pattern", "p.slot").agg(F.sum("c").alias("credits"))


def load_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.avg("UTILIZATION_RATIO").alias("avg_utilization"), F.avg("QUEUE_RATIO").alias("avg_queue_ratio"),
                  F.avg("BLOCKED_RATIO").alias("avg_blocked_ratio"), F.max("TOTAL_LOAD").alias("peak_load"),
                  F.count_if(F.col("TOTAL_LOAD") > 1.0).alias("overloaded_periods"))


def load_by_warehouse(df: DataFrame) -> DataFrame:
    return df.groupBy("WAREHOUSE_NAME").agg(
        *[F.bround(F.avg(c), 3).alias(c) for c in ("UTILIZATION_RATIO", "QUEUE_RATIO", "BLOCKED_RATIO")],
        F.bround(F.max("TOTAL_LOAD"), 3).alias("TOTAL_LOAD"))


def load_distribution(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["LOAD_CLASSIFICATION"]).groupBy("LOAD_CLASSIFICATION").agg(F.count("*").alias("periods"))


def cost_opportunities(df: DataFrame, credit_threshold: float = 10.0, top: int = 5) -> DataFrame:
    """(type, name, cost, share): dear warehouses (top 5), low compute share, weekend over 20 %."""
    wh = df.groupBy("WAREHOUSE_NAME").agg(F.sum("ESTIMATED_COST_USD").alias("cost"))
    dear = (wh.filter(F.col("cost") > credit_threshold * CREDIT_RATE).orderBy(F.desc("cost"), "WAREHOUSE_NAME").limit(top)
            .select(F.lit("high_cost_warehouses").alias("type"), F.col("WAREHOUSE_NAME").alias("name"), "cost",
                    F.lit(None).cast("double").alias("share")))
    cost = F.col("ESTIMATED_COST_USD")
    row = df.agg(F.sum(F.when(F.col("COMPUTE_CREDIT_RATIO") < 0.5, cost)).alias("low"),
                 F.sum(F.when(F.col("DAY_OF_WEEK") >= 5, cost)).alias("weekend"), F.sum(cost).alias("total"))
    share = F.col("weekend") / F.col("total") * 100
    rest = row.select(F.explode(F.array_compact(F.array(
        F.when(F.col("low").isNotNull(), F.struct(F.lit("low_efficiency_periods").alias("type"), F.lit(None).cast("string").alias("name"),
                                                  F.col("low").alias("cost"), F.lit(None).cast("double").alias("share"))),
        F.when(share > 20, F.struct(F.lit("weekend_usage").alias("type"), F.lit(None).cast("string").alias("name"),
                                    F.col("weekend").alias("cost"), share.alias("share")))))).alias("m")).select("m.*")
    return dear.unionByName(rest)


def load_issues(df: DataFrame) -> DataFrame:
    """(type, count, measure, affected_warehouses) of queueing, overload and blocking."""
    rules = [("high_queue_times", "QUEUE_RATIO", 0.3, "mean"), ("overloaded_warehouses", "TOTAL_LOAD", 1.0, "max"),
             ("high_blocked_ratio", "BLOCKED_RATIO", 0.1, "mean")]
    marks = [F.when(F.col(c) > limit, F.struct(F.lit(name).alias("type"), F.col(c).alias("v"), F.lit(how).alias("how"),
                                               F.col("WAREHOUSE_NAME").alias("wh"))) for name, c, limit, how in rules]
    long = df.select(F.explode(F.array_compact(F.array(*marks))).alias("m")).select("m.*")
    per_wh = long.groupBy("type", "how", "wh").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.max("v").alias("x"))
    return per_wh.groupBy("type").agg(
        F.sum("n").alias("count"),
        F.when(F.first("how") == "max", F.max("x")).otherwise(F.sum("s") / F.sum("n")).alias("measure"),
        F.concat_ws(",", F.array_sort(F.collect_list("wh"))).alias("affected_warehouses"))


def warehouse_recommendations(usage: DataFrame, load: DataFrame) -> DataFrame:
    """(recommendation, measure, threshold), plus the two general ones when both inputs have rows."""
    u = usage.agg((F.avg("CREDITS_PER_HOUR") * CREDIT_RATE).alias("cost"), F.avg("COMPUTE_CREDIT_RATIO").alias("compute"),
                  F.count("*").alias("urows"))
    l = load.agg(F.avg("UTILIZATION_RATIO").alias("used"), F.avg("QUEUE_RATIO").alias("queue"), F.count("*").alias("lrows"))
    row = one_row(u, l).withColumn("both", F.when((F.col("urows") > 0) & (F.col("lrows") > 0), F.lit(1.0)))
    rules = [("suspend_idle_and_resize", "cost", 50.0, ">"), ("review_compute_share", "compute", 0.7, "<"),
             ("consolidate_workloads", "used", 0.3, "<"), ("scale_up_for_queueing", "queue", 0.2, ">"),
             ("monitor_regularly", "both", 0.0, ">"), ("consider_auto_scaling", "both", 0.0, ">")]
    return _crossed(row, rules)


def action_items(usage: DataFrame, load: DataFrame) -> DataFrame:
    """Issues and opportunities as prioritised actions: High first."""
    issues = load_issues(load).select(F.lit("High").alias("priority"), F.lit("Performance").alias("category"),
                                      F.col("type").alias("title"), F.lit("Immediate").alias("urgency"), F.lit(0.0).alias("cost_impact"))
    savings = cost_opportunities(usage).groupBy("type").agg(
        F.max(F.when(F.col("type") == "low_efficiency_periods", F.col("cost"))).alias("c"))
    impact = F.coalesce(F.col("c"), F.lit(0.0))
    savings = savings.select(F.when(impact > 100, "High").otherwise("Medium").alias("priority"),
                             F.lit("Cost Optimization").alias("category"), F.col("type").alias("title"),
                             F.lit("Medium").alias("urgency"), impact.alias("cost_impact"))
    order = F.when(F.col("priority") == "High", 1).when(F.col("priority") == "Medium", 2).otherwise(3)
    return issues.unionByName(savings).withColumn("order", order).orderBy("order", "category", "title")


def executive_summary(usage: DataFrame, load: DataFrame) -> DataFrame:
    issues = load_issues(load).agg(F.count("*").alias("performance_issues_count"))
    saves = cost_opportunities(usage).agg(F.count_distinct("type").alias("optimization_opportunities_count"))
    u = usage_summary(usage).select(F.col("total_estimated_cost").alias("total_cost"), F.col("unique_warehouses").alias("warehouse_count"))
    l = load_summary(load).select("avg_utilization")
    return one_row(u, l, issues, saves).withColumns({
        "is_high_cost": flag(F.col("total_cost") > 1000), "is_low_utilization": flag(F.col("avg_utilization") < 0.5)})


def login_features(df: DataFrame) -> DataFrame:
    out = first_by_key(df, ["EVENT_ID"])
    kinds = F.create_map(*[F.lit(x) for pair in CLIENTS.items() for x in pair])
    hour, dow = F.hour("EVENT_TIMESTAMP"), F.weekday("EVENT_TIMESTAMP")
    return out.withColumns({
        "HOUR_OF_DAY": hour, "DAY_OF_WEEK": dow, "IS_WEEKEND": dow >= 5, "IS_BUSINESS_HOURS": hour.between(8, 18),
        "CLIENT_CATEGORY": F.coalesce(F.try_element_at(kinds, F.col("REPORTED_CLIENT_TYPE")), F.lit("Other"))})


def login_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total_logins"), F.count_distinct("USER_NAME").alias("unique_users"),
                  F.avg(flag(F.col("IS_SUCCESS") == "YES")).alias("success_rate"),
                  F.avg(flag(F.col("IS_WEEKEND"))).alias("weekend_activity_ratio"),
                  F.avg(flag(F.col("IS_BUSINESS_HOURS"))).alias("business_hours_ratio"))


def login_patterns(df: DataFrame, top: int = 10) -> DataFrame:
    """(pattern, name, logins): top users, client use, hours, and the users with most failures."""
    long = df.select(F.explode(F.array_compact(F.array(
        F.struct(F.lit("top_users").alias("pattern"), F.col("USER_NAME").alias("name")),
        F.struct(F.lit("client_usage").alias("pattern"), F.col("CLIENT_CATEGORY").alias("name")),
        F.struct(F.lit("hourly_pattern").alias("pattern"), F.col("HOUR_OF_DAY").cast("string").alias("name")),
        F.when(F.col("IS_SUCCESS") == "NO", F.struct(F.lit("failed_logins").alias("pattern"), F.col("USER_NAME").alias("name")))))).alias("p"))
    counts = long.groupBy("p.pattern", "p.name").agg(F.count("*").alias("logins"))
    w = Window.partitionBy("pattern").orderBy(F.desc("logins"), "name")
    capped = F.col("pattern").isin("top_users", "failed_logins")
    return counts.withColumn("_n", F.row_number().over(w)).filter(~capped | (F.col("_n") <= top)).drop("_n")


def metering_costs(df: DataFrame, rate: float = CREDIT_RATE) -> DataFrame:
    return df.withColumns({
        "ESTIMATED_COST_USD": F.col("CREDITS_USED") * rate, "COMPUTE_COST_USD": F.col("CREDITS_USED_COMPUTE") * rate,
        "CLOUD_SERVICES_COST_USD": F.col("CREDITS_USED_CLOUD_SERVICES") * rate, "DATE": period(F.col("START_TIME"), "day"),
        "HOUR": F.hour("START_TIME"), "DAY_OF_WEEK": F.weekday("START_TIME")})


def storage_costs(df: DataFrame) -> DataFrame:
    daily = F.col("AVERAGE_DATABASE_BYTES") / TIB * STORAGE_PER_TIB_DAY
    safe = F.col("AVERAGE_FAILSAFE_BYTES") / TIB * STORAGE_PER_TIB_DAY * 0.5
    return df.withColumns({"STORAGE_COST_USD": daily, "FAILSAFE_COST_USD": safe, "TOTAL_STORAGE_COST_USD": daily + safe})


def cost_report(df: DataFrame, cost: str, group: str, date: str, group_label: str, days: int = 7) -> DataFrame:
    """(section, name, cost): total, daily mean, cost by group and the last ``days`` dates."""
    daily = df.groupBy(date).agg(F.sum(cost).alias("c"))
    total = daily.select(F.explode(F.array(F.lit("total"))).alias("section"), "c").groupBy("section").agg(F.sum("c").alias("cost"))
    mean = daily.agg(F.lit("daily_mean").alias("section"), F.avg("c").alias("cost"))
    named = lambda t: t.select("section", F.lit(None).cast("string").alias("name"), "cost")
    by = df.groupBy(F.col(group).alias("name")).agg(F.sum(cost).alias("cost")).select(F.lit(group_label).alias("section"), "name", "cost")
    last = daily.orderBy(F.desc(date)).limit(days).select(
        F.lit("cost_trend").alias("section"), F.date_format(date, "yyyy-MM-dd").alias("name"), F.col("c").alias("cost"))
    return named(total).unionByName(named(mean)).unionByName(by).unionByName(last)


def total_costs(metering: DataFrame, storage: DataFrame) -> DataFrame:
    row = one_row(metering.agg(F.sum("ESTIMATED_COST_USD").alias("compute_cost_usd")),
                  storage.agg(F.sum("TOTAL_STORAGE_COST_USD").alias("storage_cost_usd")))
    total = F.col("compute_cost_usd") + F.col("storage_cost_usd")
    return row.withColumns({"total_cost_usd": total, "compute_pct": ratio(F.col("compute_cost_usd"), total) * 100,
                            "storage_pct": ratio(F.col("storage_cost_usd"), total) * 100})
