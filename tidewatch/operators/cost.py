"""Cost aggregation: summary, allocation, dimensions, series, savings opportunities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tidewatch.functions.expressions import attach, flag, one_row, period, seconds_between
from tidewatch.functions.ordered import Slices, same_keys_join
from tidewatch.functions.quantiles import counted_quantiles, group_quantiles, label, quantile_row
from tidewatch.functions.ranks import gini, with_ranks, with_running_share
from tidewatch.operators.temporal import PERIOD, UNITS
from tidewatch.session import is_small, materialise

# Price, currency, budgets, query cost classes, percentiles, window sizes.
CREDIT_PRICE = 2.0
CURRENCY = "USD"
BUDGETS = {"daily": 1000.0, "weekly": 7000.0, "monthly": 30000.0, "quarterly": 90000.0}
COST_CLASSES = {"low_cost_query": 0.01, "medium_cost_query": 0.1, "high_cost_query": 1.0,
                "very_high_cost_query": 10.0}
PERCENTILES = (0.5, 0.75, 0.9, 0.95, 0.99)
SERIES_WINDOWS = {"hourly": [3, 6, 12, 24], "daily": [3, 7, 14, 30], "weekly": [2, 4, 8, 12], "monthly": [2, 3, 6, 12]}
SPIKE_SIGMAS = 3.0
ALLOCATION_DIMENSIONS = ("USER_NAME", "WAREHOUSE_NAME", "DATABASE_NAME", "ROLE_NAME", "QUERY_TYPE")
CREDITS, TIME, COST = "CREDITS_USED", "START_TIME", "cost_amount"


def with_cost(df: DataFrame, price: float = CREDIT_PRICE) -> DataFrame:
    return df.withColumn(COST, F.col(CREDITS) * price)


def basic_summary(df: DataFrame) -> DataFrame:
    """One row: totals, per-query means, percentiles, time span, counts over each cost class."""
    df = with_cost(df)
    n = F.count(F.lit(1))
    hours = (F.max(F.unix_micros(F.col(TIME).cast("timestamp")))
             - F.min(F.unix_micros(F.col(TIME).cast("timestamp")))) / 3.6e9
    row = df.agg(
        F.sum(CREDITS).alias("total_credits_used"), F.sum(COST).alias("total_cost_amount"),
        n.alias("total_queries"), (F.sum(CREDITS) / F.greatest(n, F.lit(1))).alias("avg_credits_per_query"),
        (F.sum(COST) / F.greatest(n, F.lit(1))).alias("avg_cost_per_query"),
        F.lit(CURRENCY).alias("currency"), F.min(TIME).alias("analysis_period_start"),
        F.max(TIME).alias("analysis_period_end"), hours.alias("analysis_duration_hours"),
        *[F.count_if(F.col(CREDITS) >= v).alias(f"{k}_count") for k, v in COST_CLASSES.items()])
    row = row.withColumns({f"{k}_percentage": F.col(f"{k}_count") / F.greatest("total_queries", F.lit(1)) * 100
                           for k in COST_CLASSES})
    q = quantile_row(df, [CREDITS, COST], list(PERCENTILES))
    names = {f"{c}_{label(p)}": f"{short}_{label(p)}"
             for c, short in ((CREDITS, "credits"), (COST, "cost")) for p in PERCENTILES}
    row = attach(row, q, "_q")
    return row.withColumns({new: F.col(f"_q.{old}") for old, new in names.items()}).drop("_q")


def efficiency_summary(df: DataFrame) -> DataFrame:
    """One row: credits and cost per row, GB and hour (bottoms at least 1), and per-query spread."""
    df = with_cost(df)
    at_least_1 = lambda c: F.greatest(c, F.lit(1.0))
    per = {"row": at_least_1(F.sum("ROWS_PRODUCED")), "gb": at_least_1(F.sum("BYTES_SCANNED") / 1e9),
           "hour": at_least_1(F.sum("EXECUTION_TIME_MS") / 3.6e6)}
    row = df.agg(*[(F.sum(c) / b).alias(f"{short}_per_{name}") for name, b in per.items()
                   for short, c in (("credits", CREDITS), ("cost", COST))],
                 F.stddev_samp(CREDITS).alias("credits_per_query_std"),
                 F.stddev_samp(COST).alias("cost_per_query_std"))
    row = attach(row, quantile_row(df, [CREDITS, COST], [0.5, 0.9]), "_q")
    return row.withColumns({
        "credits_per_query_median": F.col(f"_q.{CREDITS}_p50"), "credits_per_query_p90": F.col(f"_q.{CREDITS}_p90"),
        "cost_per_query_median": F.col(f"_q.{COST}_p50"), "cost_per_query_p90": F.col(f"_q.{COST}_p90"),
    }).drop("_q")


def dimension_costs(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """(dimension, value, cost) for all dimensions in one shuffle; null values dropped."""
    pairs = with_cost(df).select(COST, F.explode(F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims])).alias("p"))
    return (pairs.filter("p.value is not null").groupBy("p.dimension", "p.value")
            .agg(F.sum(COST).alias("cost")))


def top_consumers(df: DataFrame, dims: Sequence[str], top: int = 10) -> DataFrame:
    """The largest consumers per dimension, with their share of the total cost."""
    total = with_cost(df).agg(F.sum(COST).alias("t"))
    w = Window.partitionBy("dimension").orderBy(F.desc("cost"), "value")
    return (dimension_costs(df, dims).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
            .withColumn("percentage", F.col("cost") / total.scalar() * 100))


def cost_inequality(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """(dimension, cost_gini)."""
    return gini(dimension_costs(df, dims), "cost", ["dimension"], "cost_gini")


def savings_summary(df: DataFrame) -> DataFrame:
    """One row: 30 % of the cost of the dearest tenth of queries, 20 % of that of little-used warehouses."""
    df = with_cost(df)
    dear = attach(df, quantile_row(df, [COST], [0.9]))
    row = dear.agg(F.sum(F.when(F.col(COST) >= F.col(f"_s.{COST}_p90"), F.col(COST))).alias("_dear"),
                   F.sum(COST).alias("_total"))
    by_wh = df.dropna(subset=["WAREHOUSE_NAME"]).groupBy("WAREHOUSE_NAME").agg(F.sum(COST).alias("c"))
    idle = attach(by_wh, quantile_row(by_wh, ["c"], [0.5])).agg(
        F.coalesce(F.sum(F.when(F.col("c") < F.col("_s.c_p50") * 0.5, F.col("c"))), F.lit(0.0)).alias("i"))
    return one_row(row, idle.withColumnRenamed("i", "_idle")).select(
        (F.col("_dear") * 0.3).alias("potential_savings_query_opt"),
        (F.col("_dear") * 0.3 / F.col("_total") * 100).alias("potential_savings_query_opt_percentage"),
        (F.col("_idle") * 0.2).alias("potential_savings_warehouse_opt"),
        (F.col("_idle") * 0.2 / F.col("_total") * 100).alias("potential_savings_warehouse_opt_percentage"))


def cost_summary(df: DataFrame) -> DataFrame:
    """The full one-row summary with spike thresholds and budgets."""
    unequal = cost_inequality(df, ALLOCATION_DIMENSIONS)
    spread = unequal.agg(*[F.max(F.when(F.col("dimension") == d, F.col("cost_gini"))).alias(f"{d}_cost_gini")
                           for d in ALLOCATION_DIMENSIONS])
    row = one_row(basic_summary(df), efficiency_summary(df), savings_summary(df), spread)
    return row.withColumns({
        "cost_spike_threshold": F.lit(SPIKE_SIGMAS), "usage_spike_threshold": F.lit(SPIKE_SIGMAS),
        **{f"{k}_budget_target": F.lit(v) for k, v in BUDGETS.items()}})


def cost_by_dimension(df: DataFrame, dim: str) -> DataFrame:
    """Statistics of credits, cost and the other metrics per value of one dimension; large inputs are read once."""
    others = ["EXECUTION_TIME_MS", "BYTES_SCANNED", "ROWS_PRODUCED"]
    small = is_small(df)
    df = df.dropna(subset=[dim])
    df = with_cost(df if small else materialise(df.select(dim, CREDITS, *others)))
    six = (("sum", F.sum), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))
    agg = df.groupBy(dim).agg(
        *[f(c).alias(f"{c}_{n}") for c in (CREDITS, COST) for n, f in six],
        F.count(CREDITS).alias(f"{CREDITS}_count"),
        *[f(c).alias(f"{c}_{n}") for c in others for n, f in (("sum", F.sum), ("mean", F.avg))])
    medians = group_quantiles(df, [dim], [CREDITS, COST, *others], [0.5]) if small else \
        counted_quantiles(df, [dim], [CREDITS, *others], [0.5], scaled={COST: (CREDITS, CREDIT_PRICE)})
    medians = medians.select(dim, *[F.col(f"{c}_p50").alias(f"{c}_median") for c in (CREDITS, COST, *others)])
    return same_keys_join(agg, medians, [dim], "left")


def add_cost_shares(agg: DataFrame, dim: str) -> DataFrame:
    out = with_running_share(agg, f"{COST}_sum", dim, "cost_share_percentage", "cumulative_cost_share")
    return out.withColumns({"is_top_20_percent": flag(F.col("cumulative_cost_share") <= 20),
                            "is_pareto_contributor": flag(F.col("cumulative_cost_share") <= 80)})


def add_cost_ranks(agg: DataFrame) -> DataFrame:
    for c, name in ((f"{COST}_sum", "cost"), (f"{CREDITS}_sum", "credits"), (f"{CREDITS}_count", "query_volume")):
        agg = with_ranks(agg, c, dense=f"{name}_rank", pct=f"{name}_percentile")
    return agg


def add_cost_ratios(agg: DataFrame) -> DataFrame:
    bottoms = {"query": F.col(f"{CREDITS}_count"), "row": F.col("ROWS_PRODUCED_sum") + 1,
               "gb": F.col("BYTES_SCANNED_sum") / 1e9 + 1}
    return agg.withColumns({f"{short}_per_{name}_efficiency": F.col(f"{c}_sum") / b
                            for name, b in bottoms.items() for short, c in (("credits", CREDITS), ("cost", COST))})


def analyze_dimension(df: DataFrame, dim: str) -> DataFrame:
    return add_cost_ratios(add_cost_ranks(add_cost_shares(cost_by_dimension(df, dim), dim)))


def cost_series(df: DataFrame, frequency: str, keys: Sequence[str] = ()) -> DataFrame:
    if frequency not in SERIES_WINDOWS:
        raise ValueError(f"Unsupported frequency: {frequency}")
    metrics = [c for c in ("EXECUTION_TIME_MS", "BYTES_SCANNED", "ROWS_PRODUCED") if c in df.columns]
    df = with_cost(df).withColumn(PERIOD, period(F.col(TIME), UNITS[frequency]))
    return df.groupBy(*keys, PERIOD).agg(
        F.sum(CREDITS).alias(f"{CREDITS}_sum"), F.avg(CREDITS).alias(f"{CREDITS}_mean"),
        F.count(CREDITS).alias(f"{CREDITS}_count"), F.sum(COST).alias(f"{COST}_sum"), F.avg(COST).alias(f"{COST}_mean"),
        *[f(c).alias(f"{c}_{n}") for c in metrics for n, f in (("sum", F.sum), ("mean", F.avg))])


def full_window(value: Column, rows) -> Column:
    """``value`` only where the frame is full."""
    size = -rows[0] + 1
    return F.when(F.count(F.lit(1)).over(rows[1]) == size, value)


def add_series_changes(series: DataFrame, frequency: str, keys: Sequence[str] = ()) -> DataFrame:
    """Change, relative change, moving means and 5-period deviation; null until a window is full."""
    w = Window.partitionBy(*keys).orderBy(PERIOD)
    out = {}
    for name, c in (("cost", f"{COST}_sum"), ("credits", f"{CREDITS}_sum")):
        before = F.lag(c).over(w)
        out[f"{name}_change"] = F.col(c) - before
        out[f"{name}_pct_change"] = F.when(before != 0, (F.col(c) - before) / before)
        for n in SERIES_WINDOWS[frequency]:
            rows = w.rowsBetween(-(n - 1), 0)
            out[f"{name}_ma_{n}"] = full_window(F.avg(c).over(rows), (-(n - 1), rows))
        rows = w.rowsBetween(-4, 0)
        out[f"{name}_volatility"] = full_window(F.stddev_samp(c).over(rows), (-4, rows))
    return series.withColumns(out)


def add_budget(series: DataFrame, frequency: str, keys: Sequence[str] = (), budgets=BUDGETS) -> DataFrame:
    """Variance to the period budget and running totals; no columns for periods without a budget."""
    if frequency not in budgets:
        return series
    w = Window.partitionBy(*keys).orderBy(PERIOD)
    budget, actual = F.lit(float(budgets[frequency])), F.col(f"{COST}_sum")
    spent = F.sum(actual).over(w.rowsBetween(Window.unboundedPreceding, 0))
    planned = budget * F.row_number().over(w)
    return series.withColumns({
        "budget_target": budget, "budget_actual": actual, "budget_variance": actual - budget,
        "budget_variance_pct": (actual - budget) / budget * 100, "is_over_budget": flag(actual > budget),
        "cumulative_cost": spent, "cumulative_budget": planned, "cumulative_variance": spent - planned})


def add_series_trend(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Slope of the whole series, its sign, and the slope of the last 5 periods."""
    w = Window.partitionBy(*keys).orderBy(PERIOD)
    whole, rows = Window.partitionBy(*keys), w.rowsBetween(-4, 0)
    series = series.withColumn("_i", F.row_number().over(w))
    enough = F.count(F.lit(1)).over(whole) >= 3
    out = {}
    for name, c in (("cost", f"{COST}_sum"), ("credits", f"{CREDITS}_sum")):
        slope = F.when(enough, F.regr_slope(F.col(c), F.col("_i")).over(whole))
        out[f"{name}_trend_slope"] = slope
        out[f"{name}_trend_direction"] = F.signum(slope)
    rolling = F.regr_slope(F.col(f"{COST}_sum"), F.col("_i")).over(rows)
    out["cost_rolling_trend"] = full_window(rolling, (-4, rows))
    return series.withColumns(out).drop("_i")


def high_cost_queries(df: DataFrame) -> DataFrame:
    """One row about queries at or over the 95th percentile of credits."""
    df = with_cost(df)
    marked = attach(df, quantile_row(df, [CREDITS], [0.95]))
    over = F.col(CREDITS) >= F.col(f"_s.{CREDITS}_p95")
    dear = F.when(over, F.col(COST))
    return marked.agg(F.first(f"_s.{CREDITS}_p95").alias("threshold_credits"), F.count(dear).alias("count"),
                      F.sum(dear).alias("total_cost"),
                      (F.sum(dear) / F.sum(COST) * 100).alias("percentage_of_total_cost"),
                      F.avg(dear).alias("avg_cost"))


def high_cost_patterns(df: DataFrame, top_users: int = 5) -> DataFrame:
    """(pattern, value, cost) of the dear queries: by type, by database, and the top users."""
    marked = attach(df, quantile_row(df, [CREDITS], [0.95]))
    dear = marked.filter(F.col(CREDITS) >= F.col(f"_s.{CREDITS}_p95")).drop("_s")
    costs = dimension_costs(dear, ["QUERY_TYPE", "DATABASE_NAME", "USER_NAME"])
    w = Window.partitionBy("dimension").orderBy(F.desc("cost"), "value")
    return (costs.withColumn("_rank", F.row_number().over(w))
            .filter((F.col("dimension") != "USER_NAME") | (F.col("_rank") <= top_users)).drop("_rank"))


def inefficient_users(df: DataFrame) -> DataFrame:
    """Users whose mean credits per query reach the 75th percentile of user means."""
    by_user = (with_cost(df).dropna(subset=["USER_NAME"]).groupBy("USER_NAME")
               .agg(F.sum(CREDITS).alias("credits_sum"), F.avg(CREDITS).alias("credits_mean"),
                    F.count(CREDITS).alias("query_count"), F.sum(COST).alias("cost_sum"),
                    F.sum("ROWS_PRODUCED").alias("_rows")))
    by_user = by_user.withColumn("credits_per_row", F.col("credits_sum") / (F.col("_rows") + 1)).drop("_rows")
    marked = attach(by_user, quantile_row(by_user, ["credits_mean"], [0.75]))
    return (marked.withColumn("threshold_credits_per_query", F.col("_s.credits_mean_p75"))
            .filter(F.col("credits_mean") >= F.col("threshold_credits_per_query")).drop("_s"))


def warehouse_rates(df: DataFrame) -> DataFrame:
    us = F.unix_micros(F.col(TIME).cast("timestamp"))
    return (with_cost(df).dropna(subset=["WAREHOUSE_NAME"]).groupBy("WAREHOUSE_NAME")
            .agg(F.sum(CREDITS).alias("credits_sum"), F.sum(COST).alias("cost_sum"),
                 F.greatest((F.max(us) - F.min(us)) / 3.6e9, F.lit(1.0)).alias("_hours"))
            .withColumn("credits_per_hour", F.col("credits_sum") / F.col("_hours")).drop("_hours"))


def underused_warehouses(df: DataFrame, share: float = 0.25) -> DataFrame:
    """Warehouses under ``share`` of the median credits per hour, with 30 % of their cost as saving."""
    rates = warehouse_rates(df)
    marked = attach(rates, quantile_row(rates, ["credits_per_hour"], [0.5]))
    limit = F.col("_s.credits_per_hour_p50") * share
    return (marked.withColumns({"threshold_credits_per_hour": limit, "potential_savings": F.col("cost_sum") * 0.3})
            .filter(F.col("credits_per_hour") < limit).drop("_s"))


def cost_spikes(df: DataFrame, sigmas: float = SPIKE_SIGMAS) -> DataFrame:
    """Days whose credits exceed mean + ``sigmas`` sample deviations of the daily totals."""
    daily = df.groupBy(period(F.col(TIME), "day").alias("date")).agg(F.sum(CREDITS).alias("credits"))
    stats = daily.agg((F.avg("credits") + sigmas * F.stddev_samp("credits")).alias("t"))
    return (daily.withColumn("threshold_credits", stats.scalar())
            .filter(F.col("credits") > F.col("threshold_credits"))
            .withColumn("spike_cost", F.col("credits") * CREDIT_PRICE))


def idle_time(df: DataFrame, long_minutes: float = 60.0, tie: str = "QUERY_ID") -> DataFrame:
    """Gaps between consecutive starts per warehouse; a warehouse with one row has no gaps."""
    log = df.select("WAREHOUSE_NAME", TIME, tie).dropna(subset=["WAREHOUSE_NAME"])
    slices = Slices(log, ["WAREHOUSE_NAME"], [TIME, tie])
    rows = slices.previous(slices.df, {"_before": TIME})
    gap = seconds_between(F.col("_before"), F.col(TIME)) / 60
    long_gap = F.when(F.col("_gap") > long_minutes, F.col("_gap"))
    return (slices.done(rows).withColumn("_gap", gap).groupBy("WAREHOUSE_NAME")
            .agg(F.avg("_gap").alias("avg_gap_minutes"), F.max("_gap").alias("max_gap_minutes"),
                 F.count(long_gap).alias("idle_periods_count"),
                 (F.coalesce(F.sum(long_gap), F.lit(0.0)) / 60).alias("total_idle_hours"))
            .filter("avg_gap_minutes is not null"))


def optimisation_candidates(df: DataFrame) -> DataFrame:
    """One row of candidate counts: dear with little output, slow and dear, repeated dear texts."""
    df = df.withColumn("_per_row", F.col(CREDITS) / (F.col("ROWS_PRODUCED") + 1))
    q = quantile_row(df, [CREDITS, "_per_row", "EXECUTION_TIME_MS"], [0.8, 0.9])
    marked = attach(df, q)
    row = marked.agg(
        F.count_if((F.col(CREDITS) > F.col(f"_s.{CREDITS}_p80"))
                   & (F.col("_per_row") > F.col("_s._per_row_p90"))).alias("high_cost_low_output"),
        F.count_if((F.col("EXECUTION_TIME_MS") > F.col("_s.EXECUTION_TIME_MS_p90"))
                   & (F.col(CREDITS) > F.col(f"_s.{CREDITS}_p90"))).alias("long_and_expensive"))
    texts = df.dropna(subset=["QUERY_TEXT"]).groupBy("QUERY_TEXT").agg(F.count(CREDITS).alias("n"), F.sum(CREDITS).alias("s"))
    repeated = attach(texts, quantile_row(texts, ["s"], [0.8])).agg(
        F.count_if((F.col("n") > 5) & (F.col("s") > F.col("_s.s_p80"))).alias("r"))
    return row.withColumn("repeated_expensive_patterns", repeated.scalar())


def warehouse_sizing(df: DataFrame) -> DataFrame:
    out = with_cost(df).dropna(subset=["WAREHOUSE_NAME"]).groupBy("WAREHOUSE_NAME").agg(
        F.avg(CREDITS).alias("avg_credits_per_query"), F.max(CREDITS).alias("max_credits_per_query"),
        F.sum(COST).alias("total_cost"))
    used = F.when(F.col("max_credits_per_query") > 0,
                  F.col("avg_credits_per_query") / F.col("max_credits_per_query")).otherwise(0.0)
    return out.withColumns({
        "utilization_ratio": used,
        "recommendation": F.when(used < 0.3, "downsize").when(used > 0.8, "upsize").otherwise("optimal")})


def opportunities(df: DataFrame) -> dict[str, DataFrame]:
    return {
        "high_cost_queries": high_cost_queries(df), "inefficient_users": inefficient_users(df),
        "underutilized_warehouses": underused_warehouses(df), "cost_spikes": cost_spikes(df),
        "idle_time_analysis": idle_time(df), "query_optimization_candidates": optimisation_candidates(df),
        "warehouse_sizing_recommendations": warehouse_sizing(df)}


def opportunity_counts(df: DataFrame) -> DataFrame:
    """(opportunity, rows) over all finders."""
    parts = [t.agg(F.lit(name).alias("opportunity"), F.count("*").alias("rows"))
             for name, t in opportunities(df).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
