"""Thresholds, budgets, usage and performance checks, and alert rules, over metric points."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tidewatch.functions.expressions import attach, flag, one_row, period, seconds_between
from tidewatch.functions.order_spans import span_quantiles
from tidewatch.functions.ordered import SLICE, RowFrames, Slices, per_key, same_keys_join
from tidewatch.functions.quantiles import group_quantiles
from tidewatch.functions.spans import span_count, span_folds, span_max, span_mean, span_min, span_slope, span_std, span_totals
from tidewatch.operators.forecast import smoothing_forecast

HOUR = 3600
KEY, TS, TIE = "metric", "ts", "point_id"


def severity(x: Column, critical: float, high: float, medium: float, strict: bool = False) -> Column:
    over = (lambda v: x > v) if strict else (lambda v: x >= v)
    return F.when(over(critical), "critical").when(over(high), "high").when(over(medium), "medium").otherwise("low")


def compare(left: Column, op: str, right: Column) -> Column:
    """Numbers are equal within 1e-9."""
    near = F.abs(left - right) < 1e-9
    return {">": left > right, "<": left < right, ">=": (left > right) | near, "<=": (left < right) | near, "==": near, "!=": ~near}[op]


def compare_column(left: Column, op: Column, right: Column) -> Column:
    """The same with the operator in a column."""
    out = None
    for name in (">", "<", ">=", "<=", "==", "!="):
        cond = compare(left, name, right)
        out = F.when(op == name, cond) if out is None else out.when(op == name, cond)
    return out


# --- windows --------------------------------------------------------------------------------

def window_statistics(points: DataFrame, seconds: int = 300) -> DataFrame:
    """Per point over the last ``seconds`` of its metric (ends included): count, mean, min, max, latest."""
    rows = span_totals(points, [KEY], ["value"], TS, seconds, closed=True)
    rows = rows.withColumns({"window_count": F.coalesce(span_count("value"), F.lit(0).cast("bigint")), "window_mean": span_mean("value"),
                             "window_min": span_min("value"), "window_max": span_max("value")}).drop("_span_value")
    latest = {"_latest": (F.struct(TS, TIE, "value"), "max")}
    return span_folds(rows, [KEY], latest, TS, seconds, closed=True).withColumn("window_latest", F.col("_latest.value")).drop("_latest")


def window_anomalies(points: DataFrame, seconds: int = 300) -> DataFrame:
    """Points over 2 population deviations from the window mean, with more than 5 points in the window."""
    rows = span_totals(points, [KEY], ["value"], TS, seconds, closed=True)
    rows = rows.withColumns({"_n": span_count("value"), "window_mean": span_mean("value"), "window_std": span_std("value", sample=False)}).drop("_span_value")
    z = F.when(F.col("window_std") > 0, F.abs(F.col("value") - F.col("window_mean")) / F.col("window_std"))
    rows = rows.withColumn("deviation", z).filter((F.col("_n") > 5) & (F.col("deviation") > 2)).drop("_n")
    return rows.withColumn("severity", severity(F.col("deviation"), 4, 3, 2, strict=True))


# --- thresholds -----------------------------------------------------------------------------

def check_thresholds(points: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Violations of (threshold_id, metric, op, limit); severity by relative excess 1 / .5 / .2."""
    rows = points.join(thresholds, KEY).filter(compare_column(F.col("value"), F.col("op"), F.col("limit")))
    up = F.col("op").isin(">", ">=")
    excess = F.when(up, F.col("value") - F.col("limit")).otherwise(F.col("limit") - F.col("value")) / F.nullif(F.col("limit"), F.lit(0.0))
    return rows.withColumn("severity", F.when(F.col("limit") == 0, "medium").otherwise(severity(excess, 1, 0.5, 0.2)))


def dynamic_limits(points: DataFrame, sensitivity: float = 0.2, low: float | None = None, high: float | None = None) -> DataFrame:
    """Mean of the last hour (point included) times 1 + ``sensitivity``, clamped."""
    rows = span_totals(points, [KEY], ["value"], TS, HOUR, closed=True)
    limit = span_mean("value") * (1 + sensitivity)
    if low is not None:
        limit = F.greatest(limit, F.lit(float(low)))
    if high is not None:
        limit = F.least(limit, F.lit(float(high)))
    return rows.withColumn("dynamic_limit", limit).drop("_span_value")


def adaptive_limits(points: DataFrame, static: float, k: float = 2.0, least_points: int = 10) -> DataFrame:
    """Mean + k sample deviations of the last hour; the static limit below ``least_points`` points."""
    rows = span_totals(points, [KEY], ["value"], TS, HOUR, closed=True)
    limit = F.when(span_count("value") >= least_points, span_mean("value") + k * span_std("value")).otherwise(F.lit(float(static)))
    return rows.withColumn("adaptive_limit", limit).drop("_span_value")


def percentile_limits(points: DataFrame, p: float = 0.95, static: float = 0.0, least_points: int = 10) -> DataFrame:
    """Exclusive quantile of the metric's last hour; the static limit below ``least_points`` points."""
    rows = span_quantiles(points, [KEY], "value", TS, HOUR, [p], "exclusive", closed=True)
    return rows.withColumn("percentile_limit", F.when(F.col("_n") >= least_points, F.col("_q")[0]).otherwise(F.lit(float(static)))).drop("_n", "_q")


def adapt_limits(thresholds: DataFrame, points: DataFrame, k: float = 2.0, change: float = 0.1) -> DataFrame:
    """Stored limits moved to mean + k deviations of their metric when that differs by more than ``change``."""
    stats = points.groupBy(KEY).agg((F.avg("value") + k * F.stddev_samp("value")).alias("_new"))
    rows = same_keys_join(thresholds, stats, [KEY], "left")
    moved = F.abs(F.col("_new") - F.col("limit")) / F.abs("limit") > change
    return rows.withColumns({"is_adapted": flag(moved), "limit": F.when(moved, F.col("_new")).otherwise(F.col("limit"))}).drop("_new")


def metric_statistics(points: DataFrame) -> DataFrame:
    """Per metric: count, mean, extremes, sample deviation and exclusive p50/p95/p99."""
    stats = points.groupBy(KEY).agg(F.count("value").alias("points"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"),
                                    F.stddev_samp("value").alias("std"))
    return same_keys_join(stats, group_quantiles(points, [KEY], ["value"], [0.5, 0.95, 0.99], "exclusive"), [KEY], "left")


# --- budgets --------------------------------------------------------------------------------

def spend_history(costs: DataFrame, ts: str = "START_TIME", kind: str = "SERVICE_TYPE", cost: str = "COST_USD") -> DataFrame:
    """(date, cost_type, spend) with a 'total' type."""
    rows = costs.select(period(F.col(ts), "day").alias("date"), F.col(cost).alias("c"), F.explode(F.array(F.col(kind), F.lit("total"))).alias("cost_type"))
    return rows.groupBy("date", "cost_type").agg(F.sum("c").alias("spend"))


def budget_use(history: DataFrame, budgets: DataFrame, as_of: str) -> DataFrame:
    """(budget_id, period, amount, spend, spend_percentage): daily today, weekly the last 8 dates, monthly and yearly to date."""
    today = F.lit(as_of).cast("timestamp_ntz").cast("date")
    day = F.col("date").cast("date")
    total = F.when((F.col("cost_type") == "total") & (day <= today), F.col("spend"))
    row = history.agg(*[F.coalesce(F.sum(F.when(cond, total)), F.lit(0.0)).alias(n) for n, cond in (
        ("daily", day == today), ("weekly", day >= F.date_sub(today, 7)), ("monthly", day >= F.trunc(today, "month")), ("yearly", day >= F.trunc(today, "year")))])
    out = attach(budgets, row)
    spend = F.when(F.col("period") == "daily", F.col("_s.daily")).when(F.col("period") == "weekly", F.col("_s.weekly")) \
        .when(F.col("period") == "monthly", F.col("_s.monthly")).otherwise(F.col("_s.yearly"))
    return out.withColumn("spend", spend).withColumn("spend_percentage", F.col("spend") / F.col("amount") * 100).drop("_s")


def budget_alerts(use: DataFrame, levels: Sequence[float] = (50, 80, 90, 100)) -> DataFrame:
    """One row per budget and reached level; severity by level .9 / .8 / .5."""
    rows = use.withColumn("level", F.explode(F.array(*[F.lit(float(x)) for x in levels]))).filter(F.col("spend_percentage") >= F.col("level"))
    return rows.withColumn("severity", severity(F.col("level") / 100, 0.9, 0.8, 0.5))


def spend_trend(history: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """(date, spend) of the last ``days`` dates, absent ones 0."""
    today = F.lit(as_of).cast("timestamp_ntz")
    grid = history.limit(0).agg(F.count("*").alias("_z")).select(F.explode(F.sequence(
        F.date_trunc("day", today).cast("timestamp_ntz") - F.expr(f"interval {days - 1} days"), F.date_trunc("day", today).cast("timestamp_ntz"), F.expr("interval 1 day"))).alias("date"))
    total = history.filter("cost_type = 'total'").select("date", "spend")
    return same_keys_join(grid, total, ["date"], "left").withColumn("spend", F.coalesce("spend", F.lit(0.0)))


# --- usage and performance ------------------------------------------------------------------

def recursive_mean(points: DataFrame, alpha: float = 0.1) -> DataFrame:
    """Add ``baseline``: e = alpha*x + (1-alpha)*e before, started by the first value.

    A range of a hot metric maps its entry value linearly to its exit value, so
    the ranges are chained by two numbers each and then folded in parallel.
    """
    slices = Slices(points, [KEY], [TS, TIE])
    rows = slices.df
    if slices.cut:
        rows = same_keys_join(rows, F.broadcast(_mean_entries(slices, alpha)), [SLICE, KEY], "left")
    else:
        rows = rows.withColumn("_entry", F.lit(None).cast("double"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([TS, TIE], kind="stable")
        entry, x = pdf["_entry"].iloc[0], pdf["value"].astype(float)
        if pd.isna(entry):
            return pdf.assign(baseline=x.ewm(alpha=alpha, adjust=False).mean())
        run = pd.concat([pd.Series([float(entry)]), x]).ewm(alpha=alpha, adjust=False).mean()
        return pdf.assign(baseline=run.to_numpy()[1:])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", baseline double"
    return rows.groupBy(SLICE, KEY).applyInPandas(fold, schema).drop(SLICE, "_entry")


def _mean_entries(slices: Slices, alpha: float) -> DataFrame:
    rows = slices._crossing(slices.df.select(SLICE, KEY, TS, TIE, "value"))

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values([TS, TIE], kind="stable")["value"].to_numpy(dtype=float)
        fade = (1 - alpha) ** np.arange(len(x) - 1, -1, -1)
        first = (fade * np.where(np.arange(len(x)) == 0, 1.0, alpha) * x).sum()
        return pd.DataFrame({SLICE: [pdf[SLICE].iloc[0]], KEY: [pdf[KEY].iloc[0]], "keep": [(1 - alpha) ** len(x)], "add": [(fade * alpha * x).sum()], "first": [first]})

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(SLICE)
        entries, e = [], None
        for keep, add, first in zip(pdf["keep"], pdf["add"], pdf["first"]):
            entries.append(e)
            e = first if e is None else keep * e + add
        return pdf.assign(_entry=pd.Series(entries, index=pdf.index, dtype="float64"))[[SLICE, KEY, "_entry"]]

    steps = rows.groupBy(SLICE, KEY).applyInPandas(summarise, f"{SLICE} int, {KEY} string, keep double, add double, first double")
    # One short summary per range of a crossing key.
    return steps.groupBy(KEY).applyInPandas(chain, f"{SLICE} int, {KEY} string, _entry double")


def usage_patterns(points: DataFrame) -> DataFrame:
    """Per point: spike, gradual increase, oscillation and exhaustion flags over its last values and last hour."""
    frames = RowFrames(points, [KEY], [TS, TIE], before=5)
    before, five = frames.rows(-5, -1), frames.rows(-4)
    rows = frames.done(frames.df.withColumns({"_before": F.avg("value").over(before), "_low5": F.min("value").over(five), "_n5": F.count("value").over(five)}))
    minutes = (F.unix_micros(F.col(TS).cast("timestamp")) / 60e6)
    rows = rows.withColumns({"_time": F.when(F.col("value").isNotNull(), minutes), "_x": F.col("value").cast("double")})
    mid = rows.groupBy(KEY).agg(F.avg("_time").alias("_tm"), F.avg("_x").alias("_xm"))
    rows = same_keys_join(rows, per_key(mid), [KEY], "left").withColumn("_xy", (F.col("_time") - F.col("_tm")) * (F.col("_x") - F.col("_xm"))).drop("_tm", "_xm")
    rows = span_totals(rows, [KEY], ["_time", "_x", "_xy"], TS, HOUR, closed=True)
    rows = rows.withColumns({"_n": span_count("_x"), "_mean": span_mean("_x"), "_sd": span_std("_x", sample=False), "_slope": span_slope("_time", "_x")}) \
        .drop("_time", "_x", "_xy", "_span__time", "_span__x", "_span__xy")
    cv = F.when(F.col("_mean") > 0, F.col("_sd") / F.col("_mean"))
    rise = F.when(F.col("_mean") > 0, F.col("_slope") / F.col("_mean"))
    return rows.withColumns({
        "is_spike": flag((F.col("_n") >= 10) & (F.col("value") > 2 * F.col("_before"))), "is_gradual_increase": flag((F.col("_n") >= 2) & (F.col("_slope") > 0) & (rise > 0.1)),
        "is_oscillating": flag((F.col("_n") >= 15) & (cv > 0.5)), "is_exhausted": flag((F.col("_n5") == 5) & (F.col("_low5") > 90))}) \
        .drop("_before", "_low5", "_n5", "_n", "_mean", "_sd", "_slope")


def usage_summary(points: DataFrame) -> DataFrame:
    rows = points.groupBy(KEY).agg(F.count("*").alias("points"), F.avg("value").alias("mean"), F.max("value").alias("max"),
                                   F.max_by("value", F.struct(TS, TIE)).alias("latest"), F.max(TS).alias("last_seen"))
    return rows.withColumn("latest_vs_mean", F.when(F.col("mean") != 0, F.col("latest") / F.col("mean")))


def sla_breaches(points: DataFrame, targets: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Points over target * (1 + tolerance); severity by value/target 3 / 2 / 1.5."""
    rows = points.join(targets, KEY).filter(F.col("value") > F.col("target") * (1 + tolerance))
    return rows.withColumn("ratio", F.col("value") / F.col("target")).withColumn("severity", severity(F.col("ratio"), 3, 2, 1.5))


def index_percentiles(points: DataFrame) -> DataFrame:
    """p95 and p99 of the last hour by index int(p*n), with more than 10 values."""
    rows = span_quantiles(points, [KEY], "value", TS, HOUR, [0.95, 0.99], "index", closed=True)
    return rows.withColumns({name: F.when(F.col("_n") > 10, F.col("_q")[i]) for i, name in enumerate(("p95", "p99"))}).drop("_n", "_q")


def degradation(points: DataFrame) -> DataFrame:
    """Points more than 20 % over their recursive baseline (which already holds the point); severity 1 / .5 / .3."""
    rows = recursive_mean(points)
    rows = rows.withColumn("degradation", F.when(F.col("baseline") > 0, (F.col("value") - F.col("baseline")) / F.col("baseline")))
    return rows.filter(F.col("degradation") > 0.2).withColumn("severity", severity(F.col("degradation"), 1, 0.5, 0.3))


def trends(points: DataFrame, as_of: str) -> DataFrame:
    """Per metric over the hour before ``as_of``: slope per row, intercept, R2, direction and alert flag."""
    end = F.lit(as_of).cast("timestamp_ntz")
    rows = points.filter((F.col(TS) > end - F.expr("interval 1 hour")) & (F.col(TS) <= end))
    rows = rows.withColumn("_i", F.row_number().over(Window.partitionBy(KEY).orderBy(TS, TIE)) - 1)  # one hour of one metric
    out = rows.groupBy(KEY).agg(F.count("*").alias("points"), F.regr_slope("value", "_i").alias("slope"), F.regr_intercept("value", "_i").alias("intercept"),
                                F.regr_r2("value", "_i").alias("r_squared"))
    s = F.col("slope")
    return out.withColumns({"direction": F.when(F.abs(s) < 0.01, "stable").when(s > 0, "increasing").otherwise("decreasing"),
                            "is_alert": flag((F.abs(s) > 0.1) & (F.col("r_squared") > 0.7))})


# --- rules ----------------------------------------------------------------------------------

@dataclass(frozen=True)
class Condition:
    metric: str
    aggregation: str
    op: str
    value: float
    seconds: int = 300


@dataclass(frozen=True)
class Group:
    op: str  # AND, OR, NOT (not all)
    parts: tuple = ()


@dataclass(frozen=True)
class Rule:
    rule_id: str
    tree: Group
    severity: str = "medium"
    team: str = ""
    tags: dict = field(default_factory=dict)


AGGREGATIONS = ("latest", "avg", "max", "min", "sum", "count", "median", "std", "variance", "p95", "p99", "first", "rate", "delta", "anomaly_score")


def conditions_of(rules: Sequence[Rule]) -> list[Condition]:
    def walk(node):
        return [node] if isinstance(node, Condition) else [c for p in node.parts for c in walk(p)]
    return list(dict.fromkeys(c for r in rules for c in walk(r.tree)))


def window_aggregates(points: DataFrame, windows: Sequence[tuple[str, int]], as_of: str) -> DataFrame:
    """All 15 aggregations per (metric, seconds) over the window that ends at ``as_of``."""
    end = F.lit(as_of).cast("timestamp_ntz")
    wanted = sorted(set(windows))
    tags = [F.when((F.col(KEY) == m) & (F.col(TS) >= end - F.make_dt_interval(secs=F.lit(s))), F.struct(F.lit(s).alias("seconds"))) for m, s in wanted]
    longest = max(s for _, s in wanted)
    rows = points.filter((F.col(TS) <= end) & (F.col(TS) >= end - F.make_dt_interval(secs=F.lit(longest))) & F.col(KEY).isin(*{m for m, _ in wanted}))
    rows = rows.select(KEY, TS, TIE, "value", F.explode(F.array_compact(F.array(*tags))).alias("w")).select(KEY, TS, TIE, "value", "w.seconds")
    at = F.struct(TS, TIE)
    keys = [KEY, "seconds"]
    out = rows.groupBy(*keys).agg(
        F.max_by("value", at).alias("latest"), F.avg("value").alias("avg"), F.max("value").alias("max"), F.min("value").alias("min"), F.sum("value").alias("sum"),
        F.count("value").cast("double").alias("count"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("variance"),
        F.min_by("value", at).alias("first"), F.min(TS).alias("_t0"), F.max(TS).alias("_t1"), F.sum(F.col("value") * F.col("value")).alias("_q"))
    q = group_quantiles(rows, keys, ["value"], [0.5, 0.95, 0.99], "exclusive").withColumnsRenamed({"value_p50": "median", "value_p95": "p95", "value_p99": "p99"})
    out = same_keys_join(out, q, keys, "left")
    n, span = F.col("count"), seconds_between(F.col("_t0"), F.col("_t1"))
    # mean and sample deviation of the points before the last one
    m = (F.col("sum") - F.col("latest")) / F.nullif(n - 1, F.lit(0.0))
    v = (F.col("_q") - F.col("latest") * F.col("latest") - (n - 1) * m * m) / F.nullif(n - 2, F.lit(0.0))
    z = F.when((n >= 3) & (v > 1e-12), F.abs(F.col("latest") - m) / F.sqrt(v)).otherwise(0.0)
    return out.withColumns({"rate": F.when((n >= 2) & (span > 0), (F.col("latest") - F.col("first")) / span).otherwise(0.0),
                            "delta": F.when(n >= 2, F.col("latest") - F.col("first")).otherwise(0.0), "anomaly_score": z}).drop("_t0", "_t1", "_q")


def evaluate_conditions(points: DataFrame, conditions: Sequence[Condition], as_of: str) -> DataFrame:
    """(condition_id, metric, aggregation, op, threshold, current, is_met); no data is not met."""
    table = points.sparkSession.createDataFrame(
        [(i, c.metric, c.seconds, c.aggregation, c.op, float(c.value)) for i, c in enumerate(conditions)],
        "condition_id int, metric string, seconds int, aggregation string, op string, threshold double")
    values = window_aggregates(points, [(c.metric, c.seconds) for c in conditions], as_of)
    long = values.select(KEY, "seconds", F.explode(F.array(*[F.struct(F.lit(a).alias("aggregation"), F.col(a).alias("current")) for a in AGGREGATIONS])).alias("a"))
    rows = same_keys_join(table, long.select(KEY, "seconds", "a.*"), [KEY, "seconds", "aggregation"], "left")
    met = F.coalesce(compare_column(F.col("current"), F.col("op"), F.col("threshold")), F.lit(False))
    return rows.withColumn("is_met", flag(met))


def tree_column(node, met: dict[Condition, Column]) -> Column:
    """A rule tree as one boolean expression; an empty group is false, NOT means not all."""
    if isinstance(node, Condition):
        return met[node]
    if not node.parts:
        return F.lit(False)
    parts = [tree_column(p, met) for p in node.parts]
    out = parts[0]
    for p in parts[1:]:
        out = (out | p) if node.op == "OR" else (out & p)
    return ~out if node.op == "NOT" else out


def evaluate_rules(points: DataFrame, rules: Sequence[Rule], as_of: str) -> DataFrame:
    """(rule_id, severity, is_triggered) at ``as_of``."""
    conditions = conditions_of(rules)
    results = evaluate_conditions(points, conditions, as_of)
    row = results.agg(*[F.max(F.when(F.col("condition_id") == i, F.col("is_met"))).alias(f"c{i}") for i in range(len(conditions))])
    met = {c: F.col(f"c{i}") == 1 for i, c in enumerate(conditions)}
    return row.select(F.explode(F.array(*[F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"),
                                                   flag(F.coalesce(tree_column(r.tree, met), F.lit(False))).alias("is_triggered")) for r in rules])).alias("r")).select("r.*")


def minute_hits(points: DataFrame, conditions: DataFrame) -> DataFrame:
    """(rule_id, minute): minutes whose mean value meets the rule's (metric, op, limit); one row per rule and minute."""
    series = points.groupBy(KEY, period(F.col(TS), "minute").alias("minute")).agg(F.avg("value").alias("v"))
    return series.join(conditions, KEY).filter(compare_column(F.col("v"), F.col("op"), F.col("limit"))).select("rule_id", "minute")


def fired(hits: DataFrame, cooldown_seconds: float, max_per_hour: int) -> DataFrame:
    """Hits that fire: ``cooldown`` passed since the last fired and fewer than ``max_per_hour`` fired in the hour before.

    A group holds at most one row per minute, so its size is bounded by the calendar.
    """
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("minute")
        keep, done, last = [], [], -np.inf
        for t in pdf["minute"].to_numpy().astype("datetime64[s]").astype(np.int64):
            done = [x for x in done if x > t - HOUR]
            ok = t - last >= cooldown_seconds and len(done) < max_per_hour
            keep.append(ok)
            if ok:
                last = t
                done.append(t)
        return pdf[np.asarray(keep, dtype=bool)]

    return hits.groupBy("rule_id").applyInPandas(fold, hits.schema)


def rule_statistics(hits: DataFrame, fires: DataFrame) -> DataFrame:
    a = hits.groupBy("rule_id").agg(F.count("*").alias("evaluations_met"))
    b = fires.groupBy("rule_id").agg(F.count("*").alias("fired"), F.max("minute").alias("last_fired"))
    return same_keys_join(a, b, ["rule_id"], "left").withColumn("fire_rate", F.coalesce("fired", F.lit(0)) / F.col("evaluations_met"))


# Base scores, factor weights, levels, impact and team factors.
BASE = {"low": 1.0, "medium": 2.0, "high": 3.0, "critical": 4.0}
WEIGHTS = {"breach": 0.5, "duration": 0.3, "frequency": 0.2, "trend": 0.3, "business": 0.4}
IMPACT = {"low": 0.8, "medium": 1.0, "high": 1.3, "critical": 1.5}
KEY_TEAMS = ("production", "infrastructure", "security")


def dynamic_severity(points: DataFrame, rules: Sequence[Rule], as_of: str, fires_per_day: float = 0.0) -> DataFrame:
    """(rule_id, score, level) from the first condition of each rule; the hour comes from ``as_of``."""
    firsts = {r.rule_id: conditions_of([r])[0] for r in rules}
    results = evaluate_conditions(points, list(dict.fromkeys(firsts.values())), as_of)
    end = F.lit(as_of).cast("timestamp_ntz")
    hour = points.filter((F.col(TS) <= end) & (F.col(TS) >= end - F.expr("interval 1 hour")))
    order = Window.partitionBy(KEY)
    hour = hour.withColumns({"_r": F.row_number().over(order.orderBy(F.desc(TS), F.desc(TIE))), "_i": F.row_number().over(order.orderBy(TS, TIE))})  # one hour of one metric
    table = points.sparkSession.createDataFrame(
        [(r.rule_id, c.metric, c.op, float(c.value), c.seconds, c.aggregation, BASE[r.severity], IMPACT.get(r.tags.get("business_impact", "medium"), 1.0) * (1.2 if r.team in KEY_TEAMS else 1.0))
         for r, c in ((r, firsts[r.rule_id]) for r in rules)], "rule_id string, metric string, op string, threshold double, seconds int, aggregation string, base double, business double")
    recent = hour.join(table.select("rule_id", KEY, "op", "threshold"), KEY)
    broke = F.when(F.col("_r") <= 20, flag(compare_column(F.col("value"), F.col("op"), F.col("threshold"))))
    facts = recent.groupBy("rule_id").agg(F.avg(broke).alias("_share"), F.count("*").alias("_n"), F.regr_slope("value", "_i").alias("_slope"), F.avg("value").alias("_mean"))
    rows = same_keys_join(table, facts, ["rule_id"], "left")
    rows = same_keys_join(rows, results.select(KEY, "seconds", "aggregation", "op", "threshold", "current"), [KEY, "seconds", "aggregation", "op", "threshold"], "left")
    up, down = F.col("op").isin(">", ">="), F.col("op").isin("<", "<=")
    gap = F.when(up, F.col("current") - F.col("threshold")).when(down, F.col("threshold") - F.col("current")).otherwise(0.0)
    gap = F.when(F.col("threshold") > 0, gap / F.nullif(F.col("threshold"), F.lit(0.0))).otherwise(gap)
    clamp = lambda x: F.least(F.greatest(x, F.lit(0.5)), F.lit(2.0))
    lean = F.when((F.col("_n") >= 10) & (F.col("_mean") > 0), F.col("_slope") / F.col("_mean"))
    often = 1.0 if fires_per_day == 0 else 1.5 if fires_per_day > 10 else 1.3 if fires_per_day > 5 else 1.1 if fires_per_day > 1 else 0.9
    business = F.col("business") * F.when(F.hour(end).between(9, 17), 1.1).otherwise(1.0)
    factors = {"breach": F.coalesce(clamp(1 + gap), F.lit(1.0)), "duration": F.coalesce(clamp(1 + F.col("_share")), F.lit(1.0)), "frequency": F.lit(often),
               "trend": F.when((up & (lean > 0)) | (down & (lean < 0)), F.least(F.lit(1.5), 1 + F.abs(lean))).otherwise(1.0), "business": business}
    score = F.col("base")
    for name, f in factors.items():
        score = score + (f - 1) * WEIGHTS[name]
    score = F.least(F.greatest(score, F.lit(0.5)), F.lit(5.0))
    return rows.select("rule_id", score.alias("score")).withColumn("level", severity(F.col("score"), 4, 3, 2))


# --- rule templates -------------------------------------------------------------------------

def cost_threshold_rule(rule_id: str, metric: str, limit: float, level: str = "high") -> Rule:
    return Rule(rule_id, Group("AND", (Condition(metric, "latest", ">", limit, 300),)), level)


def degradation_rule(rule_id: str, metric: str, limit: float, seconds: int = 600) -> Rule:
    return Rule(rule_id, Group("AND", (Condition(metric, "avg", ">", limit, seconds), Condition(metric, "p95", ">", limit * 1.5, seconds))), "medium")


def anomaly_rule(rule_id: str, metric: str, deviations: float = 3.0, seconds: int = 3600) -> Rule:
    return Rule(rule_id, Group("AND", (Condition(metric, "anomaly_score", ">", deviations, seconds),)), "high")


def composite_rule(rule_id: str, conditions: Sequence[Condition], op: str = "AND") -> Rule:
    return Rule(rule_id, Group(op, tuple(conditions)), "high")


def escalating_rules(rule_id: str, metric: str, limits: dict[str, float]) -> list[Rule]:
    return [cost_threshold_rule(f"{rule_id}_{level}", metric, limit, level) for level, limit in limits.items()]


def predicted_points(points: DataFrame, as_of: str) -> DataFrame:
    """Points of ``predicted_<metric>`` at ``as_of``, from each metric's hourly means so far; predictive rules read them."""
    end = F.lit(as_of).cast("timestamp_ntz")
    hours = points.filter(F.col(TS) <= end).groupBy(KEY, period(F.col(TS), "hour").alias("date")).agg(F.avg("value").alias("value"))
    found = smoothing_forecast(hours, KEY)
    return found.select(F.concat(F.lit("predicted_"), F.col(KEY)).alias(KEY), end.alias(TS), F.col("predicted").alias("value"), F.lit(-1).cast("bigint").alias(TIE))


def predictive_rule(rule_id: str, metric: str, limit: float) -> Rule:
    return Rule(rule_id, Group("AND", (Condition(f"predicted_{metric}", "latest", ">", limit, 3600),)), "medium")


def pattern_rule(rule_id: str, metric: str, rate: float, deviation: float) -> Rule:
    return Rule(rule_id, Group("OR", (Condition(metric, "rate", ">", rate, 900), Condition(metric, "std", ">", deviation, 900))), "medium")


# --- audit ----------------------------------------------------------------------------------

def search_events(log: DataFrame, start: str, end: str, types: Sequence[str] = (), user: str | None = None, level: str | None = None, limit: int = 100) -> DataFrame:
    """Newest matching audit events; ``limit`` is the size of the page asked for."""
    rows = log.filter((F.col("at") >= F.lit(start).cast("timestamp_ntz")) & (F.col("at") <= F.lit(end).cast("timestamp_ntz")))
    if types:
        rows = rows.filter(F.col("event_type").isin(*types))
    if user:
        rows = rows.filter(F.col("user_id") == user)
    if level:
        rows = rows.filter(F.col("severity") == level)
    return rows.orderBy(F.desc("at"), "sequence").limit(limit)


def audit_report(log: DataFrame) -> DataFrame:
    """(section, name, events): by type, severity, user and type, resource, and suspicious users (over 1000 events or 10 failures)."""
    rows = log.withColumn("_pair", F.concat_ws(":", "user_id", "event_type"))
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.col(c).alias("name")) for s, c in (
        ("event_type", "event_type"), ("severity", "severity"), ("user_event", "_pair"), ("resource", "resource"))])).alias("e"))
    counts = long.groupBy("e.section", "e.name").agg(F.count("*").alias("events"))
    users = log.groupBy(F.col("user_id").alias("name")).agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "failure").alias("f"))
    odd = users.filter((F.col("n") > 1000) | (F.col("f") > 10)).select(F.lit("suspicious_user").alias("section"), "name", F.col("n").alias("events"))
    return counts.unionByName(odd)


def record_hash() -> Column:
    return F.sha2(F.concat_ws("|", F.col("sequence").cast("string"), F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS"), "event_type", "user_id", "resource"), 256)


def verify_integrity(log: DataFrame) -> DataFrame:
    """(issue, sequence): records whose stored hash differs, and the first number of each gap in the sequence."""
    bad = log.filter(F.col("hash") != record_hash()).select(F.lit("hash_mismatch").alias("issue"), "sequence")
    slices = Slices(log.select("sequence"), [], ["sequence"])
    gaps = slices.done(slices.previous(slices.df, {"_before": "sequence"})).filter(F.col("sequence") > F.col("_before") + 1)
    return bad.unionByName(gaps.select(F.lit("missing_sequence").alias("issue"), (F.col("_before") + 1).alias("sequence")))


def condition_details(points: DataFrame, conditions: Sequence[Condition], as_of: str, last: int = 10) -> DataFrame:
    """Evaluated conditions with the statistics of their window and its last points, newest first."""
    rows = evaluate_conditions(points, conditions, as_of)
    windows = [(c.metric, c.seconds) for c in conditions]
    stats = window_aggregates(points, windows, as_of).select(KEY, "seconds", "count", "avg", "min", "max", "std")
    end = F.lit(as_of).cast("timestamp_ntz")
    recent = points.filter((F.col(TS) <= end) & F.col(KEY).isin(*{m for m, _ in windows}))
    n = F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc(TS), F.desc(TIE)))
    recent = recent.withColumn("_n", n).filter(F.col("_n") <= last)  # limited per task before the shuffle
    shown = recent.groupBy(KEY).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("_n", "value"))), lambda p: p["value"].cast("string"))).alias("last_points"))
    rows = same_keys_join(rows, stats, [KEY, "seconds"], "left")
    return same_keys_join(rows, shown, [KEY], "left")
