"""Deterministic forecasts, usage profiles and peaks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tidewatch.functions.expressions import attach, clip, correlation, cut, flag, one_row, period, ratio, seconds_between
from tidewatch.functions.ordered import Slices, same_keys_join
from tidewatch.functions.quantiles import group_quantiles
from tidewatch.operators.usage import distincts

INF = float("inf")
# Class limits and weights of query load, activity and peaks; horizons in days or hours.
LOAD_CLASSES = ([0, 10, 60, 300, INF], ["simple", "medium", "complex", "heavy"])
LOAD_WEIGHTS = {"simple": 1.0, "medium": 2.5, "complex": 5.0, "heavy": 10.0}
HORIZONS = {"daily": 30, "weekly": 12, "monthly": 6}
PEAK_TYPES = [("moderate", 2.0), ("high", 3.0), ("severe", 5.0)]


# --- series forecasts -----------------------------------------------------------------------

def _calendar(days: np.ndarray) -> np.ndarray:
    """Trend, weekday and yearly terms of day numbers."""
    t = days.astype(float)
    dow = np.eye(7)[(days.astype(int) + 3) % 7][:, 1:]
    year = 2 * np.pi * t / 365.25
    return np.column_stack([np.ones_like(t), (t - 19000.0) / 365.25, dow, np.sin(year), np.cos(year)])


def seasonal_forecast(daily: DataFrame, key: str, periods: int = HORIZONS["daily"], band: float = 0.15) -> DataFrame:
    """(key, date, predicted, lower, upper): least squares on trend, weekday and season; one series per task.

    ``daily`` is (key, date, value), so a series is bounded by the calendar.
    """
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        day = pd.to_datetime(pdf["date"]).to_numpy().astype("datetime64[D]").astype(int)
        weights, *_ = np.linalg.lstsq(_calendar(day), pdf["value"].to_numpy(dtype=float), rcond=None)
        ahead = day[-1] + 1 + np.arange(periods)
        y = np.maximum(_calendar(ahead) @ weights, 0.0)
        return pd.DataFrame({key: pdf[key].iloc[0], "date": ahead.astype("datetime64[D]").astype("datetime64[us]"), "predicted": y,
                             "lower": y * (1 - band), "upper": y * (1 + band)})

    kind = daily.schema[key].dataType.simpleString()
    return daily.groupBy(key).applyInPandas(fit, f"`{key}` {kind}, date timestamp_ntz, predicted double, lower double, upper double")


def ar2_coefficients(daily: DataFrame, key: str) -> DataFrame:
    """(key, mean, phi1, phi2, sigma, last1, last2): normal equations of an AR(2) from cross products."""
    w = Window.partitionBy(key).orderBy("date")
    rows = daily.withColumn("_m", F.avg("value").over(Window.partitionBy(key))).withColumn("x0", F.col("value") - F.col("_m"))
    rows = rows.withColumns({"x1": F.lag("x0", 1).over(w), "x2": F.lag("x0", 2).over(w)})
    full = rows.filter("x2 is not null")
    p = full.groupBy(key).agg(F.sum(F.col("x1") * F.col("x1")).alias("a"), F.sum(F.col("x1") * F.col("x2")).alias("b"),
                              F.sum(F.col("x2") * F.col("x2")).alias("c"), F.sum(F.col("x0") * F.col("x1")).alias("d"),
                              F.sum(F.col("x0") * F.col("x2")).alias("e"), F.sum(F.col("x0") * F.col("x0")).alias("f"), F.count("*").alias("n"),
                              F.first("_m").alias("mean"), F.max_by("x0", "date").alias("last1"), F.max_by("x1", "date").alias("last2"), F.max("date").alias("last_date"))
    det = F.col("a") * F.col("c") - F.col("b") * F.col("b")
    phi1 = F.when(det != 0, (F.col("d") * F.col("c") - F.col("e") * F.col("b")) / det).otherwise(0.0)
    phi2 = F.when(det != 0, (F.col("e") * F.col("a") - F.col("d") * F.col("b")) / det).otherwise(0.0)
    p = p.withColumns({"phi1": phi1, "phi2": phi2})
    rest = F.col("f") - F.col("phi1") * F.col("d") - F.col("phi2") * F.col("e")
    return p.withColumn("sigma", F.sqrt(F.greatest(rest / F.col("n"), F.lit(0.0)))).select(key, "mean", "phi1", "phi2", "sigma", "last1", "last2", "last_date")


def ar2_forecast(daily: DataFrame, key: str, periods: int = 7) -> DataFrame:
    """(key, step, date, predicted, lower, upper): recursion floored at 0, band 1.96 sigma sqrt(step)."""
    fit = ar2_coefficients(daily, key)
    start = F.struct(F.array().cast("array<double>").alias("out"), F.col("last1").alias("a"), F.col("last2").alias("b"))
    def step(acc, _):
        y = F.col("phi1") * acc["a"] + F.col("phi2") * acc["b"]
        return F.struct(F.concat(acc["out"], F.array(y)).alias("out"), y.alias("a"), acc["a"].alias("b"))
    path = F.aggregate(F.sequence(F.lit(1), F.lit(periods)), start, step, lambda acc: acc["out"])
    rows = fit.select(key, "mean", "sigma", "last_date", F.posexplode(path).alias("i", "x"))
    y, reach = F.greatest(F.col("mean") + F.col("x"), F.lit(0.0)), 1.96 * F.col("sigma") * F.sqrt(F.col("i") + 1)
    return rows.select(key, (F.col("i") + 1).alias("step"), (F.col("last_date") + F.make_dt_interval(F.col("i") + 1)).alias("date"),
                       y.alias("predicted"), F.greatest(y - reach, F.lit(0.0)).alias("lower"), (y + reach).alias("upper"))


def smoothing_forecast(daily: DataFrame, key: str, last: int = 10, decay: float = 0.8) -> DataFrame:
    """(key, predicted): weighted mean of the last values, weight ``decay`` per step back."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("date")))
    rows = daily.withColumn("_n", n).filter(F.col("_n") <= last).withColumn("_w", F.pow(F.lit(decay), F.col("_n") - 1))
    return rows.groupBy(key).agg((F.sum(F.col("value") * F.col("_w")) / F.sum("_w")).alias("predicted"))


def weighted_ensemble(forecasts: DataFrame, errors: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Weights 1/max(error, .1); (by, date, predicted, lower, upper) from (by, model, date, predicted, lower, upper)."""
    rows = forecasts.join(errors.select(*by, "model", (1 / F.greatest("error", F.lit(0.1))).alias("w")), [*by, "model"])
    mean = lambda c: (F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(c)
    return rows.groupBy(*by, "date").agg(mean("predicted"), mean("lower"), mean("upper"))


def vote(forecasts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Median vote with the widest band, and the plain mean."""
    return forecasts.groupBy(*by, "date").agg(F.expr("percentile(predicted, 0.5D)").alias("median_vote"), F.min("lower").alias("lower"),
                                              F.max("upper").alias("upper"), F.avg("predicted").alias("mean_vote"))


def model_consensus(forecasts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row (per ``by``): mean variance over dates, share of predictions within 10 % of the date's mean, strength."""
    mean = forecasts.groupBy(*by, "date").agg(F.avg("predicted").alias("m"), F.var_pop("predicted").alias("v"))
    near = same_keys_join(forecasts, mean, [*by, "date"], "inner")
    close = flag(F.abs(F.col("predicted") - F.col("m")) <= F.abs(F.col("m")) * 0.1)
    row = near.groupBy(*by, "date").agg(F.avg(close).alias("a"), F.first("v").alias("v")).groupBy(*by).agg(F.avg("v").alias("prediction_variance"), F.avg("a").alias("agreement"))
    return row.withColumn("strength", F.when(F.col("agreement") > 0.8, "strong").when(F.col("agreement") > 0.6, "moderate").otherwise("weak"))


def errors(rows: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """MAE, MSE, RMSE and MAPE; zero actuals add nothing to MAPE but count in its size."""
    off = F.col(actual) - F.col(predicted)
    share = F.when(F.col(actual) != 0, F.abs(off / F.col(actual))).otherwise(0.0)
    return rows.groupBy(*by).agg(F.avg(F.abs(off)).alias("mae"), F.avg(off * off).alias("mse"), F.sqrt(F.avg(off * off)).alias("rmse"), (F.avg(share) * 100).alias("mape"))


def rank_models(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return table.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("mape", "model")))  # one row per model


def horizon(last: DataFrame, key: str, level: str) -> DataFrame:
    """(key, date): the future dates of each series, from (key, last_date)."""
    step = {"daily": "interval 1 day", "weekly": "interval 7 days", "monthly": "interval 1 month"}[level]
    n = HORIZONS[level]
    return last.select(key, F.explode(F.expr(f"transform(sequence(1, {n}), i -> last_date + i * {step})")).alias("date"))


# --- query volume ---------------------------------------------------------------------------

def load_class(seconds: Column) -> Column:
    return cut(seconds, *LOAD_CLASSES, include_lowest=True)


def load_weight(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in LOAD_WEIGHTS.items() for x in pair]), kind)


def volume_patterns(hourly: DataFrame) -> DataFrame:
    """(pattern, slot, mean_count) by hour of day and weekday from (hour, n) rows."""
    cells = hourly.groupBy(F.hour("hour").alias("h"), F.weekday("hour").alias("d")).agg(F.sum("n").alias("s"), F.count("*").alias("c"))
    long = cells.select("s", "c", F.explode(F.array(F.struct(F.lit("hourly").alias("pattern"), F.col("h").alias("slot")),
                                                    F.struct(F.lit("daily").alias("pattern"), F.col("d").alias("slot")))).alias("p"))
    return long.groupBy("p.pattern", "p.slot").agg((F.sum("s") / F.sum("c")).alias("mean_count"))


def class_shares(df: DataFrame, seconds: Column) -> DataFrame:
    counts = df.groupBy(load_class(seconds).alias("complexity")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / counts.agg(F.sum("n")).scalar())


def class_entropy(shares: DataFrame) -> DataFrame:
    return shares.agg((-F.sum(F.col("share") * F.log2("share"))).alias("entropy_bits"))


def weighted_load(df: DataFrame, seconds: Column, ts: str = "START_TIME") -> DataFrame:
    """(hour, n, weighted_load): count times the mean class weight."""
    return df.groupBy(period(F.col(ts), "hour").alias("hour")).agg(
        F.count("*").alias("n"), (F.count("*") * F.avg(load_weight(load_class(seconds)))).alias("weighted_load"))


def power_users(df: DataFrame) -> DataFrame:
    users = df.dropna(subset=["USER_NAME"]).groupBy("USER_NAME").agg(F.count("*").alias("total_queries"), F.avg("CREDITS_USED").alias("mean_credits"))
    return users.withColumn("is_power_user", flag(F.col("total_queries") > 2 * users.agg(F.avg("total_queries")).scalar()))


def index_forecast(hourly: DataFrame, hours: int, start: str, value: str = "n", clip_to: float | None = None, widen: float = 1.2) -> DataFrame:
    """(hour, predicted, lower, upper) for ``hours`` hours from ``start``: mean x hour index x weekday index x 2 % a month.

    The band is 1.96 * ``widen`` population deviations.
    """
    grid = hourly.limit(0).agg(F.count("*").alias("_z")).select(F.explode(F.sequence(F.lit(start).cast("timestamp_ntz"),
        F.lit(start).cast("timestamp_ntz") + F.expr(f"interval {hours - 1} hours"), F.expr("interval 1 hour"))).alias("hour"))
    cells = hourly.groupBy(F.hour("hour").alias("h"), F.weekday("hour").alias("d")).agg(F.sum(value).alias("s"), F.count("*").alias("c"))
    index = lambda k: cells.groupBy(k).agg((F.sum("s") / F.sum("c")).alias("m"))
    hour, dow = index("h"), index("d")
    hour = hour.select("h", (F.col("m") / hour.agg(F.avg("m")).scalar()).alias("_hi"))
    dow = dow.select("d", (F.col("m") / dow.agg(F.avg("m")).scalar()).alias("_di"))
    stats = hourly.agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"), F.min("hour").alias("t0"))
    rows = grid.withColumns({"h": F.hour("hour"), "d": F.weekday("hour")})
    rows = same_keys_join(same_keys_join(rows, hour, ["h"], "left"), dow, ["d"], "left")
    rows = attach(rows, stats)
    trend = 1 + 0.02 * F.floor(seconds_between(F.col("_s.t0"), F.col("hour")) / 86400) / 30
    y = F.greatest(F.col("_s.m") * F.coalesce("_hi", F.lit(1.0)) * F.coalesce("_di", F.lit(1.0)) * trend, F.lit(0.0))
    reach = 1.96 * widen * F.col("_s.s")
    bound = (lambda c: clip(c, 0, clip_to)) if clip_to else (lambda c: F.greatest(c, F.lit(0.0)))
    return rows.select("hour", bound(y).alias("predicted"), bound(y - reach).alias("lower"), bound(y + reach).alias("upper"))


def resource_need(forecast: DataFrame) -> DataFrame:
    """Compute units load/100, memory load/50 (at least 1), peak load and scaling flag per forecast hour set."""
    row = forecast.agg(F.max("predicted").alias("peak_load"), F.avg("predicted").alias("avg_load"))
    return row.withColumns({"compute_units": F.greatest(F.col("peak_load") / 100, F.lit(1.0)), "memory_units": F.greatest(F.col("peak_load") / 50, F.lit(1.0)),
                            "needs_scaling": flag(F.col("peak_load") > F.col("avg_load") * 1.5)})


# --- user activity --------------------------------------------------------------------------

def user_profiles(sessions: DataFrame) -> DataFrame:
    """Per user from (USER_NAME, start, activity, minutes): totals, means, active hours and days, class mixes (left-closed)."""
    a, m = F.col("activity"), F.col("minutes")
    share = lambda cond: F.avg(flag(cond))
    rows = sessions.withColumns({"_h": F.hour("start"), "_d": F.weekday("start")})
    out = rows.groupBy("USER_NAME").agg(
        F.count("*").alias("total_sessions"), F.sum("activity").alias("total_activity"), F.avg("activity").alias("avg_activity_per_session"),
        F.avg("minutes").alias("avg_session_minutes"), share(a < 10).alias("low_share"), share((a >= 10) & (a < 50)).alias("medium_share"),
        share((a >= 50) & (a < 200)).alias("high_share"), share(a >= 200).alias("very_high_share"), share(m < 15).alias("short_share"),
        share((m >= 15) & (m < 60)).alias("mid_share"), share((m >= 60) & (m < 240)).alias("long_share"), share(m >= 240).alias("extended_share"),
        F.array_sort(F.collect_set("_h")).alias("active_hours"), F.array_sort(F.collect_set("_d")).alias("active_days"))
    return out.withColumn("active_hours_count", F.size("active_hours"))


def activity_patterns(sessions: DataFrame) -> DataFrame:
    """(pattern, slot, mean_activity, users) by hour and weekday."""
    rows = sessions.select("USER_NAME", "activity", F.explode(F.array(
        F.struct(F.lit("hourly").alias("pattern"), F.hour("start").alias("slot")), F.struct(F.lit("daily").alias("pattern"), F.weekday("start").alias("slot")))).alias("p"))
    rows = rows.select("USER_NAME", "activity", "p.*")
    out = rows.groupBy("pattern", "slot").agg(F.avg("activity").alias("mean_activity"))
    return same_keys_join(out, distincts(rows, ["pattern", "slot"], {"USER_NAME": "users"}), ["pattern", "slot"], "left")


def user_forecast(profiles: DataFrame, patterns: DataFrame, start: str, hours: int) -> DataFrame:
    """(USER_NAME, hour, predicted): 0 outside the user's hours or days, else the user's mean times the hour index."""
    first = F.lit(start).cast("timestamp_ntz")
    rows = profiles.select("USER_NAME", "avg_activity_per_session", "active_hours", "active_days",
                           F.explode(F.sequence(first, first + F.expr(f"interval {hours - 1} hours"), F.expr("interval 1 hour"))).alias("hour"))
    hourly = patterns.filter("pattern = 'hourly'")
    index = hourly.select(F.col("slot").alias("_h"), (F.col("mean_activity") / hourly.agg(F.avg("mean_activity")).scalar()).alias("_i"))
    rows = same_keys_join(rows.withColumn("_h", F.hour("hour")), index, ["_h"], "left")
    on = F.array_contains("active_hours", F.hour("hour")) & F.array_contains("active_days", F.weekday("hour"))
    return rows.select("USER_NAME", "hour", F.when(on, F.col("avg_activity_per_session") * F.coalesce("_i", F.lit(1.0))).otherwise(0.0).alias("predicted"))


def user_types(profiles: DataFrame) -> DataFrame:
    a, s, h = F.col("avg_activity_per_session"), F.col("total_sessions"), F.col("active_hours_count")
    kind = (F.when((a > 50) & (s > 20) & (h > 8), "power_user").when((a > 15) & (s > 5), "regular_user")
            .when((s <= 5) | (a <= 15), "occasional_user").when(h <= 4, "specialized_user").otherwise("regular_user"))
    return profiles.select("USER_NAME", kind.alias("user_type"))


def churn_risk(profiles: DataFrame) -> DataFrame:
    short = lambda c, full: 1 - F.least(F.lit(1.0), F.col(c) / full)
    risk = (short("avg_activity_per_session", 50) + short("total_sessions", 20) + short("active_hours_count", 12)) / 3
    risk = F.when(F.col("total_sessions") < 3, F.least(F.lit(1.0), risk * 1.5)).otherwise(risk)
    return profiles.select("USER_NAME", F.round(risk, 3).alias("churn_risk"))


def fit_correlation(rows: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*by).agg(correlation(a, b).alias("correlation"))


# --- utilisation ----------------------------------------------------------------------------

def capacity_metrics(points: DataFrame, value: str = "utilization", limit: float = 0.8) -> DataFrame:
    return points.agg(F.avg(value).alias("avg_utilization"), F.max(value).alias("max_utilization"), F.min(value).alias("min_utilization"),
                      F.var_pop(value).alias("utilization_variance"), (F.avg(flag(F.col(value) > limit)) * 100).alias("over_threshold_pct"))


def scaling_actions(forecast: DataFrame) -> DataFrame:
    return forecast.withColumn("action", F.when(F.col("predicted") > 0.8, "scale_up").when(F.col("predicted") < 0.3, "scale_down").otherwise("maintain"))


def scaling_summary(actions: DataFrame) -> DataFrame:
    row = actions.agg(F.count("*").alias("hours"), F.count_if(F.col("action") == "scale_up").alias("scale_up_hours"),
                      F.count_if(F.col("action") == "scale_down").alias("scale_down_hours"), F.max("predicted").alias("peak"),
                      F.min_by("hour", F.struct(-F.col("predicted"), F.col("hour"))).alias("peak_hour"))
    return row.withColumn("recommendation", F.when(F.col("scale_up_hours") > F.col("hours") * 0.3, "upgrade")
                          .when(F.col("scale_down_hours") > F.col("hours") * 0.5, "downgrade").otherwise("keep"))


def efficiency(capacity: DataFrame) -> DataFrame:
    use = 100 * (1 - F.abs(F.col("avg_utilization") - 0.75) / 0.75)
    calm, free = 100 * (1 - F.col("utilization_variance")), 100 * (1 - F.col("over_threshold_pct") / 100)
    return capacity.select(((use + calm + free) / 3).alias("efficiency_score"), use.alias("utilization_score"), calm.alias("stability_score"), free.alias("availability_score"),
                           F.when(use < 50, F.when(F.col("avg_utilization") < 0.5, "downsize").otherwise("upsize")).otherwise("keep").alias("size_advice"),
                           flag(calm < 60).alias("needs_auto_scaling"))


# --- peaks ----------------------------------------------------------------------------------

def peak_baselines(points: DataFrame) -> DataFrame:
    """Per metric mean, deviation and the 50th to 99th percentile by index."""
    stats = points.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.max("value").alias("max"))
    return same_keys_join(stats, group_quantiles(points, ["metric"], ["value"], [0.5, 0.75, 0.9, 0.95, 0.99], "index"), ["metric"], "left")


def peaks(points: DataFrame, tie: str = "point_id", min_hours: float = 2.0) -> DataFrame:
    """Runs of values at or over the metric's p90; a run ends at the first value below (or the last row)."""
    base = peak_baselines(points).select("metric", F.col("mean").alias("_mean"), F.col("value_p90").alias("_limit"))
    rows = same_keys_join(points, base, ["metric"], "inner").withColumn("_high", flag(F.col("value") >= F.col("_limit")))
    slices = Slices(rows, ["metric"], ["ts", tie])
    rows = slices.previous(slices.df, {"_was": "_high"})
    # a low row closes the run before it, so it carries the number of that run
    rows = slices.done(slices.running(rows, {"_run": F.when((F.col("_high") == 1) & (F.coalesce("_was", F.lit(0)) == 0), 1).otherwise(0)}))
    high = F.col("_high") == 1
    rows = rows.filter(high | (F.col("_was") == 1))
    out = rows.groupBy("metric", "_run").agg(
        F.min(F.when(high, F.col("ts"))).alias("start_time"), F.max("ts").alias("end_time"), F.max(F.when(high, F.col("value"))).alias("peak_value"),
        F.min_by("ts", F.when(high, F.struct(-F.col("value"), F.col("ts")))).alias("peak_time"), F.avg(F.when(high, F.col("value"))).alias("avg_value"),
        F.first("_mean").alias("_mean"))
    out = out.withColumns({"duration_hours": seconds_between(F.col("start_time"), F.col("end_time")) / 3600, "intensity": F.col("peak_value") / F.col("_mean")})
    kind = F.when(F.col("intensity") < 1, "extreme")
    for name, limit in PEAK_TYPES:
        kind = kind.when(F.col("intensity") < limit, name)
    return out.withColumn("type", kind.otherwise("extreme")).filter(F.col("duration_hours") >= min_hours).drop("_run", "_mean")


def peak_shares(found: DataFrame) -> DataFrame:
    """(pattern, slot, peaks, share) of peak starts by hour and weekday."""
    rows = found.select(F.explode(F.array(F.struct(F.lit("hourly").alias("pattern"), F.hour("start_time").alias("slot")),
                                          F.struct(F.lit("daily").alias("pattern"), F.weekday("start_time").alias("slot")))).alias("p")).select("p.*")
    counts = rows.groupBy("pattern", "slot").agg(F.count("*").alias("peaks"))
    return counts.withColumn("share", F.col("peaks") / found.agg(F.count("*")).scalar())


def peak_summary(found: DataFrame) -> DataFrame:
    days = F.greatest(F.floor(seconds_between(F.min("start_time"), F.max("start_time")) / 86400), F.lit(1))
    return found.agg(F.count("*").alias("total_peaks"), (F.count("*") / days).alias("peaks_per_day"), F.avg("intensity").alias("avg_intensity"),
                     F.max("intensity").alias("max_intensity"), F.stddev_pop("intensity").alias("intensity_std"), F.avg("duration_hours").alias("avg_duration"),
                     F.max("duration_hours").alias("max_duration"), F.min("duration_hours").alias("min_duration"), F.stddev_pop("duration_hours").alias("duration_std"))


def peak_forecast(shares: DataFrame, start: str, hours: int, avg_intensity: float = 1.0) -> DataFrame:
    """(hour, probability, is_peak, risk): mean of hour and weekday share times a season factor, capped at 1."""
    first = F.lit(start).cast("timestamp_ntz")
    grid = shares.limit(0).agg(F.count("*").alias("_z")).select(F.explode(F.sequence(first, first + F.expr(f"interval {hours - 1} hours"), F.expr("interval 1 hour"))).alias("hour"))
    rows = grid.withColumns({"_h": F.hour("hour"), "_d": F.weekday("hour")})
    side = lambda kind, k, name: shares.filter(F.col("pattern") == kind).select(F.col("slot").alias(k), F.col("share").alias(name))
    rows = same_keys_join(same_keys_join(rows, side("hourly", "_h", "_hs"), ["_h"], "left"), side("daily", "_d", "_ds"), ["_d"], "left")
    season = F.when(F.month("hour").isin(11, 12), 1.2).when(F.month("hour").isin(6, 7, 8), 0.9).otherwise(1.0)
    p = F.least((F.coalesce("_hs", F.lit(0.0)) + F.coalesce("_ds", F.lit(0.0))) / 2 * season, F.lit(1.0))
    return rows.select("hour", p.alias("probability"), flag(p > 0.5).alias("is_peak"),
                       F.when(p * avg_intensity > 0.5, "high").when(p * avg_intensity > 0.2, "medium").otherwise("low").alias("risk"))


def combined_recommendations(need: DataFrame, scaling: DataFrame, peak: DataFrame) -> DataFrame:
    """(source, recommendation, priority) from resource need, scaling summary and peak forecast, and the overall risk."""
    text = lambda df, source, rec, priority: df.select(F.lit(source).alias("source"), rec.alias("recommendation"), priority.alias("priority"))
    a = text(need, "volume", F.when(F.col("needs_scaling") == 1, "scale_for_peak").otherwise("keep_capacity"), F.when(F.col("needs_scaling") == 1, "high").otherwise("low"))
    b = text(scaling, "utilization", F.col("recommendation"), F.when(F.col("recommendation") == "upgrade", "high").when(F.col("recommendation") == "downgrade", "medium").otherwise("low"))
    hours = peak.agg(F.sum("is_peak").alias("n"))
    c = text(hours, "peaks", F.when(F.col("n") > 0, "prepare_for_peaks").otherwise("no_peak_expected"), F.when(F.col("n") > 5, "high").when(F.col("n") > 0, "medium").otherwise("low"))
    rows = a.unionByName(b).unionByName(c)
    worst = rows.agg(F.max(F.when(F.col("priority") == "high", 2).when(F.col("priority") == "medium", 1).otherwise(0)).alias("w"))
    overall = text(worst, "overall", F.lit("risk"), F.when(F.col("w") == 2, "high").when(F.col("w") == 1, "medium").otherwise("low"))
    return rows.unionByName(overall)
