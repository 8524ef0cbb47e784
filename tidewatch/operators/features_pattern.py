"""Pattern features and the feature pipeline."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tidewatch.functions.expressions import attach, clip, correlation, cut, flag, one_row, ratio, seconds_between
from tidewatch.functions.globals import TableStats, with_group
from tidewatch.functions.ordered import RowFrames, Slices, same_keys_join
from tidewatch.functions.quantiles import quantile_row
from tidewatch.operators import features_cost, features_rolling, features_time, features_usage
from tidewatch.operators.clean import numeric_columns
from tidewatch.operators.usage import distincts, modes
from tidewatch.session import materialise

INF = float("inf")
TS, TIE = "START_TIME", "QUERY_ID"
# Classes and limits.
COMPLEXITY_CLASSES = ([0, 0.2, 0.5, 0.8, 1.0], ["simple", "moderate", "complex", "very_complex"])
INTENSITY_LABELS = ["efficient", "moderate", "intensive", "very_intensive"]
SELECTIVITY_CLASSES = ([0, 0.01, 0.1, 0.5, 1.0], ["highly_selective", "selective", "moderate", "broad"])
QUEUE_CLASSES = ([0, 1000, 10000, 60000, INF], ["no_queue", "short", "medium", "long"])
SCALED = ("EXECUTION_TIME_MS", "BYTES_SCANNED", "PARTITIONS_SCANNED", "ROWS_PRODUCED")
ANOMALY = ("CREDITS_USED", "EXECUTION_TIME_MS", "BYTES_SCANNED")
SIGNATURE = ("CREDITS_USED", "EXECUTION_TIME_MS", "BYTES_SCANNED", "ROWS_PRODUCED")


def user_patterns(df: DataFrame, ts: str = TS) -> DataFrame:
    """One table per user and per key, joined back: activity, variation, sessions, roles, hours, diversity."""
    k = ["USER_NAME"]
    rows = df.withColumn("_hour", F.hour(ts))
    users = rows.dropna(subset=k).groupBy(*k).agg(
        F.count("*").alias("user_activity_score"), F.coalesce(F.stddev_samp("CREDITS_USED") / F.avg("CREDITS_USED"), F.lit(0.0)).alias("user_behavior_consistency"),
        F.avg(flag(F.col("_hour").between(9, 17))).alias("user_business_hours_preference"))
    users = same_keys_join(users, distincts(rows, k, {"SESSION_ID": "_sessions", "_hour": "user_time_diversity", "QUERY_TYPE": "user_query_type_diversity"}), k, "left")
    users = same_keys_join(users, modes(rows.dropna(subset=k), k, "_hour", "user_preferred_hour"), k, "left")
    users = users.withColumn("_max", users.agg(F.max("user_activity_score")).scalar())
    users = users.withColumns({"user_activity_score_normalized": F.col("user_activity_score") / F.col("_max"),
                               "user_multi_session": flag(F.col("_sessions") > 1)}).drop("_max", "_sessions")
    out = same_keys_join(rows.drop("_hour"), users, k, "left")
    out = with_group(out, ["SESSION_ID"], {"session_length": F.count("*")})
    out = with_group(out, ["ROLE_NAME"], {"role_usage_frequency": F.count("*")})
    out = with_group(out.withColumn("_role", F.coalesce("ROLE_NAME", F.lit("UNKNOWN"))), ["USER_NAME", "_role"], {"user_role_combination_frequency": F.count("*")})
    return out.drop("_role")


def complexity_patterns(df: DataFrame) -> DataFrame:
    df = df.withColumn("resource_intensity", ratio(F.col("CREDITS_USED"), F.col("EXECUTION_TIME_MS") / 1000))
    stats = TableStats(df, [*SCALED, "resource_intensity"], [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0], ())
    parts = [stats.scaled(c) for c in SCALED]
    score = sum(parts[1:], parts[0]) / len(parts)
    chosen = F.when(F.col("BYTES_SCANNED") > 0, clip(F.col("ROWS_PRODUCED") * 100 / F.col("BYTES_SCANNED"), 0, 1)).otherwise(0.0)
    x = F.col("resource_intensity")
    edges = [stats.q("resource_intensity", p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)]
    kind = F.when((x >= edges[0]) & (x <= edges[1]), INTENSITY_LABELS[0])
    for i in (1, 2, 3):
        kind = kind.when((x > edges[i]) & (x <= edges[i + 1]), INTENSITY_LABELS[i])
    return stats.done(stats.df.withColumns({
        "query_complexity_score": score, "complexity_category": cut(score, *COMPLEXITY_CLASSES, include_lowest=True), "resource_efficiency_class": kind,
        "query_selectivity": chosen, "selectivity_pattern": cut(chosen, *SELECTIVITY_CLASSES, include_lowest=True)}))


def resource_patterns(df: DataFrame) -> DataFrame:
    out = with_group(df, ["WAREHOUSE_NAME"], {"warehouse_load": F.count("*")})
    out = with_group(out, ["DATABASE_NAME"], {"database_usage_frequency": F.count("*")})
    out = same_keys_join(out, distincts(df, ["USER_NAME"], {"DATABASE_NAME": "user_database_diversity"}), ["USER_NAME"], "left")
    out = out.withColumn("resource_efficiency_score", ratio(F.col("ROWS_PRODUCED"), F.col("CREDITS_USED")))
    stats = TableStats(out, ["CREDITS_USED", "ROWS_PRODUCED", "resource_efficiency_score"], [0.2, 0.8, 0.95], ("max",))
    loads = df.dropna(subset=["WAREHOUSE_NAME"]).groupBy("WAREHOUSE_NAME").agg(F.count("*").alias("n")).agg(F.max("n"))
    queue = F.col("QUEUE_TIME_MS")
    return stats.done(stats.df.withColumns({
        "warehouse_preference_score": F.col("warehouse_load") / loads.scalar(), "is_cross_database_user": flag(F.col("user_database_diversity") > 1),
        "potential_waste_indicator": flag((F.col("CREDITS_USED") > stats.q("CREDITS_USED", 0.8)) & (F.col("ROWS_PRODUCED") < stats.q("ROWS_PRODUCED", 0.2))),
        "resource_efficiency_score_normalized": F.when(stats.m("resource_efficiency_score", "max") > 0,
                                                       clip(F.col("resource_efficiency_score") / stats.q("resource_efficiency_score", 0.95), 0, 1)),
        "experiences_queuing": flag(queue > 1000), "queue_severity": cut(queue, *QUEUE_CLASSES, include_lowest=True)}))


def temporal_patterns(df: DataFrame, keys: Sequence[str] = (), ts: str = TS, tie: str = TIE) -> DataFrame:
    """Busy and quiet hours, calendar flags, density over 10 rows around, bursts, gaps and their regularity."""
    hours = df.groupBy(F.hour(ts).alias("_h")).agg(F.count("*").alias("n"))
    busy = Window.orderBy(F.desc("n"), "_h")  # at most 24 rows
    quiet = Window.orderBy("n", "_h")
    ranked = hours.withColumns({"_b": F.row_number().over(busy), "_q": F.row_number().over(quiet)})
    ranked = ranked.select("_h", flag(F.col("_b") <= 3).alias("is_peak_hour"), flag(F.col("_q") <= 3).alias("is_off_peak_hour"))
    frames = RowFrames(df, list(keys), [ts, tie], before=5, after=4)
    near = frames.rows(-5, 4)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    count = F.count(F.lit(1)).over(near)
    span = (F.max(us).over(near) - F.min(us).over(near)) / 1e6
    gap = F.coalesce((us - F.lag(us).over(frames.window)) / 1e6, F.lit(0.0))
    rows = frames.df.withColumns({"query_density": F.when(count > 1, count / F.greatest(span / 60, F.lit(1.0))).otherwise(0.0), "time_since_last_query": gap})
    rows = same_keys_join(frames.done(rows).withColumn("_h", F.hour(ts)), ranked, ["_h"], "left").drop("_h")
    limit = quantile_row(rows, ["query_density"], [0.9])
    spread = rows.agg(F.stddev_samp("time_since_last_query").alias("s"), F.avg("time_since_last_query").alias("m"))
    rows = attach(attach(rows, limit, "_l"), spread, "_g")
    t, last = F.col(ts), F.dayofmonth(F.last_day(ts)) == F.dayofmonth(ts)
    return rows.withColumns({
        "is_weekend_activity": flag(F.weekday(t) >= 5), "is_month_end_activity": flag(F.dayofmonth(t) >= 25),
        "is_quarter_end_activity": flag(last & (F.month(t) % 3 == 0)), "is_burst_activity": flag(F.col("query_density") > F.col("_l.query_density_p90")),
        "timing_regularity_score": F.when((F.col("_g.s") > 0) & (F.col("_g.m") > 0), 1 / (1 + F.col("_g.s") / F.col("_g.m"))).otherwise(0.0),
        "follows_long_gap": flag(F.col("time_since_last_query") > 3600)}).drop("_l", "_g")


def anomaly_patterns(df: DataFrame) -> DataFrame:
    """Per-metric z and IQR and percentile flags, mean z score, and z against the user's own mean."""
    df = with_group(df, ["USER_NAME"], {f"_{n}_{c}": f(c) for c in ANOMALY[:2] for n, f in (("m", F.avg), ("s", F.stddev_samp))})
    stats = TableStats(df, ANOMALY, [0.25, 0.75, 0.99])
    out, scores = {}, []
    for c in ANOMALY:
        z, q1, q3 = F.abs(stats.z(c)), stats.q(c, 0.25), stats.q(c, 0.75)
        scores.append(z)
        out |= {f"{c}_is_anomaly": flag(z > 3), f"{c}_is_extreme": flag(F.col(c) > stats.q(c, 0.99)),
                f"{c}_is_outlier_iqr": flag((F.col(c) < q1 - 1.5 * (q3 - q1)) | (F.col(c) > q3 + 1.5 * (q3 - q1)))}
    mean = sum(scores[1:], scores[0]) / len(scores)
    out |= {"multivariate_anomaly_score": mean, "is_anomaly": flag(mean > 3)}
    for c in ANOMALY[:2]:
        out[f"{c}_user_anomaly"] = flag(F.when(F.col(f"_s_{c}") > 0, F.abs((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}"))) > 2)
    return stats.done(stats.df.withColumns(out)).drop(*[f"_{n}_{c}" for c in ANOMALY[:2] for n in "ms"])


def advanced_patterns(df: DataFrame, keys: Sequence[str] = (), ts: str = TS, tie: str = TIE) -> DataFrame:
    """Trend of the last 5 rows, correlation over 10 rows, and a signature of z-score bins with its frequency."""
    frames = RowFrames(df, list(keys), [ts, tie], before=10)
    five, ten = frames.rows(-4), frames.rows(-9)
    x = F.col("EXECUTION_TIME_MS")
    slope, step = F.regr_slope(x, F.col("_pos")).over(five), F.stddev_samp(x).over(five) * 0.1
    trend = F.when(F.count(F.lit(1)).over(five) == 5, F.when(slope > step, 1).when(slope < -step, -1).otherwise(0)).otherwise(0)
    a, b = "CREDITS_USED", "BYTES_SCANNED"
    flat = (F.stddev_pop(a).over(ten) <= 0) | (F.stddev_pop(b).over(ten) <= 0)
    corr = F.when((F.count(F.lit(1)).over(ten) == 10) & ~flat, correlation(a, b, ten))
    rows = frames.done(frames.df.withColumns({"recent_execution_trend": trend, f"rolling_correlation_{a}_{b}": F.coalesce(corr, F.lit(0.0)),
                                              "has_strong_correlation": flag(F.abs(corr) > 0.7)}))
    stats = TableStats(rows, SIGNATURE)
    bins = [_bin(F.coalesce(stats.z(c), F.col(c).cast("double"))) for c in SIGNATURE]
    rows = stats.done(stats.df.withColumn("workload_signature", F.concat(*bins)))
    rows = with_group(rows, ["workload_signature"], {"signature_frequency": F.count("*")})
    return rows.withColumn("is_common_pattern", flag(F.col("signature_frequency") >= 3))


def _bin(z: Column) -> Column:
    """0 to 5: how many of -2, -1, 0, 1, 2 are at or below ``z``."""
    return sum((flag(z >= edge) for edge in (-2, -1, 0, 1, 2)), F.lit(0)).cast("string")


def clustering_patterns(df: DataFrame, columns: Sequence[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Median fill, standard scaling, k-means; distance, density, outlier over the 95th percentile, rare clusters."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    columns = list(columns)
    temps = [f"_k_{c}" for c in columns]
    rows = df.withColumns({t: F.col(c).cast("double") for t, c in zip(temps, columns)})
    rows = Imputer(inputCols=temps, outputCols=temps, strategy="median").fit(rows).transform(rows)
    rows = VectorAssembler(inputCols=temps, outputCol="_raw").transform(rows)
    rows = StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True).fit(rows).transform(rows)
    model = KMeans(k=k, seed=seed, featuresCol="_scaled", predictionCol="cluster_id").fit(rows)
    centres = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in model.clusterCenters()])
    rows = model.transform(rows)
    own = centres[F.col("cluster_id")]
    squares = F.aggregate(F.zip_with(vector_to_array("_scaled"), own, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    rows = rows.withColumn("distance_to_cluster_center", F.sqrt(squares)).drop("_raw", "_scaled", *temps)
    rows = with_group(rows, ["cluster_id"], {"cluster_size": F.count("*"), "cluster_density": 1 / (1 + F.avg("distance_to_cluster_center"))})
    rows = attach(rows, one_row(quantile_row(rows, ["distance_to_cluster_center"], [0.95]), rows.agg(F.count("*").alias("n"))))
    return rows.withColumns({"is_cluster_outlier": flag(F.col("distance_to_cluster_center") > F.col("_s.distance_to_cluster_center_p95")),
                             "is_rare_cluster": flag(F.col("cluster_size") < F.col("_s.n") * 0.05)}).drop("_s")


# --- feature pipeline -----------------------------------------------------------------------

def drop_correlated(df: DataFrame, columns: Sequence[str] | None = None, limit: float = 0.95) -> DataFrame:
    """Of each strongly correlated pair drop the column with more nulls, else the later one."""
    columns = list(columns or numeric_columns(df))
    if len(columns) < 2:
        return df
    nulls = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns]).first()
    matrix = pair_correlations(df, columns)
    strong = [(a, b) for (i, a), (j, b) in combinations(list(enumerate(columns)), 2) if abs(matrix[i, j]) > limit]
    gone = {a if nulls[a] > nulls[b] else b for a, b in strong}
    return df.drop(*gone)


def pair_correlations(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Correlation matrix over the rows where both columns are known; NaN where one does not vary.

    Every batch adds its products of known, centred values; only the sums of those
    column-by-column matrices leave the tasks.
    """
    columns, k = list(columns), len(columns)
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    centre = np.array([float(means[c] or 0.0) for c in columns])

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((4, k, k))
        for pdf in batches:
            x = pdf.to_numpy(dtype=float) - centre
            known = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            total += np.stack([known.T @ known, x.T @ known, (x * x).T @ known, x.T @ x])
        yield pd.DataFrame({"at": np.arange(4 * k * k), "v": total.ravel()})

    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    sums = numbers.mapInPandas(products, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    n, s, q, xy = sums.sort_values("at")["v"].to_numpy().reshape(4, k, k)
    with np.errstate(invalid="ignore", divide="ignore"):
        cov = xy / n - (s / n) * (s.T / n)
        var = q / n - (s / n) ** 2
        spread = np.sqrt(np.maximum(var, 0) * np.maximum(var.T, 0))
        return np.where(spread > 1e-12, cov / spread, np.nan)


def keep_by_variance(df: DataFrame, most: int) -> DataFrame:
    """All non-numeric columns and the numeric ones with the largest variance, ``most`` columns in total."""
    numbers = numeric_columns(df)
    others = [c for c in df.columns if c not in numbers]
    row = df.agg(*[F.var_samp(c).alias(c) for c in numbers]).first()
    ranked = sorted(numbers, key=lambda c: (-(row[c] if row[c] is not None else -1.0), numbers.index(c)))
    return df.select(*others, *ranked[:max(most - len(others), 0)])


def keep_by_priority(df: DataFrame, priority: Sequence[str], most: int) -> DataFrame:
    first = [c for c in priority if c in df.columns][:most]
    rest = [c for c in df.columns if c not in first]
    return df.select(*first, *rest[:max(most - len(first), 0)])


# Name parts of the feature categories.
CATEGORIES = {"time": ("hour", "day", "week", "month", "quarter", "season"), "cost": ("cost", "credit", "dollar", "price"),
              "usage": ("usage", "execution", "queue", "elapsed"), "rolling": ("rolling", "moving", "avg", "mean"),
              "pattern": ("score", "ratio", "rate", "complexity")}


def feature_summary(df: DataFrame) -> DataFrame:
    """(feature, data_type, missing_values, categories)."""
    row = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(f"n{i}") for i, c in enumerate(df.columns)])
    kinds = [",".join(k for k, parts in CATEGORIES.items() if any(p in c.lower() for p in parts)) for c in df.columns]
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(f.name).alias("feature"), F.lit(f.dataType.simpleString()).alias("data_type"), F.col(f"n{i}").alias("missing_values"), F.lit(kinds[i]).alias("categories"))
        for i, f in enumerate(df.schema.fields)])).alias("e")).select("e.*")


def feature_importance(df: DataFrame, target: str) -> DataFrame:
    """(feature, importance): absolute correlation with ``target``."""
    columns = [c for c in numeric_columns(df) if c != target]
    row = df.agg(*[F.abs(correlation(c, target)).alias(f"r{i}") for i, c in enumerate(columns)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"r{i}").alias("importance"))
                                          for i, c in enumerate(columns)])).alias("e")).select("e.*")


FAMILIES = {
    "time": lambda df: features_time.all_time_features(df), "usage": lambda df: features_usage.all_usage_features(df),
    "cost": lambda df: features_cost.cost_efficiency(df),
    "rolling": lambda df: features_rolling.lag_features(df, ["USER_NAME"], ["CREDITS_USED"]), "pattern": lambda df: anomaly_patterns(df)}


def generate(df: DataFrame, families: Sequence[str] = ("time", "usage", "cost", "rolling", "pattern"), most: int = 100) -> DataFrame:
    """Chosen families in fixed order, then drop correlated features and keep at most ``most`` columns."""
    base = list(df.columns)
    for name in FAMILIES:
        if name in families:
            df = FAMILIES[name](df)
    # selection passes over the features several times: compute them once
    df = materialise(df)
    df = drop_correlated(df, [c for c in numeric_columns(df) if c not in base])
    return keep_by_variance(df, most) if len(df.columns) > most else df
