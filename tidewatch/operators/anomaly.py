"""Anomaly detection on metric points (metric, ts, value): statistical, isolation forest, ensemble."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from tidewatch.functions.expressions import attach, flag
from tidewatch.functions.globals import TableStats
from tidewatch.functions.ordered import same_keys_join
from tidewatch.functions.quantiles import group_quantiles, quantile_row
from tidewatch.session import materialise

TREES, SAMPLE = 100, 256
SEVERITY = {"low": 0, "medium": 1, "high": 2, "critical": 3}


def baselines(points: DataFrame) -> DataFrame:
    """Per metric: mean, population deviation, extremes, quartiles by index int(n*p), z and IQR bounds."""
    stats = points.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"),
                                         F.max("value").alias("max"), F.count("value").alias("points"))
    q = group_quantiles(points, ["metric"], ["value"], [0.25, 0.5, 0.75], method="index").withColumnsRenamed(
        {"value_p25": "q1", "value_p50": "median", "value_p75": "q3"})
    out = same_keys_join(stats, q, ["metric"], "left")
    iqr = F.col("q3") - F.col("q1")
    return out.withColumns({"z_lower_bound": F.col("mean") - 3 * F.col("std"), "z_upper_bound": F.col("mean") + 3 * F.col("std"),
                            "iqr_lower_bound": F.col("q1") - 1.5 * iqr, "iqr_upper_bound": F.col("q3") + 1.5 * iqr})


def seasonal_means(points: DataFrame) -> DataFrame:
    """(metric, pattern, slot, mean_value) for hour of day and weekday, from one table of cells."""
    cells = points.groupBy("metric", F.hour("ts").alias("hour"), F.weekday("ts").alias("dow")).agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    long = cells.select("metric", "s", "n", F.explode(F.array(F.struct(F.lit("hourly").alias("pattern"), F.col("hour").alias("slot")),
                                                               F.struct(F.lit("daily").alias("pattern"), F.col("dow").alias("slot")))).alias("p"))
    return long.groupBy("metric", "p.pattern", "p.slot").agg((F.sum("s") / F.sum("n")).alias("mean_value"))


def severity_of(deviation: Column) -> Column:
    return F.when(deviation > 4, "critical").when(deviation > 3, "high").when(deviation > 2, "medium").otherwise("low")


def detect(points: DataFrame) -> DataFrame:
    """Points flagged by z-score, IQR bounds or deviation from the mean of their hour."""
    base = baselines(points).select("metric", "mean", "std", "iqr_lower_bound", "iqr_upper_bound")
    hourly = seasonal_means(points).filter("pattern = 'hourly'").select("metric", F.col("slot").alias("_hour"), F.col("mean_value").alias("_expected"))
    rows = same_keys_join(points.withColumn("_hour", F.hour("ts")), base, ["metric"], "left")
    rows = same_keys_join(rows, hourly, ["metric", "_hour"], "left")
    expected = F.coalesce("_expected", "mean")
    rows = rows.withColumns({"z_score": F.abs(F.col("value") - F.col("mean")) / F.greatest("std", F.lit(0.001)),
                             "seasonal_deviation": F.abs(F.col("value") - expected) / F.greatest(expected, F.lit(0.001))})
    rows = rows.withColumns({
        "is_z_anomaly": flag(F.col("z_score") > 3), "is_seasonal_anomaly": flag(F.col("seasonal_deviation") > 0.5),
        "is_iqr_anomaly": flag((F.col("value") < F.col("iqr_lower_bound")) | (F.col("value") > F.col("iqr_upper_bound"))),
        "severity": severity_of(F.greatest("z_score", "seasonal_deviation"))})
    return rows.filter("is_z_anomaly + is_seasonal_anomaly + is_iqr_anomaly > 0").drop("_hour", "_expected", "mean", "std", "iqr_lower_bound", "iqr_upper_bound")


def scores(points: DataFrame, found: DataFrame) -> DataFrame:
    """(ts, anomaly_score, is_anomaly) for every time: the largest z over flagged points, divided by 5."""
    best = found.groupBy("ts").agg(F.max("z_score").alias("z"))
    out = same_keys_join(points.select("ts").distinct(), best, ["ts"], "left")
    return out.select("ts", F.coalesce(F.col("z") / 5, F.lit(0.0)).alias("anomaly_score"), flag(F.col("z").isNotNull()).alias("is_anomaly"))


def evaluate(rows: DataFrame, predicted: str, actual: str) -> DataFrame:
    p, a = F.col(predicted) == 1, F.col(actual) == 1
    row = rows.agg(F.count_if(p & a).alias("true_positives"), F.count_if(p & ~a).alias("false_positives"),
                   F.count_if(~p & ~a).alias("true_negatives"), F.count_if(~p & a).alias("false_negatives"))
    tp, fp, tn, fn = (F.col(c) for c in ("true_positives", "false_positives", "true_negatives", "false_negatives"))
    share = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    precision, recall = share(tp, tp + fp), share(tp, tp + fn)
    return row.withColumns({"precision": precision, "recall": recall, "f1_score": share(2 * precision * recall, precision + recall),
                            "accuracy": share(tp + tn, tp + fp + tn + fn)})


def deviation_importance(points: DataFrame) -> DataFrame:
    """(metric, importance): share of the summed deviations."""
    base = points.groupBy("metric").agg(F.stddev_pop("value").alias("s"))
    return base.withColumn("_t", base.agg(F.sum("s")).scalar()).select("metric", F.when(F.col("_t") > 0, F.col("s") / F.col("_t")).otherwise(0.0).alias("importance"))


def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values count as 0; population deviation; a constant column becomes 0."""
    columns = list(columns)
    df = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
    df = attach(df, df.agg(*[f(c).alias(f"{c}_{k}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))]))
    return df.withColumns({c: F.when(F.col(f"_s.{c}_s") > 0, (F.col(c) - F.col(f"_s.{c}_m")) / F.col(f"_s.{c}_s")).otherwise(0.0) for c in columns}).drop("_s")


def path_norm(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree of ``n`` points."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2.0 * (np.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


def _grow(data: np.ndarray, rng, depth: int, limit: int, nodes: list) -> int:
    me = len(nodes)
    nodes.append([-1, 0.0, -1, -1, depth + path_norm(len(data))])
    spread = np.flatnonzero(data.max(0) > data.min(0)) if len(data) > 1 else []
    if depth >= limit or len(spread) == 0:
        return me
    f = int(rng.choice(spread))
    cut = float(rng.uniform(data[:, f].min(), data[:, f].max()))
    left = data[:, f] < cut
    if left.any() and not left.all():
        nodes[me][:2] = [f, cut]
        nodes[me][2] = _grow(data[left], rng, depth + 1, limit, nodes)
        nodes[me][3] = _grow(data[~left], rng, depth + 1, limit, nodes)
    return me


def train_forest(df: DataFrame, columns: Sequence[str], row_id: str, trees: int = TREES, sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """Forest table (tree, node, feature, cut, low, high, depth).

    Each tree is grown in its own task on the ``sample`` rows with the smallest
    seeded hash for that tree (``sample`` and ``trees`` are the method's parameters). A row goes to a
    tree only if its hash is below the value that twice as many rows are expected to
    stay below, so about 2 * trees * sample rows are ever made, in one pass.
    """
    columns = list(columns)
    drawn = lambda tree: F.xxhash64(F.col(row_id), tree, F.lit(seed))
    size = df.agg(F.count("*").cast("double").alias("n")).scalar()
    share = (2 * sample + 64) / F.greatest(size, F.lit(1.0))
    below = F.when(share >= 1, F.lit(2 ** 63 - 1)).otherwise((F.lit(-(2.0 ** 63)) + share * 2.0 ** 64).cast("bigint"))
    rows = df.select(row_id, *columns, below.alias("_below"))
    held = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda tree: drawn(tree) <= F.col("_below"))
    rows = rows.withColumn("tree", F.explode(held)).withColumn("_h", drawn(F.col("tree"))).drop("_below")
    first = F.row_number().over(Window.partitionBy("tree").orderBy("_h"))
    rows = rows.withColumn("_n", first).filter(F.col("_n") <= sample)  # limited per task before the shuffle

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        data = pdf.sort_values("_h")[columns].to_numpy(dtype=float)
        nodes: list = []
        _grow(data, np.random.default_rng([seed, tree]), 0, int(np.ceil(np.log2(max(len(data), 2)))), nodes)
        out = pd.DataFrame(nodes, columns=["feature", "cut", "low", "high", "depth"])
        return out.assign(tree=tree, node=range(len(out)))[["tree", "node", "feature", "cut", "low", "high", "depth"]]

    return rows.groupBy("tree").applyInPandas(grow, "tree int, node int, feature int, cut double, low int, high int, depth double")


def forest_scores(df: DataFrame, columns: Sequence[str], forest: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Add ``anomaly_score`` = 2^(-mean path / c(sample)); the forest has at most trees*2*sample nodes."""
    nodes = forest.orderBy("tree", "node").toPandas()
    packed = [t[["feature", "cut", "low", "high", "depth"]].to_numpy() for _, t in nodes.groupby("tree")]
    shared = df.sparkSession.sparkContext.broadcast(packed)
    norm = path_norm(sample)

    @F.pandas_udf(DoubleType())
    def score(*features: pd.Series) -> pd.Series:
        x = np.column_stack([f.to_numpy(dtype=float) for f in features])
        total = np.zeros(len(x))
        for tree in shared.value:
            at = np.zeros(len(x), dtype=int)
            while True:
                feature = tree[at, 0].astype(int)
                inner = feature >= 0
                if not inner.any():
                    break
                value = x[np.arange(len(x)), np.where(inner, feature, 0)]
                step = np.where(value < tree[at, 1], tree[at, 2], tree[at, 3]).astype(int)
                at = np.where(inner, step, at)
            total += tree[at, 4]
        return pd.Series(np.power(2.0, -(total / len(shared.value)) / norm))

    return df.withColumn("anomaly_score", score(*[F.col(c) for c in columns]))


def isolation_forest(df: DataFrame, columns: Sequence[str], row_id: str, contamination: float = 0.1, seed: int = 42) -> DataFrame:
    """Standardise, grow, score; flag above the (1 - contamination) quantile; severity .8/.7/.6."""
    raw = {c: f"_raw_{c}" for c in columns}
    scaled = standardise(df.withColumns({r: F.col(c) for c, r in raw.items()}), columns)
    scored = forest_scores(scaled, columns, train_forest(scaled, columns, row_id, seed=seed))
    # Written, as the limit and the rows both need the scores.
    scored = materialise(scored.withColumns({c: F.col(r) for c, r in raw.items()}).select(*df.columns, "anomaly_score"))
    limit = quantile_row(scored, ["anomaly_score"], [1 - contamination])
    s = F.col("anomaly_score")
    return scored.withColumn("_limit", limit.scalar()).withColumns({
        "is_anomaly": flag(s > F.col("_limit")),
        "severity": F.when(s > 0.8, "critical").when(s > 0.7, "high").when(s > 0.6, "medium").otherwise("low")}).drop("_limit")


def forest_importance(forest: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, importance): share of the splits."""
    counts = forest.filter("feature >= 0").groupBy("feature").agg(F.count("*").alias("n"))
    names = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("feature") + 1)
    return counts.withColumn("_t", counts.agg(F.sum("n")).scalar()).select(names.alias("feature"), (F.col("n") / F.col("_t")).alias("importance"))


def explain(df: DataFrame, columns: Sequence[str], row_id: str, top: int = 3) -> DataFrame:
    """(row_id, rank, feature, z_score): the ``top`` features by absolute z of each row."""
    stats = TableStats(df, columns)
    best = F.slice(F.sort_array(F.array(*[F.struct(F.abs(F.coalesce(stats.z(c), F.lit(0.0))).alias("a"), F.lit(c).alias("feature"), stats.z(c).alias("z")) for c in columns]), False), 1, top)
    return stats.df.select(row_id, F.posexplode(best).alias("rank", "e")).select(row_id, (F.col("rank") + 1).alias("rank"), "e.feature", F.col("e.z").alias("z_score"))


def ensemble(parts: dict[str, DataFrame]) -> DataFrame:
    """Union of detectors (ts, score, severity): per time the methods, hits, mean and largest score, worst severity."""
    stacked = None
    for name, df in parts.items():
        p = df.select("ts", "score", "severity", F.lit(name).alias("method"))
        stacked = p if stacked is None else stacked.unionByName(p)
    order = F.element_at(F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair]), F.col("severity"))
    per = stacked.groupBy("ts", "method").agg(F.count("*").alias("n"), F.sum("score").alias("s"), F.max("score").alias("x"), F.max(order).alias("o"))
    names = F.element_at(F.array(*[F.lit(s) for s in SEVERITY]), F.max("o") + 1)
    return per.groupBy("ts").agg(
        F.concat_ws(",", F.array_sort(F.collect_list("method"))).alias("methods"), F.sum("n").alias("consensus"),
        (F.sum("s") / F.sum("n")).alias("avg_score"), F.max("x").alias("max_score"), names.alias("severity"))


def consensus(parts: dict[str, DataFrame]) -> DataFrame:
    """One row: mean Jaccard similarity over all detector pairs of their flagged times."""
    names = list(parts)
    stacked = None
    for name, df in parts.items():
        p = df.select("ts", F.lit(name).alias("method")).distinct()
        stacked = p if stacked is None else stacked.unionByName(p)
    flags = stacked.groupBy("ts").agg(*[F.max(flag(F.col("method") == n)).alias(n) for n in names])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    jaccard = [F.coalesce(F.sum(F.col(a) * F.col(b)) / F.nullif(F.sum(F.greatest(a, b)), F.lit(0)), F.lit(0.0)) for a, b in pairs]
    return flags.agg((sum(jaccard[1:], jaccard[0]) / len(jaccard)).alias("consensus_score"))


def mean_scores(parts: dict[str, DataFrame]) -> DataFrame:
    """(ts, score): mean over detectors; a detector without a score counts 0."""
    stacked = None
    for df in parts.values():
        p = df.select("ts", F.col("anomaly_score").alias("s"))
        stacked = p if stacked is None else stacked.unionByName(p)
    return stacked.groupBy("ts").agg((F.sum("s") / len(parts)).alias("score"))
