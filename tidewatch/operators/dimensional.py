"""Aggregation by dimensions: groups, hierarchies, combinations, profiles."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from tidewatch.functions.expressions import attach, flag, kurtosis_corrected, skew_corrected
from tidewatch.functions.ordered import Slices, same_keys_join
from tidewatch.functions.quantiles import group_quantiles, quantile_row
from tidewatch.functions.ranks import gini, with_ranks
from tidewatch.operators.temporal import AGGREGATES, statistics_by

TINY = 1e-10
MAX_CARDINALITY = 1000


def usable_dimensions(df: DataFrame, dims: Sequence[str], limit: int = MAX_CARDINALITY) -> list[str]:
    """Dimensions that exist and have at most ``limit`` distinct values; those left out are warned of by name."""
    known = [d for d in dims if d in df.columns]
    if not known:
        raise ValueError("No valid dimensions found in data")
    row = cardinalities(df, known).collect()
    wide = sorted(r["dimension"] for r in row if r["cardinality"] > limit)
    if wide:
        warnings.warn(f"left out for having over {limit} distinct values: {', '.join(wide)}", stacklevel=2)
    return [d for d in known if d not in wide]


def cardinalities(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """(dimension, cardinality): distinct pairs first, so no task holds a value set."""
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims])).alias("p"))
    return (pairs.select("p.*").distinct().groupBy("dimension").agg(F.count("value").alias("cardinality")))


def aggregate_by(df: DataFrame, dims: Sequence[str], stats: Mapping[str, Sequence[str]],
                 percentiles: Sequence[float] = (), min_support: int = 5) -> DataFrame:
    out = statistics_by(df, dims, stats, percentiles)
    return out.filter(F.col("query_count") >= min_support)


def add_rankings(agg: DataFrame, cols: Sequence[str], top: int = 50) -> DataFrame:
    for c in cols:
        agg = with_ranks(agg, c, dense=f"{c}_rank", pct=f"{c}_percentile")
        agg = agg.withColumn(f"{c}_top_{top}", flag(F.col(f"{c}_rank") <= top))
    return agg


def add_distribution(agg: DataFrame, df: DataFrame, dims: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    dims = list(dims)
    shape = df.groupBy(*dims).agg(*[x for m in metrics for x in (
        skew_corrected(m).alias(f"{m}_skewness"), kurtosis_corrected(m).alias(f"{m}_kurtosis"),
        (F.stddev_samp(m) / (F.avg(m) + TINY)).alias(f"{m}_cv"),
        (F.max(m) - F.min(m)).alias(f"{m}_range"))])
    q = group_quantiles(df, dims, list(metrics), [0.25, 0.75])
    q = q.select(*dims, *[(F.col(f"{m}_p75") - F.col(f"{m}_p25")).alias(f"{m}_iqr") for m in metrics])
    return same_keys_join(same_keys_join(agg, shape, dims, "left"), q, dims, "left")


# Ratio name, top column, bottom column (suffixes of the metric names).
RATIOS = [
    ("credits_per_row", "credits_sum", "rows_sum"), ("credits_per_byte", "credits_sum", "bytes_sum"),
    ("time_per_row", "time_sum", "rows_sum"), ("time_per_byte", "time_sum", "bytes_sum"),
    ("bytes_per_row", "bytes_sum", "rows_sum"), ("queries_per_credit", "query_count", "credits_sum"),
]


def add_efficiency(agg: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """``names`` maps credits/rows/bytes/time to metric names of ``agg``."""
    def column(part: str) -> str:
        if part == "query_count":
            return part
        role, fn = part.split("_")
        return f"{names[role]}_{fn}"

    for ratio_name, top, bottom in RATIOS:
        agg = agg.withColumn(ratio_name, F.col(column(top)) / (F.col(column(bottom)) + TINY))
        agg = agg.withColumn("_neg", -F.col(ratio_name))
        agg = with_ranks(agg, "_neg", dense=f"{ratio_name}_rank").drop("_neg")  # smallest first
        agg = with_ranks(agg, ratio_name, pct=f"{ratio_name}_percentile")
    return agg.withColumns({
        "resource_intensity": F.col(column("credits_sum")) / (F.col(column("time_sum")) / 1000 + TINY),
        "complexity_score": F.sqrt(F.col(column("bytes_mean")) * F.col(column("time_mean"))),
    })


def add_outliers(agg: DataFrame, cols: Sequence[str]) -> DataFrame:
    """IQR flag, absolute z and z > 3 flag over the groups."""
    moments = agg.agg(*[f(c).alias(f"{c}_{n}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    agg = attach(attach(agg, quantile_row(agg, list(cols), [0.25, 0.75]), "_q"), moments, "_m")
    out = {}
    for c in cols:
        q1, q3 = F.col(f"_q.{c}_p25"), F.col(f"_q.{c}_p75")
        mean, std = F.col(f"_m.{c}_m"), F.col(f"_m.{c}_s")
        x, reach = F.col(c), 1.5 * (q3 - q1)
        out[f"{c}_is_outlier"] = flag((x < q1 - reach) | (x > q3 + reach))
        out[f"{c}_z_score"] = F.when(std > 0, F.abs((x - mean) / std))
        out[f"{c}_is_extreme"] = F.when(std > 0, flag(F.abs((x - mean) / std) > 3))
    return agg.withColumns(out).drop("_q", "_m")


def aggregate_hierarchy(df: DataFrame, name: str, levels: Sequence[str], stats: Mapping[str, Sequence[str]]) -> DataFrame:
    """All prefixes of ``levels`` in one pass, with path, level number and share of the parent."""
    levels = list(levels)
    rows = df.dropna(subset=levels)
    aggs = [AGGREGATES[fn](m).alias(f"{m}_{fn}") for m, fns in stats.items() for fn in fns]
    depth_of = sum((F.lit(1) - F.grouping(d) for d in levels), F.lit(0))
    out = (rows.rollup(*levels)
           .agg(F.count("*").alias("query_count"), *aggs, depth_of.alias("hierarchy_level"))
           .filter("hierarchy_level > 0"))
    out = out.withColumns({"hierarchy_name": F.lit(name),
                           "hierarchy_path": F.concat_ws(" > ", *[F.col(d).cast("string") for d in levels])})
    shared = ["query_count", *[f"{m}_{fn}" for m, fns in stats.items() for fn in fns]]
    out = out.withColumn("_parent", F.concat_ws(
        " > ", *[F.when(F.col("hierarchy_level") > i + 1, F.col(d).cast("string")) for i, d in enumerate(levels)]))
    totals = out.groupBy("hierarchy_level", "_parent").agg(*[F.sum(c).alias(f"_t_{c}") for c in shared])
    out = same_keys_join(out, totals, ["hierarchy_level", "_parent"], "left")
    shares = {f"{c}_parent_share": F.when(F.col("hierarchy_level") > 1, F.col(c) / (F.col(f"_t_{c}") + TINY))
              for c in shared}
    return out.withColumns(shares).drop("_parent", *[f"_t_{c}" for c in shared])


def aggregate_combinations(df: DataFrame, dims: Sequence[str], stats: Mapping[str, Sequence[str]],
                           largest: int = 3, min_support: int = 5) -> DataFrame:
    """All 2..n dimension combinations by grouping sets: one scan, one shuffle."""
    dims = list(dims)
    combos = [c for r in range(2, min(largest, len(dims)) + 1) for c in combinations(dims, r)]
    aggs = [AGGREGATES[fn](m).alias(f"{m}_{fn}") for m, fns in stats.items() for fn in fns]
    marks = [F.grouping(d).alias(f"_g_{d}") for d in dims]
    out = df.groupingSets([[F.col(d) for d in c] for c in combos], *[F.col(d) for d in dims]).agg(
        F.count("*").alias("query_count"), *aggs, *marks)
    used = {d: F.col(f"_g_{d}") == 0 for d in dims}
    # A null that belongs to the grouping stays; a null in the data drops the row.
    for d in dims:
        out = out.filter(~(used[d] & F.col(d).isNull()))
    return out.withColumns({
        "dimension_combination": F.concat_ws("_x_", *[F.when(used[d], F.lit(d)) for d in dims]),
        "num_dimensions": sum((used[d].cast("int") for d in dims), F.lit(0)),
    }).drop(*[f"_g_{d}" for d in dims]).filter(F.col("query_count") >= min_support)


def interaction(agg: DataFrame, dims: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Per combination table: variation of the sums and share of variance within each dimension."""
    whole = agg.agg(*[x for c in sums for x in (
        (F.stddev_samp(c) / (F.avg(c) + TINY)).alias(f"{c}_interaction_strength"),
        F.var_samp(c).alias(f"_v_{c}"))])
    agg = attach(agg, whole, "_w")
    out = {f"{c}_interaction_strength": F.col(f"_w.{c}_interaction_strength") for c in sums}
    if len(dims) == 2:
        for d in dims:
            within = agg.groupBy(d).agg(*[F.var_samp(c).alias(c) for c in sums]).agg(*[F.avg(c).alias(c) for c in sums])
            agg = attach(agg, within, f"_d_{d}")
            out |= {f"{c}_{d}_dominance": F.col(f"_d_{d}.{c}") / (F.col(f"_w._v_{c}") + TINY) for c in sums}
    return agg.withColumns(out).drop("_w", *[f"_d_{d}" for d in dims])


def dimension_profiles(df: DataFrame, dims: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per dimension: cardinality, nulls, concentration, frequency spread, Gini, importance."""
    counted = value_counts(df, dims)
    known = counted.filter("value is not null")
    ordered = known.withColumns({"_neg": -F.col("frequency")})
    slices = Slices(ordered, ["dimension"], ["_neg", "value"])
    ranked = slices.done(slices.numbered(slices.df, "_rank"))
    freq = ranked.groupBy("dimension").agg(
        F.count("*").alias("cardinality"),
        F.sum(F.when(F.col("_rank") <= 10, F.col("frequency"))).alias("_top10"),
        F.sum(F.when(F.col("_rank") <= 20, F.col("frequency"))).alias("_top20"),
        F.min("frequency").alias("min_frequency"), F.max("frequency").alias("max_frequency"),
        F.avg("frequency").alias("mean_frequency"), F.stddev_samp("frequency").alias("frequency_std"))
    totals = counted.groupBy("dimension").agg(
        F.sum("frequency").alias("total_records"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("frequency"))), F.lit(0)).alias("null_count"))
    unequal = gini(known, "frequency", ["dimension"], "gini_coefficient")
    out = totals
    for part in (freq, unequal, importance(df, dims, metrics)):
        out = same_keys_join(out, part, ["dimension"], "left")
    n = F.col("total_records")
    return out.withColumns({
        "null_percentage": F.col("null_count") / n * 100,
        "concentration_ratio_top10": F.col("_top10") / n,
        "concentration_ratio_top20": F.col("_top20") / n,
    }).drop("_top10", "_top20").withColumnRenamed("dimension", "dimension_name")


def value_counts(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """(dimension, value, frequency)."""
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims])).alias("p"))
    return pairs.groupBy("p.dimension", "p.value").agg(F.count("*").alias("frequency"))


def top_values(df: DataFrame, dims: Sequence[str], top: int = 50) -> DataFrame:
    """The most frequent values per dimension; ``top`` is the size of the report."""
    known = value_counts(df, dims).filter("value is not null")
    w = Window.partitionBy("dimension").orderBy(F.desc("frequency"), "value")
    return known.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def importance(df: DataFrame, dims: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(dimension, importance_score): share of variance between groups, mean over metrics."""
    long = df.select(*metrics, F.explode(F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims])).alias("p"))
    groups = long.groupBy("p.dimension", "p.value").agg(
        F.count("*").alias("n"), *[F.avg(m).alias(m) for m in metrics])
    groups = groups.filter("value is not null")
    whole = df.agg(F.count("*").alias("n"), *[f(m).alias(f"{m}_{k}") for m in metrics
                                              for k, f in (("mean", F.avg), ("var", F.var_samp))])
    groups = attach(groups, whole)
    shares = [F.least(F.sum(F.col("n") * F.pow(F.col(m) - F.col(f"_s.{m}_mean"), 2)) / F.first("_s.n")
                      / F.when(F.first(f"_s.{m}_var") > 0, F.first(f"_s.{m}_var")), F.lit(1.0)).alias(f"_{m}")
              for m in metrics]
    out = groups.groupBy("dimension").agg(*shares)
    known = [F.when(F.col(f"_{m}").isNotNull(), 1).otherwise(0) for m in metrics]
    total = sum((F.coalesce(F.col(f"_{m}"), F.lit(0.0)) for m in metrics), F.lit(0.0))
    count = sum(known, F.lit(0))
    return out.select("dimension", F.when(count > 0, total / count).otherwise(0.0).alias("importance_score"))
