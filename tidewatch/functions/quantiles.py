"""Exact quantiles, over all rows or per group.

Three definitions are in use and stay apart: ``linear`` interpolates at
``p*(n-1)``, ``index`` takes the element at ``int(n*p)``, ``exclusive``
interpolates at ``p*(n+1)-1``.

Rows are first counted per (group, metric, value), which combines on the map
side.  Large inputs then number the counted values with range-cut running
totals, so no task ever holds the values of a whole group; small inputs use
the built-in aggregate.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.ordered import Slices, same_keys_join
from tidewatch.session import is_small


def label(p: float) -> str:
    """0.5 -> 'p50', 0.999 -> 'p99_9'."""
    text = f"{p * 100:.4f}".rstrip("0").rstrip(".")
    return "p" + text.replace(".", "_")


def positions(method: str, n: Column, p: float) -> tuple[Column, Column, Column]:
    """0-based low and high ranks, and the share of the high one."""
    if method == "index":
        at = F.least(F.floor(n * F.lit(p)), n - 1)
        return at, at, F.lit(0.0)
    if method == "linear":
        at = (n - 1) * F.lit(float(p))
    elif method == "exclusive":
        at = F.least(F.greatest((n + 1) * F.lit(float(p)) - 1, F.lit(0.0)), (n - 1).cast("double"))
    else:
        raise ValueError(f"unknown quantile method {method}")
    return F.floor(at), F.ceil(at), at - F.floor(at)


def group_quantiles(df: DataFrame, keys: list[str], columns: list[str], probs: list[float],
                    method: str = "linear") -> DataFrame:
    """One row per group, columns ``<column>_<pNN>``; nulls are skipped, a group of nulls gives null."""
    names = [(c, p, f"{c}_{label(p)}") for c in columns for p in probs]
    if method == "linear" and is_small(df):
        aggs = [F.expr(f"percentile(`{c}`, {p}D)").alias(name) for c, p, name in names]
        return df.groupBy(*keys).agg(*aggs)
    return counted_quantiles(df, keys, columns, probs, method)


def counted_quantiles(df: DataFrame, keys: list[str], columns: list[str], probs: list[float], method: str = "linear",
                      scaled: Mapping[str, tuple[str, float]] | None = None) -> DataFrame:
    """``group_quantiles`` of large inputs; ``scaled`` names further columns as one of ``columns`` times a factor above 0, whose
    order is the same, so that their values are not counted again."""
    scaled = scaled or {}
    if any(factor <= 0 for _, factor in scaled.values()):
        raise ValueError("a factor of 0 or less does not keep the order")
    names = [(c, p, f"{c}_{label(p)}") for c in [*columns, *scaled] for p in probs]
    long = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(i).alias("_metric"), F.col(c).cast("double").alias("_value"))
        for i, c in enumerate(columns)])).alias("_m")).select(*keys, "_m.*")
    group = [*keys, "_metric"]
    # nulls count nothing, but keep a group without values as a row
    counted = long.groupBy(*group, "_value").agg(F.count("_value").alias("_n"))
    slices = Slices(counted, group, ["_value"])
    placed = slices.running(slices.df, {"_upto": F.col("_n")})
    totals = slices.df.groupBy(*group).agg(F.sum("_n").alias("_total"))
    placed = same_keys_join(placed, totals, group, "inner")
    total = F.col("_total")
    picks = []
    for i, p in enumerate(probs):
        low, high, _ = positions(method, total, p)
        inside = lambda at: (at >= F.col("_upto") - F.col("_n")) & (at < F.col("_upto"))
        picks += [F.when(inside(low), F.col("_value")).alias(f"_lo{i}"),
                  F.when(inside(high), F.col("_value")).alias(f"_hi{i}")]
    placed = placed.select(*group, "_total", *picks)
    per_metric = placed.groupBy(*group, "_total").agg(
        *[F.max(f"_{side}{i}").alias(f"_{side}{i}") for i in range(len(probs)) for side in ("lo", "hi")])

    def value(c: str, p: float) -> Column:
        source, factor = scaled.get(c, (c, 1.0))
        i = probs.index(p)
        low, high = F.col(f"_lo{i}") * factor, F.col(f"_hi{i}") * factor
        return F.max(F.when(F.col("_metric") == columns.index(source), low + (high - low) * positions(method, total, p)[2]))

    return per_metric.groupBy(*keys).agg(*[value(c, p).alias(name) for c, p, name in names])


def quantile_row(df: DataFrame, columns: list[str], probs: list[float], method: str = "linear") -> DataFrame:
    """The same over all rows: one row."""
    return group_quantiles(df, [], columns, probs, method)


def with_group_quantiles(agg: DataFrame, df: DataFrame, keys: list[str], columns: list[str],
                         probs: list[float], method: str = "linear") -> DataFrame:
    """Join per-group quantiles of ``df`` to an aggregate of ``df`` by the same keys."""
    q = group_quantiles(df, keys, columns, probs, method)
    return same_keys_join(agg, q, keys, "left")
