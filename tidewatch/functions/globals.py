"""Whole-table statistics and per-key aggregates attached to rows without gathering the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.expressions import attach, clip, one_row
from tidewatch.functions.ordered import same_keys_join
from tidewatch.functions.quantiles import label, quantile_row

MOMENTS = {"mean": F.avg, "std": F.stddev_samp, "skew": F.skewness, "kurt": F.kurtosis, "sum": F.sum, "max": F.max, "min": F.min}


class TableStats:
    """Quantiles and moments of ``df`` as one attached struct: one pass, no join."""

    def __init__(self, df: DataFrame, columns: Sequence[str], quantiles: Sequence[float] = (), moments: Sequence[str] = ("mean", "std"),
                 name: str = "_stats"):
        self.name = name
        parts = [df.agg(F.count("*").alias("_rows"), *[MOMENTS[m](c).cast("double").alias(f"{c}_{m}") for c in columns for m in moments])]
        if quantiles:
            parts.append(quantile_row(df, list(columns), sorted(set(quantiles))))
        self.df = attach(df, one_row(*parts), name)

    def q(self, column: str, p: float) -> Column:
        return F.col(f"{self.name}.{column}_{label(p)}")

    def m(self, column: str, moment: str) -> Column:
        return F.col(f"{self.name}.{column}_{moment}")

    @property
    def rows(self) -> Column:
        return F.col(f"{self.name}._rows")

    def z(self, column: str) -> Column:
        return F.when(self.m(column, "std") > 0, (F.col(column) - self.m(column, "mean")) / self.m(column, "std"))

    def scaled(self, column: str) -> Column:
        """p10 to p90 mapped on 0 to 1 and clipped."""
        low, high = self.q(column, 0.1), self.q(column, 0.9)
        return F.when(high > low, clip((F.col(column) - low) / (high - low), 0, 1))

    def done(self, df: DataFrame) -> DataFrame:
        return df.drop(self.name)


def with_group(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """Per-key aggregates joined back to the rows.

    The aggregate combines on the map side and the join is left to the planner,
    which broadcasts it when it is small and splits skewed keys when it is not.
    """
    keys = list(keys)
    agg = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return same_keys_join(df, agg, keys, "left")
