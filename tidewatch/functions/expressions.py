"""Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def cut(x: Column, edges: Sequence[float], labels: Sequence[str], right: bool = True,
        include_lowest: bool = False) -> Column:
    """Label of the interval ``x`` falls in; outside all intervals gives null.

    ``right`` closes intervals on the right, as pandas ``cut`` does.
    """
    result = None
    for i, text in enumerate(labels):
        low, high = edges[i], edges[i + 1]
        if right:
            above = x >= low if include_lowest and i == 0 else x > low
            inside = above & (x <= high)
        else:
            inside = (x >= low) & (x < high)
        result = F.when(inside, F.lit(text)) if result is None else result.when(inside, F.lit(text))
    return result


def ratio(top: Column, bottom: Column, otherwise: float | None = 0.0) -> Column:
    """``top / bottom`` where the bottom is above zero."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(otherwise))


def flag(condition: Column) -> Column:
    """1 where true, else 0 (null counts as 0)."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6


def period(ts: Column, unit: str) -> Column:
    """Start of the hour, day, ISO week (Monday), month, quarter or year."""
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def weekday(ts: Column) -> Column:
    """Monday = 0."""
    return F.weekday(ts)


def clip(x: Column, low: float, high: float) -> Column:
    """``least``/``greatest`` skip nulls, so keep null as null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def stats_of(stats: DataFrame) -> Column:
    """A one-row table as a struct column of any query (a scalar subquery: no join)."""
    return stats.select(F.struct("*")).scalar()


def attach(df: DataFrame, stats: DataFrame, name: str = "_s") -> DataFrame:
    """Add a one-row table as the struct column ``name``."""
    return df.withColumn(name, stats_of(stats))


def one_row(*parts: DataFrame) -> DataFrame:
    """Several one-row tables with different columns side by side."""
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns])


def skew_corrected(column: str) -> Column:
    """Bias-corrected skewness (pandas); Spark's built-in is the population one."""
    n, g = F.count(column), F.skewness(column)
    return F.when((n >= 3) & (F.stddev_pop(column) > 0), g * F.sqrt(n * (n - 1)) / (n - 2)) \
        .when(n >= 3, F.lit(0.0))


def kurtosis_corrected(column: str) -> Column:
    """Bias-corrected excess kurtosis (pandas)."""
    n, g = F.count(column), F.kurtosis(column)
    return F.when((n >= 4) & (F.stddev_pop(column) > 0),
                  (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g + 6)) \
        .when(n >= 4, F.lit(0.0))


def correlation(a: str, b: str, over=None) -> Column:
    """Pearson correlation, null when a column does not vary (``corr`` divides by zero there)."""
    part = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    both = lambda x, other: F.when(F.col(other).isNotNull(), F.col(x))
    spread = part(F.stddev_pop(both(a, b))) * part(F.stddev_pop(both(b, a)))
    return F.when(spread > 0, part(F.covar_pop(a, b)) / spread)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round all double columns half away from zero; fold -0.0 into 0.0.

    Scaling first rounds the stored value, as SQL engines do, not its shortest decimal form.
    """
    scale = F.lit(10.0 ** digits)
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() in ("double", "float"):
            c = (F.round(c.cast("double") * scale) / scale + F.lit(0.0)).alias(f.name)
        elif f.dataType.typeName() in ("integer", "short", "byte"):
            c = c.cast("bigint").alias(f.name)
        cols.append(c)
    return df.select(*cols)
