"""Sums, extremes and moments over a time span before each row.

Time is cut into buckets as long as the span, so a window is the end of one bucket and the
beginning of the next: a fold from the back and a fold from the front, joined. Any sum, minimum
or maximum works that way at the same cost for every span; nothing is subtracted, so no digits
are lost, and both folds run over range cuts, so a hot key or a dense hour is many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.ordered import FOLDS, Slices, per_key, same_keys_join


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def span_folds(df: DataFrame, keys: Sequence[str], folds: Mapping[str, tuple[Column, str]], ts: str, seconds: int, closed: bool = False) -> DataFrame:
    """``df`` with a column per fold (``{name: (value, sum | min | max)}``) over ``(t - seconds, t]``, or ``[t - seconds, t]``.

    Rows of the same time are included. A window without values gives null.
    """
    keys, span = list(keys), seconds * 1_000_000
    rows = df.withColumn("_us", micros(ts))
    steps = rows.groupBy(*keys, "_us").agg(*[FOLDS[kind](value).alias(name) for name, (value, kind) in folds.items()])
    home = F.floor(F.col("_us") / span)
    none = {name: F.lit(None).cast(kind) for name, kind in steps.select(*folds).dtypes}
    enter = steps.withColumns({"_b": home, "_kind": F.lit(1), "_at": F.col("_us")})
    # A row asks at the other end of its window; whether it stands before or after the values of that time decides about them.
    ask = steps.where("_us is not null").withColumns(
        {**none, "_b": home - 1, "_kind": F.lit(0 if closed else 2), "_at": F.col("_us"), "_us": F.col("_us") - span})
    slices = Slices(enter.unionByName(ask), [*keys, "_b"], ["_us", "_kind"])
    run = slices.folded(slices.df, {f"_f_{name}": (F.col(name), kind) for name, (_, kind) in folds.items()})
    run = slices.folded(run, {f"_l_{name}": (F.col(name), kind) for name, (_, kind) in folds.items()}, back=True)
    ends = slices.done(run).select(*keys, F.col("_at").alias("_us"), *[
        F.when(F.col("_kind") == 1, F.col(f"_f_{name}")).otherwise(F.col(f"_l_{name}")).alias(name) for name in folds])
    whole = ends.groupBy(*keys, "_us").agg(*[FOLDS[kind](name).alias(name) for name, (_, kind) in folds.items()])
    return same_keys_join(rows, whole, [*keys, "_us"], "left").drop("_us")


#: Sums of the powers of what lies beside the key's mean.
POWERS = ("s", "q", "c", "f")


def span_totals(df: DataFrame, keys: Sequence[str], columns: Sequence[str], ts: str, seconds: int, closed: bool = False, powers: int = 2) -> DataFrame:
    """``df`` with a struct ``_span_<column>``: count, sums of powers, least and greatest value over the span.

    Values are centred on their key's mean before they are summed.
    """
    keys = list(keys)
    centre = df.groupBy(*keys).agg(*[F.avg(c).alias(f"_mid_{c}") for c in columns])
    rows = same_keys_join(df, per_key(centre), keys, "left") if keys else df.crossJoin(F.broadcast(centre))  # one row
    folds = {}
    for c in columns:
        off = F.col(c).cast("double") - F.col(f"_mid_{c}")
        value = off
        folds |= {f"_n_{c}": (F.when(F.col(c).isNotNull(), 1).otherwise(0).cast("bigint"), "sum"), f"_lo_{c}": (F.col(c).cast("double"), "min"), f"_hi_{c}": (F.col(c).cast("double"), "max")}
        for name in POWERS[:powers]:
            folds[f"_{name}_{c}"] = (value, "sum")
            value = value * off
    out = span_folds(rows, keys, folds, ts, seconds, closed)
    spans = {f"_span_{c}": F.struct(*[F.col(f"_{x}_{c}").alias(x) for x in ("n", "lo", "hi", *POWERS[:powers])], F.col(f"_mid_{c}").alias("mid")) for c in columns}
    return out.withColumns(spans).drop(*folds, *[f"_mid_{c}" for c in columns])


def _parts(column: str, *names: str) -> list[Column]:
    return [F.col(f"_span_{column}.{x}") for x in names]


def span_count(column: str) -> Column:
    return F.col(f"_span_{column}.n")


def span_min(column: str) -> Column:
    return F.col(f"_span_{column}.lo")


def span_max(column: str) -> Column:
    return F.col(f"_span_{column}.hi")


def span_sum(column: str) -> Column:
    n, s, mid = _parts(column, "n", "s", "mid")
    return F.when(n > 0, s + n * mid)


def span_mean(column: str) -> Column:
    n, s, mid = _parts(column, "n", "s", "mid")
    return F.when(n > 0, s / n + mid)


def _spread(column: str) -> Column:
    """Sum of the squared deviations; exactly 0 if all values are equal."""
    n, lo, hi, s, q = _parts(column, "n", "lo", "hi", "s", "q")
    return F.when(lo == hi, 0.0).otherwise(F.greatest(q - s * s / n, F.lit(0.0)))


def span_std(column: str, sample: bool = True) -> Column:
    """Sample deviation of two values or more, or population deviation of one or more."""
    n, left = F.col(f"_span_{column}.n"), _spread(column)
    return F.when(n > 1, F.sqrt(left / (n - 1))) if sample else F.when(n > 0, F.sqrt(left / n))


def span_skew(column: str) -> Column:
    """Bias-corrected skew of three values or more, 0 if all are equal; needs three powers."""
    n, lo, hi, s, q, c = _parts(column, "n", "lo", "hi", "s", "q", "c")
    m = s / n
    third = c - 3 * m * q + 2 * n * m * m * m
    g = F.sqrt(n) * third / F.pow(_spread(column), 1.5)
    return F.when(n >= 3, F.when(lo == hi, 0.0).otherwise(g * F.sqrt(n * (n - 1)) / (n - 2)))


def span_kurtosis(column: str) -> Column:
    """Bias-corrected excess kurtosis of four values or more, 0 if all are equal; needs four powers."""
    n, lo, hi, s, q, c, f = _parts(column, "n", "lo", "hi", "s", "q", "c", "f")
    m = s / n
    fourth = f - 4 * m * c + 6 * m * m * q - 3 * n * m * m * m * m
    k = n * fourth / F.pow(_spread(column), 2) - 3
    return F.when(n >= 4, F.when(lo == hi, 0.0).otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * k + 6)))


def span_slope(time: str, column: str) -> Column:
    """Slope of ``column`` on ``time``, from the totals of both, of their product ``_xy`` and of ``time`` where the column is known."""
    n, sx, qx = _parts(time, "n", "s", "q")
    sy = F.col(f"_span_{column}.s")
    sxy = F.col("_span__xy.s") + F.col("_span__xy.n") * F.col("_span__xy.mid")
    wide = qx - sx * sx / n
    return F.when((n >= 2) & (F.col(f"_span_{time}.lo") != F.col(f"_span_{time}.hi")), (sxy - sx * sy / n) / wide)
