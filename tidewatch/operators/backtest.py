"""Rolling-origin backtest: every model refitted before each day and asked for that day.

The normal equations of all origins are running sums over the days before, so a series is
sorted once and read once, whatever the number of origins and models. A series has one row
a day, so it is bounded by the calendar; series are spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

LEAST_DAYS = 21
DECAY, LAST = 0.8, 10
BAND = 1.96
START = "2024-01-01"


def rolling_origin(daily: DataFrame, key: str, least: int = LEAST_DAYS) -> DataFrame:
    """(key, date, actual, model, predicted, lower, upper) for each day with ``least`` rows or more before it.

    ``daily`` is (key, date, value). Models: ``seasonal`` (trend and weekday by least squares), ``ar2`` (mean and two lags by
    normal equations), ``smoothing`` (weighted last values); forecasts are floored at 0. The band is 1.96 times the root of
    the mean squared error of the model's earlier forecasts, none for the first.
    """
    w = Window.partitionBy(key).orderBy("date")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    middle = F.avg("value").over(Window.partitionBy(key))  # a shift of all values, so that sums of squares stay small
    rows = daily.select(key, "date", F.col("value").cast("double").alias("actual"), (F.col("value") - middle).alias("_y"), middle.alias("_mid"))
    rows = rows.withColumns({"_t": F.datediff("date", F.lit(START)).cast("double"), "_d": F.weekday("date"), "_i": F.row_number().over(w),
                             **{f"_y{k}": F.lag("_y", k).over(w) for k in range(1, LAST + 1)}})
    total = lambda x: F.coalesce(F.sum(x).over(before), F.lit(0.0))
    terms = {"_m": F.avg("_y").over(before)}
    for d in range(7):
        on = lambda x, d=d: total(F.when(F.col("_d") == d, x))
        terms |= {f"_n{d}": on(F.lit(1.0)), f"_st{d}": on(F.col("_t")), f"_sy{d}": on(F.col("_y")), f"_stt{d}": on(F.col("_t") * F.col("_t")), f"_sty{d}": on(F.col("_t") * F.col("_y"))}
    full = lambda x: total(F.when(F.col("_y2").isNotNull(), x))
    y = [F.col("_y"), F.col("_y1"), F.col("_y2")]
    terms |= {"_n": full(F.lit(1.0)), **{f"_s{k}": full(y[k]) for k in range(3)},
              **{f"_s{a}{b}": full(y[a] * y[b]) for a, b in ((1, 1), (1, 2), (2, 2), (0, 1), (0, 2))}}
    rows = rows.withColumns(terms).where(F.col("_i") > least)
    models = {"seasonal": seasonal(), "ar2": ar2(), "smoothing": smoothing()}
    made = F.array(*[F.struct(F.lit(m).alias("model"), F.greatest(p + F.col("_mid"), F.lit(0.0)).alias("predicted")) for m, p in models.items()])
    out = rows.select(key, "date", "actual", F.explode(made).alias("_f")).select(key, "date", "actual", "_f.*")
    past = Window.partitionBy(key, "model").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    off = F.col("actual") - F.col("predicted")
    reach = BAND * F.sqrt(F.coalesce(F.avg(off * off).over(past), F.lit(0.0)))
    return out.withColumns({"lower": F.greatest(F.col("predicted") - reach, F.lit(0.0)), "upper": F.col("predicted") + reach})


def seasonal() -> Column:
    """Least squares on a trend and one level a weekday: the slope within weekdays, and the own weekday's mean moved along it."""
    inner = lambda a, b, ab: sum((F.when(F.col(f"_n{d}") > 0, F.col(f"{ab}{d}") - F.col(f"{a}{d}") * F.col(f"{b}{d}") / F.col(f"_n{d}")).otherwise(0.0)
                                  for d in range(7)), F.lit(0.0))
    wide = inner("_st", "_st", "_stt")
    slope = F.when(wide > 0, inner("_st", "_sy", "_sty") / wide).otherwise(0.0)
    own = lambda name: F.array(*[F.col(f"{name}{d}") for d in range(7)])[F.col("_d")]
    n = own("_n")
    return F.when(n > 0, own("_sy") / n + slope * (F.col("_t") - own("_st") / n)).otherwise(F.col("_m"))


def ar2() -> Column:
    """Mean and two lags: the cross products around the mean of the days before, from their running sums."""
    m, n = F.col("_m"), F.col("_n")
    cross = lambda a, b: F.col(f"_s{a}{b}") - m * (F.col(f"_s{a}") + F.col(f"_s{b}")) + n * m * m
    a, b, c, d, e = cross(1, 1), cross(1, 2), cross(2, 2), cross(0, 1), cross(0, 2)
    det = a * c - b * b
    one = F.when(det != 0, (d * c - e * b) / det).otherwise(0.0)
    two = F.when(det != 0, (e * a - d * b) / det).otherwise(0.0)
    return m + one * (F.col("_y1") - m) + two * (F.col("_y2") - m)


def smoothing() -> Column:
    known = lambda k, x: F.when(F.col(f"_y{k}").isNotNull(), x).otherwise(0.0)
    weights = {k: DECAY ** (k - 1) for k in range(1, LAST + 1)}
    return sum(known(k, F.col(f"_y{k}") * w) for k, w in weights.items()) / sum(known(k, F.lit(w)) for k, w in weights.items())
