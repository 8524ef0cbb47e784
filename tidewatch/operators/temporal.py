"""Time aggregation: period statistics and features of the resulting series.

Row-level work is one ``groupBy(period)``.  Everything after it runs on one row
per period (and key), a size bounded by the calendar, so ordered windows there
are small.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window, WindowSpec

from tidewatch.functions.expressions import attach, flag, period
from tidewatch.functions.quantiles import group_quantiles
from tidewatch.functions.ordered import same_keys_join

# Period unit, calendar step and moving-average windows per level.
UNITS = {"hourly": "hour", "daily": "day", "weekly": "week", "monthly": "month", "quarterly": "quarter"}
STEPS = {"hourly": "interval 1 hour", "daily": "interval 1 day", "weekly": "interval 7 days",
         "monthly": "interval 1 month", "quarterly": "interval 3 months"}
WINDOWS = {"hourly": [3, 6, 12, 24, 168], "daily": [3, 7, 14, 30], "weekly": [2, 4, 8, 12, 26],
           "monthly": [2, 3, 6, 12], "quarterly": [2, 4, 8]}

PERIOD = "time_group"
AGGREGATES = {
    "sum": F.sum, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "count": F.count,
}


def with_period(df: DataFrame, ts: str, level: str) -> DataFrame:
    if level not in UNITS:
        raise ValueError(f"Unsupported time level: {level}")
    return df.withColumn(PERIOD, period(F.col(ts), UNITS[level]))


def statistics_by(df: DataFrame, keys: Sequence[str], stats: Mapping[str, Sequence[str]],
                  percentiles: Sequence[float] = (), count_name: str = "query_count") -> DataFrame:
    """``<metric>_<fn>`` and ``<metric>_p<k>`` per group; row count when no metric exists.

    Null keys are dropped, as a pandas group-by does.
    """
    keys = list(keys)
    df = df.dropna(subset=keys)
    stats = {m: list(fns) for m, fns in stats.items() if m in df.columns}
    if not stats:
        return df.groupBy(*keys).agg(F.count("*").alias(count_name))
    aggs = [AGGREGATES[fn](m).alias(f"{m}_{fn}")
            for m, fns in stats.items() for fn in fns if fn != "median"]
    out = df.groupBy(*keys).agg(F.count("*").alias(count_name), *aggs)
    probs = sorted({p / 100 for p in percentiles} | ({0.5} if any("median" in f for f in stats.values()) else set()))
    if probs:
        q = group_quantiles(df, keys, list(stats), probs)
        out = same_keys_join(out, q, keys, "left")
        medians = [m for m, fns in stats.items() if "median" in fns]
        out = out.withColumns({f"{m}_median": F.col(f"{m}_p50") for m in medians})
        if 50 not in percentiles:
            out = out.drop(*[f"{m}_p50" for m in stats])
    return out


def aggregate_periods(df: DataFrame, ts: str, level: str, stats: Mapping[str, Sequence[str]],
                      percentiles: Sequence[float] = (), keys: Sequence[str] = ()) -> DataFrame:
    return statistics_by(with_period(df, ts, level), [*keys, PERIOD], stats, percentiles)


def calendar_columns(series: DataFrame, level: str, col: str = PERIOD, weekend: Sequence[int] = (5, 6),
                     business_hours: tuple[int, int] = (9, 17)) -> DataFrame:
    t = F.col(col)
    dow = F.weekday(t)
    last = F.dayofmonth(F.last_day(t)) == F.dayofmonth(t)
    first = F.dayofmonth(t) == 1
    month = F.month(t)
    cols = {"year": F.year(t), "month": month, "quarter": F.quarter(t)}
    if level in ("hourly", "daily"):
        off = dow.isin(*weekend)
        cols |= {"day_of_week": dow, "day_of_month": F.dayofmonth(t), "day_of_year": F.dayofyear(t),
                 "week_of_year": F.weekofyear(t), "is_business_day": flag(~off), "is_weekend": flag(off)}
    if level == "hourly":
        h = F.hour(t)
        cols |= {"hour": h, "is_business_hours": flag((h >= business_hours[0]) & (h < business_hours[1]))}
    cols |= {
        "season": season(month),
        "is_month_start": flag(first), "is_month_end": flag(last),
        "is_quarter_start": flag(first & (month % 3 == 1)), "is_quarter_end": flag(last & (month % 3 == 0)),
        "is_year_start": flag(first & (month == 1)), "is_year_end": flag(last & (month == 12)),
    }
    return series.withColumns(cols)


def season(month):
    return (F.when(month.isin(12, 1, 2), "winter").when(month.isin(3, 4, 5), "spring")
            .when(month.isin(6, 7, 8), "summer").otherwise("fall"))


def _by(keys: Sequence[str], order: str = PERIOD) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def add_trends(series: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Difference, its sign, relative change and the slope of the last five points."""
    w = _by(keys)
    last5 = w.rowsBetween(-4, 0)
    series = series.withColumn("_i", F.row_number().over(w))
    out = {}
    for c in cols:
        x = F.col(c).cast("double")
        before = F.lag(x).over(w)
        out[f"{c}_trend"] = x - before
        out[f"{c}_trend_direction"] = F.signum(x - before)
        out[f"{c}_pct_change"] = F.coalesce(F.when(before != 0, (x - before) / before), F.lit(0.0))
        out[f"{c}_rolling_trend"] = F.when(F.count(x).over(last5) >= 2,
                                           F.regr_slope(x, F.col("_i")).over(last5))
    return series.withColumns(out).drop("_i")


def add_seasonality(series: DataFrame, level: str, col: str = PERIOD) -> DataFrame:
    t = F.col(col)
    parts = {
        "hourly": {"hour": (F.hour(t), 24), "dow": (F.weekday(t), 7)},
        "daily": {"dow": (F.weekday(t), 7), "dom": (F.dayofmonth(t), 30.5)},
        "weekly": {"woy": (F.weekofyear(t), 52)},
    }.get(level, {})
    if level != "hourly":
        parts["month"] = (F.month(t), 12)
    parts["quarter"] = (F.quarter(t), 4)
    return series.withColumns(cyclical(parts))


def cyclical(parts: Mapping[str, tuple]) -> dict:
    out = {}
    for name, (value, size) in parts.items():
        angle = value * (2 * 3.141592653589793 / size)
        out[f"{name}_sin"], out[f"{name}_cos"] = F.sin(angle), F.cos(angle)
    return out


def add_growth(series: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Growth to the period before, to the same period last year, and a 12-period compound rate.

    The number of periods per year follows from the mean spacing of the series.
    """
    w = _by(keys)
    whole = Window.partitionBy(*keys)
    last12 = w.rowsBetween(-11, 0)
    t = F.unix_micros(F.col(PERIOD).cast("timestamp")) / 1e6
    series = series.withColumns({
        "_i": F.row_number().over(w), "_n": F.count("*").over(whole),
        "_span": F.max(t).over(whole) - F.min(t).over(whole)})
    gap = F.col("_span") / (F.col("_n") - 1)
    series = series.withColumn(
        "_ppy", F.when(F.col("_n") < 2, 365).when(gap <= 3700, 8760).when(gap <= 86500, 365)
        .when(gap <= 605000, 52).when(gap <= 2629800, 12).otherwise(4))
    # lag() wants a constant offset, so the year-ago value comes by row number.
    ago = series.select(*keys, F.col("_i").alias("_ago"), *[F.col(c).alias(f"_ago_{c}") for c in cols])
    series = series.withColumn("_ago", F.col("_i") - F.col("_ppy"))
    series = same_keys_join(series, ago, [*keys, "_ago"], "left")
    out = {}
    for c in cols:
        x = F.col(c).cast("double")
        before = F.lag(x).over(w)
        out[f"{c}_growth_rate"] = F.coalesce(F.when(before != 0, (x - before) / before), F.lit(0.0))
        old = F.col(f"_ago_{c}")
        enough = (F.col("_n") >= 52) & (F.col("_n") >= F.col("_ppy"))
        out[f"{c}_yoy_growth"] = F.when(enough, F.coalesce(F.when(old != 0, (x - old) / old), F.lit(0.0)))
        first, n = F.first(x).over(last12), F.count(x).over(last12)
        out[f"{c}_cagr"] = F.when(n >= 4, F.when(first <= 0, F.lit(0.0))
                                  .otherwise(F.pow(x / first, 1 / n) - 1))
    return series.withColumns(out).drop("_i", "_n", "_span", "_ppy", "_ago", *[f"_ago_{c}" for c in cols])


def add_moving_averages(series: DataFrame, cols: Sequence[str], level: str, keys: Sequence[str] = ()) -> DataFrame:
    """Moving mean, span-weighted exponential mean and moving sample deviation."""
    w = _by(keys)
    out = {}
    for c in cols:
        for n in WINDOWS[level]:
            rows = w.rowsBetween(-(n - 1), 0)
            out[f"{c}_ma_{n}"] = F.avg(c).over(rows)
            out[f"{c}_std_{n}"] = F.stddev_samp(c).over(rows)
    series = series.withColumns(out)
    spans = [(c, n) for c in cols for n in WINDOWS[level]]
    return exponential_means(series, spans, keys)


def exponential_means(series: DataFrame, spans: Sequence[tuple[str, int]], keys: Sequence[str] = (),
                      order: str = PERIOD) -> DataFrame:
    """``<column>_ema_<span>``: weights (1-2/(span+1))^i, normalised (adjusted form)."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in series.schema.fields]
                       + [f"`{c}_ema_{n}` double" for c, n in spans])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        added = {f"{c}_ema_{n}": pdf[c].astype("float64").ewm(span=n).mean() for c, n in spans}
        return pdf.assign(**added)

    # One group is one series: its length is bounded by the calendar.
    return series.groupBy(*keys).applyInPandas(fold, schema)


def fill_periods(series: DataFrame, level: str, keys: Sequence[str] = (), interpolate: bool = False) -> DataFrame:
    """All periods from first to last; absent numbers become 0 (or interpolated), text 'Missing'."""
    keys = list(keys)
    grid = series.groupBy(*keys).agg(F.min(PERIOD).alias("_a"), F.max(PERIOD).alias("_b")).select(
        *keys, F.explode(F.expr(f"sequence(_a, _b, {STEPS[level]})")).alias(PERIOD))
    grid = grid.withColumn(PERIOD, F.col(PERIOD).cast("timestamp_ntz"))
    out = same_keys_join(grid, series, [*keys, PERIOD], "left")
    filled = {}
    for f in series.schema.fields:
        if f.name in (*keys, PERIOD):
            continue
        if f.dataType.typeName() == "string":
            filled[f.name] = F.coalesce(F.col(f.name), F.lit("Missing"))
        elif interpolate:
            filled[f.name] = linear_fill(F.col(f.name), _by(keys))
        else:
            filled[f.name] = F.coalesce(F.col(f.name), F.lit(0).cast(f.dataType))
    return out.withColumns(filled)


def linear_fill(x, w: WindowSpec):
    """Straight line between the known neighbours by row position; the end keeps the last value."""
    past, future = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    i = F.row_number().over(w)
    known = F.when(x.isNotNull(), F.struct(i.alias("i"), x.cast("double").alias("x")))
    prev, nxt = F.last(known, ignorenulls=True).over(past), F.first(known, ignorenulls=True).over(future)
    line = prev["x"] + (nxt["x"] - prev["x"]) * (i - prev["i"]) / (nxt["i"] - prev["i"])
    return F.when(x.isNotNull(), x).when(nxt.isNull(), prev["x"]).otherwise(line)


def aggregate_series(df: DataFrame, ts: str, level: str, stats: Mapping[str, Sequence[str]],
                     percentiles: Sequence[float] = (), keys: Sequence[str] = ()) -> DataFrame:
    """The whole chain: statistics, calendar, trends, seasonality, growth, averages, gap fill."""
    series = aggregate_periods(df, ts, level, stats, percentiles, keys)
    values = [c for c in series.columns if c not in (*keys, PERIOD, "query_count")]
    central = [c for c in values if c.endswith(("_sum", "_mean"))]
    series = calendar_columns(series, level)
    series = add_trends(series, values, keys)
    series = add_seasonality(series, level)
    series = add_growth(series, central, keys)
    series = add_moving_averages(series, values, level, keys)
    return fill_periods(series, level, keys)


def prepare_log(df: DataFrame, ts: str = "START_TIME", metrics: Sequence[str] = (),
                session: str | None = None, tie: str = "QUERY_ID") -> DataFrame:
    """Date parts, a row counter, nulls to 0, and a mark on the first row of each session."""
    t = F.col(ts)
    out = df.withColumns({"date": period(t, "day"), "hour": F.hour(t), "day_of_week": F.weekday(t),
                          "month": F.month(t), "quarter": F.quarter(t), "query_count": F.lit(1)})
    metrics = [m for m in metrics if m in df.columns]
    out = out.withColumns({m: F.coalesce(F.col(m), F.lit(0).cast(df.schema[m].dataType)) for m in metrics})
    if session:
        at = F.struct(t, F.col(tie))
        firsts = df.groupBy(session).agg(F.min(at).alias("_first")).select(session, "_first.*")
        firsts = firsts.withColumn("session_count", F.lit(1))
        out = same_keys_join(out, firsts, [session, ts, tie], "left")
        out = out.withColumn("session_count", F.coalesce("session_count", F.lit(0)))
    return out


def shape_output(df: DataFrame, kind: str, level: str, stamp: str) -> DataFrame:
    """Keep columns by output level and add the kind, a time stamp and the row count.

    Level 'summary' keeps identifying, total and mean columns, 'detailed' drops working columns.
    """
    if level == "summary":
        # Name parts that make a column part of the summary.
        kept = ("total", "sum", "count", "mean", "avg", "name", "date", "time", "user", "warehouse")
        df = df.select(*[c for c in df.columns if any(p in c.lower() for p in kept)])
    elif level == "detailed":
        df = df.select(*[c for c in df.columns if not c.startswith("_")])
    rows = df.agg(F.count("*").alias("row_count"))
    return df.withColumns({"aggregation_type": F.lit(kind),
                           "aggregation_timestamp": F.lit(stamp).cast("timestamp_ntz"),
                           "row_count": rows.scalar()})


def validate_output(df: DataFrame, name: str) -> DataFrame:
    """One row: row count, all-null columns and negative metrics of an aggregate."""
    numeric = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "long", "integer")]
    # Name parts of metrics that may be negative.
    signed = ("trend", "change", "growth", "time", "sin", "cos")
    checked = [c for c in numeric if not any(p in c.lower() for p in signed)]
    row = df.agg(F.count("*").alias("rows"),
                 *[F.count(c).alias(f"known_{i}") for i, c in enumerate(df.columns)],
                 *[F.count_if(F.col(c) < 0).alias(f"neg_{i}") for i, c in enumerate(checked)])
    all_null = sum((flag(F.col(f"known_{i}") == 0) for i in range(len(df.columns))), F.lit(0))
    negative = sum((flag(F.col(f"neg_{i}") > 0) for i in range(len(checked))), F.lit(0))
    return row.select(F.lit(name).alias("table_name"), "rows", flag(F.col("rows") > 0).alias("not_empty"),
                      all_null.alias("all_null_columns"), negative.alias("negative_columns"))
