"""Rolling features over rows and over time, per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tidewatch.functions.expressions import correlation, flag, ratio
from tidewatch.functions.order_spans import span_quantiles
from tidewatch.functions.ordered import RowFrames, Slices, same_keys_join
from tidewatch.functions.quantiles import label
from tidewatch.functions.spans import span_count, span_kurtosis, span_max, span_mean, span_min, span_skew, span_std, span_sum, span_totals

DAY = 86_400
TS, TIE = "START_TIME", "QUERY_ID"
# Window lengths and the metric pairs compared.
PAIRS = [("CREDITS_USED", "EXECUTION_TIME_MS"), ("CREDITS_USED", "BYTES_SCANNED"), ("EXECUTION_TIME_MS", "BYTES_SCANNED"), ("EXECUTION_TIME_MS", "ROWS_PRODUCED")]
LAGS = (1, 2, 3, 7, 14)
HOURS = (9, 12, 15, 18)


def rolling_sums(df: DataFrame, keys: Sequence[str], columns: Sequence[str], seconds: int, suffix: str, ts: str = TS) -> DataFrame:
    """Count, sum, mean and sample deviation over ``(t - seconds, t]``, rows of the same time included."""
    new = {}
    for c in columns:
        new |= {f"{c}_rolling_{suffix}_count": span_count(c), f"{c}_rolling_{suffix}_sum": span_sum(c),
                f"{c}_rolling_{suffix}_mean": span_mean(c), f"{c}_rolling_{suffix}_std": span_std(c)}
    return span_totals(df, keys, columns, ts, seconds).withColumns(new).drop(*[f"_span_{c}" for c in columns])


def rolling_shape(df: DataFrame, keys: Sequence[str], columns: Sequence[str], seconds: int, suffix: str, ts: str = TS) -> DataFrame:
    """Minimum, maximum, median, bias-corrected skew and kurtosis over ``(t - seconds, t]``."""
    rows = span_totals(df, keys, columns, ts, seconds, powers=4)
    for c in columns:
        rows = rows.withColumns({f"{c}_rolling_{suffix}_min": span_min(c), f"{c}_rolling_{suffix}_max": span_max(c),
                                 f"{c}_rolling_{suffix}_skew": span_skew(c), f"{c}_rolling_{suffix}_kurt": span_kurtosis(c)}).drop(f"_span_{c}")
        rows = span_quantiles(rows, keys, c, ts, seconds, [0.5]).withColumn(f"{c}_rolling_{suffix}_median", F.col("_q")[0]).drop("_n", "_q")
    return rows


def rolling_quantiles(df: DataFrame, keys: Sequence[str], columns: Sequence[str], days: int, probs: Sequence[float] = (0.25, 0.75, 0.9, 0.95), ts: str = TS) -> DataFrame:
    for c in columns:
        rows = span_quantiles(df, keys, c, ts, days * DAY, probs)
        df = rows.withColumns({f"{c}_rolling_{days}d_{label(p)}": F.col("_q")[i] for i, p in enumerate(probs)}).drop("_n", "_q")
    return df


def full(value: Column, w, rows: int) -> Column:
    return F.when(F.count(F.lit(1)).over(w) == rows, value)


def rolling_trends(df: DataFrame, keys: Sequence[str], columns: Sequence[str], windows: Sequence[int] = (7, 14, 30), ts: str = TS, tie: str = TIE) -> DataFrame:
    """Slope, its sign, R2, momentum, difference of moving means and its signal over ``w`` rows."""
    reach = max(windows) + max(3, max(windows) // 4)
    frames = RowFrames(df, list(keys), [ts, tie], before=reach)
    w, rows, late = frames.window, frames.df, {}
    new = {}
    for c in columns:
        x = F.col(c).cast("double")
        for n in windows:
            f = frames.rows(-(n - 1))
            count = F.count(F.lit(1)).over(f)
            slope = F.when(count >= 2, F.regr_slope(x, F.col("_pos")).over(f))
            before = F.lag(x, n).over(w)
            flat = F.stddev_pop(x).over(f) <= 0
            new |= {f"{c}_trend_{n}d": slope, f"{c}_trend_direction_{n}d": F.signum(slope),
                    f"{c}_trend_strength_{n}d": F.when(count >= 3, F.when(flat, 0.0).otherwise(F.regr_r2(x, F.col("_pos")).over(f))),
                    f"{c}_momentum_{n}d": F.coalesce(F.when(before != 0, x / before - 1), F.lit(0.0))}
            if n >= 14:
                half = frames.rows(-(n // 2 - 1))
                new[f"{c}_macd_{n}d"] = full(F.avg(x).over(half) - F.avg(x).over(f), f, n)
                late[f"{c}_macd_signal_{n}d"] = (f"{c}_macd_{n}d", max(3, n // 4))
    rows = rows.withColumns(new)
    signals = {name: F.when(F.count(src).over(frames.rows(-(m - 1))) == m, F.avg(src).over(frames.rows(-(m - 1)))) for name, (src, m) in late.items()}
    return frames.done(rows.withColumns(signals))


def rolling_volatility(df: DataFrame, keys: Sequence[str], columns: Sequence[str], windows: Sequence[int] = (7, 14, 30), ts: str = TS, tie: str = TIE) -> DataFrame:
    """Variation, relative range, stability, direction changes, and values outside the window's IQR fence."""
    frames = RowFrames(df, list(keys), [ts, tie], before=max(windows) + 2)
    rows = frames.df.withColumns({f"_d_{c}": F.signum(F.col(c) - F.lag(c).over(frames.window)) for c in columns})
    rows = rows.withColumns({f"_t_{c}": F.when(F.lag(f"_d_{c}").over(frames.window).isNotNull(), flag(F.col(f"_d_{c}") != F.lag(f"_d_{c}").over(frames.window)))
                             for c in columns})
    new, drop = {}, []
    for c in columns:
        for n in windows:
            f = frames.rows(-(n - 1))
            mean = F.avg(c).over(f)
            cv = F.coalesce(full(F.when(mean != 0, F.stddev_samp(c).over(f) / mean), f, n), F.lit(0.0))
            turns = frames.rows(-(n - 2)) if n > 1 else f
            new |= {f"{c}_volatility_{n}d": cv,
                    f"{c}_relative_range_{n}d": F.coalesce(full(F.when(mean != 0, (F.max(c).over(f) - F.min(c).over(f)) / mean), f, n), F.lit(0.0)),
                    f"{c}_stability_{n}d": 1 / (1 + cv),
                    # a full window of differences starts one row later than a full window of values
                    f"{c}_direction_changes_{n}d": F.when(F.count(f"_d_{c}").over(f) == n, F.sum(f"_t_{c}").over(turns))}
            if n >= 5:
                q = F.expr(f"percentile(`{c}`, array(0.25D, 0.75D))").over(f)
                new |= {f"_q_{c}_{n}": q, f"_v_{c}_{n}": F.collect_list(c).over(f)}
                drop += [f"_q_{c}_{n}", f"_v_{c}_{n}"]
    rows = rows.withColumns(new)
    outside = {}
    for c in columns:
        for n in (n for n in windows if n >= 5):
            q1, q3 = F.col(f"_q_{c}_{n}")[0], F.col(f"_q_{c}_{n}")[1]
            # the list holds at most n values
            outside[f"{c}_outlier_count_{n}d"] = F.when(F.size(f"_v_{c}_{n}") == n, F.size(_beyond(f"_v_{c}_{n}", q1, q3)))
    rows = rows.withColumns(outside).drop(*drop, *[f"_{p}_{c}" for c in columns for p in "dt"])
    return frames.done(rows)


def _beyond(values: str, q1: Column, q3: Column) -> Column:
    return F.filter(values, lambda x: (x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1)))


def rolling_changes(df: DataFrame, keys: Sequence[str], columns: Sequence[str], windows: Sequence[int] = (1, 3, 7), ts: str = TS, tie: str = TIE) -> DataFrame:
    frames = RowFrames(df, list(keys), [ts, tie], before=max(windows) + 1)
    w, new, late = frames.window, {}, {}
    for c in columns:
        x = F.col(c).cast("double")
        for n in windows:
            before = F.lag(x, n).over(w)
            change = x - before
            new |= {f"{c}_change_{n}d": change, f"{c}_pct_change_{n}d": F.coalesce(F.when(before != 0, change / before), F.lit(0.0)),
                    f"{c}_log_change_{n}d": F.coalesce(F.when((x > 0) & (before > 0), F.ln(x / before)), F.lit(0.0)),
                    f"{c}_change_magnitude_{n}d": F.abs(change), f"{c}_change_direction_{n}d": F.signum(change),
                    # the sum of the last n differences telescopes to the change over n rows
                    f"{c}_cumulative_change_{n}d": change}
            if n >= 2:
                late[f"{c}_acceleration_{n}d"] = F.col(f"{c}_change_{n}d") - F.lag(f"{c}_change_{n}d").over(w)
    return frames.done(frames.df.withColumns(new).withColumns(late))


def rolling_pairs(df: DataFrame, keys: Sequence[str], windows: Sequence[int] = (7, 14, 30), ts: str = TS, tie: str = TIE) -> DataFrame:
    """Rolling correlation, ratio of means, per-credit efficiency, credits per hour; undefined becomes 0."""
    frames = RowFrames(df, list(keys), [ts, tie], before=max(windows))
    zero = lambda v: F.coalesce(F.when(~F.isnan(v), v), F.lit(0.0))
    new = {}
    for n in windows:
        f = frames.rows(-(n - 1))
        mean = lambda c: F.avg(c).over(f)
        over = lambda a, b: zero(full(F.when(b != 0, a / b), f, n))
        for a, b in PAIRS:
            flat = (F.stddev_pop(a).over(f) <= 0) | (F.stddev_pop(b).over(f) <= 0)
            new[f"{a}_{b}_corr_{n}d"] = zero(full(F.when(~flat, correlation(a, b, f)), f, n))
            new[f"{a}_{b}_ratio_{n}d"] = over(mean(a), mean(b))
            if a == "CREDITS_USED" and b in ("BYTES_SCANNED", "ROWS_PRODUCED"):
                new[f"{b}_per_credit_{n}d"] = over(mean(b), mean(a))
        new[f"credits_per_hour_{n}d"] = over(F.sum("CREDITS_USED").over(f), F.sum("EXECUTION_TIME_MS").over(f) / 3.6e6)
    return frames.done(frames.df.withColumns(new))


def seasonal_means(df: DataFrame, keys: Sequence[str], columns: Sequence[str], months: Sequence[int] = (), ts: str = TS, tie: str = TIE) -> DataFrame:
    """Running means restricted to a weekday, an hour, a month, business days or weekends, carried to all rows."""
    dow, hour, month = F.weekday(ts), F.hour(ts), F.month(ts)
    seasons = {**{f"dow_{d}": dow == d for d in range(7)}, **{f"hour_{h}": hour == h for h in HOURS},
               **{f"month_{m}": month == m for m in months}, "business": dow < 5, "weekend": dow >= 5}
    slices = Slices(df, list(keys), [ts, tie])
    sums = {}
    for c in columns:
        for s, cond in seasons.items():
            sums[f"_s_{c}_{s}"] = F.when(cond, F.col(c)).otherwise(0.0)
            sums[f"_n_{c}_{s}"] = F.when(cond & F.col(c).isNotNull(), 1).otherwise(0)
    rows = slices.done(slices.running(slices.df, sums))
    new = {f"{c}_rolling_{s}_mean": F.when(F.col(f"_n_{c}_{s}") > 0, F.col(f"_s_{c}_{s}") / F.col(f"_n_{c}_{s}")) for c in columns for s in seasons}
    return rows.withColumns(new).drop(*sums)


def lag_features(df: DataFrame, keys: Sequence[str], columns: Sequence[str], lags: Sequence[int] = LAGS, ts: str = TS, tie: str = TIE) -> DataFrame:
    """Value k rows before, the difference, and the ratio (1 when undefined)."""
    frames = RowFrames(df, list(keys), [ts, tie], before=max(lags))
    new = {}
    for c in columns:
        for k in lags:
            old = F.lag(c, k).over(frames.window)
            new |= {f"{c}_lag_{k}": old, f"{c}_lag_diff_{k}": F.col(c) - old, f"{c}_lag_ratio_{k}": F.coalesce(F.when(old != 0, F.col(c) / old), F.lit(1.0))}
    return frames.done(frames.df.withColumns(new))


def grouped_means(df: DataFrame, group: str, columns: Sequence[str], days: Sequence[int] = (7, 14, 30), ts: str = TS) -> DataFrame:
    """Mean of the group's last days and the difference to it."""
    for n in days:
        df = rolling_sums(df, [group], columns, n * DAY, f"_g{n}", ts)
        mean = {c: F.col(f"{c}_rolling__g{n}_mean") for c in columns}
        df = df.withColumns({**{f"{c}_group_{group}_rolling_{n}d": mean[c] for c in columns},
                             **{f"{c}_vs_group_{group}_{n}d": F.col(c) - mean[c] for c in columns}})
        df = df.drop(*[f"{c}_rolling__g{n}_{k}" for c in columns for k in ("count", "sum", "mean", "std")])
    return df
