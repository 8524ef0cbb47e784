"""Row-level time features."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewatch.functions.expressions import attach, cut, flag, period, seconds_between
from tidewatch.operators.temporal import cyclical, season

INF = float("inf")
# Parts of day, duration classes, hour and month groups.
PARTS_OF_DAY = ([0, 6, 12, 18, 24], ["night", "morning", "afternoon", "evening"])
DURATIONS = ([0, 1, 5, 15, 60, 240, INF], ["very_short", "short", "medium", "long", "very_long", "extremely_long"])
PEAK_HOURS = (9, 10, 11, 14, 15, 16)
OFF_PEAK_HOURS = (0, 1, 2, 3, 4, 5, 22, 23)
QUARTER_END_MONTHS = (3, 6, 9, 12)
HOLIDAY_MONTHS = (11, 12, 1)


def time_components(df: DataFrame, ts: str = "START_TIME") -> DataFrame:
    t = F.col(ts)
    return df.withColumns({
        "hour_of_day": F.hour(t), "day_of_week": F.weekday(t), "day_of_month": F.dayofmonth(t), "day_of_year": F.dayofyear(t),
        "week_of_year": F.weekofyear(t), "month_of_year": F.month(t), "quarter": F.quarter(t), "year": F.year(t),
        "time_of_day": cut(F.hour(t), *PARTS_OF_DAY, include_lowest=True)})


def cyclical_features(df: DataFrame, ts: str = "START_TIME") -> DataFrame:
    t = F.col(ts)
    return df.withColumns(cyclical({"hour": (F.hour(t), 24), "dow": (F.weekday(t), 7), "dom": (F.dayofmonth(t), 30.5),
                                    "month": (F.month(t), 12), "quarter": (F.quarter(t), 4)}))


def business_indicators(df: DataFrame, ts: str = "START_TIME", hours: tuple[int, int] = (9, 17)) -> DataFrame:
    h, day = F.hour(ts), F.weekday(ts) < 5
    office = (h >= hours[0]) & (h < hours[1])
    return df.withColumns({
        "is_business_day": flag(day), "is_weekend": flag(~day), "is_business_hours": flag(office), "is_business_time": flag(day & office),
        "is_after_hours": flag(day & ~office), "is_non_business_time": flag(~day | ~office)})


def seasonality_features(df: DataFrame, ts: str = "START_TIME") -> DataFrame:
    t, month = F.col(ts), F.month(ts)
    first, last = F.dayofmonth(t) == 1, F.dayofmonth(F.last_day(t)) == F.dayofmonth(t)
    year = F.year(t)
    return df.withColumns({
        "season": season(month), "month_name": F.date_format(t, "MMMM"), "day_name": F.date_format(t, "EEEE"),
        "is_month_start": flag(first), "is_month_end": flag(last),
        "is_quarter_start": flag(first & (month % 3 == 1)), "is_quarter_end": flag(last & (month % 3 == 0)),
        "is_year_start": flag(first & (month == 1)), "is_year_end": flag(last & (month == 12)),
        "days_in_month": F.dayofmonth(F.last_day(t)),
        "is_leap_year": flag(((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0))})


def relative_time(df: DataFrame, ts: str = "START_TIME") -> DataFrame:
    """Hours from the first and to the last row; whole days from and to period bounds."""
    t = F.col(ts)
    df = attach(df, df.agg(F.min(ts).alias("a"), F.max(ts).alias("b")))
    days = lambda a, b: F.datediff(b, a)
    quarter_end = F.last_day(F.add_months(F.trunc(t, "quarter"), 2))
    return df.withColumns({
        "hours_since_dataset_start": seconds_between(F.col("_s.a"), t) / 3600, "hours_until_dataset_end": seconds_between(t, F.col("_s.b")) / 3600,
        "days_since_month_start": days(F.trunc(t, "month"), t), "days_until_month_end": days(t, F.last_day(t)),
        "days_since_quarter_start": days(F.trunc(t, "quarter"), t), "days_until_quarter_end": days(t, quarter_end),
        "days_since_year_start": days(F.trunc(t, "year"), t)}).drop("_s")


def time_indicators(df: DataFrame, ts: str = "START_TIME") -> DataFrame:
    h, m = F.hour(ts), F.month(ts)
    return df.withColumns({
        "is_peak_hours": flag(h.isin(*PEAK_HOURS)), "is_off_peak_hours": flag(h.isin(*OFF_PEAK_HOURS)),
        "is_quarter_end_month": flag(m.isin(*QUARTER_END_MONTHS)), "is_holiday_month": flag(m.isin(*HOLIDAY_MONTHS)),
        "is_morning_rush": flag(h.between(7, 9)), "is_evening_rush": flag(h.between(17, 19)), "is_lunch_hour": flag(h.between(12, 13))})


def duration_features(df: DataFrame, start: str = "START_TIME", end: str = "END_TIME", suffix: str = "query") -> DataFrame:
    s = seconds_between(F.col(start), F.col(end))
    return df.withColumns({
        f"duration_seconds_{suffix}": s, f"duration_minutes_{suffix}": s / 60, f"duration_hours_{suffix}": s / 3600,
        f"duration_category_{suffix}": cut(s / 60, *DURATIONS, include_lowest=True), f"log_duration_seconds_{suffix}": F.log1p(s)})


def all_time_features(df: DataFrame, ts: str = "START_TIME") -> DataFrame:
    for step in (time_components, cyclical_features, business_indicators, seasonality_features, relative_time, time_indicators):
        df = step(df, ts)
    return duration_features(df, ts) if "END_TIME" in df.columns else df
