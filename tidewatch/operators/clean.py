"""Cleaning: duplicates, missing values, outliers, types."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tidewatch.functions.expressions import attach, flag, one_row, stats_of
from tidewatch.functions.ordered import Slices, same_keys_join
from tidewatch.functions.quantiles import label, quantile_row
from tidewatch.functions.spacing import spaced
from tidewatch.operators.near import digest, near_copies
from tidewatch.operators.usage import modes

NUMERIC = ("double", "float", "long", "integer", "short", "byte", "decimal")
TIMES = ("timestamp", "timestamp_ntz", "date")
MAD_SCALE = 0.6745


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() in NUMERIC]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]


def time_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() in TIMES]


# --- duplicates -----------------------------------------------------------------------------

def drop_exact(df: DataFrame, columns: Sequence[str] | None = None, keep: str = "first", order: str | None = None) -> DataFrame:
    """Exact duplicates by ``columns``; ``keep`` is first, last (both by ``order``) or none.

    An aggregate combines copies before the shuffle, so many copies of one row do no harm.
    """
    columns = list(columns or df.columns)
    rest = [c for c in df.columns if c not in columns]
    if keep == "none":
        row = F.struct(*rest) if rest else F.lit(0)
        out = df.groupBy(*columns).agg(F.count("*").alias("_n"), F.first(row).alias("_r")).filter("_n = 1")
        return out.select(*columns, *(["_r.*"] if rest else [])).select(*df.columns)
    if not rest or order is None:
        return df.dropDuplicates(columns)
    pick = F.min_by if keep == "first" else F.max_by
    out = df.groupBy(*columns).agg(pick(F.struct(*rest), F.col(order)).alias("_r"))
    return out.select(*columns, "_r.*").select(*df.columns)


def drop_within(df: DataFrame, keys: Sequence[str], ts: str, tie: str, minutes: float) -> DataFrame:
    """Keep a row only when ``minutes`` have passed since the last kept row of its key."""
    return spaced(df, list(keys), ts, tie, minutes * 60)


def duplicate_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: records in any duplicate group, their percentage, the number of such groups."""
    groups = df.groupBy(*(columns or df.columns)).agg(F.count("*").alias("n"))
    many = F.when(F.col("n") > 1, F.col("n"))
    return groups.agg(F.sum("n").alias("total_records"), F.coalesce(F.sum(many), F.lit(0)).alias("duplicate_records"),
                      F.count(many).alias("duplicate_groups")).withColumn(
        "duplicate_percentage", F.when(F.col("total_records") > 0, F.col("duplicate_records") / F.col("total_records") * 100).otherwise(0.0))


def drop_near(df: DataFrame, row_id: str, text: str | None, similarity: float = 0.95, shingle: int = 3) -> DataFrame:
    """Remove exact copies and near copies of an earlier row; exact dedup when there is no text column."""
    if text is None:
        return drop_exact(df)
    first = df.groupBy(digest(text)).agg(F.min(row_id).alias(row_id)).select(row_id)
    near = near_copies(df, row_id, text, similarity, shingle).select(row_id).distinct()
    return df.join(first, row_id, "left_semi").join(near, row_id, "left_anti")


# --- missing values -------------------------------------------------------------------------

def null_ratios(df: DataFrame) -> dict[str, float]:
    """Share of nulls per column: one small row."""
    row = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in df.columns]).first()
    return {c: row[c] or 0.0 for c in df.columns}


def drop_sparse(df: DataFrame, column_limit: float = 0.8, row_limit: float | None = 0.5) -> DataFrame:
    """Drop columns with more nulls than ``column_limit``, then rows above ``row_limit``."""
    kept = [c for c, r in null_ratios(df).items() if r <= column_limit]
    df = df.select(*kept)
    if row_limit is None:
        return df
    nulls = sum((F.col(c).isNull().cast("int") for c in kept), F.lit(0))
    return df.filter(nulls / len(kept) <= row_limit)


def impute_numeric(df: DataFrame, columns: Sequence[str], how: str = "median") -> DataFrame:
    """mean, median, or most_frequent (smallest value on a tie)."""
    columns = list(columns)
    if how == "mean":
        row = df.agg(*[F.avg(c).alias(c) for c in columns])
    elif how == "median":
        row = quantile_row(df, columns, [0.5]).withColumnsRenamed({f"{c}_p50": c for c in columns})
    elif how == "most_frequent":
        row = one_row(*[modes(df, [], c, c) for c in columns])
    else:
        raise ValueError(f"unknown imputation {how}")
    df = attach(df, row, "_fill")
    kind = {c: df.schema[c].dataType for c in columns}
    return df.withColumns({c: F.coalesce(F.col(c), F.col(f"_fill.{c}").cast(kind[c])) for c in columns}).drop("_fill")


def impute_text(df: DataFrame, columns: Sequence[str], how: str = "most_frequent", value: str = "UNKNOWN") -> DataFrame:
    if how == "constant":
        return df.fillna(value, subset=list(columns))
    row = one_row(*[modes(df, [], c, c) for c in columns])
    df = attach(df, row, "_fill")
    return df.withColumns({c: F.coalesce(F.col(c), F.col(f"_fill.{c}"), F.lit(value)) for c in columns}).drop("_fill")


def impute_times(df: DataFrame, columns: Sequence[str], order: Sequence[str], keys: Sequence[str] = (), how: str = "ffill") -> DataFrame:
    """Forward or backward fill in the given order."""
    slices = Slices(df, list(keys), list(order))
    new = {f"_f_{c}": F.col(c) for c in columns}
    rows = slices.filled(slices.df, new) if how == "ffill" else slices.filled_back(slices.df, new)
    return slices.done(rows).withColumns({c: F.col(f"_f_{c}") for c in columns}).drop(*new)


def impute_by_type(df: DataFrame, order: Sequence[str], skip: Sequence[str] = (), numeric: str = "median") -> DataFrame:
    """Numbers by ``numeric``, text by mode, times by forward fill."""
    skip = set(skip) | set(order)
    numbers = [c for c in numeric_columns(df) if c not in skip]
    texts = [c for c in text_columns(df) if c not in skip]
    times = [c for c in time_columns(df) if c not in skip]
    if numbers:
        df = impute_numeric(df, numbers, numeric)
    if texts:
        df = impute_text(df, texts)
    return impute_times(df, times, order) if times else df


def impute_auto(df: DataFrame, order: Sequence[str], skip: Sequence[str] = ()) -> DataFrame:
    """Drop sparse columns, then impute by type."""
    return impute_by_type(drop_sparse(df, row_limit=None), order, skip)


def interpolate(df: DataFrame, columns: Sequence[str], order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Straight line between known neighbours by row position; the end repeats the last value, the start stays null."""
    slices = Slices(df, list(keys), list(order))
    rows = slices.numbered(slices.df)
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col("_pos").alias("i"), F.col(c).cast("double").alias("x"))) for c in columns}
    rows = slices.filled(rows, {f"_a_{c}": k for c, k in known.items()})
    rows = slices.filled_back(rows, {f"_b_{c}": k for c, k in known.items()})
    out = {}
    for c in columns:
        a, b = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        line = a["x"] + (b["x"] - a["x"]) * (F.col("_pos") - a["i"]) / (b["i"] - a["i"])
        out[c] = F.when(F.col(c).isNotNull(), F.col(c).cast("double")).when(b.isNull(), a["x"]).otherwise(line)
    rows = rows.withColumns(out).drop("_pos", *[f"_{s}_{c}" for c in columns for s in "ab"])
    return slices.done(rows)


def impute_nearest(df: DataFrame, column: str, by: str, row_id: str, k: int = 5) -> DataFrame:
    """Mean of ``column`` over the ``k`` rows nearest in ``by``; equal distances go to the nearer place.

    Rows stand in the order (``by``, id) and donors are numbered along it; the k nearest
    of a row are among the k donors before and the k after its place, so no row meets
    more than 2k donors and none are left out.
    """
    known = df.filter(F.col(by).isNotNull())
    marked = known.select(F.col(row_id).alias("_id"), F.col(by).cast("double").alias("_x"), F.col(column).cast("double").alias("_y"))
    marked = marked.withColumn("_donor", F.col("_y").isNotNull().cast("bigint"))
    slices = Slices(marked, [], ["_x", "_id"])
    placed = slices.done(slices.running(slices.df, {"_rank": F.col("_donor")}))
    donors = placed.filter("_donor = 1").select(F.col("_rank").alias("_slot"), F.col("_x").alias("_dx"), F.col("_y").alias("_dy"))
    targets = placed.filter("_donor = 0").select("_id", "_x", "_rank", F.explode(F.sequence(F.col("_rank") - (k - 1), F.col("_rank") + k)).alias("_slot"))
    near = targets.join(donors, "_slot")
    places = F.when(F.col("_slot") <= F.col("_rank"), F.col("_rank") - F.col("_slot")).otherwise(F.col("_slot") - F.col("_rank") - 1)
    w = Window.partitionBy("_id").orderBy(F.abs(F.col("_x") - F.col("_dx")), places, "_slot")
    chosen = near.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k)
    filled = chosen.groupBy("_id").agg(F.avg("_dy").alias("_fill")).withColumnRenamed("_id", row_id)
    return df.join(filled, row_id, "left").withColumn(column, F.coalesce(F.col(column).cast("double"), "_fill")).drop("_fill")


def impute_iterative(df: DataFrame, columns: Sequence[str], rounds: int = 3) -> DataFrame:
    """Chained regressions: start from the mean, then refit each column on the others ``rounds`` times.

    A filled gap is a linear function of the row's known values, the same for all rows with the same gaps. So the cross
    products of each pattern of gaps, gathered once, give those after every step by algebra, and the table is read
    twice whatever the rounds: for the cross products and to fill the gaps. There are at most 2 ** columns patterns.
    A column without values stays null and takes no part; of dependent columns the shortest coefficients are taken.
    """
    if len(columns) > MOST_CHAINED:
        raise ValueError(f"chained regressions take up to {MOST_CHAINED} columns")
    values = {c: F.col(c).cast("double") for c in columns}
    known = {c: F.when(~F.isnan(x), x) for c, x in values.items()}
    row = df.agg(*[F.avg(x).alias(f"m_{c}") for c, x in known.items()], *[F.stddev_pop(x).alias(f"s_{c}") for c, x in known.items()]).first()
    columns = [c for c in columns if row[f"m_{c}"] is not None]
    if not columns:
        return df.withColumns(known)
    scale = {c: (row[f"m_{c}"], row[f"s_{c}"] or 1.0) for c in columns}
    scaled = [F.coalesce((known[c] - F.lit(m)) / F.lit(s), F.lit(0.0)) for c, (m, s) in scale.items()]
    gaps = sum((F.when(known[c].isNull(), 1 << i).otherwise(0) for i, c in enumerate(columns)), F.lit(0))
    one = [F.lit(1.0), *scaled]
    n = len(one)
    moments = df.groupBy(gaps.alias("gaps")).agg(*[F.sum(one[i] * one[j]).alias(f"p{i}_{j}") for i in range(n) for j in range(i, n)]).collect()
    found = {r["gaps"]: np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)]) for r in moments}
    fills = chained_fills(found, len(columns), rounds)
    out, pattern = {}, gaps
    for i, c in enumerate(columns):
        value = None
        for mask, rows in fills.items():
            if mask >> i & 1:
                line = sum((F.lit(float(w)) * x for w, x in zip(rows[i + 1], one)), F.lit(0.0)) * F.lit(scale[c][1]) + F.lit(scale[c][0])
                value = F.when(pattern == mask, line) if value is None else value.when(pattern == mask, line)
        out[c] = known[c] if value is None else F.coalesce(known[c], value)
    return df.withColumns(out | {c: known[c] for c in known if c not in out})


#: Columns of chained regressions, at most: cross products are kept for each pattern of gaps.
MOST_CHAINED = 12


def chained_fills(moments: Mapping[int, np.ndarray], width: int, rounds: int) -> dict[int, np.ndarray]:
    """For each pattern of gaps the matrix that makes the whole row of its known values (gaps as 0), a leading 1 included.

    ``moments`` are sums of products of scaled rows with a leading 1, by pattern; gaps begin at the mean, which is 0.
    """
    now = {mask: np.array(p) for mask, p in moments.items()}
    made = {mask: np.eye(width + 1) for mask in moments}
    for _ in range(rounds):
        for c in range(1, width + 1):
            others = [i for i in range(width + 1) if i != c]
            whole = sum((p for mask, p in now.items() if not mask >> (c - 1) & 1), np.zeros((width + 1, width + 1)))
            weights, *_ = np.linalg.lstsq(whole[np.ix_(others, others)], whole[others, c], rcond=None)
            for mask in now:
                if mask >> (c - 1) & 1:
                    step = np.eye(width + 1)
                    step[c] = 0.0
                    step[c, others] = weights
                    now[mask] = step @ now[mask] @ step.T
                    made[mask] = step @ made[mask]
    return made


def missing_report(df: DataFrame) -> DataFrame:
    """(column_name, missing_count, missing_percentage, data_type); the row '*' is the whole table."""
    n = len(df.columns)
    row = df.agg(F.count("*").alias("rows"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in df.columns])
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    total = sum((F.col(c) for c in df.columns), F.lit(0))
    entries = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing_count"),
                        (F.col(c) / F.col("rows") * 100).alias("missing_percentage"), F.lit(kinds[c]).alias("data_type")) for c in df.columns]
    entries.append(F.struct(F.lit("*").alias("column_name"), total.alias("missing_count"),
                            (total / (F.col("rows") * n) * 100).alias("missing_percentage"), F.lit("table").alias("data_type")))
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def missing_patterns(df: DataFrame) -> DataFrame:
    """(pattern, rows): one digit per column, 1 where null."""
    pattern = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in df.columns])
    return df.groupBy(pattern.alias("pattern")).agg(F.count("*").alias("rows"))


# --- outliers -------------------------------------------------------------------------------

@dataclass(frozen=True)
class Fence:
    """Limits of a column; a value outside is an outlier."""
    low: Column
    high: Column

    def outside(self, x: Column) -> Column:
        return F.coalesce((x < self.low) | (x > self.high), F.lit(False))


def iqr_fence(df: DataFrame, c: str, factor: float = 1.5) -> Fence:
    s = stats_of(quantile_row(df, [c], [0.25, 0.75]))
    q1, q3 = s[f"{c}_p25"], s[f"{c}_p75"]
    return Fence(q1 - factor * (q3 - q1), q3 + factor * (q3 - q1))


def zscore_fence(df: DataFrame, c: str, limit: float = 3.0) -> Fence:
    s = stats_of(df.agg(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")))
    reach = F.when(s["s"] > 0, s["s"] * limit)
    return Fence(s["m"] - reach, s["m"] + reach)


def modified_zscore_fence(df: DataFrame, c: str, limit: float = 3.5) -> Fence:
    """Median and MAD; a MAD of 0 falls back to the mean absolute deviation, still 0 flags nothing.

    Nulls are skipped.
    """
    middle = quantile_row(df, [c], [0.5])
    spread = attach(df, middle, "_m").select(F.abs(F.col(c) - F.col(f"_m.{c}_p50")).alias("d"))
    s = stats_of(one_row(middle.withColumnRenamed(f"{c}_p50", "median"), quantile_row(spread, ["d"], [0.5]).withColumnRenamed("d_p50", "mad"),
                         spread.agg(F.avg("d").alias("mean_dev"))))
    scale = F.when(s["mad"] > 0, s["mad"]).when(s["mean_dev"] > 0, s["mean_dev"])
    reach = scale * (limit / MAD_SCALE)
    return Fence(s["median"] - reach, s["median"] + reach)


def percentile_fence(df: DataFrame, c: str, low: float = 1, high: float = 99) -> Fence:
    s = stats_of(quantile_row(df, [c], [low / 100, high / 100]))
    return Fence(s[f"{c}_{label(low / 100)}"], s[f"{c}_{label(high / 100)}"])


FENCES = {"iqr": iqr_fence, "zscore": zscore_fence, "modified_zscore": modified_zscore_fence, "percentile": percentile_fence}


def handle_outliers(df: DataFrame, columns: Sequence[str], method: str = "iqr", action: str = "flag") -> DataFrame:
    """Column by column: remove, cap (to the IQR fence), flag, or transform the whole column."""
    for c in columns:
        outside = FENCES[method](df, c).outside(F.col(c))
        if action == "remove":
            df = df.filter(~outside)
        elif action == "cap":
            fence = iqr_fence(df, c)
            df = df.withColumn(c, F.when(outside, F.greatest(fence.low, F.least(fence.high, F.col(c)))).otherwise(F.col(c)))
        elif action == "flag":
            df = df.withColumn(f"{c}_outlier_flag", outside)
        elif action == "transform":
            df = transform_column(df, c)
        else:
            raise ValueError(f"unknown action {action}")
    return df


def transform_column(df: DataFrame, c: str) -> DataFrame:
    """log1p when every value is above 0 (a null counts as not above), else sqrt of the absolute value."""
    positive = df.agg(F.bool_and(F.coalesce(F.col(c) > 0, F.lit(False))).alias("p")).scalar()
    return df.withColumn(c, F.when(positive, F.log1p(c)).otherwise(F.sqrt(F.abs(c))))


def outlier_report(df: DataFrame, columns: Sequence[str], methods: Sequence[str] = ("iqr", "zscore", "percentile")) -> DataFrame:
    """(column_name, count, mean, median, std, min, max, <method>_count, <method>_percentage)."""
    out = None
    for c in columns:
        counts = [F.count_if(FENCES[m](df, c).outside(F.col(c))).alias(f"{m}_count") for m in methods]
        row = df.agg(F.lit(c).alias("column_name"), F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                     F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"), *counts)
        middle = quantile_row(df, [c], [0.5]).withColumnRenamed(f"{c}_p50", "median")
        row = one_row(row, middle).withColumns({f"{m}_percentage": F.when(F.col("count") > 0, F.col(f"{m}_count") / F.col("count") * 100).otherwise(0.0)
                                                for m in methods})
        out = row if out is None else out.unionByName(row)
    return out


# --- types ----------------------------------------------------------------------------------

# Time formats, tokens, shares.
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
                "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss.SSSSSS z", "yyyy-MM-dd HH:mm:ss z")
TRUE_TOKENS, FALSE_TOKENS = ("true", "1", "yes", "on"), ("false", "0", "no", "off")
TIME_SHARE, BOOLEAN_SHARE, NUMBER_SHARE, CATEGORY_SHARE = 0.8, 0.9, 0.8, 0.5
TIME_NAMES = ("START_TIME", "END_TIME", "CREATED_TIME", "MODIFIED_TIME", "LAST_SUCCESS_TIME", "EXECUTION_TIME")
FLAG_NAMES = ("IS_", "HAS_", "CAN_", "SHOULD_", "ENABLED", "DISABLED")
NUMBER_NAMES = ("CREDITS_USED", "BYTES_SCANNED", "ROWS_PRODUCED", "EXECUTION_TIME_MS", "QUEUE_TIME_MS", "TOTAL_ELAPSED_TIME")


def parse_time(c: Column) -> Column:
    """By the first of ``TIME_FORMATS`` that fits. All have two hyphens; a text without them is not tried, as each format that fails costs an exception."""
    return F.when(c.like("%-%-%"), F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in TIME_FORMATS])).cast("timestamp_ntz")


def parse_boolean(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.isin(*TRUE_TOKENS), True).when(low.isin(*FALSE_TOKENS), False)


def parse_number(c: Column) -> Column:
    return c.try_cast("double")


def type_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, rows, known, time_share, boolean_share, number_share, whole_numbers, distinct_values) of text columns.

    Shares are over whole columns; distinct values are counted from distinct pairs.
    """
    columns = list(columns or text_columns(df))
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("v")) for c in columns])).alias("p")).select("p.*")
    counted = long.groupBy("column_name", "v").agg(F.count("*").alias("n"))
    v, n = F.col("v"), F.col("n")
    number = parse_number(v)
    share = lambda ok: F.coalesce(F.sum(F.when(ok, n)), F.lit(0)) / F.sum(F.when(v.isNotNull(), n))
    return counted.groupBy("column_name").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(v.isNotNull(), n)), F.lit(0)).alias("known"),
        share(parse_time(v).isNotNull()).alias("time_share"), share(parse_boolean(v).isNotNull()).alias("boolean_share"),
        share(number.isNotNull()).alias("number_share"), F.bool_and(F.coalesce(number == F.floor(number), F.lit(True))).alias("whole_numbers"),
        F.count("v").alias("distinct_values"))


def recommend_types(profile: DataFrame) -> DataFrame:
    """Add ``recommended_type``: timestamp, boolean, bigint, double, category or string, in that order of trial."""
    return profile.withColumn("recommended_type", F.when(F.col("known") == 0, "string")
                              .when(F.col("time_share") > TIME_SHARE, "timestamp")
                              .when(F.col("boolean_share") == 1, "boolean")
                              .when(F.col("number_share") > NUMBER_SHARE, F.when(F.col("whole_numbers"), "bigint").otherwise("double"))
                              .when(F.col("distinct_values") / F.col("rows") <= CATEGORY_SHARE, "category").otherwise("string"))


def convert_types(df: DataFrame) -> DataFrame:
    """Cast text columns to their recommended type; what does not parse becomes null."""
    texts = text_columns(df)
    if not texts:
        return df
    advice = {r["column_name"]: r["recommended_type"] for r in recommend_types(type_profile(df, texts)).collect()}
    casts = {"timestamp": parse_time, "boolean": parse_boolean, "double": parse_number, "bigint": lambda c: parse_number(c).cast("bigint")}
    return df.withColumns({c: casts[t](F.col(c)) for c, t in advice.items() if t in casts})


def convert_by_name(df: DataFrame) -> DataFrame:
    """Text columns named like times or flags become timestamps or booleans."""
    out = {}
    for c in text_columns(df):
        name = c.upper()
        if any(p in name for p in TIME_NAMES):
            out[c] = parse_time(F.col(c))
        elif name.startswith(FLAG_NAMES):
            out[c] = parse_boolean(F.col(c))
    return df.withColumns(out)


def downcast(df: DataFrame) -> DataFrame:
    """Whole numbers to the smallest integer type that holds them; doubles to float."""
    ranges = (("tinyint", -2 ** 7, 2 ** 7 - 1), ("smallint", -2 ** 15, 2 ** 15 - 1), ("int", -2 ** 31, 2 ** 31 - 1))
    wholes = [f.name for f in df.schema.fields if f.dataType.typeName() in ("long", "integer", "short")]
    casts = {f.name: F.col(f.name).cast("float") for f in df.schema.fields if f.dataType.typeName() == "double"}
    if wholes:
        row = df.agg(*[g(c).alias(f"{k}_{c}") for c in wholes for k, g in (("lo", F.min), ("hi", F.max))]).first()
        for c in wholes:
            lo, hi = row[f"lo_{c}"], row[f"hi_{c}"]
            fit = next((t for t, a, b in ranges if lo is not None and a <= lo and hi <= b), None)
            if fit:
                casts[c] = F.col(c).cast(fit)
    return df.withColumns(casts)


def standardise_log(df: DataFrame) -> DataFrame:
    """UTC times, upper-case warehouse and user names, numbers coerced (bad ones become null)."""
    out = {}
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.name in TIME_NAMES and f.dataType.typeName() == "string":
            out[f.name] = parse_time(c)
        elif f.name in ("WAREHOUSE_NAME", "USER_NAME"):
            out[f.name] = F.upper(c)
        elif f.name in NUMBER_NAMES and f.dataType.typeName() == "string":
            out[f.name] = parse_number(c)
    return df.withColumns(out)


# --- chain ----------------------------------------------------------------------------------

def clean_table(df: DataFrame, order: Sequence[str], steps: Sequence[str] = ("duplicates", "missing_values", "outliers", "types"),
                keys: Sequence[str] | None = None, skip: Sequence[str] = (), outlier_columns: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """The table after each step, in the fixed order duplicates, missing values, outliers, types."""
    out = {"input": df}
    for step in ("duplicates", "missing_values", "outliers", "types"):
        if step not in steps:
            continue
        if step == "duplicates":
            df = drop_exact(df, keys)
        elif step == "missing_values":
            df = impute_auto(df, order, skip)
        elif step == "outliers":
            df = handle_outliers(df, outlier_columns or [c for c in numeric_columns(df) if c not in set(skip) | set(order)], "iqr", "remove")
        else:
            df = convert_types(df)
        out[step] = df
    return out


def cleaning_report(stages: Mapping[str, DataFrame]) -> DataFrame:
    """One row: rows in and out, removed, retention in percent, steps."""
    names = list(stages)
    first, last = stages[names[0]], stages[names[-1]]
    row = one_row(first.agg(F.count("*").alias("initial_rows")), last.agg(F.count("*").alias("final_rows")))
    return row.withColumns({
        "rows_removed": F.col("initial_rows") - F.col("final_rows"),
        "retention_percentage": F.when(F.col("initial_rows") > 0, F.col("final_rows") / F.col("initial_rows") * 100).otherwise(0.0),
        "steps": F.lit(",".join(names[1:]))})


def compare_cleaned(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: row and column counts, null totals, and whether the result is valid."""
    nulls = lambda df: sum((F.count(F.when(F.col(c).isNull(), 1)) for c in df.columns), F.lit(0))
    row = one_row(before.agg(F.count("*").alias("original_rows"), nulls(before).alias("original_nulls")),
                  after.agg(F.count("*").alias("cleaned_rows"), nulls(after).alias("cleaned_nulls")))
    same = len(before.columns) == len(after.columns)
    return row.withColumns({
        "row_delta": F.col("original_rows") - F.col("cleaned_rows"), "same_columns": F.lit(same),
        "nulls_reduced": F.col("cleaned_nulls") <= F.col("original_nulls"),
        "is_valid": (F.col("cleaned_rows") > 0) & F.lit(same) & (F.col("cleaned_nulls") <= F.col("original_nulls"))})
