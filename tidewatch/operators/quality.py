"""Validation, quality rules, schema checks and data profiling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tidewatch.functions.expressions import attach, correlation, flag, kurtosis_corrected, one_row, seconds_between, skew_corrected
from tidewatch.functions.ordered import Slices, same_keys_join
from tidewatch.functions.quantiles import quantile_row
from tidewatch.operators.clean import numeric_columns, parse_number, parse_time, text_columns, time_columns
from tidewatch.operators.usage import distincts
from tidewatch.session import materialise

# Thresholds of the validation pipeline.
THRESHOLDS = {"completeness": 0.95, "consistency": 0.98, "accuracy": 0.99, "timeliness": 0.95, "validity": 0.97, "overall": 0.9}
MIN_SAMPLES, MAX_MISSING, MIN_VARIANCE, MAX_CORRELATION = 1000, 0.05, 0.001, 0.95
MAX_GAP_HOURS = 24.0


def unpivot(row: DataFrame, entries: Sequence[Column]) -> DataFrame:
    """One row of named structs to one row per struct."""
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def entry(**values) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in values.items()])


# --- pipeline validation --------------------------------------------------------------------

def basic_checks(df: DataFrame) -> DataFrame:
    """One row: rows, columns by kind, duplicate rows, all-null and constant columns, infinite and negative values."""
    numbers = numeric_columns(df)
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    inf = [F.count_if(F.abs(F.col(c)) == F.lit(float("inf"))) for c in doubles]
    negative = [F.count_if(F.col(c) < 0) for c in numbers]
    add = lambda xs: sum(xs, F.lit(0))
    row = df.agg(F.count("*").alias("row_count"), add(inf).alias("infinite_values"), add(negative).alias("negative_values"),
                 add([F.count(F.when(F.col(c).isNull(), 1)) for c in numbers]).alias("missing_numbers"),
                 *[F.count(c).alias(f"k{i}") for i, c in enumerate(df.columns)],
                 *[(F.min(c).eqNullSafe(F.max(c))).alias(f"c{i}") for i, c in enumerate(df.columns)])
    copies = df.groupBy(*df.columns).agg(F.count("*").alias("n")).agg((F.sum("n") - F.count("*")).alias("duplicate_rows"))
    n = len(df.columns)
    row = row.select(
        "row_count", F.lit(n).alias("column_count"), F.lit(len(numbers)).alias("numeric_columns"),
        F.lit(len(text_columns(df))).alias("categorical_columns"), F.lit(len(time_columns(df))).alias("datetime_columns"),
        add([flag(F.col(f"k{i}") == 0) for i in range(n)]).alias("columns_with_all_null"),
        add([flag(F.col(f"c{i}")) for i in range(n)]).alias("constant_columns"),
        "missing_numbers", "infinite_values", "negative_values", flag(F.col("row_count") == 0).alias("is_empty"))
    return one_row(row, copies.withColumn("duplicate_rows", F.coalesce("duplicate_rows", F.lit(0))))


def completeness(df: DataFrame) -> DataFrame:
    row = df.agg(F.count("*").alias("_rows"), *[F.count(c).alias(f"k{i}") for i, c in enumerate(df.columns)])
    return unpivot(row, [entry(column_name=c, missing_count=F.col("_rows") - F.col(f"k{i}"),
                               missing_percentage=(F.col("_rows") - F.col(f"k{i}")) / F.col("_rows") * 100,
                               completeness_score=F.col(f"k{i}") / F.col("_rows")) for i, c in enumerate(df.columns)])


def uniqueness(df: DataFrame) -> DataFrame:
    """Distinct values per column, counted from distinct (column, value) pairs."""
    pairs = df.select(F.explode(F.array(*[entry(column_name=c, v=F.col(c).cast("string")) for c in df.columns])).alias("p")).select("p.*")
    counted = pairs.groupBy("column_name", "v").agg(F.count("v").alias("n"))
    out = counted.groupBy("column_name").agg(F.count("v").alias("unique_count"), F.sum("n").alias("total_non_null"))
    return out.withColumns({"uniqueness_score": F.col("unique_count") / F.greatest("total_non_null", F.lit(1)),
                            "duplicate_count": F.col("total_non_null") - F.col("unique_count")})


def type_consistency(df: DataFrame) -> DataFrame:
    """1.0 when all values of a column are of one class (time, number or text), else 0.5; typed columns are 1.0."""
    texts = text_columns(df)
    def kinds(c):
        v = F.col(c)
        return F.when(parse_time(v).isNotNull(), "time").when(parse_number(v).isNotNull(), "number").when(v.isNotNull(), "text")
    row = df.agg(F.count("*").alias("_n"), *[F.count_distinct(kinds(c)).alias(f"t{i}") for i, c in enumerate(texts)])
    place = {c: i for i, c in enumerate(texts)}
    return unpivot(row, [entry(column_name=c, validity_score=F.when(F.col(f"t{place[c]}") > 1, 0.5).otherwise(1.0) if c in place else F.lit(1.0))
                         for c in df.columns])


def constraint_rules(columns: Sequence[str]) -> dict[str, Column]:
    """The constraints whose columns are present."""
    rules = {
        "credits_non_negative": ("CREDITS_USED", F.col("CREDITS_USED") >= 0),
        "execution_time_positive": ("EXECUTION_TIME_MS", F.col("EXECUTION_TIME_MS") > 0),
        "bytes_scanned_non_negative": ("BYTES_SCANNED", F.col("BYTES_SCANNED") >= 0),
        "rows_produced_non_negative": ("ROWS_PRODUCED", F.col("ROWS_PRODUCED") >= 0),
        "start_before_end": ("END_TIME", F.col("START_TIME") <= F.col("END_TIME"))}
    return {name: rule for name, (needs, rule) in rules.items() if needs in columns}


def constraints(df: DataFrame) -> DataFrame:
    """(constraint, violations, constraint_satisfied, constraint_score); a null fails."""
    rules = constraint_rules(df.columns)
    if not rules:
        return df.sparkSession.createDataFrame(
            [], "constraint string, violations bigint, constraint_satisfied int, constraint_score double")
    row = df.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])
    return unpivot(row, [entry(constraint=name, violations=F.col(name), constraint_satisfied=flag(F.col(name) == 0),
                               constraint_score=F.when(F.col(name) == 0, 1.0).otherwise(0.0)) for name in rules])


def distributions(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, skewness, kurtosis, outlier_count, outlier_percentage, distribution_score)."""
    columns = list(columns or numeric_columns(df))
    marked = attach(df, quantile_row(df, columns, [0.25, 0.75]), "_q")
    def outside(c):
        q1, q3 = F.col(f"_q.{c}_p25"), F.col(f"_q.{c}_p75")
        return (F.col(c) < q1 - 1.5 * (q3 - q1)) | (F.col(c) > q3 + 1.5 * (q3 - q1))
    row = marked.agg(*[x for i, c in enumerate(columns) for x in (
        F.count(c).alias(f"n{i}"), skew_corrected(c).alias(f"s{i}"), kurtosis_corrected(c).alias(f"k{i}"), F.count_if(outside(c)).alias(f"o{i}"))])
    entries = []
    for i, c in enumerate(columns):
        share = F.col(f"o{i}") / F.col(f"n{i}")
        score = 1 - F.least(F.abs(f"s{i}") / 3, F.lit(1.0)) - F.least(share, F.lit(0.1))
        entries.append(entry(column_name=c, skewness=F.col(f"s{i}"), kurtosis=F.col(f"k{i}"), outlier_count=F.col(f"o{i}"),
                             outlier_percentage=share * 100, distribution_score=score))
    return unpivot(row, entries)


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(feature1, feature2, correlation) over all column pairs in one pass."""
    columns = list(columns or numeric_columns(df))
    pairs = list(combinations(columns, 2))
    row = df.agg(*[correlation(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return unpivot(row, [entry(feature1=a, feature2=b, correlation=F.col(f"r{i}")) for i, (a, b) in enumerate(pairs)])


def correlation_check(df: DataFrame, columns: Sequence[str] | None = None, limit: float = 0.8) -> DataFrame:
    r = F.abs("correlation")
    return correlations(df, columns).agg(
        F.count_if(r > limit).alias("high_correlations"), F.max(r).alias("max_correlation"),
        (1 - F.least(F.count_if(r > limit) / 10, F.lit(1.0))).alias("correlation_score"))


@dataclass(frozen=True)
class ColumnRule:
    type: str
    nullable: bool = True
    min_value: float | None = None
    max_value: float | None = None
    max_length: int | None = None


# Families of compatible types.
TYPE_FAMILIES = {"int": {"long", "integer", "short", "byte"}, "float": {"double", "float", "decimal", "long", "integer"},
                 "string": {"string"}, "datetime": {"timestamp", "timestamp_ntz", "date"}, "bool": {"boolean"}}


def schema_check(df: DataFrame, schema: Mapping[str, ColumnRule], allow_extra: bool = False) -> DataFrame:
    """(column_name, issue, violation_count) for missing, extra and mistyped columns and broken limits."""
    present = {f.name: f.dataType.typeName() for f in df.schema.fields}
    fixed = [(c, "missing_column") for c in schema if c not in present]
    fixed += [] if allow_extra else [(c, "extra_column") for c in present if c not in schema]
    fixed += [(c, "type_mismatch") for c, r in schema.items() if c in present and present[c] not in TYPE_FAMILIES[r.type]]
    checks = []
    for c, r in schema.items():
        if c not in present:
            continue
        x = F.col(c)
        if not r.nullable:
            checks.append((c, "not_null", x.isNull()))
        if r.min_value is not None:
            checks.append((c, "min_value", x < r.min_value))
        if r.max_value is not None:
            checks.append((c, "max_value", x > r.max_value))
        if r.max_length is not None and present[c] == "string":
            checks.append((c, "max_length", F.length(x) > r.max_length))
    row = df.agg(F.count("*").alias("_rows"), *[F.count_if(cond).alias(f"v{i}") for i, (_, _, cond) in enumerate(checks)])
    entries = [entry(column_name=c, issue=issue, violation_count=F.lit(1).cast("bigint")) for c, issue in fixed]
    entries += [entry(column_name=c, issue=issue, violation_count=F.col(f"v{i}")) for i, (c, issue, _) in enumerate(checks)]
    return unpivot(row, entries).filter("violation_count > 0")


def temporal_check(df: DataFrame, ts: str, ingest: str, as_of: str) -> DataFrame:
    """One row: gaps over 24 h in sorted time, order by the ingest column, future dates."""
    rows = df.select(ts, ingest)
    by_time = Slices(rows.dropna(subset=[ts]), [], [ts, ingest])
    gaps = by_time.done(by_time.previous(by_time.df, {"_before": ts}))
    hours = seconds_between(F.col("_before"), F.col(ts)) / 3600
    gap_row = gaps.withColumn("_gap", hours).agg(
        F.count_if(F.col("_gap") > MAX_GAP_HOURS).alias("large_gaps_count"), F.max("_gap").alias("max_gap_hours"),
        F.avg("_gap").alias("avg_gap_hours"), (1 - F.count_if(F.col("_gap") > MAX_GAP_HOURS) / F.greatest(F.count("*"), F.lit(1))).alias("continuity_score"))
    by_arrival = Slices(rows.dropna(subset=[ts]), [], [ingest])
    arrived = by_arrival.previous(by_arrival.df, {"_before": ts})
    order_row = arrived.agg(F.count_if(F.col("_before") > F.col(ts)).alias("out_of_order"))
    future = rows.agg(F.count_if(F.col(ts) > F.lit(as_of).cast("timestamp_ntz")).alias("future_count"), F.count("*").alias("_rows"))
    out = one_row(gap_row, order_row, future)
    return out.withColumns({
        "is_chronological": flag(F.col("out_of_order") == 0), "future_percentage": F.col("future_count") / F.col("_rows") * 100,
        "timeliness_score": 1 - F.col("future_count") / F.col("_rows")}).drop("_rows")


def ml_readiness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: sample size, missing rate, variance and correlation checks with their scores."""
    columns = list(columns or numeric_columns(df))
    nulls = [F.avg(F.col(c).isNull().cast("int")) for c in df.columns]
    variances = [F.var_samp(c) for c in columns]
    row = df.agg(F.count("*").alias("actual_samples"), F.greatest(*nulls).alias("max_missing_rate"),
                 (1 - sum(nulls[1:], nulls[0]) / len(nulls)).alias("missing_score"),
                 sum((flag(v < MIN_VARIANCE) for v in variances), F.lit(0)).alias("low_variance_features"))
    pairs = len(columns) * (len(columns) - 1) / 2
    high = correlations(df, columns).agg(F.count_if(F.abs("correlation") > MAX_CORRELATION).alias("high_correlation_pairs"))
    out = one_row(row, high)
    return out.withColumns({
        "sample_adequacy_score": F.least(F.col("actual_samples") / MIN_SAMPLES, F.lit(1.0)),
        "acceptable_missing_rate": flag(F.col("max_missing_rate") <= MAX_MISSING),
        "variance_score": 1 - F.col("low_variance_features") / len(columns),
        "correlation_score": 1 - F.col("high_correlation_pairs") / max(pairs, 1)})


def variance_importance(df: DataFrame, columns: Sequence[str] | None = None, low: float = 0.01) -> DataFrame:
    """(column_name, importance, is_low): share of the summed variances."""
    columns = list(columns or numeric_columns(df))
    row = df.agg(*[F.var_samp(c).alias(f"v{i}") for i, c in enumerate(columns)])
    total = sum((F.col(f"v{i}") for i in range(len(columns))), F.lit(0.0))
    share = lambda i: F.when(total > 0, F.col(f"v{i}") / total).otherwise(F.col(f"v{i}"))
    return unpivot(row, [entry(column_name=c, importance=share(i), is_low=flag(share(i) < low)) for i, c in enumerate(columns)])


def compare_with(df: DataFrame, reference: DataFrame) -> DataFrame:
    """(column_name, mean_change_pct, std_change_pct, median_change_pct) of the shared numeric columns."""
    columns = [c for c in numeric_columns(df) if c in numeric_columns(reference)]
    def stats(t, suffix):
        row = t.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp))])
        row = one_row(row, quantile_row(t, columns, [0.5]))
        return row.select(*[F.col(f"{c}_{k}").alias(f"{suffix}{i}_{n}") for i, c in enumerate(columns)
                            for n, k in (("mean", "mean"), ("std", "std"), ("median", "p50"))])
    row = one_row(stats(df, "a"), stats(reference, "b"))
    change = lambda i, n: F.when(F.col(f"b{i}_{n}") != 0, (F.col(f"a{i}_{n}") - F.col(f"b{i}_{n}")) / F.col(f"b{i}_{n}") * 100).otherwise(0.0)
    return unpivot(row, [entry(column_name=c, mean_change_pct=change(i, "mean"), std_change_pct=change(i, "std"),
                               median_change_pct=change(i, "median")) for i, c in enumerate(columns)])


def compare_shape(df: DataFrame, reference: DataFrame) -> DataFrame:
    row = one_row(df.agg(F.count("*").alias("current_rows")), reference.agg(F.count("*").alias("reference_rows")))
    added, removed = sorted(set(df.columns) - set(reference.columns)), sorted(set(reference.columns) - set(df.columns))
    return row.withColumns({
        "columns_added": F.lit(",".join(added)), "columns_removed": F.lit(",".join(removed)),
        "shape_consistent": flag((F.col("current_rows") == F.col("reference_rows")) & F.lit(len(df.columns) == len(reference.columns)))})


def stage_scores(df: DataFrame, stage: str, schema: Mapping[str, ColumnRule] | None = None, ml: bool = False) -> DataFrame:
    """(stage, dimension, score) rows and the overall mean."""
    part = lambda t, name, col: t.agg(F.lit(name).alias("dimension"), F.avg(col).alias("score"))
    accuracy = constraints(df).select(F.col("constraint_score").alias("s")).unionByName(
        distributions(df).select(F.col("distribution_score").alias("s")))
    parts = [part(completeness(df), "completeness", "completeness_score"), part(type_consistency(df), "consistency", "validity_score"),
             part(accuracy, "accuracy", "s")]
    if schema is not None:
        issues = schema_check(df, schema).agg(F.lit("schema_compliance").alias("dimension"), F.when(F.count("*") > 0, 0.0).otherwise(1.0).alias("score"))
        parts.append(issues)
    else:
        parts.append(df.limit(0).agg(F.lit("schema_compliance").alias("dimension"), F.lit(1.0).alias("score")))
    if ml:
        m = ml_readiness(df)
        parts.append(m.select(F.lit("ml_readiness").alias("dimension"), (
            (F.col("sample_adequacy_score") + F.col("missing_score") + F.col("variance_score") + F.col("correlation_score")) / 4).alias("score")))
    else:
        parts.append(df.limit(0).agg(F.lit("ml_readiness").alias("dimension"), F.lit(1.0).alias("score")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = materialise(out)  # a few rows; the overall score, and what stages add to it, would run every part again
    overall = out.agg(F.lit("overall").alias("dimension"), F.avg("score").alias("score"))
    return out.unionByName(overall).withColumn("stage", F.lit(stage))


def failures(scores: DataFrame) -> DataFrame:
    """Scores below their threshold."""
    limits = F.create_map(*[x for k, v in THRESHOLDS.items() for x in (F.lit(k), F.lit(v))])
    return (scores.withColumn("threshold", F.try_element_at(limits, F.col("dimension")))
            .filter(F.col("score") < F.col("threshold")))


def recommendations(scores: DataFrame) -> DataFrame:
    """(stage, recommendation) from the dimension scores."""
    rules = [("completeness", 0.9, "impute_missing_values"), ("consistency", 0.9, "standardise_types"), ("ml_readiness", 0.8, "improve_ml_readiness"),
             ("schema_compliance", 1.0, "align_schema"), ("overall", 0.8, "monitor_data_quality")]
    marks = [F.when((F.col("dimension") == d) & (F.col("score") < limit), F.lit(text)) for d, limit, text in rules]
    return scores.select("stage", F.explode(F.array_compact(F.array(*marks))).alias("recommendation"))


def pipeline_scores(stages: Mapping[str, DataFrame]) -> DataFrame:
    """Scores of all stages plus, as stage '*', the mean of their overall scores."""
    out = None
    for name, df in stages.items():
        s = stage_scores(df, name, ml=name.startswith("ml"))
        out = s if out is None else out.unionByName(s)
    mean = out.filter("dimension = 'overall'").agg(F.lit("overall").alias("dimension"), F.avg("score").alias("score"), F.lit("*").alias("stage"))
    return out.unionByName(mean.select(*out.columns))


def cross_stage(stages: Mapping[str, DataFrame]) -> DataFrame:
    """(from_stage, to_stage, rows, next_rows, is_consistent, removed_columns, lacks_new_features) of neighbours."""
    names, out = list(stages), None
    for a, b in zip(names, names[1:]):
        x, y = stages[a], stages[b]
        removed = sorted(set(x.columns) - set(y.columns)) if a != "cleaned_data_validation" else []
        lacks = "feature" in b.lower() and not set(y.columns) - set(x.columns)
        row = one_row(x.agg(F.count("*").alias("rows")), y.agg(F.count("*").alias("next_rows")))
        row = row.withColumns({"from_stage": F.lit(a), "to_stage": F.lit(b), "is_consistent": flag(F.col("next_rows") >= F.col("rows") * 0.5),
                               "removed_columns": F.lit(",".join(removed)), "lacks_new_features": F.lit(int(lacks))})
        out = row if out is None else out.unionByName(row)
    return out


def history_metrics(history: DataFrame) -> DataFrame:
    """(stage, mean_score, validations, passed, trend) from (stage, run_at, overall, passed) rows; '*' is all stages."""
    at = F.struct("run_at", "stage").alias("at")
    both = history.select(at, "overall", "passed", F.explode(F.array(F.col("stage"), F.lit("*"))).alias("stage"))
    first, last = F.min_by("overall", "at"), F.max_by("overall", "at")
    return both.groupBy("stage").agg(
        F.avg("overall").alias("mean_score"), F.count("*").alias("validations"), F.count_if(F.col("passed") == 1).alias("passed"),
        F.when((F.count("*") > 1) & (last > first), "improving").otherwise("stable").alias("trend"))


# --- quality rules --------------------------------------------------------------------------

# Rule name, kind, severity, threshold; weights; required and enumerated columns.
RULES = [("required_fields_complete", "completeness", "critical", 0.95), ("timestamp_completeness", "completeness", "critical", 0.99),
         ("numeric_ranges", "accuracy", "warning", 0.95), ("positive_credits", "accuracy", "critical", 0.99),
         ("timestamp_order", "consistency", "critical", 0.99), ("user_name_format", "consistency", "warning", 0.90),
         ("data_freshness", "timeliness", "warning", 0.95), ("enum_values", "validity", "critical", 0.99)]
WEIGHTS = {"critical": 3.0, "warning": 2.0, "info": 1.0}
REQUIRED = {"warehouse_usage_raw": ("START_TIME", "WAREHOUSE_ID", "CREDITS_USED"), "query_history_raw": ("QUERY_ID", "START_TIME", "USER_NAME"),
            "user_activity_raw": ("EVENT_ID", "EVENT_TIMESTAMP", "USER_NAME")}
ENUMS = {"EXECUTION_STATUS": ("SUCCESS", "FAIL", "CANCELLED", "RUNNING"), "IS_SUCCESS": ("YES", "NO"), "EVENT_TYPE": ("LOGIN", "LOGOUT")}
USER_FORMAT = r"^[A-Za-z][A-Za-z0-9_.@-]*$"


def quality_rules(df: DataFrame, table: str, as_of: str) -> DataFrame:
    """(rule_name, rule_type, severity, threshold, affected, total, score, passed): all rules in one pass."""
    names = {c.upper(): c for c in df.columns}
    required = [c for c in REQUIRED.get(table, ()) if c in df.columns]
    times = [f.name for f in df.schema.fields if "TIME" in f.name.upper()]
    stamps = [c for c in times if df.schema[c].dataType.typeName() in ("timestamp", "timestamp_ntz", "date")]
    credits = [c for c in df.columns if "CREDIT" in c.upper()]
    numbers = numeric_columns(df)
    pairs = [(names[c], names[c.replace("START", "END")]) for c in names if "START_TIME" in c and c.replace("START", "END") in names]
    enums = [c for c in ENUMS if c in df.columns]
    fresh = F.lit(as_of).cast("timestamp_ntz") - F.expr("interval 24 hours")
    add = lambda xs: sum(xs, F.lit(0))
    nulls = lambda c: F.count(F.when(F.col(c).isNull(), 1))
    rows = F.count(F.lit(1))
    marked = attach(df, quantile_row(df, numbers, [0.25, 0.75]), "_q") if numbers else df

    def outside(c):
        q1, q3 = F.col(f"_q.{c}_p25"), F.col(f"_q.{c}_p75")
        return F.when(F.count(c) > 10, F.count_if((F.col(c) < q1 - 1.5 * (q3 - q1)) | (F.col(c) > q3 + 1.5 * (q3 - q1)))).otherwise(0)

    known = lambda c: F.when(F.count(c) > 10, F.count(c)).otherwise(0)
    found = {
        "required_fields_complete": (add([nulls(c) for c in required]), rows * len(required)),
        "timestamp_completeness": (add([nulls(c) for c in times]), rows * len(times)),
        "numeric_ranges": (add([outside(c) for c in numbers]), add([known(c) for c in numbers])),
        "positive_credits": (add([F.count_if(parse_number(F.col(c)) < 0) for c in credits]), add([F.count(parse_number(F.col(c))) for c in credits])),
        "timestamp_order": (add([F.count_if(F.col(a) >= F.col(b)) for a, b in pairs]),
                            add([F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)) for a, b in pairs])),
        "user_name_format": (F.count_if(~F.col("USER_NAME").rlike(USER_FORMAT)), F.count("USER_NAME")) if "USER_NAME" in df.columns else (F.lit(0), F.lit(0)),
        "data_freshness": (add([F.count_if(F.col(c) < fresh) for c in stamps]), add([F.count(c) for c in stamps])),
        "enum_values": (add([F.count_if(~F.col(c).isin(*ENUMS[c])) for c in enums]), add([F.count(c) for c in enums])),
    }
    row = marked.agg(*[x.cast("bigint").alias(f"{side}{i}") for i, (name, *_) in enumerate(RULES) for side, x in zip("at", found[name])])
    entries = []
    for i, (name, kind, severity, threshold) in enumerate(RULES):
        score = F.when(F.col(f"t{i}") > 0, 1 - F.col(f"a{i}") / F.col(f"t{i}")).otherwise(1.0)
        entries.append(entry(rule_name=name, rule_type=kind, severity=severity, threshold=float(threshold), affected=F.col(f"a{i}"),
                             total=F.col(f"t{i}"), score=score, passed=flag(score >= threshold)))
    return unpivot(row, entries)


def quality_summary(rules: DataFrame) -> DataFrame:
    """One row: weighted score, rule counts, critical failures, grade."""
    weight = F.element_at(F.create_map(*[x for k, v in WEIGHTS.items() for x in (F.lit(k), F.lit(v))]), F.col("severity"))
    out = rules.agg((F.sum(F.col("score") * weight) / F.sum(weight)).alias("overall_score"), F.count("*").alias("total_rules"),
                    F.sum("passed").alias("passed_rules"), F.count_if(F.col("passed") == 0).alias("failed_rules"),
                    F.count_if((F.col("passed") == 0) & (F.col("severity") == "critical")).alias("critical_failures"))
    s = F.col("overall_score")
    return out.withColumns({
        "quality_grade": F.when(s >= 0.95, "A").when(s >= 0.9, "B").when(s >= 0.8, "C").when(s >= 0.7, "D").otherwise("F"),
        "needs_attention": flag((F.col("critical_failures") > 0) | (s < 0.8))})


# --- declared table schemas -----------------------------------------------------------------

@dataclass(frozen=True)
class Field:
    name: str
    type: str
    required: bool = False
    nullable: bool = False
    min_value: float | None = None
    max_value: float | None = None
    allowed: tuple[str, ...] = ()
    pattern: str | None = None


@dataclass(frozen=True)
class TableSchema:
    fields: tuple[Field, ...]
    keys: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    references: Mapping[str, str] = field(default_factory=dict)


_F = Field
# The declared tables.
SCHEMAS = {
    "warehouse_usage_raw": TableSchema((
        _F("START_TIME", "datetime", True), _F("END_TIME", "datetime", True), _F("WAREHOUSE_ID", "int", True, min_value=0),
        _F("WAREHOUSE_NAME", "string", True), _F("CREDITS_USED", "float", True, min_value=0), _F("CREDITS_USED_COMPUTE", "float", min_value=0),
        _F("CREDITS_USED_CLOUD_SERVICES", "float", min_value=0), _F("BYTES_SCANNED", "int", min_value=0), _F("BYTES_WRITTEN", "int", min_value=0)),
        ("START_TIME", "WAREHOUSE_ID")),
    "query_history_raw": TableSchema((
        _F("QUERY_ID", "string", True), _F("START_TIME", "datetime", True), _F("END_TIME", "datetime", nullable=True), _F("USER_NAME", "string", True),
        _F("WAREHOUSE_NAME", "string", nullable=True), _F("EXECUTION_STATUS", "string", True, allowed=("SUCCESS", "FAIL", "CANCELLED", "RUNNING")),
        _F("TOTAL_ELAPSED_TIME", "int", min_value=0), _F("BYTES_SCANNED", "int", min_value=0), _F("ROWS_PRODUCED", "int", min_value=0)), ("QUERY_ID",)),
    "user_activity_raw": TableSchema((
        _F("EVENT_ID", "string", True), _F("EVENT_TIMESTAMP", "datetime", True), _F("EVENT_TYPE", "string", True), _F("USER_NAME", "string", True),
        _F("IS_SUCCESS", "string", True, allowed=("YES", "NO")), _F("CLIENT_IP", "string", nullable=True)), ("EVENT_ID",)),
    "query_metrics": TableSchema((
        _F("QUERY_ID", "string", True), _F("QUERY_DURATION_MS", "float", True, min_value=0),
        _F("PERFORMANCE_CLASS", "string", nullable=True, allowed=("Fast", "Normal", "Slow", "Very Slow", "Extremely Slow")),
        _F("CACHE_HIT_RATIO", "float", min_value=0, max_value=1), _F("SPILLAGE_RATIO", "float", min_value=0), _F("IS_RESOURCE_INTENSIVE", "bool")), ("QUERY_ID",)),
}
SPARK_TYPES = {"datetime": "timestamp_ntz", "int": "bigint", "float": "double", "string": "string", "bool": "boolean"}


def _cast(c: str, kind: str, actual: str) -> Column:
    x = F.col(c)
    if actual != "string" or kind == "string":
        return x.cast(SPARK_TYPES[kind])
    return parse_time(x) if kind == "datetime" else x.try_cast(SPARK_TYPES[kind])


def field_checks(df: DataFrame, schema: TableSchema) -> DataFrame:
    """(field, check, violations): type, null, allowed, min, max, pattern; only broken checks."""
    actual = {f.name: f.dataType.typeName() for f in df.schema.fields}
    checks = []
    for f in schema.fields:
        if f.name not in actual:
            continue
        x, value = F.col(f.name), _cast(f.name, f.type, actual[f.name])
        checks.append((f.name, "type", x.isNotNull() & value.isNull()))
        if not f.nullable:
            checks.append((f.name, "null", x.isNull()))
        if f.allowed:
            checks.append((f.name, "allowed_values", x.isNotNull() & ~x.isin(*f.allowed)))
        if f.min_value is not None:
            checks.append((f.name, "min_value", value < f.min_value))
        if f.max_value is not None:
            checks.append((f.name, "max_value", value > f.max_value))
        if f.pattern:
            checks.append((f.name, "pattern", ~x.rlike(f"^(?:{f.pattern})")))
    row = df.agg(*[F.count_if(cond).alias(f"v{i}") for i, (_, _, cond) in enumerate(checks)])
    return unpivot(row, [entry(field=name, check=kind, violations=F.col(f"v{i}")) for i, (name, kind, _) in enumerate(checks)]).filter("violations > 0")


def key_violations(df: DataFrame, keys: Sequence[str], name: str = "primary_key") -> DataFrame:
    """(field, check, violations): rows beyond the first of each key."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return groups.agg(F.lit(",".join(keys)).alias("field"), F.lit(name).alias("check"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"))


def orphans(df: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """(field, check, violations): rows whose non-null key has no parent."""
    lost = df.filter(F.col(column).isNotNull()).join(parent.select(F.col(parent_column).alias(column)).distinct(), column, "left_anti")
    return lost.agg(F.lit(column).alias("field"), F.lit("foreign_key").alias("check"), F.count("*").alias("violations"))


def validate_table(df: DataFrame, table: str) -> DataFrame:
    """Violations of a declared table: structure, else fields, else constraints; stops at the first failing level."""
    schema = SCHEMAS[table]
    missing = [f.name for f in schema.fields if f.required and f.name not in df.columns]
    if missing:
        row = df.limit(0).agg(F.count("*").alias("_n"))
        return unpivot(row, [entry(field=c, check="missing_column", violations=F.lit(1).cast("bigint")) for c in missing])
    fields = field_checks(df, schema)
    keys = key_violations(df, schema.keys).filter("violations > 0")
    for columns in schema.unique:
        keys = keys.unionByName(key_violations(df, columns, "unique").filter("violations > 0"))
    broken = fields.agg(F.count("*").alias("n"))
    return fields.unionByName(keys.filter(broken.scalar() == 0))


def conform(df: DataFrame, table: str) -> DataFrame:
    """Declared columns cast to their declared types."""
    actual = {f.name: f.dataType.typeName() for f in df.schema.fields}
    return df.select(*[_cast(f.name, f.type, actual[f.name]).alias(f.name) for f in SCHEMAS[table].fields if f.name in actual])


# --- table anomalies and lineage records -----------------------------------------------------

VOLUME_RANGE = (100, 100_000)


def table_anomalies(df: DataFrame, as_of: str, volume: tuple[int, int] = VOLUME_RANGE) -> DataFrame:
    """(type, column_name, count, share): unusual volume, future times, columns with over 5 % extreme values."""
    times, numbers = time_columns(df), numeric_columns(df)
    times = [c for c in times if "TIME" in c.upper()]
    marked = attach(df, quantile_row(df, numbers, [0.25, 0.75]), "_q")
    def extreme(c):
        q1, q3 = F.col(f"_q.{c}_p25"), F.col(f"_q.{c}_p75")
        return F.count_if((F.col(c) < q1 - 3 * (q3 - q1)) | (F.col(c) > q3 + 3 * (q3 - q1)))
    now = F.lit(as_of).cast("timestamp_ntz")
    row = marked.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c) > now).alias(f"f{i}") for i, c in enumerate(times)],
                     *[x for i, c in enumerate(numbers) for x in (extreme(c).alias(f"x{i}"), F.count(c).alias(f"n{i}"))])
    none = F.lit(None).cast("string")
    make = lambda kind, col, n, share: F.struct(F.lit(kind).alias("type"), col.alias("column_name"), n.cast("bigint").alias("count"), share.cast("double").alias("share"))
    entries = [F.when(F.col("rows") < volume[0], make("low_volume", none, F.col("rows"), F.lit(None))),
               F.when(F.col("rows") > volume[1], make("high_volume", none, F.col("rows"), F.lit(None)))]
    entries += [F.when(F.col(f"f{i}") > 0, make("future_timestamps", F.lit(c), F.col(f"f{i}"), F.lit(None))) for i, c in enumerate(times)]
    entries += [F.when((F.col(f"n{i}") > 10) & (F.col(f"x{i}") > F.col(f"n{i}") * 0.05), make("extreme_values", F.lit(c), F.col(f"x{i}"), F.col(f"x{i}") / F.col(f"n{i}")))
                for i, c in enumerate(numbers)]
    return row.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.*")


LINEAGE_SCHEMA = "source string, target string, tracked_at timestamp_ntz, row_count bigint"


def track_collection(df: DataFrame, source: str, target: str, as_of: str, path: str) -> None:
    """Append one record about a collected table."""
    row = df.agg(F.lit(source).alias("source"), F.lit(target).alias("target"), F.lit(as_of).cast("timestamp_ntz").alias("tracked_at"),
                 F.count("*").alias("row_count"))
    row.write.mode("append").parquet(path)


def lineage_of(records: DataFrame, name: str) -> DataFrame:
    return records.filter((F.col("source") == name) | (F.col("target") == name))
