"""Feature tables: write, read, views, statistics, snapshots, point-in-time reads, metadata."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from tidewatch.functions.expressions import attach, flag, one_row, seconds_between
from tidewatch.functions.ordered import Slices, same_keys_join
from tidewatch.functions.quantiles import quantile_row
from tidewatch.operators.clean import numeric_columns, text_columns
from tidewatch.operators.quality import entry, unpivot
from tidewatch.operators.usage import distincts

EVENT, INGEST, HASH = "_event_timestamp", "_ingestion_timestamp", "_data_hash"
# Quality limits.
MAX_MISSING, MAX_DUPLICATES, MIN_UNIQUE, MAX_OUTLIERS = 10.0, 5.0, 2, 5.0


def prepare(df: DataFrame, as_of: str, timestamp: str | None = None) -> DataFrame:
    """Add ingestion time, event time and a hash of each row."""
    cols = df.columns
    at = F.col(timestamp).cast("timestamp_ntz") if timestamp else F.lit(as_of).cast("timestamp_ntz")
    return df.withColumns({INGEST: F.lit(as_of).cast("timestamp_ntz"), EVENT: at, HASH: F.xxhash64(*cols)})


def write_warnings(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """(column_name, warning): missing, extra and more than half null columns; an empty table is 'empty'."""
    fixed = [(c, "missing") for c in expected if c not in df.columns] + [(c, "extra") for c in df.columns if c not in expected]
    row = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(f"k{i}") for i, c in enumerate(df.columns)])
    entries = [entry(column_name=c, warning=w) for c, w in fixed]
    marks = [F.when(F.col(f"k{i}") < F.col("_n") / 2, entry(column_name=c, warning="half_null")) for i, c in enumerate(df.columns)]
    marks.append(F.when(F.col("_n") == 0, entry(column_name="*", warning="empty")))
    return row.select(F.explode(F.array_compact(F.array(*entries, *marks))).alias("e")).select("e.*")


def write(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "append") -> None:
    """Append adds files only; overwrite replaces the touched partitions."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
        if mode == "overwrite":
            writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def read(spark: SparkSession, path: str, features: Sequence[str] = (), start: str | None = None, end: str | None = None,
         where: Mapping[str, dict | object] | None = None, keys: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """Columns, event-time range and gte/lte/eq/in filters, all pushed to the scan; the event time stays."""
    df = spark.read.parquet(path)
    if start:
        df = df.filter(F.col(EVENT) >= F.lit(start).cast("timestamp_ntz"))
    if end:
        df = df.filter(F.col(EVENT) <= F.lit(end).cast("timestamp_ntz"))
    for c, rule in (where or {}).items():
        rule = rule if isinstance(rule, dict) else {"eq": rule}
        for op, v in rule.items():
            df = df.filter({"gte": lambda: F.col(c) >= v, "lte": lambda: F.col(c) <= v, "eq": lambda: F.col(c) == v, "in": lambda: F.col(c).isin(*v)}[op]())
    if features:
        df = df.select(*dict.fromkeys([*keys, *features, EVENT]))
    return df.limit(limit) if limit else df


def view(groups: Mapping[str, DataFrame], keys: Sequence[str], aggregations: Mapping[str, str] | None = None) -> DataFrame:
    """Groups joined on keys; equal column names get the group's name; optional aggregation by the keys."""
    keys, out, seen = list(keys), None, set()
    for name, df in groups.items():
        rest = [c for c in df.columns if c not in keys and not c.startswith("_")]
        df = df.select(*keys, *[F.col(c).alias(f"{name}_{c}" if c in seen else c) for c in rest])
        seen |= set(rest)
        out = df if out is None else out.join(df, keys, "inner")
    if aggregations:
        out = out.groupBy(*keys).agg(*[getattr(F, fn)(c).alias(f"{c}_{fn}") for c, fn in aggregations.items()])
    return out


def statistics(df: DataFrame) -> DataFrame:
    """(feature, count, missing, unique_count, mean, std, min, p25, p50, p75, max, outlier_percentage, mean_length)."""
    cols = [c for c in df.columns if not c.startswith("_")]
    numbers, texts = [c for c in numeric_columns(df) if c in cols], [c for c in text_columns(df) if c in cols]
    q = quantile_row(df, numbers, [0.25, 0.5, 0.75])
    marked = attach(df, q, "_q")
    def out(c):
        a, b = F.col(f"_q.{c}_p25"), F.col(f"_q.{c}_p75")
        return F.count_if((F.col(c) < a - 1.5 * (b - a)) | (F.col(c) > b + 1.5 * (b - a)))
    row = marked.agg(F.count("*").alias("_n"), *[F.count(c).alias(f"n_{c}") for c in cols],
                     *[x for c in numbers for x in (F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}"), F.min(c).alias(f"a_{c}"), F.max(c).alias(f"b_{c}"), out(c).alias(f"o_{c}"))],
                     *[F.avg(F.length(c)).alias(f"l_{c}") for c in texts])
    row = one_row(row, q, distincts(df, [], {c: f"u_{c}" for c in cols}))
    none = F.lit(None).cast("double")
    num = lambda c, x: F.col(x).cast("double") if c in numbers else none
    return unpivot(row, [entry(feature=c, count=F.col(f"n_{c}"), missing=F.col("_n") - F.col(f"n_{c}"), unique_count=F.col(f"u_{c}"), mean=num(c, f"m_{c}"), std=num(c, f"s_{c}"),
                               min=num(c, f"a_{c}"), p25=num(c, f"{c}_p25"), p50=num(c, f"{c}_p50"), p75=num(c, f"{c}_p75"), max=num(c, f"b_{c}"),
                               outlier_percentage=(F.col(f"o_{c}") / F.col(f"n_{c}") * 100) if c in numbers else none, mean_length=F.col(f"l_{c}") if c in texts else none) for c in cols])


def quality(df: DataFrame) -> DataFrame:
    """(feature, rule, value, passed): missing, unique and outlier rules per feature; duplicates of the table."""
    s = statistics(df)
    rows = s.select("feature", F.explode(F.array(
        entry(rule="missing", value=F.col("missing") / (F.col("count") + F.col("missing")) * 100, passed=flag(F.col("missing") / (F.col("count") + F.col("missing")) * 100 <= MAX_MISSING)),
        entry(rule="unique", value=F.col("unique_count").cast("double"), passed=flag(F.col("unique_count") >= MIN_UNIQUE)),
        entry(rule="outliers", value=F.coalesce("outlier_percentage", F.lit(0.0)), passed=flag(F.coalesce("outlier_percentage", F.lit(0.0)) <= MAX_OUTLIERS)))).alias("r")).select("feature", "r.*")
    cols = [c for c in df.columns if not c.startswith("_")]
    copies = df.groupBy(*cols).agg(F.count("*").alias("n")).agg(((F.sum("n") - F.count("*")) / F.sum("n") * 100).alias("value"))
    return rows.unionByName(copies.select(F.lit("*").alias("feature"), F.lit("duplicates").alias("rule"), "value", flag(F.col("value") <= MAX_DUPLICATES).alias("passed")))


def table_hash(df: DataFrame) -> Column:
    """Order-free hash of all rows, as an aggregate."""
    return F.bit_xor(F.xxhash64(*df.columns))


def snapshot(df: DataFrame, root: str, name: str, as_of: str) -> DataFrame:
    """Write a copy with its hash; returns the one-row record."""
    path = f"{root}/snapshots/{name}_{uuid.uuid4().hex[:8]}"
    df.write.mode("errorifexists").parquet(path)
    copy = df.sparkSession.read.schema(df.schema).parquet(path)
    return copy.agg(F.lit(name).alias("snapshot_name"), F.lit(as_of).cast("timestamp_ntz").alias("created_at"), F.count("*").alias("row_count"),
                    table_hash(copy).alias("data_hash"), F.lit(path).alias("path"))


def expired(df: DataFrame, as_of: str, days: int, time: str = EVENT) -> DataFrame:
    """Dry run of the retention: (event_date, rows) that would go."""
    limit = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return df.filter(F.col(time) < limit).groupBy(F.date_trunc("day", time).cast("timestamp_ntz").alias("event_date")).agg(F.count("*").alias("rows"))


def retained(df: DataFrame, as_of: str, days: int, time: str = EVENT) -> DataFrame:
    return df.filter(F.col(time) >= F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days)))


def offline(df: DataFrame, ids: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """Rows of the wanted entities in a time range."""
    at = F.col(EVENT)
    return df.filter((at >= F.lit(start).cast("timestamp_ntz")) & (at <= F.lit(end).cast("timestamp_ntz"))).join(ids.select(entity).distinct(), entity, "left_semi")


def as_of_join(spine: DataFrame, features: DataFrame, entity: str, spine_time: str, columns: Sequence[str], tie: str) -> DataFrame:
    """Latest feature row at or before each spine row's time, per entity.

    Both sides are stacked in one sorted order and the last feature row is carried
    forward: one shuffle, no pair of rows is ever formed, and a hot entity is cut in ranges.
    """
    columns = list(columns)
    value = F.struct(F.col(EVENT).alias("at"), *[F.col(c) for c in columns])
    left = features.filter(F.col(EVENT).isNotNull()).select(F.col(entity), F.col(EVENT).alias("_t"), F.lit(0).alias("_side"), F.col(tie).cast("string").alias("_tie"), value.alias("_f"),
                                                            F.lit(None).cast(spine.select(F.struct("*").alias("r")).schema["r"].dataType).alias("_spine"))
    right = spine.select(F.col(entity), F.col(spine_time).cast("timestamp_ntz").alias("_t"), F.lit(1).alias("_side"), F.xxhash64(*spine.columns).cast("string").alias("_tie"),
                         F.lit(None).cast(left.schema["_f"].dataType).alias("_f"), F.struct("*").alias("_spine"))
    slices = Slices(left.unionByName(right), [entity], ["_t", "_side", "_tie"])
    rows = slices.done(slices.filled(slices.df, {"_last": F.col("_f")})).filter("_side = 1")
    return rows.select("_spine.*", F.col("_last.at").alias("feature_time"), *[F.col(f"_last.{c}").alias(c) for c in columns])


def point_in_time(df: DataFrame, entity: str, at: str, columns: Sequence[str], tie: str) -> DataFrame:
    """Latest row per entity at or before one time."""
    rows = df.filter(F.col(EVENT) <= F.lit(at).cast("timestamp_ntz"))
    return rows.groupBy(entity).agg(F.max_by(F.struct(EVENT, *columns), F.struct(EVENT, tie)).alias("r")).select(entity, "r.*")


def latest(df: DataFrame, entity: str, columns: Sequence[str], tie: str) -> DataFrame:
    """The online table: newest vector per entity."""
    return df.groupBy(entity).agg(F.max_by(F.struct(EVENT, *columns), F.struct(EVENT, tie)).alias("r")).select(entity, "r.*")


def freshness(df: DataFrame, expected: Sequence[str], as_of: str, max_minutes: float) -> DataFrame:
    """(feature, last_seen, age_minutes, status): fresh, stale or missing per expected feature."""
    have = [c for c in expected if c in df.columns]
    row = df.agg(*[F.max(F.when(F.col(c).isNotNull(), F.col(EVENT))).alias(c) for c in have], F.lit(1).alias("_one"))
    none = F.lit(None).cast("timestamp_ntz")
    rows = unpivot(row, [entry(feature=c, last_seen=F.col(c) if c in have else none) for c in expected])
    age = seconds_between(F.col("last_seen"), F.lit(as_of).cast("timestamp_ntz")) / 60
    return rows.withColumns({"age_minutes": age, "status": F.when(age.isNull(), "missing").when(age <= max_minutes, "fresh").otherwise("stale")})


def search_metadata(meta: DataFrame, group: str | None = None, status: str | None = None, tags: Sequence[str] = (), text: str | None = None, limit: int = 100) -> DataFrame:
    """Features by group, status, any tag, and text in name or description; a page of ``limit`` by name."""
    if group:
        meta = meta.filter(F.col("feature_group") == group)
    if status:
        meta = meta.filter(F.col("status") == status)
    if tags:
        meta = meta.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    if text:
        meta = meta.filter(F.contains(F.lower("name"), F.lit(text.lower())) | F.contains(F.lower("description"), F.lit(text.lower())))
    return meta.orderBy("name").limit(limit)
