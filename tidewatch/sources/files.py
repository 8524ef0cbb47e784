"""File sources and sinks: parquet, csv, json."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

# Folder per kind of data.
AREAS = {"raw": "raw", "processed": "processed", "exports": "exports"}


def save_table(df: DataFrame, root: str, name: str, kind: str = "processed", created_at: str | None = None,
               compress: bool = True, partition_by: Sequence[str] = ()) -> dict:
    """Write parquet under the folder of ``kind``; returns path, rows and columns written.

    Rows are counted while they are written.
    """
    if created_at:
        df = df.withColumn("created_at", F.lit(created_at).cast("timestamp_ntz"))
    seen = Observation()
    path = f"{root}/{AREAS[kind]}/{name}"
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
    writer = writer.option("compression", "snappy" if compress else "none")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return {"path": path, "rows": seen.get["rows"], "columns": len(df.columns)}


def load_table(spark: SparkSession, root: str, name: str, kind: str = "processed",
               columns: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    """Read parquet; the filter and the column list reach the scan."""
    df = spark.read.parquet(f"{root}/{AREAS[kind]}/{name}")
    if where is not None:
        df = df.filter(where)
    return df.select(*columns) if columns else df


def read_any(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Parquet, csv or json by the extension of ``path``."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind not in ("parquet", "csv", "json"):
        raise ValueError(f"Unsupported file format: {kind}")
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        reader = reader.option("header", True)
        if schema is None:
            reader = reader.option("inferSchema", True)
    return reader.format(kind).load(path)


def save_tables(tables: Mapping[str, DataFrame], folder: str, kind: str = "parquet") -> None:
    """Write each table to ``<folder>/<name>.<kind>`` and a metadata table beside them."""
    if not tables:
        return
    spark = next(iter(tables.values())).sparkSession
    notes = []
    for name, df in tables.items():
        seen = Observation()
        writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
        if kind == "csv":
            writer = writer.option("header", True)
        writer.format(kind).save(f"{folder}/{name}.{kind}")
        notes.append((name, kind, int(seen.get["rows"]), ",".join(df.columns)))
    meta = spark.createDataFrame(notes, "table_name string, format string, row_count bigint, columns string")
    meta.coalesce(1).write.mode("overwrite").json(f"{folder}/metadata.json")
