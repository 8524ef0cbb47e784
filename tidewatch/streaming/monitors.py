"""Structured Streaming monitors: the streaming twins of the batch operators.

Sources are any stream of metric points (metric, ts, value, point_id).  Event time
carries a watermark; later rows are dropped and counted in the query progress.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewatch.operators.alerts import compare_column
from tidewatch.sources.tables import SCHEMAS

LATE = "10 minutes"


def event_points(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """The events files of a folder as a stream of metric points."""
    reader = spark.readStream.schema(SCHEMAS["events"]).option("pathGlobFilter", "events*.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    e = reader.parquet(folder)
    return e.select(F.col("event_type").alias("metric"), F.col("ts").cast("timestamp").alias("ts"), "value", F.col("event_id").alias("point_id"))


#: Metric of the row that closes a bounded stream.
CLOSING = "__closing__"


def closed(points: DataFrame, folder: str, path: str) -> DataFrame:
    """The bounded stream ``points`` and one late row after all of ``folder``'s events.

    Its time moves the watermark past every event, so that windows, sessions and waiting rows are
    all emitted; consumers drop the metric ``CLOSING``. ``path`` is a fresh scratch path.
    """
    spark = points.sparkSession
    last = spark.read.schema(SCHEMAS["events"]).option("pathGlobFilter", "events*.parquet").parquet(folder).agg(F.max("ts").cast("timestamp").alias("ts"))
    row = last.select(F.lit(CLOSING).alias("metric"), (F.col("ts") + F.expr("interval 2 days")).alias("ts"), F.lit(1e300).alias("value"), F.lit(-1).cast("bigint").alias("point_id"))
    row.where("ts is not null").write.parquet(path)
    return points.unionByName(spark.readStream.schema(row.schema).parquet(path))


def sliding_statistics(points: DataFrame, length: str = "5 minutes", slide: str = "1 minute", late: str = LATE) -> DataFrame:
    """Count, mean, extremes and latest value per metric and sliding window."""
    return points.withWatermark("ts", late).groupBy("metric", F.window("ts", length, slide)).agg(
        F.count("value").alias("points"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.max_by("value", F.struct("ts", "point_id")).alias("latest")).select("metric", F.col("window.start").alias("window_start"), "points", "mean", "min", "max", "latest")


def sessions(points: DataFrame, key: str = "metric", gap: str = "60 minutes", late: str = LATE) -> DataFrame:
    """Sessions per key: a gap of ``gap`` or more starts a new one."""
    return points.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap)).agg(F.count("*").alias("points"), F.sum("value").alias("total")) \
        .select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "points", "total")


def deduplicated(points: DataFrame, keys: list[str], late: str = LATE) -> DataFrame:
    return points.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def threshold_violations(points: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Stream-static join with the threshold table, re-read by each micro-batch."""
    return points.join(thresholds, "metric").filter(compare_column(F.col("value"), F.col("op"), F.col("limit")))


def cooled_alerts(hits: DataFrame, cooldown_seconds: float, late: str = LATE) -> DataFrame:
    """(metric, ts, value): per metric an alert only after ``cooldown`` since the last one; state is one time.

    Rows wait for the watermark, so an alert does not depend on the order of arrival within it.
    """
    gap = int(cooldown_seconds * 1_000_000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting = state.get if state.exists else (None, [])
        waiting = list(waiting)
        for pdf in batches:
            waiting += [(t.value // 1000, float(v)) for t, v in zip(pdf["ts"], pdf["value"])]
        mark = state.getCurrentWatermarkMs() * 1000
        ready = sorted(w for w in waiting if tuple(w)[0] <= mark)
        waiting = [tuple(w) for w in waiting if tuple(w)[0] > mark]
        out = []
        for at, value in ready:
            if last is None or at - last >= gap:
                out.append((key[0], pd.Timestamp(at, unit="us"), value))
                last = at
        state.update((last, waiting))
        if waiting:
            state.setTimeoutTimestamp(max(mark // 1000 + 1, -(-min(w[0] for w in waiting) // 1000)))
        yield pd.DataFrame(out, columns=["metric", "ts", "value"])

    return hits.withWatermark("ts", late).groupBy("metric").applyInPandasWithState(
        step, "metric string, ts timestamp, value double", "last bigint, waiting array<struct<at: bigint, value: double>>", "append", GroupStateTimeout.EventTimeTimeout)


def recursive_means(points: DataFrame, alpha: float = 0.1) -> DataFrame:
    """(metric, ts, value, baseline): the recursive mean, in order of arrival; state is one number."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mean = state.get[0] if state.exists else None
        for pdf in batches:
            pdf = pdf.sort_values(["ts", "point_id"])
            out = []
            for v in pdf["value"]:
                mean = v if mean is None else alpha * v + (1 - alpha) * mean
                out.append(mean)
            yield pd.DataFrame({"metric": key[0], "ts": pdf["ts"], "value": pdf["value"], "baseline": out})
        state.update((mean,))

    return points.groupBy("metric").applyInPandasWithState(step, "metric string, ts timestamp, value double, baseline double", "mean double", "append", GroupStateTimeout.NoTimeout)


def keep_latest(points: DataFrame, path: str, checkpoint: str, key: str = "metric"):
    """Writer that keeps the newest row per key in a parquet table: each batch merges into a new version."""
    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        row = F.struct(*batch.columns)
        newest = batch.groupBy(key).agg(F.max_by(row, F.struct("ts", "point_id")).alias("r")).select("r.*")
        if epoch > 0:
            newest = newest.unionByName(spark.read.parquet(f"{path}/version={epoch - 1}"))
            newest = newest.groupBy(key).agg(F.max_by(F.struct(*batch.columns), F.struct("ts", "point_id")).alias("r")).select("r.*")
        # a repeated epoch overwrites its own version, so a retry changes nothing
        newest.write.mode("overwrite").parquet(f"{path}/version={epoch}")

    return points.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process all files present and stop; append results go to parquet."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
