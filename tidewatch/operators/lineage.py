"""Lineage over edge (source, target, relation), node (node_id, node_type, changed_at) and event tables."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, functions as F

from tidewatch.functions.expressions import flag, one_row
from tidewatch.session import materialise

#: Levels after which the found set is written as one table, so plans stay short.
LEVELS_PER_TABLE = 8


def reachable(edges: DataFrame, start: str, direction: str = "downstream", depth: int | None = None) -> DataFrame:
    """(node_id, depth): nodes by breadth levels, each at its smallest depth; stops when a level adds nothing.

    ``depth`` limits the levels; without it the whole reach is found, however long the chain.
    Every level is one join of the new nodes with the edges and a distinct; the
    found set is written per level, so plans stay short and cycles end.
    """
    a, b = ("source", "target") if direction == "downstream" else ("target", "source")
    step = edges.select(F.col(a).alias("node_id"), F.col(b).alias("next")).distinct()
    first = edges.sparkSession.createDataFrame([(start, 0)], "node_id string, depth int")
    found, frontier = first, first
    for level in count(1):
        if depth is not None and level > depth:
            break
        new = frontier.join(step, "node_id").select(F.col("next").alias("node_id")).distinct().join(found, "node_id", "left_anti")
        new = materialise(new.withColumn("depth", F.lit(level)))
        if new.isEmpty():
            break
        found, frontier = found.unionByName(new), new
        if level % LEVELS_PER_TABLE == 0:
            found = materialise(found)
    return found.filter("depth > 0")


def dependencies(edges: DataFrame, feature: str, transitive: bool = True) -> DataFrame:
    """What ``feature`` depends on."""
    return reachable(edges, feature, "upstream", None if transitive else 1)


def dependents(edges: DataFrame, feature: str) -> DataFrame:
    return reachable(edges, feature, "downstream", 1)


def would_cycle(edges: DataFrame, feature: str, depends_on: str) -> DataFrame:
    """One row: whether the new edge depends_on -> feature would close a cycle."""
    back = reachable(edges, feature, "downstream").filter(F.col("node_id") == depends_on)
    return back.agg(flag((F.count("*") > 0) | F.lit(feature == depends_on)).alias("would_cycle"))


def lineage(edges: DataFrame, nodes: DataFrame, feature: str, depth: int = 5) -> DataFrame:
    """(node_id, direction, depth, node_type) on both sides."""
    up = reachable(edges, feature, "upstream", depth).withColumn("direction", F.lit("upstream"))
    down = reachable(edges, feature, "downstream", depth).withColumn("direction", F.lit("downstream"))
    return up.unionByName(down).join(nodes.select("node_id", "node_type"), "node_id", "left")


def edges_within(edges: DataFrame, found: DataFrame, feature: str) -> DataFrame:
    """Edges whose both ends are in the lineage of ``feature``."""
    ids = found.select("node_id").unionByName(found.sparkSession.createDataFrame([(feature,)], "node_id string")).distinct()
    out = edges.join(ids.withColumnRenamed("node_id", "source"), "source", "left_semi")
    return out.join(ids.withColumnRenamed("node_id", "target"), "target", "left_semi").select("source", "target", "relation")


def impact(edges: DataFrame, nodes: DataFrame, feature: str, depth: int | None = 10) -> DataFrame:
    """One row: direct, indirect, pipelines, models affected and the risk (0 low, 5 medium, 20 high)."""
    found = reachable(edges, feature, "downstream", depth).join(nodes.select("node_id", "node_type"), "node_id", "left")
    row = found.agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count_if(F.col("depth") > 1).alias("indirect"),
                    F.count_if(F.col("node_type") == "pipeline").alias("pipelines"), F.count_if(F.col("node_type") == "model").alias("models"))
    total = F.col("direct") + F.col("indirect")
    return row.withColumn("risk", F.when(total > 20, "high").when(total > 5, "medium").when(total > 0, "low").otherwise("none"))


def root_cause(edges: DataFrame, nodes: DataFrame, events: DataFrame, feature: str, since: str, depth: int | None = 10) -> DataFrame:
    """(node_id, depth, changed_at, recent_events): upstream nodes changed since ``since``."""
    at = F.lit(since).cast("timestamp_ntz")
    up = reachable(edges, feature, "upstream", depth).join(nodes.filter(F.col("changed_at") >= at), "node_id")
    counts = events.filter(F.col("at") >= at).select(F.explode("nodes").alias("node_id")).groupBy("node_id").agg(F.count("*").alias("n"))
    return up.join(counts, "node_id", "left").select("node_id", "depth", "changed_at", F.coalesce("n", F.lit(0)).alias("recent_events"))


def timeline(events: DataFrame, feature: str, start: str, end: str) -> DataFrame:
    t = F.col("at")
    return events.filter(F.array_contains("nodes", feature) & (t >= F.lit(start).cast("timestamp_ntz")) & (t <= F.lit(end).cast("timestamp_ntz"))) \
        .select("event_id", "event_type", "at", "actor").orderBy("at", "event_id")


def timeline_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("events"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count_distinct("actor").alias("actors"))


def track(events: DataFrame, root: str) -> None:
    """Append lineage events and the edges they imply; events are partitioned by day for retention."""
    events.withColumn("day", F.date_format("at", "yyyy-MM-dd")).write.mode("append").partitionBy("day").parquet(f"{root}/lineage_events")
    edges = events.filter(F.size("nodes") >= 2).select(F.element_at("nodes", 1).alias("source"), F.element_at("nodes", 2).alias("target"), F.col("event_type").alias("relation"))
    edges.distinct().write.mode("append").parquet(f"{root}/lineage_edges")


def live_events(events: DataFrame, as_of: str, days: int) -> DataFrame:
    """Events young enough to keep: the day partitions of the others are skipped by the scan."""
    return events.filter(F.col("day") >= F.date_format(F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days)), "yyyy-MM-dd"))
