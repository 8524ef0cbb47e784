"""Register named queries together with the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.functions.expressions import rounded
from tidewatch.sources import tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}

VIEWS = {
    "qlog": tables.QUERY_LOG_SQL, "facts": tables.COST_FACTS_SQL, "points": tables.METRIC_POINTS_SQL,
    "dirty": tables.DIRTY_LOG_SQL, "qhist": tables.QUERY_HISTORY_SQL, "metering": tables.METERING_SQL,
    "loads": tables.LOAD_SQL, "wlog": tables.WIDE_LOG_SQL, "logins": tables.LOGIN_SQL, "storage": tables.STORAGE_SQL,
}


#: Digits that settle half-way values before the last rounding.
SETTLED = 10


def query(name: str, sql: str | None = None, digits: int = 6, settled: bool = False):
    """Register a query; doubles are rounded so both engines compare equal.

    ``settled`` is for sums whose last bits depend on the order of addition: both sides round
    to ``SETTLED`` digits first, so that a half-way value is the same number before it is rounded.

    ``sql`` may use the names in ``VIEWS``.
    """
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            made = fn(spark, folder)
            return rounded(rounded(made, SETTLED) if settled else made, digits)

        QUERIES[name] = run
        if sql is not None:
            text = with_views(sql)
            CHECKS[name] = text.replace("round(", "round(round(").replace(f",{digits})", f",{SETTLED}),{digits})") if settled else text
        return fn
    return register


def with_views(sql: str) -> str:
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    text = sql.strip()
    if not used:
        return text
    views = ",\n".join(f"{v} as ({VIEWS[v].strip()})" for v in used)
    if text.lower().startswith("with recursive "):
        return f"with recursive {views},\n{text[15:]}"
    if text.lower().startswith("with "):
        return f"with {views},\n{text[5:]}"
    return f"with {views}\n{text}"
