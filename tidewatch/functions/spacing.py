"""Greedy spacing: keep a row only when enough time has passed since the last kept row.

Which rows survive depends on the last KEPT row, so the rule is sequential per
key.  A hot key is still spread: every range of its sorted rows is summarised as
a step function "time of the last kept row on entry -> the same on exit", the
few summaries of a key are chained, and then all ranges are folded in parallel
from their known entry state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidewatch.functions.ordered import SLICE, Slices, same_keys_join

NEVER = np.iinfo(np.int64).min // 4
SMALL_BATCHES = 32


def _kept(times: np.ndarray, entry: int, gap: int) -> np.ndarray:
    """Positions kept from ``times`` (sorted) when the last kept time before them is ``entry``."""
    out, i = [], int(np.searchsorted(times, entry + gap, side="left")) if entry > NEVER else 0
    while i < len(times):
        out.append(i)
        step = int(np.searchsorted(times, times[i] + gap, side="left"))
        i = step if step > i else i + 1  # a zero gap keeps every row
    return np.asarray(out, dtype=np.int64)


def _exits(times: np.ndarray, gap: int) -> np.ndarray:
    """For each start position, the time of the last row kept from there on (pointer doubling)."""
    n = len(times)
    jump = np.maximum(np.searchsorted(times, times + gap, side="left"), np.arange(1, n + 1))
    last = np.arange(n)
    hop = np.append(jump, n)
    while True:
        follow = hop[last]
        moving = follow < n
        if not moving.any():
            return times[last]
        last = np.where(moving, follow, last)


def _summary(times: np.ndarray, gap: int) -> tuple[list[int], list[int]]:
    """Breakpoints of the step function: entry <= limit - gap leads to this exit."""
    reach = int(np.searchsorted(times, times[0] + gap, side="right")) + 1
    exits = _exits(times, gap)[:reach]
    starts = times[:reach]
    change = np.append(np.flatnonzero(np.diff(exits)), len(exits) - 1)
    return starts[change].tolist(), exits[change].tolist()


def _leave(entry: int, limits: list[int], exits: list[int], gap: int) -> int:
    at = int(np.searchsorted(np.asarray(limits), entry + gap, side="left")) if entry > NEVER else 0
    return exits[at] if at < len(exits) else entry


def spaced(df: DataFrame, keys: list[str], ts: str, tie: str, seconds: float) -> DataFrame:
    """Rows at least ``seconds`` after the row of the same key kept before; null keys are dropped."""
    gap = int(round(seconds * 1_000_000))
    df = df.dropna(subset=[*keys, ts]).withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    slices = Slices(df, keys, ["_us", tie])
    rows = slices.df
    if slices.cut:
        entries = _entries(slices, gap)
        rows = same_keys_join(rows, F.broadcast(entries), [SLICE, *keys], "left")
    else:
        rows = rows.withColumn("_entry", F.lit(None).cast("bigint"))

    # Many small keys share one call; a range is bounded, and so is a small input.
    rows = rows.withColumn("_batch", F.lit(0) if slices.cut else F.pmod(F.xxhash64(*keys), F.lit(SMALL_BATCHES)).cast("int"))

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_key=pdf.groupby(keys, sort=False).ngroup()).sort_values(["_key", "_us", tie], kind="stable")
        key, times, entries = (pdf[c].to_numpy() for c in ("_key", "_us", "_entry"))
        bounds = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        chosen = []
        for start, end in zip(bounds, np.append(bounds[1:], len(key))):
            entry = entries[start]
            chosen.append(start + _kept(times[start:end], NEVER if pd.isna(entry) else int(entry), gap))
        return pdf.iloc[np.concatenate(chosen)].drop(columns="_key")

    out = rows.groupBy(SLICE, "_batch").applyInPandas(keep, rows.schema).drop("_batch")
    return out.drop(SLICE, "_us", "_entry")


def _entries(slices: Slices, gap: int) -> DataFrame:
    """(range, key, _entry): last kept time before each range, for keys that cross a cut."""
    keys = slices.keys
    rows = slices._crossing(slices.df.select(SLICE, *keys, "_us"))
    key_schema = ", ".join(f"`{k}` {slices.df.schema[k].dataType.simpleString()}" for k in keys)

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        limits, exits = _summary(np.sort(pdf["_us"].to_numpy()), gap)
        return pd.DataFrame({SLICE: [pdf[SLICE].iloc[0]], **{k: [pdf[k].iloc[0]] for k in keys},
                             "limits": [limits], "exits": [exits]})

    steps = rows.groupBy(SLICE, *keys).applyInPandas(
        summarise, f"{SLICE} int, {key_schema}, limits array<bigint>, exits array<bigint>")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(SLICE)
        entry, found = NEVER, []
        for limits, exits in zip(pdf["limits"], pdf["exits"]):
            found.append(entry)
            entry = _leave(entry, list(limits), list(exits), gap)
        return pdf.assign(_entry=pd.array([None if e == NEVER else e for e in found], dtype="Int64"))[[SLICE, *keys, "_entry"]]

    # One short summary per range of a crossing key: bounded by the number of ranges.
    return steps.groupBy(*keys).applyInPandas(chain, f"{SLICE} int, {key_schema}, _entry bigint")
