"""Exact quantiles of a time span before each row.

Time is cut into buckets as long as the span, and every value also goes to the next bucket, so that
a bucket of a key holds all windows that end in it. Buckets are sorted by key and time, and a
task takes some whole ones at a time: a window is a stretch of that sort, and the value of a rank
within a stretch is found for all rows at once, bit by bit of the values' ranks (a wavelet matrix).
That costs the logarithm of a bucket's rows for each row, however many rows a window holds.

Buckets with more than ``MOST_ROWS`` rows walk down the digits of the values' ranks over range cuts
instead. On each level the values of one prefix enter at their time and leave a span later; running
counts by digit are the counts of the window at any time, so a row finds the digit of the
value it looks for and the rank within it, and goes on with that prefix. A hot key, a dense hour, or a
quantile that always falls on the same values is many ranges: no task holds a window. Rows and
values are sorted once a level, and there are log16 of the distinct values of a bucket levels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from tidewatch.functions.ordered import Slices, same_keys_join
from tidewatch.functions.quantiles import positions
from tidewatch.functions.spans import micros, span_folds
from tidewatch.session import materialise

#: Digits of a level by their binary logarithm.
BITS = 4
#: Values of a bucket and the one before that a task may hold.
MOST_ROWS = 1 << 20
#: Rows worked on at a time, unless one bucket has more.
BATCH_ROWS = 1 << 18


def span_quantiles(df: DataFrame, keys: Sequence[str], column: str, ts: str, seconds: int, probs: Sequence[float], method: str = "linear",
                   closed: bool = False) -> DataFrame:
    """``df`` with ``_n``, the values of ``column`` in ``(t - seconds, t]`` or ``[t - seconds, t]``, and ``_q``, an array of their quantiles.

    Rows of the same time are included; nulls are skipped; ``_q`` is null for a window without values. The methods are
    those of ``quantiles``.
    """
    keys = list(keys)
    rows = df.withColumn("_us", micros(ts))
    values = rows.select(*keys, "_us", F.col(column).cast("double").alias("_x")).where("_us is not null")
    found = _found(values, keys, seconds * 1_000_000, list(probs), method, closed)
    out = same_keys_join(rows, found.select(*keys, "_us", "_n", "_at"), [*keys, "_us"], "left")
    # _at holds the lower and the upper value of each quantile, one after the other.
    parts = []
    for i, p in enumerate(probs):
        low, high = F.col("_at")[2 * i], F.col("_at")[2 * i + 1]
        parts.append(low + (high - low) * positions(method, F.col("_n"), p)[2])
    return out.withColumns({"_n": F.coalesce("_n", F.lit(0).cast("bigint")), "_q": F.when(F.col("_n") > 0, F.array(*parts))}).drop("_us", "_at")


def _ranks(n: Column, probs: Sequence[float], method: str) -> Column:
    return F.array(*[at.cast("bigint") for p in probs for at in positions(method, n, p)[:2]])


def _places(method: str, n: np.ndarray, p: float) -> tuple[np.ndarray, np.ndarray]:
    """0-based low and high ranks, as ``positions`` has them."""
    if method == "index":
        at = np.minimum(np.floor(n * p), n - 1)
    elif method == "linear":
        at = (n - 1) * p
    else:
        at = np.minimum(np.maximum((n + 1) * p - 1, 0.0), n - 1)
    return np.floor(at).astype(np.int64), np.ceil(at).astype(np.int64)


def _found(values: DataFrame, keys: list[str], span: int, probs: Sequence[float], method: str, closed: bool) -> DataFrame:
    buckets = [*keys, "_bucket"]
    home = F.floor(F.col("_us") / span)
    both = F.explode(F.array("_home", F.col("_home") + 1)).alias("_bucket")
    plain = values.withColumns({"_home": home, "_x": F.when(~F.isnan("_x"), F.col("_x"))})
    copies = plain.select(*keys, "_us", "_x", both)
    counted = plain.groupBy(*keys, "_home").agg(F.count("*").alias("_c")).select(*keys, "_c", both)
    large = materialise(counted.groupBy(*buckets).agg(F.sum("_c").alias("_c")).where(F.col("_c") > MOST_ROWS).select(*buckets))
    if large.isEmpty():
        return _by_buckets(copies, buckets, span, probs, method, closed)
    large = F.broadcast(large)  # each stands for so many rows, so there are few
    some = _by_buckets(same_keys_join(copies, large, buckets, "left_anti"), buckets, span, probs, method, closed)
    rest = _by_digits(same_keys_join(copies, large, buckets, "left_semi"), buckets, span, probs, method, closed)
    return some.unionByName(rest.where(home == F.col("_bucket")))


def _by_buckets(copies: DataFrame, buckets: list[str], span: int, probs: Sequence[float], method: str, closed: bool) -> DataFrame:
    """Counts and picked values of every time of a bucket, whole buckets in a task."""
    fields = [copies.schema[k] for k in buckets]
    schema = StructType([*fields, StructField("_us", LongType()), StructField("_n", LongType()), StructField("_at", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, limit = [], 0, BATCH_ROWS
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= limit:
                table = pa.Table.from_batches(held)
                first = np.nonzero(_begins(table, buckets))[0][-1]  # the last bucket may go on
                if first:
                    yield from _picked(table.slice(0, first), buckets, span, probs, method, closed)
                held = table.slice(first).to_batches()
                size -= int(first)
                limit = max(BATCH_ROWS, 2 * size)
        if size:
            yield from _picked(pa.Table.from_batches(held), buckets, span, probs, method, closed)

    return copies.repartition(*buckets).sortWithinPartitions(*buckets, "_us").mapInArrow(run, schema)


def _begins(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    """Whether the names' values change before each row."""
    out = np.zeros(table.num_rows, bool)
    out[:1] = True
    for name in names:
        codes = table.column(name).combine_chunks().dictionary_encode(null_encoding="encode")
        codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
        out[1:] |= codes[1:] != codes[:-1]
    return out


def _picked(table: pa.Table, buckets: Sequence[str], span: int, probs: Sequence[float], method: str, closed: bool) -> Iterator[pa.RecordBatch]:
    """Rows of whole buckets, sorted by bucket and time, to one row for each time that belongs to its bucket."""
    group = np.cumsum(_begins(table, buckets)) - 1
    since = table.column("_us").to_numpy() - table.column("_bucket").to_numpy() * span  # below 0 in the bucket before
    x = table.column("_x").to_numpy().astype(float)  # null as nan
    times = np.unique(since)
    width = len(times) + 1
    place = group * width + np.searchsorted(times, since)
    asked = np.nonzero((since >= 0) & np.append(place[1:] != place[:-1], True))[0]
    known = x == x
    at, x, owner = place[known], x[known], group[known]
    end = np.searchsorted(at, place[asked], side="right")
    begin = np.searchsorted(at, group[asked] * width + np.searchsorted(times, since[asked] - span, side="left" if closed else "right"))
    order = np.lexsort((x, owner))
    rank = np.empty(len(x), np.int64)
    rank[order] = np.arange(len(x)) - np.searchsorted(owner, owner)
    sorted_x, base = x[order], np.searchsorted(owner, group[asked])
    levels = _levels(rank)
    n = end - begin
    some = n > 0
    picks = np.full((len(asked), 2 * len(probs)), np.nan)
    for i, p in enumerate(probs):
        low, high = _places(method, n[some], p)
        picks[some, 2 * i] = sorted_x[base[some] + _selected(levels, begin[some], end[some], low)]
        picks[some, 2 * i + 1] = picks[some, 2 * i]
        between = high > low
        to = np.nonzero(some)[0][between]
        picks[to, 2 * i + 1] = sorted_x[base[to] + _selected(levels, begin[to], end[to], high[between])]
    keys = table.select(list(buckets)).take(pa.array(asked)).combine_chunks()
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(asked) + 1, dtype=np.int32) * (2 * len(probs)), pa.int32()), pa.array(picks.ravel()))
    us = table.column("_us").to_numpy()[asked]
    yield from pa.table([*keys.columns, pa.array(us), pa.array(n), lists], names=[*buckets, "_us", "_n", "_at"]).to_batches()


def _levels(rank: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Zeros before each place on every bit of the ranks, from the highest bit, the ranks parted by the bits before."""
    out = []
    for bit in reversed(range(int(rank.max(initial=0)).bit_length())):
        zero = (rank >> bit & 1) == 0
        out.append((bit, np.concatenate([[0], np.cumsum(zero)])))
        rank = np.concatenate([rank[zero], rank[~zero]])
    return out


def _selected(levels: list[tuple[int, np.ndarray]], begin: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The rank that is the ``k``-th smallest, from 0, of each stretch."""
    found = np.zeros(len(k), np.int64)
    for bit, zeros in levels:
        a, b = zeros[begin], zeros[end]
        left = k < b - a
        found |= np.where(left, 0, 1 << bit)
        k = np.where(left, k, k - (b - a))
        begin, end = np.where(left, a, zeros[-1] + begin - a), np.where(left, b, zeros[-1] + end - b)
    return found


def _by_digits(values: DataFrame, keys: list[str], span: int, probs: Sequence[float], method: str, closed: bool) -> DataFrame:
    base = 1 << BITS
    plain = values
    counted = plain.where("_x is not null").groupBy(*keys, "_x").agg(F.lit(1).alias("_one"))
    slices = Slices(counted.drop("_one"), keys, ["_x"])
    placed = materialise(slices.done(slices.numbered(slices.df, "_d")).withColumn("_d", F.col("_d") - 1))
    most = placed.agg(F.max("_d")).first()[0]
    held = plain.where("_x is not null").groupBy(*keys, "_us", "_x").agg(F.count("*").alias("_c"))
    held = materialise(same_keys_join(held, placed, [*keys, "_x"], "inner").select(*keys, "_us", "_d", "_c"))
    sizes = span_folds(plain.select(*keys, F.timestamp_micros("_us").alias("_ts"), "_us", "_x").withColumnRenamed("_us", "_time"), keys,
                       {"_n": (F.when(F.col("_x").isNotNull(), 1).otherwise(0).cast("bigint"), "sum")}, "_ts", span // 1_000_000, closed)
    sizes = materialise(sizes.select(*keys, F.col("_time").alias("_us"), "_n").distinct())
    wanted = sizes.where("_n > 0").select(*keys, "_us", F.posexplode(_ranks(F.col("_n"), probs, method)).alias("_j", "_r")).withColumn("_p", F.lit(0).cast("bigint"))
    levels = max(1, math.ceil(max(1, (most or 0).bit_length()) / BITS))
    for level in range(levels):
        shift = BITS * (levels - 1 - level)
        step = held.select(*keys, F.shiftright("_d", shift + BITS).alias("_p"), F.shiftright("_d", shift).bitwiseAND(base - 1).alias("_digit"), "_us", "_c")
        enter = step.withColumn("_kind", F.lit(1))
        leave = step.withColumns({"_us": F.col("_us") + span, "_c": -F.col("_c"), "_kind": F.lit(3 if closed else 0)})
        stream = enter.unionByName(leave).unionByName(wanted.withColumn("_kind", F.lit(2)), allowMissingColumns=True)
        cut = Slices(stream, [*keys, "_p"], ["_us", "_kind"])
        run = cut.running(cut.df, {f"_h{d}": F.when(F.col("_digit") == d, F.col("_c")) for d in range(base)})
        digit, before, below = None, F.lit(0).cast("bigint"), []
        for d in range(base):
            upto = before + F.col(f"_h{d}")
            below.append((upto, before))
            before = upto
        for d, (upto, under) in enumerate(below):
            found = F.struct((F.col("_p") * base + d).alias("_p"), (F.col("_r") - under).alias("_r"))
            digit = F.when(F.col("_r") < upto, found) if digit is None else digit.when(F.col("_r") < upto, found)
        wanted = cut.done(run).where("_kind = 2").select(*keys, "_us", "_j", digit.alias("_s")).select(*keys, "_us", "_j", "_s._p", "_s._r")
    picked = same_keys_join(wanted.withColumnRenamed("_p", "_d"), placed, [*keys, "_d"], "inner")
    lists = picked.groupBy(*keys, "_us").agg(F.array_sort(F.collect_list(F.struct("_j", "_x"))).alias("_at"))  # two values a quantile
    return same_keys_join(sizes, lists.withColumn("_at", F.col("_at._x")), [*keys, "_us"], "left")
