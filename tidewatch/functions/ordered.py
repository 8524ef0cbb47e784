"""Ordered row operators that stay parallel when one key holds most of the rows.

A plain ``Window.partitionBy(key).orderBy(ts)`` sends a whole key to one task.
``Slices`` sorts rows by (keys, order) over the cluster and cuts that sort into
ranges of near equal size, so a hot key covers many ranges and a small key sits
inside one.  Window functions run per (range, key); what a range needs from the
ranges before it (a running total, the last row, the last non-null value) comes
from a carry table with one row per range for the few keys that cross a cut.

Inputs that are small by the size check skip the cut and use a plain window.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window, WindowSpec

from tidewatch.session import input_bytes, is_small, materialise

SLICE = "_slice"
ROWS_PER_FRAME_BLOCK = 100_000
#: Input bytes of a range, at most, where the size of the input is known. Rows of columnar files take many times as much
#: in memory, with what windows add to them, and a task sorts them twice for a fold from either side.
BYTES_PER_SLICE = 8 * 1024 * 1024
#: Spark reports the largest long for relations whose size it does not know.
UNKNOWN_BYTES = 2 ** 60


def slice_count(df: DataFrame) -> int:
    """Ranges to cut: the session's shuffle partitions, or more if the input is large."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = input_bytes(df)
    return max(least, math.ceil(size / BYTES_PER_SLICE)) if size < UNKNOWN_BYTES else least


FOLDS = {"sum": F.sum, "min": F.min, "max": F.max}


def joined(kind: str, a: Column, b: Column) -> Column:
    """Two folds in one; either may be null."""
    return F.coalesce(a + b, a, b) if kind == "sum" else (F.least if kind == "min" else F.greatest)(a, b)


class Slices:
    """One sorted, range-cut copy of a table; ``order`` must end in a tie-break."""

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], slices: int | None = None):
        self.keys, self.order = list(keys), list(order)
        self.cut = not is_small(df)
        self.count = (slices or slice_count(df)) if self.cut else 1
        if self.cut:
            self.df = materialise(
                df.repartitionByRange(self.count, *self.keys, *self.order)
                .withColumn(SLICE, F.spark_partition_id())
            )
        else:
            self.df = df.withColumn(SLICE, F.lit(0))

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(SLICE, *self.keys).orderBy(*self.order)

    def _dealt(self, df: DataFrame) -> DataFrame:
        """``df`` by range and key to as many tasks as there are ranges, where it is the table itself: a fixed number, because
        tasks that are merged by their compressed size hold many ranges."""
        return df.repartition(self.count, SLICE, *self.keys) if self.cut and df is self.df else df

    def _crossing(self, df: DataFrame) -> DataFrame:
        """Rows of ``df`` whose key is first or last in some range: no other key can cross a cut."""
        if not self.keys:
            return df
        key = F.struct(*self.keys)
        edges = self.df.groupBy(SLICE).agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
        # Two keys per range at most, so the broadcast is bounded by the number of ranges.
        edges = edges.select(F.explode(F.array("lo", "hi")).alias("k")).select("k.*").distinct()
        return same_keys_join(df, F.broadcast(edges), self.keys, "left_semi")

    def _with_carry(self, df: DataFrame, carry: DataFrame, names: list[str]) -> DataFrame:
        """Attach per-(range, key) carries; one row per range and crossing key."""
        return same_keys_join(df, F.broadcast(carry.select(SLICE, *self.keys, *names)),
                              [SLICE, *self.keys], "left")

    def folded(self, df: DataFrame, folds: Mapping[str, tuple[Column, str]], back: bool = False) -> DataFrame:
        """Running sum, min or max (``{name: (value, kind)}``) from the key's first row to each row, or from its last row ``back``
        to it; exact over all ranges, null before the first value."""
        inputs = {f"_in_{name}": value for name, (value, _) in folds.items()}
        dealt = self._dealt(df).withColumns(inputs)
        df = df.withColumns(inputs)
        order = [F.desc(c) for c in self.order] if back else self.order
        frame = Window.partitionBy(SLICE, *self.keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        out = {name: FOLDS[kind](f"_in_{name}").over(frame) for name, (_, kind) in folds.items()}
        if not self.cut:
            return df.withColumns(out).drop(*inputs)
        totals = self._crossing(df).groupBy(SLICE, *self.keys).agg(
            *[FOLDS[kind](f"_in_{name}").alias(f"_in_{name}") for name, (_, kind) in folds.items()])
        before = Window.partitionBy(*self.keys).orderBy(F.desc(SLICE) if back else SLICE).rowsBetween(Window.unboundedPreceding, -1)
        carry = totals.withColumns({f"_off_{n}": FOLDS[kind](f"_in_{n}").over(before) for n, (_, kind) in folds.items()})
        offsets = [f"_off_{n}" for n in folds]
        df = self._with_carry(dealt, carry, offsets)
        return df.withColumns({n: joined(kind, out[n], F.col(f"_off_{n}")) for n, (_, kind) in folds.items()}).drop(*inputs, *offsets)

    def running(self, df: DataFrame, sums: Mapping[str, Column]) -> DataFrame:
        """Running sums up to and including each row, 0 before the first value."""
        df = self.folded(df, {name: (value, "sum") for name, value in sums.items()})
        return df.withColumns({name: F.coalesce(name, F.lit(0)) for name in sums})

    def numbered(self, df: DataFrame, name: str = "_pos") -> DataFrame:
        """Row number within the key, from 1."""
        return self.running(df, {name: F.lit(1).cast("bigint")})

    def previous(self, df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
        """Values of the row before, across cuts: ``{new name: column}``."""
        out = {name: F.lag(col).over(self.window) for name, col in columns.items()}
        if not self.cut:
            return df.withColumns(out)
        sources = list(dict.fromkeys(columns.values()))
        last = self._crossing(df).groupBy(SLICE, *self.keys).agg(
            F.max_by(F.struct(*sources), F.struct(*self.order)).alias("_last"))
        carry = last.withColumn(
            "_prev", F.lag("_last").over(Window.partitionBy(*self.keys).orderBy(SLICE)))
        df = self._with_carry(df, carry, ["_prev"])
        first = F.row_number().over(self.window) == 1
        out = {name: F.when(first, F.col(f"_prev.{col}")).otherwise(F.lag(col).over(self.window))
               for name, col in columns.items()}
        return df.withColumns(out).drop("_prev")

    def filled(self, df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
        """Last non-null value up to and including each row: ``{new name: value}``."""
        inputs = {f"_in_{name}": value for name, value in columns.items()}
        df = df.withColumns(inputs)
        frame = self.window.rowsBetween(Window.unboundedPreceding, 0)
        out = {n: F.last(f"_in_{n}", ignorenulls=True).over(frame) for n in columns}
        if not self.cut:
            return df.withColumns(out).drop(*inputs)
        at = F.struct(*self.order)
        last = self._crossing(df).groupBy(SLICE, *self.keys).agg(*[
            F.max_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), at)).alias(f"_in_{n}")
            for n in columns])
        before = Window.partitionBy(*self.keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
        carry = last.withColumns({f"_off_{n}": F.last(f"_in_{n}", ignorenulls=True).over(before)
                                  for n in columns})
        offsets = [f"_off_{n}" for n in columns]
        df = self._with_carry(df, carry, offsets)
        out = {n: F.coalesce(out[n], F.col(f"_off_{n}")) for n in columns}
        return df.withColumns(out).drop(*inputs, *offsets)

    def filled_back(self, df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
        """First non-null value at or after each row: ``{new name: value}``."""
        inputs = {f"_in_{name}": value for name, value in columns.items()}
        df = df.withColumns(inputs)
        # Walk the range backwards: a frame that only grows is linear, one that shrinks is not.
        back = Window.partitionBy(SLICE, *self.keys).orderBy(*[F.desc(c) for c in self.order])
        frame = back.rowsBetween(Window.unboundedPreceding, 0)
        out = {n: F.last(f"_in_{n}", ignorenulls=True).over(frame) for n in columns}
        if not self.cut:
            return df.withColumns(out).drop(*inputs)
        at = F.struct(*self.order)
        first = self._crossing(df).groupBy(SLICE, *self.keys).agg(*[
            F.min_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), at)).alias(f"_in_{n}") for n in columns])
        later = Window.partitionBy(*self.keys).orderBy(F.desc(SLICE)).rowsBetween(Window.unboundedPreceding, -1)
        carry = first.withColumns({f"_off_{n}": F.last(f"_in_{n}", ignorenulls=True).over(later) for n in columns})
        offsets = [f"_off_{n}" for n in columns]
        df = self._with_carry(df, carry, offsets)
        out = {n: F.coalesce(out[n], F.col(f"_off_{n}")) for n in columns}
        return df.withColumns(out).drop(*inputs, *offsets)

    def done(self, df: DataFrame) -> DataFrame:
        return df.drop(SLICE)


class RowFrames:
    """Windows over a bounded number of rows before and after each row.

    Rows get their exact number within the key and are grouped in blocks of a
    fixed number of rows.  The last ``before`` rows of a block are copied to the
    next block and the first ``after`` rows to the one before, so a frame never
    leaves its block and a hot key is many blocks.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], before: int, after: int = 0,
                 block: int | None = None):
        self.keys = list(keys)
        slices = Slices(df, keys, order)
        df = slices.done(slices.numbered(slices.df))
        if slices.cut or block:
            size = max(block or ROWS_PER_FRAME_BLOCK, before, after, 1)
            home = F.floor((F.col("_pos") - 1) / size)
            place = (F.col("_pos") - 1) % size
            targets = F.array_compact(F.array(
                home,
                F.when(place >= size - before, home + 1),
                F.when((place < after) & (home > 0), home - 1)))
            df = (df.withColumn("_home", home).withColumn("_block", F.explode(targets)))
            if slices.cut:
                df = df.repartition(slices.count, *self.keys, "_block")
        else:
            df = df.withColumns({"_home": F.lit(0), "_block": F.lit(0)})
        self.df = df

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, "_block").orderBy("_pos")

    def rows(self, start: int, end: int = 0) -> WindowSpec:
        return self.window.rowsBetween(start, end)

    def done(self, df: DataFrame) -> DataFrame:
        return df.filter(F.col("_home") == F.col("_block")).drop("_home", "_block", "_pos")


class TimeFrames:
    """Windows over a bounded time span before each row: ``(t - span, t]`` or ``[t - span, t]``.

    Time is cut into buckets as long as the longest span and every row is also
    copied to the bucket after its own, so a task holds at most two spans of one key: for keys
    whose spans are known to hold few rows.  ``spans`` and ``order_spans`` have no such limit.
    """

    def __init__(self, df: DataFrame, keys: list[str], ts: str, span_seconds: int):
        self.keys = list(keys)
        self.micros = F.unix_micros(F.col(ts).cast("timestamp"))
        bucket = F.floor(self.micros / (span_seconds * 1_000_000))
        self.df = (df.withColumns({"_us": self.micros, "_home": bucket})
                   .withColumn("_bucket", F.explode(F.array(F.col("_home"), F.col("_home") + 1))))

    def span(self, seconds: int, closed: bool = False) -> WindowSpec:
        """``closed`` also takes a row exactly ``seconds`` earlier."""
        start = -(seconds * 1_000_000) + (0 if closed else 1)
        return (Window.partitionBy(*self.keys, "_bucket").orderBy("_us").rangeBetween(start, 0))

    def done(self, df: DataFrame) -> DataFrame:
        return df.filter(F.col("_home") == F.col("_bucket")).drop("_home", "_bucket", "_us")


def per_key(df: DataFrame) -> DataFrame:
    """Values per key of a large table, written: their size is known then, so that few are broadcast and no key's rows go to one task."""
    return df if is_small(df) else materialise(df)


def same_keys_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join on ``keys`` where null equals null; keeps the left key columns."""
    if not keys:
        raise ValueError("no join keys")
    names = {k: f"_r_{k}" for k in keys}
    right = right.withColumnsRenamed(names)
    condition = None
    for k, r in names.items():
        part = left[k].eqNullSafe(right[r])
        condition = part if condition is None else condition & part
    out = left.join(right, condition, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*names.values())
