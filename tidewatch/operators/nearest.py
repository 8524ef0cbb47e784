"""Imputation from the nearest rows over many numeric columns, exact at any size.

The distance of two rows is sqrt(D / m * sum of squared differences) over the m of D columns
that both have; rows without a common column are no neighbours. For each pattern of columns
that some incomplete rows have, the rows that can fill them are seen only in the columns they share with it:
of rows that are equal there, no more than the k smallest ids are kept, and the others are sorted along a z-order of
these columns' quantile ranks and packed into chunks of near rows with the least and greatest value of
each column. The distance of two boxes is a bound for their rows, so incomplete rows meet the few blocks nearest to
theirs first; after that a row meets every block whose bound is within the distance of its
farthest neighbour so far, and no other. What each meeting finds is cut to k rows before it is
merged. The block bounds go to all tasks; their number is at most about ``MOST_BLOCKS``, and larger
tables have more chunks to a block. Rows are copied once for each pattern of columns that they can fill.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.session import materialise

#: Rows of a chunk, which meets another as a whole; incomplete rows lie less dense, so their chunks have fewer.
CHUNK = 1024
TARGET_SHARE = 8
#: Chunks that one task packs.
TASK_CHUNKS = 64
MOST_BLOCKS = 65536
#: Blocks that rows meet before they have bounds.
FIRST_BLOCKS = 2
#: Quantile ranks of a column in the z-order by their binary logarithm.
CUT_BITS = 10

CHUNKS = "view long, block long, chunk long, mask long, n int, ids binary, rows binary, lo array<double>, hi array<double>"
FOUND = "chunk long, at int, id long, col int, distance double, other long, value double"
SCHEMA = pa.schema([("view", pa.int64()), ("block", pa.int64()), ("chunk", pa.int64()), ("mask", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()),
                    ("rows", pa.binary()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64()))])
#: The view of the incomplete rows themselves, which is no pattern of columns.
TARGETS = 0


def matrix(columns: Sequence[pa.Array]) -> np.ndarray:
    """Rows of doubles, an absent value as nan."""
    return np.column_stack([np.array(c.to_numpy(zero_copy_only=False), float) for c in columns])


def z_place(table: np.ndarray, shared: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Interleaved bits of the quantile ranks of the columns that ``shared`` names for each row (a bit each)."""
    width = len(cuts)
    ranks = [np.where(np.isnan(table[:, i]), 0, np.searchsorted(cuts[i], table[:, i])).astype(np.int64) for i in range(width)]
    out = np.zeros(len(table), np.int64)
    for mask in np.unique(shared).tolist():
        at = np.flatnonzero(shared == mask)
        place, used = np.zeros(len(at), np.int64), 0
        own = [i for i in range(width) if mask >> i & 1]
        for bit in range(CUT_BITS - 1, -1, -1):
            for i in own:
                if used < 62:  # the lowest bits of very many columns only order less well
                    place = place << 1 | ranks[i][at] >> bit & 1
                    used += 1
        out[at] = place
    return out


def viewed(df: DataFrame, columns: Sequence[str], row_id: str, k: int) -> DataFrame:
    """_view, _mask, _z, _id, values (_x) and those shared with the view (_p) of incomplete rows and of the rows that can fill each of their patterns."""
    width = len(columns)
    doubles = [F.col(c).cast("double") for c in columns]
    names, seen = [f"_x{i}" for i in range(width)], [f"_p{i}" for i in range(width)]
    rows = df.select(F.col(row_id).cast("bigint").alias("_id"), *[F.when(~F.isnan(x), x).alias(n) for x, n in zip(doubles, names)])
    mask = sum((F.when(F.col(x).isNotNull(), 1 << i).otherwise(0) for i, x in enumerate(names)), F.lit(0)).cast("bigint")
    rows = rows.withColumn("_mask", mask)
    probs = [i / (1 << CUT_BITS) for i in range(1, 1 << CUT_BITS)]
    row = rows.agg(F.collect_set("_mask").alias("masks"), *[F.percentile_approx(c, probs, 10 << CUT_BITS).alias(c) for c in names]).first()
    cuts = [np.array(row[c] or [], float) for c in names]
    full = (1 << width) - 1
    targets = np.array(sorted(m for m in row["masks"] if m not in (0, full)), np.int64)
    kinds = [("_view", pa.int64()), ("_mask", pa.int64()), ("_z", pa.int64()), ("_id", pa.int64()), *((n, pa.float64()) for n in (*names, *seen))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask, ids = (np.array(batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False), np.int64) for c in ("_mask", "_id"))
            table = matrix([batch.column(batch.schema.get_field_index(c)) for c in names])
            for view in (TARGETS, *targets.tolist()):
                at = np.flatnonzero(np.isin(mask, targets) if view == TARGETS else (mask & view != 0) & (mask & ~view != 0))
                common = mask[at] if view == TARGETS else mask[at] & view
                shared = np.where(common[:, None] >> np.arange(width) & 1, table[at], np.nan)
                made = [np.full(len(at), view), mask[at], z_place(shared, common, cuts), ids[at], *table[at].T, *shared.T]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x), t, from_pandas=t == pa.float64()) for x, (_, t) in zip(made, kinds)], names=[n for n, _ in kinds])

    every = rows.mapInArrow(run, ", ".join(f"{n} {'double' if t == pa.float64() else 'bigint'}" for n, t in kinds))
    # Rows that a view cannot tell apart have one distance to each row it serves, where the smaller ids go first.
    same = Window.partitionBy("_view", "_mask", "_z", *seen).orderBy("_id")
    donors = every.where(F.col("_view") != TARGETS).withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k).drop("_n")
    return every.where(F.col("_view") == TARGETS).unionByName(donors)


def packed(df: DataFrame, columns: Sequence[str], row_id: str, k: int = 5) -> DataFrame:
    """``CHUNKS``: rows of one view with the same columns, near each other, by id; written once."""
    width = len(columns)
    names, seen = [f"_x{i}" for i in range(width)], [f"_p{i}" for i in range(width)]
    rows = materialise(viewed(df, columns, row_id, k))
    total = rows.count()
    parts = max(1, math.ceil(total / CHUNK / TASK_CHUNKS))
    per = max(1, math.ceil(total / CHUNK / MOST_BLOCKS))
    order = ["_view", "_mask", "_z", *seen, "_id"]
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ordered = ordered.select(F.spark_partition_id().cast("bigint").alias("_part"), "_view", "_mask", "_id", *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        key, waiting, number, run_at = None, 0, 0, 0  # run_at: the first chunk of the rows that have the same columns

        def chunks(least: int):
            """Chunks of the held rows while ``least`` or more are left."""
            nonlocal held, waiting, number
            part, view, mask = key
            size = CHUNK if view != TARGETS else max(1, CHUNK // TARGET_SHARE)
            if waiting < max(least, 1):
                return
            ids, table = (np.concatenate([h[j] for h in held]) for j in (0, 1))
            low = 0
            while len(ids) - low >= (size if least else 1):
                some, values = ids[low:low + size], table[low:low + size]
                by_id = np.argsort(some, kind="stable")
                lo, hi = (np.where(mask >> np.arange(width) & 1, edge, 0.0) for edge in (np.min(values, axis=0), np.max(values, axis=0)))
                made = {"view": view, "block": (part << 32) + run_at + (number - run_at) // per * per, "chunk": (part << 32) + number, "mask": mask, "n": len(some),
                        "ids": some[by_id].tobytes(), "rows": values[by_id].tobytes(), "lo": lo.tolist(), "hi": hi.tolist()}
                number, low = number + 1, low + size
                yield pa.RecordBatch.from_pylist([made], schema=SCHEMA)
            held, waiting = [(ids[low:], table[low:])], len(ids) - low

        for batch in batches:
            part, view, mask, ids = (np.array(batch.column(i).to_numpy(zero_copy_only=False), np.int64) for i in range(4))
            table = matrix([batch.column(i) for i in range(4, 4 + width)])
            cuts = np.flatnonzero((view[1:] != view[:-1]) | (mask[1:] != mask[:-1])) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):
                if low == high:
                    continue
                own = int(part[low]), int(view[low]), int(mask[low])
                if key is not None and own != key:
                    yield from chunks(0)
                    held, waiting, run_at = [], 0, number
                key = own
                held.append((ids[low:high], table[low:high]))
                waiting += high - low
                yield from chunks(CHUNK if own[1] != TARGETS else max(1, CHUNK // TARGET_SHARE))
        if key is not None:
            yield from chunks(0)

    return materialise(ordered.mapInArrow(run, CHUNKS))


class Bounds:
    """The boxes of all blocks: about ``MOST_BLOCKS`` at most, one more for each task and for each view and pattern of columns."""

    def __init__(self, chunks: DataFrame, width: int):
        edge = lambda f, c: F.array(*[f(F.col(c)[i]) for i in range(width)])
        got = chunks.groupBy("block").agg(F.first("view").alias("view"), F.first("mask").alias("mask"), F.sum("n").alias("n"), edge(F.min, "lo").alias("lo"), edge(F.max, "hi").alias("hi")) \
            .orderBy("block").collect()
        self.width = width
        self.block = np.array([r.block for r in got], np.int64)
        self.view, self.mask, self.n = (np.array([r[c] for r in got], np.int64) for c in ("view", "mask", "n"))
        self.lo, self.hi = (np.array([r[c] for r in got], float).reshape(-1, width) for c in ("lo", "hi"))

    def of(self, mask: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least squared distance of a row in the box to one of each block that serves ``mask``; infinite for others and without a common column."""
        out = np.full(len(self.block), np.inf)
        at = np.flatnonzero(self.view == mask)
        out[at] = gaps(mask & self.mask[at], lo, hi, self.lo[at], self.hi[at])
        return out

    def first(self, mask: int, least: np.ndarray, k: int) -> np.ndarray:
        """The nearest blocks that have ``k`` rows or more for each missing column, ``FIRST_BLOCKS`` at least."""
        chosen = np.zeros(len(self.block), bool)
        order = np.argsort(least, kind="stable")
        for i in missing(mask, self.width):
            able = order[(self.mask[order] >> i & 1).astype(bool) & np.isfinite(least[order])]
            enough = np.searchsorted(np.cumsum(self.n[able]), k) + 1
            chosen[able[:max(enough, FIRST_BLOCKS)]] = True
        return chosen

    def within(self, mask: int, least: np.ndarray, reach: Sequence[float]) -> np.ndarray:
        """The blocks that may hold a row as near as ``reach`` for some missing column."""
        chosen = np.zeros(len(self.block), bool)
        for i in missing(mask, self.width):
            chosen |= (self.mask >> i & 1).astype(bool) & (least <= reach[i]) & np.isfinite(least)
        return chosen


def gaps(common: np.ndarray, lo: np.ndarray, hi: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least squared distance of rows in two boxes, of many pairs at once; infinite without a common column."""
    total, shared = np.zeros(len(low)), np.zeros(len(low))
    for i in range(low.shape[1]):
        both = (common >> i & 1).astype(bool)
        gap = np.maximum(np.maximum(low[:, i] - hi[..., i], lo[..., i] - high[:, i]), 0.0)
        total += np.where(both, gap * gap, 0.0)
        shared += both
    return np.where(shared > 0, total * low.shape[1] / np.maximum(shared, 1), np.inf)


def missing(mask: int, width: int) -> list[int]:
    return [i for i in range(width) if not mask >> i & 1]


def nearest(target: dict, donor: dict, width: int, k: int) -> dict[str, np.ndarray]:
    """The ``k`` nearest rows of one chunk to each row of another, for each column that only the first lacks; ties to smaller ids.

    With ``limits`` (for each row of the first and column) only rows as near as that, and only rows that the other chunk's box lets come as near are compared.
    """
    ids, rows = (np.frombuffer(target["ids"], np.int64), np.frombuffer(target["rows"]).reshape(-1, width))
    others, table = (np.frombuffer(donor["ids"], np.int64), np.frombuffer(donor["rows"]).reshape(-1, width))
    common = target["mask"] & donor["mask"]
    wanted = [i for i in missing(target["mask"], width) if donor["mask"] >> i & 1]
    limits = np.frombuffer(target["limits"]).reshape(-1, width) if target["limits"] else np.full(rows.shape, np.inf)
    lo, hi = np.array(donor["lo"], float), np.array(donor["hi"], float)
    least = gaps(np.full(len(ids), common), rows, rows, np.tile(lo, (len(ids), 1)), np.tile(hi, (len(ids), 1)))
    places = np.flatnonzero(~(least > limits[:, wanted].max(axis=1)))
    ids, rows, limits = ids[places], rows[places], limits[places]
    distance = np.zeros((len(ids), len(others)))
    for i in range(width):
        if common >> i & 1:
            gap = rows[:, i, None] - table[None, :, i]
            distance += gap * gap
    distance = distance * width / common.bit_count()
    kept = np.ones(distance.shape, bool)
    if len(others) > k and len(ids):
        limit = np.partition(distance, k - 1, axis=1)[:, k - 1:k]
        less, same = distance < limit, distance == limit
        kept = less | same & (np.cumsum(same, axis=1) <= k - less.sum(axis=1, keepdims=True))
    a, b = np.nonzero(kept)
    near = distance[a, b]
    made: dict[str, list[np.ndarray]] = {c: [np.zeros(0)] for c in ("at", "id", "col", "distance", "other", "value")}
    for i in wanted:
        held = ~(near > limits[a, i])
        x, y = a[held], b[held]
        for c, v in (("at", places[x]), ("id", ids[x]), ("col", np.full(len(x), i)), ("distance", near[held]), ("other", others[y]), ("value", table[y, i])):
            made[c].append(v)
    out = {c: np.concatenate(v[1:] or v) for c, v in made.items()}
    return {"chunk": np.full(len(out["id"]), target["chunk"]), **out}


def met(chunks: DataFrame, asks: DataFrame, width: int, k: int) -> DataFrame:
    """``FOUND``: what the rows of each asking chunk (with ``blocks`` to meet) find, cut to ``k`` a row and column in each."""
    parts, others = ["chunk", "mask", "ids", "rows", "limits"], ["mask", "ids", "rows", "lo", "hi"]
    pairs = asks.select(*[F.col(c).alias(f"t_{c}") for c in parts], F.explode("blocks").alias("block")).join(chunks.select("block", *others), "block")
    arrow = pa.schema([("chunk", pa.int64()), ("at", pa.int32()), ("id", pa.int64()), ("col", pa.int32()), ("distance", pa.float64()), ("other", pa.int64()), ("value", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for n in range(batch.num_rows):
                row = dict(zip(names, (c[n].as_py() for c in batch.columns)))
                made = nearest({c: row[f"t_{c}"] for c in parts}, {c: row[c] for c in others}, width, k)
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name].astype(f.type.to_pandas_dtype()), f.type) for f in arrow], schema=arrow)

    return pairs.mapInArrow(run, FOUND)


def cut_to(found: DataFrame, k: int, row: Sequence[str]) -> DataFrame:
    order = Window.partitionBy(*row, "col").orderBy("distance", "other")
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def asking(chunks: DataFrame, chosen, width: int) -> DataFrame:
    """The chunks with the ``blocks`` that ``chosen(mask, rows, lo, hi, limits)`` names for each; ``limits`` are those of ``far``, if given."""
    kinds = [("chunk", pa.int64()), ("mask", pa.int64()), ("ids", pa.binary()), ("rows", pa.binary()), ("limits", pa.binary()), ("blocks", pa.list_(pa.int64()))]
    bounded = "far" in chunks.columns
    schema = "chunk long, mask long, ids binary, rows binary, limits binary, blocks array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = {c: batch.column(i)[n].as_py() for i, c in enumerate(batch.schema.names)}
                limits = None
                if bounded:
                    limits = np.full((row["n"], width), np.inf)
                    for x in row["far"] or []:
                        limits[x["at"], x["col"]] = x["d"]
                rows = np.frombuffer(row["rows"]).reshape(-1, width)
                blocks = chosen(row["mask"], rows, np.array(row["lo"], float), np.array(row["hi"], float), limits)
                made = [row["chunk"], row["mask"], row["ids"], row["rows"], limits.tobytes() if bounded else None, blocks]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, (_, t) in zip(made, kinds)], names=[c for c, _ in kinds])

    return chunks.mapInArrow(run, schema)


def nearest_rows(df: DataFrame, columns: Sequence[str], row_id: str, k: int) -> DataFrame:
    """``FOUND``: for each row and column (by number) it lacks, the ``k`` nearest rows that have it, all if fewer."""
    width = len(columns)
    every = packed(df, columns, row_id, k)
    chunks, asked = every.where(F.col("view") != TARGETS), every.where(F.col("view") == TARGETS)
    tasks = max(1, math.ceil(asked.count() / TASK_CHUNKS))
    shared = df.sparkSession.sparkContext.broadcast(Bounds(chunks, width))

    def first(mask, rows, lo, hi, _):
        bounds = shared.value
        return bounds.block[bounds.first(mask, bounds.of(mask, lo, hi), k)].tolist()

    def rest(mask, rows, lo, hi, limits):
        bounds = shared.value
        least = bounds.of(mask, lo, hi)
        chosen = np.flatnonzero(bounds.within(mask, least, limits.max(axis=0)) & ~bounds.first(mask, least, k))
        reached = np.zeros(len(chosen), bool)  # by one row at least, not only by the box of all
        for row, far in zip(rows, limits):
            near = gaps(mask & bounds.mask[chosen], row, row, bounds.lo[chosen], bounds.hi[chosen])
            for i in missing(mask, width):
                reached |= (bounds.mask[chosen] >> i & 1).astype(bool) & ~(near > far[i])
        return bounds.block[chosen[reached]].tolist()

    near = materialise(cut_to(met(chunks, asking(asked.repartition(tasks, "chunk"), first, width), width, k), k, ["chunk", "at"]))
    # How far the farthest neighbour is at most; not bounded while a row has fewer than k.
    far = near.groupBy("chunk", "at", "col").agg(F.when(F.count("*") >= k, F.max("distance")).otherwise(F.lit(math.inf)).alias("d"))
    far = far.groupBy("chunk").agg(F.collect_list(F.struct("at", "col", "d")).alias("far"))
    more = met(chunks, asking(asked.join(far, "chunk", "left").repartition(tasks, "chunk"), rest, width), width, k)
    return cut_to(near.unionByName(more), k, ["id"])


def impute_nearest_all(df: DataFrame, columns: Sequence[str], row_id: str, k: int = 5) -> DataFrame:
    """Every gap in ``columns`` becomes the mean of that column over the ``k`` nearest rows that have it.

    Ties go to smaller ids. A row without neighbours (it has none of the columns) gets the column's mean; a column without
    values stays null. Rows are known by ``row_id``; a null id is filled with the mean. Not a number is a gap.
    """
    columns = list(columns)
    found = nearest_rows(df.where(F.col(row_id).isNotNull()), columns, row_id, k)
    fills = found.groupBy(F.col("id").alias(row_id)).agg(*[F.avg(F.when(F.col("col") == i, F.col("value"))).alias(f"_f{i}") for i in range(len(columns))])
    doubles = [F.col(c).cast("double") for c in columns]
    known = [F.when(~F.isnan(x), x) for x in doubles]
    means = df.agg(*[F.avg(x).alias(f"_m{i}") for i, x in enumerate(known)])
    out = df.join(fills, row_id, "left").withColumn("_m", means.select(F.struct("*")).scalar())
    return out.withColumns({c: F.coalesce(known[i], F.col(f"_f{i}"), F.col(f"_m._m{i}")) for i, c in enumerate(columns)}) \
        .drop("_m", *[f"_f{i}" for i in range(len(columns))]).select(*df.columns)
