"""Exact nearest neighbours by inner product: a block matrix join over int8 tiles.

Queries and candidates are dealt by hash into blocks of bounded size; every query block
meets every candidate block in one cell (a stated query set against all rows, in blocks).
In a cell each vector becomes int8 codes and a scale. A tile's integer products give the
inner products up to |q| e_x + e_q (|x| + e_x), with e the norm of what the codes leave
out; only pairs whose upper bound reaches the query's best lower bounds survive. These
are recomputed in double precision, component by component, and merged into a heap of
the query's best. Cells send their best few per query to a last ranking.

Equal vectors in a cell are one candidate with its smallest ids, so a vector that many
rows share costs one product. The result is exact: recall is 1 by construction.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components
take no part, nor do rows without an id; a query meets vectors of its own length only;
rows with a query's id are its own, and of several such rows the smallest vector asks; repeated rows count once; ties go to the smaller id;
with fewer candidates than wanted all are returned; empty tables give no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidewatch.llm.common import as_batch, to_arrow_schema, _schema, take

#: Numbers (rows times dimensions) of a candidate block and of a query block, and rows of a tile.
BLOCK_VALUES = 1 << 20
QUERY_VALUES = 1 << 17
TILE_ROWS = 2048
OUT = "query_id bigint, vec_id bigint, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v, dim of the rows that take part."""
    kind = dict(vectors.dtypes).get("embedding")
    rows = take(vectors, vec_id="bigint", embedding=kind if kind == "array<float>" else "array<double>")
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (rows.where(F.col("vec_id").isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0))
            .select("vec_id", v.alias("v"), F.size(v).alias("dim")))


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms, and norms of what the codes leave out (rounded up)."""
    scale = np.abs(x).max(axis=1) / 127
    scale = np.maximum(scale, np.finfo(float).tiny)
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    left = x - codes * scale[:, None]
    return codes, scale, np.sqrt((x * x).sum(axis=1)) * (1 + 1e-12), np.sqrt((left * left).sum(axis=1)) * (1 + 1e-12)


def products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows a[i] and b[j], summed from the first component on."""
    total = np.zeros(len(i))
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)):
        total += x[i] * y[j]
    return total + 0.0


def cell_best(query_ids, queries, ids, vectors, k: int) -> tuple[list, list, list]:
    """The ``k`` best candidates of every query in one cell."""
    distinct, group = np.unique(np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel(), return_inverse=True)
    x = distinct.view(vectors.dtype).reshape(len(distinct), -1).astype(np.float64)
    order = np.lexsort((ids, group))
    starts = np.searchsorted(group[order], np.arange(len(distinct)))
    ends = np.append(starts[1:], len(order))
    members = ids[order]
    # A repeated row counts once; the k best of a vector are among its k + 1 smallest ids, the query's own being one.
    owners = [np.unique(members[a:b])[: k + 1].tolist() for a, b in zip(starts.tolist(), ends.tolist())]
    q = queries.astype(np.float64)
    q_codes, q_scale, q_norm, q_left = coded(q)
    exact_in = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64
    q_codes = q_codes.astype(exact_in)
    heaps: list[list] = [[] for _ in query_ids]
    floor = np.full(len(q), -np.inf)
    for at in range(0, len(x), TILE_ROWS):
        part = x[at:at + TILE_ROWS]
        codes, scale, norm, left = coded(part)
        near = (q_codes @ codes.astype(exact_in).T).astype(np.float64)
        near *= q_scale[:, None] * scale
        slack = q_norm[:, None] * left + q_left[:, None] * (norm + left)
        slack += 1e-9 * (q_norm[:, None] * norm)
        if len(part) > k + 1:
            floor = np.maximum(floor, np.partition(near - slack, len(part) - k - 2, axis=1)[:, len(part) - k - 2])
        i, j = np.nonzero(near + slack >= floor[:, None])
        scores = products(q, part, i, j)
        cuts = np.searchsorted(i, np.arange(len(q) + 1))
        for n, own in enumerate(query_ids):
            a, b = cuts[n], cuts[n + 1]
            if a == b:
                continue
            new = [(-s, vec) for s, c in zip(scores[a:b].tolist(), j[a:b].tolist()) for vec in owners[at + c] if vec != own]
            heaps[n] = heapq.nsmallest(k, heaps[n] + new)
            if len(heaps[n]) == k:
                floor[n] = max(floor[n], -heaps[n][-1][0])
    rows = [(own, vec, -s) for own, heap in zip(query_ids, heaps) for s, vec in heap]
    return [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]


def nearest(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of every row for which ``is_query`` holds."""
    rows = usable(vectors)
    queries = rows.where(is_query).groupBy("vec_id", "dim").agg(F.min("v").alias("v"))  # of rows with one id the first vector
    # One row a vector length: how many blocks its rows and queries make.
    sizes = (rows.groupBy("dim").agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("nq")).where("nq > 0")
             .select("dim", F.ceil(F.col("n") * F.col("dim") / BLOCK_VALUES).cast("int").alias("blocks"),
                     F.ceil(F.col("nq") * F.col("dim") / QUERY_VALUES).cast("int").alias("query_blocks")))
    dealt = lambda parts: F.pmod(F.xxhash64("vec_id"), parts).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    left = queries.join(sizes, "dim").select("dim", dealt(F.col("query_blocks")).alias("a"), every("blocks").alias("b"), F.lit(True).alias("q"), "vec_id", "v")
    right = rows.join(sizes, "dim").select("dim", every("query_blocks").alias("a"), dealt(F.col("blocks")).alias("b"), F.lit(False).alias("q"), "vec_id", "v")
    arrow = to_arrow_schema(_schema(OUT))

    def cell(table: pa.Table) -> pa.Table:
        ask = table.column("q").to_numpy()
        ids = table.column("vec_id").to_numpy()
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        if ask.any() and not ask.all():
            query_ids, vec_ids, scores = cell_best(ids[ask].tolist(), flat[ask], ids[~ask], flat[~ask], k)
        else:
            query_ids, vec_ids, scores = [], [], []
        return pa.Table.from_batches([as_batch({"query_id": query_ids, "vec_id": vec_ids, "score": scores}, arrow)])

    best = left.unionByName(right).groupBy("dim", "a", "b").applyInArrow(cell, OUT)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.select("query_id", place.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
