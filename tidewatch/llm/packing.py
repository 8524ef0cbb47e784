"""Packing by lexical retrieval: a sharded BM25 index gives each seed its neighbours.

Every document's ids are written once, with a min-hash over its pairs of ids. The
documents are sorted over the cluster by that hash, so texts with much in common lie
together, and each task cuts its range into shards of bounded size. Document frequencies
are counted over the whole corpus; a shard has an inverted index from token id to
documents with BM25 weights. Whole windows of a long document stand by themselves; the
rests are packed: a seed opens a window, and its unused neighbours, best first, fill it;
the last is cut where the window is full, and its rest is the next seed. A window that a
shard leaves open is carried into the next shard of the task, so only one window of
a task is not full.

Hot groups of copies share a hash; the sort breaks ties by row key, so the range cut
splits them. Nothing is dropped: each id lies in exactly one piece.

Defined cases: null and empty texts are the end id alone; repeated rows are packed like
any other; a text of any length is cut into windows; a null doc_id is kept; an empty
table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.common import SLICE_ROWS, _schema, as_batch, keyed, mixed, release, take, to_arrow_schema
from tidewatch.llm.tokens import chunks
from tidewatch.session import scratch_path

WINDOW = 1024
VOCABULARY = 1 << 16
QUERY_TERMS = 24
SHARD_IDS = 3_000_000
TASK_IDS = 12_000_000
K1, B = 1.2, 0.75
PIECES = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")


def places(ids: np.ndarray, sizes: np.ndarray) -> list[int]:
    """A min-hash over the neighbouring ids of each document, spread evenly over 64 bits."""
    starts = np.cumsum(sizes) - sizes
    pairs = (ids[:-1].astype(np.uint64) << np.uint64(16)) | ids[1:] if len(ids) > 1 else np.zeros(0, np.uint64)
    hashes = np.append(mixed(pairs), np.uint64(0xFFFFFFFFFFFFFFFF))
    hashes[starts[1:] - 1] = np.uint64(0xFFFFFFFFFFFFFFFF)  # pairs that reach into the next document
    return mixed(np.minimum.reduceat(hashes, starts)).view(np.int64).tolist()


def encoded(docs: DataFrame, file: str, end_id: int) -> DataFrame:
    """Rows (doc_id, key, place, n, ids); a row without ``n`` carries a task's document frequencies."""
    rows = keyed(take(docs, doc_id="bigint", text="string")).select("doc_id", "_k", "text")
    schema = "doc_id bigint, _k bigint, place bigint, n bigint, ids binary"
    arrow = to_arrow_schema(_schema(schema))
    closing = np.array([end_id], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency, few = np.zeros(VOCABULARY, np.int64), np.zeros(VOCABULARY, np.uint8)  # of up to 255 documents
        seen, counted = np.zeros(VOCABULARY, np.uint8), 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                made = [b + closing for b in chunks(file, True).texts(part.column(2).to_pylist())]
                ids = np.frombuffer(b"".join(made), "<u2")
                sizes = np.array([len(b) // 2 for b in made], np.int64)
                ends = np.cumsum(sizes).tolist()
                for a, b in zip([0, *ends], ends):
                    seen[ids[a:b]] = 1
                    few += seen
                    seen[ids[a:b]] = 0
                    counted += 1
                    if counted == 255:
                        frequency += few
                        few[:], counted = 0, 0
                yield as_batch({"doc_id": part.column(0).to_pylist(), "_k": part.column(1).to_pylist(), "place": places(ids, sizes),
                                "n": sizes, "ids": made}, arrow)
        frequency += few
        yield as_batch({"doc_id": [None], "_k": [0], "place": [0], "n": [None], "ids": [frequency.astype("<i8").tobytes()]}, arrow)

    return rows.mapInArrow(run, schema)


def frequencies(kept: DataFrame) -> np.ndarray:
    """Documents of the corpus that hold each id: at most 65,536 rows from Spark."""
    def run(batches):
        total = np.zeros(VOCABULARY, np.int64)
        for batch in batches:
            for one in batch.column(0).to_pylist():
                total += np.frombuffer(one, "<i8")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["id", "n"])

    got = kept.where("n is null").select("ids").mapInArrow(run, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(VOCABULARY, np.int64)
    out[got.column("id").to_numpy()] = got.column("n").to_numpy()
    return out


class Index:
    """The BM25 inverted index of a shard: for each id, its documents and their weights."""

    def __init__(self, docs: list[np.ndarray], weights: np.ndarray, mean: float):
        sizes = np.array([len(d) for d in docs], np.int64)
        # One sort of (document, id) gives each document's distinct ids and their counts.
        pairs = (np.repeat(np.arange(len(docs), dtype=np.uint64 if len(docs) > 1 << 16 else np.uint32), sizes) << 16) | np.concatenate(docs)
        pairs.sort()
        first = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
        count = np.diff(np.append(first, len(pairs)))
        owner, term = (pairs[first] >> 16).astype(np.int32), (pairs[first] & 0xFFFF).astype(np.int64)
        gain = weights[term] * np.log1p(count)
        cuts = np.searchsorted(owner, np.arange(len(docs) + 1)).tolist()
        self.queries = [term[a:b][np.argpartition(-gain[a:b], QUERY_TERMS)[:QUERY_TERMS]] if b - a > QUERY_TERMS else term[a:b]
                        for a, b in zip(cuts, cuts[1:])]
        order = np.argsort(term, kind="stable")
        size = sizes[owner]
        weight = weights[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * size / mean))
        self.owners, self.weights = owner[order], weight[order]
        self.starts = np.searchsorted(term[order], np.arange(VOCABULARY + 1))
        self.size = len(docs)

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """BM25 of all documents of the shard for a query of distinct ids."""
        spans = [slice(a, b) for a, b in zip(self.starts[terms].tolist(), self.starts[terms + 1].tolist()) if b > a]
        if not spans:
            return np.zeros(self.size)
        return np.bincount(np.concatenate([self.owners[s] for s in spans]), np.concatenate([self.weights[s] for s in spans]), self.size)


class Packer:
    """Deals the documents of one task into windows, shard by shard; the open window goes on from one to the next."""

    def __init__(self, weights: np.ndarray, mean: float):
        self.weights, self.mean = weights, mean
        self.windows = 0             # opened so far
        self.current, self.room = 0, 0  # the open window and what is left of it
        self.asked = None            # the terms of its seed
        self.pieces: list[tuple] = []

    def open(self) -> None:
        self.current, self.room = self.windows, WINDOW
        self.windows += 1

    def piece(self, doc: tuple, start: int, length: int, window: int, offset: int) -> None:
        doc_id, ids = doc
        check = zlib.crc32(ids[start:start + length].astype("<u4").tobytes())
        self.pieces.append((doc_id, start, length, check, len(ids), window, offset))

    def shard(self, docs: list[tuple]) -> None:
        rests: list[tuple] = []
        for doc in docs:
            whole = len(doc[1]) // WINDOW
            for n in range(whole):
                self.piece(doc, n * WINDOW, WINDOW, self.windows, 0)
                self.windows += 1
            if len(doc[1]) % WINDOW:
                rests.append((doc, whole * WINDOW))
        if rests:
            self.fill(rests)

    def fill(self, rests: list[tuple]) -> None:
        """Pack what is left of each document: (document, first id)."""
        index = Index([doc[1] for doc, _ in rests], self.weights, self.mean)
        begin = [start for _, start in rests]
        unused = np.ones(len(rests), bool)
        order = iter(range(len(rests)))
        seed, ranking = None, []

        def next_seed() -> int | None:
            """The rest of the document cut last, or the first unused one in sorted order."""
            return seed if seed is not None and unused[seed] else next((n for n in order if unused[n]), None)

        while True:
            if self.room:
                chosen = next_unused(ranking, unused)
                if chosen is None and self.asked is not None:
                    ranking = ranked(index.scores(self.asked), unused)
                    chosen = next_unused(ranking, unused)
                chosen = next_seed() if chosen is None else chosen
                if chosen is None:
                    return
            else:
                chosen = next_seed()
                if chosen is None:
                    return
                self.open()
                self.asked, ranking = index.queries[chosen], []
            doc, _ = rests[chosen]
            length = min(self.room, len(doc[1]) - begin[chosen])
            self.piece(doc, begin[chosen], length, self.current, WINDOW - self.room)
            self.room -= length
            begin[chosen] += length
            if begin[chosen] == len(doc[1]):
                unused[chosen] = False
            seed = chosen


def ranked(scores: np.ndarray, unused: np.ndarray, most: int = 16) -> list[int]:
    """The best unused documents with a shared term, worst first."""
    held = np.where(unused, scores, 0.0)
    top = np.argpartition(-held, most)[:most] if len(held) > most else np.arange(len(held))
    top = top[held[top] > 0]
    return top[np.argsort(held[top], kind="stable")].tolist()


def next_unused(ranking: list[int], unused: np.ndarray) -> int | None:
    while ranking:
        at = ranking.pop()
        if unused[at]:
            return at
    return None


def packed(docs: DataFrame, file: str, end_id: int = 0) -> DataFrame:
    """The pieces of all documents, as in ``PIECES``."""
    spark = docs.sparkSession
    folder = scratch_path(spark)
    encoded(docs, file, end_id).write.option("compression", "zstd").parquet(folder)
    kept = spark.read.parquet(folder)
    rows, total = kept.where("n is not null").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = frequencies(kept)
    weights = np.log1p((rows - held + 0.5) / (held + 0.5)).astype(np.float32)
    mean = total / max(1, rows)
    shared = spark.sparkContext.broadcast((weights, mean))
    arrow = to_arrow_schema(_schema(PIECES))
    ordered = (kept.where("n is not null").repartitionByRange(max(1, math.ceil(total / TASK_IDS)), "place", "_k")
               .sortWithinPartitions("place", "_k").select("doc_id", "ids", F.spark_partition_id().alias("number")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        packer, waiting, size, number = Packer(*shared.value), [], 0, 0

        def ready():
            packer.shard(waiting)
            columns = list(zip(*packer.pieces))
            packer.pieces = []
            made = dict(zip(arrow.names, columns))
            made["sequence_id"] = [(number << 32) + n for n in made["sequence_id"]]
            return as_batch(made, arrow)

        for batch in batches:
            if batch.num_rows:
                number = batch.column(2)[0].as_py()
            for doc_id, one in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                waiting.append((doc_id, np.frombuffer(one, "<u2")))
                size += len(one) // 2
                if size >= SHARD_IDS:
                    yield ready()
                    waiting, size = [], 0
        if waiting:
            yield ready()

    return ordered.mapInArrow(run, PIECES)
