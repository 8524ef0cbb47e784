"""Token-id files: canonical length-limited Huffman codes with independent blocks.

Corpus-wide counts of the ids give one code (package-merge, at most ``LONGEST`` bits;
canonical, so its lengths define it). Documents are dealt into ranges of doc_id, one
file each, and written in ascending order. A file is a sequence of records, each

    u64 length, payload, newline

with every number little-endian. The first payload is the header: magic, file number
(u32), end id (u32), zlib-packed code lengths (u8 per id). Each further payload is a segment:
number of documents (u32), of blocks (u32), of code bytes (u32), then per document
id (i64), id present (u8), ids (u32); per block the bit offset in the codes (u32); codes.
A document starts a new block, and a block holds up to ``BLOCK`` ids, so any block can
be decoded from its checkpoint alone. Codes run from the high bit of each byte.

Decoding looks ``LONGEST`` bits up in one table and advances all blocks of a segment in
step. Files are made by Spark's text writer (a record's bytes as the row, newline as
separator) and read with its binary-file reader, so they live wherever Spark can write.

Defined cases: null and empty texts are the end id alone; rows without a doc_id come
first; rows with equal ids stand beside each other, ordered by the hash of their text;
an empty table gives no file and no rows; a text of any length is one document.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidewatch.llm.common import SLICE_ROWS, _schema, as_batch, keyed, release, take, to_arrow_schema
from tidewatch.llm.tokens import chunks
from tidewatch.session import drop_path, materialise, scratch_path

MAGIC = b"TWHUF001"
LONGEST = 18
IDS = 1 << 16
BLOCK = 256
#: Ids of a file, about; bounds what one task holds.
FILE_IDS = 4_000_000
SEGMENT_IDS = 1_000_000


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``longest`` bits (package-merge); 0 for unused ids."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    n = len(leaves)
    # Each level's list holds leaves and pairs of the level below; only which entries are leaves matters later.
    weights, levels = leaves, [np.ones(n, bool)]
    for _ in range(longest - 1):
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([leaves, pairs])
        at = np.argsort(merged, kind="stable")
        weights = merged[at]
        levels.append(at < n)
    take_n, depth = 2 * n - 2, np.zeros(n, np.int64)
    for is_leaf in reversed(levels):
        chosen = int(is_leaf[:take_n].sum())
        depth[:chosen] += 1
        take_n = 2 * (take_n - chosen)
    lengths[order] = depth
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, id)."""
    codes = np.zeros(len(lengths), np.uint32)
    code = last = 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for at in order[lengths[order] > 0].tolist():
        code <<= int(lengths[at]) - last
        last = int(lengths[at])
        codes[at] = code
        code += 1
    return codes


def decode_table(lengths: np.ndarray) -> np.ndarray:
    """For every run of ``LONGEST`` bits: id << 5 | length of the code it begins with."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    entry = (order.astype(np.uint32) << np.uint32(5)) | lengths[order]
    table = np.repeat(entry, 1 << (LONGEST - lengths[order].astype(np.int64)))
    return np.concatenate([table, np.zeros((1 << LONGEST) - len(table), np.uint32)])


def pack(ids: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Checkpoints (bit offset of every block) and code bytes of documents of ``sizes`` ids each."""
    length = lengths[ids].astype(np.int64)
    ends = np.cumsum(length)
    begin = ends - length
    first = np.cumsum(sizes) - sizes
    blocks = -(-sizes // BLOCK)
    nth = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    checks = begin[np.repeat(first, blocks) + BLOCK * nth]
    word, room = begin >> 6, 64 - (begin & 63) - length
    code = codes[ids].astype(np.uint64)
    left = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
    out = np.zeros(int(ends[-1] >> 6) + 2, np.uint64)
    starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    out[word[starts]] = np.add.reduceat(left, starts)
    over = np.flatnonzero(room < 0)
    out[word[over] + 1] += code[over] << (64 + room[over]).astype(np.uint64)
    return checks, out.astype(">u8").tobytes()[: int(ends[-1] + 7) >> 3]


def unpack(data: bytes, checks: np.ndarray, counts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The ids of blocks that start at the bits ``checks`` and hold ``counts`` ids, in order."""
    words = np.frombuffer(data + bytes(12 + -len(data) % 4), ">u4").astype(np.uint64)
    order = np.argsort(-counts, kind="stable")
    at, counts = checks[order].astype(np.int64), counts[order]
    sizes = np.empty(len(order), np.int64)
    sizes[order] = counts
    starts = (np.cumsum(sizes) - sizes)[order]
    ids = np.empty(int(sizes.sum()), np.uint32)
    low = np.uint64((1 << LONGEST) - 1)
    active = np.searchsorted(-counts, -np.arange(int(counts[0]) if len(counts) else 0), side="left")
    for step, lanes in enumerate(active.tolist()):
        pos = at[:lanes]
        w = pos >> 5
        both = (words[w] << np.uint64(32)) | words[w + 1]
        found = table[(both >> (64 - LONGEST - (pos & 31)).astype(np.uint64)) & low]
        ids[starts[:lanes] + step] = found >> np.uint32(5)
        pos += (found & np.uint32(31)).astype(np.int64)
    return ids


def record(payload: bytes) -> bytes:
    return struct.pack("<Q", len(payload)) + payload


def header(number: int, end_id: int, lengths: np.ndarray) -> bytes:
    return record(MAGIC + struct.pack("<II", number, end_id) + zlib.compress(lengths.tobytes()))


def segment(docs: list[tuple[int | None, bytes]], lengths: np.ndarray, codes: np.ndarray) -> bytes:
    """One record of documents (doc_id, ids as little-endian 16 bit)."""
    sizes = np.array([len(b) // 2 for _, b in docs], np.int64)
    ids = np.frombuffer(b"".join(b for _, b in docs), "<u2")
    checks, data = pack(ids, sizes, lengths, codes)
    parts = [struct.pack("<III", len(docs), len(checks), len(data)),
             np.array([i or 0 for i, _ in docs], "<i8").tobytes(), bytes(i is not None for i, _ in docs),
             sizes.astype("<u4").tobytes(), checks.astype("<u8").tobytes(), data]
    return record(b"".join(parts))


def records(content: bytes) -> Iterator[memoryview]:
    view, at = memoryview(content), 0
    while at < len(view):
        size = struct.unpack_from("<Q", view, at)[0]
        yield view[at + 8:at + 8 + size]
        at += size + 9


def opened(payload: memoryview, table: np.ndarray) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc ids, ids of each, and all ids of a segment."""
    docs, blocks, size = struct.unpack_from("<III", payload)
    at = 12
    names = np.frombuffer(payload, "<i8", docs, at)
    there = np.frombuffer(payload, np.uint8, docs, at + 8 * docs)
    sizes = np.frombuffer(payload, "<u4", docs, at + 9 * docs).astype(np.int64)
    checks = np.frombuffer(payload, "<u8", blocks, at + 13 * docs)
    data = bytes(payload[at + 13 * docs + 8 * blocks:])
    per = -(-sizes // BLOCK)
    counts = np.full(blocks, BLOCK, np.int64)
    last = np.cumsum(per) - 1
    counts[last] = sizes - BLOCK * (per - 1)
    return [int(n) if t else None for n, t in zip(names, there)], sizes, unpack(data[:size], checks, counts, table)


def encoded(docs: DataFrame, file: str, end_id: int) -> DataFrame:
    """doc_id, _k, n, ids of every row; a row without ``n`` carries how often a task met each id."""
    rows = keyed(take(docs, doc_id="bigint", text="string")).select("doc_id", "_k", "text")
    schema = "doc_id bigint, _k bigint, n bigint, ids binary"
    arrow = to_arrow_schema(_schema(schema))
    closing = np.array([end_id], "<u2").tobytes()

    def run(batches):
        total = np.zeros(IDS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                made = [b + closing for b in chunks(file, False).texts(part.column(2).to_pylist())]
                total += np.bincount(np.frombuffer(b"".join(made), "<u2"), minlength=IDS)
                yield as_batch({"doc_id": part.column(0), "_k": part.column(1), "n": [len(b) // 2 for b in made], "ids": made}, arrow)
        yield as_batch({"doc_id": [None], "_k": [0], "n": [None], "ids": [total.astype("<i8").tobytes()]}, arrow)

    return rows.mapInArrow(run, schema)


def id_counts(kept: DataFrame) -> np.ndarray:
    """How often each id occurs in the corpus (at most 65,536 rows from Spark)."""
    def run(batches):
        total = np.zeros(IDS, np.int64)
        for batch in batches:
            for one in batch.column(0).to_pylist():
                total += np.frombuffer(one, "<i8")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["id", "n"])

    got = kept.where("n is null").select("ids").mapInArrow(run, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(IDS, np.int64)
    counts[got.column("id").to_numpy()] = got.column("n").to_numpy()
    return counts


def write(docs: DataFrame, file: str, end_id: int, folder: str) -> None:
    """Encode ``docs`` and write the files under ``folder``."""
    spark = docs.sparkSession
    kept = scratch_path(spark)
    encoded(docs, file, end_id).write.option("compression", "zstd").parquet(kept)
    ids = spark.read.parquet(kept).where("n is not null")
    lengths = code_lengths(id_counts(spark.read.parquet(kept)))
    total = ids.agg(F.sum("n")).first()[0] or 0
    files = max(1, -(-total // FILE_IDS))
    shared = spark.sparkContext.broadcast(lengths)
    # Rows without an id or with one id are split by their key, repeated rows by their place in the staging files.
    placed = ids.select("doc_id", "_k", "ids", F.col("_metadata.row_index").alias("_row"))
    ordered = placed.repartitionByRange(files, "doc_id", "_k", "_row").sortWithinPartitions("doc_id", "_k", "_row")

    def run(batches):
        release()
        codes, number, held, size = canonical(shared.value), None, [], 0
        for batch in batches:
            if number is None and batch.num_rows:
                number = batch.column(2)[0].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([header(number, end_id, shared.value)])], names=["record"])
            for doc_id, one in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append((doc_id, one))
                size += len(one) // 2
                if size >= SEGMENT_IDS:
                    yield pa.RecordBatch.from_arrays([pa.array([segment(held, shared.value, codes)])], names=["record"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([segment(held, shared.value, codes)])], names=["record"])

    made = ordered.select("doc_id", "ids", F.spark_partition_id().alias("number")).mapInArrow(run, "record binary")
    made.select(F.col("record").cast("string").alias("value")).write.text(folder, lineSep="\n")
    drop_path(spark, kept)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """number (of the file), doc_id, before (ids before it in the file), n_tokens, ids_crc32 from the files alone."""
    out = "number int, doc_id bigint, before bigint, n_tokens bigint, ids_crc32 bigint"
    arrow = to_arrow_schema(_schema(out))

    def run(batches):
        release()
        for batch in batches:
            for content in batch.column(0):
                parts = records(content.as_py())
                head = next(parts)
                if bytes(head[:8]) != MAGIC:
                    raise ValueError("not a token-id file")
                number = struct.unpack_from("<I", head, 8)[0]
                table = decode_table(np.frombuffer(zlib.decompress(head[16:]), np.uint8))
                before = 0
                for payload in parts:
                    names, sizes, ids = opened(payload, table)
                    ends = np.cumsum(sizes)
                    data = memoryview(ids.astype("<u4").tobytes())
                    yield as_batch({
                        "number": [number] * len(names), "doc_id": names, "before": before + ends - sizes, "n_tokens": sizes,
                        "ids_crc32": [zlib.crc32(data[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), sizes.tolist())]}, arrow)
                    before += int(ends[-1])

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(run, out)


def round_trip(docs: DataFrame, file: str, end_id: int) -> DataFrame:
    """Write the files and return doc_id, start, n_tokens, ids_crc32 as read back from them."""
    spark = docs.sparkSession
    folder = scratch_path(spark)
    write(docs, file, end_id, folder)
    seen = materialise(read(spark, folder))
    # One row a file: the ids before it, a running sum over few rows.
    sums = seen.groupBy("number").agg(F.sum("n_tokens").alias("size"))
    bases = sums.select("number", (F.sum("size").over(Window.orderBy("number")) - F.col("size")).alias("base"))
    return seen.join(bases, "number").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
