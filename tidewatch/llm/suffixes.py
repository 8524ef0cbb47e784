"""Removal of long repeated strings, by a logarithmic family of suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a
smaller id. First texts are cut into pieces of some hundred strings, at places that eight bytes
tell, and dealt as hashes of the pieces: those that stand in a smaller document as a whole go. A
string of such a piece starts in a smaller document, and the smallest document that has it keeps
it, so only the pieces that are left are looked at again.

Their strings are compared where they can be equal only: each has a key, the smallest
hash of its ``SAMPLE``-byte parts, and neighbouring strings with one key are one stretch of
text. What is left of the texts is written with the keys, which are then counted. Stretches whose key
stands elsewhere too are dealt by key, as hashes: those that stand in a smaller document as a whole go. What is
left, each distinct stretch once, is dealt with its text if another stretch has its key. So
unique text is never shuffled, and a copied one as hashes only. A piece or stretch that
the same task has met in a smaller document is removed there and then, so a passage repeated
everywhere is sent once a task.

Within a share of the keys documents come in order of their ids, in batches. A batch gets a
suffix array, sorted by the first ``LENGTH`` bytes: equal strings stand side by side, and those
of the smallest document stay. It is merge-scanned against the arrays of all earlier batches, the
levels; what stands there has started in a smaller document. Its new strings then become a level,
and levels of equal size are merged, so there are few, and each string is moved a logarithmic
number of times. A level holds texts and positions, not the strings themselves.

Which pieces stay, which keys stand twice, and which stretches need their texts, goes to the tasks as bitmaps
that grow with what they hold, to 64 MB; what they let through by chance is sent for nothing. Rows are known by
their id and 32 hashed bits of the text; pieces are equal if 128 bits of hash are, stretches if 40 bits of key and 64 of hash are.

Defined cases: null and empty texts have no bytes; of documents with one id neither is smaller; a
null doc_id is smaller than none and greater than none, so such a row stays whole; repeated rows
give one row each; an empty table gives no rows. What is left may end within a character, so it
is binary.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.llm import bitmap
from tidewatch.llm.common import SLICE_ROWS, Shared, _schema, as_batch, in_parts, mixed, release, take, to_arrow_schema
from tidewatch.session import drop_path, materialise, scratch_path

LENGTH = 50
SAMPLE = 20
#: Bytes of text hashed at a time, small enough for a processor's cache; a longer text is cut with an overlap.
BLOCK = 1 << 16
#: Strings of a stretch, at most; bytes of a key.
STRETCH, KEY_BYTES = 256, 5
#: A piece ends before one of so many strings (binary logarithm), and has so many at least.
LOG_PIECE, LEAST_PIECE = 8, 64
#: Keys that a task adds up, and pieces or stretches that it compares, before it hands them on.
KEYS, STRETCHES = 1_500_000, 250_000
#: Strings of a batch, and of a share, about; strings read from a level at a time.
BATCH, SHARE, SCAN = 1 << 18, 1 << 20, 1 << 16
FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def part_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``SAMPLE``-byte parts from each of the first ``n`` bytes; ``data`` goes on for as many bytes."""
    eight = np.ndarray((len(data) - 8,), "<u8", data, 0, (1,))
    with np.errstate(over="ignore"):
        x = eight[:n] * FACTORS[0]
        for at, factor in zip((8, SAMPLE - 8), FACTORS[1:]):
            x ^= x >> np.uint64(32)
            x += eight[at:at + n]
            x *= factor
        x ^= x >> np.uint64(29)
        x *= FACTORS[0]
        x ^= x >> np.uint64(32)
    return x


def stretches(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, number of the part, first byte in it and number of strings of each stretch."""
    sizes = np.array([len(p) for p in parts], np.int64)
    ends = np.cumsum(sizes)
    n = int(ends[-1]) if len(parts) else 0
    if n < LENGTH:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    least = part_hashes(np.frombuffer(b"".join(parts) + bytes(64), np.uint8), n)
    wide, step = LENGTH - SAMPLE + 1, 1  # the least hash of the parts of each string
    while 2 * step <= wide:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if wide > step:
        least = np.minimum(least[:step - wide], least[wide - step:])
    counts = np.maximum(sizes - LENGTH + 1, 0)
    place = np.arange(counts.sum()) + np.repeat(ends - sizes - np.cumsum(counts) + counts, counts)
    least = least[place]
    fresh = np.ones(len(least), bool)
    fresh[1:] = (least[1:] != least[:-1]) | (place[1:] != place[:-1] + 1)
    begin = np.flatnonzero(fresh)
    within = np.arange(len(least)) - np.repeat(begin, np.diff(np.append(begin, len(least))))
    begin = np.flatnonzero(within % STRETCH == 0)
    owner = np.searchsorted(ends, place[begin], side="right")
    return mixed(least[begin]), owner, place[begin] - (ends - sizes)[owner], np.diff(np.append(begin, len(least)))


def cut(text: str | None) -> list[tuple[int, bytes]]:
    """The text in blocks (offset, bytes); each string of it lies in exactly one."""
    data = (text or "").encode()
    return [(at, data[at:at + BLOCK + LENGTH - 1]) for at in range(0, max(1, len(data) - LENGTH + 1), BLOCK)]


def blocks(texts: list[str | None]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Rows, offsets and bytes of parts of the texts, about ``BLOCK`` bytes at a time."""
    held, size = [], 0
    for row, text in enumerate(texts):
        for at, data in cut(text):
            if len(data) >= LENGTH:
                held.append((row, at, data))
                size += len(data)
            if size >= BLOCK:
                yield tuple(zip(*held))
                held, size = [], 0
    if held:
        yield tuple(zip(*held))


def pieces(parts: list[bytes]) -> tuple[list[int], list[int], list[int]]:
    """Number of the part, first and last string (excluded) of each piece; they cover all strings, cut by the bytes at the cut alone."""
    sizes = np.array([len(p) for p in parts], np.int64)
    begins = np.cumsum(sizes) - sizes
    eight = np.ndarray((int(sizes.sum()),), "<u8", np.frombuffer(b"".join(parts) + bytes(8), np.uint8), 0, (1,))
    with np.errstate(over="ignore"):
        places = np.flatnonzero(eight * FACTORS[0] >> np.uint64(64 - LOG_PIECE) == 0)
    low, high = np.searchsorted(places, begins).tolist(), np.searchsorted(places, begins + sizes - LENGTH + 1).tolist()
    places, owner, first, last = places.tolist(), [], [], []
    for n, (begin, size) in enumerate(zip(begins.tolist(), sizes.tolist())):
        done = 0
        for place in places[low[n]:high[n]]:
            if place - begin - done >= LEAST_PIECE:
                owner.append(n)
                first.append(done)
                last.append(done := place - begin)
        owner.append(n)
        first.append(done)
        last.append(size - LENGTH + 1)
    return owner, first, last


#: Identifies a row.
ROW = ["doc_id", "_k2"]


def found_pieces(part: pa.RecordBatch) -> Iterator[tuple]:
    """Of the texts of some rows, about a block at a time: rows, offsets and bytes of parts; part, first and last string of pieces; their hashes."""
    for owners, offsets, parts in blocks(part.column(3).to_pylist()):
        owner, first, last = pieces(parts)
        texts = [parts[n][a:b + LENGTH - 1] for n, a, b in zip(owner, first, last)]
        hashes = np.frombuffer(b"".join([xxhash.xxh3_128_digest(t) for t in texts]), np.int64).reshape(-1, 2)
        yield np.array(owners), np.array(offsets), parts, np.array(owner), np.array(first), np.array(last), hashes


NAMED = "key bigint, hash bigint, doc_id bigint, _k2 int, at int, size int, known boolean"


def named(rows: DataFrame, found: Callable[[pa.RecordBatch], Iterator[tuple]]) -> DataFrame:
    """Key, hash, row, place and size of the strings that ``found`` gives of a batch of ``rows``; some are known to go."""
    arrow = to_arrow_schema(_schema(NAMED))

    def ready(held):
        columns = [np.concatenate(c) for c in zip(*held)]
        order = np.lexsort([columns[k] for k in (4, 3, 2, 1, 0)])
        columns = [c[order] for c in columns]
        change = [np.append(True, c[1:] != c[:-1]) for c in columns[:5]]
        once = np.logical_or.reduce(change)  # a repeated row is looked at once
        first = np.flatnonzero(change[0] | change[1])
        least = np.repeat(columns[2][first], np.diff(np.append(first, len(order))))
        made = [c[once] for c in (*columns, columns[2] > least)]
        yield from in_parts(as_batch(dict(zip(arrow.names, made)), arrow))

    def run(batches):
        release()
        held, size = [], 0
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(low, SLICE_ROWS)
                ids, k2 = part.column(0).to_numpy(), part.column(1).to_numpy()
                for key, hashed, row, at, length in found(part):
                    held.append((key, hashed, ids[row], k2[row], at, length))
                    size += len(row)
                if size >= STRETCHES:
                    yield from ready(held)
                    held, size = [], 0
        if size:
            yield from ready(held)

    return rows.mapInArrow(run, NAMED)


def named_pieces(part: pa.RecordBatch) -> Iterator[tuple]:
    for owners, offsets, _, owner, first, last, hashes in found_pieces(part):
        yield hashes[:, 0], hashes[:, 1], owners[owner], offsets[owner] + first, last - first + LENGTH - 1


def compared(found: DataFrame) -> DataFrame:
    """Rows of ``named``: whether they go (``gone``), and whether others of their key are not the same (``several``)."""
    # Those known to go are spread by themselves, so that no key gets all copies of a passage.
    spread = found.withColumn("group", F.when(F.col("known"), F.xxhash64(*ROW, "at")).otherwise(F.col("key"))).repartition("group")
    same, near = Window.partitionBy("group", "hash"), Window.partitionBy("group")
    gone = F.col("known") | (F.col("doc_id") > F.min("doc_id").over(same))
    several = F.min("hash").over(near) != F.max("hash").over(near)
    return spread.select(*ROW, "hash", "at", "size", gone.alias("gone"), several.alias("several"))


def mark() -> Column:
    """Of a row of ``compared``, for a bitmap: known by its hash and its row."""
    return F.col("hash").bitwiseXOR(F.xxhash64(*ROW))


def as_bytes(keys: np.ndarray) -> bytes:
    """The first ``KEY_BYTES`` bytes of each key."""
    return keys.view(np.uint8).reshape(-1, 8)[:, 8 - KEY_BYTES:].tobytes()


def as_keys(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // KEY_BYTES, 8), np.uint8)
    out[:, 8 - KEY_BYTES:] = np.frombuffer(data, np.uint8).reshape(-1, KEY_BYTES)
    return out.view(np.int64).ravel()


PARTS = "doc_id bigint, _k2 int, mark bigint, at int, part binary, keys binary, sizes binary"


def parted(rows: DataFrame, kept: Shared) -> DataFrame:
    """The texts without the pieces that ``kept``, a bitmap, does not hold: rows, places and bytes of what is left, and its stretches' keys and sizes."""
    arrow = to_arrow_schema(_schema(PARTS))

    def run(batches):
        release()
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(low, SLICE_ROWS)
                ids, k2, marks = (part.column(k).to_numpy() for k in range(3))
                for owners, offsets, parts, owner, first, last, hashes in found_pieces(part):
                    held = np.flatnonzero(bitmap.holds(kept.value, hashes[:, 1] ^ marks[owners[owner]]))
                    if not len(held):
                        continue
                    begin = np.append(True, (owner[held[1:]] != owner[held[:-1]]) | (held[1:] != held[:-1] + 1))
                    own, first, last = owner[held[begin]], first[held[begin]], last[held[np.append(begin[1:], True)]]
                    texts = [parts[n][a:b + LENGTH - 1] for n, a, b in zip(own.tolist(), first.tolist(), last.tolist())]
                    keys, of, _, size = stretches(texts)
                    ends = np.searchsorted(of, np.arange(len(texts)), side="right").tolist()
                    keys, size, spans = as_bytes(keys), (size - 1).astype(np.uint8).tobytes(), list(zip([0, *ends], ends))
                    row = owners[own]
                    yield as_batch({"doc_id": ids[row], "_k2": k2[row], "mark": marks[row], "at": (offsets[own] + first).astype(np.int32), "part": texts,
                                    "keys": [keys[KEY_BYTES * a:KEY_BYTES * b] for a, b in spans], "sizes": [size[a:b] for a, b in spans]}, arrow)

    return rows.select(*ROW, "mark", "text").mapInArrow(run, PARTS)


def shared_keys(parts: DataFrame) -> Shared:
    """A bitmap of the keys that two parts or more have."""
    def run(batches):
        release()
        return bitmap.packed((np.unique(as_keys(keys)) for batch in batches for keys in batch.column(0).to_pylist()), KEYS)

    return bitmap.sized(parts.select("keys").mapInArrow(run, bitmap.PACKS), several=True)


def shared_stretches(part: pa.RecordBatch, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """Key, row, place, bytes and hash of the stretches of ``PARTS`` that ``keys``, a bitmap, holds."""
    texts, sizes = part.column(4).to_pylist(), part.column(6).to_pylist()
    key = as_keys(b"".join(part.column(5).to_pylist()))
    size = np.frombuffer(b"".join(sizes), np.uint8).astype(np.int64) + 1
    counts = np.array([len(s) for s in sizes], np.int64)
    row = np.repeat(np.arange(len(texts)), counts)
    begin = np.cumsum(size) - size
    begin -= np.repeat(begin[np.cumsum(counts) - counts], counts)
    held = np.flatnonzero(bitmap.holds(keys, key))
    key, row, begin, end = key[held], row[held], begin[held], (begin + size + LENGTH - 1)[held]
    found = [texts[n][a:b] for n, a, b in zip(row.tolist(), begin.tolist(), end.tolist())]
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)).view(np.int64)
    return key, row, part.column(3).to_numpy()[row] + begin, found, hashes


def named_stretches(parts: DataFrame, shared: Shared) -> DataFrame:
    def found(part):
        key, row, at, texts, hashes = shared_stretches(part, shared.value)
        yield key, hashes, row, at, np.array([len(t) for t in texts], np.int64)

    return named(parts, found)


DEALT = "key bigint, doc_id bigint, _k2 int, at int, part binary"


def dealt(parts: DataFrame, shared: Shared, wanted: Shared) -> DataFrame:
    """Key, row, place and text of the stretches that are compared: those whose hash and row ``wanted`` holds."""
    arrow = to_arrow_schema(_schema(DEALT))

    def run(batches):
        release()
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(low, SLICE_ROWS)
                key, row, at, texts, hashes = shared_stretches(part, shared.value)
                held = np.flatnonzero(bitmap.holds(wanted.value, hashes ^ part.column(2).to_numpy()[row]))
                row = row[held]
                yield as_batch({"key": key[held], "doc_id": part.column(0).to_numpy()[row], "_k2": part.column(1).to_numpy()[row],
                                "at": at[held].astype(np.int32), "part": [texts[n] for n in held.tolist()]}, arrow)

    return parts.mapInArrow(run, DEALT)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


class Level:
    """A suffix array: texts, and the positions of their distinct strings in the order of their bytes."""

    def __init__(self, text: np.ndarray, order: np.ndarray):
        self.text, self.order = text, order

    def strings(self, low: int, high: int) -> np.ndarray:
        return read(self.text, self.order[low:high])

    def places(self, other: Level) -> tuple[np.ndarray, np.ndarray]:
        """For each string of ``other``, in order: where it belongs here, and whether it is here. One scan over both."""
        size, more = len(self.order), len(other.order)
        at, here = np.full(more, size), np.zeros(more, bool)
        start = 0
        for low in range(0, more, SCAN):
            wanted = other.strings(low, low + SCAN)
            done = 0
            while done < len(wanted) and start < size:
                block = self.strings(start, start + SCAN)
                upto = int(np.searchsorted(wanted, block[-1], side="right"))
                found = np.searchsorted(block, wanted[done:upto])
                at[low + done:low + upto] = start + found
                here[low + done:low + upto] = block[found] == wanted[done:upto]
                done = upto
                if done < len(wanted):
                    start += SCAN
        return at, here

    def with_new(self, other: Level) -> Level:
        """Both in one; ``other`` has no string of this one."""
        at, _ = self.places(other)
        return Level(np.concatenate([self.text, other.text]), np.insert(self.order, at, other.order + len(self.text)))


def read(text: np.ndarray, places: np.ndarray) -> np.ndarray:
    return sliding_window_view(text, LENGTH)[places].view(f"S{LENGTH}").ravel()


def compact(parts: list[bytes], sizes: np.ndarray, part: np.ndarray, offset: np.ndarray) -> Level:
    """A level of the strings at ``offset`` of each ``part``, in this order, with the texts of these parts alone."""
    used = np.zeros(len(parts), bool)
    used[part] = True
    begin = np.cumsum(np.where(used, sizes, 0)) - np.where(used, sizes, 0)
    return Level(np.frombuffer(b"".join(p for p, u in zip(parts, used.tolist()) if u), np.uint8), begin[part] + offset)


class Family:
    """The levels of one share of the keys."""

    def __init__(self):
        self.levels: list[Level] = []

    def add(self, parts: list[bytes], documents: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Part, first byte and last byte of the stretches of strings that start in a smaller document.

        All documents added before are smaller than those of this batch.
        """
        text = np.frombuffer(b"".join(parts), np.uint8)
        sizes = np.array([len(p) for p in parts], np.int64)
        begin = np.cumsum(sizes) - sizes
        counts = sizes - LENGTH + 1
        part = np.repeat(np.arange(len(parts)), counts)
        offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        place = begin[part] + offset
        strings, first, number = np.unique(read(text, place), return_index=True, return_inverse=True)
        least = np.full(len(strings), np.iinfo(np.int64).max)
        np.minimum.at(least, number, documents[part])
        batch = Level(text, place[first])
        old = np.zeros(len(strings), bool)
        for level in self.levels:
            old |= level.places(batch)[1]
        gone = np.flatnonzero(old[number] | (documents[part] > least[number]))
        self.keep(compact(parts, sizes, part[first[~old]], offset[first[~old]]))
        fresh = np.ones(len(gone), bool)
        fresh[1:] = (gone[1:] != gone[:-1] + 1) | (part[gone[1:]] != part[gone[:-1]])
        at = np.flatnonzero(fresh)
        last = np.append(at[1:], len(gone)) - 1 if len(at) else at
        return part[gone[at]], offset[gone[at]], offset[gone[last]] + LENGTH

    def keep(self, level: Level) -> None:
        """The newest level, merged with those that are not larger."""
        if not len(level.order):
            return
        while self.levels and len(self.levels[-1].order) <= 2 * len(level.order):
            level = self.levels.pop().with_new(level)
        self.levels.append(level)


SPANS = "doc_id bigint, _k2 int, at array<int>"


def repeated(parts: DataFrame, shares: int) -> DataFrame:
    """Row and spans (from, to, ...) in bytes of the strings of ``dealt`` that start in a smaller document; a row may have several."""
    ordered = parts.repartition(shares, "key").sortWithinPartitions("doc_id")
    arrow = to_arrow_schema(_schema(SPANS))

    def run(batches):
        release()
        family = Family()
        waiting: list[tuple] = []  # row, place, text
        size = 0

        def ready():
            out: dict[tuple, list] = {}
            for n, a, b in zip(*(x.tolist() for x in family.add([w[3] for w in waiting], np.array([w[0] for w in waiting], np.int64)))):
                doc_id, k2, at, _ = waiting[n]
                out.setdefault((doc_id, k2), []).append((at + a, at + b))
            return as_batch({"doc_id": [i for i, _ in out], "_k2": [k for _, k in out], "at": [[x for s in merged(v) for x in s] for v in out.values()]}, arrow)

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(1, 5))):
                if size >= BATCH and row[0] != waiting[-1][0]:
                    yield ready()
                    waiting, size = [], 0
                waiting.append(row)
                size += len(row[3]) - LENGTH + 1
        if waiting:
            yield ready()

    return ordered.mapInArrow(run, SPANS)


def spans_to_go(rows: DataFrame) -> DataFrame:
    """As ``SPANS``, for rows with an id."""
    def whole(judged):
        return judged.where("gone").select(*ROW, F.array("at", F.col("at") + F.col("size")).alias("at"))

    judged = materialise(compared(named(rows.select(*ROW, "mark", "text"), named_pieces)).drop("several"))
    kept = bitmap.sized_of(mark(), judged.where("not gone"))
    path = scratch_path(rows.sparkSession)
    parts = materialise(parted(rows, kept), path, compression="zstd")
    kept.drop()
    keys = shared_keys(parts)
    again = materialise(compared(named_stretches(parts, keys)).where("gone or several").drop("several"))
    wanted = bitmap.sized_of(mark(), again.where("not gone"))
    strings = again.where("not gone").agg(F.sum(F.col("size") - (LENGTH - 1))).first()[0] or 0
    # A batch is scanned against all of its share, so shares do not grow with the input.
    shares = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-strings // SHARE))
    found = materialise(repeated(dealt(parts, keys, wanted), shares))
    keys.drop()
    wanted.drop()
    drop_path(rows.sparkSession, path)
    return whole(judged).unionByName(whole(again)).unionByName(found)


KEPT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def without_repeats(docs: DataFrame) -> DataFrame:
    """Every row as in ``KEPT``: what stays of its text, and how many bytes in how many stretches go."""
    rows = take(docs, doc_id="bigint", text="string").select("doc_id", F.hash("text", "doc_id").alias("_k2"), "text")
    rows = rows.select(*ROW, F.xxhash64(*ROW).alias("mark"), "text")
    spans = spans_to_go(rows.where("doc_id is not null"))
    cuts = spans.groupBy(*ROW).agg(F.flatten(F.collect_list("at")).alias("at"))  # of one text, so no more than it has bytes
    hit = bitmap.sized_of(F.xxhash64(*ROW), spans)
    arrow = to_arrow_schema(_schema(KEPT))

    def cleaned(doc_id, text, at):
        data = (text or "").encode()
        found = merged(list(zip(at[::2], at[1::2]))) if at else []
        ends = [0, *(b for _, b in found)]
        kept = b"".join(data[a:b] for a, b in zip(ends, [*(a for a, _ in found), len(data)])) if found else data
        return doc_id, len(data), len(data) - len(kept), len(found), kept

    def run(batches):
        release()
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(low, SLICE_ROWS)
                made = [cleaned(*row) for row in zip(*(part.column(k).to_pylist() for k in range(3)))]
                yield as_batch(dict(zip(arrow.names, zip(*made))), arrow)

    def chosen(held: bool):
        """The rows that the bitmap holds, or the others."""
        def some(batches):
            release()
            for batch in batches:
                yield batch.filter(pa.array(bitmap.holds(hit.value, batch.column(2).to_numpy()) == held))

        return rows.mapInArrow(some, rows.schema)

    # Only texts that lose something are shuffled.
    whole = chosen(False).select("doc_id", "text", F.lit(None).cast("array<int>").alias("at"))
    return whole.unionByName(chosen(True).join(cuts, ROW, "left").select("doc_id", "text", "at")).mapInArrow(run, KEPT)
