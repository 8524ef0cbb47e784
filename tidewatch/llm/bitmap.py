"""A set of 64-bit hashes as a bitmap of bounded size, to leave out rows early.

A value that was put in is always found; another one is found by chance with the share of
set bits. So a filter by it only saves work: whoever uses it decides exactly afterwards, and
a set larger than the bitmap costs speed, not results.

``shared`` makes one of a fixed size. ``sized`` makes one as large as the set needs, of values that
are shuffled in packs, a few thousand at a time, and told apart by their first 44 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.llm.common import Shared
from tidewatch.session import materialise

#: Bits of the map by their binary logarithm: 16 MB, the bound of what is broadcast.
LOG_BITS = 27
#: Bits of one row of Spark's bitmap aggregate.
LOG_ROW = 15
#: Of a map that follows its set: bits for a value, about, and the binary logarithm of its most bits (64 MB).
BITS, LOG_MOST = 16, 29
#: Packs, by the first bits of a value (binary logarithm).
LOG_PACKS = 12


def gathered(hashes: Column, rows: DataFrame) -> DataFrame:
    """(row, bits) of the values: at most 2 ** (LOG_BITS - LOG_ROW) rows of 4 KB."""
    place = F.shiftrightunsigned(hashes, 64 - LOG_BITS)
    return (rows.select(place.alias("p")).groupBy(F.shiftright("p", LOG_ROW).alias("row"))
            .agg(F.bitmap_construct_agg(F.col("p").bitwiseAND((1 << LOG_ROW) - 1)).alias("bits")))


def shared(hashes: Column, rows: DataFrame, onto: Shared | None = None) -> Shared:
    """The bitmap of the values, and of those of ``onto``, broadcast; a bounded number of bytes passes through the driver."""
    got = gathered(hashes, rows).toArrow()
    whole = np.zeros((1 << LOG_BITS) // 8, np.uint8) if onto is None else onto.value.copy()
    size = (1 << LOG_ROW) // 8
    for row, bits in zip(got.column("row").to_pylist(), got.column("bits")):
        whole[row * size:(row + 1) * size] |= np.frombuffer(bits.as_buffer(), np.uint8)
    return Shared(rows.sparkSession.sparkContext.broadcast(whole))


def holds(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each value may be in the set."""
    place = (hashes.view(np.uint64) >> np.uint64(65 - (8 * len(bitmap)).bit_length())).astype(np.int64)
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


PACKS = "pack int, rest binary"


def packed(arrays: Iterator[np.ndarray], most: int = 1_500_000) -> Iterator[pa.RecordBatch]:
    """``PACKS`` of the values in these arrays, handed on when there are ``most``; a value that came several times stands there twice."""
    held, size = [], 0

    def ready():
        values = np.sort(np.concatenate(held).view(np.uint64)) >> np.uint64(32 - LOG_PACKS)
        values = values[np.append([True, True], values[2:] != values[:-2])[:len(values)]]
        ends = np.searchsorted(values >> np.uint64(32), np.arange(1, (1 << LOG_PACKS) + 1, dtype=np.uint64))
        begins = np.append(0, ends[:-1])
        rest, own = values.astype(np.uint32), np.flatnonzero(ends > begins)
        for low in range(0, len(own), 1 << 10):
            some = own[low:low + (1 << 10)]
            bits = [rest[a:b].tobytes() for a, b in zip(begins[some].tolist(), ends[some].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(bits, pa.binary())], names=["pack", "rest"])

    for values in arrays:
        held.append(values)
        size += len(values)
        if size >= most:
            yield from ready()
            held, size = [], 0
    if size:
        yield from ready()


def by_pack(batches: Iterator[pa.RecordBatch], work: Callable[[int, list[bytes]], tuple]) -> Iterator[pa.RecordBatch]:
    """What ``work`` makes of each pack, of rows in the order of packs: pack, bytes and a number."""
    def ready():
        number, data, n = zip(*made)
        return pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(data, pa.binary()), pa.array(n, pa.int64())], names=["pack", "rest", "n"])

    pack, held, made = None, [], []
    for batch in batches:
        for number, rest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if number != pack:
                if held:
                    made.append((pack, *work(pack, held)))
                    if len(made) == 32:
                        yield ready()
                        made = []
                pack, held = number, []
            held.append(rest)
    if held:
        made.append((pack, *work(pack, held)))
    if made:
        yield ready()


def sized(packs: DataFrame, several: bool = False) -> Shared:
    """The bitmap of the values of ``PACKS``, or of those that came several times, broadcast; as large as they need, up to a bound."""
    def distinct(pack, held):
        values = np.sort(np.frombuffer(b"".join(held), np.uint32))
        same = values[1:] == values[:-1]
        values = np.unique(values[1:][same]) if several else values[np.append(True, ~same)]
        return values.tobytes(), len(values)

    whole = "pack int, rest binary, n bigint"
    sets = materialise(packs.repartition("pack").sortWithinPartitions("pack").mapInArrow(lambda batches: by_pack(batches, distinct), whole))
    count = sets.agg(F.sum("n")).first()[0] or 0
    log_bits = min(LOG_MOST, max(LOG_PACKS + 3, (BITS * count - 1).bit_length()))
    size = 1 << (log_bits - LOG_PACKS - 3)

    def segment(pack, held):
        bits = np.zeros(8 * size, bool)
        bits[np.frombuffer(held[0], np.uint32) >> np.uint32(32 + LOG_PACKS - log_bits)] = True
        return np.packbits(bits, bitorder="little").tobytes(), 0

    got = sets.where("n > 0").mapInArrow(lambda batches: by_pack(batches, segment), whole).select("pack", "rest").toArrow()
    bitmap = np.zeros((1 << log_bits) // 8, np.uint8)
    for chunk in got.to_batches():
        for pack, bits in zip(chunk.column(0).to_pylist(), chunk.column(1)):
            bitmap[pack * size:(pack + 1) * size] = np.frombuffer(bits.as_buffer(), np.uint8)
    return Shared(packs.sparkSession.sparkContext.broadcast(bitmap))


def sized_of(hashes: Column, rows: DataFrame) -> Shared:
    """As ``sized``, for the values of a column without nulls."""
    return sized(rows.select(hashes.alias("value")).mapInArrow(lambda batches: packed(b.column(0).to_numpy() for b in batches), PACKS))
