"""Near copies by an exact set-similarity join over word shingles.

Two sets of Jaccard similarity t or more, of sizes x and y, differ in at most
d = (1 - t) / (1 + t) * (x + y) elements. If the elements are dealt to d + 1 bands by hash, one
band holds the same elements of both. So rows meet only where a whole band is equal, which a
shared sentence or page frame does not bring about, and no near pair is missed. The number of bands goes
by classes of sizes that grow by 1 / t; a row has bands for its class and for the next one.

A pair must also have similar sizes and, of four times as many bands, at most d that differ;
a byte for each of these bands decides that before any text is read. What is left is compared on
the whole texts. A row meets the earlier rows of its bands, smallest ids first, until one is
likely near: each round takes twice as many of a band as the one before, and only rows that found none
go on. After all rounds the likely pairs are compared on their texts, a row's smallest leaders first; the few
rows whose likely leaders were not near take up their rounds again. So the rounds shuffle ids and
bands alone, and texts are shuffled once for all rounds, those of the likely pairs only. Equal texts meet by a digest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tidewatch.session import materialise

#: Words of a shingle, unless told otherwise.
SHINGLE = 5
#: Texts worked on at a time.
SLICE = 256
FINE = 4


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        return h ^ (h >> np.uint64(33))


def shingles(text: str, width: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct runs of ``width`` lower-case words; a shorter text is one run, one without words has none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    codes, names = pd.factorize(np.array(words, dtype=object))
    h = pd.util.hash_array(np.asarray(names, dtype=object), categorize=False)[codes]
    width = min(width, len(h))
    total = np.zeros(len(h) - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            total = total * np.uint64(0x9E3779B97F4A7C15) + mixed(h[k:k + len(total)] + np.uint64(width))
    return np.unique(mixed(total))


class Classes:
    """Size classes of a similarity: growing by a little more than 1 / ``t``, so that near pairs are at most one class apart."""

    def __init__(self, t: float):
        if not 0 < t <= 1:
            raise ValueError("a similarity lies above 0 and at most at 1")
        self.t, self.ratio = t, max(1 / t, 1.001) * 1.0001

    def of(self, size: int) -> int:
        return int(math.log(max(size, 1)) / math.log(self.ratio))

    def differ(self, sizes: float) -> int:
        """Elements in which a near pair of that many in all may differ."""
        return int((1 - self.t) / (1 + self.t) * sizes + 1e-6)

    def bands(self, number: int) -> int:
        """Bands of pairs whose larger row is in this class: one more than may differ."""
        return self.differ(2 * self.ratio ** (number + 1)) + 1


def band_sums(h: np.ndarray, bands: int) -> np.ndarray:
    """A hash of the set of elements of each band."""
    out = np.zeros(bands, np.uint64)
    with np.errstate(over="ignore"):
        np.add.at(out, (h % np.uint64(bands)).astype(np.int64), mixed(h + np.uint64(1)))
    return out


def row_bands(h: np.ndarray, classes: Classes) -> tuple[list[int], int, bytes, bytes]:
    """Band hashes of the own and the next class, the class, and the bytes of the finer bands of both."""
    own = classes.of(len(h))
    keys, fine = [], []
    for number in (own, own + 1):
        bands = classes.bands(number)
        names = mixed(np.arange(bands, dtype=np.uint64) + np.uint64(number << 32))
        keys.append(mixed(band_sums(h, bands) ^ names))
        fine.append((band_sums(h, FINE * bands) >> np.uint64(56)).astype(np.uint8).tobytes())
    return np.concatenate(keys).view(np.int64).tolist(), own, *fine


def digest(text: str) -> Column:
    """SHA-256 of a text: stands for the text where equal texts meet."""
    return F.unhex(F.sha2(text, 256))


def described(texts: DataFrame, t: float, width: int) -> DataFrame:
    """_id, digest, size, class, fine (of the own class), fine_next and bands of each text (_id, digest, _t) with a word."""
    classes = Classes(t)
    schema = f"_id {texts.schema['_id'].dataType.simpleString()}, digest binary, size int, class int, fine binary, fine_next binary, bands array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                kept, rows = [], []
                for i, text in enumerate(part.column(2).to_pylist()):
                    h = shingles(text, width)
                    if len(h):
                        keys, own, fine, more = row_bands(h, classes)
                        kept.append(i)
                        rows.append((len(h), own, fine, more, keys))
                columns = list(zip(*rows)) or [[]] * 5
                kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
                ids = part.select([0, 1]).take(pa.array(kept, pa.int32()))
                yield pa.RecordBatch.from_arrays([*ids.columns, *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                                                 names=["_id", "digest", "size", "class", "fine", "fine_next", "bands"])

    return texts.select("_id", "digest", "_t").mapInArrow(run, schema)


def likely(pairs: DataFrame, rows: DataFrame, t: float) -> DataFrame:
    """The pairs (_id, leader) whose sizes and finer bands allow a similarity of ``t``."""
    classes = Classes(t)
    parts = ["size", "class", "fine", "fine_next"]
    both = (pairs.join(rows.select("_id", *parts), "_id")
            .join(rows.select(F.col("_id").alias("leader"), *[F.col(c).alias(f"l_{c}") for c in parts]), "leader"))
    near = (F.least("size", "l_size") >= F.greatest("size", "l_size") * t - 1e-6) & (F.abs(F.col("class") - F.col("l_class")) <= 1)
    top = F.greatest("class", "l_class")
    chosen = lambda c, p="": F.when(F.col(f"{p}class") == top, F.col(f"{p}fine")).otherwise(F.col(f"{p}fine_next")).alias(c)
    both = both.where(near).select("_id", "leader", (F.col("size") + F.col("l_size")).alias("sizes"), chosen("a"), chosen("b", "l_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [int((np.frombuffer(a, np.uint8) != np.frombuffer(b, np.uint8)).sum()) <= classes.differ(n)
                    for n, a, b in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["_id", "leader"]).filter(pa.array(kept, pa.bool_()))

    return both.mapInArrow(run, "_id bigint, leader bigint")


def similar(pairs: DataFrame, texts: DataFrame, t: float, width: int) -> DataFrame:
    """The pairs with their similarity on the whole texts, where it is ``t`` or more."""
    both = pairs.join(texts, "_id").join(texts.select(F.col("_id").alias("leader"), F.col("_t").alias("_other")), "leader")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = shingles(a, width), shingles(b, width)
                shared = np.intersect1d(x, y, assume_unique=True).size
                values.append(shared / (x.size + y.size - shared))
            made = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.float64())], names=["_id", "leader", "similarity"])
            yield made.filter(pa.array([v >= t for v in values], pa.bool_()))

    return both.select("_id", "leader", "_t", "_other").mapInArrow(run, "_id bigint, leader bigint, similarity double")


def likely_leaders(left: DataFrame, ranked: DataFrame, rows: DataFrame, t: float) -> DataFrame | None:
    """(_id, leader, start): the likely pairs of the first round, from a row's ``_from`` on, in which it has any."""
    found, start = None, left.agg(F.min("_from")).first()[0]
    while start is not None:
        asking = left.where((F.col("rank") > start) & (F.col("_from") <= start))
        leaders = ranked.where((F.col("rank") >= start) & (F.col("rank") < 2 * start)).select("band", F.col("_id").alias("leader"))
        pairs = materialise(asking.join(leaders, "band").where(F.col("_id") > F.col("leader")).select("_id", "leader").distinct())
        near = materialise(likely(pairs, rows, t).withColumn("start", F.lit(start).cast("bigint")))
        found = near if found is None else found.unionByName(near)
        start *= 2
        left = materialise(left.where(F.col("rank") > start).join(near.select("_id").distinct(), "_id", "left_anti"))
        if left.isEmpty():
            break
    return found


def nearest_leaders(asked: DataFrame, texts: DataFrame, t: float, width: int) -> DataFrame:
    """The pairs that are near, of each row's smallest leaders, twice as many each time, until one of a row's is near."""
    numbered = F.row_number().over(Window.partitionBy("_id").orderBy("leader"))
    rest, found, at = materialise(asked.select("_id", "leader").withColumn("_n", numbered)), None, 1
    while found is None or not rest.isEmpty():
        near = materialise(similar(rest.where(F.col("_n") < 2 * at).select("_id", "leader"), texts, t, width))
        found = near if found is None else found.unionByName(near)
        rest = materialise(rest.where(F.col("_n") >= 2 * at).join(near.select("_id").distinct(), "_id", "left_anti"))
        at *= 2
    return found


def near_copies(df: DataFrame, row_id: str, text: str, similarity: float = 0.95, width: int = SHINGLE) -> DataFrame:
    """(row_id, leader, similarity): each row whose text is near that of an earlier row, with one such row.

    Rows of equal text count as their smallest id; nulls and texts without words are near nothing. Every row that has an earlier
    near row is found; leaders may be near copies themselves.
    """
    texts = df.filter(F.col(text).isNotNull()).select(F.col(row_id).alias("_id"), F.col(text).alias("_t"), digest(text).alias("digest"))
    same = [F.first(c).alias(c) for c in ("size", "class", "fine", "fine_next", "bands")]  # alike in rows of equal text
    rows = materialise(described(texts, similarity, width).groupBy("digest").agg(F.min("_id").cast("bigint").alias("_id"), *same))
    texts = texts.withColumn("_id", F.col("_id").cast("bigint"))
    band = Window.partitionBy("band")
    bands = rows.select("_id", F.explode("bands").alias("band"))
    ranked = bands.withColumns({"n": F.count("*").over(band), "rank": F.row_number().over(band.orderBy("_id"))})
    ranked = materialise(ranked.where("n > 1").drop("n"))
    rows = materialise(rows.drop("bands").join(ranked.select("_id").distinct(), "_id", "left_semi"))
    found, left = None, ranked.withColumn("_from", F.lit(1).cast("bigint"))
    while True:
        asked = likely_leaders(left, ranked, rows, similarity)
        if asked is None:
            break
        ids = asked.select("_id").unionByName(asked.select(F.col("leader").alias("_id")))
        asked_texts = texts.join(rows.select("_id", "digest").join(ids, "_id", "left_semi"), ["_id", "digest"], "left_semi")
        near = nearest_leaders(asked, materialise(asked_texts.dropDuplicates(["_id", "digest"]).select("_id", "_t")), similarity, width)
        found = near if found is None else found.unionByName(near)
        missed = asked.join(near, "_id", "left_anti").groupBy("_id").agg((F.max("start") * 2).alias("_from"))
        left = materialise(ranked.join(missed, "_id").where(F.col("rank") > F.col("_from")))
    if found is None:
        return rows.select(F.col("_id").alias(row_id), F.col("_id").alias("leader"), F.lit(0.0).alias("similarity")).limit(0)
    first = Window.partitionBy("_id").orderBy("leader")
    return found.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(F.col("_id").alias(row_id), "leader", "similarity")
