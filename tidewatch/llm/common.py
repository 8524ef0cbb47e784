"""Helpers shared by the text operators.

Every operator picks its columns with ``take``, so missing extras, clashing names
and other column types of the input cannot reach it. Python work is a map over
Arrow batches: Spark splits, shuffles and retries it, one batch is in memory.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of an Arrow batch that are worked on at a time; bounds the Python objects alive.
SLICE_ROWS = 512


def take(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns cast to the given types, found by exact name; an absent one is null."""
    names = df.columns
    plain = df.toDF(*[f"_c{i}" for i in range(len(names))])
    return plain.select(*[
        (F.col(f"_c{names.index(name)}") if name in names else F.lit(None)).cast(kind).alias(name)
        for name, kind in columns.items()])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


class Shared:
    """A broadcast value and a name for it that workers can tell apart."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value

    def drop(self) -> None:
        """Free it everywhere, once all that needs it is written."""
        self.broadcast.destroy()


#: What the current operator keeps in this worker between batches and tasks.
_STATE: dict = {}


def worker_state(name, make: Callable):
    """The state ``name`` of this worker, made when first asked for; those of other operators are let go."""
    if name not in _STATE:
        _STATE.clear()
        _STATE[name] = make()
    return _STATE[name]


def release() -> None:
    """Let go what other operators kept in this worker."""
    _STATE.clear()


def map_rows(df: DataFrame, schema: str, work: Callable[[dict[str, list]], dict[str, list]], stateful: bool = False) -> DataFrame:
    """Apply ``work`` (columns as lists to columns as lists or arrays) to slices of the rows.

    ``stateful``: it uses ``worker_state``.
    """
    out = _schema(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not stateful:
            release()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                made = work({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                yield as_batch(made, arrow)

    return df.mapInArrow(run, out)


def as_batch(made: dict, arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) for f in arrow], schema=arrow)


def in_parts(batch: pa.RecordBatch, rows: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """A large batch cut up, so that the reader holds little of it at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


#: The columns of ``documents``, which the filtering stages take and return.
DOCUMENT = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}

#: Identifies a document row by its id and text in 96 hashed bits; never null, so it joins plainly.
KEY = ["_k", "_k2"]


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("*", F.xxhash64("doc_id", "text").alias("_k"), F.hash("text", "doc_id").alias("_k2"))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix, so that sums and minima of hashes behave like random ones."""
    with np.errstate(over="ignore"):
        z = values.astype(np.uint64, copy=True)
        z ^= z >> np.uint64(30)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(27)
        z *= np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return z


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all runs of ``width`` hashed words, in order."""
    n = len(words) - width + 1
    if n < 1:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for k in range(width):
            total = total * np.uint64(0x9E3779B97F4A7C15) + mixed(words[k:k + n])
    return mixed(total)


def word_hashes(words: list[bytes]) -> np.ndarray:
    place: dict[bytes, int] = {}
    ids = np.array([place.setdefault(w, len(place)) for w in words], np.int64)
    return np.array([xxhash.xxh3_64_intdigest(w) for w in place], np.uint64)[ids] if words else np.empty(0, np.uint64)


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def sketch(text: str | None, width: int = 5, seen: np.ndarray | None = None) -> int:
    """A min-hash over the word windows of a text, which copies share and near copies mostly do."""
    data = (text or "").encode()
    if seen is None:
        seen = windows(word_hashes(data.split()), width)
    return signed(int(seen.min()) if len(seen) else xxhash.xxh3_64_intdigest(b" ".join(data.lower().split())))
