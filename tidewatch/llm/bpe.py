"""Byte-level BPE by ranked merges: encoding to ids, and decoding by joining pieces.

The corpus' frequent words are encoded on Spark: distinct words become arrays of bytes
(one letter each), and a fold of higher-order functions merges the adjacent pair with
the lowest rank, step by step, looked up in a literal rank map. That map is an array of
small maps by checksum, because a lookup in one map of all ranks reads it through. The
table of frequent words is bounded by ``HEAD_WORDS`` and goes to all tasks. The
other words of a text are folded in the task that meets them by the same rule, each
once per worker: joining them back from a corpus-wide table would shuffle the texts.

A text is split by the pattern with Unicode's white space; a match that is a piece
itself is its id; otherwise the leftmost pair of the lowest rank is merged until none is left.

Defined cases: null and empty texts have no ids and decode to nothing; a word of any
length is merged with a heap in n log n; repeated rows give one row each; an empty table
gives no rows; a byte without a rank in the file is an error.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.llm.common import Shared, map_rows, take, worker_state
from tidewatch.llm.tokens import OTHER_SPACE, SPACE, SpacedChunks

HEAD_WORDS = 1 << 16
#: Tasks that fold them: few, as each has the rank map with it.
HEAD_TASKS = 6
#: Longest frequent word in bytes that the fold takes; it makes a step per byte.
HEAD_BYTES = 32
RANK_BUCKETS = 1 << 14
CACHE_CHUNKS = 600_000
#: Pairs from which merging goes by a heap.
HEAP_PARTS = 48
NO_RANK = (1 << 31) - 1


def read_ranks(file: str) -> dict[bytes, int]:
    with open(file, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def spelled(pattern: str) -> str:
    """The pattern with its white space written out, as engines differ on the separators x1c to x1f."""
    return pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")


# ---- the fold on Spark

def rank_lookup(ranks: dict[bytes, int]):
    """A function from a column of pieces (a letter per byte) to their rank, ``NO_RANK`` if they have none."""
    buckets: list[dict] = [{} for _ in range(RANK_BUCKETS)]
    for piece, rank in ranks.items():
        letters = piece.decode("latin-1")
        buckets[zlib.crc32(letters.encode()) % RANK_BUCKETS][letters] = rank
    literal = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")

    def rank(piece: Column) -> Column:
        place = (F.crc32(piece.cast("binary")) % RANK_BUCKETS).cast("int") + 1
        return F.coalesce(F.try_element_at(F.element_at(literal, place), piece), F.lit(NO_RANK))

    return rank


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def merged_ids(word: Column, rank) -> Column:
    """The ids of a word (a string) as an array: whole if it has a rank, else by folding merges over its bytes."""
    letters = F.decode(F.encode(word, "utf-8"), "iso-8859-1")
    size = F.octet_length(word)
    bytes_ = F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(letters, i, F.lit(1)))

    def pair_rank(parts, i):
        return rank(F.concat(F.element_at(parts, i), F.element_at(parts, i + 1)))

    def step(state, _):
        def at(place):
            parts, ranks, n = state["parts"], state["ranks"], F.size(state["parts"])
            joined = F.concat(F.element_at(parts, place), F.element_at(parts, place + 1))

            def rebuilt(one):
                beside = F.array(F.concat(F.element_at(parts, F.greatest(place - 1, F.lit(1))), one),
                                 F.concat(one, F.element_at(parts, F.least(place + 2, n))))
                return let(F.transform(beside, rank), lambda new: F.struct(
                    F.concat(F.slice(parts, 1, place - 1), F.array(one), F.slice(parts, place + 2, n)).alias("parts"),
                    F.concat(F.slice(ranks, 1, F.greatest(place - 2, F.lit(0))), F.slice(new, 1, F.least(place - 1, F.lit(1))),
                             F.slice(new, 2, F.when(place + 2 <= n, 1).otherwise(0)), F.slice(ranks, place + 2, n)).alias("ranks")))

            return let(joined, rebuilt)

        least = F.array_min(state["ranks"])
        return F.when(least.isNull() | (least == NO_RANK), state).otherwise(let(F.array_position(state["ranks"], least).cast("int"), at))

    start = let(bytes_, lambda parts: F.struct(
        parts.alias("parts"),
        F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: pair_rank(parts, i)))
        .otherwise(F.array().cast("array<int>")).alias("ranks")))
    folded = F.aggregate(F.sequence(F.lit(1), size), start, step)
    return let(rank(letters), lambda whole: F.when(whole != NO_RANK, F.array(whole)).otherwise(F.transform(folded["parts"], rank)))


def frequent_words(docs: DataFrame, pattern: str, most: int = HEAD_WORDS) -> DataFrame:
    """word: the distinct pattern matches in the most frequent blank-led chunks of the corpus.

    Each task counts its chunks and leaves out those it met fewer than four times, so
    counts are lower bounds; they only choose which words are encoded ahead.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def told():
            rows = [(w, n) for w, n in counts.items() if n >= 4]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["chunk", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update(text.split(" ") if not OTHER_SPACE.search(text) else ())
                if len(counts) > CACHE_CHUNKS:
                    yield told()
        yield told()

    chunks = (docs.select("text").mapInArrow(run, "chunk string, n bigint").where("chunk <> '' and not contains(chunk, '\n')")
              .groupBy("chunk").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "chunk").limit(most))
    # A chunk holds no white space, so Java's sense of it does not matter here.
    matches = F.regexp_extract_all(F.concat(F.lit(" "), F.col("chunk")), F.lit(pattern), 0)
    return chunks.select(F.explode(matches).alias("word")).distinct().where(F.octet_length("word") <= HEAD_BYTES)


# ---- the rest, in the task

def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > HEAP_PARTS:
        return merge_long(word, ranks)
    parts = [word[i:i + 1] for i in range(len(word))]
    get = ranks.get
    found = [get(a + b, NO_RANK) for a, b in zip(parts, parts[1:])]
    while found:
        least = min(found)
        if least == NO_RANK:
            break
        i = found.index(least)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del found[i]
        if i:
            found[i - 1] = get(parts[i - 1] + parts[i], NO_RANK)
        if i < len(found):
            found[i] = get(parts[i] + parts[i + 1], NO_RANK)
    return [ranks[p] for p in parts]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for long words: a heap of pairs over a linked list of parts."""
    n = len(word)
    end = list(range(1, n + 1))       # of the part that starts here
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = []

    def offer(i):
        j = after[i]
        if j < n:
            rank = ranks.get(word[i:end[j]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        alive[j] = False
        end[i], after[i] = stop, after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[word[i:end[i]]] for i in range(n) if alive[i]]


class Pieces:
    """A byte string for each id; ``joined`` concatenates those of many ids."""

    def __init__(self, pieces: list[bytes]):
        self.sizes = np.array([len(p) for p in pieces], np.int32)
        self.begins = np.cumsum(self.sizes, dtype=np.int32) - self.sizes
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def joined(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes, and where those of each id end."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes, dtype=np.int64)
        if not len(ids):
            return b"", ends
        place = np.repeat(self.begins[ids] - (ends - sizes), sizes)
        place += np.arange(ends[-1])
        return self.bytes[place].tobytes(), ends


class RankedChunks(SpacedChunks):
    """Chunk -> its ids as 16-bit numbers."""

    def __init__(self, file: str, pattern: str, head: dict[str, bytes]):
        super().__init__()
        self.ranks = read_ranks(file)
        self.head = head
        self.matches = regex.compile(spelled(pattern)).findall
        size = max(self.ranks.values()) + 1
        pieces = [b""] * size
        for piece, rank in self.ranks.items():
            pieces[rank] = piece
        self.pieces = Pieces(pieces)
        self.decimals = Pieces([b"%d," % i for i in range(size)])

    def learn(self, chunks: set[str]) -> None:
        head, ranks = self.head, self.ranks
        for chunk in chunks:
            ids: list[int] = []
            for word in self.matches(chunk):
                known = head.get(word)
                ids += merge(word.encode(), ranks) if known is None else np.frombuffer(known, "<u2").tolist()
            self.known[chunk] = np.array(ids, "<u2").tobytes()


def coded(docs: DataFrame, file: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    spark = docs.sparkSession
    rows = take(docs, doc_id="bigint", text="string")
    head_rows = frequent_words(rows, pattern).coalesce(HEAD_TASKS).select("word", merged_ids(F.col("word"), rank_lookup(read_ranks(file))).alias("ids"))
    told = head_rows.toArrow()  # at most HEAD_WORDS chunks' words
    head = {word: np.array(ids, "<u2").tobytes() for word, ids in zip(told.column("word").to_pylist(), told.column("ids").to_pylist())}
    shared = Shared(spark.sparkContext.broadcast(head))

    def work(part):
        known = worker_state(("ranks", file, shared.id), lambda: RankedChunks(file, pattern, shared.value))
        made = known.texts(part["text"])
        counts = np.array([len(m) // 2 for m in made])
        ids = np.frombuffer(b"".join(made), "<u2")
        cuts = np.append(0, np.cumsum(counts))
        out = {"doc_id": part["doc_id"], "n_tokens": counts}
        for name, pieces, comma in (("ids_sha256", known.decimals, 1), ("decoded_sha256", known.pieces, 0)):
            data, ends = pieces.joined(ids)
            places, view = np.append(0, ends)[cuts].tolist(), memoryview(data)
            out[name] = [hashlib.sha256(view[a:max(a, b - comma)]).hexdigest() for a, b in zip(places, places[1:])]
        return out

    return map_rows(rows, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", work, stateful=True)
