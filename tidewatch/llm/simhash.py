"""SimHash near-duplicates: a byte-position inverted index with count filtering.

Two fingerprints that differ in at most two bits share at least six of their eight
positional bytes, so they agree on at least one pair of their four two-byte blocks.
The index therefore posts each distinct fingerprint under the six pairs of blocks
(four positional bytes pinned at once: a single byte's list would hold a 256th of
all rows). Pairs meeting in a list are tallied on shared positional bytes, kept from
six on, and verified bit by bit. Lists longer than ``LONG_LIST`` are not paired up:
their fingerprints are linked exactly through the words one bit away from them (two
words lie within two bits exactly if they share such a neighbour), 65 keys each,
and no key can hold more than 65 distinct words.

Copies share a fingerprint and enter as one row. Links become components by
alternating star contractions, each round written to the shared folder.

Defined cases: null or empty texts have fingerprint zero, linked like any other;
1 or 2 words are one shingle; repeated rows give one row each; a null doc_id stays
null and is never the smallest of its component; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.common import DOCUMENT, KEY, keyed, map_rows, take
from tidewatch.session import materialise

BITS = 2
LONG_LIST = 48
BLOCK_PAIRS = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]


def shingle_hashes(text: str | None, width: int = 3, seed: int = 42) -> np.ndarray:
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = list(accumulate([len(w) + 1 for w in words]))
    digest = xxhash.xxh64_intdigest
    starts = [0, *ends]
    return np.array([digest(joined[a:b - 1], seed) for a, b in zip(starts, ends[width - 1:])], np.uint64)


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """For each array the word whose bits are set in over half of its values."""
    sizes = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(hashes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    values = np.concatenate([hashes[i] for i in full])
    # Eight one-byte counters per word hold up to 255 values, so rows are summed in runs of 255.
    sizes = sizes[full]
    runs = -(-sizes // 255)
    first_run = np.cumsum(runs) - runs
    at = np.cumsum(sizes) - sizes
    cuts = np.repeat(at, runs) + 255 * (np.arange(runs.sum()) - np.repeat(first_run, runs))
    low = np.uint64(0x0101010101010101)
    found = np.zeros(len(full), np.uint64)
    for bit in range(8):
        sums = np.add.reduceat((values >> np.uint64(bit)) & low, cuts)
        counts = np.add.reduceat(sums.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first_run, axis=0)
        over = 2 * counts > sizes[:, None]
        for byte in range(8):
            found |= over[:, byte].astype(np.uint64) << np.uint64(8 * byte + bit)
    out[full] = found
    return out


def fingerprints(docs: DataFrame, *kept: str) -> DataFrame:
    """doc_id, the columns ``kept``, and fp (the 64 bits as a signed long)."""
    def work(rows):
        prints = majority([shingle_hashes(t) for t in rows.pop("text")])
        return rows | {"fp": prints.view(np.int64)}

    types = dict(docs.dtypes)
    schema = "".join(f"{c} {types[c]}, " for c in ("doc_id", *kept)) + "fp bigint"
    return map_rows(docs.select("doc_id", *kept, "text"), schema, work)


def shared_bytes(difference):
    """How many of the eight positional bytes are equal."""
    return sum((F.shiftrightunsigned(difference, 8 * i).bitwiseAND(F.lit(255)) == 0).cast("int") for i in range(8))


def links(words: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` within two bits; a < b."""
    block = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    keys = [F.shiftleft(F.lit(k).cast("bigint"), 32).bitwiseOR(F.shiftleft(block[i], 16)).bitwiseOR(block[j])
            for k, (i, j) in enumerate(BLOCK_PAIRS)]
    posts = words.select("fp", F.explode(F.array(*keys)).alias("key"))
    lists = posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    listed = materialise(posts.join(lists, "key"))
    short = listed.where(F.col("n") <= LONG_LIST)
    a, b = short.select("key", F.col("fp").alias("a")), short.select("key", F.col("fp").alias("b"))
    differs = F.col("a").bitwiseXOR(F.col("b"))
    near = a.join(b, "key").where((F.col("a") < F.col("b")) & (shared_bytes(differs) >= 8 - BITS)
                                  & (F.bit_count(differs) <= BITS)).select("a", "b")
    crowded = listed.where(F.col("n") > LONG_LIST).select("fp").distinct()
    around = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint"))
                                    for i in range(64)])
    stars = (crowded.select("fp", F.explode(around).alias("middle")).groupBy("middle")
             .agg(F.array_sort(F.collect_list("fp")).alias("all")).where("size(all) > 1")
             .select(F.col("all")[0].alias("a"), F.explode(F.slice("all", 2, 65)).alias("b")))
    return near.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (a, b): root is the smallest node reachable."""
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        edges = materialise(small)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def classes(marks: DataFrame) -> DataFrame:
    """fp, root, component_id: the component of every distinct fingerprint of ``marks``."""
    words = marks.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(words.select("fp")))
    placed = words.join(roots, words.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return placed.join(smallest, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for every row of ``docs``."""
    marks = materialise(fingerprints(take(docs, doc_id="bigint", text="string")))
    return marks.join(classes(marks), "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each component stays: that with the smallest doc_id, then the smallest key of id and text.

    Null ids come after all others; of repeated rows one stays.
    """
    rows = keyed(take(docs, **DOCUMENT))
    marks = materialise(fingerprints(rows, *KEY))
    winners = (marks.join(classes(marks), "fp").groupBy("root")
               .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *KEY)).alias("w")).select("w.*").select(*KEY))
    return rows.join(winners, KEY, "left_semi").dropDuplicates(KEY).select(*DOCUMENT)
