"""Toxicity by maximum-scoring segments.

Tokens are lower-cased words and their first five and four letters, hashed into
``BUCKETS``. From the labelled training rows each bucket gets the log-odds of its
document rates in toxic and other rows under a Dirichlet prior proportional to the
corpus rate. A bucket counts if its rows are toxic too often for chance: the tail of the
binomial distribution, by Chernoff's bound, times the buckets tried is below one. Its
score is the log-odds plus that of the classes, positive only where the word alone makes
the label likelier than not; all others score the neutral, negative value. A word
scores the best of its three buckets.

The Ruzzo-Tompa scan then finds all maximal segments of a text in linear time. A
segment's E-value is ``K n exp(-lambda S)`` with lambda solving E[exp(lambda s)] = 1
over the token scores of clean rows. The evidence of the significant segments
(those with E below 1, and the best one) becomes a score in 0..1 by a logistic
curve fitted to a bounded sample of training rows.

Defined cases: null and empty texts have no segment and score what a text without
evidence scores; without training rows of both classes every score is 0; repeated
rows give one row each; labels that are null or repeated with both values are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.common import Shared, map_rows, release, sketch, take, worker_state
from tidewatch.session import materialise

BUCKETS = 1 << 20
PRIOR_SHARE = 0.05
#: Labelled rows to learn from, at most, taken in hash order of their ids; their ids are broadcast, 16 bytes each.
TRAINING_ROWS = 100_000
#: Rows the logistic curve is fitted to, about.
CALIBRATION_ROWS = 20_000
#: Cached words of a worker; the cache starts anew beyond it.
CACHE_WORDS = 300_000
EDGES = ".,;:!?\"'()[]{}<>|*#$%&-_=+/\\"


def buckets_of(word: str) -> tuple[int, ...]:
    """The buckets of a lower-cased word: itself, its first five and its first four letters."""
    bare = word.strip(EDGES)
    if not bare:
        return ()
    units = {bare, "5" + bare[:5], "4" + bare[:4]} if len(bare) > 3 else {bare}
    return tuple(sorted(xxhash.xxh3_64_intdigest(u.encode()) % BUCKETS for u in units))


class Cache(dict):
    """word -> value, computed when first asked for."""

    def __init__(self, make, limit: int = CACHE_WORDS):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.make(word)
        return value


@dataclass
class Model:
    scores: np.ndarray  # by bucket
    neutral: float      # of a word without a bucket
    decay: float        # lambda
    scale: float        # K
    rows: int           # learned from
    curve: tuple[float, ...] = ()


def bucket_counts(labelled: DataFrame) -> DataFrame:
    """bucket, clean, toxic: documents of ``labelled`` (text, toxic) that hold the bucket; all documents as bucket ``BUCKETS``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        cache = Cache(buckets_of)
        counts = np.zeros((2, BUCKETS + 1), np.int32)
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held = {b for w in set((text or "").lower().split()) for b in cache[w]}
                counts[toxic, list(held)] += 1
                counts[toxic, BUCKETS] += 1
        for toxic in (0, 1):
            at = np.flatnonzero(counts[toxic])
            for k in range(0, len(at), 1 << 16):
                part = at[k:k + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.astype(np.int32)), pa.array(np.full(len(part), toxic, np.int32)),
                     pa.array(counts[toxic, part].astype(np.int64))], names=["bucket", "toxic", "n"])

    parts = labelled.select("text", "toxic").mapInArrow(run, "bucket int, toxic int, n bigint")
    of = lambda label: F.coalesce(F.sum(F.when(F.col("toxic") == label, F.col("n"))), F.lit(0))
    return parts.groupBy("bucket").agg(of(0).alias("clean"), of(1).alias("toxic"))


def fit_scores(counted: DataFrame) -> Model | None:
    """The token scores from ``bucket_counts``; None without both classes.

    Only buckets that count come to the driver, at most ``BUCKETS`` numbers.
    """
    rows = counted.where(F.col("bucket") == BUCKETS).first()
    if rows is None or not rows["clean"] or not rows["toxic"]:
        return None
    mass = PRIOR_SHARE * (rows["clean"] + rows["toxic"])
    base = math.log(rows["toxic"] / rows["clean"])
    neutral = min(-0.5, base)
    prior = PRIOR_SHARE * (F.col("clean") + F.col("toxic"))
    a, b = F.col("toxic") + prior, F.col("clean") + prior
    odds = F.log(a / (rows["toxic"] + mass)) - F.log(b / (rows["clean"] + mass))
    tokens = counted.where(F.col("bucket") < BUCKETS)
    tried, clean_sum = tokens.agg(F.count(F.when(F.col("toxic") > 0, 1)), F.sum("clean")).first()
    chance = rows["toxic"] / (rows["clean"] + rows["toxic"])
    share = F.col("toxic") / (F.col("clean") + F.col("toxic"))
    surprise = F.col("toxic") * F.log(share / chance) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - share) / (1 - chance))).otherwise(0.0)
    scored = tokens.withColumn("score", odds + base)
    told = scored.where((F.col("toxic") > 0) & (share > chance) & (surprise > math.log(max(2, tried))) & (F.col("score") > 0)).toArrow()
    scores = np.full(BUCKETS, neutral, np.float32)
    gains, toxic, clean = (told.column(c).to_numpy().astype(float) for c in ("score", "toxic", "clean"))
    scores[told.column("bucket").to_numpy()] = gains
    # How often a clean row's token has a positive score; half a count keeps it above zero.
    rate = (clean.sum() + 0.5) / (clean_sum + 1.0)
    typical = float(np.average(gains, weights=toxic)) if len(gains) else 1.0
    return Model(scores, neutral, decay(rate, typical, neutral), 0.3, rows["clean"] + rows["toxic"])


def decay(rate: float, gain: float, loss: float) -> float:
    """The positive lambda with rate*exp(lambda*gain) + (1-rate)*exp(lambda*loss) = 1."""
    low, high = 1e-6, 50.0
    for _ in range(80):
        at = (low + high) / 2
        value = rate * math.exp(min(700.0, at * gain)) + (1 - rate) * math.exp(at * loss)
        low, high = (at, high) if value < 1 else (low, at)
    return low


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, total), by Ruzzo and Tompa's linear scan."""
    before = np.concatenate(([0.0], np.cumsum(scores, dtype=np.float64)))
    found: list[list] = []  # start, end, total before it, total after it, index of the last one with a smaller left total
    for i in np.flatnonzero(scores > 0).tolist():
        start, end, left, right = i, i + 1, before[i], before[i + 1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                found.append([start, end, left, right, j])
                break
            start, left = found[j][0], found[j][2]
            del found[j:]
    return [(s, e, r - l) for s, e, l, r, _ in found]


def evidence(model: Model, cache: Cache, text: str | None) -> tuple[list[tuple[int, int, float, float]], list[float]]:
    """The segments (first word, end, total, log of its E-value), and the features of the curve."""
    words = (text or "").lower().split()
    if not words:
        return [], [0.0, 0.0, 0.0]
    scores = np.array([cache[w] for w in words])
    size = math.log(model.scale * len(words))
    spans = [(s, e, t, size - model.decay * t) for s, e, t in maximal_segments(scores)]
    strong = sorted((x[3] for x in spans))
    best = max(0.0, -strong[0] + size) if strong else 0.0  # lambda S of the best segment
    kept = [t for _, _, t, log_e in spans if log_e < 0] or [x[2] for x in spans]
    return spans, [math.log1p(sum(kept)), min(best, 60.0) / 10, max(0.0, min(-strong[0], 30.0)) / 10 if strong else 0.0]


def word_score(model: Model) -> Cache:
    def make(word):
        held = buckets_of(word)
        return float(max(model.scores[list(held)])) if held else model.neutral

    return Cache(make)


def fit_curve(features: np.ndarray, labels: np.ndarray, rounds: int = 60, ridge: float = 1e-2) -> tuple[float, ...]:
    """Logistic regression by Newton steps; the rows are few and the features three."""
    x = np.column_stack([np.ones(len(features)), features])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (labels - p) - ridge * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(w.tolist())


def train(docs: DataFrame, labels: DataFrame, usable) -> Model | None:
    """Fit on the labelled rows for which ``usable`` (a column of doc_id) holds."""
    spark = docs.sparkSession
    marks = (take(labels, doc_id="bigint", toxic="int").where("toxic in (0, 1) and doc_id is not null")
             .groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most"))
             .where("toxic = _most").drop("_most").where(usable)
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING_ROWS))
    rows = take(docs, doc_id="bigint", text="string").join(F.broadcast(marks), "doc_id").select("doc_id", "text", "toxic")
    # Copies and near copies under one label count once: their words are no independent evidence.
    rows = map_rows(rows, "doc_id bigint, text string, toxic int, sketch bigint",
                    lambda part: part | {"sketch": [sketch(t) for t in part["text"]]})
    rows = materialise(rows.dropDuplicates(["sketch", "toxic"]).drop("sketch"))
    model = fit_scores(materialise(bucket_counts(rows)))
    if model is None:
        return None
    shared = spark.sparkContext.broadcast(model)
    # A hash of the id makes the bounded sample the same on every run.
    share = min(1.0, CALIBRATION_ROWS / model.rows)
    sample = rows.where(F.pmod(F.xxhash64(F.lit("curve"), "doc_id"), 1 << 20) < math.ceil(share * (1 << 20)))

    def features(part):
        own, cache = shared.value, word_score(shared.value)
        return {"f": [evidence(own, cache, t)[1] for t in part["text"]], "toxic": part["toxic"]}

    seen = map_rows(sample.select("text", "toxic"), "f array<double>, toxic int", features).toArrow()
    model.curve = fit_curve(np.array(seen.column("f").to_pylist()), seen.column("toxic").to_numpy().astype(float))
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, and the significant passages (first word, end, total score)."""
    picked = take(docs, doc_id="bigint", text="string")
    schema = "doc_id bigint, score double, passages array<struct<start:int,end:int,total:double>>"
    if model is None:
        return picked.select("doc_id", F.lit(0.0).alias("score"),
                             F.expr("cast(array() as array<struct<start:int,end:int,total:double>>)").alias("passages"))
    shared = Shared(docs.sparkSession.sparkContext.broadcast(model))

    def work(part):
        own = shared.value
        cache = worker_state(("toxic words", shared.id), lambda: word_score(own))
        scores, passages = [], []
        for text in part["text"]:
            spans, f = evidence(own, cache, text)
            z = own.curve[0] + sum(c * v for c, v in zip(own.curve[1:], f))
            scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            passages.append([{"start": s, "end": e, "total": t} for s, e, t, log_e in spans if log_e < 0])
        return {"doc_id": part["doc_id"], "score": scores, "passages": passages}

    return map_rows(picked, schema, work, stateful=True)
