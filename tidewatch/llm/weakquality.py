"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or abstain on each document. Their votes overlap, so
an expectation-maximisation over the corpus-wide counts of vote patterns estimates how
each labeller votes on good and on bad documents, where it does, and gives every pattern the
probability of a good one. These posteriors, not hand labels, train a linear scorer over
hashed features: words, the shapes of words, and the shares of distinct and of repeated
words. The scorer is fitted to a bounded sample of documents; counts and scores cover all.

Defined cases: null and empty texts have no votes and score by the intercept and the
features of an empty text alone; the class of good documents is the one on which the
labellers vote good more often; if the sample holds one class only, or the table is
empty, every score is 1 and all rows are kept; repeated rows give one row each.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.common import DOCUMENT, SLICE_ROWS, map_rows, release, take, worker_state
from tidewatch.llm.linequality import base_measures
from tidewatch.llm.toxicity import Cache

BUCKETS = 1 << 17
#: Documents that the scorer is fitted to, about.
TRAINING_ROWS = 8_000
THRESHOLD = 0.35
#: Cached words of a worker.
CACHE_WORDS = 100_000
GOOD, BAD, ABSTAIN = 2, 1, 0

#: Frequent function words of the languages at hand.
FUNCTION_WORDS = frozenset(
    "the of and is to in that it for on with as was be by this are or an at from "
    "de la le les des et du un une en que qui dans pour sur par au aux est avec "
    "der die und den das von zu mit sich auf für ist im dem nicht ein eine als auch "
    "el los las del y se por con una su para es al lo como más".split())


def vote(good: bool, bad: bool) -> int:
    return GOOD if good else BAD if bad else ABSTAIN


def votes(text: str | None) -> list[int]:
    """One vote of each labeller; all abstain on a text without words."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [ABSTAIN] * 7
    _, chars, symbols, dup_lines, repeated, lines = base_measures(text)
    lines = set(map(tuple, lines))
    symbols, repeated = symbols / n, repeated / n
    shouted = sum(w.isupper() and len(w) > 1 for w in words) / n
    distinct = len(set(words)) / n
    function = sum(w.lower() in FUNCTION_WORDS for w in words) / n
    letters = sum(map(str.isalpha, text)) / max(1, chars)
    same = dup_lines / max(1, dup_lines + len(lines))
    long_enough = n >= 20
    return [
        vote(symbols <= 0.02, symbols > 0.1),
        vote(shouted <= 0.03, shouted > 0.3),
        vote(long_enough and repeated <= 0.05, repeated > 0.35),
        vote(long_enough and distinct >= 0.55, long_enough and distinct < 0.4),
        vote(function >= 0.08, long_enough and function < 0.03),
        vote(letters >= 0.9, long_enough and letters < 0.7),
        vote(len(lines) >= 3 and same <= 0.05, len(lines) >= 4 and same > 0.4),
    ]


def pattern_counts(docs: DataFrame) -> list[tuple[list[int], int]]:
    """Documents of the corpus by their votes; at most three to the number of labellers."""
    def run(batches):
        release()
        counts: dict[str, int] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                key = "".join(map(str, votes(text)))
                counts[key] = counts.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["votes", "n"])

    got = docs.select("text").mapInArrow(run, "votes string, n bigint").groupBy("votes").agg(F.sum("n").alias("n")).orderBy("votes").collect()
    return [([int(v) for v in r["votes"]], r["n"]) for r in got]


@dataclass
class Labelling:
    prior: float
    rates: np.ndarray  # class (bad, good), labeller, vote
    table: dict[tuple[int, ...], float] = field(default_factory=dict)

    def good(self, own: list[int]) -> float:
        return self.table.get(tuple(own), self.prior)


def estimate(patterns: list[tuple[list[int], int]], rounds: int = 200) -> Labelling:
    """Expectation-maximisation; starts from the number of bad votes."""
    own = np.array([p for p, _ in patterns], np.int64).reshape(len(patterns), -1)
    n = np.array([c for _, c in patterns], float)
    # Labellers call a text bad on extremes only, so at first a single such vote outweighs the others.
    good = np.where((own == BAD).any(axis=1), 0.25 ** (own == BAD).sum(axis=1), 0.9)
    prior, rates = 0.5, np.full((2, own.shape[1], 3), 1 / 3)
    for _ in range(rounds):
        for c, weight in enumerate((n * (1 - good), n * good)):
            for k in range(own.shape[1]):
                rates[c, k] = np.bincount(own[:, k], weight, minlength=3) + 1.0
        rates[:, :, ABSTAIN] = 0.0
        rates /= rates.sum(axis=2, keepdims=True)
        rates[:, :, ABSTAIN] = 1.0  # that a labeller has no opinion says nothing of the class
        prior = float((n * good).sum() + 1) / (n.sum() + 2)
        log = np.log(rates)
        columns = np.arange(own.shape[1])
        odds = math.log(prior / (1 - prior)) + (log[1, columns, own] - log[0, columns, own]).sum(axis=1)
        good, before = 1 / (1 + np.exp(-np.clip(odds, -30, 30))), good
        if np.abs(good - before).max(initial=0) < 1e-9:
            break
    if (rates[1, :, GOOD] - rates[0, :, GOOD]).sum() < 0:  # the classes came out the other way round
        good, rates, prior = 1 - good, rates[::-1], 1 - prior
    return Labelling(prior, rates, {tuple(p): float(g) for (p, _), g in zip(patterns, good)})


def shape(word: str) -> str:
    """X for upper case, x for other letters, 9 for digits, marks themselves; runs as one."""
    out = []
    for c in word:
        kind = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out)


def bucket(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode()) % BUCKETS


def word_buckets(word: str) -> int:
    """The buckets of the word and of its shape in one number, which a cache holds in little room."""
    return bucket("w" + word.lower()) * BUCKETS + bucket("s" + shape(word))


def word_cache() -> Cache:
    return Cache(word_buckets, CACHE_WORDS)


def features(text: str | None, cache: Cache) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values: roots of the shares of words and shapes, and three indicators."""
    words = (text or "").split()
    n = len(words)
    indicators = [bucket("n%d" % min(12, n.bit_length()))]
    if not n:
        return np.array(indicators), np.ones(1)
    indicators += [bucket("d%d" % int(10 * len(set(words)) / n)), bucket("r%d" % int(10 * sum(a == b for a, b in zip(words, words[1:])) / n))]
    pairs = np.array([cache[w] for w in words])
    at, counts = np.unique(np.concatenate([pairs // BUCKETS, pairs % BUCKETS]), return_counts=True)
    return np.concatenate([at, indicators]), np.concatenate([np.sqrt(counts / n), np.ones(len(indicators))])


def fit(rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, rounds: int = 150, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, both classes of equal weight; gradient steps scaled per bucket."""
    sizes = np.array([len(a) for a, _ in rows])
    at, values = np.concatenate([a for a, _ in rows]), np.concatenate([v for _, v in rows])
    starts, row = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(rows)), sizes)
    weight = good / (2 * good.sum()) + (1 - good) / (2 * (1 - good).sum())
    w, b, seen, seen_b = np.zeros(BUCKETS), 0.0, np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(w[at] * values, starts) + b, -30, 30)))
        error = weight * (p - good)
        slope = np.bincount(at, values * error[row], minlength=BUCKETS) + ridge * w / BUCKETS
        seen += slope * slope
        seen_b += error.sum() ** 2
        w -= 0.5 * slope / np.sqrt(seen)
        b -= 0.5 * error.sum() / math.sqrt(seen_b)
    return w.astype(np.float32), float(b)


def train(docs: DataFrame) -> tuple[np.ndarray, float] | None:
    """Weights and intercept of the scorer, learned from ``docs`` alone."""
    texts = take(docs, text="string")
    patterns = pattern_counts(texts)
    total = sum(n for _, n in patterns)
    if not total:
        return None
    labelling = estimate(patterns)
    share = math.ceil(min(1.0, TRAINING_ROWS / total) * (1 << 20))
    # Rows are chosen by a hash of their text, so the sample is the same on every run and holds a text and its copies or neither.
    sample = texts.where(F.pmod(F.xxhash64(F.lit("quality"), "text"), 1 << 20) < share).dropDuplicates(["text"])

    def work(part):
        cache = word_cache()
        made = [features(t, cache) for t in part["text"]]
        return {"at": [a.tolist() for a, _ in made], "value": [v.tolist() for _, v in made], "good": [labelling.good(votes(t)) for t in part["text"]]}

    got = map_rows(sample, "at array<int>, value array<float>, good double", work).toArrow()
    good = got.column("good").to_numpy()
    if not len(good) or good.max() < 0.5 or good.min() > 0.5:
        return None
    at, value = got.column("at").combine_chunks(), got.column("value").combine_chunks()
    cuts = at.offsets.to_numpy()
    flat, values = at.flatten().to_numpy(), value.flatten().to_numpy()
    rows = [(flat[a - cuts[0]:b - cuts[0]], values[a - cuts[0]:b - cuts[0]]) for a, b in zip(cuts[:-1], cuts[1:])]
    return fit(rows, good)


def score_of(text: str | None, weights: np.ndarray, intercept: float) -> float:
    at, values = features(text, worker_state("word buckets", word_cache))
    z = float(weights[at] @ values) + intercept
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def scored(docs: DataFrame, model: tuple[np.ndarray, float] | None) -> DataFrame:
    """doc_id, score, kept of every row."""
    rows = take(docs, doc_id="bigint", text="string")
    if model is None:
        return rows.select("doc_id", F.lit(1.0).alias("score"), F.lit(True).alias("kept"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(part):
        scores = [score_of(t, *shared.value) for t in part["text"]]
        return {"doc_id": part["doc_id"], "score": scores, "kept": [s >= THRESHOLD for s in scores]}

    return map_rows(rows, "doc_id bigint, score double, kept boolean", work, stateful=True)


def filtered(docs: DataFrame) -> DataFrame:
    """The documents that the scorer keeps, unchanged."""
    model = train(docs)
    rows = take(docs, **DOCUMENT)
    if model is None:
        return rows
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            place = batch.schema.get_field_index("text")
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                yield part.filter(pa.array([score_of(t, *shared.value) >= THRESHOLD for t in part.column(place).to_pylist()], pa.bool_()))

    return rows.mapInArrow(run, rows.schema)
