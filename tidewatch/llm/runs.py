"""Periodic runs of words, by recursive frequency splitting and a lag scan.

A run is a stretch of words with smallest period q, at least max(``LEAST_WORDS``,
``LEAST_EXPONENT`` * q) long, that no neighbouring word extends. Each of its words stands
in it ``LEAST_EXPONENT`` times or more, so a word that occurs less often within a segment
lies in no run there and splits the segment. The parts are counted and split again until
nothing changes; ordinary prose leaves nothing. All texts of a slice are split together.

In a segment that is left, words q apart are compared for every lag q up to a
``LEAST_EXPONENT``th of its length. A run of period q holds so many equal pairs in a row
that every stretch of lag q is probed at that distance only: n/1 + n/2 + ... probes, n log n
in all. A probe that sits among equal pairs is extended word by word to both ends. Lags go
up, so the smallest period of a stretch is found first.

Each text is worked on by itself in the task that reads it: nothing is shuffled, and a
text of any length costs n log n.

Defined cases: null, empty and blank texts have no words and no runs; repeated rows give
one row each; a null doc_id is kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame

from tidewatch.llm.common import map_rows, take

LEAST_WORDS = 6
LEAST_EXPONENT = 4
#: Lags whose probes are made at a time.
LAGS = 1 << 12
#: Words compared in one step where a run is extended.
STRIDE = 64

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def segments(words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int]]:
    """Stretches [from, to) of ``words`` that may hold runs; ``bounds`` are the ends of the texts in it."""
    at = np.arange(len(words))
    part = np.searchsorted(bounds, at, side="right")
    while len(at):
        _, place, counts = np.unique(part << 32 | words[at], return_inverse=True, return_counts=True)
        kept = counts[place] >= LEAST_EXPONENT
        left, old = at[kept], part[kept]
        fresh = np.ones(len(left), bool)
        fresh[1:] = (left[1:] != left[:-1] + 1) | (old[1:] != old[:-1])
        new = np.cumsum(fresh) - 1
        long = (np.bincount(new) >= LEAST_WORDS)[new]
        if kept.all() and long.all():
            break
        at, part = left[long], new[long]
    if not len(at):
        return []
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    last = np.append(first[1:], len(at)) - 1
    return list(zip(at[first].tolist(), (at[last] + 1).tolist()))


def run_spans(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of one segment, by start and period."""
    n = len(words)
    found: dict[tuple[int, int], int] = {}
    last: dict[int, int] = {}  # where the last run of a lag ends
    for low in range(1, n // LEAST_EXPONENT + 1, LAGS):
        for q, t in zip(*probes(words, low, min(low + LAGS, n // LEAST_EXPONENT + 1))):
            if t < last.get(q, 0):
                continue
            start, end = extended(words, q, t)
            last[q] = end - q
            if end - start >= max(LEAST_WORDS, LEAST_EXPONENT * q) and (start, end) not in found:
                found[start, end] = q
    return sorted((start, end - start, q) for (start, end), q in found.items())


def probes(words: np.ndarray, low: int, high: int) -> tuple[list[int], list[int]]:
    """Lags and places whose word, and two more in a row with it, equal those a lag on; in order."""
    n = len(words)
    lags = np.arange(low, high)
    # A run of period q has this many equal pairs in a row, so one of them is a multiple of it.
    steps = np.maximum(LEAST_WORDS, LEAST_EXPONENT * lags) - lags
    counts = -(-(n - lags) // steps)
    ends = np.cumsum(counts)
    q = np.repeat(lags, counts)
    t = (np.arange(ends[-1]) - np.repeat(ends - counts, counts)) * np.repeat(steps, counts)

    def same(q, t):
        ok = (t >= 0) & (t + q < n)
        return ok & (words[np.where(ok, t, 0)] == words[np.where(ok, t + q, 0)])

    hit = same(q, t)
    q, t = q[hit], t[hit]
    after, before = same(q, t + 1), same(q, t - 1)
    near = after & before | after & same(q, t + 2) | before & same(q, t - 2)
    return q[near].tolist(), t[near].tolist()


def extended(words: np.ndarray, q: int, t: int) -> tuple[int, int]:
    """The longest stretch [start, end) of period ``q`` around the equal pair at ``t``."""
    n = len(words)
    end, step = t + q, STRIDE
    while end < n:
        top = min(n, end + step)
        other = words[end:top] != words[end - q:top - q]
        if other.any():
            end += int(other.argmax())
            break
        end, step = top, 2 * step
    start, step = t, STRIDE
    while start > 0:
        low = max(0, start - step)
        other = (words[low:start] != words[low + q:start + q])[::-1]
        if other.any():
            start -= int(other.argmax())
            break
        start, step = low, 2 * step
    return start, end


def found_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given as its words."""
    place: dict[bytes, int] = {}
    words = np.array([place.setdefault(w, len(place)) for t in texts for w in t], np.int64)
    ends = np.cumsum([len(t) for t in texts])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for low, high in segments(words, ends):
        text = int(np.searchsorted(ends, low, side="right"))
        first = int(ends[text]) - len(texts[text])
        out[text] += [(low - first + start, length, q) for start, length, q in run_spans(words[low:high])]
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    kept = np.ones(len(words), bool)
    for start, length, q in runs:
        kept[start + q:start + length] = False
    return [w for w, k in zip(words, kept.tolist()) if k]


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with a period planted in every tenth document, as the query's contract states; others are returned as they are."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


def runs(docs: DataFrame, planted: bool = False) -> DataFrame:
    """doc_id, runs (as in ``RUNS``), and text: the words that are left, joined by blanks. ``planted``: after ``looped``."""
    def work(part):
        texts = [(t or "").encode().split() for t in part["text"]]
        if planted:
            texts = [looped(i, t) for i, t in zip(part["doc_id"], texts)]
        found = found_runs(texts)
        named = [[{"start": a, "length": n, "period": q} for a, n, q in f] for f in found]
        return {"doc_id": part["doc_id"], "runs": named, "text": [b" ".join(collapsed(t, f)).decode() for t, f in zip(texts, found)]}

    return map_rows(take(docs, doc_id="bigint", text="string"), f"doc_id bigint, runs {RUNS}, text string", work)
