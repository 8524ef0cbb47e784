"""Quality rules by cross-document line frequency.

Lines are normalised (ASCII lower case, runs of white space as one blank) and hashed.
For each host (the ``source`` column; null is a host of its own) the distinct
documents that hold a line are counted; lines in more than ``LINE_LIMIT`` of them are
removed as boilerplate. A document is depleted, and rejected, if less than
``LEAST_SHARE`` of its words or fewer than ``LEAST_WORDS`` words remain.

Two texts are one document if their normalised words are equal. A text with a line that is
neither common nor an edited common line has words of its own and counts by itself, however
much it shares. The others are told apart by the set of their common lines, an edited one
standing for the line it comes from, so edited copies of a text count as one and copying a
page does not make its sentences boilerplate. A line is an edited one if it shares
``EDIT_MARKS`` of ``MARKS`` min-hashes over three-word windows with common lines of its host: one
changed word in 15 is found with a chance of 0.97, two lines of 15 words that share one window
pass with a chance of 0.02.

Only line hashes and counts are shuffled, never texts: first every (text, line) once, to find
the lines that stand in more than ``LINE_LIMIT`` texts; after that only rows near those lines.
Bitmaps of fixed size, of the common lines and of their marks, pick these rows in the map;
the joins behind them are exact. Base rules (word count, share of words in repeated
five-word windows) are per document and come before.

Defined cases: a null or empty text has no words and is rejected; a text shorter than
five words is its own min-hash; an empty host is a host like any other, a null one another;
rows with equal id, text and host share one verdict and each give a row; lines without a word
are kept and count nothing; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm import bitmap
from tidewatch.llm.common import DOCUMENT, KEY, _schema, as_batch, map_rows, mixed, release, signed, take, to_arrow_schema, windows, word_hashes
from tidewatch.session import materialise

WINDOW = 5
LINE_LIMIT = 20
LEAST_SHARE = 0.2
LEAST_WORDS = 10
REPEAT_PERCENT = 20
MARKS, MARK_WINDOW, EDIT_MARKS = 6, 3, 2
SALTS = mixed(np.arange(1, MARKS + 1))
SYMBOLS = b"#*$%&|<>"


def repeated_words(hashes: np.ndarray) -> int:
    """Words covered by window hashes that occur twice or more."""
    if len(hashes) < 2:
        return 0
    ordered = np.sort(hashes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    again = np.isin(hashes, twice)
    ends = np.zeros(len(hashes) + WINDOW, np.int32)
    np.add.at(ends, np.flatnonzero(again), 1)
    np.add.at(ends, np.flatnonzero(again) + WINDOW, -1)
    return int((np.cumsum(ends) > 0).sum())


def line_key(line: bytes) -> bytes:
    return b" ".join(line.lower().split())


def line_marks(hashes: np.ndarray, sizes: list[int]) -> np.ndarray:
    """``MARKS`` min-hashes (32 bits) of each line over its word windows; ``sizes`` are the words of the lines, one at least."""
    if not sizes:
        return np.empty((0, MARKS), np.int32)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    last = np.repeat(np.maximum(ends - MARK_WINDOW, starts), sizes)  # where the last window of a word's line begins
    seen = windows(np.append(hashes, np.zeros(MARK_WINDOW - 1, np.uint64)), MARK_WINDOW)
    for at, size in zip(starts.tolist(), sizes):
        if size < MARK_WINDOW:  # a short line is one window
            seen[at] = windows(hashes[at:at + size], size)[0]
    beyond = np.arange(len(hashes)) > last
    out = np.empty((len(sizes), MARKS), np.uint32)
    for n, salt in enumerate(SALTS):
        values = mixed(seen ^ salt)
        values[beyond] = np.uint64(0xFFFFFFFFFFFFFFFF)
        out[:, n] = np.minimum.reduceat(values, starts) >> np.uint64(32)
    return out.view(np.int32)


def base_measures(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the lines with a word as lists of lower-case words."""
    text = text or ""
    data = text.encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (len(words), len(text) - len(data) + sum(map(len, words)), len(data) - len(data.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(windows(word_hashes(words), WINDOW)), [x.lower().split() for x in lines])


def host_key(host: str | None) -> int:
    return signed(xxhash.xxh3_64_intdigest(host.encode(), seed=1)) if host is not None else 0


def measures(text: str | None, host: int) -> tuple:
    """The five base measures, copy, line hashes (both of this host), words of each distinct line, and all their marks."""
    *base, lines = base_measures(text)
    digest = xxhash.xxh3_64_intdigest
    keys: dict[int, int] = {}
    held, sizes = [], []  # the words of the distinct lines
    for parts in lines:
        at = signed(digest(b" ".join(parts))) ^ host
        if at not in keys:
            held += parts
            sizes.append(len(parts))
        keys[at] = keys.get(at, 0) + len(parts)
    copy = signed(digest(b" ".join(w for parts in lines for w in parts))) ^ host
    return (*base, copy, list(keys), list(keys.values()), line_marks(word_hashes(held), sizes).ravel())


FIELDS = {"n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint",
          "n_repeat_words": "bigint", "copy": "bigint", "lines": "array<bigint>", "line_words": "array<int>",
          "marks": "array<int>"}


def rowed(docs: DataFrame) -> DataFrame:
    """The documents with ``KEY``, here of id, text and host."""
    return docs.select("*", F.xxhash64("doc_id", "text", "source").alias("_k"), F.hash("source", "text", "doc_id").alias("_k2"))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the row's key, host and ``FIELDS`` of every row; written once."""
    rows = rowed(take(docs, doc_id="bigint", text="string", source="string")).select("doc_id", *KEY, "source", "text")
    passed = ["doc_id", *KEY]
    schema = ", ".join(f"{c} {k}" for c, k in (dict(rows.select(*passed).dtypes) | {"host": "bigint"} | FIELDS).items())

    def work(part):
        hosts = [host_key(h) for h in part["source"]]
        made = list(zip(*(measures(t, h) for t, h in zip(part["text"], hosts))))
        return {c: part[c] for c in passed} | {"host": hosts} | dict(zip(FIELDS, made))

    return materialise(map_rows(rows, schema, work))


class Lines:
    """The lines of a batch of ``found``: the row of each, its hash, words and marks."""

    columns = ["host", "copy", "lines", "line_words", "marks", *KEY]

    def __init__(self, batch: pa.RecordBatch):
        host, copy, lines, words, marks, *self.key = (batch.column(k) for k in range(len(self.columns)))
        self.counts = lines.value_lengths().to_numpy(zero_copy_only=False)
        self.row = np.repeat(np.arange(batch.num_rows), self.counts)
        self.host, self.copy = host.to_numpy(), copy.to_numpy()
        self.line, self.words = lines.flatten().to_numpy(), words.flatten().to_numpy()
        self.marks = marks.flatten().to_numpy().reshape(-1, MARKS)

    def mark_keys(self, which: np.ndarray) -> np.ndarray:
        """64-bit keys of the marks of some lines: place, value and host."""
        values = self.marks[which].view(np.uint32).astype(np.uint64) << np.uint64(3) | np.arange(MARKS, dtype=np.uint64)
        return mixed(values ^ self.host[self.row[which]].view(np.uint64)[:, None])


def each_batch(found: DataFrame, schema: str, work: Callable[[Lines], dict]) -> DataFrame:
    arrow = to_arrow_schema(_schema(schema))

    def run(batches):
        release()
        for batch in batches:
            yield as_batch(work(Lines(batch)), arrow)

    return found.select(*Lines.columns).mapInArrow(run, schema)


def often(held: DataFrame, document: str) -> DataFrame:
    """The lines of the distinct rows (line, document) with more than ``LINE_LIMIT`` documents."""
    return held.groupBy("line").agg(F.count(document).alias("n")).where(F.col("n") > LINE_LIMIT).select("line")


def frequent_lines(found: DataFrame) -> DataFrame:
    """The lines in more than ``LINE_LIMIT`` distinct documents of a host."""
    held = found.select("copy", F.explode("lines").alias("line")).distinct()
    common = materialise(often(held, "copy"))
    places = lines_among(found, common).select("copy", "line").distinct()
    return often(places.join(told_apart(found, common, places), "copy").select("line", "document").distinct(), "document")


def lines_among(found: DataFrame, some: DataFrame) -> DataFrame:
    """``KEY``, copy, line, words of the lines of all rows that are among ``some``; written once."""
    bits = bitmap.shared(F.col("line"), some)

    def work(lines):
        at = np.flatnonzero(bitmap.holds(bits.value, lines.line))
        row = lines.row[at]
        return {c: k.take(row) for c, k in zip(KEY, lines.key)} | {"copy": lines.copy[row], "line": lines.line[at], "words": lines.words[at]}

    near = each_batch(found, "_k bigint, _k2 int, copy bigint, line bigint, words int", work)
    out = materialise(near.join(some, "line", "left_semi"))
    bits.drop()
    return out


def told_apart(found: DataFrame, common: DataFrame, places: DataFrame) -> DataFrame:
    """copy, document of every text of ``places``: the rows (copy, line) of the ``common`` lines."""
    bits = bitmap.shared(F.col("line"), common)

    def marks_of_common(lines):
        at = np.flatnonzero(bitmap.holds(bits.value, lines.line))
        at = at[np.unique(lines.line[at], return_index=True)[1]]
        return {"line": np.repeat(lines.line[at], MARKS), "mark": lines.mark_keys(at).ravel().view(np.int64)}

    marked = each_batch(found, "line bigint, mark bigint", marks_of_common)
    known = materialise(marked.join(common, "line", "left_semi").groupBy("mark").agg(F.min("line").alias("origin")))
    marks = bitmap.shared(F.col("mark"), known)

    def like_common(lines):
        """The number of lines of each text with a common line, and those of its lines with marks of common ones."""
        text = np.flatnonzero(np.bincount(lines.row, bitmap.holds(bits.value, lines.line), len(lines.counts)))
        held = np.zeros(len(lines.counts), bool)
        held[text] = True
        at = np.flatnonzero(held[lines.row])
        keys = lines.mark_keys(at)
        hit = bitmap.holds(marks.value, keys.ravel()).reshape(keys.shape)
        hit &= (hit.sum(axis=1) >= EDIT_MARKS)[:, None]
        n, _ = np.nonzero(hit)
        blank = [None] * len(text)
        return {"copy": np.concatenate([lines.copy[text], lines.copy[lines.row[at[n]]]]), "lines": [*lines.counts[text].tolist(), *[None] * len(n)],
                "line": [*blank, *lines.line[at[n]].tolist()], "mark": [*blank, *keys[hit].view(np.int64).tolist()]}

    near = materialise(each_batch(found, "copy bigint, lines int, line bigint, mark bigint", like_common))
    bits.drop()
    marks.drop()
    sizes = near.where("lines is not null").groupBy("copy").agg(F.max("lines").alias("size"))
    others = near.where("line is not null").join(common, "line", "left_anti").distinct()
    edited = others.join(known, "mark").groupBy("copy", "line").agg(F.count("*").alias("n"), F.min("origin").alias("origin")).where(F.col("n") >= EDIT_MARKS)
    parts = places.select("copy", F.col("line").alias("origin")).unionByName(edited.select("copy", "origin"))
    sets = (parts.groupBy("copy", "origin").agg(F.count("*").alias("n"))
            .groupBy("copy").agg(F.sum("n").alias("known"), F.bit_xor(F.xxhash64("origin")).alias("set")))
    own = F.col("known") < F.col("size")
    return sets.join(sizes, "copy").select("copy", F.struct(own.alias("own"), F.when(own, F.col("copy")).otherwise(F.col("set")).alias("id")).alias("document"))


def verdicts(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every row of ``found`` with base_failed, removed words and kept; and (key, line) of the removed lines."""
    removed = lines_among(found, materialise(frequent_lines(found))).select(*KEY, "line", "words").distinct()
    lost = removed.groupBy(*KEY).agg(F.sum("words").alias("lost"))
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    judged = (found.join(lost, KEY, "left").withColumn("removed_words", F.coalesce("lost", F.lit(0).cast("bigint")))
              .withColumn("base_failed", base)
              .withColumn("kept", ~base & (left >= LEAST_WORDS) & (left >= LEAST_SHARE * F.col("n_words"))))
    return judged, removed.select(*KEY, "line")


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, the base measures, base_failed, removed_words, kept."""
    rows, _ = verdicts(measured(docs))
    return rows.select("doc_id", *list(FIELDS)[:5], "base_failed", "kept", "removed_words")


def cleaned(docs: DataFrame) -> DataFrame:
    """The kept documents without their removed lines."""
    rows, removed = verdicts(measured(docs))
    kept = rows.where("kept").select(*KEY).distinct()
    cuts = removed.groupBy(*KEY).agg(F.collect_set("line").alias("cuts"))
    verdict = kept.join(cuts, KEY, "left")
    whole = rowed(take(docs, **DOCUMENT)).join(verdict, KEY)

    def work(part):
        texts = [strip_lines(t, host_key(h), c) if c else t for t, h, c in zip(part["text"], part["source"], part.pop("cuts"))]
        sizes = [n if t is o else len(t) for t, o, n in zip(texts, part["text"], part["n_chars"])]
        return part | {"text": texts, "n_chars": sizes}

    return map_rows(whole.select(*DOCUMENT, "cuts"), ", ".join(f"{c} {k}" for c, k in DOCUMENT.items()), work)


def strip_lines(text: str, host: int, cuts: list[int]) -> str:
    drop, digest = set(cuts), xxhash.xxh3_64_intdigest
    return "\n".join(x for x in text.split("\n")
                     if not x.encode().strip() or signed(digest(line_key(x.encode()))) ^ host not in drop)
