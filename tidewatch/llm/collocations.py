"""Phrase collocation mining on a weighted de Bruijn graph.

Texts are cut at punctuation and line ends into pieces and those into words; everything is
per language. Nodes are runs of ``ORDER - 1`` words, edges are runs of ``ORDER`` words with
their number of occurrences. Where a piece ends, the run is filled up with blanks: these
edges into the end are the corrections that make a node's count the sum of its outgoing
edges. So the counts of runs of three words or more follow from the edges.

Words that stand together less than ``least`` times are in no phrase together, so an edge ends
between them. All neighbours of the corpus are counted first, with the kind of the word that comes
next: a part of its key. This is one row for each place of the corpus, less those that repeat within a task, so
it grows as the corpus does. What reaches ``least`` gives the counts of two words, and three words whose
kind reaches it go to the tasks as a bitmap of fixed size: only they make edges. A kind, or the bitmap, that
lets others through by chance only adds edges that are counted and dropped. Single words are
counted with their spelling in a pass of their own. All these are added up in the task before
they are shuffled, so a passage repeated everywhere is one row a task.

A run of words is absorbed by a longer one that holds it as often as it occurs: on that side its
node has one edge with all its flow. Edges that follow each other through such nodes are
compacted into paths by doubling; a path is a passage that always occurs as a whole.

A word is known by a 64-bit hash of it and its language, so two of m words fall together with
a chance of m * m / 2 ** 65.

Defined cases: a null language is ``NO_LANGUAGE``; null, empty and blank texts have no words; ties
in score go to the more frequent phrase, then to the smaller one in byte order; repeated rows
count each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.llm import bitmap
from tidewatch.llm.common import SLICE_ROWS, Shared, as_batch, in_parts, mixed, release, take, to_arrow_schema, _schema
from tidewatch.llm.wordtable import hashes, split
from tidewatch.session import materialise

ORDER = 5
LEAST = 100
TOP = 2000
NO_LANGUAGE = "und"
#: Letters A to Z in lower case, what ends a piece as a line end, a tab as a blank.
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
#: Bytes of text worked on at a time; a longer text is cut between pieces.
BLOCK = 2 << 20
#: Pairs and edges that a task adds up before it hands them on.
BUFFER = 2_000_000
#: Distinct words that a task adds up before it hands them on.
VOCABULARY = 300_000
#: Rows of a batch that a task hands on.
ROWS = 1 << 15
GRAM = [f"w{k}" for k in range(1, ORDER + 1)]
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Kinds of words that follow two others: a part of their keys, the end of a piece, and any of these.
END, ANY = 1 << 16, -1


class Block:
    """The words of some texts: keys by language, and the piece each stands in."""

    def __init__(self, texts: list[tuple[bytes, int]], languages: np.ndarray):
        self.data = b"\n".join(t for t, _ in texts)
        starts, sizes = split(self.data, b" \n")
        ends = np.frombuffer(self.data, np.uint8)[starts[1:] - 1] == 10
        pieces = np.concatenate(([0], np.cumsum(ends)))
        held = sizes > 0
        self.starts, self.sizes, self.pieces = starts[held], sizes[held], pieces[held]
        begins = np.cumsum([0] + [len(t) + 1 for t, _ in texts])[:-1]
        self.owners = np.searchsorted(begins, self.starts, side="right") - 1
        self.languages = np.array([n for _, n in texts], np.int64)[self.owners] if texts else np.zeros(0, np.int64)
        keys, _ = hashes(self.data, self.starts, self.sizes, np.zeros(len(self.starts), np.int64))
        self.keys = np.maximum(mixed(keys ^ languages[self.languages]), np.uint64(1))  # 0 is the end of a piece


    def follows(self) -> np.ndarray:
        """Whether a word is followed by another of its piece."""
        return self.pieces[1:] == self.pieces[:-1]

    def kinds(self) -> np.ndarray:
        """The kind of the word after the next, for every word but the last."""
        out = np.full(max(len(self.keys) - 1, 0), END, np.int64)
        held = np.flatnonzero(self.pieces[2:] == self.pieces[:-2])
        out[held] = (self.keys[held + 2] & np.uint64(END - 1)).astype(np.int64)
        return out

    def triples(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether a word is followed by two others of its piece, and the hashes of all three neighbours."""
        first, second, third = self.keys[:-2], self.keys[1:-1], self.keys[2:]
        turned = second << np.uint64(29) | second >> np.uint64(35)
        return self.pieces[2:] == self.pieces[:-2], first ^ turned ^ (third & np.uint64(END - 1)) << np.uint64(48)

    def word(self, at: int) -> str:
        return self.data[self.starts[at]:self.starts[at] + self.sizes[at]].decode()


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, list[str]]]:
    """The words of all rows (text, lang) in blocks of bounded size, and the languages met so far."""
    names: list[str] = []
    place: dict[str, int] = {}
    keys = np.zeros(0, np.uint64)
    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            for text, name in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if name not in place:
                    place[name] = len(names)
                    names.append(name)
                    keys = np.append(keys, np.uint64(xxhash.xxh3_64_intdigest(name.encode())))
                data = (text or "").encode().translate(PLAIN)
                while data:
                    cut = len(data) if len(data) <= BLOCK else data.rfind(b"\n", 0, BLOCK)
                    cut = cut if cut > 0 else data.find(b"\n", BLOCK) if len(data) > BLOCK else cut
                    cut = cut if cut > 0 else len(data)
                    held.append((data[:cut], place[name]))
                    size, data = size + cut, data[cut:]
                    if size >= BLOCK:
                        yield Block(held, keys), names
                        held, size = [], 0
    if held:
        yield Block(held, keys), names


def languages(docs: DataFrame) -> DataFrame:
    return take(docs, text="string", lang="string").withColumn("lang", F.coalesce("lang", F.lit(NO_LANGUAGE)))


def added_rows(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of ``columns`` and how often each occurs; equal first words side by side, which shuffles in less room."""
    with np.errstate(over="ignore"):
        total = columns[0]
        for c in columns[1:]:
            total = mixed(total * FACTOR + c)
    total = columns[0] >> np.uint64(48) << np.uint64(48) | total >> np.uint64(16)
    order = np.argsort(total)
    total, rows = total[order], [c[order] for c in columns]
    same = total[1:] == total[:-1]
    if any((c[1:] != c[:-1])[same].any() for c in rows):  # two rows with one hash
        whole, n = np.unique(np.stack(columns, axis=1), axis=0, return_counts=True)
        return list(whole.T), n
    begins = np.flatnonzero(np.concatenate(([True], ~same)))
    return [c[begins] for c in rows], np.diff(begins, append=len(total))


NEXT = "w1 bigint, w2 bigint, next int, n bigint"


def frequent_pairs(texts: DataFrame, least: int) -> DataFrame:
    """``NEXT`` of the neighbours that occur ``least`` times or more, and of the kinds of words that follow them as often.

    A row with the kind ``ANY`` is the count of the two words. The kind of a third word is a part of its key, so the
    count of a kind is at least that of each of its words.
    """
    names = ["w1", "w2", "next", "n"]

    def run(batches):
        release()
        held: list[list[np.ndarray]] = []
        count = 0

        def added():
            (first, second, kinds), n = added_rows([np.concatenate([h[k] for h in held]) for k in range(3)])
            return in_parts(pa.RecordBatch.from_arrays([
                pa.array(np.ascontiguousarray(first).view(np.int64)), pa.array(np.ascontiguousarray(second).view(np.int64)),
                pa.array(kinds.astype(np.int32)), pa.array(n)], names=names))

        for block, _ in blocks(batches):
            at = np.flatnonzero(block.follows())
            held.append([block.keys[at], block.keys[at + 1], block.kinds()[at].astype(np.uint64)])
            count += len(at)
            if count >= BUFFER:
                yield from added()
                held, count = [], 0
        if count:
            yield from added()

    # Dealt by the two words, so that their own count needs no other shuffle.
    counts = texts.mapInArrow(run, NEXT).repartition("w1", "w2").groupBy("w1", "w2", "next").agg(F.sum("n").alias("n"))
    kinds = F.when((F.col("next") != END) & (F.col("n") >= least), F.array(F.lit(ANY), "next")).otherwise(F.array(F.lit(ANY)))
    return counts.select("w1", "w2", F.explode(kinds).alias("next"), "n").groupBy("w1", "w2", "next").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def triple_hash() -> Column:
    """What ``Block.triples`` makes of the keys of two words and the kind of a third."""
    turned = F.shiftleft("w2", 29).bitwiseOR(F.shiftrightunsigned("w2", 35))
    return F.col("w1").bitwiseXOR(turned).bitwiseXOR(F.shiftleft(F.col("next").cast("bigint"), 48))


WORDS = "key bigint, n bigint, lang string, word string"


def frequent_words(texts: DataFrame, least: int) -> DataFrame:
    """``WORDS`` that occur ``least`` times or more; a row without a word is the number of all words of its language."""
    arrow = to_arrow_schema(_schema(WORDS))

    def run(batches):
        release()
        counts: dict[int, int] = {}
        spelled: dict[int, tuple[str, str]] = {}
        sizes: dict[str, int] = {}

        def added():
            rows = [(key, n, *spelled[key]) for key, n in counts.items()]
            for low in range(0, len(rows), ROWS):
                yield as_batch(dict(zip(arrow.names, zip(*rows[low:low + ROWS]))), arrow)

        for block, names in blocks(batches):
            for number, n in enumerate(np.bincount(block.languages, minlength=0).tolist()):
                sizes[names[number]] = sizes.get(names[number], 0) + n
            keys, first, n = np.unique(block.keys.view(np.int64), return_index=True, return_counts=True)
            for key, at, m in zip(keys.tolist(), first.tolist(), n.tolist()):
                if key in counts:
                    counts[key] += m
                else:
                    counts[key] = m
                    spelled[key] = names[block.languages[at]], block.word(at)
            if len(counts) >= VOCABULARY:
                yield from added()
                counts.clear()
                spelled.clear()
        yield from added()
        made = [(0, n, lang, None) for lang, n in sizes.items()]
        yield as_batch(dict(zip(arrow.names, zip(*made))) if made else {c: [] for c in arrow.names}, arrow)

    every = texts.mapInArrow(run, WORDS)
    # The rows of the languages have the key 0, so they are told apart by language; there is one word to another key.
    found = every.groupBy("key", F.when(F.col("key") == 0, F.col("lang")).alias("of")).agg(
        F.sum("n").alias("n"), F.min("lang").alias("lang"), F.min("word").alias("word"))
    return found.where((F.col("n") >= least) | F.col("word").isNull()).drop("of")


EDGES = ", ".join(f"{w} bigint" for w in GRAM) + ", n bigint"


def edges(texts: DataFrame, triples: Shared) -> DataFrame:
    """Edges (words, blanks as 0) and their counts, from every word that begins three neighbours of ``triples``."""
    names = [*GRAM, "n"]

    def run(batches):
        release()
        held: list[list[np.ndarray]] = []
        count = 0

        def added():
            grams, n = added_rows([np.concatenate([h[k] for h in held]) for k in range(ORDER)])
            return in_parts(pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(g).view(np.int64)) for g in grams), pa.array(n)], names=names))

        for block, _ in blocks(batches):
            follow, hashed = block.triples()
            linked = np.zeros(len(block.keys) + ORDER, bool)
            linked[:len(hashed)] = follow & bitmap.holds(triples.value, hashed)
            at = np.flatnonzero(linked)
            keys = np.append(block.keys, np.zeros(ORDER, np.uint64))
            grams, on = [keys[at], keys[at + 1], keys[at + 2]], np.ones(len(at), bool)
            for k in range(1, ORDER - 2):
                on = on & linked[at + k]
                grams.append(np.where(on, keys[at + k + 2], np.uint64(0)))
            held.append(grams)
            count += len(at)
            if count >= BUFFER:
                yield from added()
                held, count = [], 0
        if count:
            yield from added()

    return texts.mapInArrow(run, EDGES)


def counted(graph: DataFrame, pairs: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """(words, f) of all runs of up to ``ORDER`` words that occur ``least`` times or more.

    The count of a run of three words or more is the sum of the edges that begin with it, those that end early among them.
    One plan for all sizes, as a union of levels would read the texts once each.
    """
    alone = words.where("word is not null").select(F.array("key").alias("words"), F.col("n").alias("f"))
    two = pairs.where(F.col("next") == ANY).select(F.array("w1", "w2").alias("words"), F.col("n").alias("f"))
    zero = F.lit(0).cast("bigint")
    d, e = (F.col(w) for w in GRAM[3:])
    # Edges that begin with the same three words are dealt together: the runs of three to five words need no other shuffle.
    parts = F.array_compact(F.array(F.struct(zero.alias("d"), zero.alias("e"), F.lit(3).alias("size")),
                                    F.when(d != 0, F.struct(d.alias("d"), zero.alias("e"), F.lit(4).alias("size"))),
                                    F.when(e != 0, F.struct(d.alias("d"), e.alias("e"), F.lit(5).alias("size")))))
    whole = graph.repartition(*GRAM[:3]).groupBy(*GRAM).agg(F.sum("n").alias("n"))
    level = whole.select(*GRAM[:3], "n", F.explode(parts).alias("p")).select(*GRAM[:3], "n", "p.*")
    level = level.groupBy(*GRAM[:3], "d", "e", "size").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    return alone.unionByName(two).unionByName(level.select(F.slice(F.array(*GRAM[:3], "d", "e"), 1, F.col("size")).alias("words"), "f"))


def absorbed(counts: DataFrame) -> DataFrame:
    """(words, f) of the runs that lie in a longer one of the same count, on either side."""
    size = F.size("words")
    longer = counts.where(size > 2)
    parts = F.array(F.slice("words", 1, size - 1), F.slice("words", 2, size - 1))
    return longer.select(F.explode(parts).alias("words"), "f").distinct()


def paths(counts: DataFrame) -> DataFrame:
    """(words, f) of the maximal chains of edges through nodes with one edge in and one out of the same count, by doubling."""
    whole = counts.where(F.size("words") == ORDER).select(F.col("words").alias("edge"), "f")
    nodes = counts.where(F.size("words") == ORDER - 1).select(F.col("words").alias("node"), "f")
    tails = whole.select("edge", F.slice("edge", 2, ORDER - 1).alias("node"), "f")
    heads = whole.select(F.col("edge").alias("next"), F.slice("edge", 1, ORDER - 1).alias("node"), "f")
    # An edge whose count is that of the node it comes from is the only one to leave it; likewise for the one that enters.
    steps = tails.join(nodes, ["node", "f"]).join(heads, ["node", "f"]).select("edge", "next")
    reach = materialise(whole.join(steps, "edge", "left").withColumn("more", F.when(F.col("next").isNotNull(), F.array(F.element_at("next", -1))).otherwise(F.array().cast("array<bigint>"))))
    inner = materialise(steps.select(F.col("next").alias("edge")))
    while not reach.where("next is not null").isEmpty():
        ahead = reach.select(F.col("edge").alias("next"), F.col("next").alias("after"), F.col("more").alias("rest"))
        reach = materialise(reach.join(ahead, "next", "left").select(
            "edge", "f", F.col("after").alias("next"), F.concat("more", F.coalesce("rest", F.array().cast("array<bigint>"))).alias("more")))
    return reach.join(inner, "edge", "left_anti").select(F.concat("edge", "more").alias("words"), "f")


def spelled(rows: DataFrame, words: DataFrame) -> DataFrame:
    """words, phrase, lang of the distinct ``words`` in ``rows``."""
    each = rows.select("words").distinct().select("words", F.posexplode("words").alias("at", "key"))
    found = each.join(words, "key").groupBy("words").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("spelling"), F.min("lang").alias("lang"))
    return found.select("words", F.array_join(F.col("spelling.word"), " ").alias("phrase"), "lang")


def score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)) in whole numbers of up to 38 digits."""
    wide = [c.cast("decimal(20,0)") for c in (a, n, left, right)]
    return F.call_function("div", wide[0] * wide[1] * F.lit(1000).cast("decimal(4,0)"), wide[2] * wide[3])


def scored(counts: DataFrame, sizes: DataFrame, words: DataFrame) -> DataFrame:
    """words, lang, phrase, a, l, r, n, score of all phrases that no longer one absorbs, by their worst cut."""
    phrases = counts.where(F.size("words") > 1)
    kept = phrases.join(absorbed(phrases), ["words", "f"], "left_anti").withColumnRenamed("f", "a")
    named = kept.join(spelled(kept, words), "words").join(sizes, "lang")
    k = F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")
    cuts = named.select("*", k).withColumns({"left": F.slice("words", 1, F.col("k")), "right": F.expr("slice(words, k + 1, size(words) - k)")})
    part = lambda name, f: counts.select(F.col("words").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("left", "l"), "left").join(part("right", "r"), "right")
    worst = F.min(F.struct(score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("worst")
    return cuts.groupBy("words", "lang", "phrase", "a", "n").agg(worst).select("words", "lang", "phrase", "a", "worst.l", "worst.r", "n", "worst.score")


class Collocations:
    """The counted graph of a corpus: ``counts`` (words, f), ``words`` (key, lang, word), ``sizes`` (lang, n)."""

    def __init__(self, docs: DataFrame, least: int = LEAST):
        texts = languages(docs)
        words = materialise(frequent_words(texts, least))
        pairs = materialise(frequent_pairs(texts, least))
        triples = bitmap.shared(triple_hash(), pairs.where(F.col("next") != ANY))
        self.counts = materialise(counted(edges(texts, triples), pairs, words, least))
        triples.drop()
        self.words = words.where("word is not null").select("key", "lang", "word")
        self.sizes = words.where("word is null").select("lang", "n")

    def phrases(self) -> DataFrame:
        return scored(self.counts, self.sizes, self.words)

    def paths(self) -> DataFrame:
        """phrase, lang, f, words of the passages of ``ORDER`` words or more that always occur as a whole."""
        found = paths(self.counts)
        return found.join(spelled(found, self.words), "words")

    def best(self, top: int = TOP) -> DataFrame:
        """The first ``top`` phrases of each language with their rank, and the path that a phrase of ``ORDER`` words opens."""
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = self.phrases().withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
        whole = self.paths().select(F.slice("words", 1, ORDER).alias("words"), F.col("phrase").alias("path"))
        return ranked.join(whole, "words", "left").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "path")
