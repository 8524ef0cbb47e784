"""Phrases and paths against plain counting."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.data import documents, same_rows
from tidewatch.llm import bitmap, collocations
from tidewatch.llm.collocations import Collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
        yield re.findall(r"[^\x20\x09]+", piece)


def counted(rows):
    f, n = Counter(), Counter()
    for text, lang in rows:
        for words in pieces(text):
            n[lang or "und"] += len(words)
            f.update((lang or "und", *words[i:i + m]) for m in range(1, 6) for i in range(len(words) - m + 1))
    return f, n


def plain(rows, least, top):
    f, n = counted(rows)
    held = {g: a for g, a in f.items() if a >= least and len(g) > 2}
    out = []
    for g, a in held.items():
        lang, words = g[0], g[1:]
        if any(b == a and h[0] == lang and any(h[i:i + len(words)] == words for i in range(1, len(h))) for h, b in held.items() if len(h) > len(g)):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, *words[:k]] * f[lang, *words[k:]]), k, f[lang, *words[:k]], f[lang, *words[k:]]) for k in range(1, len(words))]
        score, _, left, right = min(cuts)
        out.append((lang, " ".join(words), a, left, right, n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(r[0], i + 1, *r[1:]) for i, r in enumerate(own[:top])]
    return ranked


def plain_paths(rows, least):
    f, _ = counted(rows)
    edges = {g: a for g, a in f.items() if len(g) == 6 and a >= least}
    step = {e: x for e in edges for x in edges if e[0] == x[0] and e[2:] == x[1:5] and edges[e] == edges[x] == f[(e[0], *e[2:])]}
    out = []
    for e in edges:
        if e not in step.values():
            words, at = list(e[1:]), e
            while at in step:
                at = step[at]
                words.append(at[-1])
            out.append((e[0], " ".join(words), edges[e]))
    return out


def corpus():
    rng = random.Random(3)
    line = "all rights reserved by the owners of this small and quiet work for ever and ever more"
    rows = []
    for i in range(160):
        words = [rng.choice(["the", "a", "of", "Red", "blue", "é", "house", "x%d" % rng.randrange(60)]) for _ in range(rng.randrange(0, 60))]
        text = " ".join(w + rng.choice(["", "", "", ",", ".", "\t", "\n", "  "]) for w in words)
        rows.append((text + ("\n" + line if i % 3 == 0 else "") + (" the red house of" * (i % 5)), ["en", "fr", None, "und"][i % 4]))
    return rows + [(None, "en"), ("", None), (" \n,", "de"), ("word " * 9_000, "en"), (line, "en"), (line, "en"), ("\x85\x1c a\xa0b", "fr"), ("ZÄ zÄ", "de")]


def table(spark, rows):
    docs = documents(spark, [(i, t, None) for i, (t, _) in enumerate(rows)]).drop("lang")
    langs = spark.createDataFrame([(i, lang) for i, (_, lang) in enumerate(rows)], "doc_id bigint, lang string")
    return docs.join(langs, "doc_id")


@pytest.mark.parametrize("least,top", [(3, 2000), (7, 5), (100, 2000)])
def test_phrases(spark, least, top):
    found = Collocations(table(spark, corpus()), least).best(top)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score", "path"]
    assert {k for c, k in found.dtypes if c not in ("lang", "phrase", "path")} == {"bigint"}
    want = plain(corpus(), least, top)
    assert want and same_rows(found.drop("path").collect(), want)


def test_paths_and_those_that_phrases_open(spark):
    mined = Collocations(table(spark, corpus()), 3)
    want = plain_paths(corpus(), 3)
    assert any(len(p.split()) > 12 for _, p, _ in want)
    assert same_rows(mined.paths().select("lang", "phrase", "f").collect(), want)
    opened = {(r.lang, r.path) for r in mined.best().where("path is not null").collect()}
    assert opened and opened <= {(lang, p) for lang, p, _ in want}


def test_small_buffers_blocks_and_a_full_bitmap(spark, monkeypatch):
    want = plain(corpus(), 3, 2000)
    monkeypatch.setattr(collocations, "BUFFER", 50)
    monkeypatch.setattr(collocations, "BLOCK", 64)
    monkeypatch.setattr(collocations, "VOCABULARY", 30)
    assert same_rows(Collocations(table(spark, corpus()), 3).best().drop("path").collect(), want)
    monkeypatch.setattr(bitmap, "holds", lambda bits, values: values == values)
    assert same_rows(Collocations(table(spark, corpus()), 3).best().drop("path").collect(), want)


def test_edges_only_where_three_words_stand_together_often(spark, monkeypatch):
    rows = [(f"a{i} mid b{j}", "en") for i in range(20) for j in range(20)] + [("all the same", "en")] * 20  # neighbours 20 times, three words once
    made, real = [], collocations.edges
    monkeypatch.setattr(collocations, "edges", lambda *of: made.extend(real(*of).collect()) or real(*of))
    found = Collocations(table(spark, rows), 20).best().drop("path").collect()
    assert same_rows(found, plain(rows, 20, 2000)) and len(found) == 41
    assert sum(r.n for r in made) == 20 and len({r[:5] for r in made}) == 1


def test_rows_are_added_up_whatever_their_hashes(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    columns = [rng.integers(0, 4, 500).astype(np.uint64) << np.uint64(62) | np.uint64(1) for _ in range(3)]
    rows, n = np.unique(np.stack(columns, axis=1), axis=0, return_counts=True)
    want = {(*map(int, r), int(m)) for r, m in zip(rows, n)}
    for mix in (collocations.mixed, lambda v: v * np.uint64(0)):
        monkeypatch.setattr(collocations, "mixed", mix)
        got, n = collocations.added_rows(columns)
        assert len(n) == len(want) and {tuple(map(int, r)) for r in zip(*got, n)} == want


def test_scores_past_64_bits(spark):
    rows = [(10**11 + 7, 10**13 + 9, 3 * 10**11 + 1, 2 * 10**11 + 11), (10**12, 10**15, 10**12, 10**12 + 3), (100, 100, 100, 100)]
    got = spark.createDataFrame(rows, "a bigint, n bigint, l bigint, r bigint").select(
        collocations.score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).cast("bigint").alias("s"))
    assert same_rows(got.collect(), [(1000 * a * n // (x * y),) for a, n, x, y in rows])


def test_empty_tables(spark):
    for rows in ([], [(None, None)], [("one two", "en")]):
        mined = Collocations(documents(spark, [(1, t, s) for t, s in rows]))
        assert mined.best().collect() == [] and mined.paths().collect() == []


def test_bitmap_holds_what_was_put_in(spark):
    import numpy as np

    rows = spark.range(5_000).select(F.xxhash64("id").alias("h"))
    bits = bitmap.shared(F.col("h"), rows).value
    inside = np.array([r.h for r in rows.collect()], np.int64)
    assert bitmap.holds(bits, inside).all() and bitmap.holds(bits, inside ^ 0x5555555555555555).mean() < 0.01
    assert int(np.unpackbits(bits).sum()) == len(set(inside.view(np.uint64) >> np.uint64(64 - bitmap.LOG_BITS)))
