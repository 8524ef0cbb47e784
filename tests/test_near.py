"""The set-similarity join against all pairs."""

import random

import numpy as np
import pytest

from tidewatch.operators import near
from tidewatch.operators.clean import drop_near
from tidewatch.operators.near import Classes, near_copies, row_bands, shingles


def jaccard(a, b):
    def runs(t):
        w = t.lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    x, y = runs(a), runs(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def texts(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    frame = " ".join(rng.choice(words) for _ in range(60))
    rows = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([1, 3, 6, 20, 80, 250, 600]))]
        rows.append(" ".join(base))
        for _ in range(rng.randrange(5)):
            own = list(base)
            for _ in range(rng.randrange(1, 8)):
                at = rng.randrange(len(own) + 1)
                own[at:at + rng.randrange(2)] = [rng.choice(words)] if rng.random() < .7 else []
            rows.append(" ".join(own) if rng.random() < .8 else frame + " " + " ".join(own))
    rows += [rows[3], rows[3].upper(), "", "  ", None, "one", "One", "a a a a a a", "a a a a a a a"]
    rng.shuffle(rows)
    return list(enumerate(rows, 1))


@pytest.mark.parametrize("seed,t", [(1, 0.95), (2, 0.8), (3, 0.9), (4, 1.0)])
def test_every_row_with_an_earlier_near_row(spark, seed, t):
    rows = texts(seed)
    frame = spark.createDataFrame(rows, "id bigint, text string")
    first = {}
    for i, x in rows:
        if x is not None:
            first.setdefault(x, i)
    want = {i for x, i in first.items() for y, j in first.items() if j < i and jaccard(x, y) >= t}
    got = near_copies(frame, "id", "text", t).collect()
    assert {r.id for r in got} == want and len(got) == len(want)
    by = dict(rows)
    for r in got:
        assert r.leader < r.id and r.similarity == pytest.approx(jaccard(by[r.id], by[r.leader])) and r.similarity >= t
    if t < 1:
        assert want
    kept = {r.id for r in drop_near(frame, "id", "text", t, 5).collect()}
    blank = min(i for i, x in rows if x is None)  # rows without a text are copies of each other
    assert kept == {i for x, i in first.items()} - want | {blank}


def test_near_sets_share_a_band():
    """Sets at the limit of similarity, whatever their sizes."""
    rng = np.random.default_rng(5)
    for t in (0.8, 0.95):
        classes = Classes(t)
        for _ in range(150):
            n = int(rng.integers(1, 400))
            common = rng.integers(0, 2 ** 63, n, dtype=np.uint64)
            more = int(n * (1 - t) / t)
            cut = int(rng.integers(0, more + 1))
            rest = rng.integers(0, 2 ** 63, more, dtype=np.uint64)
            a, b = np.unique(np.concatenate([common, rest[:cut]])), np.unique(np.concatenate([common, rest[cut:]]))
            x, y = row_bands(a, classes), row_bands(b, classes)
            assert abs(x[1] - y[1]) <= 1 and set(x[0]) & set(y[0])
            top = max(x[1], y[1])
            fine = [np.frombuffer(r[2] if r[1] == top else r[3], np.uint8) for r in (x, y)]
            assert (fine[0] != fine[1]).sum() <= classes.differ(len(a) + len(b))


def test_shingles_and_empty_tables(spark):
    assert len(shingles("")) == 0 and len(shingles("a b")) == 1 and len(shingles("a b c d e f")) == 2
    assert (shingles("A b\tc") == shingles("a B c")).all() and shingles("a b")[0] != shingles("a b c")[0]
    none = spark.createDataFrame([], "id bigint, text string")
    assert near_copies(none, "id", "text").count() == 0 and drop_near(none, "id", "text").count() == 0


def test_texts_are_compared_once_for_all_rounds(spark, monkeypatch):
    """A band of 20 rows takes five rounds; only the texts of likely pairs are compared, and those once."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(300)}" for _ in range(600)]
    rows = [" ".join(base[:at] + [f"x{at}"] + base[at + 1:]) for at in range(5, 595, 30)]
    rows += [" ".join(f"v{rng.randrange(300)}" for _ in range(100)) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(rows, 1)), "id bigint, text string")
    sizes, plain = [], near.similar

    def counted(pairs, texts, t, width):
        sizes.append(texts.count())
        return plain(pairs, texts, t, width)

    monkeypatch.setattr(near, "similar", counted)
    got = {r.id for r in near_copies(frame, "id", "text", 0.95).collect()}
    assert got == set(range(2, 21)) and len(sizes) == 1 and sizes[0] <= 20


def test_rows_go_on_after_likely_leaders_that_are_not_near(spark, monkeypatch):
    monkeypatch.setattr(near, "likely", lambda pairs, rows, t: pairs)
    rows = texts(2)[:40]
    first = {}
    for i, x in rows:
        if x is not None:
            first.setdefault(x, i)
    want = {i for x, i in first.items() for y, j in first.items() if j < i and jaccard(x, y) >= 0.8}
    got = near_copies(spark.createDataFrame(rows, "id bigint, text string"), "id", "text", 0.8).collect()
    by = dict(rows)
    assert {r.id for r in got} == want and all(jaccard(by[r.id], by[r.leader]) >= 0.8 for r in got)


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e f"), (1, "g h"), (2, "a b c d e f"), (2, "A B c d e f"), (None, "a b c d e F"), (3, "g H"), (3, "g H"), (4, None), (None, None)]
    frame = spark.createDataFrame(rows, "id bigint, text string")
    assert {(r.id, r.leader) for r in near_copies(frame, "id", "text").collect()} == {(2, 1), (3, 1)}
    assert sorted(r.id for r in drop_near(frame, "id", "text").collect()) == [1, 1, 4]
