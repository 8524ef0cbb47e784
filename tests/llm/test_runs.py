"""Periodic runs against a plain search of all stretches."""

import hashlib
import random
import re
import zlib

import pytest

from tests.llm.data import documents, same_rows, texts
from tidewatch.llm import runs


def plain(words):
    """Every run, by trying all periods from every start."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        at = 0
        while at + q < n:
            end = at + q
            while end < n and words[end] == words[end - q]:
                end += 1
            if end - at >= max(6, 4 * q) and not any(s <= at and end <= e and p < q for (s, e), p in found.items()):
                found[at, end] = q
            at = max(at + 1, end - q + 1) if end > at + q else at + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def contract(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain(words) if len(words) < 3000 else [(0, n, 1)]  # the long fixture repeats one word
    dropped = {i for s, k, q in found for i in range(s + q, s + k)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{k},{q}\n" for s, k, q in found)),
            sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


@pytest.mark.parametrize("seed", range(60))
def test_all_runs_of_random_words(seed):
    rng = random.Random(seed)
    words = []
    while len(words) < 150:
        unit = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 8, 200])) for _ in range(rng.randrange(1, 12))]
        words += (unit * rng.randrange(1, 8))[:rng.randrange(1, 60)]
    assert runs.found_runs([words, words[3:], [], words[:7]]) == [plain(words), plain(words[3:]), [], plain(words[:7])]


def test_nested_runs_and_smallest_periods():
    a, b, c = b"a", b"b", b"c"
    words = ([a] * 6 + [b]) * 4 + [c] + [a, b] * 4
    assert runs.found_runs([words]) == [plain(words)]
    assert (0, 28, 7) in plain(words) and (0, 6, 1) in plain(words)


def test_lags_in_many_steps(monkeypatch):
    rng = random.Random(5)
    words = [b"%d" % rng.randrange(9) for _ in range(37)] * 6
    want = runs.found_runs([words])
    monkeypatch.setattr(runs, "LAGS", 5)
    assert runs.found_runs([words]) == want == [plain(words)]


def test_long_text_of_a_long_period():
    unit = [b"%d" % i for i in range(40_000)]
    assert runs.found_runs([[b"x"] + unit * 5]) == [[(1, 200_000, 40_000)]]


def rows():
    rng = random.Random(2)
    more = [(1000 + i, " ".join(rng.choice("ab") for _ in range(rng.randrange(0, 90))), "s") for i in range(60)]
    return texts() + more + [(2000, "x\ty\x0bx\ny " * 9, "s"), (2001, "a\x1cb " * 9, None)]


def test_query_columns_against_the_contract(spark, tmp_path):
    from tidewatch.llm.queries import op13

    spark.createDataFrame(rows(), "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op13(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {k for c, k in got.dtypes if c not in ("runs_sha256", "collapsed_sha256")} == {"bigint"}
    want = [contract(i, t) for i, t, _ in rows()]
    assert any(w[1] and zlib.crc32(str(w[0]).encode()) % 10 == 0 for w in want)
    assert same_rows(got.collect(), want)


def test_runs_and_texts_that_are_left(spark):
    got = {r.doc_id: r for r in runs.runs(documents(spark, [(1, "go a b a b a b a b end", None), (2, None, None), (3, " \n", None)])).collect()}
    assert [tuple(r) for r in got[1].runs] == [(1, 8, 2)] and got[1].text == "go a b end"
    assert (got[2].runs, got[2].text, got[3].text) == ([], "", "")
    assert runs.runs(documents(spark, [])).count() == 0
