"""Removal of repeated strings against a plain table of all strings."""

import hashlib
import random

import numpy as np
import pytest

from tests.llm.data import documents, same_rows, sentence, texts
from tidewatch.llm import bitmap, suffixes


def plain(rows):
    first = {}
    for i, t, *_ in rows:
        data = (t or "").encode()
        if i is not None:
            for p in range(len(data) - 49):
                first[data[p:p + 50]] = min(i, first.get(data[p:p + 50], i))
    out = []
    for i, t, *_ in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for p in range(len(data) - 49):
            if i is not None and first[data[p:p + 50]] < i:
                gone[p:p + 50] = True
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((i, len(data), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def rows():
    rng = random.Random(4)
    made = [(i, t if t is None or len(t) < 20_000 else t[:4_000]) for i, t, _ in texts()]
    passage = sentence(99, 60)
    for i in range(400, 470):  # passages, edited copies and overlaps, ids in no order
        parts = [sentence(rng.randrange(20), rng.randrange(1, 40)), passage[rng.randrange(200):rng.randrange(200, 330)], sentence(i, rng.randrange(1, 30))]
        rng.shuffle(parts)
        made.append((rng.randrange(400, 600), rng.choice(["", " ", "\n", "\x00"]).join(parts)))
    made += [(700, "ab" * 300), (701, "ab" * 40), (690, "ba" * 26 + "x"), (702, "x" * 49), (703, "x" * 50), (704, "x" * 51), (705, "y" * 50 + "x" * 50)]
    made += [(800, "é" * 100), (799, "a" + "é" * 30), (801, passage + "\x00" * 80), (802, "\x00" * 50), (802, passage), (802, passage)]
    return made + [(None, passage), (-5, passage[:80])]


def checked(spark, made):
    got = suffixes.without_repeats(documents(spark, [(i, t, None) for i, t in made]))
    return [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got.collect()]


def test_all_strings(spark):
    assert same_rows(checked(spark, rows()), plain(rows()))


def test_small_batches_blocks_and_a_full_bitmap(spark, monkeypatch):
    for name, value in (("BLOCK", 70), ("STRETCH", 7), ("KEYS", 40), ("STRETCHES", 30), ("BATCH", 64), ("SCAN", 11)):
        monkeypatch.setattr(suffixes, name, value)
    assert same_rows(checked(spark, rows()), plain(rows()))
    monkeypatch.setattr(bitmap, "holds", lambda bits, values: values == values)
    assert same_rows(checked(spark, rows()), plain(rows()))


@pytest.mark.parametrize("seed", range(8))
def test_levels_grow_geometrically_and_find_all_strings(seed, monkeypatch):
    monkeypatch.setattr(suffixes, "SCAN", 16)
    rng = random.Random(seed)
    family, first, doc = suffixes.Family(), {}, 0
    for _ in range(40):
        parts = [bytes(rng.choice(b"ab") for _ in range(50)) + bytes(rng.choice(b"ab\x00") for _ in range(rng.randrange(0, 6))) for _ in range(6)]
        parts = [rng.choice([*first, p]) + b"a" * rng.randrange(3) if first and rng.random() < 0.5 else p for p in parts]
        docs = []
        for _ in parts:
            doc += rng.randrange(2)
            docs.append(doc)
        doc += 1
        strings = [(n, p, part[p:p + 50]) for n, part in enumerate(parts) for p in range(len(part) - 49)]
        for n, _, s in strings:
            first[s] = min(docs[n], first.get(s, docs[n]))
        want = {(n, p + k) for n, p, s in strings if first[s] < docs[n] for k in range(50)}
        got = {(n, x) for n, a, b in zip(*(v.tolist() for v in family.add(parts, np.array(docs)))) for x in range(a, b)}
        assert got == want
        sizes = [len(level.order) for level in family.levels]
        assert all(a > 2 * b for a, b in zip(sizes, sizes[1:]))
        for level in family.levels:
            held = level.strings(0, len(level.order))
            assert (held[:-1] < held[1:]).all()
    assert sum(sizes) == len(first)


def test_long_text_and_empty_table(spark):
    rng = random.Random(9)
    long = " ".join("w%x" % rng.randrange(1 << 30) for _ in range(40_000))
    made = [(2, long), (1, long[1_000:300_000]), (3, "new " + long + " end")]
    got = checked(spark, made)
    assert {r[0]: r[1:4] for r in got} == {1: (299_000, 0, 0), 2: (len(long), 299_000, 1), 3: (len(long) + 8, len(long), 1)}
    assert same_rows(got, plain(made))
    assert suffixes.without_repeats(documents(spark, [])).count() == 0


def test_query_columns(spark, tmp_path):
    from tidewatch.llm.queries import op12

    spark.createDataFrame(rows(), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op12(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert same_rows(got.collect(), plain(rows()))


def test_whole_pieces_of_copies_go_before_the_strings(spark, monkeypatch):
    made = [(i, " ".join([sentence(k % 7 + 900, 300), f"edit {i} of {k}", sentence(k % 7 + 950, 300)])) for k, i in enumerate(range(300, 0, -3))]
    seen = {}

    def counted(parts, real=suffixes.shared_keys):
        seen["left"] = sum(len(r.part) for r in parts.collect())
        return real(parts)

    monkeypatch.setattr(suffixes, "shared_keys", counted)
    assert same_rows(checked(spark, made), plain(made))
    assert seen["left"] < 0.4 * sum(len(t) for _, t in made)


def test_shares_follow_the_strings(spark, monkeypatch):
    seen = {}

    def dealt_to(parts, shares, real=suffixes.repeated):
        found = real(parts, shares)
        seen["tasks"] = found.rdd.getNumPartitions()
        return found

    monkeypatch.setattr(suffixes, "repeated", dealt_to)
    monkeypatch.setattr(suffixes, "SHARE", 100)
    assert same_rows(checked(spark, rows()), plain(rows()))
    assert seen["tasks"] > int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("log_piece, least", [(0, 1), (2, 3), (4, 64)])
def test_pieces_cover_all_strings_and_follow_the_bytes(spark, monkeypatch, log_piece, least):
    monkeypatch.setattr(suffixes, "LOG_PIECE", log_piece)
    monkeypatch.setattr(suffixes, "LEAST_PIECE", least)
    parts = [t.encode() for _, t in rows() if t and len(t.encode()) >= 50]
    owner, first, last = suffixes.pieces(parts)
    assert [(n, p) for n, a, b in zip(owner, first, last) for p in range(a, b)] == [(n, p) for n, t in enumerate(parts) for p in range(len(t) - 49)]
    assert all(b - a >= min(least, len(parts[n]) - 49) or b == len(parts[n]) - 49 for n, a, b in zip(owner, first, last))
    alone = [x for t in parts for x in zip(*suffixes.pieces([t])[1:])]
    assert alone == list(zip(first, last))
    assert same_rows(checked(spark, rows()), plain(rows()))


def test_bitmaps_follow_what_they_hold(spark, monkeypatch):
    rng = np.random.default_rng(3)
    values = rng.integers(-1 << 63, (1 << 63) - 1, 40_000)
    others = rng.integers(-1 << 63, (1 << 63) - 1, 40_000)
    rows = spark.createDataFrame([(int(v),) for v in np.concatenate([values, values[:9_000], values[:5_000]])], "v bigint").repartition(3)
    bits = bitmap.sized_of(rows["v"], rows).value
    assert bitmap.holds(bits, values).all() and bitmap.holds(bits, others).mean() < 0.1 and len(bits) < 1 << 18
    packs = rows.mapInArrow(lambda batches: bitmap.packed((b.column(0).to_numpy() for b in batches), 700), bitmap.PACKS)
    twice = bitmap.sized(packs, several=True).value
    assert bitmap.holds(twice, values[:9_000]).all() and bitmap.holds(twice, values[9_000:]).mean() < 0.1
    monkeypatch.setattr(bitmap, "LOG_MOST", 15)
    full = bitmap.sized_of(rows["v"], rows).value
    assert len(full) == 1 << 12 and bitmap.holds(full, values).all()
    assert not bitmap.holds(bitmap.sized_of(rows["v"], rows.where("false")).value, others).any()
