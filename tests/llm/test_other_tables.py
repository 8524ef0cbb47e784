"""Nearest neighbours, WARC archives, and the pipeline."""

import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.data import documents, same_rows, texts
from tidewatch.llm import neighbours, warc
from tidewatch.session import scratch_path

EVERY_20 = "vec_id % 20 = 0"


def brute_nearest(rows, k):
    usable = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    out, asked = [], set()
    for q, a in usable:
        if q % 20 or (q, len(a)) in asked:
            continue
        asked.add((q, len(a)))
        found = []
        for c, b in usable:
            if c != q and len(a) == len(b):
                total = 0.0
                for x, y in zip(a, b):
                    total += float(x) * float(y)
                found.append((-total, c))
        out += [(q, rank, c, -s + 0.0) for rank, (s, c) in enumerate(sorted(found)[:k], 1)]
    return out


def vectors():
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=12).astype(np.float32).tolist()) for i in range(400)]
    shared = rows[3][1]
    rows += [(1000 + i, shared) for i in range(150)]                       # one vector that many rows share
    rows += [(20, rows[20][1]), (41, rows[41][1]), (41, rows[41][1])]      # repeated rows
    rows += [(2000, None), (2020, []), (2040, [0.0] * 12), (2060, [float("nan")] * 12), (2080, [float("inf")] + [1.0] * 11), (2100, [None] + [1.0] * 11), (None, shared)]
    rows += [(3000, [1.0, 2.0]), (3001, [2.0, 1.0]), (3020, [5.0])]        # other lengths, one of them alone
    return rows


def test_neighbours_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_VALUES", 12 * 100)
    monkeypatch.setattr(neighbours, "QUERY_VALUES", 12 * 9)
    frame = spark.createDataFrame([(i, v, "clash") for i, v in vectors()], "vec_id bigint, embedding array<float>, dim string")
    got = neighbours.nearest(frame, F.expr(EVERY_20), 5).collect()
    assert same_rows(got, brute_nearest([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in vectors()], 5))


def test_bounds_hold_and_tiles_lose_nothing():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(3000, 16)), rng.normal(size=(500, 16)) * 100, np.repeat(rng.normal(size=(1, 16)), 400, axis=0)])
    ids = rng.permutation(len(x))
    q = x[:40]
    a = neighbours.cell_best(ids[:40].tolist(), q, ids, x, 20)
    want = brute_nearest_cell(ids[:40], q, ids, x, 20)
    assert list(zip(*a)) == want
    codes, scale, norm, left = neighbours.coded(x)
    assert (np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1)) <= left).all()


def brute_nearest_cell(query_ids, queries, ids, x, k):
    out = []
    for own, q in zip(query_ids, queries):
        total = np.zeros(len(x))
        for j in range(x.shape[1]):
            total += q[j] * x[:, j]
        order = [n for n in np.lexsort((ids, -total)) if ids[n] != own][:k]
        out += [(own, ids[n], total[n]) for n in order]
    return out


def test_no_vectors(spark):
    assert neighbours.nearest(spark.createDataFrame([], "vec_id bigint, embedding array<float>"), F.expr(EVERY_20)).count() == 0


def pages():
    random.seed(2)
    big = "<p>é\r\n\r\nWARC/1.1\r\n" + "x" * 1200
    rows = [(i, f"http://h/{i}", f"<html>{i}" + "y" * random.randint(0, 3000)) for i in range(40)]
    rows += [(100 + i, f"http://h/b{i}", big) for i in range(30)]
    rows += [(200 + i, "http://h/small", "z" * 999) for i in range(3)]
    rows += [(300, None, "w" * 1000), (301, "bad\r\nWARC-Type: revisit", "w" * 1000), (301, "bad\r\nWARC-Type: revisit", "w" * 1000)]
    rows += [(400, "http://h/n", None), (401, "http://h/e", ""), (None, "http://h/none", big), (None, None, "v" * 2000)]
    return rows


def test_archives_round_trip(spark):
    rows = pages()
    last = {}
    for i, _, html in rows:
        if i is not None:
            last[html or ""] = max(last.get(html or "", i), i)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        to = last.get(html or "") if len(data) >= 1000 else None
        revisit = to is not None and i != to
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    frame = spark.createDataFrame([(*r, "x", 5) for r in rows], "page_id bigint, url string, html string, payload string, bytes int")
    assert same_rows(warc.round_trip(frame).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect(), want)


def test_archive_holds_each_large_payload_once(spark):
    folder = scratch_path(spark)
    warc.write(spark.createDataFrame(pages(), "page_id bigint, url string, html string"), folder)
    import gzip
    data = b"".join(gzip.decompress(r["content"]) for r in spark.read.format("binaryFile").load(folder).select("content").collect())
    records = list(warc.parsed(data))
    assert len(records) == len(pages()) and data.count(b"x" * 1200) == 1
    assert all(h["warc-type"] in ("response", "revisit") and h["warc-target-uri"] for h, _ in records)


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_pipeline_stages(spark):
    docs, sizes = documents(spark), []
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "unused")
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] >= sizes[2] == sizes[3] > 0
    kept = {r["text"] for r in docs.collect()}
    assert texts()[7][1] in kept and None not in kept
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "unused")
    assert {r["doc_id"] for r in pieces.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_pipeline_on_no_documents(spark):
    docs = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "unused")
        assert docs.count() == 0
