"""Each operator against a brute-force version, with the awkward cases in the input."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.data import documents, same_rows, sentence, texts
from tidewatch.llm import bpe, huffman, linequality, packing, secrets, simhash, tokens, toxicity, weakquality, wordtable
from tidewatch.session import scratch_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- SimHash near-duplicates

def brute_print(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(lower)
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Component of each distinct fingerprint, by comparing all pairs."""
    nodes, parent = sorted(set(prints)), {}

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    return {x: find(x) for x in nodes}


def test_near_duplicates_equal_brute_force(spark):
    rows = texts()
    prints = [brute_print(t) for _, t, _ in rows]
    root = brute_components(prints)
    least = {}
    for (i, _, _), p in zip(rows, prints):
        if i is not None:
            least[root[p]] = min(least.get(root[p], i), i)
    want = [(i, p - (1 << 64) if p >> 63 else p, least.get(root[p])) for (i, _, _), p in zip(rows, prints)]
    assert same_rows(simhash.near_duplicates(documents(spark)).collect(), want)


def test_links_are_complete_in_short_and_long_lists(spark):
    random.seed(4)
    centre, values = random.getrandbits(64), set()
    for _ in range(400):  # a crowd around one word, and scattered ones
        x = centre
        for b in random.sample(range(64), random.randint(0, 4)):
            x ^= 1 << b
        values |= {x, random.getrandbits(64)}
    signed = [x - (1 << 64) if x >> 63 else x for x in values]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp bigint"))
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    want = brute_components(values)
    unsigned = lambda x: x % (1 << 64)
    mine = {x: unsigned(got.get(x - (1 << 64) if x >> 63 else x, x)) for x in values}
    groups = lambda of: {frozenset(y for y in values if of[y] == of[x]) for x in values}
    assert groups(mine) == groups(want)


def test_deduplicated_keeps_one_row_of_each_component(spark):
    rows = texts()
    kept = simhash.deduplicated(documents(spark)).collect()
    root = brute_components([brute_print(t) for _, t, _ in rows])
    assert Counter(root[brute_print(r["text"])] for r in kept) == {r: 1 for r in set(root.values())}
    assert {7} == {r["doc_id"] for r in kept if r["text"] == rows[7][1]}


def test_components_of_a_long_chain(spark):
    chain = spark.range(300).selectExpr("id as a", "id + 1 as b")
    assert {r["root"] for r in simhash.components(chain).collect()} == {0}


# ---- secrets

BASE = [re.compile("(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
        re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")]


def brute_spans(text):
    out = []
    for kind, pattern in enumerate(BASE):
        for m in pattern.finditer(text or ""):
            if len(m[1]) >= 6 if kind == 0 else len(m[0]) >= (20, 24)[kind - 1]:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def checked_token(body="abcdefghijKLMNOPQRST0123456789"):
    value, text = zlib.crc32(body.encode()), ""
    while value:
        value, digit = divmod(value, 62)
        text = secrets.DIGITS62[digit] + text
    return f"ghp_{body}{text.rjust(6, '0')}"


def secret_texts():
    random.seed(3)
    atoms = ["password", "Token", "SECRET", "api_key", "apikey", "=", ":", " ", '"', "'", "é", "\n", "AKIA", "AB12" * 4, "0a1b2c3d4e5f", "abcdef", "X", "İ"]
    return ["".join(random.choice(atoms) for _ in range(random.randint(0, 25))) for _ in range(3000)]


def test_secret_spans_equal_plain_patterns():
    words = secrets.automaton()
    for text in secret_texts():
        assert [s for s in secrets.spans(text, words) if s[1] < 3] == brute_spans(text)


def test_checksum_decides():
    words = secrets.automaton()
    good = checked_token()
    bad = good[:-1] + ("A" if good[-1] != "A" else "B")
    assert secrets.written(secrets.spans(f"é {good} {bad}", words)) == f"checked:2:{2 + len(good)}"


def test_secret_digest_and_redaction(spark):
    rows = [(i, t, "s") for i, t in enumerate(secret_texts()[:200])] + texts()
    want = []
    for i, text, _ in rows:
        found = brute_spans(text)
        counts = [sum(k == kind for _, k, _ in found) for kind in range(3)]
        base = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in found)
        want.append((i, *counts, hashlib.sha256(base.encode()).hexdigest(), base))
    assert same_rows(secrets.digested(secrets.scan(documents(spark, rows))).collect(), want)
    clean = secrets.redacted(documents(spark, rows))
    assert clean.count() == len(rows)
    for r in clean.collect():
        assert not brute_spans(r["text"]) and (r["text"] is None or r["n_chars"] == len(r["text"]))


# ---- quality rules

def brute_base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n)


def test_base_rules_equal_brute_force(spark):
    rows = texts() + [(400 + i, sentence(i, 30) + "\n" + sentence(i % 3, 8) + " ## <x>\n\n" + sentence(i % 3, 8) + " ## <x>", "s0") for i in range(10)]
    got = linequality.judged(documents(spark, rows)).drop("kept", "removed_words").collect()
    assert same_rows(got, [(i, *brute_base(t)) for i, t, _ in rows])


def test_frequent_lines_go_and_depleted_documents_are_rejected(spark):
    line = "Subscribe to our letter  and read MORE of it every day of the week"
    rows = [(i, f"{sentence(1000 + i, 40)}\n{line}", "host") for i in range(30)]
    rows += [(50, f"{line}\nfew own words", "host"), (51, f"{line}\n{sentence(9, 40)}", "other")]
    rows += [(100 + i, sentence(77, 60), "host") for i in range(40)]  # copies of one text are no boilerplate
    verdict = {r["doc_id"]: r for r in linequality.judged(documents(spark, rows)).collect()}
    assert all(verdict[i]["kept"] and verdict[i]["removed_words"] == 14 for i in range(30))
    assert not verdict[50]["kept"] and not verdict[50]["base_failed"]
    assert verdict[51]["kept"] and verdict[51]["removed_words"] == 0
    assert all(verdict[100 + i]["kept"] for i in range(40))
    left = {r["doc_id"]: r["text"] for r in linequality.cleaned(documents(spark, rows)).collect()}
    assert set(left) == set(verdict) - {50}
    assert left[3] == sentence(1003, 40) and left[51] == rows[31][1] and left[100] == sentence(77, 60)


def test_pages_that_share_most_lines_are_distinct_documents(spark):
    shared = [sentence(500 + k, 12) for k in range(18)]
    rows = [(i, "\n".join([*shared, sentence(2000 + i, 24)]), "host") for i in range(50)]          # 90% shared lines
    menu = [sentence(700 + k, 8) for k in range(30)]
    rows += [(100 + i, "\n".join(menu[(i * k + k * k) % 30] for k in range(10)), "menu") for i in range(150)]  # no words of their own
    found = {r["doc_id"]: r for r in linequality.judged(documents(spark, rows)).collect()}
    assert all(found[i]["removed_words"] == 18 * 12 and not found[i]["base_failed"] and not found[i]["kept"] for i in range(50))
    assert all(found[100 + i]["removed_words"] > 0 for i in range(150))


def test_edited_copies_are_no_boilerplate(spark):
    base = [sentence(900 + k, 40).split() for k in range(6)]

    def edited(i):
        lines = [list(x) for x in base]
        lines[i % 6][3 + i % 30] = f"edit{i}"
        return "\n".join(map(" ".join, lines))

    rows = [(i, edited(i), "host") for i in range(60)] + [(100, "\n".join(map(" ".join, base)), "host")]
    found = linequality.judged(documents(spark, rows)).collect()
    assert all(r["kept"] and r["removed_words"] == 0 for r in found if not r["base_failed"])
    assert sum(r["base_failed"] for r in found) == 0


def test_lines_that_share_a_short_window_are_no_edits(spark):
    menu = [sentence(700 + k, 14) for k in range(5)]

    def own(i):  # the end of a common line in the middle of words of its own
        words = [f"w{i}x{k}" for k in range(13)]
        words[5:8] = menu[i % 5].split()[-3:]
        return " ".join(words)

    rows = [(i, "\n".join([*menu, own(i)]), "host") for i in range(40)]
    found = linequality.judged(documents(spark, rows)).collect()
    assert all(r["removed_words"] == 5 * 14 for r in found)


def test_null_and_empty_host_are_two(spark):
    line = "Subscribe to our letter and read more of it every day"
    rows = [(i, f"{sentence(1000 + i, 40)}\n{line}", None if i < 15 else "") for i in range(30)]
    assert all(r["removed_words"] == 0 for r in linequality.judged(documents(spark, rows)).collect())
    rows += [(100 + i, f"{sentence(2000 + i, 40)}\n{line}", None) for i in range(6)]
    found = linequality.judged(documents(spark, rows)).collect()
    assert {r["doc_id"] for r in found if r["removed_words"]} == {*range(15), *range(100, 106)}


def test_rows_equal_in_id_and_text_are_judged_by_host(spark):
    line = "Subscribe to our letter and read more of it every day"
    rows = [(i, f"{sentence(1000 + i, 40)}\n{line}", "host") for i in range(30)] + [(3, f"{sentence(1003, 40)}\n{line}", "other")]
    found = linequality.judged(documents(spark, rows)).where("doc_id = 3").collect()
    assert sorted(r["removed_words"] for r in found) == [0, 11]
    left = linequality.cleaned(documents(spark, rows)).where("doc_id = 3").collect()
    assert {r["source"]: r["text"] for r in left} == {"host": sentence(1003, 40), "other": rows[-1][1]}


# ---- byte-level BPE

MULTI = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def coder():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(MULTI), special_tokens={})


ATOMS = ["a", "Héllo", "don't", " ", "  ", "\n", "\r\n", "\t", ".", ",", "!!", "1", "23", "é", "ñ", "\xa0", "\x1c", "\x85", "　", "'s", "İ", "ΣΑΣ",
         "é", "́", "日本", "<|endoftext|>", "​", "ſ", "\x0b", "😀", "\x00", "abcdefghijklmnop" * 5, ""]


def fuzzed(n):
    random.seed(5)
    return ["".join(random.choice(ATOMS) for _ in range(random.randint(0, 12))) for _ in range(n)]


def test_bpe_equals_the_library(spark, coder):
    rows = texts() + [(1000 + i, t, "s") for i, t in enumerate(fuzzed(1500))]
    want = []
    for i, text, _ in rows:
        ids = coder.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert same_rows(bpe.coded(documents(spark, rows), MULTI, P.PATTERN).collect(), want)


def test_fold_of_merges_equals_the_library(spark, coder):
    words = sorted({w for t in texts()[:12] for w in t[1].split()} | {" unbelievably", " Ünïcödé", "zzzzqqq", "x", "日本語の", "!!!???"})
    ranks = bpe.read_ranks(MULTI)
    frame = spark.createDataFrame([(w,) for w in words], "word string").coalesce(1)
    got = frame.select("word", bpe.merged_ids(frame.word, bpe.rank_lookup(ranks)).alias("ids")).collect()
    assert all(r["ids"] == coder.encode_ordinary(r["word"]) for r in got)


def test_long_words_merge_alike():
    ranks = bpe.read_ranks(MULTI)
    random.seed(6)
    for n in (49, 80, 300):
        word = "".join(random.choice("abcdeé") for _ in range(n)).encode()
        parts = [word[i:i + 1] for i in range(len(word))]
        while True:
            found = [(ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, i = min(found)
            if rank == 1 << 40:
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        assert bpe.merge_long(word, ranks) == [ranks[p] for p in parts]


# ---- tokenizer files

@pytest.mark.parametrize("file,keeps", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_chunks_equal_the_library(file, keeps):
    own = tokens.Chunks(P.path(file), keeps)
    many = fuzzed(4000) + [t for _, t, _ in texts() if t]
    for text, ids in zip(many, own.texts(many)):
        assert np.frombuffer(ids, "<u2").tolist() == own._encode(text), repr(text[:80])


def test_cache_starts_anew_when_full(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_CHUNKS", 20)
    own = tokens.Chunks(P.path("byte_bpe_50k.json"), True)
    for text in [t for _, t, _ in texts() if t] * 2:
        assert np.frombuffer(own.texts([text])[0], "<u2").tolist() == own._encode(text)


def all_ids(file, end_id):
    tokenizer = Tokenizer.from_file(P.path(file))
    tokenizer.encode_special_tokens = True
    return [(i, np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [end_id], "<u4")) for i, t, _ in texts()]


# ---- Huffman files

def test_huffman_files_round_trip(spark):
    got = huffman.round_trip(documents(spark), P.path("word_bpe_49k.json"), 1).orderBy("start").collect()
    want = Counter((i, len(x), zlib.crc32(x.tobytes())) for i, x in all_ids("word_bpe_49k.json", 1))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    start = 0
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    known = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert known == sorted(known) and [r["doc_id"] for r in got][:2] == [None, None]


def test_code_is_prefix_free_limited_and_near_optimal():
    rng = np.random.default_rng(1)
    counts = np.zeros(5000, np.int64)
    counts[rng.choice(5000, 3000, replace=False)] = (rng.pareto(0.4, 3000) * 3).clip(1, 1e12).astype(np.int64)
    for longest in (12, 14, 18):
        lengths = huffman.code_lengths(counts, longest)
        assert lengths.max() <= longest and ((lengths > 0) == (counts > 0)).all()
        assert sum(2.0 ** -lengths[lengths > 0].astype(float)) == 1.0
    p = counts[counts > 0] / counts.sum()
    assert (lengths * counts).sum() / counts.sum() <= -(p * np.log2(p)).sum() + 1


def test_code_lengths_are_the_best_of_small_alphabets():
    from itertools import product
    for counts in ([1, 1, 5, 30], [3, 3, 3, 3, 3], [1, 2, 4, 8, 16]):
        for longest in (3, 4):
            best = min(sum(c * l for c, l in zip(counts, ls)) for ls in product(range(1, longest + 1), repeat=len(counts)) if sum(2.0 ** -l for l in ls) <= 1)
            assert int((huffman.code_lengths(np.array(counts), longest) * np.array(counts)).sum()) == best


def test_blocks_decode_alone():
    rng = np.random.default_rng(2)
    ids = (rng.pareto(0.7, 9000) * 5).clip(0, 4000).astype("<u2")
    lengths = huffman.code_lengths(np.bincount(ids, minlength=1 << 16))
    sizes = np.array([1, 255, 256, 257, 3000, 9000 - 3769])
    checks, data = huffman.pack(ids, sizes, lengths, huffman.canonical(lengths))
    counts = np.concatenate([[min(256, n - k) for k in range(0, n, 256)] for n in sizes])
    table = huffman.decode_table(lengths)
    assert (huffman.unpack(data, checks, counts, table) == ids).all()
    pick = np.array([5, 2, 9])
    firsts = np.cumsum(counts) - counts
    assert (huffman.unpack(data, checks[pick], counts[pick], table) == np.concatenate([ids[firsts[p]:firsts[p] + counts[p]] for p in pick])).all()


def test_one_id_and_empty_table(spark):
    lengths = huffman.code_lengths(np.bincount([7], minlength=10))
    assert lengths.tolist() == [0] * 7 + [1, 0, 0]
    assert huffman.round_trip(documents(spark, []), P.path("word_bpe_49k.json"), 1).count() == 0


# ---- packing

def test_pieces_cover_every_id_once(spark):
    rows = packing.packed(documents(spark), P.path("byte_bpe_50k.json")).collect()
    whole = Counter()
    by_doc, by_sequence = {}, {}
    ids = {i: x for i, x in all_ids("byte_bpe_50k.json", 0) if i is not None}
    for r in rows:
        if r["doc_id"] is not None:
            piece = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
            assert r["doc_tokens"] == len(ids[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(piece.tobytes())
            by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        whole["ids"] += r["length"]
    assert whole["ids"] == sum(len(x) for _, x in all_ids("byte_bpe_50k.json", 0))
    copies = Counter(i for i, _, _ in texts())
    for i, pieces in by_doc.items():
        assert sum(n for _, n in pieces) == copies[i] * len(ids[i])
    short = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
        short += at < packing.WINDOW
    assert short <= 1


def test_neighbours_come_by_shared_words():
    rng = np.random.default_rng(3)
    topics = [rng.choice(np.arange(1000 * t, 1000 * t + 200), 400).astype("<u2") for t in range(4) for _ in range(8)]
    weights = np.ones(packing.VOCABULARY, np.float32)
    packer = packing.Packer(weights, 400.0)
    order = rng.permutation(len(topics))
    packer.shard([(int(n), topics[n]) for n in order])
    windows = {}
    for doc, _, _, _, _, window, _ in packer.pieces:
        windows.setdefault(window, set()).add(doc // 8)
    assert sum(len(t) == 1 for t in windows.values()) >= len(windows) - 4
    scores = packing.Index(topics, weights, 400.0).scores(np.unique(topics[0])[:10].astype(np.int64))
    assert set(np.argsort(-scores)[:8]) == set(range(8))


# ---- toxicity

def test_maximal_segments_equal_the_definition():
    """Ruzzo and Tompa: the maximal segments are the best segment, then those of what lies left and right of it."""
    def brute(scores, low, high):
        best = None
        for a in range(low, high):
            total = 0
            for b in range(a, high):
                total += scores[b]
                if total > 0 and (best is None or (total, a - b) > (best[2], best[0] - best[1] + 1)):
                    best = (a, b + 1, total)
        if best is None:
            return []
        return brute(scores, low, best[0]) + [best] + brute(scores, best[1], high)

    random.seed(8)
    for _ in range(300):
        scores = [random.choice([-3, -2, -1, 1, 2, 4]) + random.random() / 7 for _ in range(random.randint(0, 25))]
        got = toxicity.maximal_segments(np.array(scores))
        want = brute(scores, 0, len(scores))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([t for *_, t in got], [t for *_, t in want])


def test_toxic_words_are_learned_and_clean_texts_left_alone(spark):
    rows, marks = [], []
    for i in range(400):
        toxic = i % 5 == 0
        rows.append((i, sentence(i, 40) + (" you vexquor vexbile fool" if toxic else ""), "s"))
        marks.append((i, int(toxic)))
    rows += [(1000, None, "s"), (1001, "", "s"), (None, "vexquor", "s"), (1002, "one vexquin here " + sentence(3, 400), "s")]
    marks += [(0, 0), (1000, None), (None, 1)]  # contradicting, empty and without a document
    labels = spark.createDataFrame(marks, "doc_id bigint, toxic int")
    docs = documents(spark, rows)
    model = toxicity.train(docs, labels, F.col("doc_id") % 3 != 0)
    found = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    for i in range(400):
        assert (found[i]["score"] >= 0.7) == (i % 5 == 0), i
    assert found[1000]["score"] < 0.5 and found[1001]["score"] < 0.5 and found[1002]["score"] > found[1001]["score"]
    assert found[5]["passages"][0]["start"] >= 40
    assert toxicity.train(docs, labels.where("toxic = 0"), F.lit(True)) is None
    assert {r["score"] for r in toxicity.score(docs, None).collect()} == {0.0}


# ---- weak labels

LETTERS = str.maketrans("0123456789", "ghijklmnop")


def test_weak_labels_find_junk_and_keep_prose(spark):
    rows, junk = [], set()
    for i in range(300):
        text = " ".join(f"{w} {hashlib.md5(f'{i} {k}'.encode()).hexdigest().translate(LETTERS)[:5]}" for k, w in enumerate(sentence(i, 40 + i % 50).split()))
        if i % 6 == 0:
            junk.add(i)
            text = [text.upper().replace(" ", "!! "), " ".join(w for w in text.split() for _ in range(6)), text.replace(" ", "### ")][i // 6 % 3]
        rows.append((i, text, "s"))
    rows += [(1000, None, "s"), (1001, "", "s"), (None, sentence(5, 70), "s")]
    docs = documents(spark, rows)
    got = {r["doc_id"]: r for r in weakquality.scored(docs, weakquality.train(docs)).collect()}
    assert len(got) == 303
    assert sum(got[i]["kept"] != (i not in junk) for i in range(300)) <= 3
    assert {r["doc_id"] for r in weakquality.filtered(docs).collect()} == {i for i, r in got.items() if r["kept"]}


def test_em_recovers_accuracies():
    rng = np.random.default_rng(9)
    truth = rng.random(20_000) < 0.8
    accuracy = [0.95, 0.85, 0.75, 0.7]
    own = np.stack([np.where(rng.random(len(truth)) < 0.2, 0, np.where(rng.random(len(truth)) < a, truth, ~truth) + 1) for a in accuracy], axis=1)
    patterns = Counter(map(tuple, own.tolist()))
    found = weakquality.estimate([(list(p), n) for p, n in patterns.items()])
    assert abs(found.prior - 0.8) < 0.03
    assert np.allclose(found.rates[1, :, weakquality.GOOD], accuracy, atol=0.04)


# ---- empty tables

def test_empty_documents(spark):
    none = documents(spark, [])
    assert simhash.near_duplicates(none).count() == simhash.deduplicated(none).count() == 0
    assert linequality.judged(none).count() == linequality.cleaned(none).count() == 0
    assert secrets.scan(none).count() == secrets.redacted(none).count() == 0
    assert bpe.coded(none, MULTI, P.PATTERN).count() == 0
    assert packing.packed(none, P.path("byte_bpe_50k.json")).count() == 0
    assert weakquality.train(none) is None and weakquality.filtered(none).count() == 0
    assert toxicity.train(none, spark.createDataFrame([], "doc_id bigint, toxic int"), F.lit(True)) is None


# ---- several files, full tables

def test_huffman_files_split_rows_without_id_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(huffman, "FILE_IDS", 500)
    rows = [(None, sentence(i, 20), None) for i in range(60)] + [(5, sentence(1, 20), None)] * 60 + [(i, sentence(i, 15), None) for i in range(10, 60)]
    folder = scratch_path(spark)
    huffman.write(documents(spark, rows), P.path("word_bpe_49k.json"), 1, folder)
    sizes = [r.n for r in huffman.read(spark, folder).groupBy("number").agg(F.sum("n_tokens").alias("n")).collect()]
    assert len(sizes) > 8 and max(sizes) < 1_500
    got = huffman.round_trip(documents(spark, rows), P.path("word_bpe_49k.json"), 1).orderBy("start").collect()
    ends = [r["start"] + r["n_tokens"] for r in got]
    assert [r["start"] for r in got] == [0, *ends[:-1]] and len(got) == len(rows)
    assert [r["doc_id"] for r in got] == [None] * 60 + [5] * 60 + list(range(10, 60))


def test_more_new_words_than_the_table_holds(monkeypatch):
    monkeypatch.setattr(wordtable, "WORDS", 100)
    monkeypatch.setattr(wordtable, "SLOTS", 256)
    lines = [" ".join(f"word{(i * k) % 997}" for k in range(300)) for i in range(1, 9)] + ["word1 word2", ""]
    from tokenizers import Tokenizer
    for name, keeps in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        got = tokens.Chunks(P.path(name), keeps).texts(lines)
        plain = Tokenizer.from_file(P.path(name))
        assert [np.frombuffer(g, "<u2").tolist() for g in got] == [plain.encode(t, add_special_tokens=False).ids for t in lines]
