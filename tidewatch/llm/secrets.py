"""Secret scan: a keyword automaton first, anchored patterns only at its hits, then embedded checksums.

One Aho-Corasick pass over the ASCII-lower-cased bytes of a text finds where a
keyword or a token prefix stands; patterns are matched anchored at those places only.
Hex runs have no keyword: their prefilter is a search for 24 class bytes in a row.
Access tokens whose last six characters are the base-62 CRC-32 of the 30 before
(the scheme of several code hosts and package registries) are added as kind
``checked`` only if that checksum holds.

Spans are code points, end exclusive, ordered by start and then by kind in ``KINDS``.
Defined cases: null is an empty text without spans; very long texts are scanned whole
in linear time; repeated rows give one row each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.common import DOCUMENT, map_rows, take

KINDS = ["assign", "access", "hex", "checked"]
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
CHECKED = re.compile(rb"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
#: Keywords of each kind, lower case.
KEYWORDS = {"password": 0, "passwd": 0, "secret": 0, "token": 0, "apikey": 0, "api_key": 0, "akia": 1,
            "ghp_": 3, "gho_": 3, "ghu_": 3, "ghs_": 3, "ghr_": 3, "npm_": 3}
HEX_CLASS = bytes(1 if chr(b) in "0123456789abcdef" else 0 for b in range(256))
HEX_RUN = b"\x01" * 24
DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ASSIGN_LEAST, ACCESS_LEAST = 6, 20


def automaton() -> ahocorasick.Automaton:
    words = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        words.add_word(word, (kind, len(word)))
    words.make_automaton()
    return words


def checksum_holds(body: bytes, check: bytes) -> bool:
    value, text = zlib.crc32(body), ""
    while value:
        value, digit = divmod(value, 62)
        text = DIGITS62[digit] + text
    return text.rjust(6, "0").encode() == check


def byte_spans(data: bytes, words: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes, ordered."""
    found, free = [], [0, 0, 0, 0]
    hits = [(end + 1 - size, kind) for end, (kind, size) in words.iter(data.lower().decode("latin-1"))]
    hits.sort()
    for start, kind in hits:
        if start < free[kind]:
            continue
        match = (ASSIGN, ACCESS, None, CHECKED)[kind].match(data, start)
        if not match:
            continue
        if kind == 3 and not checksum_holds(match[1], match[2]):
            continue
        free[kind] = match.end()  # a match that is then dropped still uses its characters up
        if kind == 0 and len(match[1]) < ASSIGN_LEAST or kind == 1 and len(match[0]) < ACCESS_LEAST:
            continue
        found.append((start, kind, match.end()))
    classes = data.translate(HEX_CLASS)
    at = classes.find(HEX_RUN)
    while at >= 0:
        end = classes.find(b"\x00", at)
        end = len(data) if end < 0 else end
        found.append((at, 2, end))
        at = classes.find(HEX_RUN, end)
    found.sort()
    return found


def spans(text: str | None, words: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, ordered by start and kind."""
    data = (text or "").encode()
    found = byte_spans(data, words)
    if not found or len(data) == len(text):
        return found
    points = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    place = lambda at: int(points[at - 1]) if at else 0
    return [(place(a), kind, place(b)) for a, kind, b in found]


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in found)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans: array of (kind, start, end)."""
    schema = "doc_id bigint, spans array<struct<kind:string,start:int,end:int>>"

    def work(rows):
        words = automaton()
        return {"doc_id": rows["doc_id"],
                "spans": [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans(t, words)] for t in rows["text"]]}

    return map_rows(take(docs, doc_id="bigint", text="string"), schema, work)


def digested(found: DataFrame) -> DataFrame:
    """Counts of each base kind, the digest of base spans, and all spans as text."""
    kinds = lambda *names: F.filter("spans", lambda s: s["kind"].isin(*names))
    text = lambda part: F.array_join(F.transform(part, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id", *[F.size(kinds(k)).cast("bigint").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(text(kinds(*KINDS[:3])).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with every span replaced by ``mark``; overlapping spans are one."""
    def clean(text, words):
        if text is None:
            return None
        parts, at = [], 0
        for start, _, end in spans(text, words):
            if start >= at:
                parts += [text[at:start], mark]
            at = max(at, end)
        return "".join([*parts, text[at:]]) if parts else text

    def work(rows):
        words = automaton()
        texts = [clean(t, words) for t in rows["text"]]
        return rows | {"text": texts, "n_chars": [n if t is None or t is o else len(t) for t, o, n in zip(texts, rows["text"], rows["n_chars"])]}

    return map_rows(take(docs, **DOCUMENT), ", ".join(f"{c} {k}" for c, k in DOCUMENT.items()), work)
