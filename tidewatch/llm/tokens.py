"""Tokenizer files applied fast: each distinct word of a worker is encoded once.

Both vocabularies split a text by a pattern before merging, and no match of either
pattern spans the borders cut here (a blank goes with the word after it, or is dropped),
so the ids of a text are the ids of its chunks in order. New chunks are encoded by
the tokenizers library in one go, with a separator between them that no chunk holds.
"""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np

from tidewatch.llm.common import worker_state
from tidewatch.llm.wordtable import BLANK, LINE_END, START, WordTable, split

#: Cached chunks of a worker; the cache starts anew beyond it.
CACHE_CHUNKS = 400_000
#: Unicode white space, the library's sense of it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LEADING_BLANK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: White space besides blanks and line ends.
OTHER_SPACE = re.compile(f"[{SPACE}]".replace("\t-\r ", "\t\x0b-\r"))
MARK = "\ue000"
#: Stands before a word that begins a line.
FIRST = "\x00"
SIGMA = "\u03a3"
TAIL = ".,;:!?|#$%&*)\""


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    out, free = {}, 256
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 255 and byte != 173:
            out[byte] = chr(byte)
        else:
            out[byte] = chr(free)
            free += 1
    return out


def even(text: str) -> bool:
    """White space is single blanks and line ends between words only."""
    return not (OTHER_SPACE.search(text) or "  " in text or "\n\n" in text or " \n" in text or "\n " in text
                or FIRST in text or text[0] in " \n" or text[-1] in " \n")


class SpacedChunks:
    """Texts cut where a blank goes with the word after it; ``learn`` puts the ids of new chunks into ``known``."""

    keeps_space = True

    def __init__(self):
        self.table = WordTable(self._new_words)
        self.split = LEADING_BLANK.findall
        self.known: dict = {}
        self.spaced: dict = {}  # of a word with a blank before it

    def learn(self, chunks: set[str]) -> None:
        raise NotImplementedError

    def trim(self, limit: int) -> None:
        if len(self.known) + len(self.spaced) > limit:
            self.known.clear()
            self.spaced.clear()

    def parts(self, texts: list[str | None]) -> list[list]:
        """The values of the chunks of every text, in order.

        Texts whose white space is single blanks and line ends are split at once; others go through the pattern.

        ``spaced`` holds the ids of a word with the blank before it; a word that begins a line is marked by FIRST.
        """
        get, known = self.spaced.get, self.known.get
        parts, plain = [], []
        for t in texts:
            plain.append(bool(t) and even(t))
            parts.append((FIRST + t.replace("\n", f" \n {FIRST}")).split(" ") if plain[-1] else self.split(t) if t else [])
        found = [list(map(get if e else known, p)) for p, e in zip(parts, plain)]
        new, new_spaced = set(), {}
        for p, f, e in zip(parts, found, plain):
            if None in f:
                missing = [c for c, x in zip(p, f) if x is None]
                if e:
                    new_spaced.update((c, c[1:] if c[0] == FIRST else c if c == "\n" else " " + c) for c in missing)
                else:
                    new.update(missing)
        self.learn(new.union(c for c in new_spaced.values() if c not in self.known))
        for c, chunk in new_spaced.items():
            self.spaced[c] = self.known[chunk] if chunk in new or chunk[0] != " " else self.known.pop(chunk)
        return [list(map(get if e else known, p)) if None in f else f for p, f, e in zip(parts, found, plain)]

    def texts(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text."""
        self.trim(CACHE_CHUNKS)
        out = [b""] * len(texts)
        fast, slow = [], []
        for n, t in enumerate(texts):
            if t:
                (fast if (even(t) if self.keeps_space else MARK not in t) else slow).append(n)
        if fast:
            for n, ids in zip(fast, self._looked_up([self.prepared(texts[n]) for n in fast])):
                out[n] = ids
        for n, parts in zip(slow, self.parts([texts[n] for n in slow])):
            out[n] = b"".join(parts)
        return out

    def _looked_up(self, texts: list[str]) -> list[bytes]:
        """The ids of even texts, all words at once."""
        parts = [t.encode() for t in texts]
        data = b"\n".join(parts)
        starts, sizes = split(data, b" \n" if self.keeps_space else b" \t\n\x0b\x0c\r")
        begins = np.cumsum([0] + [len(p) + 1 for p in parts])
        if self.keeps_space:
            kinds = np.where(np.frombuffer(data, np.uint8)[np.maximum(starts - 1, 0)] == 32, BLANK, LINE_END)
            kinds[np.searchsorted(starts, begins[:-1])] = START
        else:
            held = sizes > 0
            starts, sizes = starts[held], sizes[held]
            kinds = np.zeros(len(starts), np.int64)
        ids, ends = self.table.ids(data, starts, sizes, kinds)
        cuts = np.append(0, ends)[np.searchsorted(starts, begins)].tolist()
        whole = ids.astype("<u2").tobytes()
        return [whole[2 * x:2 * y] for x, y in zip(cuts, cuts[1:])]

    def _new_words(self, words: list[tuple[int, str]]) -> list[bytes]:
        """Ids for the table: of the word with the blank or the line end that stands before it."""
        chunks = [" " + w if kind == BLANK else w for kind, w in words]
        self.known.clear()
        self.learn(set(chunks))
        line_end = self.line_end() if self.keeps_space else b""
        return [line_end + self.known[c] if kind == LINE_END else self.known[c] for (kind, _), c in zip(words, chunks)]

    def prepared(self, text: str) -> str:
        return text

    def line_end(self) -> bytes:
        if "\n" not in self.known:
            self.learn({"\n"})
        return self.known["\n"]


class Chunks(SpacedChunks):
    """Ids (little-endian 16 bit) of texts. ``keeps_space``: white space is part of the tokens."""

    def __init__(self, file: str, keeps_space: bool):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = True
        self.keeps_space = keeps_space
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = WhitespaceSplit()
        self.letters = byte_letters()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        blank = self.letters[32]
        for token, at in vocabulary.items():
            self.edge[at] = token[0] == blank if keeps_space else token.endswith("</w>")
        self.between = "\n" if keeps_space else f" {MARK} "
        self.mark = np.array(self._encode("\n" if keeps_space else MARK), np.uint32)

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def prepared(self, text: str) -> str:
        # Lower case is the first step of the file that drops blanks; only the sigma depends on what stands beside it.
        return text if self.keeps_space or SIGMA in text else text.lower()

    def _one(self, chunk: str) -> bytes:
        made = self.known[chunk] = np.array(self._encode(chunk), "<u2").tobytes()
        return made

    def _is_word(self, chunk: str) -> bool:
        """One match of the pattern that the normalizer leaves as it is: letters only (after a blank, where kept)."""
        if self.keeps_space:
            return chunk[0] == " " and chunk[1:].isalpha()
        return chunk.isalpha() and (chunk.isascii() or unicodedata.is_normalized("NFC", chunk) and SIGMA not in chunk) and chunk == chunk.lower()

    def _encode_words(self, words: list[str]) -> None:
        """The model alone, without the steps that don't change such words; a token shows where a word ends or begins."""
        table = self.letters
        for at in range(0, len(words), 1000):
            group = words[at:at + 1000]
            written = [c if c.isascii() and not self.keeps_space else c.encode().decode("latin-1").translate(table) for c in group]
            ids = np.array(self.model.encode_batch_fast([" ".join(written)], add_special_tokens=False)[0].ids, np.int64)
            data = ids.astype("<u2").tobytes()
            edges = 2 * np.flatnonzero(self.edge[ids])
            if len(edges) != len(group):
                raise ValueError("the vocabulary does not mark the edges of words")
            starts, ends = (edges, [*edges[1:], len(data)]) if self.keeps_space else ([0, *(edges[:-1] + 2)], edges + 2)
            self.known.update((c, data[a:b]) for c, a, b in zip(group, starts, ends))

    def learn(self, chunks: set[str]) -> None:
        """Encode new chunks; marks after a last letter are a match of their own, so they are split off first."""
        cut, wanted = [], set()
        for c in chunks:
            core = c.rstrip(TAIL)
            if core is c or not core or not core[-1].lower().isalpha():
                core, tail = c, ""
            else:
                tail = c[len(core):]
                wanted.add(tail)
            wanted.add(core)
            cut.append((c, core, tail))
        self._encode_all(list(wanted.difference(self.known)))
        known = self.known
        for c, core, tail in cut:
            if tail:
                known[c] = known[core] + known[tail]

    def _encode_all(self, chunks: list[str]) -> None:
        words, rest = [], []
        for c in chunks:
            (words if self._is_word(c) else rest).append(c)
        self._encode_words(words)
        odd = {c for c in rest if c[0] in "\t\n\x0b\x0c\r" or c[:2] == "  " or not c.strip() or MARK in c}
        plain = [c for c in rest if c not in odd] if odd else rest
        for c in odd:
            self._one(c)
        groups = [plain[i:i + 1000] for i in range(0, len(plain), 1000)]
        for group, made in zip(groups, self.tokenizer.encode_batch_fast(
                [self.between.join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(made.ids, np.uint32)
            at = np.ones(max(0, len(ids) - len(self.mark) + 1), bool)
            for k, m in enumerate(self.mark):
                at &= ids[k:k + len(at)] == m
            cuts = np.flatnonzero(at)
            if len(cuts) != len(group) - 1:  # a chunk that reads differently beside others
                for c in group:
                    self._one(c)
                continue
            data = ids.astype("<u2").tobytes()
            starts = [0, *(2 * (cuts + len(self.mark))).tolist()]
            ends = [*(2 * cuts).tolist(), len(data)]
            for c, a, b in zip(group, starts, ends):
                self.known[c] = data[a:b]


def chunks(file: str, keeps_space: bool) -> Chunks:
    """One per worker process and file."""
    return worker_state(("chunks", file, keeps_space), lambda: Chunks(file, keeps_space))
