"""A table from words to their ids that looks all words of a batch up at once.

A dictionary lookup of each word of a text costs more than all else in tokenizing. Here
the words of a batch stay bytes in one buffer: up to 24 of them are read as three numbers,
hashed, and found in an open table of 64-bit keys with 32 more bits to check. A longer
word is hashed by itself. Only words that the table has not seen become Python strings.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash

from tidewatch.llm.common import mixed

SLOTS = 1 << 22
WORDS = 1 << 21
MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
SHORT = 24
A, B, C, D, E = (np.uint64(x) for x in (
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD))

#: What stands before a word.
START, BLANK, LINE_END = 0, 1, 2


def split(data: bytes, separators: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs between separator bytes, empty ones included."""
    at = np.flatnonzero(np.isin(np.frombuffer(data, np.uint8), np.frombuffer(separators, np.uint8), kind="table"))
    starts = np.concatenate(([0], at + 1))
    return starts, np.append(at, len(data)) - starts


def hashes(data: bytes, starts: np.ndarray, sizes: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys and 32-bit checks of the words and what stands before them."""
    padded = np.frombuffer(data + bytes(32), np.uint8)
    eight = np.ndarray((len(padded) - 8,), "<u8", padded, 0, (1,))  # the eight bytes from every place on
    with np.errstate(over="ignore"):
        first = eight[starts] & MASKS[np.minimum(sizes, 8)]
        total = first * A + (sizes.astype(np.uint64) << np.uint64(2)) + kinds.astype(np.uint64)
        check = first * D
        for begin, factor, other in ((8, B, E), (16, C, A)):
            more = np.flatnonzero((sizes > begin) & (sizes <= SHORT))
            value = eight[starts[more] + begin] & MASKS[np.minimum(sizes[more] - begin, 8)]
            total[more] += mixed(value) * factor
            check[more] += value * other
        for n in np.flatnonzero(sizes > SHORT).tolist():
            word = data[starts[n]:starts[n] + sizes[n]]
            total[n] = np.uint64(xxhash.xxh3_64_intdigest(word)) + np.uint64(kinds[n])
            check[n] = np.uint64(xxhash.xxh64_intdigest(word, 1))
    return mixed(total), (check >> np.uint64(32)).astype(np.uint32)


class WordTable:
    """``encode`` gives the 16-bit ids of new words: a list of (kind, word) to a list of bytes."""

    def __init__(self, encode: Callable[[list[tuple[int, str]]], list[bytes]]):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.keys, self.checks = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint32)
        self.entries = np.zeros(SLOTS, np.int32)  # number of the word plus one, 0 where free
        self.starts, self.words = np.zeros(WORDS + 1, np.int64), 0
        self.flat = np.zeros(1 << 20, np.uint16)

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The words' numbers, -1 for new ones."""
        out = np.full(len(keys), -1, np.int32)
        left, place = np.arange(len(keys)), (keys & np.uint64(SLOTS - 1)).astype(np.int64)
        while len(left):
            held = self.entries[place]
            same = (held > 0) & (self.keys[place] == keys[left]) & (self.checks[place] == checks[left])
            out[left[same]] = held[same] - 1
            on = (held > 0) & ~same
            left, place = left[on], (place[on] + 1) & (SLOTS - 1)
        return out

    def add(self, keys: np.ndarray, checks: np.ndarray, made: list[bytes]) -> None:
        """Words that the table does not hold, each once."""
        sizes = np.array([len(m) // 2 for m in made], np.int64)
        used, first = int(self.starts[self.words]), self.words
        while used + sizes.sum() > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint16)])
        self.flat[used:used + sizes.sum()] = np.frombuffer(b"".join(made), "<u2")
        self.starts[first + 1:first + 1 + len(made)] = used + np.cumsum(sizes)
        self.words += len(made)
        left, place = np.arange(len(keys)), (keys & np.uint64(SLOTS - 1)).astype(np.int64)
        while len(left):
            free = np.flatnonzero(self.entries[place] == 0)
            slots, winner = np.unique(place[free], return_index=True)
            taken = free[winner]
            self.entries[slots] = first + 1 + left[taken]
            self.keys[slots], self.checks[slots] = keys[left[taken]], checks[left[taken]]
            on = np.ones(len(left), bool)
            on[taken] = False
            left, place = left[on], (place[on] + 1) & (SLOTS - 1)

    def ids(self, data: bytes, starts: np.ndarray, sizes: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words in order, and where each word's end."""
        parts = [self._ids(data, *(x[at:at + WORDS] for x in (starts, sizes, kinds))) for at in range(0, max(1, len(starts)), WORDS)]
        if len(parts) == 1:
            return parts[0]
        before = np.cumsum([0] + [len(ids) for ids, _ in parts])
        return np.concatenate([ids for ids, _ in parts]), np.concatenate([ends + b for (_, ends), b in zip(parts, before)])

    def _ids(self, data: bytes, starts: np.ndarray, sizes: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for at most as many words as the table holds."""
        keys, checks = hashes(data, starts, sizes, kinds)
        found = self.find(keys, checks)
        new = np.flatnonzero(found < 0)
        if len(new):
            new = new[np.unique(keys[new], return_index=True)[1]]
            if self.words + len(new) > WORDS:
                self.clear()
                new = np.unique(keys, return_index=True)[1]
            words = [(k, data[a:a + n].decode()) for k, a, n in zip(kinds[new].tolist(), starts[new].tolist(), sizes[new].tolist())]
            self.add(keys[new], checks[new], self.encode(words))
            found = self.find(keys, checks)
        begin = self.starts[found]
        count = self.starts[found + 1] - begin
        ends = np.cumsum(count)
        place = np.repeat(begin - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)
        return self.flat[place], ends
