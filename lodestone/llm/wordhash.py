"""Hashes of words and word sequences of Arrow text columns, in numpy over the column's bytes.

Words are runs `[^\\x20\\x09-\\x0D]+`. That white space is ASCII, so bytes of UTF-8 texts can be classed one by one.
A word's hash is 64 bits, the same in every process: its bytes go eight at a time into a state that is mixed after
each, so it is no polynomial and words that differ by a pattern don't collide for it. A sequence's hash mixes those of its
halves. A second `lane` is an independent hash; both together are 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
PLAIN = np.arange(256, dtype=np.uint8)
LOWER = PLAIN.copy()
LOWER[65:91] = PLAIN[97:123]
#: Bytes that are worked on at once; a longer text is on its own.
CHUNK = 500_000
#: Keys of the lanes, and the masks that leave the first k bytes of eight.
KEYS = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))
FIRST = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], U)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of a sequence of two parts."""
    return mix(a * U(0xD6E8FEB86659FD93) + b * U(0xA0761D6478BD642F) + U(1))


class Words:
    """Of some consecutive texts: the words' hashes, bounds in `data`, and the text that each word is in."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        self.data, self.n_texts, self._table = data, len(offsets) - 1, table
        m = IS_WORD[data]
        first, last = m.copy(), m.copy()
        first[1:] &= ~m[:-1]
        last[:-1] &= ~m[1:]
        begins = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[begins] = m[begins]
        ends = begins[begins > 0] - 1
        last[ends] = m[ends]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.text = np.searchsorted(offsets, self.start, "right") - 1
        #: Words before each text, and all.
        self.bounds = np.searchsorted(self.start, offsets)
        self.hash = self.hashes(0)

    def hashes(self, lane: int) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, U)
        size = self.end - self.start
        padded = np.zeros(len(self.data) + 8, np.uint8)
        padded[:-8] = self._table[self.data] if self._table is not PLAIN else self.data
        eight = np.ndarray((len(self.data),), "<u8", padded, 0, (1,))  # the eight bytes from each one on
        h = mix(KEYS[lane] + size.astype(U))
        which, at = None, 0
        while True:
            left = (size if which is None else size[which]) - at
            start = (self.start if which is None else self.start[which]) + at
            block = eight[start] & FIRST[np.minimum(left, 8)]
            if which is None:
                h = mix(h ^ block)
            else:
                h[which] = mix((h[which] ^ block) + KEYS[lane])
            at += 8
            which = np.flatnonzero(size > at) if which is None else which[size[which] > at]
            if not len(which):
                return h


def chunks(column: pa.Array, table: np.ndarray = PLAIN) -> Iterator[tuple[int, Words]]:
    """The texts of a string column in turn: the number of the first text, and the words of some from it on. Null
    texts have none."""
    if column.null_count:
        column = column.fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int32 if column.type == pa.string() else np.int64)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        yield at, Words(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], table)
        at = end


def sequences(words: Words, k: int, hash: np.ndarray | None = None) -> np.ndarray:
    """The hash of the k words from each one on, of the lane `hash`; only those that end in the same text mean something."""
    h = words.hash if hash is None else hash
    n = len(h)
    if n < k:
        return np.zeros(0, U)
    out, have, width = None, 0, 1
    while True:  # h: hashes of `width` words from each one on
        if k & width:
            out = h if out is None else joined(h[: n - have - width + 1], out[width:])
            have += width
        if 2 * width > k:
            return out[: n - k + 1]
        h, width = joined(h[:-width], h[width:]), 2 * width


def inside(words: Words, k: int) -> np.ndarray:
    """Whether the k words from each one on are in one text."""
    n = len(words.hash)
    return words.text[: n - k + 1] == words.text[k - 1 :] if n >= k else np.zeros(0, bool)


def sliding(x: np.ndarray, k: int, what=np.minimum) -> np.ndarray:
    """The least (or greatest) of each k consecutive values."""
    if len(x) < k:
        return x[:0]
    width = 1
    while width * 2 <= k:
        x, width = what(x[:-width], x[width:]), width * 2
    rest = k - width
    return what(x[: len(x) - rest], x[rest:]) if rest else x
