"""Hashes of words and of windows of words, for a whole Arrow column of texts at a time.

Words are maximal runs of bytes other than ASCII white space. All arithmetic is modulo 2**64 in numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_STEP = 0xD6E8FEB86659FD93
_GOLD = np.uint64(0x9E3779B97F4A7C15)
# what is kept of eight bytes where a word has only so many of them
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
SHINGLE = 5


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes without gaps, and len + 1 offsets. A null is an empty text."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of each text of a column: bounds in `raw`, the text each belongs to, and on demand their hashes."""

    def __init__(self, column: pa.Array, lower: bool = False):
        if lower:
            column = pc.utf8_lower(column.cast(pa.large_string()))
        self.raw, self.offsets = _bytes(column)
        space = np.ones(len(self.raw) + 1, bool)
        space[:-1] = (self.raw == 32) | ((self.raw >= 9) & (self.raw <= 13))
        first = np.zeros(len(self.raw) + 1, bool)
        first[self.offsets] = True
        before = np.ones(len(self.raw) + 1, bool)
        before[1:] = space[:-1]
        self.starts = np.flatnonzero(~space & (before | first))
        ends = space.copy()
        ends |= first
        ends &= ~before
        self.ends = np.flatnonzero(ends)
        counts = np.searchsorted(self.starts, self.offsets)
        self.n_texts = len(self.offsets) - 1
        self.counts = np.diff(counts)
        self.first_word = counts[:-1]
        self.text_of = np.repeat(np.arange(self.n_texts), self.counts)

    def words_of(self, text: int) -> list[bytes]:
        """The words of one text."""
        return self.raw[self.offsets[text] : self.offsets[text + 1]].tobytes().split()

    def hashes(self) -> np.ndarray:
        """64 bits of each word: every eight bytes are mixed with a number of their place, the results summed and mixed
        with the length. Long words with equal hashes can be made on purpose, so this may propose what is alike but never
        decide it."""
        size = self.ends - self.starts
        padded = np.zeros(len(self.raw) + 8, np.uint8)
        padded[: len(self.raw)] = self.raw
        eight = np.ndarray((len(self.raw) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each byte on
        total = mix((eight[self.starts] & _KEEP[np.minimum(size, 8)]) + _GOLD)
        long = np.flatnonzero(size > 8)
        if len(long):
            more = (size[long] - 1) // 8
            first = np.cumsum(more) - more
            place = np.arange(int(more.sum())) - np.repeat(first, more) + 1
            at = np.repeat(self.starts[long], more) + 8 * place
            left = np.minimum(np.repeat(self.ends[long], more) - at, 8)
            key = mix((place.astype(np.uint64) + np.uint64(1)) * _GOLD)
            total[long] += np.add.reduceat(mix((eight[at] & _KEEP[left]) ^ key), first)
        return mix(total + size.astype(np.uint64) * _GOLD)

    def windows(self, width: int, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of `width` words within one text, and the index of the first word of each."""
        words = self.hashes() if of is None else of
        n = len(words) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        total = np.zeros(n, np.uint64)
        for k in range(width):
            total *= np.uint64(_STEP)
            total += words[k : k + n]
        at = np.flatnonzero(self.text_of[:n] == self.text_of[width - 1 :])
        return mix(total[at]), at

    def shingle_hashes(self, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all shingles, text after text, and where each text's begin. A text of fewer words has one shingle: all its words."""
        words = self.hashes()
        hashes, at = self.windows(width, of=words)
        cut = np.searchsorted(at, np.append(self.first_word, len(words)))
        short = np.flatnonzero((self.counts > 0) & (self.counts < width))
        if len(short):
            own = []
            for i in short:
                total = int(self.counts[i])
                for w in words[self.first_word[i] : self.first_word[i] + self.counts[i]]:
                    total = (total * _STEP + int(w)) & 0xFFFFFFFFFFFFFFFF
                own.append(total)
            hashes = np.insert(hashes, cut[short], mix(np.array(own, np.uint64)))
            more = np.zeros(len(cut), np.int64)
            more[short + 1] = 1
            cut = cut + np.cumsum(more)
        return hashes, cut

    def shingles(self, width: int = SHINGLE) -> list[np.ndarray]:
        """Of each text, the sorted set of its shingles' hashes."""
        hashes, cut = self.shingle_hashes(width)
        return [np.unique(hashes[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
