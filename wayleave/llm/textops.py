"""Words and word shingles of many texts at once, in numpy, over the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _numbers(n: int, seed: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=np.uint64) + U(seed)) * U(0x9E3779B97F4A7C15))


_STEP = U(0xD6E8FEB86659FD93)
_PLACE = _numbers(64, 101) | U(1)


#: For each byte, itself with A-Z in lower case.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: For each byte, itself.
AS_IS = np.arange(256, dtype=np.uint8)
#: Whether a byte belongs to a word: words are runs of other than ASCII white space.
SPACED = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])
#: The same where words are runs of ASCII letters, digits and all that is not ASCII.
ALNUM = np.array([b >= 0x80 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
#: Masks that leave the first 0 to 8 bytes of a block.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def pieces(column: pa.Array | pa.ChunkedArray, most: int = 1 << 19) -> Iterator[tuple[int, pa.Array]]:
    """The column in slices of about `most` bytes, or of one text if that is longer; with the slice's first row."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a = pc.fill_null(a.cast(pa.large_string()), "")
    if not len(a):
        return
    ends = np.cumsum(pc.binary_length(a).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(a):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield at, a.slice(at, to - at)
        at = to


def raw(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large_string array without nulls."""
    offsets = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1 + a.offset)[a.offset :]
    buf = a.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Hashes of all words of a slice of texts; `doc` has each word's row in the slice, `starts` and `size` its bytes, `first` and `count` each row's words.

    A word's hash mixes each of its blocks of 8 bytes with the block's number, adds these up, and mixes the sum with the
    word's length: every byte counts at its place, however long the word is. `fold` maps the bytes before they are hashed.
    """

    def __init__(self, a: pa.Array, is_word: np.ndarray, fold: np.ndarray = LOWER):
        data, offsets = raw(a)
        n = len(a)
        word = is_word[data]
        begins = np.zeros(data.size + 1, bool)
        begins[offsets[:-1]] = True
        starts = word.copy()
        if data.size:
            starts[1:] &= ~word[:-1] | begins[1:-1]
        self.starts = at = np.flatnonzero(starts)
        self.doc = np.searchsorted(offsets, at, side="right") - 1
        self.count = np.bincount(self.doc, minlength=n)
        self.first = np.cumsum(self.count) - self.count
        if at.size:
            self.size = size = np.add.reduceat(word, at, dtype=np.int64)
            padded = np.zeros(data.size + 8, np.uint8)
            padded[:-8] = fold[data]
            from_each = np.ndarray(data.size + 1, np.dtype("<u8"), padded, 0, (1,))  # the 8 bytes from each place on
            blocks = (size + 7) >> 3
            begin = np.cumsum(blocks) - blocks
            number = np.arange(int(blocks.sum())) - np.repeat(begin, blocks)
            value = from_each[np.repeat(at, blocks) + 8 * number] & _FIRST[np.minimum(np.repeat(size, blocks) - 8 * number, 8)]
            mixed = mix(value + _numbers(int(number.max()) + 1, 11)[number])
            self.hash = mix(np.add.reduceat(mixed, begin) + size.astype(np.uint64) * _STEP)
        else:
            self.hash, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and that word's number; words with fewer than k left in their text have none."""
        w, n = self.hash, self.hash.size - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        total = np.zeros(n, np.uint64)
        for j in range(k):
            total += w[j : j + n] * _PLACE[j]
        return mix(total[at] + U(k)), at

    def short(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of texts with at least one and fewer than k words: hash of the whole sequence, and the text's row."""
        rows = np.flatnonzero((self.count > 0) & (self.count < k))
        out = np.zeros(rows.size, np.uint64)
        for j in range(k - 1):
            more = self.count[rows] > j
            out[more] += self.hash[self.first[rows[more]] + j] * _PLACE[j]
        return mix(out + self.count[rows].astype(np.uint64)), rows
