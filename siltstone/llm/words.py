"""Words of texts as numpy arrays.  A word is a maximal run of ASCII letters and digits and of
characters beyond ASCII, with A-Z in lower case."""

from __future__ import annotations

import numpy as np

from siltstone.llm.common import RangeHash, mix64

#: Lower-case byte of each word byte, 0 for bytes outside words.
WORD_BYTE = np.array(
    [b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)],
    np.uint8,
)
_hash = RangeHash(11)


class Words:
    """``hash`` of every word, ``start`` and ``end`` of its bytes, and ``first``: the place of each
    text's first word (and the number of words at the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.lower = low = WORD_BYTE[data]
        inside = low != 0
        edge = np.zeros(len(data) + 1, bool)
        np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
        if len(data):
            edge[0], edge[-1] = inside[0], inside[-1]
        cut = offsets[1:-1]  # between texts, words end
        cut = cut[(cut > 0) & (cut < len(data))]
        cut = np.unique(cut[inside[cut] & inside[cut - 1]])
        marks = np.flatnonzero(edge)
        if len(cut):  # a cut both ends one word and starts the next
            marks = np.sort(np.concatenate([marks, cut, cut]))
        self.start, self.end = marks[0::2], marks[1::2]
        self.hash = _hash.ranges(_hash.prefix(low), self.start, self.end)
        self.first = np.searchsorted(self.start, offsets, "left")

    def __len__(self) -> int:
        return len(self.start)

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of ``size`` consecutive words of one text (fewer words, but some: all of them as
        one), and the place of each text's first shingle."""
        count = np.diff(self.first)
        n_out = np.where(count >= size, count - size + 1, (count > 0).astype(count.dtype))
        first = np.concatenate([[0], np.cumsum(n_out)])
        if first[-1] == 0:
            return np.zeros(0, np.uint64), first
        at = np.arange(first[-1]) - np.repeat(first[:-1], n_out) + np.repeat(self.first[:-1], n_out)
        length = np.minimum(np.repeat(count, n_out), size)
        out = np.zeros(len(at), np.uint64)
        padded = np.concatenate([self.hash, np.zeros(size, np.uint64)])
        for k in range(size):
            out = np.where(k < length, mix64(out + padded[at + k]) * np.uint64(0x9E3779B97F4A7C15), out)
        return out, first


def words_of(text: bytes) -> list[bytes]:
    """The words of one text, as bytes; for small inputs such as the benchmark."""
    return np.where(WORD_BYTE[np.frombuffer(text, np.uint8)] != 0, WORD_BYTE[np.frombuffer(text, np.uint8)], 32).astype(np.uint8).tobytes().split()
