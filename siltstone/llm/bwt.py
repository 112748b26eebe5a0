"""Burrows-Wheeler transforms of shards of byte segments, and their merge.

Each shard's segments, every one with an end mark, are sorted as rotations, which gives the shard's transform;
its symbols are the four bytes before each rotation (two, if there are too many different ones).  The merge never sorts rotations again: it refines an
interleave (for each place of the merged order, the shard it comes from).  In a round the shards'
symbols are read in the order of the interleave and the interleave is sorted stably by them; after t rounds of
symbols of m bytes it orders rotations by their first mt bytes.  Places where neighbours part are marked in the round in which
they do, which gives the common prefixes, and the intervals left unmarked are the repeated strings.
"""

from __future__ import annotations

import numpy as np

END = 0


def _ranked(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key, kind="stable")
    s = key[order]
    new = np.zeros(len(key), np.int64)
    new[1:] = s[1:] != s[:-1]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(new)
    return out


class Segments:
    """Codes of segments with their end marks: ``start`` and ``size`` include the mark."""

    def __init__(self, data: np.ndarray, size: np.ndarray):
        used = np.zeros(256, bool)
        used[data] = True
        code = np.cumsum(used).astype(np.uint16)  # text has fewer than 255 different bytes
        if used.sum() > 255:
            raise ValueError("segments must be UTF-8 text")
        self.size = size + 1
        self.start = np.cumsum(self.size) - self.size
        self.code = np.full(self.size.sum(), END, np.uint16)
        inside = np.ones(len(self.code), bool)
        inside[self.start + size] = False
        self.code[inside] = code[data]
        self.row = np.repeat(np.arange(len(size)), self.size)

    def moved(self, at: np.ndarray, by: int) -> np.ndarray:
        """Places ``by`` further on, in rotation."""
        row = self.row[at]
        return self.start[row] + (at - self.start[row] + by) % self.size[row]


def rotations(seg: Segments, rows: slice) -> np.ndarray:
    """The places of the rotations of some segments in their order (equal ones by segment)."""
    lo, hi = seg.start[rows][0], seg.start[rows][-1] + seg.size[rows][-1]
    at = np.arange(lo, hi)
    following = at + 1 - lo
    following[seg.start[rows] + seg.size[rows] - 1 - lo] = seg.start[rows] - lo
    code = seg.code[lo:hi].astype(np.uint64)
    key = code
    for _ in range(6):
        code = code[following]
        key = key << np.uint64(8) | code
    rank, depth = _ranked(key), 7
    most = 2 * int(seg.size[rows].max())  # two different rotations part before that
    while depth < most and rank.max() + 1 < len(at):
        rank = _ranked(rank * len(at) + rank[seg.moved(at, depth) - lo])
        depth *= 2
    return at[np.argsort(rank, kind="stable")]


def _symbols(seg: Segments, own: np.ndarray, length: int) -> tuple[np.ndarray, int]:
    """The ranks, of 16 bits, of the bytes before each rotation, and how many bytes make a symbol."""
    before = [seg.code[seg.moved(own, -k)].astype(np.uint32) for k in range(1, 5)]
    if length % 4 == 0:
        four = before[3] << np.uint32(24) | before[2] << np.uint32(16) | before[1] << np.uint32(8) | before[0]
        values, rank = np.unique(four, return_inverse=True)
        if len(values) <= 1 << 16:
            return rank.astype(np.uint16), 4
    return (before[1] << np.uint32(8) | before[0]).astype(np.uint16), 2


def merge(seg: Segments, shards: list[slice], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The merged order of all rotations, the common prefix of each with the one before it (whole
    symbols, in bytes, at most ``length``), and the start of each interval that shares ``length`` bytes."""
    orders = [rotations(seg, s) for s in shards]
    own = np.concatenate(orders)
    symbols, step = _symbols(seg, own, length)
    n = len(own)
    kind = np.uint8 if len(shards) <= 256 else np.uint16
    interleave = np.repeat(np.arange(len(shards)), [len(o) for o in orders]).astype(kind)
    parted = np.zeros(n, bool)
    parted[0] = True
    common = np.full(n, length, np.int32)
    common[0] = 0
    read = np.empty(n, np.uint16)
    for depth in range(0, length, step):
        read[np.argsort(interleave, kind="stable")] = symbols
        turn = np.argsort(read, kind="stable")
        block = np.cumsum(parted, dtype=np.int32)[turn]
        sorted_ = read[turn]
        new = (sorted_[1:] != sorted_[:-1]) | (block[1:] != block[:-1])
        fresh = np.flatnonzero(new & ~parted[1:]) + 1
        common[fresh] = depth
        parted[fresh] = True
        interleave = interleave[turn]
    merged = np.empty(n, np.int64)
    merged[np.argsort(interleave, kind="stable")] = own
    return merged, common, np.flatnonzero(parted)
