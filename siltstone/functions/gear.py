"""Tables and numpy kernels: gear hashes, sampled features, content-defined cut points.

Tables are derived from SHA-256 (the gear value of a byte is the first eight bytes of the digest of that
byte), so that SQL can rebuild them.
"""

from __future__ import annotations

import hashlib

import numpy as np

FEATURES = 12
#: Bits that must be 0 in a sampled hash: 1/32 (five bits), 1/4 (two), all.  Fixed values.
SAMPLE_MASKS = {5: 0x0001000100010011, 2: 0x0000000100000001, 0: 0}


def _digest(data: bytes) -> int:
    return int.from_bytes(hashlib.sha256(data).digest()[:8], "big")


GEAR = np.array([_digest(bytes([b])) for b in range(256)], np.uint64)
CUT_GEAR = (GEAR >> np.uint64(32)).astype(np.uint32)
MULTIPLY = np.array([_digest(f"a{j}".encode()) | 1 for j in range(FEATURES)], np.uint64)
ADD = np.array([_digest(f"b{j}".encode()) for j in range(FEATURES)], np.uint64)


def place_in_row(offsets: np.ndarray) -> np.ndarray:
    size = np.diff(offsets)
    return np.arange(offsets[-1]) - np.repeat(offsets[:-1], size)


def rolling(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """h = 2h + gear[byte] modulo 2**64 from the start of each row, by doubling: the hash of the last 2k bytes
    is that of the last k plus the shifted one of the k before."""
    h = GEAR[data]
    at = place_in_row(offsets)
    k = 1
    while k < 64 and k < len(h):
        more = np.where(at[k:] >= k, h[:-k] << np.uint64(k), np.uint64(0))
        h = h.copy()
        h[k:] += more
        k *= 2
    return h


def features(data: np.ndarray, offsets: np.ndarray, sample_bits: int = 5) -> np.ndarray:
    """The largest value of each linear transform over the sampled hashes of each row; 0 without any."""
    n = len(offsets) - 1
    out = np.zeros((n, FEATURES), np.uint64)
    h = rolling(data, offsets)
    chosen = np.flatnonzero((h & np.uint64(SAMPLE_MASKS[sample_bits])) == 0)
    if len(chosen):
        first = np.searchsorted(chosen, offsets)
        has = np.diff(first) > 0
        s = h[chosen]
        for j in range(FEATURES):
            out[has, j] = np.maximum.reduceat(s * MULTIPLY[j] + ADD[j], first[:-1][has])
    return out


def cut_parameters(average: int) -> tuple[int, int, int]:
    """Smallest and largest size, and the mask of the cut condition, for an average size.  The share of
    sizes between the smallest and the normal one is empty for every average, so that one mask is in force."""
    bits = round(float(np.log2(average)))
    return average // 2, average * 2, (1 << max(1, bits - 1)) - 1


def cut_points(data: np.ndarray, offsets: np.ndarray, average: int) -> list[np.ndarray]:
    """Ends of the content-defined pieces of each row.  All rows move in lockstep, a byte at a time: a
    piece starts with a hash of 0 at its smallest size, fp = fp/2 + gear[byte], and ends after the
    byte at which the masked hash is 0, or at its largest size or the row's end."""
    least, most, mask = cut_parameters(average)
    n = len(offsets) - 1
    ends: list[list[int]] = [[] for _ in range(n)]
    row = np.flatnonzero(np.diff(offsets) > 0)
    start, stop = offsets[row].copy(), offsets[row + 1]
    at = np.minimum(start + least, stop)
    fp = np.zeros(len(row), np.uint32)
    while len(row):
        limit = np.minimum(start + most, stop)
        inside = at < limit
        if inside.any():
            fp = np.where(inside, (fp >> np.uint32(1)) + CUT_GEAR[data[np.minimum(at, len(data) - 1)]], fp)
            hit = inside & ((fp & np.uint32(mask)) == 0)
        else:
            hit = inside
        at = np.where(inside, at + 1, at)
        done = hit | ~inside
        if done.any():
            for r, e in zip(row[done].tolist(), at[done].tolist()):
                ends[r].append(e - int(offsets[r]))
            start = np.where(done, at, start)
            at = np.where(done, np.minimum(start + least, stop), at)
            fp = np.where(done, np.uint32(0), fp)
            live = start < stop
            if not live.all():
                row, start, stop, at, fp = row[live], start[live], stop[live], at[live], fp[live]
    return [np.array(e, np.int32) for e in ends]


#: Bytes of a window and base of its polynomial.  Fixed values.
WINDOW_N, BASE_N = 64, 257


def window_polynomials(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW_N, base: int = BASE_N) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial fingerprints modulo 2**64 of all windows of each row, except the last one, and the place
    of each row's first."""
    size = np.maximum(np.diff(offsets) - window, 0)
    first = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(first[-1]) - np.repeat(first[:-1], size) + np.repeat(offsets[:-1], size)
    out = np.zeros(len(at), np.uint64)
    for k in range(window):
        out = out * np.uint64(base) + data[at + k].astype(np.uint64)
    return out, first


def ntransform(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each of 12 transforms modulo 2**32, the window fingerprint that attains its maximum (the first)."""
    fp, first = window_polynomials(data, offsets)
    n = len(offsets) - 1
    out = np.zeros((n, FEATURES), np.uint64)
    for j in range(FEATURES):
        value = (fp * MULTIPLY[j] + ADD[j]) & np.uint64(0xFFFFFFFF)
        for r in range(n):
            part = value[first[r] : first[r + 1]]
            if len(part) and part.max() > 0:
                out[r, j] = fp[first[r] + int(part.argmax())]
    return out


#: Prime, base and bytes of a window.  Fixed values.
PRIME_F, BASE_F, WINDOW_F = 1_000_000_007, 37, 48


def finesse(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The largest fingerprint (modulo a prime, 48-byte windows) in each of 12 equal
    blocks of each row; 0 for rows with blocks shorter than a window."""
    n = len(offsets) - 1
    out = np.zeros((n, FEATURES), np.int64)
    for r in range(n):
        part = data[offsets[r] : offsets[r + 1]].astype(np.int64)
        bounds = [len(part) * b // FEATURES for b in range(FEATURES + 1)]
        if bounds[1] < WINDOW_F:
            continue
        fp = np.zeros(len(part) - WINDOW_F + 1, np.int64)
        for k in range(WINDOW_F):
            fp = (fp * BASE_F + part[k : len(part) - WINDOW_F + 1 + k]) % PRIME_F
        for b in range(FEATURES):
            out[r, b] = fp[bounds[b] : bounds[b + 1] - WINDOW_F + 1].max()
    return out
