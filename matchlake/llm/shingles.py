"""Word shingles of many texts at once and their XXH64, vectorised over equal lengths."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash

from matchlake.llm.common import words

P1, P2, P3, P4, P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
#: Lengths with fewer shingles than this are hashed one by one.
FEW = 48
#: Hashes whose bits are spread out at a time.
ROWS = 1 << 16


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _lane(acc, lane):
    return _rotl(acc + lane * P2, 31) * P1


def _xxh64_same_length(eight: np.ndarray, four: np.ndarray, one: np.ndarray, at: np.ndarray, n: int, seed: int) -> np.ndarray:
    zero = np.zeros(len(at), np.uint64)
    s, pos = np.uint64(seed), 0
    if n >= 32:
        acc = [zero + (s + P1 + P2), zero + (s + P2), zero + s, zero + (s - P1)]
        while pos + 32 <= n:
            acc = [_lane(a, eight[at + (pos + 8 * i)]) for i, a in enumerate(acc)]
            pos += 32
        h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
        for a in acc:
            h = (h ^ _lane(zero, a)) * P1 + P4
    else:
        h = zero + (s + P5)
    h = h + np.uint64(n)
    while pos + 8 <= n:
        h = _rotl(h ^ _lane(zero, eight[at + pos]), 27) * P1 + P4
        pos += 8
    if pos + 4 <= n:
        h = _rotl(h ^ (four[at + pos].astype(np.uint64) * P1), 23) * P2 + P3
        pos += 4
    while pos < n:
        h = _rotl(h ^ (one[at + pos].astype(np.uint64) * P5), 11) * P1
        pos += 1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def xxh64_spans(data: bytes, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of data[start:end] for each span."""
    padded = data + b"\0" * 8
    n = len(data)
    one = np.frombuffer(padded, np.uint8)
    eight = np.ndarray(shape=(n + 1,), dtype="<u8", buffer=padded, strides=(1,))
    four = np.ndarray(shape=(n + 1,), dtype="<u4", buffer=padded, strides=(1,))
    size = end - start
    order = np.argsort(size, kind="stable")
    out = np.empty(len(start), np.uint64)
    with np.errstate(over="ignore"):
        lengths, first = np.unique(size[order], return_index=True)
        for length, a, b in zip(lengths.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
            pick = order[a:b]
            if b - a < FEW:
                for i in pick.tolist():
                    out[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]], seed)
            else:
                out[pick] = _xxh64_same_length(eight, four, one, start[pick], length, seed)
    return out


def shingle_hashes(texts: Iterable[str | None], size: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles, repeats included, and how many each text has.

    A text of fewer words than size has one shingle, the whole sequence; a text without words has none.
    """
    every: list[bytes] = []
    count = []
    for text in texts:
        own = words(text)
        every += own
        count.append(len(own))
    n = np.array(count, np.int64)
    if not every:
        return np.zeros(0, np.uint64), np.zeros(len(n), np.int64)
    length = np.fromiter(map(len, every), np.int64, len(every))
    end = np.cumsum(length + 1) - 1
    start = end - length
    stop = np.cumsum(n)
    at = np.arange(len(every))
    own_stop, own_first = np.repeat(stop, n), np.repeat(stop - n, n)
    keep = (at + size <= own_stop) | (at == own_first)
    first = at[keep]
    last = np.minimum(first + size, own_stop[keep]) - 1
    return xxh64_spans(b" ".join(every), start[first], end[last], seed), np.where(n > 0, np.maximum(n - size + 1, 1), 0)


def majority_bits(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """64-bit fingerprint of each text: a bit is set if it is set in over half of the text's hashes."""
    out = np.zeros(len(count), np.uint64)
    some = np.flatnonzero(count)
    if len(some):
        stop = np.cumsum(count)[some]
        total = np.zeros((len(some), 64), np.int64)
        for a in range(0, len(hashes), ROWS):
            bits = np.unpackbits(hashes[a : a + ROWS].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            lo, hi = np.searchsorted(stop, [a, min(a + ROWS, len(hashes)) - 1], "right")
            first = np.maximum(stop[lo : hi + 1] - count[some][lo : hi + 1] - a, 0)
            total[lo : hi + 1] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        set_ = (2 * total > count[some, None]).astype(np.uint8)
        out[some] = np.packbits(set_, axis=1).view(">u8").ravel().astype(np.uint64)
    return out
