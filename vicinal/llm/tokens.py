"""Words of many texts at once, as 64-bit hashes computed on the UTF-8 bytes of an Arrow column.

White space is ASCII only, so texts can be cut into words byte by byte. A word's hash is a sum of random numbers of its
bytes times powers of an odd number, mixed; a window's hash combines the hashes of its words in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text looked at together; one longer text is taken alone.
SLICE_BYTES = 1_000_000
#: Bytes whose words are hashed together.
BLOCK_BYTES = 1_000_000

U64 = np.uint64
STEP = U64(0x9E3779B97F4A7C15)
_POWER = U64(0xD6E8FEB86659FD93)
_random = np.random.default_rng(20240601)
_BYTE = _random.integers(0, 2**64, 256, dtype=U64)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the odd number, and of its inverse."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        inverse = U64(pow(int(_POWER), -1, 2**64))
        for k, base in enumerate((_POWER, inverse)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words of some texts: bytes [start, end) of ``data``; text k has the words [bounds[k], bounds[k + 1])."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())

    def hashes(self, lower: bool = False) -> np.ndarray:
        table = _LOWER if lower else _BYTE
        out = np.empty(len(self.starts), U64)
        at = 0
        while at < len(out):
            first = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, first + BLOCK_BYTES, side="right")))
            last = self.ends[to - 1]
            power, inverse = _power_tables(int(last - first) + 1)
            sums = np.zeros(int(last - first) + 1, U64)
            np.cumsum(table[self.data[first:last]] * power[: last - first], out=sums[1:])
            begin, end = self.starts[at:to] - first, self.ends[at:to] - first
            out[at:to] = mixed((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(U64))
            at = to
        return out


def split(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = IS_SPACE) -> Words:
    """Words of the texts ``data[offsets[k]:offsets[k + 1]]``; between: for each byte whether it separates words."""
    base = int(offsets[0])
    data, offsets = data[base : int(offsets[-1])], offsets - base
    if not len(data):
        return Words(data, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
    space = between[data]
    before = np.ones(len(data), bool)
    before[1:] = space[:-1]
    cuts = offsets[(offsets < len(data))]
    before[cuts] = True
    after = np.ones(len(data), bool)
    after[:-1] = space[1:]
    after[cuts[cuts > 0] - 1] = True
    starts = np.flatnonzero(before & ~space)
    ends = np.flatnonzero(after & ~space) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def windows(hashes: np.ndarray, k: int, multiplier: np.uint64 = STEP) -> np.ndarray:
    """Hashes of the windows of k consecutive words, wherever texts begin or end."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    # Two windows' hashes side by side make one of both lengths; k is put together from powers of two.
    size, power, doubled = 1, int(multiplier), hashes
    total, length = None, 0
    mod = 2**64
    while True:
        if k & size:
            if total is None:
                total, length = doubled, size
            else:
                count = min(len(total) - 0, len(doubled) - length)
                total = total[:count] * U64(power) + doubled[length : length + count]
                length += size
        if size * 2 > k:
            break
        count = len(doubled) - size
        doubled = doubled[:count] * U64(power) + doubled[size : size + count]
        size, power = size * 2, power * power % mod
    return mixed(total[:n])


def inside(words: Words, k: int) -> np.ndarray:
    """For every window of k consecutive words whether it lies in one text."""
    n = len(words.starts) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    text = words.text_of()
    return text[:n] == text[k - 1 :]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of rows of a string column without nulls, about ``most`` bytes each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offset_buffer, data_buffer = column.buffers()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(offset_buffer, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, to, data, offsets[at : to + 1]
        at = to


def distinct_windows(words: Words, k: int, lower: bool) -> list[np.ndarray]:
    """For each text its sorted distinct hashes of windows of k words; of fewer words, the one of all of them."""
    hashes = words.hashes(lower)
    rolled = windows(hashes, k)
    out = []
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        n = b - a
        if n >= k:
            found = np.sort(rolled[a : b - k + 1])
            out.append(found[np.concatenate(([True], found[1:] != found[:-1]))])
        else:
            out.append(windows(hashes[a:b], n) if n else np.zeros(0, U64))
    return out
