"""Words of Arrow text columns as numpy arrays: spans, documents and 64-bit hashes, without a
Python object per word. Works inside ``mapInArrow`` tasks on slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are handled at once; a longer document is a slice of its own.
SLICE = 2 << 20
#: Bytes that are hashed at once.
BLOCK = 1 << 20

_rng = np.random.default_rng(20240229)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: A random odd number for each byte.
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The same after lower-casing A-Z.
LOWER = BYTE.copy()
LOWER[65:91] = BYTE[97:123]

#: Bytes of the words [^\x20\x09-\x0D]+: all but ASCII white space.
SOLID = np.ones(256, bool)
SOLID[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z: digits, letters, all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers, one to one."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def slices(batch: pa.RecordBatch, text: str, size: int = SLICE) -> Iterator[tuple[int, pa.Array]]:
    """First row and texts of consecutive rows with some ``size`` bytes; null counts as empty."""
    column = pc.fill_null(batch.column(batch.schema.get_field_index(text)), "").cast(pa.large_string())
    lengths = pc.binary_length(column).to_numpy(zero_copy_only=False)
    first = 0
    while first < len(lengths):
        last = first + max(1, int(np.searchsorted(np.cumsum(lengths[first:]), size, side="right")))
        yield first, column.slice(first, last - first)
        first = last


@dataclass
class Texts:
    """The bytes of some texts and where each text begins."""

    data: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Texts:
        _, offsets, data = column.buffers()
        own = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
        data = np.frombuffer(data, np.uint8)[own[0]:own[-1]] if data is not None else np.empty(0, np.uint8)
        return cls(data, own - own[0])

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def runs(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of the longest runs of marked bytes within a text."""
        n = len(mask)
        if not n:
            return (np.empty(0, np.int64),) * 3
        cuts = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        before = np.empty(n, bool)
        before[0], before[1:] = False, mask[:-1]
        before[cuts] = False
        starts = np.flatnonzero(mask & ~before)
        after = np.empty(n, bool)
        after[-1], after[:-1] = False, mask[1:]
        after[cuts - 1] = False
        ends = np.flatnonzero(mask & ~after) + 1
        return starts, ends, self.text_of(starts)

    def text_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, side="right") - 1

    def total(self, mask: np.ndarray) -> np.ndarray:
        """Marked bytes of each text."""
        upto = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return upto[self.offsets[1:]] - upto[self.offsets[:-1]]

    def hashes(self, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
        """A 64-bit hash of each ascending, disjoint span: a polynomial in random byte values."""
        out = np.empty(len(starts), np.uint64)
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, side="right")))
            lo, hi = int(starts[i]), int(ends[j - 1])
            power = _powers(_BASE, hi - lo)
            upto = np.empty(hi - lo + 1, np.uint64)
            upto[0] = 0
            np.cumsum(table[self.data[lo:hi]] * power, out=upto[1:])
            a, b = starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = (upto[b] - upto[a]) * _powers(_INVERSE, hi - lo)[a]
            i = j
        return mix(out + (ends - starts).astype(np.uint64))


_cached: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    known = _cached.get(int(base))
    if known is None or len(known) < n:
        known = np.full(max(n, BLOCK), base, np.uint64)
        known[0] = 1
        known = np.cumprod(known, dtype=np.uint64)
        if n <= BLOCK:
            _cached[int(base)] = known
    return known[:n]


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` consecutive word hashes, in order."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[k:k + n]
    return mix(out)
