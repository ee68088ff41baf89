"""Words and word windows of Arrow string columns as numpy arrays.

Texts are read as the UTF-8 bytes of the column. A word is a run of bytes that a
256-entry table keeps; the ASCII tables never cut a multi-byte character, so byte
runs and character runs are the same. Word and window values are 64-bit
polynomial fingerprints followed by a finaliser: equal words give equal values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once; bounds the temporary arrays to about 12 times this.
CHUNK_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20_240_917))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of an odd base and of its inverse mod 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.up, self.down = int(base), np.ones(1, np.uint64), np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = _powers(self.base, size), _powers(_inverse(self.base), size)
        return self.up, self.down


_BYTE_POWERS, _WORD_POWERS = _Powers(_BASE), _Powers(_STEP)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _table(keep: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    values = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if fold:
        values[65:91] = values[97:123]
    return keep, values


def _ranges(*ranges: tuple[int, int]) -> np.ndarray:
    keep = np.zeros(256, bool)
    for a, b in ranges:
        keep[a : b + 1] = True
    return keep


#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the text with A-Z lower-cased.
ALNUM = _table(_ranges((48, 57), (65, 90), (97, 122), (128, 255)), fold=True)
#: Words [^\x20\x09-\x0D]+, A-Z lower-cased.
SPACED = _table(~_ranges((32, 32), (9, 13)), fold=True)
#: Words [^\x20\x09-\x0D]+ as they stand.
SPACED_EXACT = _table(~_ranges((32, 32), (9, 13)), fold=False)


class Words:
    """Words of a run of documents. first, last: bytes of each word in data;
    value: its fingerprint; bounds[i]:bounds[i + 1]: the words of document i;
    rows: the documents' rows in the column they come from."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rows: np.ndarray, kind: tuple[np.ndarray, np.ndarray]) -> None:
        keep, values = kind
        self.data, self.offsets, self.rows = data, offsets, rows
        n = len(data)
        mask = np.zeros(n + 2, bool)
        mask[1:-1] = keep[data]
        begin = mask[1:] & ~mask[:-1]
        end = mask[:-1] & ~mask[1:]
        inner = offsets[(offsets > 0) & (offsets < n)]
        inner = inner[mask[inner] & mask[inner + 1]]
        begin[inner] = end[inner] = True
        self.first, self.last = np.flatnonzero(begin), np.flatnonzero(end)
        up, down = _BYTE_POWERS.get(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.multiply(values[data], up[:n], out=sums[1:])
        np.cumsum(sums[1:], out=sums[1:])
        self.value = mix((sums[self.last] - sums[self.first]) * down[self.first] + (self.last - self.first).astype(np.uint64))
        self.bounds = np.searchsorted(self.first, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owners(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.rows)), self.counts)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The windows of size consecutive words of one document: their first
        words (indices into value, ascending) and fingerprints."""
        n = len(self.value)
        if n < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        up, down = _WORD_POWERS.get(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value * up[:n], out=sums[1:])
        ends = np.repeat(self.bounds[1:], self.counts)
        at = np.flatnonzero(np.arange(n) + size <= ends)
        return at, mix((sums[at + size] - sums[at]) * down[at])


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and len + 1 offsets into them; null texts have none."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def word_chunks(column: pa.Array, kind: tuple[np.ndarray, np.ndarray], chunk_bytes: int = CHUNK_BYTES) -> Iterator[Words]:
    """The column's documents in order, in runs of about chunk_bytes, one whole document at least."""
    data, offsets = string_bytes(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + chunk_bytes, side="right")) - 1)
        stop = min(stop, n)
        yield Words(data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row], np.arange(row, stop), kind)
        row = stop
