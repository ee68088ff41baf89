"""Letter n-grams of words as numpy fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tallyweave.llm.wordarrays import mix

#: Characters handled at once.
CHUNK_CHARS = 1_500_000

_STEP = np.uint64(0x9FB21C651E98DF25)
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


class Letters:
    """Words of letters, lower-cased, of a run of documents, each word between single blanks (0)."""

    def __init__(self, texts: list[str], rows: np.ndarray) -> None:
        self.rows = rows
        lower = [t.lower() for t in texts]
        lengths = np.array([len(t) + 1 for t in lower])
        codes = np.frombuffer(("\n".join(lower) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(letters()[codes], codes, np.uint32(0))
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] > 0) | (codes[:-1] > 0)
        owner = np.repeat(np.arange(len(texts)), lengths)[keep]
        # the blank that ends a word also begins the next of the same document; every document begins with one of its own
        first = np.r_[True, owner[1:] != owner[:-1]] & (codes[keep] > 0)
        at = np.flatnonzero(first)
        self.codes = np.insert(codes[keep], at, 0)
        self.owner = np.insert(owner, at, owner[at])
        self.n_letters = np.bincount(self.owner[self.codes > 0], minlength=len(texts))
        self.values = mix(self.codes.astype(np.uint64) + np.uint64(1))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(owners, fingerprints) of the n-grams of blank, word, blank; with the document's order."""
        size = len(self.codes) - n + 1
        if size <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        ok = self.owner[:size] == self.owner[n - 1 :]
        for k in range(1, n - 1):
            ok &= self.codes[k : k + size] > 0
        if n == 1:
            ok &= self.codes > 0
        at = np.flatnonzero(ok)
        value = np.zeros(len(at), np.uint64)
        for k in range(n):
            value = value * _STEP + self.values[at + k]
        return self.owner[at], mix(value)

    def words(self, longest: int = 10**9) -> tuple[np.ndarray, np.ndarray]:
        """(owners, fingerprints) of whole words."""
        blank = self.codes == 0
        begin = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
        end = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        powers = np.full(len(self.codes), _STEP, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        inverse = np.full(len(self.codes), np.uint64(pow(int(_STEP), -1, 1 << 64)), np.uint64)
        inverse[0] = 1
        inverse = np.multiply.accumulate(inverse)
        sums = np.r_[np.zeros(1, np.uint64), np.cumsum(self.values * powers, dtype=np.uint64)]
        short = end - begin <= longest
        begin, end = begin[short], end[short]
        return self.owner[begin], mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))


def letter_chunks(column: pa.Array, rows: np.ndarray | None = None) -> Iterator[Letters]:
    """The column's documents, or those of these rows, in runs of about CHUNK_CHARS, one at least. Nulls have no letters."""
    held, at, n = [], [], 0
    for i in range(len(column)) if rows is None else rows:
        text = column[int(i)].as_py() or ""
        held.append(text)
        at.append(int(i))
        n += len(text)
        if n >= CHUNK_CHARS:
            yield Letters(held, np.array(at))
            held, at, n = [], [], 0
    if held:
        yield Letters(held, np.array(at))
