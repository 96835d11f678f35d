"""Vectorised words, shingles and windows of Arrow text columns.

Words are maximal runs of bytes outside ``20 09-0D``.  A word's hash is a pair of
polynomials over its bytes modulo two primes, read off running sums per slice, so
that no Python object is made per word.  (Modulo 2**64, long words over two letters
can be made to collide whatever the base.)  Sequences of up to some hundred words are
hashed by a polynomial modulo 2**64 over the words' mixed hashes.  Hashes are 64 bits;
operators that need more combine two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled alone.
SLICE_BYTES = 1 << 20

_U = np.uint64
#: Primes and bases of words' hashes.
_PRIMES = ((2147483647, 1103515245), (2147483629, 1566083941))
_Q = 0xC2B2AE3D27D4EB4F | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ _U(seed * 0xD6E8FEB86659FD93 & _MASK)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = np.arange(1, 257, dtype=_U)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: For bare words: ASCII bytes other than letters and digits separate as well.
_MARKS = _SPACE.copy()
_MARKS[[c for c in range(128) if not chr(c).isalnum()]] = True

_powers: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int, prime: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n, modulo a prime under 2**31, or without one 2**64."""
    have = _powers.get((base, prime))
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + (1 << 18))
        out = []
        for b in (base, pow(base, -1, prime or 1 << 64)):
            a, done = np.ones(size, dtype=_U), 1
            while done < size:
                more = min(done, size - done)
                a[done : done + more] = a[:more] * _U(pow(b, done, prime or 1 << 64))
                if prime:
                    a[done : done + more] %= _U(prime)
                done += more
            out.append(a)
        have = (out[0], out[1])
        if size <= 8 * SLICE_BYTES:
            _powers[base, prime] = have
    return have


class Words:
    """The words of some texts, in order.

    first: index of each text's first word, and the total at the end.
    hashes: a 64-bit hash of each word.  starts, ends: byte positions in data.
    """

    __slots__ = ("data", "ends", "first", "hashes", "starts")

    def __init__(self, column: pa.Array, lower: bool = False, bare: bool = False):
        column = column.cast(pa.large_binary())
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
        lo, hi = int(offsets[0]), int(offsets[-1])
        body = column.buffers()[2]
        data = np.frombuffer(body, dtype=np.uint8)[lo:hi] if body is not None and hi > lo else np.zeros(0, np.uint8)
        offsets = offsets - lo
        size = hi - lo
        space = (_MARKS if bare else _SPACE)[data]
        edge = np.zeros(size + 1, dtype=bool)
        edge[offsets] = True
        begins = ~space
        begins[1:] &= space[:-1] | edge[1:size]
        finishes = ~space
        finishes[:-1] &= space[1:] | edge[1:size]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(finishes) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.data = data
        if size:
            values, halves = (_LOWER if lower else _BYTES)[data], []
            for prime, base in _PRIMES:
                up, down = _power(base, size, prime)
                run = np.zeros(size + 1, dtype=_U)
                # Terms of 39 bits: sums of a slice fit; those of longer texts are reduced first.
                np.cumsum(values * up[:size] if size <= 1 << 24 else values * up[:size] % _U(prime), out=run[1:])
                halves.append((run[self.ends] - run[self.starts]) % _U(prime) * down[self.starts] % _U(prime))
            self.hashes = mix(halves[0] << _U(32) | halves[1])
        else:
            self.hashes = np.zeros(0, dtype=_U)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def runs(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of each run of `width` words inside one text."""
        n = len(self.hashes)
        if n < width:
            return np.zeros(0, _U), np.zeros(0, np.int64)
        up, down = _power(_Q, n + 1)
        run = np.zeros(n + 1, dtype=_U)
        np.cumsum(self.hashes * up[:n], out=run[1:])
        at = np.arange(n - width + 1)
        inside = np.ones(n - width + 1, dtype=bool)
        for b in self.first[1:-1]:
            inside[max(0, b - width + 1) : b] = False
        at = at[inside]
        return mix((run[at + width] - run[at]) * down[at], width), at

    def whole(self, text: int) -> int:
        """Hash of the whole word sequence of one text."""
        h = self.hashes[self.first[text] : self.first[text + 1]]
        up, _ = _power(_Q, len(h) + 1)
        return int(mix(np.array([(h * up[: len(h)]).sum(dtype=_U)], dtype=_U), 1000 + len(h))[0])


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of about `limit` bytes of text."""
    if not len(column):
        return
    sizes = column.cast(pa.large_binary())
    ends = np.frombuffer(sizes.buffers()[1], dtype=np.int64)[sizes.offset : sizes.offset + len(sizes) + 1]
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + limit, side="right")) - 1)
        yield a, min(b, len(column))
        a = b


def texts(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The text column with nulls as empty strings."""
    col = batch.column(batch.schema.get_field_index(name))
    return col.fill_null("") if col.null_count else col


def shingles(column: pa.Array, width: int) -> list[np.ndarray]:
    """Per text: the sorted distinct hashes of its runs of `width` lower-cased words.

    A text with fewer words has one, of all its words; one without words, none.
    """
    out: list[np.ndarray] = []
    for a, b in slices(column):
        w = Words(column.slice(a, b - a), lower=True)
        h, at = w.runs(width)
        cut = np.searchsorted(at, w.first)
        n = w.counts()
        for i in range(b - a):
            if n[i] >= width:
                s = np.sort(h[cut[i] : cut[i + 1]])
                keep = np.ones(len(s), dtype=bool)
                keep[1:] = s[1:] != s[:-1]
                out.append(s[keep])
            elif n[i]:
                out.append(np.array([w.whole(i)], dtype=_U))
            else:
                out.append(np.zeros(0, dtype=_U))
    return out
