"""Vectorised hashing of words and Rabin-Karp hashing of word windows (numpy, inside tasks).

A word is taken in by eight bytes at a time, each time through a bijection of 64
bits that starts from a key; words of up to eight bytes and equal length never
share a hash. Long words take a keyed BLAKE2b digest. A window's hash is a
polynomial modulo 2**64 over the hashes of its words and comes from prefix sums,
so one pass serves every window of a text. (Polynomials over the bytes of a word
won't do: modulo 2**64 two Thue-Morse words of 1024 letters agree for every odd base.)
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Keys of two hashes that are independent of each other.
KEY, OTHER_KEY = 0x9E3779B97F4A7C15, 0x3C6EF372FE94F82B
LONG_WORD = 256
WORD_BASE = 0xD6E8FEB86659FD93 | 1
SLICE_BYTES = 1 << 21


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", self.inverse)):
                x = np.full(n, base, U64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up, self.down


_WORDS = Powers(WORD_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit depends on every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def slices(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows of about ``SLICE_BYTES``; null reads as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        to = min(to, n)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of some rows, and each row's first word (with the total at the end)."""
    n = len(data)
    inside = ~SPACE[data]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    breaks = offsets[:-1][offsets[:-1] < n]
    before[breaks] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    breaks = offsets[1:][offsets[1:] > 0] - 1
    after[breaks] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = KEY) -> np.ndarray:
    """Keyed hash of each word."""
    sizes = ends - starts
    out = mix(sizes.astype(U64) * U64(0xD1342543DE82EF95) ^ U64(key))
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eights = np.lib.stride_tricks.as_strided(padded[:8].view(U64), (len(data) + 1,), (1,))
    rows = np.flatnonzero(sizes <= LONG_WORD)
    at, left = starts[rows], sizes[rows]
    while len(rows):
        part = eights[at]
        short = left < 8
        part[short] &= (U64(1) << (left[short].astype(U64) * U64(8))) - U64(1)
        out[rows] = mix(out[rows] ^ part)
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(sizes > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=key.to_bytes(8, "little")).digest(), "little")
    return out


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each position on that has so many."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, U64)
    up, down = _WORDS.upto(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(hashes * up[:n], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * down[: n - width + 1])
