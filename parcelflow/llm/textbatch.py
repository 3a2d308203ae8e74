"""Vectorised words and word hashes of a batch of texts (numpy over the Arrow buffers).

All functions run inside Spark tasks.  Hashes are polynomials over bytes or words modulo 2**64,
read off prefix sums, so the hash of every window costs a few array operations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
_CHUNK_WORDS = 200_000


def byte_class(ranges: list[tuple[int, int]]) -> np.ndarray:
    """A 256-entry truth table that is set on the given inclusive byte ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low:high + 1] = True
    return table


#: Everything but space and the ASCII controls tab to carriage return.
NOT_SPACE = byte_class([(0x00, 0x08), (0x0E, 0x1F), (0x21, 0xFF)])
#: Digits, lower-case ASCII letters and all bytes of non-ASCII characters.
WORD_BYTES = byte_class([(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)])

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spark_xxhash64(x: np.ndarray) -> np.ndarray:
    """What Spark's xxhash64 gives for a column of longs (XXH64 of eight bytes, seed 42)."""
    # fixed values of XXH64
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (
        0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turn(v, n):
        return (v << np.uint64(n)) | (v >> np.uint64(64 - n))

    h = (np.uint64(42 + 8) + p5) ^ (turn(x.astype(np.int64).view(np.uint64) * p2, 31) * p1)
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64)


class Powers:
    """base**i and base**-i modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(int(base), -1, 2**64))
        self._up = self._down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            def table(b):
                steps = np.full(n, b, dtype=np.uint64)
                steps[0] = 1
                return np.cumprod(steps, dtype=np.uint64)
            self._up, self._down = table(self.base), table(self.inverse)
        return self._up[:n], self._down[:n]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string (UTF-8) or binary column and the len + 1 offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)
    off = off[column.offset:column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[off[0]:off[-1]], off - off[0]


class Words:
    """Words of a batch of texts: byte spans, and the range of words of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, member: np.ndarray):
        inside = member[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        begins = offsets[:-1][np.diff(offsets) > 0]
        first[begins] = inside[begins]
        stops = offsets[1:][np.diff(offsets) > 0] - 1
        last[stops] = inside[stops]
        self.data = data
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        #: words of text i are bounds[i] to bounds[i + 1]
        self.bounds = np.searchsorted(self.starts, offsets)

    def text_of(self) -> np.ndarray:
        """The index of the text of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def room(self) -> np.ndarray:
        """For each word, how many words its text has from there on."""
        return np.repeat(self.bounds[1:], np.diff(self.bounds)) - np.arange(len(self.starts))

    def hashes(self, powers: Powers) -> np.ndarray:
        """One 64-bit hash a word, the same in every batch."""
        out = np.empty(len(self.starts), dtype=np.uint64)
        for i in range(0, len(out), _CHUNK_WORDS):
            s, e = self.starts[i:i + _CHUNK_WORDS], self.ends[i:i + _CHUNK_WORDS]
            base = s[0]
            piece = self.data[base:e[-1]].astype(np.uint64) + np.uint64(1)
            up, down = powers.upto(len(piece) + 1)
            sums = np.zeros(len(piece) + 1, dtype=np.uint64)
            np.cumsum(piece * up[:-1], out=sums[1:])
            out[i:i + _CHUNK_WORDS] = mix((sums[e - base] - sums[s - base]) * down[s - base] ^ (e - s).astype(np.uint64))
        return out


def byte_powers() -> Powers:
    return Powers(_BYTE_BASE)


def window_hashes(words: np.ndarray, size: int, powers: Powers) -> np.ndarray:
    """Rabin-Karp hashes of all windows of ``size`` neighbours; fewer words give none."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = powers.upto(len(words))
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up, out=sums[1:])
    return mix((sums[size:] - sums[:n]) * down[:n])


def slices(batch: pa.RecordBatch, column: str, most_bytes: int):
    """Parts of a batch whose texts hold about ``most_bytes`` together (one text at least)."""
    _, offsets = text_buffers(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most_bytes, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j
