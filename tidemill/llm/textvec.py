"""Vectorised text primitives over Arrow string buffers.

Everything here works on the concatenated UTF-8 bytes of many texts at once, so that a per-byte or
per-word step costs a few nanoseconds instead of a Python call.  Null texts count as empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes that separate words: space and the controls 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed and shared by all hashes with that base."""

    #: Longer tables serve one very long text and are not kept.
    KEPT = 1 << 22

    def __init__(self, seed: int):
        self.base = (int(mix(np.array([seed], dtype=U64))[0]) & ~7) | 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self._tables = np.ones(1, U64), np.ones(1, U64)

    @staticmethod
    def _grown(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, U64)
        out[0] = 1
        return np.cumprod(out, dtype=U64)

    def tables(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._tables[0]) >= n:
            return self._tables
        made = self._grown(self.base, n), self._grown(self.inverse, n)
        if n <= self.KEPT:
            self._tables = made
        return made


_POWERS = _Powers(977), _Powers(1977)


class Rolling:
    """Polynomial hash modulo 2**64 whose prefix sums give the hash of any range in O(1).

    Values pass through a random table or mixer first, and results through ``mix``.  ``base`` picks one
    of two bases; hashes that must be independent take both.
    """

    def __init__(self, seed: int, base: int = 0):
        self.table = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))
        self.powers = _POWERS[base]

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums of uint64 values; length n + 1."""
        n = len(values)
        out = np.zeros(n + 1, U64)
        np.cumsum(values * self.powers.tables(n + 1)[0][:n], out=out[1:])
        return out

    def of_bytes(self, buf: np.ndarray) -> np.ndarray:
        return self.prefix(self.table[buf])

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of every range [start, end)."""
        return mix((prefix[end] - prefix[start]) * self.powers.tables(len(prefix))[1][start] + (end - start).astype(U64))


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column as one uint8 array, and the n + 1 offsets of its texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


class Words:
    """Words of many texts: byte ranges, and ``bounds[d]:bounds[d + 1]`` as the words of text d."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        n = len(buf)
        word = ~SPACE[buf]
        first, last = word.copy(), word.copy()
        if n:
            first[1:] &= ~word[:-1]
            last[:-1] &= ~word[1:]
            full = np.flatnonzero(offs[1:] > offs[:-1])
            first[offs[full]] = word[offs[full]]
            last[offs[full + 1] - 1] = word[offs[full + 1] - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, offs)
        self.counts = np.diff(self.bounds)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def index(self) -> np.ndarray:
        """Each word's number within its own text."""
        return np.arange(len(self.start)) - np.repeat(self.bounds[:-1], self.counts)


def window_starts(bounds: np.ndarray, width: int) -> np.ndarray:
    """Flat indices at which a window of so many consecutive items of one text starts."""
    n = int(bounds[-1])
    ok = np.zeros(n, bool)
    counts = np.diff(bounds)
    room = np.maximum(counts - width + 1, 0)
    index = np.arange(n) - np.repeat(bounds[:-1], counts)
    ok = index < np.repeat(room, counts)
    return np.flatnonzero(ok)


def covered(n: int, starts: np.ndarray, width) -> np.ndarray:
    """Boolean mask of the n items that some range [start, start + width) covers."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + width, -1)
    return np.cumsum(step[:n]) > 0


def row_chunks(batches, limit: int = 1 << 20, text: str = "text"):
    """Arrow batches regrouped so that each holds about ``limit`` bytes of text (a longer text stands alone)."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        total = np.cumsum(lengths)
        while at < batch.num_rows:
            before = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, before + limit - size, "right")))
            held.append(batch.slice(at, to - at))
            size += int(total[to - 1] - before)
            at = to
            if size >= limit:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
