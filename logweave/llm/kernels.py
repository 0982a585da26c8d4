"""Vectorised work on the bytes of many texts at once, used inside tasks.

Texts are taken from Arrow columns without copying. Hashes are 64-bit: bytes are mapped to random odd-looking constants,
weighted by powers of an odd number modulo 2**64 and summed, so that the hash of any byte range is a difference of two
running sums, and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64; kept between calls."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=U)
        steps[0] = 1
        have = _powers[int(base)] = np.cumprod(steps)
    return have[:n]


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column's texts, one after the other, and where each begins (one more than texts). Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(batches, column: str = "text", limit: int = 2 << 20) -> Iterator:
    """Batches (or one table) cut to about ``limit`` bytes of text; a longer text stays whole."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        ends, at = np.cumsum(lengths), 0
        while at < n:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def range_sums(values: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """Running sums of values weighted by powers, with a leading 0, for ``range_hash``."""
    out = np.empty(len(values) + 1, dtype=U)
    out[0] = 0
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, inverse: np.uint64 = INVERSE) -> np.ndarray:
    """Hash of values[start:end], wherever it stands."""
    longest = int(start.max()) + 1 if len(start) else 0
    length = (end - start).astype(U)
    return mix((sums[end] - sums[start]) * powers(inverse, longest)[start] + length * U(0xA0761D6478BD642F))


def class_table(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


SPACES = class_table(b" \t\n\v\f\r")
WORD_BYTES = ~SPACES
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(buf: np.ndarray, at: np.ndarray, member: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of member bytes that don't cross texts, and the first run of each text."""
    inside = member[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(buf))]
    first[edges] |= inside[edges]
    last[edges - 1] |= inside[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, at)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] numbers for each i, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(total)
