"""Periodic runs of words (operator 12), found by the branching-tandem test on an enhanced suffix array.

A run is a stretch of words with smallest period q whose length is at least three periods and 24 words, and which no
neighbouring word extends. Documents are worked on where they are read, a few at a time in numpy, without a shuffle:

1. Words become numbers by a 64-bit hash, apart for each document. A run holds two equal stretches of 16 words, so documents
   without a repeated stretch of 16 words have none and are done.
2. The suffix array of the rest by prefix doubling (only what is still tied is sorted again), its inverse ISA, and the
   lengths of common prefixes by binary search over running hashes.
3. For each LCP interval of depth D every suffix i of all its children but the largest is tested: if ISA[i + D] or ISA[i - D]
   lies in the interval, in another child, a square of period D starts at i (or i - D) and ends where a run ends. Intervals
   and their children are the bounds left and right of equal LCP values; no tree is built.
4. A square is rotated to the left as far as it stays a square; squares with the same stretch merge to a run, of which the
   smallest period counts.

Defined cases: a null or empty text has no words, no runs and the digests of nothing; rows with a null doc_id are taken as
they are, without the query's periodic tail; repeated rows give repeated results; texts are read whole, a long one alone;
other columns are ignored; an empty table gives an empty result. Equal hashes are taken as equal words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import kernels as K
from logweave.llm.common import table

LEAST_WORDS, LEAST_PERIODS = 24, 3
U = np.uint64


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and inverse of numbers, by prefix doubling; what is no longer tied is not sorted again."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    _, first = _heads(symbols[order])
    rank = np.empty(n, np.int64)
    rank[order] = first  # of tied suffixes all have the place of the first
    step = 1
    tied = np.flatnonzero(_in_groups(first))
    while len(tied):
        at = order[tied]
        after = np.where(at + step < n, rank[np.minimum(at + step, n - 1)] + 1, 0)
        group = first[tied]
        new = np.lexsort((after, group))
        at, after = at[new], after[new]
        order[tied] = at
        head = np.ones(len(tied), bool)
        head[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        place = np.maximum.accumulate(np.where(head, tied, 0))
        first[tied] = place
        rank[at] = place
        step *= 2
        tied = tied[_in_groups(place)]
    return order, rank


def _heads(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a new value begins in sorted values, and for each the place of its first."""
    head = np.ones(len(values), bool)
    head[1:] = values[1:] != values[:-1]
    return head, np.maximum.accumulate(np.where(head, np.arange(len(values)), 0))


def _in_groups(first: np.ndarray) -> np.ndarray:
    """Which places share their group's first place with another."""
    same = first[1:] == first[:-1]
    out = np.zeros(len(first), bool)
    out[1:] |= same
    out[:-1] |= same
    return out


class Extensions:
    """Lengths of common prefixes and suffixes at pairs of places, by binary search over running hashes."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        self.sums = K.range_sums(K.mix(symbols.astype(U) + U(1)))

    def _equal(self, a, b, length):
        return K.range_hash(self.sums, a, a + length) == K.range_hash(self.sums, b, b + length)

    def _longest(self, most, equal) -> np.ndarray:
        low, high = np.zeros(len(most), np.int64), most.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_] + 1) // 2
            same = equal(open_, middle)
            low[open_] = np.where(same, middle, low[open_])
            high[open_] = np.where(same, high[open_], middle - 1)

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._longest(self.n - np.maximum(a, b), lambda k, m: self._equal(a[k], b[k], m))

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal symbols right before a and b."""
        return self._longest(np.minimum(a, b), lambda k, m: self._equal(a[k] - m, b[k] - m, m))


def _small_children(lcp: np.ndarray, deepest: int) -> np.ndarray:
    """One row (low, high, depth, child low, child high) for each child but the largest of every LCP interval with a depth
    from 1 to ``deepest``; lcp[i] belongs to suffixes i and i + 1."""
    out: list[tuple] = []
    stack: list[list] = []  # depth, low, places where its children begin

    def close(node: list, high: int) -> None:
        depth, low, begins = node
        if depth > deepest or not depth:
            return
        ends = [b - 1 for b in begins[1:]] + [high]
        sizes = [e - b for b, e in zip(begins, ends, strict=True)]
        largest = sizes.index(max(sizes))
        out.extend((low, high, depth, b, e) for k, (b, e) in enumerate(zip(begins, ends, strict=True)) if k != largest)

    for i, depth in enumerate([*lcp.tolist(), 0]):
        low, begin = i, i
        while stack and stack[-1][0] > depth:
            node = stack.pop()
            close(node, i)
            low = begin = node[1]
        if not depth:
            continue
        if stack and stack[-1][0] == depth:
            stack[-1][2].append(i + 1)
        else:
            stack.append([depth, low, [begin, i + 1]])
    return np.array(out, np.int64).reshape(-1, 5)


def squares(symbols: np.ndarray, order: np.ndarray, rank: np.ndarray, lcp: np.ndarray, deepest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of the branching squares: those whose next symbol differs from the one a period before it."""
    low, high, depth, child, last = _small_children(lcp, deepest).T
    starts, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    sizes = last - child + 1
    step = np.cumsum(sizes) // (4 << 20)
    for part in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(step)) + 1):
        each = np.repeat(part, sizes[part])
        i = order[K.spread(child[part], sizes[part])]
        for sign in (1, -1):
            other = i + sign * depth[each]
            inside = (other >= 0) & (other < len(symbols))
            at = rank[np.where(inside, other, 0)]
            inside &= (at >= low[each]) & (at <= high[each]) & ~((at >= child[each]) & (at <= last[each]))
            starts.append(np.minimum(i, other)[inside])
            periods.append(depth[each][inside])
    return np.concatenate(starts), np.concatenate(periods)


def find(symbols: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> np.ndarray:
    """Rows (start, length, period) of the runs in a sequence of numbers, in order of start and period."""
    n = len(symbols)
    deepest = n // least_periods
    if n < max(least_words, least_periods):
        return np.zeros((0, 3), np.int64)
    order, rank = suffix_array(symbols)
    same = Extensions(symbols)
    lcp = same.forward(order[:-1], order[1:])
    start, period = squares(symbols, order, rank, lcp, deepest)
    if not len(start):
        return np.zeros((0, 3), np.int64)
    start, period = np.unique(np.stack([start, period]), axis=1)
    end = start + 2 * period
    begin = start - same.backward(start, start + period)
    found = np.stack([begin, end - begin, period], 1)
    found = found[np.lexsort((period, end, begin))]
    new = np.ones(len(found), bool)  # one stretch: the smallest period alone
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    found = found[new & (found[:, 1] >= np.maximum(least_words, least_periods * found[:, 2]))]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def shortest_repeat(least_words: int, least_periods: int) -> int:
    """Every run holds two equal stretches of so many words, one period apart."""
    return min(max(least_words - q, (least_periods - 1) * q) for q in range(1, least_words + 1))


def with_repeats(symbols: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """Numbers of the sequences (symbols[first[d]:first[d + 1]]) that hold an equal stretch of ``length`` twice."""
    sums = K.range_sums(K.mix(symbols.astype(U) + U(1)))
    counts = np.maximum(np.diff(first) - length + 1, 0)
    at = K.spread(first[:-1], counts)
    if not len(at):
        return np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(counts)), counts)
    keys = K.range_hash(sums, at, at + length) ^ K.mix(of.astype(U) + U(0x1234567))
    order = np.argsort(keys)
    again = keys[order][1:] == keys[order][:-1]
    return np.unique(of[order[1:][again]])


def periodic_tail(n: int, doc_id: int | None) -> np.ndarray | None:
    """The words of a document by their place in it, where the rule of the query repeats its end; else None."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def _described(runs: np.ndarray) -> tuple:
    if not len(runs):
        return None, None, None, None
    start, length, period = max(map(tuple, runs.tolist()), key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
    return start, length, period, 1000 * length // period


def _collapsed(n: int, runs: np.ndarray) -> np.ndarray:
    """Which words stay: those that no run contains after its first period."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(step[:-1]) == 0


OUT = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_dropped long"
_TYPES = [pa.int64()] * 7 + [pa.string()] * 2 + [pa.int64()]


def _run(tails: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.slices(batches):
            buf, at = K.texts(b.column("text"))
            begin, end, first = K.words(buf, at)
            ids = b.column("doc_id").to_pylist()
            where = np.arange(len(begin))  # the word that stands at each place
            for d in range(len(ids)) if tails else ():
                moved = periodic_tail(int(first[d + 1] - first[d]), ids[d])
                if moved is not None:
                    where[first[d] : first[d + 1]] = first[d] + moved
            symbols = K.range_hash(K.range_sums(K.BYTE[buf]), begin, end)[where] if len(begin) else np.zeros(0, U)
            some = set(with_repeats(symbols, first, shortest_repeat(LEAST_WORDS, LEAST_PERIODS)).tolist())
            data, rows = memoryview(buf.tobytes()), []
            for d, i in enumerate(ids):
                s, e = int(first[d]), int(first[d + 1])
                runs = find(np.unique(symbols[s:e], return_inverse=True)[1]) if d in some else np.zeros((0, 3), np.int64)
                kept = where[s:e][_collapsed(e - s, runs)] if len(runs) else where[s:e]
                text = b" ".join([data[x:y] for x, y in zip(begin[kept].tolist(), end[kept].tolist(), strict=True)])
                said = "".join(f"{x},{y},{q}\n" for x, y, q in runs.tolist()).encode()
                rows.append((i, e - s, len(runs), *_described(runs), hashlib.sha256(said).hexdigest(), hashlib.sha256(text).hexdigest(), e - s - len(kept)))
            names = [c.split()[0] for c in OUT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names)

    return run


def periodic_runs(docs: DataFrame, tails: bool = False) -> DataFrame:
    """One row per row of ``docs``: the number of runs, the one with the greatest exponent (start, length, period), the digest
    of all, of the text without what the runs repeat, and how many words that drops. ``tails``: the query's rule that makes
    the end of one document in ten periodic comes first."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_run(tails), OUT)


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), tails=True)
