"""Benchmark decontamination (operator 9): finds benchmark items in documents within an edit budget.

Texts and items are compared in lower case with each run of ASCII characters other than letters and digits as one blank.
An item of m bytes that occurs with at most e edits leaves at least m - q + 1 - q * e of its q-grams unharmed, all on
diagonals no further apart than e. Shared q-grams are counted in overlapping diagonal bands, bands that reach the bound
are kept, and a banded alignment decides. The index of the items goes to all tasks; a benchmark beyond a size bound is
taken in blocks that each keep it.

Most items use 12-grams; those whose edits could harm every one of them (at 6 %: 17 to 23, 34 and 35 bytes) use 8-grams.
A budget that would harm all 8-grams too is cut to what leaves one, which 6 % never is.
Items shorter than 12 bytes are found where their words stand as a whole, without edits.

Defined cases: null and empty texts match nothing; items that are null or hold no word match nothing; repeated items
are each reported; rows with a null doc_id are reported with null; repeated rows are each looked at (and reported once
per item and row); other columns are passed through by ``clean``; empty tables give no matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import kernels as K
from logweave.llm.common import give_back, table

#: Sizes of q-grams; an item takes the first that its edits can't harm everywhere.
SIZES = (12, 8)
Q, BUDGET = SIZES[0], 0.06
#: Bytes of benchmark text whose index is sent to all tasks at once.
BLOCK_BYTES = 16 << 20
U = np.uint64
_WORD = K.class_table(bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
_SEPARATORS = ~_WORD
OUT = "doc_id long, item_id long, edits int, start long, end long"
_BITS = 22


def normal(column) -> tuple[np.ndarray, ...]:
    """Normalised bytes of texts, where each text's begin, the place of each byte among the column's own, and theirs.

    Lower case can change a text's length in a few scripts; places then are those of the lower-case text.
    """
    buf, at = K.texts(pc.utf8_lower(column))
    gap = _SEPARATORS[buf]
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    starts = at[:-1][at[:-1] < len(buf)]
    keep[starts] = ~gap[starts]
    kept = np.flatnonzero(keep)
    out = buf[kept]
    out[gap[kept]] = 32
    return out, np.searchsorted(kept, at), kept, at


def grams(buf: np.ndarray, q: int) -> np.ndarray:
    """64-bit hash of the q bytes at each place; q from 8 to 16."""
    if len(buf) < q:
        return np.zeros(0, U)
    buf = np.ascontiguousarray(buf)
    eight = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    h = (eight[: len(buf) - q + 1] * U(0x9E3779B97F4A7C15)) ^ (eight[q - 8 : len(buf) - 7] * U(0xC2B2AE3D27D4EB4F))
    h ^= h >> U(29)
    return h * U(0xBF58476D1CE4E5B9)


@dataclass
class Grams:
    """The q-grams of the items that use this q: sorted hashes, where each one's places begin, and the places."""

    q: int
    keys: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    bits: np.ndarray


@dataclass
class Index:
    ids: list
    texts: list[np.ndarray]
    budget: np.ndarray
    bound: np.ndarray
    size: np.ndarray
    tables: list[Grams]
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # by size: sorted hashes of the items below Q bytes, and their numbers


def index(items: list[tuple[int, str]], budget: float = BUDGET) -> Index:
    buf, at, *_ = normal(pa.array([t or "" for _, t in items], pa.string()))
    texts = [buf[a:b][: (b - a) - int(b > a and buf[b - 1] == 32)] for a, b in zip(at[:-1], at[1:], strict=True)]
    size = np.array([len(t) for t in texts], np.int64)
    edits = np.floor(size * budget).astype(np.int64)
    q = np.select([size - n * (edits + 1) >= 0 for n in SIZES], SIZES, SIZES[-1])
    edits = np.minimum(edits, np.maximum((size - q) // q, 0))
    tables = [_grams(texts, np.flatnonzero((q == n) & (size >= Q)), n) for n in SIZES]
    return Index([i for i, _ in items], texts, edits, size - q + 1 - q * edits, size, [t for t in tables if len(t.keys)], _short(texts, size, Q))


def _grams(texts: list[np.ndarray], which: np.ndarray, q: int) -> Grams:
    found = [grams(texts[i], q) for i in which]
    item = np.repeat(which, [len(g) for g in found])
    place = np.concatenate([np.arange(len(g)) for g in found]) if found else np.zeros(0, np.int64)
    flat = np.concatenate(found) if found else np.zeros(0, U)
    order = np.argsort(flat, kind="stable")
    keys, first = np.unique(flat[order], return_index=True)
    bits = np.zeros(1 << _BITS, bool)
    bits[(keys >> U(64 - _BITS)).astype(np.int64)] = True
    return Grams(q, keys, np.append(first, len(flat)), item[order], place[order], bits)


def _short(texts: list[np.ndarray], size: np.ndarray, q: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    out = {}
    for n in range(1, q):
        which = np.flatnonzero(size == n)
        if len(which):
            h = np.array([K.range_hash(K.range_sums(K.BYTE[texts[i]]), np.array([0]), np.array([n]))[0] for i in which], U)
            order = np.argsort(h, kind="stable")
            out[n] = h[order], which[order]
    return out


def _whole_words(x: Index, buf: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """text, item, begin and end of the first place of each short item in each text."""
    start, end, first = K.words(buf, at, _WORD)
    text = np.repeat(np.arange(len(at) - 1), np.diff(first))
    sums = K.range_sums(K.BYTE[buf])
    last = np.zeros(len(buf) + 1, bool)
    last[end] = True
    for n, (hashes, which) in x.short.items():
        inside = np.flatnonzero(start + n <= at[text + 1])
        inside = inside[last[start[inside] + n]]
        h = K.range_hash(sums, start[inside], start[inside] + n)
        low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
        done = set()
        for w in np.flatnonzero(high > low).tolist():
            a, t = int(start[inside[w]]), int(text[inside[w]])
            for i in which[low[w] : high[w]].tolist():
                if (t, i) not in done and np.array_equal(buf[a : a + n], x.texts[i]):
                    done.add((t, i))
                    yield t, i, a, a + n


def align(item: np.ndarray, region: np.ndarray, low: int, width: int, anchored: bool = False) -> tuple[int, int]:
    """Fewest edits that turn the item into a piece of ``region``, and the end of that piece; banded.

    The piece starts anywhere, ``anchored`` at the region's start; cell k of row i stands for region place i + low + k.
    """
    far = len(item) + width + 1
    k = np.arange(width)
    row = np.where((low + k >= 0) & (low + k <= len(region)), low + k if anchored else 0, far)
    padded = np.full(len(region) + 2, 256, np.int64)
    padded[1:-1] = region
    for i, c in enumerate(item, 1):
        j = i + low + k  # region places after this byte
        other = padded[np.clip(j, 0, len(region) + 1)]
        other = np.where((j >= 1) & (j <= len(region)), other, 256)
        down = np.append(row[1:], far) + 1
        best = np.minimum(row + (other != c), down)
        best = np.where((j < 0) | (j > len(region)), far, best)
        row = np.minimum.accumulate(best - k) + k
    at = int(row.argmin())
    return int(row[at]), len(item) + low + at


def _hits(x: Grams, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows (text, item, diagonal, place in the item) of shared q-grams."""
    h = grams(buf, x.q)
    some = np.flatnonzero(x.bits[(h >> U(64 - _BITS)).astype(np.int64)])
    spot = np.searchsorted(x.keys, h[some])
    good = (spot < len(x.keys)) & (x.keys[np.minimum(spot, len(x.keys) - 1)] == h[some])
    some, spot = some[good], spot[good]
    text = np.searchsorted(at, some, "right") - 1
    inside = some + x.q <= at[text + 1]
    some, spot, text = some[inside], spot[inside], text[inside]
    counts = x.first[spot + 1] - x.first[spot]
    posting = K.spread(x.first[spot], counts)
    pos = np.repeat(some - at[text], counts)
    return np.stack([np.repeat(text, counts), x.item[posting], pos - x.place[posting], x.place[posting]]) if len(posting) else np.zeros((4, 0), np.int64)


def matches(x: Index, column) -> Iterator[tuple[int, int, int, int, int]]:
    """text, item, edits, start and end of each item found in each text (its best place)."""
    buf, at, kept, own = normal(column)
    if x.short and len(buf):
        for t, i, a, z in _whole_words(x, buf, at):
            yield t, i, 0, int(kept[a] - own[t]), int(kept[z - 1] - own[t]) + 1
    if not x.tables:
        return
    text, item, diagonal, place = np.concatenate([_hits(g, buf, at) for g in x.tables], axis=1)
    if not len(text):
        return
    wide = x.budget[item] + 1
    band = diagonal // wide
    keys = np.concatenate([np.stack([text, item, band, place]), np.stack([text, item, band - 1, place])], axis=1)
    keys = keys[:, np.lexsort(keys[::-1])]
    new = np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)])
    keys = keys[:, new]  # a q-gram of the item counts once in a band
    edge = np.flatnonzero(np.concatenate([[True], (keys[:3, 1:] != keys[:3, :-1]).any(0)]))
    counts = np.diff(np.append(edge, keys.shape[1]))
    good = counts >= np.maximum(x.bound[keys[1, edge]], 1)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for t, i, b in keys[:3, edge[good]].T.tolist():
        e, m = int(x.budget[i]), int(x.size[i])
        region = buf[at[t] : at[t + 1]]
        low = b * (e + 1) - e
        edits, end = align(x.texts[i], region, low, 4 * e + 3) if best.get((t, i), (e + 1,))[0] else (e + 1, 0)
        if edits <= e and edits < best.get((t, i), (e + 1,))[0]:
            back = region[max(0, end - m - e) : end][::-1]
            _, long = align(x.texts[i][::-1], back, -e, 2 * e + 1, anchored=True) if edits else (0, m)
            best[t, i] = (edits, end - long, end)
    for (t, i), (edits, begin, end) in best.items():
        yield t, i, edits, int(kept[at[t] + begin] - own[t]), int(kept[at[t] + end - 1] - own[t]) + 1


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most about BLOCK_BYTES, so that what is sent to tasks stays bounded."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * total // BLOCK_BYTES)) if total > BLOCK_BYTES else 1
    for b in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        yield [(r.item_id, r.text) for r in mine.collect()]


def find(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """doc_id, item_id, edits, start, end (bytes of the lower-case text) of each item that a document holds.

    With edits, the place is the first that ends where the alignment does and has its number of edits.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for items in _blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(index(items, budget))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            x = sent.value
            for b in K.slices(batches):
                ids = b.column("doc_id").to_pylist()
                got = [(ids[t], x.ids[i], e, s, z) for t, i, e, s, z in matches(x, b.column("text"))]
                columns = list(zip(*got, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "item_id", "edits", "start", "end"])

        part = rows.mapInArrow(run, OUT)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, with all columns."""
    for items in _blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(index(items, budget))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in K.slices(batches):
                keep = np.ones(b.num_rows, bool)
                keep[[t for t, *_ in matches(sent.value, b.column("text"))]] = False
                yield b.filter(pa.array(keep))
            give_back()

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
