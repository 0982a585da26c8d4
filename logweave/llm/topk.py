"""Exact top-k search by inner product with a pivot-distance index (operator 1).

Vectors are lifted by one coordinate so that all have the length of the longest; the largest inner product with a query
is then the smallest distance to it. Each vector is keyed by its nearest pivot and the ring its distance to that pivot
lies in. For a query at distance D from a pivot, a vector at distance d is at least |D - d| away, so rings (annuli) are
taken in order of that bound: a first round visits the nearest ones until enough vectors are seen, a second one those
whose bound still reaches the k-th distance found; the others are left out.

Rings are stored as blocks of a bounded number of vectors, sorted by distance, each with its own least and largest one;
queries go to them in strips; both are read from storage again where they meet, so that nothing exchanged grows with the
number of pairs, only arithmetic and reads do. A task keeps the k best of each query over all its blocks and sends these alone. Where bounds
leave nothing out (vectors without any grouping, in many dimensions), all pairs are multiplied: exactly, in single
precision while all sums stay below 2**24. Of equal vectors only those of the k + 1 smallest ids can be among k answers,
so the others are not stored.

Only the sample that pivots and rings are fitted on and one line per ring (pivots times rings, both bounded) reach the driver.

Defined cases: vectors that are null or hold null, NaN or infinite components, and rows without an id, take no part;
shorter vectors count as filled with zeros; rows with the query's own id are never its answers; repeated rows may appear
repeatedly, of different vectors of one query id the least asks; ties go to smaller ids; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.llm.common import settled, table

PIVOTS, RINGS, PER_RING, SAMPLE = 64, 16, 4096, 4096
#: Vectors of a block, queries of a strip, vectors of a partition of blocks.
BLOCK, QUERIES, PART = 16384, 8192, 131072
#: Vectors a query sees in the first round at least: this many, and this part of all, which bounds what the second round finds.
FIRST, FIRST_PART = 512, 256
#: Queries and vectors multiplied at a time (2 MB of scores), vectors of which only the largest score is looked at.
TILE_Q, TILE_V, GROUP = 256, 2048, 32
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_LAST = np.iinfo(np.int64).max
_BLOCKS = "cell int, pivot int, low double, high double, ids binary, vectors binary"
_STRIPS = "strip long, width int, qids binary, qvectors binary, near binary"


def _whole(embeddings: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows take part, their lengths, and floor(scale * component) of all of them in one array."""
    at = np.asarray(embeddings.offsets)
    flat = embeddings.values.slice(at[0], at[-1] - at[0])
    bad = ~np.asarray(flat.is_valid())
    x = flat.fill_null(0).cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)
    bad |= ~np.isfinite(x)
    row = np.repeat(np.arange(len(embeddings)), np.diff(at))
    good = np.asarray(embeddings.is_valid()).copy()
    good[row[bad]] = False
    with np.errstate(over="ignore"):
        x = np.floor(x[good[row]] * scale)
    edge = 2.0**63
    return good, np.diff(at)[good], np.where(x >= edge, _LAST, np.where(x < -edge, -_LAST - 1, np.where(np.abs(x) < edge, x, 0).astype(np.int64)))


def _lists(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The rows of each batch that take part, their lengths and numbers."""
    for b in batches:
        column = b.column("embedding")
        if not pa.types.is_list(column.type):
            column = column.cast(pa.list_(column.type.value_type))
        good, lengths, flat = _whole(column, scale)
        yield b.filter(pa.array(good)), lengths, flat


def _measures(scale: int):
    """For each batch: queries, longest list, largest square of a length, least and largest number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, lengths, flat in _lists(batches, scale):
            if b.num_rows:
                square = np.bincount(np.repeat(np.arange(len(lengths)), lengths), flat.astype(np.float64) ** 2, len(lengths)).max()
                queries = b.column("asks").true_count
                yield pa.RecordBatch.from_pylist([{"queries": queries, "dim": int(lengths.max()), "square": float(square), "low": int(flat.min(initial=0)), "high": int(flat.max(initial=0))}])

    return run


def _packer(dim: int, stored: str, scale: int):
    """Vectors as the bytes of their whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, lengths, flat in _lists(batches, scale):
            if (lengths == dim).all():
                m = flat.reshape(-1, dim).astype(stored)
            else:
                m, start = np.zeros((len(lengths), dim), stored), np.cumsum(lengths) - lengths
                m[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(start, lengths)] = flat
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(m.itemsize * dim), len(m), [None, pa.py_buffer(m)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), packed, pa.array(lengths, pa.int32()), b.column("asks")], ["vec_id", "v", "length", "asks"])

    return run


def _lifted(m: np.ndarray, longest: float) -> np.ndarray:
    x = m.astype(np.float64)
    return np.hstack([x, np.sqrt(np.maximum(longest - (x * x).sum(1), 0))[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0))


def _numbers(dim: int, stored: str):
    """Adds the numbers of each vector as the list it came as, by which vectors of one id are compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, lengths = _vectors(b.column("v"), dim, stored).astype(np.int64), b.column("length").to_numpy()
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), pa.array(m[np.arange(dim) < lengths[:, None]]))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), lists], ["vec_id", "v", "numbers"])

    return run


def _vectors(column: pa.Array, dim: int, stored: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), stored).reshape(-1, dim)


def _nearest(m: np.ndarray, pivots: np.ndarray, longest: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each vector, and how far that is."""
    d = _distances(_lifted(m, longest), pivots)
    near = d.argmin(1)
    return near, d[np.arange(len(near)), near]


def _cuts(sample: np.ndarray, pivots: np.ndarray, longest: float, rings: int) -> np.ndarray:
    """For each pivot the distances that part the sample's vectors around it into rings of equal numbers."""
    near, d = _nearest(sample, pivots, longest)
    shares = np.arange(1, rings) / rings
    return np.array([np.quantile(d[near == p], shares) if (near == p).any() else np.zeros(rings - 1) for p in range(len(pivots))])


def _keyer(pivots: np.ndarray, cuts: np.ndarray, dim: int, stored: str, longest: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near, d = _nearest(_vectors(b.column("v"), dim, stored), pivots, longest)
            ring = (d[:, None] >= cuts[near]).sum(1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(near, pa.int32()), pa.array(ring, pa.int32()), pa.array(d)], ["vec_id", "v", "pivot", "ring", "d"])

    return run


def _runs(batches: Iterator[pa.RecordBatch], size: int, keys: list[str]) -> Iterator[pa.Table]:
    """Rows that follow each other with equal keys, at most ``size`` of them at a time."""
    held, key, rows = [], None, 0
    for b in batches:
        values = [np.asarray(b.column(c)) for c in keys]
        change = np.zeros(b.num_rows, bool)
        for v in values:
            change[1:] |= v[1:] != v[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for start, end in zip(edges, edges[1:], strict=False):
            if start == end:
                continue
            this = tuple(v[start] for v in values)
            if held and this != key:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
            key = this
            while start < end:
                some = min(end - start, size - rows)
                held.append(b.slice(start, some))
                start, rows = start + some, rows + some
                if rows == size:
                    yield pa.Table.from_batches(held)
                    held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _blocks(number: dict[tuple[int, int], int], dim: int, stored: str, size: int):
    """Blocks of the rings, ids ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, size, ["pivot", "ring"]):
            ids, d, m = t.column("vec_id").to_numpy(), t.column("d").to_numpy(), _vectors(t.column("v"), dim, stored)
            order, pivot = np.argsort(ids, kind="stable"), t.column("pivot")[0].as_py()
            yield _batch({"cell": number[pivot, t.column("ring")[0].as_py()], "pivot": pivot, "low": d.min(), "high": d.max(), "ids": ids[order].tobytes(), "vectors": m[order].tobytes()})

    return run


def _bounds(q: np.ndarray, pivots: np.ndarray, longest: float, cells: np.ndarray) -> np.ndarray:
    """Largest inner product that a vector of each ring can have with each query. cells: pivot, least and largest d."""
    lifted = np.hstack([q.astype(np.float64), np.zeros((len(q), 1))])
    to = _distances(lifted, pivots)[:, cells[:, 0].astype(int)]
    return _reach(to, cells[:, 1], cells[:, 2], (q.astype(np.float64) ** 2).sum(1)[:, None], longest)


def _reach(to: np.ndarray, low: np.ndarray | float, high: np.ndarray | float, square: np.ndarray, longest: float) -> np.ndarray:
    gap = np.maximum(0, np.maximum(to - high, low - to))
    square = square + longest
    return (square - gap * gap) / 2 + 1e-6 * square + 1e-3  # rounding of the distances never prunes


def _strips(pivots: np.ndarray, dim: int, stored: str, longest: float, cells: np.ndarray, counts: np.ndarray, first: int, size: int):
    """Strips of queries. near: for each ring a bit per query, whether the first round visits it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, size, []):
            ids, q = t.column("vec_id").to_numpy(), _vectors(t.column("v"), dim, stored)
            near = np.zeros((len(cells), len(ids)), bool)
            for at in range(0, len(ids), 512):
                bound = _bounds(q[at : at + 512], pivots, longest, cells)
                order = np.argsort(-bound, axis=1, kind="stable")
                visit = np.zeros(bound.shape, bool)
                np.put_along_axis(visit, order, np.cumsum(counts[order], axis=1) - counts[order] < first, axis=1)
                near[:, at : at + 512] = visit.T
            bits = np.packbits(near, axis=1)
            yield _batch({"strip": ids[0], "width": bits.shape[1], "qids": ids.tobytes(), "qvectors": q.tobytes(), "near": bits.tobytes()})

    return run


def _batch(row: dict) -> pa.RecordBatch:
    kinds = {"strip": pa.int64(), "cell": pa.int32(), "pivot": pa.int32(), "width": pa.int32(), "low": pa.float64(), "high": pa.float64()}
    return pa.RecordBatch.from_arrays([pa.array([x], kinds.get(c, pa.binary())) for c, x in row.items()], list(row))


def _near(r: dict, cells: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(r["near"], np.uint8).reshape(cells, -1), axis=1, count=len(r["qids"]) // 8).astype(bool)


def _visits(dim: int, stored: str, cells: int):
    """The first round: for each ring the queries of a strip that visit it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, q, near = np.frombuffer(r["qids"], np.int64), np.frombuffer(r["qvectors"], stored).reshape(-1, dim), _near(r, cells)
                for cell in np.flatnonzero(near.any(1)):
                    yield _batch({"cell": cell, "qids": ids[near[cell]].tobytes(), "qvectors": q[near[cell]].tobytes()})

    return run


def _wanted(pivots: np.ndarray, dim: int, stored: str, longest: float, cells: np.ndarray):
    """The second round. want: for each ring a byte, whether any query that has not visited it has a bound that reaches
    its k-th score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                q, known, near = np.frombuffer(r["qvectors"], stored).reshape(-1, dim), np.array(r["known"], np.float64), _near(r, len(cells))
                want = np.zeros(len(cells), bool)
                for at in range(0, len(q), 512):
                    want |= (~near[:, at : at + 512].T & (_bounds(q[at : at + 512], pivots, longest, cells) >= known[at : at + 512, None])).any(0)
                yield _batch(r | {"known": known.tobytes(), "want": want.astype(np.uint8).tobytes()})

    return run


class _Strip:
    """Queries with the k best that a task has found for each so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, known: np.ndarray | None, kind: type, k: int):
        q = q.reshape(len(ids), -1)
        self.ids, self.q, self.k, self.kind = ids, q.astype(kind), k, kind
        self.sorted = np.argsort(ids)
        self.square = (q.astype(np.float64) ** 2).sum(1)
        whole = kind is np.int64
        self.lowest = np.iinfo(kind).min if whole else kind(-np.inf)
        self.known = np.full(len(ids), -np.inf) if known is None else known
        #: What a score must reach; at that score, the largest id that still counts.
        self.least = np.full(len(ids), self.lowest, kind) if whole else self.known.astype(kind)
        self.last = np.full(len(ids), _LAST)
        self.held, self.waiting = [], 0
        self.scores = np.empty(TILE_V * TILE_Q, kind)

    def keep_distances(self, pivots: np.ndarray) -> None:
        self.to = np.vstack([np.sqrt(np.maximum(self.square + p @ p - 2 * (self.q.astype(np.float64) @ p[:-1]), 0), dtype=np.float32) for p in pivots])

    def reaching(self, pivot: int, low: float, high: float, longest: float) -> np.ndarray:
        """Which queries can have an answer in a ring."""
        return _reach(self.to[pivot].astype(np.float64), low, high, self.square, longest) >= np.maximum(self.known, self.least.astype(np.float64))

    def visit(self, rows: np.ndarray, ids: np.ndarray, m: np.ndarray) -> None:
        """Take in the vectors ``m``, whose ids ascend, for the queries ``rows``."""
        at = self.sorted[np.minimum(np.searchsorted(self.ids, ids, sorter=self.sorted), len(self.ids) - 1)]
        own = np.flatnonzero(self.ids[at] == ids)
        place = np.full(len(self.ids), -1)
        place[rows] = np.arange(len(rows))
        own, whose = own[place[at[own]] >= 0], place[at[own]][place[at[own]] >= 0]
        tiles = -(-len(m) // TILE_V)
        width = -(-len(m) // (max(tiles, 1) * GROUP)) * GROUP
        for q0 in range(0, len(rows), TILE_Q):
            who = rows[q0 : q0 + TILE_Q]
            columns = self.q[who].T
            for v0 in range(0, len(m), width):
                part = m[v0 : v0 + width]
                groups = -(-len(part) // GROUP)
                scores = self.scores[: groups * GROUP * len(who)].reshape(groups * GROUP, len(who))
                np.matmul(part, columns, out=scores[: len(part)])
                scores[len(part) :] = self.lowest
                if len(own):
                    here = (own >= v0) & (own < v0 + width) & (whose >= q0) & (whose < q0 + TILE_Q)
                    scores[own[here] - v0, whose[here] - q0] = self.lowest
                self._take(who, scores.reshape(groups, GROUP, len(who)), ids[v0 : v0 + width])
                if self.waiting > self.k * len(self.ids) + 65536:
                    self.settle()

    def _take(self, who: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        top, least = scores.max(1), self.least[who]
        hits = np.flatnonzero(top >= least)
        if len(hits) > 4 * len(who) and len(top) >= self.k:  # k groups reach the k-th of their largest scores
            kth = np.partition(top, len(top) - self.k, axis=0)[len(top) - self.k]
            self.last[who[kth > least]] = _LAST
            self.least[who] = least = np.maximum(least, kth)
            hits = np.flatnonzero(top >= least)
        if not len(hits):
            return
        group, row = np.divmod(hits, len(who))
        counts = (top[group, row] > least[row]) | (ids[group * GROUP] <= self.last[who[row]])
        group, row = group[counts], row[counts]
        some = scores[group, :, row]
        hit, place = np.nonzero((some >= least[row][:, None]) & (some > self.lowest))
        if len(hit):
            self.held.append((who[row[hit]], some[hit, place], ids[group[hit] * GROUP + place]))
            self.waiting += len(hit)

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keeps the k best of each query: rows of queries, scores, ids."""
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, self.kind), np.zeros(0, np.int64)
        row, score, ids = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        rank = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)]))
        full = rank == self.k - 1
        self.least[row[full]], self.last[row[full]] = score[full], ids[full]
        best = rank < self.k
        self.held, self.waiting = [(row[best], score[best], ids[best])], 0
        return self.held[0]

    def found(self) -> pa.RecordBatch:
        row, score, ids = self.settle()
        return pa.RecordBatch.from_arrays([pa.array(self.ids[row]), pa.array(ids), pa.array(score.astype(np.int64))], ["query_id", "vec_id", "score"])


def _first(dim: int, stored: str, kind: type, k: int):
    """Scores of the queries that visit a ring, with one of its blocks a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for qids, q, ids, m in zip(*(b.column(c) for c in ("qids", "qvectors", "ids", "vectors")), strict=True):
                strip = _Strip(np.frombuffer(qids.as_buffer(), np.int64), np.frombuffer(q.as_buffer(), stored).reshape(-1, dim), None, kind, k)
                strip.visit(np.arange(len(strip.ids)), *_block(ids, m, dim, stored, kind))
                yield strip.found()

    return run


def _block(ids: pa.Scalar, m: pa.Scalar, dim: int, stored: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(m.as_buffer(), stored).reshape(-1, dim).astype(kind)


def _second(pivots: np.ndarray, dim: int, stored: str, longest: float, kind: type, k: int):
    """Scores of the strips with all blocks of a task, for the queries whose bound reaches what is known by then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strips: dict[int, _Strip] = {}
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i] for c in b.schema.names}
                strip = strips.get(r["strip"].as_py())
                if strip is None:
                    strip = _Strip(*(np.frombuffer(r[c].as_py(), t) for c, t in (("qids", np.int64), ("qvectors", stored), ("known", np.float64))), kind, k)
                    strip.keep_distances(pivots)
                    strips[r["strip"].as_py()] = strip
                seen = np.unpackbits(np.frombuffer(r["near"].as_py(), np.uint8), count=len(strip.ids)).astype(bool)
                rows = np.flatnonzero(~seen & strip.reaching(r["pivot"].as_py(), r["low"].as_py(), r["high"].as_py(), longest))
                if len(rows):
                    strip.visit(rows, *_block(r["ids"], r["vectors"], dim, stored, kind))
        for strip in strips.values():
            yield strip.found()

    return run


@contextmanager
def _few_bytes(spark: SparkSession):
    """Rows of blocks and strips go to Python 8 MB at a time: a task held several times the usual 64 MB."""
    usual = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, "8m")
    try:
        yield
    finally:
        spark.conf.set(_BATCH, usual)


def search(embeddings: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products of each row that ``is_query`` picks."""
    spark = embeddings.sparkSession
    rows = embeddings.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long"), "embedding")
    rows = rows.withColumn("asks", F.coalesce(is_query, F.lit(False)))
    measures = rows.mapInArrow(_measures(scale), "queries long, dim long, square double, low long, high long")
    queries, dim, longest, lowest, highest = measures.agg(F.sum("queries"), F.max("dim"), F.max("square"), F.min("low"), F.max("high")).first()
    if not queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = max(dim, 1)
    stored = next(t for t in ("<i2", "<i4", "<i8") if np.iinfo(t).min <= lowest and highest <= np.iinfo(t).max)
    kind = np.float32 if longest <= 2**24 else np.float64 if longest < 2**52 else np.int64  # no sum is larger than the longest square
    vectors = settled(rows.mapInArrow(_packer(dim, stored, scale), "vec_id long, v binary, length int, asks boolean"), "vectors")
    same = Window.partitionBy("v").orderBy("vec_id")
    packed = settled(vectors.withColumn("copy", F.dense_rank().over(same)).filter(F.col("copy") <= k + 1).select("vec_id", "v"), "packed")
    n = packed.count()
    count = max(1, min(PIVOTS, n // (2 * PER_RING)))
    rings = max(1, min(RINGS, n // (count * PER_RING)))
    sample = packed.orderBy(F.xxhash64("v"), "vec_id").limit(SAMPLE).dropDuplicates(["v"]).orderBy(F.xxhash64("v"), "v")  # bounded
    sample = _vectors(pa.array([bytes(r.v) for r in sample.select("v").collect()], pa.binary()), dim, stored)
    pivots = _lifted(sample[:count], longest)
    cuts = _cuts(sample, pivots, longest, rings)
    keyer, fields = _keyer(pivots, cuts, dim, stored, longest), "vec_id long, v binary, pivot int, ring int, d double"
    keyed = settled(packed.mapInArrow(keyer, fields), "keyed")
    stats = keyed.groupBy("pivot", "ring").agg(F.min("d"), F.max("d"), F.count("*")).orderBy("pivot", "ring").collect()  # pivots * rings at most
    cells, counts = np.array([(r[0], r[2], r[3]) for r in stats]), np.array([r[4] for r in stats])
    number = {(r[0], r[1]): i for i, r in enumerate(stats)}
    order = ["pivot", "ring", "d"]
    parts = max(spark.sparkContext.defaultParallelism, -(-n // PART))
    blocks = settled(keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_blocks(number, dim, stored, BLOCK), _BLOCKS), "blocks")
    numbers = vectors.filter("asks").mapInArrow(_numbers(dim, stored), "vec_id long, v binary, numbers array<long>")
    strips = -(-queries // QUERIES)
    asked = numbers.groupBy("vec_id").agg(F.min_by("v", "numbers").alias("v")).mapInArrow(keyer, fields)
    asked = settled(asked, "asked").repartitionByRange(strips, *order).sortWithinPartitions(*order)
    seen = max(FIRST, k + 1, n // FIRST_PART)
    asked = settled(asked.mapInArrow(_strips(pivots, dim, stored, longest, cells, counts, seen, 2 * QUERIES), _STRIPS), "strips")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def best(found: DataFrame) -> DataFrame:
        with _few_bytes(spark):
            return settled(found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).drop("rank"), "round")

    found = "query_id long, vec_id long, score long"
    visits = asked.select("qids", "qvectors", "near").mapInArrow(_visits(dim, stored, len(cells)), "cell int, qids binary, qvectors binary")
    rings_visited = visits.hint("merge").join(blocks.select("cell", "ids", "vectors"), "cell")  # Spark knows no size of visits
    one = best(rings_visited.mapInArrow(_first(dim, stored, kind, k), found))
    least = one.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).otherwise(float("-inf")).alias("least"))
    known = asked.select("strip", "qids").mapInArrow(_ids, "strip long, i int, query_id long").join(least, "query_id", "left")
    limits = known.groupBy("strip").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("least", F.lit(float("-inf"))).alias("least")))).alias("l"))
    limited = asked.join(limits.select("strip", F.col("l.least").alias("known")), "strip").select(*asked.columns, "known")
    limited = limited.mapInArrow(_wanted(pivots, dim, stored, longest, cells), _STRIPS + ", known binary, want binary")
    limited = settled(limited.repartition(strips), "limited")
    wanted = F.substring("want", F.col("cell") + 1, F.lit(1)) == F.lit(b"\x01")
    near = F.substring("near", F.col("cell") * F.col("width") + 1, F.col("width")).alias("near")
    pairs = blocks.join(limited.hint("shuffle_replicate_nl"), wanted)  # both are read from storage again, nothing is exchanged
    pairs = pairs.select("strip", "qids", "qvectors", near, "known", "pivot", "low", "high", "ids", "vectors")
    two = best(pairs.mapInArrow(_second(pivots, dim, stored, longest, kind, k), found))
    final = one.unionByName(two).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    return final.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for strip, ids in zip(b.column("strip").to_pylist(), b.column("qids").to_pylist(), strict=True):
            x = np.frombuffer(ids, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([strip] * len(x), pa.int64()), pa.array(np.arange(len(x)), pa.int32()), pa.array(x, pa.int64())], ["strip", "i", "query_id"])


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


SQL = """
with v as (
  select vec_id::bigint as vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v
  from embeddings where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score from v q, v c where q.vec_id % 100 = 0 and q.vec_id <> c.vec_id),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 10
"""
