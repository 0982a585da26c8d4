"""Texts laid out in parts of bounded size, and questions that all parts ask each other through shuffles of packed keys.

``lay_out`` writes the texts once, bucketed by part, so that later passes over whole parts read them without a shuffle.
In a pass each part emits the distinct 64-bit keys it holds, packed into one binary per bucket of keys; a bucket looks at
the keys of all parts and answers each part in the order it asked. A key that a third of all documents hold is thus
looked at once per part, and neither a part nor a bucket grows with how often a key occurs in it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import give_back, settled

PART_BYTES = 8 << 20
#: Spark's own limit is 100,000 buckets; a bucket holds several parts beyond this number.
MOST_BUCKETS = 20_000
ASKED = "part int, bucket int, keys binary, docs binary"
ANSWERED = "part int, pass int, bucket int, flags binary"
_ASKED = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary())])
_ANSWERED = pa.schema([("part", pa.int32()), ("pass", pa.int32()), ("bucket", pa.int32()), ("flags", pa.binary())])
U = np.uint64


@dataclass
class Parts:
    rows: DataFrame  # part, doc_id, text
    count: int
    name: str

    def drop(self) -> None:
        """Remove the texts; what was derived from them must be settled."""
        self.rows.sparkSession.sql(f"drop table {self.name}")


def lay_out(docs: DataFrame, part_bytes: int = PART_BYTES) -> Parts:
    """Parts of about ``part_bytes`` of text by a hash of the row; a longer text stays whole."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // part_bytes))
    buckets, name = min(count, MOST_BUCKETS), f"parts_{uuid.uuid4().hex}"
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(count)).cast("int")).repartition(buckets, "part")
    dealt.write.bucketBy(buckets, "part").saveAsTable(name)  # in the warehouse, which all executors share
    return Parts(spark.table(name), count, name)


def ask(parts: Parts, emit: Callable, answers: DataFrame | None = None, schema: str = ASKED) -> DataFrame:
    """``emit(table, answers)`` for each part: its rows, and what was answered to it so far (None at first)."""

    def released(out):
        give_back()
        return out

    if answers is None:

        def alone(table):
            return released(emit(table, None))

        return parts.rows.groupBy("part").applyInArrow(alone, schema)

    def both(table, answered):
        return released(emit(table, answered))

    return parts.rows.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(both, schema)


def answer(asked: DataFrame, number: int, decide: Callable) -> DataFrame:
    """``decide(keys, docs, sizes)`` for each bucket: one byte per key, in the order they came; settled."""

    def run(table):
        keys = table.column("keys").to_pylist()
        docs = table.column("docs").to_pylist()
        flags = decide(keys, docs)
        n = table.num_rows
        return pa.table([table.column("part"), pa.array([number] * n, pa.int32()), table.column("bucket"), pa.array(flags, pa.binary())], schema=_ANSWERED)

    return settled(asked.groupBy("bucket").applyInArrow(run, ANSWERED), f"answers{number}")


def _split(flags: np.ndarray, sizes: list[int]) -> list[bytes]:
    ends = np.cumsum(sizes)
    return [flags[e - s : e].tobytes() for s, e in zip(sizes, ends, strict=True)]


def scaled(counts: np.ndarray) -> np.ndarray:
    """Counts from 1 to 2**31 as one byte in their order: 1 stays 1, then eight steps for each doubling."""
    return (1 + np.ceil(8 * np.log2(np.maximum(counts, 1)))).astype(np.uint8)


def holders(keys: list[bytes], docs: list) -> list[bytes]:
    """To each 32-bit key the number of parts that hold it, ``scaled``."""
    flat = np.concatenate([_columns(k, "<u4") for k in keys])
    _, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    return _split(scaled(counts)[inverse], [len(k) // 4 for k in keys])


def earlier(keys: list[bytes], docs: list[bytes]) -> list[bytes]:
    """To each 64-bit key 1 if another part holds it with a smaller document, else 0."""
    flat, ids = (np.concatenate([_columns(x, kind) for x in one]) for one, kind in ((keys, "<u8"), (docs, "<i8")))
    _, inverse = np.unique(flat, return_inverse=True)
    least = np.full(int(inverse.max()) + 1 if len(flat) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, inverse, ids)
    return _split((ids > least[inverse]).astype(np.uint8), [len(k) // 8 for k in keys])


def _planes(x: np.ndarray) -> bytes:
    """All first bytes, then all second ones and so on: sorted keys and small numbers compress better so."""
    return x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()


def _columns(raw: bytes, kind: str) -> np.ndarray:
    """The numbers of ``_planes``."""
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def packed(part: int, bucket: np.ndarray, keys: np.ndarray, docs: np.ndarray | None = None) -> pa.Table:
    """Keys sorted by bucket as one row per bucket."""
    cuts = np.flatnonzero(np.diff(bucket)) + 1 if len(bucket) else np.zeros(0, np.int64)
    begin, end = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(bucket)]])
    if not len(bucket):
        begin = end = np.zeros(0, np.int64)
    ids = docs.astype("<i8") if docs is not None else None
    return pa.table([
        pa.array(np.full(len(begin), part), pa.int32()),
        pa.array(bucket[begin].astype(np.int32), pa.int32()),
        pa.array([_planes(keys[b:e]) for b, e in zip(begin, end, strict=True)], pa.binary()),
        pa.array([None if ids is None else _planes(ids[b:e]) for b, e in zip(begin, end, strict=True)], pa.binary()),
    ], schema=_ASKED)


def answered(table: pa.Table, number: int) -> np.ndarray:
    """A part's answers to pass ``number``, in the order of its keys by bucket."""
    rows = [(b, f) for p, b, f in zip(*(table.column(c).to_pylist() for c in ("pass", "bucket", "flags")), strict=True) if p == number]
    return np.frombuffer(b"".join(f for _, f in sorted(rows)), np.uint8)


class Short:
    """A part's distinct 64-bit hashes as (bucket, 32 bits): enough to find what may be shared, not to prove it."""

    def __init__(self, hashes: np.ndarray, buckets: int):
        self.joint = ((hashes >> U(32)) % U(buckets) << U(32)) | (hashes & U(0xFFFFFFFF))
        self.distinct, self.of, self.counts = np.unique(self.joint, return_inverse=True, return_counts=True)

    def table(self, part: int) -> pa.Table:
        return packed(part, (self.distinct >> U(32)).astype(np.int64), (self.distinct & U(0xFFFFFFFF)).astype("<u4"))


class Earliest:
    """A part's distinct records (64-bit hash, bucket from a second hash) with their smallest document."""

    def __init__(self, hashes: np.ndarray, second: np.ndarray, docs: np.ndarray, buckets: int):
        distinct, first, of = np.unique(hashes, return_index=True, return_inverse=True)
        least = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(least, of, docs)
        bucket = (second[first] % U(buckets)).astype(np.int64)
        order = np.lexsort((distinct, bucket))
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.of, self.docs, self.least = of, docs, least
        self.sent = (bucket[order], distinct[order].astype("<u8"), least[order])

    def table(self, part: int) -> pa.Table:
        return packed(part, *self.sent)

    def repeated(self, flags: np.ndarray) -> np.ndarray:
        """Which of the records given stand in a smaller document, in this part or by the answers."""
        return (self.docs > self.least[self.of]) | (flags[self.rank][self.of] > 0)
