"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule: blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a folder of our own only if it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="logweave-")  # one machine, as in tests
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def settled(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Returns memory that a fit or a task has freed to the system, which Arrow and the C library else keep for a process
    that may live on through stages of quite another need."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_text(col: str | Column) -> Column:
    """crc32 of a number written as text."""
    return F.crc32(F.col(col).cast("string") if isinstance(col, str) else col.cast("string"))


def running_totals(df: DataFrame, order: list[Column], sums: dict[str, Column], rank: str | None = None) -> DataFrame:
    """Exclusive running sums (and a rank from 0) over the whole table in ``order``, without one task that sees all rows.

    The rows are dealt by range, settled, summed inside each range, and each range gets the totals of the ranges before
    it; only one row per range meets in a single task. Rows that tie in ``order`` follow each other in any order, so the
    order given should be total.
    """
    from pyspark.sql import Window

    tag = "__range"
    dealt = settled(df.repartitionByRange(*order).withColumn(tag, F.spark_partition_id()), "ranges")
    sums = dict(sums) | ({rank: F.lit(1)} if rank else {})
    totals = dealt.groupBy(tag).agg(*[F.sum(c).alias(f"__t_{k}") for k, c in sums.items()])
    before = Window.orderBy(tag).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(tag, *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__o_{k}") for k in sums])
    inside = Window.partitionBy(tag).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"__l_{k}") for k, c in sums.items()])
    joined = local.join(F.broadcast(offsets), tag)  # one row per range: as many as there are shuffle partitions
    return joined.select(*df.columns, *[(F.col(f"__l_{k}") + F.col(f"__o_{k}")).alias(k) for k in sums])
