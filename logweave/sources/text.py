"""Reading log files: UTF-8 text through Spark's reader, file tables, encoding census."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CENSUS_BYTES = 8192


def file_number(path: Column) -> Column:
    """The 64-bit number of a file: its path in lower case, local ones without the scheme."""
    return F.xxhash64(F.regexp_replace(F.lower(path), "^file:/+", "/"))


def files(spark: SparkSession, paths: list[str] | str, pattern: str | None = None) -> DataFrame:
    """file_id, path, size of files and folders (recursively); the same path in another case counts once."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    found = reader.load(paths).select("path", F.col("length").alias("size"))
    once = found.groupBy(F.lower("path").alias("k")).agg(F.min("path").alias("path"), F.min("size").alias("size"))
    return once.select(file_number(F.col("k")).alias("file_id"), "path", "size")


def lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """file_id, byte_offset (an order key: block start, then place in the block), text of plain UTF-8 files."""
    rows = spark.read.option("recursiveFileLookup", "true").text(paths).select("value", "_metadata.file_path", "_metadata.file_block_start")
    place = F.monotonically_increasing_id() % (1 << 33)
    return rows.select(file_number(F.url_decode(F.replace("file_path", F.lit("+"), F.lit("%2B")))).alias("file_id"), (F.col("file_block_start") + place).alias("byte_offset"), F.regexp_replace("value", "\r+$", "").alias("text"))


def zero_shares(head: bytes) -> tuple[float, float]:
    """The share of zero bytes at even and at odd places."""
    even, odd = head[::2], head[1::2]
    return even.count(0) / max(1, len(even)), odd.count(0) / max(1, len(odd))


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the share of zero bytes at even and odd places; heads that aren't given are read from the file."""
    for b in batches:
        heads = b.column("head").to_pylist()
        for i, path in enumerate(b.column("path").to_pylist()):
            if heads[i] is None:
                with open(re.sub("^file:/+", "/", path), "rb") as f:
                    heads[i] = f.read(CENSUS_BYTES)
        even, odd = (list(x) for x in zip(*map(zero_shares, heads), strict=True)) if heads else ([], [])
        yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(heads, pa.binary()), pa.array(even), pa.array(odd)], ["path", "head", "even", "odd"])


def encodings(spark: SparkSession, paths: list[str] | str, mounted: bool = True) -> DataFrame:
    """path, encoding: by byte-order mark, then CRLF in UTF-16, then the share of zero bytes, else UTF-8. Files that all
    workers mount are opened for their heads alone; others are read by Spark, which takes them whole."""
    head = F.lit(None).cast("binary") if mounted else F.substring("content", 1, CENSUS_BYTES)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    heads = found.select("path", head.alias("head")).repartition(F.col("path"))
    d = heads.mapInArrow(_shares, "path string, head binary, even double, odd double")
    return d.select("path", encoding_of_head().alias("encoding"))


def encoding_of_head() -> Column:
    """The encoding by columns head (first bytes), even and odd (shares of zero bytes at even and odd places)."""
    h = F.hex("head")
    le, be = F.col("odd") > 0.7, F.col("even") > 0.7
    pairs = lambda p: h.rlike(f"^(?:....)*?{p}")
    return (
        F.when(h.startswith("FFFE0000"), "UTF-32LE").when(h.startswith("0000FEFF"), "UTF-32BE").when(h.startswith("EFBBBF"), "UTF-8")
        .when(h.startswith("FFFE"), "UTF-16LE").when(h.startswith("FEFF"), "UTF-16BE").when(pairs("0D000A00"), "UTF-16LE").when(pairs("000D000A"), "UTF-16BE")
        .when(le & (F.col("even") < 0.1), "UTF-16LE").when(be & (F.col("odd") < 0.1), "UTF-16BE").otherwise("UTF-8")
    )
