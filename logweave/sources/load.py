"""From a folder to records: each file by its own encoding, mask and format, all of them in one chain of jobs.

``census`` finds the files and what they are (a format is looked for in the head as UTF-8, or as its byte-order mark says), ``lines`` reads them by byte ranges dealt over the tasks, ``records`` joins
lines to records and parses them into a struct per format, ``aligned`` puts the formats under one merged schema. Neither
the list of files nor that of ranges passes through the driver.

Defined cases: Spark's listing leaves out empty files, so they have no row; a file that no format matches is plain, read without a mask,
one record per line that isn't empty; a file without any line that opens a record has none; lines before the first are no
record; the same path in another case is one file; an empty folder gives empty tables; fields are kept inside structs, so
their names clash with nothing. Files must lie on a file system that all workers mount.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.functions import times
from logweave.functions.times import DAY, HOUR
from logweave.operators.merge import Source, merged_schema
from logweave.operators.records import LEAST_SHARE, PLAIN, PROBE_CHARS, PROBE_LINES, Format, field_column, field_columns
from logweave.operators.storage import settled
from logweave.sources import text
from logweave.sources.ranges import SPLIT, batches, unmasked, whole_units

#: Files of a task whose heads are read; tasks of a read at most, each of one or more ranges.
HEADS, MOST_TASKS = 200, 100_000
#: Bytes of a file that are sorted together.
CHUNK = 1 << 20
_HEADS = "file_id long, path string, size long, mask int, head binary, even double, odd double, lines array<string>"
_LINES = "file_id long, format string, byte_offset long, byte_len long, text string"
_MARKS = ((b"\xff\xfe\0\0", "utf-32-le"), (b"\0\0\xfe\xff", "utf-32-be"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))


def local(path: str) -> str:
    return re.sub("^file:/+", "/", path)


def _probe(data: bytes) -> list[str]:
    """The first lines of a head, read as UTF-8 unless a byte-order mark says otherwise."""
    said = data.decode(next((name for mark, name in _MARKS if data.startswith(mark)), "utf-8"), "replace").lstrip("\ufeff")
    found = re.split(r"\r\n|\r|\n", said, maxsplit=PROBE_LINES)[:PROBE_LINES]
    return found[:-1] if found and not found[-1] else found


def _heads(masks: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("file_id", pa.int64()), ("path", pa.string()), ("size", pa.int64()), ("mask", pa.int32()), ("head", pa.binary()), ("even", pa.float64()), ("odd", pa.float64()), ("lines", pa.list_(pa.string()))])

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for file in b.to_pylist():
                with open(local(file["path"]), "rb") as f:
                    raw = f.read(PROBE_CHARS)
                for mask in masks:
                    data = unmasked(raw, mask)
                    head = data[: text.CENSUS_BYTES]
                    even, odd = text.zero_shares(head)
                    yield pa.RecordBatch.from_pylist([{**file, "mask": mask, "head": head, "even": even, "odd": odd, "lines": _probe(data)}], schema)

    return read


def census(spark: SparkSession, paths: list[str] | str, formats: list[Format], pattern: str | None = None) -> DataFrame:
    """file_id, path, size, format, ratio, mask, encoding of each file: the format with the best share of matching lines in
    the head under the format's own mask (the first on ties), and the encoding under that mask."""
    found = settled(text.files(spark, paths, pattern), "files")
    tasks = max(1, min(MOST_TASKS, -(-found.count() // HEADS)))
    masks = sorted({0, *(f.xor_mask for f in formats)})
    heads = found.select("file_id", "path", "size").repartition(tasks, "path").mapInArrow(_heads(masks), _HEADS)
    whole = F.size("lines")
    share = lambda f: F.coalesce(F.size(F.filter("lines", lambda x: x.rlike(f.pattern.java))) / F.when(whole > 0, whole), F.lit(0.0))
    rated = [F.struct(F.when(F.col("mask") == f.xor_mask, share(f)).otherwise(-1.0).alias("ratio"), F.lit(-i).alias("order"), F.lit(f.name).alias("format")) for i, f in enumerate(formats)]
    none = F.struct(F.when(F.col("mask") == 0, F.lit(LEAST_SHARE)).otherwise(-1.0).alias("ratio"), F.lit(1).alias("order"), F.lit(PLAIN.name).alias("format"))
    best = heads.select("file_id", "path", "size", "mask", text.encoding_of_head().alias("encoding"), F.array_max(F.array(none, *rated)).alias("b"))
    chosen = best.groupBy("file_id", "path", "size").agg(F.max(F.struct("b.ratio", "b.order", "b.format", "mask", "encoding")).alias("m"))
    return chosen.select("file_id", "path", "size", "m.format", F.when(F.col("m.order") <= 0, F.col("m.ratio")).alias("ratio"), "m.mask", "m.encoding")


def _read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in rows:
        for r in b.to_pylist():
            for got in batches(r["file_id"], local(r["path"]), r["start"], min(r["size"], r["start"] + r["split"]), r["encoding"], r["mask"]):
                yield pa.RecordBatch.from_arrays([got.column("file_id"), pa.array([r["format"]] * got.num_rows, pa.string()), *got.columns[1:]], ["file_id", "format", "byte_offset", "byte_len", "text"])


def lines(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """file_id, format, byte_offset, byte_len, text of all files of a census, read by ranges of ``split`` bytes. Small files
    share tasks of that size. Give it a settled census: it is read twice, once to count the bytes."""
    split = whole_units(split)
    held = files.filter("size > 0")
    total, ranges = held.agg(F.sum("size"), F.sum(F.ceil(F.col("size") / F.lit(split)))).first()
    tasks = max(-(-(total or 0) // split), min(int(ranges or 1), 3 * files.sparkSession.sparkContext.defaultParallelism))
    planned = held.select("*", F.lit(split).cast("long").alias("split"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))).alias("start"))
    return planned.repartition(min(MOST_TASKS, tasks), "file_id", "start").mapInArrow(_read, _LINES)


def _by_format(formats: list[Format], value: Callable[[Format], Column]) -> Column:
    out = F.when(F.lit(False), value(formats[0]))
    for f in formats:
        out = out.when(F.col("format") == f.name, value(f))
    return out


def known(formats: list[Format]) -> list[Format]:
    """The formats of a load: the given ones and plain text."""
    return formats if any(f.name == PLAIN.name for f in formats) else [*formats, PLAIN]


def clock(fmt: Format) -> bool:
    """Whether the format's times are times of day: its layout has no year, month or day."""
    return bool(fmt.time_format) and not re.search("[yMd]", re.sub("'[^']*'", "", fmt.time_format))


def records(read: DataFrame, formats: list[Format], chunk: int = CHUNK) -> DataFrame:
    """file_id, format, line_no, byte_offset, text, parsed (a struct per format, null but for the file's own), ts_raw, ts_norm.

    Each line is tested against its own file's format only. Numbers and normalised times come from one scan: lines are sorted
    within chunks of ``chunk`` bytes, a chunk is summed up by its records, first and last time, days and largest time, and the
    summaries are combined in order. A record is joined where its chunk was sorted; only those at the edge of a chunk, at most
    two of each, meet again. So the texts are exchanged once.
    """
    formats = known(formats)
    daily = F.col("format").isin([f.name for f in formats if clock(f)])
    falls = lambda now, then: F.coalesce((daily & (now < then - HOUR)).cast("long"), F.lit(0).cast("long"))
    opens = F.coalesce(_by_format(formats, lambda f: F.col("text").rlike(f.pattern.java)), F.lit(False))
    time = lambda f: times.parse(field_column(F.col("text"), f.pattern, f.time_column()), f.time_format) if f.time_column() else F.lit(None).cast("long")

    own = Window.partitionBy("file_id", "chunk").orderBy("byte_offset")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    seen = read.filter((F.col("format") != PLAIN.name) | (F.col("text") != ""))
    seen = seen.select("file_id", "format", "byte_offset", "text", F.floor(F.col("byte_offset") / F.lit(chunk)).alias("chunk"), opens.alias("opens"))
    seen = seen.withColumn("raw", F.when(F.col("opens"), _by_format(formats, time)))
    seen = seen.withColumn("then", F.last("raw", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1)))
    seen = seen.withColumn("days", F.sum(falls(F.col("raw"), F.col("then"))).over(upto)).withColumn("n", F.count_if("opens").over(upto))
    seen = seen.withColumn("top", F.max(F.col("raw") + F.col("days") * DAY).over(upto))

    timed = F.when(F.col("raw").isNotNull(), F.col("byte_offset"))
    sums = seen.groupBy("file_id", "format", "chunk").agg(
        F.max("n").alias("all"), F.min_by("raw", timed).alias("first"), F.max_by("raw", timed).alias("last"), F.max("days").alias("days"), F.max("top").alias("top")
    )
    across = Window.partitionBy("file_id").orderBy("chunk")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.last("last", ignorenulls=True).over(earlier))
    sums = sums.withColumn("base", F.sum(F.col("days") + falls(F.col("first"), F.col("before"))).over(across.rowsBetween(Window.unboundedPreceding, 0)) - F.col("days"))
    sums = sums.select("file_id", "chunk", "all", "base", "before", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("had"), F.max(F.col("top") + F.col("base") * DAY).over(earlier).alias("height"))

    # nothing tells Spark how much text the files hold, so it might take the lines for the small side and broadcast them
    both = seen.hint("merge").join(sums, ["file_id", "chunk"])
    rolled = F.greatest("height", F.col("top") + F.col("base") * DAY)
    norm = F.coalesce(F.when(daily, rolled).otherwise(F.coalesce("raw", "then", "before")), F.lit(0))
    number = F.col("had") + F.col("n") - 1
    both = both.select("file_id", "format", "chunk", "byte_offset", "text", number.alias("line_no"), "raw", F.when(F.col("opens"), norm).alias("norm"), ((F.col("n") == 0) | (F.col("n") == F.col("all"))).alias("edge"))
    pieces = F.array_sort(F.collect_list(F.struct("byte_offset", "text")))
    joined = lambda p: F.array_join(F.transform(p, lambda x: x["text"]), "\n")
    parts = both.filter("line_no >= 0").groupBy("file_id", "chunk", "line_no").agg(
        F.first("format").alias("format"), F.bool_or("edge").alias("edge"), F.min("byte_offset").alias("byte_offset"), joined(pieces).alias("text"), F.max("raw").alias("ts_raw"), F.max("norm").alias("ts_norm")
    )
    parts = settled(parts, "parts", "zstd")  # the only table of texts
    met = parts.filter("edge").groupBy("file_id", "format", "line_no").agg(joined(pieces).alias("text"), F.min("byte_offset").alias("byte_offset"), F.max("ts_raw").alias("ts_raw"), F.max("ts_norm").alias("ts_norm"))
    whole = parts.filter("not edge").drop("edge", "chunk").unionByName(met)
    parsed = F.struct(*[F.when(F.col("format") == f.name, F.struct(*field_columns(f))).alias(f.name) for f in formats])
    return whole.select("file_id", "format", "line_no", "byte_offset", "text", parsed.alias("parsed"), "ts_raw", "ts_norm")


def aligned(rows: DataFrame, formats: list[Format]) -> DataFrame:
    """The records with ``fields`` instead of ``parsed``: one struct of merged fields, empty where a format lacks one; made in
    the scan that reads the records, without a union of sources."""
    formats = known(formats)
    schema = merged_schema([Source(rows, tuple(f.pattern.names), frozenset(f.indexed), f.time_column() is not None) for f in formats])
    value = lambda own: F.coalesce(*[F.col("parsed")[f.name][n] for f, n in zip(formats, own, strict=True) if n], F.lit(""))
    return rows.withColumn("fields", F.struct(*[value(own).alias(n) for n, _, own in schema])).drop("parsed")


def load(spark: SparkSession, paths: list[str] | str, formats: list[Format], pattern: str | None = None, split: int = SPLIT, chunk: int = CHUNK) -> DataFrame:
    """A folder of logs as aligned records, in one call."""
    files = settled(census(spark, paths, formats, pattern), "census")
    return aligned(records(lines(files, split), formats, chunk), formats)
