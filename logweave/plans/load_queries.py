"""Queries of whole folders: documents are written as log files in three formats and encodings, and loaded in one call."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.operators.records import Format
from logweave.operators.storage import shared_dir
from logweave.plans.base import table
from logweave.sources import load

#: Documents of a file, and the file's kind by its number: encoding, byte-order mark, mask, line end.
DOCUMENTS = 100
KINDS = (("utf-8", "", 0xA5, "\n"), ("utf-16-le", "\ufeff", 0, "\r\n"), ("utf-8", "", 0, "\n"))
FORMATS = [
    Format("masked", r"^(?'Time'\d\d:\d\d:\d\d\.\d{3}) (?'Level'\S+) (?'Message'.*)", ("Level",), "Time", "HH:mm:ss.fff", xor_mask=0xA5),
    Format("wide", r"^(?'When'\d{4}-\d\d-\d\d \d\d:\d\d:\d\d) \[(?'Severity'[^\]]*)\] (?'Text'.*)", ("Severity",), "When", "yyyy-MM-dd HH:mm:ss"),
    Format("piped", r"^\|(?'Level'[^|]*)\|(?'Text'.*)", ("Level",)),
]


def _writer(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes lines that come sorted by file; a file gets its name once it is whole, so a task can be run again."""

    def write(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        own, out, at, done = f"{folder}/.{uuid.uuid4().hex}", None, None, []
        for b in rows:
            for number, line in zip(b.column("file").to_pylist(), b.column("line").to_pylist(), strict=True):
                encoding, mark, mask, end = KINDS[number % len(KINDS)]
                if number != at:
                    if out:
                        out.close()
                        os.replace(own, f"{folder}/{at}.log")
                        done.append(at)
                    out, at = open(own, "wb"), number  # noqa: SIM115
                    line = mark + line
                data = (line + end).encode(encoding)
                out.write(data.translate(bytes(x ^ mask for x in range(256))) if mask else data)
        if out:
            out.close()
            os.replace(own, f"{folder}/{at}.log")
            done.append(at)
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64())], ["file"])

    return write


def written(spark: SparkSession, sf: str) -> str:
    """A folder of log files of all documents, a hundred to a file."""
    folder = load.local(f"{shared_dir(spark)}/folder-{uuid.uuid4().hex}")
    d = table(spark, sf, "documents").filter("doc_id is not null")
    at = F.timestamp_seconds(F.col("doc_id") * 997)
    said = F.concat(F.col("doc_id").cast("string"), F.lit(" "), F.regexp_replace(F.coalesce("text", F.lit("")), "[\r\n]+", " "))
    level = F.coalesce("lang", F.lit("-"))
    kind = F.col("file") % len(KINDS)
    line = (
        F.when(kind == 0, F.concat(F.date_format(at, "HH:mm:ss.SSS"), F.lit(" "), level, F.lit(" "), said))
        .when(kind == 1, F.concat(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit(" ["), level, F.lit("] "), said))
        .otherwise(F.concat(F.lit("|"), level, F.lit("|"), said))
    )
    dealt = d.withColumn("file", F.floor(F.col("doc_id") / DOCUMENTS)).select("file", "doc_id", line.alias("line"))
    dealt.repartition("file").sortWithinPartitions("file", "doc_id").select("file", "line").mapInArrow(_writer(folder), "file long").write.format("noop").mode("overwrite").save()
    return folder


SQL_FOLDER = f"""
with d as (select doc_id, doc_id // {DOCUMENTS} as file, coalesce(lang, '-') as level, doc_id || ' ' || regexp_replace(coalesce(text, ''), '[\r\n]+', ' ', 'g') as message from documents where doc_id is not null),
n as (select *, row_number() over (partition by file order by doc_id) - 1 as line_no, min(doc_id) over (partition by file) as first from d)
select doc_id, ['masked', 'wide', 'piped'][file % 3 + 1] as format, line_no, level as severity, sha256(message) as message_sha256,
       case file % 3 when 0 then (doc_id * 997 - first * 997 // 86400 * 86400) * 1000000 when 1 then doc_id * 997 * 1000000 else 0 end as ts_norm
from n
"""


def folder_load(spark: SparkSession, sf: str) -> DataFrame:
    """Every document back from the files: format, record, severity, digest of the message, normalised time."""
    rows = load.load(spark, written(spark, sf), FORMATS)
    message, severity = F.col("fields.Message"), F.col("fields.Severity")
    return rows.select(F.substring_index(message, " ", 1).cast("long").alias("doc_id"), "format", "line_no", severity.alias("severity"), F.sha2(message, 256).alias("message_sha256"), "ts_norm")


QUERIES = {"folder_load": folder_load}
SQL = {"folder_load": SQL_FOLDER}
