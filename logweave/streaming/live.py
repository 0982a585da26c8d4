"""Incremental records, search, facets and merges with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from logweave.functions.times import DAY, HOUR
from logweave.operators.records import Format, field_column
from logweave.operators.search import matches

RECORD = "file_id long, line_no long, byte_offset long, text string, ts_raw long, ts_norm long"
_STATE = "line_no long, byte_offset long, raw long, ts long, last_raw long, days long, top long, open boolean"
_NEW = (-1, 0, None, 0, None, 0, 0, False)


class Assembler(StatefulProcessor):
    """Per file: the open record with its lines as a list, the last raw time, the day offset and the largest time so far.

    Input: file_id, byte_offset, text, starts (opens a record), ts_raw, last (ends the file). A record is sent once the
    next one starts or the file ends. Lines before the first record are dropped, as the header. A line that continues the
    open record is appended to the list; what the list holds already is neither read nor written again until the record ends.
    """

    def __init__(self, time_only: bool):
        self.time_only = time_only

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", _STATE)
        self.lines = handle.getListState("lines", "text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        line_no, offset, raw, ts, last_raw, days, top, is_open = self.state.get() if self.state.exists() else _NEW
        batch = pd.concat(list(rows), ignore_index=True).sort_values("byte_offset")
        given = batch[batch["text"].notna()]
        texts, starts = given["text"].to_numpy(), np.flatnonzero(given["starts"].to_numpy(bool))
        out: list[tuple] = []
        first = starts[0] if len(starts) else len(texts)
        if is_open and first:
            self.lines.appendList([(t,) for t in texts[:first]])
        if len(starts):
            if is_open:
                out.append((line_no, offset, self._held(), raw, ts))
            raws = pd.array(given["ts_raw"].to_numpy()[starts], "Int64")
            norms, last_raw, days, top = self._normalised(raws, last_raw, days, top)
            offsets = given["byte_offset"].to_numpy()[starts]
            for k in range(len(starts) - 1):
                out.append((line_no + 1 + k, offsets[k], "\n".join(texts[starts[k] : starts[k + 1]]), raws[k], norms[k]))
            line_no, offset, ts, is_open = line_no + len(starts), int(offsets[-1]), int(norms[-1]), True
            raw = None if pd.isna(raws[-1]) else int(raws[-1])
            self.lines.put([(t,) for t in texts[starts[-1] :]])
        if is_open and batch["last"].any():
            out.append((line_no, offset, self._held(), raw, ts))
            self.lines.clear()
            is_open = False
        self.state.update((line_no, offset, raw, ts, last_raw, days, top, is_open))
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=["file_id", "line_no", "byte_offset", "text", "ts_raw", "ts_norm"]).astype({"ts_raw": "Int64"})

    def _held(self) -> str:
        return "\n".join(t for (t,) in self.lines.get())

    def _normalised(self, raws, last_raw: int | None, days: int, top: int):
        """Normalised times of a batch's records, and the last raw time, the days and the largest time after it."""
        known = raws[~raws.isna()].to_numpy("int64")
        tops = known
        if len(known) and self.time_only:
            before = np.append(known[0] if last_raw is None else last_raw, known[:-1])
            rolled = days + np.cumsum(known < before - HOUR)
            tops = np.maximum.accumulate(np.maximum(known + rolled * DAY, top))
            days = int(rolled[-1])
        norms = np.append(top, tops)[np.cumsum(~raws.isna())]
        return (norms, int(known[-1]), days, int(tops[-1])) if len(known) else (norms, last_raw, days, top)

    def close(self) -> None:
        pass


def records(lines: DataFrame, fmt: Format, time: str, time_only: bool) -> DataFrame:
    """Records of a stream of lines (file_id, byte_offset, text, last). ``time``: SQL of the raw time over column ``t``.

    Needs the RocksDB state store provider.
    """
    p = fmt.pattern
    name = fmt.time_column()
    raw = F.expr(time) if name else F.lit(None).cast("long")
    fed = lines.withColumn("t", field_column(F.col("text"), p, name) if name else F.lit("")).select("file_id", "byte_offset", "text", F.coalesce(F.col("text").rlike(p.java), F.lit(False)).alias("starts"), raw.alias("ts_raw"), "last")
    return fed.groupBy("file_id").transformWithStateInPandas(Assembler(time_only), RECORD, "Append", "None")


def search(stream: DataFrame, pattern: str, regex: bool = True, case: bool = False) -> DataFrame:
    """Hits as they come; stateless."""
    return stream.filter(matches(pattern, regex, case))


def facets(stream: DataFrame, name: str) -> DataFrame:
    """Growing counts per value; for complete or update mode."""
    return stream.groupBy("file_id", F.col(name).alias("value")).agg(F.count("*").alias("n"))


def merge_into(stream: DataFrame, table: str, refresh, checkpoint: str) -> StreamingQuery:
    """Appends each batch of records to ``table`` and calls ``refresh(spark, first, last)`` for the times it touched."""

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("append").saveAsTable(table)
        first, last = batch.agg(F.min("ts_norm"), F.max("ts_norm")).first()
        if first is not None:
            refresh(batch.sparkSession, first, last)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
