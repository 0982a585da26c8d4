"""Growing log files as a stream of lines: format ``log_tail``, offsets in bytes per file, ranges dealt to the executors.

Options: ``path`` (files, folders or patterns, comma separated), ``encoding``, ``mask``, ``split`` as in ``log_lines``;
``ended`` (true: no file grows any more). Rows: file_id, byte_offset, text, last, as ``live.records`` takes them.

A batch is the bytes that each file has grown by. A line belongs to the range in which its first line end stands, so a line
that isn't whole yet waits, and one that spans ranges or batches is read once, from its start. The driver only asks for
sizes. The same offsets give the same lines, so a batch that is lost and sent again, or a restart from a checkpoint, neither
loses nor repeats a line.

Defined cases: files may appear at any time; a run of line ends is one terminator, also when it arrives in parts; a file that
begins with line ends has an empty first line; a last line without a line end comes with ``ended``, and with it a row without
text whose ``last`` is true, one for each file; after that nothing more is read; a file that shrinks is an error, because what
was read can't be taken back; a file that vanishes ends where it was read to. Offsets hold one number per file.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from logweave.sources import ranges

SCHEMA = "file_id long, byte_offset long, text string, last boolean"
_NAMES = ["file_id", "byte_offset", "text", "last"]


@dataclass
class Grown(InputPartition):
    """Bytes that a file has grown by; ``rest``: what follows the last line end before ``end``, once the file has ended."""

    path: str
    start: int
    end: int
    rest: bool = False


class Tail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Reader(self.options)


class _Reader(DataSourceStreamReader):
    def __init__(self, options):
        self.paths = options["path"].split(",")
        self.encoding = options.get("encoding", "utf-8")
        self.mask = int(options.get("mask", "0"))
        self.split = ranges.whole_units(int(options.get("split", ranges.SPLIT)))
        self.ended = options.get("ended", "false").lower() == "true"

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": {}, "ended": False}

    def latestOffset(self) -> dict:  # noqa: N802
        width, _ = ranges.unit(self.encoding)
        return {"files": {p: os.path.getsize(p) // width * width for p in _found(self.paths)}, "ended": self.ended}

    def partitions(self, start: dict, end: dict) -> list[Grown]:
        if start["ended"]:
            return []
        out = []
        for path, size in end["files"].items():
            had = start["files"].get(path, 0)
            if size < had:
                raise ValueError(f"{path} has shrunk from {had} to {size} bytes")
            out += [Grown(path, s, min(s + self.split, size)) for s in range(had, size, self.split)]
        if end["ended"]:
            out += [Grown(path, 0, size, rest=True) for path, size in (start["files"] | end["files"]).items()]
        return out

    def read(self, part: Grown) -> Iterator[pa.RecordBatch]:
        number = ranges.file_number(part.path)
        if part.rest:
            yield self._rest(number, part)
            return
        ended = self._behind(part.path, part.start, part.end)
        if ended is None:
            return  # the range lies inside one line
        begun = self._behind(part.path, 0, part.start) or 0
        for b in ranges.batches(number, part.path, begun, ended, self.encoding, self.mask, ended):
            text = pc.utf8_rtrim(b.column("text"), characters="\r\n")
            yield pa.RecordBatch.from_arrays([b.column("file_id"), b.column("byte_offset"), text, pa.array(np.zeros(b.num_rows, bool))], _NAMES)

    def _behind(self, path: str, low: int, high: int) -> int | None:
        """The place behind the last line end in [low, high), looked for from the back; None without one."""
        width, kind = ranges.unit(self.encoding)
        size = ranges.whole_units(ranges.BLOCK)
        with open(path, "rb") as f:
            while high > low:
                at = max(low, high - size)
                f.seek(at)
                units = np.frombuffer(ranges.unmasked(f.read(high - at), self.mask), kind)
                breaks = np.flatnonzero((units == 13) | (units == 10))
                if len(breaks):
                    return at + (int(breaks[-1]) + 1) * width
                high = at
        return None

    def _rest(self, number: int, part: Grown) -> pa.RecordBatch:
        """The line that no line end follows, if there is one, and the row that ends the file."""
        rows = [(number, part.end, None, True)]
        if os.path.exists(part.path):
            begun = self._behind(part.path, 0, part.end) or 0
            if begun < part.end:
                with open(part.path, "rb") as f:
                    f.seek(begun)
                    data = ranges.unmasked(f.read(part.end - begun), self.mask)
                rows.insert(0, (number, begun, data.decode(ranges.plain(self.encoding), "replace").removeprefix("\ufeff" if begun == 0 else ""), False))
        types = [pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], _NAMES)


def _found(paths: list[str]) -> list[str]:
    """Files of paths, folders (with all below them) and patterns."""
    out: set[str] = set()
    for p in paths:
        for found in glob.glob(p, recursive=True):
            out |= {os.path.join(d, n) for d, _, names in os.walk(found) for n in names} if os.path.isdir(found) else {found}
    return sorted(out)
