"""A data source of byte ranges of log files in any encoding, with an XOR mask: format ``log_lines``.

Options: ``path`` (files, comma separated), ``encoding``, ``mask`` (0 to 255), ``split`` (bytes of a range). Each range is
one partition; a line belongs to the range in which it starts. A run of line ends is one terminator and belongs to the
line before it; a file that begins with line ends has a first line made of them.

The files are opened by the workers, so they must lie on a file system that all of them mount; for other stores ``text.lines``
goes through Spark's own readers.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file_id long, byte_offset long, byte_len long, text string"
SPLIT = 64 << 20
BLOCK = 1 << 20


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class Lines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = options["path"].split(",")
        self.encoding = options.get("encoding", "utf-8")
        self.mask = int(options.get("mask", "0"))
        self.split = whole_units(int(options.get("split", SPLIT)))

    def partitions(self) -> list[Range]:
        return [Range(p, s, min(s + self.split, n)) for p in self.paths for n in [os.path.getsize(p)] for s in range(0, n, self.split)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        yield from batches(file_number(part.path), part.path, part.start, part.end, self.encoding, self.mask)


def whole_units(split: int) -> int:
    """A size of ranges that cuts no unit of a wide encoding."""
    return max(4, split // 4 * 4)


def unit(encoding: str) -> tuple[int, str]:
    """Bytes of a unit of an encoding, and its numpy type."""
    width = 4 if "32" in encoding else 2 if "16" in encoding else 1
    return width, (">" if "be" in encoding.lower() else "<") + f"u{width}"


def unmasked(data: bytes, mask: int) -> bytes:
    return data.translate(bytes(b ^ mask for b in range(256))) if mask else data


def batches(number: int, path: str, start: int, end: int, encoding: str, mask: int, limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """The lines of a file that start in [start, end), as file_id, byte_offset, byte_len, text."""
    for base, bounds, data in pieces(path, start, end, encoding, mask, limit):
        text = _texts(bounds, data, encoding)
        if base + bounds[0] == 0:
            text = pa.chunked_array([pa.array([text[0].as_py().lstrip("\ufeff")], pa.large_string()), text[1:]]).combine_chunks()
        lengths = np.diff(bounds)
        rows = pa.RecordBatch.from_arrays([pa.array(np.full(len(lengths), number)), pa.array(base + bounds[:-1]), pa.array(lengths), text.cast(pa.string())], ["file_id", "byte_offset", "byte_len", "text"])
        for at in range(0, rows.num_rows, 10_000):
            yield rows.slice(at, 10_000)


def file_number(path: str) -> int:
    """The same 64-bit number that ``text.file_number`` gives a file."""
    return (xxhash.xxh64_intdigest(re.sub("^file:/+", "/", path.lower()).encode(), 42) + (1 << 63) & (1 << 64) - 1) - (1 << 63)


def _texts(bounds: np.ndarray, data: bytes, encoding: str) -> pa.Array:
    """The lines without their line ends; a line of nothing else keeps them."""
    if plain(encoding).lower() in ("utf-8", "utf8", "ascii"):
        raw = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)])
        try:
            text = raw.cast(pa.large_string())
        except pa.ArrowInvalid:  # some line isn't UTF-8
            text = pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.large_string())
    else:
        text = pa.array([data[a:b].decode(plain(encoding), "replace") for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.large_string())
    cut = pc.utf8_rtrim(text, characters="\r\n")
    return pc.if_else(pc.equal(pc.binary_length(cut), 0), text, cut)


def pieces(path: str, start: int, end: int, encoding: str, mask: int, limit: int | None = None) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """Runs of the lines that start in [start, end): place of the data in the file, bounds of the lines in it, data.

    All line ends of a block are found at once; a block without one is read on with twice its size. ``limit``: the file is
    taken to end there.
    """
    width, kind = unit(encoding)
    with open(path, "rb") as f:
        base = max(0, start - width)  # the unit before tells whether a line starts at ``start``
        f.seek(base)
        data, size, first = b"", BLOCK, start == 0
        while True:
            got = f.read(size if limit is None else max(0, min(size, limit - f.tell())))
            data += unmasked(got, mask)
            units = np.frombuffer(data[: len(data) // width * width], kind)
            breaks = (units == 13) | (units == 10)
            begins = (np.flatnonzero(breaks[:-1] & ~breaks[1:]) + 1) * width
            if first and data:
                begins = np.append(0, begins)
            begins = begins[base + begins >= start]
            over = np.searchsorted(base + begins, end)
            bounds = begins[: over + 1]  # with the first that starts behind the range
            if not got:
                if over == len(begins) and over:
                    bounds = np.append(begins, len(data))
                if len(bounds) > 1:
                    yield base, bounds, data
                return
            if len(bounds) > 1:
                yield base, bounds, data
            if over < len(begins):
                return
            size = BLOCK if len(bounds) > 1 else max(BLOCK, 2 * len(data))
            keep = int(begins[-1]) if len(begins) else max(0, len(units) - 1) * width
            first = bool(len(begins))  # what is kept begins with a line
            data, base = data[keep:], base + keep
            start = max(start, base) if not first else base


def framed(path: str, start: int, end: int, encoding: str, mask: int) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes (with terminator) of the lines that start in [start, end)."""
    for base, bounds, data in pieces(path, start, end, encoding, mask):
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield base + a, data[a:b]


def plain(encoding: str) -> str:
    """An encoding that writes no byte-order mark."""
    return {"utf-16": "utf-16-le", "utf-32": "utf-32-le", "utf-8-sig": "utf-8"}.get(encoding.lower(), encoding)
