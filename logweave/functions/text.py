"""Shaping of long texts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

BIG_LINE, SHOWN_LINES, FOLD_ABOVE = 4096, 20, 21


def right_trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+$", "")


def prune(text: Column, size: int = BIG_LINE) -> Column:
    """Texts of ``size`` characters or more: longer lines are cut and end in three dots; trailing white space goes."""
    cut = F.array_join(F.transform(F.split(right_trimmed(text), "\n"), lambda x: F.when(F.length(x) > size, F.concat(F.substring(x, 1, size), F.lit("..."))).otherwise(x)), "\n")
    return F.when(F.length(text) >= size, cut).otherwise(text)


def break_lines(text: Column, size: int = BIG_LINE) -> Column:
    """The same texts with longer lines split to pieces of ``size`` characters."""
    pieces = F.regexp_extract_all(right_trimmed(text), F.lit(rf"(?d).{{1,{size}}}|(?<=\n)(?=\n)"), F.lit(0))
    return F.when(F.length(text) >= size, F.array_join(pieces, "\n")).otherwise(text)


def fold(text: Column, keep: int = SHOWN_LINES) -> tuple[Column, Column]:
    """The text kept and the number of lines cut: texts of more than ``keep`` + 1 lines keep ``keep``."""
    lines = F.split(text, "\n")
    long = F.size(lines) > keep + 1
    return F.when(long, F.array_join(F.slice(lines, 1, keep), "\n")).otherwise(text), F.when(long, F.size(lines) - keep).otherwise(F.lit(0))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and bounds of a column of lists."""
    bounds = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return np.asarray(column.flatten()), bounds


def match_starts(between: pa.Array, matched: pa.Array) -> pa.Array:
    """Starts of the matches of each text, from the lengths of what stands between them and of the matches: two running
    sums. Where the first match is empty and at the start, nothing is told to stand before it."""
    (gap, gap_at), (own, own_at) = _lists(between), _lists(matched)
    gaps, owns = np.concatenate([[0], np.cumsum(gap)]), np.concatenate([[0], np.cumsum(own)])
    counts = np.diff(own_at)
    of = np.repeat(np.arange(len(counts)), counts)
    k = np.arange(len(own)) - own_at[of]
    told = np.minimum(k + (np.diff(gap_at) > counts)[of], np.diff(gap_at)[of])
    starts = gaps[gap_at[of] + told] - gaps[gap_at[of]] + owns[own_at[of] + k] - owns[own_at[of]]
    return pa.ListArray.from_arrays(pa.array(own_at, pa.int32()), pa.array(starts, pa.int32()))


_starts = F.arrow_udf(match_starts, ArrayType(IntegerType()))


def places(rows: DataFrame, text: Column, java: str, keys) -> DataFrame:
    """keys, i, token, start (from 0) of every match: what stands between matches gives their places, once for each text."""
    some = rows.filter(text.rlike(java)).select(*keys, F.regexp_extract_all(text, F.lit(java), F.lit(0)).alias("__m"), F.split(text, java, -1).alias("__g"))
    lengths = lambda x: F.transform(x, lambda v: F.length(v))
    placed = some.select(*keys, "__m", _starts(lengths("__g"), lengths("__m")).alias("__s"))
    return placed.select(*keys, F.posexplode(F.arrays_zip("__m", "__s")).alias("i", "__x")).select(*keys, "i", F.col("__x.__m").alias("token"), F.col("__x.__s").alias("start"))


def _put(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, some in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
        if text is None or some is None:
            out.append(None)
            continue
        parts, at = [], 0
        for f in some:
            parts += [text[at : f["start"]], f["s"] or ""]
            at = f["start"] + f["length"]
        out.append("".join([*parts, text[at:]]))
    return pa.array(out, pa.string())


_replaced = F.arrow_udf(_put, StringType())


def replaced(text: Column, spans: Column) -> Column:
    """The text with each of the spans (start from 0, length, s; in order, not overlapping) replaced by its s, in one pass;
    null without spans."""
    return _replaced(text, spans)


def per_text(use: Callable, kind: pa.DataType, sql) -> Callable[[Column], Column]:
    """A column function that runs ``use`` once for each distinct text of a batch; null stays null."""

    def run(texts: pa.Array) -> pa.Array:
        known: dict = {None: None}
        out = []
        for t in texts.to_pylist():
            if t not in known:
                known[t] = use(t)
            out.append(known[t])
        return pa.array(out, kind)

    return F.arrow_udf(run, sql)


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
