"""Row sets: disjoint inclusive ranges of record numbers per file, and what is done with them.

A set is a table (file_id, start, end). All algebra is one sweep over range borders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.operators.scan import running
from logweave.operators.storage import settled

#: Records to a bucket of the range join.


def normalise(ranges: DataFrame) -> DataFrame:
    """Sorted ranges without inverted ones, overlapping and adjacent ones joined."""
    good = ranges.filter("start <= end").groupBy("file_id", "start").agg(F.max("end").alias("end"))
    seen = running(good, ["file_id"], "start", {"__reach": ("max", F.col("end"))}, before=True)
    new = F.when(F.col("__reach").isNull() | (F.col("start") > F.col("__reach") + 1), 1).otherwise(0)
    islands = running(seen.withColumn("__new", new), ["file_id"], "start", {"__k": ("sum", F.col("__new"))})
    return islands.groupBy("file_id", "__k").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__k")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return normalise(a.select("file_id", "start", "end").unionByName(b.select("file_id", "start", "end")))


def _sweep(sets: list[DataFrame]) -> DataFrame:
    """file_id, start, end, in0, in1, ...: the pieces of the axis between range borders, and which sets hold them."""
    names = [f"in{i}" for i in range(len(sets))]
    events = None
    for i, d in enumerate(sets):
        step = lambda sign, i=i: [F.lit(sign if n == names[i] else 0).alias(n) for n in names]
        good = d.filter("start <= end")
        for part in (good.select("file_id", F.col("start").alias("at"), *step(1)), good.select("file_id", (F.col("end") + 1).alias("at"), *step(-1))):
            events = part if events is None else events.unionByName(part)
    summed = events.groupBy("file_id", "at").agg(*[F.sum(n).alias(f"__d{n}") for n in names])
    before = running(summed, ["file_id"], "at", {"__from": ("last", F.col("at")), **{n: ("sum", F.col(f"__d{n}")) for n in names}}, before=True)
    pieces = before.filter("__from is not null").select("file_id", F.col("__from").alias("start"), (F.col("at") - 1).alias("end"), *[(F.col(n) > 0).alias(n) for n in names])
    return settled(pieces, "pieces")  # they are used more than once


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return normalise(_sweep([a, b]).filter("in0 and not in1"))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return normalise(_sweep([a, b]).filter("in0 and in1"))


def restore(current: DataFrame, original: DataFrame, affected: DataFrame) -> DataFrame:
    """(current without affected) with (original within affected)."""
    return normalise(_sweep([current, original, affected]).filter("(in0 and not in2) or (in1 and in2)"))


def toggle(marks: DataFrame, selection: DataFrame) -> DataFrame:
    """Per file: if any selected row is unmarked all selected are marked, else all are unmarked."""
    pieces = _sweep([marks, selection])
    adding = pieces.groupBy("file_id").agg(F.bool_or(F.col("in1") & ~F.col("in0")).alias("adding"))
    adding = settled(adding, "adding")  # Spark then knows how few files there are, and deals no pieces by their file alone
    return normalise(pieces.join(adding, "file_id").filter("(in0 and not in1) or (in1 and adding)"))


def size(ranges: DataFrame) -> DataFrame:
    """file_id, n: rows in the set."""
    return normalise(ranges).groupBy("file_id").agg(F.sum(F.col("end") - F.col("start") + 1).alias("n"))


#: Levels of aligned blocks; a block of level k holds 2 ** k records.
LEVELS = 62


def blocks(ranges: DataFrame) -> DataFrame:
    """file_id, level, block: ranges as aligned blocks of records, no two of which overlap; at most two of each level, so a
    range of n records gives at most 2 log2 n rows."""
    low = lambda k: F.call_function("shiftright", F.col("start") + F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1, k)
    high = lambda k: F.call_function("shiftright", F.col("end") + 1, k)
    odd = lambda x: x % 2 == 1
    span = F.ceil(F.log2(F.col("end") - F.col("start") + 2)).cast("int")
    levels = F.sequence(F.lit(0), F.least(span, F.lit(LEVELS)))
    block = lambda k, b, good: F.when(good & (low(k) < high(k)), F.struct(k.alias("level"), b.alias("block")))
    each = F.flatten(F.transform(levels, lambda k: F.array(block(k, low(k), odd(low(k))), block(k, high(k) - 1, odd(high(k))))))
    return normalise(ranges).select("file_id", F.explode(F.array_compact(each)).alias("b")).select("file_id", "b.level", "b.block")


def members(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """The rows in the set: each looks up the blocks that hold its record, of the levels that occur. Numbers out of range are
    ignored."""
    cut = blocks(ranges)
    levels = sorted(r.level for r in cut.select("level").distinct().collect())  # at most ``LEVELS``
    asked = rows.withColumn("__level", F.explode(F.array(*[F.lit(k) for k in levels]) if levels else F.array().cast("array<int>")))
    wanted = cut.select(F.col("file_id").alias("__f"), F.col("level").alias("__l"), F.col("block").alias("__b"))
    on = (F.col("file_id") == F.col("__f")) & (F.col("__level") == F.col("__l")) & (F.expr("shiftright(line_no, __level)") == F.col("__b"))
    return asked.join(wanted, on, "left_semi").drop("__level")


def export(rows: DataFrame, ranges: DataFrame, limit: int | None = None) -> DataFrame:
    """value: the text of marked rows in record order, right-trimmed, without NULs. With a ``limit`` (64,000,000 characters is
    that of a copy to the clipboard) a larger selection is refused; one that is saved has none."""
    out = members(rows, ranges).select("file_id", "line_no", F.translate(F.regexp_replace("text", r"(?U)\s+$", ""), "\0", "").alias("value"))
    if limit is not None and (out.agg(F.sum(F.length("value") + 2)).first()[0] or 0) > limit:
        raise ValueError(f"the selection has more than {limit} characters")
    return out.orderBy("file_id", "line_no").select("value")


def write_export(rows: DataFrame, ranges: DataFrame, path: str, limit: int | None = None) -> None:
    export(rows, ranges, limit).write.option("lineSep", "\r\n").text(path)
