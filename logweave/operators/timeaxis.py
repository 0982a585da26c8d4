"""The time axis of files: normalised times, summaries, day boundaries, time ranges.

``rows``: file_id, line_no, ts_raw (microseconds or null). ``ts_norm`` is the normalised time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions.times import DAY, HOUR
from logweave.operators.scan import CHUNK, running

#: Microseconds to a chunk of times.
TIME_CHUNK = 60_000_000


def normalise(rows: DataFrame, time_only: bool, chunk: int = CHUNK) -> DataFrame:
    """Adds ts_norm. Times of day that fall by more than an hour start a new day, smaller steps back are lifted to the
    largest time so far; rows without a time take the last one, 0 at the start; absolute times stay as they are."""
    if time_only:
        return _days(rows, chunk)
    last = running(rows, ["file_id"], "line_no", {"__norm": ("last", F.col("ts_raw"))}, chunk=chunk)
    return last.select(*rows.columns, F.coalesce("__norm", F.lit(0)).alias("ts_norm"))


def _days(rows: DataFrame, chunk: int) -> DataFrame:
    """Times of day in one scan: each chunk is summed up by its first and last time, the days that begin inside it and its
    largest time; the summaries are combined in order, which gives each chunk the days and the largest time before it."""
    own = Window.partitionBy("file_id", "__chunk").orderBy("line_no")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    falls = lambda now, then: F.coalesce((now < then - HOUR).cast("long"), F.lit(0))
    seen = rows.withColumn("__chunk", F.floor(F.col("line_no") / F.lit(chunk)))
    seen = seen.withColumn("__last", F.last("ts_raw", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1)))
    seen = seen.withColumn("__days", F.sum(falls(F.col("ts_raw"), F.col("__last"))).over(upto))
    seen = seen.withColumn("__top", F.max(F.col("ts_raw") + F.col("__days") * DAY).over(upto))
    timed = F.when(F.col("ts_raw").isNotNull(), F.col("line_no"))
    sums = seen.groupBy("file_id", "__chunk").agg(F.min_by("ts_raw", timed).alias("first"), F.max_by("ts_raw", timed).alias("last"), F.max("__days").alias("days"), F.max("__top").alias("top"))
    across = Window.partitionBy("file_id").orderBy("__chunk")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("enters", falls(F.col("first"), F.last("last", ignorenulls=True).over(earlier)))
    sums = sums.withColumn("__base", F.sum(F.col("days") + F.col("enters")).over(across.rowsBetween(Window.unboundedPreceding, 0)) - F.col("days"))
    sums = sums.withColumn("__before", F.max(F.col("top") + F.col("__base") * DAY).over(earlier))
    sums = sums.select(F.col("file_id").alias("__f"), F.col("__chunk").alias("__c"), "__base", "__before")
    j = seen.join(sums, F.col("file_id").eqNullSafe(F.col("__f")) & (F.col("__chunk") == F.col("__c")))
    return j.select(*rows.columns, F.coalesce(F.greatest("__before", F.col("__top") + F.col("__base") * DAY), F.lit(0)).alias("ts_norm"))


def summary(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per file: n, has_time, monotonic, min_ts, max_ts, timed (may be merged by time), axis (time or lines). Chunks
    are summed up where they are sorted; only their summaries, with the first and last time, meet per file."""
    own = Window.partitionBy("file_id", "__chunk").orderBy("line_no")
    seen = rows.select("file_id", "line_no", "ts_raw", "ts_norm", F.floor(F.col("line_no") / F.lit(chunk)).alias("__chunk"))
    seen = seen.withColumn("__rises", F.coalesce(F.col("ts_norm") >= F.lag("ts_norm").over(own), F.lit(True)))
    parts = seen.groupBy("file_id", "__chunk").agg(
        F.count("*").alias("n"), F.bool_or(F.col("ts_raw").isNotNull()).alias("has_time"), F.bool_and("__rises").alias("rises"), F.min("ts_norm").alias("min_ts"), F.max("ts_norm").alias("max_ts"),
        F.min_by("ts_norm", "line_no").alias("first"), F.max_by("ts_norm", "line_no").alias("last"),
    )
    enters = F.coalesce(F.col("first") >= F.lag("last").over(Window.partitionBy("file_id").orderBy("__chunk")), F.lit(True))
    out = parts.withColumn("rises", F.col("rises") & enters).groupBy("file_id").agg(
        F.sum("n").alias("n"), F.bool_or("has_time").alias("has_time"), F.bool_and("rises").alias("monotonic"), F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"),
    )
    timed = F.col("has_time") & F.col("monotonic")
    return out.withColumn("timed", timed).withColumn("axis", F.when(timed & (F.col("max_ts") > F.col("min_ts")), F.lit("time")).otherwise(F.lit("lines")))


def day_starts(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """file_id, line_no of timed rows whose day differs from that of the last timed row before; never row 0."""
    day = F.when(F.col("ts_raw").isNotNull(), F.floor(F.col("ts_norm") / DAY))
    seen = running(rows, ["file_id"], "line_no", {"__d": ("last", day)}, before=True, chunk=chunk)
    changed = day.isNotNull() & ((F.col("__d") != day) | F.col("__d").isNull())
    return seen.filter(changed & (F.col("line_no") > 0)).select("file_id", "line_no")


def line_ranges(rows: DataFrame, ranges: DataFrame, files: DataFrame) -> DataFrame:
    """range_id, file_id, line_from, line_to: the half-open record range of an inclusive time range (range_id, t_from,
    t_to), for timed files that aren't empty. Both searches are counts, for all ranges in one pass."""
    timed = rows.join(files.filter("timed and n > 0").select("file_id"), "file_id", "left_semi")
    each = files.filter("timed and n > 0").select("file_id").join(ranges, F.lit(True))  # every file answers each of the stated questions
    asked = each.select("file_id", "range_id", F.explode(F.array(F.struct((F.col("t_from") - 1).alias("t"), F.lit(0).alias("k")), F.struct(F.col("t_to").alias("t"), F.lit(1).alias("k")))).alias("q"))
    asked = asked.select("file_id", "range_id", "q.t", "q.k")
    counted = timed.select("file_id", F.col("ts_norm").alias("t"), F.lit(1).alias("c")).unionByName(asked.select("file_id", "t", F.lit(0).alias("c")).distinct())
    sums = running(counted.groupBy("file_id", "t").agg(F.sum("c").alias("c")), ["file_id"], "t", {"upto": ("sum", F.col("c"))}, chunk=TIME_CHUNK)
    found = asked.join(sums, ["file_id", "t"])
    return found.groupBy("range_id", "file_id").agg(F.max(F.when(F.col("k") == 0, F.col("upto"))).alias("line_from"), F.max(F.when(F.col("k") == 1, F.col("upto"))).alias("line_to"))
