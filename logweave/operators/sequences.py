"""Threads, runs and segments of consecutive rows, pages of a view, nearest visible rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.operators.scan import CHUNK, previous, running
from logweave.operators.storage import settled

SEGMENTS = 20_000


def thread_marks(rows: DataFrame, thread: str, focus: Column | None = None, keys: list[str] | None = None, order: str = "pos", chunk: int = CHUNK) -> DataFrame:
    """Adds continuation (same thread as the row before), first, last (of the whole sequence), other (than the focus)."""
    keys = keys if keys is not None else ["file_id"]
    seen = previous(rows, keys, order, {"__t": F.col(thread), "__has": F.lit(True)}, chunk)
    same = F.coalesce(F.col("__has") & F.col("__t").eqNullSafe(F.col(thread)), F.lit(False))
    ends = rows.groupBy(*keys).agg(F.max(order).alias("__end")) if keys else rows.agg(F.max(order).alias("__end"))
    out = seen.join(ends, keys) if keys else seen.join(F.broadcast(ends), F.lit(True))  # one row
    other = ~F.col(thread).eqNullSafe(focus) if focus is not None else F.lit(False)
    return out.select(*rows.columns, same.alias("continuation"), (~same).alias("first"), (F.col(order) == F.col("__end")).alias("last"), other.alias("other"))


def runs(rows: DataFrame, value: list[str], keys: list[str], order: str, chunk: int = CHUNK) -> DataFrame:
    """Adds ``run``: consecutive rows of equal ``value`` have the same number, from 0, in each sequence."""
    seen = previous(rows, keys, order, {"__v": F.struct(*value)}, chunk)
    new = (~F.col("__v").eqNullSafe(F.struct(*value))).cast("long")
    return running(seen.withColumn("__new", new), keys, order, {"run": ("sum", F.col("__new"))}, chunk=chunk).select(*rows.columns, (F.col("run") - 1).alias("run"))


def thread_runs(rows: DataFrame, thread: str, chunk: int = CHUNK) -> DataFrame:
    """file_id, run, thread, first_line, last_line, n, duration (of ts_norm)."""
    return runs(rows, [thread], ["file_id"], "line_no", chunk).groupBy("file_id", "run").agg(
        F.min(thread).alias("thread"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.count("*").alias("n"), (F.max("ts_norm") - F.min("ts_norm")).alias("duration"),
    )


def segments(merged: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """start, end (exclusive), source_ix: runs of one source in the merged order (pos, source_ix)."""
    keyed = merged.select("pos", "source_ix", F.lit(0).alias("__all"))
    return runs(keyed, ["source_ix"], ["__all"], "pos", chunk).groupBy("run").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.min("source_ix").alias("source_ix")).drop("run")


def sampled_segments(merged: DataFrame, total: int, most: int = SEGMENTS) -> DataFrame:
    """At most ``most`` equal buckets with their most frequent source (the first on ties), equal neighbours joined."""
    n = min(most, total)
    # bucket b covers bround(b * size) .. bround((b + 1) * size); half goes to even
    edges = merged.sparkSession.range(n).select(F.col("id").alias("b"), F.bround((F.col("id") + 1) * F.lit(total / n)).cast("long").alias("end"), F.bround(F.col("id") * F.lit(total / n)).cast("long").alias("start"))
    guess = F.least(F.floor(F.col("pos") / F.lit(total / n)), F.lit(n - 1)).cast("long")
    near = merged.select("pos", "source_ix", F.explode(F.array(guess - 1, guess, guess + 1)).alias("b")).join(edges, "b").filter("pos >= start and pos < end")
    counts = near.groupBy("b", "start", "end", "source_ix").count()
    best = counts.groupBy("b", "start", "end").agg(F.max_by("source_ix", F.struct("count", -F.col("source_ix"))).alias("source_ix"))
    keyed = best.withColumn("__all", F.lit(0))  # at most ``most`` rows
    return runs(keyed, ["source_ix"], ["__all"], "b").groupBy("run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("source_ix").alias("source_ix")).drop("run")


def page(view: DataFrame, start: int, count: int, chunk: int = CHUNK) -> DataFrame:
    """Rows start .. start + count of a view in record order, with their place in it. Rows are counted per chunk; sums of the
    counts, first of files and then of the chunks of the files that matter, tell which chunks hold the page, and only their
    rows are sorted."""
    part = F.floor(F.col("line_no") / F.lit(chunk))
    chunks = settled(view.groupBy("file_id", part.alias("__chunk")).agg(F.count("*").alias("n")), "counts")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    on_page = (F.col("at") < start + count) & (F.col("at") + F.col("n") > start)
    files = chunks.groupBy("file_id").agg(F.sum("n").alias("n")).withColumn("at", before(Window.orderBy("file_id"))).filter(on_page)  # one row per file
    inside = chunks.join(files.select(F.col("file_id").alias("__f"), F.col("at").alias("__at")), F.col("file_id").eqNullSafe(F.col("__f")))
    wanted = inside.withColumn("at", F.col("__at") + before(Window.partitionBy("file_id").orderBy("__chunk"))).filter(on_page)
    wanted = F.broadcast(wanted.select("__f", F.col("__chunk").alias("__c"), "at"))  # chunks aren't empty: at most ``count`` and one
    rows = view.join(wanted, F.col("file_id").eqNullSafe(F.col("__f")) & (part == F.col("__c")))
    place = F.col("at") + F.row_number().over(Window.partitionBy("__f", "__c").orderBy("line_no")) - 1
    placed = rows.select(*view.columns, place.alias("view_pos"))
    return placed.filter((F.col("view_pos") >= start) & (F.col("view_pos") < start + count))


def context(rows: DataFrame, hits: DataFrame, around: int) -> DataFrame:
    """Rows within ``around`` records of a hit, each once."""
    near = hits.select("file_id", F.explode(F.sequence(F.col("line_no") - around, F.col("line_no") + around)).alias("line_no")).distinct()
    return rows.join(near, ["file_id", "line_no"], "left_semi")


def nearest(view: DataFrame, anchors: DataFrame, clamp: bool = False) -> DataFrame:
    """file_id, anchor, view_pos: place in each file's view of the first row at or after a record; the last row if there
    is none, or the end with ``clamp``. One row per file of sums, and per anchor a search among the file's rows."""
    row = view.select("file_id", "line_no", F.lit(1).alias("v"), F.lit(0).alias("a"))
    both = row.unionByName(anchors.select("file_id", F.col("anchor").alias("line_no"), F.lit(0).alias("v"), F.lit(1).alias("a")))
    places = both.groupBy("file_id", "line_no").agg(F.sum("v").alias("v"), F.sum("a").alias("a"))
    seen = running(places, ["file_id"], "line_no", {"p": ("sum", F.col("v"))}, before=True).filter("a > 0")
    seen = seen.select("file_id", F.col("line_no").alias("anchor"), F.coalesce("p", F.lit(0)).alias("p"), F.explode(F.sequence(F.lit(1), F.col("a").cast("int"))))
    sizes = view.groupBy("file_id").agg(F.count("*").alias("n"))
    return seen.join(sizes, "file_id").select("file_id", "anchor", F.least("p", F.col("n") - (0 if clamp else 1)).alias("view_pos"))
