"""Facets: distinct values and counts per field, tuples of fields, filter summaries and densities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.operators.scan import positions


def counts(rows: DataFrame, names: list[str]) -> DataFrame:
    """file_id, field, value, n of several fields in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("value")) for n in names])).alias("e")
    return rows.select("file_id", each).groupBy("file_id", F.col("e.field").alias("field"), F.col("e.value").alias("value")).agg(F.count("*").alias("n"))


def values(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(name).distinct()


def tuples(rows: DataFrame, names: list[str]) -> DataFrame:
    """The distinct tuples of a file's indexed fields with their size, first record, and number in first-seen order."""
    keyed = rows.groupBy("file_id", *names).agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"))
    placed = positions(keyed, [F.col("file_id"), F.col("first_line")], "__p")
    first = placed.groupBy("file_id").agg(F.min("__p").alias("__f"))
    return placed.join(first, "file_id").select(*keyed.columns, (F.col("__p") - F.col("__f")).alias("key_no"))


def excluded_summary(exclusions: DataFrame) -> DataFrame:
    """field, hidden: per filtered field (field, value) the one hidden value, or how many are hidden."""
    some = exclusions.distinct().groupBy("field").agg(F.count("*").alias("c"), F.min("value").alias("v"))
    return some.select("field", F.when(F.col("c") == 1, F.col("v")).otherwise(F.col("c").cast("string")).alias("hidden"))


def density(rows: DataFrame, files: DataFrame, buckets: int = 1000) -> DataFrame:
    """file_id, bucket, n: records per share of each file's axis, time where it has one, else record numbers."""
    j = rows.join(files.select("file_id", F.col("n").alias("total"), "axis", "min_ts", "max_ts"), "file_id")
    by_time = F.least(F.floor((F.col("ts_norm") - F.col("min_ts")) * buckets / (F.col("max_ts") - F.col("min_ts"))), F.lit(buckets - 1))
    place = F.when(F.col("axis") == "time", by_time).otherwise(F.floor(F.col("line_no") * buckets / F.col("total")))
    return j.groupBy("file_id", place.cast("int").alias("bucket")).agg(F.count("*").alias("n"))
