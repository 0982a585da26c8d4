"""Running values over long sequences without one task that sees a whole sequence.

Rows are cut into chunks of their order key; values run inside each chunk, one summary row per chunk runs over its
sequence, and each chunk gets what came before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.operators.storage import settled

CHUNK = 100_000
_COMBINE = {
    "sum": (lambda c: F.sum(c), lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (lambda c: F.max(c), lambda a, b: F.greatest(a, b)),
    "min": (lambda c: F.min(c), lambda a, b: F.least(a, b)),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda a, b: F.coalesce(b, a)),
}


def running(df: DataFrame, keys: list[str], order: str, values: dict[str, tuple[str, Column]], before: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Adds running values per ``keys`` in ``order`` (whole numbers, unique per key). values: name -> (kind, column).

    Kinds: sum, max, min, last (the last value that isn't null). ``before``: without the row itself.
    """
    part = F.floor(F.col(order) / F.lit(chunk)).alias("__chunk")
    rows = df.select("*", part, *[c.alias(f"__v_{n}") for n, (_, c) in values.items()])
    inside = Window.partitionBy(*keys, "__chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    earlier = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    kinds = {n: _COMBINE[k] for n, (k, _) in values.items()}
    whole = {n: (F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), F.col(order))) if values[n][0] == "last" else kinds[n][0](F.col(f"__v_{n}"))) for n in values}
    sums = rows.groupBy(*keys, "__chunk").agg(*[w.alias(f"__s_{n}") for n, w in whole.items()])
    sums = sums.select(*keys, "__chunk", *[kinds[n][0](F.col(f"__s_{n}")).over(earlier).alias(f"__b_{n}") for n in values])
    local = rows.select("*", *[kinds[n][0](F.col(f"__v_{n}")).over(inside).alias(f"__l_{n}") for n in values])
    both = local.alias("x").join(sums.alias("y"), [*[F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in [*keys, "__chunk"]]])
    return both.select(*[F.col(f"x.{c}") for c in df.columns], *[kinds[n][1](F.col(f"__b_{n}"), F.col(f"__l_{n}")).alias(n) for n in values])


def previous(df: DataFrame, keys: list[str], order: str, columns: dict[str, Column], chunk: int = CHUNK) -> DataFrame:
    """Adds the values that the row before has, as new columns; null on the first row."""
    seen = running(df, keys, order, {"__p": ("last", F.struct(*[c.alias(n) for n, c in columns.items()]))}, before=True, chunk=chunk)
    return seen.select(*df.columns, *[F.col(f"__p.{n}").alias(n) for n in columns])


def positions(df: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """Adds the row's place from 0 in the total order: a range-partitioned sort, then counts of the ranges before."""
    dealt = settled(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    local = dealt.withColumn("__k", F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1)
    joined = local.join(F.broadcast(counts), "__range")  # one row per range of the shuffle
    return joined.select(*df.columns, (F.col("__k") + F.col("__before")).alias(name))
