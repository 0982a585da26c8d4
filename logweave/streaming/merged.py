"""The merged order of logs that grow: kept in buckets of time, of which a batch rewrites only those that it touches.

The rows lie in ``rows/version=<batch>/bucket=<number>``, each with its place in its bucket; ``buckets/version=<batch>`` has
one row per bucket: the version that holds it and how many rows it has. A row's position is the number of rows in earlier
buckets plus its place. Nothing is overwritten: a batch reads the buckets it touches from the version before, writes them
whole under its own number and then its list of buckets, which is what makes it count. So a batch that is lost halfway
or sent again gives the same table, and readers see whole batches only.

Defined cases: rows without a time come first, as in the merge of whole logs; untimed sources follow all others, in buckets
of their own records; a bucket with any share of all rows is sorted by ranges, not in one task; repeated rows each have
a position; an empty batch changes nothing; a table without batches has no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from logweave.operators.merge import END
from logweave.operators.scan import positions
from logweave.operators.storage import settled

_BUCKETS = "bucket long, held_by long, n long, version long"
#: Numbers of the buckets of untimed sources start here; each source has room for _ROOM of them.
_UNTIMED, _ROOM, _NO_TIME = 1 << 61, 1 << 40, -(1 << 61)


@dataclass(frozen=True)
class MergedTable:
    """A merged table in ``folder`` (shared by driver and executors) of rows as ``merge.align`` gives them.

    ``width``: microseconds of a bucket, at least 8; ``records``: records of an untimed source in a bucket.
    """

    spark: SparkSession
    folder: str
    schema: StructType
    width: int = 3_600_000_000
    records: int = 1_000_000

    def __post_init__(self) -> None:
        empty = self.spark.createDataFrame([], _BUCKETS).drop("version").coalesce(1)
        empty.write.mode("ignore").parquet(f"{self.folder}/buckets/version=-1")

    def _bucket(self) -> Column:
        timed = F.coalesce(F.floor(F.col("ts_norm") / F.lit(self.width)), F.lit(_NO_TIME))
        untimed = F.lit(_UNTIMED) + F.col("source_ix") * F.lit(_ROOM) + F.floor(F.col("line_no") / F.lit(self.records))
        return F.when(F.col("source_timed"), timed).otherwise(untimed).cast("long")

    def buckets(self, before: int | None = None) -> DataFrame:
        """bucket, held_by, n of the last version, or of the last one before a batch."""
        found = self.spark.read.schema(_BUCKETS).parquet(f"{self.folder}/buckets")
        found = found if before is None else found.filter(F.col("version") < before)
        last = found.agg(F.max("version").alias("version"))
        return found.join(F.broadcast(last), "version").drop("version")  # one row

    def _rows(self, buckets: DataFrame) -> DataFrame:
        """The rows of the given buckets, with bucket and place; only their folders are read."""
        if not buckets.filter("held_by >= 0").head(1):
            return self.spark.createDataFrame([], StructType(list(self.schema)).add("bucket", "long").add("place", "long"))
        stored = StructType(list(self.schema)).add("place", "long").add("version", "long").add("bucket", "long")
        rows = self.spark.read.schema(stored).parquet(f"{self.folder}/rows")
        wanted = F.broadcast(buckets.select("bucket", F.col("held_by").alias("version")))  # one row per bucket, as of its folder
        return rows.join(wanted, ["version", "bucket"], "left_semi").select(*self.schema.names, "bucket", "place")

    def add(self, batch: DataFrame, number: int) -> None:
        """Merges a batch of rows into the order; ``number`` grows from batch to batch and is the same if one is sent again."""
        new = settled(batch.select(*self.schema.names).withColumn("bucket", self._bucket()), "batch")
        had = settled(self.buckets(before=number), "buckets")
        touched = settled(new.select("bucket").distinct(), "touched")
        old = self._rows(had.join(F.broadcast(touched), "bucket", "left_semi"))
        time = F.when(F.col("source_timed"), F.col("ts_norm")).otherwise(F.lit(END))
        both = settled(positions(new.unionByName(old.drop("place")), [F.col("bucket"), time, F.col("source_ix"), F.col("line_no")], "__at"), "merged")
        sizes = both.groupBy("bucket").agg(F.count("*").alias("n"), F.min("__at").alias("__first"))
        placed = both.join(F.broadcast(sizes.select("bucket", "__first")), "bucket").withColumn("place", F.col("__at") - F.col("__first"))
        placed.select(*self.schema.names, "place", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/rows/version={number}")
        kept = had.join(F.broadcast(touched), "bucket", "left_anti")
        listed = kept.select("bucket", "held_by", "n").unionByName(sizes.select("bucket", F.lit(number).cast("long").alias("held_by"), "n"))
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/buckets/version={number}")  # one row per bucket

    def read(self) -> DataFrame:
        """All rows with ``pos``, as a merge of all rows so far gives them."""
        now = self.buckets()
        earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
        base = now.select("bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__base"))
        return self._rows(now).join(F.broadcast(base), "bucket").select(*self.schema.names, (F.col("__base") + F.col("place")).alias("pos"))

    def follow(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Merges what a stream of rows brings, batch by batch, until no more is there."""
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
