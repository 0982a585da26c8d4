"""Sharding by extendible hashing (operator 7).

A directory is indexed by the leading bits of a document's hash. Sizes are summed per hash slot; a bucket that exceeds
the byte limit is split on the next bit, and only such buckets are, until every shard fits. Eight bits are looked at in
each round, so a round sees at most 256 sums for each bucket that is still too large.

Defined cases: a document larger than the limit gets a shard of its own (depth -1, prefix 0, sub its rank among such
documents); rows whose whole hash is equal (repeated ids) and exceed the limit together are split by their rank, counted
in ``sub``; a null id is hashed by its text; a null text has 0 bytes; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm.common import running_totals, settled, table

#: Bits of the hash in use: 15 hex digits of an MD5. Bits looked at in a round.
BITS, STEP = 60, 8
#: Byte limit of the registered query; small, so that small tables are split too.
LIMIT = 1 << 20


def assign(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, depth, prefix, sub, shard_bytes. A shard is (depth, prefix, sub)."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.sha2(F.coalesce("text", F.lit("")), 256))))
    rows = settled(docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.conv(F.substring(key, 1, 15), 16, 10).cast("long").alias("h")), "hashed")
    parts = []
    big = rows.filter(F.col("n_bytes") > limit)
    ranked = running_totals(big, [F.col("h"), F.col("n_bytes")], {}, rank="sub")
    parts.append(ranked.select("doc_id", "n_bytes", F.lit(-1).alias("depth"), F.lit(0).cast("long").alias("prefix"), "sub", F.col("n_bytes").alias("shard_bytes")))
    left, base = rows.filter(F.col("n_bytes") <= limit), 0
    while base < BITS:
        low = min(base + STEP, BITS)
        leaf = F.shiftright("h", BITS - low).alias("leaf")
        sums = left.groupBy(leaf).agg(F.sum("n_bytes").alias("bytes"))
        levels = sums.withColumn("depth", F.explode(F.sequence(F.lit(base), F.lit(low)))).withColumn("prefix", F.expr(f"shiftright(leaf, {low} - depth)"))
        held = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.collect_set("leaf").alias("leaves")).filter(F.col("shard_bytes") <= limit)
        first = held.select("depth", "prefix", "shard_bytes", F.explode("leaves").alias("leaf"))
        chosen = settled(first.groupBy("leaf").agg(F.min(F.struct("depth", "prefix", "shard_bytes")).alias("s")), "directory")
        directory = F.broadcast(chosen) if base == 0 else chosen  # 2 ** STEP leaves at most in the first round
        joined = left.withColumn("leaf", leaf).join(directory, "leaf", "left")
        parts.append(joined.filter("s is not null").select("doc_id", "n_bytes", "s.depth", "s.prefix", F.lit(0).cast("long").alias("sub"), "s.shard_bytes"))
        left = settled(joined.filter("s is null").select("doc_id", "n_bytes", "h"), "oversized")
        base = low
        if left.isEmpty():
            break
    else:  # equal in all bits: as many rows to a shard as fit, by the largest of them
        each = left.groupBy("h").agg(F.greatest(F.lit(1), F.floor(F.lit(limit) / F.max("n_bytes"))).cast("long").alias("each"))
        ranked = running_totals(left, [F.col("h"), F.col("n_bytes"), F.col("doc_id")], {}, rank="r")
        start = ranked.groupBy("h").agg(F.min("r").alias("r0"))
        tied = ranked.join(each, "h").join(start, "h").withColumn("sub", F.floor((F.col("r") - F.col("r0")) / F.col("each")).cast("long"))
        sizes = tied.groupBy("h", "sub").agg(F.sum("n_bytes").alias("shard_bytes"))
        parts.append(tied.join(sizes, ["h", "sub"]).select("doc_id", "n_bytes", F.lit(BITS).alias("depth"), F.col("h").alias("prefix"), "sub", "shard_bytes"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """The documents of each shard in a folder of its own, named by its directory entry."""
    shard = F.concat_ws("-", "depth", F.lpad(F.hex("prefix"), 15, "0"), "sub")
    ids = assign(docs, limit).select(F.col("doc_id").alias("__id"), shard.alias("shard")).distinct()
    docs.join(ids, F.col("doc_id").eqNullSafe(F.col("__id"))).drop("__id").repartition("shard").write.partitionBy("shard").parquet(path)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))


SQL = f"""
with hashed as (
  select doc_id, coalesce(strlen(text), 0)::bigint as n_bytes, ('0x' || substr(md5(doc_id::varchar), 1, 15))::bigint as h
  from documents where coalesce(strlen(text), 0) <= {LIMIT}),
levels as (select h.*, d::integer as depth, h >> ({BITS} - d) as prefix from hashed h, range(0, {BITS} + 1) t(d)),
sums as (select depth, prefix, sum(n_bytes)::bigint as shard_bytes from levels group by depth, prefix),
fits as (
  select l.doc_id, l.n_bytes, l.depth, l.prefix, s.shard_bytes,
         row_number() over (partition by l.doc_id order by l.depth) as k
  from levels l join sums s using (depth, prefix) where s.shard_bytes <= {LIMIT})
select doc_id, n_bytes, depth, prefix, 0::bigint as sub, shard_bytes from fits where k = 1
"""
