"""Search over records: patterns, hit numbers, neighbours, buckets, sweeps, spans and captures."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.dialect import compile_pattern, literal
from logweave.functions.text import places
from logweave.operators.scan import positions, running

BUCKETS, HISTORY = 1000, 1024


def trimmed(text: str = "text") -> Column:
    """What a search sees: the text without trailing line ends."""
    return F.regexp_replace(text, r"[\r\n]+$", "")


def matches(pattern: str, regex: bool = True, case: bool = False, text: str = "text") -> Column:
    """A regex or a literal text; without ``case`` upper and lower case are alike."""
    if not regex:
        return F.contains(trimmed(text), F.lit(pattern)) if case else F.contains(F.lower(trimmed(text)), F.lower(F.lit(pattern)))
    return trimmed(text).rlike(compile_pattern(pattern, ignore_case=not case).java)


def in_order(terms: list[str]) -> str:
    """A pattern of several literal terms, one after the other on a line."""
    return ".*".join(literal(t) for t in terms)


def hits(rows: DataFrame, found: Column) -> DataFrame:
    """file_id, line_no, hit: the hits with their number in each file."""
    some = rows.filter(found).select("file_id", "line_no")
    placed = positions(some, [F.col("file_id"), F.col("line_no")], "__p")
    first = placed.groupBy("file_id").agg(F.min("__p").alias("__f"))
    return placed.join(first, "file_id").select("file_id", "line_no", (F.col("__p") - F.col("__f")).alias("hit"))


def neighbours(found: DataFrame, anchors: DataFrame) -> DataFrame:
    """file_id, anchor, next_hit, previous_hit: from each anchor record, wrapping round. found: file_id, line_no."""
    hit = found.select("file_id", F.col("line_no").alias("at"), F.col("line_no").alias("h"), F.lit(0).alias("a"))
    both = hit.unionByName(anchors.select("file_id", F.col("anchor").alias("at"), F.lit(None).cast("long").alias("h"), F.lit(1).alias("a")))
    spots = both.groupBy("file_id", "at").agg(F.max("h").alias("h"), F.sum("a").alias("a")).withColumn("__back", -F.col("at"))
    seen = running(spots, ["file_id"], "at", {"p": ("last", F.col("h"))}, before=True)
    seen = running(seen, ["file_id"], "__back", {"n": ("last", F.col("h"))}, before=True)
    ends = found.groupBy("file_id").agg(F.min("line_no").alias("f"), F.max("line_no").alias("l"))
    out = seen.filter("a > 0").withColumn("__each", F.explode(F.sequence(F.lit(1), F.col("a").cast("int")))).join(ends, "file_id")
    return out.select("file_id", F.col("at").alias("anchor"), F.coalesce("n", "f").alias("next_hit"), F.coalesce("p", "l").alias("previous_hit"))


def buckets(found: DataFrame, totals: DataFrame, count: int = BUCKETS) -> DataFrame:
    """file_id, bucket, hits: where in each file hits are. totals: file_id, n."""
    place = F.floor(F.col("line_no") * count / F.col("n")).cast("int")
    return found.join(totals, "file_id").groupBy("file_id", place.alias("bucket")).agg(F.count("*").alias("hits"))


def sweep(rows: DataFrame, patterns: list[tuple[str, str, bool, bool]]) -> DataFrame:
    """name, file_id, hits of many saved patterns (name, pattern, case, regex) in one pass."""
    counted = rows.groupBy("file_id").agg(*[F.count_if(matches(p, regex, case)).alias(f"c{i}") for i, (_, p, case, regex) in enumerate(patterns)])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"c{i}").alias("hits")) for i, (n, *_) in enumerate(patterns)])).alias("e")
    return counted.select("file_id", each).select("e.name", "file_id", "e.hits")


def saved(searches: DataFrame, typed: str) -> DataFrame:
    """Saved searches (name, pattern) whose name or pattern contains the typed text, whatever the case; all if it is blank."""
    has = lambda c: F.contains(F.lower(c), F.lower(F.lit(typed)))
    return searches.filter(has("name") | has("pattern")) if typed.strip() else searches


def spans(rows: DataFrame, pattern: str, case: bool = False) -> DataFrame:
    """file_id, line_no, start (from 0), length, value of every match: what stands between matches gives their places."""
    java = compile_pattern(pattern, ignore_case=not case).java
    found = places(rows, trimmed(), java, ("file_id", "line_no"))
    return found.select("file_id", "line_no", "start", F.length("token").alias("length"), F.col("token").alias("value"))


def variable_parts(rows: DataFrame, pattern: str, case: bool = False) -> DataFrame:
    """captures (what each ``.*`` of the pattern consumed), n: the variable parts of messages and how often they occur."""
    made = re.sub(r"(?<!\\)\.\*\??", lambda m: f"({m[0]})", pattern)
    p = compile_pattern(made, ignore_case=not case)
    some = rows.filter(trimmed().rlike(p.java))
    return some.groupBy(F.array(*[F.regexp_extract(trimmed(), p.java, g[0]) for _, g in p.fields]).alias("captures")).agg(F.count("*").alias("n"))


def history(log: DataFrame, keep: int = HISTORY) -> DataFrame:
    """value, uses, last_used of a search log (value, used_at): the most used first, the latest on ties."""
    return log.groupBy("value").agg(F.count("*").alias("uses"), F.max("used_at").alias("last_used")).orderBy(F.desc("uses"), F.desc("last_used"), "value").limit(keep)
