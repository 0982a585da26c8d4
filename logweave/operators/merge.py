"""Merging logs of different formats in time order under one aligned schema."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.operators.scan import positions

#: Names that mean the same in the merged schema; the first is the better spelling.
SAME = {"text": "message", "level": "severity"}
END = (1 << 63) - 1


@dataclass(frozen=True)
class Source:
    """One log of a merge: its rows (line_no, ts_norm, text and fields), its fields, those with facets, and whether it is timed."""

    rows: DataFrame
    fields: tuple[str, ...]
    indexed: frozenset[str]
    timed: bool


def _key(name: str) -> str:
    return SAME.get(name.lower(), name.lower())


def _better(a: str, b: str) -> str:
    """Of two spellings of a field: the main name before its synonym, then an upper-case initial, then the earlier."""
    rank = lambda n: (n.lower() in SAME, not n[:1].isupper())
    return b if rank(b) < rank(a) else a


def merged_schema(sources: list[Source]) -> list[tuple[str, bool, list[str | None]]]:
    """Merged fields by first appearance: best spelling, whether any source indexes it, and each source's own name."""
    out: dict[str, list] = {}
    for i, s in enumerate(sources):
        for n in s.fields:
            f = out.setdefault(_key(n), [n, False, [None] * len(sources)])
            f[0] = _better(f[0], n)
            f[1] = f[1] or n in s.indexed
            if f[2][i] is None:
                f[2][i] = n
    return [(n, indexed, own) for n, indexed, own in out.values()]


def align(sources: list[Source]) -> DataFrame:
    """All rows with source_ix, source_timed, line_no, ts_norm and the merged fields, empty where a source lacks one."""
    schema = merged_schema(sources)
    out = None
    for i, s in enumerate(sources):
        cols = [F.coalesce(F.col(own[i]).cast("string"), F.lit("")).alias(n) if own[i] else F.lit("").alias(n) for n, _, own in schema]
        part = s.rows.select(F.lit(i).alias("source_ix"), F.lit(s.timed).alias("source_timed"), F.col("line_no").cast("long").alias("line_no"), F.col("ts_norm").cast("long").alias("ts_norm"), *cols)
        out = part if out is None else out.unionByName(part)
    return out


def merge(sources: list[Source]) -> DataFrame:
    """The aligned rows with ``pos``: by time, source and record; untimed sources after all others, one by one."""
    time = F.when(F.col("source_timed"), F.col("ts_norm")).otherwise(F.lit(END))
    return positions(align(sources), [time, F.col("source_ix"), F.col("line_no")], "pos")


def chosen(sources: list[Source], wanted: list[int]) -> list[Source]:
    """Only the wanted sources, in their order."""
    return [s for i, s in enumerate(sources) if i in set(wanted)]


def facet_counts(merged: DataFrame, name: str) -> DataFrame:
    """value, n over all sources."""
    return merged.groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n"))


def field_counts(sources: list[Source]) -> DataFrame:
    """ord, name, indexed, n of each merged field: n rows of all sources hold a value of it."""
    schema = merged_schema(sources)
    counted = align(sources).agg(*[F.count_if(F.col(n) != "").alias(f"n{i}") for i, (n, _, _) in enumerate(schema)])
    return counted.select(F.inline(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("name"), F.lit(x).alias("indexed"), F.col(f"n{i}").alias("n")) for i, (n, x, _) in enumerate(schema)])))


def search(merged: DataFrame, found: dict[int, DataFrame], thread: tuple[str, str, int] | None = None) -> DataFrame:
    """Merged rows that each source's own search found (line_no per source); a thread (field, value, source) focuses
    within its source only."""
    hits = None
    for i, d in found.items():
        part = d.select(F.lit(i).alias("source_ix"), F.col("line_no").cast("long").alias("line_no"))
        hits = part if hits is None else hits.unionByName(part)
    out = merged.join(hits.distinct(), ["source_ix", "line_no"], "left_semi")
    if thread:
        name, value, source = thread
        out = out.filter((F.col("source_ix") == source) & (F.col(name) == value))
    return out
