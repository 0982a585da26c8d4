"""Filters of records: exclusions by value, time and record ranges, and their merged forms."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filter:
    """Excluded values per field, an inclusive time range and a half-open record range; all have to hold."""

    excluded: dict[str, frozenset[str]] = field(default_factory=dict)
    times: tuple[int, int] | None = None
    lines: tuple[int, int] | None = None

    def add(self, name: str, values) -> Filter:
        return replace(self, excluded=self.excluded | {name: self.excluded.get(name, frozenset()) | frozenset(values)})

    def put(self, name: str, values) -> Filter:
        rest = {k: v for k, v in self.excluded.items() if k != name}
        return replace(self, excluded=rest | ({name: frozenset(values)} if values else {}))

    def clear(self, name: str | None = None) -> Filter:
        return replace(self, excluded={k: v for k, v in self.excluded.items() if name is not None and k != name})

    def condition(self) -> Column:
        out = F.lit(True)
        for name, values in sorted(self.excluded.items()):
            out = out & ~F.col(name).isin(*sorted(values))
        if self.times:
            out = out & F.col("ts_norm").between(*self.times)
        if self.lines:
            out = out & (F.col("line_no") >= self.lines[0]) & (F.col("line_no") < self.lines[1])
        return out

    def apply(self, rows: DataFrame) -> DataFrame:
        return rows.filter(self.condition())


def exclude_all_but(name: str, kept) -> Column:
    return F.col(name).isin(*sorted(kept))


def exclude_values_of(rows: DataFrame, selected: DataFrame, name: str) -> DataFrame:
    """Drops rows that have a value of ``name`` that any selected row has."""
    return rows.join(selected.select(name).distinct(), name, "left_anti")


def thread(name: str, value: str) -> Column:
    return F.col(name) == value


def merged_exclusion(name: str, values, indexed_by: dict[int, set[str]]) -> Column:
    """Applies to a source only if that source indexes the field. indexed_by: source_ix -> its fields."""
    owners = [s for s, names in indexed_by.items() if name in names]
    return ~(F.col("source_ix").isin(*owners) & F.col(name).isin(*sorted(values))) if owners else F.lit(True)


def merged_times(first: int, last: int) -> Column:
    """Rows of timed sources outside the range go, rows of untimed sources stay."""
    return ~F.col("source_timed") | F.col("ts_norm").between(first, last)


def facet_values(rows: DataFrame, name: str, typed: str) -> DataFrame:
    """Values that contain the typed text, whatever the case."""
    return rows.select(name).distinct().filter(F.contains(F.lower(name), F.lower(F.lit(typed))))
