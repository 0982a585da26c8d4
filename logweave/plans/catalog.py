"""All registered queries of the log operators, with their SQL."""

from __future__ import annotations

from logweave.plans import load_queries, log_queries, set_queries

MODULES = (log_queries, set_queries, load_queries)


#: Registered under their name and the same with _all, from the time when the plain ones read less than whole tables.
TWICE = (
    "decoded_leaves", "decoded_text", "glued_base64", "marked_rows", "merged_logs", "merged_schema", "nearest_visible_row", "neighbour_hits",
    "ranges_normalised", "ranges_restore", "ranges_size", "ranges_toggle", "selection_export", "visible_marks",
)


def _with_twice(found: dict) -> dict:
    return found | {f"{n}_all": found[n] for n in TWICE}


def queries() -> dict:
    return _with_twice({name: f for m in MODULES for name, f in m.QUERIES.items()})


def oracle_sql() -> dict[str, str]:
    return _with_twice({name: sql for m in MODULES for name, sql in m.SQL.items()})
