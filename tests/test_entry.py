import pytest

import __spark_entry__ as entry
from logweave.plans import catalog

SMALL = "/root/testdata/sf0.001"


def test_entry_has_a_stable_schema(spark):
    d = entry.entry(spark)
    assert d.columns == ["file_id", "value", "n"] and d.count() > 0


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalog.oracle_sql()) == set(catalog.queries())


@pytest.mark.parametrize("name", ["facet_counts", "thread_runs", "merged_logs", "ranges_toggle", "annotated_text", "symbol_resolution"])
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in ("events", "orders", "documents", "lineitem", "part", "supplier", "nation", "conversations"):
        db.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    wanted = db.execute(entry.oracle_sql()[name])
    names = [c[0] for c in wanted.description]
    got = entry.queries()[name](spark, SMALL)
    assert sorted(names) == sorted(got.columns)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got.select(*names).collect())) == sorted(map(key, wanted.fetchall()))
