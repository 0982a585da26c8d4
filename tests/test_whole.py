"""Whole jobs: tables without subsets, texts without cuts, signatures and payloads of every form."""

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
WHOLE = ["glued_base64", "decoded_leaves", "decoded_text", "marked_rows", "visible_marks", "selection_export", "ranges_normalised", "ranges_size", "ranges_restore", "ranges_toggle", "neighbour_hits", "nearest_visible_row"]


def same(spark, name, sf=SMALL):
    db = duckdb.connect()
    for t in ("events", "orders", "documents", "lineitem", "nation"):
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    wanted = db.execute(entry.oracle_sql()[name])
    names = [c[0] for c in wanted.description]
    got = entry.queries()[name](spark, sf)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(names) == sorted(got.columns)
    rows = sorted(map(key, got.select(*names).collect()))
    assert rows == sorted(map(key, wanted.fetchall()))
    return len(rows)


@pytest.mark.parametrize("name", WHOLE)
def test_whole_tables(spark, name):
    assert same(spark, f"{name}_all") > 0


@pytest.mark.parametrize("name", ["base64_payloads", "payload_kinds"])
def test_detectors_meet_every_kind_of_line(spark, name, monkeypatch):
    from logweave.operators import payloads

    seen = []
    for f in ("base64", "pem", "hex_runs"):
        monkeypatch.setattr(payloads, f, lambda rows, *a, real=getattr(payloads, f), **b: (seen.append(rows), real(rows, *a, **b))[1])
    assert same(spark, name) > 0
    assert all({r.k for r in rows.selectExpr("line_no % 3 as k").distinct().collect()} == {0, 1, 2} for rows in seen) and seen


@pytest.mark.parametrize("name", ["merged_logs", "merged_schema"])
def test_merges_carry_whole_texts(spark, name):
    assert same(spark, f"{name}_all") > 0


def test_merged_sources_are_whole(spark):
    from logweave.plans import set_queries

    d = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("max(length(text))").first()[0]
    assert set_queries._sources(spark, SMALL)[2].rows.selectExpr("max(length(text))").first()[0] == d > 20


def test_leaves_of_any_depth_and_xml(spark):
    from logweave.operators import payloads

    deep = '{"a":{"b":{"c":{"d":{"e":{"f":[1,{"g":"x"}]}}}}}}'
    texts = [deep, '{"k": 2}', "[]", "no payload", '<r id="7"><a>one<b/>two</a><c x="y"> </c></r>', "<broken", None]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, payload string")
    out = sorted((r.id, r.path, r.value) for r in payloads.leaves(d, keys=("id",)).collect())
    assert out == [
        (0, "$.a.b.c.d.e.f[]", "1"), (0, "$.a.b.c.d.e.f[].g", "x"), (1, "$.k", "2"),
        (4, "$.r.@id", "7"), (4, "$.r.a", "one"), (4, "$.r.a", "two"), (4, "$.r.c.@x", "y"),
    ]


@pytest.mark.parametrize("name", ["payload_leaves", "payload_code_join", "decoded_leaves", "decoded_leaves_all"])
def test_leaves_equal_their_sql(spark, name):
    assert same(spark, name) > 0


def test_terms_of_nested_brackets(spark):
    from logweave.operators import payloads

    texts = ["[a (b)]", "(x (y) z) [ ] <<t>", 'plain "q"', "[open", None]
    d = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "file_id long, line_no long, text string")
    out = sorted((r.line_no, r.kind, r.term) for r in payloads.terms(d).collect())
    assert out == [(0, "bracket", "a (b)"), (0, "bracket", "b"), (1, "bracket", "t"), (1, "bracket", "x (y) z"), (1, "bracket", "y"), (2, "quoted", "q")]
    said = spark.createDataFrame([(0, 0, "..got a-b.c- [x_1], don't ... é"), (0, 1, None)], "file_id long, line_no long, text string")
    assert [r.term for r in payloads.tokens(said).collect()] == ["got", "a-b.c", "x_1", "don't", "é"]


def test_text_terms_equal_their_sql(spark):
    assert same(spark, "text_terms") > 0
