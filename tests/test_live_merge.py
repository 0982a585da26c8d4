"""The merged order of growing logs equals the merge of all rows after every batch."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from logweave.operators import merge
from logweave.streaming.merged import MergedTable

ROWS = "source_ix int, source_timed boolean, line_no long, ts_norm long, Text string, Level string"


def order(rows):
    """Positions by sorting: null times first, then source and record; untimed sources last."""
    key = lambda r: (not r[1], r[3] is not None if r[1] else True, (r[3] or 0) if r[1] else 0, r[0], r[2])
    return [(*r, k) for k, r in enumerate(sorted(rows, key=key))]


@pytest.fixture
def batches():
    rnd = random.Random(3)
    nexts, out = [0] * 4, []
    for _ in range(4):
        rows = []
        for _ in range(40):
            s = rnd.randrange(4)
            time = rnd.choice([7, rnd.randrange(-50, 400), None if s == 1 else 100])  # many of one time
            rows.append((s, s < 3, nexts[s], time, f"t{nexts[s]}", rnd.choice(["", "Info", None])))
            nexts[s] += 1
        out.append(rows)
    return [*out[:2], [], *out[2:]]


def test_every_batch_gives_the_merged_order(spark, tmp_path, batches):
    t = MergedTable(spark, str(tmp_path / "m"), spark.createDataFrame([], ROWS).schema, width=50, records=16)
    assert t.read().collect() == [] and t.read().columns == [*t.schema.names, "pos"]
    seen, kept = [], None
    for number, rows in enumerate(batches):
        t.add(spark.createDataFrame(rows, ROWS), number)
        seen += rows
        assert [tuple(r) for r in t.read().orderBy("pos").collect()] == order(seen)
        kept = {r.bucket: (r.held_by, r.n) for r in t.buckets().collect()}
    assert sum(n for _, n in kept.values()) == len(seen)
    timed = [(r[0], r[2], r[3]) for r in seen if r[1]]
    late = [(1, True, 900, 399, "late", "")]
    t.add(spark.createDataFrame(late, ROWS), 5)
    assert {p.name for p in Path(tmp_path / "m/rows/version=5").glob("bucket=*")} == {"bucket=7"} and timed  # the one it touches
    t.add(spark.createDataFrame(late, ROWS), 5)  # sent again
    assert [tuple(r) for r in t.read().orderBy("pos").collect()] == order(seen + late)


def test_equals_the_merge_of_whole_logs(spark, tmp_path):
    one = spark.createDataFrame([(i, i * 10, f"a{i}") for i in range(30)], "line_no long, ts_norm long, text string")
    two = spark.createDataFrame([(i, 295 - i * 5, f"b{i}") for i in range(30)], "line_no long, ts_norm long, Message string")
    none = spark.createDataFrame([(i, 0, f"c{i}") for i in range(5)], "line_no long, ts_norm long, text string")
    sources = [merge.Source(one, ("text",), frozenset(), True), merge.Source(none, ("text",), frozenset(), False), merge.Source(two, ("Message",), frozenset(), True)]
    rows = merge.align(sources)
    t = MergedTable(spark, str(tmp_path / "m"), rows.schema, width=64, records=2)
    for k in range(3):
        t.add(rows.filter(F.pmod("line_no", F.lit(3)) == k), k)
    whole = merge.merge(sources)
    assert t.read().select(whole.columns).orderBy("pos").collect() == whole.orderBy("pos").collect()


def test_a_stream_is_followed_and_taken_up_again(spark, tmp_path, batches):
    t = MergedTable(spark, str(tmp_path / "m"), spark.createDataFrame([], ROWS).schema, width=100)
    seen = []
    for rows in batches[:2]:
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        seen += rows
        q = t.follow(spark.readStream.schema(ROWS).json(str(tmp_path / "in")), str(tmp_path / "ck"))
        assert q.awaitTermination(120) and q.exception() is None
        assert [tuple(r) for r in t.read().orderBy("pos").collect()] == order(seen)
