import pytest
from pyspark.sql import functions as F

from logweave.functions import text as shape
from logweave.functions import times
from logweave.functions.dialect import PatternError, compile_pattern
from logweave.operators import records, timeaxis
from logweave.operators.records import Format
from logweave.operators.scan import positions, previous, running

CLASSIC = Format("classic", r"^(?'Time'\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d{3}) (?'Level'\w+) (?'Message'.*)", ("Level",))
CLOCK = Format("clock", r"^(?'Time'\d\d:\d\d:\d\d\.\d{3})\t(?'Message'.*)", (), "time", "HH:mm:ss.fff")


def lines(spark, texts, file_id=0):
    return spark.createDataFrame([(file_id, i, t) for i, t in enumerate(texts)], "file_id long, byte_offset long, text string")


def test_multiline_records_and_header(spark):
    t = ["banner", "2024-01-01 10:00:00.000 INFO first", "  more QX7", "2024-01-01 10:00:01.000 WARN second"]
    rows = records.fields(records.records(lines(spark, t), CLASSIC), CLASSIC).orderBy("line_no").collect()
    assert [(r.line_no, r.Level, r.Message) for r in rows] == [(0, "INFO", "first\n  more QX7"), (1, "WARN", "second")]
    assert [r.text for r in records.headers(lines(spark, t), CLASSIC).collect()] == ["banner"]


def test_empty_input(spark):
    empty = spark.createDataFrame([], "file_id long, byte_offset long, text string")
    assert records.records(empty, CLASSIC).count() == 0


@pytest.mark.parametrize(("hits", "total", "expected"), [(3, 97, "plain"), (10, 100, "classic")])
def test_format_threshold(spark, hits, total, expected):
    t = ["2024-01-01 10:00:00.000 INFO x"] * hits + ["text"] * (total - hits)
    assert records.detect(lines(spark, t), [CLASSIC, CLOCK]).first().format == expected


def test_first_format_wins_ties(spark):
    other = Format("other", CLASSIC.regex)
    assert records.detect(lines(spark, ["2024-01-01 10:00:00.000 INFO x"]), [CLASSIC, other]).first().format == "classic"


def test_extents(spark):
    t = lines(spark, ["2024-01-01 10:00:00.000 A x", "2024-01-01 10:00:00.000 B x", "tail"])
    sizes = spark.createDataFrame([(0, 9)], "file_id long, size long")
    out = records.extents(records.records(t, CLASSIC), sizes, chunk=1).orderBy("line_no").collect()
    assert [(r.byte_offset, r.byte_len) for r in out] == [(0, 1), (1, 8)]


def test_transformation(spark):
    d = spark.createDataFrame([('data "aGVsbG8=" end',), ('data "%%%" end',), ("nothing",)], "text string")
    rule = r"^data (?'Base64Decode'\"[^\"]+\")"
    assert [r[0] for r in d.select(records.transform(F.col("text"), [rule])).collect()] == ["data hello end", 'data "%%%" end', "nothing"]


def test_dialect():
    p = compile_pattern(r"^(?'a_b'\d+)(?<c>[(]x?)(y)|(?'a_b'z)$")
    assert p.java.startswith("(?dU)^(\\d+)([(]x?)(y)|(z)$") and p.fields == (("1", (3,)), ("a_b", (1, 4)), ("c", (2,)))
    for bad in (r"(?'a'x)+", r"(?(a)b|c)", r"(?<x-y>z)"):
        with pytest.raises(PatternError):
            compile_pattern(bad)


def test_midnight_and_small_step_back(spark):
    base = 23 * 3600 + 59 * 60 + 57
    t = [f"{s // 3600 % 24:02d}:{s // 60 % 60:02d}:{s % 60:02d}.{ms:03d}\tm" for k in range(25) for s, ms in [divmod(base * 1000 + 250 * k, 1000)]]
    t[20] = t[19][:-5] + "000\tm"  # less than an hour back
    rows = records.fields(records.records(lines(spark, t), CLOCK), CLOCK).withColumn("ts_raw", times.parse(F.col("Time"), CLOCK.time_format))
    for chunk in (3, 100):
        out = [r.ts_norm for r in timeaxis.normalise(rows, True, chunk).orderBy("line_no").collect()]
        assert out[12] == times.DAY and out == sorted(out) and out[20] == out[19]
    assert times.is_time_only("HH:mm:ss.fff") and not times.is_time_only("yyyy HH")


def test_missing_times_carry_forward(spark):
    d = spark.createDataFrame([(0, 0, None), (0, 1, 5), (0, 2, None), (0, 3, 3)], "file_id long, line_no long, ts_raw long")
    n = timeaxis.normalise(d, False, 2)
    assert [r.ts_norm for r in n.orderBy("line_no").collect()] == [0, 5, 5, 3]
    s = timeaxis.summary(n, 2).first()
    assert s.has_time and not s.monotonic and s.axis == "lines"


@pytest.mark.parametrize("chunk", [1, 4, 7, 1000])
def test_running_values_do_not_depend_on_chunks(spark, chunk):
    rows = [(k, i, (i * 7919 + k) % 13, None if i % 3 else i) for k in (0, 1) for i in range(40)]
    d = spark.createDataFrame(rows, "k long, i long, v long, w long")
    got = running(d, ["k"], "i", {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("w"))}, chunk=chunk).orderBy("k", "i").collect()
    for r in got:
        own = [x for x in rows if x[0] == r.k and x[1] <= r.i]
        assert (r.s, r.m, r.l) == (sum(x[2] for x in own), max(x[2] for x in own), [x[3] for x in own if x[3] is not None][-1])
    before = previous(d, ["k"], "i", {"p": F.col("w")}, chunk=chunk).filter("k = 1 and i in (0, 1, 3)").orderBy("i").collect()
    assert [r.p for r in before] == [None, 0, None]


def test_positions(spark):
    d = spark.range(500).select((F.col("id") * 7919 % 500).alias("x"))
    assert all(r.x == r.pos for r in positions(d, [F.col("x")]).collect())


def test_shapes(spark):
    d = spark.createDataFrame([("abcdefgh\nxy",), ("ab",)], "t string")
    assert [r[0] for r in d.select(shape.prune(F.col("t"), 5)).collect()] == ["abcde...\nxy", "ab"]
    assert [r[0] for r in d.select(shape.break_lines(F.col("t"), 5)).collect()] == ["abcde\nfgh\nxy", "ab"]
    long = spark.createDataFrame([("\n".join(map(str, range(25))),), ("\n".join(map(str, range(21))),)], "t string")
    kept, cut = shape.fold(F.col("t"))
    assert [r[0] for r in long.select(cut).collect()] == [5, 0]
    v = spark.createDataFrame([(12,), (1500,), (61_000,), (3_660_000,), (90_000_000,)], "ms long")
    assert [r[0] for r in v.select(times.show_duration(F.col("ms") * 1000)).collect()] == ["12 ms", "1.5 sec", "1 min 1 sec", "1 h 1 min", "1 d 1 h"]
