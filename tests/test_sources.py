from logweave.operators.records import Format, records
from logweave.plans.base import CLOCK
from logweave.sources import ranges, text
from logweave.sources.ranges import Lines, framed
from logweave.streaming import live


def whole(data: bytes, width: int = 1):
    """Lines by the rule: a run of line ends is one terminator."""
    import re

    return [(m.start(), m[0]) for m in re.finditer(rb"[\r\n]+|[^\r\n]+[\r\n]*", data)] if width == 1 else None


def test_ranges_cover_each_line_once(tmp_path):
    for data in (b"one\r\ntwo\n\n\nthree", b"\n\nfirst\nsecond\n", b"", b"\n" * 10, b"x" * 50 + b"\n" + b"y" * 5):
        p = tmp_path / "f"
        p.write_bytes(data)
        expected = list(framed(str(p), 0, len(data), "utf-8", 0))
        assert b"".join(x for _, x in expected) == data
        for split in (1, 2, 3, 7, 20):
            got = [x for s in range(0, len(data), split) for x in framed(str(p), s, min(s + split, len(data)), "utf-8", 0)]
            assert got == expected, (data, split)


def test_masked_and_wide_files(spark, tmp_path):
    spark.dataSource.register(Lines)
    p = tmp_path / "masked"
    p.write_bytes(bytes(b ^ 0xEF for b in "eins\nzwei ü\n".encode()))
    out = spark.read.format("log_lines").option("path", str(p)).option("mask", "239").load()
    assert [r.text for r in out.orderBy("byte_offset").collect()] == ["eins", "zwei ü"]
    q = tmp_path / "wide"
    q.write_bytes("eins\r\nzwei Ċ\r\n".encode("utf-16-le"))  # U+010A holds the byte of a line feed
    out = spark.read.format("log_lines").option("path", str(q)).option("encoding", "utf-16-le").option("split", "4").load()
    assert [r.text for r in out.orderBy("byte_offset").collect()] == ["eins", "zwei Ċ"]


def test_encodings(spark, tmp_path):
    files = {"a": "x\r\n".encode("utf-8-sig"), "b": "xy\r\n".encode("utf-16"), "c": "hello you\r\n".encode("utf-16-be"), "d": b"plain", "e": "x".encode("utf-32")}
    for n, data in files.items():
        (tmp_path / n).write_bytes(data)
    got = {r.path[-1]: r.encoding for r in text.encodings(spark, str(tmp_path)).collect()}
    assert got == {"a": "UTF-8", "b": "UTF-16LE", "c": "UTF-16BE", "d": "UTF-8", "e": "UTF-32LE"}


def test_text_lines_and_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.log").write_text("a\nb\n")
    assert [r.text for r in text.lines(spark, str(tmp_path)).orderBy("byte_offset").collect()] == ["a", "b"]
    assert [(r.size) for r in text.files(spark, str(tmp_path)).collect()] == [4]


def test_streamed_records_equal_batch(spark, tmp_path):
    fmt = Format("clock", r"^(?'Time'\d\d:\d\d:\d\d\.\d{3}) (?'Message'.*)", (), "Time", CLOCK.time_format)
    texts = ["head", "23:59:59.000 a", "more", "00:00:01.000 b", "00:00:00.500 c", "x"]
    schema = "file_id long, byte_offset long, text string, last boolean"
    rows = [(1, i, t, i == len(texts) - 1) for i, t in enumerate(texts)]
    for k in range(0, len(rows), 2):
        spark.createDataFrame(rows[k : k + 2], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = live.records(stream, fmt, "unix_micros(try_to_timestamp(t, 'HH:mm:ss.SSS'))", True)
    q = out.writeStream.format("memory").queryName("recs").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    assert q.exception() is None
    got = [(r.line_no, r.text, r.ts_norm) for r in spark.table("recs").orderBy("line_no").collect()]
    batch = records(spark.createDataFrame(rows, schema), fmt)
    assert [(n, t) for n, t, _ in got] == [(r.line_no, r.text) for r in batch.orderBy("line_no").collect()]
    assert [t for _, _, t in got] == [86_399_000_000, 86_401_000_000, 86_401_000_000]


def test_live_search_and_facets(spark, tmp_path):
    d = spark.createDataFrame([(0, "a x"), (0, "b"), (1, "a")], "file_id long, text string")
    d.write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).json(str(tmp_path / "in"))
    for name, made, mode in (("hits", live.search(stream, "A"), "append"), ("facets", live.facets(stream, "text"), "complete")):
        q = made.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
    assert spark.table("hits").count() == 2 and spark.table("facets").count() == 3


def test_pieces_do_not_depend_on_blocks(tmp_path, monkeypatch):
    import random

    rnd = random.Random(7)
    data = "".join(rnd.choice(["a", "bc", "\r\n", "\n", "\n\n", "long " * 9, "é"]) for _ in range(400)).encode()
    p = tmp_path / "f"
    p.write_bytes(data)
    expected = whole(data)
    for block in (1, 5, 64, 1 << 20):
        monkeypatch.setattr(ranges, "BLOCK", block)
        for split in (3, 17, 1 << 20):
            got = [x for s in range(0, len(data), split) for x in framed(str(p), s, min(s + split, len(data)), "utf-8", 0)]
            assert got == expected, (block, split)


def test_both_sources_number_files_alike(spark, tmp_path):
    spark.dataSource.register(Lines)
    p = tmp_path / "A b+c.log"
    p.write_bytes("one\r\n\xff bad\r\ntwo\r\n".encode("latin-1"))
    mine = spark.read.format("log_lines").option("path", str(p)).load()
    assert [r.text for r in mine.orderBy("byte_offset").collect()] == ["one", "� bad", "two"]
    ids = {r.file_id for d in (mine, text.files(spark, str(tmp_path)), text.lines(spark, str(tmp_path))) for r in d.select("file_id").collect()}
    assert len(ids) == 1


def test_live_merge_appends_and_names_the_times_touched(spark, tmp_path):
    schema = "file_id long, line_no long, ts_norm long, text string"
    rows = [(0, 0, 10, "a"), (1, 0, 5, "b"), (0, 1, 20, "c"), (1, 1, 15, "d")]
    for k in (0, 2):
        spark.createDataFrame(rows[k : k + 2], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    touched = []
    q = live.merge_into(stream, "live_records", lambda session, first, last: touched.append((first, last)), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert q.exception() is None and sorted(touched) == [(5, 10), (15, 20)]
    merged = [r.text for r in spark.table("live_records").orderBy("ts_norm", "file_id", "line_no").collect()]
    spark.sql("drop table live_records")
    assert merged == ["b", "a", "d", "c"]
