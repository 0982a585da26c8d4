"""Growing files as a stream: lines and records equal those of the whole files, across batches, restarts and failures."""

import random

import pytest

from logweave.operators.records import Format, records
from logweave.sources import ranges
from logweave.sources.ranges import file_number, framed
from logweave.streaming import live
from logweave.streaming.tail import Tail, _Reader

FMT = Format("clock", r"^(?'Time'\d\d:\d\d:\d\d) (?'Message'.*)", (), "Time", "HH:mm:ss")


def drained(path, encoding, mask, steps, split, last=True):
    """Lines of a reader that sees the file at the given sizes, a new reader each time."""
    data, at, out = path.read_bytes(), {"files": {}, "ended": False}, []
    for k, n in enumerate(steps):
        path.write_bytes(data[:n])
        r = _Reader({"path": str(path), "encoding": encoding, "mask": str(mask), "split": str(split), "ended": str(last and k == len(steps) - 1)})
        now = r.latestOffset()
        out += [(x["byte_offset"], x["text"], x["last"]) for p in r.partitions(at, now) for b in r.read(p) for x in b.to_pylist()]
        at = now
    return out


@pytest.mark.parametrize("encoding,mask,block", [("utf-8", 0, 1), ("utf-8", 0xEF, 5), ("utf-16-le", 0, 8), ("utf-16-be", 7, 1 << 20), ("utf-32-le", 0, 16)])
def test_lines_do_not_depend_on_growth(tmp_path, monkeypatch, encoding, mask, block):
    rnd = random.Random(11)
    p = tmp_path / "f"
    for case in range(30):
        said = "".join(rnd.choice(["a", "bc", "\r\n", "\n", "\n\n", "long " * 5, "é", "Ċ"]) for _ in range(rnd.randrange(60)))
        data = bytes(b ^ mask for b in said.encode(encoding))
        p.write_bytes(data)
        monkeypatch.setattr(ranges, "BLOCK", 1 << 20)
        expected = [(o, bytes(x ^ 0 for x in d).decode(encoding).rstrip("\r\n")) for o, d in framed(str(p), 0, len(data), encoding, mask)]
        monkeypatch.setattr(ranges, "BLOCK", max(block, 4) if "utf-8" not in encoding else block)
        steps = [*sorted(rnd.randrange(len(data) + 1) for _ in range(4)), len(data)]
        p.write_bytes(data)
        got = drained(p, encoding, mask, steps, rnd.choice([4, 12, 1 << 20]))
        assert sorted(x[:2] for x in got if not x[2]) == expected, (case, said, steps)
        assert [x for x in got if x[2]] == [(len(data), None, True)]


def test_a_line_that_is_not_whole_waits(tmp_path):
    p = tmp_path / "f"
    p.write_bytes(b"one\ntw")
    assert drained(p, "utf-8", 0, [6], 4, last=False) == [(0, "one", False)]
    assert drained(p, "utf-8", 0, [6], 4) == [(0, "one", False), (4, "tw", False), (6, None, True)]


def test_a_file_that_shrinks_is_an_error(tmp_path):
    p = tmp_path / "f"
    p.write_bytes(b"one\n")
    r = _Reader({"path": str(p)})
    with pytest.raises(ValueError, match="shrunk"):
        r.partitions({"files": {str(p): 9}, "ended": False}, r.latestOffset())
    assert r.partitions({"files": {str(p): 4}, "ended": True}, r.latestOffset()) == []


def test_restarts_and_failures_lose_and_repeat_nothing(spark, tmp_path):
    spark.dataSource.register(Tail)
    rnd = random.Random(2)
    (tmp_path / "in").mkdir()
    said, at = {}, {}
    for n in ("a.log", "b.log"):
        rows, clock = ["head"], 80_000
        for _ in range(60):
            clock = (clock + rnd.randrange(-5, 900)) % 86_400
            rows += [f"{clock // 3600:02}:{clock // 60 % 60:02}:{clock % 60:02} {'ä' * rnd.randrange(5)}", *["more"] * rnd.randrange(3)]
        said[n], at[n] = "\n".join(rows).encode(), 0  # the last line has no line end
    failed = []

    def each(batch, number):
        if number == 1 and not failed:
            failed.append(number)
            raise RuntimeError("lost on purpose")
        batch.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={number}"))

    def run(ended):
        lines = spark.readStream.format("log_tail").option("path", str(tmp_path / "in")).option("split", "64").option("ended", ended).load()
        made = live.records(lines, FMT, "unix_micros(try_to_timestamp(t, 'HH:mm:ss'))", True)
        q = made.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        try:
            q.awaitTermination(120)
        except Exception:  # noqa: BLE001
            assert failed == [1]
            run(ended)

    for step in range(4):
        for n, data in said.items():
            if n == "b.log" and step == 0:
                continue  # appears later
            at[n] = len(data) if step == 3 else at[n] + rnd.randrange(200, 400)
            (tmp_path / "in" / n).write_bytes(data[: at[n]])
        run(step == 3)
    assert failed == [1]
    got = sorted((r.file_id, r.line_no, r.byte_offset, r.text, r.ts_norm) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    expected = []
    for n, data in said.items():
        path = str(tmp_path / "in" / n)
        rows = [(0, o, d.decode().rstrip("\n")) for o, d in framed(path, 0, len(data), "utf-8", 0)]
        days, last, top = 0, None, 0
        for r in records(spark.createDataFrame(rows, "file_id long, byte_offset long, text string"), FMT).orderBy("line_no").collect():
            h, m, s = map(int, r.text[:8].split(":"))
            now = h * 3600 + m * 60 + s
            days += last is not None and now < last - 3600
            last, top = now, max(top, now + days * 86_400)
            expected.append((file_number(path), r.line_no, r.byte_offset, r.text, top * 1_000_000))
    assert got == sorted(expected)
