"""A folder of files in several encodings, masks and formats becomes records in one call."""

import random
import re

from logweave.operators.records import Format
from logweave.sources import load, text

CLOCKED = Format("clocked", r"^(?'Time'\d\d:\d\d:\d\d\.\d{3}) (?'Level'\w+) (?'Message'.*)", ("Level",), "Time", "HH:mm:ss.fff", xor_mask=0xEF)
DATED = Format("dated", r"^(?'When'\d{4}-\d\d-\d\d \d\d:\d\d:\d\d) \[(?'Severity'\w+)\] (?'Text'.*)", ("Severity",), "When", "yyyy-MM-dd HH:mm:ss")
PIPED = Format("piped", r"^(?'Id'\d+)\|(?'Text'.*)")
FORMATS = [CLOCKED, DATED, PIPED]


def masked(data, mask=0xEF):
    return bytes(b ^ mask for b in data)


def folder(root):
    (root / "sub").mkdir()
    (root / "a.log").write_bytes(masked("head\n23:59:59.000 warn eins\nmore\n\n00:00:01.000 info zwei ü\n".encode()))
    (root / "b.log").write_bytes("2024-05-06 07:08:09 [E] drei\r\n  vier\r\n2024-05-06 07:08:10 [I] 五\r\n".encode("utf-16"))
    # a wide file without a mark is no file of that format: its head is read as UTF-8
    (root / "sub" / "c.log").write_bytes("7|x\r\n8|y\r\n\r\nz".encode("utf-16-be"))
    (root / "d.log").write_bytes(b"nothing\n\n\nknown\n")
    (root / "e.log").write_bytes(b"")


def test_a_folder_becomes_records(spark, tmp_path):
    folder(tmp_path)
    for split, chunk in ((5, 9), (64 << 20, 1 << 20)):
        rows = load.load(spark, str(tmp_path), FORMATS, split=split, chunk=chunk)
        names = {r.file_id: r.path[-5] for r in text.files(spark, str(tmp_path)).collect()}
        got = {(names[r.file_id], r.line_no): r for r in rows.collect()}
        assert {k: r.text for k, r in got.items()} == {
            ("a", 0): "23:59:59.000 warn eins\nmore", ("a", 1): "00:00:01.000 info zwei ü",
            ("b", 0): "2024-05-06 07:08:09 [E] drei\n  vier", ("b", 1): "2024-05-06 07:08:10 [I] 五",
            ("d", 0): "nothing", ("d", 1): "known",
        } | {("c", 0): "7|x", ("c", 1): "8|y", ("c", 2): "z"}
        f = {k: r.fields.asDict() for k, r in got.items()}
        assert f["a", 0] == {"Time": "23:59:59.000", "Severity": "warn", "Message": "eins\nmore", "When": "", "Id": ""}
        assert f["b", 0]["Severity"] == "E" and f["b", 0]["Message"] == "drei\n  vier" and f["c", 1]["Message"] == "8|y" and f["d", 1]["Message"] == "known"
        day = 86_400_000_000
        assert [got["a", n].ts_norm for n in (0, 1)] == [day - 1_000_000, day + 1_000_000]
        assert got["b", 1].ts_norm - got["b", 0].ts_norm == 1_000_000 and got["c", 0].ts_raw is None and got["c", 0].ts_norm == 0


def test_census(spark, tmp_path):
    folder(tmp_path)
    got = {r.path[-5]: (r.format, r["mask"], r.encoding, r.ratio) for r in load.census(spark, str(tmp_path), FORMATS).collect()}
    assert got["a"] == ("clocked", 0xEF, "UTF-8", 0.4) and got["b"][:3] == ("dated", 0, "UTF-16LE")
    assert got["d"] == ("plain", 0, "UTF-8", None) and "e" not in got
    twin = Format("twin", PIPED.regex)
    (tmp_path / "f.log").write_bytes(b"1|a\n" * 30 + b"x\n" * 10)
    ties = {r.path[-5]: r.format for f in ([twin, PIPED], [PIPED, twin]) for r in load.census(spark, str(tmp_path), f, "f.log").collect() for _ in [0] if r.format == f[0].name}
    assert ties == {"f": "piped"}


def test_an_empty_folder_has_no_records(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"")
    assert load.load(spark, str(tmp_path), FORMATS).collect() == []


def test_records_equal_a_plain_reading(spark, tmp_path):
    rnd = random.Random(5)
    expected = {}
    for k in range(12):
        lines = [rnd.choice([f"{rnd.randrange(99)}|{'é' * rnd.randrange(9)}", "more", "", "x|y"]) for _ in range(80)]
        name, encoding = f"{k:02}.log", rnd.choice(["utf-8", "utf-8-sig", "utf-16", "utf-32"])
        (tmp_path / name).write_bytes(rnd.choice(["\n", "\r\n"]).join(lines).encode(encoding))
        open_, out = None, []
        for line in [x for x in lines if x]:
            if re.match(r"\d+\|", line):
                open_ = [line]
                out.append(open_)
            elif open_:
                open_.append(line)
        expected[name] = ["\n".join(r) for r in out]
    names = {r.file_id: r.path.rsplit("/", 1)[1] for r in text.files(spark, str(tmp_path)).collect()}
    got = {n: [] for n in expected}
    for r in load.load(spark, str(tmp_path), FORMATS, split=100, chunk=64).orderBy("file_id", "line_no").collect():
        got[names[r.file_id]].append(r.text)
    assert got == expected


def test_times_of_day_roll_over_chunks(spark, tmp_path):
    rnd = random.Random(9)
    clock, rows, expected = 0, [], []
    days, last, top = 0, None, 0
    for k in range(300):
        clock = (clock + rnd.randrange(-2000, 9000)) % 86_400
        rows.append(f"{clock // 3600:02}:{clock // 60 % 60:02}:{clock % 60:02}.000 i {k}" + "\nmore" * rnd.choice([0, 0, 9]))
        days += last is not None and clock < last - 3600
        last, top = clock, max(top, clock + days * 86_400)
        expected.append((clock * 1_000_000, top * 1_000_000))
    (tmp_path / "x.log").write_bytes(masked("\n".join(["head", *rows]).encode()))
    for chunk in (16, 150, 1 << 20):
        got = load.load(spark, str(tmp_path), FORMATS, split=500, chunk=chunk).orderBy("line_no").collect()
        assert [r.text for r in got] == rows and [(r.ts_raw, r.ts_norm) for r in got] == expected
