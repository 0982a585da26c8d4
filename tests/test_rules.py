"""Rules of single operators: frames and symbol files, transformations, payloads, dictionaries, times, table functions."""

import base64
import random

import pytest
from pyspark.sql import functions as F

from logweave.functions import der, tables, times
from logweave.operators import dictionaries, marks, payloads, records, search, symbols

GUID = "38b3dc8d-3d1d-fadd-e67b-593d48abec14"


def lines(spark, *texts):
    return spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "file_id long, line_no long, text string")


def test_frames_in_three_spellings_and_nothing_else(spark):
    text = f"Call stack:\n 0# test_.dll!{GUID},01!86da0\r\n1#\tC:\\bin\\app.x.exe!0X14ad  \n12# ntdll.dll+0x5aa58\n99999999999# big.dll!1\nprefix 3# a.dll!1\n4# a.dll!not-hex\n5# a.dll+5\nItem #1 done"
    got = symbols.identity(symbols.frames(lines(spark, text, "none", None))).orderBy("start").collect()
    assert [(r.number, r.module, r.guid, int(r.rva)) for r in got] == [(0, "test_.dll", GUID, 0x86DA0), (1, "C:\\bin\\app.x.exe", None, 0x14AD), (12, "ntdll.dll", None, 0x5AA58)]
    assert [text[r.start : r.start + r.length] for r in got] == [f"0# test_.dll!{GUID},01!86da0", "1#\tC:\\bin\\app.x.exe!0X14ad", "12# ntdll.dll+0x5aa58"]
    assert [(r.pdb, r["index"]) for r in got] == [("test_.pdb", GUID.replace("-", "").upper() + "1"), ("app.x.pdb", None), ("ntdll.pdb", None)]
    assert symbols.identity(symbols.frames(lines(spark, f"0# a.dll!{GUID},0A!1"))).first()["index"].endswith("C14A")


def test_symbol_files_by_identity(spark):
    own = GUID.replace("-", "").upper() + "1"
    frames = symbols.identity(symbols.frames(lines(spark, f"0# a.dll!{GUID},1!10\n1# a.dll!10\n2# b.dll!{GUID},1!10\n3# c.dll!{GUID},1!10")))
    entries = [(0, "A.pdb", True, "OTHER", None, "stranger"), (1, "a.pdb", False, own, None, "filed"), (1, "b.pdb", True, own, None, "flat b"), (2, "c.pdb", True, "OTHER", own, "flat c")]
    stores = spark.createDataFrame(entries, "store_ord int, file_name string, flat boolean, index string, other_index string, image_id string")
    found = symbols.symbol_files(frames, stores)
    assert {r.number: r.image_id for r in found.collect()} == {0: "filed", 1: "stranger", 2: "flat b", 3: "flat c"}
    known = spark.createDataFrame([("filed", 0x10, "main", "m.c", 7), ("stranger", 0x8, "f", "", 0), ("flat b", 0x20, "g", None, None)], "image_id string, rva long, function string, file string, line int")
    done = symbols.resolve(found, known.withColumn("rva", F.col("rva").cast("decimal(20,0)")))
    rows = lines(spark, f"0# a.dll!{GUID},1!10\n1# a.dll!10\n2# b.dll!{GUID},1!10\n3# c.dll!{GUID},1!10")
    assert symbols.annotate(rows, done).first().annotated == f"0# a.dll!main [m.c @ 7]\n1# a.dll!f+0x8\n2# b.dll!{GUID},1!10  (symbol not found)\n3# c.dll!{GUID},1!10  (no symbols)"


def test_source_paths_take_the_path_itself_first(spark):
    paths = spark.createDataFrame([("D:\\build\\src\\a.c",), ("D:\\build\\src\\b.c",), ("//x//c.c",), ("none",)], "path string")
    files = spark.createDataFrame([(None, "D:\\build\\src\\a.c"), (0, "a.c"), (0, "b.c"), (1, "src/b.c"), (1, "x/c.c")], "root_ord int, rel_path string")
    assert {r.path: (r.root_ord, r.rel_path) for r in symbols.source_paths(paths, files).collect()} == {"D:\\build\\src\\a.c": (None, "D:\\build\\src\\a.c"), "D:\\build\\src\\b.c": (0, "b.c"), "//x//c.c": (1, "x/c.c")}


def test_transformations_feed_each_other_and_replace_the_group(spark):
    d = lines(spark, "aa x=QUJD y=QUJD", "QUJD", "x=1 y=???", 'q="UVVK" z', None)
    rules = [r"^(?'Other'aa) ", r"y=(?'Base64Decode'\S+)", r"^(?'Base64Decode'[A-Z]{4})$", r'q=(?<Base64Decode>"\w+")', r"q=(?'Base64Decode'QUJ)"]
    got = [r.t for r in d.orderBy("line_no").select(records.transform(F.col("text"), rules).alias("t")).collect()]
    assert got == ["aa x=QUJD y=ABC", "ABC", "x=1 y=???", "q=QUJ z", None]
    chain = [r"a=(?'Base64Decode'\w+=*)", r"b=(?'Base64Decode'\w+=*)"]
    inner = base64.b64encode(b"b=QUJD").decode()
    assert lines(spark, f"a={inner}").select(records.transform(F.col("text"), chain).alias("t")).first().t == "a=b=ABC"
    assert lines(spark, "k='QUJD'").select(records.transform(F.col("text"), [r"k=(?'Base64Decode'\S+)"]).alias("t")).first().t == "k='QUJD'"


def test_durations_and_times(spark):
    cases = {0: "0 ms", -5: "0 ms", 999_999: "999 ms", 1_000_000: "1 sec", 1_249_999: "1.2 sec", 1_250_000: "1.3 sec", 59_960_000: "60 sec", 60_000_000: "1 min", 61_500_000: "1 min 1 sec", 3_600_000_000: "1 h", 7_260_000_000: "2 h 1 min", 86_400_000_000: "1 d", 93_600_000_000: "1 d 2 h"}
    d = spark.createDataFrame([(k,) for k in cases], "d long").select("d", times.show_duration(F.col("d")).alias("s"))
    assert {r.d: r.s for r in d.collect()} == cases
    shown = {(3_723_004_000, True): "01:02:03.004", (90_000_000_000, True): "01:00:00.000", (365 * times.DAY, True): "0002-01-01 00:00:00.000", (90_000_000_000, False): "1970-01-02 01:00:00.000"}
    for (t, only), s in shown.items():
        assert spark.range(1).select(times.show(F.lit(t), only).alias("s")).first().s == s
    assert spark.range(1).select(times.show(F.lit(None).cast("long"), True).alias("s")).first().s == ""


def test_formats_count_empty_lines(spark):
    rows = [(0, i, "A line" if i % 25 == 0 else "") for i in range(300)]
    d = spark.createDataFrame(rows, "file_id long, byte_offset long, text string")
    got = records.detect(d, [records.Format("capital", "^(?'Text'[A-Z].*)")]).first()
    assert got.format == "plain" and abs(got.ratio - 11 / 256) < 1e-9  # 11 of the first 256 lines


def test_hexadecimal_runs(spark):
    said = lambda s, sep="": sep.join(f"{b:02x}" for b in s.encode())
    cases = {
        "41 42 43 44 45 46 47 48 49 50": "ABCDEFGHIP", "414243444546474849": None, "0x414243444546474849": None, "0X41, 0X42, 0X43, 0X44, 0X45, 0X46, 0X47, 0X48, 0X4a": "ABCDEFGHJ",
        "41-42-43-44-45-46-47-48-4A": "ABCDEFGHJ", said("user name", ":"): "user name", said("short one")[:-2]: None, said("user name") + "0000": "user name", "".join(f"{b:02x}" for b in "Привет!!".encode("utf-16-le")): "Привет!!",
        "31 32 33 34 35 36 37 38 39": None, said("with\x01control"): None,
    }
    got = {r.token: r.decoded for r in payloads.hex_runs(lines(spark, *[f"raw {c} ok" for c in cases])).collect()}
    assert got == {c: t for c, t in cases.items() if t}


def test_base64_whole_texts_fragments_and_pem(spark):
    code = lambda s: base64.b64encode(s.encode()).decode()
    pem = f"-----BEGIN NOTE-----\n{code('twelve bytes and more')}\n-----END NOTE-----"
    d = lines(spark, code("abcdef"), f"x {code('abcdef')} y", f"x {code('a longer text')} y", pem, f"{pem} {code('a longer text')}", "-----BEGIN A-----\nQUJD\n-----END B-----", "A" * (1 << 20) + "AAAA")
    assert {(r.line_no, r.decoded) for r in payloads.base64(d).collect()} == {(0, "abcdef"), (2, "a longer text"), (4, "a longer text")}
    assert {(r.line_no, r.label, r.n_bytes) for r in payloads.pem(d).collect()} == {(3, "NOTE", 21), (4, "NOTE", 21)}
    shown = {r.line_no: r.decoded for r in payloads.decoded_text(d.filter("line_no in (2, 3)")).collect()}
    assert shown == {2: "x a longer text y", 3: "-----BEGIN NOTE-----\ntwelve bytes and more\n-----END NOTE-----"}


def test_glued_tokens_by_the_most_readable_part(spark):
    code = base64.b64encode(b"from the inside").decode().rstrip("=")
    got = payloads.glued_base64(lines(spark, f"see img/{code} and", f"see {code}_tail now", "see nothing/else_here-at+all now")).collect()
    assert {(r.line_no, r.part, r.decoded) for r in got} == {(0, code, "from the inside"), (1, code, "from the inside")}


CERTIFICATE = (
    "MIICKzCCAZSgAwIBAgICEjQwDQYJKoZIhvcNAQELBQAwIzEOMAwGA1UECgwFV2Vh"
    "dmUxETAPBgNVBAMMCGxvZy50ZXN0MB4XDTI2MTEyODE3NTkxMloXDTM2MTEyNTE3"
    "NTkxMlowIzEOMAwGA1UECgwFV2VhdmUxETAPBgNVBAMMCGxvZy50ZXN0MIGfMA0G"
    "CSqGSIb3DQEBAQUAA4GNADCBiQKBgQDCr6qKMiIy4/qJiN9peQW5ty2R5cAjW8bv"
    "fqmPZ3BrqXrriyPkOoqm+bTYMboMCP//LLEbiplaZM7iRCi4zWJ+QTAPNu5srd7S"
    "0CIs/0ixWr0yAziltVTmD7Psx+WCZeRZ7KPOmoxpvlJSqV5JmlbjF/cCcuD3jc1S"
    "88u47SH1QQIDAQABo24wbDAdBgNVHQ4EFgQU5Vs+TiQN4dJh6JIUyionu0MgPTUw"
    "HwYDVR0jBBgwFoAU5Vs+TiQN4dJh6JIUyionu0MgPTUwDwYDVR0TAQH/BAUwAwEB"
    "/zAZBgNVHREEEjAQgghsb2cudGVzdIcECgAAATANBgkqhkiG9w0BAQsFAAOBgQAl"
    "Q+7a4FeYJFAz1BXoHVpFeHY9iEQeoYnJe4vpZYkjPQ6kG507tEOjHa+bsxVfXGSj"
    "Bv5aq1wPIzsVcMb5JCBIFAyrtDcwDinouMuYn8Wr0lx/pQxOSnOXyf5TSM4s8q3h"
    "WQSdRZABlEKr2xmHOUmjdu1x9Zlr428jcg+72Nyemg=="
)
RSA_KEY = "MIGfMA0GCSqGSIb3DQEBAQUAA4GNADCBiQKBgQDCr6qKMiIy4/qJiN9peQW5ty2R5cAjW8bvfqmPZ3BrqXrriyPkOoqm+bTYMboMCP//LLEbiplaZM7iRCi4zWJ+QTAPNu5srd7S0CIs/0ixWr0yAziltVTmD7Psx+WCZeRZ7KPOmoxpvlJSqV5JmlbjF/cCcuD3jc1S88u47SH1QQIDAQAB"
EC_KEY = "MFkwEwYHKoZIzj0CAQYIKoZIzj0DAQcDQgAE77oABGqKbC9GKWfMBhkptPwvCsIF2P4ZEVpV0JaJxssRI0/Q1nfepg/zW43qx2oKQre15j/pk1wvV2+HAwkFBA=="


def test_key_blobs(spark):
    code = lambda b: base64.b64encode(b).decode()
    head = lambda bits, letters=b"RSA1", kind=0xA400: bytes([6, 2, 0, 0]) + kind.to_bytes(4, "little") + letters + bits.to_bytes(4, "little") + (65537).to_bytes(4, "little")
    modulus = bytes(range(1, 65))
    texts = [head(512) + modulus, head(512, kind=0x2400) + modulus + b"more", head(512, kind=0x1234) + modulus, head(2048) + modulus, head(510) + modulus, head(512, b"RSA2") + modulus, bytes([0x30, 0x82]) + bytes(70), base64.b64decode(RSA_KEY) + bytes(2)]
    rows = lines(spark, *[f"key {code(t)} end" for t in texts], f"key {RSA_KEY} end", f"cert {CERTIFICATE} end", f"begins otherwise {EC_KEY}", "MIIB short", "", None)
    got = {r.line_no: (r.kind, r.algorithm, r.bits, r.exponent, r.modulus) for r in payloads.key_blobs(rows).collect()}
    backwards = modulus[::-1].hex().upper()
    assert got == {
        0: ("rsa blob", "CALG_RSA_KEYX", 512, 65537, backwards), 1: ("rsa blob", "CALG_RSA_SIGN", 512, 65537, backwards), 2: ("rsa blob", "0x1234", 512, 65537, backwards),
        8: ("public key", "RSA", 1024, 65537, None), 9: ("certificate", "RSA", 1024, 65537, None),
    }


def test_keys_on_elliptic_curves():
    assert der.describe(base64.b64decode(EC_KEY)) == {"kind": "public key", "algorithm": "ECC", "bits": 256, "exponent": None}
    assert der.describe(b"") is None and der.describe(b"0") is None and der.describe(base64.b64decode(EC_KEY)[:-1]) is None


def test_certificates(spark):
    block = "\n".join(CERTIFICATE[i : i + 64] for i in range(0, len(CERTIFICATE), 64))
    pem = lambda label, b: f"-----BEGIN {label}-----\n{b}\n-----END {label}-----"
    rows = lines(spark, f"got {pem('CERTIFICATE', block)} twice", pem("NOTE", block), pem("CERTIFICATE", "QUJD"), pem("TRUSTED CERTIFICATE", CERTIFICATE), None)
    got = {r.line_no: r for r in payloads.certificates(rows).collect()}
    assert set(got) == {0, 3}
    c = got[0]
    assert (c.label, c.subject, c.issuer, c.serial, c.names) == ("CERTIFICATE", "CN=log.test, O=Weave", "CN=log.test, O=Weave", "1234", ["log.test", "10.0.0.1"])
    assert (c.not_before, c.not_after, c.signature) == ("2026-11-28 17:59:12 UTC", "2036-11-25 17:59:12 UTC", "sha256RSA")
    assert (c.thumbprint, c.algorithm, c.bits, c.exponent) == ("BA1A6F90CE2EBB55CC77CC179EC194D1194CFF4C", "RSA", 1024, 65537)


def test_times_without_a_layout(spark):
    day = "2024-03-05"
    cases = {
        "2024-03-05 01:02:03.004": f"{day} 01:02:03.004", "2024-03-05 01:02:03": f"{day} 01:02:03.000", "2024-03-05T01:02:03.5": f"{day} 01:02:03.500", "2024-03-05T01:02:03.1234567Z": f"{day} 01:02:03.123",
        "2024-03-05T01:02:03+02:00": "2024-03-04 23:02:03.000", "2024-3-5": f"{day} 00:00:00.000", "2024/03/05 1:02": f"{day} 01:02:00.000", "03/05/2024 13:02:03": f"{day} 13:02:03.000", "3/5/2024 1:02:03 PM": f"{day} 13:02:03.000",
        "Tue, 05 Mar 2024 01:02:03 GMT": f"{day} 01:02:03.000", "5 March 2024": f"{day} 00:00:00.000", "Mar 5, 2024 12:30 am": f"{day} 00:30:00.000", "March 5, 2024": f"{day} 00:00:00.000", " 2024-03-05 ": f"{day} 00:00:00.000",
        "2024-13-05": "", "2024-02-30 10:00:00": "", "yesterday": "", "": "", "10:00:00": "", None: "",
    }
    d = spark.createDataFrame([(k,) for k in cases], "t string").select("t", times.show(times.parse(F.col("t"))).alias("s"))
    assert {r.t: r.s for r in d.collect()} == cases


def test_headers_only_before_records(spark):
    rows = [(0, 0, "title"), (0, 1, "  \t"), (0, 2, "A one"), (0, 3, "rest"), (1, 0, "A only"), (2, 0, "no record"), (2, 1, "at all")]
    d = spark.createDataFrame(rows, "file_id long, byte_offset long, text string")
    fmt = records.Format("capital", "^(?'Text'[A-Z].*)")
    assert [tuple(r) for r in records.headers(d, fmt).collect()] == [(0, "title")]
    assert sorted(tuple(r) for r in records.records(d, fmt).collect()) == [(0, 0, 2, "A one\nrest"), (1, 0, 0, "A only")]


def test_saved_searches_by_name_or_pattern(spark):
    d = spark.createDataFrame([("Errors", "ERROR .*"), ("slow", "took [0-9]+"), ("x", "an error")], "name string, pattern string")
    names = lambda typed: sorted(r.name for r in search.saved(d, typed).collect())
    assert names("erRor") == ["Errors", "x"] and names("SLOW") == ["slow"] and names(" ") == ["Errors", "slow", "x"] and names("none") == []


def mappings(spark, rows):
    return spark.createDataFrame(rows, "list string, ord int, item int, enabled boolean, ignore_case boolean, fields array<string>, value string, mapping string")


def test_dictionaries(spark, monkeypatch):
    m = mappings(spark, [
        ("a", 0, 0, True, False, None, " 404 ", "not found"), ("a", 0, 1, True, False, None, "404", "second"), ("a", 0, 2, True, False, None, "E-1", "e one"), ("a", 0, 3, True, False, None, "E-1.2", "longer"),
        ("b", 1, 0, True, True, None, "ok!", "fine"), ("b", 1, 1, True, True, None, "404", "later list"), ("c", 2, 0, True, False, ["Code"], "7", "seven"), ("d", 3, 0, False, False, None, "off", "never"), ("e", 4, 0, True, False, None, "->", "arrow"),
        ("e", 4, 1, True, False, None, "[x]", "box"), ("e", 4, 2, True, False, None, "", "empty"),
    ])
    d = lines(spark, "404 and 4041 x404 E-1.2 E-1 e-1", "OK!x ok! ok 7", "a->b [x][x] off", None, "")
    want = {0: "404(not found) and 4041 x404 E-1.2(longer) E-1(e one) e-1", 1: "OK!(fine)x ok!(fine) ok 7", 2: "a->(arrow)b [x](box)[x](box) off", 3: None, 4: ""}
    assert {r.line_no: r.annotated for r in dictionaries.annotate(d, m).collect()} == want
    key = lambda r: (r.line_no, r.i, r.token, r.start, r.list, r.mapping)
    by_pattern = sorted(map(key, dictionaries.occurrences(d, m).collect()))
    monkeypatch.setattr(dictionaries, "MOST_VALUES", 3)  # more values than a pattern takes
    assert sorted(map(key, dictionaries.occurrences(d, m).collect())) == by_pattern and len(by_pattern) == 8
    monkeypatch.undo()
    rows = d.withColumn("Code", F.lit("7 x 404")).withColumn("Other", F.lit("7"))
    found = dictionaries.occurrences_in_fields(rows.limit(1), m, ["Code", "Other"]).collect()
    assert {(r.field, r.token, r.mapping) for r in found} == {("Code", "7", "seven"), ("Code", "404", "not found")}


def test_search_in_a_range_of_records(spark):
    d = lines(spark, *[f"row {i} {'hit' if i % 3 == 0 else ''}" for i in range(20)])
    assert [r.line_no for r in d.filter("line_no >= 4 and line_no < 13").filter(search.matches("HIT", False, False)).orderBy("line_no").collect()] == [6, 9, 12]


def test_export_writes_marked_rows(spark, tmp_path):
    d = lines(spark, "a \r\n", "b\0c", "d", "e")
    m = spark.createDataFrame([(0, 0, 1), (0, 3, 9), (0, 5, 4)], "file_id long, start long, end long")
    marks.write_export(d, m, str(tmp_path / "out"))
    parts = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part"))
    assert b"".join(p.read_bytes() for p in parts) == b"a\r\nbc\r\ne\r\n"


def test_table_functions_from_sql(spark):
    tables.register(spark)
    code = base64.b64encode(b"a longer text").decode()
    lines(spark, f"see {code} x1 x22", f"0# a.dll!{GUID},1!ff", "raw 75 73 65 72 20 6e 61 6d 65 ok").createOrReplaceTempView("some_records")
    assert [tuple(r) for r in spark.sql("select line_no, s.* from some_records, lateral log_spans(text, 'x[0-9]+') s").collect()] == [(0, 25, 2, "x1"), (0, 28, 3, "x22")]
    assert [(r.number, r.module, int(r.rva), r.start) for r in spark.sql("select f.* from some_records, lateral log_frames(text) f").collect()] == [(0, "a.dll", 255, 0)]
    assert {(r.kind, r.start, r.decoded) for r in spark.sql("select p.* from some_records, lateral log_payloads(text) p").collect()} == {("base64", 4, "a longer text"), ("hex", 4, "user name")}


def test_export_saves_what_a_copy_refuses(spark):
    long = "x" * 1_000_000
    d = spark.range(70).select(F.lit(0).alias("file_id"), F.col("id").alias("line_no"), F.concat(F.lit(long), F.col("id").cast("string"), F.lit(" ")).alias("text"))
    m = spark.createDataFrame([(0, 0, 69)], "file_id int, start long, end long")
    assert [r.n for r in marks.export(d, m).select(F.length("value").alias("n")).collect()] == [1_000_001] * 10 + [1_000_002] * 60
    with pytest.raises(ValueError, match="more than"):
        marks.export(d.limit(3), m, limit=3_000_008)
    assert marks.export(d.limit(3), m, limit=3_000_009).count() == 3


def test_frames_are_read_once(spark):
    found = symbols.symbol_files(symbols.identity(symbols.frames(lines(spark, "1# a!ff\n2# b!1"))), spark.createDataFrame([(0, "a.pdb", True, None, None, "x")], "store_ord int, file_name string, flat boolean, index string, other_index string, image_id string"))
    known = spark.createDataFrame([("x", 0x8, "f", "", 0)], "image_id string, rva long, function string, file string, line int").withColumn("rva", F.col("rva").cast("decimal(20,0)"))
    done = symbols.resolve(found, known)
    assert "EvalPython" not in done._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.number, r.function) for r in done.collect()} == {(1, "f"), (2, None)}


def test_frames_equal_the_rules_step_by_step(spark):
    tables.register(spark)
    rng = random.Random(3)
    parts = ["1", "0", "99", "#", "#", " ", "\t", "a", "é", "m.dll", "!", "!", "+", "+0x", "0x", "0X", "ff", "1F", f"!{GUID},1!", f"{GUID}", ",", "\r", " ", "\x85", " ", "\n"]
    texts = ["".join(rng.choice(["", " ", "\t"]) + rng.choice(["1#", "02# ", "2147483648#", "x"]) + "m" * (rng.random() < 0.8) + "".join(rng.choice(parts) for _ in range(rng.randint(0, 4))) + "\n" for _ in range(3)) for _ in range(3000)]
    rows = lines(spark, *texts)
    rows.createOrReplaceTempView("odd_frames")
    told = spark.sql("select line_no, f.* from odd_frames, lateral log_frames(text) f")
    got = symbols.frames(rows).select(*told.columns)
    assert told.count() > 80 and not told.exceptAll(got).count() and not got.exceptAll(told).count()


def test_values_reach_python_once_each(spark):
    found = payloads.base64_values(payloads.leaves(lines(spark, '{"a": "aW5uZXIgdGV4dCBoZXJl", "b": "plain", "c": null, "d": 1}', None).withColumnRenamed("text", "payload")), "value")
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 2  # one reads the leaves, one the values
    assert [tuple(r) for r in found.collect()] == [(0, 0, "inner text here")]
    blobs = payloads.rsa_blobs(lines(spark, "none"))
    assert blobs._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1  # each token is decoded once


def test_toggle_lays_out_what_each_file_has(spark):
    s = lambda *r: spark.createDataFrame(list(r), "file_id long, start long, end long")
    got = marks.toggle(s((0, 0, 10), (1, 0, 3), (2, 5, 6)), s((0, 3, 4), (1, 3, 4), (3, 1, 2)))
    assert "bool_or" not in got._jdf.queryExecution().analyzed().toString()  # no join with an aggregate of all pieces
    assert sorted(map(tuple, got.select("file_id", "start", "end").collect())) == [(0, 0, 2), (0, 5, 10), (1, 0, 4), (2, 5, 6), (3, 1, 2)]
