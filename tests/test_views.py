from pyspark.sql import functions as F

from logweave.operators import dictionaries, filters, marks, merge, search, sequences, symbols


def rows(spark, texts):
    return spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "file_id long, line_no long, text string")


def test_search_forms(spark):
    d = rows(spark, ["Alpha beta.1\r\n", "beta ALPHA", "beta.1 then alpha", ""])
    found = lambda c: [r.line_no for r in d.filter(c).orderBy("line_no").collect()]
    assert found(search.matches("alpha", regex=False)) == [0, 1, 2]
    assert found(search.matches("beta.1$")) == [0]
    assert found(search.matches("beta.1", regex=False, case=True)) == [0, 2]
    assert found(search.matches(search.in_order(["beta.1", "alpha"]))) == [2]


def test_hits_neighbours_and_spans(spark):
    d = rows(spark, ["x", "aXa", "x", "xx"])
    h = search.hits(d, search.matches("a", case=True))
    assert [(r.line_no, r.hit) for r in h.collect()] == [(1, 0)]
    anchors = spark.createDataFrame([(0, 1), (0, 0)], "file_id long, anchor long")
    near = search.neighbours(d.filter("text like '%x%'").select("file_id", "line_no"), anchors)
    assert sorted((r.anchor, r.next_hit, r.previous_hit) for r in near.collect()) == [(0, 2, 3), (1, 2, 0)]
    s = search.spans(d, "x", case=False).orderBy("line_no", "start").collect()
    assert [(r.line_no, r.start) for r in s] == [(0, 0), (1, 1), (2, 0), (3, 0), (3, 1)]


def test_filter_algebra():
    f = filters.Filter().add("a", ["x"]).add("a", ["y"]).put("b", ["z"])
    assert f.excluded == {"a": {"x", "y"}, "b": {"z"}} and f.clear("a").excluded == {"b": {"z"}} and f.clear().excluded == {}


def test_merge_keeps_time_source_and_record_order(spark):
    a = spark.createDataFrame([(i, 200 * (i + 1), "I", f"A{i}") for i in range(12)], "line_no long, ts_norm long, Level string, Message string")
    b = spark.createDataFrame([(i, 200 * (i + 2), "I", f"B{i}") for i in range(12)], "line_no long, ts_norm long, severity string, message string")
    p = spark.createDataFrame([(i, 0, f"P{i}") for i in range(4)], "line_no long, ts_norm long, Text string")
    sources = [merge.Source(a, ("Level", "Message"), frozenset({"Level"}), True), merge.Source(b, ("severity", "message"), frozenset(), True), merge.Source(p, ("Text",), frozenset(), False)]
    assert [(n, i) for n, i, _ in merge.merged_schema(sources)] == [("severity", True), ("Message", False)]
    m = merge.merge(sources).orderBy("pos").collect()
    assert [r.pos for r in m] == list(range(28)) and [r.Message for r in m[-4:]] == ["P0", "P1", "P2", "P3"]
    assert [r.Message for r in m[:4]] == ["A0", "A1", "B0", "A2"]  # at equal times the first source is first
    kept = merge.merge(sources).filter(filters.merged_times(400, 800)).count()
    assert kept == 6 + 4


def test_runs_and_segments(spark):
    threads = "AAABBCDDDD"
    d = spark.createDataFrame([(0, i, t, i * 10) for i, t in enumerate(threads)], "file_id long, line_no long, t string, ts_norm long")
    for chunk in (2, 100):
        out = sequences.thread_runs(d, "t", chunk).orderBy("run").collect()
        assert [(r.thread, r.n, r.duration) for r in out] == [("A", 3, 20), ("B", 2, 10), ("C", 1, 0), ("D", 4, 30)]
    m = sequences.thread_marks(d, "t", order="line_no").orderBy("line_no").collect()
    assert [r.first for r in m] == [c not in threads[max(0, i - 1) : i] for i, c in enumerate(threads)] and [r.last for r in m].index(True) == 9


def test_row_sets(spark):
    def s(*r):
        return spark.createDataFrame([(0, a, b) for a, b in r], "file_id long, start long, end long")

    get = lambda d: sorted((r.start, r.end) for r in d.collect())
    assert get(marks.normalise(s((5, 7), (1, 2), (3, 3), (9, 8), (6, 10)))) == [(1, 3), (5, 10)]
    assert get(marks.subtract(s((0, 10)), s((3, 4), (10, 20)))) == [(0, 2), (5, 9)]
    assert get(marks.intersect(s((0, 10)), s((3, 4), (10, 20)))) == [(3, 4), (10, 10)]
    assert get(marks.restore(s((0, 10)), s((5, 6)), s((4, 12)))) == [(0, 3), (5, 6)]
    assert get(marks.toggle(s((0, 10)), s((3, 4)))) == [(0, 2), (5, 10)] and get(marks.toggle(s((0, 3)), s((3, 4)))) == [(0, 4)]
    assert marks.size(s((0, 3), (2, 5))).first().n == 6


def test_dictionary(spark, tmp_path):
    (tmp_path / "codes.json").write_text('{"E1": "disk", // note\n "E12": "network",}')
    (tmp_path / "lists.json").write_text('[{"name": "L", "ignoreCase": true, "items": [{"value": "ok", "mapping": "fine"},]}]')
    m = dictionaries.read(spark, str(tmp_path)).withColumn("ord", F.lit(0))
    assert sorted((r.list, r.value, r.mapping) for r in m.collect()) == [("L", "ok", "fine"), ("codes", "E1", "disk"), ("codes", "E12", "network")]
    d = rows(spark, ["E12 then E1, OK E123 xE1", "none"])
    out = [r.annotated for r in dictionaries.annotate(d, m).orderBy("line_no").collect()]
    assert out == ["E12(network) then E1(disk), OK(fine) E123 xE1", "none"]
    new = dictionaries.upsert(m, m.filter("list = 'L'").withColumn("list", F.lit(" l ")).withColumn("mapping", F.lit("good")))
    assert sorted((r.list.strip(), r.mapping) for r in new.collect()) == [("codes", "disk"), ("codes", "network"), ("l", "good")]


def test_rules(spark):
    d = rows(spark, ["error a", "warn", "error b", "x"])
    out = dictionaries.classify(d, ["b$", "error", "warn"]).orderBy("line_no").collect()
    assert [r.rule for r in out] == [1, 2, 0, None]


def test_symbols_as_of(spark):
    frames = spark.createDataFrame([("i", 15, "m", 1), ("i", 5, "m", 2), (None, 5, "m", 3)], "image_id string, rva long, module string, number int").withColumn("rva", F.col("rva").cast("decimal(20,0)"))
    table = spark.createDataFrame([("i", 10, "f", "a.c", 3), ("i", 20, "g", "a.c", 9)], "image_id string, rva long, function string, file string, line int").withColumn("rva", F.col("rva").cast("decimal(20,0)"))
    out = {r.number: (r.function, r.status) for r in symbols.resolve(frames, table).collect()}
    assert out == {1: ("f", "resolved"), 2: (None, "not resolved"), 3: (None, "no symbols")}
