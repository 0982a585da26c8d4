"""Exact search, n-gram join and substring dedup against brute force."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from logweave.llm import ngram_join, substrings, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part int, id string, n int"


def frame(spark, rows):
    """Documents with extra columns whose names clash with those in use inside."""
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, "x", 2) for i, t in rows], DOCS)


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(900, 6)).astype(np.float32)
    v[100:400] = v[50]  # a third are equal
    rows = [(i, x.tolist(), 7) for i, x in enumerate(v)] + [(2000, None, 0), (2001, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0), (2002, [float("nan")] * 6, 0), (2003, [float("inf")] * 6, 0), (None, [1.0] * 6, 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, block int")
    got = topk.search(d, F.col("vec_id") % 100 == 0)
    out = {}
    for r in got.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    w = np.floor(1024 * v.astype(np.float64)).astype(np.int64)
    for q in range(0, 900, 100):
        s = w @ w[q]
        best = sorted((i for i in range(900) if i != q), key=lambda i: (-s[i], i))[:10]
        assert sorted(out[q]) == [(k + 1, i, s[i]) for k, i in enumerate(best)]
    assert set(out) == set(range(0, 900, 100))


def test_topk_of_little_and_nothing(spark):
    d = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0]), (100, [0.0, -1.0])], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(d, F.col("vec_id") % 100 == 0).collect())
    assert got == [(0, 1, 1, 1 << 20), (0, 2, 100, -(1 << 21)), (100, 1, 1, 0), (100, 2, 0, -(1 << 21))]
    assert topk.search(d.filter("vec_id < 0"), F.lit(True)).count() == 0


def brute_topk(w, k=10):
    """The k best of each vector whose number is divisible by 100: rank, number, score."""
    found = {}
    for q in range(0, len(w), 100):
        score = w @ w[q]
        best = np.lexsort((np.arange(len(w)), -score))
        found[q] = [(r + 1, i, score[i]) for r, i in enumerate(best[best != q][:k].tolist())]
    return found


def test_topk_of_many_rings_strips_and_ties(spark, monkeypatch):
    for name, value in (("PER_RING", 40), ("BLOCK", 64), ("QUERIES", 8), ("PART", 500), ("FIRST", 60)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(4)
    few = np.floor(rng.normal(size=(3000, 3)) * 2) / 1024  # few numbers: many scores tie
    few[:500] = 0
    grouped = rng.normal(size=(60, 8))[rng.integers(0, 60, 3000)] + rng.normal(size=(3000, 8)) / 20  # rings are left out
    large, huge = rng.normal(size=(3000, 4)) * 1000, rng.normal(size=(3000, 4)) * 1e5  # beyond single, beyond double precision
    for v in (few, grouped, large, huge):
        d = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
        out = {}
        for r in topk.search(d, F.col("vec_id") % 100 == 0).collect():
            out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        assert {q: sorted(x) for q, x in out.items()} == brute_topk(np.floor(v * 1024).astype(np.int64))


def test_topk_of_repeated_rows_and_ids(spark):
    rows = [(0, [1.0, 0.0])] * 30 + [(i, [1.0, 0.0]) for i in range(1, 41)] + [(5, [1.0, 0.0])] * 3 + [(3, [2.0, 0.0]), (3, [2.0]), (50, [0.5])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = {}
    for r in topk.search(d, F.col("vec_id") % 5 == 0, k=6).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score >> 20))
    assert sorted(out[0]) == [(1, 3, 2), (2, 3, 2), (3, 1, 1), (4, 2, 1), (5, 3, 1), (6, 4, 1)]
    assert sorted(out[10]) == [(1, 3, 2), (2, 3, 2), *((r, 0, 1) for r in range(3, 7))]


def test_topk_of_empty_and_unequal_lists(spark):
    def found(rows):
        d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(d, F.col("vec_id") % 100 == 0).collect())

    assert found([(0, []), (1, []), (100, [])]) == [(0, 1, 1, 0), (0, 2, 100, 0), (100, 1, 0, 0), (100, 2, 1, 0)]
    least = [(0, [1.0]), (0, [1.0, -2.0]), (1, [1.0, 1.0]), (2, [0.5, 2.0])]  # the first asks
    assert found(least) == [(0, 1, 1, 1 << 20), (0, 2, 2, 1 << 19)]
    assert found([(0, [1e30, 1.0]), (1, [0.0, -1.0]), (2, [0.0, 2.0])]) == [(0, 1, 2, 1 << 21), (0, 2, 1, -(1 << 20))]


def test_topk_exchanges_no_pairs(spark):
    """What is exchanged grows with the rows, not with pairs of queries and blocks."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def stages():
        found = store.stageList(None, False, False, none, None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteBytes() for i in range(found.size())}

    def exchanged(v):
        d = spark.createDataFrame(list(enumerate(v.tolist())), "vec_id long, embedding array<float>").repartition(4).cache()
        d.count()
        before = stages()
        assert topk.search(d, F.lit(True)).count() == 10 * len(v)
        return sum(n for i, n in stages().items() if i not in before)

    v = np.random.default_rng(6).normal(size=(4000, 64)).astype(np.float32)
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as of tables that are too large for it
    try:
        few, many = exchanged(v[:1000]), exchanged(v)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert many < 6 * few, (few, many)  # four times the rows, sixteen times the pairs


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def linked(sets):
    """Links (a, b) of a list of sets, and the smallest number reachable from each."""
    links = [(a, b) for b in range(len(sets)) for a in range(b) if (both := len(sets[a] & sets[b])) and 100 * both >= 80 * len(sets[a] | sets[b])]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return links, [root(x) for x in range(len(sets))]


def near_copies(rnd):
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(rnd.choices(words, k=rnd.choice([3, 6, 8, 12, 30, 80, 200])))))
    base = rows[-1][1].split() + rnd.choices(words, k=100)
    for k in range(60):  # near copies with more and more edits, chains among them
        t = list(base)
        for _ in range(rnd.randint(0, 6)):
            t[rnd.randrange(len(t))] = "Edit"
        rows.append((100 + k, " ".join(t)))
    rows += [(200 + k, rows[5][1].upper()) for k in range(5)] + [(300, None), (301, ""), (302, " \n\t"), (303, "one two"), (304, "One  TWO"), (305, "x" * 100_000), (306, "u v w x y z " * 20_000), (None, rows[5][1]), (None, None), (7, rows[7][1])]
    return rows


def test_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 7)
    rows = near_copies(random.Random(3))
    sets = {i: shingles(t) for i, t in rows if i is not None}
    ids = sorted(sets)
    links, roots = linked([sets[i] for i in ids])
    root = dict(zip(ids, (ids[r] for r in roots), strict=True))
    times = {i: sum(d == i for d, _ in rows) for i in ids}
    count = {i: times[i] - 1 if sets[i] else 0 for i in ids}
    for a, b in links:
        count[ids[a]] += times[ids[b]]
        count[ids[b]] += times[ids[a]]
    for all_links in (False, True):
        out = ngram_join.join(frame(spark, rows), all_links=all_links)[0].collect()
        assert len(out) == len(rows)
        for r in out:
            if r.doc_id is not None:
                assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), root[r.doc_id]), r
                assert not all_links or r.n_links == count[r.doc_id], r
            else:
                assert r.component_id is None
    kept = ngram_join.one_of_each(frame(spark, rows))
    assert kept.columns == frame(spark, []).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(root.values()))
    assert ngram_join.join(frame(spark, []))[0].count() == 0


def test_join_loses_no_link_of_an_id_on_two_texts(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, None), (4, "")]
    out = sorted((r.doc_id, r.component_id, r.n_shingles) for r in ngram_join.join(frame(spark, rows))[0].collect())
    assert out == [(1, 1, 56), (1, 1, 56), (2, 1, 57), (3, 1, 57), (4, 4, 0), (4, 4, 0)]
    assert sorted(r.text or "" for r in ngram_join.one_of_each(frame(spark, rows)).collect()) == ["", a, b]
    twice = frame(spark, [(1, a)] * 2).unionByName(frame(spark, [(1, a)]).withColumn("lang", F.lit("de")))
    assert [r.lang for r in ngram_join.one_of_each(twice).collect()] == ["de"]  # first as JSON


def test_join_by_subsets_where_they_cost_less(spark, monkeypatch):
    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choices("xyz", k=rnd.randint(9, 14)))) for i in range(600)]
    chosen, choose = [], ngram_join._boundary
    monkeypatch.setattr(ngram_join, "_boundary", lambda sets: chosen.append(choose(sets)) or chosen[-1])
    out = {r.doc_id: r.component_id for r in ngram_join.join(frame(spark, rows))[0].collect()}
    assert chosen[0] > 0
    assert [out[i] for i in range(600)] == linked([shingles(t) for _, t in rows])[1]


def brute_removal(rows, length=50):
    first, out = {}, []
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        if i is not None:
            for k in range(len(b) - length + 1):
                w = b[k : k + length]
                first[w] = min(i, first.get(w, i))
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if i is not None and first[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def test_substrings_equal_brute_force(spark):
    rnd = random.Random(5)
    text = lambda n: "".join(rnd.choices("abcdefgh éßñ\n", k=n))
    shared = [text(n) for n in (49, 50, 51, 80, 300)]
    rows = []
    for i in range(40):
        rows.append((i, text(rnd.randint(0, 200)) + "".join(s + text(rnd.randint(0, 20)) for s in rnd.sample(shared, rnd.randint(0, 3)))))
    rows += [(50, rows[3][1]), (51, rows[3][1]), (52, None), (53, ""), (54, "a" * 300), (55, "a" * 120), (None, rows[3][1]), (3, rows[3][1]), (56, "ab" * 60_000), (57, "x" + "ab" * 60), (58, shared[1]), (59, shared[0])]
    got = sorted(((tuple(r)) for r in substrings.remove_repeats(frame(spark, rows)).collect()), key=str)
    assert got == sorted(brute_removal(rows), key=str)
    assert substrings.remove_repeats(frame(spark, [])).count() == 0


def test_long_texts_are_cut_to_strips_without_a_seam(spark, monkeypatch):
    rnd = random.Random(6)
    one = "".join(rnd.choices("abc", k=5000))
    rows = [(1, one), (2, "zz" + one[1000:4200] + "yy"), (3, one[4990:] + "q")]
    import pyarrow as pa

    monkeypatch.setattr(substrings, "STRIP", 700)
    table = pa.table({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows], "part": pa.array([0] * 3, pa.int32())})
    t = substrings._Texts(table, 50)
    t.anchors()
    assert int((t.last - t.first + 1).sum()) == sum(max(0, len(x) - 49) for _, x in rows)
