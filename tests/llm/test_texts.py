"""Operators on single documents: tokens, mixing, sharding, licenses, decontamination, classifiers, pipeline."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logweave.llm import decontaminate, licenses, mixing, quality, sharding, tokens, toxicity
from logweave.llm.common import scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keyword string, size string"


def frame(spark, rows):
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0, "k", "z") for r in rows], DOCS)


def test_tokens_equal_plain_encoding(spark):
    from tokenizers import Tokenizer

    texts = [None, "", " ", "Hello, world! It's don't.'s x", "<|endoftext|> A.<|startoftext|>", "É.È,ñ!? ×.y ÷,z İI. K.k", "a\x1cb\x85c\xa0d　e", "é. x̣́.y", "1,2.3:4;5 'll ''s", "日本語。テスト.", "🙂.🙃", "x" * 5000, "'re.'ve,'d.T", "A.B,C!D?E;F:G"]
    rows = [(len(texts) - i, t) for i, t in enumerate(texts)] + [(3, "again"), (None, "no id")]
    out = scratch(spark, "tokens")
    path = tokens.tokenizer_path()
    tokens.write(frame(spark, rows), out, path)
    t = Tokenizer.from_file(path)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    expected, start = [], 0
    for i, x in order:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        expected.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [(r.doc_id, r.n_tokens, r.ids_crc32) for r in tokens.describe(spark, out).orderBy("start").collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected))
    starts = [(r.start, r.n_tokens) for r in tokens.describe(spark, out).orderBy("start").collect()]
    assert [s for s, _ in starts] == list(np.cumsum([0, *[n for _, n in starts]])[:-1]) and starts[-1][0] + starts[-1][1] == start
    assert tokens.read(spark, out).filter("doc_id = 5").count() == 1
    empty = scratch(spark, "tokens")
    tokens.write(frame(spark, []), empty, path)
    assert tokens.describe(spark, empty).count() == 0


def test_mixing_targets(spark):
    rows = [(i, "w " * (i % 7 + 1), s) for i, s in enumerate(["a"] * 60 + ["b"] * 30 + ["c"] * 200 + [None] * 10 + ["d"] * 5)] + [(900, None, "a"), (901, "", "e"), (None, "x y", "b"), (5, "w w", "a")]
    out = mixing.plan(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    names = sorted((s for s in sizes if s is not None)) + [None]
    weights, targets, capped = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, {}, set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        targets = {s: 2.0 * sizes[s] if s in capped else left * weights[s] / sum(weights[x] for x in free) for s in names}
        over = {s for s in free if targets[s] > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    taken = {}
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source]) and r.taken <= 2 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in names:
        assert abs(taken[s] - targets[s]) <= max(12, 0.1 * targets[s])
    again = sorted(str(tuple(r)) for r in mixing.plan(frame(spark, rows)).collect())
    assert again == sorted(str(tuple(r)) for r in out)
    mixed = mixing.mix(frame(spark, rows))
    assert mixed.columns == frame(spark, []).columns and mixed.count() == sum(r.copies for r in out)
    assert mixing.plan(frame(spark, [])).count() == 0


def test_sharding_fits_and_splits_only_what_is_too_large(spark):
    rows = [(i, "x" * (i % 90)) for i in range(400)] + [(500, "y" * 3000), (501, None), (None, "n" * 50), (None, "m" * 50)] + [(7, "z" * 300)] * 9
    out = sharding.assign(frame(spark, rows), 1000).collect()
    assert len(out) == len(rows)
    held = {}
    for r in out:
        held.setdefault((r.depth, r.prefix, r["sub"]), []).append(r)
    for (depth, _, _), rs in held.items():
        total = sum(r.n_bytes for r in rs)
        assert all(r.shard_bytes == total for r in rs) and (total <= 1000 or (depth == -1 and len(rs) == 1))
    assert any(r.depth == 60 for r in out if r.doc_id == 7)
    parents = {}
    for (depth, prefix, _), rs in held.items():
        for up in range(depth):
            parents[up, prefix >> (depth - up)] = parents.get((up, prefix >> (depth - up)), 0) + sum(r.n_bytes for r in rs)
    assert all(v > 1000 for v in parents.values())
    assert sharding.assign(frame(spark, [])).count() == 0


def test_license_scan(spark):
    texts = ["Licensed under the Apache License, Version 2.0.", "MIT License mit-license", "cc-by and CC BY 4.0", "GNU General\nPublic License; gnu general public licenses", "K mit licenſe", None, "", "mit mit license license", "accby cc bye cc  by", "Licensed under CC BY-NC 4.0.", "x " * 3000 + "apache license"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, "mit license")]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    out = licenses.scan(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    for i, t in rows:
        w = word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        at, names = [], set()
        for p, label in licenses.BASE.items():
            p = p.split()
            here = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            at += here
            names |= {label} if here else set()
        r = by[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(names))), (i, r)
        assert names <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert by[0].labels == "apache,apache-2.0" and "cc-by-nc-4.0" in by[9].labels and len(licenses.rules()) > 200
    assert licenses.scan(frame(spark, [])).count() == 0


def brute_labels(text):
    """Labels and score by every rule on every text, without keywords; overlaps settled pair by pair."""
    import regex

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w = word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    norm = f" {' '.join(w)} " if w else "  "
    base = {label for p, label in licenses.BASE.items() if f" {p} " in norm}
    spans = []
    for rule, _, pattern, label, versioned, priority, sure in licenses.rules():
        for m in regex.finditer(pattern, norm):
            version = regex.search(r"([0-9]+(?: [0-9]+)?)$", m.group())
            name = f"{label}-{version.group(1).replace(' ', '.')}" if versioned and version else label
            spans.append((m.start(), -m.end(), -priority, rule, name, sure))
    left = [s for s in spans if not any(o[:4] < s[:4] and o[0] <= s[0] and o[1] <= s[1] and o[2] <= s[2] for o in spans)]
    return ",".join(sorted(base | {s[4] for s in left})), max([0.5] * bool(base) + [s[5] for s in left], default=0.0)


def test_license_labels_equal_brute_force(spark):
    rnd = random.Random(9)
    pieces = [
        "Licensed under the Apache License, Version 2.0", "http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: MIT", "SPDX-License-Identifier: Apache-2.0 OR MIT", "GNU General Public License v3",
        "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", "released under the terms of the GNU Lesser General Public License version 2.1", "Permission is hereby granted, free of charge, to any person obtaining a copy",
        "https://creativecommons.org/licenses/by-nc-sa/4.0/", "CC BY-SA 4.0", "This is free and unencumbered software released into the public domain.", "Mozilla Public License, v. 2.0", "https://opensource.org/licenses/MIT",
        "Expat License", "3-clause BSD license", "the MIT License (MIT)", "GPLv3", "mit licence", "Redistribution and use in source and binary forms, with or without modification, are permitted", "Boost Software License 1.0", "Apache License, Version 2.0, January 2004",
        "You should have received a copy of the GNU Affero General Public License", "cc0", "Dual BSD/GPL", "gnu org licenses gpl-3.0.en.html", "lorem ipsum", "dolor", "licensed", "public", "2.0", "version", "under the",
    ]
    rows = [(i, rnd.choice([" ", "\n", ". "]).join(rnd.choices(pieces, k=rnd.randint(1, 6)))) for i in range(120)] + [(500, None), (501, ""), (502, "x " * 50_000 + "SPDX-License-Identifier: ISC"), (0, "mit license"), (None, "mit license")]
    got = sorted((str(r.doc_id), r.labels, r.score) for r in licenses.scan(frame(spark, rows)).collect())
    assert got == sorted((str(i), *brute_labels(t)) for i, t in rows)


def test_license_rules_pass_their_gates(spark):
    written = len(licenses.FAMILIES) + len(licenses.SPDX) + len(licenses.BODIES) + len(licenses.SIGNATURES)
    assert written > 200
    for _, keyword, pattern, *_ in licenses.rules():
        plain = pattern.replace("licen[sc]", "licenc")
        assert any(g in plain for g in licenses.GATES) or pattern.startswith("(?<= )cc by"), pattern
    for keyword, sentence, _ in licenses.SIGNATURES:
        assert re.search(rf"(?<![a-z0-9]){keyword}(?![a-z])", sentence), (keyword, sentence)


def edit_distance_inside(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row)


def test_decontamination_equals_alignment(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choices("abcdefghij", k=rnd.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rnd.randint(12, 30)))) for i in range(8)] + [(90, None), (91, "tiny"), (92, "")]
    rows = []
    for i in range(80):
        t = list(items[i % 8][1])
        for _ in range(i // 8):
            k = rnd.randrange(len(t))
            t[k : k + 1] = rnd.choice([[], [t[k], "z"], ["q"]])
        rows.append((i, f"{word()}, {''.join(t).upper()}!\n{word()}" if i % 3 else " ".join(word() for _ in range(40)) + "".join(t[: len(t) // 2])))
    rows += [(100, None), (101, ""), (None, items[0][1]), (102, "It is Tiny, one-two."), (103, "tinyx 1one two3"), (104, "filler words " * 60_000 + items[3][1]), (104, "filler words " * 60_000 + items[3][1])]
    items += [(93, "One  two!")]
    for n in (12, 16, 17, 20, 23, 24, 33, 34, 35, 36):  # around the sizes at which the q-grams or the edits change
        items.append((200 + n, "".join(rnd.choices("klmnopqrst", k=n))))
        for k in range(8):
            t = list(items[-1][1])
            for _ in range(k % 4):
                at = rnd.choice([n // 2, rnd.randrange(len(t))])
                t[at : at + 1] = rnd.choice([[], [t[min(at, len(t) - 1)], "z"], ["u"]])
            rows.append((1000 + 10 * n + k, f"{word()} {''.join(t)}, {word()}"))
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.find(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    plain = lambda t: re.sub(r"[^0-9a-z]+", " ", (t or "").lower()).strip()
    budget = {i: len(plain(t)) * 6 // 100 for i, t in items}
    assert budget[217] == budget[223] == 1 and budget[234] == budget[235] == 2
    assert {200 + n for n in (17, 20, 23, 34, 35)} <= {i for (_, i), e in got.items() if e == budget[i]}
    for d, t in rows:
        for i, item in items:
            if item and len(plain(item)) < decontaminate.Q:
                assert ((d, i) in got) == (f" {plain(item)} " in f" {plain(t)} ")
            elif item and d != 104:
                e = edit_distance_inside(plain(item), plain(t))
                assert ((d, i) in got) == (e <= budget[i]) and got.get((d, i), e) == e, (d, i, e)
    kept = decontaminate.clean(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == frame(spark, []).columns and {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in got}
    places = decontaminate.find(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert [r.edits for r in places if (r.doc_id, r.item_id) == (104, 3)] == [0, 0]
    texts = {d: t.lower() for d, t in rows if t}
    for r in places:  # the piece reported has the edits reported
        if r.edits:
            piece, item = plain(texts[r.doc_id][r.start : r.end]), plain(dict(items)[r.item_id])
            assert edit_distance_inside(piece, item) <= r.edits and edit_distance_inside(item, piece) == r.edits and abs(len(piece) - len(item)) <= r.edits
    assert decontaminate.find(frame(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontaminate.find(frame(spark, rows), spark.createDataFrame([], "item_id long, text string")).count() == 0


def labelled(spark, n=600):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choices(["la", "mi", "ko", "tu", "re", "so"], k=rnd.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        toxic, good = int(i % 5 == 0), int(i % 4 != 0)
        w = [word() for _ in range(rnd.randint(5, 60))]
        if toxic:
            w.insert(rnd.randrange(len(w)), rnd.choice(["grubby", "Blorft", "snarxen"]))
        text = " ".join(w) if good else "!! ".join(x.upper() for x in w)
        rows.append((i, text))
        labels.append((i, good, toxic))
    labels += [(None, 1, 1), (5, None, None), (3, 1, 0)]
    return frame(spark, rows + [(9000, None), (9001, ""), (None, "grubby")]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def bag(text):
    """Terms of a text and how often they occur."""
    out = {}
    for w in re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower()):
        for t in [w] + [("prefix", w[:n]) for n in toxicity.PREFIXES if len(w) >= n]:
            out[t] = out.get(t, 0) + 1
    return out


def brute_toxicity(examples, texts, k=toxicity.NEIGHBOURS):
    """Scores and evidence of ``texts`` by plain TF-IDF cosine with every example: (id, toxic, text)."""
    bags = [bag(t) for _, _, t in examples]
    n, prior = len(examples), np.mean([y for _, y, _ in examples])
    held, toxic = {}, {}
    for b, (_, y, _) in zip(bags, examples, strict=True):
        for t in b:
            held[t], toxic[t] = held.get(t, 0) + 1, toxic.get(t, 0) + y

    def vector(b):
        v = {t: (1 + np.log(c)) * (np.log((1 + n) / (1 + held.get(t, 0))) + 1) * np.log2(2 + toxic.get(t, 0) / max(1, held.get(t, 0) - toxic.get(t, 0))) for t, c in b.items()}
        norm = np.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    vectors = [vector(b) for b in bags]

    def vote(b, but=None):
        q = vector(b)
        cosine = [(round(sum(x * v.get(t, 0.0) for t, x in q.items()), 9), i) for i, v in enumerate(vectors) if i != but]
        best = sorted(((c, i) for c, i in cosine if c > 0), key=lambda x: (-x[0], examples[x[1]][0]))[:k]
        return (sum(c * examples[i][1] for c, i in best) + prior) / (sum(c for c, _ in best) + 1), [examples[i][0] for _, i in best[:3]]

    own = sorted((vote(b, i)[0], y) for i, (b, (_, y, _)) in enumerate(zip(bags, examples, strict=True)))
    y = np.array([y for _, y in own], float)
    fit = np.array([max(min(np.mean(y[a : c + 1]) for c in range(b, n)) for a in range(b + 1)) for b in range(n)])  # min-max form of isotonic regression
    ends = [b for b in range(n) if b == n - 1 or abs(fit[b + 1] - fit[b]) > 1e-12]
    starts = [0] + [b + 1 for b in ends[:-1]]
    edges, rates = [own[b][0] for b in ends], [(y[a : b + 1].sum() + prior) / (b - a + 2) for a, b in zip(starts, ends, strict=True)]
    return [(float(np.interp(v, edges, rates)), e) for v, e in map(vote, map(bag, texts))]


def test_toxicity_equals_brute_force(spark):
    docs, labels = labelled(spark, 160)
    docs = docs.unionByName(frame(spark, [(5, "other text of five"), (9002, "grubby " * 30_000), (9003, "qqq zzz")]))
    known = toxicity.sample(docs, labels, toxicity.usable())
    examples = sorted((r.doc_id, r.toxic, r.text) for r in known.collect())
    assert {i for i, _, _ in examples} == {i for i in range(160) if zlib.crc32(str(i).encode()) % 4 != 2 and i != 5} | ({5} if zlib.crc32(b"5") % 4 != 2 else set())
    rows = docs.collect()
    out = toxicity.score(docs, toxicity.train(docs, labels, toxicity.usable())).collect()
    assert len(out) == len(rows)
    want = {}
    for r, (s, e) in zip(rows, brute_toxicity(examples, [r.text for r in rows]), strict=True):
        want.setdefault(r.doc_id, []).append((round(s, 6), e))
    got = {}
    for r in out:
        got.setdefault(r.doc_id, []).append((round(r.score, 6), r.evidence))
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in want.items()}


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    m = toxicity.train(docs, labels, toxicity.usable())
    out = {r.doc_id: r for r in toxicity.score(docs, m).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(out[i].score >= toxicity.THRESHOLD) == (i % 5 == 0) for i in held]) > 0.97
    assert out[9000].score == out[9001].score == m.calibrated(m.prior) and out[9000].evidence == [] and out[None].score >= toxicity.THRESHOLD and len(out) == 603
    assert {r.doc_id for r in toxicity.clean(docs, m).collect()} == {i for i, r in out.items() if r.score < toxicity.THRESHOLD}
    none = toxicity.train(docs, labels.filter("doc_id < 0"), toxicity.usable())
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(docs.filter("doc_id < 0"), m).count() == 0


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    out = {r.doc_id: r.score for r in quality.score(docs, labels, quality.usable()).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(out[i] >= 0.5) == (i % 4 != 0) for i in held]) > 0.97 and all(0 <= s <= 1 for s in out.values()) and len(out) == 603
    same = {r.score for r in quality.score(docs, labels.filter("quality = 1"), quality.usable()).collect()}
    assert len(same) == 1 and same.pop() > 0.9
    x = quality.features(pa.array(["", None, "a|b A! 12\nline\nline"]))
    assert np.isfinite(x).all() and not x[:2].any()


def test_scores_do_not_depend_on_labels_or_source(spark):
    docs, labels = labelled(spark, 200)
    m = toxicity.train(docs, labels, toxicity.usable())
    other = docs.withColumn("source", F.lit("q")).withColumn("lang", F.lit("xx")).withColumn("doc_id", F.col("doc_id") + 1)
    a = sorted(r.score for r in toxicity.score(docs, m).collect())
    assert a == sorted(r.score for r in toxicity.score(other, m).collect())


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    from logweave.llm import ngram_join

    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in kept.select("doc_id").collect()}
        after = stage(spark, kept, sf)
        ids = [r.doc_id for r in after.select("doc_id").collect()]
        assert after.columns == docs.columns and set(ids) <= before
        if name == "toxicity":
            m = toxicity.train(kept, spark.read.parquet(f"{sf}/labels.parquet"), toxicity.usable())
            assert set(ids) == {r.doc_id for r in toxicity.score(kept, m).filter(F.col("score") < toxicity.THRESHOLD).collect()}
        elif name == "ngram_join":
            assert set(ids) == {r.component_id for r in ngram_join.join(kept)[0].collect()} and len(ids) == len(set(ids))
        elif name == "decontamination":
            assert set(ids) == before - {r.doc_id for r in decontaminate.find(kept, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
        else:
            copies = {r.doc_id: r.copies for r in mixing.plan(kept).collect()}
            assert {i: ids.count(i) for i in set(ids)} == {i: c for i, c in copies.items() if c}
        kept = after
    last = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
    assert sorted(r.doc_id for r in last.collect()) == sorted(r.doc_id for r in kept.select("doc_id").collect())
    assert last.agg(F.max(F.col("start") + F.col("n_tokens")), F.sum("n_tokens")).first()[:] == (last.agg(F.sum("n_tokens")).first()[0],) * 2


def test_pipeline_takes_nulls_repeats_and_further_columns(spark):
    sf = "/root/testdata/sf0.001"
    given = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 20").collect()
    schema = DOCS + ", copies long, toxic string, part int"
    long = "ein sehr langer text " * 60_000
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "k", "z", 7, "x", 1) for r in given]
    rows += [(i, t, None, s, None, None, None, None, None, None) for i, t, s in [(900, None, None), (901, "", "a"), (None, "no id", "a"), (902, long, "b"), (902, long, "b"), (903, long, "b")]]
    docs = spark.createDataFrame(rows, schema)
    ids = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == spark.createDataFrame([], schema).columns, name
        docs = spark.createDataFrame(docs.collect(), schema)
        ids[name] = sorted(r.doc_id for r in docs.collect() if r.doc_id is not None and r.doc_id >= 900)
    assert ids["toxicity"] == [900, 901, 902, 902, 903] and ids["ngram_join"] == ids["decontamination"] == [900, 901, 902]
    assert set(ids["mixing"]) <= {901, 902} and len(ids["mixing"]) <= 4
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == docs.count()
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        empty_out = stage(spark, empty, sf)
        assert empty_out.count() == 0


LICENSED = {
    "SPDX-License-Identifier: MIT": "mit",
    "// SPDX-License-Identifier: Apache-2.0": "apache-2.0",
    "SPDX-License-Identifier: BSD-3-Clause": "bsd",
    "SPDX-License-Identifier: MPL-2.0 */": "mpl-2.0",
    "SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 OR (MIT AND CC-BY-SA-4.0)": "cc-by,cc-by-sa-4.0,gpl-2.0,mit",  # cc-by: a base phrase
    "SPDX-License-Identifier: MIT\n2024 Apache and bees": "mit",
    "The Expat License": "mit",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this": "mit",
    "Redistribution and use in source and binary\nforms, with or without modification, are permitted": "bsd",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above": "isc",
    "It is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of": "lgpl-2.1",
    "This mit and apache 2.0 are words": "",
    "I hereby say: redistribution is plainly good": "",
}


def test_license_signatures(spark):
    texts = list(LICENSED)
    out = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {texts[r.doc_id]: r.labels for r in out} == LICENSED


def test_ids_take_no_part_in_toxicity(spark):
    words = "quiet rivers carry small boats home".split()
    scores = []
    for toxic in (range(40), range(40, 80)):
        docs = frame(spark, [(i, " ".join(words)) for i in range(80)] + [(200 + i, f"other words {i} of clean prose") for i in range(30)])
        labels = spark.createDataFrame([(i, 0, int(i in toxic)) for i in range(80)] + [(200 + i, 0, 0) for i in range(30)], "doc_id long, quality int, toxic int")
        model = toxicity.train(docs, labels, F.lit(True))
        scores.append({r.doc_id: r.score for r in toxicity.score(docs, model).collect()})
    assert scores[0] == scores[1] and len({scores[0][i] for i in range(80)}) == 1


def test_tokens_in_several_files_of_a_task(spark):
    rows = [(i, f"word {'x ' * (i % 9)}{i}") for i in range(300)]
    out = scratch(spark, "tokens")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "20")
    try:
        tokens.write(frame(spark, rows), out, tokens.tokenizer_path())
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    got = tokens.describe(spark, out).orderBy("doc_id").collect()
    assert [r.start for r in got] == list(np.cumsum([0, *[r.n_tokens for r in got]])[:-1])


def test_long_texts_and_pages_of_token_files(spark):
    import glob

    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefé") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    long = " ".join(rng.choice(words) for _ in range(450_000))
    assert len(long.encode()) > 2 << 20
    out = scratch(spark, "tokens")
    tokens.write(frame(spark, [(1, "before"), (2, long), (3, "after")] + [(10 + i, words[i % 3000]) for i in range(9000)]).coalesce(1), out, tokens.tokenizer_path())
    ids = Tokenizer.from_file(tokens.tokenizer_path()).encode(long, add_special_tokens=False).ids
    row = tokens.read(spark, out).filter("doc_id = 2").first()
    assert list(row.ids) == [*ids, tokens.END]
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{out.removeprefix('file:')}/part-*")]
    columns = [m.row_group(g).column(c) for m in files for g in range(m.num_row_groups) for c in range(m.num_columns)]
    assert columns and all(c.has_column_index and c.has_offset_index for c in columns if c.physical_type != "LIST")


def test_other_tokenizers_are_refused(tmp_path):
    import public_tokenizers

    with pytest.raises(ValueError):
        tokens.encode_texts(pa.array(["a"]), public_tokenizers.path("byte_bpe_50k.json"))


def test_tokens_words_are_one_piece_whatever_signs_or_digits_follow():
    from logweave.llm import kernels

    words = [f"{a}{b}" for a in ("stone", "señal", "über", "rio") for b in "abcdefghij"]
    texts = [f"{w}{tail} ({w})" for w in words for tail in ("", "###", "***", "%%%", "2024", "/", "_7")]
    buf, at = kernels.texts(pa.array(texts))
    start, end, first = tokens._pieces(buf, at)
    data = buf.tobytes()
    assert {data[s:e].decode() for s, e in zip(start, end, strict=True)} == {*words, "###", "***", "%%%", "2024", "/", "_", "7", "(", ")"}
    assert len(first) == len(texts) + 1 and first[-1] == len(start)


@pytest.mark.parametrize("kept", [(0, 1 << 20), (40, 1 << 20), (1 << 20, 60), (1 << 20, 1 << 20)])
def test_tokens_of_odd_texts_equal_plain_encoding(monkeypatch, kept):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "CACHE", kept[0])
    monkeypatch.setattr(tokens, "CACHE_IDS", kept[1])
    atoms = [*"abstmdlrveABSTRE019 '\"#.,-_/\\=<>|~^@!?;:()[]{}%&*+$\t\n", "'s", "'ll", "'RE", "é", "É", "ß", "ÿ", "×", "ª", "²", "́", "̸", "İ", "K", "Σ", "日", "각", "ᄀ", "🙂", "\xa0", "\x1c", "\x85", "\x00", "٣", "Ⅷ", "ﬁ", "’"]
    names = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>"]
    rng, plain = random.Random(7), Tokenizer.from_file(tokens.tokenizer_path())
    for more in ([], names):
        for _ in range(40):
            some = rng.sample(atoms, rng.randint(2, len(atoms))) + more
            texts = [None, *("".join(rng.choice(some) for _ in range(rng.randint(0, 40))) for _ in range(25))]
            got = tokens.encode_texts(pa.array(texts, pa.string()), tokens.tokenizer_path()).to_pylist()
            assert got == [[*plain.encode(t or "", add_special_tokens=False).ids, tokens.END] for t in texts]


def test_tokenizers_that_split_signs_one_by_one_are_cut_less(tmp_path):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    chars = [chr(c) for c in range(33, 127)]
    vocab = {t: i for i, t in enumerate(["[UNK]", *chars, *(f"##{c}" for c in chars)])}
    plain = Tokenizer(models.WordPiece(vocab, unk_token="[UNK]"))
    plain.normalizer, plain.pre_tokenizer = normalizers.BertNormalizer(lowercase=True), pre_tokenizers.BertPreTokenizer()
    plain.save(path := str(tmp_path / "signs.json"))
    texts = ["Outre### a-b (c) Été", "x1y22 don't. 2024-01-31!?"]
    assert tokens.encode_texts(pa.array(texts), path).to_pylist() == [[*plain.encode(t, add_special_tokens=False).ids, tokens.END] for t in texts]
