"""Winnowing, periodic runs and tokenizer alignment against brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from logweave.llm import alignment, runs, winnowing

DOCS = "doc_id long, text string, lang string, p int, v string, copies string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, "v", "c") for i, t in rows], DOCS)


def winnowed(text: str, k: int, window: int) -> list[tuple[int, int]]:
    """Place and hash of what each window chooses, window by window."""
    if not text:
        return []
    grams = [xxhash.xxh64(text[i : i + k].encode("utf-32-be"), seed=42).intdigest() >> 32 for i in range(max(1, len(text) - k + 1))]
    out = []
    for s in range(max(1, len(grams) - window + 1)):
        part = grams[s : s + window]
        at = s + max(i for i, g in enumerate(part) if g == min(part))
        if not out or out[-1][0] != at:
            out.append((at, grams[at]))
    return out


def near(a: list[int], b: list[int]) -> float:
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def texts(seed: int) -> list:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé日🙂") for _ in range(rng.randint(1, 6)))
    prose = [" ".join(word() for _ in range(rng.choice([1, 3, 10, 40, 200]))) for _ in range(25)]
    shared = " ".join(word() for _ in range(40))
    return [None, "", "a", "ab", "a" * 23, "a" * 500, "ab" * 300, "x" * 24, "y" * 100, "z" * 101, *prose, prose[0], prose[-1], prose[3] + shared, shared + prose[4], "q" * 3000 + prose[5] + "-" * 2500]


@pytest.mark.parametrize("k,window", [(3, 4), (5, 16), (winnowing.K, winnowing.WINDOW), (2, 1)])
def test_choices_equal_window_by_window(spark, k, window):
    rows = list(enumerate(texts(k)))
    got = {r.doc_id: list(zip(r.positions, r.hashes, strict=True)) for r in winnowing.fingerprints(frame(spark, rows), k, window).collect()}
    assert got == {i: winnowed(t or "", k, window) for i, t in rows}


@pytest.mark.parametrize("k,window", [(3, 4), (winnowing.K, winnowing.WINDOW)])
def test_edited_texts_equal_whole_ones(spark, k, window):
    rows = [(3 * i - 7, t) for i, t in enumerate(texts(7))] + [(None, "no id"), (2, "same id"), (2, "same id"), (2, "other text")]
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, xxhash.xxh64((r[1] or "").encode(), seed=42).intdigest() - (1 << 64) * (xxhash.xxh64((r[1] or "").encode(), seed=42).intdigest() >> 63)))
    expected = []
    for n, (i, t) in enumerate(order):
        text, following = t or "", order[(n + 1) % len(order)][1] or ""
        half = len(text) // 2
        made = text[: len(text) - half] + following[:half]
        own, new, nxt = ([h for _, h in winnowed(x, k, window)] for x in (text, made, following))
        expected += [(i, len(text), made, own, new, nxt)] * rows.count((i, t))
    out = winnowing.edited(frame(spark, rows), k, window).withColumn("c", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    got = [(r.doc_id, r.n_chars, r.edited_text, list(r.hashes), list(r.edited_hashes), list(r.next_hashes)) for r in out.collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected))


def test_fingerprint_query(spark, tmp_path):
    rows = list(enumerate(texts(1)))
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in winnowing.op11_fingerprints(spark, str(tmp_path)).collect()}
    assert len(out) == len(rows)
    for i, t in rows:
        text, following = t or "", rows[(i + 1) % len(rows)][1] or ""
        made = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        own, new, nxt = ([h for _, h in winnowed(x, winnowing.K, winnowing.WINDOW)] for x in (text, made, following))
        assert out[i].n_chars == len(text) and out[i].edited_sha256 == hashlib.sha256(made.encode()).hexdigest()
        assert abs(out[i].near_edited - near(own, new)) < 1e-12 and abs(out[i].near_next - near(own, nxt)) < 1e-12
    same = {}
    for i, t in rows:
        assert same.setdefault(t or "", out[i].fingerprint) == out[i].fingerprint
    assert len(set(same.values())) == len(same)
    (tmp_path / "none").mkdir()
    frame(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert winnowing.op11_fingerprints(spark, f"{tmp_path}/none").count() == 0
    (tmp_path / "one").mkdir()
    frame(spark, [(4, "alone here")]).write.parquet(f"{tmp_path}/one/documents.parquet")
    assert [r.near_next for r in winnowing.op11_fingerprints(spark, f"{tmp_path}/one").collect()] == [1.0]


def runs_by_hand(words: list, least: int, times: int) -> list[tuple[int, int, int]]:
    """Every maximal stretch of every period, of equal stretches the smallest period."""
    found: dict = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def sequences(seed: int) -> list[list[int]]:
    rng = random.Random(seed)
    out = [[], [1], [1] * 24, [1] * 23, [1] * 100, [1, 2] * 40, [1, 2, 3] * 8 + [1], [3, 1, 2] * 9]
    for _ in range(150):
        made: list[int] = []
        for _ in range(rng.randint(1, 5)):
            root = [rng.randint(0, rng.choice([1, 2, 30])) for _ in range(rng.randint(1, rng.choice([2, 9, 40])))]
            made += (root * rng.randint(1, 9))[: rng.randint(1, 300)]
        out.append(made)
    return out


def test_runs_equal_all_periods_by_hand():
    for least, times in ((runs.LEAST_WORDS, runs.LEAST_PERIODS), (4, 2), (1, 3)):
        for words in sequences(least):
            assert [tuple(r) for r in runs.find(np.array(words, np.int64), least, times).tolist()] == runs_by_hand(words, least, times), words


def test_suffix_array_and_prefixes():
    rng = random.Random(5)
    for n in (1, 2, 30, 200):
        words = [rng.randint(0, 2) for _ in range(n)]
        order, rank = runs.suffix_array(np.array(words))
        assert order.tolist() == sorted(range(n), key=lambda i: words[i:]) and rank[order].tolist() == list(range(n))
    assert runs.shortest_repeat(24, 3) == 16
    both = np.array([*range(16), 99, *range(16)], np.int64)
    assert runs.with_repeats(both, np.array([0, 33]), 16).tolist() == [0] and not len(runs.with_repeats(both, np.array([0, 17, 33]), 16))


def described(text: str | None, doc_id) -> tuple:
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = runs_by_hand(words, 24, 3)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    said = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(said), sha(kept))


def test_run_query(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abé日.") for _ in range(rng.randint(1, 4)))
    rows = [(i, rng.choice([" ", "\n", " \t"]).join(f"w{x}" for x in s)) for i, s in enumerate(sequences(2))]
    rows += [(1000 + i, " ".join(word() for _ in range(rng.randint(0, 400)))) for i in range(60)]
    rows += [(None, "x " * 50), (7, "x " * 50), (7, "x " * 50), (8, None), (9, ""), (-3, " \n"), (5000, " ".join(f"l{i % 40000}" for i in range(130000)))]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    columns = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    got = sorted(str(tuple(r)) for r in runs.op12_runs(spark, str(tmp_path)).select(*columns).collect() if r.doc_id != 5000)
    assert got == sorted(str(described(t, i)) for i, t in rows if i != 5000)
    plain = runs.periodic_runs(frame(spark, rows)).filter("doc_id = 5000").collect()
    assert [(r.n_runs, r.start, r.length, r.period, r.n_dropped) for r in plain] == [(1, 0, 130000, 40000, 90000)]
    assert runs.periodic_runs(frame(spark, [])).count() == 0


def aligned(text: str | None):
    """Ids of A and B, groups, links of a whole text, byte by byte; None if it has no tokens."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    if not hasattr(aligned, "a"):
        a_path, b_path = alignment.paths()
        aligned.a, aligned.b, aligned.pattern = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path), P
        aligned.a.encode_special_tokens = True
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
        aligned.sign = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    if not text:
        return None
    a, b = aligned.a.encode(" " + text, add_special_tokens=False).ids, aligned.b.encode(text)
    a_bytes = [bytes(aligned.sign[c] for c in aligned.a.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(aligned.b.id_to_piece(i)[3:5], 16)]) if aligned.b.is_byte(i) else aligned.b.id_to_piece(i).replace("\u2581", " ").encode() for i in b]
    if b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
        return None
    spans = lambda x: [(sum(map(len, x[:k])), sum(map(len, x[: k + 1]))) for k in range(len(x))]
    sa, sb = spans(a_bytes), spans(b_bytes)
    both = {e for _, e in sa} & {e for _, e in sb}
    groups, ga, gb = [], [], []
    for e in sorted(both):
        ga, gb = [i for i, (_, z) in zip(a, sa, strict=True) if z <= e], [i for i, (_, z) in zip(b, sb, strict=True) if z <= e]
        done = sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups)
        groups.append((ga[done[0] :], gb[done[1] :]))
    links = [(i, j) for i, (s, e) in zip(a, sa, strict=True) for j, (x, y) in zip(b, sb, strict=True) if s < y and x < e]
    return a, b, groups, links


def token_texts() -> list:
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghiABÉéß日本🙂.,'!-_/0123") for _ in range(rng.randint(1, 9)))
    joint = lambda: rng.choice([" ", " ", " ", "  ", "\n", " \n", "\t", "\u00a0", "\u3000 ", "\u2003 ", "\x1c ", "\x85 ", "   "])
    prose = ["".join(word() + joint() for _ in range(rng.choice([1, 2, 5, 30]))) for _ in range(40)]
    return [None, "", " ", "  ", "   a", "a ", "a  ", "Hello, world! It's the 'll don't", "x\u2581y z", "<|endoftext|> a <s> </s> <0x0A> <unk>", "a\x00b", "naïve  café\n\n  tab\t x", "日本語。 テスト", "e\u0301 x", "the the the of the", *prose, prose[0]]


def test_alignment_equals_byte_by_byte(spark, tmp_path):
    rows = list(enumerate(token_texts())) + [(None, "no id the"), (3, "same row"), (3, "same row")]
    whole = [(i, aligned(t)) for i, t in rows]
    count: dict = {}
    for _, x in whole:
        for p in x[3] if x else ():
            count[p] = count.get(p, 0) + 1
    top: dict = {}
    for (_, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    expected = []
    for i, x in whole:
        if not x:
            expected.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = x
        said = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        expected.append((i, len(a), len(b), len(groups), len(links), sum(count[p] == top[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(said.encode()).hexdigest()))
    frame(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in alignment.op13_alignment(spark, str(tmp_path)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected))
    assert sum(x is None for _, x in whole) < 8
    by_id = {r.doc_id: r for r in alignment.labelled(frame(spark, rows[:60]), *alignment.paths()).collect() if r.a_ids is not None}
    for i, x in whole[:55]:
        if x and i != 3:
            r = by_id[i]
            made = [([t for t, g in zip(r.a_ids, r.a_group, strict=True) if g == k], [t for t, g in zip(r.b_ids, r.b_group, strict=True) if g == k]) for k in range(len(x[2]))]
            assert made == x[2]
        elif not x:
            assert i not in by_id


def test_long_texts_and_empty_tables_align(spark, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE_BYTES", 1 << 12)
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7))) for _ in range(500)]
    long = " ".join(rng.choice(words) for _ in range(60000))
    out = {r.doc_id: r for r in alignment.alignments(frame(spark, [(1, long), (2, words[0]), (3, long)]), *alignment.paths()).collect()}
    a, b = aligned.a.encode(" " + long, add_special_tokens=False).ids, aligned.b.encode(long)
    assert (out[1].n_a, out[1].n_b) == (len(a), len(b)) and out[1][1:] == out[3][1:] and out[1].n_links == len(a) + len(b) - out[1].n_groups
    assert alignment.alignments(frame(spark, []), *alignment.paths()).count() == 0
    assert [r.n_links for r in alignment.alignments(frame(spark, [(1, None)]), *alignment.paths()).collect()] == [0]


def test_tokenizers_are_checked(tmp_path):
    import json

    a_path, b_path = alignment.paths()
    said = json.loads(open(a_path, encoding="utf-8").read())
    said["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "a.json").write_text(json.dumps(said))
    with pytest.raises(ValueError):
        alignment.Tokenizers(f"{tmp_path}/a.json", b_path)
