"""The quality classifier against the same model in plain Python."""

import math
import random
import re
import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
import pytest
from test_texts import frame, labelled

from logweave.llm import quality


def plain_features(text):
    b = (text or "").encode()
    words = re.findall(rb"[^ \t\n\v\f\r]+", b)
    lines = re.findall(rb"[^\n\r]+", b)
    repeated = [x.lower() == y.lower() for x, y in zip(words, words[1:])]
    count = lambda chars: sum(c in chars for c in b)
    letters, n, size = count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"), max(1, len(words)), max(1, len(b))
    return [
        math.log1p(len(words)), sum(map(len, words)) / n, count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / max(1, letters), count(b"0123456789") / size,
        count(b".?") / n, count(b"!,;:'\"-()") / size, count(b"#$%&*+/<=>@[\\]^_`{|}~") / size, count(b"|") / n, sum(repeated) / n,
        len({w.lower() for w in words}) / n, (len(lines) - len({x.lower() for x in lines})) / max(1, len(lines)), len(lines) / n,
        sum(c > 127 for c in b) / size, max(map(len, words), default=0),
    ]


def gain(g, h):
    return g * g / (h + 1)


def best_tree(g, h):
    """Bins cut to at most LEAVES spans, each time where most is won."""
    spans = [(0, len(g))]
    while len(spans) < quality.LEAVES:
        wins = []
        for a, z in spans:
            for c in range(a + 1, z):
                win = gain(sum(g[a:c]), sum(h[a:c])) + gain(sum(g[c:z]), sum(h[c:z])) - gain(sum(g[a:z]), sum(h[a:z]))
                wins.append((win, a, c, z))
        if not wins or max(wins)[0] <= 1e-9:
            break
        _, a, c, z = max(wins, key=lambda w: w[0])
        spans = [s for s in spans if s != (a, z)] + [(a, c), (c, z)]
    out = [0.0] * len(g)
    for a, z in spans:
        out[a:z] = [sum(g[a:z]) / (sum(h[a:z]) + 1)] * (z - a)
    return out


def best_quarters(g, h):
    best, values = 0.0, {}
    rows, columns = 1 + max(a for a, _ in g), 1 + max(b for _, b in g)
    for a in range(rows - 1):
        for b in range(columns - 1):
            win, cells = 0.0, {}
            for low in (True, False):
                for left in (True, False):
                    mine = [k for k in g if (k[0] <= a) == low and (k[1] <= b) == left]
                    x, y = sum(g[k] for k in mine), sum(h[k] for k in mine)
                    win += gain(x, y)
                    cells |= dict.fromkeys(mine, x / (y + 1))
            if win > best:
                best, values = win, cells
    return best, values


def plain_scores(x, y, asked):
    """Scores of ``asked`` by cyclic boosting on x and y, one row at a time."""
    cut = lambda k: [sorted(set(np.quantile([r[j] for r in x], np.arange(1, k) / k).tolist())) for j in range(len(x[0]))]
    fine, coarse = cut(quality.BINS), cut(quality.PAIR_BINS)
    bin_of = lambda edges, v: sum(v >= e for e in edges)
    share = (sum(y) + 0.5) / (len(y) + 1)
    base = math.log(share / (1 - share))
    bins = [[bin_of(fine[j], v) for j, v in enumerate(r)] for r in x]
    small = [[bin_of(coarse[j], v) for j, v in enumerate(r)] for r in x]
    tables = [[0.0] * (len(e) + 1) for e in fine]
    margin = [base] * len(y)

    def slopes():
        p = [1 / (1 + math.exp(-m)) for m in margin]
        return [t - q for t, q in zip(y, p)], [q * (1 - q) for q in p]

    for _ in range(quality.ROUNDS):
        for j, t in enumerate(tables):
            g, h = [0.0] * len(t), [0.0] * len(t)
            for r, u, v in zip(bins, *slopes()):
                g[r[j]] += u
                h[r[j]] += v
            step = best_tree(g, h)
            for k, v in enumerate(step):
                t[k] += quality.RATE * v
            margin = [m + quality.RATE * step[r[j]] for m, r in zip(margin, bins)]

    def grid(a, b):
        g = {(i, j): 0.0 for i in range(len(coarse[a]) + 1) for j in range(len(coarse[b]) + 1)}
        h = dict(g)
        for r, u, v in zip(small, *slopes()):
            g[r[a], r[b]] += u
            h[r[a], r[b]] += v
        return best_quarters(g, h)

    gains = sorted(((grid(a, b)[0], a, b) for a in range(len(fine)) for b in range(a)), reverse=True)
    pairs = [(a, b, {}) for w, a, b in gains[: quality.PAIRS] if w > 0]
    for _ in range(quality.PAIR_ROUNDS):
        for a, b, t in pairs:
            step = grid(a, b)[1]
            for k, v in step.items():
                t[k] = t.get(k, 0.0) + quality.RATE * v
            margin = [m + quality.RATE * step.get((r[a], r[b]), 0.0) for m, r in zip(margin, small)]
    out = []
    for r in asked:
        m = base + sum(t[bin_of(fine[j], r[j])] for j, t in enumerate(tables))
        m += sum(t.get((bin_of(coarse[a], r[a]), bin_of(coarse[b], r[b])), 0.0) for a, b, t in pairs)
        out.append(1 / (1 + math.exp(-m)))
    return out


TEXTS = [None, "", " \n\t", "a|b A! 12\nline\nline", "Same same SAME\r\nsame", "é ünï — 日本語 x", "$%&*+/<=>@[\\]^_`{|}~ \"quoted\" (it's); no: yes, a-b", "one\n\n\none\nTwo\ntwo", "\x0b\x0cword", "x" * 70_000, "long words and more " * 20_000]


def test_features_equal_plain_ones():
    got = quality.features(pa.array(TEXTS, pa.string()))
    assert got == pytest.approx(np.array([plain_features(t) for t in TEXTS], float), abs=1e-12)
    for k, t in enumerate(TEXTS):  # alone and in a batch alike
        assert quality.features(pa.array([t], pa.string()))[0].tolist() == pytest.approx(got[k].tolist(), abs=1e-12)
    assert quality.features(pa.array([], pa.string())).shape == (0, len(quality.NAMES))


@pytest.fixture(scope="module")
def noisy():
    """Texts whose labels no single feature tells: some of each kind are labelled the other way."""
    rnd = random.Random(7)
    rows, labels = [], []
    for i in range(140):
        good = rnd.random() < 0.6
        words = ["".join(rnd.choices("abcdefgh", k=rnd.randint(1, 9 if good else 5))) for _ in range(rnd.randint(3, 40))]
        text = "".join(w.title() + rnd.choice([" ", ". ", "\n"]) if rnd.random() < (0.2 if good else 0.5) else w + rnd.choice(" |" if not good else " ") for w in words)
        rows.append((i, text))
        labels.append((i, int(good != (rnd.random() < 0.1)), 0))
    return rows, labels


def test_scores_equal_the_plain_model(spark, noisy, monkeypatch):
    monkeypatch.setattr(quality, "ROUNDS", 12)
    monkeypatch.setattr(quality, "PAIR_ROUNDS", 5)
    rows, labels = noisy
    known = {i: q for i, q, _ in labels if zlib.crc32(str(i).encode()) % 3 != 1}
    extra = [(1000 + k, t) for k, t in enumerate(TEXTS)] + [(None, "no id here"), rows[3], rows[3]]
    odd = [(None, 1, 0), (5, None, 0), (7, 0, 0), (7, 1, 0), (99_999, 1, 0)]  # without an id, a label, twice, without a text
    known[7] = max(known.get(7, 0), 1) if 7 in known else known.get(7)
    known = {i: q for i, q in known.items() if q is not None}
    docs = frame(spark, rows + extra)
    got = quality.score(docs, spark.createDataFrame(labels + odd, "doc_id long, quality int, toxic int"), quality.usable()).collect()
    texts = dict(rows)
    x = [plain_features(texts[i]) for i in sorted(known)]
    asked = rows + extra
    expected = plain_scores(x, [known[i] for i in sorted(known)], [plain_features(t) for _, t in asked])
    key = lambda r: (r[0] is not None, r[0] or 0)
    want = sorted(zip([i for i, _ in asked], expected), key=key)
    have = sorted(((r.doc_id, r.score) for r in got), key=key)
    assert [i for i, _ in have] == [i for i, _ in want]
    assert [s for _, s in have] == pytest.approx([s for _, s in want], abs=1e-9)
    for _, same in groupby(have, key=lambda r: r[0]):
        assert len({s for _, s in same}) == 1  # repeated rows have one score


def test_quality_of_an_empty_table(spark):
    docs, labels = labelled(spark, 30)
    assert quality.score(docs.limit(0), labels, quality.usable()).collect() == []
    assert {r.score for r in quality.score(docs, labels.limit(0), quality.usable()).collect()} == {0.5}
