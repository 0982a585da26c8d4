"""Quality classifier (operator 2): a generalised additive model with pairwise interactions.

Each text becomes a few shares and averages of its bytes, words and lines. Cyclic boosting fits one shallow tree per
feature in turn to the gradient of the logistic loss and adds it to that feature's lookup table; then pairs of features
that explain most of what is left get tables of their own. A text is scored by looking up its bins and adding.

Training uses at most ``EXAMPLES`` labelled rows (those with the smallest hashes of their id), of which only the features
reach the driver; features and scores are made for every document, from its whole text.

Defined cases: null and empty texts have all features 0 and are scored like any other; repeated labels of a document
count once, by their largest; null labels and ids are not learned from; repeated rows are scored one by one; other
columns are ignored; of equal features the first, and of equal cuts the lowest, wins a tie; with labels of one kind only, or none, every score is their share or 0.5; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import kernels as K
from logweave.llm.common import crc_text, settled, table

EXAMPLES = 20_000
#: Bins of a feature, of each side of a pair; rounds of boosting, and how much of each tree is added.
BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, LEAVES = 32, 8, 120, 60, 6, 0.15, 3
NAMES = ["words", "word_length", "upper", "digits", "stops", "marks", "symbols", "pipes", "repeats", "distinct", "line_repeats", "lines", "other_bytes", "longest_word"]
_UPPER, _ALPHA = K.class_table(bytes(range(65, 91))), K.class_table(bytes(range(65, 91)) + bytes(range(97, 123)))
_DIGITS, _STOPS, _MARKS = K.class_table(bytes(range(48, 58))), K.class_table(b".?"), K.class_table(b"!,;:'\"-()")
_SYMBOLS, _OTHER = K.class_table(b"#$%&*+/<=>@[\\]^_`{|}~"), K.class_table(bytes(range(128, 256)))
_NOT_NEWLINE = ~K.class_table(b"\n\r")


def features(column) -> np.ndarray:
    """A row of NAMES for each text."""
    buf, at = K.texts(column)
    n = len(at) - 1
    size = np.maximum(np.diff(at), 1).astype(float)
    start, end, first = K.words(buf, at)
    words = np.diff(first)
    many = np.maximum(words, 1).astype(float)

    def per_text(values: np.ndarray, bounds: np.ndarray = at) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return (sums[bounds[1:]] - sums[bounds[:-1]]).astype(float)

    share = lambda t: per_text(t[buf]) / size
    length = end - start
    longest = np.zeros(n)
    sums = K.range_sums(K.BYTE[K.LOWER[buf]])
    if len(start):
        np.maximum.at(longest, np.repeat(np.arange(n), words), length)
        word = K.range_hash(sums, start, end)
        text = np.repeat(np.arange(n), words)
        same = np.zeros(len(word), np.int64)
        same[1:] = (word[1:] == word[:-1]) & (text[1:] == text[:-1])
        distinct = _distinct(word, text, n)
    else:
        same, distinct = np.zeros(0, np.int64), np.zeros(n)
    a, z, lines = K.words(buf, at, _NOT_NEWLINE)  # lines of blanks count too, whatever else the batch holds
    line = K.range_hash(sums, a, z)
    of = np.repeat(np.arange(n), np.diff(lines))
    line_repeats, line_counts = np.diff(lines) - _distinct(line, of, n), np.diff(lines).astype(float)
    letters = np.maximum(per_text(_ALPHA[buf]), 1)
    return np.column_stack([
        np.log1p(words), per_text(length, first) / many, per_text(_UPPER[buf]) / letters, share(_DIGITS), per_text(_STOPS[buf]) / many,
        share(_MARKS), share(_SYMBOLS), per_text((buf == 124)) / many, per_text(same, first) / many, distinct / many,
        line_repeats / np.maximum(line_counts, 1), line_counts / many, share(_OTHER), longest,
    ])


def _distinct(hashes: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    joint = np.unique(K.mix(hashes ^ (text.astype(np.uint64) * K.BASE)), return_index=True)[1]
    return np.bincount(text[joint], minlength=n).astype(float)


def _featurer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in K.slices(batches):
        x = features(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c) for c in x.T]], ["doc_id", *NAMES])


@dataclass
class Model:
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            out += t[np.searchsorted(self.edges[j], x[:, j], "right")]
        coarse = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.pair_edges)]
        for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
            out += t[coarse[a], coarse[b]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Values of a shallow tree over ordered bins: gradient sums g and curvature sums h per bin."""
    out, spans = np.zeros(len(g)), [(0, len(g))]
    gain = lambda a, b: a * a / (b + 1.0)
    while len(spans) < leaves:
        best = (1e-9, None, None)
        for s, (a, z) in enumerate(spans):
            cg, ch = np.cumsum(g[a:z]), np.cumsum(h[a:z])
            if z - a < 2:
                continue
            win = gain(cg[:-1], ch[:-1]) + gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1]) - gain(cg[-1], ch[-1])
            k = int(win.argmax())
            if win[k] > best[0]:
                best = (win[k], s, a + k + 1)
        if best[1] is None:
            break
        a, z = spans.pop(best[1])
        spans += [(a, best[2]), (best[2], z)]
    for a, z in spans:
        out[a:z] = g[a:z].sum() / (h[a:z].sum() + 1.0)
    return out


def _quarters(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best cut of a two-dimensional table to four quarters."""
    best, values = 0.0, np.zeros_like(g)
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    for a in range(g.shape[0] - 1):
        for b in range(g.shape[1] - 1):
            q = [cg[a, b], cg[a, -1] - cg[a, b], cg[-1, b] - cg[a, b], cg[-1, -1] - cg[a, -1] - cg[-1, b] + cg[a, b]]
            w = [ch[a, b], ch[a, -1] - ch[a, b], ch[-1, b] - ch[a, b], ch[-1, -1] - ch[a, -1] - ch[-1, b] + ch[a, b]]
            win = sum(x * x / (y + 1.0) for x, y in zip(q, w, strict=True))
            if win > best:
                v = [x / (y + 1.0) for x, y in zip(q, w, strict=True)]
                values = np.empty_like(g)
                values[: a + 1, : b + 1], values[: a + 1, b + 1 :], values[a + 1 :, : b + 1], values[a + 1 :, b + 1 :] = v
                best = win
    return best, values


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting on features x and labels y (0 or 1)."""
    cuts = lambda c, k: np.unique(np.quantile(c, np.arange(1, k) / k)) if len(c) else np.zeros(0)
    edges = [cuts(c, BINS) for c in x.T]
    coarse = [cuts(c, PAIR_BINS) for c in x.T]
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    model = Model(float(np.log(share / (1 - share))), edges, [np.zeros(len(e) + 1) for e in edges], [], coarse, [])
    if not len(y) or y.min() == y.max():
        return model
    bins = [np.searchsorted(e, c, "right") for e, c in zip(edges, x.T, strict=True)]
    margin = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            g, h = slopes()
            step = RATE * _tree(np.bincount(b, g, len(edges[j]) + 1), np.bincount(b, h, len(edges[j]) + 1), LEAVES)
            model.tables[j] += step
            margin += step[b]
    small = [np.searchsorted(e, c, "right") for e, c in zip(coarse, x.T, strict=True)]
    shape = lambda a, b: (len(coarse[a]) + 1, len(coarse[b]) + 1)
    grid = lambda v, a, b: np.bincount(small[a] * shape(a, b)[1] + small[b], v, shape(a, b)[0] * shape(a, b)[1]).reshape(shape(a, b))
    g, h = slopes()
    gains = sorted(((_quarters(grid(g, a, b), grid(h, a, b))[0], a, b) for a in range(x.shape[1]) for b in range(a)), reverse=True)
    model.pairs = [(a, b) for w, a, b in gains[:PAIRS] if w > 0]
    model.pair_tables = [np.zeros(shape(a, b)) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), t in zip(model.pairs, model.pair_tables, strict=True):
            g, h = slopes()
            step = RATE * _quarters(grid(g, a, b), grid(h, a, b))[1]
            t += step
            margin += step[small[a], small[b]]
    return model


def score(docs: DataFrame, labels: DataFrame, usable: Column, examples: int = EXAMPLES) -> DataFrame:
    """doc_id, score of every row of ``docs``, by a model of at most ``examples`` labelled rows that are ``usable``."""
    schema = "doc_id long, " + ", ".join(f"{n} double" for n in NAMES)
    rows = settled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_featurer, schema), "features")
    known = labels.filter(usable & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)
    least = F.min(F.struct(*NAMES)).alias("x")  # of different texts of one id the one of the least features
    sample = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(least).select("doc_id", "quality", "x.*").orderBy("doc_id").toPandas()  # bounded by ``examples``
    model = docs.sparkSession.sparkContext.broadcast(fit(sample[NAMES].to_numpy(float), sample["quality"].to_numpy(float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([np.asarray(b.column(n)) for n in NAMES]) if b.num_rows else np.zeros((0, len(NAMES)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.value.score(x))], ["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")


def usable() -> Column:
    return crc_text("doc_id") % 3 != 1


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), usable())
    return scored.select("doc_id", F.coalesce(crc_text("doc_id") % 3 == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
