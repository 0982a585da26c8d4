"""Toxicity (operator 3): votes of the nearest labelled examples by exact TF-IDF cosine.

Terms are words in lower case and their first 4 and 6 bytes; every term of every example is kept. A term weighs
(1 + ln tf) * idf * rf, where rf = log2(2 + toxic / max(1, other examples that hold it)) is the relevance frequency of
supervised TF-IDF; ``relevance=False`` leaves it out. Examples are kept in an inverted index whose postings are cut to
blocks of like examples; those of terms in a sixteenth of the examples are dense rows, added up for many texts at once.
The largest weight of a term in a block bounds what its examples can score, so blocks are taken by bound until no other
can reach the k-th cosine found. The k nearest vote with their cosine as weight, the vote is
calibrated by isotonic regression on leave-one-out votes of the examples, and the nearest examples are the evidence.

Training uses at most ``EXAMPLES`` labelled rows (those with the smallest hashes of their id) of at most
``EXAMPLE_BYTES`` of text together; the weights are those of this sample, and the index that is sent to the executors is
bounded by it. All documents are scored, by their whole text and over all their terms.

Defined cases: null and empty texts have no terms; a text that shares no term with any example gets the calibrated rate of
toxic examples and no evidence; ties go to smaller ids; repeated labels of a document count once, toxic if any says so; of
different texts of one id the smallest in byte order is learned from; null labels and ids are not learned from; repeated
rows are scored one by one; other columns are ignored; without labelled rows every score is 0; an empty table gives an
empty result. Terms are 48-bit fingerprints; equal fingerprints are taken as equal terms. Cosines are rounded to nine
decimals.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.llm import kernels as K
from logweave.llm.common import crc_text, give_back, settled, table

#: Bounds of the labelled sample, voters, examples in a block.
EXAMPLES, EXAMPLE_BYTES, NEIGHBOURS, BLOCK = 2_000, 64 << 20, 16, 64
THRESHOLD = 0.3
PREFIXES = (4, 6)
#: Blocks looked at together, by their bounds; share of the examples from which on a term's postings are a dense row.
STEP, FREQUENT = 8, 1 / 16
U = np.uint64
_LETTERS = K.class_table(bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
_TERM_BITS, _TABLE_BITS = 48, 20
_TOGETHER = 256
_LARGEST_BATCH = 1 << (64 - _TERM_BITS)
#: Bytes of text whose terms are in memory together in a task; a longer text stays whole.
_BATCH_BYTES = 1 << 19


def terms(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, fingerprint and count of the distinct terms of each text, sorted. At most ``_LARGEST_BATCH`` texts."""
    buf, at = K.texts(column)
    start, end, first = K.words(buf, at, _LETTERS)
    text = np.repeat(np.arange(len(at) - 1, dtype=U), np.diff(first))
    sums = K.range_sums(K.BYTE[K.LOWER[buf]])
    found = [(text, K.range_hash(sums, start, end))]
    for n in PREFIXES:
        long = end - start >= n
        found.append((text[long], K.range_hash(sums, start[long], start[long] + n) ^ U(0xA5A5A5A5 << 16)))
    joint = np.sort(np.concatenate([(t << U(_TERM_BITS)) | (h >> U(64 - _TERM_BITS)) for t, h in found]))
    edge = np.flatnonzero(np.concatenate([[True], joint[1:] != joint[:-1]])) if len(joint) else np.zeros(0, np.int64)
    kept = joint[edge]
    return (kept >> U(_TERM_BITS)).astype(np.int64), kept & U((1 << _TERM_BITS) - 1), np.diff(np.append(edge, len(joint)))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in K.slices(batches, limit=_BATCH_BYTES):
        for at in range(0, b.num_rows, _LARGEST_BATCH):
            yield b.slice(at, _LARGEST_BATCH)


@dataclass
class Model:
    """Weights, block-max index of the examples and calibration; its size is bounded by that of the sample."""

    keys: np.ndarray  # fingerprints of all terms of the examples, sorted
    weights: np.ndarray  # idf * rf of each
    unseen: float  # weight of any other term
    ids: np.ndarray
    labels: np.ndarray
    prior: float
    row: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # row of a frequent term, else -1
    frequent: tuple[np.ndarray, np.ndarray, np.ndarray] = (np.zeros(0, np.int64),) * 3  # row, example, weight
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # first list of each other term
    blocks: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # block of each list
    most: np.ndarray = field(default_factory=lambda: np.zeros(0))  # largest weight in it
    begin: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # its first posting
    example: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    steps: tuple[np.ndarray, np.ndarray] = (np.zeros(0), np.zeros(0))

    @classmethod
    def build(cls, ids: np.ndarray, labels: np.ndarray, bounds: np.ndarray, hashes: np.ndarray, counts: np.ndarray, relevance: bool = True) -> Model:
        """Examples' ids and labels; their terms and counts, each example's from bounds[i] to bounds[i + 1]."""
        n = len(ids)
        keys, term = np.unique(hashes, return_inverse=True)
        owner = np.repeat(np.arange(n), np.diff(bounds))
        held = np.bincount(term, minlength=len(keys))
        toxic = np.bincount(term, labels[owner], len(keys))
        weights = np.log((1 + n) / (1 + held)) + 1
        if relevance:
            weights = weights * np.log2(2 + toxic / np.maximum(1, held - toxic))
        model = cls(keys, weights, float(np.log(1 + n) + 1), ids, labels.astype(float), float(labels.mean()) if n else 0.0)
        commonest = np.full(n, -1)  # groups examples of one language
        order = np.lexsort((held[term], owner))
        commonest[owner[order]] = term[order]
        place = np.empty(n, np.int64)
        place[np.lexsort((ids, np.diff(bounds), commonest))] = np.arange(n)  # like terms and like lengths share blocks
        inverse = np.argsort(place)
        model.ids, model.labels = ids[inverse], model.labels[inverse]
        raw = (1 + np.log(counts)) * weights[term]
        norm = np.sqrt(np.bincount(owner, raw * raw, n))
        example, value = place[owner], raw / norm[owner]
        order = np.lexsort((example, term))
        term, example, value = term[order], example[order], value[order]
        often = held >= max(n * FREQUENT, 8)
        model.row = np.where(often, np.cumsum(often) - 1, -1)
        some = often[term]
        model.frequent = model.row[term[some]], example[some], value[some]
        term, example, value = term[~some], example[~some], value[~some]
        block = example // BLOCK
        edge = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])) if len(term) else np.zeros(0, np.int64)
        model.first = np.searchsorted(term[edge], np.arange(len(keys) + 1))
        model.blocks, model.begin = block[edge], np.append(edge, len(term))
        model.most = np.maximum.reduceat(value, edge) if len(edge) else np.zeros(0)
        model.example, model.weight = example.astype(np.int32), value
        model._calibrate(bounds, hashes, counts, place)
        return model

    @cached_property
    def dense(self) -> np.ndarray:
        """Weights of the frequent terms in all examples, filled up to whole blocks."""
        row, example, value = self.frequent
        out = np.zeros((int(self.row.max(initial=-1)) + 1, -(-len(self.ids) // BLOCK) * BLOCK))
        out[row, example] = value
        return out

    def finder(self):
        """Looks up fingerprints: number of the term, -1 if no example holds it."""
        shift = U(_TERM_BITS - _TABLE_BITS)
        start = np.searchsorted(self.keys >> shift, np.arange((1 << _TABLE_BITS) + 1, dtype=U))

        def find(hashes: np.ndarray) -> np.ndarray:
            out = np.full(len(hashes), -1)
            left = np.arange(len(hashes))
            top = (hashes >> shift).astype(np.int64)
            at, end = start[top], start[top + 1]
            while len(left):
                some = at < end
                left, at, end = left[some], at[some], end[some]
                same = self.keys[at] == hashes[left]
                out[left[same]] = at[same]
                left, at, end = left[~same], at[~same] + 1, end[~same]
            return out

        return find

    def nearest(self, bounds: np.ndarray, term: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS, but: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text (its terms from bounds[i] to bounds[i + 1]; -1 is left out) the k examples of largest cosine above 0,
        with all that tie with the last of them, and their cosines. ``but``: an example of each text that takes no part."""
        dense = self.dense
        row = np.where(term >= 0, self.row[term] if len(self.row) else -1, -1)
        for i in range(0, len(bounds) - 1, _TOGETHER):
            some = bounds[i : i + _TOGETHER + 1]
            q = np.zeros((len(some) - 1, len(dense)))
            here = np.flatnonzero(row[some[0] : some[-1]] >= 0) + some[0]
            q[np.searchsorted(some, here, "right") - 1, row[here]] = w[here]
            for j, partial in enumerate(q @ dense):
                mine = np.flatnonzero((term[some[j] : some[j + 1]] >= 0) & (row[some[j] : some[j + 1]] < 0)) + some[j]
                yield self._best(term[mine], w[mine], partial, k, None if but is None else but[i + j])

    def _best(self, term: np.ndarray, w: np.ndarray, partial: np.ndarray, k: int, but: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Adds the terms of the index to what the frequent ones give each example."""
        counts = self.first[term + 1] - self.first[term]
        lists = K.spread(self.first[term], counts)
        q = np.repeat(w, counts)
        block = self.blocks[lists]
        bound = partial.reshape(-1, BLOCK).max(1) + np.bincount(block, q * self.most[lists], len(partial) // BLOCK)
        ranked = np.argsort(-bound, kind="stable")[: np.count_nonzero(bound)]
        rank = np.zeros(len(bound), np.int16)
        rank[ranked] = np.arange(len(ranked)) // STEP
        step = rank[block]
        example, score, least = np.zeros(0, np.int64), np.zeros(0), 0.0
        for s in range(-(-len(ranked) // STEP)):
            if len(example) >= k and bound[ranked[s * STEP]] < least - 1e-9:
                break
            mine = np.flatnonzero(step == s)
            n = self.begin[lists[mine] + 1] - self.begin[lists[mine]]
            post = K.spread(self.begin[lists[mine]], n)
            got = np.bincount(self.example[post], np.repeat(q[mine], n) * self.weight[post], len(partial))
            columns = (ranked[s * STEP : (s + 1) * STEP, None] * BLOCK + np.arange(BLOCK)).ravel()
            value = np.round(got[columns] + partial[columns], 9)
            good = value >= max(least, 1e-9)
            at, value = columns[good], value[good]
            if but is not None:
                at, value = at[at != but], value[at != but]
            example, score = np.concatenate([example, at]), np.concatenate([score, value])
            least = np.partition(score, len(score) - k)[len(score) - k] if len(score) >= k else 0.0
            example, score = example[score >= least], score[score >= least]
        best = np.lexsort((self.ids[example], self.labels[example], -score))  # ids order what is shown, not what is summed
        example, score = example[best], score[best]
        return example, score

    def vote(self, example: np.ndarray, score: np.ndarray) -> float:
        """Share of toxic among the nearest, weighted by cosine; a vote of weight 1 goes to the rate of all examples."""
        return float((score @ self.labels[example] + self.prior) / (score.sum() + 1))

    def calibrated(self, vote: float) -> float:
        edges, rates = self.steps
        return min(1.0, max(0.0, float(np.interp(vote, edges, rates)))) if len(edges) else vote

    def _calibrate(self, bounds: np.ndarray, hashes: np.ndarray, counts: np.ndarray, place: np.ndarray) -> None:
        """Isotonic regression of the labels on leave-one-out votes."""
        n = len(self.ids)
        owner = np.repeat(np.arange(n), np.diff(bounds))
        term, w = self.vectors(owner, hashes, counts, n, self.finder())
        votes = np.array([self.vote(*x) for x in self.nearest(bounds, term, w, but=place)])
        self.__dict__.pop("dense", None)  # filled anew where it is needed
        order = np.argsort(votes, kind="stable")
        levels: list[list[float]] = []  # sum, count, largest vote
        for v, y in zip(votes[order], self.labels[place][order], strict=True):
            levels.append([y, 1, v])
            while len(levels) > 1 and levels[-2][0] / levels[-2][1] >= levels[-1][0] / levels[-1][1]:
                y2, n2, v2 = levels.pop()
                levels[-1] = [levels[-1][0] + y2, levels[-1][1] + n2, v2]
        self.steps = np.array([x[2] for x in levels]), np.array([(x[0] + self.prior) / (x[1] + 1) for x in levels])

    def vectors(self, text: np.ndarray, hashes: np.ndarray, counts: np.ndarray, texts: int, find) -> tuple[np.ndarray, np.ndarray]:
        """Number (-1: in no example) and weight in its text's unit vector of each term."""
        term = find(hashes)
        raw = (1 + np.log(counts)) * np.where(term >= 0, self.weights[term] if len(self.weights) else 0.0, self.unseen)
        norm = np.sqrt(np.bincount(text, raw * raw, texts))
        return term, raw / norm[text]


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _batches(batches):
        text, hashes, count = terms(b.column("text"))
        at = np.searchsorted(text, np.arange(b.num_rows + 1))
        lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, kind))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), lists(hashes.astype(np.int64), pa.int64()), lists(count, pa.int32())], ["doc_id", "toxic", "terms", "counts"])


def sample(docs: DataFrame, labels: DataFrame, usable: Column, examples: int = EXAMPLES, most_bytes: int = EXAMPLE_BYTES) -> DataFrame:
    """doc_id, toxic, text of the labelled rows to learn from."""
    known = labels.filter(usable & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("long")).alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # bounded by ``examples``
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return found.withColumn("__bytes", F.sum(F.octet_length("text")).over(order)).filter(F.col("__bytes") <= most_bytes).drop("__bytes")


def train(docs: DataFrame, labels: DataFrame, usable: Column, examples: int = EXAMPLES, relevance: bool = True) -> Model:
    """A model of the labelled rows for which ``usable`` (of doc_id) holds, at most ``examples`` of them."""
    known = settled(sample(docs, labels, usable, examples), "examples").repartition(F.col("doc_id"))
    bags = known.mapInArrow(_bags, "doc_id long, toxic long, terms array<long>, counts array<int>").toArrow()  # the bounded sample
    bags = bags.sort_by("doc_id")
    flat = lambda c: bags.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    sizes = np.asarray([len(x) for x in bags.column("terms")], np.int64)
    ids, toxic = (bags.column(c).to_numpy() for c in ("doc_id", "toxic"))
    model = Model.build(ids.astype(np.int64), toxic.astype(float), np.concatenate([[0], np.cumsum(sizes)]), flat("terms").astype(U), flat("counts").astype(float), relevance)
    del bags, flat, ids, toxic
    give_back()
    return model


def _scorer(sent, passing: bool):
    """Scores; with ``passing`` the batch's own rows that stay under the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        find = m.finder()
        for b in _batches(batches):
            text, hashes, count = terms(b.column("text"))
            term, w = m.vectors(text, hashes, count, b.num_rows, find)
            at = np.searchsorted(text, np.arange(b.num_rows + 1))
            scores, evidence = np.zeros(b.num_rows), []
            for i, (example, cosine) in enumerate(m.nearest(at, term, w)):  # all that tie: not kept beyond the text
                scores[i] = m.calibrated(m.vote(example, cosine))
                if not passing:
                    evidence.append(m.ids[example[:3]].tolist())
            if passing:
                yield b.filter(pa.array(scores < THRESHOLD))
            else:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores), pa.array(evidence, pa.list_(pa.int64()))], ["doc_id", "score", "evidence"])
        give_back()

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), evidence (ids of the nearest examples) of every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scorer(sent, False), "doc_id long, score double, evidence array<long>")


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that score under the threshold, with all columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_scorer(sent, True), docs.schema)


def usable() -> Column:
    return crc_text("doc_id") % 4 != 2


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs, train(docs, labels, usable()))
    return scored.select("doc_id", F.coalesce(crc_text("doc_id") % 4 == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
