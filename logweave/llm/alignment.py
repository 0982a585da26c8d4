"""Cross-tokenizer alignment (operator 13): groups of tokens of two tokenizers that end at the same bytes, by pointer jumping.

A is a byte-level BPE (tokenizers library) and reads a blank and the text, B a piece BPE with byte fallback (sentencepiece)
that puts the blank there itself. Every token points to its farthest-right overlapping token: an A token to the B token that
holds its last byte, a B token to the A token that holds its last byte if that ends behind it, else to itself. Successors are
doubled until nothing changes; then every token points to the last token of its component, which labels its group.

Texts are cut before blanks that follow a sign which is no white space. There both tokenizers cut in any case (no pattern of
A goes on with white space after other signs, no piece of B holds a blank after another sign; both are checked when the
files are loaded), so each distinct stretch is encoded and aligned once per slice of texts, and documents are put together
from their stretches. Each slice sends its distinct pairs with their counts, not its documents' links; corpus-wide counts are
summed from those, joined back to the slices' distinct pairs, and the documents are scored slice by slice.

Defined cases: null and empty texts, and texts whose tokens' bytes don't give back the blank and the text (U+2581 in the
text), have no tokens: zeros and an empty digest; rows with a null doc_id are documents like others; repeated rows count as
often as they stand there; texts are read whole, a long one is a slice alone; other columns are ignored; an empty table gives
an empty result. Equal 64-bit hashes of stretches of one slice are taken as equal stretches.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import kernels as K
from logweave.llm.common import settled, table

SLICE_BYTES = 4 << 20
BLANK = "▁"
U = np.uint64
#: Rows of slices: one per document, and one per slice with its distinct pairs (A id in the upper half) and their number of
#: links, and for its distinct stretches the number of links and the places of their pairs.
PARTS = "part long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, stretches array<int>, pairs array<long>, counts array<long>, sizes array<int>, links array<int>"
OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _signs() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable bytes stand for themselves, the others follow
    in order from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Bytes:
    """The bytes of each token id."""

    def __init__(self, by_id: dict[int, bytes]):
        n = max(by_id) + 1
        self.length = np.array([len(by_id.get(i, b"")) for i in range(n)], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(n)), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[K.spread(self.start[ids], self.length[ids])]


class Tokenizers:
    """Both tokenizers and their tokens' bytes. Raises ValueError for files on which texts can't be cut as stated above."""

    def __init__(self, a_path: str, b_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        with open(a_path, encoding="utf-8") as f:
            said = json.load(f)
        cut = said.get("pre_tokenizer") or {}
        if said.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError(f"{a_path}: not a byte-level tokenizer that splits at white space")
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        signs = _signs()
        added = {t["id"]: t["content"].encode() for t in said.get("added_tokens", [])}
        self.a_bytes = Bytes({i: bytes(signs[c] for c in t) for t, i in said["model"]["vocab"].items() if i not in added} | added)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = {i: self.b.id_to_piece(i) for i in range(self.b.get_piece_size())}
        odd = [p for p in pieces.values() if BLANK in p.lstrip(BLANK)]
        if odd or "".join(self.b.id_to_piece(self.b.encode(" x  y "))) != f"{BLANK}{BLANK}x{BLANK}{BLANK}y{BLANK}":
            raise ValueError(f"{b_path}: pieces go over blanks, or blanks are changed")
        own = lambda i, p: b"" if self.b.is_control(i) or self.b.is_unknown(i) else bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode()
        self.b_bytes = Bytes({i: own(i, p) for i, p in pieces.items()})

    def encode(self, stretches: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Ids and number of tokens of each stretch; all begin with a blank, which B adds itself."""
        a = [e.ids for e in self.a.encode_batch(stretches, add_special_tokens=False)]
        b = self.b.encode([s[1:] for s in stretches], num_threads=1)
        return tuple((np.fromiter(itertools.chain.from_iterable(x), np.int64), np.fromiter(map(len, x), np.int64, len(x))) for x in (a, b))


_workers: dict[tuple[str, str], Tokenizers] = {}


def loaded(a_path: str, b_path: str) -> Tokenizers:
    """The tokenizers of this worker process."""
    if (a_path, b_path) not in _workers:
        _workers[a_path, b_path] = Tokenizers(a_path, b_path)
    return _workers[a_path, b_path]


def labels(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The B token that ends the component of each A and each B token. Both cover the same bytes without gaps; ``a_end`` and
    ``b_end`` are where their tokens end."""
    n = len(a_end)
    successor = np.concatenate([n + np.searchsorted(b_end, a_end - 1, "right"), np.searchsorted(a_end, b_end - 1, "right")])
    last = n + np.arange(len(b_end))
    behind = a_end[successor[n:]] > b_end
    successor[n:] = np.where(behind, successor[n:], last)
    while True:
        further = successor[successor]
        if np.array_equal(further, successor):
            return successor[:n] - n, successor[n:] - n
        successor = further


@dataclass
class Aligned:
    """Of each stretch: whether its bytes are given back, its numbers of tokens, groups and links, and its groups written
    down; the links of all stretches."""

    whole: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[bytes]
    links: np.ndarray  # A id in the upper half, B id in the lower


def _given_back(tokens: Bytes, ids: np.ndarray, counts: np.ndarray, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which stretches (one after the other in ``data``) are the bytes of their tokens."""
    of = np.repeat(np.arange(len(counts)), counts)
    made = np.bincount(of, tokens.length[ids], len(counts)).astype(np.int64)
    same = made == lengths
    at, from_ = np.cumsum(lengths) - lengths, np.cumsum(made) - made
    k = np.flatnonzero(same)
    differs = data[K.spread(at[k], lengths[k])] != tokens.of(ids)[K.spread(from_[k], lengths[k])]
    same[np.repeat(k, lengths[k])[differs]] = False
    return same


def _kept(ids: np.ndarray, counts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return ids[np.repeat(which, counts)], np.where(which, counts, 0)


def align(tokenizers: Tokenizers, stretches: list[str], data: np.ndarray, lengths: np.ndarray) -> Aligned:
    (a, n_a), (b, n_b) = tokenizers.encode(stretches)
    whole = _given_back(tokenizers.a_bytes, a, n_a, data, lengths) & _given_back(tokenizers.b_bytes, b, n_b, data, lengths)
    (a, n_a), (b, n_b) = _kept(a, n_a, whole), _kept(b, n_b, whole)
    a_end, b_end = np.cumsum(tokenizers.a_bytes.length[a]), np.cumsum(tokenizers.b_bytes.length[b])
    a_last, b_last = labels(a_end, b_end)
    n = len(whole)
    a_of, b_of = np.repeat(np.arange(n), n_a), np.repeat(np.arange(n), n_b)
    is_last = b_last == np.arange(len(b))
    n_groups = np.bincount(b_of[is_last], minlength=n)
    first = np.searchsorted(b_end, a_end - tokenizers.a_bytes.length[a], "right")  # the B token of an A token's first byte
    each = np.searchsorted(b_end, a_end - 1, "right") - first + 1
    links = np.repeat(a << 32, each) | b[K.spread(first, each)]
    n_links = np.bincount(a_of, each, n).astype(np.int64)
    heads = np.flatnonzero(is_last)
    a_to, b_to = np.searchsorted(a_last, heads, "right").tolist(), (heads + 1).tolist()
    a_said, b_said, at, x, y = list(map(str, a.tolist())), list(map(str, b.tolist())), 0, 0, 0
    written = []
    for s, t in zip(a_to, b_to, strict=True):
        written.append(f"{','.join(a_said[x:s])}|{','.join(b_said[y:t])}")
        x, y = s, t
    groups = []
    for count in n_groups.tolist():
        groups.append(";".join(written[at : at + count]).encode())
        at += count
    return Aligned(whole, n_a, n_b, n_groups, n_links, groups, links)


_SAFE = K.class_table(bytes(range(0x21, 0x7F)))
_LEAD2, _LEAD3 = K.class_table(bytes(range(0xC3, 0xE0))), K.class_table(bytes([0xE0, *range(0xE4, 0xF0)]))


def cuts(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Starts of the stretches: where texts begin, and blanks that follow a sign that surely is no white space, the last
    byte of a text excepted. All white space beyond ASCII begins with the bytes C2, E1, E2 or E3."""
    blank = np.flatnonzero(buf == 0x20)
    blank = blank[~np.isin(blank, np.concatenate([at[:-1], at[1:] - 1]))]
    before = lambda k: buf[np.maximum(blank - k, 0)]
    inner = lambda x: (x >= 0x80) & (x < 0xC0)
    safe = _SAFE[before(1)] | inner(before(1)) & (_LEAD2[before(2)] | inner(before(2)) & (_LEAD3[before(3)] | inner(before(3)) & (before(4) >= 0xF0)))
    return np.union1d(blank[safe], at[:-1][np.diff(at) > 0])


def with_blank(column: pa.Array) -> pa.Array:
    """A blank and the text; nothing for null and empty texts."""
    raw = pc.fill_null(column.cast(pa.large_binary()), b"")
    blank, none = pa.scalar(b" ", pa.large_binary()), pa.scalar(b"", pa.large_binary())
    return pc.if_else(pc.equal(pc.binary_length(raw), 0), none, pc.binary_join_element_wise(blank, raw, none))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values)])[first])


def _slice_rows(tokenizers: Tokenizers, part: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    buf, at = K.texts(with_blank(batch.column("text")))
    start = cuts(buf, at)
    end = np.concatenate([start[1:], [len(buf)]]).astype(np.int64) if len(start) else start
    first = np.searchsorted(start, at)
    keys = K.range_hash(K.range_sums(K.BYTE[buf]), start, end)
    _, where, of = np.unique(keys, return_index=True, return_inverse=True)
    raw, lengths = buf.tobytes(), end[where] - start[where]
    stretches = [raw[s:e].decode() for s, e in zip(start[where].tolist(), end[where].tolist(), strict=True)]
    x = align(tokenizers, stretches, buf[K.spread(start[where], lengths)], lengths)
    n = batch.num_rows
    whole = (_sums(~x.whole[of], first) == 0) & (np.diff(first) > 0)
    number = lambda v: pa.array(np.append(np.where(whole, _sums(v[of], first), 0), 0), pa.int64(), mask=np.append(np.zeros(n, bool), True))
    digests = [hashlib.sha256(b";".join([x.groups[k] for k in of[first[d] : first[d + 1]].tolist()])).hexdigest() if whole[d] else "" for d in range(n)]
    kept = np.repeat(whole, np.diff(first))
    used = np.bincount(of[kept], minlength=len(where))
    pairs, place = np.unique(x.links, return_inverse=True)
    counts = np.bincount(place, np.repeat(used, x.n_links), len(pairs)).astype(np.int64)
    offsets = np.append(np.concatenate([[0], np.cumsum(np.where(whole, np.diff(first), 0))]), kept.sum())
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(of[kept], pa.int32()))
    one = lambda v, kind: pa.concat_arrays([pa.nulls(n, pa.list_(kind)), pa.array([v], pa.list_(kind))])
    columns = [
        pa.array(np.full(n + 1, part), pa.int64()), pa.concat_arrays([batch.column("doc_id"), pa.nulls(1, pa.int64())]), number(x.n_a), number(x.n_b), number(x.n_groups), number(x.n_links),
        pa.array([*digests, None], pa.string()), lists, one(pairs, pa.int64()), one(counts, pa.int64()), one(x.n_links, pa.int32()), one(place, pa.int32()),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PARTS.split(", ")])


def _slicer(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 24
        for k, b in enumerate(K.slices(batches, limit=SLICE_BYTES)):
            yield _slice_rows(loaded(a_path, b_path), task + k, b)

    return run


def _score(rows: pa.Table, answers: pa.Table) -> pa.Table:
    """The documents of a slice with the sums over their links; answers: place of a pair, its count, whether it is a best."""
    docs = rows.filter(pc.is_null(rows.column("pairs")))
    own = rows.filter(pc.is_valid(rows.column("pairs")))
    if not own.num_rows:
        return pa.table({c.split()[0]: [] for c in OUT.split(", ")}, schema=_OUT)
    array = lambda c: np.asarray(own.column(c).combine_chunks().flatten())
    sizes, place = array("sizes"), array("links")
    n = len(array("pairs"))
    count, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if answers.num_rows:
        at = answers.column("place").to_numpy()
        count[at], best[at] = answers.column("count").to_numpy(), answers.column("best").to_numpy()
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    listed = docs.column("stretches").combine_chunks()
    if isinstance(listed, pa.ChunkedArray):
        listed = pa.concat_arrays(listed.chunks) if listed.num_chunks else pa.array([], pa.list_(pa.int32()))
    of, first = np.asarray(listed.flatten()), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    total = lambda v: pa.array(_sums(_sums(v[place], bounds)[of], first), pa.int64())
    columns = {c: docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")} | {"n_best": total(best), "count_sum": total(count), "groups_sha256": docs.column("groups_sha256")}
    return pa.table(columns, schema=_OUT)


_OUT = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in OUT.split(", ")])


def pair_counts(slices: DataFrame) -> DataFrame:
    """pair, count, best (1 where no pair of its B id has more links) of all links of the corpus."""
    each = slices.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.counts").alias("count"))
    summed = each.groupBy("pair").agg(F.sum("count").alias("count")).filter("count > 0")
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    tops = summed.groupBy(b_id.alias("b_id")).agg(F.max("count").alias("top"))  # at most one row per id of B's vocabulary
    return summed.withColumn("b_id", b_id).join(F.broadcast(tops), "b_id").select("pair", "count", (F.col("count") == F.col("top")).cast("long").alias("best"))


def alignments(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per row of ``docs``, see ``OUT``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = settled(rows.mapInArrow(_slicer(a_path, b_path), PARTS), "alignment")
    slices = parts.filter("pairs is not null").select("part", "pairs", "counts")
    asked = slices.select("part", F.posexplode("pairs").alias("place", "pair"))
    answers = asked.join(pair_counts(slices), "pair").select(F.col("part").alias("of_part"), "place", "count", "best")
    return parts.groupBy("part").cogroup(answers.groupBy("of_part")).applyInArrow(_score, OUT)


def labelled(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, a_ids, b_ids, a_group, b_group: the tokens of whole texts and the number of their group, from 0; null for
    texts without tokens."""
    schema = "doc_id long, a_ids array<int>, b_ids array<int>, a_group array<int>, b_group array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = loaded(a_path, b_path)
        for batch in K.slices(batches, limit=SLICE_BYTES):
            out = []
            for text in with_blank(batch.column("text")).to_pylist():
                (a, n_a), (b, n_b) = t.encode([text.decode()])
                data, length = np.frombuffer(text, np.uint8), np.array([len(text)])
                if not text or not (_given_back(t.a_bytes, a, n_a, data, length) & _given_back(t.b_bytes, b, n_b, data, length)).all():
                    out.append((None,) * 4)
                    continue
                a_last, b_last = labels(np.cumsum(t.a_bytes.length[a]), np.cumsum(t.b_bytes.length[b]))
                heads = np.unique(b_last)
                out.append((a, b, np.searchsorted(heads, a_last), np.searchsorted(heads, b_last)))
            lists = [pa.array(c, pa.list_(pa.int32())) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], ["doc_id", "a_ids", "b_ids", "a_group", "b_group"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(table(spark, sf_dir, "documents"), *paths())
