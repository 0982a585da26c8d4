"""Token-ID output (operator 5): Parquet files with a list column of token ids.

Format: one row per document in ascending doc_id order over all files; ``doc_id`` and ``n_tokens`` delta encoded, ``ids``
a list of 32-bit integers with a dictionary (their values repeat, so pages hold bit-packed indexes). Row groups and pages
have fixed sizes and the files carry page indexes, so that a reader of some documents, or of ``doc_id`` and ``n_tokens``
alone, reads few pages. Files are numbered in order.

Texts are cut into pieces at places where the tokenizer's own splitting cuts in any case (ASCII white space; between two of
letters up to U+00FF, ASCII digits and most ASCII signs, or, for tokenizers that don't split there, between a letter and one
of ``.,!?;:``), each distinct piece is encoded once per worker with the tokenizers library, and documents are put together
from the ids of their pieces.

Defined cases: a null or empty text is the end id alone; rows with a null doc_id come first; repeated ids follow each
other, each with its own start; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.llm import kernels as K
from logweave.llm.common import give_back, scratch, table

END = 2
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 32 << 20, 256 << 10, 2_000
#: Pieces (16 bytes each) and their ids (4 bytes) that a worker keeps; beyond either it starts anew.
CACHE, CACHE_IDS = 500_000, 4_000_000
#: Bytes of text encoded together; a longer text stays whole.
SLICE_BYTES = 1 << 20
_WHITE, _LETTER, _STOP, _DIGIT, _REST = range(5)
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
#: ASCII signs next to which a splitting into letters, digits and signs always cuts: no ' (don't) and none of <|> (names of tokens).
SIGNS = bytes(x for x in range(33, 127) if x not in _LETTERS + b"0123456789'<|>")
#: Letters of U+00C0..U+00FF: the second bytes after 0xC3, without two signs.
_SECOND = K.class_table(bytes(x for x in range(0x80, 0xC0) if x not in b"\x97\xb7"))
#: What a byte-level vocabulary writes for the bytes whose own character is no visible one.
_BYTE_LEVEL = {b: 256 + 33 + b - 127 for b in range(127, 161)} | {173: 256 + 67}
_LETTERS_ONLY, _SIGNS_ONLY = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+"), re.compile(f"[{re.escape(SIGNS.decode())}]+")
_workers: dict[str, _Worker] = {}
#: Texts with every kind of cut, to check a tokenizer when it is loaded.
PROBES = ["Hello, World! It's a  test; isn't it?", "Tab\tline\n\nend.", "Été,à.b:c;ñ!", "A1b2.c3 x.5 -- (y)", "don't.'s 'LL"]
FINE_PROBES = ["outre### a#'s #'s5 'r5e", "20240131T23:59:60Z a_b-c/d\\e {\"k\":[1,22]}", "señorÍA ßÿ ÀÉ9 9é (ü)à× e\u0301=\u0338x"] + [f"a{c}b {c}1{c}é" for c in SIGNS.decode()]


def _table(stops: bytes, digits: bytes) -> np.ndarray:
    out = np.full(256, _REST, np.uint8)
    for kind, members in ((_WHITE, b" \t\n\v\f\r"), (_LETTER, _LETTERS), (_STOP, stops), (_DIGIT, digits)):
        out[list(members)] = kind
    return out


#: Bytes to kinds, for tokenizers that split into letters, digits and signs, and for others.
_FINE, _COARSE = _table(SIGNS, b"0123456789"), _table(b".,!?;:", b"")
#: Whether a cut is between two kinds, by 8 * first + second.
_CUTS = np.array([a != b and (_REST not in (a, b) or _WHITE in (a, b)) for a in range(8) for b in range(8)])


class _Worker:
    """A tokenizer and the ids of the pieces that this worker process has seen: sorted keys, and where a piece's ids lie."""

    def __init__(self, tokenizer, fine: bool):
        self.tokenizer, self.fine = tokenizer, fine
        self.digits = [self.tokenize(d) for d in "0123456789"] if fine else []
        self.clear()

    def clear(self) -> None:
        self.keys, self.begin, self.count, self.ids = np.zeros(0, K.U), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def tokenize(self, word: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(word)]

    def missing(self, keys: np.ndarray) -> np.ndarray:
        """Which of the sorted ``keys`` are not held."""
        at = np.searchsorted(self.keys, keys)
        held = at < len(self.keys)
        held[held] = self.keys[at[held]] == keys[held]
        return np.flatnonzero(~held)

    def add(self, keys: np.ndarray, pieces: list[str]) -> None:
        """Encode pieces of the sorted ``keys``, none of which is held."""
        new = self.encode(pieces)
        count = np.fromiter(map(len, new), np.int32, len(new))
        at = np.searchsorted(self.keys, keys)
        begin = len(self.ids) + np.cumsum(count, dtype=np.int32) - count
        self.keys, self.begin, self.count = np.insert(self.keys, at, keys), np.insert(self.begin, at, begin), np.insert(self.count, at, count)
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(new), np.int32, int(count.sum()))])

    def encode(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each piece. Letters alone need no splitting, and lower-case ones no normalising: the model alone does them;
        so it does signs alone, and single digits, where the tokenizer splits into such."""
        out: list = [None] * len(pieces)
        rest = []
        for i, p in enumerate(pieces):
            if p.isascii() and p.isalpha() and p.islower():
                out[i] = self.tokenize(p)
            elif not self.fine:
                rest.append(i)
            elif _LETTERS_ONLY.fullmatch(p):
                out[i] = self.tokenize(p.lower().encode().decode("latin-1").translate(_BYTE_LEVEL))
            elif _SIGNS_ONLY.fullmatch(p):
                out[i] = self.tokenize(p)
            elif p.isascii() and p.isdigit():
                out[i] = [t for d in p for t in self.digits[ord(d) - 48]]
            else:
                rest.append(i)
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out


def _worker(path: str) -> _Worker:
    if path not in _workers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _workers[path] = _checked(Tokenizer.from_file(path), path)
    return _workers[path]


def _checked(tokenizer, path: str) -> _Worker:
    """A worker for the tokenizer with the cuts under which texts have the ids of whole texts; ValueError if none are."""
    names = [f"a{t.content}b" for t in tokenizer.get_added_tokens_decoder().values()]
    for fine, probes in ((True, [PROBES, FINE_PROBES, names]), (False, [PROBES])):
        worker = _Worker(tokenizer, fine)
        if all(_encoded(worker, pa.array(x, pa.string()), END).to_pylist() == [[*tokenizer.encode(t, add_special_tokens=False).ids, END] for t in x] for x in probes):
            worker.clear()
            return worker
    raise ValueError(f"{path}: not a tokenizer that splits at white space and drops it, in lower case")


def _pieces(buf: np.ndarray, at: np.ndarray, kinds: np.ndarray = _FINE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of pieces and the first piece of each text."""
    kind = kinds[buf]
    lead = np.flatnonzero(buf[:-1] == 0xC3)
    lead = lead[_SECOND[buf[lead + 1]]]
    kind[lead] = kind[lead + 1] = _LETTER
    cut = np.ones(len(buf) + 1, bool)
    cut[1:-1] = _CUTS[(kind[:-1] << 3) | kind[1:]]
    cut[at] = True
    inside = kind != _WHITE
    start = np.flatnonzero(cut[:-1] & inside)
    end = np.flatnonzero(cut[1:] & inside) + 1
    return start, end, np.searchsorted(start, at)


def encode_texts(column: pa.Array, path: str, end: int = END) -> pa.ListArray:
    """The token ids of each text, with the end id."""
    return _encoded(_worker(path), column, end)


def _encoded(worker: _Worker, column: pa.Array, end: int) -> pa.ListArray:
    buf, at = K.texts(column)
    if b"<|" not in buf.tobytes():  # a special token's name would change its meaning in lower case
        buf = K.LOWER[buf]
    start, stop, first = _pieces(buf, at, _FINE if worker.fine else _COARSE)
    distinct, where, of = np.unique(K.range_hash(K.range_sums(K.BYTE[buf]), start, stop), return_index=True, return_inverse=True)
    if len(worker.keys) > CACHE or len(worker.ids) > CACHE_IDS:
        worker.clear()
    if len(new := worker.missing(distinct)):
        data = buf.tobytes()
        worker.add(distinct[new], [data[s:e].decode() for s, e in zip(start[where[new]].tolist(), stop[where[new]].tolist(), strict=True)])
    held = np.searchsorted(worker.keys, distinct)
    # the end id stands behind the kept ones, as one more piece that closes each text
    begin, count = np.append(worker.begin[held], len(worker.ids)), np.append(worker.count[held], 1)
    of = np.insert(of, first[1:], len(distinct))
    count = count[of]
    total = np.concatenate([[0], np.cumsum(count)])
    ids = np.append(worker.ids, np.int32(end))[K.spread(begin[of], count)]
    return pa.ListArray.from_arrays(pa.array(total[first + np.arange(len(first))], pa.int32()), pa.array(ids, pa.int32()))


def _encoder(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.slices(batches, limit=SLICE_BYTES):
            ids = encode_texts(b.column("text"), path, end)
            counts = np.diff(np.asarray(ids.offsets)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int32()), ids], ["doc_id", "n_tokens", "ids"])
        give_back()

    return run


def write(docs: DataFrame, out: str, tokenizer: str, end: int = END) -> None:
    """Encode ``docs`` (doc_id, text) and write the files to the new folder ``out``."""
    dealt = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    rows = dealt.mapInArrow(_encoder(tokenizer, end), "doc_id long, n_tokens int, ids array<int>")
    (rows.write.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "true")
     .option("parquet.enable.dictionary#doc_id", "false").option("parquet.enable.dictionary#n_tokens", "false")
     .option("parquet.dictionary.page.size", str(1 << 20)).option("parquet.block.size", str(ROW_GROUP_BYTES)).option("parquet.page.size", str(PAGE_BYTES))
     .option("parquet.page.row.count.limit", str(PAGE_ROWS)).parquet(out))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with their place: doc_id, n_tokens, ids, file_no, row_no. A task may write several files, numbered at
    the end of their names."""
    name = F.col("_metadata.file_name")
    number = F.regexp_extract(name, r"^part-(\d+)", 1).cast("long") * (1 << 24) + F.coalesce(F.regexp_extract(name, r"-c(\d+)\.", 1).try_cast("long"), F.lit(0))
    return spark.read.schema("doc_id long, n_tokens int, ids array<int>").parquet(path).select("*", number.alias("file_no"), F.col("_metadata.row_index").alias("row_no"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column("ids")
        at, flat = np.asarray(ids.offsets).tolist(), memoryview(np.asarray(ids.values).astype("<u4").view(np.uint8))
        crc = [zlib.crc32(flat[4 * x : 4 * y]) for x, y in zip(at, at[1:], strict=False)]
        counts = pa.array(np.diff(ids.offsets), pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("file_no"), b.column("row_no"), counts, pa.array(crc, pa.int64())], ["doc_id", "file_no", "row_no", "n_tokens", "ids_crc32"])


def describe(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32. Counts are summed per file first."""
    rows = read(spark, path)
    digests = rows.mapInArrow(_digests, "doc_id long, file_no long, row_no long, n_tokens long, ids_crc32 long")
    files = rows.groupBy("file_no").agg(F.sum("n_tokens").alias("__n"))  # one row per file
    before = F.coalesce(F.sum("__n").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.select("file_no", before.alias("__before"))
    inside = Window.partitionBy("file_no").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    local = digests.withColumn("__start", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return local.join(files, "file_no").select("doc_id", (F.col("__start") + F.col("__before")).alias("start"), "n_tokens", "ids_crc32")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "tokens")
    write(table(spark, sf_dir, "documents"), out, tokenizer_path())
    return describe(spark, out)
