"""Suffix-array dedup (operator 10): removes every 50-byte string that also starts in a document with a smaller id.

Suffixes are not ordered one by one: plain most-significant-digit passes over all suffixes don't meet the limits (README).
Instead groups of equal strings are refined in passes, and after each pass only groups with more than one document go on.
What is grouped is content-defined: each window of 50 bytes is represented by the smallest hash of its 24-byte strings, so
equal windows have the same anchor at the same place, and the groups left at the end are exactly the repeated windows.

1. The 24 bytes at the anchor. Anchors that no other document has are done.
2. All bytes of the windows that share the anchor. Where a smaller document has the same, all are repeated.
3. Groups of the first pass in which the second finds the same everywhere are done too: their windows stand in no smaller
   document than the first one that has them.
4. The single windows of the anchors that are left.

Strings travel as 64-bit fingerprints dealt by a second fingerprint; equal fingerprints are taken as equal strings.

Defined cases: null and empty texts have 0 bytes and keep the digest of nothing; texts under 50 bytes are kept whole; rows
with a null doc_id neither remove nor lose anything; rows with the same id don't remove each other's bytes; texts of any
length are read whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from logweave.llm import kernels as K
from logweave.llm.common import settled, table
from logweave.llm.parts import ASKED, Earliest, Short, answer, answered, ask, earlier, holders, lay_out

LENGTH, GRAM = 50, 24
#: Windows looked at together; more would not leave enough bits of a hash beside the place.
STRIP = 1 << 20
U = np.uint64
SECOND = U(0xD1342543DE82EF95)
_SECOND_INVERSE = U(pow(int(SECOND), -1, 1 << 64))
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _grams(buf: np.ndarray) -> np.ndarray:
    """Mixed hash of the 24 bytes at each place."""
    h = K.BYTE[buf]
    power = lambda n: U(pow(int(K.BASE), n, 1 << 64))
    for step in (1, 2, 4):
        h = h[:-step] * power(step) + h[step:]
    out = h[:-8] * power(8) + h[8:]
    return K.mix(out[:-8] * power(8) + h[16:])


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    return v if have == width else np.minimum(v[: len(v) - (width - have)], v[width - have :])


class _Texts:
    """A part's texts cut to strips, and their anchors: first and last window, row, and hashes."""

    def __init__(self, rows: pa.Table, length: int):
        self.length = length
        self.ids = rows.column("doc_id").to_pylist()
        self.buf, self.at = K.texts(rows.column("text"))
        windows = np.maximum(np.diff(self.at) - length + 1, 0)
        windows[[i for i, d in enumerate(self.ids) if d is None]] = 0
        self.docs = np.array([0 if d is None else d for d in self.ids], np.int64)
        self.strips = []
        i, n = 0, len(windows)
        while i < n:  # several whole texts, or a piece of a long one
            j, total = i, 0
            while j < n and (j == i or total + self.at[j + 1] - self.at[j] <= STRIP):
                total += self.at[j + 1] - self.at[j]
                j += 1
            if total <= STRIP:
                self.strips.append((i, j, self.at[i:j], windows[i:j]))
            else:
                self.strips += [(i, j, self.at[i : i + 1] + s, np.minimum(windows[i : i + 1] - s, STRIP)) for s in range(0, int(windows[i]), STRIP)]
            i = j

    def _hashed(self, strip) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        _, _, start, windows = strip
        low, high = int(start[0]), int((start + windows).max()) + self.length - 1
        grams = _grams(self.buf[low : min(high, len(self.buf))]) if windows.any() else np.zeros(0, U)
        return low, grams, K.range_sums(grams), K.range_sums(grams, SECOND)

    def _hash(self, sums, second, low, begin, end):
        """Two hashes of the bytes from window ``begin`` to window ``end``."""
        a, b = begin - low, end - low + self.length - GRAM + 1
        return K.range_hash(sums, a, b), K.range_hash(second, a, b, _SECOND_INVERSE)

    def anchors(self) -> None:
        found = []
        place = U((1 << 24) - 1)
        for strip in self.strips:
            i, j, start, windows = strip
            if not windows.any():
                continue
            low, grams, sums, second = self._hashed(strip)
            least = _least((grams & ~place) | np.arange(len(grams), dtype=U), self.length - GRAM + 1)
            s = K.spread(start - low, windows)
            p = (least[s] & place).astype(np.int64)
            new = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)]))
            first, last = s[new] + low, s[np.concatenate([new[1:], [len(s)]]) - 1] + low
            row = np.searchsorted(start, first, "right") - 1 + i if j - i > 1 else np.full(len(first), i)
            one, two = self._hash(sums, second, low, first, last)
            found.append((grams[p[new]], first, last, row, one, two, np.full(len(first), len(found))))
        columns = zip(*found, strict=True) if found else [[np.zeros(0, U)]] + [[np.zeros(0, np.int64)]] * 3 + [[np.zeros(0, U)]] * 2 + [[np.zeros(0, np.int64)]]
        self.key, self.first, self.last, self.row, self.one, self.two, self.strip = (np.concatenate(c) for c in columns)
        self.used = [x for x in self.strips if x[3].any()]

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, ...]:
        """Place, row and two hashes of each window of the anchors ``which``."""
        out = []
        for k, strip in enumerate(self.used):
            here = which[self.strip[which] == k]
            if not len(here):
                continue
            low, _, sums, second = self._hashed(strip)
            counts = self.last[here] - self.first[here] + 1
            s = K.spread(self.first[here], counts)
            out.append((s, np.repeat(self.row[here], counts), *self._hash(sums, second, low, s, s)))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U)
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _pass(number: int, buckets: int, length: int):
    """The keys a part sends in passes 1 to 4; in pass 5 its documents' results."""

    def run(rows, answers):
        if not rows.num_rows:
            return _results([], None, None, None) if number == 5 else Short(np.zeros(0, U), buckets).table(0)
        part = rows.column("part")[0].as_py()
        t = _Texts(rows, length)
        t.anchors()
        docs = t.docs[t.row]
        short = Short(t.key, buckets)
        if number == 1:
            return short.table(part)
        least, most = np.full(len(short.distinct), np.iinfo(np.int64).max), np.full(len(short.distinct), np.iinfo(np.int64).min)
        np.minimum.at(least, short.of, docs)
        np.maximum.at(most, short.of, docs)
        shared = np.flatnonzero(((answered(answers, 1) > 1) | (least < most))[short.of])
        contexts = Earliest(t.one[shared], t.two[shared], docs[shared], buckets)
        if number == 2:
            return contexts.table(part)
        whole = contexts.repeated(answered(answers, 2))
        kept = np.flatnonzero(~whole)
        heads = kept[np.unique(contexts.of[kept], return_index=True)[1]]  # one for each context that no smaller document has
        groups = Short(t.key[shared[heads]], buckets)
        if number == 3:
            return groups.table(part)
        several = groups.distinct[(answered(answers, 3) > 1) | (groups.counts > 1)]
        place, row, one, two = t.windows(shared[kept[np.isin(short.joint[shared[kept]], several)]])
        single = Earliest(one, two, t.docs[row], buckets)
        if number == 4:
            return single.table(part)
        again = single.repeated(answered(answers, 4))
        done = shared[whole]
        begin = np.concatenate([t.first[done], place[again]])
        end = np.concatenate([t.last[done], place[again]]) + length
        step = np.bincount(begin, minlength=len(t.buf) + 1) - np.bincount(end, minlength=len(t.buf) + 1)
        return _results(t.ids, t.buf, t.at, np.cumsum(step)[:-1] > 0)

    return run


def _results(ids: list, buf, at, gone) -> pa.Table:
    n_bytes, removed, spans, digest = [], [], [], []
    for i in range(len(ids)):
        own, cut = buf[at[i] : at[i + 1]], gone[at[i] : at[i + 1]]
        n_bytes.append(len(own))
        removed.append(int(cut.sum()))
        spans.append(int(cut[:1].sum()) + int((cut[1:] & ~cut[:-1]).sum()))
        digest.append(hashlib.sha256(own[~cut].tobytes() if removed[-1] else own.tobytes()).hexdigest())
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digest, pa.string())})


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256."""
    parts = lay_out(docs)
    answers = answer(ask(parts, _pass(1, parts.count, length)), 1, holders)
    for number, decide in ((2, earlier), (3, holders), (4, earlier)):
        asked = ask(parts, _pass(number, parts.count, length), answers, ASKED)
        answers = answers.unionByName(answer(asked, number, decide))
    out = settled(ask(parts, _pass(5, parts.count, length), answers, OUT), "kept")
    parts.drop()
    return out


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


SQL = f"""
with t as (select doc_id, encode(coalesce(text, '')) as b, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
blocks as (select doc_id, n, k, substr(h, 2 * k::int + 1, {2 * (100 + LENGTH)}) as p from (select doc_id, n, h, unnest(range(0, greatest(n - {LENGTH} + 1, 0), 100)) as k from t)),
w as (select doc_id, k + j as i, md5_number(substr(p, 2 * j::int + 1, {2 * LENGTH})) as a
      from (select doc_id, k, p, unnest(range(0, least(100, n - {LENGTH} + 1 - k))) as j from blocks)),
least as (select a, min(doc_id) as d from w group by a having min(doc_id) < max(doc_id)),
hits as (select w.doc_id, w.i from w join least l on w.a = l.a where w.doc_id > l.d),
marked as (select doc_id, i, lag(i) over (partition by doc_id order by i) as before from hits),
runs as (select doc_id, i, sum(case when before is null or i > before + {LENGTH} then 1 else 0 end) over (partition by doc_id order by i) as run from marked),
spans as (select doc_id, run, min(i) as a, max(i) + {LENGTH} as z from runs group by doc_id, run),
cuts as (select doc_id, count(*) as n_spans, sum(z - a)::bigint as n_removed, list(z order by a) as zs, list(a order by a) as aa from spans group by doc_id),
kept as (
  select t.*, c.n_spans, c.n_removed,
         case when c.aa is null then h else list_aggregate(list_transform(list_zip([0::bigint] || zs, aa || [n::bigint]), lambda p: substr(h, 2 * p[1]::int + 1, 2 * (p[2] - p[1])::int)), 'string_agg', '') end as k
  from t left join cuts c using (doc_id))
select doc_id, n::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(k)) as kept_sha256 from kept
"""
