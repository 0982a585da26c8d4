"""N-gram Jaccard join (operator 4): exact, size-aware, heavy-light.

A document's set holds its distinct shingles of five words. Two documents link if their sets have a Jaccard similarity
of 0.8 or more. Documents with equal sets form a class; classes are joined and stand for all their members.

Shingles are ordered by how many parts of the corpus hold them, rare ones first, so that a shingle in very many texts
comes last. A set that links with another of overlap c or more shares a shingle among its first size - c + 1, and two among its
first size - c + 2. Small sets enumerate the two-element subsets of the latter as keys, large sets put the former into
inverted lists that are scanned, and small sets near the boundary are listed too. The boundary is chosen by cost: subsets
to be emitted against pairs that the lists would give, summed per band of sizes.

Candidates are checked exactly. Each set has a sketch of 512 parities, and two sets differ in at least as many shingles
as their sketches in bits; pairs that differ in too many are not candidates. First each class is checked with a few
leaders, the closest by sketch of those drawn by hash for each key, which joins large groups of near copies in about as many checks as they have
members. Then every candidate pair whose classes are not in one component yet is checked, each key comparing the members
outside its largest component with all others, so no component is missed and no group is expanded into all its pairs. A key with many members is joined in tiles of
``TILE`` members a side. ``all_links=True`` checks every candidate pair, also inside components, and counts the links of
each document: exact, but as much work as there are links between different texts.

Defined cases: texts without words, empty and null texts have no shingles and are linked with nothing; fewer than five
words form one shingle; rows with a null doc_id have component null and link with nothing; repeated rows have equal sets;
if one id stands on different texts, each text is a document of its own and no link of any is lost; other columns are
ignored; an empty table gives an empty result. Shingles are 64-bit fingerprints of words; equal
fingerprints are taken as equal shingles.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.llm import kernels as K
from logweave.llm.common import settled, table
from logweave.llm.parts import Short, answer, answered, ask, holders, lay_out, scaled

WORDS, PERCENT = 5, 80
#: Set sizes at which small sets may end.
BOUNDARIES = [0, 8, 16, 32, 64, 128]
#: Leaders drawn for each key, and those of them that a class is checked with at first.
DRAWN, LEADERS = 8, 4
#: Members of a key on each side of a tile.
TILE = 2_000
U = np.uint64
SKETCH = [f"s{i}" for i in range(8)]
_SCHEMA = "doc_id long, digest string, n long, f1 long, f2 long, prefix array<long>, listed int, tokens array<long>, " + ", ".join(f"{c} long" for c in SKETCH)
_ARROW = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("prefix", pa.list_(pa.int64())), ("listed", pa.int32()), ("tokens", pa.list_(pa.int64())), *[(c, pa.int64()) for c in SKETCH]])


def shingle_sets(column, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, one text after the other, and where each text's begin."""
    buf, at = K.texts(column)
    buf = K.LOWER[buf]
    start, end, first = K.words(buf, at)
    word = K.range_hash(K.range_sums(K.BYTE[buf]), start, end) if len(start) else np.zeros(0, U)
    sums = K.range_sums(word)
    counts = np.diff(first)
    shingles = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    begin = K.spread(first[:-1], shingles)
    stop = begin + np.repeat(np.minimum(counts, width), shingles)
    flat = K.range_hash(sums, begin, stop) if len(begin) else np.zeros(0, U)
    bounds = np.concatenate([[0], np.cumsum(shingles)])
    sets = [np.unique(flat[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    sizes = np.array([len(s) for s in sets], np.int64)
    return np.concatenate(sets) if sets else flat, np.concatenate([[0], np.cumsum(sizes)])


def _sets(rows: pa.Table) -> tuple[list, np.ndarray, np.ndarray]:
    ids, flat, bounds = [], [], [np.zeros(1, np.int64)]
    for piece in K.slices([rows]):
        s, b = shingle_sets(piece.column("text"))
        ids += piece.column("doc_id").to_pylist()
        flat.append(s)
        bounds.append(b[1:] + bounds[-1][-1])
    return ids, np.concatenate(flat) if flat else np.zeros(0, U), np.concatenate(bounds)


def _held(ids: list, bounds: np.ndarray) -> np.ndarray:
    """Which shingles belong to rows that have an id."""
    return np.repeat(np.array([d is not None for d in ids], bool), np.diff(bounds))


def _ask(buckets: int):
    def run(rows, answers):
        part = rows.column("part")[0].as_py() if rows.num_rows else 0
        ids, flat, bounds = _sets(rows)
        return Short(flat[_held(ids, bounds)], buckets).table(part)

    return run


def _signatures(buckets: int, percent: int):
    def run(rows, answers):
        ids, flat, bounds = _sets(rows)
        held = _held(ids, bounds)
        short = Short(flat[held], buckets)
        seen = answered(answers, 1).astype(np.int64)
        counts = np.ones(len(flat), np.int64)
        counts[held] = np.where(seen > 1, seen, scaled(short.counts))[short.of] if len(short.of) else 0
        sizes = np.diff(bounds)
        alone = np.concatenate([[0], np.cumsum(counts < 2)])
        alone = alone[bounds[1:]] - alone[bounds[:-1]]
        sums = [np.concatenate([[U(0)], np.cumsum(K.mix(flat * c))]) for c in (K.BASE, U(0xC2B2AE3D27D4EB4F))]
        prints = [(s[bounds[1:]] - s[bounds[:-1]]).view(np.int64) for s in sums]
        need = -(-percent * sizes // 100)
        room = np.maximum(sizes - need + 1 - alone, 0)  # places of the prefix that rarer shingles leave
        prefix, listed, tokens, sketch = [], [], [], np.zeros((len(ids), len(SKETCH)), np.int64)
        for i in range(len(ids)):
            if ids[i] is None or room[i] + 1 <= 0 or sizes[i] - need[i] + 2 <= alone[i]:
                prefix.append(None), listed.append(0), tokens.append(None)
                continue
            own, count = flat[bounds[i] : bounds[i + 1]], counts[bounds[i] : bounds[i + 1]]
            shared = np.flatnonzero(count > 1)
            take = sizes[i] - need[i] + 2 - alone[i]
            best = own[shared[np.lexsort((own[shared], count[shared]))[:take]]]
            prefix.append(best.view(np.int64))
            listed.append(min(int(room[i]), len(best)))
            tokens.append(own.view(np.int64))
            parity = np.bincount((own & U(64 * len(SKETCH) - 1)).astype(np.int64), minlength=64 * len(SKETCH)) & 1
            sketch[i] = np.packbits(parity.astype(np.uint8)).view(np.int64)
        digests = [hashlib.md5((t or "").encode(), usedforsecurity=False).hexdigest() for t in rows.column("text").to_pylist()]
        return pa.table([pa.array(ids, pa.int64()), pa.array(digests, pa.string()), pa.array(sizes, pa.int64()), pa.array(prints[0]), pa.array(prints[1]), pa.array(prefix, pa.list_(pa.int64())), pa.array(listed, pa.int32()), pa.array(tokens, pa.list_(pa.int64())), *[pa.array(c) for c in sketch.T]], schema=_ARROW)

    return run


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of the undirected edges (a, b): smallest labels of neighbours, then jumps."""
    both = settled(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = settled(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        step = settled(step, "step")
        jump = step.join(step.select(F.col("node").alias("component"), F.col("component").alias("far")), "component", "left")
        after = settled(jump.select("node", "was", F.least("component", F.coalesce("far", "component")).alias("component")), "labels")
        if after.filter("component <> was").isEmpty():
            return after.select("node", "component")
        labels = after.select("node", "component")


def _boundary(sets: DataFrame) -> int:
    """The largest size of small sets, by cost per band of sizes."""
    band = F.lit(len(BOUNDARIES))
    for i in reversed(range(1, len(BOUNDARIES))):
        band = F.when(F.col("n") <= BOUNDARIES[i], F.lit(i)).otherwise(band)
    m = F.size("prefix")
    subsets = sets.groupBy(band.alias("band")).agg(F.sum(m * (m - 1) / 2).alias("cost"))
    lists = sets.select(band.alias("band"), F.explode(F.slice("prefix", F.lit(1), F.col("listed"))).alias("t")).groupBy("band", "t").count()
    scans = lists.groupBy("band").agg(F.sum(F.col("count") + F.col("count") * (F.col("count") - 1) / 2).alias("cost"))
    light, heavy = ({r.band: r.cost for r in d.collect()} for d in (subsets, scans))  # one row per band
    total = lambda x: sum(v for b, v in light.items() if b <= x) + sum(v for b, v in heavy.items() if b > x)
    return BOUNDARIES[min(range(len(BOUNDARIES)), key=total)]


def _keys(sets: DataFrame, small: int, percent: int) -> DataFrame:
    """kind, key, id, n, sketch: two-element subsets of small sets, inverted lists of large sets and those just below them."""
    near = sets.filter(F.col("n") * 100 >= percent * small)
    lists = near.select(F.lit("list").alias("kind"), F.explode(F.slice("prefix", F.lit(1), F.col("listed"))).alias("key"), "id", "n", *SKETCH)
    pair = lambda a, i: F.transform(F.slice("prefix", i + 2, F.size("prefix")), lambda b: F.xxhash64(a, b))
    subsets = sets.filter(F.col("n") <= small).select(F.lit("subset").alias("kind"), F.explode(F.flatten(F.transform("prefix", pair))).alias("key"), "id", "n", *SKETCH)
    return lists.unionByName(subsets)


def _gap(x: str, y: str) -> F.Column:
    """Bits in which two sketches differ: at most the number of shingles that only one of the sets has."""
    out = F.lit(0)
    for c in SKETCH:
        out = out + F.bit_count(F.col(x + c).bitwiseXOR(F.col(y + c)))
    return out


def _may_link(x: str, y: str, percent: int) -> F.Column:
    """Whether sizes and sketches leave it open that two sets link; sets that link differ in at most
    (100 - percent) / (100 + percent) of their sizes' sum."""
    n, m = F.col(f"{x}n"), F.col(f"{y}n")
    return (n * 100 >= percent * m) & (m * 100 >= percent * n) & (_gap(x, y) * (100 + percent) <= (n + m) * (100 - percent))


def _checked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of set ids whose sets link."""
    side = lambda x: sets.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("tokens").alias(f"t{x}"))
    both = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(both * 100 >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b")


def _tiled(x: DataFrame, y: DataFrame) -> DataFrame:
    """Pairs of members of each key (columns kind, key, x, y), no task with more than TILE members of a key on a side."""
    key = ["kind", "key"]
    tiles = lambda d, c: d.groupBy(*key).agg(F.ceil(F.count("*") / TILE).cast("int").alias(c))
    both = tiles(x, "__nx").join(tiles(y, "__ny"), key)

    def dealt(d: DataFrame, own: str, other: str, n: str, m: str, member: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(f"{member}.id"), F.col(n)).cast("int").alias(own)
        return d.join(both, key).select(*key, member, mine, F.explode(F.sequence(F.lit(0), F.col(m) - 1)).alias(other))

    return dealt(x, "__i", "__j", "__nx", "__ny", "x").join(dealt(y, "__j", "__i", "__ny", "__nx", "y"), [*key, "__i", "__j"])


def join(docs: DataFrame, percent: int = PERCENT, all_links: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, digest of the text, n_shingles, class_id, component, component_id) and links between classes (a, b).

    Equal sets form a class. The links connect each component; with ``all_links`` they are all links between classes, and
    documents have n_links: the other documents that they link with, those of their own class included.
    """
    parts = lay_out(docs)
    answers = answer(ask(parts, _ask(parts.count)), 1, holders)
    rows = ask(parts, _signatures(parts.count, percent), answers, _SCHEMA).withColumn("uid", F.monotonically_increasing_id())
    rows = settled(rows, "signatures")  # fixes the numbers
    parts.drop()
    same = ["n", "f1", "f2"]
    classes = rows.filter("n > 0 and doc_id is not null").groupBy(*same).agg(F.min("uid").alias("id"), F.min("doc_id").alias("least"), F.count("*").alias("members"))
    classes = settled(classes, "classes")
    sets = rows.filter("size(prefix) > 0").join(classes.select("id"), F.col("uid") == F.col("id"))
    sets = settled(sets.select("id", "n", "prefix", "listed", "tokens", *SKETCH), "sets")
    small = _boundary(sets)
    keys = settled(_keys(sets, small, percent), "keys")
    drawn = [F.min_by(F.struct("id", "n", *SKETCH), F.struct(F.xxhash64("key", "id", F.lit(i)), "id")) for i in range(DRAWN)]
    leaders = keys.groupBy("kind", "key").agg(F.count("*").alias("c"), F.array_distinct(F.array(*drawn)).alias("ls")).filter("c > 1").drop("c")
    each = keys.join(leaders, ["kind", "key"]).withColumn("l", F.explode("ls"))
    star = each.filter("id <> l.id").select("id", F.col("l.id").alias("leader"), _gap("", "l.").alias("gap"), _may_link("", "l.", percent).alias("good"))
    near = star.filter("good").groupBy("id", "leader").agg(F.min("gap").alias("gap"))
    first = F.row_number().over(Window.partitionBy("id").orderBy("gap", "leader"))  # one row for each key of a class at most
    few = near.withColumn("k", first).filter(F.col("k") <= LEADERS)
    tried = settled(few.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct(), "tried")
    one = settled(_checked(tried, sets, percent), "links")
    found = components(one)
    named = settled(keys.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id")), "named")
    sizes = named.groupBy("kind", "key", "component").count()
    tops = sizes.groupBy("kind", "key").agg(F.count("*").alias("c"), F.sum("count").alias("rows"), F.max_by("component", F.struct("count", "component")).alias("top"))
    tops = tops.filter("rows > 1" if all_links else "c > 1").select("kind", "key", "top")
    left = settled(named.join(tops, ["kind", "key"]), "open")
    side = lambda x: left.select("kind", "key", F.struct("id", "n", "component", "top", *SKETCH).alias(x))
    once = (F.col("y.component") == F.col("y.top")) | (F.col("x.id") < F.col("y.id"))
    apart = F.col("x.id") < F.col("y.id") if all_links else (F.col("x.component") != F.col("y.component")) & once
    listed = (F.col("kind") == "subset") | (F.greatest("x.n", "y.n") > small)
    outside = side("x") if all_links else side("x").filter("x.component <> x.top")
    cross = _tiled(outside, side("y")).filter(apart & listed & _may_link("x.", "y.", percent))
    more = cross.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    two = settled(_checked(more, sets, percent), "links")
    links = one.unionByName(two)
    final = components(links) if not two.isEmpty() else found
    grouped = classes.join(final.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    grouped = grouped.join(least, "component")
    if all_links:
        ends = links.select("a", "b").union(links.select("b", "a")).toDF("id", "other")
        weight = ends.join(classes.select(F.col("id").alias("other"), "members"), "other").groupBy("id").agg(F.sum("members").alias("others"))
        grouped = grouped.join(weight, "id", "left").withColumn("n_links", F.col("members") - 1 + F.coalesce("others", F.lit(0)))
    named = rows.join(grouped.drop("members", "others", "least"), same, "left")
    own = F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    counted = [F.coalesce("n_links", F.lit(0)).alias("n_links")] if all_links else []
    documents = named.select("doc_id", "digest", F.col("n").alias("n_shingles"), F.col("id").alias("class_id"), "component", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"), *counted)
    return documents, links


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))[0].select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each component, with all columns: that of the smallest id, then of the smallest MD5 of its text.

    Rows with equal id and text (null: empty) are one document: the one whose other columns come first as JSON stays. Rows
    without an id all stay.
    """
    found = join(docs, percent)[0].filter("doc_id = component_id")
    linked = found.filter("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "digest")).alias("k")).select("k.doc_id", "k.digest")
    kept = linked.unionByName(found.filter("component is null").select("doc_id", "digest")).distinct()
    kept = kept.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"))
    digest = F.md5(F.coalesce("text", F.lit("")))
    first = docs.join(kept, (F.col("doc_id") == F.col("__id")) & (digest == F.col("__digest")))
    others = F.to_json(F.struct(*[F.col(c) for c in docs.columns if c not in ("doc_id", "text")], F.lit(0).alias("__0")))
    whole = F.min_by(F.struct(*docs.columns), others)
    once = first.groupBy("__id", "__digest").agg(whole.alias("__row")).select("__row.*")
    return once.unionByName(docs.filter("doc_id is null"))


SQL = rf"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, hash(array_to_string(w[i:i + {WORDS - 1}], ' ')) as t
      from (select doc_id, w, unnest(range(1, case when len(w) = 0 then 1 else greatest(len(w) - {WORDS - 2}, 2) end)) as i from w)),
n as (select doc_id, count(*) as n from s group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.t = b.t and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from shared x join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= {PERCENT} * (na.n + nb.n - c)),
sides as (select a, b from links union all select b, a from links),
reach as (select doc_id, doc_id as other from documents union select r.doc_id, l.b from reach r join sides l on r.other = l.a)
select r.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(r.other)::bigint as component_id
from reach r left join n on n.doc_id = r.doc_id group by r.doc_id
"""
