"""Document fingerprints (operator 11): winnowing over k-grams of code points, with built-in functions only.

A k-gram stands at every code point; its value is the upper half of a 64-bit hash of its bytes in UTF-32. Of every ``window``
k-grams in a row the smallest is chosen, the rightmost one on ties; the fingerprint is what is chosen, in text order, with
its positions. So two texts that share a passage of ``k + window - 1`` code points share a chosen k-gram of it.

Texts are dealt once by (doc_id, hash of the text). There every k-gram is a row of a generated sequence whose hash is
computed in compiled code, and only those under ``1 / SPARSE`` of the range go on, for the smallest of a window is among them
wherever a window has any. The choice changes only where a k-gram enters or leaves, so two sliding frames at the rows left
give all choices. Stretches where a whole window has none are worked out from all their k-grams.

The edited text of a document has the choices of the windows inside its first part, of those inside the part of the next
document, and of those across the seam, which alone are worked out anew; they equal those of the edited text as a whole.

Defined cases: a null text is empty and has an empty fingerprint; texts of fewer than k code points are one k-gram; texts of
fewer than k + window - 1 are one window; two empty fingerprints have the likeness 1, an empty and another one 0; rows with
a null doc_id come first in the order, rows of one id follow by the hash of their text; rows of equal id and text are one
document, given back as often as they stand there; a document alone is its own next; other columns are ignored; an empty
table gives an empty result. Texts are read whole. Equal 64-bit hashes of texts of one id are taken as equal texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.llm.common import running_totals, table

K, WINDOW = 24, 77
#: One k-gram in so many is looked at first.
SPARSE = 16
#: Windows of a stretch that are worked out together.
PIECE = 2048
#: A document: whether it has no id, its id (0 without one), and the hash of its text; none is null, so joins keep the dealing.
KEY = ("no_id", "id", "text_hash")
_PLACES = (1 << 31) - 1


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _value(u: Column, p: Column, k: int) -> Column:
    """Hash of the k-gram at p above, what is left behind p below: the least of several is the rightmost of the smallest."""
    hashed = F.shiftrightunsigned(F.xxhash64(F.substring(u, p * 4 + 1, F.lit(4 * k))), 32)
    return F.shiftleft(hashed, 31) + (F.lit(_PLACES) - p)


def _place(v: Column) -> Column:
    return (F.lit(_PLACES) - v.bitwiseAND(F.lit(_PLACES))).cast("int")


def _hash(v: Column) -> Column:
    return F.shiftright(v, 31)


def _grams(n: Column, k: int) -> Column:
    """Number of k-grams of a text of n code points."""
    return F.when(n > 0, F.greatest(n - k + 1, F.lit(1))).otherwise(F.lit(0))


def _least(values: Column, window: int) -> Column:
    """The least of each ``window`` neighbours, by steps of four."""
    if window == 1:
        return values
    if window <= 4:
        return F.transform(values, lambda v, i: F.least(v, *[F.get(values, i + j) for j in range(1, window)]))
    have, steps = 4, []
    while have * 4 < window:
        steps.append(have)
        have *= 4
    last = sorted({min(j * have, window - have) for j in range(1, -(-window // have))})

    def at(m: Column, left: list[int]) -> Column:
        shifts = [left[0] * j for j in (1, 2, 3)] if left else last
        out = F.transform(m, lambda v, i: F.least(v, *[F.get(m, i + s) for s in shifts]))
        return _once(out, lambda x: at(x, left[1:])) if left else out

    first = F.transform(values, lambda v, i: F.least(v, *[F.get(values, i + j) for j in (1, 2, 3)]))
    return _once(first, lambda m: at(m, steps))


def _without_repeats(chosen: Column) -> Column:
    """Choices in order of their windows, each value once."""
    return _once(chosen, lambda x: F.filter(x, lambda c, i: (i == 0) | (c["v"] != F.get(x, i - 1)["v"])))


def _chosen(u: Column, begin: Column, end: Column, k: int, window: int) -> Column:
    """Array of (s, v): the choices of all windows of the k-grams from ``begin`` to before ``end``; fewer are one window."""
    none = F.array().cast("array<struct<s:int,v:bigint>>")
    values = lambda a, z: F.transform(F.sequence(a, z - 1), lambda p: _value(u, p, k))

    def piece(a: Column) -> Column:
        z = F.least(a + PIECE, end - window + 1)  # windows from a to before z
        minima = _once(values(a, z + window - 1), lambda h: F.slice(_least(h, window), 1, z - a))
        return F.transform(minima, lambda v, i: F.struct((a + i).cast("int").alias("s"), v.alias("v")))

    all_pieces = F.flatten(F.transform(F.sequence(begin, F.greatest(begin, end - window), F.lit(PIECE)), lambda a: _without_repeats(piece(a))))
    whole = F.array(F.struct(begin.cast("int").alias("s"), F.array_min(values(begin, end)).alias("v")))
    return F.when(end <= begin, none).when(end - begin <= window, whole).otherwise(_without_repeats(all_pieces))


def _keyed(docs: DataFrame) -> DataFrame:
    text, doc_id = F.coalesce("text", F.lit("")), F.col("doc_id").cast("long")
    return docs.select(doc_id.isNull().alias("no_id"), F.coalesce(doc_id, F.lit(0)).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def dealt(docs: DataFrame) -> DataFrame:
    """The key and text of the distinct texts of each id, dealt by the key; copies meet before they are sent. All that reads
    this reads the same columns, so that Spark deals texts once."""
    return _keyed(docs).groupBy(*KEY).agg(F.first("text").alias("text"))


def _doc_id() -> Column:
    return F.when(~F.col("no_id"), F.col("id")).alias("doc_id")


def _with_choices(texts: DataFrame, k: int, window: int) -> DataFrame:
    """Adds u (UTF-32), n (code points) and chosen, the array of (s, v): first window and value of each choice."""
    wide = texts.withColumn("u", F.encode("text", "UTF-32")).withColumn("n", (F.octet_length("u") / 4).cast("int"))
    each = wide.filter("n > 0").select(*KEY, "n", "u", F.explode(F.sequence(F.lit(0), _grams(F.col("n"), k) - 1)).alias("p"))
    some = each.select(*KEY, "n", "p", _value(F.col("u"), F.col("p"), k).alias("v")).filter(F.col("v") < (1 << 63) // SPARSE)
    order = Window.partitionBy(*KEY).orderBy("p")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    v, p, b, last = F.col("v"), F.col("p"), F.col("b"), _grams(F.col("n"), k) - 1
    seen = some.select(
        *KEY, "n", "p", "v", F.min("v").over(order.rangeBetween(1 - window, 0)).alias("a"), F.min("v").over(order.rangeBetween(1, window)).alias("b"),
        F.min(F.when(p < window, v)).over(whole).alias("f"), F.min("p").over(whole).alias("p0"), F.lead("p").over(order).alias("p1"),
    )
    enters = F.when(p < window, v == F.col("f")).otherwise(v == F.col("a"))
    follows = (p + window <= last) & (b > v) & (_place(b) != p + window)  # chosen as v leaves, unless it enters just then
    begin, until = p + 1, F.coalesce("p1", last + 1)
    marks = seen.select(
        *KEY, F.when(enters, F.struct(F.greatest(F.lit(0), p - window + 1).alias("s"), "v")).alias("x"), F.when(follows, F.struct((p + 1).alias("s"), b.alias("v"))).alias("y"),
        F.when(until - p > window, F.struct(begin.alias("begin"), until.alias("end"))).alias("gap"), F.when((p == F.col("p0")) & (p >= window), F.struct(F.lit(0).alias("begin"), p.alias("end"))).alias("gap0"),
    ).filter("x is not null or y is not null or gap is not null or gap0 is not null")
    found = marks.groupBy(*KEY).agg(F.concat(F.collect_list("x"), F.collect_list("y")).alias("c"), F.concat(F.collect_list("gap"), F.collect_list("gap0")).alias("gaps"))
    both = wide.alias("t").join(found.alias("f"), list(KEY), "left")
    grams = _grams(F.col("n"), k)
    everything = F.array(F.struct(F.lit(0).alias("begin"), grams.alias("end")))
    gaps = F.when(F.col("c").isNull(), everything).otherwise(F.col("gaps"))
    more = F.flatten(F.transform(gaps, lambda g: _chosen(F.col("u"), g["begin"], g["end"], k, window)))
    chosen = F.when(F.col("c").isNull() | (F.size("gaps") > 0), F.concat(F.coalesce("c", F.array().cast("array<struct<s:int,v:bigint>>")), more)).otherwise(F.col("c"))
    return both.select(*KEY, "text", "u", "n", _without_repeats(F.array_sort(chosen)).alias("chosen"))


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, text_hash, n_chars, positions, hashes of every distinct (doc_id, text)."""
    rows = _with_choices(dealt(docs), k, window)
    return rows.select(_doc_id(), "text_hash", F.col("n").cast("long").alias("n_chars"), F.transform("chosen", lambda c: _place(c["v"])).alias("positions"), F.transform("chosen", lambda c: _hash(c["v"])).alias("hashes"))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of hashes; 1 if both are empty."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union)


def digest(hashes: Column) -> Column:
    """One string for a fingerprint: the number of its hashes and the sha256 of them in order."""
    return F.concat(F.size(hashes).cast("string"), F.lit(":"), F.sha2(F.array_join(F.transform(hashes, lambda h: F.hex(h)), ","), 256))


def _followers(docs: DataFrame) -> DataFrame:
    """Keys of documents, the key and copies of the document before each (cyclic), and how many code points that one takes."""
    keys = _keyed(docs).select(*KEY, F.char_length("text").alias("n")).groupBy(*KEY, "n").agg(F.count("*").alias("copies"))
    ranked = running_totals(keys, [F.col("no_id").desc(), F.col("id"), F.col("text_hash")], {}, "r")
    total = ranked.agg(F.max("r").alias("top"))  # one row
    before = ranked.crossJoin(F.broadcast(total)).select(F.when(F.col("r") == F.col("top"), 0).otherwise(F.col("r") + 1).alias("r"), *[F.col(c).alias(f"to_{c}") for c in KEY], "copies", F.floor(F.col("n") / 2).cast("int").alias("need"))
    return ranked.select("r", *KEY).join(before, "r").drop("r")


def edited(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, copies, n_chars, edited_text, hashes, edited_hashes, next_hashes: each document, the text whose last half is
    replaced by the beginning of the next document, and the fingerprints of both and of the next document."""
    span = k + window - 1
    texts = dealt(docs)
    rows = _with_choices(texts, k, window)
    hashes = lambda c: F.transform(c, lambda x: _hash(x["v"]))
    taken = F.least("need", "n")
    sent = rows.join(_followers(docs), list(KEY)).select(
        *[F.col(f"to_{c}").alias(c) for c in KEY], "copies", F.substring("text", F.lit(1), taken).alias("tail"), taken.alias("q"), hashes(F.col("chosen")).alias("next_hashes"),
        F.size(F.filter("chosen", lambda c: c["s"] + span <= taken)).alias("inside"), _place(F.get("chosen", F.lit(0))["v"]).alias("first_place"),
    )
    keep = F.col("n") - F.floor(F.col("n") / 2).cast("int")
    j = rows.join(sent, list(KEY)).select(_doc_id(), "copies", "n", "text", "chosen", "tail", "q", "next_hashes", "inside", "first_place", keep.alias("keep"))
    # the code points on both sides of the seam that a window across it can reach
    a, length = F.greatest(F.lit(0), F.col("keep") - (span - 1)), F.col("keep") + F.col("q")
    seam = F.concat(F.substring("text", a + 1, F.col("keep") - a), F.substring("tail", F.lit(1), F.lit(span - 1)))
    j = j.withColumn("edited_text", F.concat(F.substring("text", F.lit(1), F.col("keep")), "tail")).withColumn("seam_at", a).withColumn("seam", F.encode(seam, "UTF-32"))
    m = (F.octet_length("seam") / 4).cast("int")
    across = F.when((m >= span) | (m == length), _chosen(F.col("seam"), F.lit(0), _grams(m, k), k, window)).otherwise(F.array().cast("array<struct<s:int,v:bigint>>"))
    flat = lambda c, shift: F.transform(c, lambda x: F.struct((_place(x["v"]) + shift).alias("at"), _hash(x["v"]).alias("h")))
    own = flat(F.filter("chosen", lambda c: c["s"] + span <= F.col("keep")), F.lit(0))
    rest = F.transform(F.slice("next_hashes", 1, F.col("inside")), lambda h, i: F.struct(F.when(i == 0, F.col("first_place") + F.col("keep")).alias("at"), h.alias("h")))
    one_each = lambda x: F.filter(x, lambda c, i: (i == 0) | ~c["at"].eqNullSafe(F.get(x, i - 1)["at"]) | c["at"].isNull())
    made = _once(F.concat(own, flat(across, F.col("seam_at")), rest), one_each)
    return j.select("doc_id", "copies", F.col("n").cast("long").alias("n_chars"), "edited_text", hashes(F.col("chosen")).alias("hashes"), F.transform(made, lambda c: c["h"]).alias("edited_hashes"), "next_hashes")


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edited(table(spark, sf_dir, "documents"))
    out = rows.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited_text", "UTF-8"), 256).alias("edited_sha256"), digest(F.col("hashes")).alias("fingerprint"), digest(F.col("edited_hashes")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"), likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"), F.size("hashes").cast("long").alias("n_hashes"), "copies",
    )
    return out.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies")
