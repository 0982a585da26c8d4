"""Call stacks: frames, identity keys, symbol files, functions, source paths, annotated records."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from logweave.functions.text import replaced
from logweave.operators import scan
from logweave.operators.storage import settled

#: A line with a number before its first ``#``; what stands behind is read by ``PARTS``.
FRAME = r"(?md)^[ \t]*[0-9]+#[^\n]*$"
#: What a frame line says, step by step: number # module, then ``!guid,age!address``, ``!address`` or ``+0xaddress``.
PARTS = {
    "frame": r"regexp_replace(token, '^[ \t]+|[ \t\r]+$', '')",
    "number": "try_cast(substring_index(frame, '#', 1) as int)",
    "said": r"regexp_replace(substr(frame, length(substring_index(frame, '#', 1)) + 2), '^[ \t]+', '')",
    "module": "regexp_extract(said, '^[^!+]*', 0)",
    "tail": "split(substr(said, length(module) + 1), '!')",
    "identity": "if(size(tail) = 3 and tail[0] = '', split(tail[1], ','), null)",
    "address": "case when size(tail) = 3 then tail[2] when size(tail) = 2 and tail[0] = '' then tail[1] when size(tail) = 1 and lower(tail[0]) like '+0x%' then substr(tail[0], 2) end",
    "digits": "if(lower(address) like '0x%', substr(address, 3), address)",
}
GOOD = r"""number is not null and module <> '' and not module rlike r'[\p{IsWhite_Space}#]' and digits rlike '^[0-9A-Fa-f]{1,16}$'
  and (size(tail) < 3 or size(identity) = 2 and length(identity[0]) = 36 and try_to_binary(replace(identity[0], '-', ''), 'hex') is not null and length(replace(identity[0], '-', '')) = 32
       and array_join(transform(split(identity[0], '-'), x -> length(x)), ' ') = '8 4 4 4 12' and identity[1] rlike '^[0-9A-Fa-f]{1,8}$')"""
#: The same as one pattern of a line for ``frames``, which reads each line once; signs that Java's ``$`` passes over at the end.
_SPACE, _LAST = r"\t\n\v\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}", r"\x{85}\x{2028}\x{2029}"
_HEX, _GUID = r"[0-9A-Fa-f]{1,16}", r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"
_PLACE = rf"!(?:(?P<guid>{_GUID}),(?P<age>[0-9A-Fa-f]{{1,8}}[\r{_LAST}]?)!)?(?:0[xX])?(?P<address>{_HEX})|\+0[xX](?P<offset>{_HEX})"
_LINE = rf"^[ \t]*(?P<frame>(?P<number>[0-9]+)#[ \t]*(?P<module>[^!+#{_SPACE}]+)(?:{_PLACE})[{_LAST}]?)[ \t\r]*$"
# What is written behind a frame without a symbol.
NO_SYMBOLS, NOT_RESOLVED = "no symbols", "symbol not found"


_READ = [("i", IntegerType()), ("number", IntegerType()), ("module", StringType()), ("guid", StringType()), ("age", StringType()), ("digits", StringType()), ("start", IntegerType()), ("length", IntegerType()), ("frame", StringType())]


def read_frames(texts: pa.Array) -> pa.Array:
    """The frames of each text, all lines of a batch in one pass."""
    lines = pc.split_pattern(texts, "\n")
    sizes = pc.fill_null(pc.list_value_length(lines), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    line = pc.list_flatten(lines)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    of = np.repeat(np.arange(len(sizes)), sizes)
    lengths = pc.utf8_length(line).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    before = np.cumsum(lengths) - lengths
    start = before - before[ends[of]]
    like = pc.match_substring_regex(line, r"^[ \t]*[0-9]+#").to_numpy(zero_copy_only=False)
    count = np.cumsum(like) - like
    i = count - count[ends[of]]
    at = np.flatnonzero(like)
    got = pc.extract_regex(line.take(pa.array(at)), _LINE)
    short = pc.utf8_ltrim(pc.struct_field(got, "number"), "0")
    good = pc.fill_null(pc.less_equal(pc.binary_length(short), 10), False).to_numpy(zero_copy_only=False)
    at, got, short = at[good], got.filter(pa.array(good)), short.filter(pa.array(good))
    number = pc.cast(pc.if_else(pc.equal(short, ""), "0", short), pa.int64())
    good = pc.less(number, 1 << 31)
    at, got, number = at[good.to_numpy(zero_copy_only=False)], got.filter(good), number.filter(good)
    field = lambda name: pc.struct_field(got, name)
    filled = lambda name: pc.if_else(pc.equal(field(name), ""), pa.scalar(None, pa.string()), field(name))
    led = pc.utf8_length(pc.utf8_ltrim(line.take(pa.array(at)), " \t")).to_numpy(zero_copy_only=False)
    columns = [
        pa.array(i[at], pa.int32()), pc.cast(number, pa.int32()), field("module"), filled("guid"), filled("age"), pc.binary_join_element_wise(field("address"), field("offset"), ""),
        pa.array(start[at] + lengths[at] - 1 - led, pa.int32()), pc.utf8_length(field("frame")), field("frame"),
    ]
    held = np.searchsorted(at, ends)
    return pa.ListArray.from_arrays(pa.array(held, pa.int32()), pa.StructArray.from_arrays(columns, [n for n, _ in _READ]))


_frames = F.arrow_udf(read_frames, ArrayType(StructType([StructField(n, t) for n, t in _READ])))


def frames(rows: DataFrame, keys: tuple[str, ...] = ("file_id", "line_no"), text: str = "text") -> DataFrame:
    """keys, i, number, module, guid, age, rva (decimal), start (from 0), length, frame (as written, without the blanks
    around it) of each call-stack line. Lines whose number is beyond 32 bits are none."""
    read = rows.filter(F.col(text).contains("#")).select(*keys, F.explode(_frames(F.col(text))).alias("__x")).select(*keys, "__x.*")
    rva = F.conv("digits", 16, 10).cast("decimal(20,0)")
    return read.select(*keys, "i", "number", "module", "guid", "age", rva.alias("rva"), "start", "length", "frame")


def identity(frame_rows: DataFrame) -> DataFrame:
    """Adds pdb (base name of the module and .pdb) and index (GUID without dashes in capitals, then the age as a
    hexadecimal number; null without an identity)."""
    base = F.regexp_extract("module", r"[^/\\]*$", 0)
    name = F.concat(F.regexp_replace(base, r"\.[^.]*$", ""), F.lit(".pdb"))
    age = F.hex(F.conv("age", 16, 10).cast("long"))
    return frame_rows.select("*", name.alias("pdb"), F.upper(F.concat(F.regexp_replace("guid", "-", ""), age)).alias("index"))


def symbol_files(frame_rows: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Adds image_id: the first store that has the frame's file.

    ``catalogue``: store_ord, file_name, flat, index, other_index, image_id. An entry that isn't flat is filed under its
    index and wanted only by frames of that identity; a flat one is filed under its name alone, index and other_index are
    what the file itself says, and a frame with an identity takes it only if one of them is the same. In a store the filed
    entry comes before the flat one. The frames are read once and laid out, as are the files found for the distinct names, so
    that Spark knows how few these are.
    """
    frame_rows = settled(frame_rows, "frames")
    wanted = frame_rows.select("pdb", "index").distinct()
    same = F.col("c.index") == F.col("w.index")
    flat = F.col("w.index").isNull() | same | (F.col("c.other_index") == F.col("w.index"))
    match = (F.lower("file_name") == F.lower("pdb")) & F.when(F.col("c.flat"), flat).otherwise(same)
    found = wanted.alias("w").join(catalogue.alias("c"), match)
    best = found.groupBy(F.col("w.pdb").alias("pdb"), F.col("w.index").alias("__index")).agg(F.min_by("image_id", F.struct("store_ord", "flat", "image_id")).alias("image_id"))
    best = settled(best, "symbol-files")
    on = (F.col("f.pdb") == F.col("b.pdb")) & F.col("f.index").eqNullSafe(F.col("b.__index"))
    return frame_rows.alias("f").join(best.alias("b"), on, "left").select("f.*", "b.image_id")


def resolve(frame_rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds function, displacement, file, line, status: the symbol (image_id, rva, function, file, line) with the greatest
    address not above the frame's. Distinct addresses are resolved once, and a module with many is cut to ranges of
    addresses, so that no task sees all of it."""
    asked = frame_rows.filter("image_id is not null").select("image_id", "rva").distinct().select("image_id", "rva", F.lit(True).alias("asked"))
    known = symbols.groupBy("image_id", "rva").agg(F.min(F.struct(F.col("rva").alias("at"), "function", "file", "line")).alias("s")).withColumn("asked", F.lit(False))
    both = known.unionByName(asked, allowMissingColumns=True).withColumn("__o", F.col("rva") * 2 + F.col("asked").cast("int"))
    places = settled(both, "addresses")  # a symbol comes before the frames at its own address
    got = scan.running(places, ["image_id"], "__o", {"g": ("last", F.col("s"))}).filter("asked").select("image_id", "rva", "g")
    images = settled(symbols.select("image_id").distinct().withColumn("__known", F.lit(True)), "images")
    j = frame_rows.join(got, ["image_id", "rva"], "left").join(images, "image_id", "left")
    status = F.when(F.col("g").isNotNull(), "resolved").when(F.col("__known"), "not resolved").otherwise("no symbols")
    return j.select(*frame_rows.columns, F.col("g.function").alias("function"), (F.col("rva") - F.col("g.at")).cast("decimal(20,0)").alias("displacement"), F.col("g.file").alias("file"), F.col("g.line").alias("line"), status.alias("status"))


def source_paths(paths: DataFrame, catalogue: DataFrame) -> DataFrame:
    """path, root_ord, rel_path: the path itself if it exists (an entry without root_ord), else per root the longest tail
    of its parts that exists; the first root wins. A drive is no part."""
    given = paths.select("path").distinct()
    parts = F.filter(F.split(F.translate("path", "\\", "/"), "/"), lambda p: p != "")
    parts = F.when(F.get(parts, F.lit(0)).endswith(":"), F.slice(parts, 2, F.size(parts))).otherwise(parts)
    tail = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.array_join(F.slice("parts", i, F.size("parts")), "/"))
    tails = given.withColumn("parts", parts).filter("size(parts) > 0").select("path", F.explode(tail).alias("rel_path"))
    in_roots = tails.join(catalogue.filter("root_ord is not null"), "rel_path").select("path", "root_ord", "rel_path")
    whole = given.join(catalogue.filter("root_ord is null").select("rel_path").distinct(), F.col("path") == F.col("rel_path"))
    found = in_roots.unionByName(whole.select("path", F.lit(None).cast("int").alias("root_ord"), "rel_path"))
    best = F.min(F.struct(F.coalesce("root_ord", F.lit(-1)).alias("o"), -F.length("rel_path"), "rel_path", "root_ord"))
    return found.groupBy("path").agg(best.alias("b")).select("path", "b.root_ord", "b.rel_path")


def annotate(rows: DataFrame, resolved: DataFrame, keys: tuple[str, ...] = ("file_id", "line_no"), text: str = "text") -> DataFrame:
    """Adds ``annotated``: the text with each frame replaced by its number, module, function, displacement and place, or
    followed by why it has none."""
    place = F.when(F.col("file") != "", F.concat(F.lit(" ["), "file", F.lit(" @ "), F.coalesce("line", F.lit(0)).cast("string"), F.lit("]"))).otherwise(F.lit(""))
    place = F.coalesce(place, F.lit(""))
    away = F.when(F.col("displacement") > 0, F.concat(F.lit("+0x"), F.lower(F.hex(F.col("displacement").cast("long"))))).otherwise(F.lit(""))
    named = F.concat(F.col("number").cast("string"), F.lit("# "), "module", F.lit("!"), "function", away, place)
    why = F.when(F.col("status") == "no symbols", NO_SYMBOLS).otherwise(NOT_RESOLVED)
    shown = F.when(F.col("status") == "resolved", named).otherwise(F.concat("frame", F.lit("  ("), why, F.lit(")")))
    lists = resolved.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "length", shown.alias("s")))).alias("__f"))
    made = replaced(F.col(text), F.col("__f"))
    joined = rows.join(lists, list(keys), "left")
    return joined.select(*[rows[c] if c not in keys else F.col(c) for c in rows.columns], F.coalesce(made, F.col(text)).alias("annotated"))
