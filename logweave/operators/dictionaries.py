"""Code dictionaries and ordered rules: occurrences, annotated text, classification; import and upsert of dictionaries.

``mappings``: list, ord (order of lists), item (order in the list), enabled, ignore_case, fields, value, mapping. Values are
trimmed; of equal values of a list the first counts. A value stands as a whole token: where it begins or ends with a letter,
digit or ``_``, no sign of a word may stand next to it. Each list is read on its own from the left, at one place its longest
value; of what all lists find the leftmost counts, then the longest, then that of the first list.

Values go to Aho-Corasick automata, so a text is read once however many there are. Beyond ``MOST_VALUES`` they are dealt to
blocks of about that size, each a pass over the texts; what the blocks find is settled together, so the result is the same.
"""

from __future__ import annotations

import json
import unicodedata
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from logweave.functions import decode
from logweave.functions.dialect import compile_pattern
from logweave.functions.text import per_text, replaced

#: Values of one block of automata.
MOST_VALUES = 200_000
#: A place where a value stands: start, length, order of its list, list, mapping.
Found = tuple[int, int, int, str, str]
_FOUND = StructType([StructField("start", IntegerType()), StructField("length", IntegerType()), StructField("ord", IntegerType()), StructField("list", StringType()), StructField("mapping", StringType())])
_FOUND_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ord", pa.int32()), ("list", pa.string()), ("mapping", pa.string())]))


def _known(mappings: DataFrame, field: str | None) -> DataFrame:
    """list, ord, mapping, ignore_case, v: what applies in ``field`` (None: the whole record, so only lists for all fields)."""
    scope = F.coalesce(F.size("fields") < 1, F.lit(True)) if "fields" in mappings.columns else F.lit(True)
    if field is not None and "fields" in mappings.columns:
        scope = scope | F.exists("fields", lambda f: F.lower(f) == field.lower())
    item = F.col("item") if "item" in mappings.columns else F.lit(0)
    rows = mappings.filter(scope).filter("enabled and trim(value) <> ''")
    rows = rows.select("list", "ord", "ignore_case", F.trim("value").alias("v"), F.coalesce("mapping", F.lit("")).alias("mapping"), item.alias("item"))
    same = F.when(F.col("ignore_case"), F.lower("v")).otherwise(F.col("v")).alias("v")
    return rows.groupBy("list", "ord", "ignore_case", same).agg(F.min(F.struct("item", "mapping")).alias("m")).select("list", "ord", "ignore_case", "v", F.col("m.mapping").alias("mapping"))


def _folded(text: str) -> str:
    """Lower case, sign by sign, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _in_word(c: str) -> bool:
    return c.isalnum() or c == "_" or unicodedata.category(c) in ("Mn", "Mc", "Pc")


class Values:
    """Automata of values: one for those in their own case, one for those in any."""

    def __init__(self, rows: list[tuple[int, str, bool, str, str]]):
        """order, name, whether case is ignored, value and mapping."""
        import ahocorasick

        self.automata = []
        for loose in (False, True):
            known: dict[str, list] = {}
            for order, name, ignored, value, mapping in rows:
                if ignored == loose:
                    known.setdefault(_folded(value) if loose else value, []).append((order, name, mapping))
            if known:
                a = ahocorasick.Automaton()
                for value, lists in known.items():
                    a.add_word(value, (len(value), _in_word(value[0]), _in_word(value[-1]), lists))
                a.make_automaton()
                self.automata.append((loose, a))

    def find(self, text: str) -> Iterator[Found]:
        """Every place where a value stands as a whole token, overlapping ones too."""
        for loose, a in self.automata:
            for last, (length, first_in, last_in, lists) in a.iter(_folded(text) if loose else text):
                start = last - length + 1
                if first_in and start and _in_word(text[start - 1]) or last_in and last + 1 < len(text) and _in_word(text[last + 1]):
                    continue
                for order, name, mapping in lists:
                    yield start, length, order, name, mapping


def settle(found: Iterator[Found]) -> list[Found]:
    """Each list from the left, the longest at one place; then all lists together in the same way, the first list on ties."""
    free: dict[int, int] = {}
    own = []
    for f in sorted(found, key=lambda f: (f[0], -f[1], f[2])):
        if f[0] >= free.get(f[2], 0):
            own.append(f)
            free[f[2]] = f[0] + f[1]
    out, end = [], 0
    for f in own:
        if f[0] >= end:
            out.append(f)
            end = f[0] + f[1]
    return out


_loaded: dict[str, Values] = {}


def _values(name: str, sent) -> Values:
    """The automata of this worker process; those of one block at a time."""
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = Values(sent.value)
    return _loaded[name]


def _blocks(known: DataFrame) -> list[Callable[[], Values]]:
    """What builds the automata on a worker, for each block of at most about ``MOST_VALUES`` values."""
    columns = ("ord", "list", "ignore_case", "v", "mapping")
    some = known.select(*columns).limit(MOST_VALUES + 1).collect()
    if len(some) <= MOST_VALUES:
        dealt = [some]
    else:
        n = -(-known.count() // MOST_VALUES)
        block = F.pmod(F.xxhash64("v"), F.lit(n))
        dealt = (known.filter(block == b).select(*columns).collect() for b in range(n))
    sc, out = known.sparkSession.sparkContext, []
    for rows in dealt:
        sent, name = sc.broadcast([tuple(r) for r in rows]), uuid.uuid4().hex
        out.append(lambda sent=sent, name=name: _values(name, sent))
    return out


def _as_rows(found: list[Found]) -> list[dict]:
    return [dict(zip(("start", "length", "ord", "list", "mapping"), f, strict=True)) for f in found]


def _settled_lists(column: pa.Array) -> pa.Array:
    return pa.array([None if x is None else _as_rows(settle(tuple(f.values()) for f in x)) for x in column.to_pylist()], _FOUND_ARROW)


_settled = F.arrow_udf(_settled_lists, ArrayType(_FOUND))


def _with_found(rows: DataFrame, known: DataFrame, text: str, keys: tuple[str, ...]) -> DataFrame:
    """keys and __found (the settled places, in order) of the rows that hold values."""
    blocks = _blocks(known)
    if len(blocks) == 1:
        one = per_text(lambda t: _as_rows(settle(blocks[0]().find(t))), _FOUND_ARROW, ArrayType(_FOUND))
        return rows.select(*keys, one(F.col(text)).alias("__found")).filter("size(__found) > 0")
    each = None
    for values in blocks:
        some = per_text(lambda t, values=values: _as_rows(list(values().find(t))), _FOUND_ARROW, ArrayType(_FOUND))
        part = rows.select(*keys, F.explode(some(F.col(text))).alias("f"))
        each = part if each is None else each.unionByName(part)
    return each.groupBy(*keys).agg(F.collect_list("f").alias("f")).select(*keys, _settled("f").alias("__found"))


def _cut(texts: pa.Array, places: pa.Array) -> pa.Array:
    return pa.array([[t[s : s + n] for s, n in (f.values() for f in x)] for t, x in zip(texts.to_pylist(), places.to_pylist(), strict=True)], pa.list_(pa.string()))


_tokens = F.arrow_udf(_cut, ArrayType(StringType()))


def occurrences(rows: DataFrame, mappings: DataFrame, text: str = "text", keys: tuple[str, ...] = ("file_id", "line_no"), field: str | None = None) -> DataFrame:
    """keys, i (number of the occurrence in the text), token, start (from 0), list, mapping of each value that occurs."""
    whole = rows.select(*keys, F.col(text).alias("__text"))
    found = _with_found(whole, _known(mappings, field), "__text", (*keys, "__text"))
    tokens = _tokens("__text", F.transform("__found", lambda f: F.struct(f["start"], f["length"])))
    each = found.select(*keys, F.posexplode(F.arrays_zip("__found", tokens.alias("token"))).alias("i", "x")).select(*keys, "i", "x.token", F.col("x.__found").alias("f"))
    return each.select(*keys, "i", "token", F.col("f.start").alias("start"), F.col("f.list").alias("list"), F.col("f.mapping").alias("mapping"))


def annotate(rows: DataFrame, mappings: DataFrame, text: str = "text", keys: tuple[str, ...] = ("file_id", "line_no"), field: str | None = None) -> DataFrame:
    """Adds ``annotated``: each value followed by its mapping in brackets."""
    known = _known(mappings, field)
    blocks = _blocks(known)
    spans = lambda c: F.transform(c, lambda f: F.struct((f["start"] + f["length"]).alias("start"), F.lit(0).alias("length"), F.concat(F.lit("("), f["mapping"], F.lit(")")).alias("s")))
    if len(blocks) == 1:
        said = per_text(lambda t: _annotated(t, blocks[0]()), pa.string(), StringType())
        return rows.withColumn("annotated", said(F.col(text)))
    found = _with_found(rows.select(*keys, F.col(text).alias("__text")).distinct(), known, "__text", (*keys, "__text"))
    made = found.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__text"), replaced(F.col("__text"), spans(F.col("__found"))).alias("__made"))
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys] + [F.col(text) == F.col("__text")]
    return rows.join(made, on, "left").select(*rows.columns, F.coalesce("__made", text).alias("annotated"))


def _spans(text: str, values: Values) -> list[decode.Span]:
    return [(s + n, s + n, f"({mapping})") for s, n, _, _, mapping in settle(values.find(text))]


def _annotated(text: str, values: Values) -> str:
    return decode.apply(text, _spans(text, values))


def annotate_payloads(rows: DataFrame, mappings: DataFrame, text: str = "text", field: str | None = None) -> DataFrame:
    """Adds ``annotated``: the same with regard to JSON and XML in the text, where only string values, texts and attributes
    are annotated and escaped anew, names never. Lists of at most ``MOST_VALUES`` values."""
    blocks = _blocks(_known(mappings, field))
    if len(blocks) > 1:
        raise ValueError(f"more than {MOST_VALUES} values")
    said = per_text(lambda t: decode.in_place(t, lambda x: _spans(x, blocks[0]()), lambda x: json.dumps(x, ensure_ascii=False)), pa.string(), StringType())
    return rows.withColumn("annotated", said(F.col(text)))


def occurrences_in_fields(rows: DataFrame, mappings: DataFrame, fields: list[str], keys: tuple[str, ...] = ("file_id", "line_no")) -> DataFrame:
    """``occurrences`` of each field's own lists, and the field."""
    out = None
    for name in fields:
        part = occurrences(rows, mappings, name, keys, name).withColumn("field", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def classify(rows: DataFrame, rules: list[str], text: str = "text") -> DataFrame:
    """Adds ``rule``: the number of the first rule that matches, null for none."""
    out = F.lit(None).cast("int")
    for i, r in reversed(list(enumerate(rules))):
        out = F.when(F.col(text).rlike(compile_pattern(r).java), F.lit(i)).otherwise(out)
    return rows.withColumn("rule", out)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Dictionaries of JSON files: a list object, an array of lists, or {value: mapping} named like its file. Comments and
    trailing commas are allowed; a file that can't be read fails as a whole."""
    strings, comments, commas = r'"(?:[^"\\\\]|\\\\.)*"', r"//[^\n]*|/\*[\s\S]*?\*/", r",(\s*[}\]])"
    whole = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    clean = F.regexp_replace(F.regexp_replace("value", f"({strings})|{comments}", "$1"), f"({strings})|{commas}", "$1$2")
    lists = "array<struct<name:string,enabled:boolean,ignoreCase:boolean,fields:array<string>,items:array<struct<value:string,mapping:string>>>>"
    text = F.trim(clean)
    shape = F.when(text.startswith("["), text).when(F.get_json_object(text, "$.items").isNotNull(), F.concat(F.lit("["), text, F.lit("]")))
    whole = whole.select("file", text.alias("t"), shape.alias("s"))
    kept = whole.withColumn("l", F.from_json("s", lists, {"mode": "FAILFAST"})).withColumn("flat", F.when(F.col("s").isNull(), F.from_json("t", "map<string,string>", {"mode": "FAILFAST"})))
    of_lists = kept.filter("s is not null").select(F.inline("l")).select("name", F.coalesce("enabled", F.lit(True)).alias("enabled"), F.coalesce("ignoreCase", F.lit(False)).alias("ignore_case"), "fields", F.posexplode("items").alias("item", "x")).select("name", "enabled", "ignore_case", "fields", "item", "x.value", "x.mapping")
    flat = kept.filter("s is null").select(F.regexp_replace("file", r"\.[^.]*$", "").alias("name"), F.lit(True).alias("enabled"), F.lit(False).alias("ignore_case"), F.lit(None).cast("array<string>").alias("fields"), F.lit(0).alias("item"), F.explode("flat").alias("value", "mapping"))
    return of_lists.unionByName(flat).withColumnRenamed("name", "list")


def upsert(current: DataFrame, imported: DataFrame) -> DataFrame:
    """Imported lists replace those of the same name, trimmed and whatever the case; others are added."""
    key = F.lower(F.trim("list"))
    names = imported.select(key.alias("__k")).distinct()
    kept = current.withColumn("__k", key).join(names, "__k", "left_anti").drop("__k")
    return kept.unionByName(imported, allowMissingColumns=True)
