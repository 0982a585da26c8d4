"""Payloads embedded in record texts: JSON and XML, Base64, PEM, HEX, key-value pairs and terms.

Shape of each job: find candidates with a pattern, decode each distinct one once, join back and aggregate.
"""

from __future__ import annotations

import binascii
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from logweave.functions import decode, nested
from logweave.functions.der import describe
from logweave.functions.text import once, per_text

KEYS = ("file_id", "line_no")
BASE64 = r"(?<![A-Za-z0-9+/_=-])(?:[A-Za-z0-9+/]{16,}|[A-Za-z0-9_-]{16,})={0,2}(?![A-Za-z0-9+/_=-])"
_BREAK = r"(?:\s|\\r|\\n)"  # a line end as it is or as it is written
PEM = rf"-----BEGIN ([A-Z0-9][A-Z0-9 ]*)-----((?:{_BREAK}|[A-Za-z0-9+/])+=*{_BREAK}*)-----END \1-----"
#: What may hold HEX: signs of bytes and between bytes. ``functions.decode`` looks at it byte by byte.
HEX_SIGNS = r"[0-9A-Fa-f][0-9A-Fa-fxX ,:-]{16,}"
#: Texts beyond this number of characters are not searched for Base64, by definition.
LARGEST = 1 << 20
WHOLE = r"^(?:[A-Za-z0-9+/]{8,}|[A-Za-z0-9_-]{8,})={0,2}$"
PAIR = r"([A-Za-z_][\w.-]*)\s*[=:]\s*(\"[^\"]*\"|'[^']*'|\{[^{}]*\}|[A-Za-z]:\\[^\s,;\"]+|[^\s,;\"'{}\[\]()]+)"
#: Cut points tried on each side of a glued token.
GLUE = 16
#: Fewest characters of a fragment.
FRAGMENT = 16


def _candidates(rows: DataFrame, pattern: str, text: str, keys) -> DataFrame:
    some = rows.filter(F.col(text).rlike(pattern))
    return some.select(*keys, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("i", "token"))


def _readable(decoded: Column) -> Column:
    """Bytes as text if they are valid UTF-8 without control characters and with something to see."""
    seen = lambda t: F.when(F.is_valid_utf8(t) & ~t.rlike(r"[\p{Cc}&&[^\t\r\n]]") & t.rlike(r"\S"), t)
    return once(decoded.cast("string"), seen)


def _packed(token: Column) -> Column:
    body = F.translate(F.regexp_replace(token, "=+$", ""), "-_", "+/")
    left, given = F.length(body) % 4, F.length(token) - F.length(body)
    pad = F.when(left == 0, "").when(left == 2, "==").when(left == 3, "=")
    mixed = token.rlike("[+/]") & token.rlike("[-_]")
    return F.try_to_binary(F.when(~mixed & ((given == 0) | (given == F.length(pad))), F.concat(body, pad)), F.lit("base64"))


def base64_text(token: Column) -> Column:
    """The readable text of a Base64 token, standard or URL-safe, or null."""
    return _readable(once(token, _packed))


def base64(rows: DataFrame, text: str = "text", keys=KEYS) -> DataFrame:
    """keys, i, token, decoded of Base64 whose bytes are readable text: the text as a whole, or fragments of it that stand in
    no PEM block."""
    short = rows.filter(F.length(text) <= LARGEST).select(*keys, F.col(text).alias("__t"))
    whole = short.filter(F.trim("__t").rlike(WHOLE)).select(*keys, F.lit(0).alias("i"), F.trim("__t").alias("token")).withColumn("decoded", base64_text(F.col("token")))
    whole = whole.filter("decoded is not null")
    others = short.withColumn("__w", F.when(F.trim("__t").rlike(WHOLE), base64_text(F.trim("__t")))).filter("__w is null")
    found = _candidates(others.withColumn("__t", F.regexp_replace("__t", PEM, " ")), BASE64, "__t", keys)
    return whole.unionByName(found.withColumn("decoded", base64_text(F.col("token"))).filter("decoded is not null"))


def glued_base64(rows: DataFrame, text: str = "text", keys=KEYS) -> DataFrame:
    """keys, i, token, part, decoded: the most readable part of a token that is glued to other text by / - _ or +.

    A token is cut on one side: after each of its first ``GLUE`` joints, or before each of the last. Letters, digits, blanks
    and common signs of the text that a part decodes to count for it, other characters twice against it; the first of the
    best wins.
    """
    found = _candidates(rows, rf"[A-Za-z0-9+/_-]{{{FRAGMENT},}}={{0,2}}", text, keys)
    size, body = F.length("token"), F.length(F.regexp_replace("token", "=+$", ""))
    joint = lambda at: F.col("token").substr(at + 1, F.lit(1)).isin("/", "-", "_", "+")
    none = F.array().cast("array<int>")
    ahead = F.filter(F.when(size > FRAGMENT, F.sequence(F.lit(0), size - FRAGMENT - 1)).otherwise(none), joint)
    behind = F.filter(F.when(body > FRAGMENT, F.sequence(body - 1, F.lit(FRAGMENT), F.lit(-1))).otherwise(none), joint)
    cuts = F.concat(F.transform(F.slice(ahead, 1, GLUE), lambda a: F.col("token").substr(a + 2, size)), F.transform(F.slice(behind, 1, GLUE), lambda z: F.col("token").substr(F.lit(1), z)))
    parts = found.select(*keys, "i", "token", F.posexplode(cuts).alias("__n", "part")).withColumn("decoded", base64_text(F.col("part"))).filter("decoded is not null")
    against = F.length(F.regexp_replace("decoded", r"""(?U)[\p{L}\p{Nd}\s"{}\[\]:,.\-_/=@]""", ""))
    score = F.length("decoded") - 3 * against
    best = parts.groupBy(*keys, "i", "token").agg(F.max_by(F.struct("part", "decoded"), F.struct(score, -F.col("__n"))).alias("b"))
    return best.select(*keys, "i", "token", "b.part", "b.decoded")


def pem(rows: DataFrame, text: str = "text", keys=KEYS) -> DataFrame:
    """keys, i, label, n_bytes, sha1 of PEM blocks, with real or written line ends."""
    found = _candidates(rows, PEM, text, keys)
    body = F.regexp_replace(F.regexp_replace(F.regexp_extract("token", PEM, 2), r"\\[rn]", ""), r"\s", "")
    blob = F.when(F.length(body) % 4 == 0, F.try_to_binary(body, F.lit("base64")))
    return found.select(*keys, "i", F.regexp_extract("token", PEM, 1).alias("label"), blob.alias("b")).filter("b is not null").select(*keys, "i", "label", F.length("b").alias("n_bytes"), F.sha1("b").alias("sha1"))


def _described(found: DataFrame, blob: Column) -> DataFrame:
    """Adds the fields of the certificate or public key that the bytes are; null if they are neither. Each distinct one is
    read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([(n, {"int": pa.int32(), "bigint": pa.int64(), "array<string>": pa.list_(pa.string())}.get(t, pa.string())) for n, t in _KEY_FIELDS])
        for b in batches:
            raw = b.column(0)
            yield pa.RecordBatch.from_arrays([raw, pa.array([describe(x) for x in raw.to_pylist()], kind)], ["__b", "__k"])

    fields = ", ".join(f"{n}: {t}" for n, t in _KEY_FIELDS)
    rows = found.withColumn("__b", blob)
    some = rows.filter("__b is not null").select("__b").distinct()
    return rows.join(some.mapInArrow(run, f"__b binary, __k struct<{fields}>"), "__b", "left").select(*found.columns, "__k.*")


#: What is read of a key or certificate; those of a key alone are algorithm, bits and exponent.
_KEY_FIELDS = [("kind", "string"), ("algorithm", "string"), ("bits", "int"), ("exponent", "bigint"), ("subject", "string"), ("issuer", "string"), ("serial", "string"), ("not_before", "string"), ("not_after", "string"), ("thumbprint", "string"), ("signature", "string"), ("names", "array<string>")]


def _rsa_blob(token: str) -> list[dict]:
    """What a token says if it is a public key blob, else nothing."""
    body = token.rstrip("=")
    missing = -len(body) % 4
    if missing == 3 or len(token) - len(body) not in (0, missing):
        return []
    raw = binascii.a2b_base64(body + "=" * missing)
    number = lambda at: int.from_bytes(raw[at : at + 4], "little")
    bits = number(12)
    if raw[:2] != b"\x06\x02" or raw[8:12] != b"RSA1" or not 0 < bits < 1 << 31 or bits % 8 or len(raw) < 20 + bits // 8:
        return []
    name = {0xA400: "CALG_RSA_KEYX", 0x2400: "CALG_RSA_SIGN"}.get(number(4)) or "0x" + re.sub("^0{0,4}", "", f"{number(4):08X}")
    return [{"algorithm": name, "bits": bits, "exponent": number(16), "modulus": raw[20 : 20 + bits // 8][::-1].hex().upper()}]


_BLOB = StructType([StructField("algorithm", StringType()), StructField("bits", LongType()), StructField("exponent", LongType()), StructField("modulus", StringType())])
_rsa_blobs = per_text(_rsa_blob, pa.list_(pa.struct([("algorithm", pa.string()), ("bits", pa.int64()), ("exponent", pa.int64()), ("modulus", pa.string())])), ArrayType(_BLOB))


def rsa_blobs(rows: DataFrame, text: str = "text", keys=KEYS) -> DataFrame:
    """keys, i, token, kind, algorithm, bits, exponent, modulus (hexadecimal, highest byte first) of Base64 of 64 or more
    characters that holds a public key blob: a header of little-endian numbers with the letters RSA1, then the modulus."""
    found = _candidates(rows, r"(?<![A-Za-z0-9+/])Bg[A-Za-z0-9+/]{62,}={0,2}", text, keys)
    read = found.select(*keys, "i", "token", F.explode(_rsa_blobs(F.col("token"))).alias("__x"))
    return read.select(*keys, "i", "token", F.lit("rsa blob").alias("kind"), "__x.*")


def key_blobs(rows: DataFrame, text: str = "text", keys=KEYS) -> DataFrame:
    """keys, i, token, kind, algorithm, bits, exponent, modulus of bare keys: public key blobs (see ``rsa_blobs``), and Base64
    of 64 or more characters from MI on that holds a certificate or a public key in DER (no modulus)."""
    found = _candidates(rows, r"(?<![A-Za-z0-9+/])MI[A-Za-z0-9+/]{62,}={0,2}", text, keys)
    der = _described(found, _packed(F.col("token"))).filter("kind is not null")
    der = der.select(*keys, "i", "token", "kind", "algorithm", F.col("bits").cast("long").alias("bits"), "exponent", F.lit(None).cast("string").alias("modulus"))
    return rsa_blobs(rows, text, keys).unionByName(der)


def certificates(rows: DataFrame, text: str = "text", keys=KEYS) -> DataFrame:
    """keys, i, label and the fields of the certificates in PEM blocks."""
    found = _candidates(rows, PEM, text, keys).withColumn("label", F.regexp_extract("token", PEM, 1)).filter(F.col("label").isin("CERTIFICATE", "TRUSTED CERTIFICATE", "X509 CERTIFICATE"))
    body = F.regexp_replace(F.regexp_extract("token", PEM, 2), _BREAK, "")
    blob = F.when(F.length(body) % 4 == 0, F.try_to_binary(body, F.lit("base64")))
    return _described(found, blob).filter("kind = 'certificate'").drop("token", "kind")


def _hex_found(text: str) -> list[dict]:
    return [{"start": b, "token": text[b:e], "decoded": said} for b, e, raw in decode._hex_pieces(text) if (said := decode.hex_text(text[b:e], raw)) is not None]


_HEX_FOUND = StructType([StructField("start", IntegerType()), StructField("token", StringType()), StructField("decoded", StringType())])
hex_found = per_text(_hex_found, pa.list_(pa.struct([("start", pa.int32()), ("token", pa.string()), ("decoded", pa.string())])), ArrayType(_HEX_FOUND))


def hex_runs(rows: DataFrame, text: str = "text", keys=KEYS) -> DataFrame:
    """keys, i, token, decoded of runs of nine or more hexadecimal bytes that read as text: printable, with a letter, UTF-8 or
    else UTF-16LE below U+0800. Unbroken decimal digits are a number; zero bytes at the end are left out."""
    some = rows.filter(F.col(text).rlike(HEX_SIGNS)).select(*keys, F.posexplode(hex_found(F.col(text))).alias("i", "__x"))
    return some.select(*keys, "i", "__x.token", "__x.decoded")


def kinds(rows: DataFrame, text: str = "text", keys=KEYS, wanted=("pem", "base64", "hex")) -> DataFrame:
    """kind, n, n_distinct of the payloads found."""
    jobs = {"pem": lambda: pem(rows, text, keys).select(F.col("sha1").alias("v")), "base64": lambda: base64(rows, text, keys).select(F.col("token").alias("v")), "hex": lambda: hex_runs(rows, text, keys).select(F.col("token").alias("v"))}
    out = None
    for k in wanted:
        part = jobs[k]().withColumn("kind", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("v").alias("n_distinct"))


_decoded = per_text(decode.decoded, pa.string(), StringType())
_decoded_value = per_text(lambda v: [said] if (said := decode.decoded_value(v)) != v else [], pa.list_(pa.string()), ArrayType(StringType()))


def base64_values(rows: DataFrame, value: str, keys=KEYS) -> DataFrame:
    """keys, decoded of values (as ``leaves`` gives them) that are or hold Base64, PEM or HEX: the value with what they say."""
    return rows.select(*keys, F.explode(_decoded_value(F.col(value))).alias("decoded"))


def decoded_text(rows: DataFrame, text: str = "text", keys=KEYS) -> DataFrame:
    """Adds ``decoded``: the text with Base64 (as a whole, in fragments or glued to other text) and readable PEM blocks, then
    HEX runs, replaced by what they say; in JSON and XML only values are, and are escaped anew."""
    return rows.withColumn("decoded", _decoded(F.col(text)))


def pairs(rows: DataFrame, text: str = "text", keys=KEYS) -> DataFrame:
    """keys, i, key, value of every ``key = value`` and ``key: value``; quoted, braced and path values are kept whole."""
    found = _candidates(rows, PAIR, text, keys)
    value = F.regexp_replace(F.regexp_extract("token", PAIR, 2), "[.-]+$", "")
    return found.select(*keys, "i", F.regexp_extract("token", PAIR, 1).alias("key"), value.alias("value"))


_inner = per_text(nested.brackets, pa.list_(pa.string()), ArrayType(StringType()))


def terms(rows: DataFrame, text: str = "text", keys=KEYS) -> DataFrame:
    """keys, kind, term: contents of brackets (nested ones too), quoted strings and Windows paths. Only texts that hold a
    bracket reach Python."""
    out = rows.filter(F.col(text).rlike(r"[\])>]")).select(*keys, F.lit("bracket").alias("kind"), F.explode(_inner(F.col(text))).alias("term"))
    for kind, (p, group) in {"quoted": (r"\"([^\"]+)\"", 1), "path": (r"[A-Za-z]:\\(?:[\w .-]+\\)*[\w.-]+", 0)}.items():
        part = rows.filter(F.col(text).rlike(p)).select(*keys, F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(group))).alias("term"))
        out = out.unionByName(part)
    return out


def tokens(rows: DataFrame, text: str = "text", keys=KEYS) -> DataFrame:
    """keys, kind, term of the tokens: letters, digits, ``_ . -`` and apostrophes inside words, without dots before or
    dots and hyphens after them."""
    p = r"(?:[\p{L}\p{Nd}_.-]|(?<=[\p{L}\p{Nd}])'(?=[\p{L}\p{Nd}]))+"
    trimmed = F.transform(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)), lambda t: F.regexp_replace(t, r"^\.+|[.-]+$", ""))
    return rows.select(*keys, F.lit("token").alias("kind"), F.explode(trimmed).alias("term")).filter("term <> ''")


_LEAF = StructType([StructField("path", StringType()), StructField("start", IntegerType()), StructField("length", IntegerType()), StructField("value", StringType())])
_leaves = per_text(
    lambda t: [dict(zip(("path", "start", "length", "value"), x, strict=True)) for x in nested.values(t)],
    pa.list_(pa.struct([("path", pa.string()), ("start", pa.int32()), ("length", pa.int32()), ("value", pa.string())])), ArrayType(_LEAF),
)
_PART = StructType([StructField("start", IntegerType()), StructField("length", IntegerType()), StructField("kind", StringType()), StructField("payload", StringType())])
_parts = per_text(
    lambda t: [{"start": b, "length": e - b, "kind": k, "payload": t[b:e]} for b, e, k in nested.structured(t)],
    pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("kind", pa.string()), ("payload", pa.string())])), ArrayType(_PART),
)


def leaf_places(rows: DataFrame, payload: str = "payload", keys=KEYS) -> DataFrame:
    """keys, path, start (from 0), length (as written), value of every JSON value, names never, and of every XML text and
    attribute (``@name``). Comments and trailing commas are allowed."""
    return rows.select(*keys, F.explode(_leaves(F.col(payload))).alias("__x")).select(*keys, "__x.*")


def leaves(rows: DataFrame, payload: str = "payload", keys=KEYS) -> DataFrame:
    """keys, path, value of the same."""
    return leaf_places(rows, payload, keys).select(*keys, "path", "value")


def structured(rows: DataFrame, text: str = "text", keys=KEYS) -> DataFrame:
    """keys, start, length, kind, payload: outermost groups of braces or brackets that are JSON (comments and trailing commas
    allowed) and XML elements with elements inside, leftmost first. Only texts that hold a bracket reach Python."""
    some = rows.filter(F.col(text).rlike(r"[{<\[]"))
    return some.select(*keys, F.explode(_parts(F.col(text))).alias("__x")).select(*keys, "__x.*")
