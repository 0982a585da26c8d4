"""From lines to records and fields: assembly, extents, headers, format detection, field extraction, transformations.

``lines``: file_id, byte_offset, text (no line end). ``records``: file_id, line_no (from 0 by matching line), byte_offset,
text (continuation lines joined by line feeds). Lines before the first match are the header (line_no -1).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions.dialect import BEHIND, Pattern, compile_pattern
from logweave.functions.text import once, right_trimmed
from logweave.operators.scan import CHUNK, running


@dataclass(frozen=True)
class Format:
    """A log format: its pattern, the fields that get facets and exclusions, and its time field."""

    name: str
    regex: str
    indexed: tuple[str, ...] = ()
    time_field: str | None = None
    time_format: str | None = None
    transformations: tuple[str, ...] = field(default=())
    xor_mask: int = 0

    @property
    def pattern(self) -> Pattern:
        return compile_pattern(self.regex)

    def time_column(self) -> str | None:
        """The configured time field, else one called Time, whatever the case."""
        wanted = (self.time_field or "time").lower()
        return next((n for n in self.pattern.names if n.lower() == wanted), None)


PLAIN = Format("plain", r"^(?'Text'.*)")
#: Lines and characters of a file's head that decide on its format, and the least share of matching lines.
PROBE_LINES, PROBE_CHARS, LEAST_SHARE = 256, 1 << 20, 0.05


def _numbered(lines: DataFrame, fmt: Format, chunk: int) -> DataFrame:
    """Lines with the number of their record; -1 before the first."""
    start = F.col("text").rlike(fmt.pattern.java)
    numbered = running(lines, ["file_id"], "byte_offset", {"line_no": ("sum", start.cast("long"))}, chunk=chunk)
    return numbered.withColumn("line_no", F.col("line_no") - 1)


def _gathered(lines: DataFrame) -> DataFrame:
    pieces = F.array_sort(F.collect_list(F.struct("byte_offset", "text")))
    grouped = lines.groupBy("file_id", "line_no").agg(pieces.alias("p"))
    return grouped.select("file_id", "line_no", F.col("p")[0]["byte_offset"].alias("byte_offset"), F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))


def records(lines: DataFrame, fmt: Format, chunk: int = CHUNK) -> DataFrame:
    return _gathered(_numbered(lines, fmt, chunk).filter("line_no >= 0"))


def headers(lines: DataFrame, fmt: Format, chunk: int = CHUNK) -> DataFrame:
    """file_id, text of what stands before the first record, right-trimmed. Files without a record have no header, so none
    of them is gathered."""
    before = _numbered(lines, fmt, chunk).filter("line_no < 0")
    with_records = lines.filter(F.col("text").rlike(fmt.pattern.java)).select("file_id").distinct()
    return _gathered(before.join(with_records, "file_id", "left_semi")).select("file_id", right_trimmed(F.col("text")).alias("text"))


def plain(lines: DataFrame) -> DataFrame:
    """A record per line that isn't empty; runs of line ends are one terminator."""
    return records(lines.filter("text <> ''"), PLAIN)


def extents(rows: DataFrame, sizes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Adds byte_len: up to the next record, or to the end of the file. sizes: file_id, size."""
    w = Window.partitionBy("file_id", "c").orderBy("line_no")
    first = rows.groupBy("file_id", F.floor(F.col("line_no") / chunk).alias("c")).agg(F.min("byte_offset").alias("o"))
    after = first.select("file_id", (F.col("c") - 1).alias("c"), F.col("o").alias("next_chunk"))
    d = rows.withColumn("c", F.floor(F.col("line_no") / chunk))
    d = d.withColumn("n", F.lead("byte_offset").over(w)).join(after, ["file_id", "c"], "left").join(sizes, "file_id")
    end = F.coalesce("n", "next_chunk", "size")
    return d.select(*rows.columns, (end - F.col("byte_offset")).alias("byte_len"))


def field_column(text: Column, pattern: Pattern, name: str) -> Column:
    """A field of a record's first line; empty if its group takes no part; several groups of a name: the first filled."""
    groups = pattern.groups(name)
    got = [F.regexp_extract(text, pattern.java, g) for g in groups]
    return got[0] if len(got) == 1 else F.coalesce(*[F.when(g != "", g) for g in got], F.lit(""))


def fields(rows: DataFrame, fmt: Format, only: list[str] | None = None) -> DataFrame:
    """Adds a string column per field. The last field also takes the continuation lines."""
    return rows.select("*", *field_columns(fmt, only))


def field_columns(fmt: Format, only: list[str] | None = None) -> list[Column]:
    """The fields of a record's text, each under its name."""
    p = fmt.pattern
    first = F.substring_index("text", "\n", 1)
    rest = F.substring(F.col("text"), F.length(first) + 1, F.length("text"))
    last = p.names[-1]
    value = lambda n: F.concat(field_column(first, p, n), rest) if n == last else field_column(first, p, n)
    return [value(n).alias(n) for n in (only or p.names)]


def detect(lines: DataFrame, formats: list[Format]) -> DataFrame:
    """file_id, format, ratio: the format with the best share of matching lines in the file's head, the first on ties. Empty
    lines count, so ``lines`` should hold them.

    Files in which no format matches more than a twentieth of the lines are plain.
    """
    # only the head of a file can be among its first lines, so the window never holds more than that
    head = lines.filter(F.col("byte_offset") < PROBE_CHARS)
    head = head.withColumn("k", F.row_number().over(Window.partitionBy("file_id").orderBy("byte_offset"))).filter(F.col("k") <= PROBE_LINES)
    shares = head.groupBy("file_id").agg(*[F.avg(F.col("text").rlike(f.pattern.java).cast("double")).alias(f"r{i}") for i, f in enumerate(formats)])
    best = F.array_max(F.array(*[F.struct(F.col(f"r{i}").alias("ratio"), F.lit(-i).alias("o"), F.lit(f.name).alias("name")) for i, f in enumerate(formats)]))
    chosen = shares.select("file_id", best.alias("b"))
    good = F.col("b.ratio") > LEAST_SHARE
    return chosen.select("file_id", F.when(good, F.col("b.name")).otherwise(PLAIN.name).alias("format"), F.col("b.ratio").alias("ratio"))


def transform(text: Column, rules: list[str]) -> Column:
    """Ordered rules, each on the result of the one before: in its first match, the groups called Base64Decode become their
    decoded text (quotes and blanks around them are dropped, bytes that aren't UTF-8 become U+FFFD).

    A group that doesn't decode, other group names, and texts that a rule doesn't match stay as they are.
    """
    for rule in rules:
        p = compile_pattern(rule, single_line=True, behind="Base64Decode")
        if "Base64Decode" in p.names:
            text = once(text, _decoder(p))
    return text


def _decoder(p: Pattern):
    return lambda text: _decoded(text, p)


def _decoded(text: Column, p: Pattern) -> Column:
    out = text
    for group, behind in reversed(list(zip(p.groups("Base64Decode"), p.groups(BEHIND), strict=True))):
        raw, rest = (F.regexp_extract(text, p.java, g) for g in (group, behind))
        packed = F.btrim(raw, F.lit("\" \t\r\n"))
        said = F.make_valid_utf8(F.try_to_binary(F.when(F.length(packed) % 4 == 0, packed), F.lit("base64")).cast("string"))
        place = F.length(text) - F.length(rest) - F.length(raw) + 1
        out = F.when((raw != "") & said.isNotNull(), F.overlay(out, said, place, F.length(raw))).otherwise(out)
    return out
