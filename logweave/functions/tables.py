"""SQL table functions over one text each, for lateral joins: log_spans, log_frames, log_payloads."""

from __future__ import annotations

from pyspark.sql import SparkSession

from logweave.functions.text import _starts
from logweave.operators.payloads import BASE64, PEM, hex_found
from logweave.operators.symbols import FRAME, GOOD, PARTS


def _text(pattern: str) -> str:
    """A pattern as a raw SQL string."""
    quote = "'" if "'" not in pattern else '"'
    return f"r{quote}{pattern}{quote}"


_PLACES = """
  select x.m as token, x.s as start from (
    select explode(arrays_zip(m, s)) as x from (
      select m, log_starts(transform(g, v -> length(v)), transform(m, v -> length(v))) as s
      from (select regexp_extract_all(text, {p}, 0) as m, split(text, {p}, -1) as g)))
"""
_BODY = "translate(regexp_replace({t}, '=+$', ''), '-_', '+/')"
_BYTES = {
    "pem": f"try_to_binary(regexp_replace(regexp_extract(token, {_text(PEM)}, 2), r'\\s|\\\\[rn]', ''), 'base64')",
    "base64": f"try_to_binary(rpad({_BODY.format(t='token')}, cast(ceil(length({_BODY.format(t='token')}) / 4) * 4 as int), '='), 'base64')",
}
_PATTERNS = {"pem": PEM, "base64": BASE64}


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session: ``select ... from records, lateral log_spans(text, 'x+')``."""
    spark.udf.register("log_starts", _starts)
    spark.udf.register("log_hex", hex_found)

    def function(name: str, arguments: str, columns: str, body: str) -> None:
        spark.sql(f"create or replace temporary function {name}({arguments}) returns table({columns}) return {body}")

    function("log_spans", "text string, pattern string", "start int, length int, value string", f"select start, length(token), token from ({_PLACES.format(p='pattern')})")
    read = f"select * from ({_PLACES.format(p=_text(FRAME))})"
    for name, expression in PARTS.items():
        read = f"select *, {expression} as {name} from ({read})"
    frame = "select number, module, identity[0], identity[1], cast(conv(digits, 16, 10) as decimal(20, 0)), start + length(regexp_extract(token, r'^[ \\t]*', 0))"
    function("log_frames", "text string", "number int, module string, guid string, age string, rva decimal(20, 0), start int", f"{frame} from ({read}) where {GOOD}")
    found = " union all ".join(f"select '{k}' as kind, start, token, cast({_BYTES[k]} as string) as said from ({_PLACES.format(p=_text(p))})" for k, p in _PATTERNS.items())
    seen = f"select kind, start, token, said from ({found}) where is_valid_utf8(said) and said rlike r'\\S' and not said rlike r'[\\p{{Cc}}&&[^\\t\\r\\n]]'"
    function("log_payloads", "text string", "kind string, start int, token string, decoded string", f"{seen} union all select 'hex', x.start, x.token, x.decoded from (select explode(log_hex(text)) as x)")
