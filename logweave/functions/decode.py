"""Decoding of Base64, PEM and HEX inside a text, in place; used inside tasks on single texts."""

from __future__ import annotations

import base64
import binascii
import html
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

from logweave.functions import nested

#: Characters of a whole value, of a fragment, of a text that is searched; cut points on each side; HEX bytes.
WHOLE, FRAGMENT, LARGEST, CUTS, HEX_BYTES = 8, 16, 1 << 20, 16, 9
_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_")
_DIGITS = frozenset("0123456789abcdefABCDEF")
_RUN, _HEX_RUN = re.compile(r"[A-Za-z0-9+/_-]+(=*)"), re.compile(r"[0-9A-Fa-f][0-9A-Fa-fxX ,:-]*")
_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9][A-Z0-9 ]*)-----")
Span = tuple[int, int, str]  # begin, end, what stands there instead


def apply(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for begin, end, said in sorted(spans):
        out += [text[at:begin], said]
        at = end
    return "".join([*out, text[at:]])


def readable(raw: bytes | None) -> str | None:
    """The bytes as text, if they are UTF-8 without control characters and something can be seen."""
    try:
        text = raw.decode() if raw else ""
    except UnicodeDecodeError:
        return None
    seen = any(not c.isspace() for c in text)
    return text if seen and not any(unicodedata.category(c) == "Cc" and c not in "\t\r\n" or c == "�" for c in text) else None


def token_text(token: str) -> str | None:
    """The readable text of a Base64 token, standard or URL-safe; PEM blocks in it are decoded too."""
    body = token.rstrip("=")
    given, missing = len(token) - len(body), -len(body) % 4
    if not body or missing == 3 or given not in (0, missing) or set(body) & set("+/") and set(body) & set("-_"):
        return None
    try:
        raw = base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * missing, validate=True)
    except binascii.Error:
        return None
    text = readable(raw)
    return apply(text, [s for s in _pem(text)]) if text and "-----BEGIN " in text else text


def _pem(text: str) -> Iterator[Span]:
    """PEM blocks whose content can be read, with it between their marks."""
    at = 0
    while m := _BEGIN.search(text, at):
        at = m.end()
        end = text.find(f"-----END {m[1]}-----", at)
        following = text.find("-----BEGIN ", at)
        if end < 0 or 0 <= following < end:
            continue
        body = "".join(re.sub(r"\\[rn]", "", text[at:end]).split())
        try:
            said = readable(base64.b64decode(body, validate=True)) if body and len(body) % 4 == 0 else None
        except binascii.Error:
            said = None
        if said:
            close = end + len(f"-----END {m[1]}-----")
            yield m.start(), close, f"{m[0]}\n{said.rstrip()}\n-----END {m[1]}-----"
            at = close


def _glued(token: str) -> Span | None:
    """The best readable part of a token that is glued to other text by / - _ or +: cut after one of the first joints, or
    before one of the last."""
    body = len(token.rstrip("="))
    ahead = [i + 1 for i in range(len(token) - FRAGMENT) if token[i] in "/-_+"][:CUTS]
    behind = [i for i in range(body - 1, FRAGMENT - 1, -1) if token[i] in "/-_+"][:CUTS]
    best, score = None, None
    for begin, end in [(i, len(token)) for i in ahead] + [(0, i) for i in behind]:
        said = token_text(token[begin:end])
        if said is not None:
            worth = sum(1 if c.isalnum() or c.isspace() or c in "\"{}[]:,.-_/=@" else -2 for c in said)
            if score is None or worth > score:
                best, score = (begin, end, said), worth
    return best


def _fragments(text: str, begin: int, end: int) -> Iterator[Span]:
    for m in _RUN.finditer(text, begin, end):
        if len(m[0]) < FRAGMENT or len(m[1]) > 2 or m[1] and text[m.end() : m.end() + 1] in _SIGNS and m.end() < end:
            continue
        said = token_text(m[0])
        found = (0, len(m[0]), said) if said is not None else _glued(m[0])
        if found:
            yield m.start() + found[0], m.start() + found[1], found[2]


def base64_spans(text: str) -> list[Span]:
    """The whole text (quotes and blanks around it aside), or else its readable PEM blocks and the fragments between them."""
    begin, end = len(text) - len(text.lstrip()), len(text.rstrip())
    if end - begin >= 2 and text[begin] in "\"'" and text[end - 1] == text[begin]:
        begin, end = begin + 1, end - 1
    if end - begin >= WHOLE and (said := token_text(text[begin:end])) is not None:
        return [(begin, end, said)]
    out, at = [], 0
    for block in _pem(text) if "-----BEGIN " in text else ():
        out += [*_fragments(text, at, block[0]), block]
        at = block[1]
    return out + list(_fragments(text, at, len(text)))


def _hex_pieces(text: str) -> Iterator[tuple[int, int, bytes]]:
    """Stretches of HEX bytes: between two a blank, a hyphen, a colon, or a comma with or without a blank, or nothing; before
    one perhaps 0x; no letter or digit around."""
    for run in _HEX_RUN.finditer(text):
        at, limit = run.start(), run.end()
        while at < limit:
            if at and text[at - 1].isalnum() or text[at] not in _DIGITS:
                at += 1
                continue
            i, raw, good = at, bytearray(), None
            while True:
                j = i + 2 if text[i : i + 2] in ("0x", "0X") else i
                if j + 2 > limit or text[j] not in _DIGITS or text[j + 1] not in _DIGITS:
                    break
                raw.append(int(text[j : j + 2], 16))
                i = j + 2
                if len(raw) >= HEX_BYTES and not text[i : i + 1].isalnum():
                    good = i, len(raw)
                i += 2 if text[i : i + 2] == ", " else text[i : i + 1] in (" ", "-", ":", ",") and i < limit
            if good:
                yield at, good[0], bytes(raw[: good[1]])
                at = good[0]
            else:
                at = max(i, at + 1)


def _printed(text: str) -> str | None:
    text = text.rstrip("\0")
    kinds = [unicodedata.category(c) for c in text]
    bad = any(k in ("Cn", "Co") or k == "Cc" and c not in "\t\r\n" for c, k in zip(text, kinds, strict=True))
    return text if not bad and any(k[0] == "L" for k in kinds) else None


def hex_text(piece: str, raw: bytes) -> str | None:
    """What a stretch of HEX bytes says: UTF-8, or else UTF-16LE below U+0800; PEM blocks in it are decoded. Unbroken decimal
    digits are a number."""
    if re.fullmatch(r"(?:0[xX])?[0-9]+", piece):
        return None
    said = None
    try:
        said = _printed(raw.decode())
    except UnicodeDecodeError:
        pass
    if said is None and len(raw) % 2 == 0 and max(raw[1::2]) < 8:
        said = _printed(raw.decode("utf-16-le"))
    return apply(said, list(_pem(said))) if said and "-----BEGIN " in said else said


def hex_spans(text: str) -> list[Span]:
    return [(b, e, said) for b, e, raw in _hex_pieces(text) if (said := hex_text(text[b:e], raw)) is not None]


def _json_literal(said: str) -> str:
    """JSON stays JSON, several lines become a list of lines, all else a string."""
    if said.strip()[:1] in ("{", "[") and nested.json_values(said.strip()) is not None:
        return said.strip()
    if "\n" in said:
        return json.dumps(said.replace("\r\n", "\n").rstrip("\n").split("\n"), ensure_ascii=False, separators=(",", ":"))
    return json.dumps(said, ensure_ascii=False)


def _xml_literal(said: str, quote: str) -> str | None:
    if quote == "[":
        return None if "]]>" in said else said
    out = html.escape(said, quote=False)
    return out.replace('"', "&quot;") if quote == '"' else out.replace("'", "&apos;") if quote == "'" else out


def in_place(text: str, spans_of: Callable[[str], list[Span]], literal: Callable[[str], str] = _json_literal) -> str:
    """The text with what ``spans_of`` finds replaced: in plain parts as it is, in values of JSON and XML escaped anew, in
    names and tags never."""
    out: list[Span] = []
    plain = lambda a, z: out.extend((a + b, a + e, said) for b, e, said in spans_of(text[a:z])) if z > a else None
    at = 0
    for begin, end, kind in nested.structured(text) if any(c in text for c in "{[<") else ():
        plain(at, begin)
        at = end
        part = text[begin:end]
        if kind == "json":
            for _, s, n, value in nested.json_values(part) or ():
                if part[s] == '"' and value and (found := spans_of(value)):
                    out.append((begin + s, begin + s + n, literal(apply(value, found))))
        else:
            for _, s, n, value, quote in nested.xml_values(part):
                if value and (found := spans_of(value)) and (said := _xml_literal(apply(value, found), quote)) is not None:
                    out.append((begin + s, begin + s + n, said))
    plain(at, len(text))
    return apply(text, out)


def decoded(text: str) -> str:
    """The text with Base64 and PEM, then HEX, replaced by what they say; texts beyond ``LARGEST`` keep their Base64."""
    if len(text) <= LARGEST:
        text = in_place(text, base64_spans)
    return in_place(text, hex_spans)


def decoded_value(value: str) -> str:
    """The same for a value that is taken from JSON or XML."""
    said = apply(value, base64_spans(value)) if len(value) <= LARGEST else value
    return apply(said, hex_spans(said))
