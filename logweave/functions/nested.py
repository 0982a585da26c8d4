"""Nested texts: balanced groups, values of JSON and XML with their places, structured ranges. Each in time that grows with
the text, without recursion; used inside tasks on single texts."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from xml.parsers import expat

#: Levels of a JSON text, open tags that an end tag is looked for among, texts that may fail as XML.
DEEPEST, OPEN_TAGS, XML_FAILURES = 64, 64, 8

_SPACE = r"(?:[ \t\r\n]+|//[^\n]*|/\*[\s\S]*?\*/)*"
_STRING = r'"[^"\\\x00-\x1f]*(?:\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4})[^"\\\x00-\x1f]*)*"'
_NUMBER = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?(?![0-9.])"
_JSON = re.compile(f"{_SPACE}(?:({_STRING})|({_NUMBER})|(true|false|null)|([][{{}},:]))")
_END = re.compile(_SPACE + r"\Z")
_MARKUP = re.compile(r"<!--[\s\S]*?-->|<!\[CDATA\[([\s\S]*?)\]\]>|<\?[\s\S]*?\?>|<(/?)([^\s/<>\"'=!?]+)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*)>")
_ATTRIBUTE = re.compile(r"([^\s=\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")


def groups(text: str, opening: str, closing: str) -> list[tuple[int, int]]:
    """Begin and end of the outermost balanced groups of one kind of bracket; a group that is never closed ends the list."""
    out, depth, begin = [], 0, 0
    for m in re.finditer(f"[{re.escape(opening + closing)}]", text):
        if m[0] == opening:
            begin = begin if depth else m.start()
            depth += 1
        elif depth:
            depth -= 1
            if not depth:
                out.append((begin, m.end()))
    return out


def unescaped(literal: str) -> str:
    value = json.loads(literal) if "\\" in literal else literal[1:-1]
    return value.encode("utf-8", "replace").decode() if "\\u" in literal else value


def json_values(text: str, deepest: int = DEEPEST) -> list[tuple[str, int, int, str | None]] | None:
    """Path, start, length (as written) and value of every value of a JSON text that is neither object nor array; None if it
    isn't JSON. Comments and trailing commas are allowed, names are no values, more than ``deepest`` levels are no JSON."""
    out: list[tuple[str, int, int, str | None]] = []
    stack: list[tuple[str, str]] = []  # bracket, path of what is in it
    path, at, wanted = "$", 0, "value"
    while wanted != "end":
        m = _JSON.match(text, at)
        if not m:
            return None
        at = m.end()
        string, number, word, sign = m.groups()
        if wanted == "name" and string:
            path, wanted = f"{stack[-1][1]}.{unescaped(string)}", "colon"
        elif wanted == "colon" and sign == ":":
            wanted = "value"
        elif wanted in ("value", "item") and (string or number or word):
            raw = string or number or word
            out.append((path, at - len(raw), len(raw), unescaped(string) if string else None if word == "null" else raw))
            wanted = "comma" if stack else "end"
        elif wanted in ("value", "item") and sign in ("{", "["):
            if len(stack) == deepest:
                return None
            stack.append((sign, path))
            path, wanted = f"{path}[]", "name" if sign == "{" else "item"
        elif wanted == "comma" and sign == ",":
            path, wanted = f"{stack[-1][1]}[]", "name" if stack[-1][0] == "{" else "item"
        elif wanted in ("comma", "name", "item") and stack and sign == {"{": "}", "[": "]"}[stack[-1][0]]:
            stack.pop()
            wanted = "comma" if stack else "end"
        else:
            return None
    return out if _END.match(text, at) else None


def is_xml(text: str) -> bool:
    """Whether the text is well-formed XML; one that declares types or entities counts as none."""
    if "<!DOCTYPE" in text:
        return False
    try:
        expat.ParserCreate().Parse(text.encode(), True)
    except (expat.ExpatError, UnicodeEncodeError, ValueError):
        return False
    return True


def xml_values(text: str) -> list[tuple[str, int, int, str, str]]:
    """Path, start, length (as written), value and quote of every attribute (``@name``) and every text that isn't blank of a
    well-formed XML text. The quote of a text is empty, that of a CDATA section ``[``."""
    out, stack, at = [], ["$"], 0

    def said(begin: int, end: int, quote: str = "") -> None:
        raw = text[begin:end]
        if raw.strip():
            out.append((stack[-1], begin, end - begin, raw if quote else html.unescape(raw), quote))

    for m in _MARKUP.finditer(text):
        said(at, m.start())
        at = m.end()
        if m[1] is not None:
            said(m.start(1), m.end(1), "[")
        elif m[3] and m[2]:
            stack.pop()
        elif m[3]:
            inside = m[4].endswith("/")
            stack.append(f"{stack[-1]}.{m[3]}")
            for a in _ATTRIBUTE.finditer(text, m.start(4), m.end(4)):
                k = 2 if a[2] is not None else 3
                out.append((f"{stack[-1]}.@{a[1]}", a.start(k), len(a[k]), html.unescape(a[k]), "\"'"[k - 2]))
            if inside:
                stack.pop()
    said(at, len(text))
    return out


def _xml_elements(text: str) -> Iterator[tuple[int, int, int]]:
    """Begin (of the declaration, if one stands before), begin of the tag and end of the elements with elements inside."""
    tags: list[list] = []  # name, begin, whether elements are inside
    declared: dict[int, int] = {}
    for m in _MARKUP.finditer(text):
        if m[0].startswith("<?xml"):
            declared[re.compile(r"\s*").match(text, m.end()).end()] = m.start()
        if not m[3]:
            continue
        if m[2]:
            near = next((i for i in range(len(tags) - 1, max(-1, len(tags) - 1 - OPEN_TAGS), -1) if tags[i][0] == m[3]), None)
            if near is not None:
                _, begin, inside = tags[near]
                del tags[near:]
                if inside:
                    yield declared.get(begin, begin), begin, m.end()
        elif m[3][0].isalpha() or m[3][0] == "_":
            if tags:
                tags[-1][2] = True
            if not m[4].endswith("/"):
                tags.append([m[3], m.start(), False])


def _apart(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Of ranges (begin, end, kind) the first, the longest where several begin, that don't overlap."""
    out: list[tuple[int, int, str]] = []
    for r in sorted(found, key=lambda r: (r[0], -r[1])):
        if not out or r[0] >= out[-1][1]:
            out.append(r)
    return out


def structured(text: str) -> list[tuple[int, int, str]]:
    """Begin, end and kind (json, xml) of the structured parts of a text: outermost groups of braces or brackets that are
    JSON, and XML elements with elements inside; the first and longest that don't overlap."""
    found = [(b, e, "json") for pair in ("{}", "[]") for b, e in groups(text, *pair) if json_values(text[b:e]) is not None]
    if "<" in text:
        failed, end = 0, 0
        for begin, tag, close in sorted(_xml_elements(text), key=lambda x: (x[1], -x[2])):
            if tag < end:
                continue
            if is_xml(text[begin:close]):
                found.append((begin, close, "xml"))
                end = close
            elif (failed := failed + 1) >= XML_FAILURES:
                break
    return _apart(_apart([f for f in found if f[2] == "json"]) + [f for f in found if f[2] == "xml"])


def values(text: str) -> list[tuple[str, int, int, str | None]]:
    """Path, start, length and value of every value of a JSON or XML text; none if it is neither."""
    found = json_values(text)
    if found is None and text.lstrip().startswith("<") and is_xml(text.strip()):
        found = [x[:4] for x in xml_values(text)]
    return found or []


def brackets(text: str) -> list[str]:
    """Contents of every matched pair of [ ], < > and ( ), nested ones too, unless blank."""
    begins: dict[str, list[int]] = {"]": [], ">": [], ")": []}
    closing, out = {"[": "]", "<": ">", "(": ")"}, []
    for m in re.finditer(r"[][<>()]", text):
        if m[0] in closing:
            begins[closing[m[0]]].append(m.end())
        elif begins[m[0]] and (inner := text[begins[m[0]].pop() : m.start()]).strip():
            out.append(inner)
    return out
