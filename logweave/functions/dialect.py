"""Compiles patterns of the log formats' regex dialect to Java patterns that Spark accepts.

The dialect names groups as ``(?<Name>…)`` or ``(?'Name'…)``, allows ``_`` in names and the same name several times, and
numbers unnamed groups before named ones. All groups become unnamed Java groups with a map from field to group numbers.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


class PatternError(ValueError):
    """The pattern can't be expressed."""


@dataclass(frozen=True)
class Pattern:
    java: str
    #: field name -> Java group numbers; unnamed groups are called "1", "2" and come first
    fields: tuple[tuple[str, tuple[int, ...]], ...]

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.fields]

    def groups(self, name: str) -> tuple[int, ...]:
        return dict(self.fields)[name]


_NAMED = re.compile(r"\(\?(?:<([A-Za-z_]\w*)>|'([A-Za-z_]\w*)')")


#: Field of the groups that hold what stands behind the groups asked for.
BEHIND = "<behind>"


def compile_pattern(pattern: str, ignore_case: bool = False, single_line: bool = False, behind: str | None = None) -> Pattern:
    """``single_line``: a dot also matches line ends. ``behind``: a field; the field BEHIND then captures all text after
    each of its groups, which gives their places."""
    out, i, number, in_class = [], 0, 0, 0
    named: dict[str, list[int]] = {}
    unnamed: list[int] = []
    open_names: list[str | None] = []
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
        elif in_class:
            in_class += (c == "[") - (c == "]")
            out.append("\\[" if c == "[" else c)
            in_class -= c == "["  # a bracket inside a class is an ordinary character
            i += 1
        elif c == "[":
            in_class = 1
            out.append(c)
            i += 1
            if pattern[i : i + 1] == "^":
                out.append("^")
                i += 1
            if pattern[i : i + 1] == "]":
                out.append("\\]")
                i += 1
        elif m := _NAMED.match(pattern, i):
            number += 1
            name = m[1] or m[2]
            named.setdefault(name, []).append(number)
            open_names.append(name)
            out.append("(")
            i = m.end()
        elif c == "(" and pattern[i + 1 : i + 2] == "?":
            if re.match(r"\(\?\(|\(\?(?:<|')[^=!]*-", pattern[i:]):
                raise PatternError("conditions and balancing groups can't be expressed")
            m = re.match(r"\(\?(?:<[=!]|[=!:>]|[a-zA-Z-]*:|[a-zA-Z-]+\))", pattern[i:])
            if not m:
                raise PatternError(f"unknown group at {i}")
            if not m[0].endswith(")"):
                open_names.append(None)
            out.append(m[0])
            i += len(m[0])
        elif c == "(":
            number += 1
            unnamed.append(number)
            open_names.append(None)
            out.append(c)
            i += 1
        elif c == ")":
            name = open_names.pop() if open_names else None
            if name and re.match(r"[*+]|\{\d+,?\d*\}", pattern[i + 1 :]):
                raise PatternError(f"group {name} is repeated; its first capture can't be had")
            out.append(c)
            if name and name == behind:
                number += 1
                named.setdefault(BEHIND, []).append(number)
                out.append(r"(?=([\s\S]*))")
            i += 1
        else:
            out.append(c)
            i += 1
    flags = "dU" + "s" * single_line + "iu" * ignore_case
    fields = [(str(k), (n,)) for k, n in enumerate(unnamed, 1)] + [(n, tuple(g)) for n, g in named.items()]
    return Pattern(f"(?{flags}){''.join(out)}", tuple(fields))


def literal(text: str) -> str:
    """A pattern that matches the text itself."""
    return re.sub(r"([\\.^$|?*+()\[\]{}#\s-])", r"\\\1", text)
