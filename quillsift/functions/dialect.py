"""Rules are written in RE2 syntax; these give the same pattern for Java (Spark) and Python.

Differences that matter: ``$`` is the end of the text and not also before a last newline,
``\\b`` ``\\d`` ``\\w`` are ASCII, ``\\s`` has no vertical tab, ``.`` excludes only newline, and a
hyphen after a shorthand inside a class is a plain hyphen.
"""

from __future__ import annotations

import re
from functools import lru_cache

_EDGE = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def _translate(pattern: str, edge: str, end: str) -> str:
    out, inside, i, shorthand = [], False, 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            pair = pattern[i : i + 2]
            i += 2
            shorthand = inside and pair in (r"\s", r"\d", r"\w")
            if pair == r"\s":
                out.append(r"\t\n\f\r " if inside else r"[\t\n\f\r ]")
            elif pair == r"\b" and not inside:
                out.append(edge)
            else:
                out.append(pair)
            continue
        if inside and c == "-" and shorthand and pattern[i + 1] != "]":
            out.append(r"\-")
        elif inside and c == "[":
            out.append(r"\[")
        elif c == "$" and not inside:
            out.append(end)
        else:
            out.append(c)
        if c == "[" and not inside:
            inside = True
        elif c == "]" and inside:
            inside = False
        shorthand = False
        i += 1
    return "".join(out)


@lru_cache(maxsize=None)
def java(pattern: str) -> str:
    """For Spark's regular expression functions."""
    return "(?d)" + _translate(pattern, _EDGE, r"\z")


@lru_cache(maxsize=None)
def python(pattern: str) -> re.Pattern[str]:
    return re.compile(_translate(pattern, r"\b", r"\Z"), re.ASCII)
