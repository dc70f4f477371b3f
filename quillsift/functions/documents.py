"""Logical fields of a cell: key-value pairs of JSON, XML, query strings, Base64 wrappings and loose text; and segments.

Documents are parsed one value at a time inside Arrow batches, as they may nest to any depth; what may be a document at all, and the
cut of long texts into segments, are expressions.
"""

from __future__ import annotations

import base64
import binascii
import ipaddress
import json
import re
import xml.etree.ElementTree as ET
from urllib.parse import unquote_plus

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillsift.functions.rulebook import STANDARD, Names, Rulebook
from quillsift.functions.validators import mac

#: Loose pairs in broken JSON and in text.
QUOTED = re.compile(r'"([^"\\]+)"[\t\n\f\r ]*:[\t\n\f\r ]*"([^"\\]+)"', re.ASCII)
BARE = re.compile(r'"([^"\\]+)"[\t\n\f\r ]*:[\t\n\f\r ]*([0-9a-zA-Z._-]+)', re.ASCII)
LOOSE = re.compile(r"\b([a-zA-Z0-9_-]{2,30})[\t\n\f\r ]*[:=][\t\n\f\r ]*([^\t\n\f\r ,;]{2,100})", re.ASCII)

Pairs = list[tuple[str, str]]


def add(pairs: Pairs, key: str, value: str) -> None:
    pair = (key.strip(), value.strip())
    if all(pair) and pair not in pairs:
        pairs.append(pair)


def unescape(text: str) -> str | None:
    """Decode a query component; None where a percent sign is not followed by two hex digits."""
    if re.search(r"%(?![0-9A-Fa-f]{2})", text):
        return None
    return unquote_plus(text, errors="replace")


def looks_structured(text: str) -> bool:
    return text[:1] in ("{", "[", "<") and text != "" or "=" in text and ("&" in text or LOOSE.search(text) is not None)


def unwrap_base64(text: str) -> str | None:
    """The document inside a Base64 text in one of the four alphabets, if it is printable and structured."""
    if not text or text[0] in "{[<":
        return None
    packed = "".join(text.split())
    if len(packed) < 8:
        return None
    for alphabet, padded in ((b"+/", True), (b"+/", False), (b"-_", True), (b"-_", False)):
        if padded and len(packed) % 4 or not padded and ("=" in packed or len(packed) % 4 == 1):
            continue
        body = packed.rstrip("=")
        if padded and len(packed) - len(body) != -len(body) % 4 or not re.fullmatch(f"[A-Za-z0-9{re.escape(alphabet.decode())}]*", body):
            continue
        try:
            inner = base64.b64decode(body + "=" * (-len(body) % 4), altchars=alphabet, validate=True).decode()
        except (binascii.Error, UnicodeDecodeError, ValueError):
            continue
        if inner and sum(c.isprintable() or c.isspace() for c in inner) >= 0.9 * len(inner) and looks_structured(inner.strip()):
            return inner.strip()
    return None


class _Bad(ValueError):
    pass


def _refuse(name: str):
    raise _Bad(name)


def from_json(text: str, pairs: Pairs) -> bool:
    """One whole JSON document: leaves under their nearest key, keys in order, numbers as they are written."""
    if text[:1] not in ("{", "["):
        return False
    try:
        value = json.loads(text, parse_int=str, parse_float=str, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return False
    todo = [("", value)]
    while todo:
        key, v = todo.pop()
        if isinstance(v, dict):
            todo += [(k, v[k]) for k in sorted(v, key=lambda s: s.encode(errors="surrogatepass"), reverse=True)]
        elif isinstance(v, list):
            todo += [(key, x) for x in reversed(v)]
        elif isinstance(v, bool):
            add(pairs, key, str(v).lower())
        elif v is not None:
            add(pairs, key, v)
    return True


def from_xml(text: str, pairs: Pairs) -> bool:
    """A well-formed document's leaf elements by local name; attributes do not count."""
    if not text.startswith("<") or re.search(r"<!(DOCTYPE|ENTITY)", text):
        return False
    try:
        root = ET.fromstring(text)
    except ET.ParseError:
        return False
    todo = [root]
    while todo:
        e = todo.pop()
        children = list(e)
        todo += reversed(children)
        if not children:
            add(pairs, e.tag.rpartition("}")[2], e.text or "")
    return True


def _query_of(text: str) -> str:
    """The query of a URL, or the text itself if it could be one."""
    cut = text.partition("#")[0]
    if "?" in cut and not re.search(r"[\x00-\x1f\x7f]", text):
        head, _, query = cut.partition("?")
        scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", head)
        first = head.split("/")[0]
        odd = re.search(r"%(?![0-9A-Fa-f]{2})", head) or not scheme and ":" in first or scheme and "//" in head and re.search(r"[ <>\"]", head.split("//", 1)[1].split("/")[0])
        if query and not odd:
            return query
    if "=" in text and not re.search(r"[{}<>\n\r]", text):
        return text.removeprefix("?")
    return ""


def from_query(text: str, pairs: Pairs) -> bool:
    """Parameters with sorted keys; a semicolon or a bad escape refuses the whole query. True once any pair is known."""
    query = _query_of(text)
    found: dict[str, list[str]] = {}
    for part in query.split("&"):
        if not part:
            continue
        key, _, value = part.partition("=")
        k, v = unescape(key), unescape(value)
        if ";" in part or k is None or v is None:
            return False
        found.setdefault(k, []).append(v)
    if not found:
        return False
    for key in sorted(found):
        for value in found[key]:
            add(pairs, key, value)
    return bool(pairs)


def network_value(text: str) -> bool:
    """The whole text is an address, so its colons separate nothing."""
    try:
        ipaddress.ip_address(text)
        return "%" not in text
    except ValueError:
        return mac(text)


def extract(text: str) -> tuple[str, Pairs]:
    """The text after one layer of unwrapping, and its pairs."""
    text = text.strip()
    if "%3d" in text.lower() and "=" not in text:
        text = unescape(text) or text
    text = unwrap_base64(text) or text
    body, pairs = text.strip(), []
    if not any(sign in body for sign in ":=<"):  # each form of a pair has one
        return text, pairs
    parsed = from_json(body, pairs) or from_xml(body, pairs)
    if from_query(body, pairs) or parsed:
        return text, pairs
    for pattern in (QUOTED, BARE):
        for m in pattern.finditer(body):
            add(pairs, m[1], m[2])
    if not pairs and not network_value(body):
        for m in LOOSE.finditer(body):
            add(pairs, m[1], m[2].strip("\"'{}[]()"))
    return text, pairs


#: White space as Python strips and splits it, in a class of Java's expressions.
BLANK = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def may_hold_fields(value: Column) -> Column:
    """Whether :func:`extract` could find a pair or a wrapping: an opening bracket, a sign that parts a key from its value, or
    nothing but the letters of Base64."""
    return value.rlike(rf"^[{BLANK}]*[{{\[<]|[:=]|%3[dD]") | (F.length(value) >= 8) & value.rlike(rf"^[A-Za-z0-9+/_=\-{BLANK}]*\z")


def document(book: Rulebook = STANDARD):
    """Column function: the text after one layer of unwrapping, and its pairs with the labels that the keys stand for."""
    names = Names(book)

    def run(value):
        if value is None:
            return None
        text, pairs = extract(value)
        return text, [(k, v, names.context(k)) for k, v in pairs]

    return F.udf(run, "struct<text:string,pairs:array<struct<key:string,value:string,context:string>>>", useArrow=True)


def segments(value: Column, size: int = 512) -> Column:
    """Values below ``size`` bytes as they are; longer ones packed word by word into pieces of about that."""

    def step(acc: Column, word: Column) -> Column:
        n, fresh = F.octet_length(word), acc["now"].isNull()
        full = ~fresh & (acc["used"] + n + 1 > size)
        return F.struct(
            F.when(full, F.concat(acc["out"], F.array(acc["now"]))).otherwise(acc["out"]).alias("out"),
            F.when(full | fresh, word).otherwise(F.concat(acc["now"], F.lit(" "), word)).alias("now"),
            F.when(full | fresh, n).otherwise(acc["used"] + n + 1).alias("used"),
        )

    words = F.filter(F.split(value, f"[{BLANK}]+", -1), lambda w: w != "")
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("now"), F.lit(0).alias("used"))
    packed = F.aggregate(words, empty, step, lambda acc: F.when(acc["now"].isNull(), F.array(value)).otherwise(F.concat(acc["out"], F.array(acc["now"]))))
    return F.when(F.coalesce(value, F.lit("")) == "", F.array().cast("array<string>")).when(F.octet_length(value) < size, F.array(value)).otherwise(packed)


def packed(value: str, size: int = 512) -> list[str]:
    """:func:`segments` of one text."""
    if not value or len(value.encode()) < size:
        return [value] if value else []
    out, now, used = [], [], 0
    for word in value.split():
        n = len(word.encode())
        if now and used + n + 1 > size:
            out.append(" ".join(now))
            now, used = [], 0
        used += n + bool(now)
        now.append(word)
    if now:
        out.append(" ".join(now))
    return out or [value]


def human_list(items: list[str]) -> str:
    """a, b and c"""
    return items[0] if len(items) == 1 else ", ".join(items[:-1]) + " and " + items[-1] if items else ""
