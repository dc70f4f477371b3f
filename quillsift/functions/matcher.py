"""Rules on whole Arrow batches: each rule is tried on all texts at once by RE2, in whose syntax rules are written."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillsift.functions import validators
from quillsift.functions.value_rules import Rule

#: What every match of a label's rules holds, in patterns that are quick to search; a text without it is not tried. Labels not named
#: are tried always: their rules are tied to both ends of the text, or need a context.
NEEDS = {
    "Email": "@|%40", "UPIID": "@", "OAuthToken": "ya29|1//|gh[opur]_|xox|eyj", "MacAddress": "[0-9a-f]{2}[:-][0-9a-f]{2}[:-]|[0-9a-f]{4}\\.[0-9a-f]{4}", "IPAddress": "[0-9]\\.[0-9]|[0-9a-f:]:[0-9a-f:]",
    "Address": r"\b(?:st|street|ave|avenue|road|rd|highway|hwy|square|sq|trail|trl|drive|dr|court|ct|park|parkway|pkwy|circle|cir|boulevard|blvd)\b",
    **dict.fromkeys(("PANNumber", "AdharcardNumber", "CreditCard", "ABHANumber", "GSTIN", "VehicleNumber"), "[0-9]{4}"), "TAN": "[0-9]{5}", "Phone": "[0-9]{5}",
    **dict.fromkeys(("CIFNumber", "CIN", "PassportNumber", "ESIC"), "[0-9]{6}"), **dict.fromkeys(("DrivingLicenceNumber", "VoterID", "EPFMemberID"), "[0-9]{7}"),
    "SEBIRegistration": "[0-9]{9}", "UAN": "[0-9]{12}", "DematAccountNumber": "[0-9]{14}",
}
_CHECKS: dict[str, Callable[[str], bool]] = {
    "CreditCard": lambda m: validators.luhn(m.translate(str.maketrans("", "", " -+"))), "AdharcardNumber": lambda m: validators.verhoeff(m.translate(str.maketrans("", "", " -"))),
    "GSTIN": validators.gstin, "MacAddress": validators.mac, "IPAddress": validators.ip,
}

#: Texts of a batch are judged in slices of about so many bytes (one text at least).
SLICE_BYTES = 4 << 20

MATCH = pa.struct([("label", pa.string()), ("weight", pa.float64()), ("start", pa.int32()), ("end", pa.int32()), ("in_context", pa.bool_())])


class Fired(NamedTuple):
    """Texts (their numbers) on which a rule of a label fires, and where its leftmost match lies, in characters."""

    label: str
    rule: int
    weight: float
    texts: np.ndarray
    start: np.ndarray
    end: np.ndarray


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """First and last place of runs of texts that hold about ``limit`` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo, done = 0, 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield lo, hi
        lo, done = hi, int(ends[hi - 1])


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], object]:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # a system without it
        return lambda _: None


def release() -> None:
    """Give freed memory back to the system, as workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def lower(texts: pa.Array) -> pa.Array:
    if pc.all(pc.string_is_ascii(texts)).as_py() is not False:
        return pc.ascii_lower(texts)
    return pa.array([None if t is None else t.lower() for t in texts.to_pylist()], pa.string())


@lru_cache(maxsize=None)
def _spans(pattern: str, group: bool) -> str:
    """A pattern whose match is named ``m`` and, if asked for, whose first group ``g``; other groups have no number."""
    out, inside, i, named = [], False, 0, not group
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if inside:
            inside = c != "]"
        elif c == "[":
            inside = True
            if (first := re.match(r"\^?\]", pattern[i + 1 :])) is not None:  # a bracket that stands for itself
                c += first[0]
                i += len(first[0])
        elif c == "(" and pattern[i + 1 : i + 2] != "?":
            c, named = "(?:" if named else "(?P<g>", True
        out.append(c)
        i += 1
    return f"(?P<m>{''.join(out)})"


def _places(texts: pa.Array, pattern: str, group: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Start and end, in characters, of each text's leftmost match, and what its check is of."""
    found = pc.extract_regex_span(texts, _spans(pattern, group))
    at = lambda name: pc.list_flatten(pc.struct_field(found, name)).to_numpy(zero_copy_only=False).reshape(-1, 2).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts)].astype(np.int64)
    whole = at("m")
    start, end = whole[:, 0], whole[:, 0] + whole[:, 1]
    if group:
        inner = at("g")
        held = _cut(data, offsets + inner[:, 0], inner[:, 1])
    else:
        held = _cut(data, offsets + start, whole[:, 1])
    if not pc.all(pc.string_is_ascii(texts)).as_py():
        heads, bodies = _cut(data, offsets, start), _cut(data, offsets + start, whole[:, 1])
        start = pc.utf8_length(heads).to_numpy().astype(np.int64)
        end = start + pc.utf8_length(bodies).to_numpy()
    return start, end, held


def _cut(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.cumsum(sizes)
    take = np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
    return pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(data[take])])


def _has(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(texts, pattern), False).to_numpy(zero_copy_only=False)


def _stands(label: str, held: pa.Array) -> np.ndarray:
    words = pc.dictionary_encode(held)
    check = _CHECKS[label]
    return np.array([check(w) for w in words.dictionary.to_pylist()], bool)[words.indices.to_numpy()]


def fires(low: pa.Array, rules: Mapping[str, Sequence[Rule]], within: Callable[[str], np.ndarray], own: frozenset[str] = frozenset(), checked: bool = True, spans: bool = True) -> Iterator[Fired]:
    """The first rule of every label that matches a lower-case text and whose leftmost match stands its check. Gated rules fire only where
    ``within`` says that a text's context has the label. Labels in ``own`` have rules that the quick patterns do not know."""
    everything, quick = np.arange(len(low)), {}
    for label, some in rules.items():
        need = "" if label in own else NEEDS.get(label, "")
        if need not in quick:
            kept = np.flatnonzero(_has(low, need)) if need else everything
            quick[need] = kept, low.take(pa.array(kept)) if need else low
        at, texts = quick[need]
        for i, r in enumerate(some):
            if not len(at):
                break
            if r.gated:
                there = np.flatnonzero(within(label)[at])
                hit = there[_has(texts.take(pa.array(there)), r.pattern)] if len(there) else there
            else:
                hit = np.flatnonzero(_has(texts, r.pattern))
            if not len(hit):
                continue
            start = end = np.full(len(hit), -1)
            asked = checked and label in _CHECKS
            if asked or spans:
                start, end, held = _places(texts.take(pa.array(hit)), r.pattern, label == "IPAddress" and label not in own)
                if asked:
                    sound = _stands(label, held)
                    hit, start, end = hit[sound], start[sound], end[sound]
            yield Fired(label, i, float(r.weight), at[hit], start, end)
            rest = np.ones(len(at), bool)
            rest[hit] = False
            at, texts = at[rest], texts.filter(pa.array(rest)) if i + 1 < len(some) else texts


def matches(low: pa.Array, rules: Mapping[str, Sequence[Rule]], within: Callable[[str], np.ndarray], own: frozenset[str] = frozenset()) -> pa.Array:
    """list<MATCH> for each text, in the order of the rules' labels."""
    found = list(fires(low, rules, within, own))
    texts = np.concatenate([f.texts for f in found]) if found else np.zeros(0, np.int64)
    order = np.argsort(texts, kind="stable")
    column = lambda parts, kind: pa.array(np.concatenate(parts)[order] if parts else np.zeros(0), kind)
    names = pa.array([f.label for f in found], pa.string())
    which = np.repeat(np.arange(len(found)), [len(f.texts) for f in found])[order] if found else np.zeros(0, np.int64)
    structs = pa.StructArray.from_arrays(
        [names.take(pa.array(which)), pa.array(np.array([f.weight for f in found], float)[which]), column([f.start for f in found], pa.int32()), column([f.end for f in found], pa.int32()), pa.array(np.zeros(len(order), bool))],
        fields=list(MATCH),
    )
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(texts, minlength=len(low)))), pa.int32()), structs)


def in_lists(contexts: pa.Array) -> Callable[[str], np.ndarray]:
    """Whether each list of labels has one."""
    flat, parents = pc.list_flatten(contexts), pc.list_parent_indices(contexts).to_numpy()

    def within(label: str) -> np.ndarray:
        out = np.zeros(len(contexts), bool)
        out[parents[pc.fill_null(pc.equal(flat, label), False).to_numpy(zero_copy_only=False)]] = True
        return out

    return within


def among(contexts: pa.Array) -> Callable[[str], np.ndarray]:
    """Whether each text's one context is a label."""
    return lambda label: pc.fill_null(pc.equal(contexts, label), False).to_numpy(zero_copy_only=False)
