"""What one value of one column says, step by step in plain Python: the version that the scan's expressions are held against."""

from __future__ import annotations

import re
from functools import lru_cache

from quillsift.functions import dialect, documents, validators
from quillsift.functions.cell import ENTITIES, Ner
from quillsift.functions.column_rules import COLUMN_RULES
from quillsift.functions.registry import tier
from quillsift.functions.value_rules import VALUE_RULES, for_region

#: label, weight, start, end (start -1: without a position)
Match = tuple[str, float, int, int]

#: What every match of a label's rules contains; "" is no condition. Labels not named need a digit.
_NEEDS = {"Email": "@%", "UPIID": "@", "Gender": "", "OAuthToken": "", "MacAddress": "", "IPAddress": ".:", "LoanAccountNumber": "", "InsurancePolicyNumber": "", "FASTagID": ""}


class CellScanner:
    """Detectors for a region ("" for all), with an optional recogniser of named entities."""

    def __init__(self, region: str = "", ner: Ner | None = None, regex: bool = True):
        self.region, self.ner, self.regex = region, ner, regex
        self.columns = [(label, [(dialect.python(r.pattern), r.weight) for r in rules]) for label, rules in for_region(COLUMN_RULES, region).items()]
        self.values = [(label, _NEEDS.get(label, "0123456789"), [(dialect.python(r.pattern), r.weight, r.gated) for r in rules]) for label, rules in for_region(VALUE_RULES, region).items()]
        self.context = lru_cache(maxsize=65536)(self._context)

    def __reduce__(self):
        return CellScanner, (self.region, self.ner, self.regex)

    def column_labels(self, name: str) -> dict[str, float]:
        """label -> weight of its first matching rule."""
        name, out = name.lower(), {}
        for label, rules in self.columns:
            for pattern, weight in rules:
                if pattern.search(name):
                    out[label] = weight
                    break
        return out

    def _context(self, name: str) -> str | None:
        """The label that a name stands for: largest weight, then first by label."""
        found = self.column_labels(name)
        return min(found, key=lambda label: (-found[label], label)) if found else None

    def value_labels(self, text: str, context: frozenset[str] = frozenset()) -> list[Match]:
        """Every label whose first matching and valid rule fires; only a rule's leftmost match is tried."""
        text, out = text.lower(), []
        marks = set(text)
        for label, needs, rules in self.values:
            if needs and marks.isdisjoint(needs):
                continue
            for pattern, weight, gated in rules:
                if gated and label not in context:
                    continue
                m = pattern.search(text)
                if m is None:
                    continue
                if validators.ip(m[1]) if label == "IPAddress" else matched(label, m[0]):
                    out.append((label, weight, m.start(), m.end()))
                    break
        return out

    def entity_labels(self, text: str, context: str | None) -> list[Match]:
        if self.ner is None or context not in ENTITIES.values():
            return []
        kinds = {kind for _, kind in self.ner(re.sub(r"[\r\n]+", " ", text))}
        return [(label, 0.7, -1, -1) for kind, label in ENTITIES.items() if kind in kinds]

    def scan(self, column: str, value: str) -> dict[tuple[str, str], tuple[float, bool]]:
        """(detector, label) -> (largest weight, whether any match was in context) of one cell."""
        context = self.context(column)
        fields, extracted = logical_fields(column, value, context is None)
        best: dict[tuple[str, str], tuple[float, bool]] = {}
        for key, text in fields:
            own = self.context(key) if extracted else context
            for piece in segments(text):
                found = {"regex": self.value_labels(piece, frozenset([own]) if own else frozenset())} if self.regex else {}
                if self.ner is not None:
                    found["spacy"] = self.entity_labels(piece, own)
                for detector, matches in found.items():
                    weighed = [weigh(m, own) for m in matches]
                    kept = occurrences(weighed) if context is None and not extracted else winner(weighed)
                    for label, weight, _, _, in_context in kept:
                        w, c = best.get((detector, label), (0.0, False))
                        best[detector, label] = (max(w, weight), c or in_context)
        return best


Weighed = tuple[str, float, int, int, bool]


def weigh(m: Match, context: str | None) -> Weighed:
    """In context a label weighs 1; without any context only first-tier labels weigh 0.70 or more."""
    label, weight, start, end = m
    if context is not None:
        return (label, 1.0, start, end, True) if label == context else (*m, False)
    return (label, 0.69 if weight >= 0.70 and tier(label) != "Tier1" else weight, start, end, False)


def winner(found: list[Weighed]) -> list[Weighed]:
    """The one label of a field: in context first, then by weight, then by name."""
    return [min(found, key=lambda m: (not m[4], -m[1], m[0]))] if found else []


def occurrences(found: list[Weighed]) -> list[Weighed]:
    """One winner (by weight, then by name) of each group of overlapping matches; matches without a position stay."""
    if len(found) < 2:
        return found
    out, group, until = [m for m in found if m[3] <= m[2]], [], -1
    for m in sorted((m for m in found if m[3] > m[2]), key=lambda m: (m[2], -m[3], m[0])):
        if group and m[2] >= until:
            out.append(min(group, key=lambda g: (-g[1], g[0])))
            group, until = [], -1
        group.append(m)
        until = max(until, m[3])
    return out + ([min(group, key=lambda g: (-g[1], g[0]))] if group else [])


class PairScanner:
    """Label of one (column, value) pair: every label of the column is context. An empty or "?" value says nothing; a value
    without a label takes the column's first one; else the first label that both have, else none."""

    def __init__(self, region: str = ""):
        self.cells = CellScanner(region)

    def detect(self, column: str, value: str) -> str | None:
        if value in ("", "?"):
            return None
        by_name = self.cells.column_labels(column)
        by_value = sorted({m[0] for m in self.cells.value_labels(value, frozenset(by_name))})
        if not by_value:
            return min(by_name, default=None)
        return next((label for label in by_value if label in by_name), None)


def matched(label: str, text: str) -> bool:
    """Whether a match of a label's value rule stands its check."""
    if label == "CreditCard":
        return validators.luhn(text.translate(str.maketrans("", "", " -+")))
    if label == "AdharcardNumber":
        return validators.verhoeff(text.translate(str.maketrans("", "", " -")))
    if label == "GSTIN":
        return validators.gstin(text)
    if label == "MacAddress":
        return validators.mac(text)
    return True


def logical_fields(column: str, value: str, document: bool) -> tuple[list[tuple[str, str]], bool]:
    """The fields to scan, and whether they came out of the value."""
    if document:
        text, pairs = documents.extract(value)
        if pairs:
            return pairs, True
        value = text or value
    return [(column, value)], False


def segments(value: str, size: int = 512) -> list[str]:
    """Values below ``size`` bytes as they are; longer ones packed word by word into pieces of less than that."""
    if not value:
        return []
    if len(value.encode()) < size:
        return [value]
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
