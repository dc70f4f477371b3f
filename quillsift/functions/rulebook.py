"""What a scan knows: rules for names and values by label, tiers and domains of labels, and detectors of one's own.

A rulebook is a value. Functions that run in tasks take it along, so what it holds works on executors
as on the driver and two scans of one session may know different things; nothing is registered anywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from functools import lru_cache

from quillsift.functions import dialect
from quillsift.functions.column_rules import COLUMN_RULES
from quillsift.functions.registry import LABELS, MERGED
from quillsift.functions.value_rules import VALUE_RULES, Rule, for_region

#: (label, weight) or (label, weight, start, end): what a detector says of a text.
Found = tuple[str, float] | tuple[str, float, int, int]


@dataclass(frozen=True)
class Isolation:
    """Calls run in ``processes`` worker processes of a task, started when the first call comes. A call that takes more than
    ``seconds`` is killed with its process, a process that dies takes its call along; either is replaced, the call finds nothing.
    A process that is not ready after ``start_seconds`` fails the scan."""

    processes: int = 4
    seconds: float = 5.0
    start_seconds: float = 120.0


@dataclass(frozen=True)
class Detector:
    """A detector of one's own.

    ``columns`` and ``values`` are rules by label, tried after those that the label has. ``on_name`` says (label, weight) of a
    name; ``on_value`` (label, weight) or (label, weight, start, end) of a text, given the labels that its column or key stands
    for, and only where one of those is in ``asks`` if that is given. ``labels`` has (tier, domain) of new labels, ``merged``
    those whose weight is averaged with the name's. What ``on_value`` finds is reported under ``name``, resolved apart from what
    others find. ``make``, in place of ``on_value``, makes it where it is to run, once a process: a model is loaded there.
    """

    name: str
    columns: Mapping[str, Iterable[Rule]] = field(default_factory=dict)
    values: Mapping[str, Iterable[Rule]] = field(default_factory=dict)
    labels: Mapping[str, tuple[str, str | None]] = field(default_factory=dict)
    merged: frozenset[str] = frozenset()
    on_name: Callable[[str], Iterable[tuple[str, float]]] | None = None
    on_value: Callable[[str, frozenset[str]], Iterable[Found]] | None = None
    make: Callable[[], Callable[[str, frozenset[str]], Iterable[Found]]] | None = None
    asks: frozenset[str] | None = None
    isolation: Isolation | None = None

    def __post_init__(self) -> None:
        if not self.name or self.name == "regex":
            raise ValueError("a detector needs a name of its own")
        if self.on_value is not None and self.make is not None:
            raise ValueError("on_value and make exclude each other")

    def maker(self) -> Callable[[], Callable[[str, frozenset[str]], Iterable[Found]]] | None:
        call = self.on_value
        return self.make if call is None else lambda: call


@dataclass(frozen=True, eq=False)
class Rulebook:
    columns: Mapping[str, tuple[Rule, ...]]
    values: Mapping[str, tuple[Rule, ...]]
    labels: Mapping[str, tuple[str, str | None]]
    merged: frozenset[str]
    detectors: tuple[Detector, ...] = ()

    @property
    def asked(self) -> tuple[Detector, ...]:
        """Detectors that judge values by a function."""
        return tuple(d for d in self.detectors if d.maker() is not None)


def _with(rules: Mapping[str, Iterable[Rule]], more: Iterable[Mapping[str, Iterable[Rule]]]) -> dict[str, tuple[Rule, ...]]:
    out = {label: tuple(some) for label, some in rules.items()}
    for own in more:
        for label, some in own.items():
            out[label] = (*out.get(label, ()), *some)
    return out


def rulebook(region: str = "", detectors: Iterable[Detector] = ()) -> Rulebook:
    """The rules of a region ("" for all), with detectors of one's own."""
    detectors = tuple(detectors)
    if len({d.name for d in detectors}) < len(detectors):
        raise ValueError("detectors must have different names")
    labels = dict(LABELS)
    for d in detectors:
        for label in [*d.columns, *d.values]:
            labels.setdefault(label, d.labels.get(label, ("Tier3", None)))
        for label, place in d.labels.items():
            labels.setdefault(label, place)
    return Rulebook(
        _with(for_region(COLUMN_RULES, region), (for_region(_with(d.columns, ()), region) for d in detectors)),
        _with(for_region(VALUE_RULES, region), (for_region(_with(d.values, ()), region) for d in detectors)),
        labels, MERGED.union(*(d.merged for d in detectors)), detectors,
    )


#: All rules, no detectors of one's own.
STANDARD = rulebook()


class Names:
    """Labels of column names and keys."""

    def __init__(self, book: Rulebook = STANDARD):
        self.book = book
        self.rules = [(label, [(dialect.python(r.pattern), r.weight) for r in rules]) for label, rules in book.columns.items()]
        self.labels = lru_cache(maxsize=65536)(self._labels)

    def __reduce__(self):
        return Names, (self.book,)

    def _labels(self, name: str) -> dict[str, float]:
        """label -> weight of its first matching rule, or what a detector says if that is more."""
        low, out = name.lower(), {}
        for label, rules in self.rules:
            for pattern, weight in rules:
                if pattern.search(low):
                    out[label] = weight
                    break
        for d in self.book.detectors:
            for label, weight in (d.on_name(name) or ()) if d.on_name is not None else ():
                out[label] = max(float(weight), out.get(label, 0.0))
        return out

    def context(self, name: str) -> str | None:
        """The label that a name stands for: largest weight, then first by label."""
        found = self.labels(name)
        return min(found, key=lambda label: (-found[label], label)) if found else None
