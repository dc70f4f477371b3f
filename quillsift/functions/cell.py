"""What runs as Python over Arrow batches: what names stand for, and detectors that judge texts by a function."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Iterator

from pyspark.sql import functions as F

from quillsift.functions.rulebook import STANDARD, Detector, Found, Isolation, Names, Rulebook
from quillsift.functions.workers import LOST, Failed, Workers

log = logging.getLogger(__name__)

#: text -> (entity, type) or (entity, type, start, end) of a recogniser of named entities
Ner = Callable[[str], list[tuple]]
#: Entity types of a recogniser and the labels they stand for, all of this weight.
ENTITIES, ENTITY_WEIGHT = {"PERSON": "Name", "GPE": "Address"}, 0.7

#: (label, weight, start, end) with start -1 for a match without a position.
Match = tuple[str, float, int, int]


def context_of(book: Rulebook = STANDARD):
    """Column function: name -> the label it stands for."""
    names = Names(book)
    return F.udf(lambda name: None if name is None else names.context(name), "string", useArrow=True)


def recogniser(ner: Ner | None = None, make: Callable[[], Ner] | None = None, isolation: Isolation | None = Isolation()) -> Detector:
    """A recogniser of named entities as a detector: asked where the context is one of its labels, in one line. ``make`` loads a model in each process."""
    load = make if make is not None else (lambda: ner)

    def judge():
        call = load()

        def run(text: str, context: frozenset[str]) -> list[Found]:
            out: dict[str, Found] = {}
            for _, kind, *place in call(re.sub(r"[\r\n]", " ", text)):
                if kind in ENTITIES:
                    out.setdefault(ENTITIES[kind], (ENTITIES[kind], ENTITY_WEIGHT, *place))
            return list(out.values())

        return run

    return Detector("spacy", make=judge, asks=frozenset(ENTITIES.values()), isolation=isolation)


def _match(found: Found) -> Match:
    label, weight, *place = found
    start, end = place if len(place) == 2 and place[1] > place[0] else (-1, -1)
    return str(label), float(weight), int(start), int(end)


class Asked:
    """A detector's function for the pieces of many cells, in this process or in workers; ``close`` ends them."""

    def __init__(self, detector: Detector):
        self.detector, self.call, self.workers = detector, None, None
        if (at := detector.isolation) is not None:
            self.workers = Workers(detector.maker(), at.processes, at.seconds, at.start_seconds)

    def __call__(self, cells: list[list[dict]]) -> Iterator[list[list[Match]]]:
        """For each cell's pieces (raw, context) what is found in them."""
        sets = [[frozenset([p["context"]] if p["context"] else ()) for p in pieces] for pieces in cells]
        wanted = [(i, j) for i, pieces in enumerate(cells) for j in range(len(pieces)) if self.detector.asks is None or self.detector.asks & sets[i][j]]
        calls = [(cells[i][j]["raw"], sets[i][j]) for i, j in wanted]
        if self.workers is not None:
            results = self.workers.map(calls) if calls else []
        else:
            if self.call is None:
                self.call = self.detector.maker()()
            results = [self.call(*c) for c in calls]
        out: list[list[list[Match]]] = [[[] for _ in pieces] for pieces in cells]
        for (i, j), found in zip(wanted, results):
            if found is LOST or isinstance(found, Failed):
                log.warning("detector %s: a call was lost%s", self.detector.name, f", {found}" if found is not LOST else "")
                continue
            out[i][j] = [_match(f) for f in found or ()]
        yield from out

    def close(self) -> None:
        if self.workers is not None:
            self.workers.close()
