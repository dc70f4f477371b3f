"""Resolution within a row: weights by context, winners of fields, groups of overlapping matches, and the merge of a cell's
parts. All functions take and return arrays of matches, so a cell is judged where it lies and nothing is shuffled.

A match is a struct of label, weight, start, end (start -1: without a position), in_context.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillsift.functions.rulebook import STANDARD, Rulebook
from quillsift.operators.score import tier_of

MATCH = "struct<label:string,weight:double,start:int,end:int,in_context:boolean>"


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(x), lambda v: body(v)), F.lit(0))


def _match(m: Column, weight: Column, in_context: Column) -> Column:
    return F.struct(m["label"].alias("label"), weight.alias("weight"), m["start"].alias("start"), m["end"].alias("end"), in_context.alias("in_context"))


def boosted(matches: Column, context: Column) -> Column:
    """Weight 1 for the label that is the field's context, and its mark."""

    def one(m: Column) -> Column:
        hit = F.coalesce(m["label"] == context, F.lit(False))
        return _match(m, F.when(hit, 1.0).otherwise(m["weight"]), hit)

    return F.transform(matches, one)


def capped(matches: Column, context: Column, book: Rulebook = STANDARD) -> Column:
    """Without a context, weights of 0.70 or more outside Tier1 become 0.69."""
    cut = lambda m: context.isNull() & (m["weight"] >= 0.70) & (tier_of(m["label"], book) != "Tier1")
    return F.transform(matches, lambda m: _match(m, F.when(cut(m), 0.69).otherwise(m["weight"]), m["in_context"]))


def field_winner(matches: Column) -> Column:
    """At most one match: in context first, then heaviest, then first by label."""
    ordered = F.array_sort(F.transform(matches, lambda m: F.struct((~m["in_context"]).alias("c"), (-m["weight"]).alias("w"), m["label"].alias("l"), m.alias("m"))))
    return F.transform(F.slice(ordered, 1, 1), lambda o: o["m"])


def occurrence_groups(matches: Column) -> Column:
    """The heaviest (then first by label) of each group of transitively overlapping ranges: a range that begins at or behind
    every end before it opens a group. Matches without a position stay, in front."""
    ordered = lambda ms: F.array_sort(F.transform(F.filter(ms, lambda m: m["end"] > m["start"]), lambda m: F.struct(m["start"].alias("s"), (-m["end"]).alias("e"), m["label"].alias("l"), m.alias("m"))))

    def step(acc: Column, x: Column) -> Column:
        m = x["m"]
        opens = acc["until"] <= m["start"]
        last = F.element_at(acc["out"], -1)
        better = (m["weight"] > last["weight"]) | (m["weight"] == last["weight"]) & (m["label"] < last["label"])
        joined = F.when(better, F.concat(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), F.array(m))).otherwise(acc["out"])
        return F.struct(F.when(opens | (F.size(acc["out"]) == 0), F.concat(acc["out"], F.array(m))).otherwise(joined).alias("out"), F.greatest(acc["until"], m["end"]).alias("until"))

    groups = lambda ms: F.aggregate(ordered(ms), F.struct(F.array().cast(f"array<{MATCH}>").alias("out"), F.lit(-1).alias("until")), step, lambda acc: acc["out"])
    return let(matches, lambda ms: F.when(F.size(ms) > 1, F.concat(F.filter(ms, lambda m: m["end"] <= m["start"]), groups(ms))).otherwise(ms))


def row_merge(matches: Column) -> Column:
    """The matches of all fields and segments of a cell, once a label: largest weight, any context."""

    def one(ms: Column, label: Column) -> Column:
        mine = F.filter(ms, lambda m: m["label"] == label)
        return F.struct(label.alias("label"), F.array_max(F.transform(mine, lambda m: m["weight"])).alias("weight"), F.exists(mine, lambda m: m["in_context"]).alias("in_context"))

    return let(matches, lambda ms: F.transform(F.array_distinct(F.transform(ms, lambda m: m["label"])), lambda label: one(ms, label)))
