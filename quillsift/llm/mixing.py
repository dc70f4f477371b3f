"""Mixing sources to target weights, in DataFrame operations only.

Sizes are added up per source, target amounts follow from the weights by water
filling, ``rate = target / size`` is a source's repetition rate, and each document
is emitted ``floor(rate)`` times plus once more when a hash of its id and text,
taken as a number in [0, 1), lies below the fraction.

Defined cases: null or empty texts have size 0 and take nothing; a null source is
a source of its own that sorts last; rows that agree in id and text draw the same
number; a very long text is counted whole; sources of equal weight and cap fill in order of
their number; an empty table gives an empty result. Only the named columns are read, so
further columns of any name do no harm.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsift.llm.common import join_small, staged, unused

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5 of seed, id and text."""
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(F.md5(text), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sized: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Source number i, by code point with null last, has weight ``weights[i % len]``. All
    targets share ``share`` times all sizes by weight; none exceeds ``cap`` times its
    source's size, and the excess is shared again. With sources in the order in which they
    reach their cap, a source is full iff the level that the others would give it is above
    its cap, so two running sums replace the rounds. The windows run over one row a source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    per = per.withColumn("nth", F.row_number().over(order) - 1).withColumn("weight", w)
    per = per.withColumn("most", cap * F.col("source_size"))
    every = Window.partitionBy()
    fill = Window.orderBy(F.col("most") / F.col("weight"), "nth")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    level = (share * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    per = per.withColumn("level", level)
    per = per.withColumn("open", F.when(F.col("level") * F.col("weight") < F.col("most"), F.col("level")))
    per = per.withColumn("final", F.first("open", ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("open").isNull(), F.col("most")).otherwise(F.col("weight") * F.col("final"))
    return per.select("source", "source_size", target.alias("target"))


def copies(target: Column, source_size: Column, u: Column) -> Column:
    """floor(rate) plus one Bernoulli copy."""
    rate = F.when(source_size > 0, target / source_size).otherwise(F.lit(0.0))
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("long")).cast("long")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 11) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken, copies. The texts are read once."""
    sized = staged(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), draw(F.col("doc_id"), F.col("text"), seed).alias("u")), "mix-sizes")
    per = staged(targets(sized, weights, share, cap).withColumnRenamed("source", "of"), "mix-targets")
    out = join_small(sized, per, F.col("source").eqNullSafe(F.col("of")))
    n = copies(F.col("target"), F.col("source_size"), F.col("u"))
    return out.select("doc_id", "size", "source_size", "target", (n * F.col("size")).alias("taken"), n.alias("copies"))


def emit(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 11) -> DataFrame:
    """The mixed corpus itself: every row of ``docs`` as often as it is taken, with its own columns."""
    sized = docs.select("source", word_count(F.col("text")).alias("size"))
    of, size, target, copy = (unused(docs, f"mix_{name}") for name in ("of", "size", "target", "copy"))
    per = staged(targets(sized, weights, share, cap).select(F.col("source").alias(of), F.col("source_size").alias(size), F.col("target").alias(target)), "mix-targets")
    out = join_small(docs, per, F.col("source").eqNullSafe(F.col(of)))
    n = copies(F.col(target), F.col(size), draw(F.col("doc_id"), F.col("text"), seed)).cast("int")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.array_repeat(F.lit(True), n)).alias(copy)).drop(copy)
