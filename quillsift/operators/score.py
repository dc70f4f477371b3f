"""From summed evidence to findings: density, final weight, dominant domain, cap, domain gate, and winners.

All of it runs on (columns x labels) rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillsift.functions.registry import confidence
from quillsift.functions.rulebook import STANDARD, Rulebook

BY_NAME, BY_VALUE = "column detector", "value detector"
_COLUMN = ["table", "column"]


def _of(pairs: dict[str, str | None], label: Column) -> Column:
    known = {k: v for k, v in pairs.items() if v is not None}
    return F.create_map(*[F.lit(x) for kv in sorted(known.items()) for x in kv])[label]


def tier_of(label: Column, book: Rulebook = STANDARD) -> Column:
    return F.coalesce(_of({k: t for k, (t, _) in book.labels.items()}, label), F.lit("Tier3"))


def domain_of(label: Column, book: Rulebook = STANDARD) -> Column:
    return _of({k: d for k, (_, d) in book.labels.items()}, label)


def confidence_of(weight: Column) -> Column:
    return F.when(weight < 0.4, "Low").when(weight < 0.7, "Medium").otherwise("High")


def weighed(values: DataFrame, scanned: DataFrame, names: DataFrame, book: Rulebook = STANDARD) -> DataFrame:
    """Value evidence with scanned, named (the column's name says something) and the final weight: the mean over all cells,
    for some labels averaged with the name's weight."""
    some = names.groupBy(*_COLUMN).agg(F.lit(True).alias("named"))
    same = names.select(*_COLUMN, "label", F.col("weight").alias("name_weight"))
    out = values.join(scanned, _COLUMN, "left").join(some, _COLUMN, "left").join(same, [*_COLUMN, "label"], "left")
    n = F.coalesce(F.col("scanned"), F.lit(0))
    mean = F.when(n > 0, F.col("weight") / n).otherwise(0.0)
    merged = F.col("label").isin(*sorted(book.merged)) & (F.coalesce(F.col("name_weight"), F.lit(0.0)) >= 0.4)
    out = out.withColumn("final", F.when(merged, (F.col("name_weight") + mean) / 2).otherwise(mean))
    return out.withColumn("scanned", n).withColumn("named", F.coalesce("named", F.lit(False)))


def dense(rows: DataFrame) -> DataFrame:
    """Drops, in columns whose name says nothing, labels outside context in fewer than 30 % of cells; 10 % where two labels reach 10 %."""
    confirmed = F.sum((F.col("matched") * 10 >= F.col("scanned")).cast("int")).over(Window.partitionBy(*_COLUMN))
    rows = rows.withColumn("least", F.when(confirmed >= 2, 10).otherwise(30))
    return rows.where(F.col("named") | (F.col("scanned") == 0) | F.col("in_context") | (F.col("matched") * 100 >= F.col("scanned") * F.col("least"))).drop("least")


def candidates(values: DataFrame, scanned: DataFrame, names: DataFrame, book: Rulebook = STANDARD) -> DataFrame:
    """Name findings and dense value findings in one shape, before any conflict is resolved."""
    by_value = dense(weighed(values, scanned, names, book)).select(*_COLUMN, "label", F.lit(BY_VALUE).alias("detector_type"), "detector", F.col("final").alias("weight"), F.col("in_context").alias("context_matched"), F.col("matched").alias("matched_count"), F.col("scanned").alias("scanned_count"), "named")
    zero = F.lit(0).cast("long")
    by_name = names.select(*_COLUMN, "label", F.lit(BY_NAME).alias("detector_type"), F.lit("regex").alias("detector"), "weight", F.lit(False).alias("context_matched"), zero.alias("matched_count"), zero.alias("scanned_count"), F.lit(True).alias("named"))
    both = by_name.unionByName(by_value)
    return both.withColumn("tier", tier_of(F.col("label"), book)).withColumn("domain", domain_of(F.col("label"), book)).withColumn("confidence", confidence_of(F.col("weight")))


def dominant_domain(found: DataFrame) -> DataFrame:
    """(table, table_domain): the domain with most High or Medium findings by name or of Tier1; ties by name."""
    scored = found.where(F.col("domain").isNotNull() & F.col("confidence").isin("High", "Medium") & ((F.col("detector_type") == BY_NAME) | (F.col("tier") == "Tier1")))
    per = scored.groupBy("table", "domain").count()
    return per.groupBy("table").agg(F.min_by("domain", F.struct((-F.col("count")).alias("n"), "domain")).alias("table_domain"))


def tier_capped(found: DataFrame) -> DataFrame:
    """Without name and context, Tier2 and Tier3 weigh 0.69 at most."""
    loose = ~F.col("named") & ~F.col("context_matched")
    cap = loose & F.col("tier").isin("Tier2", "Tier3") & (F.col("weight") >= 0.70)
    return found.withColumns({"weight": F.when(cap, 0.69).otherwise(F.col("weight")), "confidence": F.when(cap, "Medium").otherwise(F.col("confidence"))})


def domain_gated(found: DataFrame, domains: DataFrame) -> DataFrame:
    """Without name and context, Tier3 needs the table's dominant domain."""
    loose = ~F.col("named") & ~F.col("context_matched") & (F.col("tier") == "Tier3")
    return found.join(domains, "table", "left").where(~loose | F.coalesce(F.col("domain") == F.col("table_domain"), F.lit(False))).drop("table_domain")


def winners(found: DataFrame) -> DataFrame:
    """Columns whose name says something keep their best finding by name and their best by value; others keep all."""
    order = Window.partitionBy(*_COLUMN, "detector_type").orderBy(F.desc("weight"), F.desc("context_matched"), "label", "detector")
    return found.withColumn("rank", F.row_number().over(order)).where(~F.col("named") | (F.col("rank") == 1)).drop("rank")


FINDING = [*_COLUMN, "label", "detector_type", "detector", "weight", "confidence", "tier", "domain", "context_matched", "matched_count", "scanned_count"]


def findings(values: DataFrame, scanned: DataFrame, names: DataFrame, book: Rulebook = STANDARD) -> DataFrame:
    """The findings of a scan. The dominant domain is taken before weights are capped."""
    found = candidates(values, scanned, names, book)
    return winners(domain_gated(tier_capped(found), dominant_domain(found))).select(*FINDING)


def name_findings(spark: SparkSession, by_name: list[tuple[str, str, str, float]], book: Rulebook = STANDARD) -> DataFrame:
    """The findings of a scan that reads no values: the best label of each name, made on the driver. A local relation, so that
    reading it takes no job."""
    best: dict[tuple[str, str], tuple[float, str]] = {}
    for t, c, label, weight in by_name:
        best[t, c] = min(best.get((t, c), (0.0, "")), (-weight, label))
    rows = [(t, c, label, BY_NAME, "regex", -w, confidence(-w), *book.labels.get(label, ("Tier3", None)), False, 0, 0) for (t, c), (w, label) in best.items()]
    kinds = [pa.string()] * 5 + [pa.float64()] + [pa.string()] * 3 + [pa.bool_(), pa.int64(), pa.int64()]
    return spark.createDataFrame(pa.table([pa.array(v, k) for v, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=FINDING))
