"""Secrets in texts, in DataFrame operations only.

Three patterns give the base spans (assignments, access keys, hexadecimal runs). Further
spans come from a battery of randomness tests on every other run of 20 or more characters
that an encoded key could consist of. The run's encoding is inferred and fixes its alphabet;
then a chi-squared test of uniformity over the alphabet, a runs test about its middle and a
serial correlation test each give a p-value under the hypothesis that the run is random, and
Fisher's method combines them.

A false discovery is a word, path or number that is reported as random. A run is reported if
the battery does not reject randomness at the level ``FLOOR`` and chance does not explain that it
looks unlike words: its likelihood as random signs of its alphabet, over that under a model of
words, paths and numbers, is a likelihood ratio, and what is drawn from that model reaches a ratio
of t with probability 1/t at most. So the inverse ratio is a p-value of "no key" (1 where the
battery rejects), and the step-up procedure of Benjamini and Hochberg holds the false share at
``LEVEL`` within each stratum of length, whether it holds one key or most runs are keys. The model
is the chance of a sign after a sign: pairs counted in all the corpus' own words that are too
short to be runs, and a fixed prior of classes of signs for what they leave open. Of random runs
``FLOOR`` are missed by the battery, and those of about 20 signs in corpora of few words more.

Positions are code points with exclusive ends. A text's parts between matches and the
matches themselves alternate, so positions follow by adding up lengths.

Defined cases: null and empty texts have no span; a very long text is searched whole; spans
that begin together are ordered by kind, runs of equal p stay or go together; repeated rows
each get their result and each count in the estimate; an empty table gives an empty result;
only ``doc_id`` and ``text`` are read, so further columns do no harm.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsift.llm.common import staged

#: The kinds in order, their patterns, and the least characters of (group of) a match.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: The hex kind in the form that only matches long enough runs; equal, since runs are maximal.
_SEARCH = {"hex": r"[0-9a-f]{24,}", "access": r"AKIA[A-Z0-9]{16,}"}
LEAST = 20
#: An encoded key with its padding; a sign of equality in front of it belongs to no run.
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}+"
#: Largest part of the reported runs that may be false.
LEVEL = 0.05
#: Level at which the battery rejects randomness.
FLOOR = 0.02
#: First length of each stratum.
STRATA = (20, 24, 32, 48, 64)
#: Ratios are counted by their natural logarithms, up to this one.
BINS = 100
#: Chance of the next sign's class after small letters, capitals, digits, other signs; what it weighs, in signs counted.
CLASSES = ((0.94, 0.015, 0.025, 0.02), (0.3, 0.64, 0.03, 0.03), (0.03, 0.03, 0.9, 0.04), (0.45, 0.2, 0.3, 0.05))
PRIOR = 50.0
#: Elements whose running sums are taken one by one.
STRIDE = 32
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "alnum36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "alnum62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


def _let(x: Column, body) -> Column:
    return F.transform(F.array(x), body)[0]


def running(x: Column, levels: int = 3) -> Column:
    """Sums of an array of integers up to each element: within strides, on top of the running sums of the strides."""
    total = lambda some: F.aggregate(some, F.lit(0), lambda s, v: s + v)
    within = lambda some, before: F.transform(some, lambda _, j: before + total(F.slice(some, F.lit(1), j + 1)))
    if levels == 1:
        return _let(x, lambda a: within(a, F.lit(0)))
    cut = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / STRIDE).cast("int")), lambda i: F.slice(a, i * STRIDE + 1, F.lit(STRIDE)))
    joined = lambda parts: F.flatten(F.zip_with(parts, running(F.transform(parts, total), levels - 1), lambda some, end: within(some, end - total(some))))
    return F.when(F.size(x) > 0, _let(x, lambda a: _let(cut(a), joined))).otherwise(F.array().cast("array<int>"))


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found

    def placed(hits: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
        steps = F.zip_with(gaps, hits, lambda gap, hit: F.length(gap) + F.length(hit))
        ends = F.arrays_zip(running(steps).alias("end"), hits.alias("hit"), values.alias("value"))
        return F.transform(ends, lambda e: F.struct((e["end"] - F.length(e["hit"])).alias("start"), e["end"].alias("end"), e["value"].alias("value")))

    return F.when(text.rlike(pattern), _let(found, placed)).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def clear_of(runs: Column, spans: Column) -> Column:
    """The runs that overlap none of the spans. Both are in order, runs are apart from each other. Where a run ends, more spans
    have begun than had ended where it began if any lies across it."""
    edge = lambda name, rank: lambda r: F.struct(r[name].alias("at"), F.lit(rank).alias("rank"))

    def kept(events: Column) -> Column:
        count = lambda rank: running(F.transform(events, lambda e: (e["rank"] == rank).cast("int")))
        told = F.zip_with(F.zip_with(events, count(2), lambda e, n: F.struct(e["rank"].alias("rank"), n.alias("begun"))), count(0), lambda e, n: F.struct(e["rank"].alias("rank"), e["begun"].alias("begun"), n.alias("ended")))
        both = lambda t: F.zip_with(F.filter(t, lambda e: e["rank"] == 1), F.filter(t, lambda e: e["rank"] == 3), lambda last, first: last["begun"] > first["ended"])
        return _let(told, lambda t: F.filter(F.zip_with(runs, both(t), lambda r, hit: F.when(~hit, r)), lambda r: r.isNotNull()))

    events = F.array_sort(F.concat(F.transform(spans, edge("end", 0)), F.transform(runs, edge("end", 1)), F.transform(spans, edge("start", 2)), F.transform(runs, edge("start", 3))))
    return F.when((F.size(runs) > 0) & (F.size(spans) > 0), _let(events, kept)).otherwise(runs)


def base_spans(text: Column) -> Column:
    """array<struct<start, rank, end, kind>> in order."""
    def of_kind(rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
        hits = F.filter(located(text, _SEARCH.get(kind, pattern), group), lambda x: F.length(x["value"]) >= least)
        return F.transform(hits, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))

    parts = [of_kind(rank, *rule) for rank, rule in enumerate(BASE)]
    return F.array_sort(F.concat(*parts))


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the normal distribution, by a rational approximation good to 1e-7."""
    a = F.abs(z)
    t = 1.0 / (1.0 + 0.2316419 * a)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * series
    return F.when(z < 0, 1.0 - tail).otherwise(tail)


def word_model(docs: DataFrame) -> list[float]:
    """Natural logarithms of the chance of each sign after each sign in what is no key, by 64 * first + second in the order of
    base64: pairs in all words of fewer than LEAST signs, each distinct word cut once, and the prior of their classes."""
    words = docs.select(F.explode(F.split(F.translate("text", "-_", "+/"), "[^A-Za-z0-9+/]+")).alias("w")).where(F.length("w").between(2, LEAST - 1)).groupBy("w").count()
    pairs = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring("w", i, F.lit(2)))).alias("pair"), "count")
    counts = {r["pair"]: r["n"] for r in pairs.groupBy("pair").agg(F.sum("count").alias("n")).collect()}  # 64 * 64 rows at most
    signs = ALPHABETS["base64"]
    of = [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in signs]
    out = []
    for i, a in enumerate(signs):
        row = [counts.get(a + b, 0) for b in signs]
        out += [math.log((n + PRIOR * CLASSES[of[i]][of[j]] / of.count(of[j])) / (sum(row) + PRIOR)) for j, n in enumerate(row)]
    return out


def battery(runs: Column, model: list[float] | None = None) -> Column:
    """array<struct<start, end, n, p, ratio>> from array<struct<start, end, value>>: the combined p-value of randomness, and the
    natural logarithm of how much likelier random signs give the run than the word model does (0 without one)."""

    def infer(r: Column) -> Column:
        body = F.translate(F.regexp_replace(r["value"], "^=+|=+$", ""), "-_", "+/")
        digit = body.rlike("[0-9]")
        name = (
            F.when(digit & body.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex")
            .when(digit & body.rlike("^[A-Z2-7]+$"), "base32")
            .when(digit & body.rlike("^(?:[a-z0-9]+|[A-Z0-9]+)$"), "alnum36")
            .when(body.rlike("^[A-Za-z0-9]+$"), "alnum62")
            .otherwise("base64")
        )
        return F.struct(r["start"].alias("start"), r["end"].alias("end"), F.when(name.isin("hex", "alnum36"), F.lower(body)).otherwise(body).alias("body"), name.alias("name"), body.alias("raw"))

    def place(r: Column) -> Column:
        letters = F.create_map(*[F.lit(x) for kv in ALPHABETS.items() for x in kv])[r["name"]]
        places = lambda text, of: F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.position(c, of))
        marks = F.transform(places(r["body"], letters), lambda v: v.cast("double"))
        return F.struct(r["start"].alias("start"), r["end"].alias("end"), F.length(letters).cast("double").alias("a"), marks.alias("x"), unlike(places(r["raw"], F.lit(ALPHABETS["base64"])), F.length(letters)).alias("ratio"))

    def unlike(x: Column, size: Column) -> Column:
        if model is None:
            return F.lit(0.0)
        pairs = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda p, q: (p - 1) * 64 + q)
        return F.aggregate(pairs, F.lit(0.0), lambda s, at: s - F.element_at(F.lit(model), at)) - F.size(pairs) * F.ln(size)

    def sums(r: Column) -> Column:
        x, n = r["x"], F.size(r["x"]).cast("double")
        mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / n
        # the squares of the signs' numbers: the k-th of equal signs in order adds 2k - 1
        again = lambda s, v: F.when(v == s["v"], s["k"] + 2.0).otherwise(1.0)
        start = F.struct(F.lit(-1.0).alias("v"), F.lit(0.0).alias("k"), F.lit(0.0).alias("all"))
        square = F.aggregate(F.sort_array(x), start, lambda s, v: F.struct(v.alias("v"), again(s, v).alias("k"), (s["all"] + again(s, v)).alias("all")), lambda s: s["all"])
        spread = F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean))
        pairs = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
        product = F.aggregate(pairs, F.lit(0.0), lambda s, v: s + (v["p"] - mean) * (v["q"] - mean))
        half = r["a"] / 2
        turns = F.aggregate(pairs, F.lit(1.0), lambda s, v: s + ((v["p"] > half) != (v["q"] > half)).cast("double"))
        high = F.size(F.filter(x, lambda v: v > half)).cast("double")
        return F.struct(r["start"].alias("start"), r["end"].alias("end"), r["a"].alias("a"), n.alias("n"), square.alias("square"), spread.alias("spread"), product.alias("product"), turns.alias("turns"), high.alias("high"), r["ratio"].alias("ratio"))

    def combine(r: Column) -> Column:
        a, n = r["a"], r["n"]
        chi = (a * r["square"] / n - n - (a - 1)) / F.sqrt(2 * (a - 1) * (n - 1) / n)
        both = 2 * r["high"] * (n - r["high"])
        var = both * (both - n) / (n * n * (n - 1))
        runs_z = F.when(var > 0, (r["turns"] - 1 - both / n) / F.sqrt(var)).otherwise(F.lit(8.0))
        serial = F.when(r["spread"] > 0, (r["product"] / r["spread"] + 1 / n) * F.sqrt(n)).otherwise(F.lit(8.0))
        tails = (upper_tail(chi), 2 * upper_tail(F.abs(runs_z)), 2 * upper_tail(F.abs(serial)))
        h = -sum((F.ln(F.greatest(F.least(t, F.lit(1.0)), F.lit(1e-12))) for t in tails), F.lit(0.0))
        return F.struct(r["start"].alias("start"), r["end"].alias("end"), n.cast("int").alias("n"), (F.exp(-h) * (1 + h + h * h / 2)).alias("p"), r["ratio"].alias("ratio"))

    marked = F.transform(F.transform(runs, infer), place)
    return F.transform(F.transform(F.filter(marked, lambda r: F.size(r["x"]) >= LEAST), sums), combine)


def stratum(n: Column) -> Column:
    """First length of the stratum of ``n``."""
    out = F.lit(STRATA[0])
    for first in STRATA[1:]:
        out = F.when(n >= first, first).otherwise(out)
    return out


def bin_of(r: Column) -> Column:
    """The whole part of a run's ratio, and 0 if the battery rejects it."""
    return F.when(r["p"] >= FLOOR, F.greatest(F.least(F.floor(r["ratio"]), F.lit(BINS)), F.lit(0))).otherwise(0).cast("int")


def cuts(rows: DataFrame) -> DataFrame:
    """(s, bin) of the strata that report: the lowest ratio whose inverse is at most LEVEL times the part of the runs that reach it."""
    hist = rows.select(F.explode("runs").alias("r")).groupBy(stratum(F.col("r.n")).alias("s"), bin_of(F.col("r")).alias("bin")).count()
    by = Window.partitionBy("s")
    hist = hist.withColumn("reached", F.sum("count").over(by.orderBy(F.desc("bin")))).withColumn("all", F.sum("count").over(by))
    return hist.where(F.exp(-F.col("bin").cast("double")) * F.col("all") <= LEVEL * F.col("reached")).groupBy("s").agg(F.min("bin").alias("bin"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random for every text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", base_spans(text).alias("base"), located(text, RUN).alias("found"))
    runs = battery(clear_of(F.col("found"), F.col("base")), word_model(docs))
    rows = staged(rows.select("doc_id", "base", runs.alias("runs")), "secrets")
    found = {r["s"]: r["bin"] for r in cuts(rows).collect()}  # one row a stratum
    cut = lambda r: F.coalesce(*[F.when(stratum(r["n"]) == s, b) for s, b in found.items()], F.lit(BINS + 1))
    extra = F.transform(F.filter("runs", lambda r: bin_of(r) >= cut(r)), lambda r: F.struct(r["start"].alias("start"), F.lit(len(BASE)).alias("rank"), r["end"].alias("end"), F.lit("random").alias("kind")))
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    every = F.array_sort(F.concat("base", extra))
    return rows.select("doc_id", *[count(k) for k, *_ in BASE], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"), F.size(extra).cast("long").alias("n_random"))
