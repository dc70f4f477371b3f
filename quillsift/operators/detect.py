"""From cells to evidence: fields, segments, rules, resolution and sums.

Cells leave the JVM once, in Arrow batches: there documents (JSON, XML, queries, Base64, loose pairs) are taken apart, long texts cut and
rules tried on all texts of a batch at once; only pieces with a match come back. Detectors that are functions get the pieces in batches of their
own, if there are any. Resolution is expressions on one row a cell. Nothing is shuffled before the sums of evidence, which hold one row a column
and label.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillsift.functions import documents, matcher
from quillsift.functions.cell import Asked, context_of
from quillsift.functions.registry import confidence
from quillsift.functions.rulebook import STANDARD, Names, Rulebook, rulebook
from quillsift.functions.value_rules import VALUE_RULES, Rule
from quillsift.operators import resolve

#: Values of up to so many bytes are judged once a column.
SHORT = 64


def prepared(text: Column) -> Column:
    """A text in the form that rules are tried on."""
    return F.lower(text)


def _by_slices(low: pa.Array, contexts: pa.Array, judge: Callable[[pa.Array, pa.Array], pa.Array]) -> pa.Array:
    parts = [judge(low[lo:hi], contexts[lo:hi]) for lo, hi in matcher.slices(low)]
    if len(parts) > 1:
        matcher.release()
    return pa.concat_arrays(parts) if parts else judge(low, contexts)


def matches(text: Column, contexts: Column, rules: Mapping[str, Sequence[Rule]] | None = None, own: frozenset[str] = frozenset()) -> Column:
    """array<MATCH> of every label whose first matching and valid rule fires on a :func:`prepared` text; positions are those of its
    leftmost match. Gated rules fire only for labels among ``contexts``. Labels in ``own`` have rules that the quick patterns do not know."""
    known = dict(VALUE_RULES if rules is None else rules)

    def run(low: pa.Array, contexts: pa.Array) -> pa.Array:
        return _by_slices(low, contexts, lambda t, c: matcher.matches(t, known, matcher.in_lists(c), own))

    return F.arrow_udf(run, f"array<{resolve.MATCH}>")(text, contexts)


def fired(text: Column, rules: Mapping[str, Sequence[Rule]]) -> Column:
    """array<string>: labels of :func:`matches` without any context."""
    known = dict(rules)

    def labels(low: pa.Array) -> pa.Array:
        hits = list(matcher.fires(low, known, lambda _: np.zeros(len(low), bool), spans=False))
        texts = np.concatenate([np.zeros(0, np.int64), *(f.texts for f in hits)])
        order = np.argsort(texts, kind="stable")
        which = np.repeat(np.arange(len(hits)), [len(f.texts) for f in hits])[order].astype(np.int64)
        ends = np.append(0, np.cumsum(np.bincount(texts, minlength=len(low))))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([f.label for f in hits], pa.string()).take(pa.array(which)))

    def run(low: pa.Array) -> pa.Array:
        return _by_slices(low, low, lambda t, _: labels(t))

    return F.arrow_udf(run, "array<string>")(text)


def counted(cell_rows: DataFrame, long_rows: DataFrame | None = None) -> DataFrame:
    """(table, column, value, n): short values once a column with their number of cells, long ones as they are. Flags, dates and codes
    are judged once; the longer a text, the less likely it comes again, and it would have to be moved. Long ones may come as ``long_rows``
    from a pass of their own over fewer columns."""
    size = F.octet_length("value")
    long_rows = cell_rows.where(size > SHORT) if long_rows is None else long_rows
    short = cell_rows.where(size <= SHORT).groupBy("table", "column", "value").agg(F.count("*").alias("n"))
    return short.unionByName(long_rows.withColumn("n", F.lit(1).cast("long")))


_MATCHES = pa.list_(pa.list_(matcher.MATCH))
_READ = pa.list_(pa.struct([("raw", pa.string()), ("context", pa.string()), ("found", pa.list_(matcher.MATCH))]))


def _cut(values: pa.Array, contexts: pa.Array, asked: np.ndarray, names: Names) -> tuple[np.ndarray, pa.Array, pa.Array, np.ndarray]:
    """(place of each piece's value, pieces, their contexts, whether a value holds fields): the key-value pairs of values that may hold
    some, each with its own context; else the value itself, or what it wraps; long ones in segments."""
    size = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    plain = np.flatnonzero(~asked & (size > 0) & (size < 512))
    extracted, at, texts, own = np.zeros(len(values), bool), [], [], []
    some = np.flatnonzero((asked | (size >= 512)) & (size > 0))
    taken = zip(values.take(pa.array(some)).to_pylist(), contexts.take(pa.array(some)).to_pylist())
    for i in some:
        value, context = next(taken)
        parts = [(value, context)]
        if asked[i]:
            text, pairs = documents.extract(value)
            extracted[i] = bool(pairs)
            parts = [(v, names.context(k)) for k, v in pairs] or [(text or value, context)]
        for text, c in parts:
            pieces = documents.packed(text)
            at += [i] * len(pieces)
            texts += pieces
            own += [c] * len(pieces)
    place = np.concatenate([plain, np.array(at, np.int64)])
    order = pa.array(np.argsort(place, kind="stable"))
    whole = pa.concat_arrays([values.take(pa.array(plain)), pa.array(texts, pa.string())])
    return np.sort(place), whole.take(order), pa.concat_arrays([contexts.take(pa.array(plain)), pa.array(own, pa.string())]).take(order), extracted


def _alike(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows (table, column, n, loose, pieces without texts) that differ in nothing but ``n`` as one, with the sum of their ``n``."""
    code = lambda column: pc.dictionary_encode(column, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    pieces = batch.column("pieces")
    each = pieces.flatten()
    found = each.field("found").flatten()
    # numbers of each row: for every piece its context and number of matches, then those
    sizes = pc.list_value_length(each.field("found")).to_numpy(zero_copy_only=False)
    ends = np.append(0, np.cumsum(sizes + 1))
    numbers = np.zeros((ends[-1], 4), np.int32)
    heads = np.zeros(len(numbers), bool)
    heads[ends[:-1]] = True
    numbers[heads, 0], numbers[heads, 1] = code(each.field("context")), sizes
    for i, column in enumerate((code(found.field("label")), code(found.field("weight")), found.field("start"), found.field("end"))):
        numbers[~heads, i] = column
    held, width = numbers.tobytes(), numbers.strides[0]
    at = (ends[np.append(0, np.cumsum(pc.list_value_length(pieces).to_numpy(zero_copy_only=False)))] * width).tolist()
    cells = zip(code(batch.column("table")).tolist(), code(batch.column("column")).tolist(), batch.column("loose").to_pylist(), at, at[1:])
    seen: dict[tuple, int] = {}
    group = np.array([seen.setdefault((t, c, loose, held[lo:hi]), len(seen)) for t, c, loose, lo, hi in cells], np.int64)
    n = np.zeros(len(seen), np.int64)
    np.add.at(n, group, batch.column("n").to_numpy(zero_copy_only=False))
    kept = batch.take(pa.array(np.unique(group, return_index=True)[1]))
    return kept.set_column(kept.schema.get_field_index("n"), "n", pa.array(n))


def _read(rows: DataFrame, book: Rulebook, regex: bool, counted: bool) -> DataFrame:
    """(table, column, n, loose, pieces) of rows (table, column, n, value, context, asked): what the rules find in each piece. Pieces without
    a match are left out, unless detectors that are functions will be asked of them. Of counted rows those without a value are left out, and
    rows of a batch in which the same is found become one, so that far fewer rows are resolved than values are read."""
    own, raw = frozenset(label for d in book.detectors for label in d.values), bool(book.asked)
    rules = dict(book.values) if regex else {}

    def judge(batch: pa.RecordBatch, names: Names) -> pa.RecordBatch:
        values, contexts = batch.column("value"), batch.column("context")
        place, texts, within, extracted = _cut(values, contexts, pc.fill_null(batch.column("asked"), False).to_numpy(zero_copy_only=False), names)
        found = matcher.matches(matcher.lower(texts), rules, matcher.among(within), own)
        if not raw:
            kept = np.flatnonzero(pc.list_value_length(found).to_numpy(zero_copy_only=False))
            place, within, found = place[kept], within.take(pa.array(kept)), found.take(pa.array(kept))
            texts = pa.nulls(len(kept), pa.string())
        ends = np.append(0, np.cumsum(np.bincount(place, minlength=len(values))))
        pieces = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([texts, within, found], fields=list(_READ.value_type)))
        loose = pa.array(pc.is_null(contexts).to_numpy(zero_copy_only=False) & ~extracted)
        out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("table", "column", "n")), loose, pieces], names=["table", "column", "n", "loose", "pieces"])
        return _alike(out) if counted and not raw else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names(book)
        for batch in batches:
            if counted:
                batch = batch.filter(pc.is_valid(batch.column("value")))
            for lo, hi in matcher.slices(batch.column("value")):
                yield judge(batch.slice(lo, hi - lo), names)
            matcher.release()

    return rows.mapInArrow(run, f"table string, column string, n bigint, loose boolean, pieces array<struct<raw:string,context:string,found:array<{resolve.MATCH}>>>")


def asked(rows: DataFrame, book: Rulebook) -> DataFrame:
    """Rows with a column ``by0``, ``by1``, ... for each detector that is a function: array<array<MATCH>>, what it finds in each of
    their ``pieces``, in Arrow batches."""
    detectors = book.asked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        functions = [Asked(d) for d in detectors]
        try:
            for batch in batches:
                cells = batch.column("pieces").to_pylist()
                for i, judge in enumerate(functions):
                    found = [[[dict(zip(("label", "weight", "start", "end", "in_context"), (*m, False))) for m in piece] for piece in cell] for cell in judge(cells)]
                    batch = batch.append_column(f"by{i}", pa.array(found, _MATCHES))
                yield batch
        finally:
            for judge in functions:
                judge.close()

    more = T.StructType.fromDDL(", ".join(f"by{i} array<array<{resolve.MATCH}>>" for i in range(len(detectors))))
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *more.fields]))


def judged(cell_rows: DataFrame, contexts: dict[str, str | None], book: Rulebook = STANDARD, regex: bool = True, open_names: bool = False) -> DataFrame:
    """(table, column, n, found): per cell of (table, column, value) the merged evidence of its fields and segments, array<struct<detector, label, weight, in_context>>.
    Of :func:`counted` cells, with their number n, those with the same evidence may share a row, and those whose value is null are left out.

    ``contexts`` holds what the columns' names stand for; with ``open_names`` other names occur too (keys of maps and stores) and
    are looked up in Arrow batches."""
    known = {k: v for k, v in contexts.items() if v is not None}
    context = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[F.col("column")] if known else F.lit(None).cast("string")
    if open_names:
        context = context_of(book)(F.col("column"))
    rows = cell_rows if "n" in cell_rows.columns else cell_rows.withColumn("n", F.lit(1).cast("long"))
    rows = rows.select("table", "column", "n", "value", context.alias("context"))
    rows = _read(rows.withColumn("asked", F.col("context").isNull() & documents.may_hold_fields(F.col("value"))), book, regex, "n" in cell_rows.columns)
    weighed = lambda found, p: resolve.capped(resolve.boosted(found, p["context"]), p["context"], book)
    resolved = lambda found: F.when(F.col("loose"), resolve.occurrence_groups(found)).otherwise(resolve.field_winner(found))

    parts = []
    if regex:
        each = F.transform(F.col("pieces"), lambda p: F.struct(weighed(p["found"], p).alias("all")))
        parts.append(("regex", F.flatten(F.transform(each, lambda e: resolved(e["all"])))))
    if book.asked:
        rows = asked(rows, book)
        for i, d in enumerate(book.asked):
            each = F.zip_with("pieces", f"by{i}", lambda p, found: F.struct(weighed(found, p).alias("all")))
            parts.append((d.name, F.flatten(F.transform(each, lambda e: resolved(e["all"])))))

    by = lambda detector, found: F.transform(resolve.row_merge(found), lambda m: F.struct(F.lit(detector).alias("detector"), m["label"].alias("label"), m["weight"].alias("weight"), m["in_context"].alias("in_context")))

    merged = [by(*p) for p in parts]
    return rows.select("table", "column", "n", F.concat(*merged).alias("found"))


def evidence(judged_rows: DataFrame) -> DataFrame:
    """Sums of evidence: for a label its summed weight, number of cells and whether any was in context; and a row without a label
    that counts the cells of a column. One shuffle of partial sums."""
    cell = F.array(F.struct(F.lit(None).cast("string").alias("detector"), F.lit(None).cast("string").alias("label"), F.lit(0.0).alias("weight"), F.lit(False).alias("in_context")))
    rows = judged_rows.select("table", "column", "n", F.explode(F.concat(cell, "found")).alias("m")).select("table", "column", "n", "m.*")
    return rows.groupBy("table", "column", "detector", "label").agg(F.sum(F.col("weight") * F.col("n")).alias("weight"), F.sum("n").alias("matched"), F.bool_or("in_context").alias("in_context"))


def added(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table, column, detector, label, weight, matched, in_context) and (table, column, scanned)."""
    total = parts.groupBy("table", "column", "detector", "label").agg(F.sum("weight").alias("weight"), F.sum("matched").alias("matched"), F.bool_or("in_context").alias("in_context"))
    return total.where("label is not null"), total.where("label is null").select("table", "column", F.col("matched").alias("scanned"))


def pair_labels(column: str, value: str, book: Rulebook = STANDARD) -> Column:
    """Label of (column, value) pairs, both of them data: every label of the column's name is context. An empty or "?" value says
    nothing; a value without a label takes the name's first one; else the first label that both have, else none."""
    names, ranked = Names(book), sorted(book.labels)
    rank = {label: i for i, label in enumerate(ranked)}
    own = frozenset(label for d in book.detectors for label in d.values)

    def judge(name: pa.Array, low: pa.Array) -> pa.Array:
        words = pc.dictionary_encode(pc.fill_null(name, ""))
        known, code = [names.labels(w) for w in words.dictionary.to_pylist()], words.indices.to_numpy()
        within = lambda label: np.array([label in k for k in known], bool)[code]
        alone = np.array([min((rank[x] for x in k), default=len(rank)) for k in known], np.int64)[code]
        any_label, both = np.zeros(len(low), bool), np.full(len(low), len(rank))
        for f in matcher.fires(low, book.values, within, own, spans=False):
            any_label[f.texts] = True
            shared = f.texts[within(f.label)[f.texts]]
            both[shared] = np.minimum(both[shared], rank[f.label])
        return pa.array([*ranked, None], pa.string()).take(pa.array(np.where(any_label, both, alone)))

    def run(name: pa.Array, low: pa.Array) -> pa.Array:
        return _by_slices(low, name, lambda t, n: judge(n, t))

    return F.when(~F.col(value).isin("", "?"), F.arrow_udf(run, "string")(F.col(column), prepared(F.col(value))))


def by_name(names: list[tuple[str, str]], book: Rulebook = STANDARD) -> list[tuple[str, str, str, float]]:
    """(table, column, label, weight) of every label that a column's name stands for. Runs on the driver: names only."""
    known = Names(book)
    return [(t, c, label, w) for t, c in names for label, w in sorted(known.labels(c).items())]


def column_evidence(spark: SparkSession, names: list[tuple[str, str]], book: Rulebook = STANDARD) -> DataFrame:
    return spark.createDataFrame(by_name(names, book), "table string, column string, label string, weight double")


def named(spark: SparkSession, names: list[tuple[str, str]], region: str = "") -> DataFrame:
    """Column findings with the winner of each column marked: table, column, label, weight, confidence, tier, domain, is_context."""
    book = rulebook(region)
    known = Names(book)
    rows = [(t, c, label, w, confidence(w), *book.labels[label], label == known.context(c)) for t, c in names for label, w in sorted(known.labels(c).items())]
    return spark.createDataFrame(rows, "table string, column string, label string, weight double, confidence string, tier string, domain string, is_context boolean")


# --- single rules ---


def rule_number(label: str, value: Column, context: bool = False) -> Column:
    """Number of the first rule of a label whose pattern occurs in the value (before checks); null if none. As in a scan, rules are
    tried only on texts that have what the label needs."""
    rules = {label: VALUE_RULES[label]}

    def judge(low: pa.Array) -> pa.Array:
        rule = np.full(len(low), -1, np.int32)
        for f in matcher.fires(low, rules, lambda _: np.full(len(low), context), checked=False, spans=False):
            rule[f.texts] = f.rule
        return pa.array(rule, mask=rule < 0)

    def run(low: pa.Array) -> pa.Array:
        return _by_slices(low, low, lambda t, _: judge(t))

    return F.arrow_udf(run, "int")(prepared(value))
