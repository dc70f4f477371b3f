"""Rules on whole batches against the plain version, and the plans of queries that try rules."""

import pyarrow as pa
import pytest
from plain_cells import CellScanner, segments

from quillsift.functions import documents, matcher
from quillsift.functions.value_rules import VALUE_RULES
from quillsift.plans import catalogue
from test_rules import sample_values

#: Queries that try many rules on cells of the derived view.
ON_CELLS = ["field_winner", "occurrence_groups", "row_merge", "unknown_cap", "context_boost", "region_filter", "pair_detect", "context_gate"]


@pytest.mark.parametrize("context", [None, "Phone", "BankAccountNumber", "LoanAccountNumber", "InsurancePolicyNumber", "FASTagID", "BirthDate"])
def test_batches_against_plain_python(context):
    values = sample_values() + ["é ü 12 Main Street, 9876543210", "😀 27ABCDE1234F1Z5 😀", ""]
    low = matcher.lower(pa.array([None, *values, "x"]))[1:-1]
    got = matcher.matches(low, VALUE_RULES, matcher.among(pa.array([context] * len(low), pa.string()))).to_pylist()
    plain = CellScanner()
    for value, found in zip(values, got):
        want = plain.value_labels(value, frozenset([context] if context else []))
        assert sorted((m["label"], m["weight"], m["start"], m["end"]) for m in found) == sorted((label, float(w), s, e) for label, w, s, e in want), value


def test_slices_and_pieces():
    texts = pa.array(["ab", None, "", "c" * 10, "d", "e"])
    assert list(matcher.slices(texts, 3)) == [(0, 3), (3, 4), (4, 6)] and list(matcher.slices(texts[:0])) == []
    for value in [*sample_values(), "word " * 200, "x" * 600 + " y", "é" * 256, "", " " * 300]:
        assert documents.packed(value) == segments(value)


def test_the_derived_view_is_dealt_out(spark):
    """However small its file is: a million keys fit into a few megabytes, and would be one task."""
    assert catalogue.derived(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 32


@pytest.mark.parametrize("name", ON_CELLS)
def test_rules_are_tried_on_batches(spark, name):
    plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "RLIKE" not in plan and "ArrowEvalPython" in plan and "REPARTITION_BY_NUM" in plan


@pytest.mark.parametrize("name", ["detect_address", "detect_vehiclenumber"])
def test_one_rule_is_tried_on_batches_and_flags_once(spark, name):
    plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "RLIKE" not in plan and "ArrowEvalPython" in plan and "hashpartitioning(l_returnflag" in plan
    source = catalogue.corpus(spark, "/root/testdata/sf0.001").where("source = 'lineitem.l_returnflag'").collect()
    assert len(source) == 3 and sum(r["n"] for r in source) == catalogue.table(spark, "/root/testdata/sf0.001", "lineitem").count()


def test_addresses_are_tried_where_a_street_word_stands():
    low = pa.array(["12 long winding lane, oak street", "7 1 " * 20_000 + "12 straight on", "221 baker st.", "a drive of 20 years", "12-x park ", "9 x park "])
    hits = {int(t): f.rule for f in matcher.fires(low, {"Address": VALUE_RULES["Address"]}, lambda _: None, spans=False) for t in f.texts}
    assert hits == {0: 0, 2: 0, 5: 1}


def test_long_texts_are_judged_in_slices(spark):
    """One crossing into Python; a batch of long texts is worked on in slices, and pieces without a match do not come back."""
    from quillsift.operators import detect

    texts = [("word " * 3000) + ("9876543210" if i % 2 else "none") for i in range(400)]  # 6 MB
    rows = spark.createDataFrame([("t", "c", v) for v in texts], "table string, column string, value string").coalesce(1)
    judged = detect.judged(rows, {"c": None})
    assert judged._jdf.queryExecution().executedPlan().toString().count("Python") + judged._jdf.queryExecution().executedPlan().toString().count("MapInArrow") <= 2
    got = [[m["label"] for m in r["found"]] for r in judged.collect()]
    assert got == [["Phone"] if i % 2 else [] for i in range(400)]


def test_the_scan_of_the_view_tries_rules_on_batches(spark):
    from quillsift.operators import cells, detect

    view = cells.cells(catalogue.derived(spark, "/root/testdata/sf0.001"), "derived")
    plan = detect.judged(detect.counted(view), {c: None for c in catalogue.DERIVED})._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan and "REPARTITION_BY_NUM" in plan


def test_cells_are_counted_before_they_are_made_tidy(spark):
    """Cells are unpivoted in compiled code, and only different texts are trimmed; nothing is lost."""
    from quillsift.operators import detect
    from quillsift.plans import scan
    from quillsift.sources.source import as_source

    df = spark.sql("SELECT explode(array(' a', 'a', 'a', ' NULL', 'NULL', '', ' ', null, repeat('x', 70) || ' ', repeat(' ', 70) || 'y')) AS s, DATE'2024-05-06' AS d, map('k', 'v ') AS m")
    source = as_source({"t": df})
    found = scan.value_cells(scan.ScanConfig("deepscan"), source, [scan.TablePlan("t", "all", 10)])
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
    held = sorted((r["column"], r["value"], r["n"]) for r in found.where("value is not null").groupBy("column", "value").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect())
    assert held == [("d", "2024-05-06", 10), ("m.k", "v", 10), ("s", "NULL", 1), ("s", "a", 3), ("s", "x" * 70, 1), ("s", "y", 1)]
    scanned = {r["column"]: r["matched"] for r in detect.evidence(detect.judged(found, {})).where("label is null").collect()}
    assert scanned == {"d": 10, "m.k": 10, "s": 6}


def test_cells_with_the_same_evidence_are_resolved_once(spark):
    from quillsift.operators import detect

    values = [("t", c, v) for i in range(300) for c, v in (("mobile", f"9{i:09d}"), ("x", f"call 9{i:09d}, or user{i % 10}@mail.example.com"), ("x", f'{{"cvv":"{i:03d}","z":"none"}}'), ("x", f"word {i}"), ("y", f"word {i}"))]
    rows = spark.createDataFrame(values, "table string, column string, value string").coalesce(1)
    once = detect.judged(detect.counted(rows), {"mobile": "Phone"})
    assert once.count() < 100
    total = lambda judged: {(r["column"], r["label"]): (r["matched"], round(r["weight"], 6), r["in_context"]) for r in detect.evidence(judged).collect()}
    got = total(once)
    assert got == total(detect.judged(rows, {"mobile": "Phone"}))
    assert got["x", None][0] == 900 and got["mobile", "Phone"][0] == 300 and got["x", "CVV"][:1] == (300,)


def test_texts_without_a_sign_of_a_pair_have_none():
    from quillsift.functions import documents

    for text in ("ABCPE0001K", "[1, 2]", "a?b", "{}", '["a", "b"]', "word%20word", "x" * 40):
        assert documents.extract(text) == (text, [])
    assert documents.extract("bW9iaWxlPTk4NzY1NDMyMTAmYT1i")[1] == [("a", "b"), ("mobile", "9876543210")]
