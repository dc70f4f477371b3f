"""Detectors of one's own, worker processes, and scans without jobs or with hanging parts. Functions here are closures, so they travel by value."""

import os
import subprocess
import sys
import textwrap
import time

import pytest
from pyspark.sql import functions as F

from quillsift.functions.cell import Asked, recogniser
from quillsift.functions.rulebook import Detector, Isolation, Names, rulebook
from quillsift.functions.value_rules import VALUE_RULES, Rule
from quillsift.functions.workers import LOST, Failed, Workers
from quillsift.operators import detect
from quillsift.plans.scan import ScanConfig, scan, scan_targets, with_timeout


def badge():
    return Detector("badges", {"StaffBadge": [Rule(r"\bbadge\b", 1.0)]}, {"StaffBadge": [Rule(r"^bdg-[0-9]{5}$", 0.9)]}, {"StaffBadge": ("Tier1", "Employment")})


def teams():
    def on_name(name):
        return [("Team", 0.8)] if "crew" in name.lower() else []

    def on_value(text, context):
        at = text.find("TEAM-")
        return [("Team", 0.9, at, at + 8)] if at >= 0 else [("Team", 0.75)] if "Team" in context else []

    return Detector("teams", labels={"Team": ("Tier1", "Employment")}, on_name=on_name, on_value=on_value)


def found(df):
    return {(r["column"], r["label"], r["detector_type"][:5], r["detector"]) for r in df.collect()}


def test_rules_and_functions_of_ones_own(spark):
    df = spark.createDataFrame([("BDG-12345", "x", "join TEAM-007 now", "reds", {"badge": "BDG-11111", "crew a": "blues"}, '{"badge": "BDG-54321", "crew": "greens"}')], "code string, badge string, note string, crew_name string, m map<string,string>, doc string")
    got = found(scan(spark, {"t": df}, ScanConfig("deepscan", detectors=(badge(), teams()))))
    assert {("code", "StaffBadge", "value", "regex"), ("badge", "StaffBadge", "colum", "regex"), ("note", "Team", "value", "teams"), ("crew_name", "Team", "value", "teams"), ("crew_name", "Team", "colum", "regex")} <= got
    assert {("doc", "StaffBadge", "value", "regex"), ("doc", "Team", "value", "teams"), ("m.badge", "StaffBadge", "value", "regex"), ("m.crew a", "Team", "value", "teams")} <= got
    assert not {r for r in found(scan(spark, {"t": df})) if r[1] in ("StaffBadge", "Team")}  # nothing stays behind
    pairs = spark.createDataFrame([("badge no", "BDG-12345"), ("badge no", "zz"), ("x", "BDG-12345")], "c string, v string").select(detect.pair_labels("c", "v", rulebook("", [badge()])).alias("label"))
    assert [r["label"] for r in pairs.collect()] == ["StaffBadge", "StaffBadge", None]


def test_rulebooks_are_values():
    book = rulebook("us", [badge(), Detector("more", values={"Email": [Rule("mailto", 0.5)]})])
    assert "PANNumber" not in book.values and book.values["Email"][-1].pattern == "mailto" and VALUE_RULES["Email"][-1].pattern != "mailto"
    assert book.labels["StaffBadge"] == ("Tier1", "Employment") and Names(book).context("badge") == "StaffBadge" and Names().context("badge") is None
    for bad in (lambda: Detector("regex"), lambda: Detector(""), lambda: Detector("x", on_value=len, make=len), lambda: rulebook("", [Detector("a"), Detector("a")])):
        with pytest.raises(ValueError):
            bad()


def test_own_rules_of_known_labels_are_not_filtered(spark):
    df = spark.createDataFrame([("write mailto ann",)] * 5, "c1 string")
    own = Detector("mail", values={"Email": [Rule("mailto", 1.0)]})
    assert ("c1", "Email", "value", "regex") in found(scan(spark, {"t": df}, ScanConfig("deepscan", detectors=(own,))))


def test_hung_and_crashing_calls_lose_only_themselves():
    def make():
        def run(x):
            if x == "hang":
                time.sleep(60)
            if x == "crash":
                os._exit(3)
            if x == "raise":
                raise ValueError("no")
            print("noise")
            return x * 2

        return run

    with Workers(make, size=2, seconds=0.7) as pool:
        assert pool.workers == []
        began = time.time()
        out = pool.map([("a",), ("hang",), ("crash",), ("raise",), ("hang",), *[(str(i),) for i in range(30)], ("z" * 300_000,)])
        assert time.time() - began < 15
        assert out[0] == "aa" and out[1] is out[2] is out[4] is LOST and isinstance(out[3], Failed) and out[5:-1] == [str(i) * 2 for i in range(30)] and len(out[-1]) == 600_000
        assert pool.map([("b",)]) == ["bb"] and pool.map([]) == []
        pids = [w.process.pid for w in pool.workers]
    assert pids and not any(os.path.exists(f"/proc/{p}") for p in pids)


def test_workers_that_do_not_start_fail():
    def make():
        raise RuntimeError("no model")

    with Workers(make, size=1) as pool, pytest.raises(RuntimeError):
        pool.map([("a",)])

    def slow():
        time.sleep(30)

    with Workers(slow, size=1, start_seconds=0.5) as pool, pytest.raises(RuntimeError):
        pool.map([("a",)])


def test_recogniser_in_worker_processes(spark):
    def make():
        loaded = {"Ann": "PERSON", "Pune": "GPE"}

        def ner(text):
            assert "\n" not in text
            if "hang" in text:
                time.sleep(60)
            return [(w, loaded[w], text.index(w), text.index(w) + len(w)) for w in text.split() if w in loaded]

        return ner

    one = Asked(recogniser(make=make, isolation=Isolation(1, 1.0)))
    try:
        pieces = [{"raw": "Ann\nis here", "context": "Name"}, {"raw": "hang", "context": "Name"}, {"raw": "Ann", "context": None}]
        assert list(one([pieces, [{"raw": "in Pune", "context": "Address"}]])) == [[[("Name", 0.7, 0, 3)], [], []], [[("Address", 0.7, 3, 7)]]]
    finally:
        one.close()
    df = spark.createDataFrame([("Ann",), ("hang",), ("Bob",), ("Ann",)], "full_name string").repartition(2)
    for ner in (recogniser(make=make, isolation=Isolation(2, 1.0)), lambda text: [("Ann", "PERSON")] if text == "Ann" else []):
        r = scan(spark, {"t": df}, ScanConfig("deepscan", ner=ner)).where("detector = 'spacy'").collect()
        assert [(x["label"], x["matched_count"], x["scanned_count"]) for x in r] == [("Name", 2, 4)]


def test_detectors_on_executors(tmp_path):
    """The same on executors that share nothing with the driver but the library."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = tmp_path / "run.py"
    script.write_text(textwrap.dedent(f"""
        import sys
        sys.path[:0] = [{root!r}, {os.path.join(root, "tests")!r}]
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
                 .config("spark.checkpoint.dir", "file://{tmp_path}/shared").config("spark.executorEnv.PYTHONPATH", {root!r}).config("spark.executor.memory", "1g").getOrCreate())
        from quillsift.functions.cell import recogniser
        from quillsift.functions.rulebook import Isolation
        from quillsift.plans.scan import ScanConfig, scan
        from test_detectors import badge, teams
        def made():
            return lambda text: [("Ann", "PERSON")] if "Ann" in text else []
        df = spark.createDataFrame([('{{"badge": "BDG-54321", "crew": "greens"}}', {{"badge": "BDG-11111"}}, "Ann", "BDG-12345")] * 4, "doc string, m map<string,string>, name string, code string")
        got = scan(spark, {{"t": df}}, ScanConfig("deepscan", detectors=(badge(), teams()), ner=recogniser(make=made, isolation=Isolation(1)))).collect()
        print(sorted((r["column"], r["label"], r["detector"], r["matched_count"]) for r in got if r["detector_type"] == "value detector"))
    """))
    env = os.environ | {"SPARK_SCALA_VERSION": "2.13"}
    run = subprocess.run([sys.executable, str(script)], capture_output=True, text=True, timeout=300, env=env, cwd=tmp_path)
    assert run.returncode == 0, run.stderr[-3000:]
    assert run.stdout.strip().splitlines()[-1] == str([("code", "StaffBadge", "regex", 4), ("doc", "StaffBadge", "regex", 4), ("doc", "Team", "teams", 4), ("m.badge", "StaffBadge", "regex", 4), ("name", "Name", "spacy", 4)])


def jobs(spark, work):
    group = f"count-{time.time()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_a_scan_of_names_takes_no_job(spark):
    frames = {f"t{i}": spark.createDataFrame([("a@b.co", "x")], "email string, phone_no string") for i in range(5)}
    rows, n = jobs(spark, lambda: scan(spark, frames, ScanConfig("metascan")).collect())
    assert n == 0 and {(r["table"], r["column"], r["label"]) for r in rows} == {(f"t{i}", c, label) for i in range(5) for c, label in (("email", "Email"), ("phone_no", "Phone"))}
    deep = scan(spark, frames, ScanConfig("deepscan")).where("detector_type = 'column detector'").orderBy("table", "column").collect()
    assert sorted(rows) == sorted(deep) and scan(spark, frames, ScanConfig("metascan")).schema.simpleString() == scan(spark, frames).schema.simpleString()
    assert scan(spark, {"t": spark.createDataFrame([], "zzz string")}, ScanConfig("metascan")).collect() == []


def test_what_hangs_outside_spark_is_skipped(spark, monkeypatch):
    monkeypatch.setattr("quillsift.plans.scan.GRACE", 0.2)
    good = {"t": spark.createDataFrame([("a@b.co",)], "email string")}
    began, seen = time.time(), []

    def report(name, findings):
        seen.append((name, findings.count()))
        if name == "slow report":
            time.sleep(60)

    found, skipped = scan_targets(spark, {"hangs": lambda: time.sleep(60), "good": lambda: good, "slow report": lambda: good, "bad": lambda: 1 / 0}, timeout=12, report=report)
    assert time.time() - began < 45 and set(skipped) == {"hangs", "slow report", "bad"} and "stopped" in skipped["hangs"] and "not opened" in skipped["bad"]
    assert {r["target"] for r in found.collect()} == {"good"} and [s[0] for s in seen] == ["good", "slow report"]
    with pytest.raises(TimeoutError):
        with_timeout(spark, 0.5, lambda: spark.range(4).select(F.udf(lambda x: __import__("time").sleep(20) or x, "long")("id").alias("x")).agg(F.sum("x")).collect())


def test_samples_are_the_same_in_every_layout(spark):
    from quillsift.operators import cells

    df = spark.range(30_000).selectExpr("id", "concat('v', id % 20000) AS v", "if(id % 7 = 0, null, cast(id AS string)) AS w", "float(id) AS f")
    pick = lambda d, **k: sorted(r["id"] for r in cells.sample(d, **k).collect())
    one = pick(df.coalesce(1))
    assert one == pick(df.repartition(13)) and 2700 < len(one) < 3300 and cells.sample(df).columns == df.columns
    few = pick(df, rows=500)
    assert few == pick(df.repartition(5), rows=500) and len(few) == 500 and set(few) <= set(one)
    assert pick(df, fraction=1.0, rows=10**6) == list(range(30_000)) and pick(df, rows=0) == [] and pick(df, seed=1) != one
    same = spark.range(1000).selectExpr("'x' AS v")
    assert cells.sample(same, fraction=1.0, rows=10).count() == 10 and cells.sample(df.limit(0)).count() == 0
