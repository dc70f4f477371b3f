"""The document store against a stand-in with the part of a client's interface that the source uses."""

import datetime
import random

import pytest
from pyspark.sql import types as T

from quillsift.plans.scan import ScanConfig, scan
from quillsift.sources import documentstore as ds

STORE = '''
import datetime, random

DOCS = [{"_id": i if i % 2 else f"k{i:03d}", "who": {"email": f"u{i}@x.co", "age": i}, "tags": ["a", None, str(i)], "note": None if i % 3 else "call 9876543210", "mixed": i if i % 2 else "text", "at": datetime.datetime(2024, 1, 2)} for i in range(200)]

def order(x):
    return (isinstance(x, str), x)

class Cursor:
    def __init__(self, docs):
        self.docs, self.low, self.high, self.key = docs, None, None, None
    def hint(self, key):
        self.key = key
        return self
    def min(self, at):
        assert self.key == [("_id", 1)]
        self.low = at[0][1]
        return self
    def max(self, at):
        assert self.key == [("_id", 1)]
        self.high = at[0][1]
        return self
    def __iter__(self):
        ok = lambda d: (self.low is None or order(d["_id"]) >= order(self.low)) and (self.high is None or order(d["_id"]) < order(self.high))
        return iter(sorted(filter(ok, self.docs), key=lambda d: order(d["_id"])))

class Collection:
    def __init__(self, docs):
        self.docs = docs
    def find(self):
        return Cursor(self.docs)
    def estimated_document_count(self):
        return len(self.docs)
    def aggregate(self, steps):
        out = random.Random(3).sample(self.docs, min(len(self.docs), steps[0]["$sample"]["size"]))
        return iter(sorted(out, key=lambda d: order(d["_id"])) if len(steps) > 1 else out)

class Database(dict):
    def list_collection_names(self):
        return list(self)

def connect():
    return {"shop": Database({"users": Collection(DOCS), "none": Collection([]), "system.views": Collection(DOCS)})}
'''


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    import sys

    folder = tmp_path_factory.mktemp("store")
    (folder / "doc_client.py").write_text(STORE)
    spark.sparkContext.addPyFile(str(folder / "doc_client.py"))
    sys.path.insert(0, str(folder))
    yield ds.Documents(spark, "doc_client.connect", "shop", 40)
    sys.path.remove(str(folder))


def test_types_of_documents():
    when = datetime.datetime(2024, 1, 2)
    docs = [{"a": 1, "b": {"c": "x"}, "e": None, "f": {}}, {"a": 2.5, "b": {"c": None, "d": True}, "g": [1, {"h": 2}], "t": when}, {"a": None, "b": {"d": 5}}]
    kind = ds.schema_of(docs)
    assert kind.simpleString() == "struct<a:double,b:struct<c:string,d:string>,e:string,f:string,g:array<string>,t:timestamp>"
    assert [ds.fitted(docs[1].get(f.name), f.dataType) for f in kind] == [2.5, (None, "True"), None, None, ["1", '{"h": 2}'], when]
    assert ds.fitted("x", T.LongType()) is None and ds.fitted(True, T.LongType()) is None and ds.fitted(True, T.BooleanType()) is True and ds.fitted(3, T.ArrayType(T.StringType())) == ["3"]
    assert ds.schema_of([]).fields == []


def test_every_document_in_one_range(spark, store):
    whole = store.whole("users")
    assert store.tables() == ["none", "users"] and store.rows("users") == 200 and whole.rdd.getNumPartitions() == 5
    assert whole.count() == whole.select("_id").distinct().count() == 200 and max(map(len, whole.rdd.glom().collect())) < 120
    assert whole.where("note is not null").count() == 67 and whole.select("who.age").distinct().count() == 200
    assert store.sample("users").count() == 200 and store.sample("users").rdd.getNumPartitions() == 1


def test_scan_of_documents(spark, store):
    one = {(r["table"], r["column"], r["label"], r["detector_type"], r["matched_count"]) for r in scan(spark, store, ScanConfig("deepscan")).collect()}
    assert ("users", "who.email", "Email", "value detector", 200) in one and ("users", "note", "Phone", "value detector", 67) in one
    assert one == {(r["table"], r["column"], r["label"], r["detector_type"], r["matched_count"]) for r in scan(spark, {"users": store.whole("users")}, ScanConfig("deepscan")).collect()}
    assert {(r["column"], r["label"]) for r in scan(spark, store, ScanConfig("metascan")).collect()} == {("who.email", "Email")}
