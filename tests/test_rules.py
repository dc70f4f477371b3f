"""Rules, validators, cell resolution and documents: cases with stated results."""

import base64
import json
import random

import pytest

from plain_cells import CellScanner, PairScanner, occurrences, segments, winner

from quillsift.functions import dialect, documents, validators
from quillsift.functions.column_rules import COLUMN_RULES
from quillsift.functions.registry import LABELS, MERGED, confidence, domain, tier
from quillsift.functions.rulebook import Names
from quillsift.functions.value_rules import VALUE_RULES, for_region

CELLS = CellScanner()


def labels(value, *context):
    return {m[0] for m in CELLS.value_labels(value, frozenset(context))}


def test_sizes_of_the_registry():
    assert len(LABELS) == len(COLUMN_RULES) == 40 and sum(map(len, COLUMN_RULES.values())) == 104
    assert len(VALUE_RULES) == 36 and sum(map(len, VALUE_RULES.values())) == 66 and len(MERGED) == 27
    assert {x for x, rules in VALUE_RULES.items() if any(r.gated for r in rules)} == {"BankAccountNumber", "LoanAccountNumber", "InsurancePolicyNumber", "FASTagID", "BirthDate"}
    assert tier("Name") == "Tier3" and domain("Password") is None
    assert [confidence(w) for w in (0.39, 0.4, 0.69, 0.7)] == ["Low", "Medium", "Medium", "High"]


@pytest.mark.parametrize(
    "name, label, weight",
    [
        ("email", "Email", 1.0), ("user-email", "Email", 1.0), ("mail", "Email", 0.5), ("user_email_x", "Email", 0.3), ("l_quantity", "UAN", 0.3), ("user_id", "Username", 0.5), ("tan", "TAN", 1.0), ("cin", "CIN", 1.0),
        ("address", "Address", 1.0), ("pan card", "PANNumber", 1.0), ("aadhaar_card_number", "AdharcardNumber", 1.0), ("credit_card_no", "CreditCard", 1.0), ("ip_address", "IPAddress", 1.0), ("macaddr", "MacAddress", 1.0),
        ("date_of_birth", "BirthDate", 1.0), ("telephone number", "Phone", 1.0), ("cellphone", "Phone", 1.0), ("passport", "PassportNumber", 1.0), ("vehicle_registration_mark", "VehicleNumber", 1.0), ("cvv", "CVV", 1.0),
        ("driver's license", "DrivingLicenceNumber", 1.0), ("epic_no", "VoterID", 0.5), ("health id", "ABHANumber", 0.5), ("oauth_access_token", "OAuthToken", 1.0), ("token", "OAuthToken", 0.5), ("full name", "Name", 1.0),
    ],
)
def test_column_names(name, label, weight):
    assert CELLS.column_labels(name)[label] == weight


def test_underscores_are_word_characters():
    assert CELLS.column_labels("my_email_address_old")["Email"] == 0.3 and CELLS.context("description") is None


@pytest.mark.parametrize(
    "value, label",
    [
        ("bob@example.com", "Email"), ("abcde1234f", "PANNumber"), ("2345 6789 0107", "AdharcardNumber"), ("378282246310005", "CreditCard"), ("10.0.0.1:80", "IPAddress"), ("fe80::1", "IPAddress"), ("02:42:ac:11:00:01", "MacAddress"),
        ("MH02BA0001", "VehicleNumber"), ("HDFC0123456", "IFSC"), ("9876543210", "Phone"), ("bob@okaxis", "UPIID"), ("Male", "Gender"), ("A1234567", "PassportNumber"), ("12.5, 77.25", "Location"), ("ABC1234567", "VoterID"),
        ("12 main street", "Address"), ("INZ000000001", "SEBIRegistration"), ("MH/BAN/0012345/000/0001234", "EPFMemberID"), ("::ffff:1.2.3.4", "IPAddress"), ("gho_" + "a1" * 20, "OAuthToken"),
    ],
)
def test_values(value, label):
    assert label in labels(value)


@pytest.mark.parametrize("value, label", [("378282246310006", "CreditCard"), ("123456789012", "AdharcardNumber"), ("300.1.1.1", "IPAddress"), ("02:42:ac-11:00:01", "MacAddress"), ("27ABCDE1234F1Z9", "GSTIN"), ("plain words", "Email"), ("fe80::1::2", "IPAddress")])
def test_values_that_fail_their_check(value, label):
    assert label not in labels(value)


def test_quirks_of_value_rules():
    assert not labels("eyJ" + "a" * 12 + "." + "b" * 12 + ".ccc")  # upper-case rules never meet lower-cased text
    assert "AdharcardNumber" not in labels("(2345) 6789 0107") and "AdharcardNumber" not in labels("2345.6789.0107")  # separators that the check does not strip
    assert "CreditCard" not in labels("4111 1111 1111 1112 then 4111 1111 1111 1111")  # only the leftmost match is tried
    assert "IFSC" not in labels("x HDFC0123456")  # anchored
    assert VALUE_RULES["UPIID"][0].weight == 1.2


def test_gates_and_regions():
    assert "FASTagID" not in labels("341610000000004") and "FASTagID" in labels("341610000000004", "FASTagID")
    assert "BirthDate" not in labels("01/02/1990") and "BirthDate" in labels("01/02/1990", "BirthDate")
    assert "PANNumber" not in for_region(VALUE_RULES, "us") and "Email" in for_region(VALUE_RULES, "us") and for_region(VALUE_RULES, "India").keys() == VALUE_RULES.keys()


def test_dialects():
    assert dialect.python(r"^abc$").search("abc\n") is None and dialect.python(r"\ba\b").search("éa")
    assert dialect.java(r"[a$]\b$").startswith("(?d)[a$](?:") and dialect.java("x$").endswith(r"x\z")
    assert dialect.python(r"^not[\s-_]?x$").search("not-x") and not dialect.python(r"^a\sb$").search("a\x0bb")


def test_check_digits():
    assert validators.luhn("4111111111111111") and not validators.luhn("4111111111111112") and not validators.luhn("")
    assert validators.verhoeff("234567890107") and validators.verhoeff("123456789010") and not validators.verhoeff("123456789012")
    head = "27ABCDE1234F1Z"
    assert validators.gstin(head + validators.gstin_check(head)) and validators.gstin_check(head) != "9"
    assert validators.mac("0242.ac11.0001") and not validators.ip("1.2.3") and not validators.ip("::ffff:102:304")


@pytest.mark.parametrize(
    "text, want",
    [
        ('{"user":{"email":"a@b.co"},"n":[1,2.50,true,null]}', [("n", "1"), ("n", "2.50"), ("n", "true"), ("email", "a@b.co")]),
        ("a=1&b=2&a=3", [("a", "1"), ("a", "3"), ("b", "2")]),
        ("https://h/p?z=1&y=%20q#f", [("y", "q"), ("z", "1")]),
        ("<r><cvv>312</cvv><b x='1'>t</b></r>", [("cvv", "312"), ("b", "t")]),
        ("<r><cvv>312</r>", []),
        ("cvv%3D312", [("cvv", "312")]),
        ("02:42:ac:11:00:01", []),
        ("mac: 02:42:ac:11:00:01", [("mac", "02:42:ac:11:00:01")]),
        (base64.b64encode(b'{"cvv":"312"}').decode(), [("cvv", "312")]),
        ("hello there my friend", []),
        ('{"a":"x", broken "b": 7', [("a", "x"), ("b", "7")]),
        ("Contact: bob@x.com or 9876543210", [("Contact", "bob@x.com")]),
        ('["a@b.co","c"]', []),
        ('{"a":1} {"b":2}', [("a", "1"), ("b", "2")]),
        ("a=1;b=2", []),
        ("aa=%zz&bb=22", [("aa", "%zz&bb=22")]),
        ("aa=11;bb=22", [("aa", "11"), ("bb", "22")]),
        ('{"a":NaN}', [("a", "NaN")]),
        ("", []),
    ],
)
def test_documents(text, want):
    assert documents.extract(text)[1] == want


def test_base64_is_unwrapped_only_when_structured():
    assert documents.unwrap_base64("aGVsbG8gd29ybGQ=") is None and documents.unwrap_base64("[not]") is None
    wrapped = base64.b64encode(json.dumps({"k": "v" * 900}).encode()).decode()
    assert documents.unwrap_base64("\n".join(wrapped[i : i + 76] for i in range(0, len(wrapped), 76))).startswith('{"k"')
    assert documents.unwrap_base64(base64.urlsafe_b64encode(b"<a>\xc3\xbf\xc3\xbf?</a>").decode().rstrip("=")) == "<a>ÿÿ?</a>"


def test_segments():
    assert segments("") == [] and segments("a  b") == ["a  b"]
    long = "word " * 200
    assert all(len(s) <= 512 for s in segments(long)) and " ".join(segments(long)).split() == long.split()
    assert segments("x" * 600 + " y") == ["x" * 600, "y"] and segments("é" * 256) == ["é" * 256]
    assert documents.human_list(["a", "b", "c"]) == "a, b and c" and documents.human_list(["a"]) == "a"


def test_winners():
    assert winner([("B", 0.9, 0, 1, False), ("A", 0.9, 0, 1, False)])[0][0] == "A"
    assert winner([("B", 0.9, 0, 1, False), ("C", 0.3, 0, 1, True)])[0][0] == "C"
    groups = occurrences([("A", 0.5, 0, 5, False), ("B", 0.6, 4, 9, False), ("C", 0.4, 8, 12, False), ("D", 0.1, 12, 14, False), ("E", 1.0, -1, -1, False)])
    assert [g[0] for g in groups] == ["E", "B", "D"]


def scan(column, value):
    return {label: w for (_, label), w in CELLS.scan(column, value).items()}


def test_cells():
    assert scan("fastag id", "341610000000004") == {"FASTagID": (1.0, True)}
    assert scan("aadhaar", "234567890107") == {"AdharcardNumber": (1.0, True)}
    assert scan("col_01", "234567890107") == {"AdharcardNumber": (0.8, False)}
    assert scan("col_01", "write bob@example.com or 9876543210 now") == {"Email": (1.0, False), "Phone": (0.69, False)}
    assert scan("notes", '{"cvv":"312"}') == {"CVV": (1.0, True)} and scan("notes", '{"x":"' + "p" * 600 + '","cvv":"312"}') == {"CVV": (1.0, True)}
    twice = "bob@example.com " + "word " * 150 + "bob@example.com"
    assert scan("notes", twice) == {"Email": (1.0, False)}
    assert scan("email", '{"cvv":"312"}') == {}  # a recognised column is not unpacked


def test_entities_need_their_context():
    cells = CellScanner(ner=lambda text: [("Bob", "PERSON"), ("Pune", "GPE")])
    assert ("spacy", "Name") in cells.scan("full name", "Bob of Pune") and not any(d == "spacy" for d, _ in cells.scan("col_1", "Bob of Pune"))
    assert CellScanner(ner=lambda text: [], regex=False).scan("email", "bob@example.com") == {}


@pytest.mark.parametrize("column, value, want", [("email_address", "alice@example.com", "Email"), ("pan_number", "ABCDE1234F", "PANNumber"), ("email_address", "not-an-email", "Email"), ("description", "alice@example.com", None), ("email_address", "", None), ("email_address", "?", None)])
def test_pairs(column, value, want):
    assert PairScanner().detect(column, value) == want


def judged(spark, cells, contexts, **more):
    """(table, column, value) rows judged by the scan's expressions, as the plain version reports them."""
    from pyspark.sql import functions as F

    from quillsift.operators import detect

    df = spark.createDataFrame([("t", f"{i}", v) for i, (_, v) in enumerate(cells)], "table string, column string, value string")
    known = {f"{i}": contexts(c) for i, (c, _) in enumerate(cells)}
    out = {int(r["column"]): {(m["detector"], m["label"]): (m["weight"], m["in_context"]) for m in r["found"]} for r in detect.judged(df, known, **more).collect()}
    return [out[i] for i in range(len(cells))]


def sample_values():
    rng = random.Random(11)
    out = ["341610000000004", "234567890107", "write bob@example.com or 9876543210 now", '{"cvv":"312"}', "<r><gender>female</gender><city>Mumbai</city></r>", "cvv=312&note=x", "mobile%3D9876543210", "male", "M",
           "the adapter is aa-bb-cc-dd-ee-ff, ok", "bob@example.com " + "word " * 150 + "bob@example.com", "x." * 255 + "x male", "::ffff:1.2.3.4", "::ffff:102:304", "fe80::1", "10.0.0.300", "1.2.3.4:80", "a: b", "card: 4000000000000002, phone = 9876543210",
           "12 main street", "é😀 9876543210 9876543211", "[1,2", "{bad: 4111111111111111}", "x" * 700, " ", "\u2003", "27ABCDE1234F1Z5", "MH02BA0001 and ABCDE1234F", base64.b64encode(b'{"gender": "female"}').decode(), "+91 98765-43210"]
    from quillsift.plans.catalogue import SAMPLES

    out += [v for values in SAMPLES.values() for v in values]
    for _ in range(60):
        out.append(" ".join(rng.choice([*out[:30], "and", "of the", "key:", "name=", "12", "é"]) for _ in range(rng.randint(1, 60))))
    out.append(json.dumps({"name": "Ann", "dob": "01/02/1990", "nested": {"phone": "9876543210", "list": ["bob@x.co", 5, None, True]}}))
    return [v.strip() for v in out if v.strip()]


def test_scan_expressions_against_plain_python(spark):
    def ner(text):
        return [("Ann", "PERSON")] if "Ann" in text else []

    cells = [(c, v) for v in sample_values() for c in ("col_1", "email", "gender", "dob", "loan account", "full name", "fastag id")]
    for plain, more in ((CellScanner(), {}), (CellScanner("india"), {"region": "india"}), (CellScanner("", ner), {"ner": ner}), (CellScanner("", ner, regex=False), {"ner": ner, "regex": False})):
        from quillsift.functions.cell import recogniser
        from quillsift.functions.rulebook import rulebook

        own = [recogniser(more["ner"], isolation=None)] if "ner" in more else []
        got = judged(spark, cells, plain._context, book=rulebook(more.get("region", ""), own), regex=more.get("regex", True))
        for (column, value), found in zip(cells, got):
            assert found == plain.scan(column, value), (column, value)


def test_documents_that_are_not_sent_hold_no_field(spark):
    from pyspark.sql import functions as F

    values = sample_values()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    for r in df.select("i", documents.may_hold_fields(F.col("v")).alias("sent")).collect():
        assert r["sent"] or documents.extract(values[r["i"]]) == (values[r["i"]], [])


def test_segments_as_expressions(spark):
    from pyspark.sql import functions as F

    values = sample_values() + ["word " * 200, "x" * 600 + " y", "é" * 256, "a  b", "", "\u2003" * 300, "w\x1cv\u2028" * 200]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", documents.segments(F.col("v")).alias("s")).collect()
    assert all(list(r["s"]) == segments(values[r["i"]]) for r in got)


def test_native_pairs(spark):
    from quillsift.operators import detect

    cells = [(c, v) for v in [*sample_values()[:60], "", "?", None] for c in ("email", "pan number", "dob", "description", "loan account", "user email")]
    df = spark.createDataFrame(cells, "c string, v string").withColumn("label", detect.pair_labels("c", "v"))
    plain = PairScanner()
    assert all(r["label"] == (plain.detect(r["c"], r["v"]) if r["v"] is not None else None) for r in df.collect())


#: Names, and the labels that they stand for with their weights.
NAMES = {
    "driving_lics": {}, "driver_lics": {"DrivingLicenceNumber": 1.0}, "driving licence": {"DrivingLicenceNumber": 1.0}, "dl": {"DrivingLicenceNumber": 0.5}, "dl_no": {"DrivingLicenceNumber": 1.0},
    "loginid": {"Username": 1.0}, "user": {"Username": 0.5}, "users": {}, "user_id": {"Username": 0.5}, "firstname": {"Name": 1.0}, "person": {"Name": 0.5},
    "tax_id": {"PANNumber": 0.5}, "payer_pan_number": {"PANNumber": 0.3}, "mail": {"Email": 0.5}, "mymailbox": {"Email": 0.3}, "emailaddress": {"Email": 1.0}, "cellphone": {"Phone": 1.0}, "hotel": {"Phone": 0.3},
    "ip": {"IPAddress": 0.5}, "zip": {}, "tan": {"TAN": 1.0}, "cin": {"CIN": 1.0}, "mac": {"MacAddress": 0.5}, "cvv": {"CVV": 1.0}, "long": {"Location": 0.5}, "dob": {"BirthDate": 1.0}, "unisex": {"Gender": 0.3},
}


@pytest.mark.parametrize("name", NAMES)
def test_names_stand_for(name):
    assert Names().labels(name) == NAMES[name]


#: Fixed cases: what a name or a value must or must not stand for, with the labels of its context and the region.
CASES = [
    ("name", "email_address", "", "", "Email", True), ("name", "pan_number", "", "", "PANNumber", True), ("name", "aadhaar_number", "", "", "AdharcardNumber", True), ("name", "epf", "", "", "EPFMemberID", True),
    ("name", "vehicle", "", "", "VehicleNumber", True), ("name", "driving_lics", "", "", "DrivingLicenceNumber", False), ("value", "alice@example.com", "", "", "Email", True), ("value", "ABCDE1234F", "", "", "PANNumber", True),
    ("value", "378282246310005", "", "", "CreditCard", True), ("value", "378282246310006", "", "", "CreditCard", False), ("value", "123456789012", "", "", "AdharcardNumber", False),
    ("value", "9876543210123", "BankAccountNumber", "", "BankAccountNumber", True), ("value", "9876543210123", "", "", "BankAccountNumber", False), ("value", "ABCDE1234F", "", "india", "PANNumber", True),
    ("value", "ABCDE1234F", "", "us", "PANNumber", False), ("value", "192.168.1.10", "", "", "IPAddress", True), ("value", "00:1A:2B:3C:4D:5E", "", "", "MacAddress", True), ("value", "ordinary product description", "", "", "", True),
]


def test_cases_through_the_scan(spark):
    """The cases by the expressions that scans use, by the plain version, and names as a scan looks them up."""
    from pyspark.sql import functions as F

    from quillsift.operators import detect

    found = {}
    for region in {c[3] for c in CASES}:
        some = [(text, context) for kind, text, context, at, *_ in CASES if kind == "value" and at == region]
        rows = spark.createDataFrame(some, "text string, context string")
        names = F.when(F.col("context") == "", F.array().cast("array<string>")).otherwise(F.array("context"))
        judged = rows.select("text", "context", detect.matches(detect.prepared(F.col("text")), names, for_region(VALUE_RULES, region)).alias("m"))
        found |= {(r["text"], r["context"], region): {m["label"] for m in r["m"]} for r in judged.collect()}
    for kind, text, context, region, label, there in CASES:
        got = {x for _, _, x, _ in detect.by_name([("t", text)])} if kind == "name" else found[text, context, region]
        assert kind == "name" or region or got == labels(text, *filter(None, [context]))
        assert (not got) if not label else (label in got) == there, (text, label, got)
