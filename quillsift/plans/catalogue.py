"""The named queries over the driver's tables, with their SQL counterparts.

Test tables hold no Indian identifiers, so many queries run on a view derived from customer keys; its
expressions are plain SQL that both engines evaluate alike. The SQL of a query states the semantics in
DuckDB's own operators, with rules in their RE2 form.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.functions import documents as docs
from quillsift.functions import sql, validators
from quillsift.functions.column_rules import COLUMN_RULES
from quillsift.functions.registry import LABELS, MERGED
from quillsift.functions.value_rules import VALUE_RULES, for_region
from quillsift.operators import cells, detect, resolve, score
from quillsift.plans import report
from quillsift.plans.scan import ScanConfig, scan, spread

Query = Callable[[SparkSession, str], DataFrame]

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations", "embeddings")
_SCANNED = {
    "region": ["r_name"], "nation": ["n_name"], "customer": ["c_name", "c_mktsegment"], "supplier": ["s_name"], "part": ["p_name", "p_brand", "p_type"],
    "orders": ["o_orderstatus", "o_orderdate", "o_orderpriority"], "lineitem": ["l_returnflag", "l_linestatus", "l_shipdate"], "events": ["ts", "event_type", "props"],
    "documents": ["text", "lang", "source"], "pages": ["url", "html"], "benchmark": ["text"], "conversations": ["role", "text"],
}
_DATES = {"o_orderdate", "l_shipdate", "ts"}

_K = "CAST(c_custkey AS STRING)"
_DIGIT = [f"CAST(floor(c_custkey / {10**i}) AS BIGINT) % 10" for i in range(3)]
_DOUBLED = [f"(({d}) * 2) % 10 + CAST(floor((({d}) * 2) / 10) AS BIGINT)" for d in _DIGIT]
_CARD_CHECK = f"((10 - (8 + {_DOUBLED[2]} + {_DIGIT[1]} + {_DOUBLED[0]}) % 10) % 10 + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END) % 10"
_GSTIN = [h + validators.gstin_check(h) for h in ("27ABCDE1234F1Z", "29PQRSX5678G2Z")]
_PAN = "concat('ABCPE', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'), 'K')"
_MOBILE = f"concat('9', lpad({_K}, 9, '0'))"

#: Column -> SQL over customer, the same text for both engines.
DERIVED = {
    "mobile_no": _MOBILE,
    "email": f"concat('user', {_K}, '@mail.example.com')",
    "pan_number": _PAN,
    "aadhaar": "CASE c_custkey % 3 WHEN 0 THEN '234567890107' WHEN 1 THEN '123456789010' ELSE '123456789012' END",
    "card_number": f"concat('400000000000', CAST({_DIGIT[2]} AS STRING), CAST({_DIGIT[1]} AS STRING), CAST({_DIGIT[0]} AS STRING), CAST({_CARD_CHECK} AS STRING))",
    "gstin": f"CASE c_custkey % 3 WHEN 0 THEN '{_GSTIN[0]}' WHEN 1 THEN '{_GSTIN[1]}' ELSE '27ABCDE1234F1ZX' END",
    "ifsc": "concat('HDFC0', lpad(CAST(c_custkey % 1000000 AS STRING), 6, '0'))",
    "vehicle": "concat('MH02BA', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'))",
    "upi": f"concat('name', {_K}, '@okaxis')",
    "ip_addr": "concat('10.', CAST(c_custkey % 300 AS STRING), '.0.7')",
    "device_mac": "concat('02:42:ac:11:00:', lpad(CAST(c_custkey % 100 AS STRING), 2, '0'))",
    "payload_json": f"concat('{{\"cvv\":\"', lpad(CAST(c_custkey % 1000 AS STRING), 3, '0'), '\",\"mobile\":\"', {_MOBILE}, '\"}}')",
    "payload_query": f"concat('mobile=', {_MOBILE}, '&note=x', CAST(c_custkey % 10 AS STRING))",
    "payload_xml": "concat('<r><cvv>', lpad(CAST(c_custkey % 1000 AS STRING), 3, '0'), '</cvv><z>', CAST(c_custkey % 10 AS STRING), '</z></r>')",
    "payload_encoded": f"concat('mobile%3D', {_MOBILE})",
    "notes": f"concat('write to user', {_K}, '@mail.example.com or call ', {_MOBILE}, ' today, thanks')",
    "kv_text": f"concat('card: ', CAST(c_custkey % 1000 AS STRING), ', phone = ', {_MOBILE})",
    **{f"col_0{i + 1}": f"CASE WHEN c_custkey % 100 < {n} THEN {_PAN} ELSE 'none' END" for i, n in enumerate((5, 10, 29, 30, 31))},
    "created_at": "'9876543210'",
}
DERIVED_SQL = "SELECT c_custkey, " + ", ".join(f"{e} AS {n}" for n, e in DERIVED.items()) + " FROM customer"
_VALUES = [n for n in DERIVED if n != "created_at"]
#: Values for every rule of every label, in the rules' order, and behind them near misses.
SAMPLES = {
    "Email": ("Ann.Lee+x@mail.example.org", "ann%40example.org", "!x#y@example.org", "ann@example", "@example.org"),
    "PANNumber": ("abcpe1234k", "ABCDE1234F", "XYZWQ1234K", "ABCPE12345", "ABCP1234K"),
    "AdharcardNumber": ("234567890107", "2345-6789-0107", "(2345) 6789 0107", "2345.6789.0107", "23456789010", "2345-67890-107"),
    "BankAccountNumber": ("123456789", "1234 5678 9012 345", "12345678", "1234567890123456789"),
    "DematAccountNumber": ("IN12345678901234", "1234567890123456", "1612345678901234", "IN1234567890123", "1412345678901234"),
    "ChequeNumber": ("123456", "12345", "1234567"),
    "CIFNumber": ("CIF123456", "cif123456789012", "12345678", "cif12345", "1234567"),
    "LoanAccountNumber": ("LN-2024/00012345", "HL1234567890", "LN-1", "a b c"),
    "InsurancePolicyNumber": ("POL-12345678", "LIC_00123", "PO-1", "a b c"),
    "FASTagID": ("34161FA820328EE8", "ABCDEFGHIJ", "ABCDEFGHI", "A-B-C-D-E-F-G-H"),
    "UPIID": ("ann@okaxis", "a.b-c@YBL", "ann@nobank", "a@ybl"),
    "CVV": ("123", "1234", "12", "12345"),
    "TAN": ("DELA12345B", "dela12345b", "DELA1234B", "DEL123456B"),
    "CIN": ("L12345MH2001PLC123456", "u65999ka1999ptc000001", "X12345MH2001PLC123456", "L12345ZZ2001PLC123456"),
    "DrivingLicenceNumber": ("MH12 2011 1234567", "ka-05-1999-7654321", "see DL 12 20111234567 there", "MH12 1811 1234567", "ZZ12 20111234567"),
    "Gender": ("Female", "prefer not to say", "non-binary", "M", "females", "mf"),
    "Phone": ("9876543210", "09876543210", "919876543210", "+91 98765 43210", "5876543210", "+91 58765 43210"),
    "CreditCard": ("4111 1111 1111 1111", "5500000000000004", "3782 822463 10005", "378282246310005", "7111111111111111", "3682 822463 10005"),
    "VoterID": ("ABC1234567", "abc1234567", "AB1234567", "ABC123456"),
    "IFSC": ("HDFC0001234", "sbin0abc123", "HDFC1001234", "see HDFC0001234"),
    "MICRCode": ("400240015", "40024001", "4002400155"),
    "PassportNumber": ("A1234567", "AB123456", "A123456", "ABC12345"),
    "ABHANumber": ("12-3456-7890-1234", "12 3456 7890 1234", "12345678901234", "12-3456-7890-123", "123456789012345"),
    "UAN": ("101234567890", "001234567890", "10123456789"),
    "EPFMemberID": ("MH/BAN/0001234/000/0012345", "MHBAN00012340000012345", "EPF 123456789012345", "MH/BAN/001234/000/0012345", "EPF 12345678901234"),
    "GSTIN": ("27ABCDE1234F1Z5", "29abcde1234f2d6", "27ABCDE1234F0Z5", "7ABCDE1234F1Z5"),
    "VehicleNumber": ("MH 02 BA 0001", "22 BH 1234 AA", "DL VA AB 1234", "123 CD 4567", "ZZ 02 BA 0001", "123 XX 4567"),
    "IPAddress": ("10.20.30.40", "at 1.2.3.4:8080!", "fe80::1ff:fe23:4567:890a", "2001:db8::", "256.1.1.1", "1.2.3"),
    "MacAddress": ("02:42:AC:11:00:02", "02-42-ac-11-00-02", "0242.ac11.0002", "02:42:AC:11:00", "02:42:AC:11:00:0G"),
    "OAuthToken": ("ya29." + "a1B2c3D4e5" * 6, "1//" + "a1B2c3D4e5" * 5, "gho_" + "a1B2c3D4e5" * 4, "xoxb-1234567890-1234567890-" + "a1b2c3d4" * 4, "eyJ" + "a1B2c3D4e5" * 2 + "." + "a1B2c3D4e5" * 2 + ".abc", "ya29.short", "ghx_" + "a1B2c3D4e5" * 4),
    "Address": ("12 long winding lane, oak street", "221 Baker street ", "7 days later", "Baker street"),
    "ESIC": ("12-34-567890-123-4567", "12345678901234567", "12-34-56789-123-4567", "1234567890123456"),
    "RationCard": ("MH1234567890", "ka-123456789012345", "MH123456789", "ZZ1234567890"),
    "SEBIRegistration": ("INZ000123456", "inh123456789", "INX000123456", "INZ00012345"),
    "BirthDate": ("31/12/1999", "2001-02-28", "32/12/1999", "1899-02-28"),
    "Location": ("12.9716, 77.5946", "-90.0, 180", "91.0, 77.5", "12.9716 77.5946"),
}
_SAMPLES_SQL = "SELECT * FROM (VALUES " + ", ".join("('samples." + label + "', '" + v.replace("'", "''") + "')" for label, values in SAMPLES.items() for v in values) + ") s(source, value)"
_LONG = "SELECT 'derived.' || source AS source, value FROM (UNPIVOT (SELECT {cols} FROM ({derived})) ON {cols} INTO NAME source VALUE value)".format(cols=", ".join(_VALUES), derived=DERIVED_SQL)
_CORPUS_SQL = f"WITH corpus AS ({_LONG} UNION ALL {_SAMPLES_SQL} UNION ALL SELECT 'documents.text', text FROM documents UNION ALL SELECT 'customer.c_name', c_name FROM customer UNION ALL SELECT 'lineitem.l_returnflag', l_returnflag FROM lineitem)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All tables; their footers are read at once, as each is a job of its own to Spark."""
    with ThreadPoolExecutor(len(TABLES)) as pool:
        return dict(zip(TABLES, pool.map(lambda t: table(spark, sf_dir, t), TABLES)))


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view's rows come from keys alone, which may lie in one small file however many there are; so they are dealt out first."""
    parts = max(32, 3 * spark.sparkContext.defaultParallelism)
    return table(spark, sf_dir, "customer").select("c_custkey").repartition(parts, "c_custkey").selectExpr("c_custkey", *[f"{e} AS {n}" for n, e in DERIVED.items()])


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, value, n): the derived view's cells, the samples and three raw columns, flags once with their number of cells."""
    one = derived(spark, sf_dir).select(F.explode(F.array(*[F.struct(F.lit(f"derived.{n}").alias("source"), F.col(n).alias("value")) for n in _VALUES])).alias("c")).select("c.*")
    one = one.unionByName(spark.createDataFrame([(f"samples.{label}", v) for label, values in SAMPLES.items() for v in values], "source string, value string"))
    one = one.withColumn("n", F.lit(1).cast("long"))
    for t, c in (("documents", "text"), ("customer", "c_name")):
        one = one.unionByName(spread(table(spark, sf_dir, t).select(c)).select(F.lit(f"{t}.{c}").alias("source"), F.col(c).alias("value"), F.lit(1).cast("long").alias("n")))
    flags = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"))
    return one.unionByName(flags.select(F.lit("lineitem.l_returnflag").alias("source"), F.col("l_returnflag").alias("value"), "n"))


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- cells ---


def _unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(DataFrame.union, [cells.cells(df, t) for t, df in tables(spark, sf_dir).items()])


def _cell_sql(t: str, c: str) -> str:
    e = f"strftime({c}, '%Y-%m-%d')" if c in _DATES else c
    clean = rf"regexp_replace(replace({e}, chr(13), ''), '^[\s\x0B\x85\xA0]+|[\s\x0B\x85\xA0]+$', '', 'g')"
    return f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", {clean} AS value FROM {t} WHERE {e} IS NOT NULL AND {e} NOT IN ('', 'NULL', '<nil>') AND {clean} <> ''"


def _cells_sql(names) -> str:
    return " UNION ALL ".join(_cell_sql(t, c) for t in names for c in _SCANNED[t])


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t, df in tables(spark, sf_dir).items():
        part = cells.cells(df, t).select("table", "column")
        out = part if out is None else out.union(part)
    return cells.counts(out)


def _sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.sample(table(spark, sf_dir, "documents")).select("doc_id")


#: The same draw in DuckDB's words: MD5 of the seed and the scanned cells with their lengths.
_SAMPLE_SQL = """SELECT doc_id FROM (
  SELECT doc_id, ('0x' || substr(md5('47|' || """ + " || ".join(f"coalesce(length({c})::VARCHAR, '') || ':' || coalesce({c}, '')" for c in _SCANNED["documents"]) + """), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u
  FROM documents) WHERE u < 0.1 ORDER BY u LIMIT 10000"""


# --- names ---


def _names(spark: SparkSession, sf_dir: str) -> list[tuple[str, str]]:
    named = [(t, c) for t, df in tables(spark, sf_dir).items() for c in cells.wanted(cells.flattened(df.schema))]
    return named + [("derived", c) for c in cells.wanted(DERIVED)] + [("phrases", c) for c in _PHRASES]


_PHRASES = (
    "user email", "User-Name", "email_id", "Aadhaar_Card_Number", "pan card", "credit-card-no", "ip address", "mac_addr", "date of birth", "dob", "tan", "cin", "address", "bank account number",
    "voter id", "passport-no", "gender", "fastag id", "vehicle registration mark", "uan number", "loan account", "policy no", "gst_number", "geo location", "login password", "oauth access token",
    "nationality code", "cheque leaf number", "demat account", "micr code", "ifsc_code", "esic number", "ration card id", "sebi reg no", "abha health id", "epf member id", "upi vpa", "cif number", "x_phone_y",
)


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.named(spark, _names(spark, sf_dir)).drop("tier", "domain")


_RAW_NAMES = (
    "region r_regionkey r_name|nation n_nationkey n_name n_regionkey|customer c_custkey c_name c_nationkey c_acctbal c_mktsegment|supplier s_suppkey s_name s_nationkey s_acctbal"
    "|part p_partkey p_name p_brand p_type p_size p_retailprice|orders o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority"
    "|lineitem l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate|events event_id ts user_id event_type value props"
    "|documents doc_id text lang source n_chars|pages page_id url html|benchmark item_id text|labels doc_id quality toxic|conversations conv_id turn role text|embeddings vec_id embedding label"
)


def _meta_sql() -> str:
    raw = [(t.split()[0], c) for t in _RAW_NAMES.split("|") for c in t.split()[1:]]
    names = raw + [("derived", c) for c in DERIVED if c != "created_at"] + [("phrases", c) for c in _PHRASES]
    rules = ", ".join(f"({_quote(label)}, {i}, {_quote(r.pattern)}, {r.weight})" for label, rules in COLUMN_RULES.items() for i, r in enumerate(rules))
    values = ", ".join(f"({_quote(t)}, {_quote(c)})" for t, c in names)
    return f"""WITH names(t, c) AS (VALUES {values}), rules(label, nth, pattern, weight) AS (VALUES {rules}),
hit AS (SELECT t, c, label, arg_min(weight, nth)::DOUBLE AS weight FROM names JOIN rules ON regexp_matches(lower(c), pattern) GROUP BY ALL)
SELECT t AS "table", c AS "column", label, weight, CASE WHEN weight < 0.4 THEN 'Low' WHEN weight < 0.7 THEN 'Medium' ELSE 'High' END AS confidence,
       row_number() OVER (PARTITION BY t, c ORDER BY weight DESC, label) = 1 AS is_context FROM hit"""


# --- values ---


def _detect(label: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        hit = corpus(spark, sf_dir).select("source", "n", detect.rule_number(label, F.col("value"), context=True).alias("rule"))
        return hit.where("rule is not null").groupBy("source", "rule").agg(F.sum("n").alias("hits"))

    return run


def _detect_sql(label: str) -> str:
    case = " ".join(f"WHEN regexp_matches(lower(value), {_quote(r.pattern)}) THEN {i}" for i, r in enumerate(VALUE_RULES[label]))
    return f"{_CORPUS_SQL} SELECT source, rule, count(*) AS hits FROM (SELECT source, CASE {case} END::INT AS rule FROM corpus) WHERE rule IS NOT NULL GROUP BY ALL"


def _validate(column: str, check: Callable) -> Query:
    return lambda spark, sf_dir: derived(spark, sf_dir).select("c_custkey", column, check(F.col(column)).alias("valid"))


_DIGITS = "list_reverse(list_transform(string_split({c}, ''), lambda x: x::INT))"
_VALIDATE_SQL = {
    "validate_luhn": f"SELECT c_custkey, card_number, list_sum(list_transform({_DIGITS.format(c='card_number')}, lambda d, i: CASE WHEN i % 2 = 0 THEN (d * 2) % 10 + (d * 2) // 10 ELSE d END)) % 10 = 0 AS valid FROM (__D)",
    "validate_verhoeff": f"SELECT c_custkey, aadhaar, list_reduce(list_prepend(0, list_transform({_DIGITS.format(c='aadhaar')}, lambda d, i: ({[x for r in validators.PERMUTED for x in r]})[((i - 1) % 8) * 10 + d + 1])), lambda c, x: ({[x for r in validators.PRODUCT for x in r]})[c * 10 + x + 1]) = 0 AS valid FROM (__D)",
    "validate_gstin": "SELECT c_custkey, gstin, substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST((36 - list_sum(list_transform(string_split(substr(gstin, 1, 14), ''), lambda x, i: (CASE WHEN i % 2 = 1 THEN 1 ELSE 2 END * (strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', x) - 1)) // 36 + (CASE WHEN i % 2 = 1 THEN 1 ELSE 2 END * (strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', x) - 1)) % 36)) % 36) % 36 + 1 AS INT), 1) = substr(gstin, 15, 1) AS valid FROM (__D)",
    "validate_ipv4": "SELECT c_custkey, ip_addr, len(string_split(ip_addr, '.')) = 4 AND list_bool_and(list_transform(string_split(ip_addr, '.'), lambda x: x::INT BETWEEN 0 AND 255)) AS valid FROM (__D)",
    "validate_mac": "SELECT c_custkey, device_mac, regexp_full_match(device_mac, '(?i)[0-9a-f]{2}(:[0-9a-f]{2}){5}|[0-9a-f]{2}(-[0-9a-f]{2}){5}|[0-9a-f]{4}(\\.[0-9a-f]{4}){2}') AS valid FROM (__D)",
}


def _ipv6(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_IPV6} AS address")
    return made.select("c_custkey", "address", validators.ipv6_expr(F.col("address")).alias("valid"))


_HEX4 = "lower(hex(c_custkey % 70000))"
_IPV6 = f"""CASE c_custkey % 8 WHEN 0 THEN concat('fe80::', {_HEX4}, '::1') WHEN 1 THEN concat('fe80::', {_HEX4}) WHEN 2 THEN concat('1:2:3:4:5:6:7:', {_HEX4}) WHEN 3 THEN concat('1:2:3:4:5:6:7:8:', {_HEX4})
  WHEN 4 THEN concat('::ffff:', {_HEX4}, ':7') WHEN 5 THEN concat({_HEX4}, '::') WHEN 6 THEN concat(':', {_HEX4}, '::1') ELSE concat('0:0:0:0:0:ffff:1:', {_HEX4}) END"""
_IPV6_FORMS = ["([0-9a-f]{1,4}:){7}[0-9a-f]{1,4}", *[f"([0-9a-f]{{1,4}}(:[0-9a-f]{{1,4}}){{{n - 1}}})?::([0-9a-f]{{1,4}}(:[0-9a-f]{{1,4}}){{0,{6 - n}}})?" if n else "::([0-9a-f]{1,4}(:[0-9a-f]{1,4}){0,6})?" for n in range(7)], "[0-9a-f]{1,4}(:[0-9a-f]{1,4}){6}::"]
_IPV6_SQL = f"SELECT c_custkey, address, regexp_full_match(address, '{'|'.join(_IPV6_FORMS)}') AND NOT regexp_full_match(address, '(::|(0+:){{5}})ffff:[0-9a-f]{{1,4}}:[0-9a-f]{{1,4}}') AS valid FROM (SELECT c_custkey, {_IPV6} AS address FROM customer)"


def _region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region, label, cells): in how many derived cells a region's rules for a label fire, without any context."""
    each = derived(spark, sf_dir).select(F.explode(F.array(*_VALUES)).alias("value")).select(detect.prepared(F.col("value")).alias("text"))
    fired = [F.struct(F.lit(region).alias("region"), detect.fired(F.col("text"), for_region(VALUE_RULES, region)).alias("labels")) for region in ("", "india", "us")]
    each = each.select(F.explode(F.array(*fired)).alias("r")).select("r.region", F.explode("r.labels").alias("label"))
    return each.groupBy("region", "label").agg(F.count("*").alias("cells"))


#: Checks of a match's text ``{m}`` in DuckDB's words. Addresses that the patterns admit are valid.
_CHECK_SQL = {
    "CreditCard": "list_sum(list_transform(list_reverse(string_split(translate({m}, ' -+', ''), '')), lambda d, i: CASE WHEN i % 2 = 0 THEN (d::INT * 2) % 10 + (d::INT * 2) // 10 ELSE d::INT END)) % 10 = 0",
    "AdharcardNumber": f"list_reduce(list_prepend(0, list_transform(list_reverse(string_split(translate({{m}}, ' -().', ''), '')), lambda d, i: ({[x for r in validators.PERMUTED for x in r]})[((i - 1) % 8) * 10 + d::INT + 1])), lambda c, x: ({[x for r in validators.PRODUCT for x in r]})[c * 10 + x + 1]) = 0",
    "GSTIN": "substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST((36 - list_sum(list_transform(string_split(substr(upper({m}), 1, 14), ''), lambda x, i: (CASE WHEN i % 2 = 1 THEN 1 ELSE 2 END * (strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', x) - 1)) // 36 + (CASE WHEN i % 2 = 1 THEN 1 ELSE 2 END * (strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', x) - 1)) % 36)) % 36) % 36 + 1 AS INT), 1) = substr(upper({m}), 15, 1)",
}


def _fires_sql(label: str, rules, low: str, result: Callable, context: str | None = None) -> str:
    """CASE over the rules of a label: ``result`` (rule, hit) of the first that matches ``low`` and stands its check, else NULL.
    ``context`` is a list of labels."""
    arms = []
    for rule in rules:
        hit = f"regexp_extract({low}, {_quote(rule.pattern)})"
        # CASE keeps the check from texts without a match
        ok = f"CASE WHEN {hit} = '' THEN regexp_matches({low}, {_quote(rule.pattern)}) ELSE {_CHECK_SQL[label].replace('{m}', hit)} END" if label in _CHECK_SQL else f"regexp_matches({low}, {_quote(rule.pattern)})"
        if rule.gated:
            ok = "false" if context is None else f"({ok}) AND list_contains({context}, {_quote(label)})"
        arms.append(f"WHEN {ok} THEN {result(rule, hit)}")
    return f"CASE {' '.join(arms)} END"


def _region_sql() -> str:
    cells_sql = f"SELECT lower(value) AS low FROM ({_LONG})"
    parts = [
        f"SELECT {_quote(region)} AS region, {_quote(label)} AS label, count(*) AS cells FROM cells WHERE {_fires_sql(label, rules, 'low', lambda rule, hit: '1')} = 1 HAVING count(*) > 0"
        for region in ("", "india", "us") for label, rules in for_region(VALUE_RULES, region).items()
    ]
    return f"WITH cells AS MATERIALIZED ({cells_sql}) {' UNION ALL '.join(parts)}"


#: Labels whose rules all need their context.
_GATED = [label for label, rules in VALUE_RULES.items() if all(r.gated for r in rules)]


def _gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, label, plain, in_context): cells of the derived view and of the samples where a gated label fires without and in its context."""
    fires = [F.struct(F.lit(x).alias("label"), *[detect.rule_number(x, F.col("value"), within).isNotNull().cast("long").alias(n) for n, within in (("plain", False), ("in_context", True))]) for x in _GATED]
    each = corpus(spark, sf_dir).where(F.col("source").startswith("derived.") | F.col("source").startswith("samples."))
    return each.select("source", F.explode(F.array(*fires)).alias("m"), "n").groupBy("source", "m.label").agg(F.sum(F.col("m.plain") * F.col("n")).alias("plain"), F.sum(F.col("m.in_context") * F.col("n")).alias("in_context"))


def _gate_sql() -> str:
    any_of = lambda label: " OR ".join(f"regexp_matches(lower(value), {_quote(r.pattern)})" for r in VALUE_RULES[label])
    parts = [f"SELECT source, {_quote(x)} AS label, 0::BIGINT AS plain, count(*) FILTER (WHERE {any_of(x)}) AS in_context FROM each GROUP BY source" for x in _GATED]
    return f"WITH each AS MATERIALIZED ({_LONG} UNION ALL {_SAMPLES_SQL}) {' UNION ALL '.join(parts)}"


# --- matches, for resolution ---

#: Columns of the derived view whose cells are judged as they stand, by all rules.
_TEXTS = ("notes", "kv_text", "payload_query", "email", "upi", "card_number", "aadhaar", "gstin", "vehicle", "ip_addr")


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, source, context, found): the scan's matches of all labels in some columns, a half of the cells with a context."""
    context = F.when(F.col("c_custkey") % 4 == 0, "Phone").when(F.col("c_custkey") % 4 == 1, "Email")
    each = derived(spark, sf_dir).select("c_custkey", context.alias("context"), F.explode(F.array(*[F.struct(F.lit(n).alias("source"), F.col(n).alias("value")) for n in _TEXTS])).alias("t"))
    text = each.select("c_custkey", "t.source", "context", detect.prepared(F.col("t.value")).alias("text"))
    return text.select("c_custkey", "source", "context", detect.matches(F.col("text"), F.array("context"), VALUE_RULES).alias("found"))


def _matches_sql() -> str:
    texts = " UNION ALL ".join(f"SELECT c_custkey, {_quote(c)} AS source, lower({c}) AS low FROM base" for c in _TEXTS)
    parts = [
        f"SELECT c_custkey, source, context, {_quote(label)} AS label, {_quote(LABELS[label][0])} AS tier, low, unnest({_fires_sql(label, rules, 'low', lambda rule, hit: f'[({rule.weight}, {hit})]', '[context]')}) AS m FROM texts"
        for label, rules in VALUE_RULES.items()
    ]
    return f"""WITH base AS ({DERIVED_SQL}),
texts AS MATERIALIZED (SELECT *, CASE c_custkey % 4 WHEN 0 THEN 'Phone' WHEN 1 THEN 'Email' END AS context FROM ({texts})),
raw AS ({' UNION ALL '.join(parts)}),
matches AS (SELECT c_custkey, source, label, tier, m[1]::DOUBLE AS weight, (strpos(low, m[2]) - 1)::INT AS "start", (strpos(low, m[2]) - 1 + length(m[2]))::INT AS "end", context FROM raw),
marked AS (SELECT *, label IS NOT DISTINCT FROM context AS in_context FROM matches),
boosted AS (SELECT * REPLACE (CASE WHEN in_context THEN 1.0 ELSE weight END::DOUBLE AS weight) FROM marked),
capped AS (SELECT * REPLACE (CASE WHEN context IS NULL AND tier <> 'Tier1' AND weight >= 0.7 THEN 0.69 ELSE weight END::DOUBLE AS weight) FROM boosted)"""


def _with_matches(f: Callable[..., object], *columns: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = f(F.col("found"), F.col("context"))
        each = _matches(spark, sf_dir).select("c_custkey", "source", F.posexplode(found).alias("nth", "m"))
        return each.select("c_custkey", "source", (F.col("nth") + 1).alias("occurrence"), "m.*").select("c_custkey", "source", *columns)

    return run


def _weighed(m, c):
    return resolve.capped(resolve.boosted(m, c), c)


_RESOLVE = {
    "context_boost": (_with_matches(resolve.boosted, "label", "weight", "in_context"), "SELECT c_custkey, source, label, weight, in_context FROM boosted"),
    "unknown_cap": (_with_matches(_weighed, "label", "weight"), "SELECT c_custkey, source, label, weight FROM capped"),
    "field_winner": (
        _with_matches(lambda m, c: resolve.field_winner(_weighed(m, c)), "label", "weight", "in_context"),
        "SELECT c_custkey, source, label, weight, in_context FROM capped QUALIFY row_number() OVER (PARTITION BY c_custkey, source ORDER BY in_context DESC, weight DESC, label) = 1",
    ),
    "occurrence_groups": (
        _with_matches(lambda m, c: resolve.occurrence_groups(_weighed(m, c)), "occurrence", "label", "weight", "start", "end"),
        """, reach AS (SELECT *, max("end") OVER (PARTITION BY c_custkey, source ORDER BY "start", "end" DESC, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM capped),
        grouped AS (SELECT *, sum((r IS NULL OR "start" >= r)::INT) OVER (PARTITION BY c_custkey, source ORDER BY "start", "end" DESC, label ROWS UNBOUNDED PRECEDING)::INT AS occurrence FROM reach)
        SELECT c_custkey, source, occurrence, label, weight, "start", "end" FROM grouped QUALIFY row_number() OVER (PARTITION BY c_custkey, source, occurrence ORDER BY weight DESC, label) = 1""",
    ),
    "row_merge": (
        _with_matches(lambda m, c: resolve.row_merge(F.concat(m, _weighed(m, c))), "label", "weight", "in_context"),
        "SELECT c_custkey, source, label, max(weight) AS weight, bool_or(in_context) AS in_context FROM (SELECT c_custkey, source, label, weight, false AS in_context FROM marked UNION ALL SELECT c_custkey, source, label, weight, in_context FROM capped) GROUP BY ALL",
    ),
}


# --- scoring ---


def _proof(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Evidence spun from part keys: per table and column some labels with weights at many densities."""
    k = F.col("p_partkey")
    label = F.element_at(F.array(*map(F.lit, _PROOF_LABELS)), (F.floor(k / 48) % len(_PROOF_LABELS) + 1).cast("int"))
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("t"), (k % 4).cast("string")).alias("table"), F.concat(F.lit("c"), (k % 12).cast("string")).alias("column"), label.alias("label"), ((k % 10 + 1) / 10).alias("w"), (k % 97 == 0).alias("ctx"))
    found = F.when(F.col("w") > 0.3, F.array(F.struct(F.lit("regex").alias("detector"), "label", F.col("w").alias("weight"), F.col("ctx").alias("in_context"))))
    judged = p.select("table", "column", F.lit(1).cast("long").alias("n"), F.coalesce(found, F.array().cast("array<struct<detector:string,label:string,weight:double,in_context:boolean>>")).alias("found"))
    values, scanned = detect.added(detect.evidence(judged))
    names = spark.createDataFrame([("t0", "c0", "PANNumber", 1.0), ("t1", "c1", "Email", 0.5), ("t1", "c1", "Phone", 1.0), ("t2", "c2", "UAN", 0.3)], "table string, column string, label string, weight double")
    return values, scanned, names


_PROOF_LABELS = ("PANNumber", "Email", "CIFNumber", "Phone", "UAN", "IPAddress", "Gender")
_PROOF_SQL = f"""WITH p AS (SELECT 't' || (p_partkey % 4) AS t, 'c' || (p_partkey % 12) AS c, ({list(_PROOF_LABELS)})[(p_partkey // 48) % {len(_PROOF_LABELS)} + 1] AS label,
  (p_partkey % 10 + 1) / 10.0::DOUBLE AS w, p_partkey % 97 = 0 AS ctx FROM part),
hits AS (SELECT t, c, label, sum(w) AS weight, count(*) AS matched, bool_or(ctx) AS in_context FROM p WHERE w > 0.3 GROUP BY ALL),
scanned AS (SELECT t, c, count(*) AS n FROM p GROUP BY ALL),
names(t, c, label, weight) AS (VALUES ('t0', 'c0', 'PANNumber', 1.0), ('t1', 'c1', 'Email', 0.5), ('t1', 'c1', 'Phone', 1.0), ('t2', 'c2', 'UAN', 0.3)),
"""
#: From hits(t, c, label, weight, matched, in_context), scanned(t, c, n) and names(t, c, label, weight) to findings.
_CHAIN_SQL = f"""tiers(label, tier, domain) AS (VALUES {', '.join(f"({_quote(x)}, {_quote(t)}, {'NULL' if d is None else _quote(d)})" for x, (t, d) in LABELS.items())}),
final AS (SELECT h.*, n, EXISTS (FROM names m WHERE m.t = h.t AND m.c = h.c) AS named,
  CASE WHEN h.label IN ({', '.join(_quote(x) for x in sorted(MERGED))}) AND m.weight >= 0.4 THEN (m.weight + h.weight / n) / 2 ELSE h.weight / n END::DOUBLE AS final
  FROM hits h JOIN scanned USING (t, c) LEFT JOIN names m ON m.t = h.t AND m.c = h.c AND m.label = h.label),
dense AS (SELECT * FROM (SELECT *, count(*) FILTER (WHERE matched / n >= 0.10) OVER (PARTITION BY t, c) AS sure FROM final)
  WHERE named OR in_context OR matched / n >= CASE WHEN sure >= 2 THEN 0.10 ELSE 0.30 END),
found AS (SELECT t, c, label, 'column detector' AS kind, weight::DOUBLE AS weight, false AS ctx, 0::BIGINT AS matched, 0::BIGINT AS n, true AS named FROM names
  UNION ALL SELECT t, c, label, 'value detector', final, in_context, matched, n, named FROM dense),
banded AS (SELECT f.*, tier, domain, CASE WHEN weight < 0.4 THEN 'Low' WHEN weight < 0.7 THEN 'Medium' ELSE 'High' END AS confidence FROM found f JOIN tiers USING (label)),
domains AS (SELECT t, arg_min(domain, (-k, domain)) AS main FROM (SELECT t, domain, count(*) AS k FROM banded WHERE confidence <> 'Low' AND (kind = 'column detector' OR tier = 'Tier1') GROUP BY ALL) GROUP BY t),
capped AS (SELECT * REPLACE (CASE WHEN NOT named AND NOT ctx AND tier <> 'Tier1' AND weight >= 0.7 THEN 0.69 ELSE weight END AS weight,
  CASE WHEN NOT named AND NOT ctx AND tier <> 'Tier1' AND weight >= 0.7 THEN 'Medium' ELSE confidence END AS confidence) FROM banded),
gated AS (SELECT capped.* FROM capped LEFT JOIN domains USING (t) WHERE named OR ctx OR tier <> 'Tier3' OR coalesce(domain = main, false)),
won AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t, c, kind ORDER BY weight DESC, ctx DESC, label) AS nth FROM gated) WHERE NOT named OR nth = 1)
"""


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


_OUT = 't AS "table", c AS "column", label'
_SCORE: dict[str, tuple[Query, str]] = {
    "hit_aggregate": (lambda s, d: _round(_proof(s, d)[0].drop("detector"), "weight"), f"SELECT {_OUT}, round(weight, 6) AS weight, matched, in_context FROM hits"),
    "final_weight": (lambda s, d: _round(score.weighed(*_proof(s, d)).select("table", "column", "label", "named", "final"), "final"), f"SELECT {_OUT}, named, round(final, 6) AS final FROM final"),
    "density_filter": (lambda s, d: score.dense(score.weighed(*_proof(s, d))).select("table", "column", "label", "matched", "scanned"), f"SELECT {_OUT}, matched, n AS scanned FROM dense"),
    "dominant_domain": (lambda s, d: score.dominant_domain(score.candidates(*_proof(s, d))), 'SELECT t AS "table", main AS table_domain FROM domains'),
    "tier_cap": (
        lambda s, d: _round(score.tier_capped(score.candidates(*_proof(s, d))).select("table", "column", "label", "detector_type", "weight", "confidence"), "weight"),
        f"SELECT {_OUT}, kind AS detector_type, round(weight, 6) AS weight, confidence FROM capped",
    ),
    "domain_gate": (
        lambda s, d: (lambda f: score.domain_gated(score.tier_capped(f), score.dominant_domain(f)).select("table", "column", "label", "detector_type", "tier", "domain"))(score.candidates(*_proof(s, d))),
        f"SELECT {_OUT}, kind AS detector_type, tier, domain FROM gated",
    ),
    "column_winner": (
        lambda s, d: _round(score.findings(*_proof(s, d)).drop("detector"), "weight"),
        f"SELECT {_OUT}, kind AS detector_type, round(weight, 6) AS weight, confidence, tier, domain, ctx AS context_matched, matched AS matched_count, n AS scanned_count FROM won",
    ),
    "report_summary": (
        lambda s, d: report.summary(score.findings(*_proof(s, d))),
        "SELECT t AS \"table\", confidence, kind AS detector_type, string_agg(c || ' as ' || label, ', ' ORDER BY c || ' as ' || label) AS items FROM won GROUP BY ALL",
    ),
    "report_counts": (
        lambda s, d: report.counters(score.findings(*_proof(s, d))),
        "SELECT count(DISTINCT t) AS tables, count(*) FILTER (WHERE kind = 'value detector') AS data, count(*) FILTER (WHERE kind <> 'value detector') AS meta, count(*) FILTER (WHERE kind = 'value detector' AND confidence = 'Low') AS low_data, count(*) FILTER (WHERE kind <> 'value detector' AND confidence = 'Low') AS low_meta FROM won",
    ),
    "report_filter_high": (lambda s, d: report.shown(score.findings(*_proof(s, d))).select("table", "column", "label", "detector_type"), f"SELECT {_OUT}, kind AS detector_type FROM won WHERE confidence = 'High'"),
}


# --- documents ---


def _pairs_of(df: DataFrame, key: str, value) -> DataFrame:
    asked = F.when(docs.may_hold_fields(value), value)
    return df.select(key, F.explode(docs.document()(asked)["pairs"]).alias("p")).select(key, "p.key", "p.value")


def _extract(t: str, key: str, column: str) -> Query:
    return lambda spark, sf_dir: _pairs_of(derived(spark, sf_dir) if t == "derived" else table(spark, sf_dir, t), key, F.col(column))


def _pairs_sql(*pairs: tuple[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT c_custkey, '{k}' AS key, {v} AS value FROM customer" for k, v in pairs)


def _fields_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function for SQL users over all pages' urls."""
    sql.register(spark)
    return spark.sql("SELECT p.page_id, f.key, f.value, f.context FROM {pages} p, LATERAL document_fields(p.url) f", pages=table(spark, sf_dir, "pages"))


#: A url's parameters; of one without a query, the scheme and the rest.
_URL_SQL = """SELECT page_id, key, value{context} FROM (
  SELECT page_id, split_part(p, '=', 1) AS key, substr(p, strpos(p, '=') + 1) AS value FROM (SELECT page_id, unnest(string_split(regexp_extract(url, '^[^#?]*[?]([^#]*)', 1), '&')) AS p FROM pages WHERE contains(url, '?'))
  UNION ALL SELECT page_id, split_part(url, ':', 1), rtrim(substr(url, strpos(url, ':') + 1), '()[]') FROM pages WHERE NOT contains(url, '?'))"""

_CVV = "lpad(CAST(c_custkey % 1000 AS STRING), 3, '0')"
_EXTRACT: dict[str, tuple[Query, str | None]] = {
    "extract_json": (_extract("events", "event_id", "props"), "SELECT event_id, k AS key, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)"),
    "extract_json_derived": (_extract("derived", "c_custkey", "payload_json"), _pairs_sql(("cvv", _CVV), ("mobile", _MOBILE))),
    "extract_xml": (_extract("derived", "c_custkey", "payload_xml"), _pairs_sql(("cvv", _CVV), ("z", "CAST(c_custkey % 10 AS STRING)"))),
    "extract_query": (_extract("derived", "c_custkey", "payload_query"), _pairs_sql(("mobile", _MOBILE), ("note", "'x' || (c_custkey % 10)"))),
    "extract_urlencoded": (_extract("derived", "c_custkey", "payload_encoded"), _pairs_sql(("mobile", _MOBILE))),
    "extract_text_kv": (
        lambda s, d: _pairs_of(derived(s, d), "c_custkey", F.replace("kv_text", F.lit(" ="), F.lit(":"))),
        f"SELECT * FROM ({_pairs_sql(('card', 'CAST(c_custkey % 1000 AS STRING)'), ('phone', _MOBILE))}) WHERE length(value) >= 2",
    ),
    "extract_base64": (lambda s, d: _pairs_of(derived(s, d), "c_custkey", F.base64(F.encode("payload_json", "utf-8"))), _pairs_sql(("cvv", _CVV), ("mobile", _MOBILE))),
    "extract_pages_url": (_extract("pages", "page_id", "url"), _URL_SQL.format(context="")),
    "fields_in_sql": (_fields_in_sql, _URL_SQL.format(context=", NULL::VARCHAR AS context")),
    "segment_512": (
        lambda s, d: table(s, d, "documents").select("doc_id", F.posexplode(docs.segments(F.col("text"))).alias("nth", "segment")),
        r"""WITH packed AS (SELECT doc_id, list_reduce(string_split_regex(trim(regexp_replace(text, '[\s\x0B\x85\xA0]+', ' ', 'g')), ' '),
            lambda acc, w: acc || CASE WHEN strlen(string_split(acc, chr(10))[-1]) + strlen(w) + 1 > 512 THEN chr(10) ELSE ' ' END || w) AS lines FROM documents WHERE strlen(text) >= 512)
        SELECT doc_id, 0 AS nth, text AS segment FROM documents WHERE strlen(text) BETWEEN 1 AND 511
        UNION ALL SELECT doc_id, (nth - 1)::INT, string_split(lines, chr(10))[nth] FROM (SELECT doc_id, lines, unnest(range(1, len(string_split(lines, chr(10))) + 1)) AS nth FROM packed)""",
    ),
}


# --- whole scans ---


def _scan(mode: str) -> Query:
    return lambda spark, sf_dir: _round(scan(spark, tables(spark, sf_dir), ScanConfig(mode)), "weight")


def _scan_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(scan(spark, {"derived": derived(spark, sf_dir)}, ScanConfig("deepscan")), "weight")


#: (name, column of the derived view): each column under its own name, and under names that say the same, something else or nothing.
_PAIRED = [(c, c) for c in _VALUES] + [
    ("phone number", "mobile_no"), ("pan", "pan_number"), ("description", "email"), ("dob", "vehicle"), ("bank account number", "mobile_no"), ("account_number", "card_number"),
    ("fastag id", "ifsc"), ("policy no", "vehicle"), ("address", "notes"), ("epf member id", "gstin"), ("x", "ip_addr"), ("email", "upi"), ("card holder's mobile", "card_number"),
]


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = derived(spark, sf_dir).select("c_custkey", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(c).alias("source"), F.col(c).alias("value")) for n, c in _PAIRED])).alias("p"))
    return each.select("c_custkey", "p.name", "p.source", detect.pair_labels("p.name", "p.value").alias("label"))


def _pairs_of_names_sql() -> str:
    rules = ", ".join(f"({_quote(label)}, {_quote(r.pattern)})" for label, some in COLUMN_RULES.items() for r in some)
    asked = ", ".join(f"({_quote(n)})" for n in dict.fromkeys(n for n, _ in _PAIRED))
    pairs = " UNION ALL ".join(f"SELECT c_custkey, {_quote(n)} AS name, {_quote(c)} AS source, lower({c}) AS low FROM base" for n, c in _PAIRED)
    fired = ", ".join(_fires_sql(label, some, "low", lambda rule, hit, label=label: _quote(label), "names") for label, some in VALUE_RULES.items())
    return f"""WITH base AS ({DERIVED_SQL}), rules(label, pattern) AS (VALUES {rules}), asked(name) AS (VALUES {asked}),
known AS (SELECT name, list(DISTINCT label) FILTER (WHERE label IS NOT NULL) AS names FROM asked LEFT JOIN rules ON regexp_matches(lower(name), pattern) GROUP BY name),
fired AS (SELECT c_custkey, name, source, coalesce(names, []) AS names, list_filter([{fired}], lambda x: x IS NOT NULL) AS labels
  FROM ({pairs}) JOIN (SELECT name, coalesce(names, []) AS names FROM known) USING (name))
SELECT c_custkey, name, source, CASE WHEN len(labels) = 0 THEN list_min(names) ELSE list_min(list_intersect(labels, names)) END AS label FROM fired"""


def _derived_sql() -> str:
    """A scan of the derived view in DuckDB's words: contexts of names, fields of documents, rules with checks, weights by context,
    winners of fields, groups of overlapping matches, sums by column, and the chain of scores."""
    keys = {  # columns whose cells are documents: key (in names, by example) and value
        "payload_json": (("'cvv'", _CVV), ("'mobile'", _MOBILE)), "payload_xml": (("'cvv'", _CVV), ("'z'", "CAST(c_custkey % 10 AS STRING)")), "payload_query": (("'mobile'", _MOBILE), ("'note'", "'x' || (c_custkey % 10)")),
        "payload_encoded": (("'mobile'", _MOBILE),), "kv_text": (("'card: 1, phone'", _MOBILE),),
    }
    rules = ", ".join(f"({_quote(label)}, {i}, {_quote(r.pattern)}, {r.weight})" for label, some in COLUMN_RULES.items() for i, r in enumerate(some))
    names = ", ".join(f"({_quote(n)})" for n in [*_VALUES, "cvv", "mobile", "z", "note", "card: 1, phone"])
    plain = " UNION ALL ".join(f"SELECT c_custkey AS k, {_quote(c)} AS c, {_quote(c)} AS name, {c} AS value, false AS inner_field FROM base" for c in _VALUES if c not in keys)
    parts = " UNION ALL ".join(f"SELECT c_custkey, {_quote(c)}, {key}, {value}, true FROM customer" for c, pairs in keys.items() for key, value in pairs)
    match = " UNION ALL ".join(
        f"SELECT k, c, name, loose, context, {_quote(label)} AS label, {_quote(LABELS[label][0])} AS tier, low, unnest({_fires_sql(label, rules_, 'low', lambda rule, hit: f'[({rule.weight}, {hit})]', '[context]')}) AS m FROM pieces" for label, rules_ in VALUE_RULES.items()
    )
    return f"""WITH base AS ({DERIVED_SQL}), rules(label, nth, pattern, weight) AS (VALUES {rules}), asked(name) AS (VALUES {names}),
known AS (SELECT name, label, arg_min(weight, nth)::DOUBLE AS weight FROM asked JOIN rules ON regexp_matches(lower(name), pattern) GROUP BY ALL),
context AS (SELECT name, arg_min(label, (-weight, label)) AS context FROM known GROUP BY name),
pieces AS MATERIALIZED (SELECT k, c, name, lower(value) AS low, context, context IS NULL AND NOT inner_field AS loose FROM ({plain} UNION ALL {parts}) LEFT JOIN context USING (name) WHERE value <> ''),
raw AS ({match}),
matches AS (SELECT k, c, name, loose, context, label, tier, m[1]::DOUBLE AS weight, (strpos(low, m[2]) - 1)::INT AS "start", (strpos(low, m[2]) - 1 + length(m[2]))::INT AS "end", coalesce(label = context, false) AS ctx FROM raw),
boosted AS (SELECT * REPLACE (CASE WHEN ctx THEN 1.0 ELSE weight END::DOUBLE AS weight) FROM matches),
capped0 AS (SELECT * REPLACE (CASE WHEN context IS NULL AND tier <> 'Tier1' AND weight >= 0.7 THEN 0.69 ELSE weight END::DOUBLE AS weight) FROM boosted),
reach AS (SELECT *, max("end") OVER (PARTITION BY k, c ORDER BY "start", "end" DESC, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM capped0 WHERE loose),
grouped AS (SELECT *, sum((r IS NULL OR "start" >= r)::INT) OVER (PARTITION BY k, c ORDER BY "start", "end" DESC, label ROWS UNBOUNDED PRECEDING)::INT AS g FROM reach),
best AS (
  SELECT k, c, label, weight, ctx FROM grouped QUALIFY row_number() OVER (PARTITION BY k, c, g ORDER BY weight DESC, label) = 1
  UNION ALL SELECT k, c, label, weight, ctx FROM capped0 WHERE NOT loose QUALIFY row_number() OVER (PARTITION BY k, c, name ORDER BY ctx DESC, weight DESC, label) = 1),
merged AS (SELECT k, c, label, max(weight) AS weight, bool_or(ctx) AS ctx FROM best GROUP BY ALL),
hits AS (SELECT 'derived' AS t, c, label, sum(weight) AS weight, count(*) AS matched, bool_or(ctx) AS in_context FROM merged GROUP BY ALL),
scanned AS (SELECT 'derived' AS t, c, count(DISTINCT k) AS n FROM pieces GROUP BY ALL),
names AS (SELECT 'derived' AS t, name AS c, label, weight FROM known WHERE name IN ({', '.join(map(_quote, _VALUES))})), {_CHAIN_SQL}
SELECT {_OUT}, kind AS detector_type, 'regex' AS detector, round(weight, 6) AS weight, confidence, tier, domain, ctx AS context_matched, matched AS matched_count, n AS scanned_count FROM won"""


#: What a full scan of the raw tables finds: two column names, nothing by value.
_RAW_SQL = """SELECT * FROM (VALUES ('events', 'user_id', 'Username', 'column detector', 'regex', 0.5::DOUBLE, 'Medium', 'Tier3', 'Digital', false, 0::BIGINT, 0::BIGINT),
  ('lineitem', 'l_quantity', 'UAN', 'column detector', 'regex', 0.3::DOUBLE, 'Low', 'Tier3', 'Employment', false, 0::BIGINT, 0::BIGINT))
  f("table", "column", label, detector_type, detector, weight, confidence, tier, domain, context_matched, matched_count, scanned_count)"""


def _all() -> dict[str, tuple[Query, str | None]]:
    out: dict[str, tuple[Query, str | None]] = {
        "scan_cells_unpivot": (_unpivot, _cells_sql(_SCANNED)),
        "scan_cell_counts": (_counts, f'SELECT "table", "column", count(*) AS scanned FROM ({_cells_sql(_SCANNED)}) GROUP BY ALL'),
        "scan_sample_10pct": (_sample, _SAMPLE_SQL),
        "meta_scan_columns": (_meta, _meta_sql()),
        "region_filter": (_region, _region_sql()),
        "context_gate": (_gate, _gate_sql()),
        "validate_ipv6": (_ipv6, _IPV6_SQL),
        "pair_detect": (_pairs, _pairs_of_names_sql()),
        "scan_meta": (_scan("metascan"), _RAW_SQL),
        "scan_deep": (_scan("deepscan"), _RAW_SQL),
        "scan_auto": (_scan(""), _RAW_SQL),
        "scan_deep_derived": (_scan_derived, _derived_sql()),
    }
    for label in VALUE_RULES:
        out[f"detect_{label.lower()}"] = (_detect(label), _detect_sql(label))
    checks = {"luhn": ("card_number", validators.luhn_expr), "verhoeff": ("aadhaar", validators.verhoeff_expr), "gstin": ("gstin", validators.gstin_expr), "ipv4": ("ip_addr", validators.ipv4_expr), "mac": ("device_mac", validators.mac_expr)}
    for name, (column, check) in checks.items():
        out[f"validate_{name}"] = (_validate(column, check), _VALIDATE_SQL[f"validate_{name}"].replace("__D", DERIVED_SQL))
    out |= {name: (q, f"{_matches_sql()} {text}") for name, (q, text) in _RESOLVE.items()}
    out |= {name: (q, _PROOF_SQL + _CHAIN_SQL + text) for name, (q, text) in _SCORE.items()}
    return out | _EXTRACT


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in _all().items() if text is not None}
