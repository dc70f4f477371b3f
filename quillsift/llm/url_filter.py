"""URL rules found by their rarest literal token, in DataFrame operations only.

A rule is a host and a path prefix, or a regular expression over the whole URL with
literal tokens that every match contains. The tokens of all URLs are counted, each rule
is filed under the rarest of its own tokens, a URL's tokens fetch the rules filed under
them, and only those are tried on it: a host rule by the ends of host and path, any other
by its regular expression. Rules with no complete token are filed under the empty token,
which every URL has.

The rules are configuration: up to ``INLINE_RULES`` they become a map literal inside the
expression, so nothing is shuffled, and each pattern is a literal that is compiled once a
task; beyond that the distinct URLs' tokens are joined with the index table.

Defined cases: a null URL or one without ``://`` has an empty host and path and fits no
host rule; repeated rows each get the same verdict; a very long URL is judged whole; of equally
long rules the one later by name counts; an empty table gives an empty result; only ``page_id`` and
``url`` are read, so further columns of any name do no harm.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import join_small, staged

#: Beyond so many rules the index is a table and no longer a literal.
INLINE_RULES = 5000

SPLIT = r"[^a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """A host rule (``host``, ``path``) or, with ``pattern``, a general one (host "" and path "")."""

    action: str
    host: str = ""
    path: str = ""
    pattern: str = ""
    literals: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return self.host + self.path if self.host else ""

    def tokens(self) -> list[str]:
        """The complete lower-case tokens that every URL that the rule fits must have."""
        if self.pattern:
            return [t.lower() for t in self.literals if re.fullmatch("[a-z0-9]+", t.lower())]
        cut = [t for t in re.split(SPLIT, self.host.lower()) if t]
        in_path = re.split(SPLIT, self.path.lower())
        return cut + [t for t in in_path[:-1] if t]


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #`` with A-Z lower-cased; path: then up to ``? #``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, az, az.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def url_tokens(url: Column) -> Column:
    """Distinct tokens of the URL, with the empty one."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.lower(F.coalesce(url, F.lit(""))), SPLIT)))


def rarest(pages: DataFrame, rules: list[Rule], url: str = "url") -> dict[str, list[int]]:
    """Token -> numbers of the rules filed under it. Counts only the rules' own tokens, over all URLs."""
    mine = sorted({t for r in rules for t in r.tokens()})
    seen: dict[str, int] = {}
    if mine:
        hit = F.explode(F.array_intersect(url_tokens(F.col(url)), F.array(*map(F.lit, mine))))
        seen = {r["t"]: r["count"] for r in pages.select(hit.alias("t")).groupBy("t").count().collect()}
    index: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        index.setdefault(min(r.tokens(), key=lambda t: (seen.get(t, 0), t), default=""), []).append(i)
    return index


def fits(rule, host: Column, path: Column, general: Column) -> Column:
    """Whether a candidate holds: a host rule for its host and all below it where the path begins with the rule's; else ``general``."""
    own = ((host == rule["host"]) | F.endswith(host, F.concat(F.lit("."), rule["host"]))) & F.startswith(path, rule["path"])
    return F.coalesce(F.when(rule["general"], general).otherwise(own), F.lit(False))


def _best(found: Column) -> Column:
    """The longest rule, ties by name and number; general rules only when no host rule fits."""
    return F.array_max(F.transform(found, lambda r: F.struct((~r["general"]).alias("own"), F.length(r["name"]).alias("n"), r["name"].alias("name"), r["action"].alias("action"))))


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow", inline: int = INLINE_RULES) -> DataFrame:
    """page_id, host, path, rule (name of the longest host rule, else null), verdict."""
    index = rarest(pages, rules)
    host, path = host_path(F.col("url"))
    base = pages.select("page_id", "url", host.alias("host"), path.alias("path"))

    def literal(i: int) -> Column:
        r = rules[i]
        return F.struct(*[F.lit(v).alias(k) for k, v in {"nth": i, "name": r.name, "action": r.action, "host": r.host, "path": r.path, "general": bool(r.pattern)}.items()])

    def one_of(nth: Column) -> Column:
        """The regular expression of one rule; the others of the chain are not run."""
        chain = F
        for i, r in enumerate(rules):
            chain = chain.when(nth == i, F.col("url").rlike(r.pattern)) if r.pattern else chain
        return F.lit(False) if chain is F else chain.otherwise(False)

    if not rules:
        return base.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    if len(rules) <= inline:
        table = F.create_map(*[x for t, ids in sorted(index.items()) for x in (F.lit(t), F.array(*map(literal, ids)))])
        keys = F.array_intersect(url_tokens(F.col("url")), F.array(*map(F.lit, sorted(index))))
        fetched = F.flatten(F.transform(keys, lambda t: table[t]))
        held = F.filter(fetched, lambda r: fits(r, F.col("host"), F.col("path"), one_of(r["nth"])))
        out = base.withColumn("best", _best(held))
    else:
        spark = pages.sparkSession
        rows = [(t, r.name, r.action, r.host, r.path, r.pattern, bool(r.pattern)) for t, ids in index.items() for r in (rules[i] for i in ids)]
        table = staged(spark.createDataFrame(rows, "token string, name string, action string, rule_host string, rule_path string, pattern string, general boolean"), "url-rules")
        urls = base.select("url", "host", "path").distinct().withColumn("token", F.explode(url_tokens(F.col("url"))))
        rule = {"host": F.col("rule_host"), "path": F.col("rule_path"), "general": F.col("general")}
        got = join_small(urls, table, "token").where(fits(rule, F.col("host"), F.col("path"), F.rlike("url", "pattern")))
        best = got.groupBy("url").agg(F.max(F.struct((~F.col("general")).alias("own"), F.length("name").alias("n"), "name", "action")).alias("best")).withColumnRenamed("url", "of")
        out = join_small(base, staged(best, "url-best"), F.col("url").eqNullSafe(F.col("of")), "left")
    rule = F.when(F.col("best.own"), F.col("best.name"))
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(F.col("best.action"), F.lit(default)).alias("verdict"))
