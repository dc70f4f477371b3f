"""The registered queries of the corpus operators, one for each, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillsift.llm import clusters, decontam, langid, lm_score, media, mixing, near_dedup, neighbours, secrets, token_output, tokens, url_filter, whitening
from quillsift.llm.common import documents, embeddings

#: Fixed rules of the URL query, then the method's own patterns for what no host rule decides.
URL_RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
    url_filter.Rule("block", pattern=r"[?&]utm_source=feed(?:[&#]|$)", literals=("utm", "source", "feed")),
    url_filter.Rule("block", pattern=r"[?&]page=[0-9]+&ref=", literals=("page", "ref")),
]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_table(documents(spark, sf_dir))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_table(documents(spark, sf_dir), "byte_bpe_50k.json", end=2)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_table(documents(spark, sf_dir))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(documents(spark, sf_dir), "byte_bpe_50k.json", limit=1024)


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(documents(spark, sf_dir))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(documents(spark, sf_dir))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening_table(embeddings(spark, sf_dir))


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(embeddings(spark, sf_dir))


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_table(embeddings(spark, sf_dir))


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('11|' || coalesce(doc_id::VARCHAR, 'null') || '|' || coalesce(md5(text), 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, nth, [5.0, 2.0, 1.0][nth % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS most
  FROM (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS nth FROM per)),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(most) OVER (ORDER BY most / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY most / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed),
final AS (SELECT source, source_size, CASE WHEN level * weight < most
            THEN weight * (SELECT arg_min(level, (most / weight, nth)) FROM levels WHERE level * weight < most) ELSE most END AS target FROM levels),
taken AS (
  SELECT s.doc_id, s.size, f.source_size, f.target,
         CASE WHEN f.source_size > 0 THEN f.target / f.source_size ELSE 0 END AS rate, s.u
  FROM sized s JOIN final f ON s.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, source_size, target, ((floor(rate) + (u < rate - floor(rate))::INT) * size)::BIGINT AS taken,
       (floor(rate) + (u < rate - floor(rate))::INT)::BIGINT AS copies
FROM taken
"""

OP4_SQL = r"""
WITH split AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, url,
         translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM split),
ruled AS (
  SELECT *, CASE
      WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
      WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
      WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
      WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block'
    WHEN rule IN ('com/fr/', 'org/') THEN 'allow'
    WHEN regexp_matches(coalesce(url, ''), '[?&]utm_source=feed([&#]|$)') OR regexp_matches(coalesce(url, ''), '[?&]page=[0-9]+&ref=') THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
"""

OP10_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
items AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM worded WHERE len(w) > 0)),
sized AS (SELECT doc_id, count(*) AS n FROM items GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM items a JOIN items b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sized s ON s.doc_id = a JOIN sized t ON t.doc_id = b WHERE 100 * inter >= 75 * (s.n + t.n - inter)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
lowest AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(low, w.doc_id)) AS component_id,
       w.doc_id <= coalesce(low, w.doc_id) AS kept
FROM worded w LEFT JOIN sized s ON s.doc_id = w.doc_id LEFT JOIN lowest ON a = w.doc_id
"""


# Integer vectors of 64 components; three rounds of centroids, each of the assignment before it.
_OP13_ASSIGN = """
  SELECT vec_id, x, cluster, distance FROM (
    SELECT v.vec_id, v.x, c.cluster, list_sum(list_transform(range(1, 65), lambda j: (v.x[j] - c.c[j]) * (v.x[j] - c.c[j])))::BIGINT AS distance
    FROM v, {centroids} c)
  QUALIFY row_number() OVER (PARTITION BY vec_id, x ORDER BY distance, cluster) = 1"""
_OP13_MOVE = """
  SELECT c.cluster, coalesce(m.c, c.c) AS c FROM {centroids} c LEFT JOIN (
    SELECT cluster, list(m ORDER BY j) AS c FROM (
      SELECT cluster, j, floor(sum(x[j])::DOUBLE / count(*))::BIGINT AS m FROM {assigned}, (SELECT unnest(range(1, 65)) AS j) GROUP BY cluster, j)
    GROUP BY cluster) m USING (cluster)"""
OP13_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR)) - 1 AS cluster, x AS c FROM v QUALIFY cluster < 16),
a0 AS MATERIALIZED ({_OP13_ASSIGN.format(centroids="c0")}), c1 AS MATERIALIZED ({_OP13_MOVE.format(centroids="c0", assigned="a0")}),
a1 AS MATERIALIZED ({_OP13_ASSIGN.format(centroids="c1")}), c2 AS MATERIALIZED ({_OP13_MOVE.format(centroids="c1", assigned="a1")}),
a2 AS MATERIALIZED ({_OP13_ASSIGN.format(centroids="c2")}), c3 AS MATERIALIZED ({_OP13_MOVE.format(centroids="c2", assigned="a2")}),
a3 AS MATERIALIZED ({_OP13_ASSIGN.format(centroids="c3")})
SELECT vec_id, cluster::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a3 JOIN c3 USING (cluster)
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_mixing, op2_media, op3_token_output, op4_url_filter, op5_language, op6_decontamination, op7_token_counts, op8_lm_score, op9_secrets, op10_near_dedup, op11_whitening, op12_neighbours, op13_clusters)}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1_SQL, "op4_url_filter": OP4_SQL, "op10_near_dedup": OP10_SQL, "op13_clusters": OP13_SQL}
