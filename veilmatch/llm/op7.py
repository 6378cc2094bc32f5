"""Query ``op7_secrets``."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .secrets import BASE, RULES, listed, scan


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *(count(r.kind) for r in BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _rule_sql(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    regex = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind,
      list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s, length(m[i]) AS n
    FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT doc_id, string_split_regex(text, {regex}) AS b, regexp_extract_all(text, {regex}, 0) AS m, regexp_extract_all(text, {regex}, {group}) AS g
      FROM d WHERE regexp_matches(text, {regex}))) WHERE length(g[i]) >= {least}"""


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents
), f AS (
    {" UNION ALL ".join(_rule_sql(n, r.kind, r.pattern, r.group, r.least) for n, r in enumerate(RULES))}
), t AS (SELECT *, kind || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(s + n AS BIGINT) AS VARCHAR) AS w FROM f
), a AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(w, ',' ORDER BY s, rank) FILTER (rank < {len(BASE)}) AS base, string_agg(w, ',' ORDER BY s, rank) AS spans
  FROM t GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a ON d.doc_id = a.doc_id
"""
