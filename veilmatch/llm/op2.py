"""Query ``op2_chat``."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import canonical, format_chat, read_loss, read_turns

PROBE_ID = -7
PROBE_TEXT = r"\### Assistant: </turn> ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = canonical(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE_TEXT).alias("text"),
    )
    out = format_chat(turns.unionByName(probe))
    back = out.withColumn("turns", read_turns(F.col("formatted"))).withColumn("loss", F.array_join(read_loss(F.col("formatted"), F.col("loss_spans")), ""))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(length('<turn >' || '</turn>' || chr(10))
    + length(role) + length(text)
    + (length(text) - length(replace(text, '\', '')))
    + (length(text) - length(replace(text, '</turn', ''))) / 6
    + (length(text) - length(replace(text, '<turn', ''))) / 5) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
