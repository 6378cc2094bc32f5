"""Query ``op5_media``."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .media import decode, read_archives, write_archives


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_archives(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = decode(read_archives(spark, path))
    lost = F.raise_error(F.concat(F.lit("unreadable member "), F.coalesce("member", F.lit("(whole archive)")), F.lit(": "), F.col("error")))
    return found.select(
        F.when(F.col("error").isNotNull(), lost).otherwise(F.regexp_extract("member", "^(-?[0-9]+)/", 1)).alias("doc"),
        "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature",
    ).select(F.when(F.col("doc") != "", F.col("doc").cast("long")).alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
