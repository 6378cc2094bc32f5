"""Query ``op8_sharding``."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sharding import shard

SHARDS = 40


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _, _ = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), SHARDS)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        "map_version",
    )
