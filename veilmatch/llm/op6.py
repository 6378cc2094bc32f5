"""Query ``op6_lm_scoring``."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_crc_mod
from .scoring import fit, score


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = id_crc_mod("doc_id", 7) == 2
    model = fit(docs, ~held_out)
    return score(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        F.when(F.col("n_bytes") > 0, -F.col("score") * F.log2(F.lit(10.0)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
