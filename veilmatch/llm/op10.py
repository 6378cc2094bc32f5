"""Query ``op10_toxicity``."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_crc_mod
from .toxicity import fit, toxicity

THRESHOLD = 0.3


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = id_crc_mod("doc_id", 4) == 2
    model = fit(docs, labels, ~held_out)
    return toxicity(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    )
