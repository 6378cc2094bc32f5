"""A training corpus from raw documents: five stages, each one operator.

Toxic documents go, one document of each near-duplicate group stays,
contaminated documents go, secrets are redacted in place, and what is left is
packed into sequences. All stages but the last return the input's columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmatch.llm.common import id_crc_mod, materialise
from veilmatch.llm.decontaminate import contamination
from veilmatch.llm.neardup import deduplicate
from veilmatch.llm.op1 import tokenizer_path
from veilmatch.llm.op10 import THRESHOLD
from veilmatch.llm.packing import pack
from veilmatch.llm.secrets import redact
from veilmatch.llm.toxicity import fit, toxicity


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels, id_crc_mod("doc_id", 4) != 2)
    scored = toxicity(docs, model, keep=True, name="__toxicity")
    return scored.where(F.col("__toxicity") < THRESHOLD).drop("__toxicity")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicate(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contamination(docs, benchmark, keep=True, name="__match")
    return found.where("__match.n_hit = 0").drop("__match")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_path())


STAGES = [("toxicity", toxic), ("near duplicates", near_copies), ("decontamination", leaks), ("secrets", secrets), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
