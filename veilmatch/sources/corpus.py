"""Sources and sinks: corpora in JSON lines, the mapping of raw corpora, tokens as JSON, reports."""

from __future__ import annotations

import atexit
import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.schema import ADDRESS, DATE, IDENTIFIER, NAME, path

RECORD = T.StructType(
    [
        T.StructField("canonical_id", T.StringType()),
        T.StructField("entity_id", T.StringType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("record", T.MapType(T.StringType(), T.StringType())),
        T.StructField("aliases", T.ArrayType(T.StringType())),
    ]
)


def read_corpus(spark: SparkSession, location: str) -> DataFrame:
    """Records of JSON lines. Blank lines are skipped; a malformed line, a missing
    ``canonical_id`` and an empty corpus raise an error that shows the line."""
    lines = spark.read.text(location).where(F.trim("value") != "")
    bad = T.StructType([*RECORD, T.StructField("_bad", T.StringType())])
    rows = lines.select("value", F.from_json("value", bad, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}).alias("r"))
    fault = F.when(F.col("r").isNull() | F.col("r._bad").isNotNull(), "malformed record: ").when(F.coalesce(F.col("r.canonical_id"), F.lit("")) == "", "missing canonical_id: ")
    checked = F.when(fault.isNotNull(), F.raise_error(F.concat(fault, F.col("value"))).cast("boolean")).otherwise(F.lit(True))
    out = rows.where(checked).select(*(F.col(f"r.{f.name}").alias(f.name) for f in RECORD))
    if lines.isEmpty():
        raise ValueError(f"corpus {location} is empty")
    return out


def write_corpus(df: DataFrame, location: str) -> None:
    """JSON lines of records; keys of a record are sorted."""
    entries = F.map_from_entries(F.array_sort(F.map_entries("record")))
    df.withColumn("record", entries).select([f.name for f in RECORD if f.name in df.columns]).write.json(location)


def _text(name: str) -> Column:
    return F.nullif(F.trim(F.col(name).cast("string")), F.lit(""))


def _record(entries: dict[str, Column]) -> Column:
    pairs = F.array(*(F.struct(F.lit(p).alias("k"), c.alias("v")) for p, c in entries.items()))
    return F.map_from_entries(F.filter(pairs, lambda x: x["v"].isNotNull()))


def febrl_canonical_id(rec_id: Column) -> Column:
    """The number in ``rec-N-org`` and ``rec-N-dup-k``; any other id as it is."""
    found = F.regexp_extract(rec_id, "^rec-(.*?)-(?:org|dup-)", 1)
    return F.when(F.rlike(rec_id, F.lit("^rec-.*?-(?:org|dup-)")), found).otherwise(rec_id)


def iso_date(digits: Column) -> Column:
    """Eight digits with dashes put in; anything else as it is."""
    return F.when(F.rlike(digits, F.lit("^[0-9]{8}$")), F.regexp_replace(digits, "^(....)(..)(..)$", "$1-$2-$3")).otherwise(digits)


def febrl_records(df: DataFrame, dataset: str) -> DataFrame:
    """Records of a frame with the generator's columns."""
    given, family = _text("given_name"), _text("surname")
    record = _record(
        {
            str(path(NAME, "given")): given,
            str(path(NAME, "family")): family,
            str(path(IDENTIFIER, "national_id")): _text("soc_sec_id"),
            str(path(ADDRESS, "postal_code")): _text("postcode"),
            str(path(ADDRESS, "locality")): _text("suburb"),
            str(path(ADDRESS, "admin_area")): _text("state"),
            str(path(DATE, "birth")): iso_date(_text("date_of_birth")),
            str(path(NAME, "full")): F.when(given.isNotNull() & family.isNotNull(), F.concat_ws(" ", given, family)),
            str(path(ADDRESS, "country")): F.lit("AU"),
        }
    )
    return df.select(febrl_canonical_id(F.col("rec_id")).alias("canonical_id"), F.col("rec_id").alias("entity_id"), F.lit(dataset).alias("dataset"), record.alias("record"))


def febrl_corpus(originals: DataFrame, copies: DataFrame) -> DataFrame:
    return febrl_records(originals, "febrl4-org").unionByName(febrl_records(copies, "febrl4-dup"))


def read_voters(spark: SparkSession, location: str) -> DataFrame:
    """A tab-separated voter roll with a header, in Latin-1; short rows are padded with null."""
    return spark.read.options(sep="\t", header=True, encoding="ISO-8859-1", mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).csv(location)


def in_hash_sample(key: Column, one_in: int) -> Column:
    """Whether the first eight bytes of the key's SHA-256, as a number, divide by ``one_in``."""
    head = F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return head % one_in == 0


def voter_records(df: DataFrame, one_in: int = 1500, most: int | None = 5000) -> DataFrame:
    """Records of active, named voters in the hash sample, in order of id, up to ``most`` if given."""
    given, middle, family = _text("first_name"), _text("middle_name"), _text("last_name")
    full = F.when(given.isNotNull() & family.isNotNull(), F.regexp_replace(F.concat_ws(" ", given, middle, family), r"\s+", " "))
    record = _record(
        {
            str(path(NAME, "given")): given,
            str(path(NAME, "middle")): middle,
            str(path(NAME, "family")): family,
            str(path(NAME, "full")): full,
            str(path(ADDRESS, "locality")): _text("res_city_desc"),
            str(path(ADDRESS, "admin_area")): _text("state_cd"),
            str(path(ADDRESS, "postal_code")): F.substring(_text("zip_code"), 1, 5),
            str(path(ADDRESS, "country")): F.lit("US"),
        }
    )
    kept = df.where((F.col("status_cd") == "A") & _text("ncid").isNotNull() & given.isNotNull() & family.isNotNull() & in_hash_sample(_text("ncid"), one_in))
    out = kept.select(_text("ncid").alias("canonical_id"), _text("ncid").alias("entity_id"), F.lit("ncvr-org").alias("dataset"), record.alias("record"))
    return out if most is None else out.orderBy("canonical_id").limit(most)


# ---------------------------------------------------------------- tokens as JSON


def token_json(token: Column, bloom: bool = False) -> Column:
    """JSON of a token: bytes in base64, absent fields null, empty key id and fingerprint left out."""
    none = F.lit("")
    parts = [
        token["field_set_version"].alias("field_set_version"),
        F.nullif(token["key_id"], none).alias("key_id"),
        F.nullif(token["field_set_fingerprint"], none).alias("field_set_fingerprint"),
        F.transform(token["fields"], F.base64).alias("fields"),
    ]
    if bloom:
        p = token["params"]
        flip = F.when(p["flip_probability"] != 0, p["flip_probability"]).alias("flip_probability")
        least = F.when(p["target_popcount"] != 0, p["target_popcount"]).alias("target_popcount")
        parts.append(F.struct(p["size_bits"].alias("size_bits"), p["ngram_sizes"].alias("ngram_sizes"), p["hash_count"].alias("hash_count"), flip, least).alias("probabilistic_params"))
    return F.to_json(F.struct(*parts))


def token_from_json(text: Column, bloom: bool = False) -> Column:
    """The token of a JSON text; malformed JSON or base64 raises an error."""
    ddl = "field_set_version string, key_id string, field_set_fingerprint string, fields array<string>"
    if bloom:
        ddl += ", probabilistic_params struct<size_bits: bigint, ngram_sizes: array<int>, hash_count: int, flip_probability: double, target_popcount: bigint>"
    r = F.from_json(text, ddl, {"mode": "FAILFAST"})
    parts = [
        r["field_set_version"].alias("field_set_version"),
        F.coalesce(r["key_id"], F.lit("")).alias("key_id"),
        F.coalesce(r["field_set_fingerprint"], F.lit("")).alias("field_set_fingerprint"),
        F.transform(r["fields"], lambda f: F.to_binary(f, F.lit("base64"))).alias("fields"),
    ]
    if bloom:
        p = r["probabilistic_params"]
        parts.append(
            F.struct(
                p["size_bits"].alias("size_bits"), p["ngram_sizes"].alias("ngram_sizes"), p["hash_count"].alias("hash_count"),
                F.coalesce(p["flip_probability"], F.lit(0.0)).alias("flip_probability"), F.coalesce(p["target_popcount"], F.lit(0)).cast("long").alias("target_popcount"),
            ).alias("params")
        )
    return F.struct(*parts)


# ---------------------------------------------------------------- reports


def result_metrics(result: dict) -> dict[str, dict[str, float]]:
    """The twelve figures of an evaluation, by slug."""
    best = result["best_f1"]
    flat = {
        "auroc": result["auroc"],
        "auprc": result["auprc"],
        "f1": best["f1"],
        "precision": best["precision"],
        "recall": best["recall"],
        "accuracy": result["best_accuracy"]["accuracy"],
        "mcc": result["best_mcc"]["mcc"],
        "tokenize_latency_p50_ns": result["tokenize"]["p50"],
        "tokenize_latency_p99_ns": result["tokenize"]["p99"],
        "tokenize_throughput_per_sec": result["tokenize"]["throughput"],
        "match_latency_p99_ns": result["match"]["p99"],
        "match_throughput_per_sec": result["match"]["throughput"],
    }
    return {k: {"value": float(v)} for k, v in flat.items()}


def write_report(spark: SparkSession, reports: dict[str, dict], location: str) -> None:
    """``{bench: {metric: {"value": number}}}`` as indented JSON, at a path of any file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(location)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray((json.dumps(reports, indent=2) + "\n").encode()))
    finally:
        out.close()


class Reports:
    """Collects evaluations by name and writes them once, on ``close`` or at the end of the program, to ``location``
    or where the environment variable VEILMATCH_REPORT says; without either nothing is written."""

    def __init__(self, spark: SparkSession, location: str | None = None):
        self.spark, self.location, self.held = spark, location or os.environ.get("VEILMATCH_REPORT"), {}
        atexit.register(self.close)

    def add(self, name: str, result: dict) -> None:
        self.held[name] = result_metrics(result)

    def close(self) -> None:
        atexit.unregister(self.close)
        if self.location and self.held:
            write_report(self.spark, self.held, self.location)
            self.held = {}
