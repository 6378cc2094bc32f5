"""Validation and sanitising of records against a field set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import normalize
from ..plans.schema import FieldSet
from .tokenize import raw_values


def valid_path(key: Column) -> Column:
    """Whether a text is a field path: three parts, none empty."""
    parts = F.split(key, "::", 3)
    return (F.size(parts) == 3) & ~F.exists(parts, lambda p: p == "")


def path_parts(key: Column) -> Column:
    """``struct<org, namespace, name>``; null for a text that is no path."""
    parts = F.split(key, "::", 3)
    return F.when(valid_path(key), F.struct(parts[0].alias("org"), parts[1].alias("namespace"), parts[2].alias("name")))


def record_from_map(m: Column, fs: FieldSet) -> tuple[Column, Column]:
    """The entries whose keys the field set has, and every other key with its fault."""
    known = F.array(*(F.lit(p) for p in fs.paths()))
    record = F.map_filter(m, lambda k, v: F.array_contains(known, k))
    wrong = F.filter(F.map_keys(m), lambda k: ~F.array_contains(known, k))
    errors = F.transform(wrong, lambda k: F.struct(k.alias("key"), F.when(valid_path(k), "not in FieldSet").otherwise("malformed path").alias("reason")))
    return record, F.array_sort(errors)


def record_errors(record: str, fs: FieldSet) -> Column:
    """All problems of a record in one pass, as sorted texts: missing, faulty and unknown fields."""
    out = []
    for f, value in zip(fs.fields, raw_values(fs, None, record)):
        p = str(f.path)
        if f.required:
            out.append(F.when(~F.map_contains_key(record, F.lit(p)), F.lit(f'required field "{p}" missing')))
        out.append(F.concat(F.lit(f'field "{p}": '), normalize(value, f.path)["error"]))
    known = F.array(*(F.lit(p) for p in fs.paths()))
    unknown = F.transform(F.filter(F.map_keys(record), lambda k: ~F.array_contains(known, k)), lambda k: F.concat(F.lit('unknown field "'), k, F.lit('" (not in FieldSet)')))
    return F.array_sort(F.concat(F.array_compact(F.array(*out)), unknown))


def sanitize(df: DataFrame, fs: FieldSet, record: str = "record") -> DataFrame:
    """``df`` with faulty fields taken out of the record and ``dropped``, a map from path to error (null when none)."""
    faults = F.array_compact(
        F.array(
            *(
                F.when(n["error"].isNotNull(), F.struct(F.lit(str(f.path)).alias("k"), n["error"].alias("v")))
                for f, v in zip(fs.fields, raw_values(fs, None, record))
                for n in [normalize(v, f.path)]
            )
        )
    )
    out = df.withColumn("__d", F.map_from_entries(faults))
    clean = F.map_filter(record, lambda k, v: ~F.map_contains_key("__d", k))
    return out.withColumn(record, clean).withColumn("dropped", F.when(F.size("__d") > 0, F.col("__d"))).drop("__d")


def drop_counts(sanitized: DataFrame) -> DataFrame:
    """``path, drops`` over sanitised records."""
    return sanitized.select(F.explode("dropped").alias("path", "error")).groupBy("path").agg(F.count("*").alias("drops"))
