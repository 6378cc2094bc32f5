"""Records to tokens: wide normalised columns, then one token column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import normalize
from ..functions.tokens import Secret, bloom_fields, hmac_fields, params_column, timed_bloom_fields, token_meta, unpacked
from ..plans.schema import FieldPath, FieldSet

POLICIES = ("fail", "nullify", "sanitize", "report")


def raw_values(fs: FieldSet, columns: dict[str, str] | None = None, record: str = "record") -> list[Column]:
    """A string column for each field: of ``columns`` (path to column name), or of a map column."""
    if columns is not None:
        return [F.col(columns[p]).cast("string") if p in columns else F.lit(None).cast("string") for p in fs.paths()]
    return [F.try_element_at(record, F.lit(p)) for p in fs.paths()]


def normalized(df: DataFrame, fs: FieldSet, columns: dict[str, str] | None = None, record: str = "record", policy: str = "fail") -> DataFrame:
    """``df`` with ``values`` (array of strings in field order) and ``errors`` (array of structs).

    ``fail`` stops at the first faulty or missing required value, ``nullify``
    takes a faulty value as absent, ``sanitize`` does so too but stops at a
    required field that is then absent, and ``report`` lists such fields among
    the errors.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    done = [normalize(v, f.path) for v, f in zip(raw_values(fs, columns, record), fs.fields)]
    wide = df.select("*", F.array(*(F.coalesce(d, F.struct(F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("error"))) for d in done)).alias("__n"))
    out = wide.withColumn("values", F.transform("__n", lambda x: x["value"]))
    faults = [F.when(F.col("__n")[k]["error"].isNotNull(), F.struct(F.lit(p).alias("path"), F.col("__n")[k]["error"].alias("error"))) for k, p in enumerate(fs.paths())]
    missing = [
        F.when(F.col("__n")[k]["error"].isNull() & F.col("__n")[k]["value"].isNull(), F.struct(F.lit(str(f.path)).alias("path"), F.lit("required field missing").alias("error")))
        for k, f in enumerate(fs.fields)
        if f.required and policy in ("fail", "report")
    ]
    errors = F.array_compact(F.array(*faults, *missing)) if fs.fields else F.array().cast("array<struct<path:string,error:string>>")
    out = out.withColumn("errors", errors).drop("__n")
    if policy == "sanitize" and any(f.required for f in fs.fields):
        lacking = [F.when(F.col("values")[k].isNull(), F.raise_error(F.lit(f"required field {f.path} missing")).cast("array<string>")) for k, f in enumerate(fs.fields) if f.required]
        out = out.withColumn("values", F.coalesce(*lacking, F.col("values")))
    if policy == "fail":
        first = F.concat(F.lit("field "), F.col("errors")[0]["path"], F.lit(": "), F.col("errors")[0]["error"])
        out = out.withColumn("values", F.when(F.size("errors") > 0, F.raise_error(first).cast("array<string>")).otherwise(F.col("values")))
    return out


class Tokenizer:
    """Tokens under one secret; ``key_id`` labels them so that rotation shows."""

    def __init__(self, secret: bytes, key_id: str = ""):
        self.secret, self.key_id = Secret(secret), key_id

    def __repr__(self) -> str:
        return f"Tokenizer(key_id={self.key_id!r})"

    def destroy(self) -> None:
        self.secret.destroy()

    def deterministic(self, df: DataFrame, fs: FieldSet, columns=None, record="record", policy="fail", keep_errors=False) -> DataFrame:
        """``df`` with ``token``: version, key id, fingerprint and HMAC fields (null when absent)."""
        out = normalized(df, fs, columns, record, policy).withColumn("__f", hmac_fields(F.col("values"), fs.paths(), self.secret))
        out = out.withColumn("token", F.struct(*token_meta(fs, self.key_id), F.col("__f").alias("fields")))
        return out.drop("__f", "values", *([] if keep_errors else ["errors"]))

    def probabilistic(self, df: DataFrame, fs: FieldSet, columns=None, record="record", policy="fail", keep_errors=False, timed=False) -> DataFrame:
        """``df`` with ``token``: as above with ``params`` and one Bloom filter for each field; if ``timed``, with ``ns`` too."""
        out = normalized(df, fs, columns, record, policy)
        if timed:
            out = out.withColumn("__t", timed_bloom_fields(F.col("values"), fs.paths(), fs.bloom, self.secret)).withColumn("ns", F.col("__t.ns")).withColumn("__f", F.col("__t.fields")).drop("__t")
        else:
            out = out.withColumn("__f", bloom_fields(F.col("values"), fs.paths(), fs.bloom, self.secret))
        out = out.withColumn("token", F.struct(*token_meta(fs, self.key_id), F.col("__f").alias("fields"), params_column(fs.bloom).alias("params")))
        return out.drop("__f", "values", *([] if keep_errors else ["errors"]))

    def field(self, value: Column, path: FieldPath) -> Column:
        """HMAC of one normalised field, for an index or as a blocking key; null when absent or faulty."""
        return hmac_fields(F.array(normalize(value, path)["value"]), [str(path)], self.secret)[0]


def comparable(df: DataFrame, token: str = "token") -> DataFrame:
    """``df`` with ``words`` and ``pops`` of its Bloom token, the form that pairs are scored in."""
    out = df.withColumn("__u", unpacked(F.col(token)["fields"]))
    return out.withColumn("words", F.col("__u.words")).withColumn("pops", F.col("__u.pops")).drop("__u")


def annotate(token: Column, fs: FieldSet, bloom: bool = False) -> Column:
    """Redacted view: metadata and each field's path, presence and byte count."""

    def present(f):
        return F.rlike(F.hex(f), F.lit("[^0]")) if bloom else F.octet_length(f) > 0

    paths = F.array(*(F.lit(p) for p in fs.paths())) if fs.fields else F.array().cast("array<string>")
    fields = F.zip_with(
        paths,
        token["fields"],
        lambda p, f: F.struct(F.coalesce(p, F.lit("")).alias("path"), F.coalesce(present(f), F.lit(False)).alias("present"), F.coalesce(F.octet_length(f), F.lit(0)).alias("byte_count")),
    )
    return F.struct(token["field_set_version"].alias("version"), token["key_id"].alias("key_id"), token["field_set_fingerprint"].alias("field_set_fingerprint"), fields.alias("fields"))


def describe(token: Column, bloom: bool = False) -> Column:
    """One log line without any byte of a field; here an absent Bloom field counts as present."""
    fields = token["fields"]
    present = F.size(F.filter(fields, lambda f: f.isNotNull()))
    total = F.aggregate(fields, F.lit(0), lambda acc, f: acc + F.coalesce(F.octet_length(f), F.lit(0)))
    head = [token["field_set_version"], token["key_id"], F.left(token["field_set_fingerprint"], F.lit(8))]
    if bloom:
        return F.format_string("ProbabilisticToken{v=%s key=%s fp=%s size=%db fields=%d/%d bytes=%d}", *head, token["params"]["size_bits"], present, F.size(fields), total)
    return F.format_string("DeterministicToken{v=%s key=%s fp=%s fields=%d/%d bytes=%d}", *head, present, F.size(fields), total)
