"""Comparison of tokens as Spark columns: Dice, weighted scores, the match decision.

Filters are compared as ``array<bigint>`` words, 64 bits at a time. A token for
comparison holds ``words`` and ``pops`` (set bits of each field); both are
made once for a record, never for a pair.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.schema import FieldSet


def popcount(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda acc, w: acc + F.bit_count(w))


def dice(a: Column, b: Column, pop_a: Column, pop_b: Column) -> Column:
    """2 |a and b| / (|a| + |b|); 0 when both are empty."""
    common = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda acc, n: acc + n)
    return F.when(pop_a + pop_b == 0, F.lit(0.0)).otherwise(F.lit(2.0) * common / (pop_a + pop_b))


def incompatible(a: Column, b: Column) -> Column:
    """Why two Bloom tokens can't be compared, in fixed order; null when they can."""
    fa, fb = a["field_set_fingerprint"], b["field_set_fingerprint"]
    pa, pb = a["params"], b["params"]
    same = (pa["size_bits"] == pb["size_bits"]) & (pa["hash_count"] == pb["hash_count"]) & (pa["ngram_sizes"] == pb["ngram_sizes"])
    uneven = F.exists(F.zip_with(a["fields"], b["fields"], lambda x, y: F.coalesce(F.octet_length(x), F.lit(0)) != F.coalesce(F.octet_length(y), F.lit(0))), lambda x: x)
    return (
        F.when(a["field_set_version"] != b["field_set_version"], "version mismatch")
        .when(a["key_id"] != b["key_id"], "key id mismatch")
        .when((fa != "") & (fb != "") & (fa != fb), "fingerprint mismatch")
        .when(~same, "params mismatch")
        .when(F.size(a["fields"]) != F.size(b["fields"]), "field count mismatch")
        .when(uneven, "field length mismatch")
    )


def per_field(a_words: Column, b_words: Column, a_pops: Column, b_pops: Column, n: int) -> list[Column]:
    return [dice(a_words[k], b_words[k], a_pops[k], b_pops[k]) for k in range(n)]


def score(scores: list[Column], fs: FieldSet) -> Column:
    """Weighted mean over the fields of positive weight, folded in field order."""
    used = [(s, f.weight) for s, f in zip(scores, fs.fields, strict=True) if f.weight > 0]
    if not used:
        raise ValueError("token: no comparable fields")
    return reduce(lambda acc, x: acc + x[0] * x[1], used, F.lit(0.0)) / sum(w for _, w in used)


def match(scores: list[Column], a_pops: Column, b_pops: Column, fs: FieldSet, threshold: float) -> Column:
    """``struct<score, per_field, paths, is_match, comparable_fields>``.

    Fields empty on both sides drop out; a field empty on one side counts as 0.
    Without comparable fields there is no match, even at threshold 0.
    """
    if not 0 <= threshold <= 1:
        raise ValueError(f"token: threshold must be in [0,1], got {threshold}")
    top, bottom, count = F.lit(0.0), F.lit(0.0), F.lit(0)
    for k, (s, f) in enumerate(zip(scores, fs.fields, strict=True)):
        if f.weight <= 0:
            continue
        counts = (a_pops[k] > 0) | (b_pops[k] > 0)
        top = top + F.when(counts, s * f.weight).otherwise(0.0)
        bottom = bottom + F.when(counts, F.lit(f.weight)).otherwise(0.0)
        count = count + F.when(counts, 1).otherwise(0)
    value = F.when(count > 0, top / bottom).otherwise(0.0)
    return F.struct(
        value.alias("score"),
        F.array(*scores).alias("per_field"),
        F.array(*(F.lit(p) for p in fs.paths())).alias("paths"),
        ((count > 0) & (value >= threshold)).alias("is_match"),
        count.alias("comparable_fields"),
    )


def by_path(result: Column) -> Column:
    """Map from path to score of a match result."""
    return F.map_from_arrays(result["paths"], result["per_field"])


def score_for(result: Column, path: str) -> Column:
    return F.try_element_at(by_path(result), F.lit(path))
