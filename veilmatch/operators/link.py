"""Linkage of two token tables.

Equality of deterministic tokens is an equi-join with a residual, as an empty
fingerprint matches any other. Probabilistic matches are scored on candidate
pairs of equal blocking keys. ``unblocked`` compares all pairs.

Pairs are scored in one of two ways that give the same rows. ``grid`` deals
each block into cells of at most ``cell_rows`` records a side, so no block,
however hot, meets in one task, and scores a cell's pairs on packed 64-bit
words in Arrow batches; a pair becomes a row only if it is returned. ``join``
is an ordinary join with column expressions over ``comparable`` tables. It
holds for streams too, and serves as the check of the other.
"""

from __future__ import annotations

import json
from typing import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.similarity import incompatible, match, per_field
from ..plans.schema import FieldSet


#: Records of a block that meet in one cell, a side, and words that are compared at once there; a cell's pairs leave in batches.
CELL_ROWS = 4096
STEP_WORDS = 2_000_000


def _equality_key(token: Column) -> Column:
    return F.transform(token["fields"], lambda f: F.coalesce(f, F.unhex(F.lit(""))))


def equal(a: Column, b: Column) -> Column:
    """Whether two deterministic tokens are equal; null and empty fields are the same."""
    fa, fb = a["field_set_fingerprint"], b["field_set_fingerprint"]
    return (
        (a["field_set_version"] == b["field_set_version"])
        & (a["key_id"] == b["key_id"])
        & ((fa == "") | (fb == "") | (fa == fb))
        & (_equality_key(a) == _equality_key(b))
    )


def link_equal(left: DataFrame, right: DataFrame, how: str = "inner", token: str = "token", skip_empty: bool = True) -> DataFrame:
    """Join on equal tokens; the right side's columns (but for semi and anti joins) get the suffix ``_r``.

    Tokens without any field present are all equal, a hot key of all pairs: they
    link with nothing unless ``skip_empty=False`` asks for them.
    """
    other = right.select(*(F.col(c).alias(f"{c}_r") for c in right.columns))
    on = equal(left[token], other[f"{token}_r"])
    if skip_empty:
        on = on & F.exists(left[token]["fields"], lambda f: F.coalesce(F.octet_length(f), F.lit(0)) > 0)
    return left.join(other, on, how)


def link_similar(
    left: DataFrame, right: DataFrame, fs: FieldSet, threshold: float, block: str | None = None, unblocked: bool = False, keep_all: bool = False, method: str = "grid", cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Pairs ``id, id_r, result`` with a match, of tables with ``id``, ``token`` and a ``block`` column.

    ``keep_all`` keeps candidate pairs below the threshold too. Incompatible
    tokens raise an error. Null blocks link with nothing.
    """
    if block is None and not unblocked:
        raise ValueError("give a blocking column, or ask for all pairs with unblocked=True")
    if not 0 <= threshold <= 1:
        raise ValueError(f"token: threshold must be in [0,1], got {threshold}")
    if method == "grid":
        return _link_by_grid(left, right, fs, threshold, block, keep_all, cell_rows)
    if method != "join":
        raise ValueError("method must be grid or join")
    names = ["id", "token", "words", "pops"]
    a = left.select(*names, *([F.col(block).alias("block")] if block else []))
    b = right.select(*(F.col(c).alias(f"{c}_r") for c in names), *([F.col(block).alias("block")] if block else []))
    pairs = a.join(b, "block") if block else a.crossJoin(b)
    why = incompatible(F.col("token"), F.col("token_r"))
    n = len(fs.fields)
    scores = per_field(F.col("words"), F.col("words_r"), F.col("pops"), F.col("pops_r"), n)
    result = match(scores, F.col("pops"), F.col("pops_r"), fs, threshold)
    checked = F.when(why.isNotNull() | (F.size("words") != n), F.raise_error(F.concat(F.lit("token: "), F.coalesce(why, F.lit("field count differs from the field set")))).cast("boolean")).otherwise(F.lit(True))
    out = pairs.where(checked).select("id", "id_r", result.alias("result"))
    return out if keep_all else out.where("result.is_match")


def _conflict(a: dict, b: dict, n: int) -> str | None:
    """Why two tokens' metadata can't be compared, in the order of ``incompatible``."""
    if a["v"] != b["v"]:
        return "version mismatch"
    if a["k"] != b["k"]:
        return "key id mismatch"
    if a["f"] and b["f"] and a["f"] != b["f"]:
        return "fingerprint mismatch"
    if a["p"] != b["p"]:
        return "params mismatch"
    if len(a["n"]) != len(b["n"]):
        return "field count mismatch"
    if a["n"] != b["n"]:
        return "field length mismatch"
    return None if len(a["n"]) == n else "field count differs from the field set"


def _link_by_grid(left: DataFrame, right: DataFrame, fs: FieldSet, threshold: float, block: str | None, keep_all: bool, cell_rows: int) -> DataFrame:
    def side(df: DataFrame) -> DataFrame:
        t = F.col("token")
        p = t["params"]
        sizes = F.transform(t["fields"], lambda f: F.coalesce(F.octet_length(f), F.lit(0)))
        known = F.struct(t["field_set_version"].alias("v"), t["key_id"].alias("k"), t["field_set_fingerprint"].alias("f"), F.struct(p["size_bits"], p["hash_count"], p["ngram_sizes"]).alias("p"), sizes.alias("n"))
        packed = F.transform(t["fields"], lambda f: F.coalesce(f, F.unhex(F.lit(""))))
        return df.select(F.col("id").alias("id"), (F.col(block) if block else F.lit(1)).alias("block"), packed.alias("fields"), F.to_json(known).alias("meta")).where("block IS NOT NULL")

    def cells(n: Column) -> Column:
        return F.greatest(F.ceil(n / cell_rows), F.lit(1)).cast("int")

    a, b = side(left), side(right)
    sizes_a, sizes_b = (x.groupBy("block").agg(F.count("*").alias(n)) for x, n in ((a, "na"), (b, "nb")))
    sizes = sizes_a.join(sizes_b, "block").select("block", cells(F.col("na")).alias("ca"), cells(F.col("nb")).alias("cb"))
    rest = ["block", "fields", "meta"]
    own = F.pmod(F.xxhash64("id"), F.col("ca")).cast("int")
    a = a.join(sizes, "block").select("id", F.lit(None).cast(right.schema["id"].dataType).alias("id_r"), *rest, own.alias("i"), F.explode(F.sequence(F.lit(0), F.col("cb") - 1)).alias("j"), F.lit(True).alias("left"))
    own = F.pmod(F.xxhash64("id"), F.col("cb")).cast("int")
    b = b.join(sizes, "block").select(F.lit(None).cast(left.schema["id"].dataType).alias("id"), F.col("id").alias("id_r"), *rest, F.explode(F.sequence(F.lit(0), F.col("ca") - 1)).alias("i"), own.alias("j"), F.lit(False).alias("left"))

    weights, n = [f.weight for f in fs.fields], len(fs.fields)
    schema = T.StructType([T.StructField("id", left.schema["id"].dataType), T.StructField("id_r", right.schema["id"].dataType), *T.StructType.fromDDL("score double, per_field array<double>, is_match boolean, comparable_fields int")])

    def compare(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        held = pa.Table.from_batches(list(batches))
        x, y = (held.filter(m).combine_chunks() for m in (held.column("left"), pc.invert(held.column("left"))))
        if not len(x) or not len(y):
            return
        metas = [{m: json.loads(m) for m in set(t.column("meta").to_pylist())} for t in (x, y)]
        for p in metas[0].values():
            for q in metas[1].values():
                if why := _conflict(p, q, n):
                    raise ValueError(f"token: {why}")

        def fields(t):
            rows = t.column("fields").to_pylist()
            out = [np.frombuffer(b"".join(r[k] for r in rows), np.uint64).reshape(len(rows), -1) for k in range(n)]
            return out, [np.bitwise_count(f).sum(1, dtype=np.int64) for f in out]

        (fx, px), (fy, py) = fields(x), fields(y)
        own, other = x.column("id").combine_chunks(), y.column("id_r").combine_chunks()
        step = max(1, STEP_WORDS // (len(y) * max(f.shape[1] for f in fx) or 1)) if n else max(1, STEP_WORDS // len(y))
        for at in range(0, len(x), step):
            rows = slice(at, min(at + step, len(x)))
            top = np.zeros((rows.stop - at, len(y)))
            bottom, used, each = np.zeros_like(top), np.zeros(top.shape, np.int32), []
            for k, w in enumerate(weights):
                common = np.bitwise_count(fx[k][rows, None, :] & fy[k][None, :, :]).sum(2, dtype=np.int64)
                total = px[k][rows, None] + py[k][None, :]
                d = np.divide(2.0 * common, total, out=np.zeros_like(top), where=total > 0)
                each.append(d)
                if w > 0:
                    counts = total > 0
                    top += np.where(counts, w * d, 0.0)
                    bottom += np.where(counts, w, 0.0)
                    used += counts
            value = np.divide(top, bottom, out=np.zeros_like(top), where=used > 0)
            hit = (used > 0) & (value >= threshold)
            i, j = np.nonzero(np.ones_like(hit) if keep_all else hit)
            if not len(i):
                continue
            per = np.stack([d[i, j] for d in each], 1) if each else np.zeros((len(i), 0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(i) + 1, dtype=np.int32) * n), pa.array(per.ravel()))
            columns = [own.take(pa.array(i + at)), other.take(pa.array(j)), pa.array(value[i, j]), lists.cast(kinds.field("per_field").type), pa.array(hit[i, j]), pa.array(used[i, j])]
            yield pa.RecordBatch.from_arrays(columns, schema=kinds)

    import pyarrow as pa

    compare.__annotations__ = {"key": tuple, "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    found = a.unionByName(b).groupBy("block", "i", "j").applyInArrow(compare, schema)
    paths = F.array(*map(F.lit, fs.paths())) if n else F.array().cast("array<string>")
    return found.select("id", "id_r", F.struct("score", "per_field", paths.alias("paths"), "is_match", "comparable_fields").alias("result"))


def best_match(pairs: DataFrame) -> DataFrame:
    """The highest score of each left id; ties go to the smallest right id."""
    order = Window.partitionBy("id").orderBy(F.desc("result.score"), "id_r")
    return pairs.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")
