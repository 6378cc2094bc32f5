"""Linkage quality over scores and labels, and sampling of labelled pairs.

Every metric starts from an aggregation by score or threshold bin, so what is
ordered afterwards is small: 101 bins, or the distinct scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.choice import digits, pick
from ..plans.schema import FieldSet

STEPS = 100
#: Ranges of scores that running sums are split into, and buckets for numbering rows.
BINS = 4096
BUCKETS = 256


def safe_ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top.cast("double") / bottom)


def mcc(tp: Column, fp: Column, tn: Column, fn: Column) -> Column:
    """Matthews correlation; 0 when a margin is empty. Doubles, as counts would overflow."""
    p, q, r, s = (c.cast("double") for c in (tp, fp, tn, fn))
    bottom = F.sqrt((p + q) * (p + s) * (r + q) * (r + s))
    return F.when(bottom == 0, F.lit(0.0)).otherwise((p * r - q * s) / bottom)


def _ratios(df: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    out = df.withColumn("precision", safe_ratio(tp, tp + fp)).withColumn("recall", safe_ratio(tp, tp + fn))
    p, r = F.col("precision"), F.col("recall")
    return (
        out.withColumn("f1", F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)))
        .withColumn("accuracy", safe_ratio(tp + tn, tp + fp + tn + fn))
        .withColumn("fpr", safe_ratio(fp, fp + tn))
        .withColumn("mcc", mcc(tp, fp, tn, fn))
    )


def confusion(df: DataFrame, threshold: float, score: str = "score", label: str = "label") -> DataFrame:
    """One row of counts and ratios at a threshold; ``score >= threshold`` is a match."""
    hit, true = F.col(score) >= threshold, F.col(label)
    return _ratios(df.agg(F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & ~true).alias("tn"), F.count_if(~hit & true).alias("fn"))).withColumn(
        "threshold", F.lit(float(threshold))
    )


def sweep(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Operating points at 0.00, 0.01, ... 1.00: one pass by bin, then a running sum over 101 rows."""
    s = F.col(score)
    low = F.floor(s * STEPS)
    bin_ = F.when(s >= (low + 1) / F.lit(float(STEPS)), low + 1).when(s < low / F.lit(float(STEPS)), low - 1).otherwise(low)
    binned = df.select(F.greatest(F.least(bin_, F.lit(STEPS)), F.lit(-1)).cast("int").alias("k"), F.col(label).alias("y"))
    counts = binned.groupBy("k").agg(F.count_if("y").alias("p"), F.count_if(~F.col("y")).alias("n"))
    grid = counts.sparkSession.range(-1, STEPS + 1).select(F.col("id").cast("int").alias("k")).join(counts, "k", "left").na.fill(0, ["p", "n"])
    down = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summed = grid.select("k", F.sum("p").over(down).alias("tp"), F.sum("n").over(down).alias("fp"), F.sum("p").over(every).alias("P"), F.sum("n").over(every).alias("N"))
    points = summed.where("k >= 0").select((F.col("k") / F.lit(float(STEPS))).alias("threshold"), "tp", "fp", (F.col("N") - F.col("fp")).alias("tn"), (F.col("P") - F.col("tp")).alias("fn"))
    return _ratios(points)


def pick_best(points: DataFrame, by: str) -> DataFrame:
    """The operating point with the highest value; ties go to the lowest threshold."""
    return points.agg(F.max_by(F.struct(*points.columns), F.struct(F.col(by), -F.col("threshold"))).alias("p")).select("p.*")


def pick_at(points: DataFrame, floor_of: str, floor: float, by: str) -> DataFrame:
    """The highest ``by`` among points whose ``floor_of`` is at least ``floor``; no row when none is."""
    return pick_best(points.where(F.col(floor_of) >= floor), by).where("threshold IS NOT NULL")


def calibrate(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """``threshold, precision, recall, f1`` of the best F1 (ties: lowest threshold); an empty table raises ValueError."""
    if df.isEmpty():
        raise ValueError("no pairs to calibrate on")
    return pick_best(sweep(df, score, label), "f1").select("threshold", "precision", "recall", "f1")


def _blocks(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row for each distinct score: its positives and negatives, running sums from the top, totals.

    Scores fall into ``BINS`` ranges; sums run inside each range, after the
    sums of the ranges above, of which there are few.
    """
    by = df.groupBy(F.col(score).alias("s")).agg(F.count_if(label).alias("p"), F.count_if(~F.col(label)).alias("n"))
    ends = by.agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    share = F.when(F.col("hi") > F.col("lo"), (F.col("s") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    binned = by.crossJoin(F.broadcast(ends)).withColumn("bin", F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int"))
    above = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    sums = binned.groupBy("bin").agg(F.sum("p").alias("bp"), F.sum("n").alias("bn"))
    sums = sums.select("bin", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(o) for c, o in (("bp", "over_p"), ("bn", "over_n"))))
    down = Window.partitionBy("bin").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return binned.join(F.broadcast(sums), "bin").select(
        "s", "p", "n", (F.sum("p").over(down) + F.col("over_p")).alias("tp"), (F.sum("n").over(down) + F.col("over_n")).alias("fp"), "all_p", "all_n"
    )


def auroc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Area under the ROC curve, ties as one block; 0 when a class is empty."""
    b = _blocks(df, score, label)
    # whole numbers up to the one division, so that a perfect order gives exactly 1
    twice = F.sum((F.col("n").cast("decimal(19,0)") * (2 * F.col("tp") - F.col("p")).cast("decimal(19,0)")).cast("decimal(38,0)"))
    area = twice.cast("double") / (2.0 * F.max("all_p") * F.max("all_n"))
    return b.where("all_p > 0 AND all_n > 0").agg(F.coalesce(area, F.lit(0.0)).alias("auroc"))


def auprc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Average precision over distinct scores; 0 without positives."""
    b = _blocks(df, score, label)
    return b.where("all_p > 0").agg(F.coalesce(F.sum(F.col("p") / F.col("all_p") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.lit(0.0)).alias("auprc"))


def latency_summary(df: DataFrame, column: str, integral: bool = False) -> DataFrame:
    """``count, mean, p50, p95, p99, max``; percentiles by nearest rank."""
    c = F.col(column)
    mean = F.expr(f"sum(`{column}`) div count(`{column}`)") if integral else F.avg(c)
    ranks = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{column}`)").alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)]
    return df.agg(F.count(c).alias("count"), F.coalesce(mean, F.lit(0)).alias("mean"), *ranks, F.max(c).alias("max"))


def percentile(df: DataFrame, column: str, p: float) -> DataFrame:
    p = min(1.0, max(0.0, p))
    return df.agg(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{column}`)").alias("value"))


def throughput(n: int, seconds: float) -> float:
    return n / seconds if seconds > 0 else 0.0


# ---------------------------------------------------------------- labelled pairs


def positive_pairs(df: DataFrame, group: str = "canonical_id", id_col: str = "id") -> DataFrame:
    """``a, b`` with a < b for every two records of one group."""
    a = df.select(F.col(group).alias("g"), F.col(id_col).alias("a"))
    b = df.select(F.col(group).alias("g"), F.col(id_col).alias("b"))
    return a.join(b, "g").where("a < b").select("a", "b")


def group_by(df: DataFrame, group: str = "canonical_id", id_col: str = "id") -> DataFrame:
    """``group, ids, n``: each group's ids in ascending order. A group is one row here; ``numbered`` holds for groups of any size."""
    return df.groupBy(group).agg(F.array_sort(F.collect_list(id_col)).alias("ids"), F.count("*").alias("n"))


def numbered(df: DataFrame, within: list[str], by: str) -> DataFrame:
    """``df`` with ``k``, which numbers the rows of each group from 0 in a fixed order.

    Rows are numbered in buckets by a hash, after the counts of the buckets
    before, so that no group meets in one task.
    """
    rows = df.withColumn("__b", pick(F.col(by), "number", BUCKETS).cast("int"))
    before = Window.partitionBy(*within).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*within, "__b").agg(F.count("*").alias("__n")).withColumn("__o", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy(*within, "__b").orderBy(by)
    out = rows.withColumn("__k", F.row_number().over(inside) - 1).join(counts, [*within, "__b"])
    return out.withColumn("k", (F.col("__k") + F.col("__o")).cast("long")).drop("__b", "__k", "__o")


def _first_draws(make, want: int, most: int) -> DataFrame | None:
    """The first ``want`` distinct rows (by ``id``, the draw that gives them) of ``make(draws)``; None if ``most`` draws hold fewer."""
    tries = min(most, 2 * want + 1000)
    while True:
        out = make(tries).orderBy("id").limit(want)
        if out.count() >= want:
            return out
        if tries >= most:
            return None
        tries = min(most, 8 * tries)


def sample_positives(df: DataFrame, want: int, seed: int, group: str = "canonical_id", id_col: str = "id") -> DataFrame:
    """All positive pairs, or ``want`` of them chosen by a hash of the seed.

    Pairs are numbered from the groups' sizes and only chosen numbers become
    pairs, so that a group of n records never gives its n * n / 2 pairs.
    """
    spark = df.sparkSession
    records = numbered(df.select(F.col(group).alias("g"), F.col(id_col).alias("r")).where("g IS NOT NULL"), ["g"], "r")
    sizes = records.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g", (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"))
    sizes = sizes.withColumn("b", pick(F.col("g"), "number", BUCKETS).cast("int"))
    found = sorted((r["b"], r["p"]) for r in sizes.groupBy("b").agg(F.sum("pairs").alias("p")).collect())
    total, bounds = 0, []
    for b, p in found:
        bounds.append((b, total, total + p))
        total += p
    if total <= want:
        return positive_pairs(df, group, id_col)
    if total <= 4 * want:
        chosen = spark.range(total).withColumnRenamed("id", "number").orderBy(digits(F.col("number"), f"{seed} pair"), "number").limit(want)
    else:
        chosen = _first_draws(lambda tries: spark.range(tries).groupBy(pick(F.col("id"), f"{seed} pair", total).alias("number")).agg(F.min("id").alias("id")), want, 100 * want + 1000)
        if chosen is None:
            raise ValueError(f"fewer than {want} distinct positive pairs found")
    place = spark.createDataFrame(bounds, "b int, lo long, hi long")
    chosen = chosen.select("number").join(F.broadcast(place), (F.col("number") >= F.col("lo")) & (F.col("number") < F.col("hi")))
    before = Window.partitionBy("b").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("b", "g", F.coalesce(F.sum("pairs").over(before), F.lit(0)).alias("start"))
    wanted = chosen.select("b", (F.col("number") - F.col("lo")).alias("at"))
    both = starts.select("b", F.col("start").alias("at"), "g", "start").unionByName(wanted, allowMissingColumns=True)
    up_to = Window.partitionBy("b").orderBy("at", F.col("start").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = both.select("start", F.last("g", True).over(up_to).alias("g"), (F.col("at") - F.last("start", True).over(up_to)).alias("p")).where("start IS NULL")
    guess = F.floor((F.sqrt(8 * F.col("p") + 1) + 1) / 2).cast("long")
    high = F.when(guess * (guess - 1) / 2 > F.col("p"), guess - 1).when(guess * (guess + 1) / 2 <= F.col("p"), guess + 1).otherwise(guess)
    pairs = placed.select("g", "p", high.alias("j")).select("g", "j", (F.col("p") - (F.col("j") * (F.col("j") - 1) / 2).cast("long")).alias("i"))
    out = pairs.join(records.select("g", F.col("k").alias("i"), F.col("r").alias("x")), ["g", "i"]).join(records.select("g", F.col("k").alias("j"), F.col("r").alias("y")), ["g", "j"])
    return out.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def sample_negatives(df: DataFrame, want: int, seed: int, group: str = "canonical_id", id_col: str = "id") -> DataFrame:
    """``want`` pairs of different groups, uniform over groups first, then over a group's records.

    The first distinct pairs of up to ``100 * want + 1000`` draws, in rounds
    that grow; raises ValueError when they hold fewer.
    """
    spark = df.sparkSession
    records = df.select(F.col(group).alias("g"), F.col(id_col).alias("r"))
    records = numbered(records, ["g"], "r")
    sizes = records.groupBy("g").agg(F.count("*").alias("n"))
    groups = numbered(sizes.withColumn("all", F.lit(1)), ["all"], "g").select("g", "n", F.col("k").alias("place"))
    n = groups.count()
    if n < 2:
        raise ValueError("need at least two groups for negative pairs")

    def make(tries):
        draws = spark.range(tries).select("id", *(pick(F.col("id"), f"{seed} {side} group", n).alias(f"{side}_place") for side in ("left", "right"))).where("left_place <> right_place")
        for side, name in (("left", "x"), ("right", "y")):
            chosen = draws.join(groups.select(F.col("place").alias(f"{side}_place"), "g", "n"), f"{side}_place").withColumn("k", pick(F.col("id"), f"{seed} {side} record", F.col("n")))
            draws = chosen.join(records, ["g", "k"]).drop("g", "k", "n", f"{side}_place").withColumnRenamed("r", name)
        return draws.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "id").groupBy("a", "b").agg(F.min("id").alias("id"))

    out = _first_draws(make, want, 100 * want + 1000) if want else spark.range(0).select(F.lit(None).cast(df.schema[id_col].dataType).alias("a"), F.lit(None).cast(df.schema[id_col].dataType).alias("b"))
    if out is None:
        raise ValueError(f"fewer than {want} distinct negative pairs found")
    return out.select("a", "b")


def sample_pairs(df: DataFrame, positives: int, negatives: int, seed: int, group: str = "canonical_id", id_col: str = "id") -> DataFrame:
    """``a, b, match`` in mixed order; the same rows for the same seed."""
    if positives < 0 or negatives < 0 or positives + negatives == 0:
        raise ValueError("ask for at least one pair")
    pos = sample_positives(df, positives, seed, group, id_col).withColumn("match", F.lit(True))
    if positives and pos.isEmpty():
        raise ValueError("no group has two records")
    out = pos if positives else pos.limit(0)
    if negatives:
        out = out.unionByName(sample_negatives(df, negatives, seed, group, id_col).withColumn("match", F.lit(False)))
    return out.orderBy(digits(F.concat_ws(":", "a", "b"), f"{seed} order"), "a", "b")


def _timed_scores(a: Column, b: Column) -> Column:
    """``struct<scores, ns>``: the Dice scores of two tokens' fields, and the nanoseconds that each pair took."""

    @F.arrow_udf("struct<scores: array<double>, ns: bigint>")
    def compare(left, right):
        import time

        import numpy as np
        import pyarrow as pa

        scores, ns = [], []
        for x, y in zip(left.to_pylist(), right.to_pylist()):
            x, y = ([np.array(f, np.int64).view(np.uint64) for f in t] for t in (x, y))
            began = time.perf_counter_ns()
            each = []
            for f, g in zip(x, y):
                total = int(np.bitwise_count(f).sum()) + int(np.bitwise_count(g).sum())
                each.append(2.0 * int(np.bitwise_count(f & g).sum()) / total if total else 0.0)
            ns.append(time.perf_counter_ns() - began)
            scores.append(each)
        return pa.StructArray.from_arrays([pa.array(scores, pa.list_(pa.float64())), pa.array(ns, pa.int64())], ["scores", "ns"])

    return compare(a, b)


def score_pairs(pairs: DataFrame, tokens: DataFrame, fs: FieldSet, threshold: float = 0.5, timed: bool = False) -> DataFrame:
    """``a, b, label, score, result`` of labelled pairs (if ``timed``, with ``ns`` too); a pair without its tokens raises an error."""
    from ..functions.similarity import match, per_field

    t = tokens.select("id", "words", "pops")
    left = t.select(F.col("id").alias("a"), F.col("words").alias("wa"), F.col("pops").alias("pa"))
    right = t.select(F.col("id").alias("b"), F.col("words").alias("wb"), F.col("pops").alias("pb"))
    rows = pairs.join(left, "a", "left").join(right, "b", "left")
    found = F.when(F.col("wa").isNull() | F.col("wb").isNull(), F.raise_error(F.lit("a pair names no record")).cast("boolean")).otherwise(F.lit(True))
    rows = rows.where(found)
    if timed:
        rows = rows.withColumn("__t", _timed_scores(F.col("wa"), F.col("wb")))
        scores = [F.col("__t.scores")[k] for k in range(len(fs.fields))]
    else:
        scores = per_field(F.col("wa"), F.col("wb"), F.col("pa"), F.col("pb"), len(fs.fields))
    result = match(scores, F.col("pa"), F.col("pb"), fs, threshold).alias("result")
    out = rows.select("a", "b", F.col("match").alias("label"), result, *([F.col("__t.ns").alias("ns")] if timed else []))
    return out.withColumn("score", F.col("result.score"))
