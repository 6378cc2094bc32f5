import math
import random

import pytest
from pyspark.sql import functions as F

from veilmatch.operators.evaluate import auprc, auroc, calibrate, confusion, group_by, latency_summary, mcc, numbered, percentile, pick_at, pick_best, positive_pairs, sample_negatives, sample_pairs, sample_positives, score_pairs, sweep, throughput
from veilmatch.operators.tokenize import comparable
from veilmatch.plans.schema import DATE, DEFAULT, NAME, FieldSet, FieldSpec, path
from veilmatch.plans.session import Session, calibrate_on, run, scored


def frame(spark, rows):
    return spark.createDataFrame(rows, "score double, label boolean")


def counted(rows, t):
    tp = sum(s >= t and y for s, y in rows)
    fp = sum(s >= t and not y for s, y in rows)
    return tp, fp, sum(not y for _, y in rows) - fp, sum(y for _, y in rows) - tp


@pytest.mark.parametrize("seed", range(3))
def test_sweep_like_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([rng.random(), rng.randint(0, 100) / 100, 0.29, 0.57, 1.0, 0.0]), rng.random() < 0.4) for _ in range(400)]
    got = sweep(frame(spark, rows)).orderBy("threshold").collect()
    assert len(got) == 101
    for k, r in enumerate(got):
        assert r["threshold"] == k / 100 and (r["tp"], r["fp"], r["tn"], r["fn"]) == counted(rows, k / 100)
        one = confusion(frame(spark, rows), k / 100).first() if k in (0, 29, 57, 100) else r
        assert one["f1"] == pytest.approx(r["f1"]) and one["mcc"] == pytest.approx(r["mcc"])


def by_steps(rows):
    """Areas by walking down the distinct scores."""
    p, n = sum(y for _, y in rows), sum(not y for _, y in rows)
    tp = fp = 0
    roc = ap = 0.0
    for s in sorted({s for s, _ in rows}, reverse=True):
        a, b = sum(y for x, y in rows if x == s), sum(not y for x, y in rows if x == s)
        if p and n:
            roc += b / n * (tp + tp + a) / p / 2
        tp, fp = tp + a, fp + b
        if p:
            ap += a / p * tp / (tp + fp)
    return roc, ap


@pytest.mark.parametrize("rows", [[(0.9, True), (0.8, True), (0.2, False)], [(0.1, True), (0.9, False)], [(0.5, True), (0.5, False)], [(0.5, True)], [(0.5, False)], [(0.3, True), (0.3, False), (0.7, False), (0.9, True), (0.1, True)]])
def test_areas(spark, rows):
    roc, ap = by_steps(rows)
    assert auroc(frame(spark, rows)).first()["auroc"] == pytest.approx(roc)
    assert auprc(frame(spark, rows)).first()["auprc"] == pytest.approx(ap)


def test_empty_areas(spark):
    empty = frame(spark, [(0.1, True)]).limit(0)
    assert auroc(empty).first()["auroc"] == 0 and auprc(empty).first()["auprc"] == 0


def test_mcc(spark):
    df = spark.createDataFrame([(10, 0, 10, 0), (0, 10, 0, 10), (5, 5, 5, 5), (3, 0, 0, 0), (10**10, 1, 10**10, 1)], "tp long, fp long, tn long, fn long")
    got = [r["m"] for r in df.select(mcc(*(F.col(c) for c in ("tp", "fp", "tn", "fn"))).alias("m")).collect()]
    assert got[:4] == [1.0, -1.0, 0.0, 0.0] and got[4] == pytest.approx(1.0)


def test_pickers(spark):
    points = spark.createDataFrame([(0.1, 0.5, 1.0, 0.66, 0.5), (0.5, 0.8, 0.9, 0.85, 0.9), (0.6, 0.8, 0.9, 0.85, 0.9), (0.9, 1.0, 0.4, 0.57, 0.7)], "threshold double, precision double, recall double, f1 double, accuracy double")
    assert pick_best(points, "f1").first()["threshold"] == 0.5
    assert pick_at(points, "recall", 0.85, "precision").first()["threshold"] == 0.5
    assert pick_at(points, "precision", 0.99, "recall").first()["threshold"] == 0.9
    assert pick_at(points, "recall", 1.1, "precision").first() is None


def test_calibrate_ties_go_low(spark):
    rows = [(0.9, True), (0.8, True), (0.2, False), (0.1, False)]
    assert calibrate(frame(spark, rows)).first()["threshold"] == 0.21


def test_latencies(spark):
    df = spark.createDataFrame([(k,) for k in range(1, 101)], "d long")
    assert tuple(latency_summary(df, "d", integral=True).first()) == (100, 50, 50, 95, 99, 100)
    assert percentile(df, "d", 2.0).first()["value"] == 100 and percentile(df, "d", -1).first()["value"] == 1
    none = latency_summary(df.limit(0), "d").first()
    assert none["count"] == 0 and none["mean"] == 0 and none["p50"] is None
    assert throughput(10, 2.0) == 5 and throughput(10, 0) == 0


def grouped(spark, sizes):
    rows, k = [], 0
    for g, n in enumerate(sizes):
        for _ in range(n):
            rows.append((k, f"g{g}"))
            k += 1
    return spark.createDataFrame(rows, "id long, canonical_id string")


@pytest.mark.parametrize("sizes", [(2, 2), (1, 3, 4), (5,), (1, 1)])
def test_positive_pairs(spark, sizes):
    df = grouped(spark, sizes)
    group = {r["id"]: r["canonical_id"] for r in df.collect()}
    got = {(r["a"], r["b"]) for r in positive_pairs(df).collect()}
    assert len(got) == sum(math.comb(n, 2) for n in sizes) and all(group[a] == group[b] and a < b for a, b in got)


def test_sampling(spark):
    df = grouped(spark, (3, 4, 2, 1, 5))
    group = {r["id"]: r["canonical_id"] for r in df.collect()}
    a, b = (sorted(map(tuple, sample_pairs(df, 8, 30, 5).collect())) for _ in range(2))
    assert a == b and len(a) == 38 and len({(x, y) for x, y, _ in a}) == 38
    assert all((group[x] == group[y]) == m for x, y, m in a)
    assert sample_positives(df, 1000, 1).count() == 3 + 6 + 1 + 10
    assert sorted(map(tuple, sample_pairs(df, 8, 30, 6).collect())) != a
    for bad in ((grouped(spark, (1, 1)), 1, 0), (grouped(spark, (3,)), 0, 1), (grouped(spark, (1, 1)), 0, 5), (df, 0, 0), (df, -1, 2)):
        with pytest.raises(ValueError):
            sample_pairs(*bad, 1)


def test_numbers_are_gapless(spark):
    df = grouped(spark, (700, 1, 3))
    got = {}
    for r in numbered(df, ["canonical_id"], "id").collect():
        got.setdefault(r["canonical_id"], []).append(r["k"])
    assert {g: sorted(k) for g, k in got.items()} == {"g0": list(range(700)), "g1": [0], "g2": [0, 1, 2]}


def test_areas_over_many_scores(spark):
    rng = random.Random(4)
    rows = [(rng.choice([rng.gauss(0, 5), round(rng.random(), 2)]), rng.random() < 0.3) for _ in range(3000)]
    roc, ap = by_steps(rows)
    assert auroc(frame(spark, rows)).first()["auroc"] == pytest.approx(roc)
    assert auprc(frame(spark, rows)).first()["auprc"] == pytest.approx(ap)


def test_negatives_are_uniform_over_groups(spark):
    df = grouped(spark, (200, 20, 20, 20, 20))
    group = {r["id"]: r["canonical_id"] for r in df.collect()}
    got = sample_negatives(df, 400, 3).collect()
    share = sum(group[r["a"]] == "g0" or group[r["b"]] == "g0" for r in got) / len(got)
    assert 0.3 < share < 0.5


TWINS = [
    ("alice", "Alice", "Smith", "1990-01-01"), ("alice", "Alicia", "Smith", "1990-01-01"), ("alice", "Alice", "Smyth", "1990-01-01"),
    ("bob", "Bob", "Jones", "1985-05-05"), ("bob", "Robert", "Jones", "1985-05-05"), ("carol", "Carol", "White", "1970-07-07"),
]


def twins(spark, country=None):
    given, family, birth = (str(path(ns, n)) for ns, n in ((NAME, "given"), (NAME, "family"), (DATE, "birth")))
    rows = [(k, c, {given: g, family: f, birth: d}) for k, (c, g, f, d) in enumerate(TWINS)]
    if country:
        rows[0][2][str(path("address", "country"))] = country
    return spark.createDataFrame(rows, "id long, canonical_id string, record map<string,string>")


FS = FieldSet("twins", tuple(FieldSpec(path(ns, n), False, w) for ns, n, w in ((NAME, "given", 2.0), (NAME, "family", 2.5), (DATE, "birth", 2.0), ("address", "country", 0.5))), DEFAULT)


def test_run_end_to_end(spark):
    session = Session(b"s", FS)
    a, b = (run(session, twins(spark, "USA"), 4, 6, 1, 0.5) for _ in range(2))
    assert {k: v for k, v in a.items() if k not in ("tokenize", "match")} == {k: v for k, v in b.items() if k not in ("tokenize", "match")}
    assert a["counts"] == {"records": 6, "positives": 4, "negatives": 6, "dropped_fields": {str(path("address", "country")): 1}}
    assert a["auroc"] == 1.0 and a["best_f1"]["f1"] == 1.0 and len(a["roc"]) == 101 and a["at_threshold"]["threshold"] == 0.5
    best = calibrate_on(session, twins(spark), 4, 6, 1)
    assert best["f1"] == 1.0 and 0 < best["threshold"] < 1
    assert scored(session, twins(spark), 4, 6, 1).where("label AND score > 0.5").count() == 4


def test_pairs_without_tokens_fail(spark):
    t = comparable(Session(b"s", FS).probabilistic(twins(spark).select("id", "record")))
    pairs = spark.createDataFrame([(0, 77, True)], "a long, b long, match boolean")
    with pytest.raises(Exception, match="names no record"):
        score_pairs(pairs, t, FS).collect()


def test_positives_of_a_large_group_come_from_its_size(spark):
    """20,000 records of one group make 200 million pairs; only those asked for are made."""
    df = spark.range(20_000).select("id", F.lit("all").alias("canonical_id")).unionByName(spark.range(20_000, 20_006).select("id", F.concat(F.lit("g"), (F.col("id") % 3).cast("string")).alias("canonical_id")))
    got = [(r["a"], r["b"]) for r in sample_positives(df, 500, 3).collect()]
    assert len(set(got)) == 500 and all(a < b < 20_000 or (b - a == 3 and a >= 20_000) for a, b in got)
    assert len({a for a, _ in got}) > 400


@pytest.mark.parametrize("want", [1, 7, 20, 40])
def test_every_number_is_a_pair(spark, want):
    df = grouped(spark, (4, 1, 5, 3, 8))
    every = {(r["a"], r["b"]) for r in positive_pairs(df).collect()}
    got = [(r["a"], r["b"]) for r in sample_positives(df, want, 2).collect()]
    assert len(got) == len(set(got)) == want and set(got) <= every


def test_groups(spark):
    got = {r["canonical_id"]: (r["ids"], r["n"]) for r in group_by(grouped(spark, (2, 1)).orderBy(F.desc("id"))).collect()}
    assert got == {"g0": ([0, 1], 2), "g1": ([2], 1)}


def test_pairs_are_mixed(spark):
    labels = [r["match"] for r in sample_pairs(grouped(spark, (6, 6, 6)), 40, 40, 1).collect()]
    assert 5 < sum(labels[:40]) < 35


def test_calibrate_needs_pairs(spark):
    with pytest.raises(ValueError, match="no pairs"):
        calibrate(frame(spark, [(0.1, True)]).limit(0))
