import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilmatch.llm.common import crc_mod, id_crc_mod
from veilmatch.llm.toxicity import Boosted, Chunks, NAMES, features, fit, isotonic, toxicity

RUDE = ["zorpo", "blarg", "snikka"]


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        ws = [rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", f"w{rng.randint(0, 300)}"]) for _ in range(rng.randint(5, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                ws.insert(rng.randint(0, len(ws)), rng.choice(RUDE) + rng.choice(["", "ish", ","]))
        docs.append((i, " ".join(ws)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_isotonic_like_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(20):
        x, y, w = rng.integers(0, 8, 30).astype(float), rng.integers(0, 2, 30).astype(float), rng.random(30) + 0.1
        knots, values = isotonic(x, y, w)
        got = np.interp(np.unique(x), knots, values)
        assert (np.diff(got) >= -1e-12).all()
        keys = np.unique(x)
        want = [max(min(np.average(y[(x >= a) & (x <= b)], weights=w[(x >= a) & (x <= b)]) for b in keys if b >= k) for a in keys if a <= k) for k in keys]
        assert np.allclose(got, want)


def test_features_by_hand():
    chunks = Chunks({"idiot": 3.0, "zorp*": 2.0})
    got = features([b"You IDIOT! zorpish x1 id10t", b"", b"aaaa ?", b"zorpo a b c d e f g you"], chunks)
    row = dict(zip(NAMES, got[0]))
    assert row["hit_rate"] == 3 / 5 and row["hidden_hits"] == 1 and row["distinct_hits"] == 2
    assert row["hit_near_second"] == 3 / 5 and row["second_rate"] == 1 / 5 and row["shout_rate"] == 1 / 5
    assert not got[1].any()
    assert dict(zip(NAMES, got[2]))["repeat_rate"] == 0.5
    assert dict(zip(NAMES, got[3]))["hit_near_second"] == 0
    alone = features([b"zorpo a b c d e f g you"], Chunks({"idiot": 3.0, "zorp*": 2.0}))
    assert np.allclose(alone[0], got[3])


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 2] < 0.3)).astype(float)
    model = Boosted.fit(x, y, np.ones(3000), np.arange(3000) % 4 == 0)
    test = rng.random((1000, 4))
    truth = (test[:, 0] > 0.5) & (test[:, 2] < 0.3)
    score = model.score(test)
    assert ((score > 0.5) == truth).mean() > 0.97 and score.min() >= 0 and score.max() <= 1


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    odd = [(None, None), (9001, ""), (9001, ""), (9002, "x " * 20000), (9003, None)]
    d = spark.createDataFrame([(*r, 0.5, "s") for r in docs + odd], "doc_id long, text string, score double, x string").repartition(3)
    lab = spark.createDataFrame([*labels, (None, 1), (1, None), (2, 7), (9002, 0), (3, 0), (3, 0)], "doc_id long, toxic int")
    model = fit(d, lab, id_crc_mod("doc_id", 4) != 2)
    assert any(t.startswith("zorp") for t in model.lexicon)
    rows = toxicity(d, model).collect()
    assert len(rows) == len(docs) + len(odd)
    got = {r["doc_id"]: r["score"] for r in rows}
    held = [i for i, _ in docs if crc_mod(i, 4) == 2]
    right = sum((got[i] >= 0.3) == bool(labels[i][1]) for i in held)
    assert right / len(held) > 0.97
    kept = toxicity(d, model, keep=True, name="tox")
    assert kept.columns == [*d.columns, "tox"] and kept.where("score = 0.5").count() == len(rows)
    assert toxicity(d.limit(0), model).count() == 0


def test_without_labels(spark):
    d = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity(d, fit(d, none, F.lit(True))).first()["score"] == 0.0
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity(d, fit(d, one, F.lit(True))).first()["score"] == 0.0


@pytest.mark.parametrize("value", [None, 0, 7, 123456789])
def test_crc_rule(spark, value):
    df = spark.createDataFrame([(value,)], "i long")
    assert df.select(id_crc_mod("i", 7).alias("m")).first()["m"] == crc_mod(value, 7)
