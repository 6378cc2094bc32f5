import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilmatch.llm import scoring
from veilmatch.llm.scoring import blocks, fit, grams_of, log_gamma, score, tree_log10, windows


class Tree:
    """A context tree by the book: block probabilities by sequential updates."""

    def __init__(self, depth):
        self.depth, self.counts = depth, {}

    def add(self, context, prefix, bit, times):
        for d in range(self.depth + 1):
            n = self.counts.setdefault((d, context[len(context) - d:], prefix), [0, 0])
            n[bit] += times

    def block(self, d, context, prefix):
        a, b = self.counts.get((d, context, prefix), (0, 0))
        kt = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)
        if d == self.depth:
            return kt, kt
        below = sum(self.block(d + 1, c, p)[1] for dd, c, p in self.counts if dd == d + 1 and p == prefix and c[1:] == context)
        return kt, np.logaddexp(kt, below) - math.log(2)

    def chance(self, context, prefix, bit):
        p = None
        for d in range(self.depth, -1, -1):
            c = context[len(context) - d:]
            a, b = self.counts.get((d, c, prefix), (0, 0))
            own = ((b if bit else a) + 0.5) / (a + b + 1)
            if p is None:
                p = own
            else:
                kt, whole = self.block(d, c, prefix)
                share = math.exp(kt - math.log(2) - whole)
                p = share * own + (1 - share) * p if deeper else own
            deeper = a + b > 0
        return p


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 2, 3.25, 10, 1e3, 1e9])
    assert np.allclose(log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_tree_like_brute_force(depth):
    words = [b"abab", b"abc", b"a", b"bca", b"\n", b"zz"]
    counts = [5, 3, 2, 1, 4, 0]
    codes, per = grams_of(words, depth)
    tree = Tree(depth)
    weights = np.repeat(counts, per)
    for code, n in zip(codes.tolist(), weights.tolist()):
        raw = code.to_bytes(depth + 1, "big")
        for k in range(8):
            if n:
                tree.add(raw[:depth], 1 << k | raw[-1] >> 8 - k, raw[-1] >> 7 - k & 1, n)
    keys, inverse = np.unique(codes, return_inverse=True)
    got = tree_log10(keys, np.bincount(inverse, weights).astype(float), depth)
    for code, value in zip(keys.tolist(), got):
        raw = code.to_bytes(depth + 1, "big")
        want = sum(math.log10(tree.chance(raw[:depth], 1 << k | raw[-1] >> 8 - k, raw[-1] >> 7 - k & 1)) for k in range(8))
        assert abs(want - value) < 1e-9


def test_base_and_scores(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["the", "The", "cat", "x\x1cy", "é", f"w{rng.randint(0, 40)}"]) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    docs += [(None, None), (7, ""), (8, "rare \t\x0bword"), (8, "rare \t\x0bword"), (9, "long " * 3000)]
    df = spark.createDataFrame([(i, t, "q", i is None or i % 3 != 0) for i, t in docs], "doc_id long, text string, score string, train boolean").repartition(3)
    want = None

    def tok(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x20\x09-\x0D]+", low) + ["\n"]

    c = Counter(w for i, t in docs if i is None or i % 3 for w in tok(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(tok(t)), sum(c[w] > 0 for w in tok(t)), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tok(t)), 6)) for i, t in docs)
    scores = []
    for head in (10**6, 5, 0):
        model = fit(df, F.col("train"), head=head, depth=3)
        assert (model.train_tokens, model.train_types) == (n, v)
        rows = score(df, model).collect()
        assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in rows) == want
        scores.append(sorted(round(r["score"], 6) for r in rows))
    assert scores[0] == scores[1] == scores[2]
    empty = df.limit(0)
    assert score(empty, fit(empty, F.col("train"))).count() == 0
    none = score(df, fit(df, F.lit(None).cast("boolean")))
    assert none.where("n_known > 0").count() == 0


def test_texts_that_fit_did_not_meet(spark):
    """They get what they would have got as rows of ``fit`` that are not for training."""
    learn = [(1, "abc abd abc"), (2, "abd xyz"), (3, None)]
    asked = [(4, "abc abd"), (5, "never seen \u00e9"), (6, ""), (7, "zzz abc"), (7, "zzz abc")]
    ddl = "doc_id long, text string"
    whole = spark.createDataFrame([(*r, r in learn) for r in learn + asked], f"{ddl}, train boolean")
    want = {r["doc_id"]: r for r in score(whole, fit(whole, F.col("train"), depth=4)).collect()}
    for head in (10**6, 2, 0):
        model = fit(spark.createDataFrame(learn, ddl), F.lit(True), depth=4, head=head)
        rows = score(spark.createDataFrame(asked, ddl), model).collect()
        assert sorted(r["doc_id"] for r in rows) == [4, 5, 6, 7, 7]
        for r in rows:
            for name in ("n_tokens", "n_bytes", "n_known", "base_score", "score"):
                assert r[name] == pytest.approx(want[r["doc_id"]][name], abs=1e-9)


def test_long_texts_are_cut_without_loss(monkeypatch):
    texts = [b" Ab\tcde", b"", b"x" * 50 + b"  " + b"yz" * 30]
    want, lengths = grams_of([scoring.normal(t) for t in texts], 3)
    for size in (1, 7, 64, 10**6):
        monkeypatch.setattr(scoring, "BLOCK_BYTES", size)
        got = [[] for _ in texts]
        for numbers, parts in blocks(texts, 3):
            codes, places = windows(parts, 3)
            for k, piece in zip(numbers, np.split(codes, np.cumsum(places)[:-1])):
                got[k] += piece.tolist()
        assert [len(g) for g in got] == lengths.tolist()
        assert sum(got, []) == want.tolist()


def test_chances_sum_to_one():
    words = [b"abc", b"abd", b"\xc3\xa9", b"\n"]
    codes, per = grams_of(words, 2)
    n = np.repeat([4.0, 2.0, 1.0, 3.0], per)
    for context in {c >> 8 for c in codes.tolist()} | {0x7171}:
        asked = np.array([context << 8 | b for b in range(256)], np.uint64)
        keys, inverse = np.unique(np.concatenate([codes, asked]), return_inverse=True)
        got = tree_log10(keys, np.bincount(inverse, np.concatenate([n, np.zeros(256)])), 2)
        assert abs((10 ** got[np.searchsorted(keys, asked)]).sum() - 1) < 1e-9


def test_tree_in_tables(spark, monkeypatch):
    """It gives what one tree over all grams gives, for more grams than a task works on at once."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefghij ") for _ in range(400)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for name, value in (("BLOCK_GRAMS", 50), ("ROW_GRAMS", 7), ("FLUSH_GRAMS", 900), ("BLOCK_BYTES", 1000)):
        monkeypatch.setattr(scoring, name, value)
    for depth in (1, 2, 3, 6):
        model = fit(df, F.col("doc_id") % 4 != 1, depth=depth, head=3)
        all_codes, learned = Counter(), Counter()
        for i, text in enumerate(texts):
            own = grams_of([scoring.normal(text.encode())], depth)[0].tolist()
            all_codes.update(own)
            learned.update(own if i % 4 != 1 else [])
        keys = np.array(sorted(all_codes), np.uint64)
        want = tree_log10(keys, np.array([float(learned[g]) for g in keys.tolist()]), depth)
        got = model.grams.orderBy("gram").toPandas()
        assert got["gram"].tolist() == keys.tolist() and got["n"].tolist() == [all_codes[g] for g in keys.tolist()]
        assert np.allclose(got["s"], want, rtol=0, atol=1e-9)


def test_contexts_reach_into_the_words_before(spark):
    """A text's score depends on the order of its words, and is the sum over the bytes of the whole text."""
    docs = [(1, "Red fox  ran", True), (2, "red fox ate", True), (3, "red fox ran", False), (4, "ran fox red", False), (5, None, True)]
    df = spark.createDataFrame(docs, "doc_id long, text string, train boolean")
    rows = {}
    for head in (100, 0):
        rows = {r["doc_id"]: r for r in score(df, fit(df, F.col("train"), depth=5, head=head)).collect()}
        texts = [b"     red fox ran \n", b"     red fox ate \n", b"     red fox ran \n", b"     ran fox red \n", b"     \n"]
        grams = [[int.from_bytes(t[k: k + 6], "big") for k in range(len(t) - 5)] for t in texts]
        learned = Counter(grams[0] + grams[1] + grams[4])
        keys = sorted(set().union(*grams))
        value = dict(zip(keys, tree_log10(np.array(keys, np.uint64), np.array([float(learned[g]) for g in keys]), 5)))
        for i, own in enumerate(grams, 1):
            assert rows[i]["score"] == pytest.approx(sum(value[g] for g in own), abs=1e-9)
    assert rows[3]["score"] > rows[4]["score"] + 1
    assert rows[3]["base_score"] == pytest.approx(rows[4]["base_score"])
