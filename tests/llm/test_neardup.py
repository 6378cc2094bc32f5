import random
import re

import numpy as np
import pytest

from veilmatch.llm.neardup import bands_for, components, deduplicate, near_duplicates, shingles, Signer


def sets_of(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(ws[i: i + k]) for i in range(len(ws) - k + 1)) if len(ws) >= k else frozenset([tuple(ws)] if ws else [])


def brute(docs, k, percent):
    sets = [sets_of(t, k) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for n, (i, _) in enumerate(docs):
        least[root(n)] = min(filter(lambda v: v is not None, (i, least.get(root(n)))), default=None)
    return sorted(((i, len(s), least[root(n)], i == least[root(n)] or least[root(n)] is None) for n, ((i, _), s) in enumerate(zip(docs, sets))), key=str)


def family(rng, size, edits, words=60, chain=False):
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(words)]
    out, last = [], base
    for _ in range(size):
        copy = list(last if chain else base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(len(copy))] = f"e{rng.randint(0, 10**6)}"
        out.append(" ".join(copy))
        last = copy
    return out


@pytest.mark.parametrize("k,percent,seed", [(3, 85, 1), (5, 80, 2), (3, 85, 3)])
def test_like_brute_force(spark, k, percent, seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(8):
        texts += family(rng, rng.randint(2, 12), rng.choice([1, 2, 4, 6]), rng.choice([8, 20, 60, 150]), rng.random() < 0.5)
    for chain in (False, True):
        texts += family(rng, 40, 5, 80, chain)
    texts += ["", " \t", None, "one", "ONE", "one two", "one two", "x\x1cy a b", "a b c", "a b c", "A B c d"] + [" ".join(["dup"] * 400)] * 2
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    docs = list(zip(ids, texts)) + [(None, texts[0]), (None, "lonely words here now"), (3, texts[5]), (ids[0], texts[20])]
    df = spark.createDataFrame([(*d, "c", True) for d in docs], "doc_id long, text string, component_id string, kept boolean").repartition(3)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(df, shingle_words=k, percent=percent).collect()), key=str)
    assert got == brute(docs, k, percent)


@pytest.mark.parametrize("far", [2, 4, 6])
def test_families_that_share_a_template(spark, far):
    rng = random.Random(far)
    base = [f"w{n}" for n in range(120)]
    texts = []
    for _ in range(5):
        own = list(base)
        for at in rng.sample(range(120), far):
            own[at] = f"t{rng.randint(0, 10**6)}"
        for _ in range(rng.randint(5, 30)):
            copy = list(own)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(120)] = f"e{rng.randint(0, 10**6)}"
            texts.append(" ".join(copy))
    docs = list(enumerate(rng.sample(texts, len(texts))))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, near_duplicates(df, shingle_words=3, percent=85).collect()), key=str)
    assert got == brute(docs, 3, 85)


def test_very_long_texts_of_one_bucket(spark):
    rng = random.Random(9)
    base = [f"w{n}" for n in range(30_000)]
    texts = []
    for share in (0.03, 0.04, 0.05, 0.05, 0.06, 0.07):
        copy = list(base)
        for at in rng.sample(range(30_000), int(share * 30_000)):
            copy[at] = f"e{rng.randint(0, 10**6)}"
        texts += [" ".join(copy), " ".join([*copy[:29_000], *base[29_000:]])]
    docs = list(enumerate(texts))
    got = sorted(map(tuple, near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle_words=3, percent=85).collect()), key=str)
    assert got == brute(docs, 3, 85)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bands():
    for percent in (70, 80, 85, 95):
        bands, rows = bands_for(percent)
        assert bands <= 56 and (1 - (percent / 100) ** rows) ** bands <= 1e-7


@pytest.mark.parametrize("size", [6, 40, 2000])
def test_signature_agreement_is_the_similarity(size):
    rng = np.random.default_rng(size)
    signer, got, want = Signer(*bands_for(85)), [], []
    for _ in range(60):
        common = rng.integers(0, 2**63, size, np.int64).astype(np.uint64) * np.uint64(2)
        p = np.unique(np.append(common, rng.integers(0, 2**63, max(1, size // 8), np.int64).astype(np.uint64)))
        q = np.unique(common)
        got.append((signer.signature(p) == signer.signature(q)).mean())
        want.append(len(np.intersect1d(p, q)) / len(np.union1d(p, q)))
    assert abs(np.mean(got) - np.mean(want)) < 0.04


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(5, k) for k in range(200, 260)] + [(7, 8), (8, 9), (9, 7)]
    got = {r["cid"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(100, 141)} == {100} and {got[k] for k in range(200, 260)} == {5} and got[9] == got[8] == 7


def test_few_words_are_one_shingle():
    assert len(shingles(b"a b", 3)) == 1 and len(shingles(b"a b c d", 3)) == 2 and len(shingles(b" \n", 3)) == 0
    assert shingles(b"A  b", 3).tolist() == shingles(b"a b", 3).tolist() != shingles(b"b a", 3).tolist()


def test_deduplicate_keeps_one_row_of_each_component(spark):
    rng = random.Random(5)
    texts = family(rng, 6, 1) + family(rng, 3, 0) + ["", None, "", "lone text stands here by itself"]
    docs = list(enumerate(texts)) + [(2, texts[2]), (None, texts[0]), (None, "no id at all in these words"), (None, "no id at all in these words")]
    df = spark.createDataFrame([(t, i, f"{i}") for i, t in docs], "text string, doc_id long, kept string").repartition(3)
    out = deduplicate(df)
    assert out.columns == df.columns
    got = sorted((str(r["doc_id"]), r["text"] or "") for r in out.collect())
    words = brute([d for d in docs if sets_of(d[1], 5)], 5, 80)
    want = {str(c) for _, _, c, _ in words}
    assert sorted({i for i, t in got if sets_of(t, 5)}) == sorted(want)
    assert sum(1 for _, t in got if sets_of(t, 5)) == len(want) and sum(1 for _, t in got if not sets_of(t, 5)) == 3


def test_bands_hold_the_promised_chance_at_any_threshold():
    for percent in (1, 5, 20, 50, 80, 85, 99, 100):
        bands, rows = bands_for(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= 1e-7
    with pytest.raises(ValueError):
        bands_for(0)


def test_clashing_names_stay(spark):
    rows = [(1, "a b c d e f g", "k", "r", "w", 5), (2, "a b c d e f g", "k", "r", "w", 6), (3, "x y", "k", "r", "w", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __key string, __row string, __Winner string, __least int")
    assert sorted(map(tuple, deduplicate(df).collect())) == [rows[0], rows[2]]
