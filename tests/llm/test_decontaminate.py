import random
import time
import re

import numpy as np
import pytest

from veilmatch.llm.decontaminate import contamination, suffix_order

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window):
    out = []
    for i, text in docs:
        ws, hit, found, longest = split(text), set(), set(), 0
        for item, t in items:
            q = split(t)
            k = min(window, len(q))
            for j in range(len(q) - k + 1 if k else 0):
                for p in range(len(ws) - k + 1):
                    if ws[p: p + k] == q[j: j + k]:
                        hit |= set(range(p, p + k))
                        if item is not None:
                            found.add(str(item))
                        n = k
                        while p + n < len(ws) and j + n < len(q) and ws[p + n] == q[j + n]:
                            n += 1
                        longest = max(longest, n)
        out.append((i, len(ws), len(hit), sorted(found), longest))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_like_brute_force(spark, seed):
    rng = random.Random(seed)
    voc = ["aa", "B", "cc", "É", "1", "d"][: 2 + seed]

    def text(n):
        return rng.choice([" ", ", ", "\0", "\n"]).join(rng.choice(voc) for _ in range(n))

    items = [(k, text(rng.choice([0, 1, 2, 5, 6, 7, 12]) if seed % 2 else rng.randint(5, 12))) for k in range(6)] + [(None, text(7)), (98, None), (99, "!!")]
    docs = [(k, text(rng.randint(0, 60))) for k in range(25)] + [(None, None), (3, "aa " * 500), (3, "aa " * 500), (7, "")]
    docs[2] = (2, "zz " + (items[3][1] or "") + " " + (items[4][1] or "") + " zz")
    d = spark.createDataFrame([(*x, 5) for x in docs], "doc_id long, text string, n_hit int")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items, 5)
    for blocks in (10**6, 8):
        rows = contamination(d, b, window=5, shard_bytes=300, block_words=blocks).collect()
        got = sorted(((r["doc_id"], r["match"]["n_words"], r["match"]["n_hit"], r["match"]["items"], r["match"]["longest"]) for r in rows), key=str)
        if blocks == 8:  # a match is followed within a block only
            got, expect = [x[:4] for x in got], [x[:4] for x in want]
        else:
            expect = want
        assert got == expect


def test_location_and_kept_columns(spark):
    d = spark.createDataFrame([(1, "x y one two three four z", "m")], "doc_id long, text string, match string").drop("match")
    b = spark.createDataFrame([(5, "zero one two three four five")], "item_id long, text string")
    r = contamination(d, b, window=3, keep=True).first()
    assert r["text"].startswith("x y") and tuple(r["match"])[3:] == (4, 2, "5", 1)
    assert contamination(d.limit(0), b).count() == 0
    assert contamination(d, b.limit(0)).first()["match"]["n_hit"] == 0
    clash = d.withColumn("Match", d["text"])
    with pytest.raises(ValueError, match="column"):
        contamination(clash, b, keep=True)
    assert contamination(clash, b, window=3, keep=True, name="found").first()["found"]["n_hit"] == 4


@pytest.mark.parametrize("seed", range(5))
def test_suffix_array(seed):
    rng = random.Random(seed)
    ids = [rng.randint(0, 2) for _ in range(rng.choice([0, 1, 50, 300]))] + [1, 2] * 40
    order = suffix_order(np.array(ids)).tolist()
    nones = [k for k, x in enumerate(ids) if x == 0]
    value = [-1 - nones.index(k) if x == 0 else x for k, x in enumerate(ids)]
    assert order == sorted(range(len(ids)), key=lambda k: value[k:])


def test_equal_items_do_not_multiply(spark):
    """3,000 items of one text that occurs 500 times in a document."""
    d = spark.createDataFrame([(1, "aa bb cc dd " * 500)], "doc_id long, text string")
    b = spark.range(3000).selectExpr("id AS item_id", "'aa bb cc dd' AS text")
    began = time.time()
    r = contamination(d, b).first()["match"]
    assert len(r["items"]) == 3000 and r["n_hit"] == 2000 and time.time() - began < 20
