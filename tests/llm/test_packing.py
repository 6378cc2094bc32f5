import random
import zlib

import numpy as np
import pytest

from veilmatch.llm.op1 import tokenizer_path
from veilmatch.llm.packing import ChunkEncoder, pack, plan


def check_plan(lengths, window):
    sequences = plan(lengths, window)
    seen = [np.zeros(n, int) for n in lengths]
    for pieces in sequences:
        total = sum(p[2] for p in pieces)
        assert 0 < total <= window
        for doc, start, length in pieces:
            assert length > 0
            seen[doc][start: start + length] += 1
    assert all((s == 1).all() for s in seen)
    return sequences


@pytest.mark.parametrize("seed", range(6))
def test_every_token_once_and_little_padding(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([0, 1, 5, 2048, 4096, rng.randint(1, 9000)]) for _ in range(300)]
    sequences = check_plan(lengths, 2048)
    used = sum(lengths)
    padded = sum(0 if (t := sum(p[2] for p in s)) & (t - 1) == 0 else 2048 - t for s in sequences)
    assert padded <= 0.01 * used


def test_best_fit_takes_tightest_window():
    sequences = plan([60, 70, 40, 30], 100, min_fill=1000)
    assert sorted(sorted(p[0] for p in s) for s in sequences) == [[0, 2], [1, 3]]


def test_chunks_equal_the_tokenizer():
    texts = [
        "The cat's toy, isn't it? 3.14 <b>x</b> don't", "ÉÊ!! EAU.\nEN!! ÈMENTAI", "ΑΣ ΣΑΣ. İstanbul ß ǅ", "ábc é, ≮ x,̸",
        "<|endoftext|> hi <|STARTOFTEXT|>", "", " \t\x0b\x0c\r\n", "日本語 テキスト。x y z \x1c q", "a.,b ...! foo.bar' 'tis they're,;", "x" * 5000, "🙂🙂 ok🙂.", "²³ ½ Ⅷ ok",
    ]
    enc = ChunkEncoder(tokenizer_path())
    for _ in range(2):
        got = enc.encode([t.encode() for t in texts])
        want = [enc.tok.encode(t, add_special_tokens=False).ids for t in texts]
        assert [g.tolist() for g in got] == want


def test_pack_rows(spark):
    rows = [(1, "Hello there, friend."), (2, None), (3, ""), (None, "x y"), (1, "Hello there, friend."), (4, "word " * 5000)]
    df = spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], "doc_id long, text string, start string, ids int")
    got = [r.asDict() for r in pack(df.coalesce(1), tokenizer_path()).collect()]
    enc = ChunkEncoder(tokenizer_path())
    want = sorted(sum(([(i, len(enc.encode([(t or "").encode()])[0]) + 1)] for i, t in rows), []), key=str)
    whole = {}
    for r in got:
        assert len(r["ids"]) == 4 * r["length"]
        whole.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["sequence_tokens"]))
    for pieces in whole.values():
        at = 0
        for offset, length, total in sorted(pieces):
            assert offset == at and total == pieces[0][2]
            at += length
        assert at == pieces[0][2]
    assert sum(r["length"] for r in got) == sum(n for _, n in want)
    big = sorted((r for r in got if r["doc_id"] == 4), key=lambda r: r["start"])
    ids = b"".join(r["ids"] for r in big)
    expect = np.append(enc.encode([("word " * 5000).encode()])[0], 1).astype("<u4").tobytes()
    assert ids == expect and zlib.crc32(ids) == zlib.crc32(expect)
    assert pack(df.limit(0), tokenizer_path()).count() == 0
