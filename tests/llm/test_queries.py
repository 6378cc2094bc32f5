"""Every registered query on a whole small table, against values worked out here from the texts alone."""

import hashlib
import json
import math
import re
import zlib
from collections import Counter

import pytest

from veilmatch.llm import media, op1, op2, op5, op6, op8, op10
from veilmatch.llm.scoring import grams_of, normal, tree_log10

SF = "/root/testdata/sf0.001"


def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_op1_covers_every_id_once_with_little_padding(spark):
    tokenizers = pytest.importorskip("tokenizers")
    known = tokenizers.Tokenizer.from_file(op1.tokenizer_path())
    want = {i: [*known.encode(t, add_special_tokens=False).ids, 1] for i, t in texts(spark).items()}
    rows = op1.query(spark, SF).collect()
    pieces, windows = {}, {}
    for r in rows:
        ids = want[r["doc_id"]]
        part = b"".join(x.to_bytes(4, "little") for x in ids[r["start"]: r["start"] + r["length"]])
        assert r["ids_crc32"] == zlib.crc32(part) and r["doc_tokens"] == len(ids) and r["length"] > 0
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, ids in want.items():
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at
            at += length
        assert at == len(ids)
    padded = 0
    for held in windows.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
        padded += at if at & (at - 1) == 0 else 2048
    assert padded <= 1.01 * sum(map(len, want.values()))


def test_op2_reads_its_texts_back(spark):
    turns = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        turns.setdefault(r["conv_id"], []).append((r["turn"], r["role"] or "", r["text"] or ""))
    said = r"\### Assistant: </turn> ok"
    turns[-7] = [(0, "user", said), (1, "assistant", said)]
    rows = {r["conv_id"]: r for r in op2.query(spark, SF).collect()}
    assert rows.keys() == turns.keys()
    for i, own in turns.items():
        own.sort()
        loss = "".join(t for _, role, t in own if role == "assistant")
        assert rows[i]["n_turns"] == len(own) and rows[i]["loss_chars"] == len(loss)
        assert rows[i]["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in own).encode()).hexdigest()
        assert rows[i]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_op5_stores_every_text(spark):
    known = texts(spark)
    rows = op5.query(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(known)
    for r in rows:
        raw = known[r["doc_id"]].encode()
        full = raw + b" " * (192 * max(1, math.ceil(len(raw) / 192)) - len(raw))
        image = media.to_png(full, len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(image), hashlib.sha256(image).hexdigest(), media.feature(full))


def test_op6_scores_like_one_tree_over_all_texts(spark):
    import numpy as np

    known = texts(spark)
    training = {i for i in known if zlib.crc32(str(i).encode()) % 7 != 2}
    words = {i: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)), "\n"] for i, t in known.items()}
    c = Counter(w for i in training for w in words[i])
    n, v = sum(c.values()), len(c)
    grams = {i: grams_of([normal(t.encode())], 6)[0].tolist() for i, t in known.items()}
    learned = Counter(g for i in training for g in grams[i])
    keys = np.array(sorted(set().union(*grams.values())), np.uint64)
    value = dict(zip(keys.tolist(), tree_log10(keys, np.array([float(learned[g]) for g in keys.tolist()]), 6)))
    rows = {r["doc_id"]: r for r in op6.query(spark, SF).collect()}
    assert rows.keys() == known.keys()
    for i, r in rows.items():
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i not in training, len(words[i]), sum(c[w] > 0 for w in words[i]), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words[i]), rel=1e-9)
        assert r["score"] == pytest.approx(sum(value[g] for g in grams[i]), rel=1e-9)


def test_op8_shards_hold_near_equal_bytes(spark):
    known = texts(spark)
    rows = op8.query(spark, SF).collect()
    shards, load = {}, Counter()
    for r in rows:
        raw = known[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        shards.setdefault(r["shard"], []).append(r["slot"])
        load[r["shard"]] += r["size"]
    assert len(rows) == len(known) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    # largest first to the least loaded: no shard is above the mean by more than its largest record
    assert set(load) <= set(range(40)) and max(load.values()) <= sum(load.values()) / 40 + max(r["size"] for r in rows)


def test_op10_scores_every_text(spark):
    known = texts(spark)
    rows = {r["doc_id"]: r for r in op10.query(spark, SF).collect()}
    assert rows.keys() == known.keys()
    for i, r in rows.items():
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
    same = {}
    for i, t in known.items():
        same.setdefault(json.dumps(t), set()).add(rows[i]["score"])
    assert all(len(s) == 1 for s in same.values())
