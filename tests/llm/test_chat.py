import hashlib

import pytest

from veilmatch.llm.chat import LAYOUTS, canonical, canonical_json, escape, format_chat, layout_of, read_loss, read_turns, unescape
from pyspark.sql import functions as F

NASTY = ["", "plain", "\\", "\\\\s\\l", "</turn>\n<turn user>", "<turn assistant>x</turn>\n", "<", "a<", "\\l/turn>", "🙂é\n", "<</turn>", "\\### Assistant: </turn> ok", "x" * 3000]


def test_escape_is_reversible(spark):
    df = spark.createDataFrame([(t,) for t in NASTY], "t string")
    for r in df.select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u"), unescape(escape(F.col("t"), True)).alias("r")).collect():
        assert r["u"] == r["t"] == r["r"]
        assert "<turn" not in r["e"] and "</turn" not in r["e"]


def test_round_trip_and_mask(spark):
    turns = [(c, k, ("user", "assistant", "odd>role", None)[k % 4], t) for c in (1, 2, None) for k, t in enumerate([*NASTY, None])]
    turns += [(3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (4, None, None, None)]
    df = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, formatted string")
    out = format_chat(canonical(df))
    got = {r["conv_id"]: r for r in out.select("*", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for c, r in got.items():
        mine = sorted((t for t in turns if t[0] == c), key=lambda t: (t[1] is not None, t[1], t[2] or "", t[3] or ""))
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(t[2] or "", t[3] or "") for t in mine]
        assert r["loss"] == [t[3] or "" for t in mine if t[2] == "assistant"]
    assert format_chat(canonical(df.limit(0))).count() == 0


def test_layouts_by_schema(spark):
    assert len({x.fingerprint() for x in LAYOUTS}) == len(LAYOUTS)
    a = spark.sql("SELECT 1 AS id, array(named_struct('role','human','content','hi'), named_struct('role','gpt','content','yo')) AS messages, 5 AS extra")
    assert [(r["turn"], r["role"], r["text"]) for r in canonical(a).orderBy("turn").collect()] == [(0, "user", "hi"), (1, "assistant", "yo")]
    b = spark.sql("SELECT 1 AS id, 'do' AS instruction, CAST(NULL AS STRING) AS input, 'done' AS output")
    assert [(r["role"], r["text"]) for r in canonical(b).orderBy("turn").collect()] == [("user", "do"), ("assistant", "done")]
    with pytest.raises(ValueError):
        layout_of(spark.sql("SELECT 1 AS x").schema)


def test_mixed_json(spark):
    rows = [
        '{"id":"1","messages":[{"role":"user","content":"q"},{"content":null,"role":"assistant"}]}',
        '{"conversations":[{"from":"human","value":"q2"},{"from":"gpt","value":"a2"}],"id":"2"}',
        '{"id":3,"prompt":"p","response":"r"}', '{"id":"4","instruction":"i","input":"in","output":"o"}', '{"who":"knows"}', "not json", None,
    ]
    got = canonical_json(spark.createDataFrame([(r, 1) for r in rows], "doc string, role int"), "doc").collect()
    key = sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in got if r["layout"])
    assert key == [("1", 0, "user", "q"), ("1", 1, "assistant", None), ("2", 0, "user", "q2"), ("2", 1, "assistant", "a2"), ("3", 0, "user", "p"), ("3", 1, "assistant", "r"), ("4", 0, "user", "i\n\nin"), ("4", 1, "assistant", "o")]
    assert sorted(str(r["text"]) for r in got if not r["layout"]) == ["None", "not json", '{"who":"knows"}']


def test_hashes_like_brute_force(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b<turn")], "conv_id long, turn long, role string, text string")
    r = format_chat(canonical(df)).first()
    assert r["formatted"] == "<turn user>a</turn>\n<turn assistant>b\\lturn</turn>\n"
    assert hashlib.sha256(r["formatted"][r["loss_spans"][0]["start"]:][: r["loss_spans"][0]["length"]].encode()).hexdigest() == hashlib.sha256(b"b\\lturn").hexdigest()
