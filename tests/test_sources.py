import json

import pytest
from pyspark.sql import functions as F

from veilmatch.functions import corrupt
from veilmatch.plans.schema import NAME, FieldSet, FieldSpec, path
from veilmatch.plans.session import Session
from veilmatch.sources.corpus import RECORD, Reports, febrl_canonical_id, febrl_corpus, in_hash_sample, iso_date, read_corpus, read_voters, result_metrics, voter_records, write_corpus, write_report
from veilmatch.streaming.link import link_stream_equal, link_stream_similar


def test_corpus_round_trip(spark, tmp_path):
    rows = [("1", "e", "d", {"b::c::d": "x", "a::b::c": ""}, ["al"]), ("2", None, None, {}, None)]
    write_corpus(spark.createDataFrame(rows, RECORD), f"{tmp_path}/c")
    got = read_corpus(spark, f"{tmp_path}/c").orderBy("canonical_id").collect()
    assert [(r["canonical_id"], r["record"], r["aliases"]) for r in got] == [("1", {"a::b::c": "", "b::c::d": "x"}, ["al"]), ("2", {}, None)]


@pytest.mark.parametrize("text,what", [('{"canonical_id":"1","record":{}}\n\n{oops\n', "malformed"), ('{"record":{}}\n', "missing canonical_id"), ('{"canonical_id":"","record":{}}', "missing canonical_id"), ("\n \n", "empty")])
def test_bad_corpora(spark, tmp_path, text, what):
    (tmp_path / "c.jsonl").write_text(text)
    with pytest.raises(Exception, match=what):
        read_corpus(spark, f"{tmp_path}/c.jsonl").collect()


def test_blank_lines(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('\n{"canonical_id":"1","record":{"a::b::c":"x"}}\n   \n')
    assert read_corpus(spark, f"{tmp_path}/c.jsonl").count() == 1


def test_febrl(spark):
    ids = spark.createDataFrame([("rec-12-org",), ("rec-12-dup-0",), ("other",), ("rec-7",)], "i string").select(febrl_canonical_id(F.col("i")).alias("c")).collect()
    assert [r["c"] for r in ids] == ["12", "12", "other", "rec-7"]
    d = spark.createDataFrame([("19870230",), ("1987",), (None,), ("abcdefgh",)], "d string").select(iso_date(F.col("d")).alias("d")).collect()
    assert [r["d"] for r in d] == ["1987-02-30", "1987", None, "abcdefgh"]
    cols = "rec_id string, given_name string, surname string, soc_sec_id string, postcode string, suburb string, state string, date_of_birth string"
    org = spark.createDataFrame([("rec-1-org", " ann ", "lee", "123", None, "", "nsw", "19900102")], cols)
    dup = spark.createDataFrame([("rec-1-dup-0", "ann", None, "123", "2000", "x", "nsw", "bad")], cols)
    a, b = febrl_corpus(org, dup).orderBy(F.desc("dataset")).collect()
    assert (a["canonical_id"], b["canonical_id"], a["dataset"], b["dataset"]) == ("1", "1", "febrl4-org", "febrl4-dup")
    assert a["record"][str(path(NAME, "full"))] == "ann lee" and a["record"][str(path("date", "birth"))] == "1990-01-02" and len(a["record"]) == 7
    assert str(path(NAME, "full")) not in b["record"] and b["record"][str(path("address", "country"))] == "AU"


def test_voters(spark, tmp_path):
    head = "ncid\tvoter_reg_num\tstatus_cd\tfirst_name\tmiddle_name\tlast_name\tres_city_desc\tstate_cd\tzip_code"
    rows = [f'"A{k}"\t"{k}"\t"{"A" if k % 2 else "I"}"\t"JOS\xc9"\t" B  C "\t"LEE"\t"CARY"\t"NC"\t"275111234"' for k in range(40)] + ['"Z"\t"1"\t"A"\t"X"']
    (tmp_path / "v.txt").write_bytes("\n".join([head, *rows]).encode("latin-1"))
    got = voter_records(read_voters(spark, f"{tmp_path}/v.txt"), one_in=2).collect()
    import hashlib

    want = sorted(f"A{k}" for k in range(1, 40, 2) if int.from_bytes(hashlib.sha256(f"A{k}".encode()).digest()[:8], "big") % 2 == 0)
    assert [r["canonical_id"] for r in got] == want
    assert got[0]["record"][str(path(NAME, "full"))] == "JOSÉ B C LEE" and got[0]["record"][str(path("address", "postal_code"))] == "27511"
    assert spark.range(1).select(in_hash_sample(F.lit("x"), 1).alias("s")).first()["s"]


def test_report(spark, tmp_path):
    best = {"f1": 0.5, "precision": 0.4, "recall": 0.6}
    r = {"auroc": 0.9, "auprc": 0.8, "best_f1": best, "best_accuracy": {"accuracy": 0.7}, "best_mcc": {"mcc": 0.3}, "tokenize": {"p50": 1, "p99": 2, "throughput": 3}, "match": {"p99": 4, "throughput": 5}}
    m = result_metrics(r)
    assert len(m) == 12 and m["f1"] == {"value": 0.5}
    write_report(spark, {"bench": m}, f"{tmp_path}/r.json")
    assert json.load(open(f"{tmp_path}/r.json"))["bench"]["mcc"]["value"] == 0.3
    kept = Reports(spark, f"{tmp_path}/more/all.json")
    kept.add("one", r)
    kept.add("two", r)
    kept.close()
    assert sorted(json.load(open(f"{tmp_path}/more/all.json"))) == ["one", "two"]
    nowhere = Reports(spark)
    nowhere.add("one", r)
    nowhere.close()


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]


def test_corruption(spark):
    values = ["Christopher", "ann", "ab", "", "QUILL", "zoo", "vane", "1234", "w"]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values * 8)], "k long, v string")
    k, v = F.col("k"), F.col("v")
    cols = [corrupt.typo(v, k).alias("t"), corrupt.drop_char(v, k).alias("d"), corrupt.phonetic(v, k).alias("p"), corrupt.ocr(v, k).alias("o"), corrupt.missing(v, k).alias("m")]
    rows = df.select("v", *cols).collect()
    assert rows == df.select("v", *cols).collect()
    for r in rows:
        assert len(r["t"]) == len(r["v"]) and edits(r["v"], r["t"]) <= 1 and r["m"] is None
        assert r["d"] == r["v"] if len(r["v"]) < 3 else len(r["d"]) == len(r["v"]) - 1
        assert edits(r["v"], r["p"]) <= 2 and edits(r["v"], r["o"]) <= 2
    assert {r["p"] for r in rows if r["v"] == "vane"} == {"fane"} and {r["o"] for r in rows if r["v"] == "w"} == {"vv"}
    assert len({r["t"] for r in rows if r["v"] == "Christopher"}) > 3


def test_corrupt_record(spark):
    full, given, family = (str(path(NAME, n)) for n in ("full", "given", "family"))
    base = {full: "Ann Lee", given: "Ann", family: "Lee", "x::y::z": "kept"}
    df = spark.createDataFrame([(k, base) for k in range(300)], "id long, record map<string,string>")
    out = {r["id"]: r["record"] for r in corrupt.corrupt_record(df, "id").collect()}
    assert out == {r["id"]: r["record"] for r in corrupt.corrupt_record(df.repartition(5), "id").collect()}
    assert all(r["x::y::z"] == "kept" for r in out.values())
    changed = [sum(r.get(p) != v for p, v in base.items()) for r in out.values()]
    assert max(changed) <= 3 and 0.5 < sum(c > 0 for c in changed) / 300 <= 1
    assert any(full not in r for r in out.values()) and all(full not in r for r in out.values() if given not in r and family not in r)
    empty = spark.createDataFrame([(1, {})], "id long, record map<string,string>")
    assert corrupt.corrupt_record(empty, "id").first()["record"] == {}


def test_streams(spark, tmp_path):
    given = str(path(NAME, "given"))
    fs = FieldSet("v", (FieldSpec(path(NAME, "given")),))
    session = Session(b"s", fs)
    rows = spark.createDataFrame([(1, {given: "Ann"}), (2, {given: "Bob"})], "id long, record map<string,string>")
    rows.write.parquet(f"{tmp_path}/in")
    stored = session.deterministic(rows.where("id = 1")).select("id", "token")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = link_stream_equal(session, stream, stored).select("id", "id_r").writeStream.format("memory").queryName("linked").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("linked").collect()] == [(1, 1)]
    with pytest.raises(ValueError):
        link_stream_equal(session, rows, stored)
    with pytest.raises(ValueError):
        link_stream_similar(session, rows, stored, 0.5, "block")
