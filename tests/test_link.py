import pytest
from pyspark.sql import functions as F

from veilmatch.functions.similarity import by_path, dice, incompatible, match, per_field, popcount, score, score_for
from veilmatch.functions.tokens import words_of
from veilmatch.operators.link import best_match, equal, link_equal, link_similar
from veilmatch.operators.tokenize import Tokenizer, annotate, comparable, describe, normalized
from veilmatch.operators.validate import drop_counts, record_errors, record_from_map, sanitize
from veilmatch.plans.schema import ADDRESS, DATE, DEFAULT, FAST, HARDENED, IDENTIFIER, NAME, BloomConfig, FieldPath, FieldSet, FieldSpec, default_field_set, path
from veilmatch.plans.session import Session, block_on
from veilmatch.sources.corpus import token_from_json, token_json

G, FAM, BIRTH, NID = path(NAME, "given"), path(NAME, "family"), path(DATE, "birth"), path(IDENTIFIER, "national_id")
FS = FieldSet("v1-test", (FieldSpec(G, True, 2.0), FieldSpec(FAM, False, 1.0)), DEFAULT)


def records(spark, *maps):
    return spark.createDataFrame([(k, m) for k, m in enumerate(maps)], "id long, record map<string,string>")


def person(given=None, family=None, birth=None):
    return {str(p): v for p, v in ((G, given), (FAM, family), (BIRTH, birth)) if v is not None}


def one(df, column):
    return df.select(column.alias("x")).first()["x"]


def pair_result(spark, session, a, b, threshold):
    df = comparable(session.probabilistic(records(spark, a, b)))
    left, right = df.where("id = 0"), df.where("id = 1")
    return link_similar(left, right, session.field_set, threshold, unblocked=True, keep_all=True).first()["result"]


def det(version="v", key="k", fp="f", fields=(b"\x01", None)):
    return (version, key, fp, list(fields))


TOKEN = "struct<field_set_version:string,key_id:string,field_set_fingerprint:string,fields:array<binary>>"


@pytest.mark.parametrize(
    "a,b,want",
    [
        (det(), det(), True), (det(version="w"), det(), False), (det(key="z"), det(), False), (det(fp="x"), det(), False), (det(fp=""), det(), True),
        (det(fields=(b"\x01",)), det(), False), (det(fields=(b"\x02", None)), det(), False), (det(fields=(b"\x01\x01", None)), det(), False), (det(fields=(b"\x01", b"")), det(), True), (det(fields=(None, None)), det(), False),
    ],
)
def test_equal_truth_table(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], f"a {TOKEN}, b {TOKEN}")
    assert one(df, equal(F.col("a"), F.col("b"))) is want


def test_fingerprint_is_a_wildcard_in_joins(spark):
    left = spark.createDataFrame([(1, det(fp="f")), (2, det(fp="g")), (3, det(fp=""))], f"id int, token {TOKEN}")
    got = {(r["id"], r["id_r"]) for r in link_equal(left, left).collect()}
    assert got == {(1, 1), (1, 3), (2, 2), (2, 3), (3, 1), (3, 2), (3, 3)}
    empty = spark.createDataFrame([(1, det(fields=(None, b"")))], f"id int, token {TOKEN}")
    assert link_equal(empty, empty).count() == 0 and link_equal(empty, empty, skip_empty=False).count() == 1
    assert link_equal(left, empty, "left_anti").count() == 3 and link_equal(left, left, "left_semi").count() == 3


@pytest.mark.parametrize("x,y,want", [(b"\xff", b"\xff", 1.0), (b"\xf0", b"\x0f", 0.0), (b"\xff", b"\xf0", 2 * 4 / 12), (b"\x00", b"\x00", 0.0)])
def test_dice_values(spark, x, y, want):
    df = spark.createDataFrame([(x.ljust(8, b"\0"), y.ljust(8, b"\0"))], "x binary, y binary")
    a, b = words_of(F.col("x")), words_of(F.col("y"))
    assert one(df, dice(a, b, popcount(a), popcount(b))) == want


def test_gates(spark):
    t = Tokenizer(b"s", "k").probabilistic(records(spark, person("ann", "b")), FS).select("token")
    field = FieldSet("v1-test", FS.fields[:1], DEFAULT)
    others = {
        "version mismatch": Tokenizer(b"s", "k").probabilistic(records(spark, person("ann")), FS.with_bloom(DEFAULT, "v2")),
        "key id mismatch": Tokenizer(b"s", "z").probabilistic(records(spark, person("ann")), FS),
        "fingerprint mismatch": Tokenizer(b"s", "k").probabilistic(records(spark, person("ann")), field),
        "params mismatch": Tokenizer(b"s", "k").probabilistic(records(spark, person("ann")), FS.with_bloom(FAST)).withColumn("token", F.col("token").withField("field_set_fingerprint", F.lit(""))),
        "field count mismatch": Tokenizer(b"s", "k").probabilistic(records(spark, person("ann")), field).withColumn("token", F.col("token").withField("field_set_fingerprint", F.lit(""))),
        None: Tokenizer(b"s", "k").probabilistic(records(spark, person("bob")), FS.with_bloom(HARDENED)),
    }
    for why, other in others.items():
        df = t.join(other.select(F.col("token").alias("o")))
        assert one(df, incompatible(F.col("token"), F.col("o"))) == why
    short = t.withColumn("o", F.col("token").withField("fields", F.array(F.col("token.fields")[0], F.lit(b"\0"))))
    assert one(short, incompatible(F.col("token"), F.col("o"))) == "field length mismatch"


def test_score_weights(spark):
    df = spark.range(1)
    assert one(df, score([F.lit(1.0), F.lit(0.0)], FS)) == pytest.approx(2 / 3)
    with pytest.raises(ValueError):
        score([F.lit(1.0)], FS)
    with pytest.raises(ValueError):
        score([F.lit(1.0)], FieldSet("v", (FieldSpec(G, False, 0.0),)))


def test_match_absence(spark):
    s = Session(b"secret", FieldSet("v", (FieldSpec(G, False, 2.0), FieldSpec(FAM, False, 1.0)), DEFAULT))
    both = pair_result(spark, s, person("ann"), person("ann"), 0.9)
    assert both["score"] == 1.0 and both["comparable_fields"] == 1 and both["is_match"]
    lone = pair_result(spark, s, person("ann", "x y"), person("ann"), 0.5)
    assert lone["score"] == pytest.approx(2 / 3) and lone["comparable_fields"] == 2
    none = pair_result(spark, s, {}, {}, 0.0)
    assert (none["score"], none["is_match"], none["comparable_fields"]) == (0.0, False, 0)
    with pytest.raises(ValueError):
        pair_result(spark, s, person("a"), person("a"), 1.5)


def test_blocked_links_in_cells(spark):
    s = Session(b"k", FS)
    rows = records(spark, *(person(f"name{k % 7}", f"fam{k % 3}") for k in range(30)))
    t = comparable(s.probabilistic(block_on(rows.withColumn("b", F.lit("same")), s, "b", FAM)))
    plain = {(r["id"], r["id_r"]) for r in link_similar(t, t, FS, 0.8, block="block").collect()}
    salted = {(r["id"], r["id_r"]) for r in link_similar(t, t, FS, 0.8, block="block", cell_rows=7).collect()}
    for keep_all in (False, True):
        one_way, other_way = ({(r["id"], r["id_r"]): r["result"] for r in link_similar(t, t, FS, 0.8, block="block", keep_all=keep_all, method=m, cell_rows=11).collect()} for m in ("grid", "join"))
        assert one_way.keys() == other_way.keys() and len(one_way) == (900 if keep_all else len(plain))
        for pair, r in one_way.items():
            o = other_way[pair]
            assert (r["paths"], r["is_match"], r["comparable_fields"]) == (o["paths"], o["is_match"], o["comparable_fields"])
            assert r["score"] == pytest.approx(o["score"]) and r["per_field"] == pytest.approx(o["per_field"])
    nulls = t.withColumn("block", F.lit(None).cast("string"))
    assert link_similar(nulls, t, FS, 0.0, block="block").count() == 0 and link_similar(t.limit(0), t, FS, 0.0, unblocked=True).count() == 0
    full = link_similar(t, t, FS, 0.8, unblocked=True)
    assert plain == salted == {(r["id"], r["id_r"]) for r in full.collect()} and all((k, k) in plain for k in range(30))
    assert {r["id"]: r["id_r"] for r in best_match(full).collect()}[29] == 8
    r = full.where("id = 0 AND id_r = 0").select("result", by_path(F.col("result")).alias("m"), score_for(F.col("result"), str(G)).alias("g"), score_for(F.col("result"), "no::such::path").alias("n")).first()
    assert r["m"] == {str(G): 1.0, str(FAM): 1.0} and r["g"] == 1.0 and r["n"] is None
    with pytest.raises(ValueError):
        link_similar(t, t, FS, 0.8)
    other = comparable(Session(b"k", FS, "k2").probabilistic(rows))
    for m in ("grid", "join"):
        with pytest.raises(Exception, match="key id mismatch"):
            link_similar(t, other, FS, 0.8, unblocked=True, method=m).collect()


def test_policies(spark):
    fs = FieldSet("v", (FieldSpec(G, True), FieldSpec(BIRTH)), DEFAULT)
    bad, lacking = person("ann", birth="nope"), person(birth="2000-01-01")
    for m in (bad, lacking):
        with pytest.raises(Exception, match="date must be|required field missing"):
            normalized(records(spark, m), fs).select("values").collect()
    got = normalized(records(spark, bad, lacking), fs, policy="report").orderBy("id").collect()
    assert got[0]["values"] == ["ann", None] and got[0]["errors"][0]["path"] == str(BIRTH)
    assert got[1]["errors"][0]["error"] == "required field missing"
    assert normalized(records(spark, bad), fs, policy="nullify").first()["values"] == ["ann", None]
    assert normalized(records(spark, bad), fs, policy="sanitize").first()["values"] == ["ann", None]
    with pytest.raises(Exception, match="required field"):
        normalized(records(spark, lacking), fs, policy="sanitize").select("values").collect()
    with pytest.raises(ValueError):
        normalized(records(spark, bad), fs, policy="other")


def test_presence(spark):
    """An emptied identifier is present deterministically and absent in a filter, unless that is hardened."""
    fs = FieldSet("v", (FieldSpec(NID), FieldSpec(G)), DEFAULT)
    rows = records(spark, {str(NID): "---"})
    d = Tokenizer(b"s").deterministic(rows, fs)
    p = comparable(Tokenizer(b"s").probabilistic(rows, fs))
    h = comparable(Tokenizer(b"s").probabilistic(rows, fs.with_bloom(HARDENED)))
    assert len(d.first()["token"]["fields"][0]) == 32 and d.first()["token"]["fields"][1] is None
    assert p.first()["pops"] == [0, 0] and h.first()["pops"] == [400, 0]
    assert [tuple(f) for f in one(d, annotate(F.col("token"), fs))["fields"]] == [(str(NID), True, 32), (str(G), False, 0)]
    assert [tuple(f) for f in one(p, annotate(F.col("token"), fs, True))["fields"]] == [(str(NID), False, 256), (str(G), False, 256)]
    more = FieldSet("v", fs.fields[:1], DEFAULT)
    assert [f["path"] for f in one(p, annotate(F.col("token"), more, True))["fields"]] == [str(NID), ""]
    assert one(d, describe(F.col("token"))) == f"DeterministicToken{{v=v key= fp={fs.fingerprint()[:8]} fields=1/2 bytes=32}}"
    assert "fields=2/2 bytes=512" in one(p, describe(F.col("token"), True))


def test_key_rotation_and_path_separation(spark):
    rows = records(spark, {str(G): "same", str(FAM): "same"})
    a, b = (Tokenizer(b"s", k).deterministic(rows, FS) for k in ("k1", "k2"))
    assert link_equal(a, b).count() == 0 and link_equal(a, a).count() == 1
    f = a.first()["token"]["fields"]
    assert f[0] != f[1] and link_equal(a, Tokenizer(b"t", "k1").deterministic(rows, FS)).count() == 0
    assert one(rows.withColumn("v", F.lit("SAME ")), Tokenizer(b"s").field(F.col("v"), G)) == f[0]


def test_formatting_differences_are_equal(spark):
    s = Session(b"s", FieldSet("v", (FieldSpec(G), FieldSpec(BIRTH), FieldSpec(NID))))
    a = s.deterministic(records(spark, {str(G): " José ", str(BIRTH): "1990-01-02", str(NID): "12-3.4"}))
    b = s.deterministic(records(spark, {str(G): "jose", str(BIRTH): "1990-01-02 ", str(NID): "1234"}))
    assert link_equal(a, b).count() == 1


def test_json_round_trip(spark):
    for df, bloom in ((Tokenizer(b"s", "k").deterministic(records(spark, person("ann")), FS), False), (Tokenizer(b"s").probabilistic(records(spark, person("ann")), FS.with_bloom(HARDENED)), True)):
        text = token_json(F.col("token"), bloom)
        back = df.select(F.col("token"), token_from_json(text, bloom).alias("b"), text.alias("j")).first()
        assert back["token"].asDict(True) == back["b"].asDict(True)
        assert ("key_id" in back["j"]) is not bloom and ("flip_probability" in back["j"]) is bloom
    df = spark.createDataFrame([(("v", "", "", [b"\x01", None, b""]),)], f"token {TOKEN}")
    assert one(df, token_json(F.col("token"))) == '{"field_set_version":"v","fields":["AQ==",null,""]}'
    with pytest.raises(Exception):
        spark.sql("""SELECT '{"field_set_version":"v","fields":["*"]}' AS j""").select(token_from_json(F.col("j"))).collect()


def test_records_and_validation(spark):
    fs = FieldSet("v1", (FieldSpec(G, True), FieldSpec(FAM), FieldSpec(BIRTH)))
    rows = records(spark, person(birth="bad") | {"a::b::c": "x"}, person("ann", "b", "2000-01-01"), {"plain": "x", "a::b::c": "y", str(G): ""})
    got = [r["e"] for r in rows.orderBy("id").select(record_errors("record", fs).alias("e")).collect()]
    assert len(got[0]) == 3 and got[1] == [] and len(got[2]) == 2
    record, errors = record_from_map(F.col("record"), fs)
    r = rows.where("id = 2").select(record.alias("r"), errors.alias("e")).first()
    assert r["r"] == {str(G): ""} and [tuple(e) for e in r["e"]] == [("a::b::c", "not in FieldSet"), ("plain", "malformed path")]
    clean = sanitize(rows, fs).orderBy("id").collect()
    assert clean[0]["record"] == {"a::b::c": "x"} and str(BIRTH) in clean[0]["dropped"] and clean[1]["dropped"] is None
    assert [tuple(r) for r in drop_counts(sanitize(rows, fs)).collect()] == [(str(BIRTH), 1)]


def test_custom_schema(spark):
    mrn = FieldPath.parse("acme::identifier::mrn")
    fs = FieldSet("acme/v1", (FieldSpec(mrn, True, 4.0), FieldSpec(path(ADDRESS, "country"))))
    df = spark.createDataFrame([(1, "12-34", "us")], "id int, m string, c string")
    t = Session(b"s", fs).deterministic(df, columns={str(mrn): "m", str(fs.fields[1].path): "c"})
    same = Session(b"s", fs).deterministic(df.withColumn("m", F.lit("1234")).withColumn("c", F.lit("US")), columns={str(mrn): "m", str(fs.fields[1].path): "c"})
    assert link_equal(t, same).count() == 1


def test_session_lifecycle(spark):
    with pytest.raises(ValueError, match="version"):
        Session(b"", FieldSet("", ()))
    with Session(b"s", FS) as s:
        assert "secret" not in repr(s.tokenizer).lower()
    with pytest.raises(ValueError, match="destroyed"):
        s.deterministic(records(spark, person("a")))
    assert match([F.lit(1.0), F.lit(1.0)], F.array(F.lit(1), F.lit(1)), F.array(F.lit(1), F.lit(1)), FS, 1.0) is not None
    assert per_field(F.col("a"), F.col("b"), F.col("c"), F.col("d"), 0) == []


def test_a_hot_block_leaves_its_cells_in_batches(spark, monkeypatch):
    """A cell's pairs are not gathered: with every pair kept, each batch holds a bounded share of them."""
    s = Session(b"k", FS)
    rows = records(spark, *(person(f"n{k % 5}", "same") for k in range(600)))
    t = s.probabilistic(block_on(rows.withColumn("b", F.lit("hot")), s, "b", FAM))
    monkeypatch.setattr("veilmatch.operators.link.STEP_WORDS", 600 * 32 * 50)
    assert link_similar(t, t, FS, 0.0, block="block", keep_all=True).count() == 600 * 600
