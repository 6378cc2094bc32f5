import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilmatch.functions.normalize import decode, normalize, normalize_value
from veilmatch.plans.queries import QUERIES
from veilmatch.plans.schema import ADDRESS, CONTACT, DATE, IDENTIFIER, NAME, FieldPath, path

G, FAM, LOC, POST, COUNTRY = path(NAME, "given"), path(NAME, "family"), path(ADDRESS, "locality"), path(ADDRESS, "postal_code"), path(ADDRESS, "country")
BIRTH, REG, NID, MAIL, TEL = path(DATE, "birth"), path(DATE, "registration"), path(IDENTIFIER, "national_id"), path(CONTACT, "email"), path(CONTACT, "phone")

#: Raw value, path, and the result or (after !) part of the error; a block for each rule.
CASES = [
    # bytes, decomposition, case and white space, which all values share
    (b"Li\xc3\xa8ge", LOC, "lie\u0300ge"), (b"Sk\xfe\xfdne", LOC, "sk\ufffdne"), (b"\xe2\x82", LOC, "\ufffd"), ("\u2126hm \u33a5", LOC, "\u03c9hm m3"),
    ("GRO\u00df-GERAU", LOC, "gro\u00df-gerau"), ("\tSan\u2003 Jos\u00e9\n", LOC, "san jose\u0301"), ("u\u001dv", LOC, "u\u001dv"), ("\u0130zmir", LOC, "i\u0307zmir"), ("\u1680 ", LOC, ""),
    # names lose their marks
    ("Zo\u00eb", G, "zoe"), ("Zoe\u0308", G, "zoe"), ("N\u0169 \u1e9e", FAM, "nu \u00df"), ("\ufb02ynn", G, "flynn"), ("\u0308", G, ""), ("\uff2b\uff49\uff4d", G, "kim"),
    # dates
    ("1984-10-05", BIRTH, "1984-10-05"), ("\u00a01984-10-05", REG, "1984-10-05"), ("\uff11984-10-05", BIRTH, "1984-10-05"), ("2000-02-29", BIRTH, "2000-02-29"),
    ("1900-02-29", BIRTH, "!ISO 8601"), ("1984-00-05", BIRTH, "!ISO 8601"), ("1984-10-5", REG, "!ISO 8601"), ("5 Oct 1984", BIRTH, "!ISO 8601"), ("1984-10-05T00", BIRTH, "!ISO 8601"), (" ", BIRTH, "!empty"),
    # identifiers
    ("C-77. 04", NID, "c7704"), (". - .", NID, ""), ("\u00c7-9", NID, "c\u03279"), ("\u2460\u2461/3", NID, "12/3"),
    # countries
    ("se", COUNTRY, "SE"), (" No\t", COUNTRY, "NO"), ("\u0131s", COUNTRY, "IS"), ("swe", COUNTRY, "!2 characters"), ("s", COUNTRY, "!2 characters"), ("\u00dfe", COUNTRY, "!ASCII letters"), ("4x", COUNTRY, "!ASCII letters"),
    # addresses of mail
    (" Nils@Holgersson.SE.", MAIL, "nils@holgersson.se"), ("\u00f6@x.y", MAIL, "o\u0308@x.y"), ("nils", MAIL, "!exactly one"), ("n@h@s", MAIL, "!exactly one"), ("nils h@s.se", MAIL, "!whitespace"), ("@s.se", MAIL, "!non-empty"), ("nils@..", MAIL, "!non-empty"),
    # telephone numbers
    ("+46 (0)70-123 45", TEL, "+4607012345"), ("070/123 45 67", TEL, "0701234567"), ("00+4670123", TEL, "004670123"), (" (+46) 70123", TEL, "4670123"), ("(+46) 701", TEL, "!at least 7"), ("+", TEL, "!at least 7"),
    # other paths, and other organisations
    (" 114  55 ", POST, "114 55"), ("7-7 A", FieldPath.parse("shop::identifier::card"), "77a"), ("\u00c5", FieldPath.parse("shop::name::nick"), "a"), ("No Mail", FieldPath.parse("shop::contact::email"), "no mail"),
]


def by_spark(spark, values):
    """``(value, error)`` of (raw, path) pairs, in order."""
    out = [None] * len(values)
    for p in {p for _, p in values}:
        rows = [(k, v if isinstance(v, bytes) else v.encode()) for k, (v, q) in enumerate(values) if q == p]
        df = spark.createDataFrame(rows, "k int, raw binary").select("k", normalize(F.col("raw").cast("string"), p).alias("n"))
        for r in df.collect():
            out[r["k"]] = (r["n"]["value"], r["n"]["error"])
    return out


def test_tables(spark):
    got = by_spark(spark, [(v, p) for v, p, _ in CASES])
    for (raw, p, want), (value, error) in zip(CASES, got):
        if want.startswith("!"):
            assert value is None and want[1:] in error, (raw, p)
            with pytest.raises(ValueError, match="."):
                normalize_value(raw, p)
        else:
            assert (value, error) == (want, None), (raw, p)
            assert normalize_value(raw, p) == want


def test_null(spark):
    assert spark.range(1).select(normalize(F.lit(None).cast("string"), G).alias("n")).first()["n"] is None


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=30))
def test_idempotent(text):
    text = text.encode("utf-8", "replace").decode()
    for p in (G, NID, MAIL, TEL, LOC):
        try:
            once = normalize_value(text, p)
        except ValueError:
            continue
        assert normalize_value(once, p) == once


def test_native_path_equals_the_other_on_ascii(spark):
    values = ["".join(chr(k) for k in range(n, n + 12)) for n in range(0, 116, 7)] + [" a  b ", "A-B.C d", "+1 234 5678", "a@B.c.", "Us"]
    pairs = [(v, p) for v in values for p in (G, NID, MAIL, TEL, LOC, COUNTRY, BIRTH)]
    for (v, p), (value, error) in zip(pairs, by_spark(spark, pairs)):
        try:
            want = (normalize_value(v, p), None)
        except ValueError as e:
            want = (None, str(e))
        assert (value, error) == want, (v, p)


def test_decode_merges_runs_only():
    assert decode(b"\xff\xfea\xffb") == "�a�b" and decode("��".encode()) == "��"
    assert unicodedata.normalize("NFKD", decode(b"\xed\xa0\x80")) == "�"


def test_whole_texts_are_normalised(spark, tmp_path):
    texts = [None, "", "Ab  C" * 40 + " \u00c9nd ", "x" * 60 + "  \ufb01\u00a0\u00dc", " a" * 3000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["value"], r["error"]) for r in QUERIES["normalize_name"](spark, str(tmp_path)).collect()}
    assert got == {k: (None if t is None else normalize_value(t, G), None) for k, t in enumerate(texts)}
