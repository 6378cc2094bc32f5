import hashlib
import hmac
import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilmatch.functions.tokens import BloomEncoder, Secret, bloom_fields, field_hmac, field_hmac_column, grams, grams_column, hmac_column, hmac_fields, positions_column, words_of
from veilmatch.plans.schema import DEFAULT, HARDENED, NAME, BloomConfig, path

GIVEN = str(path(NAME, "given"))


def bits(raw):
    return {8 * i + k for i, b in enumerate(raw) for k in range(8) if b >> k & 1}


def test_field_by_hand():
    m = struct.pack(">I", 5) + b"odile" + struct.pack(">I", len(GIVEN)) + GIVEN.encode()
    assert field_hmac(b"a key", "odile", GIVEN) == hmac.digest(b"a key", m, "sha256")


def test_hardened_bits_by_hand():
    """The keyed streams written out: label, framed path, framed value, counter; four numbers to a block."""
    def stream(label):
        head = label + struct.pack(">I", len(GIVEN)) + GIVEN.encode() + struct.pack(">I", 5) + b"odile"
        for counter in range(10**6):
            yield from struct.unpack(">4Q", hmac.digest(b"a key", head + struct.pack(">I", counter), "sha256"))

    want = bits(BloomEncoder(b"a key", GIVEN, DEFAULT).encode("odile"))
    want ^= {k for k, n in zip(range(2048), stream(b"blip:")) if n >> 11 < int(HARDENED.flip_probability * 2**53)}
    numbers = stream(b"balance:")
    while len(want) < HARDENED.target_popcount:
        want.add(next(numbers) % 2048)
    assert bits(BloomEncoder(b"a key", GIVEN, HARDENED).encode("odile")) == want


def test_bits_by_hand():
    c = BloomConfig(1000, 3, (2,))
    got = bits(BloomEncoder(b"k", "p", c).encode("abc"))
    want = set()
    for g in (b"ab", b"bc"):
        for k in range(3):
            m = struct.pack(">I", 2) + g + struct.pack(">I", 1) + b"p" + struct.pack(">I", k)
            want.add(int.from_bytes(hmac.digest(b"k", m, "sha256")[:8], "big") % 1000)
    assert got == want and len(BloomEncoder(b"k", "p", c).encode("abc")) == 128


@pytest.mark.parametrize("text,sizes,want", [("ab", (2,), ["ab"]), ("a", (2,), []), ("αβγ", (2,), ["αβ", "βγ"]), ("", (2,), []), ("ab", (3, 2), ["ab"]), ("abc", (2, 3), ["ab", "bc", "abc"]), ("aaa", (2,), ["aa", "aa"]), ("🙂🙃x", (2,), ["🙂🙃", "🙃x"])])
def test_grams(spark, text, sizes, want):
    assert grams(text, sizes) == want
    assert spark.createDataFrame([(text,)], "t string").select(grams_column(F.col("t"), sizes).alias("g")).first()["g"] == want


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=20), st.integers(1, 5))
def test_gram_counts(text, n):
    got = grams(text, (n,))
    assert len(got) == max(0, len(text) - n + 1) and all(len(g) == n for g in got)


@settings(max_examples=30, deadline=None)
@given(st.text(max_size=20))
def test_hardening(text):
    blip = BloomConfig(512, 2, (2, 3), 0.10)
    a, b = (BloomEncoder(b"s", GIVEN, blip).encode(text) for _ in range(2))
    assert a == b and len(a) == 64
    plain = BloomEncoder(b"s", GIVEN, BloomConfig(1024, 2)).encode(text)
    balanced = BloomEncoder(b"s", GIVEN, BloomConfig(1024, 2, (2, 3), 0.0, 200)).encode(text)
    assert len(bits(balanced)) == max(200, len(bits(plain))) and bits(plain) <= bits(balanced)


def test_absent_is_never_hardened():
    assert BloomEncoder(b"s", GIVEN, HARDENED).encode(None) == bytes(256)
    assert not any(BloomEncoder(b"s", GIVEN, DEFAULT).encode("a")) and len(bits(BloomEncoder(b"s", GIVEN, HARDENED).encode(""))) == 400


def test_memo_bound(monkeypatch):
    monkeypatch.setattr("veilmatch.functions.tokens.MEMO_GRAMS", 5)
    e, f = BloomEncoder(b"s", GIVEN, DEFAULT), BloomEncoder(b"s", GIVEN, DEFAULT)
    assert e.encode("a long enough value") == f.encode("a long enough value") and len(e.memo) <= 5


@pytest.mark.parametrize("key", [b"k", b"x" * 64, b"y" * 100])
def test_column_forms(spark, key):
    rng = random.Random(1)
    values = ["", "a", "ab", "héllo", "🙂x"] + ["".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 30))) for _ in range(20)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v string")
    secret, c = Secret(key), BloomConfig(1000, 3, (2, 3))
    rows = df.select(
        "v", hmac_column(key, F.col("v").cast("binary")).alias("h"), field_hmac_column(key, F.col("v"), GIVEN).alias("f"), hmac_fields(F.array("v"), [GIVEN], secret)[0].alias("g"),
        positions_column(key, F.col("v"), GIVEN, c).alias("p"), bloom_fields(F.array("v"), [GIVEN], c, secret)[0].alias("b"),
    ).collect()
    for r in rows:
        if r["v"] is None:
            assert r["f"] is None and r["g"] is None and not any(r["b"])
            continue
        assert r["h"] == hmac.new(key, r["v"].encode(), "sha256").hexdigest()
        assert bytes(r["f"]) == bytes(r["g"]) == field_hmac(key, r["v"], GIVEN)
        assert set(r["p"]) == bits(bytes(r["b"])) and r["p"] == sorted(r["p"])


def test_words(spark):
    raw = bytes(random.Random(2).randrange(256) for _ in range(64))
    got = spark.createDataFrame([(raw,), (b"",), (None,)], "b binary").select(words_of(F.col("b")).alias("w")).collect()
    assert got[0]["w"] == list(struct.unpack("<8q", raw)) and got[1]["w"] == []


def test_secret():
    with pytest.raises(ValueError):
        Secret(b"")
    s = Secret(b"key")
    assert "key" not in repr(s)
    s.destroy()
    with pytest.raises(ValueError):
        s.get()
