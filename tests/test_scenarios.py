"""Whole scenarios over the default field set, with scores computed anew from the definitions in plain Python."""

import hashlib
import hmac

import pytest

from veilmatch.operators.evaluate import calibrate
from veilmatch.operators.link import link_equal, link_similar
from veilmatch.plans.schema import ADDRESS, DATE, HARDENED, NAME, default_field_set, path
from veilmatch.plans.session import Session

KEY = b"scenario key, not a real one"
FAMILY, BIRTH, TOWN = (str(p) for p in (path(NAME, "family"), path(DATE, "birth"), path(ADDRESS, "locality")))
WEIGHT = {FAMILY: 2.5, BIRTH: 2.0, TOWN: 1.0}


def voter(family, birth, town=None):
    return {FAMILY: family, BIRTH: birth} | ({TOWN: town} if town else {})


def bits(value, p):
    """Positions of a plain filter: three keyed hashes of every distinct 2-gram and 3-gram."""
    def framed(x):
        return len(x).to_bytes(4, "big") + x

    value, out = value.lower(), set()
    for g in {value[k: k + n] for n in (2, 3) for k in range(len(value) - n + 1)}:
        for k in range(3):
            digest = hmac.new(KEY, framed(g.encode()) + framed(p.encode()) + k.to_bytes(4, "big"), hashlib.sha256).digest()
            out.add(int.from_bytes(digest[:8], "big") % 2048)
    return out


def expected(a, b):
    top = bottom = 0.0
    for p in a.keys() | b.keys():
        x, y = (bits(r[p], p) if p in r else set() for r in (a, b))
        top += WEIGHT[p] * 2 * len(x & y) / (len(x) + len(y))
        bottom += WEIGHT[p]
    return top / bottom


def results(spark, session, pairs, threshold=0.7):
    schema = "id long, record map<string,string>, block long"
    a, b = (session.probabilistic(spark.createDataFrame([(k, p[side], k) for k, p in enumerate(pairs)], schema)) for side in (0, 1))
    return {r["id"]: r["result"] for r in link_similar(a, b, session.field_set, threshold, block="block", keep_all=True).collect()}


OKONKWO, SLIP, STRANGER = voter("Okonkwo", "1968-11-30", "Uppsala"), voter("Okonkvo", "1968-11-30", "Uppsala"), voter("Brandt", "2003-05-17", "Trieste")


def test_one_wrong_letter_breaks_equality_but_not_similarity(spark):
    session = Session(KEY, default_field_set())
    rows = [session.deterministic(spark.createDataFrame([(1, r)], "id int, record map<string,string>")) for r in (OKONKWO, SLIP)]
    assert link_equal(*rows).count() == 0 and link_equal(rows[0], rows[0]).count() == 1
    pairs = [(OKONKWO, SLIP), (OKONKWO, STRANGER), (SLIP, voter("Okonkvo", "1968-11-30")), (STRANGER, STRANGER)]
    got = results(spark, session, pairs)
    for k, pair in enumerate(pairs):
        assert got[k]["score"] == pytest.approx(expected(*pair), abs=1e-9) and got[k]["comparable_fields"] == 3
    assert got[0]["is_match"] and not got[1]["is_match"] and got[3]["score"] == 1.0


def test_hardening_draws_scores_together(spark):
    pairs = [(OKONKWO, OKONKWO), (OKONKWO, SLIP), (OKONKWO, STRANGER)]
    plain = results(spark, Session(KEY, default_field_set()), pairs)
    hard = results(spark, Session(KEY, default_field_set().with_bloom(HARDENED, "0.1-hardened")), pairs)
    assert hard[0]["score"] == plain[0]["score"] == 1.0
    assert plain[2]["score"] < hard[2]["score"] < hard[1]["score"] < 1.0


def test_calibration_separates_the_pairs(spark):
    people = [("Achterberg", "1951-02-08"), ("Delacroix", "1987-09-21"), ("Mwangi", "1999-12-01"), ("Szymanska", "1974-06-13")]
    same = [(voter(f, b), voter(f[:3] + f[4:], b)) for f, b in people]
    other = [(voter(*people[k]), voter(*people[(k + 1) % 4])) for k in range(4)]
    got = results(spark, Session(KEY, default_field_set()), same + other)
    scored = spark.createDataFrame([(got[k]["score"], k < 4) for k in range(8)], "score double, label boolean")
    best = calibrate(scored).first()
    assert best["f1"] == 1.0 and max(expected(*p) for p in other) < best["threshold"] <= min(expected(*p) for p in same)
