import hashlib

import pytest

from veilmatch.plans.schema import DEFAULT, FAST, HARDENED, HIGH_PRECISION, NAME, BloomConfig, FieldPath, FieldSet, FieldSpec, default_field_set, path

GIVEN, FAMILY = path(NAME, "given"), path(NAME, "family")


def test_paths():
    assert str(FieldPath.parse("a::b::c::d")) == "a::b::c::d" and FieldPath.parse("a::b::c::d").name == "c::d"
    for bad in ("", "a", "a::b", "::a::b", "a::::b", "a::b::"):
        with pytest.raises(ValueError):
            FieldPath.parse(bad)
    assert FieldPath.parse("acme::name::x").in_namespace("name")
    assert FieldPath.from_text("") is None and FieldPath.from_text("a::b::c") == FieldPath("a", "b", "c")


def test_public_names():
    import veilmatch

    assert all(getattr(veilmatch, n) is not None for n in veilmatch.__all__)
    with pytest.raises(AttributeError):
        veilmatch.nothing


def test_fingerprints():
    assert default_field_set().fingerprint() == "865cfb4997e71d285775a4e138309c379774adf68e887dfd3d8d31a195526aca"
    # the encoding written out: lengths before texts, numbers big-endian, a weight as its IEEE bits
    text = bytes.fromhex("00000002") + b"v1" + bytes.fromhex("00000001" "0000000d") + b"shop::id::tag" + bytes.fromhex("01" "3ff0000000000000" "00000400" "00000002" "00000001" "00000002")
    golden = FieldSet("v1", (FieldSpec(FieldPath.parse("shop::id::tag"), True, 1.0),), BloomConfig(1024, 2, (2,))).fingerprint()
    assert golden == hashlib.sha256(text).hexdigest()
    assert default_field_set("shop").fingerprint() != default_field_set().fingerprint() and default_field_set("shop").fields[0].path.org == "shop"


def test_fingerprint_sensitivity():
    base = FieldSet("v1", (FieldSpec(GIVEN, True, 1.0), FieldSpec(FAMILY, False, 2.0)), BloomConfig(1024, 2, (2, 3)))
    f = base.fields
    others = [
        FieldSet("v2", f, base.bloom), FieldSet("v1", f[::-1], base.bloom), FieldSet("v1", f[:1], base.bloom),
        FieldSet("v1", (FieldSpec(GIVEN, False, 1.0), f[1]), base.bloom), FieldSet("v1", (FieldSpec(GIVEN, True, 1.5), f[1]), base.bloom),
        base.with_bloom(BloomConfig(2048, 2, (2, 3))), base.with_bloom(BloomConfig(1024, 3, (2, 3))), base.with_bloom(BloomConfig(1024, 2, (3, 2))),
    ]
    assert len({x.fingerprint() for x in [base, *others]}) == 9
    assert base.with_bloom(BloomConfig(1024, 2, (2, 3), 0.02, 400)).fingerprint() == base.fingerprint()


@pytest.mark.parametrize(
    "version,fields,bloom",
    [
        ("", (FieldSpec(GIVEN),), DEFAULT), ("v", (FieldSpec(GIVEN), FieldSpec(GIVEN)), DEFAULT), ("v", (FieldSpec(GIVEN, False, -1.0),), DEFAULT),
        ("v", (FieldSpec(GIVEN, False, float("nan")),), DEFAULT), ("v", (), BloomConfig(0, 3)), ("v", (), BloomConfig(8, 0)), ("v", (), BloomConfig(8, -1)), ("v", (), BloomConfig(8, 1, ())),
        ("v", (), BloomConfig(8, 1, (2, 0))), ("v", (), BloomConfig(8, 1, (2,), -0.1)), ("v", (), BloomConfig(8, 1, (2,), 1.0)), ("v", (), BloomConfig(8, 1, (2,), 0.0, 8)),
    ],
)
def test_invalid_sets(version, fields, bloom):
    with pytest.raises(ValueError):
        FieldSet(version, fields, bloom).validate()


def test_presets_are_valid():
    for preset in (FAST, DEFAULT, HIGH_PRECISION, HARDENED):
        default_field_set().with_bloom(preset).validate()
    assert FieldSet("v", (FieldSpec(GIVEN, False, 0.0),)).validate().bloom == DEFAULT
    assert DEFAULT.comparable(HARDENED) and not DEFAULT.comparable(HARDENED, strict=True) and not DEFAULT.comparable(FAST)
