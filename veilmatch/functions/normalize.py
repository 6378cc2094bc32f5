"""Normalisation of person fields as Spark columns.

ASCII values stay in the JVM. All others take one path, an Arrow function that
repairs UTF-8, decomposes (NFKD), lower-cases, collapses white space and, for
names and identifiers, strips marks or separators. ``normalize`` gives a
struct of the value and an error; exactly one of them is set for a value that
is present, and none for null.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.schema import ADDRESS, CONTACT, DATE, IDENTIFIER, NAME, FieldPath, path

EMAIL, PHONE, COUNTRY = path(CONTACT, "email"), path(CONTACT, "phone"), path(ADDRESS, "country")

_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_INVALID = re.compile("[\udc80-\udcff]+")


def kind_of(p: FieldPath) -> str:
    """Which rule a path follows; dates, identifiers and names go by namespace alone."""
    for namespace in (DATE, IDENTIFIER, NAME):
        if p.in_namespace(namespace):
            return namespace
    return {EMAIL: "email", PHONE: "phone", COUNTRY: "country"}.get(p, "default")


def decode(raw: bytes) -> str:
    """UTF-8 with each run of invalid bytes as one U+FFFD."""
    return _INVALID.sub("\ufffd", raw.decode("utf-8", "surrogateescape"))


def fold(text: str, kind: str = "default") -> str:
    """The part of normalisation that needs Unicode tables."""
    text = _SPACE.sub(" ", unicodedata.normalize("NFKD", text).lower()).strip(" ")
    if kind == IDENTIFIER:
        return unicodedata.normalize("NFKD", text.translate({45: None, 46: None, 32: None}))
    if kind == NAME:
        text = "".join(c for c in text if unicodedata.category(c) != "Mn")
        return _SPACE.sub(" ", unicodedata.normalize("NFKD", text)).strip(" ")
    return text


def let(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed once, however often ``fn`` names it."""
    return F.transform(F.array(value), fn)[0]


def _folded(value: Column, kind: str) -> Column:
    @F.arrow_udf("string")
    def unicode_fold(raw):
        import pyarrow as pa

        return pa.array([None if x is None else fold(decode(x), kind) for x in raw.to_pylist()], pa.string())

    def plain(v: Column) -> Column:
        out = F.trim(F.regexp_replace(F.lower(v), r"[\t-\r ]+", " "))
        return F.translate(out, "-. ", "") if kind == IDENTIFIER else out

    def is_ascii(v: Column) -> Column:
        return F.rlike(v, F.lit(r"\A[\x00-\x7F]*\z"))

    native = let(value, lambda v: F.when(is_ascii(v), plain(v)))
    return F.coalesce(native, unicode_fold(let(value, lambda v: F.when(~is_ascii(v), v)).cast("binary")))


def _result(value: Column, *faults: tuple[Column, str]) -> Column:
    """First fault that holds gives the error; ``value`` is what stands otherwise."""
    error = F.lit(None).cast("string")
    if not faults:
        return F.struct(value.alias("value"), error.alias("error"))
    for holds, message in reversed(faults):
        error = F.when(holds, F.lit(message)).otherwise(error)
    return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"))


def rules(folded: Column, kind: str) -> Column:
    """Struct of value and error for a folded value; messages are fixed values."""
    v = folded
    if kind == DATE:
        bad = ~F.rlike(v, F.lit(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z")) | F.try_to_date(v, "yyyy-MM-dd").isNull()
        return _result(v, (v == "", "date value is empty"), (bad, "date must be ISO 8601 YYYY-MM-DD"))
    if kind == "email":
        ats = F.length(v) - F.length(F.replace(v, F.lit("@"), F.lit("")))
        local, domain = F.substring_index(v, "@", 1), F.rtrim(F.substring_index(v, "@", -1), F.lit("."))
        return _result(
            F.concat(local, F.lit("@"), domain),
            (F.contains(v, F.lit(" ")), "email must not contain whitespace"),
            (ats != 1, "email must contain exactly one '@'"),
            ((local == "") | (domain == ""), "email must have non-empty local and domain parts"),
        )
    if kind == "phone":
        digits = F.regexp_replace(v, "[^0-9]", "")
        return _result(F.concat(F.when(F.startswith(v, F.lit("+")), "+").otherwise(""), digits), (F.length(digits) < 7, "phone must contain at least 7 digits"))
    if kind == "country":
        return _result(
            F.upper(v), (F.length(v) != 2, "country code must be 2 characters"), (~F.rlike(v, F.lit("\\A[a-z\u0131]{2}\\z")), "country code must be 2 ASCII letters")
        )
    return _result(v)


def normalize(value: Column, p: FieldPath) -> Column:
    """``struct<value, error>`` of a string column under a path's rules; both null for null."""
    kind = kind_of(p)
    return let(_folded(value, kind), lambda v: F.when(v.isNotNull(), rules(v, kind)))


def normalize_value(value: str | bytes, p: FieldPath) -> str:
    """The same for one value in Python; raises ValueError. An independent form for tests."""
    kind = kind_of(p)
    v = fold(decode(value if isinstance(value, bytes) else value.encode("utf-8", "surrogateescape")), kind)
    if kind == DATE:
        from datetime import date

        if not v:
            raise ValueError("date value is empty")
        if not re.fullmatch("[0-9]{4}-[0-9]{2}-[0-9]{2}", v):
            raise ValueError("date must be ISO 8601 YYYY-MM-DD")
        try:
            date(int(v[:4]) or 2000, int(v[5:7]), int(v[8:]))
        except ValueError:
            raise ValueError("date must be ISO 8601 YYYY-MM-DD") from None
    elif kind == "email":
        if " " in v:
            raise ValueError("email must not contain whitespace")
        if v.count("@") != 1:
            raise ValueError("email must contain exactly one '@'")
        local, domain = v.split("@")
        domain = domain.rstrip(".")
        if not local or not domain:
            raise ValueError("email must have non-empty local and domain parts")
        return f"{local}@{domain}"
    elif kind == "phone":
        digits = re.sub("[^0-9]", "", v)
        if len(digits) < 7:
            raise ValueError("phone must contain at least 7 digits")
        return ("+" if v.startswith("+") else "") + digits
    elif kind == "country":
        if len(v) != 2:
            raise ValueError("country code must be 2 characters")
        if not re.fullmatch("[a-z\u0131]{2}", v):
            raise ValueError("country code must be 2 ASCII letters")
        return v.upper()
    return v
