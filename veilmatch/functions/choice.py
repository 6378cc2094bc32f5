"""Choices that look random and are hashes: SHA-256 of a key and a salt.

They are the same in every run, on every cluster and in any SQL engine that
knows SHA-256.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(key: Column, salt: str) -> Column:
    """Fifteen hexadecimal digits that depend on the key's text and the salt."""
    return F.substring(F.sha2(F.concat(key.cast("string"), F.lit(f"|{salt}")), 256), 1, 15)


def pick(key: Column, salt: str, n: Column | int) -> Column:
    """A number from 0 to n - 1 (long) that depends on the key and the salt; 0 where n is."""
    over = F.lit(n) if isinstance(n, int) else n
    return F.pmod(F.conv(digits(key, salt), 16, 10).cast("long"), F.greatest(over.cast("long"), F.lit(1).cast("long")))
