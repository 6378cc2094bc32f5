"""Keyed tokens: HMAC-SHA256 and n-gram Bloom filters.

Two forms of each. The Arrow form keeps the secret in a closure whose text
shows nothing and is the default. The column form is pure SQL; its plan holds
pads from which the key follows, so it is for checks with throw-away keys.
"""

from __future__ import annotations

import hashlib
import hmac
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.schema import BloomConfig, FieldSet

#: Grams a worker remembers for each field.
MEMO_GRAMS = 200_000


class Secret:
    """Key bytes that do not show in text forms; ``destroy`` overwrites them."""

    def __init__(self, key: bytes):
        if not key:
            raise ValueError("token: secret must not be empty")
        self._key = bytearray(key)

    def __repr__(self) -> str:
        return "Secret(...)"

    def get(self) -> bytes:
        if not self._key:
            raise ValueError("token: secret is destroyed")
        return bytes(self._key)

    def destroy(self) -> None:
        for k in range(len(self._key)):
            self._key[k] = 0
        self._key = bytearray()


def framed(raw: bytes) -> bytes:
    return struct.pack(">I", len(raw)) + raw


def field_hmac(key: bytes, value: str, path: str) -> bytes:
    """Digest of the framed value and the framed path."""
    return hmac.digest(key, framed(value.encode()) + framed(path.encode()), "sha256")


def grams(text: str, sizes: tuple[int, ...]) -> list[str]:
    """Code point n-grams, size after size; duplicates stay."""
    return [text[k: k + n] for n in sizes for k in range(len(text) - n + 1)]


class _Stream:
    """64-bit numbers from HMAC in counter mode, four to a block.

    The inner and outer hash states are copied rather than computed anew, and
    the inner one has already taken in all but the counter.
    """

    def __init__(self, pads: tuple, label: bytes, path: str, value: str):
        self.inner, self.outer = pads[0].copy(), pads[1]
        self.inner.update(label + framed(path.encode()) + framed(value.encode()))
        self.counter, self.held = 0, []

    def block(self) -> bytes:
        inner = self.inner.copy()
        inner.update(self.counter.to_bytes(4, "big"))
        self.counter += 1
        outer = self.outer.copy()
        outer.update(inner.digest())
        return outer.digest()

    def next(self) -> int:
        if not self.held:
            self.held = list(struct.unpack(">4Q", self.block()))[::-1]
        return self.held.pop()

    def below(self, limit: int, count: int) -> int:
        """A number whose bit k tells whether the k-th draw's upper 53 bits are below ``limit``."""
        import numpy as np

        raw = b"".join(self.block() for _ in range(-(-count // 4)))
        hits = (np.frombuffer(raw, ">u8")[:count] >> np.uint64(11)) < limit
        return int.from_bytes(np.packbits(hits, bitorder="little").tobytes(), "little")


class BloomEncoder:
    """Filters of one field under one key."""

    def __init__(self, key: bytes, path: str, config: BloomConfig):
        self.base, self.path, self.config = hmac.new(key, digestmod="sha256"), path, config
        self.pads = tuple(map(hashlib.sha256, _pads(key)))
        self.tail = framed(path.encode())
        self.memo: dict[str, int] = {}

    def gram_bits(self, gram: str) -> int:
        bits = self.memo.get(gram)
        if bits is None:
            head = framed(gram.encode()) + self.tail
            bits = 0
            for k in range(self.config.hash_count):
                h = self.base.copy()
                h.update(head + struct.pack(">I", k))
                bits |= 1 << (int.from_bytes(h.digest()[:8], "big") % self.config.size_bits)
            if len(self.memo) >= MEMO_GRAMS:
                self.memo.clear()
            self.memo[gram] = bits
        return bits

    def encode(self, value: str | None) -> bytes:
        """Filter bytes, bit i at byte i // 8, bit i % 8; absent is all zero and never hardened."""
        c = self.config
        if value is None:
            return bytes(c.n_bytes)
        bits = 0
        for g in set(grams(value, c.ngram_sizes)):
            bits |= self.gram_bits(g)
        if c.flip_probability > 0:
            bits ^= _Stream(self.pads, b"blip:", self.path, value).below(int(c.flip_probability * (1 << 53)), c.size_bits)
        if bits.bit_count() < c.target_popcount:
            stream = _Stream(self.pads, b"balance:", self.path, value)
            while bits.bit_count() < c.target_popcount:
                bits |= 1 << (stream.next() % c.size_bits)
        return bits.to_bytes(c.n_bytes, "little")


def hmac_fields(values: Column, paths: list[str], secret: Secret) -> Column:
    """``array<binary>`` of an ``array<string>`` in path order; null stays null."""
    key = secret.get()

    @F.arrow_udf("array<binary>")
    def tokenise(rows):
        import pyarrow as pa

        bases = [framed(p.encode()) for p in paths]
        keyed = hmac.new(key, digestmod="sha256")

        def digest(v, tail):
            h = keyed.copy()
            h.update(framed(v.encode()) + tail)
            return h.digest()

        return pa.array([None if r is None else [None if v is None else digest(v, t) for v, t in zip(r, bases)] for r in rows.to_pylist()], pa.list_(pa.binary()))

    return tokenise(values)


def timed_bloom_fields(values: Column, paths: list[str], config: BloomConfig, secret: Secret) -> Column:
    """``struct<fields, ns>``: filters as ``bloom_fields`` gives them, and the nanoseconds that each record took."""
    key, encoders = secret.get(), []

    @F.arrow_udf("struct<fields: array<binary>, ns: bigint>")
    def tokenise(rows):
        import time

        import pyarrow as pa

        if not encoders:
            encoders.extend(BloomEncoder(key, p, config) for p in paths)
        fields, ns = [], []
        for r in rows.to_pylist():
            began = time.perf_counter_ns()
            fields.append(None if r is None else [e.encode(v) for e, v in zip(encoders, r)])
            ns.append(time.perf_counter_ns() - began)
        return pa.StructArray.from_arrays([pa.array(fields, pa.list_(pa.binary())), pa.array(ns, pa.int64())], ["fields", "ns"])

    return tokenise(values)


def bloom_fields(values: Column, paths: list[str], config: BloomConfig, secret: Secret) -> Column:
    """``array<binary>`` of filters; equal values of a batch are encoded once when hardened."""
    key, encoders = secret.get(), []

    @F.arrow_udf("array<binary>")
    def tokenise(rows):
        import pyarrow as pa

        if not encoders:
            encoders.extend(BloomEncoder(key, p, config) for p in paths)
        done: dict[tuple[int, str | None], bytes] = {}

        def filter_of(k, v):
            if not config.hardened:
                return encoders[k].encode(v)
            if (k, v) not in done:
                done[k, v] = encoders[k].encode(v)
            return done[k, v]

        return pa.array([None if r is None else [filter_of(k, v) for k, v in enumerate(r)] for r in rows.to_pylist()], pa.list_(pa.binary()))

    return tokenise(values)


# ---------------------------------------------------------------- column forms


def _pads(key: bytes) -> tuple[bytes, bytes]:
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    block = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def _blob(raw: bytes) -> Column:
    return F.unhex(F.lit(raw.hex()))


def _u32(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0"))


def hmac_column(key: bytes, message: Column) -> Column:
    """Lower-case hex HMAC-SHA256 of a binary column, in SQL."""
    inner, outer = _pads(key)
    return F.sha2(F.concat(_blob(outer), F.unhex(F.sha2(F.concat(_blob(inner), message), 256))), 256)


def field_hmac_column(key: bytes, value: Column, path: str) -> Column:
    raw = value.cast("binary")
    return F.when(value.isNotNull(), F.unhex(hmac_column(key, F.concat(_u32(F.octet_length(raw)), raw, _blob(framed(path.encode()))))))


def _gram_at(value: Column, n: int):
    return lambda i: F.substring(value, i, F.lit(n))


def grams_column(value: Column, sizes: tuple[int, ...]) -> Column:
    """``array<string>`` of n-grams, as ``grams`` gives them."""
    parts = []
    for n in sizes:
        spots = F.sequence(F.lit(1), F.length(value) - n + 1)
        parts.append(F.when(F.length(value) >= n, F.transform(spots, _gram_at(value, n))).otherwise(F.array().cast("array<string>")))
    return F.concat(*parts)


def positions_column(key: bytes, value: Column, path: str, config: BloomConfig) -> Column:
    """Sorted distinct bit positions of an unhardened filter, in SQL."""
    tail = _blob(framed(path.encode()))

    def spots(gram):
        raw = gram.cast("binary")
        head = F.concat(_u32(F.octet_length(raw)), raw, tail)
        return F.array(
            *((F.conv(F.substring(hmac_column(key, F.concat(head, _blob(struct.pack(">I", k)))), 1, 16), 16, 10).cast("decimal(20,0)") % config.size_bits).cast("int") for k in range(config.hash_count))
        )

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.array_distinct(grams_column(value, config.ngram_sizes)), spots))))


def words_of(filter_bytes: Column) -> Column:
    """``array<bigint>`` of a filter's little-endian 64-bit words."""

    def word(i):
        text = F.hex(F.substring(filter_bytes, i * 8 + 1, F.lit(8)))
        swapped = F.concat(*(F.substring(text, 15 - 2 * k, 2) for k in range(8)))
        return F.conv(swapped, 16, -10).cast("long")

    count = (F.octet_length(filter_bytes) / 8).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), word)).otherwise(F.array().cast("array<bigint>"))


def unpacked(fields: Column) -> Column:
    """``struct<words, pops>`` of an ``array<binary>`` of filters: each one's words, as ``words_of`` gives them, and its set bits."""

    @F.arrow_udf("struct<words: array<array<bigint>>, pops: array<int>>")
    def unpack(rows):
        import numpy as np
        import pyarrow as pa

        each = [x or b"" for x in rows.flatten().to_pylist()]
        words = np.frombuffer(b"".join(each), "<i8")
        ends = np.cumsum([0, *(len(x) // 8 for x in each)])
        set_bits = np.concatenate([[0], np.cumsum(np.bitwise_count(words.view(np.uint64)), dtype=np.int64)])
        inner = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(words))
        pops = pa.array(np.diff(set_bits[ends]).astype(np.int32))
        none = rows.is_null()
        sizes = np.array([0 if r is None else r for r in pa.compute.list_value_length(rows).to_pylist()], np.int64)
        outer = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(outer, x, mask=none) for x in (inner, pops)], ["words", "pops"])

    return unpack(fields)


def token_meta(fs: FieldSet, key_id: str | None) -> list[Column]:
    return [F.lit(fs.version).alias("field_set_version"), F.lit(key_id or "").alias("key_id"), F.lit(fs.fingerprint()).alias("field_set_fingerprint")]


def params_column(c: BloomConfig) -> Column:
    return F.struct(
        F.lit(c.size_bits).cast("long").alias("size_bits"),
        F.array(*(F.lit(n) for n in c.ngram_sizes)).alias("ngram_sizes"),
        F.lit(c.hash_count).alias("hash_count"),
        F.lit(float(c.flip_probability)).alias("flip_probability"),
        F.lit(c.target_popcount).cast("long").alias("target_popcount"),
    )
