"""Field paths, field sets and their fingerprints: metadata that plans are built from."""

from __future__ import annotations

import hashlib
import math
import struct
from dataclasses import dataclass, replace

#: The organisation of built-in paths. A path is part of every token's hash: parties that link must use the same one,
#: and whoever has tokens of paths under another name passes that name to ``path`` and ``default_field_set``.
ORG = "veilmatch"
# The namespaces of built-in paths.
NAME, IDENTIFIER, DATE, ADDRESS, CONTACT = "name", "identifier", "date", "address", "contact"


@dataclass(frozen=True)
class FieldPath:
    """``org::namespace::name``; only the first two separators split."""

    org: str
    namespace: str
    name: str

    @classmethod
    def parse(cls, text: str) -> FieldPath:
        parts = text.split("::", 2)
        if len(parts) != 3 or not all(parts):
            raise ValueError(f"invalid field path {text!r}: expected org::namespace::name")
        return cls(*parts)

    @classmethod
    def from_text(cls, text: str) -> FieldPath | None:
        """As ``parse``, but an empty text is no path."""
        return cls.parse(text) if text else None

    def __str__(self) -> str:
        return f"{self.org}::{self.namespace}::{self.name}"

    def in_namespace(self, namespace: str) -> bool:
        return self.namespace == namespace


def path(namespace: str, name: str, org: str = ORG) -> FieldPath:
    return FieldPath.parse(f"{org}::{namespace}::{name}")


@dataclass(frozen=True)
class FieldSpec:
    path: FieldPath
    required: bool = False
    weight: float = 1.0


@dataclass(frozen=True)
class BloomConfig:
    size_bits: int
    hash_count: int
    ngram_sizes: tuple[int, ...] = (2, 3)
    flip_probability: float = 0.0
    target_popcount: int = 0

    @property
    def hardened(self) -> bool:
        return self.flip_probability > 0 or self.target_popcount > 0

    @property
    def n_bytes(self) -> int:
        return -(-self.size_bits // 64) * 8

    def comparable(self, other: BloomConfig, strict: bool = False) -> bool:
        """Hardening is not compared unless ``strict``."""
        if strict:
            return self == other
        return (self.size_bits, self.hash_count, self.ngram_sizes) == (other.size_bits, other.hash_count, other.ngram_sizes)


FAST = BloomConfig(1024, 2)
DEFAULT = BloomConfig(2048, 3)
HIGH_PRECISION = BloomConfig(4096, 5)
HARDENED = BloomConfig(2048, 3, (2, 3), 0.02, 400)


@dataclass(frozen=True)
class FieldSet:
    version: str
    fields: tuple[FieldSpec, ...]
    bloom: BloomConfig = DEFAULT

    def validate(self) -> FieldSet:
        """Raises ValueError on the first fault; returns itself."""
        if not self.version:
            raise ValueError("fieldset: version must not be empty")
        seen = set()
        for f in self.fields:
            if f.path in seen:
                raise ValueError(f"fieldset: duplicate field path {f.path}")
            seen.add(f.path)
            if not f.weight >= 0 or math.isinf(f.weight):
                raise ValueError(f"fieldset: field {f.path} has negative weight {f.weight}")
        b = self.bloom
        if b.size_bits <= 0:
            raise ValueError("fieldset: size_bits must be > 0")
        if b.hash_count <= 0:
            raise ValueError("fieldset: hash_count must be > 0")
        if not b.ngram_sizes:
            raise ValueError("fieldset: ngram_sizes must not be empty")
        if min(b.ngram_sizes) <= 0:
            raise ValueError("fieldset: ngram_sizes must be > 0")
        if not 0 <= b.flip_probability < 1:
            raise ValueError("fieldset: flip_probability must be in [0, 1)")
        if not 0 <= b.target_popcount < b.size_bits:
            raise ValueError("fieldset: target_popcount must be < size_bits")
        return self

    def fingerprint(self) -> str:
        """SHA-256 of the set's length-prefixed encoding; hardening is not part of it."""

        def text(s: str) -> bytes:
            raw = s.encode()
            return struct.pack(">I", len(raw)) + raw

        out = text(self.version) + struct.pack(">I", len(self.fields))
        for f in self.fields:
            out += text(str(f.path)) + struct.pack(">Bd", f.required, f.weight)
        out += struct.pack(">III", self.bloom.size_bits, self.bloom.hash_count, len(self.bloom.ngram_sizes))
        out += b"".join(struct.pack(">I", n) for n in self.bloom.ngram_sizes)
        return hashlib.sha256(out).hexdigest()

    def paths(self) -> list[str]:
        return [str(f.path) for f in self.fields]

    def index(self, p: FieldPath) -> int:
        return self.paths().index(str(p))

    def with_bloom(self, bloom: BloomConfig, version: str | None = None) -> FieldSet:
        return replace(self, bloom=bloom, version=version or self.version)


# The default field set, in the order and with the weights that
# its fingerprint covers.
DEFAULT_VERSION = "0.1"
DEFAULT_FIELDS = (
    (IDENTIFIER, "national_id", 3.0),
    (IDENTIFIER, "passport", 3.0),
    (IDENTIFIER, "tax_id", 2.5),
    (NAME, "given", 2.0),
    (NAME, "family", 2.5),
    (NAME, "full", 1.5),
    (NAME, "middle", 1.0),
    (DATE, "birth", 2.0),
    (DATE, "death", 1.0),
    (DATE, "registration", 0.5),
    (ADDRESS, "country", 0.5),
    (ADDRESS, "admin_area", 0.5),
    (ADDRESS, "locality", 1.0),
    (ADDRESS, "postal_code", 1.0),
    (CONTACT, "email", 2.0),
    (CONTACT, "phone", 1.5),
)


def default_field_set(org: str = ORG) -> FieldSet:
    return FieldSet(DEFAULT_VERSION, tuple(FieldSpec(path(ns, n, org), False, w) for ns, n, w in DEFAULT_FIELDS), DEFAULT)
