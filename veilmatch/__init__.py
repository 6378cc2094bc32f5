"""Privacy-preserving record linkage on Spark DataFrames."""

from importlib import import_module

_HOMES = {
    "plans.schema": ("FieldPath", "FieldSpec", "FieldSet", "BloomConfig", "FAST", "DEFAULT", "HIGH_PRECISION", "HARDENED", "default_field_set", "path"),
    "plans.session": ("Session", "run", "calibrate_on", "block_on"),
    "operators.tokenize": ("Tokenizer", "comparable", "annotate", "describe"),
    "operators.link": ("link_equal", "link_similar", "best_match"),
}
__all__ = [name for names in _HOMES.values() for name in names]


def __getattr__(name: str):
    """Public names load on first use, so that workers import only what they run."""
    for home, names in _HOMES.items():
        if name in names:
            return getattr(import_module(f".{home}", __name__), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
