"""Corpus curation and robustness analytics on PySpark.

The names below can be imported from here; each is loaded when it is asked for,
so that a worker that needs one module doesn't load them all.
"""

_PLACES = {
    "textmill.functions.keys": ("alnum_key", "author_group", "exact_key", "group_id", "matches", "normalized_key", "obfuscation_candidate", "quality_flags", "quality_status", "subtype", "whitespace_key"),
    "textmill.operators.evaluate": ("bootstrap_ci", "flips", "metrics", "paired"),
    "textmill.operators.graph": ("components",),
    "textmill.operators.obfuscate": ("FAMILIES", "SEED", "SEVERITIES", "Obfuscation", "edit_distance", "hash_mode", "mt_mode", "normalize_homoglyphs", "obfuscate", "open_spans", "protected", "protected_spans", "spans_kept"),
    "textmill.operators.pool": ("canonical", "conflicts", "harmonise", "isolate", "keyed", "pairwise_overlap", "reconciliation", "with_near_duplicates"),
    "textmill.operators.nearcopies": ("clusters",),
    "textmill.operators.shingles": ("exact_pairs", "minhash"),
}
_HOME = {name: place for place, names in _PLACES.items() for name in names}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    from importlib import import_module

    return getattr(import_module(_HOME[name]), name)
