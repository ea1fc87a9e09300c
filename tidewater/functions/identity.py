"""Hashes for identity, provenance and deterministic sampling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with sorted keys that keeps nulls."""
    struct = F.struct(*[c.alias(k) for k, c in sorted(fields.items())])
    return F.to_json(struct, {"ignoreNullFields": "false"})


def identity(**fields: Column) -> Column:
    """SHA-256 of the canonical JSON."""
    return F.sha2(canonical_json(**fields), 256)


def seeded_hash(seed: int, key: Column) -> Column:
    """SHA-256 of ``seed:key``, for hash-ordered sampling."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)
