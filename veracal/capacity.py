"""Estimates of what training needs, before anything is loaded."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bytes that an entry of the manifest takes at most.
FLOAT_BYTES, INDEX_BYTES, DIGEST_BYTES, EPOCH_BYTES, FIXED_BYTES = 24, 12, 67, 640, 1 << 16
MOST_MANIFEST = 4 << 30


def id_bytes(df: DataFrame) -> int:
    """The length of all ids as JSON strings."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("id"))) - 7), F.lit(0))).first()[0])


def manifest_bytes(rows: int, ids: int, epochs: int, iterations: int, resolution: float, classes: int) -> int:
    """An upper estimate of the manifest: provenance of every row, both distributions, the ladder and the history."""
    from .functions.scores import ladder

    per_row = 2 * FLOAT_BYTES + INDEX_BYTES + DIGEST_BYTES
    regions = len(ladder(resolution)) * (classes + 2) * FLOAT_BYTES
    return FIXED_BYTES + ids + rows * per_row + regions + epochs * iterations * EPOCH_BYTES


def require_capacity(rows: int, ids: int, epochs: int, iterations: int, resolution: float, classes: int) -> int:
    n = manifest_bytes(rows, ids, epochs, iterations, resolution, classes)
    if n > MOST_MANIFEST:
        raise ValueError(f"the manifest would take {n} bytes; {MOST_MANIFEST} are allowed")
    return n


def most_rows(ids_each: int, epochs: int, iterations: int, resolution: float, classes: int) -> int:
    """The most rows whose manifest fits, by bisection."""
    lo, hi = 0, MOST_MANIFEST
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if manifest_bytes(mid, mid * ids_each, epochs, iterations, resolution, classes) <= MOST_MANIFEST:
            lo = mid
        else:
            hi = mid - 1
    return lo


def input_bytes(rows: int, dimension: int) -> int:
    return rows * dimension * 4


def physical_memory() -> int:
    return os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")


def advice(rows: int, dimension: int) -> dict:
    """Input bytes against this machine's memory; informs, never stops."""
    need, have = input_bytes(rows, dimension), physical_memory()
    return {"inputBytes": need, "physicalBytes": have, "share": need / have, "comparisons": rows * rows}
