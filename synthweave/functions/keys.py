"""Deterministic draw keys shared by every sampler.

All draws are pure functions of ``(row key, seed)``: they do not depend on
partitioning, task order or retries, so a lost executor recomputes exactly the
same rows, and DuckDB reproduces them with the same ``md5`` expression.

* sort key: ``md5(concat(key, ':', seed))`` (hex string, compared as text)
* position: first 15 hex digits of that md5 read as an unsigned integer, mod N
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_str(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def hash_key(*parts, seed) -> Column:
    """``md5(concat(part1, ':', part2, ..., ':', seed))`` as a hex string."""
    pieces = []
    for p in parts:
        pieces += [_as_str(p), F.lit(":")]
    pieces.append(F.lit(str(seed)))
    return F.md5(F.concat(*pieces))


HASH_RANGE = 1 << 60


def hash_bits(*parts, seed) -> Column:
    """First 60 bits of :func:`hash_key` as a non-negative bigint."""
    return F.conv(F.substring(hash_key(*parts, seed=seed), 1, 15), 16, 10).cast("bigint")


def hash_order(*parts, seed) -> list[Column]:
    """:func:`hash_key` as three numbers that sort like it."""
    key = hash_key(*parts, seed=seed)
    return [F.conv(F.substring(key, at, size), 16, 10).cast("bigint") for at, size in ((1, 15), (16, 15), (31, 2))]


def hash_pos(*parts, seed, n) -> Column:
    """Uniform position in ``[0, n)`` derived from :func:`hash_bits`."""
    n_col = n if isinstance(n, Column) else F.lit(n)
    return F.pmod(hash_bits(*parts, seed=seed), n_col.cast("bigint"))
