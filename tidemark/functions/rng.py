"""Randomness from hashes of a seed, a stream name and an index.

A draw depends on its arguments only, never on partitions, row order or retries, and any
engine with MD5 can repeat it.
"""

from __future__ import annotations

import hashlib
import math
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column
from pyspark.sql import functions as F


_FAST: ContextVar[bool] = ContextVar("fast", default=False)


@contextmanager
def drawing(fast: bool):
    """Within it, ``uniform`` and ``normal`` are hashes that only Spark can repeat, several times cheaper than MD5 (or not)."""
    token = _FAST.set(fast)
    try:
        yield
    finally:
        _FAST.reset(token)


def _part(x) -> Column:
    return x.cast("string") if isinstance(x, Column) else F.lit(str(x))


def uniform(*parts) -> Column:
    """A number in (0, 1): (first 32 bits of the MD5 of the parts joined by ``|`` + 0.5) / 2**32, or ``fast_uniform`` (see ``drawing``)."""
    if _FAST.get():
        return fast_uniform(*parts)
    digest = F.md5(F.concat_ws("|", *[_part(p) for p in parts]).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / float(2**32)


def normal(*parts) -> Column:
    """A standard normal number (Box-Muller over two streams)."""
    return F.sqrt(-2.0 * F.log(uniform(*parts, "a"))) * F.cos(2.0 * math.pi * uniform(*parts, "b"))


def fast_uniform(*parts) -> Column:
    """A number in (0, 1) from xxHash64: cheaper, but only Spark can repeat it."""
    return (F.shiftrightunsigned(F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts]), 11).cast("double") + 0.5) * 2.0**-53


def draw(*parts) -> float:
    """``uniform`` on the driver."""
    return (int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) + 0.5) / 2**32


def seed_of(*parts) -> int:
    """A derived 32-bit seed: the first 8 bytes of the SHA-256 of the joined parts modulo 2**32."""
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[8:16], 16)


def seed_column(*parts) -> Column:
    """``seed_of`` as a column."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *[_part(p) for p in parts]).cast("binary"), 256), 9, 8), 16, 10).cast("long")
