"""Repeatable pseudo-random numbers drawn from row keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HASH_BITS = 32


def key_hash(seed, *keys) -> Column:
    """A number in [0, 2^32) from the seed and the key columns.

    Built on md5 so that any SQL engine draws the same number.  Keys must be
    integers or strings; the text of a double differs between engines.
    """
    parts = [F.lit(str(seed))] + [F.col(k) if isinstance(k, str) else k for k in keys]
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def unit_interval(hash_col) -> Column:
    """The hash as a double in [0, 1)."""
    return hash_col.cast("double") / F.lit(float(2**HASH_BITS))
