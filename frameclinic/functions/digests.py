"""Reproducible pseudo-random numbers as column expressions.

A row's random number is the md5 of a salt and the row key. It needs no state,
gives the same value on every executor and every retry, and can be recomputed by
any other SQL engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hex digits per refinement step of a digest histogram: 16**3 = 4096 buckets.
PREFIX_DIGITS = 3


def row_digest(*parts: Column | str) -> Column:
    """md5 of ``parts`` joined by ``:``; strings are column names."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in columns]))


def digest_prefix(digest: Column | str, digits: int = PREFIX_DIGITS) -> Column:
    return F.substring(digest, 1, digits)


def digest_choice(digest: Column, options: tuple[float, ...]) -> Column:
    """One of ``options``, drawn uniformly by the last 7 hex digits of ``digest``."""
    number = F.conv(F.substring(digest, 26, 7), 16, 10).cast("long")
    index = (number % F.lit(len(options))).cast("int")
    return F.element_at(F.array(*[F.lit(float(o)) for o in options]), index + 1)
