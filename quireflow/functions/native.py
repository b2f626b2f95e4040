"""Scalar building blocks as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def template(text: Column) -> Column:
    """White space collapsed, runs of ASCII digits masked: what repeated page furniture has in common."""
    return F.regexp_replace(F.trim(F.regexp_replace(text, "\\s+", " ")), "[0-9]+", "#")


def length_prefix(value: Column) -> Column:
    """Byte length of a string as eight bytes, least significant first."""
    big = F.lpad(F.hex(F.octet_length(value)), 16, "0")
    return F.unhex(F.concat(*[F.substring(big, 15 - 2 * i, 2) for i in range(8)]))


def stable_id(prefix: str, *parts: Column) -> Column:
    """``prefix_`` and the SHA-256 over every part, each with its length before it, so that no two part lists collide."""
    data = F.concat(*[F.concat(length_prefix(p), F.encode(p, "UTF-8")) for p in parts])
    return F.concat(F.lit(prefix + "_"), F.sha2(data, 256))


def nearest_percentile(values: Column, fraction: float) -> Column:
    """The sorted value at ``round((n-1)*fraction)`` of an array."""
    return F.element_at(F.array_sort(values), F.round((F.size(values) - 1) * F.lit(fraction)).cast("int") + 1)


def upper_median(values: Column) -> Column:
    return F.element_at(F.array_sort(values), F.floor(F.size(values) / 2).cast("int") + 1)
