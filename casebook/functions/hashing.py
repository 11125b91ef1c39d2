"""Pseudo-random choices that depend on the value only, never on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casebook.functions.text import column


def hash_number(c: str | Column, salt: int | str) -> Column:
    """The first 32 bits of ``md5('<salt>:<value>')`` as a long."""
    digest = F.md5(F.concat(F.lit(f"{salt}:"), column(c).cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def hash_bucket(c: str | Column, k: int | Column, salt: int | str) -> Column:
    """A number in ``0..k-1``, the same for equal values in every run."""
    return hash_number(c, salt) % (k if isinstance(k, Column) else F.lit(k))
