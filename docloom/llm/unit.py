"""Stable hashing of keys to the unit interval, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit(*parts) -> Column:
    """A double in [0, 1) from the first 52 bits of the MD5 of the parts, joined by ``|``.

    It depends on nothing but the parts: not on partitions, row order, versions or other rows.
    """
    text = F.concat_ws("|", *(p if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
