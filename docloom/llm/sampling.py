"""A reproducible sample that only grows as data grows.

A record's key is hashed with a fixed salt to the unit interval; it is in the sample if the value
is below the rate of its stratum. Nothing else matters: not the partitions, the order, the run
or the other records. So what was drawn once stays drawn when records are added or a rate is
raised, and records with one key (say, one template) are treated alike. No shuffle is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.unit import unit


def stable_sample(df: DataFrame, key: Column, rate: float | dict[str, float], stratum: Column | None = None, salt: str = "sample") -> DataFrame:
    """The rows of ``df`` in the sample, with their ``unit`` value (an existing column of that name is replaced).

    ``rate`` is one share, or one per value of ``stratum``; rows with a null key or without a rate
    are not drawn. A rate of 0 draws nothing, of 1 or more everything.
    """
    if isinstance(rate, dict):
        limit = F.lit(None).cast("double")
        for name, share in rate.items():
            limit = F.when(stratum == name, F.lit(float(share))).otherwise(limit)
    else:
        limit = F.lit(float(rate)) if stratum is None else F.when(stratum.isNotNull(), F.lit(float(rate)))
    rows = df.withColumn("unit", F.when(key.isNotNull(), unit(salt, key)))
    return rows.where(F.col("unit") < limit)
