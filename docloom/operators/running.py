"""Running sums over a global order, without putting all rows in one task.

Values in [0, 1] are cut into equal ranges; ranges are summed (partial aggregates), the few sums are
accumulated, and rows are accumulated within their range only. Ranges are many, so none holds much.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 4096


def running(df: DataFrame, value: str, sums: dict[str, Column], by: list[str] = (), descending: bool = True, ties: bool = True, order: list[str] = ()) -> DataFrame:
    """``df`` with running ``sums`` in the order of ``value`` (in [0, 1]) per group ``by``.

    With ``ties``, rows of equal value share the sum of all of them; else ``order`` decides among them.
    """
    by = list(by)
    at = df.withColumn("__r", F.least(F.floor(F.col(value) * RANGES), F.lit(RANGES - 1)))
    for n, c in sums.items():
        at = at.withColumn(f"__x_{n}", c)
    per = at.groupBy(*by, "__r").agg(*(F.sum(f"__x_{n}").alias(f"__s_{n}") for n in sums))
    before = Window.partitionBy(*by).orderBy(F.desc("__r") if descending else F.asc("__r")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(*by, "__r", *(F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums))
    key = F.desc(value) if descending else F.asc(value)
    inside = Window.partitionBy(*by, "__r").orderBy(key, *order)
    inside = inside.rangeBetween(Window.unboundedPreceding, Window.currentRow) if ties and not order else inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = at.withColumns({f"__l_{n}": F.sum(f"__x_{n}").over(inside) for n in sums})
    j = at.join(offsets, [*by, "__r"])
    return j.select(*df.columns, *((F.col(f"__l_{n}") + F.col(f"__o_{n}")).alias(n) for n in sums))


def percentile(df: DataFrame, value: str, share: float, by: list[str] = (), top: float = 1.0) -> DataFrame:
    """``(by, n, percentile)``: the exact percentile of ``value`` (in [0, ``top``], nulls left out), linear between neighbours.
    Without groups it is one row, of nulls if there is no value.

    Equal values are counted first, then places are running sums, so no group is held or sorted in one task.
    """
    by = list(by)
    rows = df.where(F.col(value).isNotNull()).groupBy(*by, (F.col(value).cast("double") / top).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    placed = running(rows, "__v", {"__end": F.col("__n")}, by, descending=False, ties=False, order=["__v"])
    total = rows.groupBy(*(F.col(c).alias(f"__k_{c}") for c in by)).agg(F.sum("__n").alias("n"))
    at = (F.col("n") - 1) * F.lit(float(share))
    total = total.withColumns({"__low": F.floor(at) + 1, "__part": at - F.floor(at)})
    on = [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in by] or [F.lit(True)]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    # Without a group the totals are a single row.
    j = placed.join(total if by else F.broadcast(total), condition)
    inside = lambda place: (F.col("__end") >= place) & (F.col("__end") - F.col("__n") < place)
    low = F.max(F.when(inside(F.col("__low")), F.col("__v")))
    high = F.max(F.when(inside(F.least(F.col("__low") + 1, F.col("n"))), F.col("__v")))
    got = j.groupBy(*by).agg(F.max("n").alias("n"), low.alias("__a"), high.alias("__b"), F.max("__part").alias("__p"))
    return got.select(*by, "n", ((F.col("__a") + F.col("__p") * (F.col("__b") - F.col("__a"))) * top).alias("percentile"))


def previous(df: DataFrame, by: str, index: str, order: list[str], columns: list[str], block: int = 1024) -> DataFrame:
    """``df`` with ``previous``: a struct of ``columns`` of the row before, per ``by``, in the order of ``index`` and ``order``.

    Null for the first row. A group is cut into blocks of ``block`` index values, which are sorted apart; only
    the last row of each block is carried over to the next. So a group with a third of all rows is many tasks.
    """
    at = df.withColumn("__b", F.floor(F.col(index) / block))
    inside = Window.partitionBy(by, "__b").orderBy(index, *order)
    value = F.struct(*columns)
    at = at.withColumn("__p", F.lag(value).over(inside))
    last = at.groupBy(by, "__b").agg(F.max_by(value, F.struct(index, *order)).alias("__v"))
    carried = last.select(F.col(by).alias("__k"), F.col("__b").alias("__c"), F.lag("__v").over(Window.partitionBy(by).orderBy("__b")).alias("__w")).where("__w is not null")
    j = at.join(carried, (F.col(by) == F.col("__k")) & (F.col("__b") == F.col("__c")), "left")
    return j.select(*df.columns, F.coalesce("__p", "__w").alias("previous"))
