"""A total order over a whole table: ranges of the keys, sorted inside, and what comes before each range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ROW_BITS = 33  # of monotonically_increasing_id, below the number of the partition


def in_order(df: DataFrame, keys: Sequence[str | Column], tasks: int) -> DataFrame:
    """Rows of ``df`` dealt to ``tasks`` ranges of ``keys`` and sorted inside; partition after partition in ascending order.

    Rows with equal keys are dealt to several ranges if they are many, so they fill no task; nulls come first.
    """
    columns = df.columns
    names = [f"_k{i}" for i in range(len(keys))]
    held = df.select(*columns, *[(F.col(k) if isinstance(k, str) else k).alias(n) for k, n in zip(keys, names, strict=True)])
    held = held.withColumn("_tie", F.monotonically_increasing_id())
    return held.repartitionByRange(tasks, *names, "_tie").sortWithinPartitions(*names, "_tie").select(*columns)


def numbered(ordered: DataFrame) -> DataFrame:
    """``ordered`` with ``part`` and ``at``: the range of a row and its place there.  To be written before it is read twice."""
    at = F.monotonically_increasing_id()
    return ordered.withColumn("at", at).select(
        *ordered.columns, F.shiftright("at", _ROW_BITS).cast("int").alias("part"), F.col("at").bitwiseAND((1 << _ROW_BITS) - 1).alias("at")
    )


def bases(rows: DataFrame, size: Column) -> DataFrame:
    """(part, base, total): the sum of ``size`` over all ranges before ``part``, and over it; one row per range."""
    sums = rows.groupBy("part").agg(F.sum(size).alias("total"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"), "total")
