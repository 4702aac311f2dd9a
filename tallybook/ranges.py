"""Order over a whole table without one task that holds it: written ranges, and the numbers of their rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.session import shared_folder


def written(df: DataFrame, purpose: str, *partition_by: str) -> DataFrame:
    """The rows of ``df``, written to the shared folder and read again.

    It cuts the lineage: a lost executor costs the tasks that read it, not the work behind it.
    """
    path = shared_folder(df.sparkSession, purpose)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sorted_ranges(rows: DataFrame, order: Sequence[str | Column], purpose: str, *partition_by: str) -> DataFrame:
    """``rows`` written in ranges of ``order``, each sorted, with ``__task`` and ``__row``, the number in the task.

    Rows are dealt by all of ``order`` and a salt, so many equal rows do not meet in one task. Both numbers are
    long and ascend with ``order``; rows equal in it stand in any order, once and for all as they are written.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = rows.withColumn("__salt", F.xxhash64(F.monotonically_increasing_id()))
    dealt = dealt.repartitionByRange(*order, "__salt").drop("__salt").sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    dealt = dealt.withColumn("__at", at).select(
        *rows.columns,
        F.shiftright("__at", 33).alias("__task"),
        F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)).alias("__row"),
    )
    return written(dealt, purpose, *partition_by)


def numbered(rows: DataFrame, groups: Sequence[str], order: Sequence[str], purpose: str = "numbered") -> DataFrame:
    """``rows`` with ``place`` (long), gapless from 0 within each of ``groups``, ascending in ``order``, and the group's ``total``.

    Of each group and range only the first number and the count are aggregated, and turn the numbers of the ranges
    into places. ``groups`` must not hold nulls; nulls in ``order`` come first.
    """
    dealt = sorted_ranges(rows, [*groups, *order], purpose)
    runs = dealt.groupBy("__task", *groups).agg(F.min("__row").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy(*groups).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")
    total = F.sum("__n").over(Window.partitionBy(*groups))
    shifts = runs.select("__task", *groups, shift.alias("__shift"), total.alias("total"))
    placed = dealt.join(shifts, ["__task", *groups])
    return placed.select(*rows.columns, (F.col("__row") + F.col("__shift")).alias("place"), "total")
