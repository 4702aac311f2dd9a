"""What the operators of this package share: tables, written intermediate results, components."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallybook.session import shared_folder

#: ASCII blanks part words; everything else, of any script, belongs to a word.
BLANKS = r"[\x20\x09-\x0D]+"
NOT_BLANK = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, purpose: str, *partition_by: str) -> DataFrame:
    """The rows of ``df``, written to the shared folder and read again.

    It cuts the lineage: a lost executor costs the tasks that read it, not the work behind it.
    """
    path = shared_folder(df.sparkSession, purpose)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(rows: DataFrame, **columns: Column) -> DataFrame:
    """``withColumns``, but a later filter is not moved below them, where it would compute them over again."""
    own = F.struct(*[c.alias(name) for name, c in columns.items()])
    return rows.select(*rows.columns, F.inline(F.array(own)))


def words_of(text: Column) -> Column:
    """Words of a text as an array; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def numbered(rows: DataFrame, groups: Sequence[str], order: Sequence[str], purpose: str = "numbered") -> DataFrame:
    """``rows`` with ``place`` (long), gapless from 0 within each of ``groups``, ascending in ``order``, and the group's ``total``.

    Rows are dealt by ranges of all these columns and a salt, so neither a large group nor many equal rows meet in
    one task. Each task writes its sorted rows with their number in the task; of each group and task only the first
    number and the count are aggregated, and turn these numbers into places. ``groups`` must not hold nulls; rows
    equal in ``order`` (nulls come first) are numbered in any order, once and for all as they are written.
    """
    dealt = rows.withColumn("__salt", F.xxhash64(F.monotonically_increasing_id()))
    dealt = dealt.repartitionByRange(*groups, *order, "__salt").drop("__salt").sortWithinPartitions(*groups, *order)
    dealt = written(dealt.withColumn("__at", F.monotonically_increasing_id()), purpose)
    task, row = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    dealt = dealt.select(*rows.columns, task.alias("__task"), row.alias("__row"))
    runs = dealt.groupBy("__task", *groups).agg(F.min("__row").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy(*groups).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")
    total = F.sum("__n").over(Window.partitionBy(*groups))
    shifts = runs.select("__task", *groups, shift.alias("__shift"), total.alias("total"))
    placed = dealt.join(shifts, ["__task", *groups])
    return placed.select(*rows.columns, (F.col("__row") + F.col("__shift")).alias("place"), "total")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """Connected components of links ``a``, ``b`` (long): columns ``node``, ``component`` (smallest node).

    Alternating large-star and small-star steps; each is a grouped minimum and a join, and the links are
    written after each round, so neither a component nor the link list meets in one task or on the driver.
    Nodes without links are not listed. Null ends and loops are ignored.
    """
    links = written(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a is not null and b is not null and a <> b")
        .distinct(),
        "links",
    )
    before = None
    for _ in range(rounds):
        # Large star: neighbours above a node move to the smallest node around it.
        both = links.union(links.select("b", "a"))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: a node and its lower neighbours move to the lowest of these.
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least)
        links = written(small.where("a <> b").distinct(), "links")
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")
