"""Sharding by weighted rendezvous hashing of record keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows of a shard are numbered in so many slices, each by its own task.
SLICES = 1024


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key: that with the least ``-ln(u) / weight``, where ``u`` is a hash of key and shard.

    A shard's share of keys is its weight's share. A further shard only takes keys into itself, and a
    changed weight moves keys only to or from that shard. Ties go to the lower number. A shard of weight 0
    takes none.
    """
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights must not be negative, and one must be positive")
    scores = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11)
            unit = (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**53))
            scores.append(F.struct((-F.log(unit) / F.lit(float(weight))).alias("s"), F.lit(shard).alias("shard")))
    return F.array_min(F.array(*scores))["shard"] if len(scores) > 1 else scores[0]["shard"]


def record_key(key: Column, text: Column) -> Column:
    """Hash of the stable key; a record without a key goes by its text, and without both by a constant."""
    return F.xxhash64(F.coalesce(key.cast("string"), F.concat(F.lit("text:"), text)))


def assign_shards(df: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows with their ``shard`` (int). A projection; a column of that name in the input is replaced.

    Rows with equal keys share a shard. Null keys go by text. No row is dropped.
    """
    return df.withColumn("shard", rendezvous(record_key(F.col(key), F.col(text)), weights))


def number_slots(df: DataFrame, order: Sequence[str], slices: int = SLICES) -> DataFrame:
    """Rows with ``shard`` get ``slot`` (long), gapless from 0 in each shard.

    A shard is cut into slices by a hash of the row and the input partition, so that even equal rows
    spread. Slices are numbered apart and moved by the rows of the slices before them; the offsets are
    shards x slices rows, whatever the input. The rows are written first, so both passes see the same.
    """
    rows = df.withColumn("__slice", F.pmod(F.xxhash64(*order, F.spark_partition_id()), F.lit(slices)).cast("int"))
    rows = written(rows, "slots")
    sizes = rows.groupBy("shard", "__slice").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "shard", "__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).cast("long").alias("__start")
    )
    place = Window.partitionBy("shard", "__slice").orderBy(*order)
    return (
        rows.withColumn("__place", F.row_number().over(place))
        .join(F.broadcast(offsets), ["shard", "__slice"])
        .withColumn("slot", F.col("__start") + F.col("__place") - 1)
        .drop("__slice", "__start", "__place")
    )


def shard_documents(
    docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, key: str = "doc_id"
) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row of ``docs``.

    ``size`` is the UTF-8 bytes of ``text`` plus 1, ``grown_shard`` the shard under the weights ``grown``
    (null without). Null texts count as empty. Repeated rows are kept and have slots of their own; an empty
    table gives an empty result. Only these numbers are shuffled, no text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    hashed = record_key(F.col(key), F.col("text"))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(hashed, weights).alias("shard"),
        (rendezvous(hashed, grown) if grown else F.lit(None)).cast("int").alias("grown_shard"),
    )
    return number_slots(rows, ["doc_id", "text_crc32", "size"])


def write_shards(df: DataFrame, path: str, parts: int = 1) -> None:
    """One folder ``shard=N`` a shard, each of ``parts`` files or more; needs ``shard`` and ``slot``."""
    df.repartition(F.col("shard"), F.col("slot") % parts).write.partitionBy("shard").parquet(path)
