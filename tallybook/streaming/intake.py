"""Continuous intake: the batch validation on a stream, and suppression of repeated uploads."""

from __future__ import annotations

import bisect
import datetime as dt
import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallybook.operators import stats
from tallybook.operators.validate import validate_invoices
from tallybook.ranges import numbered, written
from tallybook.sources.invoice_json import load_invoices

COOLDOWN_MS = 1000


def json_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of invoices from JSON files arriving in a folder, one document per file."""
    text = (
        spark.readStream.option("wholetext", "true").option("maxFilesPerTrigger", files_per_batch).text(path)
    )
    return load_invoices(text, "value")


def validate_stream(invoices: DataFrame, as_of: str | dt.date | Column) -> DataFrame:
    """The batch validation on a stream. Unreadable records pass through as invalid."""
    validated = validate_invoices(invoices, as_of)
    if "load_error" not in invoices.columns:
        return validated
    good = F.col("load_error").isNull()
    return validated.withColumns(
        {
            "is_valid": F.col("is_valid") & good,
            "score": F.when(good, F.col("score")),
            "errors": F.when(good, F.col("errors")).otherwise(F.array("load_error")),
            "warnings": F.when(good, F.col("warnings")).otherwise(F.array().cast("array<string>")),
        }
    )


def append_available(stream: DataFrame, table: str, checkpoint: str) -> None:
    """Append everything that has arrived to a Parquet table and stop.

    The file sink commits each batch once, so a restarted run neither loses nor repeats rows.
    """
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", table)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def append_summaries(validated: DataFrame, folder: str, checkpoint: str) -> None:
    """Sum up every batch of validated invoices that has arrived, beside those summed up before, and stop.

    Each batch writes one row for the dashboard and its error counts to folders of its own, which a repeated
    batch replaces. So a restarted run neither loses nor repeats invoices, and no invoice is read again to show them.
    """

    def sum_up(batch: DataFrame, number: int) -> None:
        batch = written(batch.select("is_valid", "score", "errors", "total_amount"), "batch")
        stats.dashboard_partials(batch).write.mode("overwrite").parquet(f"{folder}/dashboard/batch={number}")
        stats.error_counts(batch).write.mode("overwrite").parquet(f"{folder}/errors/batch={number}")

    query = (
        validated.writeStream.foreachBatch(sum_up)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def summed_dashboard(spark: SparkSession, folder: str) -> DataFrame:
    """The dashboard over all batches that ``append_summaries`` has summed up."""
    return stats.fold_dashboard(spark.read.parquet(f"{folder}/dashboard"))


def summed_error_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The error counts over all batches that ``append_summaries`` has summed up."""
    return stats.fold_error_counts(spark.read.parquet(f"{folder}/errors"))


#: Uploads of a name that one task decides together.
BLOCK = 1 << 13


def accepted_uploads(uploads: DataFrame, cooldown_ms: int = COOLDOWN_MS, block: int = BLOCK) -> DataFrame:
    """Accepted uploads (``file_name``, ``ts``), in the order of their moments: none within ``cooldown_ms``
    of the last accepted one of the same name.

    Each upload leads on to the next one that would be accepted after it, and those accepted are what the first of a
    name leads to. Uploads are numbered by name and cut into blocks; within a block all follow these pointers at
    once. A name of several blocks needs only the uploads by which a block can be entered, those within the
    cooldown of its start: they are followed by doubling, a join for every factor of two in the number of blocks.
    So neither a busy name nor an endless chain meets in one task. Rows without a name or a moment are no uploads.
    """
    cooldown = cooldown_ms * 1000
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = uploads.select("file_name", micros.alias("at")).where("file_name is not null and at is not null").distinct()
    placed = numbered(written(rows, "uploads"), ["file_name"], ["at"], "uploads")
    blocks = placed.withColumn("block", F.floor(F.col("place") / F.lit(block)))
    blocks = blocks.groupBy("file_name", "block").agg(F.sort_array(F.collect_list("at")).alias("moments"), F.max("total").alias("total"))
    blocks = written(blocks, "uploads")
    starts = _block_starts(blocks.where(F.col("total") > block), cooldown, block)
    first = F.when(F.col("block") == 0, F.get("moments", F.lit(0)))
    entered = blocks.join(starts, ["file_name", "block"], "left").withColumn("entry", F.coalesce(first, "start"))
    decided = entered.where("entry is not null").select("file_name", "moments", "entry")
    accepted = decided.mapInArrow(functools.partial(_accepted, cooldown=cooldown), "file_name string, at long")
    return accepted.select("file_name", F.timestamp_micros("at").alias("ts"))


def _block_starts(blocks: DataFrame, cooldown: int, block: int) -> DataFrame:
    """``file_name, block, start``: the first accepted upload of each block that has one, of names with several blocks."""
    ways = "file_name string, block long, at long, last long"
    entries = written(blocks.mapInArrow(functools.partial(_entries, cooldown=cooldown), ways), "uploads")
    # The next accepted upload is the first entry that is the cooldown behind the last one of the block.
    arrivals = entries.select("file_name", F.col("at").alias("moment"), F.lit(0).alias("kind"), "at", F.lit(None).cast("long").alias("of"))
    asked = entries.select("file_name", (F.col("last") + cooldown).alias("moment"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("at"), F.col("at").alias("of"))
    backwards = Window.partitionBy("file_name").orderBy(F.desc("moment"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    following = F.last("at", ignorenulls=True).over(backwards)
    both = arrivals.unionByName(asked).withColumn("to", following).where("kind = 1 and to is not null")
    jumps = written(both.select("file_name", F.col("of").alias("at"), "to"), "uploads")
    reached = entries.where("block = 0").select("file_name", "at")
    most = blocks.agg(F.max("total")).first()[0] or 0
    for _ in range((-(-most // block)).bit_length()):
        further = reached.join(jumps, ["file_name", "at"]).select("file_name", F.col("to").alias("at"))
        reached = written(reached.unionByName(further).distinct(), "uploads")
        twice = jumps.select("file_name", F.col("at").alias("of"), F.col("to").alias("at")).join(jumps, ["file_name", "at"])
        jumps = written(twice.select("file_name", F.col("of").alias("at"), "to"), "uploads")
    return entries.join(reached, ["file_name", "at"]).select("file_name", "block", F.col("at").alias("start"))


def _pointers(batch: pa.RecordBatch, cooldown: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the sorted moments of some rows: the moments, each row's bounds, positions, and the next accepted one.

    Positions grow by the time that passes, but by no more than the cooldown, and by that from row to row; so they stay
    small, and all rows are searched at once. The last accepted moment of a row points to itself.
    """
    lists = batch["moments"]
    at = lists.flatten().to_numpy()
    bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    steps = np.minimum(np.diff(at, prepend=at[:1]), cooldown)
    steps[bounds[:-1]] = cooldown
    position = np.cumsum(steps)
    following = np.searchsorted(position, position + cooldown)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    return at, bounds, position, np.where(following < ends, following, np.arange(len(at)))


def _entries(batches: Iterator[pa.RecordBatch], cooldown: int) -> Iterator[pa.RecordBatch]:
    """For each upload by which a block can be entered, the last accepted moment of the block if it is."""
    for batch in batches:
        if not len(batch):
            continue
        at, bounds, position, last = _pointers(batch, cooldown)
        while (last[last] != last).any():
            last = last[last]
        stop = np.minimum(np.searchsorted(position, position[bounds[:-1]] + cooldown) + 1, bounds[1:])
        stop = np.where(batch["block"].to_numpy() == 0, bounds[:-1] + 1, stop)
        row = np.repeat(np.arange(len(batch)), stop - bounds[:-1])
        spot = np.concatenate([np.arange(a, b) for a, b in zip(bounds[:-1], stop, strict=True)])
        columns = [batch["file_name"].take(pa.array(row)), batch["block"].take(pa.array(row)), pa.array(at[spot]), pa.array(at[last[spot]])]
        yield pa.record_batch(columns, ["file_name", "block", "at", "last"])


def _accepted(batches: Iterator[pa.RecordBatch], cooldown: int) -> Iterator[pa.RecordBatch]:
    """The uploads that the entries of their blocks lead to."""
    for batch in batches:
        if not len(batch):
            continue
        at, bounds, _, jump = _pointers(batch, cooldown)
        row = np.repeat(np.arange(len(batch)), np.diff(bounds))
        taken = at == batch["entry"].to_numpy()[row]
        while (jump[jump] != jump).any():
            taken[jump[taken]] = True
            jump = jump[jump]
        taken[jump[taken]] = True
        spot = np.flatnonzero(taken)
        yield pa.record_batch([batch["file_name"].take(pa.array(row[spot])), pa.array(at[spot])], ["file_name", "at"])


#: Groups that the names of a stream fall into. Each keeps its own clock, and only names that clock has not left behind.
BUCKETS = 4096


def _decide(
    key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, cooldown: int, horizon: int
) -> Iterator[pd.DataFrame]:
    names, moments, clock = state.get if state.exists else ([], [], -(1 << 62))
    kept = {name: list(own) for name, own in zip(names, moments, strict=True)}
    arrived = pd.concat(list(frames))
    arrived["at"] = arrived["ts"].to_numpy("datetime64[us]").astype("int64")
    out = []
    for name, rows in arrived.groupby("file_name", sort=True):
        own = kept.get(name, [])
        for at in np.unique(rows["at"].to_numpy()).tolist():
            if at < (own[-1] - horizon if own else clock):
                out.append((name, at, True))
                continue
            place = bisect.bisect(own, at)
            if all(abs(at - k) >= cooldown for k in own[max(0, place - 1) : place + 1]):
                own.insert(place, at)
                out.append((name, at, False))
        kept[name] = own
    newest = max((own[-1] for own in kept.values() if own), default=clock)
    # A name is forgotten once the group's newest upload is the horizon ahead of its own last one.
    clock = max(clock, newest - horizon)
    left = {name: [k for k in own if k >= own[-1] - horizon] for name, own in kept.items() if own and own[-1] >= clock}
    state.update((list(left), list(left.values()), clock))
    if out:
        names, at, late = zip(*out, strict=True)
        yield pd.DataFrame({"file_name": list(names), "ts": np.array(at, "datetime64[us]"), "late": list(late)})


def suppress_duplicates(uploads: DataFrame, horizon: str = "600 seconds", buckets: int = BUCKETS) -> DataFrame:
    """Accepted uploads of a stream (``file_name``, ``ts``, ``late``), decided as they arrive.

    An upload is dropped only if it is within a second of an accepted one of the same name, before or
    after. One that arrives more than ``horizon`` behind the newest accepted upload of its name cannot be
    judged and is returned with ``late`` set; nothing else is left out. In disturbed order the first to
    arrive wins; ``accepted_uploads`` over the stored uploads decides by moment instead.

    Names are kept by groups of their hash. A group's clock is its newest accepted upload less the horizon: names whose
    last upload lies before it are forgotten, and an upload of an unknown name that lies before it is late. So the
    state holds the accepted moments within the horizon of names that are still in use, however many there were; a
    watermark would expire names as well, but drop what comes late unseen.
    """
    seconds = float(horizon.split()[0])
    decide = functools.partial(_decide, cooldown=COOLDOWN_MS * 1000, horizon=int(seconds * 1_000_000))
    rows = uploads.select("file_name", F.col("ts").cast("timestamp").alias("ts")).where("file_name is not null and ts is not null")
    return (
        rows.withColumn("bucket", F.pmod(F.xxhash64("file_name"), F.lit(buckets)).cast("int"))
        .groupBy("bucket")
        .applyInPandasWithState(
            decide,
            outputStructType="file_name string, ts timestamp, late boolean",
            stateStructType="names array<string>, kept array<array<bigint>>, clock bigint",
            outputMode="append",
            timeoutConf=GroupStateTimeout.NoTimeout,
        )
    )
