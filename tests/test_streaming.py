"""Streams give what the batch gives."""

import datetime as dt
import json
import random

import pandas as pd
import pytest

from tallybook.operators.validate import validate_invoices
from tallybook.sources.invoice_json import read_invoice_json
from tallybook.streaming import intake


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i in range(12):
        record = {"invoice_number": f"INV-{i}", "vendor_name": "V", "total_amount": i, "invoice_date": "2024-01-01"}
        body = record if i % 3 else [record, {"invoice_number": i}]
        (source / f"{i}.json").write_text(json.dumps(body))
    columns = ["invoice_number", "is_valid", "score", "errors", "warnings"]
    stream = intake.validate_stream(intake.json_stream(spark, str(source), files_per_batch=5), "2024-06-01")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    intake.append_available(stream.select(columns), out, checkpoint)
    intake.append_available(stream.select(columns), out, checkpoint)  # nothing new the second time
    batch = intake.validate_stream(read_invoice_json(spark, str(source)), "2024-06-01").select(columns)
    assert sorted(map(str, spark.read.parquet(out).collect())) == sorted(map(str, batch.collect()))
    assert batch.count() == 16


def test_repeats_within_a_second(spark, tmp_path):
    rng = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    uploads, moment = [], start
    for _ in range(400):
        moment += dt.timedelta(milliseconds=rng.choice([100, 300, 500, 999, 1000, 1500]))
        uploads.append((rng.choice(["a.pdf", "a.pdf", "a.pdf", "b.pdf"]), moment))
    source = str(tmp_path / "in")
    for part in range(4):  # four batches, in time order
        rows = uploads[part * 100 : part * 100 + 100]
        rng.shuffle(rows)
        spark.createDataFrame(rows, "file_name string, ts timestamp").coalesce(1).write.mode("append").parquet(source)
    stream = (
        spark.readStream.schema("file_name string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    )
    out = str(tmp_path / "out")
    intake.append_available(intake.suppress_duplicates(stream), out, str(tmp_path / "checkpoint"))

    last, expected = {}, []
    for name, at in uploads:
        if name not in last or at - last[name] >= dt.timedelta(seconds=1):
            last[name] = at
            expected.append((name, at))
    got = spark.read.parquet(out)
    assert sorted((r.file_name, r.ts) for r in got.collect()) == sorted(expected)
    assert not got.where("late").count()


def test_validation_is_the_same_code(spark):
    assert intake.validate_invoices is validate_invoices


def test_late_uploads_are_not_lost(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    source = str(tmp_path / "in")
    for part in ([100, 101.5], [50, 60, 98, 100.4], [-900]):
        rows = [(name, start + dt.timedelta(seconds=s)) for s in part for name in ("a.pdf", "b.pdf")]
        spark.createDataFrame(rows, "file_name string, ts timestamp").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("file_name string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    out = str(tmp_path / "out")
    intake.append_available(intake.suppress_duplicates(stream), out, str(tmp_path / "checkpoint"))
    got = sorted((r.file_name, (r.ts - start).total_seconds(), r.late) for r in spark.read.parquet(out).collect())
    each = [(-900.0, True), (50.0, False), (60.0, False), (98.0, False), (100.0, False), (101.5, False)]
    assert got == [(name, s, late) for name in ("a.pdf", "b.pdf") for s, late in each]


def test_accepted_uploads_follow_the_last_accepted(spark):
    rng = random.Random(6)
    start = dt.datetime(2024, 1, 1)
    uploads = [(rng.choice(["a", "b"]), start + dt.timedelta(milliseconds=100 * rng.randrange(900))) for _ in range(500)]
    uploads += [("c", start + dt.timedelta(seconds=s)) for s in (0, 0.6, 1.2)] + [(None, start), ("d", None)]
    got = intake.accepted_uploads(spark.createDataFrame(uploads, "file_name string, ts timestamp")).collect()
    last, expected = {}, []
    for name, at in sorted({u for u in uploads if None not in u}):
        if name not in last or at - last[name] >= dt.timedelta(seconds=1):
            last[name] = at
            expected.append((name, at))
    assert sorted(map(tuple, got)) == expected and ("c", start + dt.timedelta(seconds=1.2)) in expected


def chained(uploads):
    last, expected = {}, []
    for name, at in sorted(set(uploads)):
        if name not in last or at - last[name] >= dt.timedelta(seconds=1):
            last[name] = at
            expected.append((name, at))
    return expected


@pytest.mark.parametrize("block", [1, 2, 7, 64])
def test_blocks_decide_like_one_chain(spark, block):
    """Chains across blocks, blocks within one cooldown, gaps, and names of one upload."""
    rng = random.Random(block)
    start = dt.datetime(2024, 1, 1)
    uploads, at = [("c", start)], start
    for _ in range(900):
        at += dt.timedelta(microseconds=rng.choice([1, 999, 90_000, 400_000, 600_000, 999_999, 1_000_000, 9_000_000]))
        uploads.append((rng.choice("aaab"), at))
    uploads += [("d", start + dt.timedelta(microseconds=i)) for i in range(40)] + [("d", start + dt.timedelta(seconds=1))]
    frame = spark.createDataFrame(uploads + uploads[:9], "file_name string, ts timestamp")
    got = intake.accepted_uploads(frame, block=block)
    assert sorted(map(tuple, got.collect())) == chained(uploads)


class State:
    """The state of one group, as Spark hands it to the function."""

    def __init__(self):
        self.get, self.exists = None, False

    def update(self, value):
        self.get, self.exists = value, True


def test_names_out_of_use_are_forgotten():
    state, day = State(), pd.Timedelta(days=1)
    start = pd.Timestamp("2024-01-01")

    def arrive(rows):
        frame = pd.DataFrame(rows, columns=["file_name", "ts"])
        parts = list(intake._decide((0,), iter([frame]), state, 1_000_000, 600_000_000))
        return [tuple(r) for part in parts for r in part.itertuples(index=False)]

    assert len(arrive([(f"f{i}", start + pd.Timedelta(seconds=i)) for i in range(500)])) == 500
    assert len(state.get[0]) == 500
    arrive([("g", start + day)])
    assert state.get[0] == ["g"]
    # What comes behind the clock cannot be judged and says so; the state does not grow by it.
    assert arrive([("f3", start), ("new", start + day - pd.Timedelta(seconds=599))]) == [
        ("f3", start, True), ("new", start + day - pd.Timedelta(seconds=599), False),
    ]
    assert sorted(state.get[0]) == ["g", "new"]
    before_the_epoch = State()
    state = before_the_epoch
    assert arrive([("old", pd.Timestamp("1960-01-01"))])[0][2] is False
