"""Web archives: records with revisits, files, and a globally ordered index of captures.

``write_archives`` makes WARC files through Spark's writer, ``read_records`` reads them back by their lengths,
``capture_runs`` sorts each file's captures, and ``merge_runs`` merges the runs range by range with a loser tree.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

#: Payload bytes that a file aims at; a single larger record still makes a file.
FILE_BYTES = 16 << 20
#: Captures that a merge task aims at.
MERGE_ROWS = 500_000
#: Time of the first capture where the input has none; capture n comes n seconds later.
EPOCH = "2024-01-01T00:00:00Z"

#: Seconds after which dates that follow the key start anew, so that any key has one, in order while keys are below it.
DATED_KEYS = 1 << 37
LAST_MOMENT = "9999-12-31T23:59:59Z"

_CRLF = "\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def url_key(url: Column) -> Column:
    """Sort key of a url: reversed host labels, ``)`` and the rest; the scheme, ``www.`` and the port do not count."""
    whole = F.coalesce(F.lower(url), F.lit(""))
    rest = F.regexp_replace(whole, r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_extract(rest, r"^[^/?#]*", 0), r"^www\d*\.|:\d*$", "")
    path = F.regexp_replace(F.regexp_replace(rest, r"^[^/?#]*", ""), r"#.*$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(path == "", "/").otherwise(path))


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of the UTF-8 bytes; null counts as empty.

    Each 40 bits of the hash are a number, and each 5 of these a letter.
    """
    digest = F.sha1(F.coalesce(payload, F.lit("")))
    numbers = F.transform(F.array(*[F.lit(10 * i + 1) for i in range(4)]), lambda at: F.conv(F.substr(digest, at, F.lit(10)), 16, 10).cast("long"))
    shifts = F.array(*[F.lit(35 - 5 * i) for i in range(8)])

    def letters(number: Column) -> Column:
        return F.transform(shifts, lambda by: F.substr(F.lit(_BASE32), F.call_function("shiftright", number, by).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)))

    return F.array_join(F.flatten(F.transform(numbers, letters)), "")


def with_revisits(pages: DataFrame, key: str, payload: str, least_bytes: int = 0) -> DataFrame:
    """Adds ``payload_digest``, ``payload_bytes``, ``refers_to`` (null for responses).

    Of the rows with the same payload of ``least_bytes`` or more the smallest key is the response, as is
    each smaller payload. Only (digest, key) pairs are grouped, combined before the shuffle, and only
    digests that occur twice are joined back.
    """
    rows = pages.withColumns(
        {
            "payload_digest": payload_digest(F.col(payload)),
            "payload_bytes": F.coalesce(F.octet_length(F.col(payload)), F.lit(0)).cast("long"),
        }
    )
    slim = rows.where(F.col("payload_bytes") >= least_bytes).select("payload_digest", key)
    several = (
        slim.groupBy("payload_digest").agg(F.min(key).alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    )
    joined = rows.join(written(several, "revisits"), "payload_digest", "left")
    refers = F.when(F.col("__first") != F.col(key), F.col("__first"))
    return joined.withColumn("refers_to", F.when(F.col("payload_bytes") >= least_bytes, refers)).drop("__first")


def _urn(key: Column) -> Column:
    """A record id made of the page's key, in the form of a UUID."""
    digest = F.md5(F.concat(F.lit("page:"), key.cast("string")))
    parts = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def record_text(key: str, url: str, payload: str, date: str) -> Column:
    """One WARC/1.1 record but for its last line end. Revisits have the HTTP head alone.

    The URI has its line ends and blanks percent-encoded; a null one is ``urn:null``.
    """
    uri = F.coalesce(F.col(url), F.lit("urn:null"))
    for raw, code in (("\r", "%0D"), ("\n", "%0A"), (" ", "%20"), ("\t", "%09")):
        uri = F.replace(uri, F.lit(raw), F.lit(code))
    revisit = F.col("refers_to").isNotNull()
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(_CRLF * 2),
    )
    body = F.when(revisit, F.lit("")).otherwise(F.coalesce(F.col(payload), F.lit("")))
    length = F.octet_length(head) + F.octet_length(body)
    refers = F.concat(
        F.lit("WARC-Refers-To: "), _urn(F.col("refers_to")), F.lit(f"{_CRLF}WARC-Refers-To-Page: "),
        F.col("refers_to").cast("string"), F.lit(f"{_CRLF}WARC-Profile: "),
        F.lit(f"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{_CRLF}"),
    )
    return F.concat(
        F.lit(f"WARC/1.1{_CRLF}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{_CRLF}WARC-Record-ID: "), _urn(F.col(key)),
        F.lit(f"{_CRLF}WARC-Page-ID: "), F.coalesce(F.col(key).cast("string"), F.lit("")),
        F.lit(f"{_CRLF}WARC-Date: "), F.col(date), F.lit(f"{_CRLF}WARC-Target-URI: "), uri,
        F.lit(f"{_CRLF}WARC-Payload-Digest: sha1:"), F.col("payload_digest"), F.lit(_CRLF),
        F.when(revisit, refers).otherwise(F.lit("")),
        F.lit(f"Content-Type: application/http; msgtype=response{_CRLF}Content-Length: "), length.cast("string"),
        F.lit(_CRLF * 2), head, body, F.lit(_CRLF),
    )


def write_archives(
    pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", date: str | None = None
) -> None:
    """A folder of WARC files with a record for each row of ``pages``.

    ``date`` names a timestamp column; without it, capture n is n seconds after ``EPOCH``, n being the key modulo
    ``DATED_KEYS``. A record's date has four digits for the year, so moments are kept within years 1 to 9999, and texts
    of dates sort as the moments do. The files hold about ``FILE_BYTES`` each, by the mean size of a payload, so that a
    reader's task holds one file in memory.
    """
    last = F.lit(LAST_MOMENT).cast("timestamp")
    if date:
        moment = F.greatest(F.lit("0001-01-01T00:00:00Z").cast("timestamp"), F.least(last, F.col(date)))
        moment = F.when(F.col(date).isNotNull(), moment)
    else:
        after = F.pmod(F.coalesce(F.col(key), F.lit(0)).cast("long"), F.lit(DATED_KEYS))
        moment = F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH).cast("timestamp")) + after)
    stamped = pages.select(
        F.col(key), F.col(url), F.col(payload),
        F.coalesce(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(EPOCH)).alias("__date"),
    )
    mean = pages.agg(F.avg(F.coalesce(F.octet_length(F.col(payload)), F.lit(0)))).first()[0] or 1.0
    rows = with_revisits(stamped, key, payload)
    (
        rows.select(record_text(key, url, payload, "__date").alias("value"))
        .write.option("lineSep", _CRLF)
        .option("maxRecordsPerFile", max(1, int(FILE_BYTES / (mean + 700))))
        .text(path)
    )


_RECORD = pa.schema(
    [
        ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()),
        ("url", pa.string()), ("date", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_()),
    ]
)
RECORD = (
    "file string, offset long, length long, page_id long, url string, date string, record_type string, "
    "payload_bytes long, payload_digest string, refers_to long, intact boolean"
)


def parse_records(data: memoryview) -> Iterator[tuple[int, int, dict[str, str], memoryview]]:
    """``(offset, length, headers, block)`` of each record; lengths alone tell where a record ends."""
    at = 0
    while at < len(data):
        stop, step = -1, 4096
        while stop < 0:
            stop = bytes(data[at : at + step]).find(b"\r\n\r\n")
            if stop < 0 and at + step >= len(data):
                raise ValueError(f"no end of the record head at {at}")
            step *= 4
        first, *lines = bytes(data[at : at + stop]).decode().split(_CRLF)
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        head = dict(line.split(": ", 1) for line in lines)
        begin = at + stop + 4
        end = begin + int(head["Content-Length"])
        if bytes(data[end : end + 4]) != b"\r\n\r\n":
            raise ValueError(f"record at {at} does not end where its length says")
        yield at, end + 4 - at, head, data[begin:end]
        at = end + 4


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows = []
            for offset, length, head, block in parse_records(memoryview(content.as_buffer())):
                split = bytes(block[:4096]).find(b"\r\n\r\n") + 4
                payload = block[split:]
                stated = re.search(rb"\r\nContent-Length: (\d+)", bytes(block[:split]))
                size, digest = int(stated[1]), head["WARC-Payload-Digest"].removeprefix("sha1:")
                intact = True
                if head["WARC-Type"] == "response":
                    own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    intact, size, digest = own == digest and size == len(payload), len(payload), own
                page, refers = head["WARC-Page-ID"], head.get("WARC-Refers-To-Page")
                rows.append(
                    (
                        name, offset, length, int(page) if page else None, head["WARC-Target-URI"], head["WARC-Date"],
                        head["WARC-Type"], size, digest, int(refers) if refers else None, intact,
                    )
                )
            if rows:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RECORD, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=_RECORD)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives below ``path``.

    Sizes and digests of responses are of the payload read; ``intact`` says if the record states the same.
    Those of revisits are what the record states. Each task reads one file at a time.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").where("length(content) > 0").mapInArrow(_parsed, RECORD)


def capture_runs(records: DataFrame) -> DataFrame:
    """Captures with ``run``, sorted in the run by url key, date and page: ``seq`` counts from 0.

    A run is what a task holds at a time, the records of one file or of a few, named after its first record;
    nothing is shuffled. Null pages sort first.
    """
    columns = records.withColumn("url_key", url_key(F.col("url")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows.append_column("known", rows["page_id"].is_valid())
            order = rows.append_column("nth", pa.array(range(rows.num_rows))).sort_by(
                [("url_key", "ascending"), ("date", "ascending"), ("known", "ascending"), ("page_id", "ascending"), ("nth", "ascending")]
            )
            name = f"{batch.column(0)[0].as_py()}#{batch.column(1)[0].as_py()}" if batch.num_rows else ""
            order = order.drop_columns(["known", "nth"]).append_column("run", pa.array([name] * rows.num_rows, pa.string()))
            yield from order.append_column("seq", pa.array(range(rows.num_rows), pa.int64())).combine_chunks().to_batches()

    return columns.mapInArrow(run, f"{RECORD}, url_key string, run string, seq long")


class LoserTree:
    """k-way merge: each inner node keeps the loser of its match, so a new head plays one match a level."""

    def __init__(self, heads: list[tuple | None]):
        self.k = len(heads)
        self.heads = heads
        self.losers = [-1] * self.k
        for run in range(self.k - 1, -1, -1):
            self._play(run)

    def _before(self, a: int, b: int) -> bool:
        """Whether run ``a`` comes first; ended runs come last, and equal heads go by run."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return x is not None or (y is None and a < b)
        return (x, a) < (y, b)

    def _play(self, run: int) -> None:
        winner, node = run, (run + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = winner
                return
            if self._before(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    @property
    def winner(self) -> int:
        return self.losers[0]

    def replace(self, head: tuple | None) -> None:
        """The winning run's next head, or None at its end."""
        run = self.winner
        self.heads[run] = head
        winner, node = run, (run + self.k) // 2
        while node > 0:
            if self._before(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.losers[0] = winner


def merge_order(runs: list[list[tuple]]) -> Iterator[tuple[int, int]]:
    """``(run, place in it)`` in the order of all heads; the runs are sorted."""
    if not runs:
        return
    places = [0] * len(runs)
    tree = LoserTree([r[0] if r else None for r in runs])
    for _ in range(sum(map(len, runs))):
        run = tree.winner
        yield run, places[run]
        places[run] += 1
        tree.replace(runs[run][places[run]] if places[run] < len(runs[run]) else None)


def merge_runs(captures: DataFrame, ranges: int | None = None) -> DataFrame:
    """All captures in global order of url key, date and page, with ``part`` and ``position`` in it.

    The key space is cut into ranges of about ``MERGE_ROWS`` captures, and a task merges the pieces of all runs
    that fall into its range, so neither a run nor the index passes through one task. Ranges are cut by
    (url key, date, page): a url with a third of all captures spreads over many. Reading the parts in order
    gives the whole index; ``part`` and ``position`` sort it.
    """
    ranges = ranges or max(1, -(-captures.count() // MERGE_ROWS))
    dealt = captures.repartitionByRange(ranges, "url_key", "date", "page_id", "run", "seq")
    fields = captures.schema.fieldNames()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held).sort_by([("run", "ascending"), ("seq", "ascending")])
        names = rows["run"].to_pylist()
        cuts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
        pages = [(p is not None, p or 0) for p in rows["page_id"].to_pylist()]
        heads = list(zip(rows["url_key"].to_pylist(), rows["date"].to_pylist(), pages, strict=True))
        runs = [heads[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        order = [cuts[run] + place for run, place in merge_order(runs)]
        merged = rows.take(pa.array(order)).append_column("position", pa.array(range(len(order)), pa.int64()))
        yield from merged.combine_chunks().to_batches()

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in captures.schema) + ", position long"
    merged = dealt.mapInArrow(merge, schema).withColumn("part", F.spark_partition_id())
    return merged.select(*fields, "part", "position")


def archive_index(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes ``pages`` below ``folder`` as archives, reads them back and returns the merged index.

    A row for each page: ``page_id, payload_bytes, payload_digest, record_type, refers_to, intact, url, url_key,
    date, file, offset, length, run, seq, part, position``. Null payloads are empty ones; rows with a
    null key keep it, and as responses are never referred to by number. Repeated rows with one key are records
    of their own, and of equal payloads those with the smallest key are all responses. An empty table
    makes no archive and an empty index. Other columns are not read.
    """
    spark = pages.sparkSession
    write_archives(pages.select(key, url, payload), f"{folder}/archives", key, url, payload)
    capture_runs(read_records(spark, f"{folder}/archives")).write.parquet(f"{folder}/runs")
    runs = spark.read.parquet(f"{folder}/runs")
    merge_runs(runs).write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")
