"""The invoice and file tables: rows to store, lookups, pages, and deletes.

Tables are plain DataFrames (Parquet underneath). A delete returns the remaining rows, to be
written as the next snapshot of the table.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallybook.functions.pycompat import truthy_text
from tallybook.ranges import sorted_ranges, written
from tallybook.schema import INVOICE_FIELDS
from tallybook.sources.files import content_type

TEXTS = "array<string>"


def _or_null(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _or_default(df: DataFrame, name: str, default: Column) -> Column:
    return F.coalesce(F.col(name), default) if name in df.columns else default


def to_store(df: DataFrame, created_at: str | dt.datetime | Column, key: str = "invoice_id") -> DataFrame:
    """Validated invoices as stored records. No currency becomes USD; no validation, invalid with 0."""
    at = created_at if isinstance(created_at, Column) else F.lit(str(created_at)).cast("timestamp_ntz")
    currency = F.when(truthy_text(F.col("currency")), F.col("currency")).otherwise("USD")
    fields = [currency.alias(f) if f == "currency" else F.col(f) for f in INVOICE_FIELDS]
    items = [F.col(c) for c in ("line_items", "item_count", "items_total", "extraction_metadata") if c in df.columns]
    none = F.array().cast(TEXTS)
    return df.select(
        key,
        *fields,
        *items,
        _or_default(df, "is_valid", F.lit(False)).alias("is_valid"),
        _or_default(df, "score", F.lit(0)).alias("validation_score"),
        _or_default(df, "errors", none).alias("validation_errors"),
        _or_default(df, "warnings", none).alias("validation_warnings"),
        _or_null(df, "file_id").alias("file_id"),
        _or_null(df, "file_name").alias("file_name"),
        _or_null(df, "file_type").alias("file_type"),
        at.alias("created_at"),
        at.alias("updated_at"),
    )


def to_file_store(files: DataFrame) -> DataFrame:
    """Files read with their content as rows of the file table.

    The id is derived from path and content, so a task that is run again gives the same id.
    """
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    return files.select(
        F.sha2(F.concat_ws("|", F.col("path"), F.sha2("content", 256)), 256).alias("file_id"),
        name.alias("filename"),
        content_type(name).alias("content_type"),
        F.col("length"),
        F.col("content"),
    )


FILE_REFERENCES = "file_id string, filename string, content_type string, length long, content_id string"
FILE_CONTENTS = "content_id string, content binary"


class FileStore:
    """Files by content below a folder: the bytes of a content once, and a reference for every path and content.

    ``put`` may be run again, after a failure too: what is there is not written again, and what two runs at a time
    have both written counts once.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        for name, schema in (("references", FILE_REFERENCES), ("contents", FILE_CONTENTS)):
            # A part without rows, so that an empty store can be read.
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{folder}/{name}")

    @property
    def references(self) -> DataFrame:
        """``file_id, filename, content_type, length, content_id``."""
        return self.spark.read.schema(FILE_REFERENCES).parquet(f"{self.folder}/references").dropDuplicates(["file_id"])

    @property
    def contents(self) -> DataFrame:
        """``content_id, content``: the hash of the bytes, and the bytes. A content may stand twice."""
        return self.spark.read.schema(FILE_CONTENTS).parquet(f"{self.folder}/contents")

    def put(self, files: DataFrame) -> DataFrame:
        """Store files read with ``path``, ``length`` and ``content``; their references, old and new.

        Hashes are written first. Of paths with equal content one is chosen by them, and only its bytes are
        read again and written, so no bytes are compared or meet in one task.
        """
        hashed = written(files.select("path", "length", F.sha2("content", 256).alias("content_id")), "hashes")
        fresh = hashed.join(self.contents.select("content_id"), "content_id", "left_anti")
        chosen = fresh.groupBy("content_id").agg(F.min("path").alias("path"))
        bytes_of = files.select("path", "content").join(chosen, "path").select("content_id", "content")
        bytes_of.write.mode("append").parquet(f"{self.folder}/contents")
        name = F.element_at(F.split(F.col("path"), "/"), -1)
        references = hashed.select(
            F.sha2(F.concat_ws("|", "path", "content_id"), 256).alias("file_id"),
            name.alias("filename"),
            content_type(name).alias("content_type"),
            "length",
            "content_id",
        ).dropDuplicates(["file_id"])
        unknown = references.join(self.references.select("file_id"), "file_id", "left_anti")
        unknown.write.mode("append").parquet(f"{self.folder}/references")
        return self.references.join(references.select("file_id"), "file_id", "left_semi")

    def get(self, ids: DataFrame) -> DataFrame:
        """Reference and ``content`` of each requested ``file_id``; null where there is none."""
        wanted = ids.select("file_id").distinct().join(self.references, "file_id", "left")
        held = self.contents.join(wanted.select("content_id").distinct(), "content_id", "left_semi")
        return wanted.join(held.dropDuplicates(["content_id"]), "content_id", "left")


def get_invoice(df: DataFrame, invoice_id, key: str = "invoice_id") -> DataFrame:
    """The invoice with the given id; no row if there is none or the id is malformed."""
    return df.filter(F.col(key) == F.lit(invoice_id).try_cast(df.schema[key].dataType))


def list_page(df: DataFrame, limit: int = 100, offset: int = 0, key: str = "invoice_id") -> DataFrame:
    """One page of invoices, newest first; ties by id, highest first."""
    return df.orderBy(F.col("created_at").desc(), F.col(key).desc()).offset(offset).limit(limit)


def next_page(df: DataFrame, after: tuple | None = None, limit: int = 100, key: str = "invoice_id") -> DataFrame:
    """The page that follows the row ``after`` (its ``created_at`` and key), newest first; the first one without.

    Each task keeps ``limit`` rows at most, however deep the page lies. Rows without a moment come last.
    """
    if after is not None:
        moment, last = F.lit(after[0]).cast(df.schema["created_at"].dataType), F.lit(after[1])
        same = F.col("created_at").eqNullSafe(moment) & (F.col(key) < last)
        older = F.coalesce(F.col("created_at") < moment, moment.isNotNull())
        df = df.filter(older | same)
    return df.orderBy(F.col("created_at").desc(), F.col(key).desc()).limit(limit)


@dataclass(frozen=True)
class PageIndex:
    """A table written newest first in ranges, and how many rows lie before each range."""

    rows: DataFrame
    ranges: DataFrame
    columns: tuple[str, ...]

    def page(self, limit: int = 100, offset: int = 0) -> DataFrame:
        """Rows ``offset`` to ``offset + limit``, read from the ranges that hold them alone."""
        last = offset + limit
        held = self.ranges.where((F.col("before") < last) & (F.col("before") + F.col("n") > offset))
        tasks = {r["__task"]: r["before"] for r in held.collect()}
        kept = self.rows.where(F.col("__task").isin(list(tasks)))
        before = F.lit(0).cast("long")
        for task, n in tasks.items():
            before = F.when(F.col("__task") == task, n).otherwise(before)
        place = before + F.col("__row")
        return kept.where((place >= offset) & (place < last)).orderBy("__task", "__row").select(*self.columns)


def index_pages(df: DataFrame, key: str = "invoice_id") -> PageIndex:
    """``df`` indexed for pages at any depth, newest first; ties by id, highest first, and nulls last.

    The table is dealt into ranges once and each is a folder of its own, so a page reads one or two folders and no
    more than their rows; of each range only its count is aggregated. To the driver come the ranges of a page.
    """
    order = [F.col("created_at").desc(), F.col(key).desc()]
    rows = sorted_ranges(df, order, "pages", "__task")
    counts = rows.groupBy("__task").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    return PageIndex(rows, written(ranges, "pages"), tuple(df.columns))


def page_envelope(df: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """One row: total number of invoices, limit and offset."""
    return df.agg(F.count(F.lit(1)).alias("total")).select("total", F.lit(limit).alias("limit"), F.lit(offset).alias("offset"))


def delete_invoices(
    df: DataFrame, files: DataFrame, ids: DataFrame, key: str = "invoice_id"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remaining invoices, remaining files, and per requested id whether it was deleted.

    Files of deleted invoices go as well; an invoice without a file, or whose file is missing,
    is deleted all the same.
    """
    wanted = ids.select(key).distinct()
    gone_files = (
        df.join(wanted, key, "left_semi").filter(F.col("file_id").isNotNull()).select("file_id").distinct()
    )
    found = df.select(key).withColumn("_found", F.lit(True))
    outcome = wanted.join(found, key, "left").select(key, F.coalesce("_found", F.lit(False)).alias("deleted"))
    return df.join(wanted, key, "left_anti"), files.join(gone_files, "file_id", "left_anti"), outcome


def file_lookup(df: DataFrame, files: DataFrame, ids: DataFrame, key: str = "invoice_id") -> DataFrame:
    """File of each requested invoice, or why there is none."""
    stored = df.select(key, "file_id", F.lit(True).alias("_invoice"))
    # Invoices without a file get a join key of their own, so that they do not meet in one task.
    own_key = F.concat(F.lit("none-"), F.col(key).cast("string"))
    wanted = ids.select(key).join(stored, key, "left").withColumn(
        "_file_key", F.coalesce(F.concat(F.lit("file-"), F.col("file_id").cast("string")), own_key)
    )
    others = [c for c in files.columns if c != "file_id"]
    kept = files.select(
        F.concat(F.lit("file-"), F.col("file_id").cast("string")).alias("_file_key"), F.lit(True).alias("_file"), *others
    )
    status = (
        F.when(F.col("_invoice").isNull(), "Invoice not found")
        .when(F.col("file_id").isNull(), "No file associated with this invoice")
        .when(F.col("_file").isNull(), "File not found")
        .otherwise("ok")
    )
    return wanted.join(kept, "_file_key", "left").select(key, "file_id", status.alias("status"), *others)
