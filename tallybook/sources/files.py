"""Uploaded files: scan, checks on name and size, file type, and assembled page text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions.pycompat import pystrip, truthy_text

MAX_BYTES = 35 * 1024 * 1024

# Accepted extensions, their file type and their content type.
FILE_TYPES = {
    "pdf": ("pdf", "application/pdf"),
    "jpg": ("image", "image/jpeg"),
    "jpeg": ("image", "image/jpeg"),
    "png": ("image", "image/png"),
    "gif": ("image", "image/gif"),
    "webp": ("image", "image/webp"),
    "bmp": ("image", "image/bmp"),
    "docx": ("docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
}
DEFAULT_CONTENT_TYPE = "application/octet-stream"

# Messages of the checks, per kind of intake.
NO_NAME = "No filename provided"
EMPTY_FILE = "File is empty"
UNSUPPORTED = "Only PDF, Image (JPG, PNG, GIF, WEBP, BMP), and DOCX files are supported"
TOO_LARGE = "File size exceeds 35MB limit"
PDF_ONLY = {
    "merge": ("Only PDF files are supported for dual-source extraction", TOO_LARGE),
    "document": ("Only PDF files supported", "File exceeds 35MB"),
    "layout": ("Only PDF files are supported", TOO_LARGE),
}


def read_invoice_files(spark: SparkSession, path: str, pattern: str = "*.pdf", nested: bool = False) -> DataFrame:
    """The ``*.pdf`` files directly in a folder (or one file), with ``source_file`` as base name.

    ``pattern`` and ``nested`` read files of other names, and those in folders below.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    files = reader.option("recursiveFileLookup", str(nested).lower()).load(path)
    return files.withColumn("source_file", F.element_at(F.split("path", "/"), -1))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z]+)\z", 1))


def file_type(name: Column) -> Column:
    """``pdf``, ``image``, ``docx`` or ``other``; the default content type if there is no name."""
    kind = F.when(~truthy_text(name), DEFAULT_CONTENT_TYPE)
    for ext, (label, _) in FILE_TYPES.items():
        kind = kind.when(extension(name) == ext, label)
    return kind.otherwise("other")


def content_type(name: Column) -> Column:
    """Content type by extension, the default one if it is unknown."""
    kind = F.when(~truthy_text(name), DEFAULT_CONTENT_TYPE)
    for ext, (_, label) in FILE_TYPES.items():
        kind = kind.when(extension(name) == ext, label)
    return kind.otherwise(DEFAULT_CONTENT_TYPE)


def gate_files(files: DataFrame, intake: str = "batch") -> DataFrame:
    """Add ``error``, null for an acceptable file. Needs ``file_name`` and ``length`` only.

    ``intake`` is ``single`` or ``batch`` (all accepted types; they word the size limit
    differently), or ``merge``, ``document`` or ``layout`` (PDF only).
    """
    name, length = F.col("file_name"), F.col("length")
    if intake in PDF_ONLY:
        wrong_type, too_large = PDF_ONLY[intake]
        accepted = extension(name) == "pdf"
        size_error = F.lit(too_large)
    else:
        wrong_type = UNSUPPORTED
        accepted = extension(name).isin(list(FILE_TYPES))
        if intake == "batch":
            megabytes = F.bround(length.cast("decimal(18,0)") / F.lit(1024 * 1024).cast("decimal(7,0)"), 2)
            size_error = F.concat(
                F.lit("File size ("), megabytes.cast("decimal(18,2)").cast("string"), F.lit("MB) exceeds 35MB limit")
            )
        else:
            size_error = F.lit(TOO_LARGE)
    error = (
        F.when(~truthy_text(name), NO_NAME)
        .when(~accepted, wrong_type)
        .when(length > MAX_BYTES, size_error)
        .when(length == 0, EMPTY_FILE)
    )
    return files.withColumn("error", error)


def assemble_text(pages: DataFrame, sep: str = "", key: str = "invoice_id") -> DataFrame:
    """One text per document: its pages in page order, with ``sep`` after each page.

    The result is one document per row by nature, and the file size check bounds a document.
    """
    page = pages.select(key, "page", F.concat(F.coalesce("text", F.lit("")), F.lit(sep)).alias("_part"))
    return page.groupBy(key).agg(F.expr("listagg(_part) within group (order by page)").alias("text"))


def needs_ocr(text: Column) -> Column:
    """Whether a document has too little text to extract from."""
    return F.length(pystrip(F.coalesce(text, F.lit("")))) < 50
