"""JSON files of any size as one text per record.

A file that is one array is cut into its records without any task or row holding it: Spark's text reader splits
the bytes at closing braces, and what a piece means follows from two states at its start, whether it lies in a string
and how deep it is nested. Each byte range says how it changes the states; these changes are added up over the ranges
of a file, and handed back to the pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallybook.functions import jsonvalues as J
from tallybook.ranges import written

#: What JSON counts as white space.
BLANK = "[ \\t\\n\\r]"


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Text up to each closing brace, by ``file``, byte range ``block`` and ``row``, with what follows from it alone.

    ``quotes`` is odd where the piece changes between string and not; ``outside`` and ``inside`` are how much deeper
    the nesting is after it, if it starts outside or inside a string, its closing brace not counted.
    """
    text = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        F.col("_metadata.file_size").alias("size"),
        F.col("value").alias("text"),
    )
    bare = F.regexp_replace("text", r"(?s)\\.", "")
    quotes = F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))

    def deeper(kept: Column) -> Column:
        kept = F.regexp_replace(kept, r'"[^"]*+(?:"|\z)', "")
        opened = F.length(F.regexp_replace(kept, r"[^\[{]++", ""))
        return opened - F.length(F.regexp_replace(kept, r"[^\]}]++", ""))

    return written(
        text.select(
            "*",
            (quotes % 2).alias("quotes"),
            deeper(bare).alias("outside"),
            deeper(F.regexp_replace(bare, r'^[^"]*+(?:"|\z)', "")).alias("inside"),
        ),
        "pieces",
    )


def _closed(pieces: DataFrame) -> DataFrame:
    """Pieces with whether a brace follows them: after the last one of a file none does, unless bytes are left over."""
    used = pieces.groupBy("file").agg(
        F.sum(F.octet_length("text") + 1).alias("used"), F.max(F.struct("block", "row")).alias("last")
    )
    ends = pieces.select("file", "size").distinct().join(used, "file")
    ends = ends.where("used > size").select("file", F.col("last.block").alias("block"), F.col("last.row").alias("row"), F.lit(False).alias("brace"))
    return pieces.join(ends, ["file", "block", "row"], "left").withColumn("brace", F.coalesce("brace", F.lit(True)))


def _placed(pieces: DataFrame) -> DataFrame:
    """Pieces with ``ends``: whether a record of the file's array ends with them."""
    in_block = Window.partitionBy("file", "block").orderBy("row")
    so_far = in_block.rowsBetween(Window.unboundedPreceding, -1)
    # Parity at the start of a piece, as if its byte range started outside a string.
    parity = F.coalesce(F.sum("quotes").over(so_far), F.lit(0)) % 2

    def change(start: int) -> Column:
        """How much deeper the nesting is after a piece, in a byte range that starts in this state."""
        in_string = (F.col("parity") + start) % 2 == 1
        ends_outside = (F.col("parity") + start + F.col("quotes")) % 2 == 0
        return F.when(in_string, F.col("inside")).otherwise(F.col("outside")) - (F.col("brace") & ends_outside).cast("int")

    pieces = pieces.withColumn("parity", parity)
    pieces = pieces.withColumns({"change0": change(0), "change1": change(1)})
    blocks = pieces.groupBy("file", "block").agg(F.sum("quotes").alias("q"), F.sum("change0").alias("d0"), F.sum("change1").alias("d1"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("start", F.coalesce(F.sum("q").over(before), F.lit(0)) % 2)
    own = F.when(F.col("start") == 1, F.col("d1")).otherwise(F.col("d0"))
    blocks = blocks.withColumn("own", own).withColumn("depth", F.coalesce(F.sum("own").over(before), F.lit(0)))
    pieces = pieces.join(blocks.select("file", "block", "start", "depth"), ["file", "block"])
    change_here = F.when(F.col("start") == 1, F.col("change1")).otherwise(F.col("change0"))
    depth = F.col("depth") + F.sum(change_here).over(in_block)
    outside = (F.col("start") + F.col("parity") + F.col("quotes")) % 2 == 0
    return pieces.withColumn("ends", F.col("brace") & outside & (depth == 1))


def read_json_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, part, value, whole``: the records of JSON files as texts that ``load_invoices`` reads.

    A file that is an array gives a text for each of its objects, an array of that object and of other values
    before it; ``part`` tells their order. Any other file gives one text. A text that is not JSON, or not in its place in
    the array, makes the file malformed: it then has one row, its ``value`` null.
    """
    placed = _placed(_closed(_pieces(spark, path)))
    # The last record end before a piece names the record it belongs to.
    mark = F.when(F.col("ends"), F.struct("block", "row"))
    earlier = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    blocks = placed.groupBy("file", "block").agg(F.max(mark).alias("mark"), F.min_by("text", "row").alias("head"))
    in_file = Window.partitionBy("file").orderBy("block")
    heads = F.first("head").over(in_file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    blocks = blocks.select(
        "file", "block",
        F.max("mark").over(in_file.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"),
        heads.rlike(rf"^{BLANK}*+\[").alias("is_array"),
    )
    named = placed.withColumn("mark", F.max(mark).over(earlier)).join(blocks, ["file", "block"])
    record = F.when(F.col("is_array"), F.coalesce("mark", "carried"))
    parts = named.select(
        "file", "is_array", record["block"].alias("after_block"), record["row"].alias("after_row"),
        F.concat("text", F.when(F.col("brace"), "}").otherwise("")).alias("text"),
        F.struct("block", "row").alias("at"), F.when(F.col("ends") & F.col("is_array"), True).alias("ended"),
    )
    parts = parts.groupBy("file", "is_array", "after_block", "after_row").agg(
        F.expr("listagg(text, '') within group (order by at)").alias("text"),
        F.coalesce(F.bool_or("ended"), F.lit(False)).alias("ended"),
    )
    # Step by step, each in a column of its own: in one expression the branches would search and parse a record again.
    first = F.col("after_block").isNull()
    lead = F.when(first, rf"^{BLANK}*+\[").otherwise(rf"^{BLANK}*+,")
    parts = parts.withColumns(
        {"in_place": F.regexp_like(F.col("text"), lead), "body": F.regexp_replace(F.col("text"), lead, F.lit(""))}
    )
    tail = ~F.col("ended") & F.regexp_like(F.col("body"), F.lit(rf"\]{BLANK}*+\z"))
    parts = parts.withColumn("tail", tail)
    parts = parts.withColumn("body", F.when(F.col("tail"), F.regexp_replace("body", rf"\]{BLANK}*+\z", "")).otherwise(F.col("body")))
    parts = parts.withColumn("hollow", F.regexp_like(F.col("body"), F.lit(rf"^{BLANK}*+\z")))
    value = F.concat(F.lit("["), "body", F.lit("]"))
    due = F.col("is_array") & F.col("in_place") & ~F.col("hollow") & (F.col("ended") | F.col("tail"))
    parts = parts.withColumn("value", F.when(due, value))
    parts = parts.withColumn("good", F.col("value").isNotNull() & J.strict_json(F.col("value")).isNotNull())
    # After the last record only the closing bracket may follow, or further values behind a comma.
    closing = ~F.col("ended") & ~first & F.regexp_like(F.col("text"), F.lit(rf"^{BLANK}*+\]{BLANK}*+\z"))
    empty = F.col("is_array") & (closing | (F.col("tail") & first & F.col("hollow")))
    part = F.struct(F.coalesce("after_block", F.lit(-1).cast("long")).alias("block"), F.coalesce("after_row", F.lit(-1).cast("long")).alias("row"))
    rows = parts.select(
        "file", part.alias("part"),
        F.when(F.col("is_array"), F.when(F.col("good"), F.col("value"))).otherwise(F.col("text")).alias("value"),
        empty.alias("empty"),
        (F.col("is_array") & ~empty & ~F.col("good")).alias("bad"),
        (~F.col("is_array") | ~F.col("ended")).alias("complete"),
    )
    rows = written(rows, "records")
    # An array that stops after one of its objects has no part that closes it.
    bad = rows.groupBy("file").agg(F.bool_or("bad").alias("bad"), F.bool_or("complete").alias("complete"))
    bad = bad.where("bad or not complete").select("file")
    good_rows = rows.where("not empty").join(bad, "file", "left_anti").select("file", "part", "value")
    none = F.lit(None).cast("string").alias("value")
    return good_rows.unionByName(bad.select("file", F.lit(None).cast("struct<block:bigint,row:bigint>").alias("part"), none))
