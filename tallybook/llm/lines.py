"""Removal of boilerplate lines: those on more than a share of their site's pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.pycompat import let

from .common import written

#: A line on more than this share of a site's pages is boilerplate, if it is on MIN_PAGES pages or more.
MAX_RATIO = 0.1
MIN_PAGES = 3
#: Boilerplate lines that may be sent to all executors; more are joined by a shuffle.
MAX_BROADCAST_ROWS = 200_000

#: What has no visible text, and the elements that begin and end lines.
HIDDEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
BLOCKS = (
    r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|"
    r"nav|ol|option|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>"
)
TAGS = r"<[^>]*>"


#: Characters from which on a page is read with care for what is opened and never closed.
LONG = 1 << 14
#: Stands behind the first character of an opening that nothing closes.
_UNCLOSED = "\ue000\ue001"
_OPENINGS = {r"(?is)^.*</script\s*>": r"(?i)<(?=script\b)", r"(?is)^.*</style\s*>": r"(?i)<(?=style\b)", r"(?s)^.*-->": r"<(?=!--)"}


def html_lines(html: Column) -> Column:
    """The visible lines of a page as an array: trimmed, without empty ones, entities left as they are.

    Hidden parts end a line like blocks do. Null pages have no lines; what is opened and never closed is text. A search
    for an end that is not there would start anew at every opening: in long pages the openings behind the last end
    of their kind are marked first, and tags are sought up to the last ``>`` only. Both forms give the same lines.
    """
    text = F.coalesce(html, F.lit(""))
    return text_lines(F.when(F.length(text) >= LONG, _shown_with_care(text)).otherwise(_shown(text)))


def _shown(text: Column) -> Column:
    text = F.regexp_replace(text, HIDDEN, "\n")
    return F.regexp_replace(F.regexp_replace(text, BLOCKS, "\n"), TAGS, "")


def _shown_with_care(text: Column) -> Column:
    for closed, opening in _OPENINGS.items():
        text = let(text, _marking(closed, opening))
    return F.replace(let(F.regexp_replace(text, HIDDEN, "\n"), _untagged), F.lit(_UNCLOSED), F.lit(""))


def _marking(closed: str, opening: str) -> Callable[[Column], Column]:
    """Marks the openings of a text behind the last end of their kind."""

    def marked(text: Column) -> Column:
        def from_head(head: Column) -> Column:
            return F.concat(head, F.regexp_replace(F.substr(text, F.length(head) + 1), opening, f"<{_UNCLOSED}"))

        return let(F.regexp_extract(text, closed, 0), from_head)

    return marked


def _untagged(text: Column) -> Column:
    def cut(behind: Column) -> Column:
        tagged = F.substr(text, F.lit(1), F.length(text) - F.length(behind))
        return F.concat(F.regexp_replace(F.regexp_replace(tagged, BLOCKS, "\n"), TAGS, ""), behind)

    return let(F.substring_index(text, ">", -1), cut)


def text_lines(text: Column) -> Column:
    lines = F.split(F.coalesce(text, F.lit("")), r"[\n\r]+")
    return F.filter(F.transform(lines, lambda s: F.trim(s, F.lit(" \t"))), lambda s: s != "")


def drop_boilerplate(
    pages: DataFrame,
    key: str = "page_id",
    host: str = "host",
    lines: str = "lines",
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """``page_id, host, n_lines, n_dropped, kept_lines`` (array, in order) of every row of ``pages``.

    A line counts once a page. It goes if it is on ``min_pages`` pages of the host or more and on more
    than ``max_ratio`` of them. Pages with a null or empty host belong to no site and keep all lines; null
    lines count as an empty array. Repeated rows count as pages of their own; an empty table gives an empty
    result. Counts of (host, line) are combined before the shuffle, and no host's pages meet in one task:
    the boilerplate of a host is at most its mean lines a page / ``max_ratio`` lines long, and only that
    is joined to its pages.
    """
    rows = written(
        pages.select(
            F.col(key).alias("page_id"),
            F.col(host).alias("host"),
            F.coalesce(F.col(lines), F.array().cast("array<string>")).alias("lines"),
        ),
        "page-lines",
    )
    sites = rows.where("host <> ''")
    hashed = F.transform(F.array_distinct("lines"), lambda s: F.xxhash64(s))
    counts = sites.select("host", F.explode(hashed).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    totals = sites.groupBy("host").agg(F.count("*").alias("total"))
    frequent = written(
        counts.where(F.col("n") >= min_pages)
        .join(totals, "host")
        .where(F.col("n") > max_ratio * F.col("total"))
        .groupBy("host")
        .agg(F.collect_list("line").alias("frequent")),
        "boilerplate",
    )
    listed = frequent.agg(F.coalesce(F.sum(F.size("frequent")), F.lit(0))).first()[0]
    if listed <= MAX_BROADCAST_ROWS:
        frequent = F.broadcast(frequent)
    none = F.array().cast("array<bigint>")
    hits = rows.join(frequent, "host", "left").withColumn(
        "hits", F.array_intersect(hashed, F.coalesce("frequent", none))
    )
    kept = F.filter("lines", lambda s: ~F.array_contains("hits", F.xxhash64(s)))
    return hits.select("page_id", "host", F.col("lines"), kept.alias("kept_lines")).select(
        "page_id",
        "host",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept_lines")).cast("long").alias("n_dropped"),
        "kept_lines",
    )
