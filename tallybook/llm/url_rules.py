"""Allow and block rules for urls: a trie over reversed host labels, then path segments."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A trie of more rules than this is not sent to the executors; the rules then become a table to join.
MAX_BROADCAST_RULES = 200_000


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains, for paths that start with ``path`` ('' fits every path)."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def rule(verdict: str, text: str) -> Rule:
    """``rule('block', 'example.com/en/')``."""
    host, slash, rest = text.partition("/")
    if verdict not in ("allow", "block") or not host:
        raise ValueError(f"not a rule: {verdict} {text}")
    return Rule(verdict, host.lower(), slash + rest)


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lowered, F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def build_trie(rules: Iterable[Rule]) -> dict:
    """Nested dicts: labels from the last to the first, then '/' and whole path segments.

    The piece after a path's last slash may end within a segment; a node keeps such pieces, longest first.
    Of rules with the same host and path the block wins.
    """
    root: dict = {}
    for r in rules:
        node = root
        for label in reversed(r.host.split(".")):
            node = node.setdefault(("host", label), {})
        *whole, piece = r.path.split("/")
        for segment in whole:
            node = node.setdefault(("path", segment), {})
        ends = node.setdefault("ends", {})
        if ends.get(piece, (None, "allow"))[1] == "allow":
            ends[piece] = (r.name, r.verdict)
    stack = [root]
    while stack:
        node = stack.pop()
        if "ends" in node:
            node["ends"] = sorted(node["ends"].items(), key=lambda e: -len(e[0]))
        stack.extend(child for key, child in node.items() if key != "ends")
    return root


def look_up(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """Name and verdict of the longest rule that fits: most host labels, then the longest path."""
    best, node = None, trie
    segments = path.split("/")
    for label in reversed(host.split(".")):
        node = node.get(("host", label))
        if node is None:
            break
        place, at = node, 0
        while place is not None:
            rest = "/".join(segments[at:]) if at < len(segments) else None
            if rest is not None:
                for piece, found in place.get("ends", ()):
                    if rest.startswith(piece):
                        best = found
                        break
            # A whole segment needs a slash behind it.
            place = place.get(("path", segments[at])) if at + 1 < len(segments) else None
            at += 1
    return best


def judge_urls(
    df: DataFrame,
    rules: Iterable[Rule],
    url: str = "url",
    default: str = "allow",
    max_broadcast: int = MAX_BROADCAST_RULES,
) -> DataFrame:
    """All rows of ``df`` with ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``.

    The longest rule decides; where none fits, ``default`` does. Null urls and urls without ``://`` have
    an empty host and path and take ``default``. Columns of these names in the input are replaced, rows
    are neither dropped nor joined up, and an empty table gives an empty result. Up to ``max_broadcast``
    rules travel to the executors as one trie; more become a table that is joined by prefix.
    """
    rules = list(rules)
    parsed = df.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    if len(rules) > max_broadcast:
        return _judge_by_join(parsed, rules, default)
    trie = df.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def found(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        root = trie.value
        for hosts, paths in batches:
            hits = [look_up(root, h, p) or (None, default) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame(hits, columns=["rule", "verdict"])

    hit = parsed.drop("rule", "verdict").withColumn("__hit", found("host", "path"))
    return hit.withColumns({"rule": F.col("__hit.rule"), "verdict": F.col("__hit.verdict")}).drop("__hit")


def _judge_by_join(parsed: DataFrame, rules: list[Rule], default: str) -> DataFrame:
    """The same verdicts without a broadcast, for distinct (host, path) pairs and every prefix of them."""
    spark = parsed.sparkSession
    listed = spark.createDataFrame([(r.host, r.path, r.name, r.verdict) for r in rules], "h string, p string, rule string, verdict string")
    places = parsed.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, -i, i), ".")
    )
    prefixes = F.transform(F.sequence(F.lit(0), F.length("path")), lambda i: F.col("path").substr(F.lit(1), i))
    keys = places.withColumn("h", F.explode(suffixes)).withColumn("p", F.explode(prefixes))
    longest = Window.partitionBy("host", "path").orderBy(
        F.size(F.split("h", r"\.")).desc(), F.length("p").desc(), F.desc("verdict")
    )
    best = (
        keys.join(listed, ["h", "p"])
        .withColumn("__n", F.row_number().over(longest))
        .where("__n = 1")
        .select("host", "path", "rule", "verdict")
    )
    joined = parsed.drop("rule", "verdict").join(best, ["host", "path"], "left")
    return joined.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
