"""Text similarity as used when two extractions are compared (Ratcliff-Obershelp)."""

from __future__ import annotations

from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.functions.pycompat import pystrip


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _ratios(left: pa.Array, right: pa.Array) -> pa.Array:
    seen: dict = {}

    def ratio(pair: tuple) -> float | None:
        if pair[0] is None or pair[1] is None:
            return None
        if pair not in seen:
            seen[pair] = SequenceMatcher(None, *pair).ratio()
        return seen[pair]

    rows = zip(left.to_pylist(), right.to_pylist())
    return pa.array([[ratio(p) for p in zip(a, b)] for a, b in rows], pa.list_(pa.float64()))


def similarity_bound(left: Column, right: Column) -> Column:
    """An upper bound (0 to 1) of the similarity of two texts, lower-cased; null where they are equal, blank or null.

    No more characters can match than the shorter text has, and of each character no more than the text with fewer of
    it has. The second bound is counted only where the first leaves the question open.
    """
    a, b = F.lower(left), F.lower(right)
    differ = (a != b) & (pystrip(a) != "") & (pystrip(b) != "")
    size = F.length(a) + F.length(b)
    by_length = F.lit(2.0) * F.least(F.length(a), F.length(b)) / size

    def times(text: Column, sign: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, sign, F.lit("")))

    def shared(total: Column, sign: Column) -> Column:
        return total + F.least(times(a, sign), times(b, sign))

    by_signs = F.aggregate(F.array_distinct(F.split(a, "")), F.lit(0), shared) * F.lit(2.0) / size
    return F.when(differ, F.when(by_length <= DECISIVE, by_length).otherwise(F.least(by_length, by_signs)))


#: Bounds at most this are not made tighter.
DECISIVE = 0.85


def similarities(pairs: Column) -> Column:
    """Similarity (0 to 1) of each lower-cased pair in an array of ``struct<left, right, ...>``.

    The order within a pair matters. Only pairs of differing, non-blank texts have their
    similarity computed in Python, once per distinct pair and batch; all others give null.
    """

    def side(name: str) -> Column:
        def one(pair: Column) -> Column:
            left, right = F.lower(pair["left"]), F.lower(pair["right"])
            # Equal texts are equal in lower case too, so most pairs end at the first comparison.
            differ = (pair["left"] != pair["right"]) & (left != right) & (pystrip(left) != "") & (pystrip(right) != "")
            return F.when(differ, left if name == "left" else right)

        return F.transform(pairs, one)

    return _ratios(side("left"), side("right"))
