"""Quality rules: base counts, and the distance of a document's histograms from its language's.

Everything is a DataFrame expression. A document's two histograms are its characters by class and its
words by common word (one further bin for all other words). The reference of a language pools the
histograms of all its documents that pass the base rules. The distance is the Jensen-Shannon distance
(square root of the divergence, base 2, so 0 to 1).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_BLANK, words_of, written

#: Frequent words of the languages, lower case.
COMMON_WORDS = {
    "en": "the of and to in a is that for it on with as was at by be this from or an are".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne".split(),
}
BINS = max(len(words) for words in COMMON_WORDS.values())
#: Character classes; blanks belong to none. Letters without case count as lower case.
CLASSES = ("lower", "upper", "digit", "punctuation", "other")
WINDOW = 8

MIN_WORDS = 20
REPEAT_PERCENT = 30
MIN_CLASS_CHARS = 200
MIN_COMMON_WORDS = 60
#: Limits for long texts; what chance adds in short ones comes on top.
MAX_CLASS_DISTANCE = 0.24
MAX_WORD_DISTANCE = 0.15

_INNER = [
    "__text", "__words", "__hashes", "__windows", "__sorted", "__places", "__hits", "__listed", "__letters", "__rest",
]


def _listed(lang: Column) -> Column:
    """The common words of a language; none for languages without a list."""
    choice = F.array().cast("array<string>")
    for name, words in COMMON_WORDS.items():
        choice = F.when(lang == name, F.array(*[F.lit(w) for w in words])).otherwise(choice)
    return choice


def measure(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """All rows with the base counts and both histograms (``classes``, ``common``: array<long>).

    Base counts: ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long). Null and blank
    texts count 0 everywhere. It is a projection: no shuffle, whole texts. Repeated 8-word windows are
    found by sorting the window hashes of a document, which only documents with equal hashes do.
    """
    rows = docs.withColumns({"__text": F.coalesce(F.col(text), F.lit("")), "__listed": _listed(F.col(lang))})
    rows = rows.withColumn("__words", words_of(F.col("__text")))
    rows = rows.withColumns(
        {
            "__hashes": F.transform("__words", lambda w: F.xxhash64(w)),
            "__hits": F.filter("__words", lambda w: F.array_contains("__listed", F.lower(w))),
            "__rest": F.regexp_replace("__text", r"[\x20\x09-\x0D]+", ""),
        }
    )
    hashes = F.col("__hashes")
    rows = rows.withColumns(
        {
            "__windows": F.when(
                F.size("__hashes") > WINDOW,
                F.transform(
                    F.sequence(F.lit(0), F.size("__hashes") - WINDOW),
                    lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]),
                ),
            ).otherwise(F.array().cast("array<bigint>")),
            "__letters": F.regexp_replace("__rest", r"[\p{Ll}\p{Lm}\p{Lo}\p{M}]+", ""),
        }
    )
    windows = F.col("__windows")
    rows = rows.withColumn(
        "__sorted",
        F.when(
            F.size(F.array_distinct(windows)) < F.size(windows),
            F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
    )
    by_hash = F.col("__sorted")
    rows = rows.withColumn(
        "__places",
        F.sort_array(
            F.transform(
                F.filter(
                    by_hash,
                    lambda s, k: (F.when(k > 0, F.get(by_hash, k - 1)["h"]) == s["h"]).eqNullSafe(F.lit(True))
                    | (F.get(by_hash, k + 1)["h"] == s["h"]).eqNullSafe(F.lit(True)),
                ),
                lambda s: s["i"],
            )
        ),
    )
    places = F.col("__places")
    length = lambda c: F.length(c).cast("long")
    letters, rest = F.col("__letters"), F.col("__rest")
    upper = F.regexp_count(letters, F.lit(r"[\p{Lu}\p{Lt}]"))
    digit = F.regexp_count(letters, F.lit(r"\p{Nd}"))
    punctuation = F.regexp_count(letters, F.lit(r"\p{P}"))
    # Lines with a word, less the different ones among them.
    lines = F.filter(F.split("__text", "\n", -1), lambda line: line.rlike(NOT_BLANK))
    hits = F.col("__hits")
    common = F.transform("__listed", lambda w: F.size(F.filter(hits, lambda h: F.lower(h) == w)).cast("long"))
    rows = rows.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": length(rest),
            "n_symbols": F.regexp_count("__text", F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": F.aggregate(
                F.transform(
                    places, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW)))
                ),
                F.lit(0).cast("long"),
                lambda a, b: a + b,
            ),
            "classes": F.array(
                length(rest) - length(letters), upper, digit, punctuation,
                length(letters) - upper - digit - punctuation,
            ).cast("array<bigint>"),
            "common": common,
        }
    )
    return rows.drop(*_INNER)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def _language(lang: Column) -> Column:
    return F.when(lang.isin(*COMMON_WORDS), lang).otherwise("")


def references(measured: DataFrame, lang: str = "lang") -> DataFrame:
    """Pooled histograms of each language over all documents that pass the base rules.

    Columns ``ref_lang, ref_classes, ref_common, ref_words``; one row for each listed language that
    occurs, and one for all others together (empty ``ref_lang``). Sums of numbers, combined before the
    shuffle; texts do not take part.
    """
    sums = [F.sum(F.get("classes", F.lit(i))).cast("double").alias(f"c{i}") for i in range(len(CLASSES))]
    sums += [F.sum(F.coalesce(F.get("common", F.lit(i)), F.lit(0))).cast("double").alias(f"w{i}") for i in range(BINS)]
    pooled = (
        measured.where(~base_failed()).groupBy(_language(F.col(lang)).alias("ref_lang"))
        .agg(*sums, F.sum("n_words").cast("double").alias("ref_words"))
    )
    return pooled.select(
        "ref_lang",
        F.array(*[F.col(f"c{i}") for i in range(len(CLASSES))]).alias("ref_classes"),
        F.array(*[F.col(f"w{i}") for i in range(BINS)]).alias("ref_common"),
        "ref_words",
    )


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares that each sum up to 1."""

    def side(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    terms = F.zip_with(p, q, lambda a, b: side(a, b) + side(b, a))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) / 2, F.lit(0.0)))


def _shares(counts: Column, whole: Column) -> Column:
    return F.transform(counts, lambda c: c.cast("double") / whole)


def _with_rest(shares: Column) -> Column:
    """One bin more, for what the others leave."""
    return F.concat(shares, F.array(1 - F.aggregate(shares, F.lit(0.0), lambda a, b: a + b)))


def _noise(bins: int, n: Column) -> Column:
    """About the distance that chance alone gives a sample of ``n`` from its own reference."""
    return F.sqrt(F.lit(bins / (8 * math.log(2))) / n)


def judged(measured: DataFrame, reference: DataFrame, lang: str = "lang") -> DataFrame:
    """Adds ``base_failed, class_distance, word_distance, kept``.

    A distance is null, and speaks for keeping, below its minimum length, without a reference, and, for
    words, in a language without a list. The reference has a row a language (five here) and is joined by it.
    """
    rows = measured.withColumn("ref_lang", _language(F.col(lang))).join(F.broadcast(reference), "ref_lang", "left")
    chars, words = F.col("word_chars").cast("double"), F.col("n_words").cast("double")
    ref_chars = F.aggregate("ref_classes", F.lit(0.0), lambda a, b: a + b)
    full = F.concat("common", F.array_repeat(F.lit(0).cast("long"), F.lit(BINS) - F.size("common")))
    rows = rows.withColumns(
        {
            "base_failed": base_failed(),
            "class_distance": F.when(
                (F.col("word_chars") >= MIN_CLASS_CHARS) & (ref_chars > 0),
                js_distance(_shares(F.col("classes"), chars), _shares(F.col("ref_classes"), ref_chars)),
            ),
            "word_distance": F.when(
                (F.col("n_words") >= MIN_COMMON_WORDS) & (F.col("ref_words") > 0) & (F.col("ref_lang") != ""),
                js_distance(
                    _with_rest(_shares(full, words)), _with_rest(_shares(F.col("ref_common"), F.col("ref_words")))
                ),
            ),
        }
    )
    class_limit = MAX_CLASS_DISTANCE + 2 * _noise(len(CLASSES) - 1, chars)
    word_limit = MAX_WORD_DISTANCE + 1.25 * _noise(BINS, words)
    near = F.coalesce(F.col("class_distance") <= class_limit, F.lit(True)) & F.coalesce(
        F.col("word_distance") <= word_limit, F.lit(True)
    )
    return rows.withColumn("kept", ~F.col("base_failed") & near).drop("ref_lang", "ref_classes", "ref_common", "ref_words")


def quality_report(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row a document: key, base counts, distances, ``base_failed``, ``kept``.

    Null and empty texts have no words and fail the base rules; a null or unlisted language is compared
    with the pooled unlisted documents, by characters alone. Repeated rows are judged alike; an empty
    table gives an empty result. The counts are written once and read twice.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("__t"))
    measured = written(measure(rows, "__t").drop("__t"), "quality")
    return judged(measured, references(measured))


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs``, with their columns, that ``quality_report`` would keep.

    Rows and counts are written together, so the filter needs no join by key: null and repeated keys do
    not matter. Columns of ``docs`` named like a measure are carried unharmed.
    """
    packed = docs.select(F.struct(*docs.columns).alias("__row"), F.col(text).alias("__t"), F.col(lang).alias("lang"))
    measured = written(measure(packed, "__t").drop("__t"), "quality")
    kept = judged(measured, references(measured)).where("kept")
    return kept.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])
