"""Mixing to target weights with soft membership in domains.

A table of labels trains a naive Bayes classifier over words and shapes; it gives each document
a posterior for each domain. Projected gradient steps then fit one nonnegative rate a document, so that the
expected tokens of a domain (posterior x tokens x rate, summed) match its target. Everything is a DataFrame
expression; the driver sees the vocabulary, and one number a domain in each step.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled, total, written

#: Labelled rows that train the classifier: those with the least key hash. Documented bound of the sample.
SAMPLE = 20_000
#: A word of the vocabulary is in so many labelled documents, and in this share of those of some domain.
MIN_DOCUMENTS = 5
MIN_SHARE = 0.01
#: A word of the vocabulary is so many times likelier in that domain than in all.
MIN_LIFT = 4.0
#: Half the G statistic of a word and the domains, in nats: beyond chance even among many words.
MIN_INFORMATION = 10.0
STEPS = 100
#: Steps end when no domain's tokens change by this share of all tokens any more, three times in a row.
TOLERANCE = 5e-6
#: Steps after which the rates so far are written, so that each is computed from few others.
STRETCH = 10

LABEL = (
    "case when toxic = 1 then 'toxic' when quality = 0 then 'low' when quality = 1 or toxic = 0 then 'good' end"
)


def _cut(share: Column, name: str, *edges: float) -> Column:
    """A word for the range that a share lies in."""
    out = F.lit(f"{name}:0")
    for i, edge in enumerate(edges, 1):
        out = F.when(share > edge, f"{name}:{i}").otherwise(out)
    return out


def describe(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows with ``tokens`` (runs of letters and digits, long) and ``features`` (their words and shapes).

    Shapes are words with a colon, which no token has: shares of symbols, capitals and repeated tokens.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    parts = F.array_remove(F.split(F.lower(whole), r"[^\p{L}\p{N}]+"), "")
    rows = settled(docs, __parts=parts, __whole=whole)
    size = F.greatest(F.size("__parts"), F.lit(1)).cast("double")
    distinct = F.array_distinct("__parts")
    shapes = F.array(
        _cut(F.regexp_count("__whole", F.lit(r"[#*$%&|<>!]")) / size, "symbols", 0.05, 0.3, 1.0),
        _cut(F.regexp_count("__whole", F.lit(r"[A-Z]{2}")) / size, "capitals", 0.1, 0.5),
        _cut(1 - F.size(distinct) / size, "repeats", 0.3, 0.6, 0.9),
        F.when(size < 20, "short:1").otherwise("short:0"),
    )
    return rows.withColumns(
        {"tokens": F.size("__parts").cast("long"), "features": F.concat(distinct, shapes)}
    ).drop("__parts", "__whole")


@dataclass(frozen=True)
class Classifier:
    """Naive Bayes: per domain the weight of each feature that a text has, and a constant."""

    domains: list[str]
    vocabulary: list[str]
    weights: list[list[float]]
    constants: list[float]

    def posteriors(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``p`` in the place of ``features``: the posterior by domain, which sums up to 1."""
        words = _texts(self.vocabulary)
        places = F.transform(F.array_intersect("features", words), lambda w: F.array_position(words, w).cast("int"))

        def score(weights: list[float], constant: float) -> Column:
            own = _doubles(weights)
            return F.aggregate("__places", F.lit(constant), lambda a, i: a + F.element_at(own, i))

        scores = F.array(*[score(w, c) for w, c in zip(self.weights, self.constants, strict=True)])
        rows = settled(rows, __places=places).drop("features")
        rows = settled(rows, __scores=scores).drop("__places")
        rows = settled(rows, __most=F.array_max("__scores"))
        rows = settled(rows, __raised=F.transform("__scores", lambda s: F.exp(s - F.col("__most"))))
        rows = settled(rows.drop("__scores", "__most"), __all=F.aggregate("__raised", F.lit(0.0), lambda a, b: a + b))
        return rows.withColumn("p", F.transform("__raised", lambda e: e / F.col("__all"))).drop("__raised", "__all")


def _texts(values: list[str]) -> Column:
    if not values:
        return F.array().cast("array<string>")
    quoted = [v.replace("\\", "\\\\").replace("'", "\\'") for v in values]
    return F.expr("array(" + ", ".join(f"'{v}'" for v in quoted) + ")")


def _doubles(values: list[float]) -> Column:
    return F.expr("array(" + ", ".join(f"double('{v!r}')" for v in [*values, 0.0]) + ")")


def fit_classifier(
    docs: DataFrame, labels: DataFrame, domains: list[str], key: str = "doc_id", text: str = "text",
    label: str = LABEL, sample: int = SAMPLE,
) -> Classifier:
    """Trained on at most ``sample`` labelled rows. ``label`` is SQL over ``labels`` for the domain.

    Rows whose label is null or none of ``domains`` are left out, of several labels of a key the least
    counts. The vocabulary is all words that speak for some domain, measured within it however rare it is, and
    all shapes. Domains without a labelled row have a posterior near 0.
    """
    chosen = (
        labels.select(F.col(key).alias("__key"), F.expr(label).alias("__domain"))
        .where(F.col("__domain").isin(*domains) & F.col("__key").isNotNull())
        .groupBy("__key")
        .agg(F.min("__domain").alias("__domain"))
        .orderBy(F.xxhash64("__key"), "__key")
        .limit(sample)
    )
    chosen = written(chosen, "labelled")
    taught = docs.select(F.col(key).alias("__key"), F.col(text).alias("__t")).join(F.broadcast(chosen), "__key")
    rows = written(describe(taught, "__t").select("__domain", "features"), "taught")
    sizes = {r["__domain"]: r["n"] for r in rows.groupBy("__domain").agg(F.count("*").alias("n")).collect()}
    n = [sizes.get(d, 0) for d in domains]
    everything = sum(n)
    counts = rows.select("__domain", F.explode("features").alias("word")).groupBy("word").agg(
        *[F.count(F.when(F.col("__domain") == d, 1)).alias(f"n{i}") for i, d in enumerate(domains)]
    )
    present = total([F.col(f"n{i}") for i in range(len(domains))])

    def cell(a: Column, row: Column, size: int) -> Column:
        return F.when((a > 0) & (row > 0), a * F.log(a * everything / (row * max(size, 1)))).otherwise(0.0)

    information = total(
        [cell(F.col(f"n{i}"), present, k) + cell(F.lit(k) - F.col(f"n{i}"), F.lit(everything) - present, k) for i, k in enumerate(n)]
    )
    # Words must speak for a domain; those that are merely rarer in one would add up to a verdict by sheer number.
    frequent = [F.col(f"n{i}") >= max(1, MIN_SHARE * k) for i, k in enumerate(n)]
    telling = [often & (F.col(f"n{i}") * everything >= MIN_LIFT * k * present) for (i, k), often in zip(enumerate(n), frequent, strict=True)]
    word = _any_of(telling) & (information >= MIN_INFORMATION)
    best = (
        counts.where((present >= MIN_DOCUMENTS) & (word | F.contains("word", F.lit(":")) & _any_of(frequent)))
        .withColumn("information", information).orderBy(F.desc("information"), "word").collect()
    )
    # A word counts by its presence and its absence, a shape as the one of its kind that a text has.
    weights, constants = [], []
    for i, k in enumerate(n):
        shares = [(r[f"n{i}"] + 0.5) / (k + 1) for r in best]
        word = [":" not in r["word"] for r in best]
        weights.append([math.log(q) - w * math.log1p(-q) for q, w in zip(shares, word, strict=True)])
        absent = sum(math.log1p(-q) for q, w in zip(shares, word, strict=True) if w)
        constants.append(math.log((k + 1e-6) / (everything + 1)) + absent)
    return Classifier(list(domains), [r["word"] for r in best], weights, constants)


def _any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _largest(matrix: list[list[float]]) -> float:
    """A bound of the largest eigenvalue of a nonnegative symmetric matrix: its largest row sum."""
    return max(sum(row) for row in matrix)


def _moved(rate: Column, before: Column, moves: list[list[float]], ceiling: float | None) -> Column:
    """``struct<x, b>``: the rate after some steps, and the one before it.

    A move is how much of the last change is kept, and behind it the step a domain. One expression whatever the number of
    steps, so that its code is made once.
    """
    taken = F.expr("array(" + ", ".join("array(" + ", ".join(f"double('{v!r}')" for v in m) + ")" for m in moves) + ")")

    def step(state: Column, move: Column) -> Column:
        ahead = state["x"] + F.get(move, F.lit(0)) * (state["x"] - state["b"])
        domains = len(moves[0]) - 1
        moved = ahead - total([F.get("p", F.lit(i)) * F.get(move, F.lit(i + 1)) for i in range(domains)])
        return F.struct(F.greatest(F.lit(0.0), moved if ceiling is None else F.least(F.lit(ceiling), moved)).alias("x"), state["x"].alias("b"))

    return F.aggregate(taken, F.struct(rate.alias("x"), before.alias("b")), step)


def fit_rates(
    rows: DataFrame, targets: list[float], ceiling: float | None = None, fixed: Column | None = None, steps: int = STEPS
) -> tuple[Column, list[float]]:
    """The rate of a row as an expression over ``tokens`` and ``p`` (posteriors), and the tokens it reaches.

    Least squares of ``sum(tokens * p * rate) - targets``, each domain divided by the root of its
    tokens, so that domains weigh alike and few steps do. A step is one aggregate over the rows; a
    document moves by the gradient a token and is projected onto [0, ``ceiling``]. Steps are accelerated: they start
    ahead of the rates by a growing part of the last change, and from the rates again when that leads uphill. All rates
    start at 1, and those of ``fixed`` rows stay there. Domains without tokens are left alone, and so are rows in
    ties: equal posteriors get equal rates. ``rows`` must be written: a rate follows from the steps' gradients, of
    which there is one number a domain; the rates of the steps between are written without the rows' other columns.
    """
    k = range(len(targets))
    tokens, p = F.col("tokens").cast("double"), [F.get("p", F.lit(i)) for i in range(len(targets))]
    sums = rows.agg(
        *[F.coalesce(F.sum(tokens * p[i]), F.lit(0.0)).alias(f"t{i}") for i in k],
        *[F.coalesce(F.sum(tokens * p[i] * p[j]), F.lit(0.0)).alias(f"m{i}_{j}") for i in k for j in k],
    ).first()
    scale = [1 / math.sqrt(max(1.0, sums[f"t{i}"])) for i in k]
    length = 1 / max(1e-12, _largest([[sums[f"m{i}_{j}"] * scale[i] * scale[j] for j in k] for i in k]))
    one = F.lit(1.0)

    def kept(moved: Column) -> Column:
        return moved if fixed is None else F.when(fixed, one).otherwise(moved)

    state = rows.select("tokens", "p", one.alias("rate"), one.alias("before"), (F.lit(False) if fixed is None else fixed).alias("fixed"))
    everything = sum(sums[f"t{i}"] for i in k)
    reached = before = [sums[f"t{i}"] for i in k]
    moves: list[list[float]] = [[0.0, *[0.0 for _ in k]]]
    held, calm, turn = 0, 0, 1
    for n in range(1, steps + 1):
        ahead = (turn - 1) / (turn + 2)
        slopes = [(1 + ahead) * reached[i] - ahead * before[i] - targets[i] for i in k]
        moves.append([ahead, *[length * scale[i] ** 2 * slopes[i] for i in k]])
        moved = _moved(F.col("rate"), F.col("before"), moves[held:], ceiling)
        free = F.when(F.col("fixed"), one).otherwise(moved["x"])
        found = state.agg(*[F.coalesce(F.sum(tokens * p[i] * free), F.lit(0.0)).alias(f"t{i}") for i in k]).first()
        before, reached = reached, [found[f"t{i}"] for i in k]
        changes = [a - b for a, b in zip(reached, before, strict=True)]
        uphill = sum(scale[i] ** 2 * slopes[i] * changes[i] for i in k) > 0
        turn = 1 if uphill else turn + 1
        calm = calm + 1 if max(map(abs, changes), default=0.0) <= TOLERANCE * everything else 0
        if calm == 3:
            break
        if n % STRETCH == 0:
            state = written(state.select("tokens", "p", "fixed", moved["x"].alias("rate"), moved["b"].alias("before")), "rates")
            held = len(moves)
    return kept(_moved(one, one, moves, ceiling)["x"]), reached


def uniform(*columns: str) -> Column:
    """A stable number in [0, 1) by row content."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("mixing"), *columns), 11).cast("double") / F.lit(float(2**53))


def mixing_rates(
    docs: DataFrame, labels: DataFrame, weights: dict[str, float], key: str = "doc_id", text: str = "text",
    label: str = LABEL,
) -> DataFrame:
    """``doc_id, tokens, domain, rate, copies`` of every row of ``docs``.

    ``weights`` are the domains' shares of the tokens of the mixture, which is as large as the corpus.
    ``domain`` is the likeliest one; ``copies`` is the rate rounded up or down by a hash of key and tokens, so
    that the mean is the rate. Null and blank texts have 0 tokens and a rate like others. Repeated rows
    are treated alike; an empty table gives an empty result; without usable labels all domains are as likely as
    the sample makes them, and targets may stay out of reach. Texts are not shuffled.
    """
    domains, rows = _posteriors(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("__t")), docs, labels, weights, key, text, label)
    everything = rows.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    share = sum(weights.values())
    rate, _ = fit_rates(rows, [everything * weights[d] / share for d in domains])
    named = F.array(*[F.lit(d) for d in domains])
    domain = F.element_at(named, F.array_position("p", F.array_max("p")).cast("int"))
    out = rows.select("doc_id", "tokens", domain.alias("domain"), rate.alias("rate"))
    return out.withColumn("copies", F.floor(F.col("rate") + uniform("doc_id", "tokens")).cast("long"))


def _posteriors(
    carried: DataFrame, docs: DataFrame, labels: DataFrame, weights: dict[str, float], key: str, text: str, label: str
) -> tuple[list[str], DataFrame]:
    """``carried`` (whose text is ``__t``) without its text, with ``tokens`` and ``p``, written."""
    if not weights or min(weights.values()) < 0 or sum(weights.values()) <= 0:
        raise ValueError("weights must not be negative, and one must be positive")
    domains = sorted(weights)
    classifier = fit_classifier(docs, labels, domains, key, text, label)
    kept = [c for c in carried.columns if c != "__t"]
    rows = classifier.posteriors(describe(carried, "__t").select(*kept, "tokens", "features"))
    return domains, written(rows, "posteriors")


def mix_documents(
    docs: DataFrame, labels: DataFrame, weights: dict[str, float], full: str, key: str = "doc_id",
    text: str = "text", label: str = LABEL,
) -> DataFrame:
    """The rows of ``docs``, with their columns, that make up the mixture; none is repeated.

    Documents likeliest in the domain ``full`` all stay, at rate 1, and with their expected tokens set the size of the
    mixture; the others are fitted to the targets, below a ceiling of 1. A document stays if a hash of its key and
    tokens is below its rate.
    """
    packed = docs.select(F.struct(*docs.columns).alias("__row"), F.col(key).alias("__key"), F.col(text).alias("__t"))
    domains, rows = _posteriors(packed, docs, labels, weights, key, text, label)
    own = F.get("p", F.lit(domains.index(full)))
    fixed = own == F.array_max("p")
    size = rows.agg(F.coalesce(F.sum(F.col("tokens") * own), F.lit(0.0))).first()[0] / weights[full]
    rate, _ = fit_rates(rows, [size * weights[d] for d in domains], ceiling=1.0, fixed=fixed)
    kept = rows.where(uniform("__key", "tokens") < rate)
    return kept.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])
