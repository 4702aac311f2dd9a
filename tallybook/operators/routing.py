"""Choice of the extraction method and of the extraction to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

# The names of the methods, and below their labels and confidences.
DOCUMENT, MODEL, LOCAL = "google_document_ai", "gemini_extraction", "pdf_extractor"


def choose_method(requested: Column, document_ready: Column, model_ready: Column, unknown: str = "local") -> Column:
    """The method to run: for ``auto`` the best one ready, else the one asked for.

    ``unknown`` says what an unknown request means: ``local`` (service) or ``auto`` (batch).
    """
    best = F.when(document_ready, DOCUMENT).when(model_ready, MODEL).otherwise(LOCAL)
    known = requested.isin(DOCUMENT, MODEL, LOCAL)
    fallback = best if unknown == "auto" else F.lit(LOCAL)
    return F.when(requested == "auto", best).when(known, requested).otherwise(fallback)


#: The error of a service that was due and gave nothing.
NO_ANSWER = "No answer"

# Labels and confidences of the extraction that was kept.
DIRECT = {
    DOCUMENT: ("Google Document AI", 95.0),
    MODEL: ("Gemini Extraction", 90.0),
    LOCAL: ("PDF Extractor (Regex)", 70.0),
}
MODEL_FALLBACK = ("Gemini Extraction (Fallback)", 85.0)
LOCAL_FALLBACK = ("PDF Extractor (Fallback)", 60.0)
DEFAULT = ("PDF Extractor (Default)", 0.0)
EMERGENCY = ("PDF Extractor (Emergency Fallback)", 0.0)


def pick_extraction(candidates: DataFrame, requested: str | Column = "auto", key: str = "invoice_id") -> DataFrame:
    """The extraction to keep per document, with its label and confidence.

    ``candidates`` has one row per document and attempted method: key, method, ok, the ``error`` text of a failed
    attempt if it has that column, and any payload columns. ``requested`` is what was asked for, the same for all
    or a column over the candidates. The ``error`` of an emergency fallback is that of the attempt that led to it.
    One partial and one final aggregate; attempts of a document need not sit together.
    """
    payload = [c for c in candidates.columns if c not in (key, "method", "ok", "error")]
    method, ok = F.col("method"), F.coalesce("ok", F.lit(False))
    wanted = F.coalesce(requested if isinstance(requested, Column) else F.lit(requested), F.lit(""))
    in_turn = F.when(method == DOCUMENT, 0).when(method == MODEL, 1).when(method == LOCAL, 2)
    as_asked = F.when(method == wanted, 0).when(method == LOCAL, 1)
    usable = F.when(ok, F.when(wanted == "auto", in_turn).otherwise(as_asked))
    message = F.col("error") if "error" in candidates.columns else F.lit(None).cast("string")

    picked = candidates.groupBy(key).agg(
        F.min_by(F.struct("method", *payload), usable).alias("_kept"),
        F.max(wanted).alias("_wanted"),
        *[F.max(method == m).alias(f"_tried_{m}") for m in (DOCUMENT, MODEL)],
        *[F.max((method == m) & ok).alias(f"_worked_{m}") for m in DIRECT],
        *[F.max(F.when((method == m) & ~ok, message)).alias(f"_error_{m}") for m in DIRECT],
    )

    def tried(m: str) -> Column:
        return F.col(f"_tried_{m}")

    def worked(m: str) -> Column:
        return F.col(f"_worked_{m}")

    auto = F.col("_wanted") == "auto"
    choices = [
        (auto & worked(DOCUMENT), DIRECT[DOCUMENT]),
        (auto & tried(DOCUMENT) & worked(MODEL), MODEL_FALLBACK),
        (auto & tried(DOCUMENT) & ~tried(MODEL) & worked(LOCAL), LOCAL_FALLBACK),
        (auto & tried(DOCUMENT), EMERGENCY),
        (auto & worked(MODEL), DIRECT[MODEL]),
        (auto & tried(MODEL), EMERGENCY),
        (auto & worked(LOCAL), DIRECT[LOCAL]),
        *[((F.col("_wanted") == m) & worked(m), label) for m, label in DIRECT.items()],
        (~auto & ~F.col("_wanted").isin(*DIRECT) & worked(LOCAL), DEFAULT),
    ]
    label, confidence = F.lit(EMERGENCY[0]), F.lit(EMERGENCY[1])
    for condition, (name, value) in reversed(choices):
        label = F.when(condition, name).otherwise(label)
        confidence = F.when(condition, value).otherwise(confidence)

    cause = F.when(auto, F.coalesce(f"_error_{MODEL}", f"_error_{DOCUMENT}", f"_error_{LOCAL}"))
    for m in DIRECT:
        cause = cause.when(F.col("_wanted") == m, F.coalesce(f"_error_{m}", f"_error_{LOCAL}"))
    cause = F.coalesce(cause.otherwise(F.col(f"_error_{LOCAL}")), F.lit("Selected extraction failed"))
    return picked.select(
        key,
        label.alias("model_used"),
        confidence.alias("confidence"),
        F.when(label == EMERGENCY[0], cause).alias("error"),
        F.col("_kept.method").alias("method"),
        *[F.col(f"_kept.{c}").alias(c) for c in payload],
    )


def attempts(
    files: DataFrame,
    answers: dict[str, DataFrame | None],
    payload: dict[str, DataType],
    key: str = "file_id",
    readable: Column | None = None,
) -> DataFrame:
    """Candidate rows of every file: what each method that is due for it gave, or why it failed.

    ``files`` holds key, ``requested``, ``document_ready`` and ``model_ready``; ``answers`` the rows of the document
    service and of the model by method: key, ``error`` (null where it worked) and any ``payload`` columns. The method
    chosen for a file is due, after a document service chosen for ``auto`` also a model that is ready, and the
    local extraction always, whose payload is left to the caller. A method that is due and has no answer failed. Files
    that are not ``readable`` have the local candidate alone. Files and answers are joined by key, and as candidates
    stay where the join put them, ``pick_extraction`` needs no further shuffle.
    """
    rows = files
    for method, answer in answers.items():
        if answer is not None:
            fields = [(F.col(c) if c in answer.columns else F.lit(None)).cast(t).alias(c) for c, t in payload.items()]
            told = F.struct(F.col("error").isNull().alias("ok"), "error", *fields)
            rows = rows.join(answer.select(key, told.alias(f"_{method}")), key, "left")
    usable = F.lit(True) if readable is None else F.coalesce(readable, F.lit(False))
    chosen = choose_method(F.col("requested"), F.col("document_ready"), F.col("model_ready"))
    model_next = (chosen == DOCUMENT) & (F.col("requested") == "auto") & F.col("model_ready")
    due = {DOCUMENT: chosen == DOCUMENT, MODEL: (chosen == MODEL) | model_next}

    def candidate(method: str, ok: Column, error: Column, value) -> Column:
        fields = [value(c).cast(t).alias(c) for c, t in payload.items()]
        return F.struct(F.lit(method).alias("method"), ok.alias("ok"), error.cast("string").alias("error"), *fields)

    def served(method: str) -> Column:
        if answers.get(method) is None:
            return candidate(method, F.lit(False), F.lit(NO_ANSWER), lambda _: F.lit(None))
        told = F.col(f"_{method}")
        ok = F.coalesce(told["ok"], F.lit(False))
        return candidate(method, ok, F.when(~ok, F.coalesce(told["error"], F.lit(NO_ANSWER))), lambda c: told[c])

    local = candidate(LOCAL, F.lit(True), F.lit(None), lambda _: F.lit(None))
    found = F.array_compact(F.array(*[F.when(usable & on, served(m)) for m, on in due.items()], local))
    return rows.select(*files.columns, F.inline(found))
