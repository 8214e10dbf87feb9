"""Fields of documents: extraction by pattern, and validation, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of dates, phone numbers, addresses and document numbers.
DATES = (
    r"\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b",
    r"\b\d{4}-\d{1,2}-\d{1,2}\b",
    r"(?iu)\b\d{1,2}\s+(?:Ocak|Şubat|Mart|Nisan|Mayıs|Haziran|Temmuz|Ağustos|Eylül|Ekim|Kasım|Aralık)\s+\d{4}\b",
)
PHONES = (
    r"(?:\+90|0)?\s*\(?5\d{2}\)?[\s.-]?\d{3}[\s.-]?\d{2}[\s.-]?\d{2}",
    r"(?:\+90|0)?\s*\(?0?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{2}[\s.-]?\d{2}",
)
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
NUMBERS = (r"(?iu)(?:Sayı|Sayi|Evrak\s*No|Belge\s*No)\s*[:\-]?\s*([A-Za-z0-9\-/]{3,20})", r"(?i)\b(E-\d{6,})\b")
PAGE_DATE = r"\b(?:\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}[./-]\d{1,2}[./-]\d{1,2})\b"
VALID_EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def _values(values: Column, confidence: float) -> Column:
    return F.transform(values, lambda v: F.struct(v.alias("value"), F.lit(confidence).alias("confidence"), F.lit("regex").alias("source")))


def dates(text: Column) -> Column:
    """Dates, those of one notation after the other, as array<struct<value, confidence, source>>."""
    return _values(F.concat(*(_all(text, p) for p in DATES)), 0.95)


def phones(text: Column) -> Column:
    """Phone numbers of ten digits or more, each once whatever its spelling."""
    found = F.transform(F.concat(*(_all(text, p) for p in PHONES)), lambda v: F.struct(F.regexp_replace(v, r"[^0-9]", "").alias("d"), F.trim(v).alias("v")))
    zero = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        keep = (F.length(x["d"]) >= 10) & ~F.array_contains(acc["seen"], x["d"])
        return F.struct(F.when(keep, F.concat(acc["seen"], F.array(x["d"]))).otherwise(acc["seen"]).alias("seen"), F.when(keep, F.concat(acc["out"], F.array(x["v"]))).otherwise(acc["out"]).alias("out"))

    return _values(F.aggregate(found, zero, step, lambda acc: acc["out"]), 0.9)


def emails(text: Column) -> Column:
    return _values(_all(text, EMAIL), 0.97)


def document_number(text: Column) -> Column:
    """struct of the first document number by the first notation that has one; null if none has."""
    tries = [F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), p, 1), F.lit("")) for p in NUMBERS]
    value = F.coalesce(*tries)
    return F.when(value.isNotNull(), F.struct(F.trim(value).alias("value"), F.lit(0.85).alias("confidence"), F.lit("regex").alias("source")))


def overall_confidence(dates_: Column, number: Column, entities: Column, request: Column) -> Column:
    """Mean of what was found, to three places: the request's confidence if it has one, 0.9 for dates, the number's, each entity's."""
    known = F.concat(
        F.when(F.coalesce(request, F.lit(0.0)) > 0, F.array(request)).otherwise(F.array().cast("array<double>")),
        F.when(F.size(dates_) > 0, F.array(F.lit(0.9))).otherwise(F.array().cast("array<double>")),
        F.when(number.isNotNull(), F.array(number["confidence"])).otherwise(F.array().cast("array<double>")),
        F.coalesce(entities, F.array().cast("array<double>")),
    )
    return F.when(F.size(known) > 0, F.bround(F.aggregate(known, F.lit(0.0), lambda a, b: a + b) / F.size(known), 3)).otherwise(0.0)


def page_dates(text: Column) -> Column:
    """Distinct dates in order; the first is the document's."""
    return F.array_distinct(_all(text, PAGE_DATE))


def parsed_date(value: Column) -> Column:
    """A date in one of the three accepted notations; null for others and for days that do not exist."""
    v = F.trim(value)
    shaped = lambda shape, format: F.when(v.rlike(shape), F.try_to_timestamp(v, F.lit(format)).cast("date"))
    return F.coalesce(shaped(r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"), shaped(r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), shaped(r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"))


def valid_email(value: Column) -> Column:
    return F.coalesce(F.trim(value).rlike(VALID_EMAIL), F.lit(False))


def valid_phone(value: Column, length: int = 10) -> Column:
    """Whether a number has so many digits, less a country code or a leading zero where the length shows there is one."""
    d = F.regexp_replace(F.coalesce(value, F.lit("")), r"[^0-9]", "")
    d = F.when(d.startswith("90") & (F.length(d) == length + 2), F.substring(d, 3, length)).when(d.startswith("0") & (F.length(d) == length + 1), F.substring(d, 2, length)).otherwise(d)
    return F.length(d) == length


def validation(extraction: Column, classification: Column, ocr: Column) -> Column:
    """struct(success, is_complete, errors, warnings) of a document's stage results, by ten rules.

    extraction: struct of success, sender, date, address, phone, email; classification: of success, classification_confidence; ocr: of
    success, full_text. Each may be null."""
    fields = [extraction[k] for k in ("sender", "date", "address", "phone", "email")]
    given = [F.coalesce(f != "", F.lit(False)) for f in fields]
    some, every = given[0], given[0]
    for g in given[1:]:
        some, every = some | g, every & g
    done = F.coalesce(extraction["success"], F.lit(False))
    rules = lambda *pairs: F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in pairs)))
    errors = rules(
        ("extraction_failed", extraction["success"] == F.lit(False)),
        ("invalid_date_format", done & given[1] & parsed_date(fields[1]).isNull()),
        ("invalid_email_format", done & given[4] & ~valid_email(fields[4])),
        ("invalid_phone_format", done & given[3] & ~valid_phone(fields[3])),
    )
    blank = F.trim(F.coalesce(ocr["full_text"], F.lit(""))) == ""
    warnings = rules(
        ("extraction_result_missing", extraction["success"].isNull()),
        ("partial_extraction_data", done & some & ~every),
        ("classification_failed", classification["success"] == F.lit(False)),
        ("low_classification_confidence", classification["classification_confidence"] < 0.5),
        ("ocr_failed", ocr["success"] == F.lit(False)),
        ("empty_ocr_text", F.coalesce(ocr["success"], F.lit(False)) & blank),
    )
    return F.struct((F.size(errors) == 0).alias("success"), (done & every & (F.size(errors) == 0)).alias("is_complete"), errors.alias("errors"), warnings.alias("warnings"))


def missing(names: dict[str, Column]) -> Column:
    """Names of the values that are null or blank."""
    return F.array_compact(F.array(*(F.when(F.coalesce(F.trim(c.cast("string")), F.lit("")) == "", F.lit(n)) for n, c in names.items())))


def gate(confidence: Column, least: float = 0.60) -> Column:
    """A classification's status."""
    return F.when(F.coalesce(confidence, F.lit(0.0)) >= least, "success").otherwise("needs_review")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; -1 where the lengths differ, or one is empty or all zeros."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) <= 0) | (norm == 0), F.lit(-1.0)).otherwise(dot(a, b) / F.when(norm == 0, 1.0).otherwise(norm))


def similarity(distance: Column) -> Column:
    """A cosine distance as a score from 0 to 1, to four places."""
    return F.round(F.greatest(F.lit(0.0), 1 - distance / 2), 4)


def box(points: Column) -> Column:
    """struct(x0, y0, x1, y1) around a polygon's points."""
    side = lambda k, f: f(F.transform(points, lambda p: F.get(p, F.lit(k))))
    return F.struct(side(0, F.array_min).alias("x0"), side(1, F.array_min).alias("y0"), side(0, F.array_max).alias("x1"), side(1, F.array_max).alias("y1"))


def image_quality(blur: Column, brightness: Column, contrast: Column) -> Column:
    """An image's score from features between 0 and 1."""
    return 0.5 * blur + 0.25 * brightness + 0.25 * contrast
