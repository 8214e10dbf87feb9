"""Reading what language models write as JSON, with or without fences and prose around it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes of the document classes, in their order (fixed values).
CLASSES = (
    "dilekce", "basvuru_belgesi", "talep_yazisi", "sikayet_basvurusu", "itiraz_basvurusu", "bilgi_edinme_basvurusu", "resmi_yazi", "ust_yazi",
    "izin_belgesi", "onay_belgesi", "tutanak", "form", "beyan_beyanname", "bildirim_tebligat", "rapor", "karar_karar_yazisi", "sozlesme_protokol",
    "diger_belirsiz",
)
UNCERTAIN = "diger_belirsiz"


def _is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def repaired(raw: Column) -> Column:
    """The JSON text within a model's answer: without fences, else from the first to the last brace; null if neither parses."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(raw), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    inner = F.regexp_extract(plain, r"(?s)\{.*\}", 0)
    return F.when(_is_json(plain), plain).when((inner != "") & _is_json(inner), inner)


def recovered(raw: Column) -> Column:
    """Like repaired(), and, failing that, with trailing commas dropped, smart quotes straightened and escapes undone."""
    first = repaired(raw)
    text = F.translate(raw, "“”", '""')
    second = repaired(F.regexp_replace(text, r",\s*([}\]])", "$1"))
    third = repaired(F.replace(F.replace(text, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")))
    return F.coalesce(first, second, third)


def label(raw: Column, classes: tuple[str, ...] = CLASSES, uncertain: str = UNCERTAIN) -> Column:
    """struct(document_type, confidence, alternatives) of a classifier's answer: unknown types are uncertain, confidences
    lie between 0 and 1, and alternatives of unknown types are dropped. Null if the answer holds no JSON object."""
    schema = "document_type STRING, confidence DOUBLE, alternatives ARRAY<STRUCT<document_type: STRING, confidence: DOUBLE>>"
    got = F.from_json(repaired(raw), schema, {"mode": "PERMISSIVE"})
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.0))))
    known = got["document_type"].isin(*classes)
    others = F.transform(F.filter(F.coalesce(got["alternatives"], F.array().cast("array<struct<document_type:string,confidence:double>>")), lambda a: a["document_type"].isin(*classes)), lambda a: F.struct(a["document_type"].alias("document_type"), clamp(a["confidence"]).alias("confidence")))
    made = F.struct(F.when(known, got["document_type"]).otherwise(uncertain).alias("document_type"), clamp(got["confidence"]).alias("confidence"), others.alias("alternatives"))
    return F.when(repaired(raw).isNotNull(), made)


def envelope(success: Column, **data: Column) -> Column:
    """The wire form of one document's result: a success flag and a list with one object."""
    return F.to_json(F.struct(success.alias("Success"), F.array(F.struct(*(c.alias(k) for k, c in data.items()))).alias("Data")))
