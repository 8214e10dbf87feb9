import pytest
from pyspark.sql import functions as F

from lodestone.functions import extract, jsonfix, text


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first()["y"]


def test_tokens_fold_after_cutting(spark):
    assert one(spark, "İzin ÇALIŞMA için the", text.tokens) == ["izin", "calisma", "icin", "the"]
    assert one(spark, "İzin ÇALIŞMA için the", lambda c: text.tokens(c, 3, True)) == ["izin", "calisma"]
    assert one(spark, None, text.tokens) == [] and one(spark, "İzin ve a", text.routing_tokens) == ["izin"]
    assert one(spark, "4857 sayılı İş Kanunu işçi", text.title_tokens) == ["isci"]


def test_clean_text(spark):
    raw = "başlık\r\n———————\nmetin (1)\nsürer\n\n 749 \n\n\n\nson  satır\t "
    assert one(spark, raw, text.clean_text) == "başlık\nmetin (1) sürer\n\nson satır"
    assert one(spark, None, text.clean_text) == ""


def test_ocr(spark):
    assert one(spark, "“a” b , 12 34  5 .", text.ocr_correct) == '"a" b, 12345.'
    assert one(spark, "Tüketici", text.detect_language)["detected"] == "tr"
    assert tuple(one(spark, "adres ve bir iki", text.detect_language)) == ("tr", pytest.approx(0.73))
    assert tuple(one(spark, "hello", text.detect_language)) == ("en", 0.6) and tuple(one(spark, "12", text.detect_language)) == ("tr", 0.0)
    assert one(spark, "yazı (1) birşey metindir\nbaşka uzunkelime (2) uzunkelimedir", text.order_unreliable) is True
    assert one(spark, "(1) bir\n(2) iki", text.order_unreliable) is False
    assert one(spark, "xkcdrtz bcdfghj kjhgfds", text.looks_corrupted) is True


def test_blocks_and_tables(spark):
    for raw, want in (("Doc_Title", "title"), ("page header", "header"), ("TABLE", "table"), ("stamp", "seal"), ("picture", "image"), ("", "unknown"), (None, "unknown")):
        assert one(spark, raw, text.block_type) == want
    html = "<TABLE><tr><th>a</th><td>b <i>c</i></td></tr>\n<tr><td> d </td></tr></TABLE>"
    cells = one(spark, html, text.table_cells)
    assert [tuple(c) for c in cells] == [(0, 0, "a"), (0, 1, "b c"), (1, 0, "d")]
    assert one(spark, html, lambda c: text.table_grid(text.table_cells(c))) == [["a", "b c"], ["d", ""]]
    assert one(spark, None, lambda c: text.table_grid(text.table_cells(c))) == []


def test_lines_articles_signature(spark):
    assert one(spark, " a \\n\\n b", text.display_lines) == ["a", "b"]
    got = one(spark, "giriş\nMADDE 1 - ilk\nsatır\nMadde 2: son", text.article_blocks)
    assert [(a["number"], a["lines"]) for a in got] == [("1", ["ilk", "satır"]), ("2", ["son"])]
    s = one(spark, "metin\nİmza:\nAyşe Kaya", text.signature)
    assert s["has_signature"] and s["handwritten"] and s["names"] == ["Ayşe Kaya"]
    assert one(spark, "metin", text.signature)["has_signature"] is False


def test_repeated_sentences(spark):
    long = "Bu cümle elli karakterden daha uzun olan bir örnek cümledir."
    assert one(spark, f"{long} Kısa. {long} Kısa.", text.without_repeats) == f"{long}\n\nKısa.\n\nKısa."
    assert one(spark, f"{long} {long}", text.repeats_itself) is True and one(spark, f"{long} Kısa. Kısa.", text.repeats_itself) is False


def test_extraction(spark):
    t = "Sayı: E-2024/15 tarih 12.05.2024, 3 Mayıs 2024 ve 2024-01-02. Tel 0532 123 45 67, 05321234567, (0212) 123 45 67. a@b.org"
    assert [d["value"] for d in one(spark, t, extract.dates)] == ["12.05.2024", "2024-01-02", "3 Mayıs 2024"]
    assert len(one(spark, t, extract.phones)) == 2 and one(spark, t, extract.emails)[0]["value"] == "a@b.org"
    assert one(spark, t, extract.document_number)["value"] == "E-2024/15" and one(spark, "yok", extract.document_number) is None
    for v, ok in (("31.01.2024", True), ("31.02.2024", False), ("2024-2-3", True), ("1/2/2024", True), ("2024.01.01", False), ("", False)):
        assert (one(spark, v, extract.parsed_date) is not None) is ok
    for v, ok in (("+90 532 123 45 67", True), ("05321234567", True), ("5321234567", True), ("90532123456", False), (None, False)):
        assert one(spark, v, extract.valid_phone) is ok
    assert one(spark, [3.0, 4.0], lambda c: extract.cosine(c, F.array(F.lit(3.0), F.lit(4.0))), "array<double>") == pytest.approx(1)
    assert one(spark, [0.0], lambda c: extract.cosine(c, c), "array<double>") == -1


def test_validation(spark):
    schema = "e struct<success:boolean,sender:string,date:string,address:string,phone:string,email:string>, c struct<success:boolean,classification_confidence:double>, o struct<success:boolean,full_text:string>"
    good = (True, "s", "01.02.2024", "adr", "5321234567", "a@b.org")
    rows = [
        ((good, (True, 0.9), (True, "t")), True, True, [], []),
        (((True, None, "x", None, "12", "a"), (False, 0.1), (True, " ")), False, False, ["invalid_date_format", "invalid_email_format", "invalid_phone_format"], ["partial_extraction_data", "classification_failed", "low_classification_confidence", "empty_ocr_text"]),
        (((False, *[None] * 5), None, None), False, False, ["extraction_failed"], []),
        ((None, (True, None), (False, None)), True, False, [], ["extraction_result_missing", "ocr_failed"]),
    ]
    df = spark.createDataFrame([r[0] for r in rows], schema).select(extract.validation(F.col("e"), F.col("c"), F.col("o")).alias("v"))
    for got, (_, success, complete, errors, warnings) in zip(df.collect(), rows, strict=True):
        assert tuple(got["v"]) == (success, complete, errors, warnings)


def test_json(spark):
    assert one(spark, '```json\n{"a": 1}\n```', jsonfix.repaired) == '{"a": 1}'
    assert one(spark, 'so {"a": {"b": 2}} it is', jsonfix.repaired) == '{"a": {"b": 2}}' and one(spark, "{", jsonfix.repaired) is None
    assert one(spark, '{"a": [1, 2,],}', jsonfix.recovered) == '{"a": [1, 2]}'
    got = one(spark, '{"document_type": "mektup", "confidence": 3, "alternatives": [{"document_type": "form", "confidence": -1}, {"document_type": "x"}]}', jsonfix.label)
    assert (got["document_type"], got["confidence"], [tuple(a) for a in got["alternatives"]]) == ("diger_belirsiz", 1.0, [("form", 0.0)])
    assert one(spark, "none", jsonfix.label) is None
