from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.sources import chunker as C


def law(*parts):
    return "\n\n".join(parts)


def test_articles_and_labels():
    text = C.clean(law("Giriş", "Yürürlük", "Madde 1 - bir", "EK MADDE 1 – ek", "Geçici Madde 2 süreli", "Madde 10 ilâ 15 - aralık", "DEĞİŞİKLİKLER CETVELİ", "Madde 99 - cetvel"))
    got = [(a.number, a.kind) for a in C.articles(text)]
    assert got == [(None, "preamble"), ("1", "madde"), ("Ek Madde 1", "ek_madde"), ("Geçici Madde 2", "gecici_madde"), ("10 ilâ 15", "madde")]
    assert C.articles(text)[1].text.startswith("Yürürlük")
    assert [a.kind for a in C.articles("düz metin")] == ["legal_document"] and C.articles("") == []


def test_pages_of_clauses():
    clause = "uzun bent metni burada yer alır ve sürer. " * 12
    rows = C.chunks(law("[[RAG_PAGE:1]]", "Madde 1 - kısa bir madde metni, ama otuzdan uzun.", "[[RAG_PAGE:2]]", f"Madde 2 - a) {clause}", f"b) {clause}", f"c) {clause}"))
    assert {r["page_start"] for r in rows if r["article_no"] == "2"} == {2} and rows[0]["page_start"] == 1
    assert all("RAG_PAGE" not in r["text"] for r in rows)


def test_short_chunks_and_ids():
    rows = C.chunks(law("Madde 1 - kısa", "Madde 2 - (Mülga: 1/1/2000-1234/5 md.) artık yok"), "4857_is.txt", "1")
    assert [r["article_no"] for r in rows] == ["2"] and rows[0]["chunk_id"].startswith("4857_2_00000_")
    assert C.law_number("is.txt", "unknown", "Kanun Numarası: 1234") == "1234" and C.law_number("is.txt", "5", "") == "5" and C.law_number("x.txt", None, "") == "unknown"
    a = C.chunk_id("1", "f", "", None, 0, "metin")
    assert a != C.chunk_id("1", "f", "doc", None, 0, "metin") and a.startswith("1_preamble_00000_")


def test_sentences_keep_their_blanks():
    long = "Bu bir cümledir. " * 100
    assert all("cümledir.Bu" not in c for c, _ in C.pack(long))
    assert any("cümledir.Bu" in c for c, _ in C.pack(long, C.Options(compat_join=True)))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc .!\n)(1-", max_size=3000), st.integers(20, 400))
def test_no_chunk_is_too_long(text, size):
    assert all(len(c) <= size for c, _ in C.pack(text.strip(), C.Options(size=size, overlap=size // 5)))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc ", max_size=2000), st.integers(5, 100))
def test_hard_split_loses_nothing(text, size):
    parts = C.hard_split(text, size)
    assert all(0 < len(p) <= size for p in parts) and "".join(parts).replace(" ", "") == text.replace(" ", "")


def test_frame(spark):
    df = spark.createDataFrame([("77_x.txt", "Madde 1 - " + "metin burada. " * 5, "k"), ("8_y.txt", None, "k"), ("9_z.txt", "", "k")], "source_file string, text string, other string")
    rows = C.enriched(C.split(df)).collect()
    assert [(r["source_file"], r["other"], r["law_number"], r["article_number"], r["ordinal"], r["language"]) for r in rows] == [("77_x.txt", "k", "77", "1", 0, "tr")]
