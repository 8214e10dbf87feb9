import pytest
from pyspark.sql import functions as F

from lodestone.operators import answers, querying


def value(spark, f, **cols):
    df = spark.range(1).select(*(F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in cols.items()))
    return df.select(f(*(F.col(k) for k in cols)).alias("y")).first()["y"]


def test_scoped_text(spark):
    t = "Madde 5 - beş\nmetin\nMadde 6 - altı\nMadde 7 – yedi"
    assert value(spark, answers.scoped_text, t=t, a="5") == "Madde 5 - beş\nmetin\n" and value(spark, answers.scoped_text, t=t, a="") == t
    assert value(spark, answers.scoped_text, t="düz", a="5") == "düz"
    assert value(spark, answers.law_title, n="5237", m="5237_Türk Ceza Kanunu") == "5237 sayılı Türk Ceza Kanunu" and value(spark, answers.law_title, n="unknown", m="X") == "X"


def test_packing_passes_over_what_does_not_fit(spark):
    chunks = spark.createDataFrame([(1, "a " * 100, "k"), (2, "b " * 900, "k"), (3, "c " * 50, "k"), (4, "A " * 100, "k"), (5, "", "k")], "chunk_id long, text string, law_name string")
    hits = spark.createDataFrame([(1, i, 1 - i / 10) for i in range(1, 6)], "query long, doc long, score double")
    got = answers.packed(hits, chunks, 150).first()
    assert [s["chunk_id"] for s in got["sources"]] == [1, 3] and [s["label"] for s in got["sources"]] == ["S1", "S2"] and got["dropped"] == 1 and got["used"] <= 150
    assert got["context"].startswith("[S1] k | Kanun unknown | Madde unknown | Dosya unknown\na a")


def test_citations(spark):
    check = lambda a, labels: tuple(value(spark, answers.citation_check, a=a, b=labels))
    assert check("x [S1] [S9] [S3]", ["S1", "S2"]) == (False, ["S3", "S9"]) and check("x [S1]", ["S1"]) == (True, []) and check("none", ["S1"]) == (False, [])
    assert value(spark, answers.abstained, a="Sağlanan kaynaklarda doğrulanamadı.") is True and value(spark, answers.abstained, a="Evet") is False


SOURCES = [("S1", "Madde 4 - başka konu", "VUK", "213", "4", "f", 1, 1, 0.9), ("S2", "Madde 5 – vergi mahremiyeti ve gizlilik", "VUK", "213", "5", "f", None, 2, 0.8)]


def test_article_vote(spark):
    df = spark.createDataFrame([("mahremiyet gizlilik hangi maddede", SOURCES), ("hangi madde", SOURCES), ("mahremiyet", [])], f"q string, s array<{answers.SOURCE}>")
    got = [r["v"]["label"] if r["v"] else None for r in df.select(answers.article_vote(F.col("q"), F.col("s")).alias("v")).collect()]
    assert got == ["S2", None, None]
    assert "[S1] 213 sayılı VUK - Madde 4 - Sayfa 1" in df.select(answers.rendered(F.col("s")).alias("r")).first()["r"]


def test_ladder(spark):
    rows = [(1, "soru bir"), (2, ""), (3, "5271/100 nedir"), (4, "kaynak yok"), (5, "mahremiyet hangi maddede"), (6, "çekimser"), (7, "yanlış atıf"), (8, "atıfsız"), (9, "saklı"), (10, "nerede sorgulanır")]
    asked = spark.createDataFrame(rows, "query long, text string")
    asked = asked.withColumn("cited", querying.citation(F.col("text"))).withColumn("plan", querying.plan(F.col("text"), F.col("cited")))
    ctx = spark.createDataFrame([(q, "ctx", SOURCES if q != 4 else []) for q, _ in rows], f"query long, context string, sources array<{answers.SOURCE}>")
    drafts = {1: "Cevap [S1].", 6: "Sağlanan kaynaklarda doğrulanamadı.", 7: "Cevap [S7].", 8: "Cevap."}
    seen = []

    def generate(df):
        seen.extend(r["query"] for r in df.collect())
        return spark.createDataFrame(list(drafts.items()), "query long, draft string")

    cache = spark.createDataFrame([(9, "Saklı cevap. İkinci cümle.")], "query long, payload string")
    got = {r["query"]: (r["status"], r["grounded"]) for r in answers.answered(asked, ctx, generate, cache).collect()}
    assert got == {1: ("generated", True), 2: ("empty_question", False), 3: ("reference_not_found", False), 4: ("no_retrieved_evidence", False), 5: ("article_lookup", True), 6: ("abstained", False), 7: ("invalid_citations", False), 8: ("missing_citations", False), 9: ("cache", True), 10: ("service_notice", False)}
    assert sorted(seen) == [1, 6, 7, 8]
    fix = lambda df: spark.createDataFrame([(8, "Cevap [S2].")], "query long, draft string")
    more = {r["query"]: (r["status"], r["answer"]) for r in answers.answered(asked, ctx, generate, None, fix, on_invalid="nearby", on_missing="repair", guard=False).collect()}
    assert more[8] == ("generated", "Cevap [S2].") and "Yakın kaynaklar" in more[7][1] and more[3][0] != "reference_not_found"


def test_cache(spark):
    schema = "entry long, question string, version int, payload string, created_at long"
    cache = spark.createDataFrame([(1, "Soru  bir", 9, "eski", 1), (2, "soru bir", 9, "yeni", 2), (3, "soru bir", 8, "başka", 3), (4, "iki", 9, "iki", 4)], schema)
    q = spark.createDataFrame([(1, "SORU bir"), (2, "üç")], "query long, text string")
    near = spark.createDataFrame([(1, 4, 0.99), (2, 4, 0.95), (2, 1, 0.95), (2, 3, 1.0)], "query long, entry long, cosine double")
    assert sorted(tuple(r) for r in answers.probe(q, cache, near).collect()) == [(1, "yeni", 1.0, True), (2, "eski", 0.95, False)]
    kept = answers.stored(cache, spark.createDataFrame([(5, "SORU BIR x", 9, "x", 9), (6, "iki", 9, "iki2", 10)], schema), 3)
    assert sorted(r["payload"] for r in kept.collect()) == ["başka", "iki2", "x"]


def test_conversations(spark):
    turns = [(1, 1, "Vergi mahremiyeti nedir", "c", "213"), (1, 2, "Peki cezası ne kadar", "c", None), (1, 3, "5237 sayılı kanun nedir", "c", "5237"), (1, 4, "bambaşka", "c", None), (1, 5, "peki ne yapmam gerek", "c", None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, question string, answer string, law_number string")
    got = answers.follow_ups(df).orderBy("turn").collect()
    assert [r["related"] for r in got] == [False, True, False, False, True] and got[4]["ambiguous"] and got[1]["scoped"] == "213 sayılı Kanun kapsamında: Peki cezası ne kadar"
    assert got[4]["memory"].count("Tur ") == 3 and got[0]["memory"] == ""
    whole = answers.conversations(df, lambda d: d.select("conv_id", "turn", F.lit("a").alias("answer"), F.lit("7").alias("law_number"))).orderBy("turn").collect()
    assert whole[1]["scoped"].startswith("7 sayılı")


if __name__ == "__main__":
    pytest.main([__file__])
