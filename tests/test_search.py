import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import filters, fusion, lawgraph, lexical, querying, retrieval, vectors

DOCS = [(1, "vergi borcu sorgulama"), (2, "vergi cezası ve usulsüzlük"), (3, "yol onarımı"), (4, ""), (5, "Vergi  BORCU sorgulama")]


@pytest.fixture(scope="module")
def index(spark):
    return lexical.tokenized(spark.createDataFrame(DOCS, "id long, text string"), "id", "text")


def test_bm25_equals_the_formula(spark, index):
    q = spark.createDataFrame([(1, "vergi vergi borcu yok")], "query long, text string")
    words = {1: "vergi borcu sorgulama".split(), 2: "vergi cezasi ve usulsuzluk".split(), 3: "yol onarimi".split(), 4: ["_empty_"], 5: "vergi borcu sorgulama".split()}
    avg = sum(map(len, words.values())) / 5
    idf = lambda t: math.log(1 + (5 - sum(t in w for w in words.values()) + 0.5) / (sum(t in w for w in words.values()) + 0.5))
    want = {d: sum(idf(t) * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / avg)) for t in ["vergi", "vergi", "borcu"]) for d, w in words.items() if set(w) & {"vergi", "borcu"}}
    got = {r["doc"]: r["score"] for r in lexical.scores(q, index).collect()}
    assert got == pytest.approx(want)
    top = lexical.search(q, index, 2).orderBy("rank").collect()
    assert [(r["doc"], r["rank"], r["score"]) for r in top] == [(1, 1, 1.0), (5, 2, 1.0)]
    assert lexical.search(q, index, 5, spark.createDataFrame([(2,)], "doc long")).count() == 1
    cap = lexical.caps(q, index).first()["cap"]
    assert cap == pytest.approx(idf("vergi") + idf("borcu") + math.log(1 + 5.5 / 0.5))


def test_knn(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0]), (7, [2.0, 0.0])], "doc long, vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (9, None)], "query long, vector array<double>")
    assert [(r["doc"], r["score"]) for r in vectors.search(q, v, 3).orderBy("rank").collect()] == [(1, 1.0), (7, 1.0), (3, 0.8536)]
    assert vectors.knn(q, v, 1, skip_self=True).first()["doc"] == 7
    assert vectors.knn(q.where("query > 9"), v, 3).count() == 0


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query long, doc long, rank int, score double")


def test_fusion(spark):
    a, b = ranked(spark, [(1, 10, 1, 0.9), (1, 11, 2, 0.8)]), ranked(spark, [(1, 11, 1, 0.7), (1, 12, 2, 0.1)])
    got = [(r["doc"], r["score"]) for r in fusion.rrf([a, b], [0.55, 0.45]).orderBy("rank").collect()]
    assert got == [(11, round(0.55 / 62 + 0.45 / 61, 6)), (10, round(0.55 / 61, 6)), (12, round(0.45 / 62, 6))]
    assert sorted(r["doc"] for r in fusion.rrf([b, a], [0.45, 0.55]).collect()) == [10, 11, 12]
    texts = spark.createDataFrame([(10, "A  b"), (11, "a b"), (12, "c")], "doc long, text string")
    once = fusion.distinct_texts(ranked(spark, [(1, 10, 1, 0.9), (1, 11, 2, 0.8), (1, 12, 3, 0.1)]), texts)
    assert [(r["doc"], r["rank"]) for r in once.orderBy("rank").collect()] == [(10, 1), (12, 2)]
    assert [(r["doc"], r["rank"]) for r in fusion.distinct_texts(once.select("query", "doc", "rank", "score"), texts).orderBy("rank").collect()] == [(10, 1), (12, 2)]
    cross = spark.createDataFrame([(1, 10, 0.1), (1, 11, 0.9)], "query long, doc long, cross double")
    assert [r["doc"] for r in fusion.blend(a, cross).orderBy("rank").collect()] == [11, 10]
    assert [r["doc"] for r in fusion.blend(a, cross, 1.0).orderBy("rank").collect()] == [10, 11]


def test_feedback(spark):
    q = spark.createDataFrame([(1, "vergi borcu")], "query long, text string")
    texts = spark.createDataFrame([(10, "vergi tahsilat tahsilat usul"), (11, "usul kural")], "doc long, text string")
    terms = fusion.feedback_terms(ranked(spark, [(1, 10, 1, 1.0), (1, 11, 2, 0.5)]), texts, q, terms=2)
    assert [r["term"] for r in terms.orderBy("nth").collect()] == ["tahsilat", "usul"]
    assert fusion.expanded(q, terms).first()["text"] == "vergi borcu tahsilat usul"


def test_questions(spark):
    ask = lambda t, f: spark.createDataFrame([(t,)], "q string").select(f(F.col("q")).alias("y")).first()["y"]
    cite = lambda t, **k: tuple(ask(t, lambda c: querying.citation(c, **k)))
    assert cite("5271/100 nedir") == ("5271", "100") and cite("4857 Sayılı Kanun madde 3") == ("4857", "3") and cite("TCK 65") == ("5237", "65")
    assert cite("İş Kanunu 12. maddesi") == ("4857", "12") and cite("bilgim 5 kaldı") == (None, None) and cite("bilgim 5 kaldı", compat=True) == (None, "5")
    plan = lambda t: ask(t, lambda c: querying.plan(c, querying.citation(c)))["name"]
    assert [plan(t) for t in ("5271/100", "hangi maddede yazar", "iki madde arasındaki ilişki", "beyanname vermedim", "bambaşka bir şey")] == ["exact_citation", "article_lookup", "legal_relationship", "lexical_legal_lookup", "semantic_hybrid"]
    assert [ask(t, querying.source_scope) for t in ("değişiklik ne", "yönetmelik", "soru")] == [None, "regulations", "laws"]
    assert ask("vergi borcum nede", querying.rewrites) == ["vergi borcum nede", "vergi borcumu nerede"] and ask("tck nedir", querying.rewrites)[1] == "Türk Ceza Kanunu nedir"
    assert ask("izin", lambda c: querying.accepted_variants(c, F.array(F.lit("İZİN 2024"), F.lit("IZIN"), F.lit("izin"), F.lit("yıllık izin")))) == ["izin", "yıllık izin"]
    assert ask("12. maddesi", querying.with_article) == ["12. maddesi", "Madde 12"] and ask("fesih", querying.with_synonyms) == "fesih sona erdirme işten çıkarma"
    assert ask("e-devlet nerede", querying.asks_for_service) is True


def test_laws_by_title(spark):
    q = spark.createDataFrame([(1, "yedek subaylar ve askeri memurlar ne"), (2, "subaylar")], "query long, text string")
    titles = spark.createDataFrame([("1076", "1076_Yedek Subaylar ve Askeri Memurlar Kanunu"), ("2", "Subaylar Kanunu"), ("unknown", "yedek subaylar")], "law_number string, title string")
    assert [tuple(r) for r in querying.laws_by_title(q, titles).collect()] == [(1, "1076")]


def test_filters_hold_before_ranking(spark):
    chunks = spark.createDataFrame([(i, "vergi borcu" if i < 5 or i == 199 else f"yol {i}", "9999" if i == 199 else "1", "1", "laws") for i in range(200)], "chunk_id long, text string, law_number string, article_no string, source_type string")
    near = spark.createDataFrame([(i, [1.0, i / 100]) for i in range(200)], "doc long, vector array<double>")
    index = retrieval.Index(chunks, near)
    q = spark.createDataFrame([(1, "vergi", {"law_number": "9999"}, [1.0, 0.0]), (2, "vergi", None, [1.0, 0.0])], "query long, text string, where map<string,string>, vector array<double>")
    for mode in ("vector", "bm25", "hybrid"):
        got = retrieval.hybrid(index, q, 5, mode).collect()
        assert [r["doc"] for r in got if r["query"] == 1] == [199] and sorted(r["doc"] for r in got if r["query"] == 2) == [0, 1, 2, 3, 4], mode


def test_tokens_keep_characters_apart_that_lower_case_would_join(spark):
    from lodestone.functions.text import tokens

    rows = spark.createDataFrame([("İstanbul'da IŞIK ılık Å\u212a5K\u0307 b\u212bc ÇÖĞÜ",), (None,), (" - ",)], "t string").select(tokens(F.col("t")).alias("w")).collect()
    assert [r["w"] for r in rows] == [["istanbul", "da", "isik", "ilik", "å", "5k", "b", "c", "cogu"], [], []]


def test_filters(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", 5), (3, None, 6)], "doc long, k string, n int")
    assert [r["doc"] for r in filters.matching(df, {"k": {"$in": ["a", "b"]}, "n": 5}).collect()] == [1, 2] and filters.matching(df, None).count() == 3
    assert filters.matching(df, {"nope": 1}, {"k": "a"}).count() == 1 and filters.matching(df, {"k": "c"}).count() == 0
    docs = df.withColumn("text", F.lit("vergi")).withColumn("vector", F.array(F.lit(1.0), F.col("doc").cast("double")))
    q = spark.createDataFrame([(1, {"k": "a"}), (2, None), (3, {"k": "zz"}), (4, {"k": "b", "other": "c"})], "query long, where map<string,string>").withColumn("text", F.lit("vergi")).withColumn("vector", F.array(F.lit(1.0), F.lit(0.0)))
    admitted = [(1, 1), (2, 1), (2, 2), (2, 3), (4, 2)]
    for got in (lexical.scores(q, lexical.tokenized(docs, "doc", "text", keep=("k",)), where="where", keys=("k",)), vectors.knn(q, docs, 3, where="where", keys=("k",))):
        assert sorted((r["query"], r["doc"]) for r in got.collect()) == admitted
    m = spark.createDataFrame([({"a": "1"}, {"a": "2", "b": "3"}, {"Token": "x", "y": "z"})], "e map<string,string>, x map<string,string>, p map<string,string>")
    got = m.select(filters.merged(F.col("e"), F.col("x")).alias("m"), filters.redacted(F.col("p")).alias("p")).first()
    assert got["m"] == {"a": "1", "b": "3"} and got["p"] == {"Token": "<redacted>", "y": "z"}


CHUNKS = [(1, "1", "1", "ilk madde"), (2, "1", "2", "ikinci, 2 sayılı Kanunun 7. maddesine bakar"), (3, "1", "10", "on"), (4, "1", "Ek Madde 1", "ek"), (5, "2", "7", "yedi"), (6, "2", "8", "1 sayılı 99 madde 5")]


def test_graph(spark):
    arts = lawgraph.articles(spark.createDataFrame(CHUNKS, "chunk_id long, law_number string, article_no string, text string"))
    edges = {(r["src"][-3:], r["dst"][-3:]) for r in lawgraph.adjacent(arts).collect()}
    assert len(edges) == 4 and tuple(lawgraph.statistics(arts).first()) == (2, 6, 4, 0)
    full = spark.createDataFrame([(1, "100", "1", "x"), (2, "200", "7", "100 sayılı Kanunun 1. maddesine ve 100 sayılı kanun madde 9")], "chunk_id long, law_number string, article_no string, text string")
    arts2 = lawgraph.articles(full)
    assert [tuple(r) for r in lawgraph.mentions(arts2).collect()] == [("law:200|article:7", "law:100|article:1")]
    start = spark.createDataFrame([(1, "law:1|article:1")], "query long, node string")
    got = {r["node"][-1:]: r["distance"] for r in lawgraph.within(start, lawgraph.both_ways(lawgraph.adjacent(arts)), 2).collect()}
    assert got == {"1": 0, "2": 1, "0": 2}
    cited = spark.createDataFrame([(1, "1", "2")], "query long, law_number string, article_no string")
    out = lawgraph.enriched(ranked(spark, [(1, 2, 1, 0.9)]), cited, arts).orderBy("rank").collect()
    assert [(r["doc"], r["score"], r["graph_distance"]) for r in out] == [(2, 0.9, None), (1, 0.27, 1), (3, 0.27, 1)]
    assert lawgraph.missing(cited, ranked(spark, [(1, 2, 1, 0.9)]), arts).count() == 0 and lawgraph.missing(cited, ranked(spark, [(1, 1, 1, 0.9)]), arts).count() == 1


def test_retrieve(spark):
    chunks = spark.createDataFrame([(i, t, "213", str(i), "laws") for i, t in DOCS], "chunk_id long, text string, law_number string, article_no string, source_type string")
    q = spark.createDataFrame([(1, "vergi borcu"), (2, "213 sayılı kanun madde 3"), (3, " ")], "query long, text string")
    got = retrieval.retrieve(retrieval.Index(chunks), q, 3, use_prf=None).collect()
    assert {(r["query"], r["rank"]): r["doc"] for r in got if r["query"] == 1}[(1, 1)] == 1 and all(r["query"] != 3 for r in got)
    assert retrieval.sizes(None) == (5, 20) and retrieval.sizes(99) == (20, 40) and retrieval.sizes(-1) == (1, 20)


def test_contexts(spark):
    chunks = spark.createDataFrame([(i, t, "213", str(i), "laws") for i, t in DOCS], "chunk_id long, text string, law_number string, article_no string, source_type string")
    got = {r["query"]: r for r in retrieval.contexts(retrieval.Index(chunks), spark.createDataFrame([(1, "yol onarımı"), (2, "hiç yok")], "query long, text string"), 2).collect()}
    assert got[1]["count"] == 1 and got[1]["sources"][0]["article_number"] == "3" and (got[2]["context"], got[2]["count"]) == ("", 0)


@pytest.mark.parametrize("variant", ["plus1", "okapi"])
def test_blocks_give_the_best_of_all_postings(spark, variant):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(60)], k=rng.randint(0, 60)))) for i in range(300)] + [(300 + i, "w7 w8 w9") for i in range(40)]
    queries = [(i, " ".join(rng.choices(words, k=rng.randint(1, 6)))) for i in range(20)] + [(50, "nowhere"), (51, ""), (52, "w0 w0 w59"), (53, docs[5][1])]
    t, q = lexical.indexed(spark.createDataFrame(docs, "id long, text string"), "id", "text"), spark.createDataFrame(queries, "query long, text string")
    index = lexical.Blocks.build(t, 4, variant)
    for k in (1, 7):
        want = {(r["query"], r["doc"], r["rank"], r["score"]) for r in lexical.top(lexical.scores(q, t, variant), k).select("query", "doc", "rank", "score").collect()}
        assert {(r["query"], r["doc"], r["rank"], r["score"]) for r in index.top(q, k).select("query", "doc", "rank", "score").collect()} == want
    if variant == "plus1":
        every, opened = index.share(q, 1)
        assert opened < every / 2
