import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import tokens
from lodestone.operators import fusion, lexical, routing, sparse
from lodestone.plans import catalogue

ODD = ["", None, "İIıi ŞşĞğ ÇçÖöÜü", "ȧb", "KK ẞß ÿŸ ×÷", "“q” — dash…", "日本 x", "a\x00b", "_empty_", "é" * 3, "😀x", "".join(map(chr, range(1, 0x250)))]


def test_words_equal_the_columns_tokens(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "id long, text string")
    want = {r["id"]: r["w"] or ["_empty_"] for r in df.select("id", tokens(F.col("text")).alias("w")).collect()}
    got = {r["doc"]: (r["terms"], r["length"]) for r in lexical.tokenized(df, "id", "text").collect()}
    assert got == {i: (w, len(w)) for i, w in want.items()}
    assert sparse.words(b"ab\xffcd") == [b"ab", b"cd"]


def made(spark, seed=4, n=300):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    text = lambda m: " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(40)], k=rng.randint(0, m)))
    texts = [text(30) for _ in range(n)]
    docs = [(i, texts[i % (n - 60)], rng.choice(["a", "b", None])) for i in range(n)]  # many equal texts, so scores tie
    asked = [(i, text(8), {"k": rng.choice(["a", "b"])} if i % 2 else None) for i in range(25)] + [(90, "none of these", None), (91, "", None)]
    return spark.createDataFrame(docs, "id long, text string, k string").repartition(5), spark.createDataFrame(asked, "query long, text string, where map<string,string>")


@pytest.mark.parametrize("variant, where, many", [("plus1", None, 70), ("okapi", "where", 1 << 18)])
def test_best_equals_the_top_of_all_scores(spark, monkeypatch, variant, where, many):
    docs, asked = made(spark)
    t = lexical.indexed(docs, "id", "text", keep=("k",))
    monkeypatch.setattr(lexical, "ROWS", many)  # the smaller number makes several parts of queries
    rows = lambda df: {(r["query"], r["doc"], r["rank"], r["score"]) for r in df.collect()}
    want = rows(lexical.top(lexical.scores(asked, t, variant, where=where, keys=("k",)), 7))
    assert rows(lexical.best(asked, t, 7, variant, where=where, keys=("k",))) == want and len(want) > 100


def test_best_in_small_pieces(monkeypatch):
    docs = pa.record_batch([pa.array(range(60), pa.int64()), pa.array([3] * 60, pa.int32()), pa.array([f"a b w{i % 7}" for i in range(60)])], ["doc", "length", "words"])
    asked = sparse.Asked.of(pa.array(["a", "w3", "w3", "b"]), pa.array([0, 0, 1, 2]).to_numpy(), pa.array([1.0, 2.0, 1.0, -1.0]).to_numpy(), [], 3)
    run = lambda: [x.tolist() for x in sparse.best(asked, 4, lambda tf, n: tf * 1.0, [docs, docs.slice(0, 0)])]
    whole = run()
    monkeypatch.setattr(sparse, "CELLS", 16)
    monkeypatch.setattr(sparse, "BYTES", 20)
    assert run() == whole == [[0] * 4 + [1] * 4 + [2] * 4, [3, 10, 17, 24] * 2 + [0, 1, 2, 3], [3.0] * 4 + [1.0] * 4 + [-1.0] * 4]


def pairless(spark, monkeypatch):
    """Fails where all pairs of a query and a document are made."""

    def scores(*a, **k):
        raise AssertionError("a row for every query and document")

    monkeypatch.setattr(lexical, "scores", scores)


def test_search_makes_no_pairs(spark, monkeypatch):
    docs, asked = made(spark)
    t = lexical.indexed(docs, "id", "text")
    want = lexical.top(lexical.scores(asked, t, "okapi"), 5).where("score > 0").count()
    pairless(spark, monkeypatch)
    assert lexical.search(asked, t, 5, variant="okapi").count() == want


def test_blocks_make_no_row_for_each_posting(spark, monkeypatch):
    docs, asked = made(spark, n=100)
    t = lexical.indexed(docs, "id", "text")
    want = {(r["query"], r["doc"], r["rank"], r["score"]) for r in lexical.top(lexical.scores(asked, t), 3).select("query", "doc", "rank", "score").collect()}

    def postings(*a, **k):
        raise AssertionError("a row for each posting")

    monkeypatch.setattr(lexical, "postings", postings)
    monkeypatch.setattr(sparse, "BYTES", 300)  # blocks in several parts
    index = lexical.Blocks.build(t, 4)
    assert {(r["query"], r["doc"], r["rank"], r["score"]) for r in index.top(asked, 3).collect()} == want and len(want) > 50
    rows = index.blocks.collect()
    assert len({r["block"] for r in rows}) == len(rows) < 100 and sorted(d for r in rows for d in r["docs"]) == list(range(100))


@pytest.mark.parametrize("name", ["rrf_hybrid", "variant_fusion", "context_pack", "hybrid_vector", "retrieve_batch"])
def test_queries_make_no_pairs(spark, monkeypatch, name):
    pairless(spark, monkeypatch)
    assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_only_texts_of_hits_are_hashed(spark):
    texts = spark.createDataFrame([(i, f"t {i % 3}") for i in range(50)], "doc long, text string")
    hits = spark.createDataFrame([(1, 3, 1, 0.9), (1, 6, 2, 0.8), (1, 4, 3, 0.1)], "query long, doc long, rank int, score double")
    got = fusion.distinct_texts(hits, texts.select("doc", "text"))
    assert [(r["doc"], r["rank"]) for r in got.orderBy("rank").collect()] == [(3, 1), (4, 2)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.index("sha2") < plan.index("LeftSemi")  # the hash stands above the semi join


def test_digests_of_texts_hold_what_departments_look_for(spark):
    kb = routing.KnowledgeBase(routing.DEPARTMENTS)
    texts = ["İzin talebi, DAVA açma", "izinsiz yol onarımları yolu", None, "", "ağaç budama ağaç\nbudama park", "x " * 50 + "yıllık izin", "mahkeme kararı idari dava icra dava dava"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").withColumns({"low": routing._low(F.col("t")), "words": routing.routing_tokens(F.col("t")), "d": kb.digested(F.col("t"))})
    every = sorted({p for d in kb.departments for p in d.keywords + d.topics + d.responsibilities + d.rules + d.excluded})
    for whole, digest in df.select(*(F.array(*(routing.phrase(p, F.col(a), F.col(b)) for p in every)) for a, b in (("low", "words"), ("d.low", "d.words")))).collect():
        assert whole == digest
    hits = F.filter("words", lambda w: w.isin(*kb.vocabulary))
    for r in df.select(hits.alias("a"), F.filter("d.words", lambda w: w.isin(*kb.vocabulary)).alias("b"), F.size(F.array_distinct("words")).alias("n"), "d.different").collect():
        assert r["a"] == r["b"] and r["n"] == r["different"]
