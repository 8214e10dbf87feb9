import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import metrics


def test_hits(spark):
    q = spark.createDataFrame([(1,), (2,)], "query long")
    rel = spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "query long, rank int")
    assert tuple(metrics.hit_metrics(q, rel).first()) == (2, 0.4167, 0.0, 0.5, 1.0)
    times = spark.createDataFrame([(1, 10.0), (2, 30.0)], "query long, ms double")
    assert metrics.system_benchmark(q, rel, times).first().asDict() == {"n_queries": 2, "mrr": 0.4167, "hit_at_1": 0.0, "hit_at_3": 1.0, "hit_at_5": 1.0, "mean": 20.0, "p50": 20.0, "p95": 29.0, "p99": 29.8, "qps": 50.0}
    assert metrics.failures(spark.createDataFrame([(1,), (9,)], "query long"), rel).first()["query"] == 9
    hits = spark.createDataFrame([(1, 7, 1, "213", "5", "f"), (2, 8, 1, "1", "4", "g"), (3, 9, 1, "1", "12", "h")], "query long, doc long, rank int, law_number string, article_no string, source_file string")
    want = spark.createDataFrame([(1, ["213"], ["5"], [], []), (2, [], [], [], ["g"]), (3, [], [], ["h#1"], [])], "query long, laws array<string>, articles array<string>, ids array<string>, files array<string>")
    assert sorted(r["query"] for r in metrics.relevance(hits, want).collect()) == [1, 2, 3]


def test_latency_by_place(spark):
    values = [random.Random(1).randint(1, 50) / 2 for _ in range(237)]
    got = metrics.latency_nearest(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()
    o = sorted(values)
    assert (got["n"], got["p50_ms"], got["p95_ms"], got["max_ms"]) == (237, o[round(0.5 * 236)], o[round(0.95 * 236)], o[-1])


def test_classes(spark):
    pairs = [("a", "a"), ("a", "b"), ("b", "b"), ("b", ""), ("c", "a"), ("a", "zz")]
    p, t = spark.createDataFrame(pairs, "true string, predicted string"), metrics.classes(spark, ("a", "b", "c", "d"))
    rep = {r["label"]: tuple(r)[1:] for r in metrics.class_report(p, t).collect()}
    assert rep == {"a": (0.5, 0.3333, 0.4, 3), "b": (0.5, 0.5, 0.5, 2), "c": (0.0, 0.0, 0.0, 1), "d": (0.0, 0.0, 0.0, 0)}
    assert tuple(metrics.summary(p, metrics.class_report(p, t)).first()) == (6, 0.3333, 0.3, 0.225, 0.3667)
    conf = {(r["true"], r["predicted"]): r["n"] for r in metrics.confusion(p, t).collect()}
    assert len(conf) == 16 and conf["c", "a"] == 1 and sum(conf.values()) == 4
    empty = metrics.evaluate(p.limit(0), t)
    assert tuple(empty["summary"].first()) == (0, 0.0, 0.0, 0.0, 0.0)


def test_split(spark):
    rows = [(i, "x" if i < 100 else "y" if i < 110 else None, i % 10 == 0) for i in range(120)]
    got = metrics.split(spark.createDataFrame(rows, "id long, label string, made_up boolean"), "label", "id", synthetic="made_up").collect()
    n = {k: sum(r["label"] == k[0] and r["split"] == k[1] for r in got) for k in (("x", "test"), ("x", "val"), ("x", "train"), ("y", "test"), ("y", "train"))}
    assert len(got) == 110 and n == {("x", "test"): round(90 * 0.15), ("x", "val"): round(90 * 0.15), ("x", "train"): 100 - 2 * round(90 * 0.15), ("y", "test"): 1, ("y", "train"): 8}
    assert all(r["split"] == "train" for r in got if r["made_up"])


def test_others(spark):
    t = metrics.classes(spark, ("a", "b", "c"))
    d = {r["label"]: tuple(r)[1:] for r in metrics.distribution(spark.createDataFrame([("a",)] * 3 + [("b",)], "l string"), "l", t, few=2).collect()}
    assert d == {"a": (3, 0.75, False, False), "b": (1, 0.25, True, False), "c": (0, 0.0, False, True)}
    rows = spark.createDataFrame([(["x", "y"], 1), (["x"], 0)], "tags array<string>, ok int")
    got = {r["tag"]: (r["n"], r["accuracy"]) for r in metrics.by_tag(rows, "tags", F.col("ok") == 1, spark.createDataFrame([("x",), ("y",), ("z",)], "tag string")).collect()}
    assert got == {"x": (2, 0.5), "y": (1, 1.0), "z": (0, None)}
    v = spark.createDataFrame([("m1",), ("m2",)], "variant string")
    p = spark.createDataFrame([("m1", "a", "a", None), ("m1", "b", "a", None), ("m1", "a", None, "boom")], "variant string, true string, predicted string, error string")
    got = {r["variant"]: tuple(r)[1:] for r in metrics.ablation(v, p, t).collect()}
    assert got["m1"] == (3, 1, 0.5, pytest.approx(0.3334, abs=1e-3)) and got["m2"][:2] == (0, 0)
    bench = spark.createDataFrame([(True, True, True, 1.0, 1.0, 2.0, 3.0), (False, True, False, 0.0, 3.0, 2.0, 5.0)], "answerable boolean, grounded boolean, expected_found boolean, citation_precision double, retrieval_ms double, generation_ms double, total_ms double")
    assert tuple(metrics.answer_benchmark(bench).first()) == (1.0, 1.0, 1.0, 2.0, 2.0, 4.0)
    route = spark.createDataFrame([("a", ["a", "b"], False, False, False, False, "HIGH", "x", "x"), ("b", ["a", "b"], True, False, True, True, "LOW", "x", "y")], "expected string, ranked array<string>, conflict boolean, expect_conflict boolean, ambiguous boolean, expect_ambiguous boolean, confidence string, authority string, expect_authority string")
    assert tuple(metrics.routing_benchmark(route).first()) == (0.5, 1.0, 0.75, 0.5, 0.5, 1.0, 1.0)
    chunks = spark.createDataFrame([(1, "213", "5", "Başlık")], "chunk_id long, law_number string, article_no string, title string")
    assert metrics.generated_questions(chunks).count() == 2
    found, none = metrics.evidence(spark.createDataFrame([(1, "213", "5"), (2, "9", "9")], "query long, law_number string, article_no string"), chunks)
    assert found.count() == 1 and none.first()["query"] == 2
    pred = metrics.predicted(spark.createDataFrame([(1,), (2,)], "doc_id long"), spark.createDataFrame([(1, "a")], "doc_id long, predicted string"))
    assert sorted(tuple(r) for r in pred.collect()) == [(1, "a"), (2, "")]
