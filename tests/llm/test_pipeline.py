import random
from collections import Counter

import pytest

import corpus_pipeline as P
from lodestone.llm import bpe, mixing, pii
from test_jaccard import brute
from test_pii import brute as brute_pii


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(9)
    vocab = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(240):
        w = [rng.choice(vocab) for _ in range(rng.randint(20, 80))]
        if i % 5 == 0:
            w = [x.upper() + "!!" for x in w]
        elif i % 7 == 0 and i % 5 != 1 and i > 7:
            w = rows[i - 1][1].split(" ")
        elif i % 11 == 0:
            w.insert(3, f"me{i}@mail.org")
        rows.append((i, " ".join(w), "en", f"s{i % 4}", 0))
    rows += [(300, None, None, None, None), (301, "", "en", "s1", 0), (1, rows[1][1], "en", "s1", 0), (None, "some plain words", "en", "s2", 3)]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality classifier", "n-gram jaccard join", "pii", "mixing sources", "bpe"]
    good = P.quality_classifier(spark, docs, tables)
    assert good.columns == docs.columns
    kept = {r["doc_id"] for r in good.collect()}
    assert kept & {*range(240)} == {i for i in range(240) if i % 5}
    one = P.near_duplicates(spark, docs, tables)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None]
    firsts = {c for _, _, c in brute(rows, 5, 80, 100)}
    got = [r["doc_id"] for r in one.collect()]
    assert one.columns == docs.columns and Counter(got) == Counter([*firsts, None])
    clean = P.personal_data(spark, docs, tables)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    for r in clean.collect():
        assert not brute_pii(r["text"]) and (r["text"] is None or r["n_chars"] == len(r["text"]))
    mixed = P.mix_sources(spark, docs, tables)
    assert mixed.columns == docs.columns
    times = Counter(r["doc_id"] for r in mixed.collect())
    plan = mixing.mix(docs).collect()
    for i in {r["doc_id"] for r in plan}:
        of = [r for r in plan if r["doc_id"] == i]
        size, taken = sum(r["size"] for r in of), sum(r["taken"] for r in of)
        assert abs(times[i] - (len(of) * taken / size if size else 0)) <= len(of) * 0.5 + 1e-9
    tok = bpe.load(bpe.tokenizer_path())
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in P.tokens(spark, docs, tables).collect():
        assert r["ids"] == tok.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])


def test_run(spark, tables):
    got = P.run(spark, tables).collect()
    assert got and {r["doc_id"] for r in got} <= {*range(240), None} and all(r["decoded"] for r in got)


def test_empty_tables(spark, tables, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{tables}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []


def test_clashing_columns_and_empty_table(spark, tables):
    names = ("__score", "__first", "__n", "__base", "__every", "__h", "__h2", "__id", "__times", "__copy", "__text", "score", "id", "label", "ids")
    docs = spark.read.parquet(f"{tables}/documents.parquet").where("doc_id < 40 OR doc_id >= 300 OR doc_id IS NULL")
    docs = docs.selectExpr("*", *(f"'{c}' AS {c}" for c in names))
    for some in (docs, docs.where("doc_id < 0")):
        for _, function in P.STAGES[:-1]:
            got = function(spark, some, tables)
            assert got.columns == docs.columns
            rows = got.collect()
            assert all(r[c] == c for r in rows for c in names) and bool(rows) == (some is docs)
        out = P.STAGES[-1][1](spark, some, tables)
        assert out.count() == some.count()


def test_run_equals_its_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, function in P.STAGES:
        docs = function(spark, docs, tables)
    assert Counter(map(str, docs.collect())) == Counter(map(str, P.run(spark, tables).collect()))
