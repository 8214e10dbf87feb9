import zlib

import numpy as np

from lodestone.llm import quality

ROWS = [(i, ("good calm words of text " * (1 + i % 4) + str(i)) if i % 3 else "BUY!! NOW!! BUY!! " * (1 + i % 5)) for i in range(400)]


def frames(spark, rows=ROWS):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS score")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in rows], "doc_id long, quality int")
    return docs, labels


def test_learns_and_scores_whole_texts(spark):
    docs, labels = frames(spark)
    assert quality.sample(docs, labels).count() == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, _ in ROWS)
    model = quality.fitted(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert all((got[i] >= 0.3) == (i % 3 > 0) for i, _ in ROWS)


def test_odd_rows(spark):
    docs, labels = frames(spark)
    model = quality.fitted(docs, labels)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "w " * 500_000), (3, "w " * 500_000), (None, " \n")], "doc_id long, text string")
    got = quality.score(odd, model).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got) and got[0]["score"] == got[1]["score"] and got[2]["score"] == got[3]["score"]
    assert quality.score(odd.limit(0), model).count() == 0
    none = quality.fitted(docs, labels.limit(0))
    assert {r["score"] >= 0.99 for r in quality.score(odd, none).collect()} == {True}


def test_chunks_do_not_matter():
    from lodestone.llm.shared import chunks, text_bytes
    import pyarrow as pa

    model = quality.train([t for _, t in ROWS], [int(i % 3 > 0) for i, _ in ROWS], buckets=1 << 12, epochs=2)
    data, offs = text_bytes(pa.array([t for _, t in ROWS]))
    whole = model.score(data, offs)
    parts = [model.score(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]) for a, b in chunks(offs, 100)]
    assert np.allclose(whole, np.concatenate(parts), atol=1e-6)
