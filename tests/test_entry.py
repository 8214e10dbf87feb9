from pathlib import Path

import __spark_entry__


def test_catalogue():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(oracles) >= 35 and callable(queries["bm25_topk"])


#: Queries without SQL, and the tests that hold them against something else.
TESTED = {
    "retrieve_batch": "test_search.py", "chunk_articles": "test_chunker.py", "reading_order": "test_dealing.py", "op2_substrings": "llm/test_substrings.py", "op3_urls": "llm/test_urls.py", "op4_quality": "llm/test_quality.py",
    "op5_matroska": "llm/test_matroska.py", "op6_pii": "llm/test_pii.py", "op7_rules": "llm/test_rules.py", "op9_bpe": "llm/test_bpe.py", "op10_mix": "llm/test_mixing.py", "op11_whitening": "llm/test_whitening.py",
    "op12_alignment": "llm/test_alignment.py", "op13_packing": "llm/test_packing.py", "pipeline": "llm/test_pipeline.py",
}


def test_each_query_has_sql_or_a_test():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    here = Path(__file__).parent
    assert queries.keys() - oracles.keys() <= TESTED.keys()
    assert all((here / TESTED[name]).exists() for name in queries.keys() - oracles.keys())
