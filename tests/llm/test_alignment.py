import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import alignment

PATHS = alignment.paths()
A, B = alignment.sides(*PATHS)


def brute(texts):
    """Per text what the two libraries give for the whole, token by token."""
    out, counts = [], Counter()
    for t in texts:
        ids_a = A.tok.encode(" " + t, add_special_tokens=False).ids if t else []
        ids_b = B.tok.encode(t) if t else []
        said = [b"".join(side.bytes[i] for i in ids) for side, ids in ((A, ids_a), (B, ids_b))]
        if not t or said != [(" " + t).encode()] * 2:
            out.append((0, 0, [], []))
            continue
        spans = []
        for side, ids in ((A, ids_a), (B, ids_b)):
            at, got = 0, []
            for i in ids:
                got.append((at, at + len(side.bytes[i]), i))
                at = got[-1][1]
            spans.append(got)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = [tuple([i for s, e, i in side if lo <= s and e <= hi] for side in spans) for lo, hi in zip([0, *cuts], cuts, strict=False)]
        links = [(i, j) for s, e, i in spans[0] for x, y, j in spans[1] if s < y and x < e]
        counts.update(links)
        out.append((len(ids_a), len(ids_b), groups, links))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    rows = []
    for n_a, n_b, groups, links in out:
        said = ";".join("|".join(",".join(map(str, ids)) for ids in g) for g in groups)
        rows.append((n_a, n_b, len(groups), len(links), hashlib.sha256(said.encode()).hexdigest() if groups else "", said, sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links)))
    return rows


BITS = ["the", "ing", " ", " ", "  ", " \n", "\n", "\n ", "\t", " the", " and", "'s", "don't", "1234", "!!", "...", "é", "é", "日本語", "　", " ", "  ", "<|endoftext|>", "<s>", "<unk>", "<0x41>", "👍🏽", "\x00", "\x1c", " ", "Ünïcödé", "한국", "\r\n", ";\r", "{\r", "​"]


def texts(n, seed, least=1, most=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(least, most))) for _ in range(n)]


CASES = [None, "", " ", "   ", "a", " a", "a ", "\na", "a▁b", "▁", "a\n b", "a  b", "a 　 b", "x" * 300, "the cat the cat"]


@pytest.mark.parametrize("section, hot", [(1 << 19, 1 << 19), (64, 40), (64, 0)])
def test_equals_whole_texts(spark, section, hot):
    rows = CASES + texts(60, 1) + texts(3, 2, 300, 400) + ["the cat sat on the mat. " * 200]
    rows += rows[3:20]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(rows)], "doc_id long, text string, n_best string, __key int").repartition(5)
    what = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "pairs", "times")
    got = alignment.link_scores(alignment.align(df, *PATHS, what=what, cached=100, section=section), *PATHS, hot=hot)
    assert got.columns == ["doc_id", "text", "n_best", "__key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "n_best_", "count_sum"]
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "n_best_", "count_sum"]
    got = {r["doc_id"]: tuple(r[k] for k in names) for r in got.collect()}
    assert len(got) == len(rows)
    for i, want in enumerate(brute(rows)):
        assert got[i] == want, rows[i]


def test_segments_are_exact():
    for t in texts(400, 7):
        for side, whole in ((A, A.tok.encode(" " + t, add_special_tokens=False).ids), (B, B.tok.encode(t))):
            parts = [p for s in alignment.sections(t.encode(), 50) for p in alignment.split(s)]
            assert b" ".join(parts) == t.encode()
            assert [i for ids in side.segments(parts) for i in ids] == whole, t


def test_ranks():
    rng = np.random.default_rng(3)
    ends = np.unique(rng.integers(1, 5000, 700))
    bits = alignment.marked(ends, 5000)
    assert (alignment.selected(bits) == ends - 1).all()
    at = np.arange(5001)
    assert (alignment.Ranks(bits)(at) == np.searchsorted(ends - 1, at)).all()


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.link_scores(alignment.align(df, *PATHS, keep=["doc_id"], what=("n_a", "pairs", "times")), *PATHS).collect() == []
