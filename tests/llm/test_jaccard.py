import random
import re
from itertools import combinations

import pyarrow as pa
import pytest

from lodestone.llm import jaccard


def brute(rows, width, num, den):
    sets, ids = [], [i for i, _ in rows]
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        inter = len(sets[a] & sets[b])
        if sets[a] and sets[b] and den * inter >= num * len(sets[a] | sets[b]):
            x, y = sorted((root(ids[a]), root(ids[b])))
            parent[y] = x
    return sorted((i, len(s), root(i)) for i, s in zip(ids, sets, strict=True))


def corpus(seed, n=250):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocab) for _ in range(25)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE"), (5, "a b c"), (6, "A b\tc"), (7, "a b c d"), (8, "É é"), (9, "é é")]
    base = [rng.choice(vocab) for _ in range(60)]
    while len(rows) < n:
        kind = rng.random()
        if kind < 0.3 and len(rows) > 12:  # near copy of an earlier one, or a chain of them
            w = (rng.choice(rows[10:])[1]).split(" ")
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
        elif kind < 0.6:  # near copies of one text
            w = base[:]
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
        elif kind < 0.8:  # a passage that many share
            w = [rng.choice(vocab) for _ in range(rng.randint(0, 40))] + passage
        else:
            w = [rng.choice(vocab) for _ in range(rng.randint(1, 120))]
        rows.append((len(rows), " ".join(w)))
    ids = list(range(n))
    rng.shuffle(ids)
    return [(ids[i], t) for i, t in rows]


@pytest.mark.parametrize(("seed", "width", "num", "den"), [(1, 4, 85, 100), (2, 5, 80, 100)])
def test_equals_brute_force(spark, seed, width, num, den, monkeypatch):
    rows = corpus(seed)
    monkeypatch.setattr(jaccard, "QUERIES", 20)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, node string")
    want = brute(rows, width, num, den)
    for sent in (1.0, 0.3):
        assert sorted(map(tuple, jaccard.cluster(df, width, num, den, sent=sent).collect())) == want


def test_repeated_ids_and_rows(spark):
    long = " ".join(f"x{k}" for k in range(50))
    df = spark.createDataFrame([(5, long), (5, long), (9, long + " y"), (9, "other words entirely here"), (7, "other words entirely here"), (8, "z " * 300_000)], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.cluster(df, 4, 85, 100).collect())) == sorted([(5, 47, 5), (5, 47, 5), (9, 48, 5), (9, 1, 5), (7, 1, 5), (8, 1, 8)])


def test_empty(spark):
    assert jaccard.cluster(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("task", [5, 1000])
def test_components(spark, task, monkeypatch):
    monkeypatch.setattr(jaccard, "TASK_EDGES", task)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (102, 101), (200, 200)]
    got = {r["node"]: r["component"] for r in jaccard.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}


def test_sets_are_whole():
    sets = list(jaccard.token_sets(pa.array(["a b c d e", "b c d e", None, "a  b\nC d", "abcd"]), 4))
    assert [len(s) for s in sets] == [2, 1, 0, 1, 1] and sets[3][0] in sets[0] and sets[1][0] in sets[0]
