from collections import defaultdict

from lodestone.llm import mixing


def test_targets_share_out_the_excess():
    sizes = {"b": 100, "a": 10, None: 40, "c": 0}
    got = mixing.targets(sizes)
    assert list(got) == ["a", "b", "c", None] and got["a"] == 20 and got["c"] == 0
    assert abs(sum(got.values()) - 225) < 1e-9 and all(got[s] <= 2 * sizes[s] for s in sizes)
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0}


def test_mix(spark):
    rows = [(i, " ".join(["w"] * (i % 37)) if i % 11 else None, f"s{i % 3}" if i % 7 else None, i) for i in range(3000)]
    rows += [(5, "same row twice", "s1", 0)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    taken, size, target = defaultdict(int), defaultdict(int), {}
    by_id = {r[0]: r[2] for r in rows if r[1] != "same row twice"}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        s = by_id[r["doc_id"]] if r["doc_id"] != 5 or r["size"] != 3 else "s1"
        taken[s] += r["taken"]
        size[s] += r["size"]
        target[s] = r["target"]
    assert target == mixing.targets(dict(size))
    for s, t in target.items():
        assert abs(taken[s] - t) < 0.02 * t + 100
    assert sorted(map(tuple, mixing.mix(df.repartition(7)).collect())) == sorted(map(tuple, got))


def test_empty(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], schema)).collect() == []
    assert [tuple(r)[:5] for r in mixing.mix(spark.createDataFrame([(1, None, None), (2, " ", "a")], schema)).orderBy("doc_id").collect()] == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_schedule_is_spread_evenly(spark):
    goals = {"a": 600.0, "b": 300.0, "c": 100.0}
    slots = [r["__s"] for r in mixing.schedule(spark, goals, goals, 1).orderBy("slot").collect()]
    for n in (50, 200, 1000):
        assert [abs(slots[:n].count(i) - n * g / 1000) < 4 for i, g in enumerate(goals.values())] == [True] * 3
