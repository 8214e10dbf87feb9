import random
from collections import Counter, defaultdict
from statistics import median

import pytest
from pyspark.sql import functions as F

from lodestone.operators import dealing, lawgraph, layout, spatial


def rows_of(seed, n=200):
    """Keys of which one, and null, have many rows."""
    rng = random.Random(seed)
    return [(i, rng.choice(["hot", "hot", "hot", None, *"abcdefgh"]), rng.randint(0, 60), rng.choice([None, rng.randint(-9, 9)])) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, key string, at long, v long").repartition(7)


def test_met_is_a_join(spark):
    left, right = rows_of(1), rows_of(2, 30)
    a, b = frame(spark, left).select("id", "key"), frame(spark, right).select(F.col("id").alias("other"), "key")
    got = Counter((r["id"], r["other"]) for r in dealing.met(a, b, ["key"], rows=10).collect())
    assert got == Counter((x[0], y[0]) for x in left for y in right if x[1] is not None and x[1] == y[1])


@pytest.mark.parametrize("ranges", [1, 6, 40])
def test_ordered_passes_equal_one_list(spark, ranges):
    rows = rows_of(3)
    df = dealing.ranged(frame(spark, rows), ["key"], ["at", "id"], ranges)
    assert ranges == 1 or df.where("key = 'hot'").select("__range").distinct().count() > 1
    lists = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        lists[r[1]].append(r)
    want = {}
    for part in lists.values():
        run = None
        for k, r in enumerate(part):
            run = (run or 0) + (r[3] or 0)
            want[r[0]] = (part[k - 1][0] if k else None, part[k - 1][3] if k else None, part[k + 1][0] if k + 1 < len(part) else None, k + 1, len(part))
    got = dealing.shifted(df, ["key"], ["at", "id"], {"before": "id", "v_before": "v"})
    got = dealing.shifted(got, ["key"], ["at", "id"], {"after": "id"}, ahead=True).withColumn("one", F.lit(1).cast("long"))
    got = dealing.totals(dealing.accumulated(got, ["key"], ["at", "id"], {"nth": "one"}), ["key"], {"all": "one"})
    assert {r["id"]: (r["before"], r["v_before"], r["after"], r["nth"], r["all"]) for r in got.collect()} == want
    got = {r["key"]: r["median"] for r in dealing.medians(frame(spark, rows), ["key"], "v", ranges=ranges).collect()}
    assert got == {k: median([r[3] for r in part if r[3] is not None]) for k, part in lists.items() if any(r[3] is not None for r in part)}


@pytest.mark.parametrize("ranges", [1, 9])
def test_islands(spark, ranges):
    rows = rows_of(4)
    lists = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        lists[r[1]].append(r)
    want = {}
    for part in lists.values():
        gaps = [b[2] - a[2] for a, b in zip(part, part[1:], strict=False)]
        number = 0
        for k, r in enumerate(part):
            number += bool(k) and gaps[k - 1] > 2 * median(gaps)
            want[r[0]] = number
    got = dealing.islands(frame(spark, rows), ["key"], "at", "id", F.col("gap") > 2 * F.col("median_gap"), ranges=ranges)
    assert {r["id"]: r["island"] for r in got.collect()} == want
    assert dealing.islands(frame(spark, []), ["key"], "at", "id", F.col("gap") > 1).count() == 0


def test_neighbours_of_one_law_in_many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rng = random.Random(5)
    rows = [(i, rng.choice(["1", "1", "1", "2"]), str(rng.randint(1, 60)) if i % 4 else f"Ek {rng.randint(1, 9)}", "x") for i in range(150)]
    try:
        arts = lawgraph.articles(spark.createDataFrame(rows, "chunk_id long, law_number string, article_no string, text string"))
        got = {(r["src"], r["dst"]) for r in lawgraph.adjacent(arts).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = set()
    for law in "12":
        seen = {}
        for i, x, article, _ in rows:
            if x == law:
                seen.setdefault(article, i)
        order = sorted(seen, key=lambda a: (not a.isdigit(), int(a) if a.isdigit() else 0, seen[a]))
        want |= {(f"law:{law}|article:{a}", f"law:{law}|article:{b}") for a, b in zip(order, order[1:], strict=False)}
    assert got == want


BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def boxes(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y, size = rng.uniform(-50, 50), rng.uniform(-50, 50), rng.choice([0.0, 1e-6, 0.3, 4.0, 16.0, 120.0])
        if i % 5 == 0:
            x, y = float(round(x / 8) * 8), float(round(y / 8) * 8)
        out.append((i, rng.choice(["p", "p", "q", None]), (x, y, x + size * rng.choice([0, 0.5, 1]), y + size)))
    return [*out, (n, "p", (0.0, 0.0, 0.0, 0.0)), (n + 1, "p", None), (n + 2, "p", (1.0, float("nan"), 2.0, 3.0)), (n + 3, "p", (5.0, 5.0, 4.0, 6.0)), (n + 4, "p", (-1e9, -1e9, 1e9, 1e9)), (n + 5, "p", (float("-inf"), 0.0, 1.0, 1.0))]


def fine(b):
    return b is not None and all(abs(x) < 1e300 for x in b) and b[0] <= b[2] and b[1] <= b[3]


def apart(a, b):
    return a[2] < b[0] or b[2] < a[0] or a[3] < b[1] or b[3] < a[1]


@pytest.mark.parametrize("rows", [3, None])
def test_overlapping_equals_all_pairs(spark, rows):
    left, right = boxes(6, 90), boxes(7, 60)
    a = spark.createDataFrame(left, f"item long, page string, box {BOX}")
    b = spark.createDataFrame(right, f"block long, page string, around {BOX}").withColumn("top", F.col("around.y0"))
    want = [(x[0], y[0]) for x in left for y in right if x[1] is not None and x[1] == y[1] and fine(x[2]) and fine(y[2]) and not apart(x[2], y[2])]
    got = [(r["item"], r["block"]) for r in spatial.overlapping(a, b, ["page"], "box", "around", rows).collect()]
    assert sorted(got) == sorted(want) and len(want) > 100
    first = {r["item"]: r["block"] for r in spatial.first_overlap(a, b, ["page"], "item", "box", "block", "around", ["top"], rows).collect()}
    top = {y[0]: (y[2][1], y[0]) for y in right if fine(y[2])}
    assert first == {x[0]: min((top[k] for i, k in want if i == x[0]), default=(0, None))[1] for x in left}


def test_blocks_of_a_page(spark):
    its = spark.createDataFrame([(1, 0, (0.0, 0.0, 5.0, 5.0)), (1, 1, (50.0, 50.0, 60.0, 60.0)), (2, 0, (0.0, 0.0, 5.0, 5.0))], f"page long, item long, box {BOX}")
    lay = spark.createDataFrame([(1, 7, (4.0, 4.0, 9.0, 9.0)), (1, 8, (5.0, 1.0, 9.0, 9.0))], f"page long, block long, box {BOX}")
    assert sorted(tuple(r) for r in layout.blocks(its, lay).select("page", "item", F.coalesce("block", F.lit(-1))).collect()) == [(1, 0, 8), (1, 1, -1), (2, 0, -1)]


def page_of(rng, kind):
    """Items of a page: two columns with rows of full width, one column, or anything."""
    out = []
    for i in range(rng.randint(1, 40)):
        y = float(rng.randint(0, 40) * 9)
        if kind == "any":
            x = float(rng.randint(0, 300))
            out.append((x, y, x + rng.randint(5, 250), y + rng.randint(5, 30)))
        elif kind == "bare":
            out.append((0.0, 0.0, 0.0, 0.0))
        elif rng.random() < 0.1 or kind == "one":
            out.append((10.0, y, 490.0, y + 12))
        else:
            x = rng.choice([10.0, 300.0]) + rng.randint(0, 9)
            out.append((x, y, x + rng.randint(90, 170), y + 12))
    return out


def test_rows_in_reading_order_equal_the_bands_of_a_page(spark):
    rng = random.Random(8)
    pages = [page_of(rng, kind) for kind in ["two"] * 25 + ["one"] * 3 + ["any"] * 12 + ["bare"] * 2]
    df = spark.createDataFrame([(p, i, *b) for p, items in enumerate(pages) for i, b in enumerate(items)], "page long, item long, x0 double, y0 double, x1 double, y1 double")
    got = defaultdict(dict)
    for r in layout.ordered(df).collect():
        got[r["page"]].setdefault(r["band"], []).append((r["place"], r["item"]))
    many = 0
    for p, items in enumerate(pages):
        bands = layout.reading_order([{"i": i, **dict(zip(("x0", "y0", "x1", "y1"), b, strict=True))} for i, b in enumerate(items)])
        many += len(bands) > 2
        want = [i["i"] for band in bands for i in band]
        assert [i for k in sorted(got[p]) for _, i in sorted(got[p][k])] == want, (p, items)
        assert [len(got[p][k]) for k in sorted(got[p])] == [len(b) for b in bands if b]
    assert many > 10


def test_paragraph_rows(spark):
    rows = [(1, 0, "Title", 10.0, 0.0, 490.0, 12.0), (1, 1, "a", 10.0, 30.0, 60.0, 42.0), (1, 2, "b  c", 70.0, 31.0, 120.0, 43.0), (1, 3, "d", 10.0, 46.0, 60.0, 58.0), (1, 4, "(2) e", 10.0, 62.0, 60.0, 74.0), (1, 5, " ", 10.0, 80.0, 60.0, 92.0), (1, 6, "f", 10.0, 120.0, 60.0, 132.0), (2, 0, None, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "page long, item long, text string, x0 double, y0 double, x1 double, y1 double")
    got = [tuple(r) for r in layout.paragraph_rows(df).orderBy("page", "paragraph").collect()]
    assert got == [(1, 0, 1, "Title"), (1, 1, 2, "a b c\nd"), (1, 2, 1, "(2) e"), (1, 3, 1, "f")]


def test_overlap_equals_every_length():
    rng = random.Random(2)
    for _ in range(2000):
        a, b = ("".join(rng.choice("abİ日") for _ in range(rng.randint(0, 25))) for _ in range(2))
        b = a[rng.randint(0, 25) :] + b if rng.random() < 0.6 else b
        least = rng.choice([1, 3])
        assert layout.overlap(a, b, least) == max((n for n in range(least, min(len(a), len(b)) + 1) if a[-n:] == b[:n]), default=0)
    assert layout.overlap("x" * 200_000, "x" * 150_000 + "y") == 150_000
