import math
from collections import Counter

from pyspark.sql import functions as F

from lodestone.llm import urls

CASES = [
    (None, "", ""), ("", "", ""), ("no scheme/en/", "", ""), ("http://A.COM/En/7", "a.com", "/En/7"), ("x://y://z/en?q#f", "y:", "//z/en"),
    ("http://h?q=/en/", "h", ""), ("http://h#/a", "h", ""), ("http://ÉX.com/\na?b", "Éx.com".replace("x", "x"), "/\na"), ("://", "", ""), ("http://u/" + "p" * 20000, "u", "/" + "p" * 20000),
]


def test_host_and_path(spark):
    df = spark.createDataFrame([(c[0],) for c in CASES], "url string")
    got = df.select(*urls.host_and_path(F.col("url"))).collect()
    assert [tuple(r) for r in got] == [c[1:] for c in CASES]


def test_longest_rule_wins(spark):
    rows = [("example.com", "/en/7", "example.com/en/7", "allow"), ("a.example.com", "/en/70", "example.com/en/7", "allow"), ("example.com", "/en/8", "com/en/", "block"), ("xexample.com", "/en/7", "com/en/", "block"),
            ("com", "/en/", "com/en/", "block"), ("xcom", "/en/", None, None), ("b.net", "/de/8", "net/de/", "allow"), ("example.net", "/de/8", "example.net/de/8", "block"), ("o.org", "/es", None, None), ("", "", None, None)]
    df = spark.createDataFrame([r[:2] for r in rows], "host string, path string")
    assert [tuple(r) for r in df.select(*urls.rule_of(F.col("host"), F.col("path"))).collect()] == [r[2:] for r in rows]


def brute_model(accepted, rejected, order, text):
    def counted(texts):
        c = Counter()
        for t in texts:
            t = "\x02" * order + t
            for i in range(order, len(t)):
                for k in range(order + 1):
                    c[t[i - k : i + 1]] += 1
                    c[("context", t[i - k : i])] += 1
        return c

    def p(c, gram):
        low = 1 / 256 if len(gram) == 1 else p(c, gram[1:])
        return (c[gram] + low) / (c[("context", gram[:-1])] + 1)

    a, r = counted(accepted), counted(rejected)
    t = "\x02" * order + text
    llrs = [math.log(p(a, t[i - order : i + 1]) / p(r, t[i - order : i + 1])) for i in range(order, len(t))]
    return sum(llrs) / len(llrs)


def test_model_equals_brute_force(spark):
    import zlib

    rows = [(i, f"http://{'good' if i % 2 else 'bad'}.{'net' if i % 2 else 'org'}/{'de' if i % 2 else 'es'}/{i}", 0) for i in range(60)]
    rows += [(100, "http://goodish.xyz/q", 0), (101, "http://bad.org/x/es/1", 0), (102, None, 0), (103, "", 0), (104, "日本\U0001f600x", 0), (104, "日本\U0001f600x", 0)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, score int"), order=2).collect()
    assert len(got) == len(rows)
    learn = [u for i, u, _ in rows[:60] if zlib.crc32(u.encode()) % 5]
    for r in got:
        u = next(u for i, u, _ in rows if i == r["page_id"])
        if u:
            assert abs(r["score"] - brute_model([x for x in learn if "good" in x], [x for x in learn if "bad" in x], 2, u)) < 1e-4
    verdict = {r["page_id"]: r["verdict"] for r in got}
    assert verdict[100] == "allow" and verdict[101] == "block" and verdict[102] == verdict[103] == "allow"


def test_nothing_to_learn_from(spark):
    schema = "page_id long, url string"
    assert urls.judge(spark.createDataFrame([], schema)).collect() == []
    assert [r["verdict"] for r in urls.judge(spark.createDataFrame([(1, "http://x/")], schema)).collect()] == ["allow"]


def test_same_result_joined_and_sent_and_long_urls(spark):
    rows = [(i, f"http://{'good' if i % 2 else 'bad'}.{'net' if i % 2 else 'org'}/{'de' if i % 2 else 'es'}/{i}") for i in range(60)]
    rows += [(200, "http://good.xyz/" + "de/" * 40_000), (201, "http://good.xyz/" + "de/" * 40_000), (202, None)]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS n", "2 AS held", "3 AS __key", "4 AS score")
    sent, joined = (sorted(tuple(r) for r in urls.judge(df, small=small).collect()) for small in (urls.SMALL, 0))
    assert sent == joined and len(sent) == len(rows)
    last = {r[0]: r for r in sent}
    assert last[200][1:] == last[201][1:] and last[200][4] == "allow"
