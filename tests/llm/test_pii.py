import hashlib
import re

from lodestone.llm import pii

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d)))
        return 12 <= len(d) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def brute(text):
    out = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(KINDS.items()) for m in re.finditer(p, text or "", re.ASCII) if good(kind, m[0])]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out)]


TEXTS = [
    None, "", "nothing", "a@b.c", "a@b.c_x@d.e", "x@y.com.z+foo@bar.com", "..a@b@c.d.e-f.", "a@b", "éa@b.cé 😀 z@y.x",
    "1.2.3.4.5.6.7.8", "256.1.1.1 1.256.1.1 0000255.1.1.1 255.255.255.255", "1.2.3", "v1.2.3.4x",
    "4111 1111 1111 1111", "4111-1111--1111 1111", "4111111111111112", "4111111111111111 4111111111111111", "0 0 0 0 0 0 0 0 0 0 0 0",
    "+1 (375) 555-4393", "+1+1 (375) 555-4393.", "+1 2", "+1 (((((", "+123456789012345678", "call +44 20 7946 0958 or +1.", "+4111 1111 1111 1111",
    "1 " * 5000, "a" * 20000, "a." * 5000, "1" * 20000, "+1 " * 3000, "x@" * 3000, ("mail me@here.org, 4111111111111111, 10.0.0.1, +1 (555) 555-1234; " * 200),
]


def test_base_spans_equal_brute_force(spark):
    rows = [(i, t, 0) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    got = pii.detect(df, None).select("doc_id", pii.listed(pii.F.col("pii_base")).alias("b"), pii.listed(pii.F.col("pii_spans")).alias("s")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["b"] == r["s"] == ",".join(brute(TEXTS[r["doc_id"]])), TEXTS[r["doc_id"]][:80]


def corpus(n=300):
    rows = []
    for i in range(n):
        extra = ["+1 (%03d) 555-%04d" % (200 + i, i), "m%d@mail.org" % i, "10.0.%d.%d" % (i % 250, i % 240), "year 2001 1999 12 40", "no 77 12 34 56 78 90 12 34 56 78 90 11", "x 123456789 y"][i % 6]
        rows.append((i, f"some words here {extra} and more words {i}"))
    return rows


def test_trees_add_what_the_patterns_leave_out(spark):
    rows = corpus() + [(1000, "ring (212) 555-0123 now"), (1001, "write to jane.doe [at] mail.org please"), (1002, "digits 1234567 end"), (1003, "clean words only")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    trees = pii.fit(df)
    got = {r["doc_id"]: r["s"] for r in pii.detect(df, trees).select("doc_id", pii.listed(pii.F.col("pii_spans")).alias("s")).collect()}
    assert got[1000] == "phone:5:19" and got[1002] == "" and got[1003] == ""
    assert all(set(brute(t)) <= set(filter(None, got[i].split(","))) for i, t in rows)


def test_parts_of_dropped_matches_and_spans_beside_base_ones(spark):
    cards = ["4111 1111 1111 1111", "5500005555555559", "4012888888881881", "378282246310005"]
    rows = corpus() + [(400 + i, f"paid by {cards[i % 4]} then") for i in range(60)] + [(500 + i, f"code {10**15 + 7 * i} and {10**11 + i} here") for i in range(60)]
    more = {
        2000: ("ids 4111111111111111 4012888888881881 end", "card:4:20,card:21:37"),
        2001: ("ids 2353820953013748 4111111111111111 end", "card:21:37"),
        2002: ("at +1 (826) 555-4081 190.137.223.204 end", "phone:3:20,ip:21:36"),
        2003: ("at 300.10.20.30.40 end", "ip:7:18"),
        2004: ("or jane.doe [at] mail.org end", "email:3:25"),
    }
    df = spark.createDataFrame(rows + [(i, t) for i, (t, _) in more.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in pii.detect(df, pii.fit(df)).select("doc_id", pii.listed(pii.F.col("pii_spans")).alias("s")).where("doc_id >= 2000").collect()}
    assert got == {i: want for i, (_, want) in more.items()}


def test_expression_equals_the_trees(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    trees = pii.fit(df)
    flat = df.select(pii.F.explode(pii.base_spans(pii.F.col("text"))).alias("x"))
    f = pii.features(pii.F.col("x"))
    for r in flat.select(*(f[k].cast("int").alias(k) for k in pii.FEATURES), trees.expression(f).alias("v")).collect():
        assert abs(trees.value([r[k] for k in pii.FEATURES]) - r["v"]) < 1e-9


def test_redact(spark):
    df = spark.createDataFrame([(1, "é a@b.c, +4111 1111 1111 1111 end", "k"), (2, None, "k"), (3, "", None), (4, "plain", "k")], "doc_id long, text string, kind string")
    got = {r["doc_id"]: r["text"] for r in pii.redact(df, None).collect()}
    assert got == {1: "é [EMAIL], +[CARD] end", 2: None, 3: "", 4: "plain"}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.fit(df) is None and pii.detect(df, None).collect() == [] and hashlib.sha256(b"").hexdigest()
