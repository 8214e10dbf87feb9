import math
import random
import re
from collections import Counter

import numpy as np

from lodestone.llm import rules

TEXTS = [None, "", " \n\t", "one", "a b", "a b c a b c", "x x x x x", "l1 a\nl1 a\n\n \nl2\nl1 a", "#*$ %&| <> é\u00a0ü", "w " * 60 + "\x0b", "\x0c".join("abc"), "a b c d a b c e " * 300]
TEXTS += [" ".join(f"w{i * j % 97}" for i in range(120)) for j in range(1, 6)]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    n, r = len(words), len(hit)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, r, n < 50 or 100 * r > 50 * n


def test_counts_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], None, None, 2)], "doc_id long, text string, lang string, source string, n_words int")
    got = rules.judge(df).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        assert tuple(r)[1:7] == brute(TEXTS[r["doc_id"]]), TEXTS[r["doc_id"]]
        assert not (r["kept"] and r["base_failed"])


def test_fences_adapt_to_the_group(spark):
    words = [f"word{i}" for i in range(80)]
    plain = [(i, " ".join(words[: 60 + i % 20]), "en", "plain") for i in range(100)]
    marked = [(100 + i, " ".join(w + "#" for w in words[: 60 + i % 20]), "en", "marked") for i in range(100)]
    odd = [(200, " ".join(w + "###" for w in words), "en", "plain"), (201, " ".join(w + "x" for w in words), "en", "marked"), (202, " ".join(w * 9 for w in words), "en", "plain"), (203, " ".join(words), "xx", None)]
    got = {r["doc_id"]: r["kept"] for r in rules.judge(spark.createDataFrame(plain + marked + odd, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(200)) and not got[200] and got[201] and not got[202] and got[203]


def test_sketch_is_near_the_quantile(spark):
    from pyspark.sql import functions as F

    df = spark.range(1, 1001).select(F.col("id").cast("double").alias("x"))
    worst = df.select(F.max(F.abs(rules.value(rules.bucket(F.col("x"))) / F.col("x") - 1))).first()[0]
    assert worst < 0.02


def bucket_of(x):
    return math.ceil(math.log(x) / rules.WIDTH) if x > 0 else None


def test_fences_are_those_of_exact_quantiles_and_differ_by_source(spark):
    rng = random.Random(6)
    rows = []
    for i in range(900):
        source = "abc"[i % 3]
        words = ["".join(rng.choice("aeiou") for _ in range(rng.randint(2, 5 + 3 * (i % 3)))) for _ in range(rng.randint(60, 90))]
        marks = rng.choice([0, 0, 0, 0, 0, 0, 0, 0, 0, 30]) if source == "a" else rng.randint(0, 20)
        rows.append((i, " ".join(words) + "#" * marks, "en", source))
    df = spark.createDataFrame(rows + [(1000, "short", "en", "a"), (1001, " ".join(rows[0][1].split()), "de", "a")], "doc_id long, text string, lang string, source string")
    counted = rules.measured(df)
    got = {(r["level"], r["__lang"], r["__source"]): r for r in rules.fences(counted).collect()}
    assert set(got) == {(2, "en", "a"), (2, "en", "b"), (2, "en", "c"), (1, "en", None), (0, None, None)}
    assert len({got[2, "en", s]["high_symbols"] for s in "abc"}) == 3 and len({got[2, "en", s]["low_word_length"] for s in "abc"}) == 3
    exact = [r.asDict() for r in counted.where(~rules.failed()).select("__source", *(c.alias(k) for k, c in rules.metrics().items())).collect()]
    for s in "abc":
        for k in rules.ABOVE:
            x = np.sort([r[k] for r in exact if r["__source"] == s][:300])
            assert got[2, "en", s]["n"] == 300
            q1, q3, top = (x[int(np.ceil(q * len(x))) - 1] for q in (0.25, 0.75, rules.UPPER))
            want = q3 + (rules.TIMES * (q3 - q1) if bucket_of(q1) != bucket_of(q3) else rules.FLAT * (top - q3))
            assert abs(got[2, "en", s][f"high_{k}"] - want) <= 0.03 * q3 + 0.09 * max(q3, top), (s, k)


def test_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    got = rules.judge(spark.createDataFrame([(1, long, "en", "s"), (2, long + " # #", "en", "s"), (3, "w " * 200_000, "en", "s")], "doc_id long, text string, lang string, source string")).collect()
    assert [tuple(r)[1:7] for r in sorted(got)] == [brute(long), brute(long + " # #"), brute("w " * 200_000)]


def test_empty(spark):
    assert rules.judge(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).collect() == []
