"""URL filters: host and path rules, and beyond them the ratio of two character language models.

The URLs that a rule decides teach two variable-order Markov models, one of accepted and one of rejected URLs: the
chance of a character after up to `order` characters of context is smoothed with the chance after one character less, down to
the uniform one. A URL's score is the difference of the models' log-likelihoods divided by its length; the
calibration compares it with a threshold between the scores of the accepted and the rejected URLs of a fold kept out of training.

Everything is counted and joined natively: windows of order + 1 characters are counted with map-side combination, and each
order's table has one row for each distinct window, so a host with a third of all rows adds counts, not rows. Distinct URLs are
written once, in as many parts as the session shuffles, and go beside their windows as a key of 128 bits. The table of windows, which
grows with the alphabet rather than the corpus, is sent to all tasks where its counted rows are at most `small`, so that a URL's
windows are scored in the task that made them; a larger one is joined by window, where the session's skew join splits "http:" and the like.

A very long URL is judged whole, at a cost in proportion to its length. URLs of equal score get equal verdicts; one at the threshold is allowed.
An empty table gives an empty result.

A null URL, or one without "://", has an empty host and path and fits no rule; the method judges its characters as they are.
URLs without any character are allowed, as is every URL where the rules decided none, or only one way, since nothing speaks
against them. Repeated rows are counted and returned as often as they come; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import stage

#: Fixed values of the contract: host, path, verdict.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
ORDER = 4
SMALL = 1 << 19  # rows of the windows' table, of some 100 bytes each in memory, up to which it is broadcast
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_EDGE = "\x02"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty without "://"."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host + path, and its verdict; nulls if none does. For rule lists of up to a few hundred."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def windows(url: Column, order: int) -> Column:
    """Every character with the `order` before it, as strings of order + 1 characters; edges are padded."""
    chars = F.split(F.concat(F.lit(_EDGE * order), F.coalesce(url, F.lit(""))), "")
    length = F.length(F.coalesce(url, F.lit("")))
    places = F.when(length > 0, F.sequence(F.lit(1), length)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.arrays_zip(places, *[F.slice(chars, k + 1, length).alias(f"c{k}") for k in range(order + 1)]), lambda z: F.concat(*(z[f"c{k}"] for k in range(order + 1))))


def model(counts: DataFrame, order: int = ORDER, strength: float = 1.0, alphabet: int = 256) -> DataFrame:
    """From counts (window, a, r: how often accepted and rejected URLs have it; 0 counts too) the table window, llr."""
    lower = None
    for k in range(order + 1):
        grams = counts.groupBy(F.right("window", F.lit(k + 1)).alias("gram")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        contexts = grams.groupBy(F.expr("left(gram, char_length(gram) - 1)").alias("context")).agg(F.sum("a").alias("ca"), F.sum("r").alias("cr"))
        table = grams.withColumn("context", F.expr("left(gram, char_length(gram) - 1)")).join(contexts, "context")
        if lower is None:
            table = table.withColumns({"pa0": F.lit(1 / alphabet), "pr0": F.lit(1 / alphabet)})
        else:
            table = table.withColumn("shorter", F.right("gram", F.lit(k))).join(lower, "shorter")
        p = lambda n, c, p0: (F.col(n) + strength * F.col(p0)) / (F.col(c) + strength)
        table = table.select("gram", p("a", "ca", "pa0").alias("pa"), p("r", "cr", "pr0").alias("pr"))
        lower = table.select(F.col("gram").alias("shorter"), F.col("pa").alias("pa0"), F.col("pr").alias("pr0"))
    return table.select(F.col("gram").alias("window"), F.round(F.log(F.col("pa") / F.col("pr")), 9).alias("llr"))


def key_of(url: Column) -> Column:
    """128 bits that stand for a URL."""
    return F.struct(F.xxhash64(F.lit(1), url).alias("a"), F.xxhash64(F.lit(2), url).alias("b"))


def judge(pages: DataFrame, rules=RULES, order: int = ORDER, id: str = "page_id", url: str = "url", small: int = SMALL) -> DataFrame:
    """id, host, path, rule, verdict, score (null for URLs without characters)."""
    host, path = host_and_path(F.col("__url"))
    base = pages.select(F.col(id).alias("__id"), F.col(url).cast("string").alias("__url")).withColumns({"host": host, "path": path})
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "ruled": ruled, "__key": key_of(F.col("__url"))})
    # a URL stands for all rows that have it
    held = F.crc32(F.coalesce("__url", F.lit("")).cast("binary")) % 5 == 0
    urls = base.groupBy("__url", "__key", "ruled").agg(F.count("*").alias("n")).withColumn("held", held)
    # spread before the windows multiply the rows
    urls = stage(urls.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "urls")
    grams = urls.select("__key", "ruled", "held", "n", F.explode(windows(F.col("__url"), order)).alias("window"))
    learn = ~F.col("held")
    counts = grams.groupBy("window").agg(
        F.sum(F.when(learn & (F.col("ruled") == "allow"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(learn & (F.col("ruled") == "block"), F.col("n")).otherwise(0)).alias("r")
    )
    table = stage(model(stage(counts, "url-windows"), order), "url-model")
    table = table.hint("broadcast" if table.count() <= small else "merge")
    scores = grams.join(table, "window").groupBy("__key", "ruled", "held", "n").agg(F.round(F.avg("llr"), 6).alias("score"))
    scores = stage(scores, "url-scores")
    fold = scores.where("held AND ruled IS NOT NULL")
    if fold.isEmpty():
        fold = scores.where("ruled IS NOT NULL")
    by = {r["ruled"]: r for r in fold.groupBy("ruled").agg(F.avg("score").alias("mean"), F.coalesce(F.stddev_pop("score"), F.lit(0.0)).alias("dev")).collect()}
    if {"allow", "block"} <= by.keys():  # as many deviations from the one mean as from the other
        a, b = by["allow"], by["block"]
        spread = a["dev"] + b["dev"]
        threshold = (a["mean"] * b["dev"] + b["mean"] * a["dev"]) / spread if spread else (a["mean"] + b["mean"]) / 2
    else:
        threshold = -math.inf
    scored = scores.select(F.col("__key").alias("__scored"), "score")
    out = base.join(scored, F.col("__key") == F.col("__scored"), "left")
    verdict = F.coalesce("ruled", F.when(F.col("score") < threshold, "block").otherwise("allow"))
    return out.select(F.col("__id").alias(id), "host", "path", "rule", verdict.alias("verdict"), "score")


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
