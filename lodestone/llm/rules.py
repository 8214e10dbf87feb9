"""Quality rules with adaptive thresholds.

Each text's counts are made natively in one pass and written once. Its ratios (symbols a word, repeated lines, repeated words, word
length) go, where the base rule holds, into quantile sketches for each language and source: logarithmic buckets of 2 % relative width and their
counts, which merge by addition and do not depend on the order of merging. A group of fewer than `least` such documents uses its
language's merged sketch, and below that everyone's. Fences come from the sketches' quantiles alone and replace fixed cutoffs: TIMES quartile ranges
beyond the middle half, or, where that range is zero, FLAT times the distance from there to the quantile UPPER (below: 1 - UPPER). They are joined to the documents, and what lies beyond one is not kept.

Null texts count as empty, without words, and fail the base rule. Null languages and sources are groups of their own. Ties cannot
matter, as a verdict depends on the text and the fences only; repeated rows count and are returned as often as they come. Texts are counted
whole, however long. Extra columns are ignored; without documents there are no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import documents, stage

WIDTH = math.log(1.02)
#: Quartile ranges beyond the middle half; where that range is zero, so many times the distance to a quantile far out.
TIMES, UPPER, FLAT = 4.0, 0.99, 2.0
#: Metrics with fences above, and below too.
ABOVE, BELOW = ("symbols", "dup_lines", "repeats", "word_length"), ("word_length",)
LEAST = 30


def counts(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of a text, from the columns __words, __lines and __grams."""
    n = F.size("__words")
    ordered = F.sort_array(F.transform(F.col("__grams"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twins = F.zip_with(F.slice(ordered, 1, F.size("__grams") - 1), F.slice(ordered, 2, F.size("__grams") - 1), lambda a, b: F.when(a["h"] == b["h"], F.struct(a["i"].alias("a"), b["i"].alias("b"))))
    places = F.flatten(F.transform(F.array_compact(twins), lambda p: F.array(p["a"], p["a"] + 1, p["a"] + 2, p["b"], p["b"] + 1, p["b"] + 2)))
    return {
        "n_words": n,
        "word_chars": F.length(F.array_join("__words", "")),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")),
        "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
        "n_repeat_words": F.when(F.size(F.array_distinct("__grams")) == F.size("__grams"), 0).otherwise(F.size(F.array_distinct(places))),
        "n_lines": F.size("__lines"),
    }


def measured(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row for each document: id, lang, source and the counts as longs."""
    blank = r"[\x20\x09-\x0D]+"
    base = docs.select(F.col(id).alias("__id"), F.col(lang).alias("__lang"), F.col(source).alias("__source"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    base = base.withColumn("__words", F.array_remove(F.split("__text", blank, -1), ""))
    base = base.withColumn("__lines", F.filter(F.split("__text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size("__words")
    trios = F.arrays_zip(*(F.slice("__words", k, F.greatest(n - 2, F.lit(0))).alias(f"w{k}") for k in (1, 2, 3)))
    base = base.withColumn("__grams", F.transform(trios, lambda z: F.xxhash64(z["w1"], z["w2"], z["w3"])))
    return base.select("__id", "__lang", "__source", *(c.cast("long").alias(k) for k, c in counts(F.col("__text")).items()))


def metrics() -> dict[str, Column]:
    share = lambda n, of: F.when(F.col(of) > 0, F.col(n) / F.col(of)).otherwise(0.0)
    return {"symbols": share("n_symbols", "n_words"), "dup_lines": share("n_dup_lines", "n_lines"), "repeats": share("n_repeat_words", "n_words"), "word_length": share("word_chars", "n_words")}


def bucket(x: Column) -> Column:
    """The sketch's bucket of a number that is not negative; zero has its own."""
    return F.when(x > 0, F.ceil(F.log(x) / WIDTH).cast("int")).otherwise(-(1 << 30))


def value(b: Column, edge: float = 0.0) -> Column:
    """A bucket's lower (-1), middle (0) or upper (1) number."""
    return F.when(b > -(1 << 30), F.exp((b - 0.5 + edge / 2) * WIDTH)).otherwise(0.0)


def failed() -> Column:
    """The base rule's verdict."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fences(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """level (2: language and source, 1: language, 0: all), __lang, __source, n, and low_* and high_* of each metric."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), bucket(c).alias("bucket")) for k, c in metrics().items()))).alias("m")
    sketch = rows.where(~failed()).select("__lang", "__source", each).groupBy("__lang", "__source", "m.metric", "m.bucket").agg(F.count("*").alias("n"))
    level = lambda k, lang, source: sketch.select(F.lit(k).alias("level"), lang.alias("__lang"), source.alias("__source"), "metric", "bucket", "n")
    none = F.lit(None).cast("string")
    levels = level(2, F.col("__lang"), F.col("__source")).unionByName(level(1, F.col("__lang"), none)).unionByName(level(0, none, none))
    merged = levels.groupBy("level", "__lang", "__source", "metric", "bucket").agg(F.sum("n").alias("n"))
    key = ["level", "__lang", "__source", "metric"]
    w = Window.partitionBy(*key).orderBy("bucket")  # a sketch has as many rows as buckets: some hundreds
    run = merged.withColumns({"upto": F.sum("n").over(w), "all": F.sum("n").over(Window.partitionBy(*key))})
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.struct("bucket")))["bucket"]
    quantiles = run.groupBy(*key).agg(*(at(q).alias(k) for k, q in (("q1", 0.25), ("q3", 0.75), ("top", UPPER), ("bottom", 1 - UPPER))), F.max("all").alias("n"))
    spread = value(F.col("q3")) - value(F.col("q1"))
    flat = F.col("q1") == F.col("q3")
    high = F.when(flat, value(F.col("q3"), 1) + FLAT * (value(F.col("top")) - value(F.col("q3")))).otherwise(value(F.col("q3")) + TIMES * spread)
    low = F.when(flat, value(F.col("q1"), -1) - FLAT * (value(F.col("q1")) - value(F.col("bottom")))).otherwise(value(F.col("q1")) - TIMES * spread)
    of = lambda k, c: F.max(F.when(F.col("metric") == k, c))
    aggs = [of(k, high).alias(f"high_{k}") for k in ABOVE] + [of(k, low).alias(f"low_{k}") for k in BELOW]
    return quantiles.groupBy("level", "__lang", "__source").agg(F.max("n").alias("n"), *aggs).where((F.col("n") >= least) | (F.col("level") == 0))


def judge(docs: DataFrame, least: int = LEAST, id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """id, the counts, base_failed, kept."""
    rows = stage(measured(docs, id, text, lang, source).withColumns({"__lang": F.col("__lang").cast("string"), "__source": F.col("__source").cast("string")}), "rule-counts")
    table = stage(fences(rows, least), "rule-fences")
    limits = [c for c in table.columns if c.startswith(("high_", "low_"))]
    # the finest level that has fences, for every group: as many rows as groups
    groups = rows.select("__lang", "__source").distinct()
    best = groups
    for k, on in ((2, ["__lang", "__source"]), (1, ["__lang"]), (0, [])):
        side = table.where(F.col("level") == k).select(*(F.col(c).alias(f"{c}_k") for c in on), F.struct(*limits).alias(f"f{k}"))
        match = F.lit(True)
        for c in on:
            match &= F.col(c).eqNullSafe(F.col(f"{c}_k"))
        best = best.join(side, match, "left").drop(*(f"{c}_k" for c in on)) if on else best.join(F.broadcast(side), match, "left")  # level 0 is one row
    best = best.select(F.col("__lang").alias("__l"), F.col("__source").alias("__s"), F.coalesce("f2", "f1", "f0").alias("f"))
    joined = rows.join(best, F.col("__lang").eqNullSafe(F.col("__l")) & F.col("__source").eqNullSafe(F.col("__s")), "left")
    within = F.lit(True)
    for k, c in metrics().items():
        within &= (c <= F.col("f")[f"high_{k}"]) & ((c >= F.col("f")[f"low_{k}"]) if k in BELOW else F.lit(True))
    return joined.select(F.col("__id").alias(id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed().alias("base_failed"), (~failed() & within).alias("kept"))


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir))
