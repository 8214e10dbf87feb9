"""Quality measures of retrieval and classification, latencies, distributions and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.jsonfix import CLASSES


def relevance(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """The hits (query, doc, rank, law_number, article_no, source_file) that are relevant by expected (query, laws, articles, ids, files): by law and
    article where laws are given, else by id, file, or "file#article"."""
    has = lambda arr, v: F.coalesce(F.array_contains(arr, v), F.lit(False))
    law = has(F.col("laws"), F.col("law_number")) & ((F.size("articles") <= 0) | has(F.col("articles"), F.col("article_no")))
    article = F.coalesce("article_no", F.lit(""))
    pair = F.exists("ids", lambda k: k.contains("#") & (F.substring_index(k, "#", 1) == F.col("source_file")) & (article.contains(F.regexp_extract(k, "#(.*)$", 1)) | F.regexp_extract(k, "#(.*)$", 1).contains(article)))
    other = has(F.col("ids"), F.col("doc").cast("string")) | has(F.col("files"), F.col("source_file")) | F.coalesce(pair, F.lit(False))
    return hits.join(expected, "query").where(F.when(F.size("laws") > 0, law).otherwise(other))


def hit_metrics(queries: DataFrame, relevant: DataFrame, ks=(1, 2, 3)) -> DataFrame:
    """One row: n_queries, MRR and Hit@k, to four places. relevant: the relevant hits (query, rank); queries without any count as misses."""
    best = queries.select("query").distinct().join(relevant.groupBy("query").agg(F.min("rank").alias("first")), "query", "left")
    hit = lambda k: F.round(F.avg(F.coalesce((F.col("first") <= k).cast("int"), F.lit(0))), 4)
    return best.agg(F.count("*").alias("n_queries"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 4).alias("mrr"), *(hit(k).alias(f"hit_at_{k}") for k in ks))


def system_benchmark(queries: DataFrame, relevant: DataFrame, times: DataFrame, value: str = "ms") -> DataFrame:
    """One row: Hit@1, 3 and 5, MRR, queries a second, and the latency's mean and percentiles. times: query and its milliseconds."""
    speed = latency(times, value).crossJoin(times.agg(F.round(1000 * F.count("*") / F.sum(value), 3).alias("qps")))  # one row each
    return hit_metrics(queries, relevant, (1, 3, 5)).crossJoin(speed.drop("n"))


def failures(queries: DataFrame, relevant: DataFrame) -> DataFrame:
    """The queries without any relevant hit."""
    return queries.select("query").distinct().join(relevant.select("query"), "query", "left_anti")


def latency(times: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """n, mean, p50, p95, p99 by linear interpolation, to three places."""
    p = lambda q: F.round(F.percentile(F.col(value), F.lit(q)), 3)
    return times.groupBy(*(by or [])).agg(F.count(value).alias("n"), F.round(F.avg(value), 3).alias("mean"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"))


def latency_nearest(times: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """n, mean_ms, p50_ms, p95_ms, max_ms, where a percentile is the value at the place p * (n - 1), rounded half to even.

    Values are counted first, so a group's rows are its different values, and a running count finds the places; a group
    of equal values is one row."""
    by = by or []
    counted = times.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by)
    run = counted.withColumns({"upto": F.sum("c").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("c").over(w)})
    at = lambda p: F.round(F.min(F.when(F.col("upto") > F.bround(p * (F.col("n") - 1), 0), F.col("v"))), 2)
    return run.groupBy(*by).agg(F.max("n").alias("n"), F.round(F.sum(F.col("v") * F.col("c")) / F.max("n"), 2).alias("mean_ms"), at(0.5).alias("p50_ms"), at(0.95).alias("p95_ms"), F.round(F.max("v"), 2).alias("max_ms"))


def classes(spark, names=CLASSES) -> DataFrame:
    """The taxonomy: code, place."""
    return spark.createDataFrame([(c, i + 1) for i, c in enumerate(names)], "code string, place int")


def confusion(predictions: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """true, predicted, n for every pair of classes, zeros included; pairs with an unknown class are left out."""
    pairs = taxonomy.select(F.col("code").alias("true")).crossJoin(taxonomy.select(F.col("code").alias("predicted")))  # classes squared
    n = predictions.groupBy("true", "predicted").agg(F.count("*").alias("n"))
    return pairs.join(n, ["true", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def class_report(predictions: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """label, precision, recall, f1 (to four places, 0 where undefined) and support of every class, in one aggregation."""
    right = F.col("true") == F.col("predicted")
    sides = predictions.select(F.explode(F.array(F.struct(F.col("true").alias("label"), right.cast("int").alias("tp"), (~right).cast("int").alias("fn"), F.lit(0).alias("fp"), F.lit(1).alias("s")), F.struct(F.col("predicted").alias("label"), F.lit(0).alias("tp"), F.lit(0).alias("fn"), (~right).cast("int").alias("fp"), F.lit(0).alias("s")))).alias("x")).select("x.*")
    sums = sides.groupBy("label").agg(*(F.sum(c).alias(c) for c in ("tp", "fn", "fp", "s")))
    all_ = taxonomy.select(F.col("code").alias("label")).join(sums, "label", "left").fillna(0, ["tp", "fn", "fp", "s"])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return all_.select("label", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(ratio(2 * p * r, p + r), 4).alias("f1"), F.col("s").alias("support"))


def summary(predictions: DataFrame, report: DataFrame) -> DataFrame:
    """One row: n_examples, accuracy, macro_f1 (classes with support), macro_f1_all, weighted_f1."""
    f1 = report.agg(
        F.round(F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("f1"))), F.lit(0.0)), 4).alias("macro_f1"), F.round(F.coalesce(F.avg("f1"), F.lit(0.0)), 4).alias("macro_f1_all"),
        F.round(F.coalesce(F.sum(F.col("f1") * F.col("support")) / F.nullif(F.sum("support"), F.lit(0)), F.lit(0.0)), 4).alias("weighted_f1"),
    )
    hit = predictions.agg(F.count("*").alias("n_examples"), F.round(F.coalesce(F.avg((F.col("true") == F.col("predicted")).cast("int")), F.lit(0.0)), 4).alias("accuracy"))
    return hit.crossJoin(f1)


def evaluate(predictions: DataFrame, taxonomy: DataFrame, latency_ms: str | None = None) -> dict[str, DataFrame]:
    """All measures of a classifier at once."""
    report = class_report(predictions, taxonomy)
    out = {"summary": summary(predictions, report), "per_class": report, "confusion": confusion(predictions, taxonomy)}
    return out | ({"latency": latency_nearest(predictions, latency_ms)} if latency_ms else {})


def distribution(rows: DataFrame, label: str, taxonomy: DataFrame, code: str = "code", few: int = 20) -> DataFrame:
    """label, n, share (to four places), minority (some, but fewer than `few`), unsupported (none) of every class."""
    n = rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    every = taxonomy.select(F.col(code).alias("label")).join(n, "label", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy())  # one row for each class
    return every.select("label", "n", F.round(F.coalesce(F.col("n") / F.nullif(total, F.lit(0)), F.lit(0.0)), 4).alias("share"), ((F.col("n") > 0) & (F.col("n") < few)).alias("minority"), (F.col("n") == 0).alias("unsupported"))


def by_tag(rows: DataFrame, tags: str, right: Column, known: DataFrame) -> DataFrame:
    """tag, n, accuracy (to four places; null without rows) of every known tag; a row counts for each of its tags."""
    got = rows.select(F.explode(tags).alias("tag"), right.cast("int").alias("right")).groupBy("tag").agg(F.count("*").alias("n"), F.round(F.avg("right"), 4).alias("accuracy"))
    return known.select("tag").join(got, "tag", "left").select("tag", F.coalesce("n", F.lit(0)).alias("n"), "accuracy")


def predicted(documents: DataFrame, predictions: DataFrame, id: str = "doc_id") -> DataFrame:
    """documents with their prediction; an empty one where there is none."""
    return documents.join(predictions.select(id, "predicted"), id, "left").withColumn("predicted", F.coalesce("predicted", F.lit("")))


def split(rows: DataFrame, label: str, id: str, test: float = 0.15, val: float = 0.15, synthetic: str | None = None, seed: int = 42) -> DataFrame:
    """rows of a label with a split of test, val or train: of each class, in an order shuffled by hash, the first ones, as many as the shares
    rounded half to even; synthetic rows only train.

    A class may hold most rows, so ranks are made in two steps: within buckets of the hash, then over the buckets' counts."""
    real = ~F.col(synthetic) if synthetic else F.lit(True)
    h = F.xxhash64(F.lit(seed), F.col(id))
    base = rows.where(F.col(label).isNotNull() & (F.col(label).cast("string") != "")).withColumns({"__h": h, "__b": F.shiftright(h, 54), "__real": real})
    counts = base.where("__real").groupBy(F.col(label).alias("__l"), F.col("__b").alias("__c")).agg(F.count("*").alias("__k"))
    w = Window.partitionBy("__l")
    counts = counts.withColumns({"__n": F.sum("__k").over(w), "__before": F.sum("__k").over(w.orderBy("__c").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__k")})
    inner = Window.partitionBy(label, "__real", "__b").orderBy("__h", id)
    base = base.withColumn("__r", F.row_number().over(inner)).join(counts, (F.col(label) == F.col("__l")) & (F.col("__b") == F.col("__c")), "left")
    n_test, n_val, rank = F.bround(F.col("__n") * test, 0), F.bround(F.col("__n") * val, 0), F.col("__r") + F.col("__before")
    name = F.when(~F.col("__real"), "train").when(rank <= n_test, "test").when(rank <= n_test + n_val, "val").otherwise("train")
    return base.withColumn("split", name).select(*rows.columns, "split")


def answer_benchmark(rows: DataFrame) -> DataFrame:
    """One row of means, to three places. rows: answerable, grounded, expected_found, citation_precision, retrieval_ms, generation_ms, total_ms."""
    ok = (F.col("grounded") & F.col("expected_found")).cast("double")
    mean = lambda c, name: F.round(F.avg(c), 3).alias(name)
    able = F.col("answerable")
    return rows.agg(
        mean(F.when(able, ok), "answer_correct"), mean(F.when(able, F.col("citation_precision")), "citation_precision"), mean(F.when(~able, F.col("grounded").cast("double")), "hallucination_rate"),
        *(mean(F.col(c), f"mean_{c}") for c in ("retrieval_ms", "generation_ms", "total_ms")),
    )


def routing_benchmark(rows: DataFrame) -> DataFrame:
    """One row of shares. rows: expected, ranked (array of departments), conflict, expect_conflict, ambiguous, expect_ambiguous, confidence, authority, expect_authority."""
    place = F.array_position("ranked", F.col("expected"))
    share = lambda c, name: F.round(F.avg(c.cast("double")), 4).alias(name)
    right = place == 1
    return rows.agg(
        share(right, "top1"), share(place.between(1, 3), "top3"), F.round(F.avg(F.when(place > 0, 1 / place).otherwise(0.0)), 4).alias("mrr"), share(F.col("authority") == F.col("expect_authority"), "authority"),
        share(F.col("conflict") == F.col("expect_conflict"), "conflict"), share(F.col("ambiguous") == F.col("expect_ambiguous"), "ambiguity"), share((F.col("confidence") == "HIGH") <= right, "calibration"),
    )


def ablation(variants: DataFrame, predictions: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """variant, n, errors, accuracy, macro_f1 of every variant. predictions: variant, true, predicted, error."""
    right = F.col("true") == F.col("predicted")
    good = predictions.where("error IS NULL")
    per = good.select("variant", F.explode(F.array(F.struct(F.col("true").alias("label"), right.cast("int").alias("tp"), (~right).cast("int").alias("fn"), F.lit(0).alias("fp")), F.struct(F.col("predicted").alias("label"), F.lit(0).alias("tp"), F.lit(0).alias("fn"), (~right).cast("int").alias("fp")))).alias("x"))
    per = per.groupBy("variant", "x.label").agg(*(F.sum(f"x.{c}").alias(c) for c in ("tp", "fn", "fp"))).join(taxonomy.select(F.col("code").alias("label")), "label", "left_semi")
    f1 = F.coalesce(F.round(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fn") + F.col("fp"), F.lit(0)), 4), F.lit(0.0))
    macro = per.where("tp + fn > 0").groupBy("variant").agg(F.round(F.avg(f1), 4).alias("macro_f1"))
    base = predictions.groupBy("variant").agg(F.count("*").alias("n"), F.count("error").alias("errors"), F.round(F.avg(F.when(F.col("error").isNull(), right.cast("int"))), 4).alias("accuracy"))
    return variants.select("variant").join(base, "variant", "left").join(macro, "variant", "left").fillna(0, ["n", "errors"])


def evidence(questions: DataFrame, chunks: DataFrame, most: int = 2) -> tuple[DataFrame, DataFrame]:
    """(query, chunk_id, nth) of up to `most` chunks for each expected law and article, and the questions that have none. questions: query, law_number, article_no."""
    met = questions.join(chunks.select("chunk_id", "law_number", "article_no"), ["law_number", "article_no"])
    w = Window.partitionBy("query", "law_number", "article_no").orderBy("chunk_id")
    found = met.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most).select("query", "chunk_id", "nth")
    return found, questions.select("query").distinct().join(found.select("query"), "query", "left_anti")


TEMPLATES = ("{title} konusunda hangi hüküm uygulanır?", "{law} sayılı Kanunun {article}. maddesi neyi düzenler?", "{title} hangi maddede düzenlenmiştir?")


def generated_questions(chunks: DataFrame, most: int = 2) -> DataFrame:
    """chunk_id, nth, question from templates, up to `most` for each chunk (law_number, article_no, title)."""
    fill = lambda t: F.replace(F.replace(F.replace(F.lit(t), F.lit("{title}"), F.coalesce("title", F.lit(""))), F.lit("{law}"), F.coalesce("law_number", F.lit(""))), F.lit("{article}"), F.coalesce("article_no", F.lit("")))
    return chunks.select("chunk_id", F.posexplode(F.slice(F.array(*map(fill, TEMPLATES)), 1, most)).alias("nth", "question"))
