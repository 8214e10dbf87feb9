"""Mixing sources to target weights by a low-discrepancy schedule.

The documents of a source, in an order shuffled by hash, form a stream of words that is cut into blocks of equal length.
The points of a golden-ratio (Kronecker) sequence go through the cumulated shares of the sources' targets, which gives
each slot its source; the slots of a source are ranked, and the slot of rank r takes the source's block r, from the
start again after the last. A document is taken as often as the blocks that cover it.

Every prefix sum is taken in two steps, within buckets of documents (or slots) and then over the buckets' totals, so a
source that holds a third of all rows is still spread over all tasks. Null texts have size 0 and are never taken;
a null source is a source of its own, last in order. Equal rows are told apart by their content's hash and doc_id only; rows
that are alike in both get one another's place, which is harmless. Very long texts are cut over blocks like others; extra columns, whatever their names, take no part. Without documents, or with only empty ones, all targets are 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import columns_free, documents, n_words, stage

#: Golden-ratio step of the sequence: round(0.618... * 2**31), made odd.
STEP, PERIOD = 1327217885, 1 << 31
WEIGHTS = (5.0, 2.0, 1.0)


def targets(sizes: dict, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> dict:
    """Target words of each source (in code-point order, null last): weights, repeating, share `share` of all words; a
    target stops at `most` times the source's size, and the excess is shared out anew by weight."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, open_, left = {s: 0.0 for s in names}, [s for s in names if sizes[s]], share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ = [s for s in open_ if s not in full]
    return out


def block_words(total: float) -> int:
    """Words of a block: a power of two from 16 to 4096, for about 2**18 slots or more."""
    b = 16
    while b < 4096 and total / (2 * b) >= 1 << 18:
        b *= 2
    return b


def _running(df: DataFrame, key: str, order: list, value: str, out: str, buckets: int) -> DataFrame:
    """df with the sum of `value` over earlier rows of the key as `out`; order[0] is a hash, uniform over the longs."""
    bucket = F.shiftrightunsigned(F.col(order[0]), 64 - buckets.bit_length() + 1).cast("int") if buckets > 1 else F.lit(0)
    df = df.withColumn("__bucket", bucket)
    w = Window.partitionBy(key, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = df.withColumn("__sum", F.sum(value).over(w) - F.col(value))
    totals = df.groupBy(key, "__bucket").agg(F.sum(value).alias("__total"))
    before = totals.withColumn("__before", F.sum("__total").over(Window.partitionBy(key).orderBy("__bucket")) - F.col("__total")).drop("__total")
    before = before.withColumnsRenamed({key: "__key", "__bucket": "__b"})
    joined = inner.join(before, inner[key].eqNullSafe(before["__key"]) & (inner["__bucket"] == before["__b"]))
    return joined.withColumn(out, F.col("__sum") + F.col("__before")).drop("__bucket", "__sum", "__before", "__key", "__b")


def schedule(spark: SparkSession, goals: dict, sizes: dict, block: int) -> DataFrame:
    """slot, __s (number of the source in code-point order), rank: which block of which source comes in each place.

    The ranks are made in two steps: the slots of a source are counted in chunks of 4096 slots, then ranked within each."""
    names = list(goals)
    total = sum(goals.values())
    slots = spark.range(round(total / block)).withColumnRenamed("id", "slot")
    point = F.pmod(F.pmod(F.col("slot"), F.lit(PERIOD)) * F.lit(STEP) + F.lit(PERIOD // 2), F.lit(PERIOD)) / F.lit(float(PERIOD))
    edges, run = [], 0.0
    for s in names:
        run += goals[s]
        edges.append(run / total if total else 0.0)
    source = F.least(F.size(F.filter(F.array(*(F.lit(e) for e in edges)), lambda e: e <= point)), F.lit(max(i for i, s in enumerate(names) if goals[s]))) if total else F.lit(0)
    slots = slots.withColumn("__s", source).withColumn("__chunk", F.expr("slot div 4096"))
    ranked = slots.withColumn("__r", F.row_number().over(Window.partitionBy("__chunk", "__s").orderBy("slot")))
    counts = slots.groupBy("__s", "__chunk").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy("__s").orderBy("__chunk")) - F.col("__n")).drop("__n")
    return ranked.join(before, ["__s", "__chunk"]).select("slot", "__s", (F.col("__r") - 1 + F.col("__before")).alias("rank"))


def text_hash(id, text, seed: int = 7):
    """What shuffles the documents of a source."""
    return F.xxhash64(F.lit(seed), id, text)


def repeat(docs: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs with every row as often as the mix takes it, to the nearest whole number; rows of size 0 are taken never."""
    plan = mix(docs, id=id, text=text, **how).groupBy(F.col(id).alias("__id"), "text_hash").agg(F.sum("taken").alias("__taken"), F.sum("size").alias("__size"))
    times = F.when(F.col("__size") > 0, F.round(F.col("__taken") / F.col("__size"))).otherwise(0).cast("int")
    plan = stage(plan.select("__id", F.col("text_hash").alias("__h"), times.alias("__times")).where("__times > 0"), "mix-times")
    hashed, copy = columns_free(docs, "__h2", "__copy")
    plan = plan.withColumnsRenamed(dict(zip(plan.columns, columns_free(docs, *plan.columns), strict=True)))
    key, same, times = plan.columns
    kept = docs.withColumn(hashed, text_hash(F.col(id), F.col(text)))
    joined = kept.join(plan.hint("merge"), (F.col(hashed) == F.col(same)) & kept[id].eqNullSafe(F.col(key)))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 7, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per row of docs: id, size, source_size, target (of its source), taken (words the mix takes, repeats counted), text_hash."""
    spark = docs.sparkSession
    base = stage(docs.select(F.col(id).alias("__id"), F.col(source).alias("__source"), n_words(F.col(text)).alias("size"), text_hash(F.col(id), F.col(text), seed).alias("__h")), "mix-sizes")
    # one row for each source goes to the driver: as many as there are sources
    rows = base.groupBy("__source").agg(F.sum("size").alias("n"), F.count("*").alias("docs")).collect()
    sizes, n_docs = {r["__source"]: r["n"] for r in rows}, sum(r["docs"] for r in rows)
    goals = targets(sizes, weights, share, most)
    names = list(goals)
    total = sum(goals.values())
    block = block_words(total)
    facts = spark.createDataFrame([(i, s, sizes[s], float(goals[s])) for i, s in enumerate(names)], "__s int, __name string, source_size long, target double")
    base = base.join(F.broadcast(facts), base["__source"].eqNullSafe(facts["__name"])).drop("__name", "__source")
    empty = base.where("size = 0").select(F.col("__id").alias(id), "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.col("__h").alias("text_hash"))
    buckets = 1 << max(0, (n_docs // 2048).bit_length())
    placed = _running(base.where("size > 0"), "__s", ["__h", "__id"], "size", "__at", buckets)
    # a stream runs twice at most; slots beyond that find no block
    plan = schedule(spark, goals, sizes, block)
    hits = plan.withColumn("__block", F.col("rank")).groupBy("__s", "__block").agg(F.count("*").alias("__times"))
    # a document lies in the stream at __at, and again one length of the source later
    twice = placed.withColumn("__lap", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("__from", F.col("__at") + F.col("__lap") * F.col("source_size"))
    pieces = twice.where(F.col("__from") < F.col("target") + 64 * block).withColumn(
        "__block", F.explode(F.sequence(F.expr(f"__from div {block}"), F.expr(f"(__from + size - 1) div {block}")))
    )
    covered = F.least(F.col("__from") + F.col("size"), (F.col("__block") + 1) * block) - F.greatest(F.col("__from"), F.col("__block") * block)
    got = pieces.select("__s", "__h", "__id", "__at", "__block", covered.alias("__words")).join(hits, ["__s", "__block"])
    got = got.groupBy("__s", "__at", "__id").agg(F.sum(F.col("__words") * F.col("__times")).alias("__taken"))
    out = placed.join(got.withColumnsRenamed({"__s": "__s2", "__at": "__at2", "__id": "__id2"}), (F.col("__s") == F.col("__s2")) & (F.col("__at") == F.col("__at2")), "left")
    return out.select(F.col("__id").alias(id), "size", "source_size", "target", F.coalesce("__taken", F.lit(0)).cast("long").alias("taken"), F.col("__h").alias("text_hash")).unionByName(empty)


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).drop("text_hash")
