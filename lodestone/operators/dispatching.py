"""Department routing over a table of departments, of any number: the same decisions as in routing, made by joins.

routing compiles some ten departments into expressions; here their phrases are a dictionary that texts are joined with, their words a table of weights. Keyword and BM25
scores exist only for the departments that a text has something in common with; they choose a few candidates, and only for these the other signals are worked out, row by row
from the department's own columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import routing_tokens
from lodestone.operators import phrases
from lodestone.operators.dealing import met
from lodestone.operators.phrases import low
from lodestone.operators.routing import ALTERNATIVES, B, CANDIDATES, EXCLUDED, FLOOR, INTENTS, K1, SOFT, WEIGHTS, Department, ambiguous, analysed, confidence, weights
from lodestone.sources.scratch import cut

LISTS = ("keywords", "topics", "responsibilities", "rules", "excluded", "legal", "entities")
_PHRASE = "struct<p:string,own:array<string>,raw:string>"


def table(spark: SparkSession, departments: list[Department]) -> DataFrame:
    """Departments as rows: place (their order), id, institution, name, unit, office, authority, channel, and the lists of phrases."""
    rows = [(i, d.id, d.institution, d.name, d.unit, d.office, d.authority, d.channel, *(list(getattr(d, k)) for k in LISTS)) for i, d in enumerate(departments)]
    return spark.createDataFrame(rows, "place int, id string, institution string, name string, unit string, office string, authority string, channel string, " + ", ".join(f"{k} array<string>" for k in LISTS))


def _phrases(c: Column) -> Column:
    """A list of phrases with what a text is compared with."""
    return F.transform(c, lambda x: F.struct(low(x).alias("p"), F.array_distinct(routing_tokens(low(x))).alias("own"), x.alias("raw")))


class Offices:
    """A table of departments, with its phrases and the weights of its words as tables."""

    def __init__(self, departments: DataFrame):
        lists = {k: F.coalesce(k, F.array().cast("array<string>")) for k in LISTS}
        self.rows = cut(departments.withColumns(lists), "offices")
        corpus = F.concat_ws(" ", "name", "unit", "keywords", "topics", "responsibilities", "rules")
        words = self.rows.select("place", F.explode(routing_tokens(corpus)).alias("term"))
        counts = words.groupBy("place", "term").agg(F.count("*").alias("f"))
        size = self.rows.select("place", F.size(routing_tokens(corpus)).alias("length"))
        one = size.agg(F.count("*").alias("n"), F.avg("length").alias("average"))  # one row
        df = counts.groupBy("term").agg(F.count("*").alias("df"))
        self.idf = cut(df.crossJoin(F.broadcast(one)).select("term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")), "office-idf")
        norm = counts.groupBy("place").agg(F.sqrt(F.sum(F.col("f") * F.col("f"))).alias("norm"))
        shape = size.join(norm, "place").crossJoin(F.broadcast(one))
        average = F.when(F.col("average") > 0, F.col("average")).otherwise(1.0)
        gain = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / average))
        self.words = cut(counts.join(self.idf, "term").join(shape, "place").select("term", "place", "f", gain.alias("gain"), "norm"), "office-words")
        self.rarest = one.select(F.log(1 + (F.col("n") + 0.5) / 0.5).alias("rarest"))

    def dictionary(self, *lists: str) -> DataFrame:
        """place, p, times (how often the lists have it), size (how many phrases they have)."""
        whole = F.concat(*(F.col(k) for k in lists))
        each = self.rows.select("place", F.size(whole).alias("size"), F.explode(whole).alias("phrase"))
        return each.select("place", "size", low(F.col("phrase")).alias("p")).where("p != ''").groupBy("place", "p").agg(F.count("*").alias("times"), F.max("size").alias("size"))

    def shares(self, texts: DataFrame, id: str, text: str, *lists: str) -> DataFrame:
        """id, place, share of the lists' phrases that are in a row's text, where that is not 0."""
        words = self.dictionary(*lists)
        hits = phrases.found(texts, words, id, text, "p")
        return met(hits, words, ["p"]).groupBy(id, "place").agg((F.sum("times") / F.max("size")).alias("share"))

    def best(self, texts: DataFrame, id: str, text: str, *lists: str, least: float = 0.0) -> DataFrame:
        """id, named: the department with the greatest share, the first of equal ones; rows below `least` have none."""
        named = self.shares(texts, id, text, *lists).join(self.rows.select("place", "name"), "place")
        return named.where(F.col("share") >= least).groupBy(id).agg(F.max_by("name", F.struct("share", -F.col("place"))).alias("named"))

    def lexical(self, texts: DataFrame, id: str, text: str) -> DataFrame:
        """id, place, bm25, semantic, where a row's text has a word of the department's."""
        words = texts.select(id, F.explode(routing_tokens(F.col(text))).alias("term")).groupBy(id, "term").agg(F.count("*").alias("tf"))
        words = cut(words, "text-words")
        about = words.join(self.idf, "term", "left").crossJoin(F.broadcast(self.rarest)).groupBy(F.col(id).alias("__id")).agg(
            F.sum(F.coalesce("idf", "rarest")).alias("cap"), F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("own_norm"))
        hit = met(words, self.words, ["term"]).groupBy(id, "place").agg(F.sum(F.col("tf") * F.col("gain")).alias("raw"), F.sum(F.col("tf") * F.col("f")).alias("dot"), F.max("norm").alias("norm"))
        both = hit.join(about, hit[id] == about["__id"])
        bm25 = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("raw") / F.greatest("cap", F.lit(1e-6))))
        return both.select(id, "place", bm25.alias("bm25"), (F.col("dot") / (F.col("own_norm") * F.col("norm"))).alias("semantic"))


def intents(states: DataFrame, offices: Offices) -> DataFrame:
    """states (with a row number __s) with label, focus and focus_topic: the whole analysis, and up to two subtopics that point to another department."""
    subs = states.select("__s", F.posexplode(F.coalesce("subtopics", F.array().cast("array<string>"))).alias("n", "said"))
    texts = states.select("__s", F.lit(-1).alias("n"), F.col("analysis").alias("said")).unionByName(subs)
    texts = cut(texts.withColumn("__t", F.monotonically_increasing_id()), "intent-texts")
    named = cut(texts.join(offices.best(texts, "__t", "said", "keywords", "topics"), "__t", "left"), "named")
    main = named.where("n = -1").select("__s", F.col("named").alias("main"))
    other = named.where("n >= 0 AND named IS NOT NULL").join(main, "__s").where(F.col("main").isNull() | (F.col("named") != F.col("main")))
    first = F.slice(F.transform(F.sort_array(F.collect_list(F.struct("n", "said"))), lambda x: x["said"]), 1, INTENTS - 1)
    other = other.groupBy(F.col("__s").alias("__s2")).agg(first.alias("__others"))
    whole = F.struct(F.lit("primary").alias("label"), F.col("analysis").alias("focus"), F.col("topic").alias("focus_topic"))
    more = F.transform(F.coalesce("__others", F.array().cast("array<string>")), lambda s: F.struct(F.concat(F.lit("secondary:"), s).alias("label"), s.alias("focus"), s.alias("focus_topic")))
    rows = states.join(other, states["__s"] == other["__s2"], "left").withColumn("__i", F.explode(F.concat(F.array(whole), more)))
    return rows.select(*states.columns, "__i.label", "__i.focus", "__i.focus_topic")


def shortlist(rows: DataFrame, offices: Offices, id: str = "__r") -> DataFrame:
    """id, place, first, keyword, bm25, semantic of each row's CANDIDATES departments: of those at FLOOR or above the best by keywords and BM25, or of all if none is."""
    texts = rows.select(id, "focus")
    words = offices.lexical(texts, id, "focus")
    keys = offices.shares(texts, id, "focus", "keywords", "topics").withColumnRenamed("share", "keyword")
    # departments without a score of their own can only be among the first places
    bare = rows.select(id).crossJoin(F.broadcast(offices.rows.orderBy("place").limit(CANDIDATES).select("place")))
    scored = words.join(keys, [id, "place"], "full").join(bare, [id, "place"], "full")
    scored = scored.select(id, "place", *(F.coalesce(k, F.lit(0.0)).alias(k) for k in ("keyword", "bm25", "semantic")))
    scored = scored.withColumn("first", 0.5 * F.col("keyword") + 0.5 * F.col("bm25"))
    w = Window.partitionBy(id)
    passed = F.max((F.col("first") >= FLOOR).cast("int")).over(w)
    scored = scored.withColumn("__any", passed).where((F.col("first") >= FLOOR) | (F.col("__any") == 0))
    return scored.withColumn("__nth", F.row_number().over(w.orderBy(F.desc("first"), "place"))).where(F.col("__nth") <= CANDIDATES).drop("__any", "__nth")


def _share(list_: Column, text: Column, words: Column) -> Column:
    return F.when(F.size(list_) > 0, F.size(F.filter(list_, lambda x: phrases.within(text, words, x["p"], x["own"]))) / F.size(list_)).otherwise(0.0)


def heuristic() -> Column:
    """The stand-in for a model's score: the share of a department's responsibilities that the text names. For rows of candidates()."""
    return _share(_phrases(F.col("d.responsibilities")), F.col("__low"), F.col("__words"))


def candidates(rows: DataFrame, offices: Offices, llm: Column | None = None) -> DataFrame:
    """rows (with a row number __r) with ranked, as in routing: the shortlist's departments with all signals, best first, and __top, the first one's columns.

    llm: a model's score over the columns of a row, its texts (__low, __words) and the department's (d)."""
    chosen = cut(shortlist(rows, offices), "shortlist")
    both = F.concat_ws(" ", F.nullif(F.col("focus"), F.lit("")), F.nullif(F.col("focus_topic"), F.lit("")))
    d = offices.rows.select("place", F.struct(*(c for c in offices.rows.columns)).alias("d"))
    each = rows.join(chosen.withColumnRenamed("__r", "__r2"), F.col("__r") == F.col("__r2")).drop("__r2").join(d, "place")
    each = each.withColumns({"__low": low(F.col("focus")), "__words": routing_tokens(F.col("focus")), "__haylow": low(both), "__hay": routing_tokens(both)})
    plain = lambda c: F.lower(F.replace(F.coalesce(c, F.lit("")), F.lit("İ"), F.lit("i")))
    inst, recipient = low(F.col("institution")), low(F.col("recipient"))
    held = (recipient != "") & reduce(lambda a, b: a | b, [plain(F.col(f"d.{k}")).contains(recipient) for k in ("name", "unit", "office")])
    before = F.exists(F.coalesce("previous_correspondence", F.array().cast("array<map<string,string>>")), lambda m: (low(m["department"]) != "") & plain(F.col("d.name")).contains(low(m["department"])))
    points = ((inst != "") & plain(F.col("d.institution")).contains(inst)).cast("int") + held.cast("int") + F.coalesce(before, F.lit(False)).cast("int")
    refs = F.coalesce("legal_references", F.array().cast("array<string>"))
    legal = F.transform(F.col("d.legal"), plain)
    fits = F.filter(refs, lambda r: F.exists(legal, lambda s: s.contains(low(r)) | low(r).contains(s)))
    mine = F.array_distinct(F.transform(F.coalesce("entities", F.array().cast("array<string>")), low))
    own = F.transform(F.col("d.entities"), low)
    exact = F.filter(mine, lambda e: F.array_contains(own, e))
    near = F.filter(mine, lambda e: (e != "") & F.exists(own, lambda s: s.contains(e) | e.contains(s)))
    matched = F.when(F.size(exact) > 0, F.size(exact)).otherwise(F.size(near))
    ratio = lambda n, arr: F.when(F.size(arr) > 0, n / F.size(arr)).otherwise(0.0)
    each = each.withColumns({
        "rule": _share(_phrases(F.col("d.rules")), F.col("__haylow"), F.col("__hay")), "metadata": points / 3.0, "legal": ratio(F.size(fits), refs), "entity": F.least(F.lit(1.0), ratio(matched, mine)),
        "llm": llm if llm is not None else F.lit(0.0), "__w": weights(llm is not None),
    })
    topic = F.get(F.filter(_phrases(F.col("d.excluded")), lambda x: phrases.within(F.col("__haylow"), F.col("__hay"), x["p"], x["own"])), F.lit(0))["raw"]
    each = each.withColumn("__topic", topic)
    total = reduce(lambda a, b: a + b, [F.col(f"__w.{k}") * F.col(k) for k in WEIGHTS])
    total = F.when(F.col("__topic").isNotNull(), total * EXCLUDED).otherwise(total)
    nothing = (total <= 0) & reduce(lambda a, b: a & b, [F.col(k) <= 0 for k in WEIGHTS])
    reason = F.when(F.col("__topic").isNotNull(), F.concat(F.lit("document matches excluded topic '"), F.col("__topic"), F.lit("' for this department"))).when(nothing, "no supporting evidence found for this department")
    signals = F.struct(*(F.col(k).cast("double").alias(k) for k in WEIGHTS))
    kept = F.struct("first", (-F.col("place")).alias("place"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)).alias("total"), F.col("d.name").alias("department"), F.col("d.id").alias("id"), (F.col("__topic").isNotNull() | nothing).alias("rejected"), reason.alias("reason"), signals.alias("signals"))
    each = each.select("__r", kept.alias("c"))
    order = F.struct((~F.col("c.rejected")).alias("r"), F.col("c.total").alias("t"), F.col("c.first").alias("f"), F.col("c.place").alias("p"), F.col("c").alias("c"))
    ranked = each.groupBy(F.col("__r").alias("__r2")).agg(F.transform(F.reverse(F.array_sort(F.collect_list(order))), lambda x: x["c"]).alias("ranked"))  # CANDIDATES at most
    return rows.join(ranked, F.col("__r") == F.col("__r2")).drop("__r2")


def conflicts(rows: DataFrame, offices: Offices, legal: str = "Hukuk Müşavirliği") -> DataFrame:
    """rows of candidates() with d, the first candidate's department, and conflicts, what speaks against it: legal wording in intent or draft, or a topic that classification gave."""
    said = F.concat_ws(" ", F.nullif(F.col("intent"), F.lit("")), F.nullif(F.col("writing_output"), F.lit("")), F.nullif(F.col("analysis_summary"), F.lit("")))
    rows = rows.withColumns({"__said": said, "__place": -F.get("ranked", F.lit(0))["place"]})
    d = offices.rows.select(F.col("place").alias("__p"), F.struct(*offices.rows.columns).alias("d"))
    rows = cut(rows.join(d, F.col("__place") == F.col("__p"), "left").drop("__p"), "ranked")
    share = lambda list_: _share(_phrases(list_), low(F.col("__said")), routing_tokens(F.col("__said")))
    lawyers = offices.rows.where(F.col("name") == legal).agg(F.min_by("keywords", "place").alias("__lawyers"))  # one row
    rows = rows.crossJoin(F.broadcast(lawyers))
    mine = F.when(F.col("__lawyers").isNotNull(), share(F.coalesce("__lawyers", F.array().cast("array<string>"))))
    first = F.when((F.col("__said") != "") & (F.col("d.name") != legal) & (mine >= 0.34) & (mine > share(F.col("d.keywords")) + 0.15), F.concat(F.lit(f"legal signals point to {legal}, not to "), F.col("d.name")))
    named = offices.best(rows.select("__r", F.coalesce("classification_topic", F.lit("")).alias("said")), "__r", "said", "topics", least=0.5).withColumnRenamed("__r", "__r2")
    alone = offices.rows.agg((F.count("*") < 2).alias("__alone"))  # one row
    rows = rows.join(named, F.col("__r") == F.col("__r2"), "left").drop("__r2").crossJoin(F.broadcast(alone))
    topic, named = F.col("classification_topic"), F.when(~F.col("__alone"), F.col("named"))
    handled = F.coalesce(F.array_contains("d.topics", topic), F.lit(False))
    second = F.when(F.coalesce(topic != "", F.lit(False)) & ~handled & named.isNotNull() & (named != F.col("d.name")), F.concat(F.lit("classification topic points to "), named, F.lit(", not to "), F.col("d.name")))
    return rows.withColumn("conflicts", F.array_compact(F.array(first, second))).drop("__said", "__place", "__lawyers", "__alone", "named")


def route(states: DataFrame, departments: DataFrame | Offices, llm: Column | None = None) -> DataFrame:
    """As routing.route(), over a table of departments."""
    offices = departments if isinstance(departments, Offices) else Offices(departments)
    for name in ("writing_output", "analysis_summary", "classification_topic", "document_type"):
        if name not in states.columns:
            states = states.withColumn(name, F.lit(None).cast("string"))
    states = cut(analysed(states).withColumn("__s", F.monotonically_increasing_id()), "states")
    rows = cut(intents(states, offices).withColumn("__r", F.monotonically_increasing_id()), "intents")
    rows = conflicts(candidates(rows, offices, llm), offices)
    top = F.get("ranked", F.lit(0))
    empty = F.array_compact(F.array(*(F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(c)) for c in SOFT)))
    rows = rows.withColumns({"ambiguous": ambiguous(), "missing": empty})
    rows = rows.withColumn("confidence", confidence(top, F.size("conflicts"), F.col("ambiguous"), F.size("missing")))
    status = F.when(F.size("conflicts") > 0, "CONFLICT_DETECTED").when(F.col("ambiguous"), "AMBIGUOUS").when(F.col("label") != "primary", "MULTI_ROUTE").otherwise("SINGLE_ROUTE")
    others = F.slice(F.array_distinct(F.transform(F.filter("ranked", lambda c: c["department"] != top["department"]), lambda c: c["department"])), 1, ALTERNATIVES)
    text, hint = F.lower(F.concat_ws(" ", "document_text", "intent")), F.col("d.channel")
    channel = (
        F.when(hint == "CONFIDENTIAL", "CONFIDENTIAL").when((hint == "LEGAL") | (F.size(F.coalesce("legal_references", F.array())) > 0), "LEGAL").when(hint == "EXTERNAL_CORRESPONDENCE", hint)
        .when(text.rlike("acil|ivedi|urgent"), "URGENT").when((F.coalesce("institution", F.lit("")) != "") & ~F.lower("institution").contains(F.lower("d.institution")), "EXTERNAL_CORRESPONDENCE").otherwise("STANDARD")
    )
    out = rows.select(
        "state_id", "label", status.alias("status"), top["department"].alias("department"), F.col("d.authority").alias("authority"), channel.alias("channel"), top["total"].alias("total"), top["signals"].alias("signals"),
        F.when(top["rejected"], top["reason"]).alias("rejection"), others.alias("alternatives"), "conflicts", "ambiguous", "missing", F.col("confidence.level").alias("confidence"), F.col("confidence.score").alias("confidence_score"),
    )
    problems = F.array_compact(F.array(F.when(F.col("department").isNull(), "no department"), F.when(F.col("authority").isNull(), "no authority"), F.when(F.col("total").isNull(), "no score")))
    return out.withColumn("problems", problems).withColumn("needs_human_review", (F.size("problems") > 0) | (F.size("conflicts") > 0) | F.col("ambiguous") | (F.col("confidence") == "LOW"))
