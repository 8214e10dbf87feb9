"""Answers from retrieved passages: context packing, citations, the decision ladder, the answer cache and conversations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import fold, normal, repeats_itself, squeeze, token_estimate, tokens, without_repeats
from lodestone.operators import querying, vectors
from lodestone.sources.scratch import cut

CACHE_VERSION = 9
ABSTAINED = r"\b(saglanan\s+kaynaklarda\s+(?:bu\s+soruyu\s+)?dogrulanamadi|dogrulanamiyor|yeterli\s+(?:hukuki\s+)?(?:bilgi|pasaj|kaynak)\s+(?:bulunamadi|yok)|guvenilir\s+bir\s+(?:bilgi|yonlendirme)\s+veremem)\b"
REFUSAL = "Sağlanan kaynaklarda bu soruyu doğrulayacak yeterli hukukî pasaj bulunamadı."
NEARBY = "Sağlanan kaynaklarda sorunuzun doğrudan cevabını doğrulayacak açık bir hüküm bulunamadı. Aşağıdaki kaynaklar konuya yakın görünmektedir; ancak bunlar sorunun kesin cevabı olarak değerlendirilmemelidir."
SOURCE = "struct<label:string,text:string,law_name:string,law_number:string,article_number:string,source_file:string,page_start:int,chunk_id:bigint,score:double>"


def scoped_text(text: Column, article: Column) -> Column:
    """A passage up to the first heading of another article than its own; whole where its own is unknown."""
    head = r"(?imu)^\s*madde\s+(\d+)\b|\bmadde\s+(\d+)\s*[–-]"
    numbers = F.transform(F.arrays_zip(F.regexp_extract_all(text, F.lit(head), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(head), F.lit(2)).alias("b")), lambda z: F.when(z["a"] != "", z["a"]).otherwise(z["b"]))
    pieces, heads = F.split(text, head, -1), F.regexp_extract_all(text, F.lit(head), F.lit(0))
    nth = F.coalesce(F.array_position(F.transform(numbers, lambda n: n != article), True), F.lit(0))
    kept = F.array_join(F.zip_with(F.slice(pieces, F.lit(1), nth.cast("int")), F.slice(heads, F.lit(1), F.greatest(nth.cast("int") - 1, F.lit(0))), lambda p, h: F.concat(p, F.coalesce(h, F.lit("")))), "")
    return F.when((F.coalesce(article, F.lit("")) == "") | (nth == 0), text).otherwise(kept)


def law_title(number: Column, name: Column) -> Column:
    """A law's name without its number in front, after "N sayılı"."""
    name = F.trim(F.coalesce(name, F.lit("Bilinmeyen kanun")))
    number = F.trim(F.coalesce(number, F.lit("")))
    bare = F.when(name.startswith(number), F.regexp_replace(F.substring(name, F.length(number) + 1, F.length(name)), r"^[_\s-]*", "")).otherwise(name)
    return F.when((number != "") & (number != "unknown"), F.concat(number, F.lit(" sayılı "), F.trim(bare))).otherwise(name)


def packed(hits: DataFrame, chunks: DataFrame, budget: int = 2700, longest: int = 1500) -> DataFrame:
    """query, context, sources, used, dropped. hits: query, doc, score; chunks: chunk_id, text and any of law_name, law_number, article_no, source_file,
    page_start. The passages of a query, best first and each text once, are taken as long as they fit; one that does not fit is passed over, and
    later ones may still fit. A query's hits are bounded by the search's k."""
    have = set(chunks.columns)
    col = lambda name, kind="string", default=None: (F.col(name).cast(kind) if name in have else F.lit(default).cast(kind))
    file = F.coalesce(col("source_file"), F.lit("unknown"))
    # only the texts of hits are worked on; written, the hits have a size that Spark can choose its join by
    hits = cut(hits.select("query", "doc", "score"), "hits")
    chunks = chunks.join(hits.select(F.col("doc").alias("chunk_id")), "chunk_id", "left_semi")
    meta = chunks.select(
        F.col("chunk_id").alias("doc"), scoped_text(F.coalesce("text", F.lit("")), col("article_no")).alias("text"), F.lower(squeeze(F.coalesce("text", F.lit("")))).alias("key"),
        F.coalesce(col("law_name"), F.regexp_replace(F.replace(file, F.lit(".pdf"), F.lit("")), "_", " ")).alias("law_name"), F.coalesce(col("law_number"), F.lit("unknown")).alias("law_number"),
        F.coalesce(col("article_no"), F.lit("unknown")).alias("article_number"), file.alias("source_file"), col("page_start", "int").alias("page_start"),
    )
    rows = hits.join(meta, "doc").where("key <> ''")
    w = Window.partitionBy("query", F.sha2("key", 256)).orderBy(F.desc("score"), "doc")
    rows = rows.withColumn("nth", F.row_number().over(w)).where("nth = 1")
    item = F.struct((-F.col("score")).alias("order"), "doc", "text", "law_name", "law_number", "article_number", "source_file", "page_start", "score")
    lists = rows.groupBy("query").agg(F.array_sort(F.collect_list(item)).alias("items"))
    zero = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("parts"), F.array().cast(f"array<{SOURCE}>").alias("sources"))

    def step(acc, x):
        label = F.concat(F.lit("S"), (F.size(acc["sources"]) + 1).cast("string"))
        page = F.when(F.coalesce(x["page_start"], F.lit(0)) != 0, F.concat(F.lit(" | Sayfa "), x["page_start"].cast("string"))).otherwise(F.lit(""))
        head = F.concat(F.lit("["), label, F.lit("] "), x["law_name"], F.lit(" | Kanun "), x["law_number"], F.lit(" | Madde "), x["article_number"], F.lit(" | Dosya "), x["source_file"], page)
        part = F.concat(head, F.lit("\n"), F.trim(F.left(squeeze(x["text"]), F.lit(longest))))
        cost = token_estimate(part)
        fits = acc["used"] + cost <= budget
        source = F.struct(label.alias("label"), x["text"].alias("text"), x["law_name"].alias("law_name"), x["law_number"].alias("law_number"), x["article_number"].alias("article_number"), x["source_file"].alias("source_file"), x["page_start"].alias("page_start"), x["doc"].alias("chunk_id"), x["score"].alias("score")).cast(SOURCE)
        return F.struct(
            F.when(fits, acc["used"] + cost).otherwise(acc["used"]).alias("used"),
            F.when(fits, F.concat(acc["parts"], F.array(part))).otherwise(acc["parts"]).alias("parts"),
            F.when(fits, F.concat(acc["sources"], F.array(source))).otherwise(acc["sources"]).alias("sources"),
        )

    got = lists.withColumn("p", F.aggregate("items", zero, step))
    return got.select("query", F.array_join("p.parts", "\n\n").alias("context"), F.col("p.sources").alias("sources"), F.col("p.used").alias("used"), (F.size("items") - F.size("p.sources")).alias("dropped"))


def cited_labels(answer: Column) -> Column:
    """The labels of an answer's citations, in order, repeats included."""
    return F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[S(\d+)\]"), F.lit(1)), lambda n: F.concat(F.lit("S"), n))


def citation_check(answer: Column, labels: Column) -> Column:
    """struct(valid, invalid): whether an answer cites, and only what it was given; and the labels it was not given."""
    invalid = F.array_sort(F.array_distinct(F.array_except(cited_labels(answer), F.coalesce(labels, F.array().cast("array<string>")))))
    return F.struct(((F.size(cited_labels(answer)) > 0) & (F.size(invalid) == 0)).alias("valid"), invalid.alias("invalid"))


def rendered(sources: Column) -> Column:
    """One line for each source: label, law, article, page."""
    page = lambda s: F.when(F.coalesce(s["page_start"], F.lit(0)) != 0, F.concat(F.lit(" - Sayfa "), s["page_start"].cast("string"))).otherwise(F.lit(""))
    return F.array_join(F.transform(sources, lambda s: F.concat(F.lit("["), s["label"], F.lit("] "), law_title(s["law_number"], s["law_name"]), F.lit(" - Madde "), s["article_number"], page(s))), "\n")


def nearby(sources: Column, message: str = NEARBY) -> Column:
    """The text that shows up to three sources as near, not as an answer."""
    lines = F.transform(F.slice(sources, 1, 3), lambda s: F.concat(F.lit("- "), law_title(s["law_number"], s["law_name"]), F.lit(" — Madde "), s["article_number"], F.lit(" ["), s["label"], F.lit("]")))
    return F.when(F.size(sources) > 0, F.concat(F.lit(message + "\n\nYakın kaynaklar:\n"), F.array_join(lines, "\n"))).otherwise(message)


def abstained(answer: Column) -> Column:
    """Whether a model says that the sources do not answer the question."""
    return normal(answer).rlike(ABSTAINED)


IGNORED = ("kanun", "kanununda", "kanunu", "madde", "maddede", "hangi", "nedir", "duzenlenmistir", "duzenlenir", "gore", "sayili", "vergi", "usul")


def article_vote(question: Column, sources: Column) -> Column:
    """The source that best answers "which article": how many of the question's words begin some word of it, plus ten where it
    begins with its own article's heading; the first of equals; null if none has any."""
    terms = F.filter(tokens(fold(question), 4), lambda t: ~t.isin(*IGNORED))

    def votes(s):
        text = normal(s["text"])
        hits = F.size(F.filter(terms, lambda t: text.contains(F.left(t, F.lit(6)))))
        own = F.regexp_extract(text, r"^\s*madde\s+(\d+)\s*[–-]", 1) == s["article_number"]
        return hits + F.when(own & (s["article_number"] != ""), 10).otherwise(0)

    scored = F.transform(sources, lambda s, i: F.struct(votes(s).alias("votes"), (-i).alias("first"), s.alias("source")))
    best = F.element_at(F.array_sort(F.transform(scored, lambda x: F.struct((-x["votes"]).alias("v"), (-x["first"]).alias("i"), x["source"].alias("source")))), 1)
    return F.when((F.size(sources) > 0) & (F.size(terms) > 0) & (best["v"] < 0), best["source"])


def fallback_label(cited: Column, sources: Column) -> Column:
    """The label of the first source of the cited law and article, else of the first source."""
    fits = F.filter(sources, lambda s: F.coalesce(s["law_number"] == cited["law_number"], cited["law_number"].isNull()) & F.coalesce(s["article_number"] == cited["article_no"], cited["article_no"].isNull()))
    return F.coalesce(F.get(fits, F.lit(0))["label"], F.get(sources, F.lit(0))["label"])


def answered(asked: DataFrame, contexts: DataFrame, generate, cache: DataFrame | None = None, repair=None, on_invalid: str = "refuse", on_missing: str = "refuse", guard: bool = True) -> DataFrame:
    """query, answer, status, grounded, sources, citations for questions (query, text, cited, plan).

    generate, and repair where on_missing is "repair": functions from DataFrame(query, text, context) to DataFrame(query, draft); they only
    get the questions that need them. cache: query, payload, of probe(). status is the rung of the ladder that decided: empty_question, cache,
    reference_not_found, service_notice, no_retrieved_evidence, article_lookup, abstained, invalid_citations, missing_citations, or generated.
    on_invalid: "refuse", or "nearby" to show near sources instead."""
    none = F.array().cast(f"array<{SOURCE}>")
    rows = asked.join(contexts.select("query", "context", "sources"), "query", "left").withColumns({"sources": F.coalesce("sources", none), "context": F.coalesce("context", F.lit(""))})
    rows = rows.join(cache.select("query", "payload"), "query", "left") if cache is not None else rows.withColumn("payload", F.lit(None).cast("string"))
    match = F.exists("sources", lambda s: F.coalesce(s["law_number"] == F.col("cited.law_number"), F.lit(False)) & F.coalesce(s["article_number"] == F.col("cited.article_no"), F.lit(False)))
    asks_both = F.col("cited.law_number").isNotNull() & F.col("cited.article_no").isNotNull()
    vote = F.when(F.col("plan.name") == "article_lookup", article_vote(F.col("text"), F.col("sources")))
    early = (
        F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "empty_question").when(F.col("payload").isNotNull() & ~repeats_itself(F.col("payload")), "cache")
        .when(F.size("sources") == 0, "no_retrieved_evidence").when(F.lit(guard) & asks_both & ~match, "reference_not_found")
        .when(querying.service_notice(F.col("text"), F.transform("sources", lambda s: s["text"])), "service_notice").when(vote.isNotNull(), "article_lookup")
    )
    rows = rows.withColumns({"early": early, "vote": vote})
    open_ = rows.where("early IS NULL").select("query", "text", "context")
    drafts = generate(open_).select("query", "draft")
    rows = rows.join(drafts, "query", "left")
    draft = without_repeats(F.col("draft"))
    check = citation_check(draft, F.transform("sources", lambda s: s["label"]))
    late = F.when(F.coalesce(F.trim("draft"), F.lit("")) == "", "abstained").when(abstained(draft), "abstained").when(F.size(check["invalid"]) > 0, "invalid_citations").when(~check["valid"], "missing_citations").otherwise("generated")
    rows = rows.withColumn("status", F.coalesce("early", late)).withColumn("draft", draft)
    if on_missing == "repair" and repair is not None:
        fixed = repair(rows.where("status = 'missing_citations'").select("query", F.col("draft").alias("text"), "context")).select("query", F.col("draft").alias("fixed"))
        rows = rows.join(fixed, "query", "left")
        good = citation_check(F.col("fixed"), F.transform("sources", lambda s: s["label"]))["valid"]
        rows = rows.withColumns({"draft": F.when(good, F.col("fixed")).otherwise(F.col("draft")), "status": F.when((F.col("status") == "missing_citations") & good, "generated").otherwise(F.col("status"))})
    direct = F.concat(law_title(F.col("vote.law_number"), F.col("vote.law_name")), F.lit(", Madde "), F.col("vote.article_number"), F.lit(" ["), F.col("vote.label"), F.lit("]."))
    shown = ["service_notice", "abstained", "reference_not_found"] + (["invalid_citations", "missing_citations"] if on_invalid == "nearby" else [])
    answer = (
        F.when(F.col("status") == "cache", F.col("payload")).when(F.col("status") == "generated", F.col("draft")).when(F.col("status") == "article_lookup", direct)
        .when(F.col("status").isin(*shown), nearby(F.col("sources"))).otherwise(REFUSAL)
    )
    return rows.select("query", answer.alias("answer"), "status", F.col("status").isin("cache", "generated", "article_lookup").alias("grounded"), "sources", rendered(F.col("sources")).alias("citations"))


def cache_key(question: Column) -> Column:
    return squeeze(F.lower(F.coalesce(question, F.lit(""))))


def probe(queries: DataFrame, cache: DataFrame, near: DataFrame | None = None, threshold: float = 0.94, version: int = CACHE_VERSION) -> DataFrame:
    """query, payload, similarity, exact: for each question (query, text) the newest cached answer of the same words, else that of the nearest
    cached vector at the threshold or above, the oldest of equals. cache: entry, question, version, payload, created_at; near: query, entry,
    cosine from a vector search over the cache, of k of a few, since a cache keeps few entries."""
    live = cache.where(F.col("version") == version)
    w = Window.partitionBy("query").orderBy(F.desc("created_at"), F.desc("entry"))
    same = queries.select("query", cache_key(F.col("text")).alias("key")).join(live.withColumn("key", cache_key(F.col("question"))), "key")
    same = same.withColumn("nth", F.row_number().over(w)).where("nth = 1").select("query", "payload", F.lit(1.0).alias("similarity"), F.lit(True).alias("exact"))
    if near is None:
        return same
    w = Window.partitionBy("query").orderBy(F.desc("cosine"), "created_at", "entry")
    close = near.where(F.col("cosine") >= threshold).join(live, "entry").join(same.select("query"), "query", "left_anti")
    close = close.withColumn("nth", F.row_number().over(w)).where("nth = 1").select("query", "payload", F.round("cosine", 6).alias("similarity"), F.lit(False).alias("exact"))
    return same.unionByName(close)


def stored(cache: DataFrame, new: DataFrame, most: int = 200) -> DataFrame:
    """The cache with new entries, which replace those of the same words; the newest `most` stay."""
    both = cache.withColumn("fresh", F.lit(0)).unionByName(new.withColumn("fresh", F.lit(1)))
    w = Window.partitionBy(cache_key(F.col("question"))).orderBy(F.desc("fresh"), F.desc("created_at"), F.desc("entry"))
    kept = both.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth", "fresh")
    return kept.orderBy(F.desc("created_at"), F.desc("entry")).limit(most)


def nearest_entries(queries: DataFrame, cache: DataFrame, k: int = 5) -> DataFrame:
    """query, entry, cosine of the k cached vectors nearest to each question (query, vector)."""
    return vectors.knn(queries, cache, k, id="entry").select("query", F.col("doc").alias("entry"), "cosine")


def follow_ups(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, question, answer, law_number) with previous, related, ambiguous, scoped and memory.

    A question is related to the one before if it names no new law and has a word that carries on, or shares a word of four letters or
    more; scoped is the search for it: within the earlier law if that is known. memory holds the last three turns, answers cut at 700 characters."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    text = normal(F.col("question"))
    has = lambda words: reduce(lambda a, b: a | b, [text.contains(x) for x in words])
    words = lambda c: F.filter(tokens(fold(c), 4), lambda t: ~t.isin(*querying.GENERIC))
    shares = F.arrays_overlap(words(F.col("question")), words(F.col("previous")))
    related = F.col("previous").isNotNull() & ~has(querying.NEW_LAW) & (has(querying.FOLLOW_UP) | F.coalesce(shares, F.lit(False)))
    out = turns.withColumns({"previous": F.lag("question").over(w), "before": F.lag("law_number").over(w), "related": F.lit(False)})
    out = out.withColumn("related", related).withColumn("ambiguous", F.col("related") & has(querying.AMBIGUOUS))
    known = F.nullif(F.coalesce("before", F.lit("unknown")), F.lit("unknown")).isNotNull() & (F.col("before") != "")
    scoped = F.when(F.col("related") & known, F.concat(F.col("before"), F.lit(" sayılı Kanun kapsamında: "), squeeze(F.col("question")))).otherwise(squeeze(F.col("question")))
    last = F.collect_list(F.struct("question", "law_number", "answer")).over(w.rowsBetween(-3, -1))
    line = lambda x, i: F.concat(F.lit("Tur "), (i + 1).cast("string"), F.lit(" | Konu: "), x["question"], F.lit("\nKanun: "), F.coalesce(x["law_number"], F.lit("Kanun bilgisi yok")), F.lit("\nÖnceki cevap özeti: "), F.left(squeeze(F.coalesce(x["answer"], F.lit(""))), F.lit(700)))
    return out.withColumns({"scoped": scoped, "memory": F.array_join(F.transform(last, line), "\n\n")}).drop("before")


def conversations(turns: DataFrame, answer) -> DataFrame:
    """Answer whole conversations: turn by turn, since a question's scope comes from the answer before it; all conversations of a turn
    go together. answer: a function from DataFrame(conv_id, turn, question, scoped, memory, ambiguous) to DataFrame(conv_id, turn, answer, law_number)."""
    done = turns.select("conv_id", "turn", "question", F.lit(None).cast("string").alias("answer"), F.lit(None).cast("string").alias("law_number"))
    numbers = sorted(r["turn"] for r in turns.select("turn").distinct().collect())  # as many as the longest conversation has
    for n in numbers:
        now = follow_ups(done.where(F.col("turn") <= n)).where(F.col("turn") == n)
        got = answer(now.select("conv_id", "turn", "question", "scoped", "memory", "ambiguous")).select("conv_id", "turn", F.col("answer").alias("a"), F.col("law_number").alias("l"))
        done = done.join(got, ["conv_id", "turn"], "left").select("conv_id", "turn", "question", F.coalesce("a", "answer").alias("answer"), F.coalesce("l", "law_number").alias("law_number"))
    return follow_ups(done)
