"""Department routing: eight signals for each text and department, a weighted total, conflicts, ambiguity, confidence.

The knowledge base has some ten departments; it is a fixed-size dimension, given as Python rows and compiled into expressions, so a text is scored against all
departments in one narrow pass: no join, no shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import ROUTING_STOPWORDS, ROUTING_TOKEN, routing_tokens

# The signals' weights and the thresholds of decisions.
WEIGHTS = {"rule": 0.20, "keyword": 0.10, "bm25": 0.15, "semantic": 0.20, "metadata": 0.10, "legal": 0.10, "entity": 0.10, "llm": 0.05}
EXCLUDED, MARGIN, FLOOR, CANDIDATES, INTENTS, ALTERNATIVES = 0.1, 0.06, 0.02, 5, 3, 2
HIGH, MEDIUM, PER_CONFLICT, PER_AMBIGUITY, PER_MISSING = 0.72, 0.48, 0.18, 0.10, 0.03
K1, B = 1.5, 0.75
_TOKEN, _STOP = re.compile(ROUTING_TOKEN), frozenset(ROUTING_STOPWORDS)


@dataclass(frozen=True)
class Department:
    id: str
    institution: str
    name: str
    keywords: tuple[str, ...] = ()
    topics: tuple[str, ...] = ()
    responsibilities: tuple[str, ...] = ()
    rules: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    legal: tuple[str, ...] = ()
    entities: tuple[str, ...] = ()
    unit: str = ""
    office: str = ""
    authority: str = "DAIRE"
    channel: str = "STANDARD"
    more: dict = field(default_factory=dict, hash=False, compare=False)

    def corpus(self) -> str:
        return " ".join([self.name, self.unit, *self.keywords, *self.topics, *self.responsibilities, *self.rules])


def _split(text: str) -> list[str]:
    """The words of a department's own texts, as routing_tokens() cuts them."""
    return [w for w in _TOKEN.findall(_plain(text)) if len(w) > 1 and w not in _STOP]


def _plain(text: str) -> str:
    return text.replace("İ", "i").lower()


def phrase(p: str, text: Column, words: Column) -> Column:
    """Whether a phrase is in a text: as it is, or by all its words. text: lower-cased."""
    p = p.replace("İ", "i").lower().strip()
    if not p:
        return F.lit(False)
    own = sorted(set(_split(p)))
    inside = text.contains(p)
    if not own or own == [p]:  # a text with that word contains it
        return inside
    return inside | reduce(lambda a, b: a & b, [F.array_contains(words, w) for w in own])


def share(phrases, text: Column, words: Column) -> Column:
    """The share of phrases that are in a text."""
    if not phrases:
        return F.lit(0.0)
    return reduce(lambda a, b: a + b, [phrase(p, text, words).cast("int") for p in phrases]) / F.lit(float(len(phrases)))


class KnowledgeBase:
    """The departments, with the term statistics of their texts."""

    def __init__(self, departments: list[Department]):
        self.departments = departments
        self.counts = [Counter(_split(d.corpus())) for d in departments]
        self.lengths = [sum(c.values()) for c in self.counts]
        self.average = sum(self.lengths) / len(self.lengths) if departments else 0.0
        df = Counter(t for c in self.counts for t in c)
        n = len(departments)
        self.idf = {t: math.log(1 + (n - f + 0.5) / (f + 0.5)) for t, f in df.items()}
        self.rarest = math.log(1 + (n + 0.5) / 0.5)

    @property
    def vocabulary(self) -> list[str]:
        return sorted(self.idf)

    def digested(self, text: Column) -> Column:
        """struct(low, words, different, norm): what the departments' phrases and words are looked for in, instead of the text and its words. low has those phrases of the departments that are in
        the text, a line for each, so it contains the same of them; words has those of its words that any department has, in order, with repeats; different and norm are of all its words."""
        phrases = sorted({_plain(p).strip() for d in self.departments for p in d.keywords + d.topics + d.responsibilities + d.rules + d.excluded} - {""})
        known = set(self.idf) | {w for p in phrases for w in _split(p)}

        @F.pandas_udf("low string, words array<string>, different int, norm double")
        def digest(texts: pd.Series) -> pd.DataFrame:
            out = []
            for t in texts:
                low, words = _plain(t or ""), _split(t or "")
                counts = Counter(words)
                out.append(("\n".join(p for p in phrases if p in low), [w for w in words if w in known], len(counts), math.sqrt(sum(c * c for c in counts.values()))))
            return pd.DataFrame(out, columns=["low", "words", "different", "norm"])

        return digest(text)

    def prepared(self, rows: DataFrame) -> DataFrame:
        """rows with __words as what the scores need: the words that any department has, and, unless they are there, the number of different words and the length
        of the vector of word counts."""
        none = F.array().cast("array<string>")
        known = F.filter("__words", lambda w: w.isin(*self.vocabulary)) if self.idf else none
        if "__norm" in rows.columns:
            return rows.withColumn("__hits", known)
        zero = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("total"))

        def step(acc, w):  # c equal words in a row add 1 + 3 + ... = c squared
            run = F.when(acc["last"] == w, acc["run"] + 1).otherwise(F.lit(1.0))
            return F.struct(w.alias("last"), run.alias("run"), (acc["total"] + 2 * run - 1).alias("total"))

        norm = F.sqrt(F.aggregate(F.sort_array("__words"), zero, step, lambda acc: acc["total"]))
        return rows.withColumns({"__hits": known, "__different": F.size(F.array_distinct("__words")), "__norm": norm})

    def bm25(self, i: int) -> Column:
        """A text's score for a department as a share of what its different words could score at most."""
        dl = self.lengths[i]
        gain = {t: self.idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * dl / (self.average or 1))) for t, f in self.counts[i].items()}
        raw = F.aggregate("__hits", F.lit(0.0), lambda a, w: a + F.coalesce(_lookup(gain, w), F.lit(0.0)))
        distinct = F.array_distinct("__hits")
        cap = self.rarest * (F.col("__different") - F.size(distinct)) + F.aggregate(distinct, F.lit(0.0), lambda a, w: a + _lookup(self.idf, w))
        return F.when(F.col("__different") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw / F.greatest(cap, F.lit(1e-6))))).otherwise(0.0)

    def semantic(self, i: int) -> Column:
        """Cosine of the word counts; the stand-in for a model's similarity."""
        c = {t: float(f) for t, f in self.counts[i].items()}
        norm = math.sqrt(sum(f * f for f in c.values()))
        dot = F.aggregate("__hits", F.lit(0.0), lambda a, w: a + F.coalesce(_lookup(c, w), F.lit(0.0)))
        return F.when((F.col("__norm") > 0) & F.lit(norm > 0), dot / (F.col("__norm") * norm)).otherwise(0.0)


def _lookup(table: dict[str, float], key: Column) -> Column:
    """A value from a small constant map."""
    if not table:
        return F.lit(None).cast("double")
    return F.create_map(*[F.lit(x) for t, v in sorted(table.items()) for x in (t, float(v))])[key]


def _low(c: Column) -> Column:
    return F.lower(F.trim(F.replace(F.coalesce(c, F.lit("")), F.lit("İ"), F.lit("i"))))


def analysed(states: DataFrame) -> DataFrame:
    """states with analysis: summary, intent, requested action, topic, subtopics and text, as far as they are given."""
    parts = F.array(F.col("summary"), F.col("intent"), F.col("requested_action"), F.col("topic"), F.array_join("subtopics", " "), F.col("document_text"))
    return states.withColumn("analysis", F.array_join(F.filter(parts, lambda p: F.coalesce(p, F.lit("")) != ""), " "))


def intents(states: DataFrame, kb: KnowledgeBase) -> DataFrame:
    """states with label, focus (text to route) and focus_topic: the whole analysis, and up to two subtopics that point to another department."""
    quick = lambda low, words: _best([share(d.keywords + d.topics, low, words) for d in kb.departments], [d.name for d in kb.departments])
    whole = F.struct(F.lit("primary").alias("label"), F.col("analysis").alias("focus"), F.col("topic").alias("focus_topic"))
    # words are cut once, in a step of their own, and not once for every phrase
    own = F.transform(F.coalesce("subtopics", F.array().cast("array<string>")), lambda s: F.struct(s.alias("s"), _low(s).alias("l"), routing_tokens(s).alias("w")))
    base = states.withColumns({"__d": kb.digested(F.col("analysis")), "__subs": own}).withColumns({"__low": F.col("__d.low"), "__words": F.col("__d.words")})
    base = base.withColumn("__main", quick(F.col("__low"), F.col("__words")))
    subs = F.transform("__subs", lambda x: F.struct(x["s"].alias("s"), quick(x["l"], x["w"]).alias("d")))
    other = F.slice(F.filter(subs, lambda x: x["d"].isNotNull() & (F.col("__main").isNull() | (x["d"] != F.col("__main")))), 1, INTENTS - 1)
    more = F.transform(other, lambda x: F.struct(F.concat(F.lit("secondary:"), x["s"]).alias("label"), x["s"].alias("focus"), x["s"].alias("focus_topic")))
    return base.withColumn("__i", F.explode(F.concat(F.array(whole), more))).select(*states.columns, "__i.label", "__i.focus", "__i.focus_topic")


def _best(scores: list[Column], names: list[str], least: float = 0.0) -> Column:
    """The name of the first greatest score above `least`; null if none is."""
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    pick = reduce(lambda rest, x: F.when(x[0] == top, x[1]).otherwise(rest), reversed(list(zip(scores, names, strict=True))), F.lit(None).cast("string"))
    return F.when(top > least, pick)


def signals(kb: KnowledgeBase, i: int, llm: Column | None = None) -> dict[str, Column]:
    """The signals of department i for rows of intents()."""
    d = kb.departments[i]
    text, words = F.col("__low"), F.col("__words")
    hay, hay_words = F.col("__haylow"), F.col("__hay")
    inst, recipient = _low(F.col("institution")), _low(F.col("recipient"))
    within = lambda s: F.lit(s.replace("İ", "i").lower())
    held = (recipient != "") & reduce(lambda a, b: a | b, [within(s).contains(recipient) for s in (d.name, d.unit, d.office)])
    before = F.exists(F.coalesce("previous_correspondence", F.array().cast("array<map<string,string>>")), lambda m: (_low(m["department"]) != "") & within(d.name).contains(_low(m["department"])))
    points = ((inst != "") & within(d.institution).contains(inst)).cast("int") + held.cast("int") + F.coalesce(before, F.lit(False)).cast("int")
    legal = [s.replace("İ", "i").lower() for s in d.legal]
    refs = F.coalesce("legal_references", F.array().cast("array<string>"))
    fits = F.filter(refs, lambda r: reduce(lambda a, b: a | b, [F.lit(s).contains(_low(r)) | _low(r).contains(s) for s in legal], F.lit(False)))
    mine = F.array_distinct(F.transform(F.coalesce("entities", F.array().cast("array<string>")), _low))
    own = [s.replace("İ", "i").lower().strip() for s in d.entities]
    exact = F.filter(mine, lambda e: e.isin(*own) if own else F.lit(False))
    near = F.filter(mine, lambda e: (e != "") & reduce(lambda a, b: a | b, [F.lit(s).contains(e) | e.contains(s) for s in own], F.lit(False)))
    met = F.when(F.size(exact) > 0, F.size(exact)).otherwise(F.size(near))
    ratio = lambda n, arr: F.when(F.size(arr) > 0, n / F.size(arr)).otherwise(0.0)
    return {
        "rule": share(d.rules, hay, hay_words), "keyword": share(d.keywords + d.topics, text, words), "bm25": kb.bm25(i), "semantic": kb.semantic(i), "metadata": points / 3.0,
        "legal": ratio(F.size(fits), refs), "entity": F.least(F.lit(1.0), ratio(met, mine)), "llm": llm if llm is not None else F.lit(0.0),
    }


def weights(use_llm: bool = False) -> Column:
    """A map of the weights that hold for a row: those of signals without input are shared out equally among the others."""
    off = {"llm": F.lit(not use_llm), "legal": F.size(F.coalesce("legal_references", F.array())) <= 0, "entity": F.size(F.coalesce("entities", F.array())) <= 0}
    dropped = reduce(lambda a, b: a + b, [F.when(c, F.lit(WEIGHTS[k])).otherwise(0.0) for k, c in off.items()])
    left = F.lit(len(WEIGHTS)) - reduce(lambda a, b: a + b, [c.cast("int") for c in off.values()])
    return F.struct(*(F.when(off.get(k, F.lit(False)), 0.0).otherwise(F.lit(w) + dropped / left).alias(k) for k, w in WEIGHTS.items()))


def candidates(intent: DataFrame, kb: KnowledgeBase, llm=None) -> DataFrame:
    """intent rows with ranked: array of structs (total, department, id, rejected, reason, signals), best first, of the CANDIDATES
    departments that a cheap first score prefers (those at FLOOR or above, or all if none is). The first use of costly scores is after that cut only in meaning: all are
    expressions over the same row."""
    both = F.concat_ws(" ", F.nullif(F.col("focus"), F.lit("")), F.nullif(F.col("focus_topic"), F.lit("")))
    if llm in (None, heuristic):
        rows = intent.withColumns({"__d": kb.digested(F.col("focus")), "__e": kb.digested(both)})
        rows = rows.withColumns({"__low": F.col("__d.low"), "__words": F.col("__d.words"), "__different": F.col("__d.different"), "__norm": F.col("__d.norm"), "__haylow": F.col("__e.low"), "__hay": F.col("__e.words")}).drop("__d", "__e")
    else:  # a model gets the whole text
        rows = intent.withColumns({"__low": _low(F.col("focus")), "__words": routing_tokens(F.col("focus")), "__haylow": _low(both), "__hay": routing_tokens(both)})
    names = list(WEIGHTS)
    rows = kb.prepared(rows)
    rows = rows.withColumn("__s", F.array(*(F.struct(*(c.cast("double").alias(k) for k, c in signals(kb, i, llm(kb.departments[i]) if llm else None).items())) for i in range(len(kb.departments)))))
    rows = rows.withColumn("__w", weights(llm is not None))
    hay = F.col("__haylow")
    made = []
    for i, d in enumerate(kb.departments):
        s = F.get("__s", F.lit(i))
        topic = reduce(lambda rest, t: F.when(phrase(t, hay, F.col("__hay")), t).otherwise(rest), reversed(d.excluded), F.lit(None).cast("string"))
        total = reduce(lambda a, b: a + b, [F.col(f"__w.{k}") * s[k] for k in names])
        total = F.when(topic.isNotNull(), total * EXCLUDED).otherwise(total)
        nothing = (total <= 0) & reduce(lambda a, b: a & b, [s[k] <= 0 for k in names])
        reason = F.when(topic.isNotNull(), F.concat(F.lit("document matches excluded topic '"), topic, F.lit("' for this department"))).when(nothing, "no supporting evidence found for this department")
        made.append(F.struct((0.5 * s["keyword"] + 0.5 * s["bm25"]).alias("first"), F.lit(-i).alias("place"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)).alias("total"), F.lit(d.name).alias("department"), F.lit(d.id).alias("id"), (topic.isNotNull() | nothing).alias("rejected"), reason.alias("reason"), s.alias("signals")))
    every = F.array(*made)
    rows = rows.withColumn("__c", every)
    passed = F.filter("__c", lambda c: c["first"] >= FLOOR)
    pool = F.when(F.size(passed) > 0, passed).otherwise(F.col("__c"))
    short = F.slice(F.reverse(F.array_sort(F.transform(pool, lambda c: F.struct(c["first"].alias("k"), c["place"].alias("p"), c.alias("c"))))), 1, CANDIDATES)
    ranked = F.transform(F.reverse(F.array_sort(F.transform(short, lambda x: F.struct((~x["c"]["rejected"]).alias("r"), x["c"]["total"].alias("t"), x["k"].alias("k"), x["p"].alias("p"), x["c"].alias("c"))))), lambda x: x["c"])
    return rows.withColumn("ranked", ranked).drop("__low", "__hits", "__different", "__norm", "__words", "__haylow", "__hay", "__s", "__w", "__c")


def heard(rows: DataFrame) -> DataFrame:
    """rows with what conflicts() looks at: the words of intent and draft, and of the classification's topic."""
    said = F.concat_ws(" ", F.nullif(F.col("intent"), F.lit("")), F.nullif(F.col("writing_output"), F.lit("")), F.nullif(F.col("analysis_summary"), F.lit("")))
    topic = F.col("classification_topic")
    return rows.withColumns({"__said": _low(said), "__saidwords": routing_tokens(said), "__topic": _low(topic), "__topicwords": routing_tokens(topic)})


def conflicts(kb: KnowledgeBase, legal: str = "Hukuk Müşavirliği") -> Column:
    """What speaks against the first candidate: legal wording in intent or draft, or a topic that classification gave. For rows of heard()."""
    top = F.get("ranked", F.lit(0))
    said, low, words = F.col("__said"), F.col("__said"), F.col("__saidwords")
    dept = next((d for d in kb.departments if d.name == legal), None)
    out = []
    if dept:
        mine = share(dept.keywords, low, words)
        theirs = reduce(lambda rest, d: F.when(top["id"] == d.id, share(d.keywords, low, words)).otherwise(rest), kb.departments, F.lit(0.0))
        out.append(F.when((said != "") & (top["department"] != legal) & (mine >= 0.34) & (mine > theirs + 0.15), F.concat(F.lit(f"legal signals point to {legal}, not to "), top["department"])))
    topic = F.col("classification_topic")
    scores = [share(d.topics, F.col("__topic"), F.col("__topicwords")) for d in kb.departments]
    handled = reduce(lambda rest, d: F.when(top["id"] == d.id, topic.isin(*d.topics) if d.topics else F.lit(False)).otherwise(rest), kb.departments, F.lit(False))
    named = F.when(F.greatest(*scores) >= 0.5, _best(scores, [d.name for d in kb.departments])) if len(scores) > 1 else F.lit(None).cast("string")
    out.append(F.when(F.coalesce(topic != "", F.lit(False)) & ~handled & named.isNotNull() & (named != top["department"]), F.concat(F.lit("classification topic points to "), named, F.lit(", not to "), top["department"])))
    return F.array_compact(F.array(*out))


def ambiguous() -> Column:
    """Whether the two best candidates that are not rejected are within the margin."""
    viable = F.filter("ranked", lambda c: ~c["rejected"])
    return F.coalesce((F.size(viable) >= 2) & (F.get(viable, F.lit(0))["total"] - F.get(viable, F.lit(1))["total"] < MARGIN), F.lit(False))


def channel(kb: KnowledgeBase) -> Column:
    """How the first candidate's department is to handle the document."""
    top = F.get("ranked", F.lit(0))
    by = lambda f: reduce(lambda rest, d: F.when(top["id"] == d.id, F.lit(f(d))).otherwise(rest), kb.departments, F.lit(None).cast("string"))
    hint, home = by(lambda d: d.channel), by(lambda d: d.institution.lower())
    text = F.lower(F.concat_ws(" ", "document_text", "intent"))
    return (
        F.when(hint == "CONFIDENTIAL", "CONFIDENTIAL").when((hint == "LEGAL") | (F.size(F.coalesce("legal_references", F.array())) > 0), "LEGAL").when(hint == "EXTERNAL_CORRESPONDENCE", hint)
        .when(text.rlike("acil|ivedi|urgent"), "URGENT").when((F.coalesce("institution", F.lit("")) != "") & ~F.lower("institution").contains(home), "EXTERNAL_CORRESPONDENCE").otherwise("STANDARD")
    )


def confidence(top: Column, n_conflicts: Column, is_ambiguous: Column, n_missing: Column) -> Column:
    """struct(level, score): the total, a little more for each of seven signals that is on, less for what speaks against it."""
    on = reduce(lambda a, b: a + b, [(top["signals"][k] > 0.05).cast("int") for k in WEIGHTS if k != "llm"])
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), top["total"] + F.least(F.lit(0.10), 0.015 * on) - PER_CONFLICT * n_conflicts - PER_AMBIGUITY * is_ambiguous.cast("int") - PER_MISSING * n_missing))
    level = F.when(score >= HIGH, F.when((n_conflicts > 0) | is_ambiguous, "MEDIUM").otherwise("HIGH")).when(score >= MEDIUM, "MEDIUM").otherwise("LOW")
    return F.struct(level.alias("level"), score.alias("score"))


SOFT = ("document_type", "summary", "intent", "topic", "requested_action", "institution")


def heuristic(d: Department) -> Column:
    """The stand-in for a model's score: the share of a department's responsibilities that the text names."""
    return share(d.responsibilities, F.col("__low"), F.col("__words"))


def route(states: DataFrame, kb: KnowledgeBase, llm=None) -> DataFrame:
    """state_id, label and the decision of every intent of every state: status, department, authority, channel, alternatives, conflicts, confidence ...
    llm: a function from a department to the Column of a model's score for it, such as heuristic(); without one that signal's weight is shared out."""
    for name, kind in (("writing_output", "string"), ("analysis_summary", "string"), ("classification_topic", "string"), ("document_type", "string")):
        if name not in states.columns:
            states = states.withColumn(name, F.lit(None).cast(kind))
    rows = heard(candidates(intents(analysed(states), kb), kb, llm))
    top = F.get("ranked", F.lit(0))
    by = lambda f: reduce(lambda rest, d: F.when(top["id"] == d.id, F.lit(f(d))).otherwise(rest), kb.departments, F.lit(None).cast("string"))
    empty = F.array_compact(F.array(*(F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(c)) for c in SOFT)))
    rows = rows.withColumns({"conflicts": conflicts(kb), "ambiguous": ambiguous(), "missing": empty})
    rows = rows.withColumn("confidence", confidence(top, F.size("conflicts"), F.col("ambiguous"), F.size("missing")))
    multi = F.col("label") != "primary"
    status = F.when(F.size("conflicts") > 0, "CONFLICT_DETECTED").when(F.col("ambiguous"), "AMBIGUOUS").when(multi, "MULTI_ROUTE").otherwise("SINGLE_ROUTE")
    others = F.slice(F.array_distinct(F.transform(F.filter("ranked", lambda c: c["department"] != top["department"]), lambda c: c["department"])), 1, ALTERNATIVES)
    out = rows.select(
        "state_id", "label", status.alias("status"), top["department"].alias("department"), by(lambda d: d.authority).alias("authority"), channel(kb).alias("channel"), top["total"].alias("total"), top["signals"].alias("signals"),
        F.when(top["rejected"], top["reason"]).alias("rejection"), others.alias("alternatives"), "conflicts", "ambiguous", "missing", F.col("confidence.level").alias("confidence"), F.col("confidence.score").alias("confidence_score"),
    )
    problems = F.array_compact(F.array(F.when(F.col("department").isNull(), "no department"), F.when(F.col("authority").isNull(), "no authority"), F.when(F.col("total").isNull(), "no score")))
    return out.withColumn("problems", problems).withColumn("needs_human_review", (F.size("problems") > 0) | (F.size("conflicts") > 0) | F.col("ambiguous") | (F.col("confidence") == "LOW"))


def contract(routes: DataFrame) -> DataFrame:
    """state_id, success, department: what the next stage gets of the primary route."""
    ok = F.col("department").isNotNull() & (F.size("problems") == 0) & F.col("rejection").isNull()
    return routes.where("label = 'primary'").select("state_id", ok.alias("success"), F.when(ok, F.col("department")).otherwise("").alias("department"))


#: A small knowledge base of our own, of the shape that the operators expect.
DEPARTMENTS = [
    Department("legal", "Belediye", "Hukuk Müşavirliği", ("dava", "itiraz", "mahkeme", "hukuki görüş"), ("idari dava", "icra"), ("dava takibi",), ("dava açma", "mahkeme kararı"), ("izin talebi",), ("2577", "1136"), ("İdare Mahkemesi",), channel="LEGAL", authority="MUSAVIRLIK"),
    Department("staff", "Belediye", "İnsan Kaynakları", ("izin", "personel", "atama", "maaş"), ("yıllık izin", "özlük"), ("personel işleri",), ("izin talebi", "atama talebi"), ("ihale",), ("657", "4857"), ("Personel",)),
    Department("works", "Belediye", "Fen İşleri", ("yol", "asfalt", "kaldırım", "altyapı"), ("yol onarımı",), ("yol yapımı",), ("yol bozuk", "çukur onarımı"), ("dava",), ("3194",), ("Karayolları",)),
    Department("finance", "Belediye", "Mali Hizmetler", ("bütçe", "ödeme", "fatura", "vergi"), ("vergi borcu", "ödeme planı"), ("tahsilat",), ("ödeme talebi", "borç sorgulama"), (), ("5018", "213"), ("Gelir İdaresi",)),
    Department("green", "Belediye", "Park ve Bahçeler", ("park", "ağaç", "bahçe", "yeşil alan"), ("ağaç budama",), ("park bakımı",), ("ağaç budama",), (), ("2872",), ()),
]
