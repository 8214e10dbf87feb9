"""What a question asks for: citations, plan, source scope, rewrites and expansions, as Column expressions over batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import normal, squeeze, title_tokens

# Names of laws, and the words that tell one kind of question from another.
ALIASES = (("cmk", "5271"), ("ceza muhakemesi kanunu", "5271"), ("tck", "5237"), ("turk ceza kanunu", "5237"), ("kvkk", "6698"), ("is kanunu", "4857"))
ARTICLE_WORDS = ("hangi maddede", "hangi madde", "maddesi nedir", "hangi maddes")
RELATION_WORDS = ("baglant", "iliski", "atif", "ilgili madde", "karsilastir")
LEGAL_WORDS = (
    "usulsuzluk", "beyanname", "mukellef", "ceza tutari", "ceza miktari", "para cezasi", "idari para", "guncel ceza", "tarife", "ceza haddi",
    "teblig", "yonetmelik", "resmi gazete", "kavram", "tanim",
)
AMENDMENT_WORDS = ("degisiklik", "degistir", "resmi gazete", "yururluk", "yururluge", "ek madde", "torba kanun")
REGULATION_WORDS = ("yonetmelik", "teblig", "tuzuk", "genelge")
SERVICE = r"\b(nerden|nerede|hangi\s+(site|uygulama|portaldan)|e\s*-?\s*devlet|nasil\s+sorgula|sorgulayabil|online\s+sorgu|internet(?:ten)?\s+sorgu|resmi\s+(internet|web)|internet\s+sayfas)\b"
OFFICIAL = ("e-devlet", "turkiye.gov.tr", "gib.gov.tr", "gelir idaresi", "dijital vergi")
CORRECTIONS = (
    ("nede", "nerede"), ("nerden", "nereden"), ("nasil", "nasıl"), ("sorgulabilir", "sorgulanabilir"), (r"vergi\s+borcum", "vergi borcumu"),
    ("calinirsa", "çalınırsa"), ("hirsiz", "hırsız"),
)
ABBREVIATIONS = (("cmk", "Ceza Muhakemesi Kanunu"), ("tck", "Türk Ceza Kanunu"), ("kvkk", "Kişisel Verilerin Korunması Kanunu"), ("vuk", "Vergi Usul Kanunu"))
SYNONYMS = (
    ("ihbar", ("bildirim", "fesih bildirimi")), ("fesih", ("sona erdirme", "işten çıkarma")), ("işçi", ("çalışan", "personel")), ("işveren", ("patron", "şirket")),
    ("kıdem", ("çalışma süresi",)), ("izin", ("yıllık izin",)), ("yedek subay", ("askerlik süresi", "muvazzaf")), ("tazminat", ("nakdi tazminat", "idari tazminat")),
)


def _any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, group), F.lit(""))


def citation(question: Column, inferred: Column | None = None, compat: bool = False) -> Column:
    """struct(law_number, article_no): what a question cites. A compact form (5271/100) wins, then "N sayılı", then the first
    alias, then `inferred` from titles; articles by their word, then a number after an alias. compat: a bare letter m counts as the word for article."""
    text = F.coalesce(question, F.lit(""))
    compact = r"\b(\d{2,4})\s*/\s*(\d+)\b"
    law = F.coalesce(_found(text, compact), _found(text, r"(?iu)\b(\d{2,4})\b\s*(?:sayılı|sayili)"))
    alias = reduce(lambda rest, a: F.when(normal(text).contains(a[0]), a[1]).otherwise(rest), reversed(ALIASES), inferred if inferred is not None else F.lit(None).cast("string"))
    mark = "m" if compat else r"\bm\b"
    pattern = rf"(?i)(?:Madde|m\.|{mark})\s*(\d+)|(\d+)\s*\.?\s*madde(?:si|sine|sinin|nin|de|den)?"
    article = F.coalesce(_found(text, compact, 2), _found(text, pattern), _found(text, pattern, 2), _found(text, r"(?i)\b(?:cmk|tck|kvkk)\s*(\d+)\b"))
    return F.struct(F.coalesce(law, alias).alias("law_number"), article.alias("article_no"))


def laws_by_title(queries: DataFrame, titles: DataFrame) -> DataFrame:
    """query, inferred: the law of which all title words (two or more, over all its titles) are in the question; of several the one with most words,
    then the greatest number. titles: law_number, title. Words are joined on equality, so only laws that share a word meet a query."""
    laws = titles.where((F.trim("law_number") != "") & (F.col("law_number") != "unknown")).select("law_number", F.explode(title_tokens(F.col("title"))).alias("word")).distinct()
    sizes = laws.groupBy("law_number").agg(F.count("*").alias("size")).where("size >= 2")
    asked = queries.select("query", F.explode(title_tokens(F.col("text"))).alias("word"))
    met = asked.join(laws, "word").groupBy("query", "law_number").agg(F.count("*").alias("n")).join(sizes, "law_number").where("n = size")
    w = Window.partitionBy("query").orderBy(F.desc("size"), F.desc("law_number"))
    return met.withColumn("nth", F.row_number().over(w)).where("nth = 1").select("query", F.col("law_number").alias("inferred"))


def plan(question: Column, cited: Column) -> Column:
    """struct(name, mode, use_prf, use_reranker, use_graph): how to search for a question."""
    text = normal(question)
    row = lambda name, mode, prf, graph: F.struct(F.lit(name).alias("name"), F.lit(mode).alias("mode"), F.lit(prf).alias("use_prf"), F.lit(True).alias("use_reranker"), F.lit(graph).alias("use_graph"))
    return (
        F.when(cited["law_number"].isNotNull() & cited["article_no"].isNotNull(), row("exact_citation", "vector", False, "auto"))
        .when(_any(text, ARTICLE_WORDS), row("article_lookup", "hybrid", False, "off"))
        .when(_any(text, RELATION_WORDS), row("legal_relationship", "hybrid", True, "full"))
        .when(_any(text, LEGAL_WORDS), row("lexical_legal_lookup", "hybrid", False, "off"))
        .otherwise(row("semantic_hybrid", "hybrid", False, "off"))
    )


def source_scope(question: Column) -> Column:
    """The source type to search where the caller names none: null (all) for changes, else regulations or laws."""
    text = normal(question)
    return F.when(_any(text, AMENDMENT_WORDS), F.lit(None).cast("string")).when(_any(text, REGULATION_WORDS), "regulations").otherwise("laws")


def asks_for_service(question: Column) -> Column:
    """Whether a question is about using a web site rather than about law."""
    return normal(question).rlike(SERVICE)


def service_notice(question: Column, hits: Column) -> Column:
    """Whether such a question is left without any official guide among the texts of its hits."""
    return asks_for_service(question) & ~F.exists(F.coalesce(hits, F.array().cast("array<string>")), lambda t: _any(F.lower(F.left(t, F.lit(1000))), OFFICIAL))


def accepted_variants(original: Column, candidates: Column, most: int = 3, longest: int = 320) -> Column:
    """The original and those of the candidates that are new whatever their case, not too long, and bring in no new number of 2 to 8 digits."""
    original = squeeze(original)
    numbers = lambda t: F.regexp_extract_all(t, F.lit(r"\b\d{2,8}\b"), F.lit(0))
    fine = F.filter(F.transform(candidates, squeeze), lambda c: (c != "") & (F.length(c) <= longest) & (F.size(F.array_except(numbers(c), numbers(original))) == 0))
    zero = F.array(original)
    grow = lambda acc, c: F.when(F.exists(acc, lambda a: F.lower(a) == F.lower(c)) | (F.size(acc) >= most), acc).otherwise(F.concat(acc, F.array(c)))
    return F.aggregate(fine, zero, grow)


def corrected(question: Column) -> Column:
    """Common misspellings put right."""
    return reduce(lambda t, r: F.regexp_replace(t, rf"(?iu)\b{r[0]}\b", r[1]), CORRECTIONS, question)


def rewrites(question: Column, cited: Column | None = None, candidates: Column | None = None) -> Column:
    """The searches for a question: itself, its corrected form, that with abbreviations spelt out, and useful ones of a model's candidates.
    A question that cites a law or article is not rewritten."""
    first = corrected(squeeze(question))
    second = reduce(lambda t, r: F.regexp_replace(t, rf"(?iu)\b{r[0]}\b", r[1]), ABBREVIATIONS, first)
    made = F.array(first, second)
    if candidates is not None:
        made = F.concat(made, F.filter(candidates, lambda c: useful(question, c)))
    out = accepted_variants(question, made)
    if cited is None:
        return out
    return F.when(cited["law_number"].isNotNull() | cited["article_no"].isNotNull(), F.array(squeeze(question))).otherwise(out)


def useful(original: Column, candidate: Column) -> Column:
    """Whether a model's rewrite has two words or more, no known misspelling, and is not just the question cut short."""
    low = F.lower(candidate)
    words = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(r"(?U)[\wçğıöşü]+"), F.lit(0)))
    wrong = reduce(lambda a, b: a | b, [low.rlike(rf"\b{p}\b") for p, _ in CORRECTIONS])
    cut = (F.size(F.array_except(words(low), words(F.lower(original)))) == 0) & (F.length(candidate) < 0.9 * F.length(original))
    return ~wrong & ~cut & (F.size(words(low)) >= 2)


def with_synonyms(question: Column, most: int = 4) -> Column:
    """The question with up to `most` related terms that it does not have."""
    low = F.lower(question)
    none = F.array().cast("array<string>")
    terms = [F.when(low.contains(key), F.filter(F.array(*map(F.lit, values)), lambda v: ~low.contains(F.lower(v)))).otherwise(none) for key, values in SYNONYMS]
    more = F.slice(F.array_distinct(F.concat(*terms)), 1, most)
    return F.when(F.size(more) > 0, F.concat_ws(" ", F.trim(question), F.array_join(more, " "))).otherwise(question)


def with_article(question: Column) -> Column:
    """The question, and "Madde N" where it asks for article N."""
    n = F.coalesce(_found(question, r"(?i)(\d+)\.\s*maddes"), _found(question, r"(?:Madde|madde|MADDE|m\.)\s+(\d+)"))
    return F.when(n.isNotNull(), F.array(question, F.concat(F.lit("Madde "), n))).otherwise(F.array(question))


def strategy(question: Column, name: str | None) -> Column:
    """One query text by an expansion strategy; feedback is applied to results, not here."""
    name = (name or "none").lower()
    if name in ("synonym", "synonym+prf"):
        return with_synonyms(question)
    if name == "smart_rule":
        return with_synonyms(F.element_at(with_article(question), -1))
    return question


def expansions(question: Column) -> Column:
    """All searches that rules and synonyms give for a question, without repeats."""
    return F.array_distinct(F.concat(with_article(question), F.array(with_synonyms(question))))


# Words by which a question carries on from the one before.
FOLLOW_UP = ("peki", "ayrica", "bunun", "buna", "bunu", "bu durumda", "devam", "ayni", "onun", "orada", "ikinci", "sonra", "daha", "ne kadar", "hangi sure")
GENERIC = ("kanun", "madde", "nedir", "nasil", "gore", "ile", "icin")
AMBIGUOUS = ("affedersem", "bu durumda yapmam gereken", "bu durumda ne yap", "peki ne yapmam gerek", "peki ne yapmaliyim")
NEW_LAW = ("sayili", "kanunu", "kanununda", "cmk", "tck", "kvkk")
