"""Catalogue of the engine's queries and their DuckDB counterparts.

Every query runs over its whole tables. Doubles are rounded at the end, on both sides by the same rule.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import extract, text
from lodestone.operators import answers, fusion, layout, lawgraph, lexical, metrics, querying, retrieval, routing, vectors, workflow
from lodestone.sources import chunker, corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Enter a function under its own name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- SQL pieces

FOLD = "translate({}, 'çğıöşü' || chr(775), 'cgiosu')"
NORMAL = FOLD.format("lower(translate(coalesce({}, ''), 'çğıöşüÇĞİÖŞÜ', 'cgiosuCGIOSU'))")
WORDS = "list_transform(regexp_extract_all(coalesce({}, ''), '[0-9A-Za-zÀ-ÖØ-öø-ÿĞğİıŞşÇçÜüÖö]+'), lambda w: " + FOLD.format("lower(w)") + ")"
SQUEEZE = "trim(regexp_replace({}, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))"
STRIP = "regexp_replace({}, '^[ \\t\\n\\x0b\\f\\r]+|[ \\t\\n\\x0b\\f\\r]+$', '', 'g')"
STOP = "[" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "]"

TOKENS = f"""
w AS (SELECT doc_id AS doc, lang, {WORDS.format('text')} AS t0 FROM documents),
d AS (SELECT doc, lang, CASE WHEN len(t0) = 0 THEN ['_empty_'] ELSE t0 END AS terms FROM w),
e AS (SELECT doc, len(terms) AS dl, unnest(terms) AS term FROM d),
tf AS (SELECT term, doc, dl, count(*) AS tf FROM e GROUP BY ALL),
n AS (SELECT count(*) AS n_docs, avg(len(terms)) AS avg_len FROM d),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
"""
SCORES = (
    TOKENS
    + f"""
q AS (SELECT query, term, count(*) AS times FROM (SELECT item_id AS query, unnest({WORDS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
idf AS (SELECT term, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) AS idf FROM df, n),
odds AS (SELECT term, ln((n_docs - df + 0.5) / (df + 0.5)) AS raw FROM df, n),
okapi AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM odds) ELSE raw END AS idf FROM odds),
"""
)


def _scored(name: str, idf: str) -> str:
    return f"""
{name} AS (SELECT q.query, tf.doc, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_len))), 9) AS score
  FROM q JOIN tf ON tf.term = q.term JOIN {idf} i ON i.term = q.term, n GROUP BY q.query, tf.doc)"""


def _top(name: str, source: str, k: int) -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM {source}) WHERE rank <= {k})"


def _index(spark, sf_dir):
    return lexical.indexed(table(spark, sf_dir, "documents"), "doc_id", "text"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")


# ---------------------------------------------------------------- text


@query(f"""
WITH a AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\\n?\\s*[—\\-]{{5,}}\\s*\\n?', chr(10), 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(t, '(?m)^\\s*\\d{{1,4}}(?:-\\d{{1,2}})?\\s*$', '', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\\s*\\((\\d+)\\)\\s*\\n', ' (\\1) ', 'g'), '\\r\\n?', chr(10), 'g') AS t FROM b),
e AS (SELECT doc_id, {STRIP.format("regexp_replace(regexp_replace(t, '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")} AS t FROM c)
SELECT doc_id, length(t) AS chars, sha256(t) AS digest FROM e
""")
def clean_text_stats(spark, sf_dir):
    clean = text.clean_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", clean.alias("t")).select("doc_id", F.length("t").cast("long").alias("chars"), F.sha2("t", 256).alias("digest"))


@query(f"""
SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, len(list_filter(t, lambda w: length(w) >= 4 AND NOT list_contains({STOP}, w))) AS n_long
FROM (SELECT doc_id, {WORDS.format('text')} AS t FROM documents)
""")
def token_stats(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"), text.tokens(F.col("text"), 4, True).alias("l"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.size("l").cast("long").alias("n_long"))


@query("""
WITH a AS (SELECT doc_id, translate(coalesce(text, ''), '“”‘’', '""''''') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[ \\t]+', ' ', 'g'), '\\s+([,.;:!?])', '\\1', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '([0-9])\\s+([0-9])', '\\1\\2', 'g'), '([0-9])\\s+([0-9])', '\\1\\2', 'g') AS t FROM b),
d AS (SELECT doc_id, regexp_replace(t, '^[ \\t\\n\\x0b\\f\\r]+|[ \\t\\n\\x0b\\f\\r]+$', '', 'g') AS t FROM c)
SELECT d.doc_id, length(t) AS chars, sha256(t) AS digest, t <> coalesce(text, '') AS applied FROM d JOIN documents ON d.doc_id = documents.doc_id
""")
def ocr_correct(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", text.ocr_correct(F.col("text")).alias("t"))
    return rows.select("doc_id", F.length("t").cast("long").alias("chars"), F.sha2("t", 256).alias("digest"), (F.col("t") != F.coalesce("text", F.lit(""))).alias("applied"))


@query(f"""
WITH a AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '\\pL')) AS letters, len(regexp_extract_all(coalesce(text, ''), '[{text.TURKISH_LETTERS}]')) AS tr,
  len(list_intersect(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-zA-Z]+')), [{", ".join(f"'{w}'" for w in text.TURKISH_WORDS)}])) AS hits FROM documents)
SELECT doc_id, CASE WHEN letters = 0 THEN 'tr' WHEN tr > 0 OR hits >= 3 THEN 'tr' ELSE 'en' END AS detected,
  CASE WHEN letters = 0 THEN 0.0 WHEN tr > 0 THEN round(least(0.99, 0.5 + 10.0 * tr / letters), 2) WHEN hits >= 3 THEN least(0.95, 0.55 + hits * 0.06) ELSE 0.6 END AS confidence
FROM a
""")
def language_ref(spark, sf_dir):
    got = text.detect_language(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", got.alias("g")).select("doc_id", "g.detected", "g.confidence")


@query(f"""
WITH s AS (SELECT doc_id, string_split(regexp_replace(regexp_replace({STRIP.format("coalesce(text, '')")}, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+', chr(10), 'g'), chr(10)) AS p FROM documents),
u AS (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM s),
k AS (SELECT doc_id, i, {STRIP.format('x')} AS x, {SQUEEZE.format(NORMAL.format(STRIP.format('x')))} AS key FROM u),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY i) AS nth FROM k WHERE x <> '')
SELECT documents.doc_id, count(f.x) AS sentences, coalesce(sum(CASE WHEN length(key) >= 50 AND nth > 1 THEN 1 ELSE 0 END), 0)::BIGINT AS repeats FROM documents LEFT JOIN f ON f.doc_id = documents.doc_id GROUP BY documents.doc_id
""")
def repeated_sentences(spark, sf_dir):
    count = lambda t: F.size(F.filter(F.split(text.strip(t), r"(?<=[.!?])\s+|\n+"), lambda s: text.strip(s) != ""))
    kept = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.size(F.filter(F.split(text.without_repeats(F.col("text")), "\n\n"), lambda s: s != "")).alias("kept"))
    return kept.select("doc_id", count(F.col("t")).cast("long").alias("sentences"), (count(F.col("t")) - F.col("kept")).cast("long").alias("repeats"))


@query("""
SELECT doc_id, len(regexp_extract_all(t, '\\b\\d{1,2}[./]\\d{1,2}[./]\\d{2,4}\\b')) + len(regexp_extract_all(t, '\\b\\d{4}-\\d{1,2}-\\d{1,2}\\b')) AS n_dates,
  len(regexp_extract_all(t, '[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}')) AS n_emails,
  nullif(regexp_extract(t, '[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}'), '') AS first_email,
  len(list_distinct(list_filter(list_transform(list_concat(regexp_extract_all(t, '(?:\\+90|0)?\\s*\\(?5\\d{2}\\)?[\\s.-]?\\d{3}[\\s.-]?\\d{2}[\\s.-]?\\d{2}'), regexp_extract_all(t, '(?:\\+90|0)?\\s*\\(?0?\\d{3}\\)?[\\s.-]?\\d{3}[\\s.-]?\\d{2}[\\s.-]?\\d{2}')), lambda p: regexp_replace(p, '[^0-9]', '', 'g')), lambda p: length(p) >= 10))) AS n_phones
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
""")
def extract_contacts(spark, sf_dir):
    t = F.col("text")
    rows = table(spark, sf_dir, "documents").select("doc_id", extract.dates(t).alias("d"), extract.emails(t).alias("e"), extract.phones(t).alias("p"))
    return rows.select("doc_id", F.size("d").cast("long").alias("n_dates"), F.size("e").cast("long").alias("n_emails"), F.get("e", F.lit(0))["value"].alias("first_email"), F.size("p").cast("long").alias("n_phones"))


_FIELDS = """
SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE '31.02.2024' END AS day,
  CASE o_orderkey % 3 WHEN 0 THEN 'u' || o_custkey || '@mail.org' WHEN 1 THEN 'u' || o_custkey || '@mail' ELSE '' END AS email,
  CASE o_orderkey % 5 WHEN 0 THEN '+90 532 ' || lpad((o_custkey % 10000000)::VARCHAR, 7, '0') WHEN 1 THEN '0532' || lpad((o_custkey % 10000000)::VARCHAR, 7, '0') WHEN 2 THEN '532' ELSE NULL END AS phone, o_orderstatus AS sender FROM orders"""


@query(f"""
WITH f AS ({_FIELDS}),
v AS (SELECT id, coalesce(try_strptime(CASE WHEN regexp_full_match(day, '\\d{{1,2}}\\.\\d{{1,2}}\\.\\d{{4}}') THEN day END, '%d.%m.%Y'), try_strptime(CASE WHEN regexp_full_match(day, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') THEN day END, '%Y-%m-%d'), try_strptime(CASE WHEN regexp_full_match(day, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') THEN day END, '%d/%m/%Y')) IS NOT NULL AS date_ok,
  email, email <> '' AS has_email, regexp_full_match(email, '[^@\\s]+@[^@\\s]+\\.[^@\\s]+') AS email_ok, phone IS NOT NULL AS has_phone, regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g') AS d FROM f),
p AS (SELECT *, length(CASE WHEN d LIKE '90%' AND length(d) = 12 THEN substr(d, 3) WHEN d LIKE '0%' AND length(d) = 11 THEN substr(d, 2) ELSE d END) = 10 AS phone_ok FROM v)
SELECT id, concat_ws(',', CASE WHEN NOT date_ok THEN 'invalid_date_format' END, CASE WHEN has_email AND NOT email_ok THEN 'invalid_email_format' END, CASE WHEN has_phone AND NOT phone_ok THEN 'invalid_phone_format' END) AS errors,
  concat_ws(',', CASE WHEN NOT (has_email AND has_phone) THEN 'partial_extraction_data' END, CASE WHEN id % 7 / 7.0 < 0.5 THEN 'low_classification_confidence' END) AS warnings,
  date_ok AND has_email AND email_ok AND has_phone AND phone_ok AS is_complete
FROM p
""")
def validate_contacts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    day = lambda f: F.date_format("o_orderdate", f)
    number = F.lpad((c % 10000000).cast("string"), 7, "0")
    e = F.struct(
        F.lit(True).alias("success"), F.col("o_orderstatus").alias("sender"), F.when(k % 4 == 0, day("dd.MM.yyyy")).when(k % 4 == 1, day("yyyy-MM-dd")).when(k % 4 == 2, day("dd/MM/yyyy")).otherwise("31.02.2024").alias("date"), F.lit("x").alias("address"),
        F.when(k % 5 == 0, F.concat(F.lit("+90 532 "), number)).when(k % 5 == 1, F.concat(F.lit("0532"), number)).when(k % 5 == 2, "532").alias("phone"),
        F.when(k % 3 == 0, F.concat(F.lit("u"), c.cast("string"), F.lit("@mail.org"))).when(k % 3 == 1, F.concat(F.lit("u"), c.cast("string"), F.lit("@mail"))).otherwise("").alias("email"),
    )
    cls = F.struct(F.lit(True).alias("success"), (k % 7 / 7.0).alias("classification_confidence"))
    ocr = F.struct(F.lit(True).alias("success"), F.lit("text").alias("full_text"))
    v = o.select(k.alias("id"), extract.validation(e, cls, ocr).alias("v"))
    return v.select("id", F.array_join("v.errors", ",").alias("errors"), F.array_join("v.warnings", ",").alias("warnings"), F.col("v.is_complete").alias("is_complete"))


@query("""
SELECT documents.doc_id, concat_ws(',', CASE WHEN coalesce(trim(lang), '') = '' THEN 'lang' END, CASE WHEN coalesce(trim(source), '') = '' THEN 'source' END, CASE WHEN quality IS NULL THEN 'quality' END, CASE WHEN toxic IS NULL THEN 'toxic' END) AS missing
FROM documents LEFT JOIN labels ON labels.doc_id = documents.doc_id
""")
def required_fields(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.array_join(extract.missing({c: F.col(c) for c in ("lang", "source", "quality", "toxic")}), ",").alias("missing"))


@query("SELECT doc_id, lang, source, sha256(lower(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')))) AS key FROM documents QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id) = 1")
def dedupe_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    key = F.sha2(F.lower(text.squeeze(F.coalesce("text", F.lit("")))), 256)
    return corpus.first_of_each(docs.select("doc_id", "lang", "source", key.alias("key")), "key", "doc_id")


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1")
def dedupe_first_id(spark, sf_dir):
    return corpus.first_of_each(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn")


# ---------------------------------------------------------------- search


@query(f"WITH {TOKENS.rstrip().rstrip(',')} SELECT term, df, round(ln(1 + (n_docs - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, n")
def term_df_idf(spark, sf_dir):
    t, _ = _index(spark, sf_dir)
    return lexical.term_statistics(t).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {SCORES} {_scored('s', 'idf')}, {_top('r', 's', 5)} SELECT query, doc, rank, round(score, 6) AS score FROM r")
def bm25_topk(spark, sf_dir):
    t, q = _index(spark, sf_dir)
    return lexical.top(lexical.scores(q, t), 5).select("query", "doc", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"WITH {SCORES} {_scored('s', 'okapi')}, {_top('r', 's', 10)} SELECT query, doc, rank, round(score / max(score) OVER (PARTITION BY query), 4) AS score FROM r QUALIFY r.score > 0")
def bm25_okapi(spark, sf_dir):
    t, q = _index(spark, sf_dir)
    return lexical.search(q, t, 10, variant="okapi").withColumn("rank", F.col("rank").cast("long"))


@query(f"""
WITH {SCORES} {_scored('s', 'idf')},
c AS (SELECT q.query, greatest(sum(coalesce(idf, ln(1 + (n_docs + 0.5) / 0.5)) * 2.5 / 2.5), 1e-6) AS cap FROM q LEFT JOIN idf ON idf.term = q.term, n GROUP BY q.query),
m AS (SELECT s.query, s.doc, least(1.0, greatest(0.0, score / cap)) AS score FROM s JOIN c ON c.query = s.query), {_top('r', 'm', 5)}
SELECT query, doc, rank, round(score, 6) AS score FROM r
""")
def bm25_normalised(spark, sf_dir):
    t, q = _index(spark, sf_dir)
    return lexical.top(lexical.normalised(lexical.scores(q, t), lexical.caps(q, t)), 5).select("query", "doc", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"WITH {SCORES} {_scored('s0', 'idf')}, s AS (SELECT s0.* FROM s0 JOIN d ON d.doc = s0.doc WHERE lang IN ('fr', 'de')), {_top('r', 's', 5)} SELECT query, doc, rank, round(score / max(score) OVER (PARTITION BY query), 4) AS score FROM r QUALIFY r.score > 0")
def bm25_filtered(spark, sf_dir):
    from lodestone.operators.filters import matching

    t, q = _index(spark, sf_dir)
    ok = matching(table(spark, sf_dir, "documents"), {"lang": {"$in": ["fr", "de"]}}).select(F.col("doc_id").alias("doc"))
    return lexical.search(q, t, 5, ok).withColumn("rank", F.col("rank").cast("long"))


_KNN = """
v AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
c AS (SELECT a.vec_id AS query, b.vec_id AS doc, a.label AS ql, b.label AS dl, round(list_cosine_similarity(a.v, b.v), 9) AS cosine FROM v a, v b WHERE a.vec_id % 50 = 0 {}),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, doc) AS rank FROM c)"""


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"), "label")
    return e.where("doc % 50 = 0").withColumnRenamed("doc", "query"), e


@query(f"WITH {_KNN.format('')} SELECT query, doc, rank, round(greatest(0.0, (1 + cosine) / 2), 4) AS score FROM r WHERE rank <= 5")
def vector_topk(spark, sf_dir):
    q, e = _vectors(spark, sf_dir)
    return vectors.search(q, e, 5).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_KNN.format('AND a.label = b.label')} SELECT query, doc, rank, round(greatest(0.0, (1 + cosine) / 2), 4) AS score FROM r WHERE rank <= 5")
def vector_filtered(spark, sf_dir):
    q, e = _vectors(spark, sf_dir)
    q = q.withColumn("where", F.create_map(F.lit("label"), F.col("label").cast("string")))
    return vectors.search(q, e, 5, where="where", keys=("label",)).withColumn("rank", F.col("rank").cast("long"))


@query(f"""
WITH {SCORES.replace("(SELECT item_id AS query, unnest({}) AS term FROM benchmark)".format(WORDS.format('text')), "(SELECT doc_id AS query, unnest({}) AS term FROM documents JOIN embeddings ON vec_id = doc_id WHERE doc_id % 50 = 0)".format(WORDS.format('text')))} {_scored('s0', 'okapi')},
x AS (SELECT doc_id, lang, source FROM documents),
s AS (SELECT s0.query, s0.doc, s0.score FROM s0 JOIN x a ON a.doc_id = s0.query JOIN x b ON b.doc_id = s0.doc WHERE a.lang = b.lang AND a.source = b.source), {_top('l0', 's', 40)},
l AS (SELECT query, doc, rank FROM l0 WHERE score > 0),
v AS (SELECT vec_id, embedding::DOUBLE[] AS v, lang, source FROM embeddings JOIN x ON doc_id = vec_id),
c AS (SELECT a.vec_id AS query, b.vec_id AS doc, round(list_cosine_similarity(a.v, b.v), 9) AS score FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.lang = b.lang AND a.source = b.source), {_top('m', 'c', 40)},
f AS (SELECT query, doc, round(sum(w / (60 + rank)), 6) AS score FROM (SELECT query, doc, rank, 0.55 AS w FROM m UNION ALL SELECT query, doc, rank, 0.45 FROM l) GROUP BY query, doc)
SELECT query, doc, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM f) WHERE rank <= 40
""")
def hybrid_vector(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"))
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), "text", F.lit("").alias("law_number"), F.lit("").alias("article_no"), F.col("lang").alias("source_type"), F.col("source").alias("source_file"))
    index = retrieval.Index(chunks, e)
    wanted = F.map_filter(F.create_map(F.lit("source_type"), F.col("lang"), F.lit("source_file"), F.col("source")), lambda k, v: v.isNotNull())
    q = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query"), "text", wanted.alias("where")).join(e.withColumnRenamed("doc", "query"), "query")
    return retrieval.hybrid(index, q, 40).select("query", "doc", "score")


@query(f"""
WITH {_KNN.format('AND a.vec_id <> b.vec_id')},
f AS (SELECT query, min(CASE WHEN ql = dl THEN rank END) AS first FROM r WHERE rank <= 5 GROUP BY query)
SELECT count(*) AS n_queries, round(avg(coalesce(1.0 / first, 0)), 4) AS mrr, round(avg(CASE WHEN first <= 1 THEN 1 ELSE 0 END), 4) AS hit_at_1, round(avg(CASE WHEN first <= 3 THEN 1 ELSE 0 END), 4) AS hit_at_3, round(avg(CASE WHEN first <= 5 THEN 1 ELSE 0 END), 4) AS hit_at_5 FROM f
""")
def hit_mrr(spark, sf_dir):
    q, e = _vectors(spark, sf_dir)
    hits = vectors.knn(q, e, 5, skip_self=True).join(q.select("query", F.col("label").alias("ql")), "query").join(e.select("doc", "label"), "doc")
    return metrics.hit_metrics(q, hits.where("ql = label"), (1, 3, 5))


def _two_lists(spark, sf_dir):
    t, q = _index(spark, sf_dir)
    return [lexical.best(q, t, 20, v) for v in ("plus1", "okapi")], q


_LISTS = f"WITH {SCORES} {_scored('s1', 'idf')}, {_scored('s2', 'okapi')}, {_top('l1', 's1', 20)}, {_top('l2', 's2', 20)}"
_RRF = "x AS (SELECT query, doc, {} / (60 + rank) AS part FROM l1 UNION ALL SELECT query, doc, {} / (60 + rank) FROM l2), u AS (SELECT query, doc, round(sum(part), 6) AS score FROM x GROUP BY query, doc), "


@query(f"{_LISTS}, {_RRF.format(0.55, 0.45)} {_top('r', 'u', 10)} SELECT query, doc, rank, score FROM r")
def rrf_hybrid(spark, sf_dir):
    lists, _ = _two_lists(spark, sf_dir)
    return fusion.rrf(lists, [0.55, 0.45], 60, 10).select("query", "doc", F.col("rank").cast("long").alias("rank"), "score")


@query(f"{_LISTS}, {_RRF.format(1.0, 0.65)} {_top('r', 'u', 10)} SELECT query, doc, rank, score FROM r")
def variant_fusion(spark, sf_dir):
    lists, _ = _two_lists(spark, sf_dir)
    return fusion.variants(lists, 60, 10).select("query", "doc", F.col("rank").cast("long").alias("rank"), "score")


@query(f"""
WITH {SCORES} {_scored('s', 'idf')}, {_top('h', 's', 15)},
c AS (SELECT query, doc, rank AS base_rank, ((doc * 7919 + query) % 1000) / 1000.0 AS score FROM h),
b AS (SELECT *, count(*) OVER (PARTITION BY query) AS n, row_number() OVER (PARTITION BY query ORDER BY score DESC, base_rank) AS cross_rank FROM c),
m AS (SELECT *, round(0.3 * (1 - (base_rank - 1) / n) + 0.7 * (1 - (cross_rank - 1) / n), 6) AS blended FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY blended DESC, score DESC, base_rank) AS rank FROM m)
SELECT query, doc, rank, blended, round(score, 6) AS score, base_rank, cross_rank FROM r WHERE rank <= 5
""")
def rank_blend(spark, sf_dir):
    t, q = _index(spark, sf_dir)
    hits = lexical.top(lexical.scores(q, t), 15)
    cross = hits.select("query", "doc", (((F.col("doc") * 7919 + F.col("query")) % 1000) / 1000.0).alias("cross"))
    out = fusion.blend(hits, cross, 0.3)
    return out.select("query", "doc", "blended", "score", *(F.col(c).cast("long").alias(c) for c in ("rank", "base_rank", "cross_rank")))


@query(f"""
WITH {SCORES} {_scored('s', 'idf')}, {_top('h', 's', 3)},
o AS (SELECT item_id AS query, list_filter({WORDS.format('text')}, lambda w: length(w) >= 4 AND NOT list_contains({STOP}, w)) AS own FROM benchmark),
t AS (SELECT h.query, h.rank, list_filter(d.terms, lambda w: length(w) >= 4 AND NOT list_contains({STOP}, w)) AS ws FROM h JOIN d ON d.doc = h.doc),
u AS (SELECT query, rank, unnest(ws) AS term, generate_subscripts(ws, 1) AS place FROM t),
k AS (SELECT query, term, count(*) AS times, min(rank * 1000000 + place) AS seen FROM u GROUP BY query, term),
f AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY times DESC, seen) AS nth FROM k),
g AS (SELECT f.* FROM f JOIN o ON o.query = f.query WHERE nth <= 15 AND NOT list_contains(own, term)),
z AS (SELECT query, term, times, row_number() OVER (PARTITION BY query ORDER BY nth) AS nth FROM g)
SELECT query, term, times, nth FROM z WHERE nth <= 5
""")
def prf_terms(spark, sf_dir):
    t, q = _index(spark, sf_dir)
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    return fusion.feedback_terms(lexical.top(lexical.scores(q, t), 3), texts, q).withColumn("nth", F.col("nth").cast("long"))


@query()
def retrieve_batch(spark, sf_dir):
    """The whole retrieval pipeline: every benchmark item against all documents, sources standing for laws."""
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("law_number"), F.col("doc_id").cast("string").alias("article_no"), F.lit("laws").alias("source_type"))
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")
    return retrieval.retrieve(retrieval.Index(chunks), queries, 5)


@query(f"""
WITH RECURSIVE {SCORES} {_scored('s', 'idf')}, {_top('h', 's', 10)},
p AS (SELECT h.query, h.doc, h.score, {SQUEEZE.format("coalesce(text, '')")} AS body, lower({SQUEEZE.format("coalesce(text, '')")}) AS key, source FROM h JOIN documents ON documents.doc_id = h.doc),
g AS (SELECT *, row_number() OVER (PARTITION BY query, key ORDER BY score DESC, doc) AS nth FROM p WHERE key <> ''),
o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS i FROM g WHERE nth = 1),
f AS (SELECT DISTINCT query, 0::BIGINT AS i, 0::BIGINT AS used, 0::BIGINT AS taken FROM o
  UNION ALL SELECT f.query, o.i, CASE WHEN f.used + z.cost <= 1200 THEN f.used + z.cost ELSE f.used END, CASE WHEN f.used + z.cost <= 1200 THEN f.taken + 1 ELSE f.taken END
  FROM f JOIN o ON o.query = f.query AND o.i = f.i + 1, LATERAL (SELECT greatest(1, (length('[S' || (f.taken + 1) || '] ' || source || ' | Kanun ' || source || ' | Madde ' || o.doc || ' | Dosya unknown' || chr(10) || trim(left(o.body, 1500))) + 3) // 4) AS cost) z)
SELECT query, max_by(used, i) AS used, max_by(taken, i) AS n_sources, max(i) - max_by(taken, i) AS dropped FROM f GROUP BY query
""")
def context_pack(spark, sf_dir):
    t, q = _index(spark, sf_dir)
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("law_name"), F.col("source").alias("law_number"), F.col("doc_id").cast("string").alias("article_no"))
    got = answers.packed(lexical.best(q, t, 10), chunks, 1200)
    return got.select("query", *(c.cast("long").alias(n) for n, c in (("used", F.col("used")), ("n_sources", F.size("sources")), ("dropped", F.col("dropped")))))


@query("""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT * FROM v WHERE vec_id % 3 = 0),
c AS (SELECT a.vec_id AS query, x.vec_id AS entry, list_cosine_similarity(a.v, x.v) AS cosine FROM v a, x WHERE a.vec_id % 50 = 0 AND a.vec_id % 3 <> 0),
f AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(cosine, 9) DESC, entry) AS nth FROM c WHERE cosine >= 0.5)
SELECT query, 'answer ' || entry AS payload, round(cosine, 6) AS similarity, false AS exact FROM f WHERE nth = 1
UNION ALL SELECT vec_id, 'answer ' || vec_id, 1.0, true FROM v WHERE vec_id % 50 = 0 AND vec_id % 3 = 0
""")
def cache_lookup(spark, sf_dir):
    q, e = _vectors(spark, sf_dir)
    name = lambda c: F.concat(F.lit("question "), c.cast("string"))
    cache = e.where("doc % 3 = 0").select(F.col("doc").alias("entry"), name(F.col("doc")).alias("question"), F.lit(answers.CACHE_VERSION).alias("version"), F.concat(F.lit("answer "), F.col("doc").cast("string")).alias("payload"), F.col("doc").alias("created_at"))
    near = vectors.knn(q, e.where("doc % 3 = 0"), 5).select("query", F.col("doc").alias("entry"), "cosine")
    return answers.probe(q.select("query", name(F.col("query")).alias("text")), cache, near, 0.5)


# ---------------------------------------------------------------- graph

_ADJACENT = "a AS (SELECT 'law:' || source || '|article:' || doc_id AS src, 'law:' || source || '|article:' || lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS dst FROM documents), e AS (SELECT src, dst FROM a WHERE dst IS NOT NULL)"


def _articles(spark, sf_dir):
    return lawgraph.articles(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("law_number"), F.col("doc_id").cast("string").alias("article_no"), "text"))


@query(f"WITH {_ADJACENT} SELECT src, dst FROM e")
def adjacent_edges(spark, sf_dir):
    return lawgraph.adjacent(_articles(spark, sf_dir))


@query(f"""
WITH RECURSIVE {_ADJACENT}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
w AS (SELECT doc_id AS query, 'law:' || source || '|article:' || doc_id AS node, 0 AS distance FROM documents WHERE doc_id % 50 = 0
  UNION SELECT w.query, b.dst, w.distance + 1 FROM w JOIN b ON b.src = w.node WHERE w.distance < 2)
SELECT query, node, min(distance) AS distance FROM w GROUP BY query, node
""")
def bfs_two_hops(spark, sf_dir):
    arts = _articles(spark, sf_dir)
    starts = arts.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query"), "node")
    return lawgraph.within(starts, lawgraph.both_ways(lawgraph.adjacent(arts)), 2)


# ---------------------------------------------------------------- conversations


@query("""
WITH a AS (SELECT conv_id, turn, list_transform(regexp_extract_all(text || ' [S' || (turn % 4) || '] [S1]', '\\[S(\\d+)\\]', 1), lambda n: 'S' || n) AS labels FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, len(labels) AS cited, array_to_string(list_sort(list_filter(list_distinct(labels), lambda x: x NOT IN ('S1', 'S2'))), ',') AS invalid, len(list_filter(labels, lambda x: x NOT IN ('S1', 'S2'))) = 0 AS valid FROM a
""")
def citation_check(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    said = F.concat("text", F.lit(" [S"), (F.col("turn") % 4).cast("string"), F.lit("] [S1]"))
    rows = rows.select("conv_id", "turn", answers.cited_labels(said).alias("labels"), answers.citation_check(said, F.array(F.lit("S1"), F.lit("S2"))).alias("c"))
    return rows.select("conv_id", "turn", F.size("labels").cast("long").alias("cited"), F.array_join("c.invalid", ",").alias("invalid"), F.col("c.valid").alias("valid"))


_MARK = " OR ".join(f"contains(x, '{w}')" for w in querying.FOLLOW_UP)
_LAW = " OR ".join(f"contains(x, '{w}')" for w in querying.NEW_LAW)
_TURN_WORDS = "list_filter({}, lambda w: length(w) >= 4 AND w NOT IN (" + ", ".join(f"'{w}'" for w in querying.GENERIC) + "))"


def _turns(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", F.col("text").alias("question"), F.col("text").alias("answer"), F.when(F.col("turn") % 3 == 0, F.lit("unknown")).otherwise((F.col("conv_id") % 9000 + 100).cast("string")).alias("law_number"))


@query(f"""
WITH q AS (SELECT conv_id, turn, text, {NORMAL.format('text')} AS x, lag(text) OVER w AS previous, lag(CASE WHEN turn % 3 = 0 THEN NULL ELSE (conv_id % 9000 + 100)::VARCHAR END) OVER w AS law FROM conversations WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, coalesce(previous IS NOT NULL AND NOT ({_LAW}) AND (({_MARK}) OR list_has_any({_TURN_WORDS.format(WORDS.format('text'))}, {_TURN_WORDS.format(WORDS.format('previous'))})), false) AS related FROM q)
SELECT conv_id, turn, related, CASE WHEN related AND law IS NOT NULL THEN law || ' sayılı Kanun kapsamında: ' ELSE '' END || {SQUEEZE.format('text')} AS scoped FROM r
""")
def follow_up(spark, sf_dir):
    return answers.follow_ups(_turns(spark, sf_dir)).select("conv_id", "turn", "related", "scoped")


@query(f"""
WITH q AS (SELECT conv_id, turn, text, CASE WHEN turn % 3 = 0 THEN 'unknown' ELSE (conv_id % 9000 + 100)::VARCHAR END AS law, left({SQUEEZE.format("text")}, 700) AS said FROM conversations WHERE role = 'user'),
m AS (SELECT conv_id, turn, list({{'q': text, 'l': law, 'a': said}}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS h FROM q)
SELECT conv_id, turn, sha256(coalesce(array_to_string(list_transform(h, lambda s, i: 'Tur ' || i || ' | Konu: ' || s.q || chr(10) || 'Kanun: ' || s.l || chr(10) || 'Önceki cevap özeti: ' || s.a), chr(10) || chr(10)), '')) AS memory FROM m
""")
def turn_memory(spark, sf_dir):
    return answers.follow_ups(_turns(spark, sf_dir)).select("conv_id", "turn", F.sha2(F.coalesce("memory", F.lit("")), 256).alias("memory"))


_QUESTION = """CASE turn % 6 WHEN 0 THEN '5271/100 nedir' WHEN 1 THEN 'TCK hangi maddede ' || text WHEN 2 THEN text || ' arasındaki ilişki' WHEN 3 THEN 'usulsüzlük cezası ' || text WHEN 4 THEN 'yönetmelik değişikliği 4857 sayılı' ELSE text END"""


def _questions(spark, sf_dir):
    t, whole = F.col("turn"), F.col("text")
    said = F.when(t % 6 == 0, "5271/100 nedir").when(t % 6 == 1, F.concat(F.lit("TCK hangi maddede "), whole)).when(t % 6 == 2, F.concat(whole, F.lit(" arasındaki ilişki"))).when(t % 6 == 3, F.concat(F.lit("usulsüzlük cezası "), whole)).when(t % 6 == 4, "yönetmelik değişikliği 4857 sayılı").otherwise(whole)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("q"))


def _contains(words) -> str:
    return "(" + " OR ".join(f"contains(x, '{w}')" for w in words) + ")"


@query(f"""
WITH q AS (SELECT conv_id, turn, {_QUESTION} AS q FROM conversations), n AS (SELECT *, {NORMAL.format('q')} AS x FROM q),
c AS (SELECT *, coalesce(nullif(regexp_extract(q, '\\b(\\d{{2,4}})\\s*/\\s*(\\d+)\\b', 1), ''), nullif(regexp_extract(q, '\\b(\\d{{2,4}})\\b\\s*(?:sayılı|sayili)', 1), ''), CASE {" ".join(f"WHEN contains(x, '{a}') THEN '{v}'" for a, v in querying.ALIASES)} END) AS law_number,
  nullif(regexp_extract(q, '\\b(\\d{{2,4}})\\s*/\\s*(\\d+)\\b', 2), '') AS article_no FROM n)
SELECT conv_id, turn, law_number, article_no, CASE WHEN law_number IS NOT NULL AND article_no IS NOT NULL THEN 'exact_citation' WHEN {_contains(querying.ARTICLE_WORDS)} THEN 'article_lookup' WHEN {_contains(querying.RELATION_WORDS)} THEN 'legal_relationship' WHEN {_contains(querying.LEGAL_WORDS)} THEN 'lexical_legal_lookup' ELSE 'semantic_hybrid' END AS plan FROM c
""")
def router_plan(spark, sf_dir):
    rows = _questions(spark, sf_dir).withColumn("c", querying.citation(F.col("q")))
    return rows.select("conv_id", "turn", "c.law_number", "c.article_no", querying.plan(F.col("q"), F.col("c"))["name"].alias("plan"))


@query(f"""
WITH q AS (SELECT conv_id, turn, {_QUESTION} AS q FROM conversations), n AS (SELECT *, {NORMAL.format('q')} AS x FROM q)
SELECT conv_id, turn, CASE WHEN {_contains(querying.AMENDMENT_WORDS)} THEN NULL WHEN {_contains(querying.REGULATION_WORDS)} THEN 'regulations' ELSE 'laws' END AS scope FROM n
""")
def source_policy(spark, sf_dir):
    return _questions(spark, sf_dir).select("conv_id", "turn", querying.source_scope(F.col("q")).alias("scope"))


# ---------------------------------------------------------------- measures


@query("SELECT event_type, count(value) AS n, round(avg(value), 3) AS mean, round(quantile_cont(value, 0.5), 3) AS p50, round(quantile_cont(value, 0.95), 3) AS p95, round(quantile_cont(value, 0.99), 3) AS p99 FROM events GROUP BY event_type")
def latency_linear(spark, sf_dir):
    return metrics.latency(table(spark, sf_dir, "events"), "value", ["event_type"])


@query("""
WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(n) AS n, round(sum(value) / max(n), 2) AS mean_ms, round(max(CASE WHEN i = round_even(0.5 * (n - 1), 0) THEN value END), 2) AS p50_ms, round(max(CASE WHEN i = round_even(0.95 * (n - 1), 0) THEN value END), 2) AS p95_ms, round(max(value), 2) AS max_ms FROM o GROUP BY event_type
""")
def latency_nearest(spark, sf_dir):
    return metrics.latency_nearest(table(spark, sf_dir, "events"), "value", ["event_type"])


_PREDICTED = "p AS (SELECT quality::VARCHAR AS t, CASE WHEN n_chars > 700 THEN '1' WHEN n_chars > 300 THEN '0' ELSE '2' END AS p FROM labels JOIN documents ON documents.doc_id = labels.doc_id), c AS (SELECT unnest(['0', '1', '2', '3']) AS code)"
_REPORT = """s AS (SELECT code AS label, (SELECT count(*) FROM p WHERE t = code AND p.p = code) AS tp, (SELECT count(*) FROM p WHERE t = code) AS s, (SELECT count(*) FROM p WHERE p.p = code) AS g FROM c),
f AS (SELECT label, s, CASE WHEN g > 0 THEN tp / g ELSE 0.0 END AS pr, CASE WHEN s > 0 THEN tp / s ELSE 0.0 END AS re FROM s),
r AS (SELECT label, round(pr, 4) AS precision, round(re, 4) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0 END, 4) AS f1, s AS support FROM f)"""


def _predictions(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.select(F.col("quality").cast("string").alias("true"), F.when(F.col("n_chars") > 700, "1").when(F.col("n_chars") > 300, "0").otherwise("2").alias("predicted")), metrics.classes(spark, ("0", "1", "2", "3"))


@query(f"WITH {_PREDICTED} SELECT a.code AS true_label, b.code AS predicted, (SELECT count(*) FROM p WHERE t = a.code AND p.p = b.code) AS n FROM c a, c b")
def confusion(spark, sf_dir):
    return metrics.confusion(*_predictions(spark, sf_dir)).withColumnRenamed("true", "true_label")


@query(f"WITH {_PREDICTED}, {_REPORT} SELECT label, precision, recall, f1, support FROM r")
def per_class_prf(spark, sf_dir):
    return metrics.class_report(*_predictions(spark, sf_dir))


@query(f"""WITH {_PREDICTED}, {_REPORT} SELECT (SELECT count(*) FROM p) AS n_examples, (SELECT round(avg(CASE WHEN t = p.p THEN 1 ELSE 0 END), 4) FROM p) AS accuracy, round(avg(CASE WHEN support > 0 THEN f1 END), 4) AS macro_f1, round(avg(f1), 4) AS macro_f1_all, round(sum(f1 * support) / sum(support), 4) AS weighted_f1 FROM r""")
def f1_summary(spark, sf_dir):
    p, c = _predictions(spark, sf_dir)
    return metrics.summary(p, metrics.class_report(p, c))


@query("""
WITH c AS (SELECT unnest(['de', 'en', 'es', 'fr', 'tr']) AS label), n AS (SELECT label, (SELECT count(*) FROM documents WHERE lang = label) AS n FROM c)
SELECT label, n, round(n / sum(n) OVER (), 4) AS share, n > 0 AND n < 20 AS minority, n = 0 AS unsupported FROM n
""")
def class_distribution(spark, sf_dir):
    return metrics.distribution(table(spark, sf_dir, "documents"), "lang", metrics.classes(spark, ("de", "en", "es", "fr", "tr")))


@query("""
WITH n AS (SELECT quality, count(*) FILTER (WHERE toxic = 0) AS r, count(*) FILTER (WHERE toxic = 1) AS s FROM labels GROUP BY quality),
k AS (SELECT quality, round_even(r * 0.15, 0)::BIGINT AS t, r, s FROM n)
SELECT * FROM (SELECT quality, 'test' AS split, t AS n FROM k UNION ALL SELECT quality, 'val', t FROM k UNION ALL SELECT quality, 'train', r - 2 * t + s FROM k) WHERE n > 0
""")
def stratified_split_sizes(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").withColumn("made_up", F.col("toxic") == 1)
    return metrics.split(rows, "quality", "doc_id", synthetic="made_up").groupBy("quality", "split").agg(F.count("*").alias("n"))


@query("""
WITH x AS (SELECT unnest([event_type, 'all']) AS tag, value > 50 AS ok FROM events), t AS (SELECT DISTINCT event_type AS tag FROM events UNION SELECT 'all' UNION SELECT 'never')
SELECT t.tag, count(x.tag) AS n, round(avg(x.ok::INT), 4) AS accuracy FROM t LEFT JOIN x ON x.tag = t.tag GROUP BY t.tag
""")
def tag_breakdown(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("tags", F.array("event_type", F.lit("all")))
    known = e.select(F.col("event_type").alias("tag")).distinct().unionByName(spark.createDataFrame([("all",), ("never",)], "tag string"))
    return metrics.by_tag(e, "tags", F.col("value") > 50, known)


# ---------------------------------------------------------------- corpus, routing, workflow, pages


@query("""
WITH n AS (SELECT source || '/' || doc_id AS f, sha256(coalesce(text, '')) AS h FROM documents WHERE doc_id % 10 <> 0), o AS (SELECT source || '/' || doc_id AS f, CASE WHEN doc_id % 11 = 0 THEN 'old' ELSE sha256(coalesce(text, '')) END AS h FROM documents WHERE doc_id % 7 <> 0)
SELECT coalesce(n.f, o.f) AS source_file, CASE WHEN n.f IS NULL THEN 'removed' ELSE 'changed' END AS change FROM n FULL OUTER JOIN o ON n.f = o.f WHERE n.f IS NULL OR o.f IS NULL OR n.h <> o.h
""")
def manifest_diff(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("source_file"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    old = d.where("doc_id % 7 <> 0").withColumn("sha256", F.when(F.col("doc_id") % 11 == 0, "old").otherwise(F.col("sha256")))
    return corpus.manifest_diff(d.where("doc_id % 10 <> 0"), old)


def _case(stage: str, column: str) -> str:
    p, nxt = workflow.POLICIES[stage], workflow.following(stage)
    say = lambda v: "NULL" if v is None else f"'{v}'"
    good = ("complete", None) if nxt is None else ("continue", nxt)
    bad = ("skip", nxt) if p.fallback == "skip" else ("terminate", None)
    k = 0 if column == "action" else 1
    rag = f"WHEN ok AND NOT rag THEN {say(('continue', 'summary')[k])} " if stage == "validation" else ""
    return f"WHEN '{stage}' THEN CASE {rag}WHEN ok THEN {say(good[k])} WHEN retries < {p.retries} THEN {say(('retry', stage)[k])} ELSE {say(bad[k])} END"


@query(f"""
WITH e AS (SELECT event_id, [{", ".join(f"'{s}'" for s in workflow.STAGES)}][event_id % 8 + 1] AS stage, value > 20 AS ok, user_id % 2 AS retries, user_id % 3 <> 0 AS rag FROM events)
SELECT event_id, stage, CASE stage {" ".join(_case(s, "action") for s in workflow.STAGES)} END AS action, CASE stage {" ".join(_case(s, "next") for s in workflow.STAGES)} END AS next FROM e
""")
def workflow_decisions(spark, sf_dir):
    stages = F.array(*map(F.lit, workflow.STAGES))
    e = table(spark, sf_dir, "events").select("event_id", F.get(stages, (F.col("event_id") % 8).cast("int")).alias("stage"), F.when(F.col("value") > 20, "success").otherwise("failed").alias("status"), (F.col("user_id") % 2).alias("retries"), (F.col("user_id") % 3 != 0).alias("rag"))
    return e.select("event_id", "stage", workflow.after(F.col("stage"), F.col("status"), F.col("retries"), F.col("rag")).alias("d")).select("event_id", "stage", "d.action", "d.next")


@query("""
WITH e AS (SELECT event_id, least(1.0, value / 100) AS m, (user_id % 10) / 10.0 AS low, event_type <> 'error' AS has, event_id % 13 = 0 AS bad, event_id % 17 = 0 AS poor, event_id % 3 AS attempt FROM events)
SELECT event_id, CASE WHEN has AND m >= 0.6 AND low < 0.3 AND NOT bad THEN 'accept' WHEN bad AND m >= 0.6 THEN 'fallback' WHEN attempt < 2 THEN 'retry' WHEN m < 0.4 OR bad OR poor OR NOT has OR m < 0.6 OR low >= 0.3 THEN 'fallback' ELSE 'give_up' END AS decision FROM e
""")
def page_decision(spark, sf_dir):
    i = F.col("event_id")
    d = layout.decision(F.least(F.lit(1.0), F.col("value") / 100), (F.col("user_id") % 10) / 10.0, F.col("event_type") != "error", i % 13 == 0, i % 17 == 0, i % 3)
    return table(spark, sf_dir, "events").select("event_id", d.alias("decision"))


def _states(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    words = ("izin talebi", "dava açma", "yol bozuk", "vergi borcu", "ağaç budama", "genel")
    said = F.get(F.array(*map(F.lit, words)), (F.col("doc_id") % 6).cast("int"))
    none = F.lit(None).cast("string")
    return d.select(
        F.col("doc_id").alias("state_id"), F.concat_ws(" ", said, "text").alias("document_text"), none.alias("summary"), said.alias("intent"), none.alias("requested_action"), said.alias("topic"), F.array(F.lit("yol onarımı")).alias("subtopics"),
        F.lit("Belediye").alias("institution"), none.alias("recipient"), F.array().cast("array<string>").alias("entities"), F.array().cast("array<string>").alias("legal_references"), F.array().cast("array<map<string,string>>").alias("previous_correspondence"),
    )


@query()
def route_documents(spark, sf_dir):
    """Every document routed to a department, with all signals."""
    got = routing.route(_states(spark, sf_dir), routing.KnowledgeBase(routing.DEPARTMENTS))
    return got.select("state_id", "label", "status", "department", "channel", F.round("total", 6).alias("total"), "confidence", "needs_human_review")


def _phrase_sql(p: str) -> str:
    words = sorted(set(routing._split(p)))
    return f"(CASE WHEN contains(x, '{p}') OR len(list_filter([{', '.join(repr(w) for w in words)}], lambda v: NOT list_contains(ws, v))) = 0 THEN 1 ELSE 0 END)"


@query(f"""
WITH s AS (SELECT doc_id, lower(['izin talebi', 'dava açma', 'yol bozuk', 'vergi borcu', 'ağaç budama', 'genel'][doc_id % 6 + 1] || ' ' || text) AS x FROM documents),
w AS (SELECT doc_id, trim(x) AS x, list_filter(regexp_extract_all(x, '[a-zA-ZçğıöşüÇĞİÖŞÜ0-9]+'), lambda v: length(v) > 1 AND v NOT IN ({", ".join(f"'{v}'" for v in text.ROUTING_STOPWORDS)})) AS ws FROM s)
{" UNION ALL ".join(f"SELECT doc_id, '{d.id}' AS department, round(({' + '.join(_phrase_sql(k) for k in d.keywords + d.topics)}) / {len(d.keywords + d.topics)}.0, 6) AS keyword FROM w" for d in routing.DEPARTMENTS)}
""")
def route_scores(spark, sf_dir):
    s = _states(spark, sf_dir).select(F.col("state_id").alias("doc_id"), F.lower(F.trim("document_text")).alias("x"), routing.routing_tokens(F.col("document_text")).alias("ws"))
    each = F.array(*(F.struct(F.lit(d.id).alias("department"), F.round(routing.share(d.keywords + d.topics, F.col("x"), F.col("ws")), 6).alias("keyword")) for d in routing.DEPARTMENTS))
    return s.select("doc_id", F.explode(each).alias("d")).select("doc_id", "d.department", "d.keyword")


LAW_TEXT = "Örnek Kanunu\n\nAmaç\n\nMadde 1 - " + "Bu maddenin amacı örnek vermektir. " * 30 + "\n\n[[RAG_PAGE:2]]\n\nKapsam\n\nMadde 2 – " + " ".join(f"{c}) " + "Bent metni burada yer alır. " * 12 for c in "abc") + "\n\nEk Madde 1 - Ek hüküm bu kanunla birlikte uygulanır ve yürürlüktedir.\n\nDEĞİŞİKLİKLER CETVELİ ..."


@query()
def chunk_articles(spark, sf_dir):
    """A fixture law, and every document, cut into chunks."""
    law = spark.createDataFrame([("4857_ornek.txt", LAW_TEXT)], "source_file string, text string")
    docs = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_file"), "text")
    return chunker.split(law.unionByName(docs)).select("source_file", "chunk_id", "article_no", "article_type", "chunk_index", "chunk_length", "page_start", "page_end")


@query("SELECT page_id, len(regexp_extract_all(html, '(?is)<a[^>]*>(.*?)</a>')) AS links, length(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))) AS chars FROM pages")
def html_text(spark, sf_dir):
    plain = text.squeeze(F.regexp_replace("html", "<[^>]+>", " "))
    return table(spark, sf_dir, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit(r"(?is)<a[^>]*>(.*?)</a>"), F.lit(1))).cast("long").alias("links"), F.length(plain).cast("long").alias("chars"))
