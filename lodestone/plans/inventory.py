"""More of the catalogue: corpus handling, questions, evaluation sets and page parts, each with its DuckDB counterpart.

Inputs that the tables do not have (paths, uploads, predictions) are made from their columns, by the same rule on both sides, for every row.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import metrics, querying
from lodestone.plans.catalogue import NORMAL, SQUEEZE, WORDS, query, table
from lodestone.sources import corpus


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _pick(words, key):
    return F.get(F.array(*map(F.lit, words)), key.cast("int"))


def _name(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


# ---------------------------------------------------------------- questions

_FOLDED = "translate(coalesce(text, ''), 'çğıöşüÇĞİÖŞÜ' || chr(775), 'cgiosuCGIOSU')"


@query(f"""
SELECT item_id, len(t) AS n, array_to_string(list_sort(t), ' ') AS words FROM (SELECT item_id, list_distinct(list_filter({WORDS.format(_FOLDED)},
  lambda w: length(w) >= 3 AND NOT regexp_full_match(w, '[0-9]+') AND NOT list_contains({_list(text.TITLE_WORDS)}, w))) AS t FROM benchmark)
""")
def title_words(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", text.title_tokens(F.col("text")).alias("t"))
    return rows.select("item_id", F.size("t").cast("long").alias("n"), F.array_join(F.array_sort("t"), " ").alias("words"))


_OPENINGS = ("ihbar ve fesih süresi", "yıllık izin", "tazminat hakkı ve kıdem", "genel")
_MORE = ", ".join(f"CASE WHEN contains(low, '{k}') THEN list_filter({_list(v)}, lambda v: NOT contains(low, lower(v))) ELSE []::VARCHAR[] END" for k, v in querying.SYNONYMS)


@query(f"""
WITH q AS (SELECT conv_id, turn, {_list(_OPENINGS)}[turn % 4 + 1] || ' ' || coalesce(text, '') AS q FROM conversations), l AS (SELECT *, lower(q) AS low FROM q),
m AS (SELECT *, flatten([{_MORE}])[1:4] AS more FROM l)
SELECT conv_id, turn, len(more) AS n, sha256(CASE WHEN len(more) > 0 THEN trim(q) || ' ' || array_to_string(more, ' ') ELSE q END) AS expanded FROM m
""")
def synonym_queries(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(" ", _pick(_OPENINGS, F.col("turn") % 4), F.coalesce("text", F.lit(""))).alias("q"))
    c = c.withColumn("x", querying.with_synonyms(F.col("q")))
    none = [F.when(F.lower("q").contains(k), F.size(F.filter(F.array(*map(F.lit, v)), lambda t: ~F.lower("q").contains(F.lower(t))))).otherwise(0) for k, v in querying.SYNONYMS]
    return c.select("conv_id", "turn", F.least(F.lit(4), sum(none[1:], none[0])).cast("long").alias("n"), F.sha2("x", 256).alias("expanded"))


@query("""
WITH q AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN coalesce(text, '') || ' 12. maddesi nedir' WHEN 1 THEN 'Madde 7 ' || coalesce(text, '') ELSE coalesce(text, '') END AS q FROM conversations),
a AS (SELECT *, coalesce(nullif(regexp_extract(q, '(?i)(\\d+)\\.\\s*maddes', 1), ''), nullif(regexp_extract(q, '(?:Madde|madde|MADDE|m\\.)\\s+(\\d+)', 1), '')) AS n FROM q)
SELECT conv_id, turn, CASE WHEN n IS NULL THEN 1 ELSE 2 END::BIGINT AS searches, sha256(coalesce('Madde ' || n, q)) AS last FROM a
""")
def article_searches(spark, sf_dir):
    t, said = F.col("turn"), F.coalesce("text", F.lit(""))
    q = F.when(t % 3 == 0, F.concat(said, F.lit(" 12. maddesi nedir"))).when(t % 3 == 1, F.concat(F.lit("Madde 7 "), said)).otherwise(said)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", querying.with_article(q).alias("a"))
    return rows.select("conv_id", "turn", F.size("a").cast("long").alias("searches"), F.sha2(F.element_at("a", -1), 256).alias("last"))


_SERVICE = ("vergi borcumu nerede sorgularım", "e-devlet üzerinden başvuru", "hangi site kullanılır", "madde metni")


@query(f"SELECT conv_id, turn, regexp_matches({NORMAL.format('q')}, '{querying.SERVICE}') AS service FROM (SELECT conv_id, turn, {_list(_SERVICE)}[turn % 4 + 1] || ' ' || coalesce(text, '') AS q FROM conversations)")
def service_questions(spark, sf_dir):
    q = F.concat_ws(" ", _pick(_SERVICE, F.col("turn") % 4), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", querying.asks_for_service(q).alias("service"))


@query(f"""
SELECT conv_id, turn, sha256(trim(concat_ws(' ', CASE WHEN turn % 2 = 0 THEN conv_id || ' sayılı kanun' END, 'madde ' || turn, {SQUEEZE.format("coalesce(text, '')")}))) AS question FROM conversations
""")
def contract_questions(spark, sf_dir):
    law = F.when(F.col("turn") % 2 == 0, F.col("conv_id").cast("string"))
    q = corpus.contract_query(F.coalesce("text", F.lit("")), law, F.col("turn").cast("string"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(q, 256).alias("question"))


# ---------------------------------------------------------------- corpora

_FOLDERS = ("laws", "regulations", "drafts")
_FILES = ("README.md", ".hidden.txt", "a.meta.json", "law.txt", "rule.md")


@query(f"""
WITH p AS (SELECT doc_id, '/data/' || {_list(_FOLDERS)}[doc_id % 3 + 1] || '/' || doc_id || '/' || {_list(_FILES)}[doc_id % 5 + 1] AS path, doc_id % 3 AS f, doc_id % 5 AS n FROM documents)
SELECT doc_id, {_list(_FILES)}[n + 1] AS name, ['README', '.hidden', 'a.meta', 'law', 'rule'][n + 1] AS stem, CASE f WHEN 2 THEN 'unknown' WHEN 0 THEN 'laws' ELSE 'regulations' END AS bucket, n > 2 AS kept FROM p
""")
def bucket_tags(spark, sf_dir):
    i = F.col("doc_id")
    path = F.concat(F.lit("/data/"), _pick(_FOLDERS, i % 3), _name("/", i, "/"), _pick(_FILES, i % 5))
    rows = table(spark, sf_dir, "documents").select("doc_id", path.alias("p"))
    p = F.col("p")
    return rows.select("doc_id", corpus.name_of(p).alias("name"), corpus.stem_of(p).alias("stem"), corpus.bucket_of(p, {"laws": "/data/laws", "regulations": "/data/regulations"}).alias("bucket"), corpus.kept(p).alias("kept"))


@query("""
WITH p AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), u AS (SELECT doc_id, octet_length(b) AS size, doc_id % 4 AS k FROM p)
SELECT doc_id, size AS bytes, concat_ws(',', CASE WHEN k = 1 OR k = 3 THEN 'unsupported_type' END, CASE WHEN size <= 0 THEN 'empty_file' END, CASE WHEN size > 2000 THEN 'file_too_large' END) AS errors FROM u
""")
def upload_checks(spark, sf_dir):
    k = F.col("doc_id") % 4
    name, mime = F.when(k == 0, "a.PDF").when(k == 1, "a.exe").otherwise("a.bin"), F.when(k == 2, "Image/PNG").when(k == 3, "text/html")
    rows = table(spark, sf_dir, "documents").select("doc_id", corpus.decoded_size(F.base64(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))).alias("bytes"), name.alias("n"), mime.alias("m"))
    return rows.select("doc_id", "bytes", F.array_join(corpus.upload_errors(F.col("n"), F.col("m"), F.col("bytes"), most=2000), ",").alias("errors"))


@query("""
WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN '' ELSE lang END AS law_name FROM documents),
s AS (SELECT p_partkey AS id, p_brand AS law_name, 'tr-' || p_size AS language FROM part WHERE p_partkey % 2 = 0)
SELECT doc_id, coalesce(nullif(nullif(trim(d.law_name), 'unknown'), ''), s.law_name, 'unknown') AS law_name, 'unknown' AS law_number, coalesce(s.language, 'tr') AS language, CASE WHEN s.id IS NULL THEN '' ELSE 'a,b' END AS tags
FROM d LEFT JOIN s ON s.id = doc_id
""")
def sidecar_fill(spark, sf_dir):
    i, none = F.col("doc_id"), F.lit(None).cast("string")
    docs = table(spark, sf_dir, "documents").select("doc_id", _name(i, ".txt").alias("source_file"), F.when(i % 3 == 0, "unknown").when(i % 3 == 1, "").otherwise(F.col("lang")).alias("law_name"))
    side = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").cast("string").alias("stem"), F.col("p_brand").alias("law_name"), F.lit("unknown").alias("law_number"), none.alias("effective_date"), none.alias("source_type"), _name("tr-", F.col("p_size")).alias("language"), F.array(F.lit("a"), F.lit("b")).alias("tags"), none.alias("notes"))
    return corpus.with_sidecars(docs, side).select("doc_id", "law_name", "law_number", "language", "tags")


@query("""
WITH n AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents), o AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'old' ELSE h END AS h FROM n WHERE doc_id % 7 <> 0)
SELECT n.doc_id FROM n LEFT JOIN o ON n.doc_id = o.doc_id WHERE o.h IS NULL OR o.h <> n.h
""")
def changed_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("source_file"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    old = d.where("doc_id % 7 <> 0").withColumn("sha256", F.when(F.col("doc_id") % 11 == 0, "old").otherwise(F.col("sha256")))
    return corpus.changed_only(d, corpus.manifest_diff(d, old)).select("doc_id")


@query("""
WITH p AS (SELECT conv_id, turn, '[[RAG_PAGE:' || (turn + 1) || ']]' || chr(10) || nullif(text, '') AS part FROM conversations)
SELECT conv_id, sha256(coalesce(string_agg(part, chr(10) || chr(10) ORDER BY turn, part), '')) AS digest, min(turn) + 1 AS page_start, max(turn) + 1 AS page_end, max(CASE WHEN part IS NOT NULL THEN turn END) + 1 AS last_page FROM p GROUP BY conv_id
""")
def merged_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("source"), F.col("turn").alias("page"), "text")
    m = corpus.merge_pages(pages)
    last = corpus.page_at(F.col("text"), F.length("text"))
    return m.select(F.col("source").alias("conv_id"), F.sha2("text", 256).alias("digest"), F.col("page_start").cast("long").alias("page_start"), F.col("page_end").cast("long").alias("page_end"), last.cast("long").alias("last_page"))


@query("SELECT d.doc_id::VARCHAR AS stem, '/in/' || d.doc_id || '.pdf' AS pdf_path, '/ocr/' || l.doc_id || '.json' AS ocr_json_path FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def pdf_pairs(spark, sf_dir):
    pdfs = table(spark, sf_dir, "documents").select(_name("/in/", F.col("doc_id"), ".pdf").alias("path"))
    return corpus.paired(pdfs, table(spark, sf_dir, "labels").select(_name("/ocr/", F.col("doc_id"), ".json").alias("path")))


@query("""
SELECT '/in/' || upper(lang) || '/' || CASE WHEN doc_id % 5 = 0 THEN 'synthetic_' ELSE 'scan_' END || doc_id || '.pdf' AS path, CASE lang WHEN 'en' THEN 'letter' WHEN 'de' THEN 'form' END AS label, doc_id % 5 = 0 AS is_synthetic FROM documents WHERE lang IN ('en', 'de')
""")
def folder_labels(spark, sf_dir):
    i = F.col("doc_id")
    path = F.concat(F.lit("/in/"), F.upper("lang"), F.lit("/"), F.when(i % 5 == 0, "synthetic_").otherwise("scan_"), _name(i, ".pdf"))
    return corpus.class_folders(table(spark, sf_dir, "documents").select(path.alias("path")), {"en": "letter", "de": "form"})[0].select("path", "label", "is_synthetic")


_PAYLOADS = ('{"ocr": {}}', '{"pages": []}', '{"question": "a"}', '{"other": 1}', "{broken")


@query(f"""
SELECT event_id, ['state', 'index', 'query', NULL, NULL][event_id % 5 + 1] AS kind, [NULL, NULL, NULL, 'unknown_request', 'invalid_json'][event_id % 5 + 1] AS error FROM events
""")
def dispatch_kinds(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", _pick(_PAYLOADS, F.col("event_id") % 5).alias("payload"))
    return corpus.dispatch(rows).select("event_id", "kind", "error")


# ---------------------------------------------------------------- measures

_MEANS = "round(avg({}), 3) AS {}"


@query(f"""
WITH r AS (SELECT event_id % 5 <> 0 AS able, value > 30 AS grounded, user_id % 3 <> 0 AS found, (user_id % 10) / 10.0 AS prec, value FROM events)
SELECT round(avg(CASE WHEN able THEN (grounded AND found)::INT END), 3) AS answer_correct, round(avg(CASE WHEN able THEN prec::DOUBLE END), 3) AS citation_precision, round(avg(CASE WHEN NOT able THEN grounded::INT END), 3) AS hallucination_rate,
  {_MEANS.format('value', 'mean_retrieval_ms')}, {_MEANS.format('value * 2', 'mean_generation_ms')}, {_MEANS.format('value * 3', 'mean_total_ms')} FROM r
""")
def answer_means(spark, sf_dir):
    v, u = F.col("value"), F.col("user_id")
    rows = table(spark, sf_dir, "events").select((F.col("event_id") % 5 != 0).alias("answerable"), (v > 30).alias("grounded"), (u % 3 != 0).alias("expected_found"), (u % 10 / 10.0).alias("citation_precision"), v.alias("retrieval_ms"), (v * 2).alias("generation_ms"), (v * 3).alias("total_ms"))
    return metrics.answer_benchmark(rows)


_RANKED = ("legal", "staff", "works", "finance")


@query(f"""
WITH r AS (SELECT list_position({_list(_RANKED)}, {_list((*_RANKED, 'green'))}[event_id % 5 + 1]) AS place, value > 80 AS conflict, user_id % 7 = 0 AS expect_conflict, value < 10 AS ambiguous, user_id % 9 = 0 AS expect_ambiguous, CASE WHEN value > 50 THEN 'HIGH' ELSE 'LOW' END AS confidence, user_id % 2 = 0 AS same FROM events)
SELECT round(avg((coalesce(place, 0) = 1)::INT), 4) AS top1, round(avg((coalesce(place, 0) BETWEEN 1 AND 3)::INT), 4) AS top3, round(avg(CASE WHEN place > 0 THEN 1.0 / place ELSE 0 END), 4) AS mrr, round(avg(same::INT), 4) AS authority,
  round(avg((conflict = expect_conflict)::INT), 4) AS conflict, round(avg((ambiguous = expect_ambiguous)::INT), 4) AS ambiguity, round(avg((NOT (confidence = 'HIGH') OR coalesce(place, 0) = 1)::INT), 4) AS calibration FROM r
""")
def routing_means(spark, sf_dir):
    v, u = F.col("value"), F.col("user_id")
    rows = table(spark, sf_dir, "events").select(
        _pick((*_RANKED, "green"), F.col("event_id") % 5).alias("expected"), F.array(*map(F.lit, _RANKED)).alias("ranked"), (v > 80).alias("conflict"), (u % 7 == 0).alias("expect_conflict"), (v < 10).alias("ambiguous"), (u % 9 == 0).alias("expect_ambiguous"),
        F.when(v > 50, "HIGH").otherwise("LOW").alias("confidence"), F.lit("DAIRE").alias("authority"), F.when(u % 2 == 0, "DAIRE").otherwise("MUSAVIRLIK").alias("expect_authority"),
    )
    return metrics.routing_benchmark(rows)


# the mean of values of four places often ends in a 5, which is rounded up on both sides
@query("""
WITH p AS (SELECT 'v' || i AS variant, quality::VARCHAR AS yt, CASE WHEN (doc_id + i) % 3 = 0 THEN '1' ELSE '0' END AS yp, CASE WHEN (doc_id + i) % 11 = 0 THEN 'timeout' END AS error FROM labels, range(3) r(i)),
g AS (SELECT * FROM p WHERE error IS NULL),
x AS (SELECT variant, yt AS label, (yt = yp)::INT AS tp, (yt <> yp)::INT AS fn, 0 AS fp FROM g UNION ALL SELECT variant, yp, 0, 0, (yt <> yp)::INT FROM g),
k AS (SELECT variant, label, sum(tp) AS tp, sum(fn) AS fn, sum(fp) AS fp FROM x WHERE label IN ('0', '1', '2') GROUP BY variant, label),
m AS (SELECT variant, floor(avg(coalesce(round(2.0 * tp / nullif(2 * tp + fn + fp, 0), 4), 0)) * 10000 + 0.5 + 1e-7) / 10000 AS macro_f1 FROM k WHERE tp + fn > 0 GROUP BY variant),
b AS (SELECT variant, count(*) AS n, count(error) AS errors, round(avg(CASE WHEN error IS NULL THEN (yt = yp)::INT END), 4) AS accuracy FROM p GROUP BY variant),
v AS (SELECT unnest(['v0', 'v1', 'v2', 'idle']) AS variant)
SELECT v.variant, coalesce(n, 0) AS n, coalesce(errors, 0) AS errors, accuracy, macro_f1 FROM v LEFT JOIN b ON b.variant = v.variant LEFT JOIN m ON m.variant = v.variant
""")
def ablation_grid(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").withColumn("i", F.explode(F.array(*map(F.lit, range(3)))))
    turn = F.col("doc_id") + F.col("i")
    p = rows.select(_name("v", F.col("i")).alias("variant"), F.col("quality").cast("string").alias("true"), F.when(turn % 3 == 0, "1").otherwise("0").alias("predicted"), F.when(turn % 11 == 0, "timeout").alias("error"))
    return metrics.ablation(spark.createDataFrame([("v0",), ("v1",), ("v2",), ("idle",)], "variant string"), p, metrics.classes(spark, ("0", "1", "2")))


@query("""
WITH c AS (SELECT doc_id, (doc_id % 20)::VARCHAR AS law, (doc_id % 40)::VARCHAR AS article FROM documents), q AS (SELECT item_id, (item_id % 25)::VARCHAR AS law, (item_id % 40)::VARCHAR AS article FROM benchmark),
f AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id, q.law, q.article ORDER BY doc_id) AS nth FROM q JOIN c ON c.law = q.law AND c.article = q.article QUALIFY nth <= 2)
SELECT item_id AS query, doc_id AS chunk_id, nth FROM f UNION ALL SELECT DISTINCT item_id, NULL, NULL FROM q WHERE item_id NOT IN (SELECT item_id FROM f)
""")
def evidence_chunks(spark, sf_dir):
    d, b = F.col("doc_id"), F.col("item_id")
    chunks = table(spark, sf_dir, "documents").select(d.alias("chunk_id"), (d % 20).cast("string").alias("law_number"), (d % 40).cast("string").alias("article_no"))
    asked = table(spark, sf_dir, "benchmark").select(b.alias("query"), (b % 25).cast("string").alias("law_number"), (b % 40).cast("string").alias("article_no"))
    found, none = metrics.evidence(asked, chunks)
    return found.withColumn("nth", F.col("nth").cast("long")).unionByName(none, allowMissingColumns=True)


@query("""
WITH h AS (SELECT doc_id % 500 AS query, doc_id AS doc, (doc_id % 7)::VARCHAR AS law, (doc_id % 11)::VARCHAR AS article, 'f' || (doc_id % 13) AS file FROM documents),
e AS (SELECT item_id AS query, item_id % 3 AS k, (item_id % 7)::VARCHAR AS law, (item_id % 11)::VARCHAR AS article, item_id % 6 = 0 AS narrow, 'f' || (item_id % 13) AS file FROM benchmark)
SELECT h.query, h.doc FROM h JOIN e ON e.query = h.query
WHERE CASE k WHEN 0 THEN h.law = e.law AND (NOT narrow OR h.article = e.article) WHEN 1 THEN h.doc = e.query + 500 OR (h.file = e.file AND (contains(h.article, e.article) OR contains(e.article, h.article))) ELSE h.file = e.file END
""")
def relevant_hits(spark, sf_dir):
    d, b = F.col("doc_id"), F.col("item_id")
    text_of = lambda c: c.cast("string")
    hits = table(spark, sf_dir, "documents").select((d % 500).alias("query"), d.alias("doc"), F.lit(1).alias("rank"), text_of(d % 7).alias("law_number"), text_of(d % 11).alias("article_no"), _name("f", d % 13).alias("source_file"))
    none, file = F.array().cast("array<string>"), _name("f", b % 13)
    wanted = table(spark, sf_dir, "benchmark").select(
        b.alias("query"), F.when(b % 3 == 0, F.array(text_of(b % 7))).otherwise(none).alias("laws"), F.when(b % 6 == 0, F.array(text_of(b % 11))).otherwise(none).alias("articles"),
        F.when(b % 3 == 1, F.array(text_of(b + 500), F.concat(file, F.lit("#"), text_of(b % 11)))).otherwise(none).alias("ids"), F.when(b % 3 == 2, F.array(file)).otherwise(none).alias("files"),
    )
    return metrics.relevance(hits, wanted).select("query", "doc")


@query("SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'good' WHEN l.quality = 0 THEN 'bad' END, '') AS predicted FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def predictions_joined(spark, sf_dir):
    p = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad").alias("predicted"))
    return metrics.predicted(table(spark, sf_dir, "documents").select("doc_id"), p)


@query("""
SELECT doc_id AS chunk_id, 0 AS nth, coalesce(lang, '') || ' konusunda hangi hüküm uygulanır?' AS question FROM documents
UNION ALL SELECT doc_id, 1, coalesce(source, '') || ' sayılı Kanunun ' || doc_id || '. maddesi neyi düzenler?' FROM documents
""")
def template_questions(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("law_number"), F.col("doc_id").cast("string").alias("article_no"), F.col("lang").alias("title"))
    return metrics.generated_questions(chunks)


# ---------------------------------------------------------------- page parts


@query(f"""
WITH c AS (SELECT page_id, flatten(list_transform(regexp_extract_all(coalesce(html, ''), '(?is)<tr[^>]*>(.*?)</tr>', 1), lambda r: regexp_extract_all(r, '(?is)<t[dh][^>]*>(.*?)</t[dh]>', 1))) AS cells FROM pages)
SELECT page_id, len(cells) AS n, sha256(array_to_string(list_transform(cells, lambda x: {SQUEEZE.format("regexp_replace(x, '<[^>]+>', ' ', 'g')")}), '|')) AS digest FROM c
""")
def page_table_cells(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", text.table_cells(F.col("html")).alias("c"))
    return rows.select("page_id", F.size("c").cast("long").alias("n"), F.sha2(F.array_join(F.transform("c", lambda x: x["text"]), "|"), 256).alias("digest"))


_KINDS = ("Doc Title", "page header", " FOOTER ", "Table 1", "stamp", "Signature block", "picture", "other", "list", "section heading")


@query(f"SELECT event_id, ['title', 'header', 'footer', 'table', 'seal', 'signature', 'image', 'unknown', 'list', 'title'][event_id % {len(_KINDS)} + 1] AS block FROM events")
def block_types(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.block_type(_pick(_KINDS, F.col("event_id") % len(_KINDS))).alias("block"))
