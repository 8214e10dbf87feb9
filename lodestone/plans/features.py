"""Queries with SQL for the retrieval pipeline as a whole, references of the graph, the cache, the gate and pages' figures. Entered into the catalogue when imported."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.functions import extract, jsonfix, text
from lodestone.operators import answers, dealing, layout, lawgraph, retrieval
from lodestone.plans.catalogue import ORACLES, SCORES, SQUEEZE, STRIP, _scored, _top, query, table
from lodestone.plans.structures import _ITEMS, _page_items
from lodestone.sources import sinks
from lodestone.sources.scratch import folder
from lodestone.streaming import memory

# ---------------------------------------------------------------- retrieval


@query(f"""
WITH {SCORES} {_scored('s0', 'okapi')},
x AS (SELECT doc_id, lang, lower({SQUEEZE.format("coalesce(text, '')")}) AS key FROM documents),
wq AS (SELECT item_id AS query, ['en', 'de', 'fr', 'es'][item_id % 4 + 1] AS wish FROM benchmark JOIN embeddings ON vec_id = item_id),
s AS (SELECT s0.query, s0.doc, s0.score FROM s0 JOIN wq ON wq.query = s0.query JOIN x ON x.doc_id = s0.doc WHERE lang = wish), {_top('l0', 's', 20)},
l AS (SELECT query, doc, rank FROM l0 WHERE score > 0),
v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
c AS (SELECT wq.query, b.vec_id AS doc, round(list_cosine_similarity(a.v, b.v), 9) AS score FROM wq JOIN v a ON a.vec_id = wq.query, v b JOIN x ON x.doc_id = b.vec_id WHERE lang = wish), {_top('m', 'c', 20)},
f AS (SELECT query, doc, round(sum(part / (60 + rank)), 6) AS score FROM (SELECT query, doc, rank, 0.55 AS part FROM m UNION ALL SELECT query, doc, rank, 0.45 FROM l) GROUP BY query, doc), {_top('r', 'f', 20)},
k AS (SELECT r.*, row_number() OVER (PARTITION BY query, key ORDER BY rank, doc) AS nth FROM r JOIN x ON x.doc_id = r.doc)
SELECT query, doc, rank, score FROM (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY rank, doc) AS rank FROM k WHERE nth = 1) WHERE rank <= 5
""")
def retrieve_hybrid(spark, sf_dir):
    """The retrieval pipeline with vectors and filters: benchmark items against the documents of a language, both lists fused, equal texts once."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"))
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.lit("").alias("law_number"), F.lit("").alias("article_no"), F.col("lang").alias("source_type"))
    wish = F.get(F.array(*map(F.lit, ("en", "de", "fr", "es"))), (F.col("item_id") % 4).cast("int"))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text", F.create_map(F.lit("source_type"), wish).alias("where")).join(e.withColumnRenamed("doc", "query"), "query")
    got = retrieval.retrieve(retrieval.Index(chunks, e), q, 5, mode="hybrid", use_prf=False, use_graph="off")
    return got.select("query", "doc", F.col("rank").cast("long").alias("rank"), "score")


# ---------------------------------------------------------------- graph

#: Articles whose texts cite the next document's article, in its law.
_CITING = """
a AS (SELECT doc_id, (1000 + doc_id % 40)::VARCHAR AS law, doc_id::VARCHAR AS article, coalesce(text, '') || chr(10) || (1000 + (doc_id + 7) % 40) || ' sayili Kanunun ' || (doc_id + 7) || '. maddesi ve ' || (1000 + doc_id % 40) || ' sayili Kanun madde ' || (doc_id + 40) AS text FROM documents),
k AS (SELECT doc_id, law, article, 'law:' || law || '|article:' || article AS node, regexp_extract_all(text, '(?is)\\b(\\d{3,4})\\s*(?:sayili)\\b.{0,140}?(?:(\\d+)\\s*\\.?\\s*madd(?:e|esi|esine|esinin)|madde\\s*(\\d+))', 1) AS l,
  regexp_extract_all(text, '(?is)\\b(\\d{3,4})\\s*(?:sayili)\\b.{0,140}?(?:(\\d+)\\s*\\.?\\s*madd(?:e|esi|esine|esinin)|madde\\s*(\\d+))', 2) AS x, regexp_extract_all(text, '(?is)\\b(\\d{3,4})\\s*(?:sayili)\\b.{0,140}?(?:(\\d+)\\s*\\.?\\s*madd(?:e|esi|esine|esinin)|madde\\s*(\\d+))', 3) AS y FROM a),
u AS (SELECT node AS src, unnest(l) AS l, unnest(x) AS x, unnest(y) AS y FROM k),
m AS (SELECT src, 'law:' || l || '|article:' || CASE WHEN coalesce(x, '') <> '' THEN x ELSE y END AS dst FROM u),
e AS (SELECT m.src, m.dst FROM m WHERE m.dst IN (SELECT node FROM k)),
n AS (SELECT node AS src, lead(node) OVER (PARTITION BY law ORDER BY doc_id) AS dst FROM k)"""


def _citing(spark, sf_dir):
    i = F.col("doc_id")
    law = lambda c: (1000 + c % 40).cast("string")
    said = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), law(i + 7), F.lit(" sayili Kanunun "), (i + 7).cast("string"), F.lit(". maddesi ve "), law(i), F.lit(" sayili Kanun madde "), (i + 40).cast("string"))
    return lawgraph.articles(table(spark, sf_dir, "documents").select(i.alias("chunk_id"), law(i).alias("law_number"), i.cast("string").alias("article_no"), said.alias("text")))


@query(f"WITH {_CITING} SELECT src, dst, count(*) AS times FROM e GROUP BY src, dst")
def law_mentions(spark, sf_dir):
    """References from article to article found in their texts, of those that exist."""
    return lawgraph.mentions(_citing(spark, sf_dir)).groupBy("src", "dst").agg(F.count("*").alias("times"))


@query(f"WITH {_CITING} SELECT (SELECT count(DISTINCT law) FROM k) AS laws, (SELECT count(DISTINCT node) FROM k) AS articles, (SELECT count(*) FROM n WHERE dst IS NOT NULL) AS adjacent_edges, (SELECT count(*) FROM e) AS reference_edges")
def graph_statistics(spark, sf_dir):
    return lawgraph.statistics(_citing(spark, sf_dir))


@query(f"""
WITH {_CITING},
b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e UNION SELECT src, dst FROM n WHERE dst IS NOT NULL UNION SELECT dst, src FROM n WHERE dst IS NOT NULL),
q AS (SELECT doc_id AS query, node FROM k WHERE doc_id % 50 = 0),
h AS (SELECT query, doc, rank FROM (SELECT q.query, k.doc_id AS doc, k.doc_id - q.query + 1 AS rank FROM q JOIN k ON k.doc_id BETWEEN q.query AND q.query + 2)),
z AS (SELECT query, node, 0 AS distance FROM q UNION ALL SELECT DISTINCT q.query, b.dst, 1 FROM q JOIN b ON b.src = q.node WHERE b.dst <> q.node),
g AS (SELECT z.query, k.doc_id AS doc, z.node, distance, row_number() OVER (PARTITION BY z.query ORDER BY distance, z.node, k.doc_id) AS nth FROM z JOIN k ON k.node = z.node WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.query = z.query AND h.doc = k.doc_id)),
r AS (SELECT query, doc, round(1.0 / rank, 4) AS score, 0 AS part, rank AS at_, NULL AS node FROM h UNION ALL SELECT query, doc, round(greatest(0.05, 0.35 - 0.08 * distance), 4), 1, nth, node FROM g WHERE nth <= 12)
SELECT query, doc, score, node AS graph_node, row_number() OVER (PARTITION BY query ORDER BY part, at_) AS rank FROM r
""")
def graph_enriched(spark, sf_dir):
    """Hits with the chunks of neighbouring and cited articles after them: every fiftieth article, with it and the two after it as its hits."""
    arts = _citing(spark, sf_dir)
    asked = arts.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query"), F.col("law").alias("law_number"), F.col("article").alias("article_no"))
    hits = asked.select("query", F.explode(F.array(*(F.struct((F.col("query") + i).alias("doc"), F.lit(i + 1).alias("rank"), F.round(F.lit(1.0) / (i + 1), 4).alias("score")) for i in range(3)))).alias("h")).select("query", "h.*")
    hits = hits.join(arts.select(F.col("chunk_id").alias("doc")), "doc", "left_semi")
    got = lawgraph.enriched(hits, asked, arts, references=True)
    return got.select("query", "doc", "score", "graph_node", F.col("rank").cast("long").alias("rank"))


# ---------------------------------------------------------------- cache, gate, pages


@query(f"""
WITH c AS (SELECT conv_id * 1000 + turn AS entry, text AS question, conv_id * 1000 + turn AS created_at, turn % 4 AS fresh FROM conversations WHERE role = 'user'),
k AS (SELECT *, {SQUEEZE.format("lower(coalesce(question, ''))")} AS key FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY fresh > 1 DESC, created_at DESC, entry DESC) AS nth FROM k)
SELECT entry, question, created_at FROM o WHERE nth = 1 ORDER BY created_at DESC, entry DESC LIMIT 200
""")
def cache_store(spark, sf_dir):
    """A cache after new entries came in: of the same words the new one, and the newest two hundred stay."""
    i = F.col("conv_id") * 1000 + F.col("turn")
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").select(i.alias("entry"), F.col("text").alias("question"), i.alias("created_at"), (F.col("turn") % 4).alias("fresh"))
    return answers.stored(rows.where("fresh <= 1").drop("fresh"), rows.where("fresh > 1").drop("fresh"))


@query("""
WITH c AS (SELECT doc_id, CASE WHEN n_chars % 7 = 0 THEN NULL ELSE (n_chars % 100) / 100.0 END AS confidence, coalesce(text, '') AS t FROM documents),
d AS (SELECT doc_id, confidence, regexp_extract_all(t, '\\b(?:\\d{1,2}[./-]\\d{1,2}[./-]\\d{2,4}|\\d{4}[./-]\\d{1,2}[./-]\\d{1,2})\\b') AS found FROM c)
SELECT doc_id, CASE WHEN coalesce(confidence, 0) >= 0.6 THEN 'success' ELSE 'needs_review' END AS status, len(list_distinct(found)) AS dates, found[1] AS first_date,
  round_even((CASE WHEN len(found) > 0 THEN 0.9 ELSE 0 END + coalesce(confidence, 0)) / greatest(1, (len(found) > 0)::INT + (coalesce(confidence, 0) > 0)::INT), 3) AS overall FROM d
""")
def extraction_gate(spark, sf_dir):
    """The gate after classification, the dates of a page, and the confidence of what was found."""
    c = F.when(F.col("n_chars") % 7 != 0, (F.col("n_chars") % 100) / 100.0)
    rows = table(spark, sf_dir, "documents").select("doc_id", c.alias("c"), extract.page_dates(F.col("text")).alias("d"))
    none = F.lit(None).cast("struct<value:string,confidence:double,source:string>")
    overall = extract.overall_confidence(F.col("d"), none, F.array().cast("array<double>"), F.col("c"))
    return rows.select("doc_id", extract.gate(F.col("c")).alias("status"), F.size("d").cast("long").alias("dates"), F.get("d", F.lit(0)).alias("first_date"), overall.alias("overall"))


@query(f"""
WITH {_ITEMS},
c AS (SELECT e.*, least(1.0, value / 100) AS confidence FROM e JOIN (SELECT event_id, value FROM events) v ON v.event_id = e.item)
SELECT page, count(*) AS items, round(avg(confidence), 12) AS mean, round(avg((confidence < 0.3)::INT), 12) AS low, min(x0)::DOUBLE AS x0, min(y0)::DOUBLE AS y0, max(x1)::DOUBLE AS x1, max(y1)::DOUBLE AS y1,
  CASE WHEN count(*) FILTER (confidence >= 0.9) = 0 THEN 'failed' WHEN count(*) FILTER (confidence >= 0.9) < count(*) THEN 'partial' ELSE 'complete' END AS status FROM c GROUP BY page
""")
def page_figures(spark, sf_dir):
    """Of each page of items the mean confidence, the share of poor ones, the box around all, and whether all, some or none are good."""
    value = table(spark, sf_dir, "events").select(F.col("event_id").alias("item"), F.least(F.lit(1.0), F.col("value") / 100).alias("confidence"))
    rows = _page_items(spark, sf_dir).join(value, "item")
    pages = rows.groupBy("page").agg(F.collect_list(F.struct("text", "confidence", "x0", "y0", "x1", "y1")).alias("items"))  # a page has 64 items
    status = layout.page_status(rows.withColumn("ok", F.col("confidence") >= 0.9), "page")
    got = pages.select("page", F.size("items").cast("long").alias("items"), F.round(layout.mean_confidence(F.col("items")), 12).alias("mean"), F.round(layout.low_ratio(F.col("items"), 0.3), 12).alias("low"), layout.union_box(F.col("items")).alias("b"))
    return got.join(status, "page").select("page", "items", "mean", "low", "b.x0", "b.y0", "b.x1", "b.y1", "status")


@query("""
WITH o AS (SELECT doc_id AS chunk_id, source AS source_file, n_chars AS size FROM documents), n AS (SELECT doc_id AS chunk_id, source AS source_file, -n_chars AS size FROM documents WHERE doc_id % 7 = 0 UNION ALL SELECT doc_id + 10000000, 'new', 1 FROM documents WHERE doc_id % 100 = 0),
u AS (SELECT * FROM n UNION ALL SELECT * FROM o WHERE chunk_id NOT IN (SELECT chunk_id FROM n)), l AS (SELECT * FROM u WHERE source_file IS NULL OR source_file <> (SELECT min(source) FROM documents))
SELECT coalesce(source_file, 'none') AS source_file, count(*) AS chunks, sum(size)::BIGINT AS size FROM l GROUP BY ALL
""")
def chunk_table(spark, sf_dir):
    """The chunk table after a first load, an upsert of some and new chunks, and the removal of a source."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_file"), F.col("n_chars").alias("size"))
    chunks = sinks.ChunkTable(spark, f"{folder(spark)}/chunk-table-{uuid.uuid4().hex}")
    chunks.replace(rows)
    new = rows.where("chunk_id % 100 = 0").select((F.col("chunk_id") + 10000000).alias("chunk_id"), F.lit("new").alias("source_file"), F.lit(1).cast("long").alias("size"))
    chunks.upsert(rows.where("chunk_id % 7 = 0").withColumn("size", -F.col("size")).unionByName(new))
    chunks.delete_sources(rows.agg(F.min("source_file").alias("source_file")))
    return chunks.read().groupBy(F.coalesce("source_file", F.lit("none")).alias("source_file")).agg(F.count("*").alias("chunks"), F.sum("size").alias("size"))


@query(ORACLES["turn_memory"])
def stream_memory(spark, sf_dir):
    """The rows of turn_memory from a stream of the conversations, whose last turns are keyed state."""
    path = f"{sf_dir}/conversations.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 64)
    rows = stream.parquet(f"{path[:-1]}[t]").where("role = 'user'")  # as a pattern, since the table may be a single file
    law = F.when(F.col("turn") % 3 == 0, F.lit("unknown")).otherwise((F.col("conv_id") % 9000 + 100).cast("string"))
    turns = rows.select("conv_id", "turn", F.col("text").alias("question"), F.col("text").alias("answer"), law.alias("law_number"))
    got = memory.remembered_table(spark, turns, f"{folder(spark)}/memory-{uuid.uuid4().hex}")
    return got.select("conv_id", "turn", F.sha2("memory", 256).alias("memory"))


_CLASSES = "[" + ", ".join(f"'{c}'" for c in jsonfix.CLASSES) + "]"


@query(f"""
SELECT doc_id, CASE WHEN doc_id % 5 > 2 THEN NULL WHEN doc_id % 7 = 0 THEN '{jsonfix.UNCERTAIN}' ELSE {_CLASSES}[n_chars % {len(jsonfix.CLASSES)} + 1] END AS document_type, CASE WHEN doc_id % 5 <= 2 THEN least(1.0::DOUBLE, (n_chars % 200) / 100.0) END AS confidence FROM documents
""")
def json_repair(spark, sf_dir):
    """A label for each document as models write them, plain, fenced, within prose, broken or cut off, read again."""
    i, n = F.col("doc_id"), F.col("n_chars")
    kind = F.when(i % 7 == 0, F.col("source")).otherwise(F.get(F.array(*map(F.lit, jsonfix.CLASSES)), (n % len(jsonfix.CLASSES)).cast("int")))
    said = F.concat(F.lit('{"document_type": "'), F.coalesce(kind, F.lit("?")), F.lit('", "confidence": '), (n % 200).cast("string"), F.lit("e-2}"))
    raw = F.when(i % 5 == 0, said).when(i % 5 == 1, F.concat(F.lit("```json\n"), said, F.lit("\n```"))).when(i % 5 == 2, F.concat(F.lit("Of "), F.coalesce("lang", F.lit("?")), F.lit(": "), said, F.lit(" so"))).when(i % 5 == 3, "broken {").otherwise(F.left(said, F.length(said) - 1))
    got = table(spark, sf_dir, "documents").select("doc_id", jsonfix.label(raw).alias("l"))
    return got.select("doc_id", "l.document_type", "l.confidence")


@query()
def reading_order(spark, sf_dir):
    """Pages of items as text, whole pages in a worker; reading_order_rows and page_paragraphs are the same by windows."""
    item = F.struct("item", "text", F.lit(1.0).alias("confidence"), "x0", "y0", "x1", "y1")
    pages = _page_items(spark, sf_dir).groupBy("page").agg(F.sort_array(F.collect_list(item)).alias("items"))  # a page has 64 items
    return layout.page_text(pages.withColumn("items", F.transform("items", lambda x: x.dropFields("item")))).select("page", "text")


@query("""
WITH r AS (SELECT page_id, list_transform(regexp_extract_all(coalesce(html, ''), '(?is)<tr[^>]*>(.*?)</tr>', 1), lambda r: len(regexp_extract_all(r, '(?is)<t[dh][^>]*>(.*?)</t[dh]>', 1))) AS n FROM pages)
SELECT page_id, coalesce(list_sum(n), 0)::BIGINT AS cells, coalesce(list_max(list_transform(n, lambda c, i: CASE WHEN c > 0 THEN i ELSE 0 END)), 0)::BIGINT AS grid_rows, coalesce(list_max(n), 0)::BIGINT AS grid_columns FROM r
""")
def table_cells(spark, sf_dir):
    """The cells of a page's tables, and the grid that they fill."""
    cells = table(spark, sf_dir, "pages").select("page_id", text.table_cells(F.col("html")).alias("c"))
    grid = cells.select("page_id", F.size("c").cast("long").alias("cells"), text.table_grid(F.col("c")).alias("g"))
    return grid.select("page_id", "cells", F.size("g").cast("long").alias("grid_rows"), F.coalesce(F.size(F.get("g", F.lit(0))), F.lit(0)).cast("long").alias("grid_columns"))


_FOLDED = "lower(translate({}, 'çğıöşüÇĞİÖŞÜ', 'cgiosuCGIOSU'))"


@query(f"""
WITH n AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS later FROM conversations),
r AS (SELECT conv_id, turn, {STRIP.format("text")} AS o, {STRIP.format("CASE turn % 4 WHEN 0 THEN right(text, 40) || later WHEN 1 THEN later || left(text, 25) WHEN 2 THEN translate(text, 'aeiou', 'AEIOU') ELSE later END")} AS v FROM n WHERE later IS NOT NULL AND text IS NOT NULL),
p AS (SELECT *, {_FOLDED.format('o')} AS a, {_FOLDED.format('v')} AS b FROM r),
k AS (SELECT *, coalesce(list_max(list_filter(range(12, least(length(a), length(b)) + 1), lambda i: right(a, i) = left(b, i))), 0) AS x, coalesce(list_max(list_filter(range(12, least(length(a), length(b)) + 1), lambda i: right(b, i) = left(a, i))), 0) AS y,
  list_distinct(string_split_regex(a, '[ \\t\\n\\x0b\\f\\r]+')) AS ws, list_distinct(string_split_regex(b, '[ \\t\\n\\x0b\\f\\r]+')) AS vs FROM p)
SELECT conv_id, turn, sha256(CASE WHEN o = '' OR v = '' THEN o || v WHEN a = b OR starts_with(b, a) OR ends_with(b, a) THEN v WHEN starts_with(a, b) OR ends_with(a, b) THEN o WHEN x > 0 AND x >= y THEN o || substr(v, x + 1) WHEN y > 0 THEN v || substr(o, y + 1)
  WHEN len(list_intersect(ws, vs)) / len(ws) >= 0.5 AND length(v) > length(o) THEN v ELSE o END) AS merged FROM k
""")
def merged_turns(spark, sf_dir):
    """Neighbouring turns as two readings of a page, stitched where the end of one begins the other."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    rows = dealing.shifted(dealing.ranged(rows, ["conv_id"], ["turn"]), ["conv_id"], ["turn"], {"later": "text"}, ahead=True).where("later IS NOT NULL AND text IS NOT NULL")
    t = F.col("turn") % 4
    seen = F.when(t == 0, F.concat(F.right("text", F.lit(40)), "later")).when(t == 1, F.concat("later", F.left("text", F.lit(25)))).when(t == 2, F.translate("text", "aeiou", "AEIOU")).otherwise(F.col("later"))
    got = layout.merged(rows.withColumn("vision", seen))
    return got.select("conv_id", "turn", F.sha2("merged", 256).alias("merged"))
