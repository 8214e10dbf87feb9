"""Queries on structures that searches and pages need: an index of vectors, grids, ranges of ordered rows. Entered into the catalogue when imported."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import dealing, dispatching, layout, lexical, passages, phrases, routing, vectors
from lodestone.plans.catalogue import _KNN, ORACLES, _index, _states, _vectors, query, table
from lodestone.sources.scratch import cut

# ---------------------------------------------------------------- vectors


@query(f"WITH {_KNN.format('')} SELECT query, doc, rank, round(greatest(0.0, (1 + cosine) / 2), 4) AS score FROM r WHERE rank <= 10")
def vector_index_topk(spark, sf_dir):
    """Exact neighbours through the index: cells that cannot have a nearer vector stay closed."""
    q, e = _vectors(spark, sf_dir)
    return vectors.Cells.build(e).search(q, 10, exact=True).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT count(*) FILTER (WHERE vec_id % 50 = 0) AS queries, count(*) FILTER (WHERE vec_id % 50 = 0) * least(10, count(*)) AS neighbours, true AS found_nine_tenths FROM embeddings WHERE embedding IS NOT NULL")
def vector_index_recall(spark, sf_dir):
    """How the approximate search compares with all vectors: whether it finds nine tenths of the ten nearest."""
    q, e = _vectors(spark, sf_dir)
    want = vectors.knn(q, e, 10).select("query", "doc")
    got = vectors.Cells.build(e).knn(q, 10).select("query", "doc", F.lit(1).alias("there"))
    both = want.join(got, ["query", "doc"], "left")
    return both.agg(F.countDistinct("query").alias("queries"), F.count("*").alias("neighbours"), (F.count("there") >= 0.9 * F.count("*")).alias("found_nine_tenths"))


# ---------------------------------------------------------------- postings


@query(ORACLES["bm25_topk"])
def bm25_blocks(spark, sf_dir):
    """The rows of bm25_topk from an index that opens only the blocks that can hold them."""
    t, q = _index(spark, sf_dir)
    got = lexical.Blocks.build(t).top(q, 5)
    return got.select("query", "doc", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- pages


@query("""
WITH b AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.vec_id AS item, c.vec_id AS block, row_number() OVER (PARTITION BY a.vec_id ORDER BY c.e[4] - 0.02, c.e[3] - 0.02, c.vec_id) AS nth FROM b a JOIN b c ON a.label = c.label
  AND a.e[1] - 0.01 <= c.e[3] + 0.02 AND c.e[3] - 0.02 <= a.e[1] + 0.01 AND a.e[2] - 0.01 <= c.e[4] + 0.02 AND c.e[4] - 0.02 <= a.e[2] + 0.01)
SELECT b.vec_id AS item, b.label AS page, p.block FROM b LEFT JOIN p ON p.item = b.vec_id AND p.nth = 1
""")
def spatial_blocks(spark, sf_dir):
    """Items of a page with the first block that each overlaps: boxes around two of a vector's entries, pages by label."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("page"), F.col("embedding").cast("array<double>").alias("e"))
    box = lambda x, y, d: F.struct((F.col("e")[x] - d).alias("x0"), (F.col("e")[y] - d).alias("y0"), (F.col("e")[x] + d).alias("x1"), (F.col("e")[y] + d).alias("y1"))
    items = rows.select("page", F.col("vec_id").alias("item"), box(0, 1, 0.01).alias("box"))
    blocks = rows.select("page", F.col("vec_id").alias("block"), box(2, 3, 0.02).alias("box"))
    return layout.blocks(items, blocks).select("item", "page", "block")


_ITEMS = """
i AS (SELECT event_id // 64 AS page, event_id AS item, value > 97 AS wide, 10.0 + 310.0 * (event_id % 2) AS left_, 18.0 * ((event_id % 64) // 2) + user_id % 4 + CASE WHEN event_id % 64 >= 40 THEN 30.0 ELSE 0.0 END AS y0, event_type || ' ' || event_id AS text, value, event_id // 64 % 3 = 2 AS single FROM events),
e AS (SELECT page, item, text, CASE WHEN wide OR single THEN 10.0 ELSE left_ END AS x0, y0, CASE WHEN wide OR single THEN 490.0 ELSE left_ + 100.0 + least(value, 50.0) END AS x1, y0 + 12.0 AS y1 FROM i)"""
_ORDERED = f"""
{_ITEMS},
w AS (SELECT *, max(x1) OVER p AS width, count(*) OVER p AS n, x1 - x0 < 0.55 * max(x1) OVER p AS slim FROM e WINDOW p AS (PARTITION BY page)),
m AS (SELECT *, CASE WHEN slim THEN (x0 + x1) / 2 END AS mid FROM w),
g AS (SELECT *, CASE WHEN slim THEN lead(mid) OVER (PARTITION BY page, slim ORDER BY mid) - mid END AS gap FROM m),
t AS (SELECT page, arg_max(mid + gap / 2, (gap, -mid)) AS split, max(gap) AS widest FROM g WHERE gap IS NOT NULL GROUP BY page),
s AS (SELECT g.*, split, widest, mid >= split AS on_right FROM g LEFT JOIN t ON t.page = g.page),
c AS (SELECT page, count(*) FILTER (slim AND NOT on_right) AS ln, count(*) FILTER (slim AND on_right) AS rn, min(y0) FILTER (slim AND NOT on_right) AS lt, min(y0) FILTER (slim AND on_right) AS rt, max(y1) FILTER (slim AND NOT on_right) AS le, max(y1) FILTER (slim AND on_right) AS re FROM s GROUP BY page),
k AS (SELECT s.*, coalesce(width >= 80 AND n >= 12 AND ln + rn >= 12 AND widest >= 0.14 * width AND least(ln, rn) >= 4 AND least(le - lt, re - rt) > 0 AND least(le, re) - greatest(lt, rt) >= 0.45 * least(le - lt, re - rt), false) AS two FROM s JOIN c ON c.page = s.page),
f AS (SELECT page, item, (y0 + y1) / 2 AS middle, row_number() OVER (PARTITION BY page ORDER BY y0, item) AS nth FROM k WHERE NOT slim),
b AS (SELECT k.*, CASE WHEN slim THEN coalesce((SELECT min(nth) FROM f WHERE f.page = k.page AND f.middle >= k.y1), 1 << 30) ELSE (SELECT nth FROM f WHERE f.page = k.page AND f.item = k.item) END AS before FROM k),
o AS (SELECT page, item, text, x0, y0, x1, y1, CASE WHEN two THEN before ELSE 0 END AS k1, CASE WHEN NOT two THEN 0 WHEN NOT slim THEN 2 WHEN on_right THEN 1 ELSE 0 END AS k2 FROM b),
r AS (SELECT *, dense_rank() OVER (PARTITION BY page ORDER BY k1, k2) - 1 AS band, row_number() OVER (PARTITION BY page ORDER BY k1, k2, y0, x0, item) - 1 AS place FROM o)"""


def _page_items(spark, sf_dir):
    """Pages of 64 events: two columns with some rows of full width, every third page one column."""
    i, v = F.col("event_id"), F.col("value")
    page = F.expr("event_id div 64")
    wide = (v > 97) | (page % 3 == 2)
    left = 10.0 + 310.0 * (i % 2)
    y0 = 18.0 * F.expr("(event_id % 64) div 2") + F.col("user_id") % 4 + F.when(i % 64 >= 40, 30.0).otherwise(0.0)
    rows = table(spark, sf_dir, "events").select(page.alias("page"), i.alias("item"), F.concat_ws(" ", "event_type", i.cast("string")).alias("text"), F.when(wide, 10.0).otherwise(left).alias("x0"), y0.cast("double").alias("y0"), F.when(wide, 490.0).otherwise(left + 100.0 + F.least(v, F.lit(50.0))).alias("x1"))
    return rows.withColumn("y1", F.col("y0") + 12.0)


@query(f"WITH {_ORDERED} SELECT page, item, band, place FROM r")
def reading_order_rows(spark, sf_dir):
    """The reading order of pages of items, by windows."""
    rows = layout.ordered(_page_items(spark, sf_dir))
    return rows.select("page", "item", F.col("band").cast("long").alias("band"), F.col("place").cast("long").alias("place"))


@query(f"""
WITH {_ORDERED},
q AS (SELECT *, lag(x0) OVER v AS px0, lag(x1) OVER v AS px1, lag(y0) OVER v AS py0, lag(y1) OVER v AS py1, lag(band) OVER v AS pband FROM r WINDOW v AS (PARTITION BY page ORDER BY place)),
l AS (SELECT *, sum(CASE WHEN band = pband AND least(y1, py1) - greatest(y0, py0) >= 0.5 * least(greatest(8.0, y1 - y0), greatest(8.0, py1 - py0)) AND abs((y0 + y1) / 2 - (py0 + py1) / 2) <= 0.38 * greatest(8.0, y1 - y0, py1 - py0)
  AND least(x1, px1) - greatest(x0, px0) <= 0.3 * least(greatest(1.0, x1 - x0), greatest(1.0, px1 - px0)) THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY place) - 1 AS line FROM q),
n AS (SELECT page, line, min(band) AS band, min(y0) AS top, max(y1) AS bottom, string_agg(text, ' ' ORDER BY x0, place) AS said FROM l GROUP BY page, line),
h AS (SELECT page, greatest(0.85 * median(greatest(8.0, bottom - top)), 10.0) AS usual FROM n GROUP BY page),
z AS (SELECT n.*, usual, lag(bottom) OVER v AS pbottom, lag(band) OVER v AS pband FROM n JOIN h ON h.page = n.page WINDOW v AS (PARTITION BY n.page ORDER BY line)),
x AS (SELECT *, sum(CASE WHEN pband IS NULL OR band <> pband OR top - pbottom >= usual THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY line) - 1 AS paragraph FROM z)
SELECT page, paragraph::BIGINT AS paragraph, count(*) AS lines, sha256(string_agg(said, chr(10) ORDER BY line)) AS digest FROM x GROUP BY page, paragraph
""")
def page_paragraphs(spark, sf_dir):
    """Lines and paragraphs of pages of items, by lag, running sums and a median."""
    rows = layout.paragraph_rows(_page_items(spark, sf_dir))
    return rows.select("page", F.col("paragraph").cast("long").alias("paragraph"), F.col("lines").cast("long").alias("lines"), F.sha2("text", 256).alias("digest"))


@query("""
WITH g AS (SELECT event_id, user_id, epoch_us(ts) AS t, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
m AS (SELECT user_id, median(gap) AS usual FROM g GROUP BY user_id),
i AS (SELECT g.user_id, event_id, t, sum(CASE WHEN gap > 3 * usual THEN 1 ELSE 0 END) OVER (PARTITION BY g.user_id ORDER BY t, event_id) AS island FROM g JOIN m ON m.user_id IS NOT DISTINCT FROM g.user_id)
SELECT user_id, island::BIGINT AS island, count(*) AS events, min(t) AS started, max(t) AS ended FROM i GROUP BY user_id, island
""")
def event_islands(spark, sf_dir):
    """Runs of a user's events: a new one begins after a gap of more than three times the user's median gap."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    rows = dealing.islands(e, ["user_id"], "t", "event_id", F.col("gap") > 3 * F.col("median_gap"))
    return rows.groupBy("user_id", F.col("island").cast("long").alias("island")).agg(F.count("*").alias("events"), F.min("t").alias("started"), F.max("t").alias("ended"))


# ---------------------------------------------------------------- phrases and departments


@query("""
WITH w AS (SELECT item_id, list_filter(string_split_regex(lower(trim(text)), '\\s+'), lambda v: v <> '') AS ws FROM benchmark),
p0 AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + 2], ' ') AS p FROM w, range(1, 5000) t(i) WHERE i <= len(ws) - 2),
p AS (SELECT DISTINCT p, list_distinct(list_filter(regexp_extract_all(p, '[a-zA-ZçğıöşüÇĞİÖŞÜ0-9]+'), lambda v: length(v) > 1 AND v NOT IN (""" + ", ".join(f"'{v}'" for v in text.ROUTING_STOPWORDS) + """))) AS own FROM p0),
d AS (SELECT doc_id, lower(trim(coalesce(text, ''))) AS x FROM documents),
t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(x, '[a-zA-ZçğıöşüÇĞİÖŞÜ0-9]+'))) AS word FROM d),
u AS (SELECT p, len(own) AS n, unnest(own) AS word FROM p),
m AS (SELECT doc_id, p FROM d JOIN p ON contains(x, p) UNION SELECT doc_id, p FROM (SELECT doc_id, p, any_value(n) AS n, count(*) AS hits FROM t JOIN u ON u.word = t.word GROUP BY doc_id, p) WHERE hits = n)
SELECT doc_id, item_id, count(*) AS phrases FROM m JOIN p0 ON p0.p = m.p GROUP BY doc_id, item_id
""")
def phrase_dictionary(spark, sf_dir):
    """How many of each benchmark item's phrases of three words every document has, as they are or word by word: a dictionary joined with texts."""
    words = F.filter(F.split(F.lower(F.trim("text")), r"\s+"), lambda v: v != "")
    three = F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.array_join(F.slice("w", i, 3), " "))
    items = table(spark, sf_dir, "benchmark").select("item_id", words.alias("w")).where(F.size("w") >= 3).select("item_id", F.explode(three).alias("p")).distinct()
    hits = phrases.found(table(spark, sf_dir, "documents"), items, "doc_id", "text", "p")
    # written, the items have a size that Spark can choose its join by
    return hits.join(cut(items, "items"), "p").groupBy("doc_id", "item_id").agg(F.count("*").alias("phrases"))


def _sql_list(values) -> str:
    say = lambda p: "'" + p.replace("'", "''") + "'"
    low = [p.replace("İ", "i").lower().strip() for p in values]
    return "[" + ", ".join(f"{{'raw': {say(raw)}, 'p': {say(p)}, 'own': [{', '.join(say(w) for w in sorted(set(routing._split(p))))}]::VARCHAR[]}}" for raw, p in zip(values, low, strict=True)) + "]::STRUCT(raw VARCHAR, p VARCHAR, own VARCHAR[])[]"


def _decisions_sql() -> str:
    kb, stop = routing.KnowledgeBase(routing.DEPARTMENTS), text.ROUTING_STOPWORDS
    offices = ", ".join(
        f"({i}, '{d.name}', '{d.channel}', '{d.authority}', {_sql_list(d.keywords)}, {_sql_list(d.keywords + d.topics)}, {_sql_list(d.rules)}, {_sql_list(d.excluded)}, {kb.lengths[i]}, '{' '.join(routing._split(d.corpus()))}')" for i, d in enumerate(routing.DEPARTMENTS)
    )
    within = lambda text, ws: f"lambda e: e.p <> '' AND (contains({text}, e.p) OR (len(e.own) > 0 AND len(list_filter(e.own, lambda v: NOT list_contains({ws}, v))) = 0))"
    share = lambda list_, text, ws: f"len(list_filter({list_}, {within(text, ws)})) / greatest(len({list_}), 1)"
    words = lambda text: f"list_filter(regexp_extract_all(lower(replace({text}, 'İ', 'i')), '[a-zA-ZçğıöşüÇĞİÖŞÜ0-9]+'), lambda v: length(v) > 1 AND v NOT IN ({', '.join(repr(v) for v in stop)}))"
    lows = lambda text: f"lower(trim(replace({text}, 'İ', 'i')))"
    return f"""
WITH o(place, name, channel, authority, keywords, quick, rules, excluded, length, corpus) AS (VALUES {offices}),
s AS (SELECT doc_id, ['izin talebi', 'dava açma', 'yol bozuk', 'vergi borcu', 'ağaç budama', 'genel'][doc_id % 6 + 1] AS said, text FROM documents),
a AS (SELECT doc_id, said, concat_ws(' ', said, text) AS document, concat_ws(' ', said, said, 'yol onarımı', concat_ws(' ', said, text)) AS analysis FROM s),
b AS (SELECT doc_id, name, {share('quick', lows('analysis'), words('analysis'))} AS score, place FROM a, o),
n AS (SELECT doc_id, arg_max(CASE WHEN score > 0 THEN name END, (score, -place)) AS main FROM b WHERE score > 0 GROUP BY doc_id),
c AS (SELECT arg_max(name, (score, -place)) AS other FROM (SELECT name, place, {share('quick', "'yol onarımı'", "['yol', 'onarımı']")} AS score FROM o)),
i AS (SELECT doc_id, said, document, 'primary' AS label, analysis AS focus, said AS topic FROM a
  UNION ALL SELECT a.doc_id, said, document, 'secondary:yol onarımı', 'yol onarımı', 'yol onarımı' FROM a LEFT JOIN n ON n.doc_id = a.doc_id, c WHERE main IS NULL OR main <> other),
x AS (SELECT *, {lows('focus')} AS low, {words('focus')} AS ws, {lows("focus || ' ' || topic")} AS hay, {words("focus || ' ' || topic")} AS hws FROM i),
w AS (SELECT place, unnest(string_split(corpus, ' ')) AS term FROM o),
f AS (SELECT place, term, count(*) AS f FROM w GROUP BY place, term),
q AS (SELECT term, ln(1 + ({len(routing.DEPARTMENTS)} - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM f GROUP BY term),
g AS (SELECT f.place, f.term, f, idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * length / (SELECT avg(length) FROM o))) AS gain, sqrt(sum(f * f) OVER (PARTITION BY f.place)) AS norm FROM f JOIN q ON q.term = f.term JOIN o ON o.place = f.place),
t AS (SELECT doc_id, label, term, count(*) AS tf FROM (SELECT doc_id, label, unnest(ws) AS term FROM x) GROUP BY ALL),
h AS (SELECT doc_id, label, sum(coalesce(idf, ln(1 + ({len(routing.DEPARTMENTS)} + 0.5) / 0.5))) AS cap, sqrt(sum(tf * tf)) AS norm FROM t LEFT JOIN q ON q.term = t.term GROUP BY doc_id, label),
k AS (SELECT t.doc_id, t.label, place, sum(tf * gain) AS raw, sum(tf * f) / any_value(norm) AS dot FROM t JOIN g ON g.term = t.term GROUP BY t.doc_id, t.label, place),
e AS (SELECT x.doc_id, x.label, o.place, name, channel, said, document, {share('quick', 'low', 'ws')} AS keyword, {share('rules', 'hay', 'hws')} AS rule, coalesce(least(1.0, greatest(0.0, raw / greatest(cap, 1e-6))), 0.0) AS bm25, coalesce(dot / h.norm, 0.0) AS semantic,
    len(list_filter(excluded, {within('hay', 'hws')})) > 0 AS rejected, {share('keywords', 'said', 'string_split(said, chr(32))')} AS mine
  FROM x CROSS JOIN o LEFT JOIN h ON h.doc_id = x.doc_id AND h.label = x.label LEFT JOIN k ON k.doc_id = x.doc_id AND k.label = x.label AND k.place = o.place),
l AS (SELECT *, 0.5 * keyword + 0.5 * bm25 AS first, (0.25 * rule + 0.15 * keyword + 0.2 * bm25 + 0.25 * semantic + 0.15 / 3) * CASE WHEN rejected THEN 0.1 ELSE 1 END AS total, max(CASE WHEN name = 'Hukuk Müşavirliği' THEN mine END) OVER (PARTITION BY doc_id, label) AS lawyers FROM e),
p AS (SELECT * FROM l QUALIFY first >= 0.02 OR max(first) OVER (PARTITION BY doc_id, label) < 0.02),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY rejected, total DESC, first DESC, place) AS nth FROM p QUALIFY row_number() OVER (PARTITION BY doc_id, label ORDER BY first DESC, place) <= 5),
v AS (SELECT doc_id, label, count(*) FILTER (NOT rejected) >= 2 AND max(total) FILTER (nth = 1) - max(total) FILTER (nth = 2) < 0.06 AS ambiguous FROM r GROUP BY doc_id, label),
z AS (SELECT r.*, ambiguous, name <> 'Hukuk Müşavirliği' AND lawyers >= 0.34 AND lawyers > mine + 0.15 AS conflict,
    (keyword > 0.05)::INT + (rule > 0.05)::INT + (bm25 > 0.05)::INT + (semantic > 0.05)::INT + 1 AS lit FROM r JOIN v ON v.doc_id = r.doc_id AND v.label = r.label WHERE nth = 1),
y AS (SELECT *, greatest(0.0, least(1.0, total + least(0.10, 0.015 * lit) - 0.18 * conflict::INT - 0.10 * ambiguous::INT - 0.09)) AS score FROM z)
SELECT doc_id AS state_id, label, CASE WHEN conflict THEN 'CONFLICT_DETECTED' WHEN ambiguous THEN 'AMBIGUOUS' WHEN label <> 'primary' THEN 'MULTI_ROUTE' ELSE 'SINGLE_ROUTE' END AS status, name AS department,
  CASE WHEN channel = 'LEGAL' THEN 'LEGAL' WHEN regexp_matches(lower(document || ' ' || said), 'acil|ivedi|urgent') THEN 'URGENT' ELSE 'STANDARD' END AS channel, round(total, 6) AS total,
  CASE WHEN score >= 0.72 AND NOT conflict AND NOT ambiguous THEN 'HIGH' WHEN score >= 0.48 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, conflict OR ambiguous OR score < 0.48 AS needs_human_review FROM y
"""


ORACLES["route_documents"] = _decisions_sql()


@query(_decisions_sql())
def route_by_table(spark, sf_dir):
    """Every document routed, by joins with a table of departments."""
    got = dispatching.route(_states(spark, sf_dir), dispatching.table(spark, routing.DEPARTMENTS))
    return got.select("state_id", "label", "status", "department", "channel", F.round("total", 6).alias("total"), "confidence", "needs_human_review")


_PLAIN = "regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+', '', 'g')"


@query(f"""
WITH RECURSIVE d AS (SELECT doc_id, {_PLAIN} AS x, list_filter(list_transform(string_split(text, ''), lambda c, i: CASE WHEN c IN (' ', chr(9), chr(10), chr(11), chr(12), chr(13)) THEN NULL ELSE i - 1 END), lambda v: v IS NOT NULL) AS pos FROM documents),
p AS (SELECT item_id, {_PLAIN} AS y FROM benchmark),
o AS (SELECT doc_id, item_id, instr(x, y) AS k, x, y FROM d, p WHERE y <> '' AND contains(x, y)
  UNION ALL SELECT doc_id, item_id, k + instr(substr(x, k + 1), y), x, y FROM o WHERE contains(substr(x, k + 1), y))
SELECT o.doc_id, item_id, pos[k] AS "start", pos[k + length(y) - 1] + 1 AS "end" FROM o JOIN d ON d.doc_id = o.doc_id
""")
def passage_places(spark, sf_dir):
    """Every place of a benchmark passage in a document, in characters of its text, whatever the white space."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    got = passages.located(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("passage"), "text"), docs)
    return got.select(F.col("doc").alias("doc_id"), F.col("passage").alias("item_id"), "start", "end")
