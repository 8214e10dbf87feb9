"""N-gram Jaccard join by a token-group matrix.

A document's set holds the hashes of its distinct word shingles. Two documents link when the Jaccard similarity of
their sets reaches a threshold, tested exactly as den * intersection >= num * union. Components of links are found without listing
all links of a group of copies:

1. Equal sets are one node, whatever the number of copies.
2. Each node sends its tokens with the smallest hashes (a share `sent` of all, and the length of its prefix at least) to partitions by
   token, as packed blocks, where tokens of one node only are dropped. What comes back is the node's rarest repeated tokens.
   By the prefix-filter principle two linked nodes share a token within both prefixes in the order (frequency, hash);
   a node whose prefix has unique tokens only has no partner, and is done.
3. Similar nodes are partitioned into groups: of the nodes of like size that share a prefix token the smallest is the pivot. Nodes
   that link with pivots make connected groups, within which nothing needs a test; the others are put with their first pivot.
4. The token-group matrix has the groups that hold each prefix token. A node queries it with its own prefix; for each group that
   qualifies by size, but for its own connected one, the query is given blocks of up to BLOCK members. The block's token union bounds the
   overlap with any member; only where the bound reaches what the threshold demands is the block's token-member matrix opened.
5. Links are contracted to components, in rounds until what is left fits one task's union-find.

Only (node, group) rows are made, never the pairs within a group. Groups with many queries are split by salting the queries.
Null and empty texts have an empty set and link with nothing; rows that repeat a doc_id count as one document with several
texts; extra columns are ignored; an empty table gives an empty result. Ties are broken by doc_id.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import chunks, documents, lean, release, shingles, small_batches, stage, text_bytes, word_hashes, word_spans

SENT = 1.0
BLOCK = 256
QUERIES = 512
#: Edges that one task joins to components.
TASK_EDGES = 500_000
#: Tokens that one partition gets to count.
PART_TOKENS = 5_000_000
_BITS = 64


def token_sets(column: pa.Array, width: int):
    """The sorted distinct shingle hashes of each row of a text column, one by one."""
    data, offs = text_bytes(column)
    for lo, hi in chunks(offs):
        part, at = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        starts, stops, first = word_spans(part, at)
        h = word_hashes(part, starts, stops)
        for i in range(hi - lo):
            yield np.unique(shingles(h[first[i] : first[i + 1]], width))


def node_of(tokens: np.ndarray) -> int:
    """The node of a set: 64 bits of a cryptographic digest."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix(n, num: int, den: int, other: bool = False):
    """Length of the prefix of a set of n tokens that has a token of any linked set; other: of any set at least as large."""
    need = -(-num * n // den) if not other else -(-2 * num * n // (num + den))
    return n - need + 1


def sizes(docs: DataFrame, width: int, id: str, text: str) -> DataFrame:
    """id, n, node (null for empty sets)."""

    def run(batches):
        for b in batches:
            got = [(len(t), node_of(t) if len(t) else None) for t in token_sets(b.column(1), width)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())], names=["id", "n", "node"])

    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("t")).mapInArrow(lean(run), "id long, n long, node long")


def repeated(docs: DataFrame, width: int, num: int, den: int, parts: int, text: str, sent: float) -> DataFrame:
    """node, n, low (tokens sent that are below the cut), token, df, high: the sent tokens that several nodes have sent."""
    cut = np.uint64(int(sent * 2.0**64)) if sent < 1 else None

    def pack(batches):
        seen: set[int] = set()
        for b in batches:
            nodes, ns, lows, toks = [], [], [], []
            for t in token_sets(b.column(0), width):
                if len(t):
                    node = node_of(t)
                    if node in seen:  # copies are sent once a task
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(node)
                    low = len(t) if cut is None else int(np.searchsorted(t, cut))
                    nodes.append(node)
                    ns.append(len(t))
                    lows.append(low)
                    toks.append(t[: max(low, prefix(len(t), num, den))])
            if not nodes:
                continue
            flat = np.concatenate(toks)
            row = np.repeat(np.arange(len(toks), dtype=np.int32), [len(t) for t in toks])
            high = np.zeros(len(flat), np.uint8) if cut is None else (flat >= cut).astype(np.uint8)
            key = flat & np.uint64((1 << _BITS) - 1)
            part = (key % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            row, high, key, part = row[order], high[order], key[order], part[order]
            edge = np.searchsorted(part, np.arange(parts + 1))
            info = np.array([nodes, ns, lows], np.int64)
            out = {"part": [], "info": [], "count": [], "key": []}
            for p in range(parts):
                a, z = edge[p], edge[p + 1]
                if a < z:
                    mine, count = np.unique(row[a:z], return_counts=True)
                    out["part"].append(p)
                    out["info"].append(info[:, mine].astype("<i8")[0].tobytes() + info[1:, mine].astype("<i4").tobytes())
                    out["count"].append(count.astype("<u2" if count.max() < 65536 else "<u4").tobytes())
                    packed = key[a:z, None].view(np.uint8).reshape(-1, 8)[:, : _BITS // 8]
                    if sent < 1:  # else all tokens are below the cut
                        packed = np.concatenate([packed, high[a:z, None]], axis=1)
                    out["key"].append(np.ascontiguousarray(packed).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out["part"], pa.int32()), *(pa.array(out[k], pa.binary()) for k in ("info", "count", "key"))], names=list(out))

    def count(table: pa.Table) -> pa.Table:
        nodes, ns, lows, keys, highs = [], [], [], [], []
        for info, cnt, key in zip(*(table.column(k).to_pylist() for k in ("info", "count", "key")), strict=True):
            m = len(info) // 16
            c = np.frombuffer(cnt, "<u2" if len(cnt) == 2 * m else "<u4")
            nodes.append(np.repeat(np.frombuffer(info, "<i8", m), c))
            small = np.frombuffer(info, "<i4", 2 * m, 8 * m)
            ns.append(np.repeat(small[:m], c))
            lows.append(np.repeat(small[m:], c))
            k = np.frombuffer(key, np.uint8).reshape(int(c.sum()), -1)
            wide = np.zeros((len(k), 8), np.uint8)
            wide[:, : _BITS // 8] = k[:, : _BITS // 8]
            keys.append(wide.view("<i8").ravel())
            highs.append(k[:, -1] if sent < 1 else np.zeros(len(k), np.uint8))
        node, n, low, key, high = map(np.concatenate, (nodes, ns, lows, keys, highs))
        order = np.lexsort((node, key))
        node, n, low, key, high = node[order], n[order], low[order], key[order], high[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])  # one copy of each node's token
        node, n, low, key, high = node[new], n[new], low[new], key[new], high[new]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        run = np.diff(np.concatenate([first, [len(key)]]))
        df = np.repeat(run, run)
        keep = np.flatnonzero(df > 1)
        keep = keep[np.argsort(node[keep], kind="stable")]  # a node's rows together: they compress better
        release()
        return pa.table({"node": node[keep], "n": n[keep].astype(np.int32), "low": low[keep].astype(np.int32), "token": key[keep], "df": df[keep].astype(np.int32), "high": high[keep].astype(np.int32)})

    packed = docs.select(F.col(text).alias("t")).mapInArrow(lean(pack), "part int, info binary, count binary, key binary")
    return packed.groupBy("part").applyInArrow(count, "node long, n int, low int, token long, df int, high int")


def postings(rep: DataFrame, num: int, den: int) -> DataFrame:
    """token, node, n, main (within the shorter prefix too): the repeated tokens of each node's prefix."""
    n, low = F.col("n"), F.col("low")
    whole = n - F.ceil(F.lit(num) * n / den) + 1
    main = n - F.ceil(F.lit(2 * num) * n / (num + den)) + 1
    by = rep.groupBy("node", "n", "low").agg(F.sort_array(F.collect_list(F.struct("high", "df", "token"))).alias("got"))
    unique = low - F.size(F.filter("got", lambda x: x["high"] == 0))
    take = F.when(low < whole, F.size("got")).otherwise(F.greatest(whole - unique, F.lit(0)))
    take_main = F.when(low < main, F.size("got")).otherwise(F.greatest(main - unique, F.lit(0)))
    by = by.withColumns({"take": take.cast("int"), "take_main": take_main.cast("int")}).where("take > 0")
    rows = by.select("node", "n", "take_main", F.posexplode(F.slice("got", F.lit(1), F.col("take"))).alias("at", "x"))
    return rows.select(F.col("x.token").alias("token"), "node", "n", (F.col("at") < F.col("take_main")).alias("main"))


def opened(cand: DataFrame, members: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """x, y: for each candidate (x, g) and block of the group's members (g, y) every member but x that x links with; of
    members whose link to each other is known (equal `known`) one is enough.

    members: g, y, known; texts: id, text. Members of a block come first and make its matrix: a row for each token of their
    union, a column for each member. Queries then pass one by one; those whose overlap with the union cannot reach what
    the threshold demands of any member do not open the block."""
    asked = cand.groupBy("g").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("salts"))
    counted = members.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    shape = stage(asked.join(counted, "g"), "jaccard-shape")
    left = cand.join(shape.hint("merge"), "g").select("g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("x"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"), F.col("x").alias("id"), F.lit(None).cast("long").alias("known"))
    right = members.join(shape.hint("merge"), "g").select("g", F.pmod(F.xxhash64("y"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("y").alias("id"), "known")
    key = ["g", "block", "salt"]
    rows = left.unionByName(right).join(texts.hint("merge"), "id").select(*key, "role", "id", "known", "text").repartition(*key).sortWithinPartitions(*key, "role", "id")

    def run(batches):
        now, ids, knowns, sets, union = None, [], [], [], None
        for b in batches:
            xs, ys = [], []
            keys = list(zip(*(b.column(k).to_pylist() for k in range(6)), strict=True))
            for (g, block, salt, role, i, known), t in zip(keys, token_sets(b.column(6), width), strict=True):
                if (g, block, salt) != now:
                    now, ids, knowns, sets, union = (g, block, salt), [], [], [], None
                if not role:
                    ids.append(i)
                    knowns.append(known)
                    sets.append(t)
                    continue
                if not sets:
                    continue
                if union is None:
                    flat = np.concatenate(sets)
                    union, at = np.unique(flat, return_inverse=True)
                    matrix = np.zeros((len(union), len(sets)), np.uint8)
                    matrix[at, np.repeat(np.arange(len(sets)), [len(s) for s in sets])] = 1
                    lengths, names = np.array([len(s) for s in sets]), np.array(ids)
                place = np.searchsorted(union, t)
                place[place == len(union)] = 0
                place = place[union[place] == t]
                if den * len(place) < num * len(t):
                    continue
                common = matrix[place].sum(axis=0, dtype=np.int64)
                linked = np.flatnonzero((den * common >= num * (len(t) + lengths - common)) & (names != i))
                seen = set()
                for m in linked.tolist():
                    if knowns[m] not in seen:
                        seen.add(knowns[m])
                        xs.append(i)
                        ys.append(ids[m])
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], names=["x", "y"])

    return rows.mapInArrow(lean(run), "x long, y long")


def forest(batches):
    """node, to (the smallest node of its component) of one task's edges (a, b), by union-find."""
    parent: dict[int, int] = {}

    def root(v):
        while (p := parent.setdefault(v, v)) != v:
            parent[v] = parent[p]
            v = p
        return v

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for lo in range(0, len(nodes), 100_000):
        part = nodes[lo : lo + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(v) for v in part], pa.int64())], names=["node", "to"])


def connected(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of the edges (a, b).

    As long as the edges are too many for one task, each round every node goes to the neighbour, or itself, that a fresh hash puts
    first, and edges between the nodes that remain are kept: a constant share of the nodes goes away a round."""
    pair = lambda df, a, b: df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct()
    e = stage(pair(edges, "a", "b"), "components-edges")
    maps, turn = None, 0
    while e.count() > TASK_EDGES:
        turn += 1
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(rank("b")).alias("best"))
        to = stage(best.select(F.col("a").alias("node"), F.least("best", rank("a"))["v"].alias("to")), "components-step")
        step = to.hint("merge")
        maps = to if maps is None else stage(_moved(maps, to), "components-maps")
        e = e.join(step.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
        e = stage(pair(e, "ta", "tb"), "components-edges")
    last = stage(e.coalesce(1).mapInArrow(lean(forest), "node long, to long"), "components-forest")
    if maps is None:
        return last.withColumnRenamed("to", "component")
    maps = stage(_moved(maps, last), "components-maps")
    lowest = stage(maps.groupBy("to").agg(F.min("node").alias("component")), "components-lowest")
    return stage(maps.join(lowest.hint("merge"), "to").select("node", "component"), "components")


def _moved(maps: DataFrame, step: DataFrame) -> DataFrame:
    """maps (node, to) with one more step taken; nodes of the step only are none of maps' nodes' targets but stay themselves."""
    return maps.join(step.select(F.col("node").alias("to"), F.col("to").alias("next")).hint("merge"), "to", "left").select("node", F.coalesce("next", "to").alias("to"))


def cluster(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id: str = "doc_id", text: str = "text", sent: float = SENT) -> DataFrame:
    """id, n_shingles, component (smallest id reachable by links) of every row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    base = stage(sizes(docs, width, id, text), "jaccard-sizes")
    total = base.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total * sent / PART_TOKENS))
    nodes = stage(base.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("rid")), "jaccard-nodes")
    posts = postings(repeated(docs, width, num, den, parts, text, sent), num, den)
    posts = stage(posts.join(nodes.hint("merge"), "node").select("token", F.col("rid").alias("x"), "n", "main"), "jaccard-postings")
    involved = posts.select(F.col("x").alias("id")).distinct()
    texts = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull()).join(involved.hint("merge"), "id").distinct()
    texts = stage(texts, "jaccard-texts")
    # partition: pivots of like size, and what links with them
    like = F.floor(F.log("n") / math.log(den / num)).cast("int")
    sized = posts.withColumn("like", like)
    pivots = sized.where("main").groupBy("token", "like").agg(F.min(F.struct("n", "x")).alias("p")).select("token", "like", F.col("p.x").alias("g"), F.col("p.n").alias("pn"))
    near = (F.col("n") * num <= F.col("pn") * den) & (F.col("pn") * num <= F.col("n") * den)
    first = stage(sized.join(pivots.hint("merge"), ["token", "like"]).where((F.col("x") != F.col("g")) & near).select("x", "g").distinct(), "jaccard-pivots")
    found = stage(opened(first, first.select("g", F.col("g").alias("y"), F.col("g").alias("known")).distinct(), texts, width, num, den), "jaccard-links")
    groups = connected(found.select(F.col("x").alias("a"), F.col("y").alias("b")))
    # a node's group is its connected one; one that links with no pivot is put with the others of its first pivot
    mine = first.groupBy("x").agg(F.min("g").alias("pivot"))
    grouped = posts.join(groups.select(F.col("node").alias("x"), "component").hint("merge"), "x", "left").join(mine.hint("merge"), "x", "left")
    grouped = grouped.select("token", "x", "n", "main", F.coalesce("component", "x").alias("known"), F.when(F.col("component").isNotNull(), F.struct(F.lit(1).alias("kind"), F.col("component").alias("v"))).otherwise(F.struct(F.lit(0).alias("kind"), F.coalesce("pivot", "x").alias("v"))).alias("g"))
    grouped = stage(grouped.withColumn("own", F.when(F.col("g.kind") == 1, F.col("g.v"))).withColumn("g", F.xxhash64("g.kind", "g.v")), "jaccard-grouped")
    # query: the token-group matrix, but for a node's own connected group
    matrix = grouped.where("main").groupBy("token", "g").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("own").alias("theirs"), F.count("*").alias("many"), F.max("x").alias("one"))
    asks = grouped.select("token", "x", "n", "own", F.col("g").alias("mine"))
    other = F.coalesce(F.col("theirs") != F.col("own"), F.lit(True)) & ((F.col("many") > 1) | (F.col("one") != F.col("x")))
    fits = other & (F.col("least") <= F.col("n")) & (F.col("most") * den >= F.col("n") * num)
    cand = stage(asks.join(matrix.hint("merge"), "token").where(fits).select("x", "g").distinct(), "jaccard-candidates")
    members = grouped.select("g", F.col("x").alias("y"), "known").distinct()
    more = stage(opened(cand, members, texts, width, num, den), "jaccard-more")
    edges = found.unionByName(more).select(F.col("x").alias("a"), F.col("y").alias("b"))
    # an id with several texts is one document
    same = base.where("node IS NOT NULL").join(nodes.hint("merge"), "node").groupBy("id").agg(F.min("rid").alias("a"), F.max("rid").alias("z"), F.collect_set("rid").alias("all")).where("a < z").select("a", F.explode("all").alias("b"))
    final = connected(edges.unionByName(same))
    out = base.join(nodes.hint("merge"), "node", "left").join(final.withColumnRenamed("node", "rid").hint("merge"), "rid", "left")
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.coalesce("component", "rid", "id").alias("component"))


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(documents(spark, sf_dir), 4, 85, 100).withColumnRenamed("component", "component_id")


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END) AS g FROM w),
n AS (SELECT w.doc_id, count(s.g) AS n_shingles FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 85 * (nx.n_shingles + ny.n_shingles - i)),
c(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT c.doc_id, l.y FROM c JOIN l ON l.x = c.r)
SELECT n.doc_id, CAST(n.n_shingles AS BIGINT) AS n_shingles, min(c.r) AS component_id FROM n JOIN c ON c.doc_id = n.doc_id GROUP BY n.doc_id, n.n_shingles
"""
