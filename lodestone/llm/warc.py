"""WARC archives: writing with payload deduplication, and reading with boundary-chain verification.

Writing is Spark's own text writer: a record is one string of headers and block, and the blank lines that end a record are the line
separator, so archives land on any file system that Spark knows.

Reading: each task scans its archives for every place that looks like the head of a record, inside payloads too, and
emits the candidate and its successor, the byte after its block. Within ranges of `span` bytes the successors are followed at once,
to the first one beyond the range; across ranges, pointer jumping from the file's start (reached places doubled a round, as
many rounds as the logarithm of the ranges of a file) finds where the chain of real records enters each range. Candidates that
the chain does not reach are no records.

Null payloads count as empty, null URLs are left out, an empty table gives no records; very long URLs and payloads are written whole. Of rows that share the smallest
page_id of a payload all are responses. A file that does not begin with a record has none; a chain that breaks off ends
there. Extra columns of the input are ignored. Archives compressed as a whole or by record (gzip) are read too; places then count unpacked bytes.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import lean, shared_dir, stage

LEAST = 100  # bytes of payload from which on equal payloads are stored once
SMALL = 1 << 18  # repeated digests, of some 100 bytes each, up to which they are broadcast
SPAN = 1 << 20
_HEAD = re.compile(rb"WARC/1\.[01]\r\n")
_URN = "urn:lodestone:page:"
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def plan(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST, small: int = SMALL) -> tuple[DataFrame, int]:
    """The rows (id, url, body, digest, n: bytes, first: of equal payloads the smallest id, null where a payload is short or
    not repeated), and the mean bytes of a payload.

    Digests alone are counted. Where the repeated ones, counted, are at most `small`, they are sent to all tasks and no payload is
    shuffled. Beyond that those of more than a 4096th of all repeats, of which there are fewer than 4096, are sent, and the others
    joined by digest; rows that need no partner are spread by id."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumns({"digest": F.sha2("body", 256), "n": F.octet_length("body").cast("long")})
    mean = int(rows.agg(F.avg("n")).first()[0] or 0)
    repeated = rows.where(F.col("n") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("times")).where("times > 1")
    repeated = stage(repeated, "warc-repeated")
    facts = repeated.agg(F.count("*").alias("digests"), F.sum("times").alias("times")).first()
    if facts["digests"] <= small:
        return rows.join(F.broadcast(repeated.select("digest", "first")), "digest", "left"), mean
    hot = F.col("times") * 4096 > facts["times"]
    rows = rows.join(F.broadcast(repeated.where(hot).select("digest", F.col("first").alias("hot"))), "digest", "left")
    key = F.when((F.col("n") >= least) & F.col("hot").isNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    cold = repeated.where(~hot).select(F.col("digest").alias("key"), "first")
    rows = rows.withColumn("key", key).join(cold.hint("merge"), "key", "left")
    return rows.withColumn("first", F.coalesce("hot", "first")).drop("key", "hot"), mean


def write(pages: DataFrame, path: str, id: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST, records_per_file: int = 8192, bytes_per_file: int = 64 << 20, small: int = SMALL) -> None:
    """Write the rows as gzipped WARC files under path, of at most records_per_file records, and fewer where bytes_per_file holds fewer of the mean payload."""
    rows, mean = plan(pages, id, url, payload, least, small)
    records_per_file = max(1, min(records_per_file, bytes_per_file // (mean + 1024)))
    revisit = F.col("first").isNotNull() & (F.col("first") != F.col("id"))
    uri = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7f]", "%20")
    line = lambda name, *value: F.concat(F.lit(name + ": "), *value, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, F.lit("")).otherwise(F.concat(http, F.col("body").cast("string")))
    length = F.when(revisit, F.lit(0)).otherwise(F.octet_length(http) + F.col("n"))
    record = F.concat(
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.lit(f"<{_URN}"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">")),
        line("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        line("WARC-Payload-Digest", F.lit("sha256:"), F.col("digest")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(_PROFILE)), line("WARC-Refers-To", F.lit(f"<{_URN}"), F.col("first").cast("string"), F.lit(">")))).otherwise(F.lit("")),
        line("X-Payload-Length", F.col("n").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
        block,
    )
    rows.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(path)


def heads(data: bytes) -> list[tuple[int, int, int, dict[str, str]]]:
    """(offset, start of the block, successor, headers) of every place that could begin a record."""
    out = []
    for m in _HEAD.finditer(data):
        end = data.find(b"\r\n\r\n", m.end() - 2)
        if end < 0:
            continue
        fields = {}
        for row in data[m.end() : end].split(b"\r\n"):
            name, colon, value = row.partition(b":")
            if colon:
                fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
        size = fields.get("content-length", "")
        if size.isascii() and size.isdigit() and len(size) < 16:
            out.append((m.start(), end + 4, end + 4 + int(size) + 4, fields))
    return out


def exits(offsets: list[int], successors: list[int], span: int) -> list[int]:
    """Where the chain from each candidate leaves its range of `span` bytes; -1 where it comes to a place that begins no record."""
    known = dict(zip(offsets, successors, strict=True))
    out: dict[int, int] = {}
    for o in sorted(offsets, reverse=True):
        s = known[o]
        out[o] = s if s // span > o // span else out.get(s, -1)
    return [out[o] for o in offsets]


def unpacked(data: bytes) -> bytes:
    """The bytes of an archive whose members, one or many, may be gzipped."""
    if data[:2] != b"\x1f\x8b":
        return data
    parts = []
    while data[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        parts.append(d.decompress(data))
        data = d.unused_data
    return b"".join(parts)


CANDIDATES = "path string, span_no long, offset long, successor long, leaves long, type string, id string, refers_to string, digest string, stated string, stated_bytes long, bytes long, headers map<string,string>"


def candidates(files: DataFrame, span: int = SPAN) -> DataFrame:
    """files: path, content. A row for every place that could begin a record, with what it would hold."""
    kinds = [pa.string(), *[pa.int64()] * 4, *[pa.string()] * 5, *[pa.int64()] * 2, pa.map_(pa.string(), pa.string())]
    names = [c.split()[0] for c in CANDIDATES.split(", ")]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                path, data = batch.column(0)[k].as_py(), unpacked(batch.column(1)[k].as_py() or b"")
                found = heads(data)
                ends = exits([f[0] for f in found], [f[2] for f in found], span)
                rows = []
                for (at, start, nxt, h), leave in zip(found, ends, strict=True):
                    block = data[start : nxt - 4]
                    if h.get("content-type", "").startswith("application/http"):
                        cut = block.find(b"\r\n\r\n")
                        block = block[cut + 4 :] if cut >= 0 else b""
                    stated = h.get("x-payload-length", "")
                    rows.append((path, at // span, at, nxt, leave, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-refers-to"), hashlib.sha256(block).hexdigest(), h.get("warc-payload-digest"), int(stated) if stated.isdigit() else None, len(block), list(h.items())))
                for lo in range(0, len(rows), 2000):
                    yield pa.RecordBatch.from_arrays([pa.array(list(v), kind) for v, kind in zip(zip(*rows[lo : lo + 2000], strict=True), kinds, strict=True)], names=names)

    return files.select("path", "content").mapInArrow(lean(run), CANDIDATES)


def records(spark: SparkSession, path: str, span: int = SPAN) -> DataFrame:
    """The records of the archives under path: those candidates that the chain from the file's start reaches."""
    found = stage(candidates(spark.read.format("binaryFile").load(path), span), "warc-candidates")
    last = found.agg(F.max("span_no")).first()[0] or 0
    reached = found.where("offset = 0").select("path", "offset")
    jump = found.where("leaves >= 0").select("path", "offset", "leaves")
    for k in range(int(last).bit_length()):
        reached = stage(reached.unionByName(reached.join(jump.hint("merge"), ["path", "offset"]).select("path", F.col("leaves").alias("offset"))).distinct(), f"warc-reached-{k}")
        after = jump.select("path", F.col("offset").alias("leaves"), F.col("leaves").alias("then"))
        jump = stage(jump.join(after.hint("merge"), ["path", "leaves"]).select("path", "offset", F.col("then").alias("leaves")), f"warc-jump-{k}")
    entries = reached.select("path", F.expr(f"offset div {span}").alias("span_no"), F.col("offset").alias("entry"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        following = dict(zip(pdf["offset"], pdf["successor"], strict=True))
        at, real = pdf["entry"].iloc[0], []
        while at in following:
            real.append(at)
            at = following[at]
        return pdf.loc[pdf["offset"].isin(real), ["path", "span_no", "offset"]]

    # a range's candidates: as many as `span` bytes can hold
    chain = found.select("path", "span_no", "offset", "successor").join(entries.hint("merge"), ["path", "span_no"]).groupBy("path", "span_no").applyInPandas(walk, "path string, span_no long, offset long")
    return found.join(chain.hint("merge"), ["path", "span_no", "offset"], "left_semi")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    got = records(spark, path)
    number = lambda c: F.regexp_extract(c, r"^<urn:lodestone:page:(-?\d+)>$", 1).try_cast("long")
    revisit = F.col("type") == "revisit"
    return got.select(
        number(F.col("id")).alias("page_id"),
        F.when(revisit, F.col("stated_bytes")).otherwise(F.col("bytes")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("stated", "^sha256:", "")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        number(F.col("refers_to")).alias("refers_to"),
    )


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS f FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f <> page_id THEN f END AS refers_to
FROM r
"""
