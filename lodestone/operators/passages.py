"""Where passages stand in texts, whatever white space lies between their characters.

Passages and texts are compared without white space. A passage has one anchor, a hash of K characters at a place of it: of the hashes that content alone samples the smallest, its first
if none is sampled, and of a passage shorter than K the whole. Texts give their sampled hashes, and those that unsampled or short anchors ask for; both sides are joined by hash, the places are
compared character by character, and the places' characters are counted back in the original text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.dealing import met
from lodestone.sources.scratch import cut

K, EVERY = 12, 16
#: Anchors up to which texts only give what is asked for: 8 bytes of each are sent to the tasks. Beyond, the join does that.
SENT = 1 << 20
#: Characters of a text that are hashed at a time.
PART = 1 << 18
_SPACE = np.array([9, 10, 11, 12, 13, 32])


def characters(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The characters of a text other than white space, as numbers, and their places in it."""
    whole = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    places = np.flatnonzero(~np.isin(whole, _SPACE))
    return whole[places], places


def hashes(chars: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k characters in a row, as long integers."""
    n = len(chars) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    acc = np.zeros(n, np.uint64)
    for j in range(k):
        acc = (acc ^ chars[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(29)
    return acc.view(np.int64)


def _sampled(h: np.ndarray) -> np.ndarray:
    return (h & (EVERY - 1)) == 0


def _anchors(batches):
    """id, n, k, hash, at of passages: k is negative where texts have to be asked for that very hash."""
    for b in batches:
        rows = []
        for i, text in enumerate(b.column(1).to_pylist()):
            chars, _ = characters(text)
            if len(chars):
                k = min(K, len(chars))
                h = hashes(chars, k)
                at = np.flatnonzero(_sampled(h)) if k == K else np.zeros(0, np.int64)
                place = int(at[h[at].argmin()]) if len(at) else 0
                rows.append((i, len(chars), k if len(at) else -k, int(h[place]), place))
        i, n, k, h, at = zip(*rows, strict=True) if rows else ([],) * 5
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i, pa.int64())), pa.array(n, pa.int64()), pa.array(k, pa.int32()), pa.array(h, pa.int64()), pa.array(at, pa.int64())], names=["passage", "n", "k", "hash", "at"])


def located(passages: DataFrame, docs: DataFrame, passage_id: str = "passage", doc_id: str = "doc", text: str = "text") -> DataFrame:
    """passage, doc, start, end (characters of the document's text, end exclusive) of every place where a passage stands, overlapping ones too. Ids name rows.

    Null texts and those of white space alone are nowhere and have nothing. A hot anchor, such as that of a passage which many documents have, is dealt to many tasks."""
    spark = docs.sparkSession
    said = passages.select(F.col(passage_id).alias("passage"), F.col(text).alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    asked = cut(said.mapInArrow(_anchors, f"passage {said.schema['passage'].dataType.simpleString()}, n long, k int, hash long, at long"), "anchors")
    kinds = {r["k"]: r["n"] for r in asked.groupBy("k").agg(F.count_distinct("hash").alias("n")).collect()}  # 2 K rows at most
    sent = None
    if sum(kinds.values()) <= SENT:
        table = asked.select("k", "hash").distinct().toArrow()
        k, h = table.column("k").to_numpy(), table.column("hash").to_numpy()
        sent = {x: np.sort(h[k == x]) for x in kinds}
    shared = spark.sparkContext.broadcast(sent)

    def given(batches):
        for b in batches:
            out = [(np.zeros(0, np.int64),) * 4]
            for i, text in enumerate(b.column(1).to_pylist()):
                chars, _ = characters(text)
                for k in kinds:
                    for lo in range(0, len(chars), PART):
                        h = hashes(chars[lo : lo + PART + abs(k) - 1], abs(k))
                        at = np.flatnonzero(_sampled(h)) if k > 0 else np.arange(len(h))
                        if shared.value is not None and len(at):
                            there = shared.value[k]
                            at = at[there[np.minimum(np.searchsorted(there, h[at]), len(there) - 1)] == h[at]]
                        out.append((np.full(len(at), i), np.full(len(at), k), h[at], at + lo))
            i, k, h, at = (np.concatenate(c) for c in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), pa.array(k, pa.int32()), pa.array(h), pa.array(at)], names=["doc", "k", "hash", "place"])

    texts = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    have = texts.mapInArrow(given, f"doc {kind}, k int, hash long, place long")
    pairs = met(have, asked, ["k", "hash"]).select("doc", "passage", (F.col("place") - F.col("at")).alias("begin")).where("begin >= 0")
    # of a document, each passage with all the places where it may stand
    places = pairs.groupBy("doc", "passage").agg(F.collect_set("begin").alias("begins")).join(said.withColumnRenamed("text", "words"), "passage")
    rows = texts.withColumnRenamed("doc", "__doc").join(places, F.col("__doc") == F.col("doc")).select("passage", "doc", "text", "words", "begins")

    def compared(batches):
        for b in batches:
            out = [(np.zeros(0, np.int64),) * 3]
            seen = None
            for i, (text, words, begins) in enumerate(zip(*(b.column(c).to_pylist() for c in (2, 3, 4)), strict=True)):
                if seen is None or seen[0] != text:
                    seen = text, *characters(text)
                chars, at = seen[1:]
                want, _ = characters(words)
                found = np.array([s for s in sorted(begins) if np.array_equal(chars[s : s + len(want)], want)], np.int64)
                out.append((np.full(len(found), i), at[found] if len(found) else found, at[found + len(want) - 1] + 1 if len(found) else found))
            i, start, end = (np.concatenate(c) for c in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), b.column(1).take(pa.array(i)), pa.array(start), pa.array(end)], names=["passage", "doc", "start", "end"])

    return rows.mapInArrow(compared, f"passage {said.schema['passage'].dataType.simpleString()}, doc {kind}, start long, end long")
