"""Alignment of two tokenizers: which tokens of the one cover the same bytes as which of the other.

A encodes blank + text, B encodes the text and puts the blank before it itself; both sequences spell the same bytes. Each side marks the ends of its
tokens in a packed bitset over the bytes of many texts. The AND of both holds the shared cuts, where popcount ranks give the number of tokens of
either side before a cut, and so the token ranges of each group. Every bit of the OR ends one stretch of bytes that
lies in one token of A and one of B, which are two tokens that overlap: the ranks before that bit give the link's two tokens.

Both sides cut a text before a blank between a visible character and another; so texts are encoded by such segments, each different one once
in a while in each task, and a text of any length is worked on in sections of about half a megabyte. The links of a document are kept as its different
pairs of ids with their numbers. Corpus-wide counts of pairs are sums, made in each task first. The most frequent pairs, at most `hot`, are sent to the
tasks; documents' rarer pairs are joined with the rest of the counts.

Null and empty texts, and texts whose tokens of either side don't spell blank + text, have no tokens: zeros, and the empty string for the groups.
Equal texts get equal values, repeated rows and rows without id a row each, and each adds to the counts. Ties for a token's best
count are all best. Extra columns pass through where they are kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.shared import Grown, Numbers, Ragged, columns_free, documents, lean, small_batches, stage, text_bytes

SECTION, CACHED, HOT = 1 << 19, 500_000, 1 << 19
#: White space in UTF-8, other than inside a character; a segment does not begin with it.
_SPACE = rb"(?:[\x09-\x0d\x1c-\x20]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8f\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)"
_STARTS_WITH_SPACE = re.compile(_SPACE)
#: A blank that the next segment may not begin with, or where that has to be looked at.
_ODD = re.compile(rb" (?:" + _SPACE + rb"|\Z)|\A" + _SPACE)
_CUT = re.compile(rb"[!-~\x80-\xff] (?=[!-~])")


# ---------------------------------------------------------------- the two tokenizers


def byte_of() -> dict[str, int]:
    """Byte-level vocabularies write visible Latin-1 characters as themselves, the other bytes as characters from 256 on, in order."""
    seen = [b for b in range(256) if chr(b).isprintable() and b != 32 and b != 173]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE of the tokenizers library. Strings of special tokens are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.tok.encode_special_tokens = True
        codes, added = byte_of(), self.tok.get_added_tokens_decoder()
        names = [self.tok.id_to_token(i) or "" for i in range(self.tok.get_vocab_size())]
        self.bytes = [n.encode() if i in added else bytes(map(codes.__getitem__, n)) for i, n in enumerate(names)]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)

    def segments(self, segments: list[bytes]) -> list[list[int]]:
        """Ids of blank + segment. Segments that begin with no white space are encoded together, as they are cut there anyway."""
        plain = [i for i, s in enumerate(segments) if not _STARTS_WITH_SPACE.match(s)]
        out: list[list[int]] = [[]] * len(segments)
        for lo in range(0, len(plain), 4096):
            some = plain[lo : lo + 4096]
            ids = self.tok.encode("".join(" " + segments[i].decode() for i in some), add_special_tokens=False).ids
            ends = np.cumsum(self.lengths[ids])
            want = np.cumsum([len(segments[i]) + 1 for i in some])
            cuts = np.searchsorted(ends, want)
            if cuts[-1] >= len(ends) or (ends[cuts] != want).any():
                raise ValueError("this tokenizer does not cut before a blank")
            cuts = [0, *(cuts + 1).tolist()]
            for i, x, y in zip(some, cuts, cuts[1:], strict=False):
                out[i] = ids[x:y]
        alone = sorted(set(range(len(segments))) - set(plain))
        for i, e in zip(alone, self.tok.encode_batch([" " + segments[i].decode() for i in alone], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out


class Pieces:
    """A sentencepiece model, which puts the blank before a text itself; bytes that it has no piece for have one each."""

    def __init__(self, path: str):
        import sentencepiece

        self.tok = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.tok.get_piece_size()
        names = [self.tok.id_to_piece(i) for i in range(n)]
        if any("▁" in name.lstrip("▁") for name in names):
            raise ValueError("this model has pieces with a blank inside")
        self.bytes = [bytes([int(name[3:5], 16)]) if self.tok.is_byte(i) else name.replace("▁", " ").encode() for i, name in enumerate(names)]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)

    def segments(self, segments: list[bytes]) -> list[list[int]]:
        return self.tok.encode([s.decode() for s in segments], num_threads=1)


@lru_cache(maxsize=4)
def sides(path_a: str, path_b: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(path_a), Pieces(path_b)


def split(text: bytes) -> list[bytes]:
    """The segments of a text, each without the blank before it: they begin after a blank that follows a character other than a blank and comes before one other than white space."""
    parts = text.split(b" ")
    if not _ODD.search(text):
        return parts
    out = parts[:1]
    for before, part in zip(parts, parts[1:], strict=False):
        if before and part and not _STARTS_WITH_SPACE.match(part):
            out.append(part)
        else:
            out[-1] += b" " + part
    return out


def sections(text: bytes, most: int = SECTION) -> list[bytes]:
    """A long text cut where segments begin, after `most` bytes or as soon as there is such a place."""
    out, at = [], 0
    while len(text) - at > most:
        cut = _CUT.search(text, at + most)
        if not cut:
            break
        out.append(text[at : cut.end() - 1])
        at = cut.end()
    return [*out, text[at:]]


# ---------------------------------------------------------------- bitsets


def marked(ends: np.ndarray, n: int) -> np.ndarray:
    """A bitset of n bits or some more, with the bit before each end set."""
    bits = np.zeros(-(-n // 64) * 64 + 64, np.uint8)
    bits[ends - 1] = 1
    return np.packbits(bits, bitorder="little").view("<u8")


def selected(bits: np.ndarray) -> np.ndarray:
    """The places of the bits that are set."""
    return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))


class Ranks:
    """How many bits of a bitset are set before a place."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.before = bits, np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])

    def __call__(self, at: np.ndarray) -> np.ndarray:
        word, low = at >> 6, (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.bits[word] & low)


def _decimal(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Text of each id with a separator after it, ',', '|' or ';', as row 3 * id + which; and which bytes of a row count."""
    rows = [f"{i}{s}".encode() for i in range(n) for s in ",|;"]
    width = max(map(len, rows), default=1)
    table = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(-1, width)
    return table, table != 0


class Aligner:
    """Aligns texts in one worker."""

    def __init__(self, path_a: str, path_b: str, cached: int = CACHED, section: int = SECTION):
        self.a, self.b = sides(path_a, path_b)
        self.cached, self.section, self.table = cached, section, _decimal(max(len(self.a.bytes), len(self.b.bytes)))
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.ids_a, self.ids_b, self.fine = Numbers(), Ragged(), Ragged(), Grown(bool)

    def _learn(self) -> None:
        new, self.numbers.new = self.numbers.new, []
        for lo in range(0, len(new), 20_000):
            some = new[lo : lo + 20_000]
            fine = np.ones(len(some), bool)
            for ids, side in ((self.ids_a, self.a), (self.ids_b, self.b)):
                rows = side.segments(some)
                if b"".join(map(side.bytes.__getitem__, ids.extend(rows).tolist())) != b" " + b" ".join(some):
                    fine &= [b"".join(map(side.bytes.__getitem__, r)) == b" " + s for r, s in zip(rows, some, strict=True)]
            self.fine.extend(fine)

    def sections(self, texts: list[bytes]):
        """For each of some sections, each not empty: (fine, n_a, n_b, n_groups, n_links, groups, pairs, how often each)."""
        parts = [split(t) for t in texts]
        words = [w for p in parts for w in p]
        rows = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        self._learn()
        owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        fine = np.ones(len(texts), bool)
        fine[owner[~self.fine.array[rows]]] = False
        keep = fine[owner]
        rows, owner = rows[keep], owner[keep]
        (a, ends), (b, ends_b) = self.ids_a.gathered(rows), self.ids_b.gathered(rows)
        if len(self.numbers) > self.cached:
            self._forget()
        if not len(rows):
            return [(bool(f), 0, 0, 0, 0, b"", np.zeros(0, np.int64), np.zeros(0, np.int64)) for f in fine]
        last = np.searchsorted(owner, np.arange(len(texts)), "right") - 1  # a text's last segment, or that of one before
        n_a, n_b = (np.diff(np.concatenate([[0], np.where(last >= 0, e[last], 0)])) for e in (ends, ends_b))
        ends_a, ends_b = np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b])
        size = int(ends_a[-1])
        bits_a, bits_b = marked(ends_a, size), marked(ends_b, size)
        rank_a, rank_b = Ranks(bits_a), Ranks(bits_b)
        # groups: tokens of both sides up to each shared cut
        cuts = selected(bits_a & bits_b) + 1
        to_a, to_b = rank_a(cuts), rank_b(cuts)
        texts_end = np.concatenate([[0], ends_a])[np.cumsum(n_a)]
        n_groups = np.diff(np.searchsorted(cuts, texts_end, "right"), prepend=0)
        # links: one for each bit that either side has
        links = selected(bits_a | bits_b)
        n_links = np.diff(np.searchsorted(links, texts_end), prepend=0)
        pairs = a[rank_a(links)].astype(np.int64) * len(self.b.bytes) + b[rank_b(links)]
        owned = np.sort(np.repeat(np.arange(len(texts)), n_links) << 42 | pairs)
        first = np.flatnonzero(np.concatenate([[True], owned[1:] != owned[:-1]]))
        times = np.diff(np.append(first, len(owned)))
        pairs, whose = owned[first] & ((1 << 42) - 1), owned[first] >> 42
        at = np.searchsorted(whose, np.arange(len(texts) + 1))
        # groups as text: A's tokens, then B's, of each group
        from_a, from_b = np.concatenate([[0], to_a[:-1]]), np.concatenate([[0], to_b[:-1]])
        many_a, many_b = to_a - from_a, to_b - from_b
        codes = np.empty(len(a) + len(b), np.int64)
        row_a, row_b = 3 * a.astype(np.int64), 3 * b.astype(np.int64)
        row_a[to_a - 1] += 1
        row_b[to_b - 1] += 2
        codes[np.arange(len(a)) + np.repeat(from_b, many_a)] = row_a
        codes[np.arange(len(b)) + np.repeat(to_a, many_b)] = row_b
        table, real = self.table
        used = real[codes]
        said = table[codes][used].tobytes()
        edges = np.concatenate([[0], np.cumsum(used.sum(1))])[np.concatenate([[0], np.cumsum(n_a + n_b)])].tolist()
        counts = zip(fine.tolist(), n_a.tolist(), n_b.tolist(), n_groups.tolist(), n_links.tolist(), strict=True)
        return [(*c, said[edges[i] : edges[i + 1]], pairs[at[i] : at[i + 1]], times[at[i] : at[i + 1]]) for i, c in enumerate(counts)]

    def texts(self, data: bytes, offs: np.ndarray):
        """(n_a, n_b, n_groups, n_links, parts of the groups' text, pairs, how often each) of each text, in order. Sections of short texts are worked on together."""
        waiting: list[tuple[int, bytes]] = []
        got: dict[int, list] = {}
        weight = told = 0
        n = len(offs) - 1
        for i, (lo, hi) in enumerate(zip(offs.tolist(), offs[1:].tolist(), strict=False)):
            for s in sections(data[lo:hi], self.section) if hi > lo else []:
                waiting.append((i, s))
                weight += len(s)
                if weight >= self.section:
                    self._work(waiting, got)
                    weight = 0
            if i == n - 1 and waiting:
                self._work(waiting, got)
            if not waiting:
                for k in range(told, i + 1):
                    yield self._whole(got.pop(k, []))
                told = i + 1

    def _work(self, waiting: list[tuple[int, bytes]], got: dict[int, list]) -> None:
        for (i, _), r in zip(waiting, self.sections([s for _, s in waiting]), strict=True):
            got.setdefault(i, []).append(r)
        waiting.clear()

    def _whole(self, parts: list):
        none = np.zeros(0, np.int64)
        if not parts or not all(p[0] for p in parts):
            return 0, 0, 0, 0, [], none, none
        if len(parts) == 1:
            return *parts[0][1:5], [parts[0][5][:-1]], *parts[0][6:]
        sums = [sum(p[k] for p in parts) for k in range(1, 5)]
        pairs, back = np.unique(np.concatenate([p[6] for p in parts]), return_inverse=True)
        times = np.bincount(back, weights=np.concatenate([p[7] for p in parts])).astype(np.int64)
        return *sums, [*(p[5] for p in parts[:-1]), parts[-1][5][:-1]], pairs, times


def _sha256(parts: list[bytes]) -> str:
    if not parts:
        return ""
    h = hashlib.sha256()
    for p in parts:
        h.update(p)
    return h.hexdigest()


# ---------------------------------------------------------------- operators

_KINDS = {"n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups": pa.string(), "groups_sha256": pa.string(), "pairs": pa.binary(), "times": pa.binary()}
_PLACE = {"n_a": 0, "n_b": 1, "n_groups": 2, "n_links": 3}


def _pair_type(path_a: str, path_b: str) -> str:
    a, b = sides(path_a, path_b)
    return "<u4" if len(a.bytes) * len(b.bytes) <= 1 << 32 else "<u8"


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text", keep: list[str] | None = None, what: tuple[str, ...] = ("n_a", "n_b", "n_groups", "n_links", "groups"), cached: int = CACHED, section: int = SECTION) -> DataFrame:
    """docs' columns `keep` (all by default) and, as asked for in `what`: n_a, n_b, n_groups, n_links; groups, like `a1,a2|b1;a3|b2,b3` with the ids of both
    sides in order; groups_sha256 of that; pairs and times, the different linked pairs (id of A times B's vocabulary size plus id of B) in order
    and how often the text has each, as packed integers. A column of docs that has such a name gives way to the new one."""
    spark_types = {pa.int64(): T.LongType(), pa.string(): T.StringType(), pa.binary(): T.BinaryType()}
    kept = [c for c in (docs.columns if keep is None else keep) if c not in what]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(k, spark_types[_KINDS[k]]) for k in what])
    (body,) = columns_free(docs, "__text")

    def run(batches):
        aligner, kind = Aligner(path_a, path_b, cached, section), _pair_type(path_a, path_b)
        make = {"groups": lambda r: b"".join(r[4]).decode(), "groups_sha256": lambda r: _sha256(r[4]), "pairs": lambda r: r[5].astype(kind).tobytes(), "times": lambda r: r[6].astype("<u4").tobytes()}
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                data, offs = text_bytes(part.column(len(kept)))
                got = [[r[_PLACE[k]] if k in _PLACE else make[k](r) for k in what] for r in aligner.texts(data.tobytes(), offs)]
                made = [pa.array([r[j] for r in got], _KINDS[k]) for j, k in enumerate(what)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *made], names=[*kept, *what])

    small_batches(docs.sparkSession)
    return docs.select(*kept, docs[text].alias(body)).mapInArrow(lean(run), schema)


def pair_counts(aligned: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """pair, b, n (links of that pair in all documents), best (whether no pair of that b has more); aligned: with columns pairs and times."""
    kind, width = _pair_type(path_a, path_b), len(sides(path_a, path_b)[1].bytes)

    def tally(batches):
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting, weight = [], 0

        def merged(keys, sums):
            pairs, times = (np.concatenate(x) for x in zip((keys, sums), *waiting, strict=True))
            order = np.argsort(pairs, kind="stable")
            pairs, times = pairs[order], times[order]
            first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
            return pairs[first], np.add.reduceat(times, first) if len(first) else times

        for batch in batches:
            waiting.append(tuple(np.frombuffer(_joined(batch.column(i)), k).astype(np.int64) for i, k in ((0, kind), (1, "<u4"))))
            weight += len(waiting[-1][0])
            if weight >= 1 << 21:
                keys, sums = merged(keys, sums)
                waiting, weight = [], 0
        keys, sums = merged(keys, sums)
        for lo in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[lo : lo + (1 << 16)]), pa.array(sums[lo : lo + (1 << 16)])], names=["pair", "n"])

    sums = stage(aligned.select("pairs", "times").mapInArrow(lean(tally), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "alignment-counts")
    sums = sums.withColumn("b", F.pmod("pair", F.lit(width)).cast("int"))
    most = sums.groupBy(F.col("b").alias("b2")).agg(F.max("n").alias("most"))  # as many rows as B has tokens, at most
    return sums.join(F.broadcast(most), sums["b"] == most["b2"]).select("pair", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def _joined(column: pa.Array) -> bytes:
    """The bytes of a binary column's rows, one after the other."""
    if not len(column):
        return b""
    offs = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return memoryview(column.buffers()[2] or b"")[offs[0] : offs[-1]]


def link_scores(aligned: DataFrame, path_a: str, path_b: str, hot: int = HOT) -> DataFrame:
    """aligned, with columns pairs and times, with n_best (links whose count is the highest of their B id) and count_sum (the sum of the links' counts) in
    place of these two. At most `hot` pairs are sent to the tasks, those that occur most; a document's other pairs are joined with theirs."""
    spark, kind = aligned.sparkSession, _pair_type(path_a, path_b)
    key, best, total = columns_free(aligned, "__key", "n_best", "count_sum")
    kept = [c for c in aligned.columns if c not in ("pairs", "times")]
    small_batches(spark)
    aligned = stage(aligned.withColumn(key, F.monotonically_increasing_id()), "alignment")
    counts = stage(pair_counts(aligned, path_a, path_b), "alignment-best")
    sizes = sorted((r["k"], r["m"]) for r in counts.groupBy(F.length(F.bin("n")).alias("k")).agg(F.count("*").alias("m")).collect())  # 63 rows at most
    least, room = 1 << 62, hot
    while sizes and sizes[-1][1] <= room:
        k, m = sizes.pop()
        least, room = 1 << (k - 1), room - m
    table = counts.where(F.col("n") >= least).select("pair", "n", "best").toArrow().sort_by("pair")
    shared = spark.sparkContext.broadcast([table.column(i).to_numpy() for i in range(3)])

    def looked_up(batch: pa.RecordBatch):
        """Of the last two columns: pairs, times, which pairs are in the table, where, and each row's first pair."""
        packed, often = batch.columns[-2:]
        pairs, times = np.frombuffer(_joined(packed), kind).astype(np.int64), np.frombuffer(_joined(often), "<u4").astype(np.int64)
        edges = np.concatenate([[0], np.cumsum([len(p.as_buffer()) for p in packed])]) // np.dtype(kind).itemsize
        keys = shared.value[0]
        where = np.minimum(np.searchsorted(keys, pairs), max(0, len(keys) - 1))
        return pairs, times, keys[where] == pairs if len(keys) else np.zeros(len(pairs), bool), where, edges

    def score(batches):
        _, n, top = shared.value
        for batch in batches:
            _, times, there, where, edges = looked_up(batch)
            sums = []
            for value in (top, n):
                each = np.where(there, times * value[where], 0) if len(value) else 0 * times
                run = np.concatenate([[0], np.cumsum(each)])
                sums.append(pa.array(run[edges[1:]] - run[edges[:-1]], pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *sums], names=[*batch.schema.names[:-2], best, total])

    def others(batches):
        for batch in batches:
            pairs, times, there, _, edges = looked_up(batch)
            rows, pairs, times = np.repeat(np.arange(batch.num_rows), np.diff(edges))[~there], pairs[~there], times[~there]
            for lo in range(0, len(rows), 1 << 16):
                some = slice(lo, lo + (1 << 16))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[some])), pa.array(pairs[some]), pa.array(times[some])], names=["key", "pair", "times"])

    made = [T.StructField(best, T.LongType()), T.StructField(total, T.LongType())]
    first = aligned.select(*kept, key, "pairs", "times").mapInArrow(score, T.StructType([aligned.schema[c] for c in [*kept, key]] + made))
    if not sizes:
        return first.drop(key)
    rest = aligned.select(key, "pairs", "times").mapInArrow(lean(others), "key long, pair long, times long")
    found = rest.join(counts.where(F.col("n") < least).select("pair", "n", "best").hint("merge"), "pair")
    more = found.groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more"))
    both = first.join(more.hint("merge"), first[key] == more["key"], "left")
    sums = [(first[c] + F.coalesce(more[m], F.lit(0))).alias(c) for c, m in ((best, "more_best"), (total, "more"))]
    return both.select(*(first[c] for c in kept), *sums)


def paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = align(documents(spark, sf_dir), *paths(), keep=["doc_id"], what=("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"))
    return link_scores(aligned, *paths())
