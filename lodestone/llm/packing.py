"""Best-fit packing of token sequences by exact-complement hashing.

A document's ids and an end id are cut into pieces of at most `size` tokens, of which all but the last are full. What is packed are the
numbers of pieces of each length, at most `size` of them whatever the corpus holds: the longest length left opens a sequence, and a single
length, a pair or a triple of lengths that fills the gap exactly is looked up by its sum. The combination found is used as often as the numbers allow. Where
none fills the gap, the best-fitting length goes in and the rest of the gap is looked up, until nothing fits. Lookups by sum are kept while their lengths
are there; as numbers only fall, a sum without a combination never gets one.

The plan is a table of ranges: the pieces of one length with ranks from r on go to the sequences from s on, at one place. Ranks are made in
two steps, within each task that cuts documents and then over the tasks' numbers, so a length that a third of all pieces have is spread like others.
To the driver go the numbers of pieces by length, to the tasks the plan, both bounded by `size`.

Null and empty texts are a piece with the end id alone. Equal rows, rows without id and those that share an id are pieces of their own. Which of the pieces of a length goes
where is arbitrary, the number of sequences is not. Texts of any length are encoded in sections. Extra columns pass through where they are kept; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.bpe import load, tokenizer_path
from lodestone.llm.shared import Numbers, Ragged, columns_free, documents, lean, small_batches, stage, text_bytes

SIZE, END = 4096, 1


# ---------------------------------------------------------------- the plan


class Lengths:
    """How many pieces of each length there are, how many of them the combination in hand leaves, and which pairs and triples have a sum."""

    def __init__(self, counts: np.ndarray):
        self.all, self.left = counts.astype(np.int64), counts.astype(np.int64)
        self.pairs: dict[int, tuple[int, ...]] = {}
        self.triples: dict[int, tuple[int, ...]] = {}
        self.no_pair, self.no_triple = np.zeros(len(counts), bool), np.zeros(len(counts), bool)

    def take(self, lengths) -> None:
        for x in lengths:
            self.left[x] -= 1

    def use(self, lengths, times: int) -> None:
        """The combination in hand is used up so many times."""
        for x in lengths:
            self.all[x] -= times
        self.left[:] = self.all

    def has(self, lengths: tuple[int, ...]) -> bool:
        return all(self.left[x] >= n for x, n in Counter(lengths).items())

    def pair(self, total: int) -> tuple[int, ...] | None:
        """The pair with the longest length that has this sum."""
        if total < 2 or self.no_pair[total]:
            return None
        known = self.pairs.get(total)
        if known and self.has(known):
            return known
        long = np.arange(total - 1, (total - 1) // 2, -1)
        for numbers in (self.left, self.all):
            there = (numbers[long] > 0) & (numbers[total - long] > (long * 2 == total))
            if there.any():
                if numbers is self.all:
                    return None
                a = int(long[there.argmax()])
                self.pairs[total] = known = a, total - a
                return known
        self.no_pair[total] = True
        return None

    def triple(self, total: int) -> tuple[int, ...] | None:
        """A triple with the longest length for which there is a pair."""
        if total < 3 or self.no_triple[total]:
            return None
        known = self.triples.get(total)
        if known and self.has(known):
            return known
        third = np.flatnonzero((self.all[1 : total - 1] > 0) & ~self.no_pair[total - 1 : 1 : -1]) + 1
        for c in third[::-1].tolist():
            if self.left[c] > 0:
                self.left[c] -= 1
                rest = self.pair(total - c)
                self.left[c] += 1
                if rest:
                    self.triples[total] = known = c, *rest
                    return known
        self.no_triple[total] = not len(third)
        return None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.left[gap] > 0 else self.pair(gap) or self.triple(gap)


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of lengths, each with the number of sequences filled by it; counts[n]: pieces of length n, up to the size of a sequence."""
    lengths, size, out = Lengths(counts), len(counts) - 1, []
    if counts[0]:
        raise ValueError("pieces have at least one token")
    for first in range(size, 0, -1):
        while lengths.left[first] > 0:
            chosen, gap = [first], size - first
            lengths.take(chosen)
            while gap:
                found = lengths.exact(gap)
                if not found:
                    fits = np.flatnonzero(lengths.left[1 : gap + 1] > 0)
                    if not len(fits):
                        break
                    found = (int(fits[-1]) + 1,)
                lengths.take(found)
                chosen += found
                gap -= sum(found)
            times = min(int(lengths.all[x]) // n for x, n in Counter(chosen).items())
            lengths.use(chosen, times)
            out.append((tuple(chosen), times))
    return out


def ranges(combinations: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Sorted by length and rank: length << 48 | first rank, first sequence, offset in it."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for lengths, times in combinations:
        offset = 0
        for x in lengths:
            rows.append((x << 48 | used[x], sequence, offset))
            used[x] += times
            offset += x
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 3)
    return table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy()


# ---------------------------------------------------------------- encoding

#: Words (in UTF-8) of letters that normalisation keeps apart from others, each at its length; and what the splitting pattern makes of such words in lower case.
_SIMPLE = re.compile(rb"(?:[!-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ ]+| ")
_BLANK = re.compile(rb"[\x09-\x0d\x20]")


class Words:
    """Ids of whole texts by their words between ASCII white space, which never influence each other under this tokenizer. Words are looked up by number; new ones
    are put together from parts in lower case, which the tokenizer encodes many at a time."""

    def __init__(self, path: str, cached: int = 1_000_000, section: int = 1 << 20):
        self.tok, self.cached, self.section = load(path), cached, section
        names = [self.tok.id_to_token(i) or "" for i in range(self.tok.get_vocab_size())]
        self.last = np.array([n.endswith("</w>") for n in names])
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self._forget()
        self._forget_parts()

    def _forget(self) -> None:
        self.numbers, self.ids, self.weight = Numbers(), Ragged(), 0

    def _forget_parts(self) -> None:
        """Part 0 is the blank between words, without ids."""
        self.parts, self.part_ids = Numbers(), Ragged()
        self.parts[" "] = 0
        self.part_ids.extend([[]])

    def _learn_parts(self) -> None:
        new, self.parts.new = self.parts.new, []
        for lo in range(0, len(new), 4096):
            some = new[lo : lo + 4096]
            ids = np.array(self.tok.encode(" ".join(some), add_special_tokens=False).ids, np.int32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(some):
                self.part_ids.append(ids, np.diff(ends, prepend=0))
            else:
                self.part_ids.extend([e.ids for e in self.tok.encode_batch(some, add_special_tokens=False)])

    def _learn(self) -> None:
        new, self.numbers.new = self.numbers.new, []
        for lo in range(0, len(new), 20_000):
            some = new[lo : lo + 20_000]
            joined = b" ".join(some)
            self.weight += len(joined)
            rare = any(s in joined for s in self.special)
            alone = [i for i, w in enumerate(some) if not _SIMPLE.fullmatch(w) or rare and any(s in w for s in self.special)]
            got = Ragged()
            if len(alone) < len(some):
                if alone:
                    left = set(alone)
                    joined = b" ".join(w for i, w in enumerate(some) if i not in left)
                if len(self.parts) > self.cached:
                    self._forget_parts()
                marks = _PARTS.findall(joined.decode().lower())
                rows = np.fromiter(map(self.parts.__getitem__, marks), np.int64, len(marks))
                self._learn_parts()
                ids, ends = self.part_ids.gathered(rows)
                got.append(ids, np.diff(np.append(ends[rows == 0], len(ids)), prepend=0))
            got.extend([e.ids for e in self.tok.encode_batch([some[i].decode() for i in alone], add_special_tokens=False)] if alone else [])
            if alone:  # back in order
                at = np.empty(len(some), np.int64)
                at[np.setdiff1d(np.arange(len(some)), alone)], at[alone] = np.arange(len(some) - len(alone)), np.arange(len(some) - len(alone), len(some))
                ids, ends = got.gathered(at)
                self.ids.append(ids, np.diff(ends, prepend=0))
            else:
                self.ids.append(got.flat.array[: got.flat.n], np.diff(got.starts.array[: got.starts.n]))

    def _some(self, texts: list[bytes]) -> list[np.ndarray]:
        parts = [t.split() for t in texts]
        words = [w for p in parts for w in p]
        rows = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        self._learn()
        ids, ends = self.ids.gathered(rows)
        if len(self.numbers) > self.cached or self.weight > 64 * self.cached:
            self._forget()
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)]
        return [ids[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]

    def texts(self, data: bytes, offs: np.ndarray) -> list[np.ndarray]:
        out, waiting, weight = [], [], 0
        for lo, hi in zip(offs.tolist(), offs[1:].tolist(), strict=False):
            text = data[lo:hi]
            if len(text) > self.section:
                out += self._some(waiting)
                waiting, weight = [], 0
                got, at = [], 0
                while at < len(text):
                    cut = _BLANK.search(text, at + self.section)
                    end = cut.start() if cut else len(text)
                    got += self._some([text[at:end]])
                    at = end
                out.append(np.concatenate(got))
                continue
            waiting.append(text)
            weight += len(text)
            if weight > self.section:
                out += self._some(waiting)
                waiting, weight = [], 0
        return out + (self._some(waiting) if waiting else [])


@lru_cache(maxsize=2)
def known(path: str, **how) -> Words:
    """The words that a worker has met, in all its tasks."""
    return Words(path, **how)


# ---------------------------------------------------------------- operators


def pieces(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, what: str = "ids", size: int = SIZE, end: int = END, **how) -> DataFrame:
    """Of each document: its columns `keep` (all by default), piece, start, length, `what` (ids, array<int>, or ids_crc32, long), and task and rank: the
    piece's place among those of its length that one task made. Columns of docs with such names give way to these."""
    made = [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField(what, T.ArrayType(T.IntegerType()) if what == "ids" else T.LongType()), T.StructField("task", T.IntegerType()), T.StructField("rank", T.LongType())]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in {f.name for f in made}]
    schema = T.StructType([docs.schema[c] for c in kept] + made)
    (body,) = columns_free(docs, "__text")

    def run(batches):
        words, seen, task = known(path, **how), np.zeros(size + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                data, offs = text_bytes(part.column(len(kept)))
                rows: list[tuple] = []
                for i, ids in enumerate(words.texts(data.tobytes(), offs)):
                    ids = np.append(ids, end).astype("<i4")
                    for k, start in enumerate(range(0, len(ids), size)):
                        some = ids[start : start + size]
                        rows.append((i, k, start, len(some), some if what == "ids" else zlib.crc32(some), int(seen[len(some)])))
                        seen[len(some)] += 1
                if rows:
                    i, k, start, length, value, rank = zip(*rows, strict=True)
                    columns = [pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(value, pa.list_(pa.int32()) if what == "ids" else pa.int64()), pa.array([task] * len(rows), pa.int32()), pa.array(rank, pa.int64())]
                    yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(i)) for c in range(len(kept))), *columns], names=schema.names)

    small_batches(docs.sparkSession)
    return docs.select(*kept, docs[text].alias(body)).mapInArrow(lean(run), schema)


def pack(docs: DataFrame, path: str, size: int = SIZE, **how) -> DataFrame:
    """pieces() with sequence_id and offset in place of task and rank."""
    cut = stage(pieces(docs, path, size=size, **how), "packing-pieces")
    counts = stage(cut.groupBy("length", "task").agg(F.count("*").alias("n")), "packing-lengths")
    numbers = np.zeros(size + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `size` rows
        numbers[r["length"]] = r["n"]
    shared = docs.sparkSession.sparkContext.broadcast(ranges(plan(numbers)))
    of, by, earlier = columns_free(cut, "__length", "__task", "__before")
    running = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    before = counts.select(F.col("length").alias(of), F.col("task").alias(by), running.alias(earlier))
    kept = [c for c in cut.columns if c not in ("task", "rank", "sequence_id", "offset")]
    ranked = cut.join(before, (cut["length"] == before[of]) & (cut["task"] == before[by])).select(*(cut[c] for c in kept), (cut["rank"] + before[earlier]).alias("rank"))
    schema = T.StructType([cut.schema[c] for c in kept] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    at = kept.index("length")

    def place(batches):
        first, sequence, offset = shared.value
        for batch in batches:
            key = batch.column(at).to_numpy() << 48 | batch.column(len(kept)).to_numpy()
            row = np.searchsorted(first, key, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(sequence[row] + key - first[row]), pa.array(offset[row])], names=schema.names)

    return ranked.mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (array<int>), starts (where its pieces begin): the sequences themselves, from pack(..., what="ids")."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))  # at most `size` pieces of at least one token
    return rows.select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"), F.col("p.offset").alias("starts"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_path(), keep=["doc_id"], what="ids_crc32")
