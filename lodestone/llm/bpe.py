"""BPE encoding and decoding with a public tokenizer file, by tree concatenation.

A text longer than `whole_chars` characters is encoded as a tree, whether it has white space or not: it is halved at any character, the halves, and the
halves of those, are encoded on their own, and at each join a window is encoded anew and widened until it has a token in common, at the same
place, with the encoding of either side. A BPE token sequence is valid if and only if each pair of neighbours is valid, and every pair of the
spliced sequence was a pair of one of the three encodings, so the result is exactly the encoding of the whole text. Common tokens
count only where no character in or after them can compose with others when the text is normalised. Texts of more than `task_chars` characters are
cut into pieces that different tasks encode, and joined in the same way.

Shorter texts, and the leaves of the trees, are encoded word by word through a bounded cache, as words between ASCII white space never influence
each other under this family of tokenizers (normalisation and the splitting pattern keep white space apart).

Null and empty texts have no tokens, and the decoded text is empty. A row's result depends on its text alone, so repeated rows repeat it and ties do not matter;
an empty table gives no rows. Extra columns pass through.
"""

from __future__ import annotations

import hashlib
import os
import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.shared import columns_free, documents, lean, small_batches

_BLANK = re.compile(r"[ \t\n\r]+")
WHOLE_CHARS, TASK_CHARS, WINDOW = 4096, 1 << 20, 64


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer of a file, without truncation and padding; once in each worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


class Tokens:
    """Ids, and the places of their tokens, which are looked up only where they are asked for."""

    def __init__(self, ids: np.ndarray, parts: list[tuple]):
        self.ids, self.parts = ids, parts  # parts: (number of the first id, how to get a token's place, shift of its number, shift of its place)
        self.begins = [p[0] for p in parts]

    def span(self, i: int) -> tuple[int, int]:
        begin, get, shift, base = self.parts[bisect_right(self.begins, i) - 1]
        s, e = get(i - begin + shift)
        return s + base, e + base

    def token(self, i: int) -> tuple[int, int, int]:
        return (*self.span(i), int(self.ids[i]))

    def cut(self, lo: int, hi: int) -> Tokens:
        kept = []
        for k, (begin, get, shift, base) in enumerate(self.parts):
            end = self.begins[k + 1] if k + 1 < len(self.parts) else len(self.ids)
            x, y = max(begin, lo), min(end, hi)
            if x < y:
                kept.append((x - lo, get, shift + x - begin, base))
        return Tokens(self.ids[lo:hi], kept)

    def __add__(self, other: Tokens) -> Tokens:
        n = len(self.ids)
        return Tokens(np.concatenate([self.ids, other.ids]), self.parts + [(n + b, *rest) for b, *rest in other.parts])


def _leaf(tok, text: str, lo: int, hi: int) -> Tokens:
    e = tok.encode(text[lo:hi], add_special_tokens=False)
    return Tokens(np.asarray(e.ids, "<u4"), [(0, e.token_to_chars, 0, lo)])


class Places:
    """The places of the n tokens of a text whose ids are known. Its two ends, between white space, are encoded for that, the whole only if need be."""

    EDGE = 128

    def __init__(self, tok, text: str, n: int):
        self.tok, self.text, self.n, self.whole, self.head, self.tail = tok, text, n, None, None, None

    def _end(self, lo: int, hi: int):
        e = self.tok.encode(self.text[lo:hi], add_special_tokens=False)
        return e, len(e.ids), lo

    def __call__(self, i: int) -> tuple[int, int]:
        if self.whole is None:
            if self.head is None:
                size = len(self.text)
                first = next(reversed([m.start() for m in _BLANK.finditer(self.text, 0, self.EDGE)]), 0)
                last = _BLANK.search(self.text, max(0, size - self.EDGE))
                self.head, self.tail = self._end(0, first), self._end(last.start() if last else size, size)
            if i < self.head[1]:
                return self.head[0].token_to_chars(i)
            if i >= self.n - self.tail[1]:
                s, e = self.tail[0].token_to_chars(i - self.n + self.tail[1])
                return s + self.tail[2], e + self.tail[2]
            self.whole = self.tok.encode(self.text, add_special_tokens=False)
        return self.whole.token_to_chars(i)


def _stands_alone(c: str) -> bool:
    """Whether normalisation keeps a character apart from those before it, and at its length."""
    return c.isascii() or (unicodedata.category(c)[0] != "M" and len(c.lower()) == 1 and not unicodedata.decomposition(c) and not ("\u1100" <= c <= "\u11ff" or "\ua960" <= c <= "\ua97c" or "\ud7b0" <= c <= "\ud7fb"))


def _joined(tok, text: str, lo: int, hi: int, cut: int, left: Tokens, right: Tokens, special: int, width: int = WINDOW) -> Tokens:
    """The encoding of text[lo:hi] from those of text[lo:cut] and text[cut:hi]; special: length of the longest special token, which may lie
    across the cut or an edge of the window, so that tokens so near to them count for nothing."""
    width = max(width, 2 * special + 16)

    def sure(t) -> bool:
        return t[0] < t[1] and all(map(_stands_alone, text[t[0] : t[1] + 1]))

    while True:
        a, b = max(lo, cut - width), min(hi, cut + width)
        if a == lo and b == hi:
            return _leaf(tok, text, lo, hi)
        e = tok.encode(text[a:b], add_special_tokens=False)
        tokens = [(s + a, t + a, i) for (s, t), i in zip(e.offsets, e.ids, strict=True)]
        first, last = (0, 0), (len(right.ids), len(tokens))
        if a > lo:  # a common token left of the cut, the nearest one
            first, i = None, len(left.ids) - 1
            for k in range(len(tokens) - 1, 0, -1):
                t = tokens[k]
                if t[1] < cut - special and a + special <= t[0]:
                    while i >= 0 and left.span(i)[0] > t[0]:
                        i -= 1
                    if i >= 0 and left.token(i) == t and sure(t):
                        first = i, k
                        break
        if b < hi:  # and right of it
            last, i = None, 0
            for k, t in enumerate(tokens[:-1]):
                if t[0] > cut + special and t[1] <= b - special:
                    while i < len(right.ids) and right.span(i)[0] < t[0]:
                        i += 1
                    if i < len(right.ids) and right.token(i) == t and sure(t):
                        last = i, k
                        break
        if first is not None and last is not None and first[1] <= last[1]:
            middle = Tokens(np.asarray(e.ids[first[1] : last[1]], "<u4"), [(0, e.token_to_chars, first[1], a)] if first[1] < last[1] else [])
            return left.cut(0, first[0]) + middle + right.cut(last[0], len(right.ids))
        width *= 2


def leaves(lo: int, hi: int, whole_chars: int) -> list[tuple[int, int]]:
    """The parts that a text is halved to."""
    cut = (lo + hi) // 2
    return [(lo, hi)] if hi - lo <= whole_chars else leaves(lo, cut, whole_chars) + leaves(cut, hi, whole_chars)


def join_pieces(enc: Encoder, texts: list[str], pieces: list[Tokens]) -> Tokens:
    """The encoding of a text from those of its pieces, each with places from 0 on, joined two by two."""
    text = "".join(texts)
    edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).tolist()
    parts = [(x, y, Tokens(p.ids, [(b, get, shift, base + x) for b, get, shift, base in p.parts])) for x, y, p in zip(edges, edges[1:], pieces, strict=False)]
    while len(parts) > 1:
        twos = [(p[0], q[1], _joined(enc.tok, text, p[0], q[1], p[1], p[2], q[2], enc.special)) for p, q in zip(parts[::2], parts[1::2], strict=False)]
        parts = twos + parts[2 * len(twos) :]
    return parts[0][2]


class Encoder:
    """Encodes whole texts and decodes the ids again. Words are kept in two generations of up to `cached` words: a full one
    replaces the older one, from which words that still occur move on."""

    def __init__(self, path: str, cached: int = 250_000, whole_chars: int = WHOLE_CHARS, width: int = WINDOW):
        self.tok, self.cached, self.whole_chars, self.width = load(path), cached, whole_chars, width
        self.special = max((len(t.content) for t in self.tok.get_added_tokens_decoder().values()), default=0)
        self.names = [self.tok.id_to_token(i) or "" for i in range(self.tok.get_vocab_size())]
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> None:
        """Have all words known, as ids in little-endian unsigned 32-bit integers."""
        known, old, new = self.known, self.old, []
        for w in words - known.keys():
            if w in old:
                known[w] = old[w]
            else:
                new.append(w)
        for lo in range(0, len(new), 4096):  # many words as one text, as white space parts them anyway
            some = new[lo : lo + 4096]
            e = self.tok.encode(" ".join(some), add_special_tokens=False)
            starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in some])])
            cuts = (4 * np.searchsorted(np.array([o[0] for o in e.offsets], np.int64), starts)).tolist()
            ids = np.asarray(e.ids, "<u4").tobytes()
            known.update(zip(some, [ids[x:y] for x, y in zip(cuts, cuts[1:], strict=False)], strict=True))

    def decode(self, ids: bytes) -> str:
        """The decoding of ids; a tokenizer without a decoder puts blanks between the tokens."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        return " ".join(map(self.names.__getitem__, numbers)) if self.tok.decoder is None else self.tok.decode(numbers, skip_special_tokens=False)

    def _words(self, parts: list[str]) -> bytes:
        return b"".join(map(self.known.__getitem__, parts))

    def _tree(self, text: str, parts: list[tuple[int, int, list[str]]]) -> Tokens:
        """The encoding of a text by tree concatenation, from its leaves and their words, all of them known."""

        def half(some) -> Tokens:
            lo, hi = some[0][0], some[-1][1]
            if len(some) == 1:
                ids = np.frombuffer(self._words(some[0][2]), "<u4")
                return Tokens(ids, [(0, Places(self.tok, text[lo:hi], len(ids)), 0, lo)])
            cut = (lo + hi) // 2
            k = next(k for k, p in enumerate(some) if p[0] == cut)
            return _joined(self.tok, text, lo, hi, cut, half(some[:k]), half(some[k:]), self.special, self.width)

        return half(parts)

    def encoded(self, texts: list[str]) -> list[Tokens]:
        """The encodings of texts: long ones by a tree, short ones are single leaves."""
        parts = [[(lo, hi, _BLANK.split(t[lo:hi])) for lo, hi in leaves(0, len(t), self.whole_chars)] for t in texts]
        words = {w for p in parts for leaf in p for w in leaf[2]}
        self._learn(words)
        got = [self._tree(t, p) for t, p in zip(texts, parts, strict=True)]
        for w in words:
            if len(w) > 64:
                del self.known[w]
        if len(self.known) > self.cached:
            self.old, self.known = self.known, {}
        return got

    def texts(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """(ids, decoded text) of each text."""
        got = [t.ids.tobytes() for t in self.encoded([t or "" for t in texts])]
        return [(ids, self.decode(ids)) for ids in got]

    def text(self, text: str | None) -> tuple[bytes, str]:
        return self.texts([text])[0]


_MAKE = {
    "ids": lambda ids, said: np.frombuffer(ids, "<i4"),
    "decoded": lambda ids, said: said,
    "n_tokens": lambda ids, said: len(ids) // 4,
    "ids_sha256": lambda ids, said: hashlib.sha256(ids).hexdigest(),
    "decoded_sha256": lambda ids, said: hashlib.sha256(said.encode()).hexdigest(),
}
_TYPES = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}


def _made(rows: list[tuple[bytes, str]], what: tuple[str, ...]) -> list[pa.Array]:
    return [pa.array([_MAKE[k](*row) for row in rows], _TYPES.get(k, pa.string())) for k in what]


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, what: tuple[str, ...] = ("ids", "decoded"), whole_chars: int = WHOLE_CHARS, task_chars: int = TASK_CHARS) -> DataFrame:
    """docs' columns `keep` (all by default) and, as asked for in `what`: ids array<int>, decoded string, n_tokens long,
    ids_sha256 and decoded_sha256 string. A column of docs that has such a name gives way to the new one."""
    kinds = {"ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType(), "n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    kept = [c for c in (docs.columns if keep is None else keep) if c not in what]
    made = [T.StructField(k, kinds[k]) for k in what]
    schema = T.StructType([docs.schema[c] for c in kept] + made)
    (body,) = columns_free(docs, "__text")
    source = docs.select(*kept, docs[text].alias(body))

    def run(batches):
        enc = Encoder(path, whole_chars=whole_chars)
        for batch in batches:
            for lo in range(0, batch.num_rows, 250):
                part = batch.slice(lo, 250)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *_made(enc.texts(part.column(len(kept)).to_pylist()), what)], names=[*kept, *what])

    small_batches(docs.sparkSession)
    huge = F.length(body) > task_chars
    if source.where(huge).isEmpty():
        return source.mapInArrow(lean(run), schema)
    # each huge text once, in pieces that are dealt to all tasks
    (key,) = columns_free(docs, "__key")
    texts = source.where(huge).select(F.sha2(body, 256).alias("key"), F.col(body).alias("text")).dropDuplicates(["key"])
    pieces = texts.select("key", F.length("text").alias("chars"), "text").withColumn("i", F.explode(F.sequence(F.lit(0), F.expr(f"cast((chars - 1) div {task_chars} as int)"))))
    pieces = pieces.select("key", "i", F.substring("text", F.col("i") * task_chars + 1, F.lit(task_chars)).alias("text")).repartition("key", "i")

    def encode_pieces(batches):
        enc = Encoder(path, whole_chars=whole_chars)
        for batch in batches:
            for k, i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                (got,) = enc.encoded([t])
                spans = np.array([got.span(n) for n in range(len(got.ids))], "<i4").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([i], pa.int32()), pa.array([t]), pa.array([got.ids.tobytes()]), pa.array([spans.tobytes()])], names=["key", "i", "text", "ids", "spans"])

    def join(table: pa.Table) -> pa.Table:
        enc = Encoder(path, whole_chars=whole_chars)
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("i", "text", "ids", "spans", "key")), strict=True))
        parts = []
        for _, _, ids, spans, _ in rows:
            at = np.frombuffer(spans, "<i4").reshape(-1, 2)
            parts.append(Tokens(np.frombuffer(ids, "<u4"), [(0, lambda n, at=at: (int(at[n, 0]), int(at[n, 1])), 0, 0)]))
        ids = join_pieces(enc, [r[1] for r in rows], parts).ids.tobytes()
        return pa.Table.from_arrays([pa.array([rows[0][4]]), *_made([(ids, enc.decode(ids))], what)], names=[key, *what])

    whole = pieces.mapInArrow(lean(encode_pieces), "key string, i int, text string, ids binary, spans binary").groupBy("key").applyInArrow(join, T.StructType([T.StructField(key, T.StringType()), *made]))
    rest = source.where(~huge | F.col(body).isNull()).mapInArrow(lean(run), schema)
    found = source.where(huge).withColumn(key, F.sha2(body, 256)).drop(body).join(whole, key).select(*kept, *what)
    return rest.unionByName(found)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir), tokenizer_path(), keep=["doc_id"], what=("n_tokens", "ids_sha256", "decoded_sha256"))
