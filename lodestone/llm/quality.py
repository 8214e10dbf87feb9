"""Document quality by supervised subword embeddings.

A text's features are its words, word pairs and character 3- and 4-grams (bytes, as written), hashed into `buckets`
rows of a learned embedding table, and one more feature for each word that equals the word before it. Their average goes
through a softmax output of two classes. The model is trained by stochastic gradient descent in numpy, on at most `max_rows`
labels and four times as many rows of theirs, taken in the order of a hash; a part of those, kept out of training, fits the Platt scaling
of the score. As both layers are linear, scoring needs only one number a feature (embedding times output weights),
which is what the executors get: a table of `buckets` floats, whatever the corpus' size.

Null and empty texts have no features and get the score of the bias alone. Labels that are null are left out; labels
of ids that occur several times, or of several rows of one id, are all used within those bounds. Without labels of both classes every score is the
share of label 1 among them, or 1 without any, so that nothing is rejected on no evidence. Ties do not matter: a row's score depends on its text alone.
Extra columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.shared import chunks, columns_free, documents, lean, mix, small_batches, text_bytes, word_hashes, word_spans

BUCKETS, DIM, MAX_ROWS, EPOCHS = 1 << 17, 8, 4000, 12
THRESHOLD = 0.3


def features(data: np.ndarray, offs: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all rows, each kind one after the other, and the row of each."""
    n = len(offs) - 1
    ids, rows = [], []
    if len(data):
        starts, stops, first = word_spans(data, offs)
        h = word_hashes(data, starts, stops, lower=False)
        row = np.repeat(np.arange(n, dtype=np.int32), np.diff(first))
        both = row[1:] == row[:-1]
        same = both & (h[1:] == h[:-1])
        ids += [h, mix(h[:-1] * np.uint64(3) + h[1:])[both], np.full(int(same.sum()), 12345, np.uint64)]
        rows += [row, row[1:][both], row[1:][same]]
        at = np.repeat(np.arange(n, dtype=np.int32), np.diff(offs))
        code = data.astype(np.uint64)
        for k in (3, 4):
            if len(data) >= k:
                gram = code[: len(data) - k + 1].copy()
                for i in range(1, k):
                    gram = (gram << np.uint64(8)) | code[i : len(data) - k + 1 + i]
                ok = at[: len(gram)] == at[k - 1 :]
                ids.append(((gram + np.uint64(k << 40)) * np.uint64(0x9E3779B97F4A7C15))[ok] >> np.uint64(20))
                rows.append(at[: len(gram)][ok])
    if not ids:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    return (np.concatenate(ids) & np.uint64(buckets - 1)).astype(np.int64), np.concatenate(rows)


@dataclass
class Model:
    """One number for each feature, a bias, and the slope and offset of the calibration."""

    table: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def raw(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        ids, rows = features(data, offs, len(self.table))
        n = len(offs) - 1
        count = np.bincount(rows, minlength=n)
        return np.bincount(rows, self.table[ids], minlength=n) / np.maximum(count, 1) + self.bias

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(data, offs) + self.offset, -60, 60)))


def train(texts: list[str], labels: list[int], buckets: int = BUCKETS, dim: int = DIM, epochs: int = EPOCHS, rate: float = 1.0, batch: int = 16, seed: int = 1) -> Model:
    """Fit embeddings and output weights to the texts; every fifth row serves the calibration only."""
    y = np.asarray(labels)
    if len(set(labels)) < 2:
        share = float(y.mean()) if len(y) else 1.0
        return Model(np.zeros(buckets, np.float32), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    data, offs = text_bytes(pa.array(texts, pa.large_string()))
    bags = []
    for lo, hi in chunks(offs):
        ids, rows = features(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], buckets)
        order = np.argsort(rows, kind="stable")
        for bag in np.split(ids[order], np.cumsum(np.bincount(rows, minlength=hi - lo))[:-1]):
            u, c = np.unique(bag, return_counts=True)
            bags.append((u.astype(np.int32), (c / max(1, len(bag))).astype(np.float32)))
    del data, texts
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    w, b = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    fit = np.array([i for i in range(len(y)) if i % 5 or len(y) < 50])
    steps, total = 0, epochs * -(-len(fit) // batch)
    for _ in range(epochs):
        rng.shuffle(fit)
        for lo in range(0, len(fit), batch):
            lr = rate * (1 - steps / total)
            steps += 1
            for i in fit[lo : lo + batch]:  # one step a row, as the rows of a batch share few features
                u, c = bags[i]
                x = c @ e[u]
                z = x @ w + b
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y[i]] -= 1
                e[u] -= (lr * c[:, None] * len(u) ** 0.5) * (w @ p)
                w -= lr * np.outer(x, p)
                b -= lr * p
    table = (e @ (w[:, 1] - w[:, 0])).astype(np.float32)
    model = Model(table, float(b[1] - b[0]))
    held = [i for i in range(len(y)) if not (i % 5) or len(y) < 50]
    if len(held) >= 20 and len(set(y[held])) == 2:
        x = np.array([float(bags[i][1] @ table[bags[i][0]]) + model.bias for i in held])
        s, o, t = 1.0, 0.0, y[held]
        for _ in range(100):  # Newton's method for the two numbers, with a little shrinkage
            p = 1 / (1 + np.exp(-np.clip(s * x + o, -60, 60)))
            g = np.array([((p - t) * x).sum() + 1e-2 * (s - 1), (p - t).sum()])
            v = p * (1 - p)
            hess = np.array([[(v * x * x).sum() + 1e-2, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-6]])
            step = np.linalg.solve(hess, g)
            s, o = s - float(np.clip(step[0], -1, 1)), o - float(np.clip(step[1], -2, 2))
        model.slope, model.offset = max(s, 1e-3), o
    return model


def sample(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> DataFrame:
    """id, text, label of the texts to learn from: rows whose crc32 of the id is no multiple of five, at most max_rows labels in the order of a hash of the id."""
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    ids = ids.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("__label")).orderBy(F.xxhash64("__id"), "__id", "__label").limit(max_rows)
    docs = docs.select("doc_id", "text")
    rows = docs.join(F.broadcast(ids), docs["doc_id"] == ids["__id"]).select(F.col("__id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.col("__label").alias("label"))
    # where ids repeat there may be more texts than labels: the first ones in a fixed order
    return rows.orderBy(F.xxhash64("id", "text"), "id", "label").limit(4 * max_rows)


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns `keep` of docs (all by default) and the score of the text, from 0 to 1."""
    kept = [c for c in (docs.columns if keep is None else keep) if c != name]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            data, offs = text_bytes(batch.column(len(kept)))
            parts = [m.score(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]) for lo, hi in chunks(offs)]
            got = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(got, pa.float64())], names=[*kept, name])

    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(name, T.DoubleType())])
    small_batches(docs.sparkSession)
    (body,) = columns_free(docs, "__text")
    return docs.select(*kept, docs[text].alias(body)).mapInArrow(lean(run), schema)


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of a corpus: one task gets the bounded sample and trains; the driver only gets the table of numbers."""

    def run(batches):
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        m = train([r[1] for r in rows], [r[2] for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([m.table.tobytes()], pa.binary()), *(pa.array([float(v)], pa.float64()) for v in (m.bias, m.slope, m.offset))], names=["table", "bias", "slope", "offset"])

    small_batches(docs.sparkSession)
    got = sample(docs, labels).repartition(1).mapInArrow(lean(run), "table binary, bias double, slope double, offset double").collect()
    if not got:
        return train([], [])
    return Model(np.frombuffer(bytes(got[0]["table"]), np.float32), got[0]["bias"], got[0]["slope"], got[0]["offset"])


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, keep=["doc_id"]).select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
