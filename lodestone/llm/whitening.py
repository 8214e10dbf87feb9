"""Whitening of embeddings by exact integer moments.

Every entry c of a vector becomes the integer x = floor(scale * c) + offset. The mean and the covariance of the distinct x-vectors are exact: the vectors
are centred at the whole part of the mean, y = x - floor(S / n), split into digits ("limbs") so small that float64 matrix products of a block of
rows are exact, the limbs' products are recombined as big integers, and the sums of all tasks are merged as digits of 32 bits, which no order of
addition changes. With r = S - n * floor(S / n), the sum of (n*x - S)(n*x - S)' is n*n * sum(y y') - n * r r'. Only its quotient by n**3, rounded
once, goes to the eigendecomposition; so the components are the same for any number of partitions.

Null vectors and those with null, NaN or infinite entries are dropped; so are vectors without entries. Vectors of each length are a set of their own,
with its own n, mean and components. Entries whose x is beyond 2**61 count as that bound. Repeated rows get a result each, but are in the fit once.
Null ids pass through, extra columns take no part, an empty table gives no rows. A component that is not above the rank tolerance
(1e-12 of the largest; always if n is 1) has no whitened value (null), and takes no part in identity_error, which is null
if no component is left. A squared deviation beyond a long is null.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.shared import small_batches, stage

#: A limb has 21 bits, and a block 2048 rows, so that sums of products stay within 2**53.
LIMB, ROWS = 21, 2048
LARGEST = 1 << 61
#: Bits after the point of whitened values in the check of their covariance.
POINT = 30
RANK = 1e-12


def vectors(column: pa.Array):
    """Of a column of lists of doubles: for each length, the rows (numbers) and the matrix of those without null or non-finite entries."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offs = column.offsets.to_numpy().astype(np.int64)
    values = column.values
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls are NaN
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    fine = (bad[offs[1:]] == bad[offs[:-1]]) & (offs[1:] > offs[:-1]) & np.asarray(column.is_valid())
    length = np.where(fine, offs[1:] - offs[:-1], 0)
    for size in np.unique(length[fine]).tolist():
        rows = np.flatnonzero(length == size)
        yield rows, flat[offs[rows][:, None] + np.arange(size)]


def whole(c: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * c) as integers within the bound."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(c * scale), -float(LARGEST), float(LARGEST)).astype(np.int64)


def packed(x: np.ndarray) -> list[bytes]:
    """A key of each row: its length and the bytes an entry takes, then the entries. Equal rows have equal keys."""
    m, size = x.shape
    most = np.maximum(x.max(1), -1 - x.min(1))  # an integer of b bits and a sign
    width = np.select([most < 1 << 7, most < 1 << 15, most < 1 << 31], [1, 2, 4], 8)
    out: list[bytes] = [b""] * m
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        head = np.frombuffer(size.to_bytes(4, "little") + bytes([w]), np.uint8)
        body = np.ascontiguousarray(x[rows].astype(f"<i{w}")).view(np.uint8).reshape(len(rows), -1)
        keys = np.hstack([np.broadcast_to(head, (len(rows), 5)), body])
        for r, key in zip(rows.tolist(), keys, strict=True):
            out[r] = key.tobytes()
    return out


def unpacked(column: pa.Array):
    """(length, matrix of integers) of the keys of a column, in blocks of at most ROWS rows."""
    if not len(column):
        return
    offs = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)
    head = data[offs[:-1, None] + np.arange(5)]
    kind = np.ascontiguousarray(head[:, :4]).view("<u4").ravel().astype(np.int64) * 16 + head[:, 4]
    for k in np.unique(kind).tolist():
        size, w = k // 16, k % 16
        rows = np.flatnonzero(kind == k)
        for lo in range(0, len(rows), ROWS):
            body = data[offs[rows[lo : lo + ROWS], None] + 5 + np.arange(size * w)]
            yield size, np.ascontiguousarray(body).view(f"<i{w}").astype(np.int64)


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Float matrices of digits with sign, the lowest first: y is the sum of digit k times 2**(k * LIMB)."""
    sign, rest, out = np.sign(y).astype(np.float64), np.abs(y), []
    while True:
        out.append(sign * (rest & ((1 << LIMB) - 1)))
        rest = rest >> LIMB
        if not rest.any():
            return out


def gram(y: np.ndarray) -> np.ndarray:
    """y' y as big integers, for at most ROWS rows of integers."""
    digits = limbs(y)
    total = 0
    for i, a in enumerate(digits):
        for j, b in enumerate(digits[: i + 1]):
            product = (a.T @ b).astype(np.int64).astype(object)
            if i != j:
                product = product + product.T
            total = total + product * (1 << (LIMB * (i + j)))
    return total


def _digits(value: int):
    """32-bit digits of an integer, the lowest first; the last one, with the sign, is of less than 32 bits."""
    p = 0
    while not -(1 << 31) <= value < 1 << 31:
        yield p, value & 0xFFFFFFFF
        value >>= 32
        p += 1
    yield p, value


def moments(keys: DataFrame, make, products: bool) -> dict[int, tuple[int, list[int], np.ndarray | None]]:
    """For each length: the number of keys, the exact sums of the integers that `make(length, x)` gives, and if asked for of their products.

    Each task adds up its rows; the tasks' sums are added by Spark digit by digit. To the driver go numbers for each place of the mean and the covariance."""

    def run(batches):
        got: dict[int, list] = {}
        for batch in batches:
            for size, x in unpacked(batch.column(0)):
                y = make(size, x)
                old = got.setdefault(size, [0, 0, 0])
                old[0] += len(y)
                old[1] = old[1] + (y.sum(0).astype(object) if np.abs(y).max(initial=0) < 1 << 50 else y.astype(object).sum(0))
                if products:
                    old[2] = old[2] + gram(y)
        for size, (n, sums, grams) in got.items():
            rows = [(-1, -1, p, v) for p, v in _digits(n)] + [(i, -1, p, v) for i, s in enumerate(sums) for p, v in _digits(s)]
            if products:
                rows += [(i, j, p, v) for i in range(len(sums)) for j in range(i + 1) for p, v in _digits(grams[i, j])]
            i, j, p, v = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([size] * len(rows), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(p, pa.int32()), pa.array(v, pa.int64())], names=["size", "i", "j", "p", "v"])

    parts = keys.mapInArrow(run, "size int, i int, j int, p int, v long").groupBy("size", "i", "j", "p").agg(F.sum("v").alias("v"))
    out: dict[int, dict] = {}
    for size, i, j, p, v in parts.collect():
        at = out.setdefault(size, {})
        at[i, j] = at.get((i, j), 0) + (v << (32 * p))
    done = {}
    for size, at in out.items():
        many = len([1 for i, j in at if j == -1]) - 1
        grams = None
        if products:
            grams = np.zeros((many, many), object)
            for (i, j), v in at.items():
                if j >= 0:
                    grams[i, j] = grams[j, i] = v
        done[size] = at[-1, -1], [at[i, -1] for i in range(many)], grams
    return done


def centred(n: int, sums: list[int], grams: np.ndarray) -> np.ndarray:
    """n times the sum of the products of the centred vectors, as big integers."""
    s = np.array(sums, object)
    return grams * n - s[:, None] * s[None, :]


class Model:
    """What whitens the vectors of one length. sums: S - n * offset, of the vectors without the offset."""

    def __init__(self, n: int, sums: list[int], grams: np.ndarray, components: int):
        self.n, self.middle = n, [s // n for s in sums]
        self.rest = [s - n * m for s, m in zip(sums, self.middle, strict=True)]
        self.fraction = np.array([float(Fraction(r, n)) for r in self.rest])
        exact = centred(n, self.rest, grams)  # grams are of x - middle
        largest = max((abs(v) for v in exact.ravel()), default=0) or 1
        ratio = np.array([[float(Fraction(v, largest)) for v in row] for row in exact])
        values, axes = np.linalg.eigh(ratio)
        values, axes = np.maximum(values[::-1], 0.0), axes[:, ::-1]
        trace = sum(exact[i, i] for i in range(len(exact)))
        many = min(components, len(values))
        self.alive = values[:many] > RANK * max(values[0], 0.0)
        self.values = np.array([float(Fraction(v) * Fraction(largest, n * n)) for v in values[:many]])
        self.explained = np.array([float(Fraction(v) * Fraction(largest, trace)) if trace else 0.0 for v in values[:many]])
        self.axes = np.ascontiguousarray(axes[:, :many] / np.sqrt(np.where(self.alive, self.values, 1.0)))
        self.identity_error: float | None = None

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """x: integers without the offset."""
        return (x - np.array(self.middle, np.int64) - self.fraction) @ self.axes

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact squares of n*x - S, added up for each row."""
        y = x - np.array(self.middle, np.int64)
        bound = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if bound * bound * y.shape[1] < 1 << 63:
            d = self.n * y - np.array(self.rest, np.int64)
            return (d * d).sum(1).tolist()
        d = y.astype(object) * self.n - np.array(self.rest, object)
        return (d * d).sum(1).tolist()


def fit(df: DataFrame, vector: str = "embedding", components: int = 16, scale: float = 64.0) -> dict[int, Model]:
    """A model for each length. The distinct vectors are a table in the shared folder: a key of some bytes each, of which tasks send each only once."""

    def keys(batches):
        for batch in batches:
            for _, c in vectors(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(packed(whole(c, scale)), pa.binary())], names=["key"])

    small_batches(df.sparkSession)
    distinct = stage(df.select(F.col(vector).cast("array<double>")).mapInArrow(keys, "key binary").distinct(), "whitening-vectors")
    sums = moments(distinct, lambda size, x: x, False)
    middles = {size: np.array([s // n for s in total], np.int64) for size, (n, total, _) in sums.items()}
    grams = moments(distinct, lambda size, x: x - middles[size], True)
    models = {size: Model(n, total, grams[size][2], components) for size, (n, total, _) in sums.items()}
    shared = df.sparkSession.sparkContext.broadcast(models)  # of each length a few numbers for each place and component
    seen = moments(distinct, lambda size, x: np.rint(shared.value[size].whitened(x) * (1 << POINT)).astype(np.int64), True)
    for size, (n, total, products) in seen.items():
        m = models[size]
        unit = n * n << (2 * POINT)
        off = [abs(Fraction(int(v), unit) - (i == j)) for i, row in enumerate(centred(n, total, products)) for j, v in enumerate(row) if m.alive[i] and m.alive[j]]
        m.identity_error = float(max(off)) if off else None
    return models


def whiten(df: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = 16, scale: float = 64.0) -> DataFrame:
    """id, and for each remaining row and component: component, n, deviation, whitened, explained, eigenvalue, identity_error.

    The offset that the integers have moves the mean with the vectors, so no result depends on it, and it is left out."""
    models = fit(df, vector, components, scale)
    shared = df.sparkSession.sparkContext.broadcast(models)
    kinds = [("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("eigenvalue", T.DoubleType()), ("identity_error", T.DoubleType())]
    schema = T.StructType([T.StructField(id, df.schema[id].dataType), *(T.StructField(k, t) for k, t in kinds)])

    def run(batches):
        for batch in batches:
            for rows, c in vectors(batch.column(1)):
                m, x = shared.value[c.shape[1]], whole(c, scale)
                k, white = len(m.values), m.whitened(x)
                exact = pa.array([d if d < 1 << 63 else None for d in m.deviations(x)], pa.int64())
                again = pa.array(np.repeat(np.arange(len(rows)), k))
                dead = np.tile(~m.alive, len(rows))
                error = pa.array([m.identity_error] * (len(rows) * k), pa.float64())
                columns = [
                    batch.column(0).take(pa.array(rows)).take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), pa.array(np.full(len(dead), m.n, np.int64)), exact.take(again),
                    pa.array(white.ravel(), mask=dead), pa.array(np.tile(m.explained, len(rows))), pa.array(np.tile(m.values, len(rows))), error,
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.select(F.col(id), F.col(vector).cast("array<double>")).mapInArrow(run, schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
