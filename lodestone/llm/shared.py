"""Pieces the operators share: tables in the cluster's shared folder, and vectorised word scanning over Arrow buffers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and RE2 spelling of one word: everything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none and all its tasks are on this machine (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back, which cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Have the session send Python batches of at most so many rows; long texts would make larger ones heavy."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def lean(run):
    """A worker's function over batches, after which the process gives memory back: workers are used again, and would keep what the largest stage took."""

    @wraps(run)
    def inner(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return inner


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def n_words(text):
    """Number of words of a text column; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# ---------------------------------------------------------------- numpy over Arrow buffers

_SEP = np.zeros(256, bool)
_SEP[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_BYTE[_SEP] = 0
_PLACES = 4096
_PLACE = np.cumprod(np.full(_PLACES, 0x9E3779B97F4A7C15 | 1, np.uint64), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offs = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]]
    return data, offs - offs[0]


def chunks(offs: np.ndarray, most: int = 1 << 19):
    """Ranges of rows of about `most` bytes each, so that working arrays stay bounded; a longer row is alone."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the index of each row's first word (one more than there are rows)."""
    inside = ~_SEP[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    edge = offs[:-1][offs[:-1] < len(data)]
    before[edge] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = offs[1:][offs[1:] > 0]
    after[ends - 1] = False
    stops = np.flatnonzero(inside & ~after) + 1
    return starts, stops, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of every word, with A-Z lower-cased if so asked."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    seen = _LOWER[data] if lower else data
    first = np.zeros(len(data), np.int64)
    first[starts] = starts
    place = (np.arange(len(data)) - np.maximum.accumulate(first)) & (_PLACES - 1)
    sums = np.add.reduceat(_BYTE[seen] * _PLACE[place], starts)
    return mix(sums + (stops - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of `width` word hashes of one text; of the whole sequence where that is shorter."""
    n = len(hashes)
    if not n:
        return hashes
    span = min(width, n)
    acc = hashes[: n - span + 1].copy()
    for k in range(1, span):
        acc = mix(acc) + hashes[k : n - span + 1 + k]
    return mix(acc + np.uint64(span))


def columns_free(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has, for helper columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


# ---------------------------------------------------------------- dictionaries of a task


class Numbers(dict):
    """Numbers for parts of texts in the order in which they are first asked for."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, part: bytes) -> int:
        self.new.append(part)
        self[part] = n = len(self)
        return n


class Grown:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.array, self.n = np.zeros(1 << 16, kind), 0

    def extend(self, new: np.ndarray) -> None:
        size = self.n + len(new)
        if size > len(self.array):
            self.array = np.concatenate([self.array, np.zeros(max(size, 2 * len(self.array)) - len(self.array), self.array.dtype)])
        self.array[self.n : size] = new
        self.n = size


class Ragged:
    """Rows of numbers, one after the other."""

    def __init__(self):
        self.flat, self.starts = Grown(np.int32), Grown(np.int64)
        self.starts.extend(np.zeros(1, np.int64))

    def extend(self, rows: list[list[int]]) -> np.ndarray:
        return self.append(np.array([i for r in rows for i in r], np.int32), np.array([len(r) for r in rows], np.int64))

    def append(self, new: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Rows of the given sizes, one after the other in `new`."""
        self.starts.extend(self.flat.n + np.cumsum(sizes))
        self.flat.extend(new)
        return new

    def gathered(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the given rows, one after the other, and where each row ends."""
        starts = self.starts.array[rows]
        sizes = self.starts.array[rows + 1] - starts
        ends = np.cumsum(sizes)
        return self.flat.array[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)], ends
