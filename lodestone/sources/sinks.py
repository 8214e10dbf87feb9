"""Writing: a versioned chunk table with upsert and delete, the lexical index, exports and reports.

The chunk table lies in hash buckets of the source file. A change writes the buckets it touches anew, in a folder of its own, and then says in a pointer table
which folder each of them is in from now on, so the files of other buckets stay as they are, readers see the old buckets until the new ones are whole, and a job that dies in
between can be run again. One writer at a time; there is no transaction log.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators import lexical

POINTER = "version int, bucket int, name string, buckets int, schema string"


class ChunkTable:
    """Chunks by chunk_id under a folder, in so many buckets; the number holds from the first write on."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.wished = spark, root.rstrip("/"), buckets

    def _pointers(self) -> list:
        """The newest pointer of each bucket: as many rows as there are buckets."""
        try:
            rows = self.spark.read.schema(POINTER).parquet(f"{self.root}/_current")
        except AnalysisException:
            return []
        newest = rows.groupBy("bucket").agg(F.max_by(F.struct(*rows.columns), "version").alias("p")).select("p.*")
        return sorted(newest.collect(), key=lambda r: r["bucket"])

    @property
    def version(self) -> int:
        return max((p["version"] for p in self._pointers()), default=0)

    @property
    def buckets(self) -> int:
        return next((p["buckets"] for p in self._pointers()), self.wished)

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64("source_file"), F.lit(buckets)).cast("int")

    def _read(self, pointers: list, only: set[int] | None = None) -> DataFrame | None:
        """The chunks of some buckets, all by default, with __bucket."""
        if not pointers:
            return None
        schema = T.StructType.fromJson(json.loads(max(pointers, key=lambda p: p["version"])["schema"]))
        by_name: dict[str, list[str]] = {}
        for p in pointers:
            if p["name"] and (only is None or p["bucket"] in only):
                by_name.setdefault(p["name"], []).append(f"{self.root}/{p['name']}/__bucket={p['bucket']}")
        whole = T.StructType([*schema.fields, T.StructField("__bucket", T.IntegerType())])
        parts = [self.spark.read.schema(whole).option("basePath", f"{self.root}/{name}").parquet(*paths) for name, paths in sorted(by_name.items())]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], whole)

    def read(self) -> DataFrame | None:
        rows = self._read(self._pointers())
        return None if rows is None else rows.drop("__bucket")

    def _write(self, rows: DataFrame, touched: set[int], pointers: list) -> int:
        """Write the touched buckets, which rows (with __bucket) hold whole, and point to them."""
        version = max((p["version"] for p in pointers), default=0) + 1
        buckets = pointers[0]["buckets"] if pointers else self.wished
        name = f"v{version}-{uuid.uuid4().hex[:8]}"
        rows.hint("rebalance", "__bucket").write.partitionBy("__bucket").parquet(f"{self.root}/{name}")
        try:
            there = {r["__bucket"] for r in self.spark.read.parquet(f"{self.root}/{name}").select("__bucket").distinct().collect()}
        except AnalysisException:  # no rows, no files
            there = set()
        schema = rows.drop("__bucket").schema.json()
        new = [(version, b, name if b in there else None, buckets, schema) for b in sorted(touched)]
        self.spark.createDataFrame(new, POINTER).coalesce(1).write.mode("append").parquet(f"{self.root}/_current")
        return version

    def replace(self, rows: DataFrame) -> int:
        """Make rows the table."""
        pointers = self._pointers()
        buckets = pointers[0]["buckets"] if pointers else self.wished
        return self._write(rows.withColumn("__bucket", self._bucket(buckets)), set(range(buckets)), pointers)

    def change(self, rows: DataFrame | None, leaving) -> int:
        """Put rows in and take those out that `leaving`, a function from the table to some of its rows, names; only their buckets are read whole and written."""
        pointers = self._pointers()
        old = self._read(pointers)
        if old is None:
            return 0 if rows is None else self.replace(rows)
        gone = leaving(old)
        touched = {r["__bucket"] for r in gone.select("__bucket").distinct().collect()}
        if rows is not None:
            rows = rows.withColumn("__bucket", self._bucket(pointers[0]["buckets"]))
            touched |= {r["__bucket"] for r in rows.select("__bucket").distinct().collect()}
        if not touched:
            return max(p["version"] for p in pointers)
        part = self._read(pointers, touched)
        kept = part.join(leaving(part).select("__bucket", "chunk_id").distinct(), ["__bucket", "chunk_id"], "left_anti").select(*part.columns)
        return self._write(kept if rows is None else kept.unionByName(rows, allowMissingColumns=True), touched, pointers)

    def upsert(self, rows: DataFrame, order: str | None = None) -> int:
        """Put rows in, in place of those of the same chunk_id, whatever their source was; of several new ones of an id the first by `order` counts, then by content."""
        content = F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256)
        w = Window.partitionBy("chunk_id").orderBy(*([order] if order else []), content)
        rows = rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
        return self.change(rows, lambda old: old.join(rows.select("chunk_id"), "chunk_id", "left_semi"))

    def delete(self, condition: Column | None) -> int:
        """Take out what fits the condition; without one nothing happens."""
        return self.version if condition is None else self.change(None, lambda old: old.where(F.coalesce(condition, F.lit(False))))

    def delete_sources(self, sources: DataFrame) -> int:
        """Take out all chunks of the given source files."""
        return self.change(None, lambda old: old.join(sources.select("source_file").distinct(), "source_file", "left_semi"))

    def count(self) -> int:
        rows = self.read()
        return rows.count() if rows is not None else 0

    def reset(self) -> int:
        old = self.read()
        return self.replace(old.limit(0)) if old is not None else self.version


def write_lexical_index(chunks: DataFrame, path: str) -> None:
    """Postings, document lengths and term statistics of chunks as Parquet."""
    t = lexical.tokenized(chunks, "chunk_id", "text")
    lexical.postings(t).write.mode("overwrite").parquet(f"{path}/postings")
    t.select("doc", "length").write.mode("overwrite").parquet(f"{path}/documents")
    lexical.term_statistics(t, "okapi").write.mode("overwrite").parquet(f"{path}/terms")


def export(chunks: DataFrame, path: str, preview: int = 300) -> None:
    """JSON lines for inspection, with the beginning of each text."""
    chunks.withColumns({"preview": F.left("text", F.lit(preview)), "chars": F.length("text")}).drop("text").write.mode("overwrite").json(path)


def ingestion_report(chunks: DataFrame, required=("chunk_id", "source_file", "source_type", "law_name", "article_no")) -> DataFrame:
    """source_file, chunks, invalid (chunks that lack a required field)."""
    bad = F.lit(False)
    for c in required:
        bad = bad | (F.coalesce(F.col(c).cast("string"), F.lit("")) == "")
    return chunks.groupBy("source_file").agg(F.count("*").alias("chunks"), F.count_if(bad).alias("invalid"))


def upload(files: DataFrame, table: str, overwrite: bool = False) -> None:
    """Add files to an upload bucket."""
    files.write.mode("overwrite" if overwrite else "append").partitionBy("source_type").parquet(table)


def markdown(title: str, frames: dict[str, DataFrame], most: int = 100) -> str:
    """A report of small tables."""
    out = [f"# {title}", ""]
    for name, df in frames.items():
        rows = df.limit(most).collect()
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join(str(v) for v in r) + " |" for r in rows] + [""]
    return "\n".join(out)
