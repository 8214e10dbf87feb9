"""Reading corpora: files in buckets, PDF pages, sidecars, manifests, labelled folders, evaluation sets, uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from lodestone.functions.text import squeeze

BUCKETS = ("laws", "regulations", "amendments", "internal_docs", "uploads")
SIDECAR = "law_name STRING, law_number STRING, effective_date STRING, source_type STRING, language STRING, tags ARRAY<STRING>, notes STRING"
UPLOAD_TYPES = {"pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "tiff": "image/tiff", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document"}


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem_of(path: Column) -> Column:
    return F.regexp_replace(name_of(path), r"(?<=.)\.[^.]*$", "")


def extension_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(name_of(path), r"\.([^.]+)$", 1))


def bucket_of(path: Column, roots: dict[str, str]) -> Column:
    """The bucket under whose folder a path lies. roots: bucket to folder."""
    out = F.lit("unknown")
    for bucket, root in roots.items():
        out = F.when(path.contains(root.rstrip("/") + "/"), bucket).otherwise(out)
    return out


def kept(path: Column) -> Column:
    """No readme, no hidden file, no sidecar."""
    name = F.lower(name_of(path))
    return ~name.isin("readme.md", "readme.txt", ".gitkeep") & ~name.startswith(".") & ~name.endswith(".meta.json")


def files(spark: SparkSession, roots: dict[str, str], patterns=("*.txt", "*.md")) -> DataFrame:
    """source, source_file, source_type, source_dir, law_name, sha256, content of the files in all buckets, in the buckets' order (bucket_no).
    Buckets that do not exist are empty."""
    out = spark.createDataFrame([], "source string, content binary, source_dir string, source_type string, bucket_no int")
    for n, (bucket, root) in enumerate(roots.items()):
        for pattern in patterns:
            try:
                got = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
            except AnalysisException:
                continue
            out = out.unionByName(got.select(F.col("path").alias("source"), "content", F.lit(root).alias("source_dir"), F.lit(bucket).alias("source_type"), F.lit(n).alias("bucket_no")))
    out = out.where(kept(F.col("source")))
    return out.select("source", name_of(F.col("source")).alias("source_file"), "source_type", "source_dir", stem_of(F.col("source")).alias("law_name"), F.sha2("content", 256).alias("sha256"), "content", "bucket_no")


def texts(found: DataFrame) -> DataFrame:
    """files() with their content as text; what is no UTF-8 is replaced."""
    return found.withColumn("text", F.col("content").cast("string")).drop("content")


def merge_pages(pages: DataFrame) -> DataFrame:
    """source, text, page_start, page_end of pages (source, page from 0, text): in order, each with a marker before it, blank ones left out."""
    part = F.when(F.coalesce("text", F.lit("")) != "", F.concat(F.lit("[[RAG_PAGE:"), (F.col("page") + 1).cast("string"), F.lit("]]\n"), F.col("text")))
    got = pages.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("page", part.alias("part")))).alias("parts"), (F.min("page") + 1).alias("page_start"), (F.max("page") + 1).alias("page_end"))
    return got.select("source", F.array_join(F.transform("parts", lambda x: x["part"]), "\n\n").alias("text"), "page_start", "page_end")


def page_at(text: Column, offset: Column, fallback: Column | None = None) -> Column:
    """The page of a place in a text with markers; the fallback before the first one."""
    marks = F.regexp_extract_all(F.left(text, offset), F.lit(r"\[\[RAG_PAGE:(\d+)\]\]"), F.lit(1))
    return F.coalesce(F.element_at(F.when(F.size(marks) > 0, marks), -1).cast("int"), fallback if fallback is not None else F.lit(None).cast("int"))


def sidecars(spark: SparkSession, root: str) -> DataFrame:
    """stem and the fields of every <stem>.meta.json."""
    got = spark.read.schema(SIDECAR).option("multiLine", True).option("pathGlobFilter", "*.meta.json").option("recursiveFileLookup", True).json(root)
    return got.select(F.regexp_replace(name_of(F.col("_metadata.file_path")), r"\.meta\.json$", "").alias("stem"), *(f.split()[0] for f in SIDECAR.split(", ")))


def with_sidecars(docs: DataFrame, meta: DataFrame) -> DataFrame:
    """docs completed by their sidecars: what a document says itself wins unless it is null, empty or "unknown"; tags become one list with commas."""
    names = [f.split()[0] for f in SIDECAR.split(", ")]
    said = lambda c: F.nullif(F.nullif(F.trim(c), F.lit("unknown")), F.lit(""))
    side = meta.select(F.col("stem").alias("__stem"), *(F.col(n).alias(f"__{n}") for n in names))
    joined = docs.withColumn("__mine", stem_of(F.col("source_file"))).join(side, F.col("__mine") == F.col("__stem"), "left")
    default = {"language": "tr", "notes": "", "tags": ""}
    out = {}
    for n in names:
        other = F.array_join("__tags", ",") if n == "tags" else F.col(f"__{n}")
        own = said(F.col(n).cast("string")) if n in docs.columns else F.lit(None).cast("string")
        out[n] = F.coalesce(own, F.nullif(F.nullif(other, F.lit("unknown")), F.lit("")), F.lit(default.get(n, "unknown")))
    return joined.withColumns(out).drop("__mine", "__stem", *(f"__{n}" for n in names))


def manifest_diff(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """source_file and change (changed or removed) between what there is and what was indexed (both source_file, sha256); unchanged files are left out."""
    now = current.groupBy("source_file").agg(F.min("sha256").alias("now"))
    both = now.join(manifest.select("source_file", F.col("sha256").alias("old")), "source_file", "full_outer")
    change = F.when(F.col("now").isNull(), "removed").when(F.col("old").isNull() | (F.col("now") != F.col("old")), "changed")
    return both.select("source_file", change.alias("change")).where("change IS NOT NULL")


def changed_only(docs: DataFrame, diff: DataFrame) -> DataFrame:
    """The documents whose source changed."""
    return docs.join(diff.where("change = 'changed'").select("source_file"), "source_file", "left_semi")


def first_of_each(chunks: DataFrame, id: str = "chunk_id", order: str = "ordinal") -> DataFrame:
    """Of rows with one id the first; for large inputs the minimum is aggregated before the shuffle."""
    first = chunks.groupBy(id).agg(F.min(order).alias(order))
    return chunks.join(first, [id, order], "left_semi")


LABELS = "document_id STRING, pdf_path STRING, ocr_json_path STRING, label STRING, is_synthetic STRING, hard_case_tags STRING, split STRING, notes STRING"


def label_manifest(spark: SparkSession, path: str, classes) -> DataFrame:
    """A CSV of labelled documents, with flags and tags decoded; ValueError names labels that the taxonomy does not have."""
    rows = spark.read.option("header", True).schema(LABELS).csv(path)
    bad = [r["label"] for r in rows.where(F.col("label").isNotNull() & (F.col("label") != "") & ~F.col("label").isin(*classes)).select("label").distinct().limit(20).collect()]
    if bad:
        raise ValueError(f"labels outside the taxonomy: {', '.join(sorted(bad))}")
    tags = F.filter(F.split(F.coalesce("hard_case_tags", F.lit("")), r"\|"), lambda t: t != "")
    return rows.withColumns({"is_synthetic": F.col("is_synthetic").isin("1", "true", "True"), "hard_case_tags": tags})


def write_label_manifest(rows: DataFrame, path: str) -> None:
    flat = rows.withColumns({"is_synthetic": F.when(F.col("is_synthetic"), "1").otherwise("0"), "hard_case_tags": F.array_join("hard_case_tags", "|")})
    flat.write.option("header", True).mode("overwrite").csv(path)


def class_folders(listing: DataFrame, names: dict[str, str], marks=("synthetic", "sentetik", "uydurma")) -> tuple[DataFrame, DataFrame]:
    """(documents, unmapped): of paths (path) the label by their folder's name and whether the name marks them as made up; and the folders without a label."""
    folder = F.regexp_extract("path", r"([^/]*)/[^/]*$", 1)
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else F.create_map().cast("map<string,string>")
    rows = listing.select("path", folder.alias("folder"), stem_of(F.col("path")).alias("document_id")).withColumn("label", table[F.lower("folder")])
    made_up = F.lower("document_id").rlike("|".join(marks))
    return rows.where("label IS NOT NULL").withColumn("is_synthetic", made_up), rows.where("label IS NULL").groupBy("folder").agg(F.count("*").alias("n"))


def paired(pdfs: DataFrame, results: DataFrame) -> DataFrame:
    """PDF paths with the path of the recognition result of the same stem, null where there is none."""
    right = results.select(stem_of(F.col("path")).alias("stem"), F.col("path").alias("ocr_json_path"))
    return pdfs.select(stem_of(F.col("path")).alias("stem"), F.col("path").alias("pdf_path")).join(right, "stem", "left")


EXAMPLE = "id STRING, query STRING, expected_law_numbers ARRAY<STRING>, expected_article_numbers ARRAY<STRING>, relevant_chunk_ids ARRAY<STRING>, relevant_source_files ARRAY<STRING>, notes STRING, split STRING"


def eval_set(spark: SparkSession, path: str) -> DataFrame:
    """An evaluation set from JSON, a list or {examples: list}; lists that are missing are empty, the split is synthetic by default."""
    rows = spark.read.schema(f"examples ARRAY<STRUCT<{', '.join(f.replace(' ', ': ', 1) for f in EXAMPLE.split(', '))}>>, {EXAMPLE}").option("multiLine", True).json(path)
    fields = [f.split()[0] for f in EXAMPLE.split(", ")]
    flat = rows.where("examples IS NULL").select(*fields).unionByName(rows.where("examples IS NOT NULL").select(F.explode("examples").alias("e")).select("e.*"))
    lists = {n: F.coalesce(n, F.array().cast("array<string>")) for n in fields if n.startswith(("expected", "relevant"))}
    return flat.withColumns(lists | {"split": F.coalesce("split", F.lit("synthetic")), "notes": F.coalesce("notes", F.lit(""))})


def decoded_size(b64: Column) -> Column:
    """Bytes that a base64 text decodes to; its line breaks and blanks do not count."""
    b64 = F.translate(b64, " \t\r\n", "")
    return F.floor(F.length(b64) * 3 / 4).cast("long") - F.when(b64.endswith("=="), 2).when(b64.endswith("="), 1).otherwise(0)


def upload_errors(name: Column, mime: Column, size: Column, types: dict[str, str] = UPLOAD_TYPES, most: int = 10 << 20) -> Column:
    """What is wrong with an upload: its type (by MIME, or by extension where that is empty), emptiness, size."""
    ext = extension_of(name)
    given = F.coalesce(F.trim(mime), F.lit(""))
    fits = F.when(given == "", ext.isin(*types)).otherwise(F.lower(given).isin(*types.values()))
    return F.array_compact(F.array(F.when(~fits, "unsupported_type"), F.when(F.coalesce(size, F.lit(0)) <= 0, "empty_file"), F.when(size > most, "file_too_large")))


def validated(found: DataFrame, allowed=("pdf", "png", "jpg", "jpeg", "tiff", "docx", "pptx", "xlsx", "txt"), most: int = 50 << 20) -> DataFrame:
    """files with `errors`: extension, emptiness and size."""
    size = F.octet_length("content")
    return found.withColumn("errors", F.array_compact(F.array(F.when(~extension_of(F.col("source")).isin(*allowed), "unsupported_extension"), F.when(size == 0, "empty_file"), F.when(size > most, "file_too_large"))))


def contract_text(pages: Column) -> Column:
    """One text of an array of page texts, with markers."""
    made = F.transform(pages, lambda t, i: F.when(F.trim(F.coalesce(t, F.lit(""))) != "", F.concat(F.lit("[[RAG_PAGE:"), (i + 1).cast("string"), F.lit("]]\n"), squeeze(t))))
    return F.array_join(made, "\n\n")


def contract_query(question: Column, law: Column, article: Column) -> Column:
    """A question with the law and article it is filtered by written out."""
    cite = F.concat_ws(" ", F.concat(law, F.lit(" sayılı kanun")), F.concat(F.lit("madde "), article))
    return F.trim(F.concat_ws(" ", F.nullif(cite, F.lit("")), squeeze(question)))


def dispatch(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """payloads with `kind` (state, index, query) and `error` by what their JSON object holds."""
    has = lambda k: F.get_json_object(payload, f"$.{k}").isNotNull()
    kind = F.when(F.try_parse_json(F.col(payload)).isNull(), F.lit(None)).when(has("ocr") | has("request"), "state").when(has("pages") | has("text"), "index").when(has("query") | has("question"), "query")
    return payloads.withColumn("kind", kind).withColumn("error", F.when(F.try_parse_json(F.col(payload)).isNull(), "invalid_json").when(F.col("kind").isNull(), "unknown_request"))
