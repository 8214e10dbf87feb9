"""The corpus pipeline: from the documents table to token ids, in five stages of the llm operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the shared folder and reads
again as the next stage's docs. All but the last return the columns of docs, extra ones too, whatever their names. Rows without doc_id
take part like others, except that the near-duplicate stage has no name to group them by and keeps them all.

Null and empty texts are scored like others, are in no group of near duplicates, have nothing to redact, and are never taken by the mix. Of
repeated rows, and of rows of one doc_id, the near-duplicate stage keeps one; the mix may take that one several times. Ties are
settled by doc_id, then by the text. Very long texts are worked on whole. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import bpe, jaccard, mixing, pii, quality
from lodestone.llm.shared import columns_free, documents, stage


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, does not reject."""
    model = quality.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = columns_free(docs, "__score")
    scored = quality.score(docs, model, name=score)
    return scored.where(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of 0.8 or more on five-word shingles connect, the one with the smallest doc_id;
    of several rows of that id the one with the smallest text. Documents without words are in no group and stay."""
    groups = jaccard.cluster(docs, 5, 80, 100)
    first, nth = columns_free(docs, "__first", "__n")
    firsts = groups.where("doc_id IS NOT NULL").select(F.col("component").alias(first)).distinct()
    kept = docs.join(firsts.hint("merge"), docs["doc_id"] == firsts[first], "left_semi")
    w = Window.partitionBy("doc_id").orderBy("text")
    kept = kept.withColumn(nth, F.row_number().over(w)).where(F.col(nth) == 1).drop(nth)
    return kept.unionByName(docs.where("doc_id IS NULL"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data redacted, and n_chars brought up to date."""
    clean = pii.redact(docs, pii.fit(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it."""
    return mixing.repeat(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, and the text's token ids, their number, and the ids decoded."""
    return bpe.encode(docs, bpe.tokenizer_path(), keep=["doc_id", "lang", "source"], what=("n_tokens", "ids", "decoded"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram jaccard join", near_duplicates),
    ("pii", personal_data),
    ("mixing sources", mix_sources),
    ("bpe", tokens),
]

#: The learned stages, the mix's schedule and the tokenizer have no counterpart in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
