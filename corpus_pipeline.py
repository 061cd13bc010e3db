"""The corpus pipeline: stages over documents, each written as Parquet and reread as the next one's input.

Every stage works on all that its predecessor kept, and its decisions take effect: documents that the quality
classifier rejects go, one document of each group of equal texts and of each near-duplicate component stays,
documents that hold a benchmark item go, and what is left is encoded and decoded.  All stages but the last
return the columns of documents.  The stages tighten the session's bounds of an Arrow batch, since they run
after each other in one set of executors.

Rows are judged, not ids: where ids repeat or are null, the stages that drop copies number the rows by id (nulls
last) and text, so a row is dropped only for its own text, and null ids are deduplicated like others.  Defined
results: null text counts as empty; very long texts are used whole; of identical rows one stays; an empty table
gives an empty result; columns besides id and text, whatever their names, are passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import decontamination, quality_classifier
from auditlake.llm.common import bound_batches, new_path, read_table, stored
from auditlake.llm.exact_dedup import exact_dedup
from auditlake.llm.near_dedup import near_dedup
from auditlake.llm.sentencepiece_codec import encode_decode


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Score every whole text and keep what reaches the classifier's threshold."""
    bound_batches(spark)
    model = quality_classifier.fit(docs, read_table(spark, sf_dir, "labels"))
    return docs.where(quality_classifier.score_column(model, F.col("text")) >= quality_classifier.THRESHOLD)


ROW = "_pipeline_row"


def _rows(docs: DataFrame) -> DataFrame:
    """docs with a row key in the order of ids: the id itself where ids are distinct and not null, else a number."""
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").limit(1)
    if odd.isEmpty():
        return docs.withColumn(ROW, F.col("doc_id").cast("long"))
    ordered = docs.orderBy(F.col("doc_id").asc_nulls_last(), "text")
    return stored(ordered.withColumn(ROW, F.monotonically_increasing_id()), "pipeline-rows")


def _kept(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """rows without those that are not kept; Catalyst broadcasts the list only when it is small."""
    gone = decided.where(~F.col("kept")).select(F.col("doc_id").alias(ROW))
    return rows.join(gone, ROW, "left_anti").drop(ROW)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row with the smallest id of each group of equal texts."""
    rows = _rows(docs)
    return _kept(rows, exact_dedup(rows, id_col=ROW)).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each component of texts alike by 0.8 on five-word shingles."""
    rows = _rows(docs)
    return _kept(rows, near_dedup(rows, id_col=ROW)).select(docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that cover a benchmark item."""
    bound_batches(spark)
    return decontamination.annotate(docs, read_table(spark, sf_dir, "benchmark")).where(F.size("_hits") == 0).select(docs.columns)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text."""
    bound_batches(spark)
    return encode_decode(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("sentencepiece", encode_texts),
]

#: The classifier is fitted, so SQL cannot give the rows; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; the last one's rows."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
