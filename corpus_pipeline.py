"""A corpus from raw documents to packed sequences, in five stages; each is written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotrail.llm import langid, nearset, packing, recipes, secrets
from geotrail.llm.common import free_name, materialize
from geotrail.llm.queries import vocabulary


def _ready(spark: SparkSession, docs: DataFrame) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned from the labelled ones; those without a letter go. lang becomes the prediction.

    Whole texts count, however long. A null id is never held out. Columns keep their names and order.
    """
    docs, predicted = _ready(spark, docs), free_name("predicted", docs)
    prototypes = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))))
    named = docs.withColumn(predicted, langid.predict(F.col("text"), prototypes)["lang_pred"])
    return named.where(F.col(predicted) != langid.UNKNOWN).withColumn("lang", F.col(predicted)).select(*docs.columns)


def _with_sha(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with the digest of each text in a new column, and its name."""
    sha = free_name("sha", docs)
    return docs.withColumn(sha, F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)), sha


def _same_row(rows: DataFrame, sha: str, marked: DataFrame):
    """Whether a row of rows has the id and text that a row of marked (marked_id, marked_sha) names; null ids are ids."""
    return rows["doc_id"].eqNullSafe(marked["marked_id"]) & (rows[sha] == marked["marked_sha"])


def _marked(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("doc_id").alias("marked_id"), F.col("text_sha256").alias("marked_sha"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, that of the largest doc_id; one of those that repeat with id and text.

    A null text equals an empty one. Texts are compared whole, however long.
    """
    docs = _ready(spark, docs)
    kept = _marked(recipes.exact_duplicates(docs).where("kept"))
    named, sha = _with_sha(docs)
    return named.join(kept, _same_row(named, sha, kept), "left_semi").dropDuplicates(["doc_id", sha]).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that of the smallest doc_id. Rows that repeat an id with other texts are told apart.

    Of a group without a known id one row stays. Texts without words are linked with nothing and stay. Texts are compared whole, however long.
    """
    docs = _ready(spark, docs)
    found = materialize(nearset.near_duplicates(docs, with_sha=True).select("doc_id", "text_sha256", "kept"))
    stays = found.where("doc_id is null and kept").select(F.col("text_sha256").alias("stays"))
    lost = found.where(~F.col("kept")).join(stays, F.col("doc_id").isNull() & (F.col("text_sha256") == F.col("stays")), "left_anti")
    gone, (named, sha) = _marked(lost), _with_sha(docs)
    left = named.join(gone, _same_row(named, sha, gone), "left_anti")
    # rows without an id that repeat a text with words can't be told apart
    alike = F.col("doc_id").isNull() & F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return left.where(~alike).unionByName(left.where(alike).dropDuplicates([sha])).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret found in a text replaced by a mark; n_chars follows. A null text stays null; whole texts are read."""
    docs, spans = _ready(spark, docs), free_name("spans", docs)
    found = docs.withColumn(spans, secrets.secret_spans(F.col("text"), vocabulary("byte_bpe_50k.tiktoken")))
    text = F.when(F.size(spans) > 0, secrets.masked(F.col("text"), F.col(spans))).otherwise(F.col("text"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 4096 ids. A null text is the end id alone; longer ones are cut."""
    return packing.pack_documents(_ready(spark, docs), vocabulary("word_bpe_49k.json"), keep_ids=False)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("pack", pack)]

#: Language prediction, similarity and packing have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
