"""Corpus pipeline: from raw documents to packed training sequences.

Each stage applies one operator of ``tarnlake.llm`` to all that the stage before it kept. ``run``
writes every stage's result as Parquet into the shared folder and reads it back, so that a lost
executor never costs more than the stage it works on.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm import decontamination, jaccard_join, packing, pii, toxicity
from tarnlake.llm.common import bucket_of, delete, free_prefix, quoted, scratch, settle, shared_dir, table

#: Toxicity score from which a document is rejected.
REJECT = 0.7
#: Words to a shingle and Jaccard similarity in percent for near duplicates.
NEAR = (5, 80)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on its training fold of the labels, does not reject."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), train_rows=bucket_of("doc_id", 3) != 1)
    score = free_prefix(docs) + "toxicity"
    return toxicity.score(docs, model, into=score).where(F.col(score) < REJECT).select(*map(quoted, docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows one with the smallest doc_id, null last. Different texts of one doc_id are rows of
    their own; rows without words are only linked with their exact copies, those without an id either all stay."""
    p = free_prefix(docs)
    own, rows, n = f"{p}key", f"{p}rows", f"{p}n"
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("t"))
    keyed = docs.withColumn(own, key)
    found = jaccard_join.join_components(keyed.select(F.col(own).alias("doc_id"), "text"), *NEAR)
    first = found.where("doc_id = component_id").groupBy(F.col("doc_id").alias(own)).agg(F.count("*").alias(rows), F.max("n_shingles").alias(n))
    # The keys grow with the corpus, so they are never broadcast, whatever their size happens to be.
    kept = settle(keyed.join(settle(first, "kept").hint("merge"), own), "kept")
    every = (F.col(rows) == 1) | ((F.col(n) == 0) & F.col(f"{own}.none"))
    # Rows that repeat a key are exact copies; there are few, so only they are grouped.
    repeated = kept.where(~every).dropDuplicates([own])
    return kept.where(every).unionByName(repeated).select(*map(quoted, docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window that is similar to a benchmark item."""
    own = free_prefix(docs) + "key"
    keyed = docs.withColumn(own, F.xxhash64("doc_id", "text"))
    found = decontamination.contaminated(keyed.select(F.col(own).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return keyed.join(found.select(F.col("doc_id").alias(own)).distinct(), own, "left_anti").select(*map(quoted, docs.columns))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; spans of personal data give way to their kind, n_chars follows."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*map(quoted, docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The placed pieces of all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

#: Training a model, finding components and packing are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's intermediate tables go as it ends, its result as the next one's is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/tarnlake-{spark.sparkContext.applicationId}/stage-{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
