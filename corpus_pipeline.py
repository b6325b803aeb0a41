"""A training-data pipeline of five stages over ``documents``; each stage reads what the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratecraft.llm.common import table
from ratecraft.llm.decontam import leaks
from ratecraft.llm.exact import exact_groups
from ratecraft.llm.packing import pack
from ratecraft.llm.quality import quality, train
from ratecraft.llm.queries import TOKENIZER
from ratecraft.llm.simhash import near_duplicates
from ratecraft.session import shared_folder


def _row(docs: DataFrame) -> str:
    """A name for the row key that no column of the documents has."""
    name = "__row"
    while name in docs.columns:
        name += "_"
    return name


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents with a row key: id, null ids last, and the digest of the text. Decisions of stages are made for keys, so rows
    that share only an id, or the lack of one, don't share a fate. A null text counts as empty."""
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    return docs.withColumn(_row(docs), F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), digest.alias("digest")))


def _by_row(docs: DataFrame) -> DataFrame:
    """(doc_id, text) for an operator, with row keys as ids."""
    return _keyed(docs).select(F.col(_row(docs)).alias("doc_id"), "text")


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The documents whose row key is not among the ids of ``dropped``."""
    row = _row(docs)
    return _keyed(docs).join(dropped.select(F.col("doc_id").alias(row)).distinct(), row, "left_anti").select(docs.columns)


def _one_each(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """One document for each row key among the ids of ``kept``: rows that repeat id and text are copies of each other."""
    row = _row(docs)
    return _keyed(docs).dropDuplicates([row]).join(kept.select(F.col("doc_id").alias(row)).distinct(), row, "left_semi").select(docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Null and empty texts are scored as empty, long texts whole; rows that repeat
    share one fate and stay as often as they occur. Other columns are carried and not looked at; an empty table gives no rows, and
    without labels of both kinds every document scores alike."""
    labels = table(spark, sf_dir, "labels")
    return _without(docs, quality(_by_row(docs), labels, model=train(docs, labels)).where("predicted = 0"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, one with the largest id; one without an id if none has any."""
    groups = exact_groups(docs).where("kept")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.unhex("text_sha256").alias("digest"))
    return _one_each(docs, groups.select(row.alias("doc_id")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints, one document with the smallest id; one without an id if none has any."""
    return _one_each(docs, near_duplicates(_by_row(docs)).where("doc_id = component_id"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; long texts are searched whole; repeated rows share one
    fate. Other columns are carried; an empty table, or an empty benchmark, drops nothing."""
    return _without(docs, leaks(_by_row(docs), table(spark, sf_dir, "benchmark")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left and their places in training sequences: null and empty texts are one end token, only documents
    longer than a sequence are cut, repeated rows are packed one by one, equal pieces are interchangeable. Other columns are
    left out; an empty table gives no rows."""
    return pack(docs, TOKENIZER)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_exact_copies),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("best-fit packing", pack_sequences),
]

#: a trained classifier decides the first stage, which SQL can't express; tests compare with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
    return docs
